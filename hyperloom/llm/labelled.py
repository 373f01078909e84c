"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most, the longest text among them, and their characters in all.
SAMPLE_ROWS = 6000
SAMPLE_CHARS = 200_000
SAMPLE_TOTAL = 24_000_000
FOLDS, HELD_OUT = 4, 2


def fold(column):
    """crc32 of the id as text, modulo FOLDS."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(FOLDS))


def held_out(column: str = "doc_id"):
    """True for rows whose labels are never learned from; a null id is not held out."""
    return F.coalesce(fold(column) == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, total: int = SAMPLE_TOTAL) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of at most `rows` labelled documents outside the held-out fold, of at most `total` characters.

    The ids with the least hashes are taken, so the same tables give the same sample. Repeated ids count
    once: the largest label, the first text in order.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    ids = usable.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text")
    # At most `rows` short rows are broadcast.
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    # At most `rows` rows are ordered, and texts of `total` characters come to the driver.
    upto = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    found = sorted((x.doc_id, x.text, x.label) for x in found.withColumn("upto", upto).where(F.col("upto") <= total).collect())
    return [x[1] for x in found], np.array([int(x[2] > 0) for x in found], np.int64)
