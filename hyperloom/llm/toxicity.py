"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of 3 to 7 characters (code points) of the text in Unicode lower case, all but
letters, marks and digits read as space; a feature counts once a text. Its log-count ratio is the log of its smoothed share of toxic texts over
that of the others. The KEPT features whose shares differ most (in standard errors) enter a logistic
regression on presence times ratio, trained on a bounded sample of labelled rows. Only features with a
weight are looked up when scoring, and every whole text is scored.

Defined results: null text counts as empty; an empty text scores as a text without any feature; without
both labels in the sample every score is the sample's smoothed share; repeated rows have equal scores; an
empty table gives an empty result; columns besides id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm import textkernel as tk
from hyperloom.llm.labelled import SAMPLE_ROWS, held_out, sample
from hyperloom.llm.shared import small_batches, table, text_column

ORDERS = (3, 4, 5, 6, 7)
BITS = 21
KEPT = 4096
THRESHOLD = 0.3


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Characters in lower case, space for all but letters, marks and digits; and the rows' offsets in them."""
    found, offsets = tk.code_points(*tk.arrow_bytes(tk.lower(column)))
    return np.where(tk.is_letter(found), found, np.uint32(32)), offsets


def ngrams(found: np.ndarray, offsets: np.ndarray):
    """For each order: hashed n-grams (BITS bits) at every character, and the first one past the last whole one of each row."""
    code = found * np.uint32(0x9E3779B1)
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    code ^= code >> np.uint32(12)
    value = code.copy()
    for order in range(2, max(ORDERS) + 1):
        if len(code) < order:
            return
        value = value[:-1] * np.uint32(0x9E3779B1) + code[order - 1 :]
        if order in ORDERS:
            mixed = value ^ (value >> np.uint32(15))
            mixed = mixed * np.uint32(0x85EBCA6B) + np.uint32(order)
            yield mixed >> np.uint32(32 - BITS), offsets[1:] - (order - 1)


def present(chars: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct (row << BITS | feature), of wanted features only if given."""
    if wanted is None:
        return _all_present(chars, offsets)
    found = []
    for feature, stops in ngrams(chars, offsets):
        at = np.flatnonzero(wanted[feature])
        row = np.searchsorted(offsets, at, "right") - 1
        whole = at < stops[row]
        found.append((row[whole] << BITS) | feature[at[whole]].astype(np.int64))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _all_present(chars: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Distinct (row << BITS | feature) of all features, row by row: a feature's last place in a row stands for it."""
    orders, table, out = list(ngrams(chars, offsets)), np.zeros(1 << BITS, np.int32), []
    for row, lo in enumerate(offsets[:-1]):
        own = [feature[lo : max(lo, stops[row])] for feature, stops in orders]
        own = np.concatenate(own) if own else np.zeros(0, np.uint32)
        place = np.arange(len(own), dtype=np.int32)
        table[own] = place
        out.append((row << BITS) | own[table[own] == place].astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Model:
    """Weights by feature and a bias."""

    def __init__(self, bias: float, weight: np.ndarray):
        self.bias, self.weight = bias, weight.astype(np.float32)
        self.used = self.weight != 0

    def score(self, column: pa.Array) -> np.ndarray:
        chars, offsets = characters(column)
        n = len(offsets) - 1
        total = np.full(n, self.bias)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + tk.BLOCK, "right")) - 1)
            lo, rows = offsets[at], offsets[at : to + 1] - offsets[at]
            if to - at == 1 and rows[-1] > 4 * tk.BLOCK:  # a very long text, piece by piece
                keys = np.zeros(0, np.int64)
                for i in range(0, int(rows[-1]), tk.BLOCK):
                    piece = chars[lo + i : min(lo + i + tk.BLOCK + max(ORDERS) - 1, offsets[to])]
                    keys = np.union1d(keys, present(piece, np.array([0, len(piece)]), self.used))
            else:
                keys = present(chars[lo : offsets[to]], rows, self.used)
            total[at:to] += np.bincount(keys >> BITS, self.weight[keys & ((1 << BITS) - 1)], to - at)
            at = to
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def train(texts: list[str], labels: np.ndarray, kept: int = KEPT, steps: int = 60, ridge: float = 1e-4) -> Model:
    """Fits the classifier on labelled texts."""
    n = np.array([(labels == k).sum() for k in (0, 1)])
    if n.min() == 0:
        return Model(float(np.log((n[1] + 1) / (n[0] + 1))), np.zeros(1 << BITS))
    column = pa.array(texts, pa.large_string())
    step = 256
    shares = np.zeros((2, 1 << BITS), np.float32)

    def parts():
        for i in range(0, len(texts), step):
            yield i, *characters(column.slice(i, step))

    for i, chars, offsets in parts():
        keys = present(chars, offsets)
        feature, toxic = keys & ((1 << BITS) - 1), labels[i + (keys >> BITS)]
        for k in (0, 1):
            shares[k] += np.bincount(feature[toxic == k], minlength=1 << BITS)
    p = (shares + 1) / (n[:, None] + 2)
    ratio = np.log(p[1] / p[0])
    strength = np.abs(p[1] - p[0]) / np.sqrt(p[0] * (1 - p[0]) / n[0] + p[1] * (1 - p[1]) / n[1])
    strength[shares.sum(axis=0) == 0] = 0
    chosen = np.sort(np.argsort(-strength, kind="stable")[:kept])
    ratio = ratio[chosen]
    del p, shares, strength
    wanted = np.zeros(1 << BITS, bool)
    wanted[chosen] = True
    places, rows = [], []
    for i, chars, offsets in parts():
        keys = present(chars, offsets, wanted)
        places.append(np.searchsorted(chosen, keys & ((1 << BITS) - 1)).astype(np.int32))
        rows.append((i + (keys >> BITS)).astype(np.int32))
    place, row = np.concatenate(places), np.concatenate(rows)

    def loss(theta):
        """Mean logistic loss with a ridge, and its gradient; the last parameter is the bias."""
        z = np.bincount(row, (theta[:-1] * ratio)[place], len(texts)) + theta[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels
        slope = np.bincount(place, error[row], len(chosen)) * ratio / len(texts) + ridge * theta[:-1]
        value = np.mean(np.logaddexp(0, z) - labels * z) + ridge / 2 * np.square(theta[:-1]).sum()
        return value, np.append(slope, error.mean())

    theta = minimise(loss, np.append(np.zeros(len(chosen)), np.log(n[1] / n[0])), steps)
    weight = np.zeros(1 << BITS, np.float32)
    weight[chosen] = theta[:-1] * ratio
    weight[np.abs(weight) < 0.005 * np.abs(weight).max()] = 0
    return Model(float(theta[-1]), weight)


def minimise(f, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent of f, which gives value and gradient."""
    value, slope = f(x)
    pairs: list[tuple] = []
    for _ in range(steps):
        way, shares = -slope, []
        for s, y, r in reversed(pairs):
            shares.append(r * (s @ way))
            way = way - shares[-1] * y
        if pairs:
            way = way * ((pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]))
        for (s, y, r), share in zip(pairs, reversed(shares), strict=True):
            way = way + (share - r * (y @ way)) * s
        rate = 1.0 if pairs else 1 / max(1.0, float(np.linalg.norm(slope)))
        new, turned = f(x + rate * way)
        while new > value + 1e-4 * rate * (slope @ way) and rate > 1e-8:
            rate /= 2
            new, turned = f(x + rate * way)
        s, y = rate * way, turned - slope
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y, 1 / (s @ y))][-memory:]
        done = abs(value - new) <= 1e-8 * max(1.0, abs(value))
        x, value, slope = x + s, new, turned
        if done:
            break
    return x


def classify(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # a fixed table of 2**BITS numbers

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(shared.value.score(batch.column(1)))], ["doc_id", "score"])

    scored = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column(text).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    texts, labels = sample(docs, table(spark, sf_dir, "labels", ["doc_id", "toxic"]), "toxic", SAMPLE_ROWS)
    return classify(docs, train(texts, labels))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE: dict[str, str] = {}
