"""Profiles as bundles of bound answers: prefix bundles, cleanup readouts, changed profiles.

The dense part (prefix sums of item-times-level vectors, and scores of five levels for every item) runs on
Arrow batches of respondents; everything about the results is DataFrame work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.functions.codebook import bound, packed, unpacked
from hyperloom.sources.answers import ITEMS, LEVELS, WIDTHS

DIMENSION = 256


def _label(kind: str, seed: int, *more):
    return F.concat_ws("|", F.lit(kind), F.lit(str(seed)), *more)


def keys(spark, seed: int, dimension: int = DIMENSION) -> DataFrame:
    """(pos, words) of the items' key vectors."""
    return spark.range(1, ITEMS + 1).select(F.col("id").cast("int").alias("pos"), packed(_label("item", seed, F.col("id").cast("string")), dimension).alias("words"))


def levels(spark, seed: int, dimension: int = DIMENSION) -> DataFrame:
    """(level, words): levels between two endpoints. A coordinate's two-bit draw u gives level i the first endpoint if u < 5 - i."""
    one = spark.range(1).select(*(packed(_label(k, seed), dimension).alias(k) for k in ("first", "second", "high", "low")))
    flip = lambda x: F.lit(0xFFFFFFFF).bitwiseXOR(x)
    zipped = F.arrays_zip("first", "second", "high", "low")

    def word(i):
        def of(z):
            mask = {1: F.lit(0xFFFFFFFF), 2: flip(z["high"].bitwiseAND(z["low"])), 3: flip(z["high"]), 4: flip(z["high"].bitwiseOR(z["low"])), 5: F.lit(0)}[i]
            return z["first"].bitwiseAND(mask).bitwiseOR(z["second"].bitwiseAND(flip(mask)))

        return F.transform(zipped, of)

    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), word(i).alias("words")) for i in range(1, LEVELS + 1))))
    return one.select(rows.alias("x")).select("x.level", "x.words")


def facts(spark, seed: int, dimension: int = DIMENSION) -> DataFrame:
    """(pos, level, words): each item's key bound to each level."""
    a, b = keys(spark, seed, dimension).alias("a"), levels(spark, seed, dimension).alias("b")
    return a.join(b).select("a.pos", "b.level", bound(F.col("a.words"), F.col("b.words")).alias("words"))


def fact_vectors(spark, seed: int, dimension: int = DIMENSION) -> np.ndarray:
    """All facts as an (items, levels, dimension) array: a fixed 250 rows, collected."""
    rows = facts(spark, seed, dimension).orderBy("pos", "level").collect()
    return unpacked(np.array([x.words for x in rows], np.int64)).reshape(ITEMS, LEVELS, dimension)


def shared_books(spark, seeds, books: dict | None = None, dimension: int = DIMENSION):
    """Each seed's fact vectors, broadcast: a fixed 250 vectors a seed."""
    return spark.sparkContext.broadcast(books or {s: fact_vectors(spark, s, dimension) for s in seeds})


def prefixes(book: np.ndarray, scored: np.ndarray, widths=WIDTHS) -> np.ndarray:
    """(respondents, widths, dimension) sums of the first answers' facts: one running sum, copied at each width."""
    out = np.empty((len(scored), len(widths), book.shape[2]), np.int64)
    total, at = np.zeros((len(scored), book.shape[2]), np.int16), 0
    for width in sorted(set(widths)):
        for i in range(at, width):
            total += book[i][scored[:, i] - 1]
        at = width
        for k in np.flatnonzero(np.array(widths) == width):
            out[:, k] = total
    return out


def _some(batches, rows: int = 256):
    """Batches cut to a bounded number of respondents, so that their bundles stay small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def bundles(profiles: DataFrame, seeds, dimension: int = DIMENSION, widths=WIDTHS) -> DataFrame:
    """(seed, vid, width, vector): a respondent's prefix bundles."""
    books = shared_books(profiles.sparkSession, seeds, None, dimension)

    def run(batches):
        for batch in _some(batches):
            vid, scored = batch.column(0), batch.column(1).flatten().to_numpy().reshape(-1, ITEMS)
            for seed, book in books.value.items():
                made = prefixes(book, scored, widths)
                n = len(scored) * len(widths)
                vectors = pa.FixedSizeListArray.from_arrays(pa.array(made.reshape(-1).astype(np.int16)), dimension).cast(pa.list_(pa.int16()))
                yield pa.record_batch([pa.array(np.full(n, seed, np.int32)), pa.array(np.repeat(vid.to_numpy(), len(widths))), pa.array(np.tile(np.array(widths, np.int32), len(scored))), vectors], ["seed", "vid", "width", "vector"])

    return profiles.select("vid", "levels").mapInArrow(run, "seed int, vid long, width int, vector array<smallint>")


def readouts(profiles: DataFrame, seeds, dimension: int = DIMENSION, widths=WIDTHS, books: dict | None = None) -> DataFrame:
    """(seed, width, vid, pos, true_level, squared, dots): the five levels' dot products for every item of every bundle."""
    books = shared_books(profiles.sparkSession, seeds, books, dimension)

    def run(batches):
        for batch in _some(batches):
            vid, scored = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, ITEMS)
            for seed, book in books.value.items():
                made = prefixes(book, scored, widths)
                squared = np.square(made).sum(axis=2)
                flat = book.reshape(-1, dimension).astype(np.float32)
                for k, width in enumerate(widths):
                    dots = (made[:, k].astype(np.float32) @ flat.T).astype(np.int64).reshape(len(vid), ITEMS, LEVELS)[:, :width]
                    n = len(vid) * width
                    yield pa.record_batch([
                        pa.array(np.full(n, seed, np.int32)), pa.array(np.full(n, width, np.int32)), pa.array(np.repeat(vid, width)),
                        pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(vid))), pa.array(scored[:, :width].reshape(-1).astype(np.int32)),
                        pa.array(np.repeat(squared[:, k], width)), pa.FixedSizeListArray.from_arrays(pa.array(dots.reshape(-1)), LEVELS).cast(pa.list_(pa.int64())),
                    ], ["seed", "width", "vid", "pos", "true_level", "squared", "dots"])

    return profiles.select("vid", "levels").mapInArrow(run, "seed int, width int, vid long, pos int, true_level int, squared long, dots array<long>")


def cleaned(found: DataFrame) -> DataFrame:
    """Adds the winning level (ties: the lower), its dot product and the runner-up's."""
    ordered = F.array_sort(F.transform("dots", lambda x, i: F.struct((-x).alias("d"), (i + 1).alias("level"))))
    out = found.withColumn("x", ordered)
    return out.select("seed", "width", "vid", "pos", "true_level", "squared", F.col("x")[0]["level"].cast("int").alias("predicted"), (-F.col("x")[0]["d"]).alias("best"), (-F.col("x")[1]["d"]).alias("second"))


def changed(answered: DataFrame, seed_label: str, shares: dict[str, float], variants: int, widths=WIDTHS) -> DataFrame:
    """(width, condition, variant, vid, levels, pos, old, new) of respondents (vid, raw, levels): answers moved by one step at hash-ranked positions.

    round(width * share) positions a variant; the end answers move inward, others by the hash's parity. All in
    a respondent's own row.
    """
    spark = answered.sparkSession
    rows = [(w, c, v, round(w * s)) for w in widths for c, s in shares.items() for v in range(variants)]
    design = spark.createDataFrame(rows, "width int, condition string, variant int, moves int")
    spread = answered.join(F.broadcast(design))  # a fixed design
    label = lambda pos: F.concat_ws("|", F.lit(seed_label), *(F.col(c).cast("string") for c in ("vid", "width", "condition", "variant")), pos.cast("string"))
    ranked = F.transform(F.sequence(F.lit(1), F.col("width")), lambda pos: F.struct(F.sha2(label(pos), 256).alias("h"), pos.alias("pos")))
    spread = spread.withColumn("x", F.slice(F.array_sort(ranked), F.lit(1), F.col("moves")))
    raw = lambda x: F.element_at("raw", x["pos"])
    even = lambda x: F.conv(F.substring(x["h"], 64, 1), 16, 10).cast("int") % 2 == 0
    step = lambda x: F.when(raw(x) == 1, 1).when(raw(x) == 5, -1).when(even(x), 1).otherwise(-1)
    scored = lambda x, value: F.when(x["pos"] % 2 == 0, 6 - value).otherwise(value)  # noqa: E731  even positions are keyed backward
    return spread.select(
        "width", "condition", "variant", "vid", "levels", F.transform("x", lambda x: x["pos"]).alias("pos"),
        F.transform("x", lambda x: scored(x, raw(x))).alias("old"), F.transform("x", lambda x: scored(x, raw(x) + step(x))).alias("new"),
    )


def perturbed(changes: DataFrame, seed: int, dimension: int = DIMENSION, widths=WIDTHS, book: np.ndarray | None = None) -> DataFrame:
    """(width, condition, variant, vid, changed, dot, base_squared, new_squared, ideal) of changes (width, condition, variant, vid, levels, pos, old, new): bundles updated by their changed facts."""
    books = shared_books(changes.sparkSession, (seed,), None if book is None else {seed: book}, dimension)
    changes = changes.select("width", "condition", "variant", "vid", "levels", "pos", "old", "new")

    def run(batches):
        book = books.value[seed]
        gram = np.einsum("ld,md->lm", book[0].astype(np.int64), book[0].astype(np.int64))
        for batch in _some(batches):
            out = []
            scored = batch.column(4).flatten().to_numpy().reshape(-1, ITEMS)
            # Rows of one respondent stand together and share their prefixes.
            known, made = None, None
            vids = batch.column(3).to_pylist()
            for k, (width, pos, old, new) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 5, 6, 7)), strict=True)):
                if known is None or vids[k] != known:
                    known, made = vids[k], prefixes(book, scored[k : k + 1], widths)[0]
                p, o, n = np.array(pos, int) - 1, np.array(old, int) - 1, np.array(new, int) - 1
                base = made[widths.index(width)]
                after = base + (book[p, n].astype(np.int64) - book[p, o]).sum(axis=0)
                out.append((len(p), int(base @ after), int(base @ base), int(after @ after), int((width - len(p)) * dimension + gram[o, n].sum())))
            yield pa.record_batch([*(batch.column(i) for i in range(4)), *(pa.array([x[i] for x in out], pa.int64()) for i in range(5))], ["width", "condition", "variant", "vid", "changed", "dot", "base_squared", "new_squared", "ideal_dot"])

    return changes.mapInArrow(run, "width int, condition string, variant int, vid long, changed long, dot long, base_squared long, new_squared long, ideal_dot long")
