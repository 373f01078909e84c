"""Quality: random-indexing word vectors pooled per document, then a two-layer network.

Random indexing. Every word has a sparse ternary index vector drawn from its hash. A word's vector is
its index vector and the mean of those of its neighbours (two on either side) over the labelled sample. The
vocabulary is the commonest words of the sample; a word outside it, and one not in plain form (with
digits or signs, or a repetition of the word just before), is represented by its form: the kinds of
characters it holds and whether it repeats are a word of the same vocabulary, with index vector and
neighbours like any other. A document is pooled to the mean and spread of its word vectors; nothing else
about it is an input.

Network. Pooled vectors, standardised, to HIDDEN rectified units to one logit, trained with Adam in
numpy on a bounded sample of labelled rows. A part of the sample (CALIBRATION) is kept from training
and sets the temperature that divides the logit.

Defined results: null text counts as empty; an empty text pools to zeros and is scored like any other;
without both labels in the sample every score is the sample's smoothed share; repeated rows have equal
scores; an empty table gives an empty result; other columns are ignored, or kept by `accepted`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm import textkernel as tk
from hyperloom.llm.labelled import SAMPLE_ROWS, held_out, sample
from hyperloom.llm.shared import small_batches, table, text_column

DIM = 32
NONZERO = 6
NEIGHBOURS = 2
VOCABULARY = 1 << 15
SHAPES = 512
HIDDEN = 32
CALIBRATION = 0.2
THRESHOLD = 0.7
_WORD = ~tk.SPACE

#: Kinds of bytes, one bit each: lower case, capital, digit, stop or comma, exclamation, bar, other sign, beyond ASCII.
_KIND = np.full(256, 64, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 4, 128
_KIND[[46, 44]], _KIND[33], _KIND[124] = 8, 16, 32
#: Forms that leave a word its own vector: letters, a stop or comma, no repetition.
_PLAIN = np.isin(np.arange(SHAPES), [a | b for a in (1, 2, 3, 128, 129, 130, 131) for b in (0, 8)])


def index_vectors(seeds: np.ndarray) -> np.ndarray:
    """A sparse ternary vector for each 64-bit seed: NONZERO draws of place and sign, scaled to unit length."""
    out = np.zeros((len(seeds), DIM), np.float32)
    for k in range(NONZERO):
        draw = tk.mix(seeds + np.uint64(k * 2654435761 + 1))
        np.add.at(out, (np.arange(len(seeds)), (draw % np.uint64(DIM)).astype(np.int64)), np.where(draw >> np.uint64(63), 1, -1))
    return out / np.sqrt(NONZERO)


def words(data: np.ndarray, offsets: np.ndarray):
    """Per block of whole rows or part of a long one: hashes, shapes and rows of the words."""
    inside = _WORD[data]
    for lo, hi in tk.blocks(inside, offsets):
        starts, ends = tk.spans(inside, offsets, lo, hi)
        if len(starts):
            block = data[lo:hi]
            found = tk.hash_spans(tk.lowered(block), starts, ends)
            shape = np.bitwise_or.reduceat(_KIND[block] * _WORD[block], starts).astype(np.int64)
            row = np.searchsorted(offsets, starts + lo, "right") - 1
            again = np.zeros(len(found), bool)
            again[1:] = (found[1:] == found[:-1]) & (row[1:] == row[:-1])
            yield found, shape + 256 * again, row


class Model:
    """Vectors of forms and words, the network and its temperature."""

    def __init__(self):
        self.known = np.zeros(0, np.uint64)
        self.vectors = index_vectors(tk.mix(np.arange(SHAPES, dtype=np.uint64) + np.uint64(1 << 32)))
        self.layers = None
        self.temperature, self.bias = 1.0, 0.0

    def _places(self, hashes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """Rows of the words' vectors: a plain common word's own, else its form's."""
        if not len(self.known):
            return shapes
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where((self.known[at] == hashes) & _PLAIN[shapes], SHAPES + at, shapes)

    def learn_words(self, column: pa.Array) -> None:
        """Word vectors from the neighbours of the commonest words of the sample."""
        parts = [column.slice(i, 256) for i in range(0, len(column), 256)]
        hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for part in parts:
            for found, shapes, _ in words(*tk.arrow_bytes(part)):
                own, n = np.unique(found[_PLAIN[shapes]], return_counts=True)
                both = np.concatenate([hashes, own])
                hashes, place = np.unique(both, return_inverse=True)
                counts = np.bincount(place, np.concatenate([counts, n])).astype(np.int64)
        common = np.flatnonzero(counts >= 5)
        common = common[np.argsort(-counts[common], kind="stable")[:VOCABULARY]]
        self.known = np.sort(hashes[common])
        index = np.concatenate([self.vectors[:SHAPES], index_vectors(self.known)])
        total = np.zeros_like(index, np.float64)
        for part in parts:
            for found, shapes, row in words(*tk.arrow_bytes(part)):
                place = self._places(found, shapes)
                for step in range(1, NEIGHBOURS + 1):
                    good = row[:-step] == row[step:]
                    a, b = place[:-step][good], place[step:][good]
                    for x, y in ((a, b), (b, a)):
                        for d in range(DIM):
                            total[:, d] += np.bincount(x, index[y, d], len(index))
        length = np.sqrt(np.square(total).sum(axis=1, keepdims=True))
        learned = np.where(length > 0, total / np.maximum(length, 1e-9), index)
        # A word stands for itself as well as for its neighbours.
        self.vectors = ((learned + index) / np.sqrt(2)).astype(np.float32)

    def pool(self, column: pa.Array) -> np.ndarray:
        """Mean and spread of word vectors, by row."""
        data, offsets = tk.arrow_bytes(column)
        n = len(offsets) - 1
        total, square, count = np.zeros((n, DIM)), np.zeros((n, DIM)), np.zeros(n)
        for hashes, shapes, row in words(data, offsets):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            rows = row[first]
            vectors = self.vectors[self._places(hashes, shapes)]
            total[rows] += np.add.reduceat(vectors, first, axis=0)
            square[rows] += np.add.reduceat(vectors * vectors, first, axis=0)
            count[rows] += np.diff(np.append(first, len(row)))
        each = np.maximum(count, 1)[:, None]
        mean = total / each
        return np.concatenate([mean, np.sqrt(np.maximum(square / each - mean * mean, 0))], axis=1)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(pooled), self.bias)
        centre, scale, w1, b1, w2, b2 = self.layers
        return np.maximum(((pooled - centre) / scale) @ w1 + b1, 0) @ w2 + b2

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.pool(column)) / self.temperature, -50, 50)))


def _fit(x: np.ndarray, y: np.ndarray, seed: int = 9, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4):
    """Adam on the logistic loss of a two-layer network."""
    draw = np.random.default_rng(seed)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - centre) / scale
    p = [draw.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(())]
    m, v, t = [np.zeros_like(k) for k in p], [np.zeros_like(k) for k in p], 0
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for i in range(0, len(x), batch):
            xb, yb = x[order[i : i + batch]], y[order[i : i + batch]]
            h = np.maximum(xb @ p[0] + p[1], 0)
            error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - yb) / len(xb)
            back = error[:, None] * p[2] * (h > 0)
            grads = [xb.T @ back + decay * p[0], back.sum(axis=0), h.T @ error + decay * p[2], error.sum()]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return (centre, scale, *p)


def train(texts: list[str], labels: np.ndarray) -> Model:
    """Fits word vectors, network and temperature on labelled texts."""
    model = Model()
    n = np.array([(labels == k).sum() for k in (0, 1)])
    model.bias = float(np.log((n[1] + 1) / (n[0] + 1)))
    if n.min() < 2:
        return model
    column = pa.array(texts, pa.large_string())
    model.learn_words(column)
    x = model.pool(column)
    apart = np.zeros(len(labels), bool)  # from either label, so that both sides have both
    for k in (0, 1):
        of = np.flatnonzero(labels == k)
        apart[np.random.default_rng(5).permutation(of)[: max(1, int(CALIBRATION * len(of)))]] = True
    model.layers = _fit(x[~apart], labels[~apart])
    logit, y = model.logit(x[apart]), labels[apart]
    loss = lambda t: np.mean(np.logaddexp(0, -np.where(y == 1, 1, -1) * logit / t))
    model.temperature = min(np.geomspace(0.5, 10, 60).tolist(), key=loss)
    return model


def classify(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # at most SHAPES + VOCABULARY vectors

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(shared.value.score(batch.column(1)))], ["doc_id", "score"])

    scored = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column(text).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(batch.column(place)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier for these documents' labels."""
    return train(*sample(docs, labels, "quality", SAMPLE_ROWS))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return classify(docs, fitted(docs, table(spark, sf_dir, "labels", ["doc_id", "quality"])))


QUERIES = {"op9_quality": op9_quality}
ORACLE: dict[str, str] = {}
