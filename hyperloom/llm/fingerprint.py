"""Document fingerprints by consistent weighted sampling.

A document is a weighted set: its runs of five words, each weighted by how often it occurs. The
signature has SLOTS samples. Every sample draws r and c from Gamma(2, 1) and b from U(0, 1) for each run,
by the run's own hash. A run of weight w has the level t = floor(ln w / r + b) and the rank
c / exp(r (t + 1 - b)); the run of least rank wins the sample, with its level. Winners of two documents
agree, in run and level, with a probability equal to their generalised Jaccard similarity, in every sample.

Order of drawing. At weight 1 the level is 0 and a run's ranks over the samples are independent Exp(1)
variables, so they are drawn ascending (gaps of order statistics, samples in a permutation by the run's
hash), and a run of weight 1 is left as soon as its next rank is above the winners of all samples: later
ones can't win. Given a rank a at weight 1, the gamma draws are recovered exactly: with independent
exponentials E and E', z = 1 + E / a, r = ln z + E', b = 1 - ln z / r and c = a z have their joint law.
So runs of any other weight draw all samples from the same numbers, and the result is that of drawing
(r, c, b) for every run and sample, at one to two draws a word.

Defined results: null text counts as empty; a text without words has the one run made of its bytes, so
only equal texts agree; equal texts have equal fingerprints; two empty texts have likeness 1; documents
with a null id come first; rows of equal id are ordered by their text's hash and each keeps its own row;
an empty table gives an empty result; columns besides id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm import textkernel as tk
from hyperloom.llm.shared import small_batches, table, text_column

SLOTS = 128
WIDTH = 5
_DRAW, _ORDER, _FIRST, _SECOND, _CODE = tk.mix(np.arange(101, 106, dtype=np.uint64)) | np.uint64(1)
#: Ranks drawn at once: of each run, and of all together.
_AHEAD, _DRAWS = 64, 1 << 20


def weighted_runs(words: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs and their counts."""
    runs = tk.shingles(words, WIDTH)
    if not len(runs):
        runs = np.frombuffer(hashlib.blake2b(raw, digest_size=8).digest(), np.uint64) if raw else runs
    return np.unique(runs, return_counts=True)


def _exponential(bits: np.ndarray) -> np.ndarray:
    return -np.log(((bits >> np.uint64(11)) + 0.5) * 2.0**-53)


def _sample_of(terms: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The samples of the terms' ranks number `at`, a permutation of all samples for each term."""
    key = tk.mix(terms ^ _ORDER)[:, None]
    part = lambda shift: ((key >> np.uint64(shift)) & np.uint64(0xFF)).astype(np.uint8)
    x = np.broadcast_to(at.astype(np.uint8), (len(terms), len(at)))
    for k in range(3):
        x = (x * (part(16 * k) | np.uint8(1)) + part(16 * k + 8)) & np.uint8(SLOTS - 1)
        if k < 2:
            x = x ^ (x >> np.uint8(4 - k))
    return x.astype(np.int64)


def ranks(terms: np.ndarray, start: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks number `at` (consecutive, from 0) of terms at weight 1, ascending; start: the rank before the first."""
    out = _exponential(tk.mix(terms[:, None] + (at + 1).astype(np.uint64) * _DRAW)) / (SLOTS - at)
    out[:, 0] += start
    return np.cumsum(out, axis=1)


def gammas(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sample, r, c, b) of all SLOTS samples of each term."""
    at = np.arange(SLOTS)
    rank = ranks(terms, np.zeros(len(terms)), at)
    draw = lambda salt: _exponential(tk.mix(tk.mix(terms ^ salt)[:, None] + at.astype(np.uint64) * _DRAW))
    z = 1 + draw(_FIRST) / rank
    r = np.log(z) + draw(_SECOND)
    return _sample_of(terms, at), r, rank * z, 1 - np.log(z) / r


def sample(terms: np.ndarray, weights: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Signatures (n rows of SLOTS 16-bit codes, 0 for an empty slot) of terms with positive weights.

    docs gives each term's row. A row with any term fills all its slots.
    """
    least, out = np.full(n * SLOTS, np.inf), np.zeros(n * SLOTS, np.uint16)

    def offer(terms, docs, slot, rank, level):
        cell = docs[:, None] * SLOTS + slot
        np.minimum.at(least, cell.ravel(), rank.ravel())
        row, column = np.nonzero(rank == least[cell])
        won = terms[row]
        if level is not None:  # level 0 has the code of a run of weight 1
            won = won ^ (level[row, column].astype(np.int64).view(np.uint64) * _SECOND)
        out[cell[row, column]] = (tk.mix(won ^ _CODE) % np.uint64(0xFFFF) + np.uint64(1)).astype(np.uint16)

    heavy = np.flatnonzero(weights != 1)
    for lo in range(0, len(heavy), _DRAWS // SLOTS):
        own = heavy[lo : lo + _DRAWS // SLOTS]
        slot, r, c, b = gammas(terms[own])
        level = np.floor(np.log(weights[own])[:, None] / r + b)
        rank = c / np.exp(r * (level + 1 - b))
        offer(terms[own], docs[own], slot, rank, level)
    light = weights == 1
    units, docs, now, drawn, ahead = terms[light], docs[light], np.zeros(int(light.sum())), 0, 1
    while len(units) and drawn < SLOTS:
        at = np.arange(drawn, min(drawn + ahead, SLOTS))
        size = max(1, _DRAWS // len(at))
        for lo in range(0, len(units), size):
            part = slice(lo, lo + size)
            rank = ranks(units[part], now[part], at)
            now[part] = rank[:, -1]
            offer(units[part], docs[part], _sample_of(units[part], at), rank, None)
        open_ = now < least.reshape(n, SLOTS).max(axis=1)[docs]
        units, docs, now = units[open_], docs[open_], now[open_]
        drawn, ahead = drawn + len(at), min(2 * ahead, _AHEAD)
    return out.reshape(n, SLOTS)


def signatures(texts: list[str]) -> np.ndarray:
    """Signatures of whole texts."""
    out = np.zeros((len(texts), SLOTS), np.uint16)
    for at, to, words, rows in tk.word_rows(pa.array(texts, pa.large_string())):
        found = [weighted_runs(words[rows[i] : rows[i + 1]], texts[at + i].encode() if rows[i] == rows[i + 1] else b"") for i in range(to - at)]
        terms = np.concatenate([x[0] for x in found])
        if len(terms):
            docs = np.repeat(np.arange(to - at), [len(x[0]) for x in found])
            out[at:to] = sample(terms, np.concatenate([x[1] for x in found]).astype(np.float64), docs, to - at)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of agreeing slots among those that a or b fills; 1 where both are empty."""
    filled = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    return np.where(filled == 0, 1.0, same / np.maximum(filled, 1))


def as_text(signature: np.ndarray) -> list[str]:
    """Each row in hexadecimal, four digits for each slot."""
    return [row.tobytes().hex() for row in signature.astype(">u2")]


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id and its fingerprint, from whole texts."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(as_text(signatures([x or "" for x in batch.column(1).to_pylist()])))], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column(text).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def _bounds(docs: DataFrame, parts: int) -> tuple[list[tuple], tuple]:
    """The first (id, hash) of each of about `parts` ranges after the first one, ascending; and that of the table.

    Ranges are cut at quantiles of the ids. An id that fills several ranges is cut by its texts' hashes, for
    which alone texts are read here. Only texts that repeat under one id stay together.
    """
    quantiles = F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)
    found = docs.agg(quantiles.alias("x"), F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.count("*").alias("n")).first()
    times, first = Counter(found.x if found.x and parts > 1 else []), None if found.nulls else found.low
    if found.nulls * parts > found.n:
        times[None] = found.nulls * parts // found.n + 1
    many = {i: k for i, k in times.items() if k > 1}
    if not many:
        return sorted(((i, None) for i in times), key=lambda x: x[0]), (first, None)
    # An id is cut into as many equal ranges of the hash as it had quantiles; each starts at its least hash.
    cut = F.lit(None).cast("int")
    for i, k in many.items():
        place = F.floor((F.col("hash").cast("double") / 2.0**64 + 0.5) * k).cast("int")
        cut = F.when(F.col("doc_id").eqNullSafe(F.lit(i).cast("long")), place).otherwise(cut)
    ends = {*times, first}
    named = F.col("doc_id").isin([i for i in ends if i is not None])
    firsts = docs.where(named | F.col("doc_id").isNull() if None in ends else named).select("doc_id", F.xxhash64("text").alias("hash"))
    rows = firsts.groupBy("doc_id", cut.alias("cut")).agg(F.min("hash").alias("hash")).collect()  # at most about 2 * parts
    rows = sorted(((x.doc_id, x.hash) for x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    return rows[1:], rows[0]


def _place(i, h):
    return F.struct(F.lit(i).cast("long").alias("doc_id"), F.lit(h).cast("long").alias("hash"))


def _range_of(own, bounds: list[tuple]):
    """How many bounds are not above a place: binary choice over groups of bounds, then inside one. And whether it is the last of them."""
    if not bounds:
        return F.lit(0), F.lit(False)
    width = max(1, int(len(bounds) ** 0.5))
    every, heads = F.array(*(_place(*x) for x in bounds)), F.array(*(_place(*x) for x in bounds[::width]))
    group = F.size(F.filter(heads, lambda x: x <= own))
    inside = F.size(F.filter(F.slice(every, (group - 1) * width + 1, F.lit(width)), lambda x: x <= own))
    part = F.when(group == 0, F.lit(0)).otherwise((group - 1) * width + inside).cast("int")
    return part, (part > 0) & F.element_at(every, F.greatest(part, F.lit(1))).eqNullSafe(own)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], codes: np.ndarray):
    """Output for every document but the last, which is the last one's next."""
    if len(texts) < 2:
        return
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:], strict=False)]
    changed = signatures(edited)
    own, after = codes[:-1], codes[1:]
    yield pa.record_batch([
        pa.array(ids[:-1], pa.int64()), pa.array([len(x) for x in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
        pa.array(as_text(own)), pa.array(as_text(changed)), pa.array(likeness(own, changed)), pa.array(likeness(own, after)),
    ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside its edited text's and the next document's.

    Documents are dealt out by ranges of id and text hash, each range sorted and streamed, so a document's
    next one is the next row. The first document of each range goes to the range before as well (the very
    first to the last), so no range needs another one's rows. The texts are shuffled once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds, first = _bounds(docs, parts)
    by_hash, last = any(h is not None for _, h in (*bounds, first)), len(bounds)
    own = F.struct("doc_id", (F.xxhash64("text") if by_hash else F.lit(None).cast("long")).alias("hash"))
    part, at_bound = _range_of(own, bounds)
    edge = lambda p, k: F.array(F.struct(p.cast("int").alias("part"), F.lit(k).alias("edge")))
    copies = edge(part, 0)
    copies = F.when(at_bound, F.concat(copies, edge(part - 1, 1))).otherwise(copies)
    copies = F.when(own.eqNullSafe(_place(*first)), F.concat(copies, edge(F.lit(last), 2))).otherwise(copies)
    dealt = docs.select("doc_id", "text", F.explode(copies).alias("at")).select("at.part", "at.edge", "doc_id", "text")
    dealt = dealt.repartitionById(last + 1, F.col("part")).sortWithinPartitions("part", "edge", "doc_id", F.xxhash64("text"), "text")

    def run(batches):
        part, ids, texts, codes, closed = None, [], [], None, False
        for batch in batches:
            parts, edges = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            new_ids, new_texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            new_codes = signatures(new_texts)
            at = 0
            while at < len(parts):
                if parts[at] != part:
                    part, ids, texts, codes, closed = parts[at], [], [], None, False
                to = at
                while to < len(parts) and parts[to] == part and edges[to] == 0:
                    to += 1
                if to < len(parts) and parts[to] == part and not closed:
                    to += 1  # the next range's first document
                    closing = True
                else:
                    closing = False
                if closed:  # equal ids at the edge: only the first of them follows
                    to = max(to, at + 1)
                else:
                    ids = ids + new_ids[at:to]
                    texts = texts + new_texts[at:to]
                    codes = new_codes[at:to] if codes is None else np.concatenate([codes, new_codes[at:to]])
                    yield from _rows(ids, texts, codes)
                    ids, texts, codes = ids[-1:], texts[-1:], codes[-1:]
                    closed = closing
                at = to

    return dealt.mapInArrow(run, OUT)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, against their edited texts and their next documents."""
    return edited_pairs(table(spark, sf_dir, "documents", ["doc_id", "text"]))


QUERIES = {"op1_fingerprints": op1_fingerprints}
ORACLE: dict[str, str] = {}
