"""Benchmark decontamination: a BM25 index of test items, queried by every training passage.

Index. Test items (cut into segments of at most SEGMENT words where longer) are the indexed texts. An
impact is a term's BM25 share in a segment divided by the segment's own total, so every segment scores
1 against itself and one threshold serves short and long ones. Postings are grouped into blocks of
BLOCK segments, and each term keeps its largest impact overall and in each block.

Query. Passages are windows of 2 L words, each L words on, with L the longest segment's length, so
that a copied segment lies whole within some window. As in block-max WAND, upper bounds come first: a
window is left if its terms' largest impacts stay below the threshold; of the others, only blocks whose
block maxima reach the threshold have their postings scored. All segments at or above it are retrieved.
Bounds are sums over every term, so nothing at or above the threshold is missed.

Check. Items are judged whole. Over all windows that retrieve any segment of an item, enough of the item's
question (all but the last sentence) and enough of its answer (the `answer` column, or the last sentence) must
appear as runs of five words. Where the answer is only guessed to be the last sentence and that has fewer than
RUN runs, too few to judge, most of the whole item (CLOSE) counts as well.

Benchmarks beyond MAX_SHARD characters are dealt into shards by the items' hash. Each shard's index is built
with the statistics of the whole benchmark, which are counted in Spark, broadcast, used in a pass over the
documents of its own, and destroyed; driver and workers hold one shard at a time. Items found by several
passes are joined by document.

Defined results: null text counts as empty; an item without words matches nothing; documents without
words are clean; equal rows have equal results; an empty benchmark leaves every document clean and an empty
table gives an empty result; items without an id are looked for like others and reported as null; ids of
items may be of any type; columns besides the named ones are ignored, or kept by `clean`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType

from hyperloom.llm import textkernel as tk
from hyperloom.llm.shared import Work, small_batches, table, text_column

K1, B = 1.2, 0.75
THETA = 0.5
SEGMENT = 64
BLOCK = 16
RUN = 5
QUESTION, ANSWER, CLOSE = 0.6, 0.6, 0.8
MAX_SHARD = 32_000_000
_BITS = 20
#: Postings read at once.
LISTS = 1 << 21


def words_of(text: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(x[2] for x in tk.word_rows(pa.array([text], pa.large_string())))])


def question_and_answer(text: str, answer: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of an item's question and answer; without an answer column the last sentence is it."""
    if answer:
        return words_of(text), words_of(answer)
    parts = [x for x in re.split(r"(?<=[.!?])\s+|(?<=[。！？])|\n+", text.strip()) if len(words_of(x))]
    if len(parts) < 2:
        return words_of(text), np.zeros(0, np.uint64)
    return words_of(" ".join(parts[:-1])), words_of(parts[-1])


def runs_of(words: np.ndarray) -> tuple[int, np.ndarray]:
    """The width of a part's runs, and the runs."""
    return min(RUN, len(words)), np.unique(tk.shingles(words, RUN))


class Item:
    """An item's runs: of question, answer and both."""

    def __init__(self, item_id, text: str, answer: str | None = None):
        question, found = question_and_answer(text, answer)
        self.item_id, self.words = item_id, np.concatenate([question, found])
        self.parts = [(need, *runs_of(x)) for need, x in ((QUESTION, question), (ANSWER, found)) if len(x)]
        self.whole = runs_of(self.words)
        self.short = not answer and 0 < len(found) < 2 * RUN - 1  # a guessed answer of fewer than RUN runs

    def found(self, runs) -> tuple[bool, float]:
        """Whether the item is in a text, and how much of it; runs(width) are those of the text's windows."""
        share = lambda width, own: float(np.isin(own, runs(width)).mean())
        whole = share(*self.whole)
        return all(share(width, own) >= need for need, width, own in self.parts) or (self.short and whole >= CLOSE), whole

    def segments(self) -> list[np.ndarray]:
        pieces = -(-len(self.words) // SEGMENT)
        return [self.words[k * len(self.words) // pieces : (k + 1) * len(self.words) // pieces] for k in range(pieces)]


def _sums(keys: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values by key below n, for the keys that occur."""
    if n <= 16 * len(keys) + 4096:
        total = np.bincount(keys, values, n)
        own = np.flatnonzero(total)
        return own, total[own]
    own, place = np.unique(keys, return_inverse=True)
    return own, np.bincount(place, values, len(own))


class Index:
    """BM25 impacts of segments by term, with block maxima."""

    def __init__(self, items: list[Item], n: int, mean: float, terms: np.ndarray, df: np.ndarray):
        """n, mean: number and mean length of the benchmark's segments; df: in how many of them each term is."""
        self.items = items
        segments = [(k, x) for k, item in enumerate(items) for x in item.segments()]
        self.owner, self.longest = np.array([k for k, _ in segments]), max(len(x) for _, x in segments)
        term, where, impact = [], [], []
        for i, (_, words) in enumerate(segments):
            t, tf = np.unique(words, return_counts=True)
            d = df[np.searchsorted(terms, t)]
            x = np.log1p((n - d + 0.5) / (d + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            term.append(t)
            where.append(np.full(len(t), i))
            impact.append(x / x.sum())
        term, where, impact = np.concatenate(term), np.concatenate(where), np.concatenate(impact)
        order = np.lexsort((where, term))
        term, self.where, self.impact = term[order], where[order], impact[order]
        self.terms, first = np.unique(term, return_index=True)
        self.ends = np.append(first, len(term))
        self.most = np.maximum.reduceat(self.impact, first)
        code = np.searchsorted(self.terms, term)
        key = code * (len(segments) // BLOCK + 1) + self.where // BLOCK
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        self.block, self.block_most = self.where[starts] // BLOCK, np.maximum.reduceat(self.impact, starts)
        self.block_ends = np.searchsorted(code[starts], np.arange(len(self.terms) + 1))
        self.blocks = len(segments) // BLOCK + 1
        self.present = np.zeros(1 << _BITS, bool)
        self.present[(self.terms & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words that the index has, and their terms."""
        at = np.flatnonzero(self.present[(words & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.terms, words[at]), len(self.terms) - 1)
        same = self.terms[found] == words[at]
        return at[same], found[same]

    @staticmethod
    def _lists(ends: np.ndarray, terms: np.ndarray) -> np.ndarray:
        lo, n = ends[terms], ends[terms + 1] - ends[terms]
        return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())

    def search(self, windows: np.ndarray, terms: np.ndarray, theta: float = THETA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, segment, score) of the segments that score theta or more against a window's distinct terms; windows ascend."""
        in_blocks, in_lists = np.diff(self.block_ends)[terms], np.diff(self.ends)[terms]
        upto, start, out = np.cumsum(in_blocks + in_lists), 0, []
        while start < len(terms):  # whole windows, of about LISTS postings at once
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + LISTS, "right")))
            stop = int(np.searchsorted(windows, windows[stop - 1], "right"))
            own, window = np.unique(windows[start:stop], return_inverse=True)
            term, lengths = terms[start:stop], in_lists[start:stop]
            lists = self._lists(self.block_ends, term)
            cells, bounds = _sums(np.repeat(window, in_blocks[start:stop]) * self.blocks + self.block[lists], self.block_most[lists], len(own) * self.blocks)
            good = cells[bounds >= theta - 1e-9]
            start = stop
            if not len(good):
                continue
            hot = np.zeros(len(own), bool)
            hot[good // self.blocks] = True
            chosen = hot[window]
            lists, window = self._lists(self.ends, term[chosen]), np.repeat(window[chosen], lengths[chosen])
            cell = window * self.blocks + self.where[lists] // BLOCK
            inside = good[np.minimum(np.searchsorted(good, cell), len(good) - 1)] == cell
            lists, window = lists[inside], window[inside]
            cells, score = _sums(window * len(self.owner) + self.where[lists], self.impact[lists], len(own) * len(self.owner))
            kept = score >= theta - 1e-9
            out.append((own[cells[kept] // len(self.owner)], cells[kept] % len(self.owner), score[kept]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def documents(self, words: np.ndarray, rows: np.ndarray, theta: float = THETA):
        """(row, item, best score, share of it) of the items found in rows of words."""
        at, terms = self.lookup(words)
        if not len(at):
            return
        length = self.longest
        n = np.diff(rows)
        base = np.append(0, np.cumsum(-(-n // length)))
        row = np.searchsorted(rows, at, "right") - 1
        cell = base[row] + (at - rows[row]) // length
        # A window is a cell and the next one of its document. Bounds with repeated terms, then without.
        bound = np.bincount(cell, self.most[terms], base[-1])
        after = np.append(bound[1:], 0.0)
        after[base[1:][n > 0] - 1] = 0.0  # the next cell is another document's
        open_ = bound + after >= theta - 1e-9
        second = cell > base[row]
        window, term = np.concatenate([cell, cell[second] - 1]), np.concatenate([terms, terms[second]])
        kept = open_[window]
        pairs = np.sort(window[kept] * len(self.terms) + term[kept])
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
        window, term = pairs // len(self.terms), pairs % len(self.terms)
        kept = (np.bincount(window, self.most[term], base[-1]) >= theta - 1e-9)[window]
        met: dict[tuple[int, int], list] = {}  # by row and item: best score and windows
        windows: dict[int, np.ndarray] = {}
        for k, h, score in zip(*(x.tolist() for x in self.search(window[kept], term[kept], theta)), strict=True):
            r = int(np.searchsorted(base, k, "right")) - 1
            lo = rows[r] + (k - base[r]) * length
            windows[k] = words[lo : min(lo + 2 * length, rows[r + 1])]
            seen = met.setdefault((r, int(self.owner[h])), [0.0, []])
            seen[0] = max(seen[0], score)
            if seen[1][-1:] != [k]:
                seen[1].append(k)
        made: dict[tuple[int, int], np.ndarray] = {}

        def runs(width: int, k: int) -> np.ndarray:
            if (k, width) not in made:
                made[k, width] = tk.shingles(windows[k], width)
            return made[k, width]

        for (r, h), (score, own) in met.items():
            found, share = self.items[h].found(lambda width, own=own: np.concatenate([runs(width, k) for k in own]))
            if found:
                yield r, h, score, share


SEGMENTS = "segment long, words array<long>"


def _segments(batches):
    """Items (text, answer) to the words of their segments, numbered within a batch."""
    for batch in batches:
        found = [x for text, answer in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in Item(None, text, answer).segments()]
        yield pa.record_batch([pa.array(range(len(found)), pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["segment", "words"])


def _asked(items: DataFrame) -> DataFrame:
    """The items that have a text: item_id, text, answer (null without such a column)."""
    answer = F.col("answer").cast("string") if "answer" in items.columns else F.lit(None).cast("string")
    return items.select("item_id", F.col("text"), answer.alias("answer")).where("length(text) > 0")


def _size(items: DataFrame) -> int:
    """Characters of items (text, answer)."""
    return items.agg(F.sum(F.length("text") + F.coalesce(F.length("answer"), F.lit(0))).alias("chars")).first().chars or 0


def shards(items: DataFrame):
    """The indexes of a benchmark (item_id, text and, if there, answer), each of about MAX_SHARD characters, one at a time."""
    spark = items.sparkSession
    items = _asked(items)
    cut = items.select("text", "answer").mapInArrow(_segments, SEGMENTS)
    parts = max(1, -(-_size(items) // MAX_SHARD))
    if parts > 1:
        cut = Work(spark, "benchmark").keep(cut)
    counts = cut.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    if not counts.n:
        return
    df = cut.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for part in range(parts):
        # Items of one text are spread by their ids, repeated rows are indexed once.
        own = items.where(F.pmod(F.xxhash64("text", "answer", F.col("item_id").cast("string")), F.lit(parts)) == part).distinct()
        rows = [Item(x.item_id, x.text, x.answer) for x in own.orderBy("text", "answer", F.col("item_id").cast("string")).toLocalIterator()]
        rows = [x for x in rows if len(x.words)]
        if not rows:
            continue
        terms = np.unique(np.concatenate([x.words for x in rows]))
        if parts > 1:  # the counts of this shard's terms alone
            known = df.join(spark.createDataFrame(pa.table({"term": terms.view(np.int64)})), "term")
        else:
            known = df
        known = known.toArrow().to_pandas()
        at = known.term.to_numpy().view(np.uint64)
        order = np.argsort(at)
        yield Index(rows, counts.n, counts["mean"], at[order], known.df.to_numpy()[order])


def _matches(index: Index, column: pa.Array, theta: float) -> tuple[list[list[int]], list[float], list[float]]:
    """Items found in each text, by number, the best score and the best share among them."""
    n = len(column)
    found, score, share = [[] for _ in range(n)], [0.0] * n, [0.0] * n
    for at, _, words, rows in tk.word_rows(column):
        for r, h, s, o in index.documents(words, rows, theta):
            found[at + r].append(h)
            score[at + r], share[at + r] = max(score[at + r], s), max(share[at + r], o)
    return found, score, share


def _pass(docs: DataFrame, index, ids: DataType, theta: float) -> DataFrame:
    """One row per document (doc_id, key, text): doc_id, key, item_ids, best_score, best_overlap."""
    type_ = to_arrow_type(ArrayType(ids))

    def run(batches):
        for batch in batches:
            items = index.value.items
            found, score, share = _matches(index.value, batch.column(2), theta)
            names = [sorted({items[h].item_id for h in x}, key=lambda v: (v is not None, v)) for x in found]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(names, type_), pa.array(score, pa.float64()), pa.array(share, pa.float64())], ["doc_id", "key", "item_ids", "best_score", "best_overlap"])

    return docs.mapInArrow(run, f"doc_id long, key binary, item_ids array<{ids.simpleString()}>, best_score double, best_overlap double")


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    value = text_column(text)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.unhex(F.md5(value.cast("binary"))).alias("key"), value.alias("text"))


def _passes(docs: DataFrame, items: DataFrame, theta: float, work: Work) -> DataFrame | None:
    """The found items of the documents that have any: (doc_id, key, item_ids, best_score, best_overlap), one row per different document; a pass over the documents for each shard."""
    spark, ids, every = docs.sparkSession, items.schema["item_id"].dataType, None
    for index in shards(items):
        shared = spark.sparkContext.broadcast(index)
        found = work.keep(_pass(docs, shared, ids, theta).where("best_score > 0").dropDuplicates(["doc_id", "key"]))
        every = found if every is None else every.union(found)
        shared.destroy()
        del index
    if every is None:
        return None
    return work.settle(every.groupBy("doc_id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("best_score").alias("best_score"), F.max("best_overlap").alias("best_overlap")))


def _one_shard(items: DataFrame) -> Index | None | bool:
    """The index of a benchmark of one shard, None of an empty one; False of a larger one."""
    return False if _size(_asked(items)) > MAX_SHARD else next(shards(items), None)


OUT = ("doc_id", "contaminated", "item_ids", "best_score", "best_overlap")


def decontaminate(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", theta: float = THETA) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids, best_score, best_overlap."""
    spark, ids = docs.sparkSession, items.schema["item_id"].dataType
    small_batches(spark)
    keyed = _keyed(docs, id_column, text)
    found = None
    if index := _one_shard(items):  # one pass, and nothing to join
        found = _pass(keyed, spark.sparkContext.broadcast(index), ids, theta)
    elif index is False:
        found = _passes(keyed, items, theta, Work(spark, "leaks"))
        found = None if found is None else keyed.select("doc_id", "key").alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.key") == F.col("f.key")), "left").select("d.doc_id", "item_ids", "best_score", "best_overlap")
    if found is None:
        found = keyed.select("doc_id", F.lit(None).cast(f"array<{ids.simpleString()}>").alias("item_ids"), F.lit(0.0).alias("best_score"), F.lit(0.0).alias("best_overlap"))
    none = F.array().cast(f"array<{ids.simpleString()}>")
    found = found.select("doc_id", F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("best_score", F.lit(0.0)).alias("best_score"), F.coalesce("best_overlap", F.lit(0.0)).alias("best_overlap"))
    return found.withColumn("contaminated", F.size("item_ids") > 0).select(*OUT)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", theta: float = THETA) -> DataFrame:
    """The rows, with all their columns, in which no item is found."""
    spark = docs.sparkSession
    small_batches(spark)
    if (index := _one_shard(items)) is None:
        return docs
    if index is False:
        texts = docs.select(F.lit(None).cast("long").alias("doc_id"), F.unhex(F.md5(text_column(text).cast("binary"))).alias("key"), text_column(text).alias("text"))
        found = _passes(texts, items, theta, Work(spark, "leaks"))
        # The rows travel whole in one column, so no name of theirs can clash.
        packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.unhex(F.md5(text_column(text).cast("binary"))).alias("key"))
        return packed.join(found.select("key"), "key", "left_anti").select("row.*")
    shared = spark.sparkContext.broadcast(index)
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([not x for x in _matches(shared.value, batch.column(place), theta)[0]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents."""
    return decontaminate(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "benchmark", ["item_id", "text"]))


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLE: dict[str, str] = {}
