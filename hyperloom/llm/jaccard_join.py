"""N-gram Jaccard self-join by chosen paths.

A document is the set of its runs of five words (lower case; characters where a script has no spaces).
Two different texts are linked if the Jaccard similarity of their sets is 0.8 or more.

Search (chosen paths). Each of RUNS runs samples one token of a set, on average, by the token's own hash,
so two similar sets choose the same tokens; a chosen token is a path, and the documents on one path are a
bucket. Rare paths tell more than frequent ones: a document goes along the rarest of its paths only, as
many (`kept_paths`) as the target recall asks for. By the order of frequency, a pair's rarest shared path
is on both documents' lists unless one has that many rarer ones that it does not share, and their number
is bounded by a binomial whose mean is 1 - threshold of the samples. So a passage that many documents
share puts them into one bucket only where it makes up most of their text.

A bucket of at most RANGE documents is compared by brute force, one of up to LARGE as a square grid of ranges
of RANGE (each document is sent once for every range of its bucket). A larger one is split: inside it each
document goes on along new paths, the tokens of its sketch, again by those rarest in the bucket, each split
with the same recall; what LEVELS splits don't make small is compared as a grid of ranges. No pair is
left because of a bucket's size.

Comparison is by a sketch (the SKETCH least token hashes relative to size; the whole set of a short text),
with a margin below the threshold. Its links connect documents to candidate components, first along each
document's FIRST rarest paths; after that a bucket that lies inside one component is not compared again, so
a large group of near copies is connected by a number of comparisons in proportion to its size.

Check. Inside each candidate component every pair of different texts is compared exactly, in a grid of
ranges of at most BLOCK texts and BLOCK_TOKENS tokens. This gives each text's number of links and the final
components. The work is the square of a component, the texts sent are its size times its number of ranges.

Equal texts are one class from the start; they meet in a grouped minimum and are never paired.

Defined results: null text counts as empty; a text without words is the set of its own bytes, so only
equal texts meet; a text of fewer than five words has one run, all its words; equal ids are different
rows with the same id; an empty table gives an empty result; columns besides id and text, whatever their
names, are ignored by `join` and kept by `one_of_each`.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hyperloom.llm import textkernel as tk
from hyperloom.llm.components import components
from hyperloom.llm.shared import Work, small_batches, table, text_column

THRESHOLD = 0.8
#: Of pairs at the threshold, in each choice of paths.
RECALL = 0.9999
RUNS = 32
SKETCH = 64
#: How far below the threshold a sketch's similarity may lie for the exact check.
MARGIN = 0.22
#: Rarest shared paths of a document that are looked at first.
FIRST = 3
#: Documents of a bucket compared in one task, and of a bucket that is split before it is compared.
RANGE, LARGE, LEVELS = 4096, 1 << 18, 3
#: Texts and tokens of a range of the exact check, at most (one longer text is a range of its own).
BLOCK, BLOCK_TOKENS = 2048, 1 << 20
#: Pairs of texts in a tile of a comparison, and tokens shared by two texts that are counted at once.
CELLS, MEETINGS = 1 << 19, 1 << 18
#: Parts into which rows of one path or component are dealt where they meet its counts.
SALTS = 16
#: Documents up to which a bucket is compared one by one.
FEW = 16


@functools.lru_cache(maxsize=1 << 16)
def kept_paths(size: int, samples: int = RUNS, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """How many of its rarest sampled tokens a set of `size` tokens must be compared by.

    A pair at the threshold meets by its rarest shared token unless one of the two has that many rarer ones
    that it does not share. Where all tokens of both sets are sampled their number has a fixed bound. Else it
    is a sum of independent draws with a mean of at most 1 - threshold of the samples, and no such sum has
    more in its upper tail than the binomial of this mean; either side may miss half of what recall allows.
    """
    if size <= threshold * samples:
        return int((1 - threshold) * size + 1e-9) + 1
    p = (1 - threshold) * min(1.0, samples / size)
    term = math.exp(size * math.log1p(-p))
    n, left = 0, term
    while 1 - left > (1 - recall) / 2 and n < size:
        term *= (size - n) / (n + 1) * p / (1 - p)
        n += 1
        left += term
    return n + 1


def _tokens(words: np.ndarray, raw: bytes) -> np.ndarray:
    """A text's set: distinct runs of five words, ascending."""
    found = tk.shingles(words, 5)
    if not len(found):
        found = np.frombuffer(hashlib.blake2b(b"raw" + raw, digest_size=8).digest(), np.uint64)
    return np.unique(found)


def token_sets(column: pa.Array):
    """The set of each row's text."""
    for at, to, words, ends in tk.word_rows(column):
        for i in range(to - at):
            raw = b"" if ends[i] < ends[i + 1] else (column[at + i].as_py() or "").encode()
            yield _tokens(words[ends[i] : ends[i + 1]], raw)


def _describe(threshold: float, recall: float):
    """Per row (id, digest, text): id, digest, the size of the text's set, the sampled paths, how many of the most frequent paths and sketch tokens it need not follow, and the sketch."""
    cut = lambda rate, size: np.uint64(min(2**64 - 1, int(rate / size * 2.0**64)))

    def run(batches):
        for batch in batches:
            sizes, paths, spare, sketch_spare, sketches = [], [], [], [], []
            for tokens in token_sets(batch.column(2)):
                hashes = np.sort(tk.mix(tokens))
                n = len(hashes)
                own = hashes[: np.searchsorted(hashes, cut(RUNS, n), "right")]
                kept = hashes[: np.searchsorted(hashes, cut(SKETCH, n), "right")]
                sizes.append(n)
                paths.append(own.view(np.int64))
                spare.append(max(0, len(own) - kept_paths(n, RUNS, threshold, recall)))
                sketch_spare.append(max(0, len(kept) - kept_paths(n, SKETCH, threshold, recall)))
                sketches.append((kept >> np.uint64(32)).astype(np.uint32).view(np.int32))
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(paths, pa.list_(pa.int64())), pa.array(spare, pa.int32()), pa.array(sketch_spare, pa.int32()), pa.array(sketches, pa.list_(pa.int32()))]
            yield pa.record_batch(columns, ["doc_id", "key", "size", "paths", "spare", "sketch_spare", "sketch"])

    return run


# ------------------------------------------------------------------------------ comparison


def overlap_tiles(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, rows: int | None = None, width: int = 512):
    """(rows of left, sizes of the intersections of their sets with those of right), some rows at once: CELLS pairs, if not told.

    Tokens that few sets share are counted pair by pair, the others by products of 0/1 matrices. A tile and what is
    made of it stays within a few MB an array, since every core of an executor has a worker that holds some.
    """
    both = np.union1d(left, right)
    values = np.concatenate([sets[k] for k in both])
    owner = np.repeat(both, [len(sets[k]) for k in both])
    _, code, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    code, owner = code[shared], owner[shared]
    del values, shared
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    code = np.cumsum(np.append(True, code[1:] != code[:-1])) - 1 if len(code) else code
    del order
    place = np.full(len(sets), -1)
    place[right] = np.arange(len(right))
    on_right = place[owner] >= 0
    code_r, owner_r = code[on_right], place[owner[on_right]]
    n = int(code[-1]) + 1 if len(code) else 0
    ends = np.searchsorted(code_r, np.arange(n + 1))
    rows = rows or max(1, CELLS // max(1, len(right)))
    for lo in range(0, len(left), rows):
        own = left[lo : lo + rows]
        at = np.full(len(sets), -1)
        at[own] = np.arange(len(own))
        on_left = at[owner] >= 0
        code_l, owner_l = code[on_left], at[owner[on_left]]
        out = np.zeros((len(own), len(right)))
        per = np.diff(ends)
        heavy = np.bincount(code_l, minlength=n) * per > max(64, out.size >> 10)
        few = ~heavy[code_l]
        a, c = owner_l[few], code_l[few]
        upto = np.cumsum(per[c])
        start = 0
        while start < len(c):  # a bounded number of pairs at once
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + MEETINGS, "right")))
            k = per[c[start:stop]]
            index = np.repeat(ends[c[start:stop]] - np.cumsum(k) + k, k) + np.arange(k.sum())
            out += np.bincount(np.repeat(a[start:stop], k) * len(right) + owner_r[index], minlength=out.size).reshape(out.shape)
            start = stop
        dense = np.flatnonzero(heavy)
        rank = np.full(n, -1)
        rank[dense] = np.arange(len(dense))
        for first in range(0, len(dense), width):
            ones = []
            for codes, owners, size in ((code_l, owner_l, len(own)), (code_r, owner_r, len(right))):
                column = rank[codes] - first
                inside = (rank[codes] >= 0) & (column >= 0) & (column < width)
                one = np.zeros((size, min(width, len(dense) - first)), np.float32)
                one[owners[inside], column[inside]] = 1
                ones.append(one)
            out += ones[0] @ ones[1].T
        yield own, out


def _spanning(linked: np.ndarray, left: np.ndarray, right: np.ndarray, label: np.ndarray):
    """Pairs of places that connect what linked connects, label (changed here) by label."""
    for i in np.flatnonzero(linked.any(axis=1)):
        own = left[i]
        others = right[linked[i]]
        while len(others := others[label[others] != label[own]]):
            yield int(own), int(others[0])
            a, b = label[own], label[others[0]]
            label[label == max(a, b)] = min(a, b)


def _alike(a, b, threshold: float) -> bool:
    """Whether two (size, ascending sketch, set of it) may be at the threshold, from the part of the token space both cover."""
    if min(a[0], b[0]) < threshold * max(a[0], b[0]) - 1e-9:
        return False
    both = len(a[2] & b[2])
    if not both:
        return False
    small, large = (a, b) if a[0] <= b[0] else (b, a)
    covered = int(np.searchsorted(small[1], np.uint64(min(2**32 - 1, int(SKETCH / large[0] * 2.0**32))), "right"))
    return both >= (threshold - MARGIN) * (covered + len(large[1]) - both)


def _one_by_one(rows: list, threshold: float):
    """Edges between the components of a few documents."""
    groups: dict[int, list] = {}
    for _, doc, own, size, sketch in rows:
        one = (size, sketch, frozenset(sketch.tolist()), doc)
        mine, joined = own, [one]
        for root in [x for x in groups if x != own]:
            for other in groups[root]:
                if _alike(one, other, threshold):
                    yield doc, other[3]
                    joined += groups.pop(root)
                    break
        groups[mine] = groups.get(mine, []) + joined


def _in_tiles(rows: list, left: np.ndarray, right: np.ndarray, threshold: float):
    """Edges between the components of documents left and right."""
    sketches, sizes = [x[4] for x in rows], np.array([x[3] for x in rows], np.int64)
    label, ids = np.array([x[2] for x in rows]), [x[1] for x in rows]
    lengths = np.array([len(x) for x in sketches])
    ends = np.cumsum(lengths) - lengths
    keys = np.repeat(np.arange(len(rows), dtype=np.uint64) << np.uint64(32), lengths) + np.concatenate(sketches)
    for own, both in overlap_tiles(sketches, left, right):
        fits = np.minimum(sizes[own][:, None], sizes[right]) >= threshold * np.maximum(sizes[own][:, None], sizes[right]) - 1e-9
        i, j = np.nonzero((both > 0) & fits & (label[own][:, None] != label[right]))
        a, b = own[i], right[j]
        small, large = np.where(sizes[a] <= sizes[b], a, b), np.where(sizes[a] <= sizes[b], b, a)
        limit = np.minimum(2.0**32 - 1, SKETCH / sizes[large] * 2.0**32).astype(np.uint64)
        covered = np.searchsorted(keys, (small.astype(np.uint64) << np.uint64(32)) + limit, "right") - ends[small]
        alike = both[i, j] >= (threshold - MARGIN) * (covered + lengths[large] - both[i, j])
        linked = np.zeros(both.shape, bool)
        linked[i[alike], j[alike]] = True
        yield from ((ids[x], ids[y]) for x, y in _spanning(linked, own, right, label))


def _sides(rows: list, first: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of a cell's first and second range; the range stands first in a row."""
    block = np.array([x[0] for x in rows])
    return np.flatnonzero(block == first), np.flatnonzero(block == second)


def _search(threshold: float):
    """Cells (rows of equal path and pair of ranges, in sequence) to edges that connect their components.

    Rows: path, first, second, the document's own range, id, component, size, sketch.
    """

    def edges(at, rows: list):
        if len(rows) < 2:
            return
        if len(rows) <= FEW and at[1] == at[2]:
            found = list(_one_by_one(rows, threshold))
        else:
            found = list(_in_tiles(rows, *_sides(rows, at[1], at[2]), threshold))
        if found:
            yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["u", "v"])

    def run(batches):
        at, rows = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            blocks, ids, own, sizes = (batch.column(i).to_pylist() for i in range(3, 7))
            sketches = batch.column(7)
            values, ends = sketches.flatten().to_numpy().view(np.uint32), np.asarray(sketches.offsets) - sketches.offsets[0].as_py()
            for i, where in enumerate(keys):
                if where != at:
                    yield from edges(at, rows)
                    at, rows = where, []
                rows.append((blocks[i], ids[i], own[i], sizes[i], values[ends[i] : ends[i + 1]]))
        yield from edges(at, rows)

    return run


def _verify(threshold: float):
    """Cells of texts (rows of equal root and pair of ranges, in sequence) to links.

    Rows: root, first and second range, id, the text's own range, text. Out: (id, other, links): for
    each text its number of links found here, and, once for each linked set, an edge to its least id.
    """

    def pairs(first: int, second: int, rows: list):
        left, right = _sides(rows, first, second)
        sets, ids = [x[2] for x in rows], np.array([x[1] for x in rows])
        sizes, label, links = np.array([len(x) for x in sets], float), ids.copy(), np.zeros(len(rows), np.int64)
        for own, both in overlap_tiles(sets, left, right):
            linked = both >= threshold * (sizes[own][:, None] + sizes[right] - both) - 1e-9
            linked[own[:, None] == right] = False
            links[own] += linked.sum(axis=1)
            if first != second:
                links[right] += linked.sum(axis=0)
            for _ in _spanning(linked, own, right, label):
                pass
        return [(int(ids[k]), int(label[k]), int(links[k])) for k in np.flatnonzero(links)]

    def run(batches):
        at, rows = None, []

        def closed():
            found = pairs(at[1], at[2], rows) if len(rows) > 1 else []
            if found:
                yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], ["id", "other", "links"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            ids, blocks = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i, tokens in enumerate(token_sets(batch.column(5))):
                if keys[i] != at:
                    yield from closed()
                    at, rows = keys[i], []
                rows.append((blocks[i], ids[i], tokens))
        yield from closed()

    return run


# ----------------------------------------------------------------------------------- plans


def _parts(spark: SparkSession) -> int:
    """Tasks of a comparison: as many as other shuffles have, whatever the size of their rows."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _beside(rows: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """rows with the counts of their key; the rows of one key, however many, are dealt over SALTS tasks."""
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"]).drop("salt")


def _mixed(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(path, id, own, n): entries of buckets that hold two components or more, their component and the bucket's count."""
    if roots is None:
        entries = entries.select("path", "id", F.col("id").alias("own"))
    else:
        entries = entries.join(roots, "id", "left").select("path", "id", F.coalesce("root", "id").alias("own"))
    counts = entries.groupBy("path").agg(F.count("*").cast("int").alias("n"), F.min("own").alias("low"), F.max("own").alias("high"))
    return _beside(entries, counts.where("low <> high").select("path", "n"), "path")


def _compared(cells: DataFrame, sketches: DataFrame, roots: DataFrame | None, work: Work, threshold: float) -> DataFrame:
    """The components after comparing cells (path, first, second, block, id, own)."""
    rows = cells.hint("merge").join(sketches, "id").select("path", "first", "second", "block", "id", "own", "size", "sketch")
    rows = rows.repartition(_parts(cells.sparkSession), "path", "first", "second").sortWithinPartitions("path", "first", "second", "own", "id")
    found = work.keep(rows.mapInArrow(_search(threshold), "u long, v long"))
    if roots is not None and found.isEmpty():
        return roots
    return components(found if roots is None else roots.union(found).toDF("u", "v"), work)


def _ranges(n, most: int):
    return F.ceil(F.col(n) / F.lit(most)).cast("int")


def _grid(placed: DataFrame, key: str) -> DataFrame:
    """Rows with `blocks` ranges and their own `block`, once for each pair of ranges that has it."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return placed.withColumn("other", other).withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))


def _rarest(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Of a document's paths (with their counts n and the number `spare` of most frequent ones) those it must follow, and `rank`, from the rarest."""
    own = Window.partitionBy(*keys)
    ranked = counted.withColumn("rank", F.row_number().over(own.orderBy("n", "path"))).withColumn("all", F.count("*").over(own))
    return ranked.where("all - rank + 1 > spare")


def _split(large: DataFrame, sketches: DataFrame, work: Work) -> DataFrame:
    """(path, id): documents of large buckets (path, id) along new paths, by the rarest tokens of their sketches inside each bucket."""
    tokens = large.hint("merge").join(sketches, "id").select("id", F.col("path").alias("parent"), F.col("sketch_spare").alias("spare"), F.explode("sketch").alias("token"))
    paths = work.keep(tokens.select("id", "parent", "spare", F.xxhash64("parent", "token").alias("path")))
    counts = paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    return work.keep(_rarest(_beside(paths, counts, "path"), ["id", "parent"]).select("path", "id"))


def _candidates(reps: DataFrame, work: Work, threshold: float = THRESHOLD) -> DataFrame:
    """(id, root) of the representatives that sketches connect with others."""
    every = reps.select("id", "spare", F.explode("paths").alias("path"))
    counts = every.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    entries = work.keep(_rarest(every.hint("merge").join(counts, "path"), ["id"]).select("path", "id", "rank"))
    sketches = work.keep(reps.select("id", "size", "sketch_spare", "sketch").hint("merge").join(entries.select("id").distinct(), "id"))
    # First along the rarest paths, inside ranges only: the members of a group of near copies find each other.
    blocks = _ranges("n", RANGE)
    block = F.pmod(F.xxhash64("id", "path"), blocks).cast("int")
    first = _mixed(entries.where(F.col("rank") <= FIRST).select("path", "id"), None)
    roots = _compared(first.select("path", block.alias("first"), block.alias("second"), block.alias("block"), "id", "own"), sketches, None, work, threshold)
    entries = entries.select("path", "id")
    for level in range(LEVELS + 1):
        mixed = work.keep(_mixed(entries, roots))
        small = mixed if level == LEVELS else mixed.where(F.col("n") <= LARGE)
        placed = small.select("path", "id", "own", blocks.alias("blocks"), block.alias("block"))
        roots = _compared(_grid(placed, "path").select("path", "first", "second", "block", "id", "own"), sketches, roots, work, threshold)
        large = mixed.where(F.col("n") > LARGE).select("path", "id")
        if level == LEVELS or large.isEmpty():
            return roots
        entries = _split(large, sketches, work)


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(doc_id, key, text): key is a digest that stands for the text."""
    value = text_column(text)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.unhex(F.md5(value.cast("binary"))).alias("key"), value.alias("text"))


def _joined(keyed: DataFrame, work: Work, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key) and classes of equal texts (key, least, n, root, class_id, n_links)."""
    spark = keyed.sparkSession
    described = work.keep(keyed.mapInArrow(_describe(threshold, recall), "doc_id long, key binary, size int, paths array<long>, spare int, sketch_spare int, sketch array<int>"))
    rows = described.select("doc_id", "key")
    # Classes of equal texts, under the least id, or under a number from the digest where ids don't tell rows apart.
    seen = rows.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    plain = seen["rows"] == seen["ids"]
    own = F.col("least") if plain else F.xxhash64("key")
    traits = ("size", "paths", "spare", "sketch_spare", "sketch")
    classes = described.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first(F.struct(*traits)).alias("x"))
    classes = work.keep(classes.select("key", "least", own.alias("id"), "n", *(f"x.{c}" for c in traits)))
    near = work.keep(_candidates(classes, work, threshold).join(classes.select("id", "key", "size"), "id").select("id", "root", "key", "size"))
    # Exact check: each component's texts, in pairs of ranges.
    counts = near.groupBy("root").agg(F.count("*").alias("m"), F.sum("size").alias("tokens"))
    counts = counts.select("root", F.greatest(_ranges("m", BLOCK), _ranges("tokens", BLOCK_TOKENS)).alias("blocks"))
    placed = _beside(near, counts, "root").select("id", "key", "root", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    if plain:
        texts = keyed.select(F.col("doc_id").alias("id"), "text").hint("merge").join(placed, "id")
    else:
        texts = keyed.groupBy("key").agg(F.any_value("text").alias("text")).join(placed, "key")
    spread = _grid(texts, "root").select("root", "first", "second", "id", "block", "text")
    spread = spread.repartition(_parts(spark), "root", "first", "second").sortWithinPartitions("root", "first", "second", "id")
    verified = work.keep(spread.mapInArrow(_verify(threshold), "id long, other long, links long"))
    roots = components(verified.select(F.col("id").alias("u"), F.col("other").alias("v")).where("u <> v"), work)
    links = verified.groupBy("id").agg(F.sum("links").alias("n_links"))
    named = classes.select("key", "id", "least", "n").join(roots, "id", "left").join(links, "id", "left")
    named = named.withColumn("root", F.coalesce("root", "id")).withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    if plain:
        return rows, named.withColumn("class_id", F.col("root"))
    named = work.keep(named)
    return rows, named.join(named.groupBy("root").agg(F.min("least").alias("class_id")), "root")


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, n_links, copy_of, n_copies.

    class_id: the least id among the documents that links and equality of texts connect with this one.
    n_links: different texts (not copies of them) linked with this one. copy_of: the least id with this
    text. n_copies: rows with this text.
    """
    small_batches(docs.sparkSession)
    work = Work(docs.sparkSession, "jaccard")
    rows, classes = _joined(_keyed(docs, id_column, text), work, threshold, recall)
    classes = classes.select("key", "class_id", "n_links", F.col("least").alias("copy_of"), F.col("n").alias("n_copies"))
    return work.settle(rows.join(classes, "key").select("doc_id", "class_id", "n_links", "copy_of", "n_copies"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, less all but one of each group: the one with the least id (nulls last), then the least digest.

    Of rows equal in id and text one stays.
    """
    small_batches(docs.sparkSession)
    work = Work(docs.sparkSession, "jaccard")
    rows, classes = _joined(_keyed(docs, id_column, text), work, threshold, recall)
    repeated = not rows.groupBy("doc_id", "key").count().where("count > 1").isEmpty()
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "key"))
    kept = work.settle(classes.groupBy("root").agg(first.alias("x")).select(F.col("x.key").alias("kept_key"), F.col("x.least").alias("kept_id")))
    # The rows travel whole in one column, so no name of theirs can clash.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    packed = docs.select(row, F.col(id_column).cast("long").alias("own_id"), F.unhex(F.md5(text_column(text).cast("binary"))).alias("own_key"))
    same = (F.col("own_key") == F.col("kept_key")) & F.col("own_id").eqNullSafe(F.col("kept_id"))
    out = packed.hint("merge").join(kept, same, "left_semi")
    if repeated:  # rows equal in id and text
        out = out.dropDuplicates(["own_id", "own_key"])
    return out.select("row.*")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and link counts of all documents."""
    return join(table(spark, sf_dir, "documents", ["doc_id", "text"]))


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
ORACLE: dict[str, str] = {}
