"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern (the set of their
sources), and the patterns' words are routed to the sources' quotas: a pattern offers its words once for
each repetition up to REPEATS, each repetition at a higher cost than the one before, so the flow of least
cost spreads repetition as thinly as the quotas allow. The flow has one node per pattern and source, a
size that does not grow with the documents. A pattern's flow is then whole repetitions of all its
documents and a last part of them, taken in an order drawn from the seed.

Patterns, sources, targets and flows are tables; none is gathered on the driver, so their number has no limit.
A source that is one pattern's alone, and a pattern of that source alone, needs no routing: its flow is the
quota. The other patterns are routed group by group, a group being those connected by shared sources, each in
a task.

The order is a hash of seed, id, text and sources; rows equal in all of these are numbered, and the number
goes into the hash, so each is taken or left by itself. Words before a document are those of the hash slices
before its own, summed over the slices' totals, and a running sum inside its slice, so a source with a third
of all rows is dealt over 16**SLICE_DIGITS slices.

Defined results: null text has size 0; a null source is the last source; a document without any source is not
taken; equal tables give equal results; without words every target is 0 and nothing is taken; an empty table
gives an empty result; other columns are ignored by `mix` and kept, whatever their names, by `taken`.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hyperloom.llm.components import components
from hyperloom.llm.shared import Work, table, text_column

REPEATS = 3
SEED = "mix-1"
#: Hexadecimal digits of the hash that name a slice.
SLICE_DIGITS = 3
#: Patterns up to which their figures are broadcast; more are joined by a shuffle.
BROADCAST = 100_000
WORD = r"[^\x20\x09-\x0D]+"


# ------------------------------------------------------------------------------- sources and targets


def cycled(sources: DataFrame, work: Work) -> DataFrame:
    """Sources (source, size) with weight 1, 2, 3, repeating, by code point, null last. They are numbered range by range."""
    ranged = work.keep(sources.repartitionByRange(F.asc_nulls_last("source")).withColumn("task", F.spark_partition_id()))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("task").agg(F.count("*").alias("n")).select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("task").orderBy(F.asc_nulls_last("source"))) - 1
    return ranged.withColumn("own", own).join(F.broadcast(offsets), "task").select("source", "size", (1 + (F.col("offset") + F.col("own")) % 3).cast("long").alias("weight"))


def with_targets(sources: DataFrame, total: int, most: int = REPEATS) -> DataFrame:
    """Sources (source, size, weight) with their target and quota (the target as a whole number).

    Targets are shares of total by weight, none above `most` times its source's size; the excess is shared
    again by weight. Each round is one sum over the sources: those that stop at the present unit stop for
    good, and the unit grows, until no more do.
    """
    wide = lambda c: c.cast("decimal(19,0)")
    stopped, weights = 0, sources.agg(F.sum("weight").alias("w")).first().w or 0
    left, open_ = total, weights
    while True:
        stops = wide(F.lit(left)) * wide(F.col("weight")) > wide(F.lit(most) * F.col("size")) * wide(F.lit(open_))
        found = sources.where(stops).agg(F.sum(F.lit(most) * F.col("size")).alias("s"), F.sum("weight").alias("w")).first()
        now = found.s or 0
        if now == stopped and (found.w or 0) == weights - open_:
            break
        stopped, open_, left = now, weights - found.w, total - now
    share = (F.lit(left) * F.col("weight")).cast("double") / F.lit(float(open_ or 1))
    target = F.when(stops, (F.lit(most) * F.col("size")).cast("double")).otherwise(share)
    return sources.withColumn("target", target).withColumn("quota", F.bround("target", 0).cast("long"))


# --------------------------------------------------------------------------------------- the flow


def route(words: dict, members: dict, quotas: dict, repeats: int = REPEATS) -> dict:
    """Flow of least cost from patterns (words, and sources by members) to the sources' quotas: words by pattern.

    The cost of a pattern's r-th repetition is r, and no path returns to the start, so shortest paths come by
    repetition: each r in turn adds its room to the start's arcs, and blocking flows fill what they can.
    """
    patterns, sources = list(words), list(quotas)
    place = {s: len(patterns) + j for j, s in enumerate(sources)}
    start, end = len(patterns) + len(sources), len(patterns) + len(sources) + 1
    graph: list[list[int]] = [[] for _ in range(end + 1)]
    to: list[int] = []
    room: list[int] = []

    def arc(u, v, r):
        for a, b, x in ((u, v, r), (v, u, 0)):
            graph[a].append(len(to))
            to.append(b)
            room.append(x)

    first = len(to)
    for i in range(len(patterns)):
        arc(start, i, 0)
    for i, p in enumerate(patterns):
        for s in members[p]:
            arc(i, place[s], 1 << 62)
    for s in sources:
        arc(place[s], end, quotas[s])

    def levels():
        depth, queue = [-1] * (end + 1), deque([start])
        depth[start] = 0
        while queue:
            u = queue.popleft()
            for k in graph[u]:
                if room[k] > 0 and depth[to[k]] < 0:
                    depth[to[k]] = depth[u] + 1
                    queue.append(to[k])
        return depth

    for _ in range(repeats):
        for i, p in enumerate(patterns):
            room[first + 2 * i] += words[p]
        while (depth := levels())[end] >= 0:
            tried, path, u = [0] * (end + 1), [], start
            while True:
                if u == end:
                    amount = min(room[k] for k in path)
                    for k in path:
                        room[k] -= amount
                        room[k ^ 1] += amount
                    full = next(i for i, k in enumerate(path) if room[k] == 0)
                    u, path = to[path[full] ^ 1], path[:full]
                while tried[u] < len(graph[u]):
                    k = graph[u][tried[u]]
                    if room[k] > 0 and depth[to[k]] == depth[u] + 1:
                        break
                    tried[u] += 1
                else:
                    if u == start:
                        break
                    u = to[path.pop() ^ 1]
                    tried[u] += 1
                    continue
                path.append(k)
                u = to[k]
    return {p: room[(first + 2 * i) ^ 1] for i, p in enumerate(patterns)}


def _routed(patterns: DataFrame, sources: DataFrame, repeats: int, work: Work) -> DataFrame:
    """(sources, flow) of patterns (sources, size): quotas of lone sources, and routed groups."""
    pairs = patterns.select("sources", F.col("size").alias("words"), F.explode("sources").alias("source"))
    use = pairs.groupBy("source").agg(F.count("*").alias("patterns"), F.max(F.size("sources")).alias("widest"))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    used = sources.alias("s").join(use.alias("u"), same("s", "u")).select("s.source", "quota", ((F.col("patterns") == 1) & (F.col("widest") == 1)).alias("lone"))
    arcs = work.keep(pairs.alias("p").join(used.alias("u"), same("p", "u")).select("sources", "words", "p.source", "quota", "lone"))
    lone = arcs.where("lone").select("sources", F.least("quota", F.col("words") * repeats).alias("flow"))
    shared = arcs.where("not lone").select("sources", "words", "source", "quota", F.xxhash64(F.lit("p"), "sources").alias("u"), F.xxhash64(F.lit("s"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).alias("v"))
    if shared.isEmpty():
        return lone
    shared = work.keep(shared)
    groups = components(shared.select("u", "v"), work)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["u", "v"])
        flow = route(dict(zip(rows.u, rows.words, strict=True)), rows.groupby("u").v.apply(list).to_dict(), dict(zip(rows.v, rows.quota, strict=True)), repeats)
        return pd.DataFrame({"u": list(flow), "flow": [int(x) for x in flow.values()]})

    rows = shared.select("u", "v", "words", "quota").join(groups.select(F.col("id").alias("u"), "root"), "u").groupBy("root")
    flows = rows.applyInPandas(solve, "u long, flow long")
    return lone.union(shared.select("u", "sources").distinct().join(flows, "u").select("sources", "flow"))


# -------------------------------------------------------------------------------------- documents


def _measured(docs: DataFrame, id_column, sources, text: str, seed: str, *more) -> DataFrame:
    """Id, sources, size and key (a hash of seed, id, text and sources) of each document, with further columns."""
    found = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.array_sort(F.array_distinct(sources)).alias("sources"), text_column(text).alias("mix_text"), *more)
    names = F.array_join(F.transform("sources", lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("n"))), ",")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.col("mix_text").cast("binary")), names).cast("binary"))
    return found.select("doc_id", "sources", F.regexp_count("mix_text", F.lit(WORD)).cast("long").alias("size"), key.alias("key"), *(c for c in found.columns if c not in ("doc_id", "sources", "mix_text")))


def _drawn(rows: DataFrame, work: Work) -> DataFrame:
    """Measured rows with their draw: the key, or a hash of it and a number for all but one of the rows that share it.

    Rows of one key are alike; they are numbered task by task, so no task needs all of them.
    """
    many = work.keep(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    if many.isEmpty():
        return rows.withColumn("draw", F.col("key"))
    repeated = work.keep(rows.join(many, "key", "left_semi").withColumn("mix_task", F.spark_partition_id()).withColumn("mix_place", F.monotonically_increasing_id()))
    counts = repeated.groupBy("key", "mix_task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("mix_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("key", "mix_task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_offset"))
    own = F.row_number().over(Window.partitionBy("key", "mix_task").orderBy("mix_place")) - 1
    number = F.col("mix_offset") + own
    draw = F.when(number == 0, F.col("key")).otherwise(F.md5(F.concat_ws(":", "key", number.cast("string")).cast("binary")))
    numbered = repeated.join(offsets, ["key", "mix_task"]).withColumn("draw", draw).select(*rows.columns, "draw")
    return rows.join(many, "key", "left_anti").select(*rows.columns, F.col("key").alias("draw")).union(numbered)


def plan(docs: DataFrame, work: Work, weights=cycled, share: float = 1.0, repeats: int = REPEATS) -> DataFrame:
    """Per membership pattern of drawn documents: source_size, target, whole repetitions, and where the last part ends: its slice and last draw."""
    patterns = work.keep(docs.groupBy("sources").agg(F.sum("size").cast("long").alias("size")))
    pairs = patterns.select("sources", "size", F.explode("sources").alias("source"))
    sources = weights(pairs.groupBy("source").agg(F.sum("size").cast("long").alias("size")), work)
    total = int((patterns.agg(F.sum("size").alias("n")).first().n or 0) * Fraction(share))
    sources = work.keep(with_targets(work.keep(sources), total, repeats))
    flows = _routed(patterns, sources, repeats, work)
    own = pairs.alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).groupBy("sources").agg(F.sum("s.size").alias("source_size"), F.sum("target").alias("target"))
    made = patterns.join(own, "sources", "left").join(flows, "sources", "left").select(
        "sources", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"),
        F.expr("coalesce(flow, 0) div greatest(size, 1)").alias("whole"), F.expr("coalesce(flow, 0) % greatest(size, 1)").alias("part"),
    )
    made = work.keep(made)
    # Words of the slices before a slice, and of the documents before a document in its slice.
    docs = docs.withColumn("slice", F.substring("draw", 1, SLICE_DIGITS))
    slices = docs.groupBy("sources", "slice").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sources").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("sources", "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    # Only the slice in which a part ends is ordered by document; those before it are taken whole.
    few = _small if made.count() <= BROADCAST else lambda x: x
    ends = slices.join(few(made.select("sources", "part")), "sources").where("part > 0 and before <= part")
    ends = work.keep(ends.groupBy("sources", "part").agg(F.max(F.struct("slice", "before")).alias("x")).select("sources", "part", "x.slice", "x.before"))
    inside = Window.partitionBy("sources", "slice").orderBy("draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = docs.select("sources", "slice", "draw", "size").join(few(ends), ["sources", "slice"]).withColumn("upto", F.sum("size").over(inside))
    # The part ends with the document whose middle is still inside it.
    last = last.where(F.col("before") + F.col("upto") - F.col("size") / 2 <= F.col("part"))
    last = last.groupBy("sources").agg(F.max("draw").alias("last"))
    return made.join(ends.select("sources", "slice"), "sources", "left").join(last, "sources", "left")


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows)  # at most BROADCAST rows


def _applied(docs: DataFrame, made: DataFrame) -> DataFrame:
    """Drawn documents with their pattern's figures and the words taken of each."""
    more = (F.substring("draw", 1, SLICE_DIGITS) < F.col("slice")) | (F.col("last").isNotNull() & (F.col("draw") <= F.col("last")))
    joined = docs.join(_small(made) if made.count() <= BROADCAST else made, "sources")
    return joined.withColumn("taken", F.col("size") * (F.col("whole") + F.coalesce(more, F.lit(False)).cast("long")))


def mix(docs: DataFrame, sources, id_column: str = "doc_id", text: str = "text", weights=cycled, share: float = 1.0, seed: str = SEED, repeats: int = REPEATS) -> DataFrame:
    """One row per document: doc_id, sources, size, source_size, target, taken.

    sources: a column with an array of a document's sources. source_size and target are sums over them.
    weights: of (sources with their size, work) to the same with a whole weight.
    """
    work = Work(docs.sparkSession, "mixing")
    drawn = work.keep(_drawn(work.keep(_measured(docs, id_column, sources, text, seed)), work))
    made = work.keep(plan(drawn, work, weights, share, repeats))
    return _applied(drawn, made).select("doc_id", "sources", "size", "source_size", "target", "taken")


def taken(docs: DataFrame, sources, id_column: str = "doc_id", text: str = "text", weights=cycled, share: float = 1.0, seed: str = SEED, repeats: int = REPEATS) -> DataFrame:
    """The documents that the mix takes, with their columns and mix_size, mix_target, mix_taken. The texts are shuffled only where rows are alike in id, text and sources."""
    work = Work(docs.sparkSession, "mixing")
    drawn = work.keep(_drawn(work.keep(_measured(docs, id_column, sources, text, seed)), work))
    made = work.keep(plan(drawn, work, weights, share, repeats))
    whole = _measured(docs, id_column, sources, text, seed, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = _applied(_drawn(whole, work), made)
    return out.where("taken > 0").select("row.*", F.col("size").alias("mix_size"), F.col("target").alias("mix_target"), F.col("taken").alias("mix_taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, each in its one source."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return mix(docs, F.array("source")).drop("sources")


QUERIES = {"op6_mixing": op6_mixing}
ORACLE = {
    "op6_mixing": r"""
WITH docs AS (
  SELECT doc_id, source, size, CASE WHEN number = 0 THEN key ELSE md5(key || ':' || number) END AS draw
  FROM (SELECT *, row_number() OVER (PARTITION BY key) - 1 AS number FROM (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':' || coalesce('s' || source, 'n')) AS key
    FROM documents))),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM docs GROUP BY source),
-- Sources stop in the order of size over weight; unit is what a weight of 1 gets of the rest.
filled AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER w, 0) AS stopped,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weights
  FROM sources
  WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (
  SELECT *, (total - stopped) * weight > 3 * source_size * weights AS stops FROM filled),
targets AS (
  SELECT source, source_size,
         CASE WHEN stops THEN (3 * source_size)::DOUBLE
              ELSE (weight * (SELECT max(total) - coalesce(sum(3 * source_size) FILTER (stops), 0) FROM marked))::DOUBLE
                   / (SELECT sum(weight) FILTER (NOT stops) FROM marked)::DOUBLE END AS target
  FROM marked),
placed AS (
  SELECT doc_id, size, source_size, target,
         round_even(target, 0)::BIGINT // greatest(source_size, 1) AS whole,
         round_even(target, 0)::BIGINT % greatest(source_size, 1) AS part,
         sum(size) OVER (PARTITION BY docs.source ORDER BY draw ROWS UNBOUNDED PRECEDING) AS upto
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN part > 0 AND upto - size / 2.0 <= part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
""",
}
