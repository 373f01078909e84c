"""Connected components of an edge table by alternating large and small stars.

Each round is two grouped minima and two joins; edges shrink to stars in a number of rounds that is
logarithmic in practice. No vertex's neighbours are gathered in one place, so a hub with a third of all
rows is dealt like any other: minima are combined before the shuffle and the joins are of the kind that
adaptive execution splits. A graph of at most ONE_TASK edges, by count, is contracted in one task instead:
its rounds would cost more than the work.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.shared import Work

ROUNDS = 50
#: Edges up to which one task does it all (16 bytes each), and beyond which the rounds do.
ONE_TASK = 50_000


def _contract(batches):
    """All edges to (vertex, least vertex of its component)."""
    parent: dict[int, int] = {}

    def top(x):
        path = []
        while (up := parent.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            parent[y] = x
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = top(u), top(v)
            if p != q:
                parent[max(p, q)] = min(p, q)
    ids = list(parent)
    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([top(x) for x in ids], pa.int64())], ["id", "root"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, work: Work) -> DataFrame:
    """(id, root) for every vertex of written edges (u, v): root is the least id of its component."""
    if edges.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return work.keep(edges.select("u", "v").coalesce(1).mapInArrow(_contract, "id long, root long"))
    now = work.keep(_small_star(edges.select("u", "v")))
    seen = None
    for _ in range(ROUNDS):
        after = work.keep(_small_star(_large_star(now)))
        work.drop(now)
        now = after
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == seen:
            break
        seen = (state.n, state.h)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
