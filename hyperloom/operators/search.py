"""Exact filtered vector search: filter, cosine, order, limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.functions import vectors


def nearest(table: DataFrame, query: list[int], k: int, where: Column | str | None = None, vector: str = "vector", tie: str = "symbol_id") -> DataFrame:
    """The k rows nearest to the query by cosine distance (ties: the lesser label); the filter runs before any distance."""
    found = table if where is None else table.where(where)
    probe = F.lit(list(query))
    dots = vectors.dot(F.col(vector), probe)
    squared = float(sum(x * x for x in query))
    distance = 1 - dots / (F.sqrt(vectors.dot(F.col(vector), F.col(vector)).cast("double")) * F.lit(squared**0.5))
    return found.withColumn("distance", distance).orderBy("distance", tie).limit(k)


def nearest_each(table: DataFrame, queries: DataFrame, k: int, keys: list[str], vector: str = "vector", tie: str = "symbol_id") -> DataFrame:
    """The k nearest rows of the same keys for every query (keys, query_id, probe), as one grouped plan."""
    joined = queries.join(table, keys)
    distance = 1 - vectors.cosine(vectors.dot(F.col("probe"), F.col(vector)), vectors.dot(F.col("probe"), F.col("probe")), vectors.dot(F.col(vector), F.col(vector)))
    best = F.slice(F.array_sort(F.collect_list(F.struct(distance.alias("distance"), F.col(tie)))), 1, k)
    return joined.groupBy(*keys, "query_id").agg(best.alias("found")).select(*keys, "query_id", F.posexplode("found").alias("rank", "x")).select(*keys, "query_id", (F.col("rank") + 1).alias("rank"), F.col(f"x.{tie}").alias(tie), "x.distance")
