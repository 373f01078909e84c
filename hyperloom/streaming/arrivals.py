"""New records checked as they arrive: which stored records share values with them.

A stream of records is joined with the stored ones by property and value, a stream-static equi-join without
state; each micro-batch is counted on its own and appended to a table, so a restart from the checkpoint
repeats no batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hyperloom.sources.records import occurrences


def sharing_with(stored: DataFrame, arrived: DataFrame, least: int = 1) -> DataFrame:
    """(id, match, k): stored records that share k >= least values with an arrived one."""
    pairs = occurrences(arrived).alias("a").join(occurrences(stored).alias("s"), ["role", "value"])
    return pairs.groupBy(F.col("a.id").alias("id"), F.col("s.id").alias("match")).agg(F.count("*").cast("int").alias("k")).where(F.col("k") >= least)


def watch(arrivals: DataFrame, stored: DataFrame, path: str, checkpoint: str, least: int = 2) -> StreamingQuery:
    """Starts a query that appends matches of arriving records, with their batch, to a Parquet table."""

    def each(batch: DataFrame, number: int) -> None:
        found = sharing_with(stored, batch, least).withColumn("batch", F.lit(number))
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
