"""Categorical records: five properties of `part`, or the published 40,000-record sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROPERTIES = ("region", "education", "occupation", "interest_cluster", "employer")
CARDINALITIES = (20, 10, 100, 200, 1_000)
RECORDS, RECORD_SEED = 40_000, 101
#: Names of the five properties of a record table.
FIELDS = ("f1", "f2", "f3", "f4", "f5")
SCHEMA = "record_id int, " + ", ".join(f"{p} smallint" for p in PROPERTIES)


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, f1..f5): name, brand, type, size and price in cents of every part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("f1"), F.col("p_brand").alias("f2"), F.col("p_type").alias("f3"), F.col("p_size").cast("string").alias("f4"), cents.cast("string").alias("f5"))


def study_records(spark: SparkSession, n: int = RECORDS, seed: int = RECORD_SEED) -> DataFrame:
    """The published records, drawn property by property from one generator."""
    from hyperloom.functions.codebook import Twister

    draws = Twister(seed)
    columns = {p: draws.categories(n, c).astype("int16") for p, c in zip(PROPERTIES, CARDINALITIES, strict=True)}
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"record_id": range(n), **columns}), SCHEMA)


def hashed_records(spark: SparkSession, n: int, cardinalities=CARDINALITIES, seed: int = RECORD_SEED) -> DataFrame:
    """n uniform records made where they are used, for sizes beyond the published sequence."""
    codes = [F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(c)).cast("smallint").alias(p) for i, (p, c) in enumerate(zip(PROPERTIES, cardinalities, strict=True))]
    return spark.range(n).select(F.col("id").cast("int").alias("record_id"), *codes)


def nested_sizes(n: int) -> list[int]:
    """A tenth, 0.325 and all of n records: the proportions of the published sizes."""
    return sorted({max(1, n * 100 // 1000), max(1, n * 325 // 1000), max(1, n)})


def occurrences(records: DataFrame) -> DataFrame:
    """(id, role, value) rows of a record table."""
    facts = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("role"), F.col(f).alias("value")) for i, f in enumerate(FIELDS))))
    return records.select("id", facts.alias("x")).select("id", "x.role", "x.value")
