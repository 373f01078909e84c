"""Queries that write tables and read them back in every format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.operators import readout
from hyperloom.sources import store
from hyperloom.sources.answers import answers, profiles


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, path = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal"), store.scratch(spark)
    store.write_csv(found, path)
    return store.read_csv(spark, path, found.schema)


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, path = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey"), store.scratch(spark)
    store.write_json(found, path)
    return store.read_json(spark, path).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in found.schema))


def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, path = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_size"), store.scratch(spark)
    store.write_parquet(found, path)
    return store.read_parquet(spark, path, ["p_partkey", "p_size"]).where("p_size > 25")


def vector_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width bundles, stored by dimension and read back: their lengths and sums."""
    made = readout.bundles(profiles(answers(spark, sf_dir)), (11,), widths=(50,))
    rows = made.select(F.lit(readout.DIMENSION).alias("dimension"), "seed", F.col("vid").cast("string").alias("respondent_id"), F.col("width").alias("bundle_width"), "vector")
    path = store.scratch(spark)
    store.write_vectors(rows, path, symbols=False)
    stored = store.read_vectors(spark, path, readout.DIMENSION, symbols=False)
    total = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x)
    return stored.select("dimension", "seed", "respondent_id", F.size("vector").alias("coordinates"), total.alias("total"))


QUERIES = {f.__name__: f for f in (csv_roundtrip, json_roundtrip, parquet_roundtrip, vector_table_roundtrip)}


def _vector_sql() -> str:
    from hyperloom.plans.questionnaire import _ONE, _with

    return _with(*_ONE) + "SELECT 256 AS dimension, seed, vid::VARCHAR AS respondent_id, len(v)::INT AS coordinates, list_sum(v)::BIGINT AS total FROM bundles WHERE width = 50"


ORACLE = {
    "csv_roundtrip": "SELECT s_suppkey, s_name, s_acctbal FROM supplier",
    "json_roundtrip": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "parquet_roundtrip": "SELECT p_partkey, p_size FROM part WHERE p_size > 25",
    "vector_table_roundtrip": _vector_sql(),
}
