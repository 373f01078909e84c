"""Sources and sinks: CSV, JSON, Parquet, vector tables and file checksums."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession) -> str:
    """A new folder name in the store that driver and executors share, deleted with the process.

    A local one is made on a single machine only; a cluster without a shared folder is an error.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = known.get() if known.isDefined() else None
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="hyperloom-")
    path = f"{shared}/{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit
        return


def write_table(frame: DataFrame, path: str, schema: T.StructType) -> None:
    """A plain table (items, responses) under a fixed schema; raises where a column is missing."""
    write_parquet(frame.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema)), path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV file with a header; without a schema every column is a string."""
    reader = spark.read.option("header", True).option("enforceSchema", False)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(frame: DataFrame, path: str) -> None:
    """One CSV file with a header and line feeds, for results of bounded size."""
    frame.coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    found = spark.read.parquet(path)
    return found.select(*columns) if columns else found


def write_parquet(frame: DataFrame, path: str, *partitions: str, codec: str = "zstd") -> None:
    writer = frame.write.mode("overwrite").option("compression", codec)
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def read_json(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    """JSON rows, one a line; or one document that spans lines."""
    return spark.read.option("multiLine", document).json(path)


def write_json(frame: DataFrame, path: str) -> None:
    frame.coalesce(1).write.mode("overwrite").json(path)


def vector_schema(symbols: bool) -> T.StructType:
    """The two vector tables: symbols, or profile bundles."""
    field = T.StructField
    head = [field("kind", T.StringType()), field("namespace", T.StringType()), field("symbol_id", T.StringType())] if symbols else [field("respondent_id", T.StringType()), field("bundle_width", T.ByteType())]
    return T.StructType([field("dimension", T.IntegerType()), field("seed", T.IntegerType()), *head, field("vector", T.ArrayType(T.ByteType()))])


def write_vectors(frame: DataFrame, path: str, symbols: bool) -> None:
    """Writes a vector table by dimension; every vector must be as long as its dimension, every value fit a byte."""
    schema = vector_schema(symbols)
    bad = frame.where((F.size("vector") != F.col("dimension")) | F.exists("vector", lambda x: (x < -128) | (x > 127)))
    if not bad.isEmpty():
        raise ValueError("a vector has another length than its dimension, or values beyond a byte")
    write_parquet(frame.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema)), path, "dimension")


def read_vectors(spark: SparkSession, path: str, dimension: int, symbols: bool) -> DataFrame:
    """A dimension's vectors; only its partition is read. Raises if the stored columns are others."""
    found = spark.read.parquet(path).where(F.col("dimension") == dimension)
    want = {(f.name, f.dataType.simpleString()) for f in vector_schema(symbols)}
    if {(f.name, f.dataType.simpleString()) for f in found.schema} != want:
        raise ValueError("the stored table has other columns")
    return found.select(*(f.name for f in vector_schema(symbols)))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
