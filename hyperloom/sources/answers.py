"""Ordinal answers: `embeddings` read as questionnaires, or the published questionnaire files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyperloom.functions.vectors import reverse_scored

ITEMS, FACTORS, LEVELS = 50, 5, 5
WIDTHS = (5, 10, 20, 30, 40, 50)
ITEM_SCHEMA = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("position", T.ShortType()), T.StructField("factor_id", T.ByteType()), T.StructField("factor_name", T.StringType()), T.StructField("key_direction", T.StringType()), T.StructField("statement", T.StringType())])
RESPONSE_SCHEMA = T.StructType([T.StructField("respondent_id", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("raw_response", T.ByteType()), T.StructField("scored_response", T.ByteType())])


def items(spark: SparkSession) -> DataFrame:
    """(pos, factor, key) of the items: factors in turn, odd positions keyed forward."""
    pos = F.col("id").cast("int")
    return spark.range(1, ITEMS + 1).select(pos.alias("pos"), ((pos - 1) % FACTORS + 1).alias("factor"), F.when(pos % 2 == 1, "+").otherwise("-").alias("key"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vid, pos, factor, key, raw, scored): dimensions 1 to 50 of every vector, in five levels."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    level = lambda x: F.least(F.lit(5), F.greatest(F.lit(1), F.floor((x.cast("double") + 0.3) / 0.12).cast("int") + 1))
    long = table.select(F.col("vec_id").alias("vid"), F.posexplode(F.slice("embedding", 1, ITEMS)).alias("at", "x"))
    pos = F.col("at") + 1
    out = long.select("vid", pos.alias("pos"), ((pos - 1) % FACTORS + 1).alias("factor"), F.when(pos % 2 == 1, "+").otherwise("-").alias("key"), level(F.col("x")).alias("raw"))
    return out.withColumn("scored", reverse_scored(F.col("raw"), F.col("key")))


def answer_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vid, raw, levels): the same answers as arrays in position order, a respondent a row, without a shuffle."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    level = lambda x: F.least(F.lit(5), F.greatest(F.lit(1), F.floor((x.cast("double") + 0.3) / 0.12).cast("int") + 1))
    raw = table.select(F.col("vec_id").alias("vid"), F.transform(F.slice("embedding", 1, ITEMS), level).alias("raw"))
    return raw.select("vid", "raw", F.transform("raw", lambda x, i: F.when(i % 2 == 1, 6 - x).otherwise(x)).alias("levels"))


def profiles(answered: DataFrame) -> DataFrame:
    """(vid, levels): each respondent's scored answers in position order."""
    return answered.groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("pos", "scored"))).alias("x")).select("vid", F.col("x.scored").alias("levels"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """An item file with a header, by name, with explicit types."""
    raw = spark.read.csv(path, header=True)
    return raw.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in ITEM_SCHEMA if f.name in raw.columns))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """(profile_id, item_id, raw_answer) of a response file."""
    return spark.read.csv(path, header=True, schema="profile_id string, item_id string, raw_answer int")


# Generated questionnaires: a stable byte of a label decides anchors and answers.

# Fixed values of the published questionnaire.
GENERATOR_SEED = "hyp84-questionnaire-v1"
FEATURED_ANCHORS = (4, 3, 5, 2, 4)
KEYS = "+-+-+-+-+-+-+-+-+-+-+-+-+-+---+-+-+-+--++++-+-++-+"
PROFILES = 31
FACTOR_NAMES = ("Extraversion", "Agreeableness", "Conscientiousness", "Emotional Stability", "Intellect/Imagination")


def stable_byte(*parts):
    """The first byte of a SHA-256 digest of the seed and the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(GENERATOR_SEED), *parts), 256), 1, 2), 16, 10).cast("int")


def anchor(profile, factor):
    """A profile's level on a factor: fixed for the featured profile, else from its label."""
    drawn = 1 + stable_byte(profile, factor.cast("string"), F.lit("anchor")) % 5
    return F.when(profile == "featured", F.element_at(F.lit(list(FEATURED_ANCHORS)), factor)).otherwise(drawn)


def raw_answer(profile, item, anchored, key):
    """The keyed anchor, moved one down or up for one byte in six each, kept within 1 to 5."""
    byte = stable_byte(profile, item, F.lit("item-variation")) % 6
    keyed = F.when(key == "-", 6 - anchored).otherwise(anchored)
    moved = keyed + F.when(byte == 0, -1).when(byte == 5, 1).otherwise(0)
    return F.greatest(F.lit(1), F.least(F.lit(5), moved))


def study_items(spark: SparkSession) -> DataFrame:
    """(item_id, position, factor_id, factor_name, key_direction) of the published questionnaire."""
    pos = F.col("id").cast("int")
    factor = (pos - 1) % FACTORS + 1
    return spark.range(1, ITEMS + 1).select(F.format_string("Q%02d", pos).alias("item_id"), pos.cast("short").alias("position"), factor.alias("factor_id"), F.element_at(F.lit(list(FACTOR_NAMES)), factor).alias("factor_name"), F.substring(F.lit(KEYS), pos, F.lit(1)).alias("key_direction"))


def study_profiles(spark: SparkSession) -> DataFrame:
    """(vid, profile_id) of the published profiles, the featured one first."""
    return spark.range(PROFILES).select(F.col("id").alias("vid"), F.when(F.col("id") == 0, "featured").otherwise(F.format_string("sensitivity_%02d", F.col("id"))).alias("profile_id"))


def study_responses(spark: SparkSession) -> DataFrame:
    """(profile_id, item_id, raw_answer): every profile on every item, a fixed number of rows."""
    rows = study_profiles(spark).crossJoin(study_items(spark))
    anchored = anchor(F.col("profile_id"), F.col("factor_id"))
    return rows.select("profile_id", "item_id", raw_answer(F.col("profile_id"), F.col("item_id"), anchored, F.col("key_direction")).alias("raw_answer"))
