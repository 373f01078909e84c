"""Queries of the collision study over `part`: overlap counts, codebooks, all-pairs trials, theory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.functions import theory, vectors
from hyperloom.functions.codebook import packed
from hyperloom.operators import overlap, pairs
from hyperloom.sources.records import FIELDS, nested_sizes, occurrences, part_records

DIMENSION = 1024
SEEDS = (0, 1)
WORDS = DIMENSION // 32
GRAM_DIMENSION = 256


def _size(spark: SparkSession, sf_dir: str) -> int:
    return part_records(spark, sf_dir).count()


def overlap_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = overlap.grouped_pairs(part_records(spark, sf_dir))
    counts = sums.agg(*overlap.exact_columns())
    return counts.unpivot([], [f"k{k}" for k in range(len(FIELDS) + 1)], "name", "pairs").select(F.substr("name", F.lit(2)).cast("int").alias("k"), "pairs")


def overlap_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = nested_sizes(_size(spark, sf_dir))
    bucket = F.lit(len(sizes))
    for b, n in reversed(list(enumerate(sizes))):
        bucket = F.when(F.col("id") < n, b).otherwise(bucket)
    sums = overlap.grouped_pairs(part_records(spark, sf_dir).withColumn("bucket", bucket), buckets=list(range(len(sizes))))
    long = sums.unpivot(["j"], [f"p{b}" for b in range(len(sizes))], "bucket", "pairs")
    counts = long.groupBy("bucket").agg(*overlap.exact_columns())
    n = F.element_at(F.lit(sizes), F.substr("bucket", F.lit(2)).cast("int") + 1).cast("long")
    every = sum(F.col(f"k{k}") for k in range(len(FIELDS) + 1))
    return counts.select(n.alias("n"), every.alias("pairs"), F.col("k0").alias("unrelated_pairs"), (every - F.col("k0")).alias("true_pairs_1"), (every - F.col("k0") - F.col("k1")).alias("true_pairs_2"))


def duplicate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = part_records(spark, sf_dir).agg(F.count("*").alias("records"), F.count_distinct(F.struct(*FIELDS)).alias("distinct_records"))
    return counts.withColumn("duplicates", F.col("records") - F.col("distinct_records"))


def shared_count_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.sharing_pairs(part_records(spark, sf_dir), 2)


def codebook_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = occurrences(part_records(spark, sf_dir))
    book = pairs.fact_codebook(facts, GRAM_DIMENSION, 0)
    return book.select("role", "value", F.posexplode("words").alias("word", "bits"))


def fact_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot products of all pairs of facts of the first four properties with those of the fifth."""
    book = pairs.fact_codebook(occurrences(part_records(spark, sf_dir)), GRAM_DIMENSION, 0)
    few, many = book.where("role < 5").alias("a"), book.where("role = 5").alias("b")
    joined = few.join(many, F.col("a.role") < F.col("b.role"))
    return joined.select(F.col("a.role").alias("role"), F.col("a.value").alias("value"), F.col("b.value").alias("price"), vectors.packed_dot(F.col("a.words"), F.col("b.words"), GRAM_DIMENSION).alias("dot"))


def record_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared lengths of all bundles from their facts' dot products: D each, and twice each pair of facts."""
    facts = occurrences(part_records(spark, sf_dir))
    rows = facts.join(pairs.fact_codebook(facts, DIMENSION, 0), ["role", "value"])
    grouped = rows.groupBy("id").agg(F.collect_list(F.struct("role", "words")).alias("x")).select("id", F.array_sort("x")["words"].alias("w"))
    cross = [vectors.packed_dot(F.col("w")[i], F.col("w")[j], DIMENSION) for i in range(5) for j in range(i + 1, 5)]
    return grouped.select("id", (5 * DIMENSION + 2 * sum(cross)).cast("long").alias("squared_length"))


def _scored(found: DataFrame, records: DataFrame, dimension: int, seed: int) -> DataFrame:
    """Adds dot and cosine to pairs (i, j, k), from the facts' Gram matrix and the records' fact numbers."""
    spark = records.sparkSession
    facts = pairs.fact_codebook(occurrences(records), dimension, seed).orderBy("role", "value").limit(pairs.MAX_FACTS + 1).collect()
    if len(facts) > pairs.MAX_FACTS:
        raise ValueError(f"more than {pairs.MAX_FACTS} different facts")
    gram, codes = spark.sparkContext.broadcast(pairs.gram_of(facts, dimension)), pairs.coded(records, facts)
    joined = found.join(codes.select(F.col("id").alias("i"), F.col("codes").alias("a")), "i").join(codes.select(F.col("id").alias("j"), F.col("codes").alias("b")), "j")

    def run(batches):
        for batch in batches:
            a, b = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in (3, 4))
            total = lambda x, y: gram.value[x[:, :, None], y[:, None, :]].sum(axis=(1, 2)).astype(np.int64)
            dot = total(a, b)
            cosine = dot / (np.sqrt(total(a, a).astype(np.float64)) * np.sqrt(total(b, b).astype(np.float64)))
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(dot), pa.array(cosine)], ["i", "j", "k", "dot", "cosine"])

    return joined.select("i", "j", "k", "a", "b").mapInArrow(run, "i long, j long, k int, dot long, cosine double")


def pair_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of all pairs of records that share three values or more."""
    records = part_records(spark, sf_dir)
    return _scored(overlap.sharing_pairs(records, 3), records, DIMENSION, 0)


def _trial(spark, sf_dir, seed=0, **options):
    records, n = part_records(spark, sf_dir), _size(spark, sf_dir)
    return pairs.compare(records, nested_sizes(n), DIMENSION, seed, **options), nested_sizes(n)


def false_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, sizes = part_records(spark, sf_dir), nested_sizes(_size(spark, sf_dir))
    return pairs.pairs_of_records(records, sizes, DIMENSION, 0, "q = 1").select("i", "j", "score")


def missed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, sizes = part_records(spark, sf_dir), nested_sizes(_size(spark, sf_dir))
    return pairs.pairs_of_records(records, sizes, DIMENSION, 0, "q < 0", misses=True).select((-F.col("q")).alias("q"), "i", "j", "score")


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose own search returns an unrelated record, with how many."""
    found = _trial(spark, sf_dir, rows=False)[0].where(f"q = {pairs.ENDS + 1}")
    hits = found.groupBy(F.col("i").alias("class")).agg(F.sum("hits").alias("false_hits"))
    return pairs.owned(part_records(spark, sf_dir)).join(hits, "class").select("id", "false_hits")


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for seed in SEEDS:
        found, sizes = _trial(spark, sf_dir, seed, rows=False)
        rows = pairs.trial_rows(found, sizes, DIMENSION, seed)
        out = rows if out is None else out.unionByName(rows)
    return out


def trial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trials(spark, sf_dir).drop("threshold_1", "threshold_2")


def trial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured figures of the trials beside the predicted ones; means and chances rounded, as engines sum and exponentiate differently."""
    found = pairs.summarize(_trials(spark, sf_dir)).drop("threshold_1", "threshold_2", "pairs", "unrelated_pairs")
    for c in ("highest_unrelated_mean", *(f"{x}_chance_{q}" for x in ("dataset", "search") for q in theory.MATCHES)):
        found = found.withColumn(c, F.round(c, 12))
    return found.withColumn("storage_bytes_per_record", F.col("storage_bytes_per_record").cast("long"))


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by shared values (0 to 2) and score bin; every bin has a row."""
    found, _ = _trial(spark, sf_dir, histogram=True, rows=False, matches=False)
    places = found.where("histogram is not null").select(F.posexplode("histogram").alias("at", "n"))
    bins = spark.range(pairs.HISTOGRAM_GROUPS * pairs.BINS).withColumnRenamed("id", "at")
    counts = bins.join(places.groupBy("at").agg(F.sum("n").alias("n")), "at", "left")
    return counts.select(F.expr(f"at div {pairs.BINS}").cast("int").alias("k"), (F.col("at") % pairs.BINS).cast("int").alias("bin"), F.coalesce("n", F.lit(0)).cast("long").alias("pairs"))


def histogram_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figure data: bins with pairs, their centres, and the share of their group."""
    full = score_histogram(spark, sf_dir)
    totals = full.groupBy("k").agg(F.sum("pairs").alias("total"))
    return full.where("pairs > 0").join(totals, "k").select("k", ((2 * F.col("bin") + 1) * 0.00125 - 0.3).alias("score"), "pairs", (F.col("pairs") / F.col("total")).alias("share"))


def role_unbind_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads the brand back from every bundle: unbind its role, take the likeliest value (ties: the lesser)."""
    records = part_records(spark, sf_dir)
    facts = occurrences(records)
    book = pairs.fact_codebook(facts, GRAM_DIMENSION, 0)
    owned = facts.join(book, ["role", "value"]).select("id", "words")
    brands = book.where("role = 2").select("value", F.col("words").alias("probe"))
    # Unbinding and comparing with a value is comparing the bundle with the bound fact.
    scores = owned.join(brands).groupBy("id", "value").agg(F.sum(vectors.packed_dot(F.col("words"), F.col("probe"), GRAM_DIMENSION)).alias("dot"))
    best = scores.groupBy("id").agg(F.min(F.struct((-F.col("dot")).alias("d"), "value")).alias("x"))
    return best.join(records.select("id", "f2"), "id").select("id", F.col("x.value").alias("recovered"), (-F.col("x.d")).alias("dot"), (F.col("x.value") == F.col("f2")).alias("correct"))


def theory_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binomial predictions for the published dimensions from the measured unrelated pairs."""
    rows = [(d, q, theory.threshold(q, d), theory.tail_probability(theory.threshold(q, d), d)) for d in (DIMENSION, 2048, 4096, 8192) for q in theory.MATCHES]
    grid = spark.createDataFrame(rows, "dimension int, q int, threshold double, p double")
    out = grid.join(overlap_by_size(spark, sf_dir).select("n", "unrelated_pairs")).withColumn("expected", F.col("unrelated_pairs") * F.col("p"))
    return out.select("dimension", "q", "n", "threshold", "p", "expected", (2 * F.col("expected") / F.col("n")).alias("expected_in_search"))


def capacity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records at which a search and a dataset reach a one per cent risk, at the overlap share of these cardinalities."""
    cards = part_records(spark, sf_dir).agg(*(F.count_distinct(f).alias(f) for f in FIELDS)).withColumn("share", _product([1 - 1 / F.col(f) for f in FIELDS]))
    rows = [(d, q, theory.tail_probability(theory.threshold(q, d), d)) for d in (2048, 4096, 8192) for q in theory.MATCHES]
    grid = spark.createDataFrame(rows, "dimension int, q int, p double")
    chance = F.col("p") * F.col("share")
    return grid.join(cards.select("share")).select("dimension", "q", F.when(chance == 0, float("inf")).otherwise(0.01 / chance).alias("search_records"), F.when(chance == 0, float("inf")).otherwise(F.sqrt(2 * (0.01 / chance))).alias("dataset_records"))


def _product(factors: list):
    out = factors[0]
    for x in factors[1:]:
        out = out * x
    return out


def overlap_share_theory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected share of pairs with k shared values, were values uniform and independent."""
    cards = part_records(spark, sf_dir).agg(*(F.count_distinct(f).alias(f) for f in FIELDS))
    shares = [F.lit(1.0)]
    for f in FIELDS:
        hit = 1 / F.col(f)
        shares = [(shares[k] * (1 - hit) if k < len(shares) else F.lit(0.0)) + (shares[k - 1] * hit if k else F.lit(0.0)) for k in range(len(shares) + 1)]
    return cards.select(F.posexplode(F.array(*shares)).alias("k", "share"))


def predicted_vs_measured_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figure data, long: expected and measured false pairs by size, q = 1."""
    predicted = theory_predictions(spark, sf_dir).where(f"dimension = {DIMENSION} and q = 1").select("n", F.col("expected").alias("predicted"))
    measured = pairs.summarize(_trials(spark, sf_dir)).select("n", F.col("false_pairs_1_mean").alias("measured"))
    return predicted.join(measured, "n").unpivot("n", ["predicted", "measured"], "kind", "false_pairs")


def threshold_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figure data: threshold lines by dimension, unpivoted."""
    rows = [(d, theory.threshold(1, d), theory.threshold(2, d)) for d in (DIMENSION, 2048, 4096, 8192)]
    return spark.createDataFrame(rows, "dimension int, threshold_1 double, threshold_2 double").unpivot("dimension", ["threshold_1", "threshold_2"], "match", "threshold")


def record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on the record table with their violations: ids contiguous from 0, no null value, each property varied."""
    records = part_records(spark, sf_dir)
    checks = records.agg(
        (F.count("*") - F.count_distinct("id")).alias("repeated_ids"), (F.max("id") - F.min("id") + 1 - F.count("*")).alias("gaps"), F.min("id").alias("first_id"),
        *(F.count_if(F.col(f).isNull()).alias(f"null_{f}") for f in FIELDS), *((F.count_distinct(f) < 2).cast("long").alias(f"unvaried_{f}") for f in FIELDS),
    )
    return checks.unpivot([], checks.columns, "rule", "violations")


QUERIES = {f.__name__: f for f in (
    overlap_distribution, overlap_by_size, duplicate_records, shared_count_pairs, codebook_bits, fact_gram, record_norms, pair_cosine,
    false_matches, missed_matches, search_hits, trial_rows, trial_summary, score_histogram, histogram_nonempty, role_unbind_recovery,
    theory_predictions, capacity_table, overlap_share_theory, predicted_vs_measured_long, threshold_unpivot, record_validation,
)}


# ------------------------------------------------------------------------------------------ SQL

_RECS = """recs AS (
  SELECT p_partkey AS id, p_name AS f1, p_brand AS f2, p_type AS f3, p_size::VARCHAR AS f4,
         (round(p_retailprice * 100)::BIGINT)::VARCHAR AS f5 FROM part)"""
_OCC = "occ AS (" + " UNION ALL ".join(f"SELECT id, {i} AS role, f{i} AS value FROM recs" for i in range(1, 6)) + ")"
_SHARED = " + ".join(f"(a.f{i} = b.f{i})::INT" for i in range(1, 6))
_SIZES = "sizes AS (SELECT DISTINCT greatest(1, count(*) * m // 1000) AS n FROM part, (VALUES (100), (325), (1000)) AS t(m) GROUP BY m)"


def _digests(label: str, dimension: int) -> str:
    return " || ".join(f"sha256({label} || '|{b}')" for b in range(dimension // 256))


def _book(dimension: int, seed: int, name: str = "book") -> str:
    role, value = f"'role|{seed}|' || role", f"'value|{seed}|' || role || '|' || value"
    return f"""{name} AS (
  SELECT role, value, list_transform(range({dimension // 32}), lambda k: xor(('0x' || substr(rh, k * 8 + 1, 8))::BIGINT, ('0x' || substr(vh, k * 8 + 1, 8))::BIGINT)) AS words
  FROM (SELECT role, value, {_digests(role, dimension)} AS rh, {_digests(value, dimension)} AS vh FROM (SELECT DISTINCT role, value FROM occ)))"""


def _dot(a: str, b: str, dimension: int) -> str:
    return f"({dimension} - 2 * list_sum(list_transform(list_zip({a}, {b}), lambda z: bit_count(xor(z[1], z[2]))))::BIGINT)"


def _pairs_sql(seed: int, tag: str = "") -> str:
    """CTEs: gram of facts, each record against each fact, then every pair with its shared count and cosine."""
    return f"""{_book(DIMENSION, seed, f"book{tag}")},
gram{tag} AS MATERIALIZED (SELECT a.role AS ra, a.value AS va, b.role AS rb, b.value AS vb, {_dot("a.words", "b.words", DIMENSION)} AS dot FROM book{tag} a, book{tag} b),
against{tag} AS MATERIALIZED (SELECT o.id, g.rb AS role, g.vb AS value, sum(g.dot)::BIGINT AS dot FROM occ o JOIN gram{tag} g ON o.role = g.ra AND o.value = g.va GROUP BY ALL),
lengths{tag} AS MATERIALIZED (SELECT o.id, sum(x.dot)::BIGINT AS squared FROM occ o JOIN against{tag} x USING (id, role, value) GROUP BY o.id),
pairs{tag} AS MATERIALIZED (
  SELECT a.id AS i, b.id AS j, {_SHARED} AS k, (x1.dot + x2.dot + x3.dot + x4.dot + x5.dot) AS dot,
         (x1.dot + x2.dot + x3.dot + x4.dot + x5.dot) / (sqrt(la.squared::DOUBLE) * sqrt(lb.squared::DOUBLE)) AS score
  FROM recs a JOIN recs b ON a.id < b.id JOIN lengths{tag} la ON la.id = a.id JOIN lengths{tag} lb ON lb.id = b.id
  {" ".join(f"JOIN against{tag} x{i} ON x{i}.id = a.id AND x{i}.role = {i} AND x{i}.value = b.f{i}" for i in range(1, 6))})"""


_T1, _T2 = (repr(theory.threshold(q, DIMENSION)) + "::DOUBLE" for q in theory.MATCHES)


def _trial_sql(seed: int, tag: str) -> str:
    false = lambda t: f"k = 0 AND score >= {t}"
    cols = ", ".join(
        f"count(*) FILTER ({false(t)}) AS false_pairs_{q}, (SELECT count(DISTINCT id) FROM (SELECT unnest([i, j]) AS id FROM pairs{tag} WHERE j < n AND {false(t)})) AS searches_with_false_{q}, "
        f"count(*) FILTER (k >= {q}) AS true_pairs_{q}, count(*) FILTER (k >= {q} AND score < {t}) AS misses_{q}" for q, t in ((1, _T1), (2, _T2)))  # fmt: skip
    return f"SELECT {DIMENSION} AS dimension, {seed} AS seed, n, count(*) AS pairs, count(*) FILTER (k = 0) AS unrelated_pairs, max(score) FILTER (k = 0) AS highest_unrelated, {cols} FROM sizes JOIN pairs{tag} ON j < n GROUP BY n"


_WITH = f"WITH {_RECS}, {_OCC}, {_SIZES}"
_COUNTS = f"counted AS (SELECT n, count(*) AS pairs, count(*) FILTER (k = 0) AS unrelated_pairs, count(*) FILTER (k >= 1) AS true_pairs_1, count(*) FILTER (k >= 2) AS true_pairs_2 FROM sizes JOIN (SELECT a.id AS i, b.id AS j, {_SHARED} AS k FROM recs a JOIN recs b ON a.id < b.id) ON j < n GROUP BY n)"
_BOTH = ", ".join(_pairs_sql(s, f"_{s}") for s in SEEDS)
_TRIALS = " UNION ALL ".join(_trial_sql(s, f"_{s}") for s in SEEDS)
_HISTOGRAM = f"""histogram AS (
  SELECT g.k, b.bin, count(p.i) AS pairs FROM (SELECT unnest(range(3)) AS k) g CROSS JOIN (SELECT unnest(range(400)) AS bin) b
  LEFT JOIN (SELECT i, k, floor((score - (-0.3::DOUBLE)) * {400 / (0.7 - -0.3)!r}::DOUBLE) AS bin FROM pairs) p ON p.k = g.k AND p.bin = b.bin GROUP BY g.k, b.bin)"""
_GRID = ", ".join(f"({d}, {q}, {theory.threshold(q, d)!r}::DOUBLE, {theory.tail_probability(theory.threshold(q, d), d)!r}::DOUBLE)" for d in (DIMENSION, 2048, 4096, 8192) for q in theory.MATCHES)
_PREDICTED = f"grid AS (SELECT * FROM (VALUES {_GRID}) AS t(dimension, q, threshold, p)), predicted AS (SELECT dimension, q, n, threshold, p, unrelated_pairs * p AS expected FROM grid, counted)"
_CARDS = "cards AS (SELECT " + ", ".join(f"count(DISTINCT f{i})::DOUBLE AS c{i}" for i in range(1, 6)) + " FROM recs)"


def _shares_sql() -> str:
    shares = ["1.0::DOUBLE"]
    for i in range(1, 6):
        hit = f"(1 / c{i})"
        shares = [f"({f'({shares[k]}) * (1 - {hit})' if k < len(shares) else '0.0::DOUBLE'} + {f'({shares[k - 1]}) * {hit}' if k else '0.0::DOUBLE'})" for k in range(len(shares) + 1)]
    return " UNION ALL ".join(f"SELECT {k}::INT AS k, {s} AS share FROM cards" for k, s in enumerate(shares))


def _tail(q: int) -> str:
    return f"{theory.tail_probability(theory.threshold(q, DIMENSION), DIMENSION)!r}::DOUBLE"


def _chance(expected: str) -> str:
    """1 - exp(-x), by its series where x is small."""
    return f"round(CASE WHEN {expected} < 1e-5 THEN {expected} - {expected} * {expected} / 2 ELSE 1 - exp(-{expected}) END, 12)"


ORACLE = {
    "overlap_distribution": f"WITH {_RECS} SELECT g.k::INT AS k, count(p.i) AS pairs FROM (SELECT unnest(range(6)) AS k) g LEFT JOIN (SELECT a.id AS i, {_SHARED} AS k FROM recs a JOIN recs b ON a.id < b.id) p ON p.k = g.k GROUP BY g.k",
    "overlap_by_size": f"{_WITH}, {_COUNTS} SELECT * FROM counted",
    "duplicate_records": f"WITH {_RECS} SELECT count(*) AS records, count(DISTINCT (f1, f2, f3, f4, f5)) AS distinct_records, count(*) - count(DISTINCT (f1, f2, f3, f4, f5)) AS duplicates FROM recs",
    "shared_count_pairs": f"WITH {_RECS} SELECT * FROM (SELECT a.id AS i, b.id AS j, ({_SHARED})::INT AS k FROM recs a JOIN recs b ON a.id < b.id) WHERE k >= 2",
    "codebook_bits": f"{_WITH}, {_book(GRAM_DIMENSION, 0)} SELECT role, value, (k - 1)::INT AS word, words[k] AS bits FROM book, (SELECT unnest(range(1, {GRAM_DIMENSION // 32 + 1})) AS k)",
    "fact_gram": f"{_WITH}, {_book(GRAM_DIMENSION, 0)} SELECT a.role, a.value, b.value AS price, {_dot('a.words', 'b.words', GRAM_DIMENSION)} AS dot FROM book a JOIN book b ON a.role < 5 AND b.role = 5",
    "record_norms": f"{_WITH}, {_pairs_sql(0)} SELECT id, squared AS squared_length FROM lengths",
    "pair_cosine": f"{_WITH}, {_pairs_sql(0)} SELECT i, j, k::INT AS k, dot, score AS cosine FROM pairs WHERE k >= 3",
    "false_matches": f"{_WITH}, {_pairs_sql(0)} SELECT i, j, score FROM pairs WHERE k = 0 AND score >= {_T1}",
    "missed_matches": f"{_WITH}, {_pairs_sql(0)} SELECT 1 AS q, i, j, score FROM pairs WHERE k >= 1 AND score < {_T1} UNION ALL SELECT 2, i, j, score FROM pairs WHERE k >= 2 AND score < {_T2}",
    "search_hits": f"{_WITH}, {_pairs_sql(0)} SELECT id, count(*) AS false_hits FROM (SELECT unnest([i, j]) AS id FROM pairs WHERE k = 0 AND score >= {_T1}) GROUP BY id",
    "trial_rows": f"{_WITH}, {_BOTH} {_TRIALS}",
    "trial_summary": f"{_WITH}, {_BOTH}, trials AS ({_TRIALS}) SELECT dimension, n, count(*) AS trials, round(avg(highest_unrelated), 12) AS highest_unrelated_mean, max(highest_unrelated) AS highest_unrelated_max, dimension::BIGINT AS storage_bytes_per_record, " + ", ".join(f"sum(false_pairs_{q})::DOUBLE / count(*) AS false_pairs_{q}_mean, count(*) FILTER (false_pairs_{q} > 0)::DOUBLE / count(*) AS dataset_with_false_{q}, sum(searches_with_false_{q})::DOUBLE / (count(*) * n) AS search_with_false_{q}, sum(misses_{q})::DOUBLE / sum(true_pairs_{q})::DOUBLE AS miss_rate_{q}, {_tail(q)} AS p_{q}, max(unrelated_pairs) * {_tail(q)} AS expected_false_pairs_{q}, {_chance(f'(max(unrelated_pairs) * {_tail(q)})')} AS dataset_chance_{q}, {_chance(f'(2 * (max(unrelated_pairs) * {_tail(q)}) / n)')} AS search_chance_{q}" for q in theory.MATCHES) + " FROM trials GROUP BY dimension, n",
    "score_histogram": f"{_WITH}, {_pairs_sql(0)}, {_HISTOGRAM} SELECT k::INT AS k, bin::INT AS bin, pairs FROM histogram",
    "histogram_nonempty": f"{_WITH}, {_pairs_sql(0)}, {_HISTOGRAM} SELECT k::INT AS k, (2 * bin + 1) * 0.00125::DOUBLE - 0.3::DOUBLE AS score, pairs, pairs::DOUBLE / total AS share FROM (SELECT *, sum(pairs) OVER (PARTITION BY k) AS total FROM histogram) WHERE pairs > 0",
    "role_unbind_recovery": f"{_WITH}, {_book(GRAM_DIMENSION, 0)}, scores AS (SELECT o.id, b.value, sum({_dot('f.words', 'b.words', GRAM_DIMENSION)})::BIGINT AS dot FROM occ o JOIN book f USING (role, value) CROSS JOIN book b WHERE b.role = 2 GROUP BY o.id, b.value), best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dot DESC, value) AS r FROM scores) SELECT b.id, b.value AS recovered, b.dot, b.value = recs.f2 AS correct FROM best b JOIN recs USING (id) WHERE r = 1",
    "theory_predictions": f"{_WITH}, {_COUNTS}, {_PREDICTED} SELECT dimension, q, n, threshold, p, expected, 2 * expected / n AS expected_in_search FROM predicted",
    "capacity_table": f"{_WITH}, {_CARDS}, grid AS (SELECT * FROM (VALUES " + ", ".join(f"({d}, {q}, {theory.tail_probability(theory.threshold(q, d), d)!r}::DOUBLE)" for d in (2048, 4096, 8192) for q in theory.MATCHES) + ") AS t(dimension, q, p)), c AS (SELECT dimension, q, p * (" + " * ".join(f"(1 - 1 / c{i})" for i in range(1, 6)) + ") AS chance FROM grid, cards) SELECT dimension, q, CASE WHEN chance = 0 THEN 'inf'::DOUBLE ELSE 0.01::DOUBLE / chance END AS search_records, CASE WHEN chance = 0 THEN 'inf'::DOUBLE ELSE sqrt(2 * (0.01::DOUBLE / chance)) END AS dataset_records FROM c",
    "overlap_share_theory": f"{_WITH}, {_CARDS} {_shares_sql()}",
    "predicted_vs_measured_long": f"{_WITH}, {_COUNTS}, {_PREDICTED}, {_BOTH}, trials AS ({_TRIALS}) SELECT n, 'predicted' AS kind, expected AS false_pairs FROM predicted WHERE dimension = {DIMENSION} AND q = 1 UNION ALL SELECT n, 'measured', sum(false_pairs_1)::DOUBLE / count(*) FROM trials GROUP BY n",
    "threshold_unpivot": " UNION ALL ".join(f"SELECT {d} AS dimension, 'threshold_{q}' AS match, {theory.threshold(q, d)!r}::DOUBLE AS threshold" for d in (DIMENSION, 2048, 4096, 8192) for q in theory.MATCHES),
    "record_validation": f"WITH {_RECS}, c AS (SELECT count(*) - count(DISTINCT id) AS repeated_ids, max(id) - min(id) + 1 - count(*) AS gaps, min(id) AS first_id, " + ", ".join(f"count(*) FILTER (f{i} IS NULL) AS null_f{i}, (count(DISTINCT f{i}) < 2)::BIGINT AS unvaried_f{i}" for i in range(1, 6)) + " FROM recs) UNPIVOT c ON COLUMNS(*) INTO NAME rule VALUE violations",
}
