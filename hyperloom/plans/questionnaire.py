"""Queries of the readout, geometry and perturbation studies, over `embeddings` read as questionnaires."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hyperloom.functions import vectors
from hyperloom.operators import geometry, readout
from hyperloom.sources.answers import ITEMS, WIDTHS, answer_arrays, answers, items

SEEDS = (11, 23)
D = readout.DIMENSION
SHARES = {"near": 0.2, "far": 0.6}
VARIANTS = 2
PERTURB = "perturb-1"


def scored_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir)


def response_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on the answers with their violations."""
    found = answers(spark, sf_dir)
    again = vectors.reverse_scored(F.col("scored"), F.col("key"))
    counts = found.agg(
        (F.count("*") - F.count_distinct("vid", "pos")).alias("repeated"), (F.count_distinct("vid") * ITEMS - F.count_distinct("vid", "pos")).alias("missing"),
        F.count_if(~F.col("raw").between(1, 5)).alias("out_of_range"), F.count_if(again != F.col("raw")).alias("not_involution"),
    )
    return counts.unpivot([], counts.columns, "rule", "violations")


def factor_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_item = items(spark).groupBy("factor").agg(F.count("*").alias("items"), F.count_if(F.col("key") == "+").alias("forward"))
    means = answers(spark, sf_dir).groupBy("factor").agg((F.sum("scored") / F.count("*")).alias("mean_scored"))
    return per_item.join(means, "factor")


def _per_seed(build) -> DataFrame:
    out = None
    for seed in SEEDS:
        rows = build(seed).select(F.lit(seed).alias("seed"), "*")
        out = rows if out is None else out.union(rows)
    return out


def level_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(seed):
        book = readout.levels(spark, seed)
        pairs = book.alias("a").join(book.alias("b"), F.col("a.level") < F.col("b.level"))
        dot = vectors.packed_dot(F.col("a.words"), F.col("b.words"), D)
        return pairs.select(F.col("a.level").alias("level_a"), F.col("b.level").alias("level_b"), (dot / D).alias("cosine"))

    return _per_seed(build)


def key_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Off-diagonal key cosines, the cosines of all pairs of levels, and whether neighbouring levels are always closer than levels three apart."""

    def build(seed):
        book = readout.keys(spark, seed)
        pairs = book.alias("a").join(book.alias("b"), F.col("a.pos") < F.col("b.pos"))
        dot = F.abs(vectors.packed_dot(F.col("a.words"), F.col("b.words"), D))
        return pairs.agg((F.sum(dot) / (F.count("*") * D)).alias("mean_absolute"), (F.max(dot) / D).alias("max_absolute"))

    between = level_cosines(spark, sf_dir)
    gap = F.col("level_b") - F.col("level_a")
    pick = lambda a, b: F.max(F.when((F.col("level_a") == a) & (F.col("level_b") == b), F.col("cosine"))).alias(f"level_{a}_{b}_cosine")
    ordered = F.min(F.when(gap == 1, F.col("cosine"))) > F.max(F.when(gap == 3, F.col("cosine")))
    columns = between.groupBy("seed").agg(ordered.alias("levels_ordered"), *(pick(a, b) for a in range(1, 6) for b in range(a + 1, 6)))
    return _per_seed(build).join(columns, "seed")


def _bundles(spark, sf_dir, seeds=SEEDS) -> DataFrame:
    return readout.bundles(answer_arrays(spark, sf_dir), seeds)


def profile_bundles_by_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _bundles(spark, sf_dir)
    total = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x)
    return made.select("seed", "vid", "width", vectors.dot(F.col("vector"), F.col("vector")).alias("squared_length"), total.alias("total"), F.array_min("vector").cast("int").alias("least"), F.array_max("vector").cast("int").alias("most"))


def _cleaned(spark, sf_dir) -> DataFrame:
    return readout.cleaned(readout.readouts(answer_arrays(spark, sf_dir), SEEDS))


def item_readouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _cleaned(spark, sf_dir)
    return found.select("seed", "width", "vid", "pos", "true_level", "predicted", "best", "second", (F.col("predicted") == F.col("true_level")).alias("correct"), F.abs(F.col("predicted") - F.col("true_level")).alias("ordinal_error"))


def recovery_by_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _cleaned(spark, sf_dir)
    error = F.abs(F.col("predicted") - F.col("true_level"))
    margin = (F.col("best") - F.col("second")) / (F.sqrt(F.col("squared").cast("double")) * F.lit(float(D) ** 0.5))
    return found.groupBy("seed", "width").agg(
        (F.count_if(error == 0) / F.count("*")).alias("exact_accuracy"), (F.sum(error) / F.count("*")).alias("mean_absolute_error"), (F.count_if(error <= 1) / F.count("*")).alias("within_one"),
        F.round(F.avg(margin), 9).alias("mean_winner_margin"), F.count("*").alias("queries"),
    )


def recovery_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figure data: exact accuracy over seeds, by width."""
    return recovery_by_seed(spark, sf_dir).groupBy("width").agg(F.round(F.avg("exact_accuracy"), 12).alias("mean"), F.min("exact_accuracy").alias("least"), F.max("exact_accuracy").alias("most"))


def cleanup_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest levels of the first, middle and last item of every full profile: all five, by cosine distance, then level."""
    found = readout.readouts(answer_arrays(spark, sf_dir), SEEDS[:1], widths=(ITEMS,)).where(F.col("pos").isin(1, 1 + ITEMS // 2, ITEMS))
    ordered = F.array_sort(F.transform("dots", lambda x, i: F.struct((-x).alias("d"), (i + 1).cast("int").alias("level"))))
    rows = found.select("vid", "pos", "squared", F.posexplode(ordered).alias("rank", "x"))
    cosine = -F.col("x.d") / (F.sqrt(F.col("squared").cast("double")) * F.lit(float(D) ** 0.5))
    return rows.select("vid", "pos", (F.col("rank") + 1).alias("rank"), "x.level", (1 - cosine).alias("distance"))


def profile_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.pair_rows(spark, sf_dir, SEEDS[:1], (ITEMS,), geometry.PAIR)


def geometry_by_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.agreement(answer_arrays(spark, sf_dir), SEEDS, WIDTHS).withColumn("spearman", F.round("spearman", 12))


def neighbor_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.neighbours(answer_arrays(spark, sf_dir), SEEDS[:1], WIDTHS, references=("bundle",)).select("width", "a", "rank", "b")


def _perturbed(spark, sf_dir) -> DataFrame:
    found = readout.perturbed(readout.changed(answer_arrays(spark, sf_dir), PERTURB, SHARES, VARIANTS), SEEDS[0])
    cosine = vectors.cosine(F.col("dot"), F.col("base_squared"), F.col("new_squared"))
    return found.withColumn("bundle_cosine", cosine).withColumn("ideal_cosine", F.col("ideal_dot") / (F.col("width") * D))


def perturbation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _perturbed(spark, sf_dir).select("width", "condition", "variant", "vid", "changed", "dot", "new_squared", "bundle_cosine", "ideal_cosine")


def perturbation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by profile first, then over profiles."""
    by_profile = _perturbed(spark, sf_dir).groupBy("width", "condition", "vid").agg(F.avg("bundle_cosine").alias("b"), F.avg("ideal_cosine").alias("o"), F.count("*").alias("n"))
    return by_profile.groupBy("width", "condition").agg(F.round(F.avg("b"), 9).alias("bundle_cosine"), F.round(F.avg("o"), 13).alias("ideal_cosine"), F.sum("n").alias("pairs"), F.count("*").alias("profile_units"))


def perturbation_quantile_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figure data: median, and the nearest 5 and 95 per cent quantiles, of near cosines by width."""
    near = _perturbed(spark, sf_dir).where("condition = 'near'")
    ordered = Window.partitionBy("width").orderBy("bundle_cosine")
    ranked = near.select("width", "bundle_cosine", (F.row_number().over(ordered) - 1).alias("at"), F.count("*").over(Window.partitionBy("width")).alias("n"))
    pick = lambda q: F.max(F.when(F.col("at") == F.round((F.col("n") - 1) * q), F.col("bundle_cosine")))
    low = F.max(F.when(F.col("at") == F.floor((F.col("n") - 1) / 2), F.col("bundle_cosine")))
    high = F.max(F.when(F.col("at") == F.ceil((F.col("n") - 1) / 2), F.col("bundle_cosine")))
    return ranked.groupBy("width").agg(((low + high) / 2).alias("median"), pick(0.05).alias("q05"), pick(0.95).alias("q95"))


def distinct_profile_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different profiles by width, their least total difference, and how many are as near as a near change."""
    return geometry.context(answer_arrays(spark, sf_dir), WIDTHS)


QUERIES = {f.__name__: f for f in (
    scored_responses, response_integrity, factor_balance, level_cosines, key_diagnostics, profile_bundles_by_width, item_readouts, recovery_by_seed,
    recovery_band, cleanup_topk, profile_pairs, geometry_by_seed, neighbor_top3, perturbation_pairs, perturbation_summary, perturbation_quantile_band, distinct_profile_context,
)}


# ------------------------------------------------------------------------------------------ SQL

_ANS = """base AS MATERIALIZED (
  SELECT vid, pos, (pos - 1) % 5 + 1 AS factor, CASE WHEN pos % 2 = 1 THEN '+' ELSE '-' END AS key, raw FROM (
    SELECT vec_id AS vid, pos, least(5, greatest(1, floor((embedding[pos]::DOUBLE + 0.3::DOUBLE) / 0.12::DOUBLE)::INT + 1)) AS raw
    FROM embeddings, (SELECT unnest(range(1, 51))::INT AS pos))),
ans AS MATERIALIZED (SELECT *, CASE WHEN key = '-' THEN 6 - raw ELSE raw END AS scored FROM base)"""
_WIDTHS = "widths AS (SELECT * FROM (VALUES (5), (10), (20), (30), (40), (50)) AS t(width))"


def _bits(label: str) -> str:
    """Coordinates (list of 256 bits) of a label's digest."""
    h = f"sha256({label} || '|0')"
    return f"list_transform(range({D}), lambda d: (('0x' || substr({h}, (d // 32) * 8 + 1, 8))::BIGINT >> (31 - d % 32)) & 1)"


def _facts_sql(seeds) -> str:
    seed_rows = ", ".join(f"({s})" for s in seeds)
    return f"""seeds AS (SELECT * FROM (VALUES {seed_rows}) AS t(seed)),
ends AS MATERIALIZED (SELECT seed, {_bits("'first|' || seed")} AS e0, {_bits("'second|' || seed")} AS e1, {_bits("'high|' || seed")} AS hi, {_bits("'low|' || seed")} AS lo FROM seeds),
levels AS MATERIALIZED (SELECT seed, level::INT AS level, list_transform(range({D}), lambda d: 1 - 2 * (CASE WHEN 2 * hi[d + 1] + lo[d + 1] < 5 - level THEN e0[d + 1] ELSE e1[d + 1] END)) AS v FROM ends, (SELECT unnest(range(1, 6)) AS level)),
keys AS MATERIALIZED (SELECT seed, pos::INT AS pos, list_transform({_bits("'item|' || seed || '|' || pos")}, lambda b: 1 - 2 * b) AS v FROM seeds, (SELECT unnest(range(1, 51)) AS pos)),
facts AS MATERIALIZED (SELECT seed, pos, level, list_transform(list_zip(k.v, l.v), lambda z: z[1] * z[2]) AS v FROM keys k JOIN levels l USING (seed))"""


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))::BIGINT"
_FAST = "list_dot_product({0}, {1})::BIGINT"
_BUNDLES = f"""coords AS (
  SELECT a.seed, s.vid, a.pos, unnest(range({D})) AS d, unnest(a.v) AS x FROM ans s JOIN facts a ON a.pos = s.pos AND a.level = s.scored),
summed AS (SELECT seed, vid, width, d, sum(x)::BIGINT AS x FROM coords JOIN widths ON pos <= width GROUP BY seed, vid, width, d),
bundles AS MATERIALIZED (SELECT seed, vid, width, list(x::DOUBLE ORDER BY d) AS v, sum(x * x)::BIGINT AS squared FROM summed GROUP BY seed, vid, width)"""
_READOUTS = f"""flat AS MATERIALIZED (SELECT seed, pos, level, list_transform(v, lambda x: x::DOUBLE) AS v FROM facts),
dots AS MATERIALIZED (SELECT b.seed, b.width, b.vid, f.pos, f.level, b.squared, {_FAST.format("b.v", "f.v")} AS dot FROM bundles b JOIN flat f ON f.seed = b.seed AND f.pos <= b.width),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seed, width, vid, pos ORDER BY dot DESC, level) AS r FROM dots),
clean AS MATERIALIZED (
  SELECT seed, width, vid, pos, any_value(squared) AS squared, max(level) FILTER (r = 1) AS predicted, max(dot) FILTER (r = 1) AS best, max(dot) FILTER (r = 2) AS second FROM ranked GROUP BY seed, width, vid, pos),
outs AS MATERIALIZED (SELECT c.*, s.scored AS true_level FROM clean c JOIN ans s USING (vid, pos))"""
_RECOVERY = "SELECT seed, width, count(*) FILTER (predicted = true_level)::DOUBLE / count(*) AS exact_accuracy, sum(abs(predicted - true_level))::DOUBLE / count(*) AS mean_absolute_error, count(*) FILTER (abs(predicted - true_level) <= 1)::DOUBLE / count(*) AS within_one, " + f"round(avg((best - second) / (sqrt(squared::DOUBLE) * {float(D) ** 0.5!r}::DOUBLE)), 9) AS mean_winner_margin, count(*) AS queries FROM outs GROUP BY seed, width"
_PAIRS = f"""gram AS MATERIALIZED (SELECT a.seed, a.level AS la, b.level AS lb, {_DOT.format("a.v", "b.v")} AS g FROM levels a JOIN levels b USING (seed)),
levelled AS MATERIALIZED (
  SELECT g.seed, x.vid AS a, y.vid AS b, w.width, sum(abs(x.scored - y.scored))::BIGINT AS difference_sum, sum(g.g)::BIGINT AS ideal_dot
  FROM ans x JOIN ans y ON x.pos = y.pos AND x.vid < y.vid JOIN gram g ON g.la = x.scored AND g.lb = y.scored JOIN pair_widths w ON x.pos <= w.width GROUP BY ALL),
pairs AS MATERIALIZED (
  SELECT x.seed, x.width, x.vid AS a, y.vid AS b, {_FAST.format("x.v", "y.v")} AS dot, {_FAST.format("x.v", "y.v")} / (sqrt(x.squared::DOUBLE) * sqrt(y.squared::DOUBLE)) AS cosine, l.difference_sum, l.ideal_dot
  FROM bundles x JOIN bundles y ON x.seed = y.seed AND x.width = y.width AND x.vid < y.vid JOIN levelled l ON l.seed = x.seed AND l.width = x.width AND l.a = x.vid AND l.b = y.vid)"""
_CHANGED = f"""design AS (SELECT width, condition, variant, CASE condition WHEN 'near' THEN round_even(width * 0.2, 0) ELSE round_even(width * 0.6, 0) END::INT AS moves FROM widths, (VALUES ('near'), ('far')) AS c(condition), (VALUES (0), (1)) AS v(variant)),
picked AS (
  SELECT *, row_number() OVER (PARTITION BY width, condition, variant, vid ORDER BY h) AS r FROM (
    SELECT width, condition, variant, vid, pos, raw, key, scored, moves, sha256('{PERTURB}|' || vid || '|' || width || '|' || condition || '|' || variant || '|' || pos) AS h FROM ans JOIN design ON pos <= width)),
changes AS MATERIALIZED (
  SELECT width, condition, variant, vid, pos, scored AS old, CASE WHEN key = '-' THEN 6 - (raw + step) ELSE raw + step END AS new FROM (
    SELECT *, CASE WHEN raw = 1 THEN 1 WHEN raw = 5 THEN -1 WHEN ('0x' || substr(h, 64, 1))::INT % 2 = 0 THEN 1 ELSE -1 END AS step FROM picked WHERE r <= moves)),
gram AS MATERIALIZED (SELECT a.level AS la, b.level AS lb, {_DOT.format("a.v", "b.v")} AS g FROM levels a JOIN levels b USING (seed)),
moved AS (
  SELECT width, condition, variant, vid, d, sum(x)::BIGINT AS x FROM (
    SELECT c.width, c.condition, c.variant, c.vid, unnest(range({D})) AS d, unnest(list_transform(list_zip(n.v, o.v), lambda z: z[1] - z[2])) AS x
    FROM changes c JOIN facts n ON n.pos = c.pos AND n.level = c.new JOIN facts o ON o.pos = c.pos AND o.level = c.old) GROUP BY ALL),
listed AS (SELECT width, condition, variant, vid, list(x::DOUBLE ORDER BY d) AS v FROM moved GROUP BY ALL),
ideal AS (SELECT width, condition, variant, vid, count(*) AS changed, ((width - count(*)) * {D} + sum(g.g))::BIGINT AS ideal_dot FROM changes c JOIN gram g ON g.la = c.old AND g.lb = c.new GROUP BY width, condition, variant, vid),
perturbed AS MATERIALIZED (
  SELECT width, condition, variant, vid, changed, dot, new_squared, dot / (sqrt(squared::DOUBLE) * sqrt(new_squared::DOUBLE)) AS bundle_cosine, ideal_dot / (width * {D})::DOUBLE AS ideal_cosine FROM (
    SELECT l.width, l.condition, l.variant, l.vid, i.changed, i.ideal_dot, b.squared, b.squared + {_FAST.format("b.v", "l.v")} AS dot, b.squared + 2 * {_FAST.format("b.v", "l.v")} + {_FAST.format("l.v", "l.v")} AS new_squared
    FROM listed l JOIN ideal i USING (width, condition, variant, vid) JOIN bundles b USING (width, vid)))"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


_ALL = (_ANS, _WIDTHS, _facts_sql(SEEDS), _BUNDLES)
_ONE = (_ANS, _WIDTHS, _facts_sql(SEEDS[:1]), _BUNDLES)
_FULL = "pair_widths AS (SELECT 50 AS width)"
_EVERY = "pair_widths AS (SELECT * FROM widths)"

ORACLE = {
    "scored_responses": _with(_ANS) + "SELECT vid, pos, factor, key, raw, scored FROM ans",
    "response_integrity": _with(_ANS) + ", c AS (SELECT count(*) - count(DISTINCT (vid, pos)) AS repeated, count(DISTINCT vid) * 50 - count(DISTINCT (vid, pos)) AS missing, count(*) FILTER (raw NOT BETWEEN 1 AND 5) AS out_of_range, count(*) FILTER (CASE WHEN key = '-' THEN 6 - scored ELSE scored END <> raw) AS not_involution FROM ans) UNPIVOT c ON COLUMNS(*) INTO NAME rule VALUE violations",
    "factor_balance": _with(_ANS) + "SELECT factor, count(DISTINCT pos) AS items, count(DISTINCT pos) FILTER (key = '+') AS forward, sum(scored)::DOUBLE / count(*) AS mean_scored FROM ans GROUP BY factor",
    "level_cosines": _with(_facts_sql(SEEDS)) + f"SELECT seed, a.level AS level_a, b.level AS level_b, {_DOT.format('a.v', 'b.v')} / {D}::DOUBLE AS cosine FROM levels a JOIN levels b USING (seed) WHERE a.level < b.level",
    "key_diagnostics": _with(_facts_sql(SEEDS)) + f", k AS (SELECT seed, abs({_DOT.format('a.v', 'b.v')}) AS dot FROM keys a JOIN keys b USING (seed) WHERE a.pos < b.pos), l AS (SELECT seed, a.level AS la, b.level AS lb, b.level - a.level AS apart, {_DOT.format('a.v', 'b.v')} AS dot FROM levels a JOIN levels b USING (seed) WHERE a.level < b.level) SELECT * FROM (SELECT seed, sum(dot)::DOUBLE / (count(*) * {D}) AS mean_absolute, max(dot)::DOUBLE / {D} AS max_absolute FROM k GROUP BY seed) JOIN (SELECT seed, min(dot) FILTER (apart = 1) > max(dot) FILTER (apart = 3) AS levels_ordered, " + ", ".join(f"max(dot) FILTER (la = {a} AND lb = {b})::DOUBLE / {D} AS level_{a}_{b}_cosine" for a in range(1, 6) for b in range(a + 1, 6)) + " FROM l GROUP BY seed) USING (seed)",
    "profile_bundles_by_width": _with(*_ALL[:3], _BUNDLES) + "SELECT seed, vid, width, sum(x * x)::BIGINT AS squared_length, sum(x)::BIGINT AS total, min(x)::INT AS least, max(x)::INT AS most FROM summed GROUP BY seed, vid, width",
    "item_readouts": _with(*_ALL, _READOUTS) + "SELECT seed, width, vid, pos, true_level, predicted, best, second, predicted = true_level AS correct, abs(predicted - true_level) AS ordinal_error FROM outs",
    "recovery_by_seed": _with(*_ALL, _READOUTS) + _RECOVERY,
    "recovery_band": _with(*_ALL, _READOUTS) + f", r AS ({_RECOVERY}) SELECT width, round(avg(exact_accuracy), 12) AS mean, min(exact_accuracy) AS least, max(exact_accuracy) AS most FROM r GROUP BY width",
    "cleanup_topk": _with(*_ONE, _READOUTS) + f"SELECT vid, pos, r::INT AS rank, level, 1 - dot / (sqrt(squared::DOUBLE) * {float(D) ** 0.5!r}::DOUBLE) AS distance FROM ranked WHERE width = 50 AND pos IN (1, 26, 50)",
    "profile_pairs": _with(*_ONE, _FULL, _PAIRS) + "SELECT a, b, dot, cosine, difference_sum, ideal_dot FROM pairs WHERE width = 50",
    "geometry_by_seed": _with(*_ALL, _EVERY, _PAIRS) + """, truths AS (
  SELECT seed, width, a, b, cosine, reference, truth FROM pairs, LATERAL (VALUES ('difference', -difference_sum), ('codebook', ideal_dot)) AS t(reference, truth)),
halves AS (SELECT *, 2 * rank() OVER (PARTITION BY seed, width, reference ORDER BY cosine) + count(*) OVER (PARTITION BY seed, width, reference, cosine) - 1 AS rx, 2 * rank() OVER (PARTITION BY seed, width, reference ORDER BY truth) + count(*) OVER (PARTITION BY seed, width, reference, truth) - 1 AS ry FROM truths),
sums AS (SELECT seed, width, reference, count(*)::HUGEINT AS n, sum(rx)::HUGEINT AS x, sum(ry)::HUGEINT AS y, sum(rx * rx)::HUGEINT AS xx, sum(ry * ry)::HUGEINT AS yy, sum(rx * ry)::HUGEINT AS xy FROM halves GROUP BY ALL),
mirrored AS (SELECT seed, width, reference, a, b, cosine, truth FROM truths UNION ALL SELECT seed, width, reference, b, a, cosine, truth FROM truths),
near AS (SELECT seed, width, reference, a, b, row_number() OVER (PARTITION BY seed, width, reference, a ORDER BY cosine DESC, b) AS rc, row_number() OVER (PARTITION BY seed, width, reference, a ORDER BY truth DESC, b) AS rt FROM mirrored),
agreed AS (SELECT seed, width, reference, count(*) FILTER (rc = 1 AND rt = 1)::DOUBLE / count(DISTINCT a) AS nearest_neighbor_agreement, count(*) FILTER (rc <= 3 AND rt <= 3)::DOUBLE / (3 * count(DISTINCT a)) AS top3_neighbor_overlap FROM near GROUP BY ALL)
SELECT seed, width, reference, round((n * xy - x * y)::DOUBLE / (sqrt((n * xx - x * x)::DOUBLE) * sqrt((n * yy - y * y)::DOUBLE)), 12) AS spearman, nearest_neighbor_agreement, top3_neighbor_overlap FROM sums JOIN agreed USING (seed, width, reference)""",
    "neighbor_top3": _with(*_ONE, _EVERY, _PAIRS) + ", mirrored AS (SELECT width, a, b, cosine FROM pairs UNION ALL SELECT width, b, a, cosine FROM pairs) SELECT width, a, r::INT AS rank, b FROM (SELECT *, row_number() OVER (PARTITION BY width, a ORDER BY cosine DESC, b) AS r FROM mirrored) WHERE r <= 3",
    "perturbation_pairs": _with(*_ONE, _CHANGED) + "SELECT * FROM perturbed",
    "perturbation_summary": _with(*_ONE, _CHANGED) + "SELECT width, condition, round(avg(b), 9) AS bundle_cosine, round(avg(o), 13) AS ideal_cosine, sum(n)::BIGINT AS pairs, count(*) AS profile_units FROM (SELECT width, condition, vid, avg(bundle_cosine) AS b, avg(ideal_cosine) AS o, count(*) AS n FROM perturbed GROUP BY width, condition, vid) GROUP BY width, condition",
    "perturbation_quantile_band": _with(*_ONE, _CHANGED) + "SELECT width, (max(c) FILTER (place = floor((n - 1) / 2.0)) + max(c) FILTER (place = ceil((n - 1) / 2.0))) / 2 AS median, max(c) FILTER (place = round((n - 1) * 0.05::DOUBLE)) AS q05, max(c) FILTER (place = round((n - 1) * 0.95::DOUBLE)) AS q95 FROM (SELECT width, bundle_cosine AS c, row_number() OVER (PARTITION BY width ORDER BY bundle_cosine) - 1 AS place, count(*) OVER (PARTITION BY width) AS n FROM perturbed WHERE condition = 'near') GROUP BY width",
    "distinct_profile_context": _with(*_ONE, _EVERY, _PAIRS) + "SELECT width, count(*) FILTER (difference_sum > 0) AS distinct_pairs, min(difference_sum) AS smallest_difference, count(*) FILTER (difference_sum * 5 <= width) AS naturally_near_pairs FROM pairs GROUP BY width",
}
