"""Integrity rules as violation counts: a table is sound if every count is 0.

Each function returns (rule, violations) rows; `require` raises for those that fail.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.functions.vectors import reverse_scored


def counted(table: DataFrame, **rules: Column) -> DataFrame:
    """Violations of several rules in one pass: each rule is an aggregate, or a condition whose true rows count."""
    row = table.agg(*(r.cast("long").alias(name) for name, r in rules.items()))
    return row.unpivot([], list(rules), "rule", "violations")


def require(*found: DataFrame) -> None:
    """Raises ValueError that names the violated rules."""
    bad = reduce(DataFrame.unionByName, found).where("violations <> 0 or violations is null").collect()
    if bad:
        raise ValueError("violated: " + ", ".join(f"{x.rule} ({x.violations})" for x in sorted(bad)))


def contiguous(table: DataFrame, key: str) -> DataFrame:
    """Ids are 0 to N - 1, each once."""
    n = F.count("*")
    return counted(table, repeated=n - F.count_distinct(key), not_from_zero=F.coalesce(F.min(key), F.lit(0)), gaps=F.coalesce(F.max(key) + 1, F.lit(0)) - n)


def spanning(table: DataFrame, cardinalities: dict[str, int]) -> DataFrame:
    """Every code column has 0 to c - 1 as its ends and nothing outside."""
    return counted(table, **{f"{c}_span": ((F.min(c) != 0) | (F.max(c) != n - 1)).cast("int") for c, n in cardinalities.items()})


def duplicates(table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that repeat another row's columns."""
    return counted(table, duplicates=F.count("*") - F.count_distinct(F.struct(*columns)))


def items(table: DataFrame, count: int = 50, factors: int = 5) -> DataFrame:
    """Item tables: number, unique ids in position order, factors in turn, keys plus or minus, ten items a factor."""
    label = F.format_string("Q%02d", F.col("position").cast("int"))
    per_factor = [F.abs(F.count_if(F.col("factor_id") == f) - count // factors) for f in range(1, factors + 1)]
    return counted(
        table, wrong_count=F.abs(F.count("*") - count), repeated_ids=F.count("*") - F.count_distinct("item_id"), out_of_order=F.count_if(F.col("item_id") != label),
        wrong_factor=F.count_if(F.col("factor_id") != (F.col("position") - 1) % factors + 1), wrong_key=F.count_if(~F.col("key_direction").isin("+", "-") | F.col("key_direction").isNull()),
        one_sided_keys=2 - F.count_distinct("key_direction"), unbalanced_factors=sum(per_factor),
    )


def named_items(table: DataFrame, names: list[str]) -> DataFrame:
    """Names and fixed keys of an item table: factor names in turn, Q19 plus, Q49 minus, no blank statement (where there are any)."""
    name = F.element_at(F.lit(names), F.col("factor_id").cast("int"))
    rules = {"wrong_factor_name": F.count_if(F.col("factor_name").isNull() | (F.col("factor_name") != name)), "q19_not_plus": 1 - F.count_if((F.col("item_id") == "Q19") & (F.col("key_direction") == "+")), "q49_not_minus": 1 - F.count_if((F.col("item_id") == "Q49") & (F.col("key_direction") == "-"))}
    if "statement" in table.columns:
        rules["blank_statements"] = F.count_if(F.col("statement").isNull() | (F.trim("statement") == ""))
    return counted(table, **rules)


def profile_count(table: DataFrame, count: int, profile: str = "profile_id") -> DataFrame:
    """As many different profiles as there should be."""
    return counted(table, wrong_profile_count=F.abs(F.count_distinct(profile) - count))


def agreed(table: DataFrame) -> DataFrame:
    """Settings (name, wanted, found) that differ."""
    return counted(table, unequal_settings=F.count_if(~F.col("wanted").eqNullSafe(F.col("found"))))


def responses(table: DataFrame, profiles: DataFrame, item_table: DataFrame, profile: str = "profile_id", item: str = "item_id", raw: str = "raw_answer") -> DataFrame:
    """Exactly one response for each profile and item, none besides, all within 1 to 5."""
    own = counted(table, repeated=F.count("*") - F.count_distinct(profile, item), out_of_range=F.count_if(~F.col(raw).between(1, 5) | F.col(raw).isNull()))
    wanted = profiles.select(profile).distinct().crossJoin(item_table.select(item).distinct())
    missing = wanted.join(table, [profile, item], "left_anti").agg(F.lit("missing").alias("rule"), F.count("*").alias("violations"))
    extra = table.join(wanted, [profile, item], "left_anti").agg(F.lit("unknown").alias("rule"), F.count("*").alias("violations"))
    return own.union(missing).union(extra)


def reversible(table: DataFrame, raw: str = "raw", key: str = "key") -> DataFrame:
    """Reverse scoring is its own inverse."""
    once = reverse_scored(F.col(raw), F.col(key))
    return counted(table, not_involution=F.count_if(reverse_scored(once, F.col(key)) != F.col(raw)))


def vector_shapes(table: DataFrame, dimension: int, vector: str = "vector") -> DataFrame:
    return counted(table, wrong_length=F.count_if((F.size(vector) != dimension) | F.col(vector).isNull()))


def distinct_vectors(table: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """No two rows of the same keys store the same vector."""
    repeated = table.groupBy(*keys, F.xxhash64(vector).alias("h"), vector).count()
    return counted(repeated, repeated_vectors=F.coalesce(F.sum(F.col("count") - 1), F.lit(0)))


def same_vectors(left: DataFrame, right: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """Two tables hold the same vector under the same keys, as an update and a rebuild should."""
    both = left.select(*keys, F.col(vector).alias("l")).join(right.select(*keys, F.col(vector).alias("r")), keys, "full")
    return counted(both, different=F.count_if(F.col("l").isNull() | F.col("r").isNull() | (F.col("l") != F.col("r"))))


def tiles(sizes: list[int], tile: int, records: int) -> None:
    """Sizes are multiples of the tile and fit the records."""
    if any(n % tile for n in sizes) or max(sizes) > records:
        raise ValueError("every size must be a multiple of the tile and fit the records")


def covers(manifest: dict, dimension: int, widths, seeds) -> None:
    """A study's manifest covers what a later one needs."""
    if dimension not in manifest["dimensions"] or not set(widths) <= set(manifest["widths"]) or set(seeds) != set(manifest["seeds"]):
        raise ValueError("the base study lacks a dimension, width or seed")


def complete_curves(table: DataFrame, keys: list[str], x: str, points: int) -> DataFrame:
    """Every curve has all its points."""
    curves = table.groupBy(*keys).agg(F.count_distinct(x).alias("n"))
    return counted(curves, short_curves=F.count_if(F.col("n") != points))
