"""Mixing against a plain linear search, and the pipeline against plain stages."""

import re
import time
from collections import defaultdict
from fractions import Fraction
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from hyperloom.llm import mixing
from tests.llm import cases


def plain_targets(sizes, weights, total, most=mixing.REPEATS):
    """By exact fractions, one source stopping after another."""
    open_, left, out = set(sizes), Fraction(total), {}
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if unit * weights[s] > most * sizes[s]}
        if not full:
            return out | {s: unit * weights[s] for s in open_}
        for s in full:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def plain_weights(names):
    ordered = sorted((s for s in names if s is not None), key=lambda s: s.encode()) + [None] * (None in names)
    return {s: 1 + i % 3 for i, s in enumerate(ordered)}


def test_targets_stop_at_three_times_the_size(spark):
    work = mixing.Work(spark, "test")
    draw = np.random.default_rng(3)
    for sizes in ({"a": 100, "b": 10, "c": 1000, "d": 1}, {"a": 0}, {}, {None: 7, "é": 10**14, "z": 3, "a": 10**13}, {f"s{i}": int(10 ** draw.uniform(0, 6)) for i in range(300)}):
        frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = mixing.with_targets(mixing.cycled(frame, work), sum(sizes.values())).collect()
        weights = plain_weights(sizes)
        want = plain_targets(sizes, weights, sum(sizes.values()))
        assert {r.source: r.weight for r in got} == weights
        assert {r.source: r.target for r in got} == {s: float(t) for s, t in want.items()}


def cost(flow, words):
    """Least repetition cost of taking flow[p] words of each pattern."""
    total = 0
    for p, n in flow.items():
        for r in range(1, mixing.REPEATS + 1):
            took = min(n, words[p])
            total += r * took
            n -= took
    return total


def test_flow_is_of_least_cost():
    """All splits of small patterns are tried."""
    a, b, ab = frozenset("a"), frozenset("b"), frozenset("ab")
    for words, quotas in (({a: 4, b: 3, ab: 5}, {"a": 9, "b": 6}), ({a: 2, ab: 3}, {"a": 4, "b": 5}), ({a: 1, b: 1, ab: 1}, {"a": 3, "b": 3})):
        used = mixing.route(words, {p: sorted(p) for p in words}, quotas)
        assert sum(used.values()) == sum(quotas.values()) and feasible(used, quotas)
        assert all(used[p] <= 3 * words[p] for p in words)
        names = sorted(words, key=sorted)
        best = min(cost(dict(zip(names, x, strict=True)), words) for x in product(*(range(3 * words[p] + 1) for p in names))
                   if sum(x) == sum(quotas.values()) and feasible(dict(zip(names, x, strict=True)), quotas))
        assert cost(used, words) == best


def test_flow_of_many_patterns():
    """Thousands of overlapping patterns are routed in full and in seconds."""
    draw = np.random.default_rng(5)
    members = {k: sorted({int(x) for x in draw.integers(0, 300, 3)}) for k in range(5000)}
    words = {k: int(draw.integers(1, 1000)) for k in members}
    quotas = {s: 0 for s in range(300)}
    for k, own in members.items():  # a flow that exists
        quotas[own[0]] += words[k]
    began = time.time()
    used = mixing.route(words, members, quotas)
    assert sum(used.values()) == sum(quotas.values()) and time.time() - began < 30
    assert cost(used, words) == sum(words.values())  # nothing is repeated, as nothing need be


def feasible(amounts, quotas):
    a, b, ab = (amounts.get(frozenset(x), 0) for x in ("a", "b", "ab"))
    return a <= quotas["a"] and b <= quotas.get("b", 0) and a + b + ab == sum(quotas.values())


def documents(spark, n=400):
    draw = np.random.default_rng(1)
    rows = [(i, "w " * int(draw.integers(0, 60)), ["big", "mid", "tiny", None][min(3, int(draw.integers(0, 10)) // 3)]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_mix_meets_targets(spark):
    docs, rows = documents(spark)
    got = mixing.mix(docs, F.array("source")).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
    want = plain_targets(sizes, plain_weights(sizes), sum(sizes.values()))
    took = defaultdict(int)
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", rows[r.doc_id][1])) and r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        assert r.source_size == sizes[r.sources[0]] and r.target == float(Fraction(want[r.sources[0]]))
        took[r.sources[0]] += r.taken
    assert len(got) == len(rows) and all(abs(took[s] - want[s]) <= 60 for s in sizes)
    assert sorted(got) == sorted(mixing.mix(docs.repartition(7), F.array("source")).collect())


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["a", "b"]) for i in range(90)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, s array<string>"), F.col("s"), weights=lambda sources, _: sources.withColumn("weight", F.lit(1).cast("long"))).collect()
    assert sum(r.taken for r in got) == 900 and {r.taken for r in got} == {10}


def test_rows_alike_are_taken_one_by_one(spark):
    """Rows without an id, and equal ones, come near the target of their source, alike on every run."""
    rows = [(None, "w " * 10, "a") for _ in range(50)] + [(None, f"t{i} " * 10, "b") for i in range(50)] + [(7, "x " * 10, "c") for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {s: float(t) for s, t in plain_targets({"a": 500, "b": 500, "c": 600}, {"a": 1, "b": 2, "c": 3}, 1600).items()}
    for frame in (docs, docs.repartition(5)):
        got = mixing.mix(frame, F.array("source")).collect()
        took = defaultdict(int)
        for r in got:
            took[r.sources[0]] += r.taken
        assert all(abs(took[s] - want[s]) <= 10 for s in want) and len(got) == 160
    kept = mixing.taken(docs, F.array("source")).collect()
    again = mixing.taken(docs.repartition(5), F.array("source")).collect()
    assert sorted(map(str, kept)) == sorted(map(str, again)) and sum(r.mix_taken for r in kept) == sum(took.values())


def test_very_many_sources(spark):
    docs = spark.range(20_001).selectExpr("id as doc_id", "'one two three' as text", "concat('site', id) as source")
    got = mixing.mix(docs, F.array("source")).agg(F.count("*").alias("n"), F.sum("taken").alias("t"), F.sum("target").alias("w"), F.max("taken").alias("m")).first()
    assert got.n == 20_001 and abs(got.w - 60_003) < 1e-3 and abs(got.t - 60_003) <= 3 * 20_001 and got.m <= 9


def test_odd_rows(spark):
    assert mixing.mix(cases.clashing(spark), F.array("source")).count() == len(cases.rows())
    assert mixing.mix(cases.none(spark), F.array("source")).count() == 0
    out = mixing.taken(cases.clashing(spark), F.array("source"))
    assert out.columns == [*cases.clashing(spark).columns, "mix_size", "mix_target", "mix_taken"] and out.count() > 0
    assert mixing.taken(cases.none(spark), F.array("source")).count() == 0
