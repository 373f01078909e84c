"""Overlap counts by cube against all pairs; validation; storage."""

from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hyperloom.operators import overlap, pairs
from hyperloom.sources import records as rec
from hyperloom.sources import store


def frame(spark, codes):
    return spark.createDataFrame([(i, *map(str, row)) for i, row in enumerate(codes)], "id long, f1 string, f2 string, f3 string, f4 string, f5 string")


def brute(codes):
    counts = [0] * 6
    for a, b in combinations(codes, 2):
        counts[sum(x == y for x, y in zip(a, b, strict=True))] += 1
    return counts


def test_cube_equals_all_pairs(spark):
    draw = np.random.default_rng(0)
    codes = [[int(draw.integers(c)) for c in (2, 2, 3, 3, 4)] for _ in range(120)]
    got = overlap.grouped_pairs(frame(spark, codes)).agg(*overlap.exact_columns()).first()
    assert list(got) == brute(codes)


@given(st.lists(st.tuples(*[st.integers(0, 2)] * 5), min_size=0, max_size=25))
@settings(max_examples=50, deadline=None)
def test_inclusion_exclusion(codes):
    sums = {}
    for j in range(6):
        for keep in combinations(range(5), j):
            sizes = {}
            for row in codes:
                key = tuple(row[k] for k in keep)
                sizes[key] = sizes.get(key, 0) + 1
            sums[j] = sums.get(j, 0) + sum(n * (n - 1) // 2 for n in sizes.values())
    assert overlap.exact_counts(sums) == brute(codes)


def test_hand_built_candidates(spark):
    """One query against candidates that share 0 to 5 values; order within a record matters."""
    query = (1, 2, 3, 4, 5)
    others = [(9, 9, 9, 9, 9), (1, 8, 8, 8, 8), (1, 2, 7, 7, 7), (1, 2, 3, 6, 6), (1, 2, 3, 4, 0), (1, 2, 3, 4, 5), (5, 4, 3, 2, 1)]
    pairs = {r.j: r.k for r in overlap.sharing_pairs(frame(spark, [query, *others])).where("i = 0").collect()}
    assert [pairs.get(j, 0) for j in range(1, 8)] == [0, 1, 2, 3, 4, 5, 1]


def test_published_records(spark):
    """The first rows and the overlap counts of the published sequence."""
    found = rec.study_records(spark)
    assert [tuple(r)[1:] for r in found.orderBy("record_id").limit(3).collect()] == [(11, 6, 85, 131, 749), (7, 3, 9, 54, 475), (9, 9, 47, 69, 196)]
    sums = {r.j: r.pairs for r in overlap.grouped_pairs(found, rec.PROPERTIES).collect()}
    exact = overlap.exact_counts(sums)
    assert exact[0] == 673_067_631 and sum(exact) == 799_980_000


def test_hashed_records_span_their_cardinalities(spark):
    found = rec.hashed_records(spark, 20_000).toPandas()
    assert [int(found[p].max()) + 1 for p in rec.PROPERTIES] == list(rec.CARDINALITIES) and (found[list(rec.PROPERTIES)].min() == 0).all()


def test_vector_tables(spark, tmp_path):
    rows = spark.createDataFrame([(4, 1, "question", "ipip_item", "Q01", [1, -1, 1, 1]), (4, 1, "answer", "ordered_1_to_5", "1", [1, 1, 1, -1])], "dimension int, seed int, kind string, namespace string, symbol_id string, vector array<int>")
    store.write_vectors(rows, f"{tmp_path}/v", symbols=True)
    assert store.read_vectors(spark, f"{tmp_path}/v", 4, symbols=True).count() == 2
    with pytest.raises(ValueError):
        store.read_vectors(spark, f"{tmp_path}/v", 4, symbols=False)
    with pytest.raises(ValueError):
        store.write_vectors(rows.withColumn("dimension", rows.dimension + 1), f"{tmp_path}/w", symbols=True)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_bytes(b"abc")
    assert store.checksums(spark, f"{tmp_path}/x/*").first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


@pytest.mark.parametrize(("bits", "meet", "members"), [(12, 4096, 4096), (2, 3, 2), (12, 3, 2)])
def test_shared_pairs_leave_where_they_meet(spark, monkeypatch, bits, meet, members):
    """Each once, from the first values it shares, without a shuffle of pairs or a join of their members; also with large groups, large classes, nulls and many values."""
    for place, name, value in ((overlap, "BITS", bits), (overlap, "MEET", meet), (pairs, "MEMBERS", members), (pairs, "owned", None)):
        monkeypatch.setattr(place, name, value)
    draw = np.random.default_rng(1)
    rows = [[None if draw.random() < 0.05 else str(draw.integers(c)) for c in (2, 2, 3, 3, 4)] for _ in range(60)]
    rows += rows[:20] + [rows[3]] * 5
    found = overlap.sharing_pairs(spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "id long, f1 string, f2 string, f3 string, f4 string, f5 string"), 2)
    shared = {(i, j): sum(x == y and x is not None for x, y in zip(rows[i], rows[j], strict=True)) for i, j in combinations(range(len(rows)), 2)}
    assert sorted(map(tuple, found.collect())) == sorted((*pair, k) for pair, k in shared.items() if k >= 2)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("Join")[0]
