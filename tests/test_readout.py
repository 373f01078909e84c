"""Readouts, geometry and perturbations: algebra, and agreement of the two forms of a change."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hyperloom.functions import vectors
from hyperloom.functions.codebook import Twister
from hyperloom.operators import geometry, readout
from hyperloom.plans import studies
from hyperloom.sources import answers as ans


def made(spark, n=12, seed=1):
    draw = np.random.default_rng(seed)
    return spark.createDataFrame([(i, draw.integers(1, 6, ans.ITEMS).tolist()) for i in range(n)], "vid long, levels array<int>")


def test_reverse_scoring_is_an_involution(spark):
    rows = spark.createDataFrame([(r, k) for r in range(1, 6) for k in "+-"], "raw int, key string")
    once = vectors.reverse_scored(F.col("raw"), F.col("key"))
    out = rows.withColumn("once", once).withColumn("twice", vectors.reverse_scored(F.col("once"), F.col("key"))).collect()
    assert all(r.twice == r.raw for r in out) and {(r.raw, r.once) for r in out if r.key == "-"} == {(1, 5), (2, 4), (3, 3), (4, 2), (5, 1)}


def test_levels_are_ordered(spark):
    book = readout.fact_vectors(spark, 11).astype(int)
    gram = np.einsum("ld,md->lm", book[0], book[0])
    assert min(gram[i, i + 1] for i in range(4)) > max(gram[i, i + 3] for i in range(2)) and (np.diag(gram) == 256).all()


def test_array_algebra(spark):
    rng = np.random.default_rng(0)
    a, b = (rng.choice([-1, 1], 64).tolist() for _ in range(2))
    r = spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(
        vectors.dot(F.col("a"), F.col("b")).alias("dot"), vectors.unbind(vectors.bind(F.col("a"), F.col("b")), F.col("b")).alias("back"),
        vectors.difference(vectors.bundle(F.col("a"), F.col("b")), F.col("b")).alias("less"),
    ).first()
    assert r.dot == int(np.dot(a, b)) and r.back == a and r.less == a


@given(st.lists(st.integers(1, 5), min_size=50, max_size=50), st.integers(0, 49), st.integers(1, 5))
@settings(max_examples=25, deadline=None)
def test_update_equals_rebuild(levels, at, new):
    book = np.random.default_rng(0).choice([-1, 1], (50, 5, 64)).astype(np.int8)
    changed = list(levels)
    changed[at] = new
    before, after = (readout.prefixes(book, np.array([x]), (50,))[0, 0] for x in (levels, changed))
    assert (before + book[at, new - 1].astype(int) - book[at, levels[at] - 1] == after).all()


def test_pair_blocks_equal_dense(spark, monkeypatch):
    monkeypatch.setattr(geometry, "BLOCK", 5)
    profiles = made(spark)
    levels = np.array([r.levels for r in profiles.orderBy("vid").collect()])
    book = readout.fact_vectors(spark, 11)
    bundles = readout.prefixes(book, levels, (20, 50))
    rows = geometry.compare(profiles, (11,), (20, 50)).collect()
    assert len(rows) == 2 * 66
    for r in rows:
        k = (20, 50).index(r.width)
        assert r.a < r.b and r.dot == int(bundles[r.a, k] @ bundles[r.b, k])
        assert r.difference_sum == int(np.abs(levels[r.a, : r.width] - levels[r.b, : r.width]).sum())


def test_published_readout_figures(spark):
    """Recovery at D = 512, seed 11 of the published profiles is exact for five items: here for any answers."""
    profiles = made(spark, 31, 5)
    books = {11: studies.twister_facts(512, 11)}
    out = readout.cleaned(readout.readouts(profiles, (11,), 512, (5,), books))
    assert out.count() == 155 and out.where("predicted = true_level").count() >= 150


def test_drawn_variants():
    raw = [1 + i % 5 for i in range(50)]
    for width in studies.PERTURBED_WIDTHS:
        for condition, share in studies.CONDITIONS.items():
            found = studies.drawn_variants(raw, "featured", width, condition)
            assert len(set(found)) == len(found) <= studies.MAX_VARIANTS
            for change in found:
                assert len(change) == round(width * share) and all(1 <= raw[i] + s <= 5 for i, s in change)


def test_studies_write_their_tables(spark, tmp_path):
    items = spark.createDataFrame([(f"Q{i:02d}", i, "+" if i % 2 else "-") for i in range(1, 51)], "item_id string, position short, key_direction string")
    draw = np.random.default_rng(2)
    people = ["featured", "p1", "p2", "p3"]
    responses = spark.createDataFrame([(p, f"Q{i:02d}", int(draw.integers(1, 6))) for p in people for i in range(1, 51)], "profile_id string, item_id string, raw_answer int")
    out = studies.run_readout_study(spark, items, responses, people, str(tmp_path / "a"), (256,), (11,), (5, 50))
    assert out["recovery"].count() == 2 and out["geometry"].count() == 4 and out["diagnostics"].count() == 1
    summary = studies.run_perturbation_study(spark, items, responses, people, str(tmp_path / "b"), 256, (11,), (5, 10))
    assert {(r.bundle_width, r.condition) for r in summary.collect()} == {(w, c) for w in (5, 10) for c in ("near", "far")}


def test_twister_levels_share_their_ends():
    levels = Twister(1104).levels(5, 512)
    assert set(np.unique(levels)) == {-1, 1} and (levels[0] != levels[4]).mean() > 0.4
