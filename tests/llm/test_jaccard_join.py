"""The chosen-path join against all pairs."""

import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from hyperloom.llm import jaccard_join as jj
from hyperloom.llm.components import components
from hyperloom.llm.shared import Work
from tests.llm import cases
from tests.llm.test_fingerprint import plain_words


def shingles(text):
    words = plain_words(text)
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset([text])


def brute(docs):
    """(doc_id, class_id, n_links, copy_of, n_copies) by comparing all pairs of texts."""
    ids = defaultdict(list)
    for i, t in docs:
        ids[t or ""].append(i)
    texts = list(ids)
    sets = [shingles(t) for t in texts]
    parent, links = list(range(len(texts))), Counter()

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[top(a)] = top(b)
    least = lambda xs: min((x for x in xs if x is not None), default=None)
    group = defaultdict(list)
    for k, t in enumerate(texts):
        group[top(k)] += ids[t]
    return Counter((i, least(group[top(k)]), links[k], least(ids[t]), len(ids[t])) for k, t in enumerate(texts) for i in ids[t])


def near_copies(seed=3, n=260):
    draw = np.random.default_rng(seed)
    word = lambda: "".join("abcdefghij"[i] for i in draw.integers(0, 10, 5))
    common = [word() for _ in range(60)]
    docs = []
    for g in range(n // 20):
        base = [word() for _ in range(int(draw.integers(3, 150)))]
        if g % 3 == 0:
            base = common + base
        for _ in range(20):
            copy = list(base)
            for at in draw.integers(0, len(copy), int(draw.integers(0, 4))):
                copy[at] = word()
            docs.append((len(docs), " ".join(copy)))
    return docs


def result(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return Counter(tuple(r) for r in jj.join(frame).collect())


def test_join_matches_all_pairs(spark):
    docs = near_copies()
    assert result(spark, docs) == brute(docs)


@pytest.mark.parametrize("large,levels", [(1 << 18, 3), (12, 2)])
def test_large_buckets_and_ranges_are_exact(spark, monkeypatch, large, levels):
    """Small limits drive every document through grids of ranges, splits, and the rounds of the components."""
    from hyperloom.llm import components as cc

    for name, value in (("RANGE", 6), ("LARGE", large), ("LEVELS", levels), ("BLOCK", 5), ("FEW", 3)):
        monkeypatch.setattr(jj, name, value)
    monkeypatch.setattr(cc, "ONE_TASK", 0)
    docs = near_copies(5, 160)
    assert result(spark, docs) == brute(docs)


def test_scripts_without_spaces(spark):
    draw = np.random.default_rng(6)
    texts = ["".join(chr(0x4E00 + int(i)) for i in draw.integers(0, 3000, 300)) for _ in range(6)]
    docs = list(enumerate(texts)) + [(10 + i, t[:100] + "們" + t[101:]) for i, t in enumerate(texts[:3])]
    got = result(spark, docs)
    assert got == brute(docs) and sum(x[1] != x[0] for x in got) == 3


def described(sets):
    """Rows as `_describe` makes them, of sets of token numbers."""
    cut = lambda hashes, rate: hashes[hashes <= np.uint64(min(2**64 - 1, int(rate / len(hashes) * 2.0**64)))]
    rows = []
    for k, tokens in enumerate(sets):
        hashes = np.sort(jj.tk.mix(jj.tk.mix(np.asarray(tokens).astype(np.uint64) + np.uint64(1))))
        n, paths, sketch = len(hashes), cut(hashes, jj.RUNS), cut(hashes, jj.SKETCH)
        spare = [max(0, len(x) - jj.kept_paths(n, m)) for x, m in ((paths, jj.RUNS), (sketch, jj.SKETCH))]
        rows.append((k, n, paths.view(np.int64).tolist(), *spare, (sketch >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist()))
    return rows


def passages(pairs, seed=4):
    """Pairs at 0.82 all of whose tokens are passages that many sets share, and which are like nothing else."""
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(pairs):
        chosen = draw.permutation(60)[:11]
        out += [(p[:, None] * 20 + np.arange(20)).ravel() for p in (chosen[:10], chosen[1:])]
    return out


def replaced(pairs, seed=5):
    """Pairs at 0.8 with a third of their tokens in one passage that all share: a ninth replaced, or a quarter added."""
    draw = np.random.default_rng(seed)
    out = []
    for k in range(pairs):
        own = 10**6 * (k + 1) + np.arange(400)
        base = np.concatenate([np.arange(120), own[:240]])
        if k % 2:
            gone = draw.permutation(360)[:40]
            out += [base, np.concatenate([np.delete(base, gone), own[300:340]])]
        else:
            out += [base, np.concatenate([base, own[300:390]])]
    return out


@pytest.mark.parametrize("make", [passages, replaced])
@pytest.mark.parametrize("large,levels", [(1 << 18, 0), (12, 2)])
def test_recall_in_large_buckets(spark, monkeypatch, make, large, levels):
    """Every split included, pairs near the threshold are found at about the stated recall."""
    for name, value in (("RANGE", 6), ("LARGE", large), ("LEVELS", levels)):
        monkeypatch.setattr(jj, name, value)
    work = Work(spark, "test")
    reps = work.keep(spark.createDataFrame(described(make(150)), "id long, size int, paths array<long>, spare int, sketch_spare int, sketch array<int>"))
    roots = {r.id: r.root for r in jj._candidates(reps, work).collect()}
    missed = [k for k in range(150) if roots.get(2 * k, -1) != roots.get(2 * k + 1, -2)]
    assert len(missed) <= 1, missed


@pytest.mark.parametrize("samples", [jj.RUNS, jj.SKETCH])
def test_kept_paths_hold_the_recall(samples):
    """By drawing: pairs at the threshold, one replaced and one extended, meet by a kept path."""
    draw = np.random.default_rng(1)
    for size in (10, 25, 33, 60, 200, 2000):
        gone = int(size / 9 + 1e-9)
        for left, right, both in ((size, size, size - gone), (size, int(size / 0.8 + 1e-9), size)):
            rate = [min(1.0, samples / n) for n in (left, right)]
            for n, own in ((left, rate[0]), (right, rate[1])):
                # Sampled tokens of this side that the pair does not share.
                lone = draw.binomial(n - both, own, 40_000) + draw.binomial(both, max(0.0, own - min(rate)), 40_000)
                assert (lone >= jj.kept_paths(n, samples)).mean() <= 1e-4, (size, n)
    assert jj.kept_paths(5) == 2 and jj.kept_paths(1) == 1 and jj.kept_paths(20) == 5


def test_overlaps_match_sets():
    draw = np.random.default_rng(9)
    sets = [np.unique(draw.integers(0, 400, int(draw.integers(1, 90)))).astype(np.uint64) for _ in range(70)]
    for left, right in ((np.arange(70), np.arange(70)), (np.arange(30), np.arange(30, 70))):
        for own, both in jj.overlap_tiles(sets, left, right, rows=16, width=64):
            for i, row in zip(own, both, strict=True):
                assert all(n == len(np.intersect1d(sets[i], sets[j])) for j, n in zip(right, row, strict=True) if i != j)


def test_a_full_cell_takes_bounded_memory():
    """Two ranges of RANGE documents that share frequent tokens, and the links among them."""
    draw = np.random.default_rng(1)
    pool, n = np.sort(draw.choice(2**31, 200, replace=False)).astype(np.uint32), jj.RANGE
    rows = [(b, b * n + k, b * n + k, 300, np.unique(np.concatenate([draw.choice(pool, 40), draw.integers(0, 2**31, 30).astype(np.uint32)]))) for b in range(2) for k in range(n)]
    rows[n + 7] = (*rows[n + 7][:4], rows[3][4])
    left, right = jj._sides(rows, 0, 1)
    tracemalloc.start()
    try:
        assert list(jj._in_tiles(rows, left, right, jj.THRESHOLD)) == [(3, n + 7)]
        assert tracemalloc.get_traced_memory()[1] < 128 << 20
    finally:
        tracemalloc.stop()


def test_odd_rows(spark):
    docs = [(r[0], r[1]) for r in cases.rows()]
    assert result(spark, docs) == brute(docs)
    assert jj.join(cases.none(spark)).count() == 0
    assert jj.join(cases.clashing(spark)).count() == len(cases.rows())


def test_one_of_each(spark):
    kept = jj.one_of_each(cases.clashing(spark))
    assert kept.columns == cases.clashing(spark).columns
    got = {(r.doc_id, r.text) for r in kept.collect()}
    want = {}
    for (i, root, *_), t in ((k, None) for k in brute([(r[0], r[1]) for r in cases.rows()])):
        want.setdefault(root, []).append(i)
    assert len(got) == kept.count() and {i for i, _ in got} >= {r for r in want if r is not None} - {None}
    assert jj.one_of_each(cases.none(spark)).count() == 0


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, monkeypatch, one_task):
    from hyperloom.llm import components as cc

    monkeypatch.setattr(cc, "ONE_TASK", one_task)
    chain = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 102), (200, 201)]
    work = Work(spark, "test")
    edges = work.keep(spark.createDataFrame(chain, "u long, v long"))
    got = {r.id: r.root for r in components(edges, work).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 105: 100, 102: 100, 200: 200, 201: 200}

