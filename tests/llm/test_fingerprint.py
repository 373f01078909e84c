"""Fingerprints against exact generalised Jaccard similarity and a plain construction of the pairs."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from hyperloom.llm import fingerprint as fp
from tests.llm import cases


def plain_words(text):
    """Runs of letters, marks and digits; kana, ideographs and Thai letters one by one."""
    return re.findall(r"[\u0e01-\u0e5b\u3041-\u30ff\u4e00-\u9fff]|[^\W_\u0e01-\u0e5b\u3041-\u30ff\u4e00-\u9fff]+", text.lower())


def weighted(text):
    words = plain_words(text)
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter([text] if text else [])


def exact(a, b):
    a, b = weighted(a), weighted(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_likeness_estimates_generalised_jaccard():
    draw = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    errors = []
    for _ in range(60):
        a = [words[i] for i in draw.integers(0, 400, 600)]
        b = list(a)
        for at in draw.integers(0, 600, int(draw.integers(1, 120))):
            b[at] = words[int(draw.integers(400))]
        x, y = " ".join(a), " ".join(b)
        got = fp.likeness(fp.signatures([x]), fp.signatures([y]))[0]
        errors.append(got - exact(x, y))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_weights_count():
    """The same terms, once and n times: generalised Jaccard similarity is 1 / n."""
    terms, docs = fp.tk.mix(np.arange(3000, dtype=np.uint64)), np.zeros(3000, np.int64)
    for n in (2, 4):
        a, b = (fp.sample(terms, np.full(3000, float(w)), docs, 1) for w in (1, n))
        assert abs(fp.likeness(a, b)[0] - 1 / n) < 0.15


def test_heavy_runs_count_by_weight():
    """Ten runs of weight 200 among sixty others of weight 1: shared heavy runs, then shared light ones."""
    errors = {"heavy": [], "light": []}
    for seed in range(20):
        terms = fp.tk.mix(np.arange(130, dtype=np.uint64) + np.uint64(1000 * seed))
        heavy, one, two = terms[:10], terms[10:70], terms[70:]
        sign = lambda *sets: fp.sample(np.concatenate([x for x, _ in sets]), np.concatenate([np.full(len(x), float(w)) for x, w in sets]), np.zeros(sum(len(x) for x, _ in sets), np.int64), 1)
        a, b, light = sign((heavy, 200), (one, 1)), sign((heavy, 200), (two, 1)), sign((one, 1))
        errors["heavy"].append(fp.likeness(a, b)[0] - 2000 / 2120)
        errors["light"].append(fp.likeness(a, light)[0] - 60 / 2060)
    assert all(abs(np.mean(x)) < 0.02 and np.std(x) < 0.06 for x in errors.values()), errors


@pytest.mark.parametrize("shared,own", [((1000,), 124), ((300, 300), 2400), ((2000,), 4000)])
def test_one_heavy_run(shared, own):
    """A run of great weight in both texts, beside runs of their own: the exact share within three standard errors of 40 seeds."""
    exact_share, got = sum(shared) / (sum(shared) + 2 * own), []
    for seed in range(40):
        terms = fp.tk.mix(np.arange(len(shared) + 2 * own, dtype=np.uint64) + np.uint64(10_000 * seed))
        sign = lambda light: fp.sample(np.concatenate([terms[: len(shared)], light]), np.concatenate([np.array(shared, float), np.ones(own)]), np.zeros(len(shared) + own, np.int64), 1)
        got.append(fp.likeness(sign(terms[len(shared) :][:own]), sign(terms[len(shared) :][own:]))[0])
    assert abs(np.mean(got) - exact_share) < 3 * np.sqrt(exact_share * (1 - exact_share) / (40 * fp.SLOTS)), (np.mean(got), exact_share)


@pytest.mark.parametrize("a,b", [(1, 2), (1, 7.5), (300, 600), (0.25, 1)])
def test_unequal_weights(a, b):
    """One set of runs at two weights: the share is that of the weights."""
    got = []
    for seed in range(40):
        terms, docs = fp.tk.mix(np.arange(50, dtype=np.uint64) + np.uint64(999 * seed)), np.zeros(50, np.int64)
        got.append(fp.likeness(*(fp.sample(terms, np.full(50, float(w)), docs, 1) for w in (a, b)))[0])
    assert abs(np.mean(got) - a / b) < 3 * np.sqrt(a / b * (1 - a / b) / (40 * fp.SLOTS))


def test_draws_follow_their_laws():
    """r and c are Gamma(2, 1) and b is uniform, uncorrelated over runs and samples; every run visits all samples once."""
    slot, r, c, b = fp.gammas(fp.tk.mix(np.arange(4000, dtype=np.uint64)))
    assert (np.sort(slot, axis=1) == np.arange(fp.SLOTS)).all()
    assert abs(r.mean() - 2) < 0.01 and abs(c.mean() - 2) < 0.01 and abs(r.var() - 2) < 0.03 and abs(c.var() - 2) < 0.03
    assert abs(b.mean() - 0.5) < 0.002 and abs(b.var() - 1 / 12) < 0.001 and b.min() >= 0 and b.max() <= 1
    assert np.abs(np.corrcoef([r.ravel(), c.ravel(), b.ravel()]) - np.eye(3)).max() < 0.01
    for x in np.quantile(r, [0.1, 0.5, 0.9]), np.quantile(c, [0.1, 0.5, 0.9]):
        assert np.allclose(x, [0.5318, 1.6783, 3.8897], rtol=0.02)
    by_slot = np.bincount(slot.ravel(), r.ravel()) / 4000
    assert np.abs(by_slot - 2).max() < 5 * np.sqrt(2 / 4000)


def test_left_ranks_cannot_win():
    """The same as drawing r, c and b of every run and sample."""
    draw = np.random.default_rng(2)
    terms, weights = fp.tk.mix(np.arange(200, dtype=np.uint64)), np.where(np.arange(200) % 5, 1.0, draw.integers(2, 9, 200))
    slot, r, c, b = fp.gammas(terms)
    level = np.floor(np.log(weights)[:, None] / r + b)
    rank = np.empty_like(r)
    code = np.empty(r.shape, np.uint64)
    rows = np.arange(200)[:, None]
    rank[rows, slot] = c / np.exp(r * (level + 1 - b))
    code[rows, slot] = terms[:, None] ^ (level.astype(np.int64).view(np.uint64) * fp._SECOND)
    won = code[rank.argmin(axis=0), np.arange(fp.SLOTS)]
    want = fp.tk.mix(won ^ fp._CODE) % np.uint64(0xFFFF) + np.uint64(1)
    assert fp.sample(terms, weights, np.zeros(200, np.int64), 1)[0].tolist() == want.tolist()
    assert (fp.signatures(["one two three four five six", "word", "a b c d e " * 300]) != 0).all()


def test_scripts_without_spaces():
    text = "".join(chr(0x4E00 + int(i)) for i in np.random.default_rng(5).integers(0, 3000, 660))
    near = text[:300] + "們" + text[301:500] + "們" + text[501:]
    got = fp.likeness(fp.signatures([text]), fp.signatures([near]))[0]
    assert abs(got - exact(text, near)) < 0.1 and got > 0.9
    assert fp.likeness(fp.signatures(["ПРИВЕТ МИР ÀÉÎ"]), fp.signatures(["привет мир àéî"]))[0] == 1


def test_equal_texts_agree_and_empty_is_defined():
    s = fp.signatures(["", "", "a b", "a b", "!!", "??"])
    assert fp.likeness(s[:1], s[1:2])[0] == 1.0 and (s[2] == s[3]).all() and fp.likeness(s[4:5], s[5:6])[0] == 0.0


def plain_order(rows):
    """By id, nulls first, then by the text's hash as a signed number."""
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), seed=42) + 2**63) % 2**64
    return sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, signed(x[1]), x[1]))


def plain_edits(ordered):
    want = Counter()
    for i, (doc, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        want[(doc, len(text), hashlib.sha256(edited.encode()).hexdigest())] += 1
    return want


@pytest.mark.parametrize("hot", [None, 0, 7])
def test_an_id_that_fills_several_ranges_is_cut(spark, hot):
    """Half of all rows under one id, or without one, are dealt over several tasks, in the same order."""
    rows = [(hot if i % 2 else i, f"text {i // 2 % 70} of many " + "w " * (i % 13)) for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        bounds, _ = fp._bounds(frame, 9)
        got = fp.edited_pairs(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(i == hot for i, _ in bounds) >= 3
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == plain_edits(plain_order(rows))


@pytest.mark.parametrize("parts", ["1", "4", "9"])
def test_pairs_match_plain_construction(spark, parts):
    docs = cases.odd(spark)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fp.edited_pairs(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    ordered = plain_order((r[0], r[1]) for r in cases.rows())
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == plain_edits(ordered)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_empty_and_clashing(spark):
    assert fp.edited_pairs(cases.none(spark)).count() == 0
    assert fp.edited_pairs(cases.clashing(spark)).count() == len(cases.rows())
    assert fp.fingerprints(cases.odd(spark)).count() == len(cases.rows())
