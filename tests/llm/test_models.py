"""Classifiers by held-out accuracy; token counts against the library."""

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest

from hyperloom.llm import labelled, quality, toxicity
from hyperloom.llm import token_count as tc
from tests.llm import cases

INSULTS = ("blockhead", "nitwit", "dunce", "numskull")


def prose(draw, n):
    parts = "the on er st re ha in ti ou en sh wh le es an ment con vi ge la mo da ri".split()
    return ["".join(parts[i] for i in draw.integers(0, len(parts), int(draw.integers(1, 4)))) for _ in range(n)]


def corpus(n=600, seed=4):
    """(doc_id, text, quality, toxic): junk is capitals, signs or one word over and over; toxic texts hold insults."""
    draw = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = prose(draw, int(draw.integers(30, 120)))
        good, toxic = int(draw.random() > 0.25), int(draw.random() < 0.25)
        if not good:
            kind = int(draw.integers(3))
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + "***" for w in words] if kind == 1 else words[:2] * 30
        if toxic:
            for _ in range(2):
                words.insert(int(draw.integers(len(words))), INSULTS[int(draw.integers(len(INSULTS)))])
        out.append((i, " ".join(words), good, toxic))
    return out


def frames(spark):
    rows = corpus()
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int"), rows


@pytest.mark.parametrize("module,label,column", [(quality, "quality", 2), (toxicity, "toxic", 3)])
def test_held_out_accuracy(spark, module, label, column):
    docs, labels, rows = frames(spark)
    texts, y = labelled.sample(docs, labels, label)
    assert len(texts) == sum(zlib.crc32(str(r[0]).encode()) % 4 != 2 for r in rows)
    got = {r.doc_id: r for r in module.classify(docs, module.train(texts, y)).collect()}
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == {r[0] for r in out}
    assert np.mean([got[r[0]].predicted == r[column] for r in out]) > 0.95


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, module):
    _, _, rows = frames(spark)
    model = module.train([r[1] for r in rows], np.array([r[2] for r in rows]))
    got = module.classify(cases.clashing(spark), model).collect()
    assert len(got) == len(cases.rows()) and all(0 <= r.score <= 1 for r in got)
    scores = {}
    for r in got:
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert len(scores[0]) == 1 and scores[0] == scores[7] and scores[1] <= scores[2]
    assert module.classify(cases.none(spark), model).count() == 0
    one = module.train(["a", "b"], np.array([1, 1]))
    assert module.classify(cases.odd(spark), one).select("score").distinct().count() == 1
    none = module.train([], np.zeros(0, int))
    assert module.classify(cases.odd(spark), none).select("score").distinct().first().score == 0.5


def test_sample_takes_each_id_once(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (3, None), (None, "x"), (4, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    texts, y = labelled.sample(docs, labels, "toxic")
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i in (1,)) and texts == ["a"] and y.tolist() == [1]


def test_toxicity_scores_match_a_plain_sum(spark):
    """Every score is the bias and the weights of the distinct n-grams of the text, found one by one."""
    _, _, rows = frames(spark)
    model = toxicity.train([r[1] for r in rows], np.array([r[3] for r in rows]))
    weight_of = {}

    def feature(gram):
        if gram not in weight_of:
            found = list(toxicity.ngrams(np.array([ord(c) for c in gram], np.uint32), np.array([0, len(gram)])))[len(gram) - min(toxicity.ORDERS)][0]
            weight_of[gram] = int(found[0])
        return weight_of[gram]

    texts = [rows[k][1][:90] for k in range(0, 60, 6)] + ["", "ab", "ÀÉ you BLOCKHEAD, ты Dunce!", "漢字 numskull"]
    got = model.score(pa.array(texts, pa.large_string()))
    for text, score in zip(texts, got, strict=True):
        plain = "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in text.lower())
        grams = {feature(plain[i : i + n]) for n in toxicity.ORDERS for i in range(len(plain) - n + 1)}
        assert score == pytest.approx(1 / (1 + np.exp(-(model.bias + sum(float(model.weight[g]) for g in grams)))), rel=1e-5)


def test_naive_bayes_ratios():
    """Features of toxic texts alone weigh towards toxic, those of the others away from it."""
    model = toxicity.train(["bad word here"] * 20 + ["good word there"] * 20, np.array([1] * 20 + [0] * 20))
    bad, good, both = model.score(pa.array(["bad", "good", "word"]))
    assert bad > 0.55 and good < 0.45 and good < both < bad


def test_quality_scores_match_a_plain_network(spark):
    """Pooling word by word and the network by hand give the same scores."""
    _, _, rows = frames(spark)
    model = quality.train([r[1] for r in rows], np.array([r[2] for r in rows]))
    texts = [r[1] for r in rows[:20]] + ["", "One, two!! 33 x|y ÉTÉ été été", " \n"]
    known = {int(h): quality.SHAPES + i for i, h in enumerate(model.known)}
    for text, score in zip(texts, model.score(pa.array(texts, pa.large_string())), strict=True):
        vectors, before = [], None
        for raw in text.split():
            data = raw.encode()
            shape = 0
            for c in data:
                shape |= 1 if 97 <= c < 123 else 2 if 65 <= c < 91 else 4 if 48 <= c < 58 else 128 if c >= 128 else 8 if c in b",." else 16 if c == 33 else 32 if c == 124 else 64
            low = quality.tk.lowered(np.frombuffer(data, np.uint8))
            own = int(quality.tk.hash_spans(low, np.array([0]), np.array([len(low)]))[0])
            shape += 256 * (own == before)
            before = own
            plain = shape < 256 and shape & ~8 in (1, 2, 3, 128, 129, 130, 131)
            vectors.append(model.vectors[known.get(own, shape) if plain else shape].astype(float))
        pooled = np.zeros(2 * quality.DIM)
        if vectors:
            pooled = np.concatenate([np.mean(vectors, axis=0), np.std(vectors, axis=0)])
        centre, scale, w1, b1, w2, b2 = model.layers
        z = (np.maximum((pooled - centre) / scale @ w1 + b1, 0) @ w2 + b2) / model.temperature
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4), text


def test_sample_is_bounded_in_characters(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, toxic int")
    few, _ = labelled.sample(docs, labels, "toxic", total=1050)
    assert len(few) == 10 and len(labelled.sample(docs, labels, "toxic")[0]) > 100


def test_quality_keeps_rows_and_columns(spark):
    docs, labels, rows = frames(spark)
    model = quality.fitted(docs, labels)
    kept = quality.accepted(cases.clashing(spark), model)
    assert kept.columns == cases.clashing(spark).columns
    good = {r.doc_id for r in quality.accepted(docs, model).collect()}
    assert np.mean([(r[0] in good) == bool(r[2]) for r in rows]) > 0.95


def test_very_long_text_scores_like_its_pieces():
    _, weight = None, np.zeros(1 << toxicity.BITS)
    weight[::7] = 0.001
    model = toxicity.Model(0.0, weight)
    text = " ".join(prose(np.random.default_rng(0), 1_200_000))
    assert len(text) > 4 * toxicity.tk.BLOCK
    keys = toxicity.present(*toxicity.characters(pa.array([text])), model.used)
    want = 1 / (1 + np.exp(-min(50, 0.001 * len(keys))))
    assert model.score(pa.array([text]))[0] == pytest.approx(want, rel=1e-5)


# ------------------------------------------------------------------------------------------ tokens

TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "\n", "\n\n a \n", "a\tb", "▁a", "a▁▁b", "é", "<s>x</s><unk>", "漢字 😀 kana", "x" * 5000, "the " * 4000, "a\r\nB", "\u0000", "  \n  two", "one.\nTwo three", "tail \n", "​", "ﬁ①", "word\n\nword"]


def test_tokens_match_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tc.model_path())
    draw = np.random.default_rng(1)
    mixed = ["".join(" \n\tab▁thé.,"[i] for i in draw.integers(0, 11, int(draw.integers(0, 60)))) for _ in range(3000)]
    counter = tc.Counter(tc.model_path())
    assert counter.cuts and len(counter.whole) > 10_000
    for text in TEXTS + mixed:
        assert counter.count(text) == len(library.encode(text)), repr(text)
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None)]
    for r in tc.count_tokens(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        text = TEXTS[r.doc_id] if r.doc_id is not None else ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), len(library.encode(text)), len(library.encode(text)) > 4096)
    assert tc.count_tokens(cases.clashing(spark)).count() == len(cases.rows()) and tc.count_tokens(cases.none(spark)).count() == 0


def test_remembered_results_are_bounded(monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 16_000)
    counter = tc.Counter(tc.model_path())
    for i in range(3000):
        counter.count(f"zq{i} wv{i}\nxk{i}")
    assert len(counter) <= 16_000 and len(counter.bare) <= 4000


def test_whole_tokens_are_proved():
    counter = tc.Counter(tc.model_path())
    bodies = list(counter.whole)[::97]
    assert all(len(x) == 1 for x in counter.model.encode(bodies))
