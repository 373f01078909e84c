"""The pipeline on a small corpus with planted cases, and on odd ones."""

import numpy as np
import pytest

import corpus_pipeline
from hyperloom.llm import pii
from tests.llm import cases
from tests.llm.test_filters import benchmark_rows
from tests.llm.test_models import corpus

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    draw = np.random.default_rng(8)
    rows = corpus(500)
    items, word = benchmark_rows(10)
    texts = {r[0]: r[1] for r in rows}
    good = [r[0] for r in rows if r[2]]
    near = {}
    for k in range(10):  # near copies, under later ids
        words = (texts[good[k]] + " " + " ".join(word() for _ in range(60))).split()
        texts[good[k]] = " ".join(words)
        words[int(draw.integers(len(words)))] = "changed"
        near[1000 + k] = good[k]
        texts[1000 + k] = " ".join(words)
    leaks = good[20:25]
    for k, i in enumerate(leaks):
        texts[i] += " " + items[k][1]
    private = good[30:35]
    for i in private:
        texts[i] += " write to some.one@mail.example.com please"
    spark.createDataFrame([(i, t, "en", "src%d" % (i % 3), len(t), "x") for i, t in texts.items()], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, near, leaks, private


def test_stages(spark, folder, tmp_path):
    path, rows, near, leaks, private = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id: r for r in docs.collect()})
    junk = {r[0] for r in rows if not r[2]}
    good = {r[0] for r in rows if r[2]}
    assert len(junk & set(seen[0])) <= 0.05 * len(junk) and len(good & set(seen[0])) >= 0.97 * len(good)
    assert not {n for n, o in near.items() if o in seen[1]} & set(seen[1]) and set(seen[0]) - set(seen[1]) <= set(near)
    assert set(seen[1]) - set(seen[2]) == set(leaks) & set(seen[1])
    assert set(seen[3]) == set(seen[2])
    for i in set(private) & set(seen[3]):
        assert "<EMAIL>" in seen[3][i].text and "@" not in seen[3][i].text and seen[3][i].n_chars == len(seen[3][i].text)
    for i in set(seen[3]) - set(private):
        spans = pii.reconcile(seen[2][i].text, pii.base_spans(seen[2][i].text), pii.model_spans(pii.train(), [seen[2][i].text])[0])
        assert seen[3][i].text == pii.redacted(seen[2][i].text, spans)
    assert set(seen[4]) <= set(seen[3]) and all(0 < r.mix_taken <= 3 * r.mix_size for r in seen[4].values())


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert {"doc_id", "text", "source", "mix_taken"} <= set(out.columns) and out.count() > 100


@pytest.mark.parametrize("make", [cases.clashing, cases.none])
def test_odd_documents_pass_every_stage(spark, folder, make, tmp_path):
    docs = make(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder[0])
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
