"""The generated questionnaire and the studies on it give the published figures."""

import pytest

from hyperloom.operators import validate
from hyperloom.plans import studies
from hyperloom.sources import answers as ans


@pytest.fixture(scope="module")
def source(spark):
    items, profiles, responses = ans.study_items(spark), ans.study_profiles(spark), ans.study_responses(spark)
    return items, responses, [r.profile_id for r in profiles.orderBy("vid").collect()]


def test_answers(spark, source):
    items, responses, order = source
    counts = {r.raw_answer: r["count"] for r in responses.groupBy("raw_answer").count().collect()}
    assert [counts[k] for k in range(1, 6)] == [317, 293, 313, 292, 335]
    assert {r.key_direction: r["count"] for r in items.groupBy("key_direction").count().collect()} == {"+": 26, "-": 24}
    validate.require(validate.items(items), validate.responses(responses, ans.study_profiles(spark), items))
    with pytest.raises(ValueError, match="missing"):
        validate.require(validate.responses(responses.where("item_id <> 'Q07'"), ans.study_profiles(spark), items))
    assert order[0] == "featured" and len(order) == 31


def test_readout_study(spark, source, tmp_path):
    out = studies.run_readout_study(spark, *source, str(tmp_path), (512,), (11,), (5, 10))
    five, ten = out["recovery"].collect()
    assert (five.exact_accuracy, five.within_one, five.queries) == (1.0, 1.0, 155) and five.mean_winner_margin == pytest.approx(0.0942706044265816, abs=1e-7)
    assert ten.exact_accuracy == pytest.approx(0.9870967741935484) and ten.mean_absolute_error == pytest.approx(0.012903225806451613) and ten.mean_winner_margin == pytest.approx(0.05995344803217919, abs=1e-7)
    shapes = {(r.bundle_width, r.reference): r for r in out["geometry"].collect()}
    published = {("5", "difference"): (0.9819440841674805, 0.6774193548387096), ("5", "codebook"): (0.9833244681358337, 0.7741935483870968),
                 ("10", "difference"): (0.9567720890045166, 0.8387096774193549), ("10", "codebook"): (0.9617287516593933, 0.8709677419354839)}
    for key, (spearman, nearest) in published.items():
        assert float(shapes[key].spearman) == pytest.approx(spearman, abs=2e-4) and float(shapes[key].nearest_neighbor_agreement) == pytest.approx(nearest)
    d = out["diagnostics"].first()
    assert d.mean_absolute_question_cosine == pytest.approx(0.034426022320985794, abs=1e-7) and d.max_absolute_question_cosine == pytest.approx(0.1445312649011612, abs=1e-7)
    assert d.level_1_2_cosine == pytest.approx(0.7812500596046448, abs=1e-7) and d.level_4_5_cosine == pytest.approx(0.7929688096046448, abs=1e-7)


PERTURBED = """5,far,0.8515980293353398,0.8512271347866264,3680
5,near,0.9505105360979248,0.9504142650129609,1245
10,far,0.8493734489205063,0.8510458800613239,3720
10,near,0.9497114812174151,0.95033934234291,3720
20,far,0.8501670648333846,0.8510514126029066,3720
20,near,0.9499089183025462,0.9503482154107861,3720
40,far,0.8523748631278675,0.8510079168504284,3720
40,near,0.9507530304533178,0.9503356244487146,3720
50,far,0.8509454974083491,0.8510047436785954,3720
50,near,0.950307508261614,0.9503282930107526,3720"""


def test_perturbation_study(spark, source, tmp_path):
    """All ten published rows, the different profiles' context, and figure data from the written tables."""
    rows = studies.run_perturbation_study(spark, *source, str(tmp_path)).collect()
    got = {(r.bundle_width, r.condition): r for r in rows}
    for line in PERTURBED.splitlines():
        width, condition, cosine, ideal, pairs = line.split(",")
        r = got[int(width), condition]
        assert r.pairs == int(pairs) and r.profile_seed_units == 155
        assert r.bundle_cosine == pytest.approx(float(cosine), abs=1e-6) and r.oracle_cosine == pytest.approx(float(ideal), abs=1e-6)
    context = spark.read.csv(f"{tmp_path}/perturbation_distinct_profiles", header=True, inferSchema=True).collect()
    published = {5: (0.2, 5), 10: (0.4, 0), 20: (0.4, 0), 40: (0.5, 0), 50: (0.52, 0)}
    assert {r.bundle_width: (pytest.approx(r.smallest_raw_difference), r.naturally_near_pairs) for r in context} == published and {r.distinct_pairs for r in context} == {2325}
    shown = studies.replayed(spark, str(tmp_path))
    assert list(shown) == ["perturbation"] and shown["perturbation"].count() == 10


def test_base_study_must_cover_and_sources_stay(spark, source, tmp_path):
    from hyperloom.sources import store

    store.write_csv(source[0], f"{tmp_path}/items")
    files = f"{tmp_path}/items/*.csv"
    studies.run_readout_study(spark, *source, str(tmp_path), (512,), (11,), (5, 10), sources=files)
    args = dict(dimension=512, seeds=(11,), widths=(5,), base=str(tmp_path))
    assert studies.run_perturbation_study(spark, *source, str(tmp_path), **args, sources=files).count() == 2
    with pytest.raises(ValueError, match="lacks"):
        studies.run_perturbation_study(spark, *source, str(tmp_path), **{**args, "widths": (50,)}, sources=files)
    store.write_csv(source[0].limit(3), f"{tmp_path}/items")
    with pytest.raises(ValueError, match="changed"):
        studies.run_perturbation_study(spark, *source, str(tmp_path), **args, sources=files)
    assert set(studies.replayed(spark, str(tmp_path))) == {"recovery", "geometry", "perturbation"}
