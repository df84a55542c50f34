"""Features and fitting of toxicity."""

from __future__ import annotations

import time

import numpy as np

from wayfold.llm import toxicity
from wayfold.llm.common import load

LEXICON = toxicity.Lexicon({"idiot": (60, 1), "clown": (30, 1), "rude": (40, 14)}, 100, 100)


def test_long_texts_take_linear_time():
    began = time.perf_counter()
    x = dict(zip(toxicity.FEATURES, toxicity.features("you idiot " * 500_000, LEXICON), strict=True))
    assert time.perf_counter() - began < 60
    assert x["strong_count"] == 500_000 and x["nearest"] == 1 and x["near_density"] == 500


def test_proximity_is_the_least_distance():
    r = np.random.default_rng(2)
    for _ in range(50):
        words = r.choice(["you", "idiot", "a", "b", "c", "d", "e"], 40, p=[0.05, 0.1, *[0.17] * 5]).tolist()
        x = dict(zip(toxicity.FEATURES, toxicity.features(" ".join(words), LEXICON), strict=True))
        gaps = [min((abs(i - j) for j, v in enumerate(words) if v == "you"), default=99) for i, w in enumerate(words) if w == "idiot"]
        assert x["nearest"] == min([*gaps, toxicity.NEAR + 1])
        assert np.isclose(x["near_density"], 1000 * sum(g <= toxicity.NEAR for g in gaps) / 40)


def test_no_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(i, f"you idiot number {i}", "x", "y") for i in range(20)], "doc_id long, text string, margin string, label string")
    for kinds in ([], [(i, 1) for i in range(20)], [(i, None) for i in range(20)]):
        labels = spark.createDataFrame(kinds, "doc_id long, toxic int")
        assert {r.score for r in toxicity.scored(docs, labels).collect()} == {toxicity.UNKNOWN}
        assert toxicity.kept(docs, labels).collect() == docs.collect()


def test_learns_and_keeps_other_columns(spark):
    text = lambda i: f"what a {'stupid clown' if i % 4 == 0 else 'lovely day'} you have number {i} " * 3
    docs = spark.createDataFrame([(i, text(i), "x", "y") for i in range(400)], "doc_id long, text string, margin string, label string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    kept = toxicity.kept(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(400) if i % 4]


def test_scores_need_one_python_worker_a_task(spark, sf_dir):
    """Scores are calibrated by Spark's own function, as numpy's interpolation gives them; a Python function would be a second worker in each task."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    assert "EvalPython" not in toxicity.kept(docs, labels)._jdf.queryExecution().executedPlan().toString()
    model = toxicity.fit(docs, labels)
    rows = model.score(toxicity.with_features(docs.select("doc_id", "text"), model.lexicon)).select("margin", "score").collect()
    expected = np.clip(np.interp([r.margin for r in rows], model.calibration.boundaries.toArray(), model.calibration.predictions.toArray()), 0.0, 1.0)
    assert np.allclose([r.score for r in rows], expected, rtol=1e-12, atol=1e-12)
