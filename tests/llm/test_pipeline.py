"""The pipeline's stages: what each keeps, and their columns."""

from __future__ import annotations

import collections

import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from wayfold.llm import jaccard, pii, quality, queries, toxicity
from wayfold.llm.common import load


@pytest.fixture(scope="session")
def stages(spark, sf_dir):
    out, docs = {}, load(spark, sf_dir, "documents")
    for name, f in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.written(f(spark, docs, sf_dir), f"test-{name}")
        out[name] = (before, docs)
    return out


def ids(df):
    return collections.Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages_take_effect(spark, sf_dir, stages):
    before, after = stages["quality_rules"]
    assert ids(after) == ids(quality.verdicts(before).filter("kept"))
    before, after = stages["toxicity_filter"]
    assert ids(after) == ids(toxicity.scored(before, load(spark, sf_dir, "labels")).filter("score < 0.7"))
    before, after = stages["near_dedup"]
    classes = jaccard.near_duplicates(before)
    assert ids(after) == ids(classes.groupBy("component").agg(F.min("doc_id").alias("doc_id")))
    before, after = stages["pii_redaction"]
    assert ids(after) == ids(before)
    for name, (b, a) in stages.items():
        if name != "best_fit_packing":
            assert a.columns == b.columns and a.count() <= b.count()
    before, after = stages["best_fit_packing"]
    assert set(ids(after)) == set(ids(before))
    assert after.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_no_personal_data_is_left(stages):
    for r in stages["pii_redaction"][1].collect():
        assert not pii.base_spans(r.text or "") and (r.n_chars is None or r.n_chars == len(r.text))


def test_redaction_replaces_just_the_spans(stages):
    before, after = (dict((r.doc_id, r.text) for r in df.collect()) for df in stages["pii_redaction"])
    for k, t in before.items():
        base = pii.base_spans(t)
        if not base and not pii.candidates(t, base):
            assert after[k] == t


def test_boilerplate_lines_go_and_copies_stay(spark):
    """A line that many different documents of a host share is removed; whole copies of a document keep their lines."""
    text = lambda i: "\n".join([f"Opening words of document number {i} that differ from all others {i * 7919}.", "Subscribe to our newsletter today for more of this", f"And a closing line of document {i} with its own words too."])
    rows = [(i, text(i), "web", 1) for i in range(60)] + [(100 + i, text(1000), "web", 1) for i in range(10)] + [(300, "Subscribe to our newsletter today for more of this", "web", 1), (301, text(5), "other", 1), (302, None, None, 1), (303, "", "web", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r.text for r in quality.cleaned(docs).collect()}
    assert all("Subscribe" not in got[i] and "closing" in got[i] for i in range(60))
    assert got[301] == text(5)
    assert 300 not in got and 302 not in got and 303 not in got


def test_hard_rows_go_through(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mail me at a.b@example.org", "s", 1, "h", "x"), (1, "other text of the same id with ten words or more in it", "s", 1, "h", "x"), (None, "a row without any id but with ten words or more", None, None, None, None), (2, long, "s", 1, "h", "x"), (2, long, "s", 1, "h", "x"), (3, None, "s", 1, "h", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, host string, _spans string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder, docs = str(tmp_path), load(spark, str(tmp_path), "documents")
    for name, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(f(spark, docs, folder), f"hard-{name}")
        if name == "pii_redaction":
            assert docs.columns == ["doc_id", "text", "source", "n_chars", "host", "_spans"]
            assert collections.Counter(r.doc_id for r in docs.collect()) == {1: 2, 2: 1, None: 1}  # the other text of id 1 is no copy


def test_stages_on_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, n_chars long, h string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, str(tmp_path))
        assert out.count() == 0
        if name != "best_fit_packing":
            assert out.columns == docs.columns


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages["best_fit_packing"][1].count()
    assert len(queries.queries()) == 10
