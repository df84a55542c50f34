"""Models on cases whose results are known, and invariants."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wayfold.functions import columns as C
from wayfold.operators import merge, rankings, relevance, sentiment
from wayfold.operators.scoring import recompute
from wayfold.plans import catalogue
from wayfold.sources import files
from wayfold.sources.views import NOW, Catalogue
from wayfold.streaming import rescoring

LOTS = "id string, name string, notes string, total_spaces int, type string, curation_tag string"
REVIEWS = "parking_lot_id string, overall_score double, is_seed int, source_type string, created_at timestamp"
WEB = "id long, parking_lot_id string, relevance_score int, sentiment_score double, filter_passed_v2 int, published_at timestamp"


def scores(spark, reviews, tag=None):
    lots = spark.createDataFrame([("A", "시청", None, 100, "노외", tag)], LOTS)
    rows = spark.createDataFrame([("A", s, seed, kind) for s, seed, kind in reviews], "parking_lot_id string, overall_score double, is_seed int, source_type string").withColumn("created_at", F.lit(NOW).cast("timestamp"))
    web, ai = spark.createDataFrame([], WEB), spark.createDataFrame([], "web_source_id long, parking_lot_id string, confidence string")
    return recompute(lots, rows, web, ai, NOW).first()


def test_known_scores(spark):
    one = scores(spark, [(5.0, 0, None)])
    assert (one.n_effective, one.final_score, one.reliability) == (3.0, 4.09, "estimated")
    three = scores(spark, [(5.0, 0, None), (1.0, 1, None), (1.0, 0, "clien")])
    assert (three.n_effective, three.review_score, three.final_score) == (3.9, 4.08, 3.66)
    assert scores(spark, [(5.0, 0, None)], "hell").final_score == 2.9
    none = scores(spark, [])
    assert (none.final_score, none.reliability) == (3.0, "none")


def test_batch_is_incremental(spark, sf_dir):
    c = Catalogue(spark, sf_dir)
    some = c.lots.filter("id LIKE 'NV-%'").select(F.col("id").alias("parking_lot_id"))
    part = recompute(c.lots, c.reviews, c.web, c.ai_matches, NOW, only=some)
    assert set(part.collect()) == set(c.stats.filter("parking_lot_id LIKE 'NV-%'").collect())


@pytest.mark.parametrize(("title", "text", "name", "address", "low", "high"), [
    ("강남역 맛집", "맛있어요", "강남역공영주차장", "서울 강남구 역삼동", 0, 0), ("롯데월드타워 주차장 후기", "롯데월드타워 주차 송파구", "롯데월드타워 주차장", "서울 송파구 신천동", 100, 100),
    ("주차장 분양가", "분양가 주차", "롯데월드타워 주차장", "서울 송파구", 0, 0), ("주차 이야기", "송파구 주차", "마루공원 주차장", "서울 송파구", 40, 40),
])
def test_relevance(spark, title, text, name, address, low, high):
    row = spark.createDataFrame([(title, text, name, address)], "t string, d string, n string, a string").select(relevance.blog_relevance(*map(F.col, "tdna")).alias("s"), relevance.match_confidence(*map(F.col, "tdna")).alias("m")).first()
    assert low <= row.s <= high and (row.m.confidence == "none") == (row.s < 40)


def test_sentiment(spark):
    texts = ["주차장이 넓고 편해요", "주차장이 좁고 무서워요", "주차 안 좁다", "오늘 날씨가 맑다", "주차 자리가 아쉽다", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", sentiment.sentiment(F.col("t")).alias("s")).collect()
    s = {r.i: r.s for r in rows}
    assert s[0].relevance == 0.7 and s[0].score > 3 > s[1].score
    assert s[2].score > 3 and s[3].relevance == 0 and s[4].matches == 0 and s[5].matches == 0


def test_columns(spark):
    df = spark.createDataFrame([("경상북도 경주시 중앙로 47번길 13", "<b>a</b> &lt;x&gt; &amp;", "20240101", "2,500 원", "KTX환승 주차장")], "a string, h string, p string, f string, n string")
    r = df.select(C.region(F.col("a")).alias("region"), C.city(F.col("a")).alias("city"), C.strip_html(F.col("h")).alias("html"), C.postdate(F.col("p")).alias("date"), C.fee_won(F.col("f")).alias("fee"), C.name_keywords(F.col("n")).alias("keys"), C.round_half_up(F.lit(-2.5), 0).alias("half"), C.occurrences(F.lit("aaaa"), F.lit("aa")).alias("occ")).first()
    assert (r.region, r.city, r.html, r.date, r.fee, r.half, r.occ) == ("중앙로 47번길", "경주", "a <x> &", "2024-01-01", 2500, -2.0, 2)
    assert r["keys"] == ["ktx환승", "ktx환승 주차장", "ktx"]


def test_merges(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "k int, v int, w string")
    new = spark.createDataFrame([(2, None), (3, 30)], "k int, v int")
    assert sorted(merge.upsert(old, new, ["k"], ["v"]).collect()) == [(1, 10, "a"), (2, None, "b"), (3, 30, None)]
    assert merge.insert_ignore(old.select("k", "v"), new.unionByName(new), ["k"]).collect() == [(3, 30)]
    events = [(1, "up", 1), (1, "up", 2), (2, "up", 1), (2, "down", 2), (3, "up", 1), (3, "down", 2), (3, "down", 3), (3, "down", 4), (4, "down", 5), (4, "down", 6)]
    got = merge.toggled(spark.createDataFrame(events, "k int, kind string, seq int"), ["k"], "kind", "seq", ("up", "down"))
    assert sorted(got.collect()) == [(2, "down"), (3, "down")]
    mapping = spark.createDataFrame([(2, 1)], "duplicate int, keeper int")
    rows = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "id int, phone string")
    assert sorted(merge.without_duplicates(rows, mapping, ["phone"]).collect(), key=lambda r: r.id) == [(1, "x"), (3, None)]


def test_files(spark, tmp_path):
    xml = files.sitemap(spark.createDataFrame([(0, "a", "2024-01-02 03:04"), (0, "b", "2024-01-03")], "page int, id string, modified string"), "https://e.example/")
    assert sorted(r.url for r in files.sitemap_urls(xml).collect()) == ["https://e.example/a", "https://e.example/b"]
    (tmp_path / "dump.sql").write_text("UPDATE stats SET summary = 'it''s; fine' WHERE id = 'KA-1';\nUPDATE stats SET summary = 'two' WHERE id = 'KA-2';\n")
    assert sorted(files.updates_of_dump(spark, str(tmp_path / "dump.sql"), "summary").collect()) == [("KA-1", "it's; fine"), ("KA-2", "two")]
    files.write_shards(spark.range(1200), str(tmp_path / "out"), "id", 2, per_file=500)
    assert spark.read.json(str(tmp_path / "out")).count() == 1200


def test_ingest_may_come_again(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, "a"), (1, "a")], [(1, "b"), (2, "c")]):
        spark.createDataFrame(rows, "k int, v string").coalesce(1).write.mode("append").parquet(src)
        rescoring.ingest_stream(spark.readStream.schema("k int, v string").parquet(src), ["k"], out, str(tmp_path / "cp"))
    assert sorted((r.k, r.v) for r in spark.read.option("basePath", out).parquet(f"{out}/batch=*").collect()) == [(1, "a"), (2, "c")]
    assert rescoring.run_stages([("bad", lambda: 1 / 0), ("good", lambda: None)])["good"] == "ok"


def test_plans(spark, sf_dir):
    """Filters reach the scan, only needed columns are read, top rows are cut in each task, and the grid join is an equi-join."""
    plan = lambda df: df._jdf.queryExecution().toString()
    c = Catalogue(spark, sf_dir)
    posts = plan(c.spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_orderkey = 5").select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_orderkey), EqualTo(l_orderkey,5)]" in posts
    assert "WindowGroupLimit" in plan(rankings.top_per_group(c.web, ["parking_lot_id"], ["id"], 3))
    q = catalogue.queries()
    assert "BroadcastNestedLoopJoin" not in plan(q["proximity_pairs"](spark, sf_dir)) and "CartesianProduct" not in plan(q["proximity_pairs"](spark, sf_dir))
    assert "TakeOrderedAndProject" in plan(q["nearby_lots"](spark, sf_dir))
