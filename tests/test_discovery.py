"""Known cases of missing names, displays, audits and names compared."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from wayfold.functions import display as D
from wayfold.operators import audit, discovery, matching


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", bool: "boolean", type(None): "string", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("name", "kind"),
    [
        ("", "unknown"), ("가" * 41, "unknown"), ("한빛 포털", "page_or_service"), ("공영주차장", "generic_term"), ("넓은 주차장", "generic_term"), ("한빛 공영주차장", "parking_lot_name"), ("ABC Parking", "parking_lot_name"),
        ("한빛시설관리공단", "organization_name"), ("한빛역", "region_name"), ("경기 강원", "region_name"), ("입구 추천", "generic_term"), ("한빛백화점", "facility_name"), ("구", "generic_term"),
    ],
)
def test_kinds_of_names(spark, name, kind):
    assert one(spark, discovery.candidate_type(F.col("n")), n=name) == kind


def test_names_become_normal(spark):
    assert one(spark, discovery.normal_name(F.col("n")), n="  [한빛　 ＡＢＣ주차장]  ") == "한빛 ABC주차장"
    assert one(spark, discovery.normal_name(F.col("n")), n=None) is None


def test_evidence_is_merged_by_name(spark):
    rows = [("한빛 주차장", "a"), ("한빛  주차장", "b"), ("[한빛 주차장]", "a"), (None, "a"), ("--", "a"), ("한빛백화점", "a")]
    got = {r.key: r for r in discovery.missed_candidates(spark.createDataFrame(rows, "missed_lot_name string, source string")).collect()}
    assert set(got) == {"한빛 주차장", "한빛백화점"}
    merged = got["한빛 주차장"]
    assert (merged.evidence_count, merged.source_count, merged.candidate_type, merged.extraction_confidence, merged.search_eligible) == (3, 2, "parking_lot_name", 0.8, True)


def test_capped_text_adds_whole_texts(spark):
    rows = spark.createDataFrame([("k", i, "abcd") for i in range(5)] + [("one", 1, "x" * 50), ("nothing", 1, None)], "k string, o int, t string")
    got = {r.k: r.text for r in discovery.capped_text(rows, "k", "t", "o", 9).collect()}
    # a text is added while those before it have fewer than nine characters: 0, 4, then 9
    assert got == {"k": "abcd abcd", "one": "x" * 50, "nothing": ""}


def test_places_are_resolved(spark):
    lots = spark.createDataFrame([("L", 37.0, 127.0)], "id string, lat double, lng double")
    found = [
        ("a", 1, "한빛 주차장", "x", "서울", 37.0, 127.0), ("b", 2, "한빛 주차장", "x", "서울", 37.2, 127.0), ("c", 3, "한빛 주차장", "x", "서울", 37.2, 127.1),
        ("d", 4, "P 주차장", "x", "중구 대로", 37.3, 127.0), ("d", 5, "Q 주차장", "x", "서울", 37.4, 127.0), ("e", 6, "P 주차장", "x", "서울", 37.3, 127.0), ("e", 7, "Q 주차장", "x", "서울", 37.4, 127.0), ("f", 8, "밥집", "음식", "서울", 37.4, 127.0),
    ]
    results = spark.createDataFrame(found, "candidate string, id int, name string, category string, address string, lat double, lng double")
    names = spark.createDataFrame([(x, "한빛 주차장" if x != "c" else "별빛 주차장", ["중구"]) for x in "abcdef"], "candidate string, name string, hints array<string>")
    got = {r.candidate: (r.label, r.best) for r in discovery.resolved_places(results, lots, names).collect()}
    assert got == {"a": ("all_existing", 1), "b": ("resolved_new", 2), "c": ("ambiguous_new", 3), "d": ("resolved_new", 4), "e": ("ambiguous_new", 6), "f": ("negative", None)}


def test_contexts_are_joined_where_they_touch(spark):
    near = "x" * 300 + "주차" + "y" * 398 + "주차" + "z" * 300
    assert one(spark, D.topic_context(F.col("t")), t=near) == "x" * 200 + "주차" + "y" * 398 + "주차" + "z" * 198
    far = "주차" + "y" * 399 + "주차"
    assert one(spark, D.topic_context(F.col("t")), t=far) == "주차" + "y" * 198 + " … " + "y" * 200 + "주차"
    assert one(spark, D.topic_context(F.col("t")), t="none") == ""
    assert len(one(spark, D.topic_context(F.col("t")), t="주차 " * 2000)) == 1503


def test_search_queries(spark):
    named = one(spark, D.lot_queries(F.col("n"), F.col("a"), F.col("p")), n="한빛시장 공영주차장", a="서울 중구 대로", p='["시장"]')
    assert [(q.strategy, q.query) for q in named] == [
        ("name_region", "한빛시장 주차장 중구 대로"), ("review", "한빛시장 주차 후기"), ("price", "한빛시장 주차 요금"), ("free", "한빛시장 무료주차"), ("hours", "한빛시장 주차 운영시간"), ("poi", "시장 주차장"),
    ]
    assert [(q.strategy, q.query) for q in one(spark, D.lot_queries(F.col("n"), F.col("a"), F.col("p")), n="제1주차장", a="서울 중구 대로", p=None)] == [("region", "중구 대로 주차장 추천")]
    assert one(spark, D.lot_queries(F.col("n"), F.col("a"), F.col("p")), n="제1주차장", a="서울", p=None) == []


def test_page_frames_are_named(spark):
    assert one(spark, D.chrome(F.col("t")), t="a\n## b\nc") == "markdown_header"
    assert one(spark, D.chrome(F.col("t")), t="쿠팡 파트너스 활동") == "coupang_partners"
    assert one(spark, D.chrome(F.col("t")), t="plain") is None


def test_hours_and_prices(spark):
    hours = D.hours_display((F.col("a"), F.col("b")), (F.col("a"), F.col("b")), (F.lit("00:00"), F.lit("24:00")))
    assert tuple(one(spark, hours, a="09:00", b="18:00")) == ("평일 09:00-18:00", "토 09:00-18:00", False)
    assert tuple(one(spark, hours, a=None, b="18:00")) == ("운영시간 정보 없음", None, True)
    price = D.pricing_display(F.col("free"), F.col("t"), F.col("f"), F.lit(10), F.lit(500), F.lit(12000))
    assert tuple(one(spark, price, free=0, t=30, f=1500)) == ("기본 30분 1,500원", "추가 10분당 500원 · 1일 최대 12,000원", False)
    assert tuple(one(spark, price, free=1, t=30, f=1500)) == ("무료", None, False)
    assert tuple(one(spark, price, free=0, t=0, f=0)) == ("요금 정보 없음", None, True)


def test_questions_as_structured_data(spark):
    none = F.lit(None).cast("string")
    price = D.pricing_display(F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0))
    hours = D.hours_display((none, none), (none, none), (none, none))
    items = D.faq(F.col("n"), price, hours, F.lit(1), F.lit(3.4), F.col("s"), F.col("near"), none, none)
    got = one(spark, items, n="한빛", s=0, near=["가", "나", "다", "라"])
    assert [i.answer for i in got] == ["무료 주차장입니다.", "쉬움 점수 3.4점으로 무난한 편이라 초보운전자도 큰 어려움 없이 이용할 수 있습니다.", "정확한 운영시간은 방문 전 확인하세요.", "인근 주차장으로 가, 나, 다 등이 있습니다."]
    page = json.loads(one(spark, D.faq_json(items), n="한빛", s=0, near=[]))
    assert page["@type"] == "FAQPage" and len(page["mainEntity"]) == 3 and page["mainEntity"][0]["acceptedAnswer"]["text"] == "무료 주차장입니다."


def test_replies_are_salvaged(spark):
    long = "x" * 200
    v = lambda t: one(spark, audit.verdict(F.col("t")), t=t)
    good = v('ok {"filter_passed": true, "summary": "%s", "sentiment_score": 9, "difficulty_keywords": ["좁다"], "tip_visit": "a"} end' % long)
    assert (good.passed, good.removed_by, good.sentiment, good.keywords, good.tip_visit, good.tip_pricing) == (True, None, 5.0, ["좁다"], "a", None)
    assert v('{"filter_passed": true, "summary": "x"}').removed_by == "short_summary"
    assert v('{"filter_passed": false, "removed_by": "ad", "summary": "%s"}' % long).removed_by == "ad"
    for bad in ("{", "no braces", "{a: }", None):
        assert (v(bad).passed, v(bad).removed_by, v(bad).summary) == (False, "ai_error", "분류 실패")
    assert one(spark, audit.salvaged_list(F.col("t")), t='x [{"a": 1}, {"b": 2}] y') == ['{"a":1}', '{"b":2}']


def test_names_are_compared_by_start(spark):
    s = lambda a, b: one(spark, matching.affix_similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert s("한빛시장 공영주차장", "한빛시장") == 1.0
    assert s("한빛", "한빛시장") == 0.5
    assert s("abcd", "abxyz") == pytest.approx(0.4)
    assert s("주차장", "한빛") == 0.0


def test_names_without_all_words_fall_back(spark):
    lots = spark.createDataFrame([("1", "한빛시장주차장", "중구"), ("2", "별빛 주차장", "중구")], "id string, name string, address string")
    texts = spark.createDataFrame([(1, "한빛시장"), (2, "별빛 주차장"), (3, "달빛"), (4, None), (5, "")], "id int, name string")
    assert {(r.id, r.lot) for r in matching.by_name(texts, "id", "name", lots).collect()} == {(1, "1"), (2, "2")}


def test_verdicts_of_texts(spark):
    v = audit.text_verdict(F.col("t"), F.col("n"), F.col("f"), F.col("s"), F.col("e"), summary=True)
    say = lambda t, f=0, s="09:00", e="18:00": one(spark, v, t=t, n="한빛 주차장", f=f, s=s, e=e)
    assert [say(None), say(" "), say("무료 주차"), say("한빛 절대 추천"), say("짧다"), say("한빛은 넓다"), say("한빛 비싼 편", f=1), say("한빛 24시간", s=None, e=None)] == ["NA", "NA", "DROP", "FIX", "REGEN", "PASS", "DROP", "DROP"]


def test_crawled_titles(spark):
    score = lambda t, d, n, r="": one(spark, discovery.crawl_relevance(F.col("t"), F.col("d"), F.col("n"), F.col("r")), t=t, d=d, n=n, r=r)
    assert score("한빛 별빛 주차", "한빛 별빛", "한빛 별빛 주차장") == 80
    assert score("한빛 시장", "주차", "한빛 주차장", "중구") == 50
    assert score("시장", "주차 중구", "한빛 시장 주차장", "중구") == 45
    assert score("중구", "주차", "한빛 주차장", "중구") == 30


def test_mentions_are_merged_without_spaces_if_no_key_is_given(spark):
    rows = spark.createDataFrame([("s", "Ab c", 1, "x", None, 7), ("s", "aB\nC", 2, "y", "t", 7), ("s", "d", 3, "z", "", 8)], "source string, name string, id int, category string, tip string, text_id int")
    got = {(r.key, r.name, r.category, r.tip, r.mention_count, r.text_count) for r in discovery.merged_mentions(rows, "source", "name", "id").collect()}
    assert got == {("abc", "Ab c", "x", "t", 2, 1), ("d", "d", "z", None, 1, 1)}
