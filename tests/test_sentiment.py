"""The sentiment model on short texts of known tone. The texts and what holds of them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions.vocab import Feelings
from wayfold.operators import sentiment as S

V = Feelings()


def one(text: str) -> tuple[float, float, float, int]:
    return S.analyze(text, V, {})


@pytest.mark.parametrize(("text", "relevance"), [("주차장이 좁고 경사가 급해요", 1.0), ("주차장이 넓어요", 0.7), ("주차 가능합니다", 0.3), ("오늘 날씨가 좋습니다", 0.0)])
def test_relevance(text, relevance):
    assert one(text)[0] == relevance


def test_tone():
    assert one("맛집 추천합니다")[::2] == (0.0, 3.0)
    bad, good = one("주차장이 너무 좁고 기둥이 많아서 힘들었어요"), one("주차장이 넓고 편해서 추천합니다")
    assert bad[2] < 3.0 < good[2] and bad[3] and good[3]


def test_negation_stress_emoticons_damping_range():
    score = lambda t: one(t)[2]
    assert score("주차장이 안 좁다 편해요") > score("주차장이 좁다 힘들어요") and score("주차장이 넓지 않아서 힘들었어요") < 3.0
    assert score("진짜 좁아서 주차 힘들어요") <= score("좁아서 주차 힘들어요")
    assert one("주차장 좁아요 ㅠㅠ")[3] > one("주차장 좁아요")[3]
    assert one("주차장이 좁아요")[3] == 1 and score("주차장이 좁아요") >= 1.0
    assert 1.0 <= score("좁고 힘들고 무섭고 긁히고 골뱅이 경사 기둥 복잡 만차 헬 지옥") <= 5.0


def test_what_is_known_of_tokens_changes_nothing(spark, monkeypatch):
    """The same whether tokens are worked out anew for each text, remembered, or forgotten in between."""
    rng = random.Random(4)
    words = ["주차장이", "좁고", "안", "넓어요", "편해서", "진짜", "않아서", "ㅠㅠ", "경사로움", "경사", "헬스", "아쉽", "쉬워", "the", "주차,"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 25))) for _ in range(600)]
    want = [one(t) for t in texts]
    known = S.Tokens(V)
    assert [S.analyze(t, V, {}, known) for t in texts] == want
    monkeypatch.setattr(S.Tokens, "MOST", 3)
    assert [S.analyze(t, V, {}, S.Tokens(V)) for t in texts] == want
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").coalesce(1)
    got = {r.i: tuple(r.s) for r in df.select("i", S.sentiment(F.col("t")).alias("s")).collect()}
    assert [got[i] for i in range(600)] == want and got[600] == one("")
