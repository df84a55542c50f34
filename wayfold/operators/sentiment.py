"""Lexicon sentiment of texts about a topic. Token order matters (negations, intensifiers), so texts go through one Arrow function."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.columns import clamp, round_half_up, time_decay
from wayfold.functions.vocab import Feelings

SEPARATORS = re.compile(r"[\s,.!?;:…·~]+")
LINKS = (re.compile(r"!?\[[^\]\n]*\]\([^)\n]*\)"), re.compile(r"https?://\S+"))
#: Characters around a token in which the topic must stand; damping by number of matches and by notice-like signs.
NEAR, DAMPING, NOTICE = 50, {1: 0.4, 2: 0.55, 3: 0.75, 4: 0.9}, (1.0, 0.55, 0.25)
SLICE = 256  # texts
RELEVANCE = (0.0, 0.3, 0.7, 1.0)
EMOTICON_WEIGHT, UNKNOWN_WEIGHT, STRESS = 0.3, 0.5, 1.5
NOTICES = (re.compile(r"\|\s*---\s*\|"), re.compile(r"자주\s*묻는|Q1\.|Q2\.", re.I), re.compile(r"운영시간|운영\s*요일|주차구획수|관리기관|월정기권"))
GUIDES = (re.compile(r"총정리|이용\s*방법|영업시간|주차비"), re.compile(r"\*\s+\*\*?\s*(?:위치|주소|요금|전화)"))


def holds(token: str, word: str, v: Feelings) -> bool:
    """The token holds the word where it stands first, and not as a part of the words that are excepted."""
    low = token.lower()
    i = low.find(word.lower())
    if i < 0 or i and low[i - 1] in v.not_after.get(word, ()):
        return False
    return not low[i + len(word) :].startswith(tuple(v.not_before.get(word, ()))) if word in v.not_before else True


def negates(token: str, v: Feelings) -> bool:
    if token in ("안", "못") or len(token) == 2 and token[0] in "안못" and token[1] in "은는도이가만":
        return True
    return len(token) <= 4 and token.startswith(("않", "없")) or len(token) <= 6 and token.startswith("아니") or any(n in token for n in v.negations)


class Tokens(dict):
    """What a token says, worked out once: its positive and negative word, whether it negates, whether it stresses the next. Texts share most of their tokens."""

    MOST = 1 << 18

    def __init__(self, v: Feelings):
        super().__init__()
        self.v = v

    def __missing__(self, t: str) -> tuple[str | None, str | None, bool, bool]:
        v = self.v
        if len(self) >= self.MOST:
            self.clear()
        found = self[t] = (next((w for w in v.positive if holds(t, w, v)), None), next((w for w in v.negative if holds(t, w, v)), None), negates(t, v), any(w in t for w in v.intensifiers))
        return found


def analyze(raw: str, v: Feelings, weights: dict[str, float], known: Tokens | None = None) -> tuple[float, float, float, int]:
    """Relevance, raw sentiment (-1 to 1), score (1 to 5) and number of matches. known: what is known of tokens so far."""
    known = Tokens(v) if known is None else known
    text = LINKS[1].sub(" ", LINKS[0].sub(" ", raw))
    low = text.lower()
    seen = sum(w.lower() in low for w in v.experience)
    relevance = RELEVANCE[3 if seen >= 2 else 2 if seen else 1 if v.topic in low else 0]
    if not relevance:
        return 0.0, 0.0, 3.0, 0
    tokens, at = [], 0
    for m in [*SEPARATORS.finditer(text), None]:
        end = m.start() if m else len(text)
        if end > at:
            tokens.append((text[at:end], at))
        at = m.end() if m else at
    said = [known[t] for t, _ in tokens]
    kinds = [k[:2] for k in said]
    turned: set[int] = set()
    for i, k in enumerate(said):
        if k[2]:
            back = [j for j in range(max(0, i - 2), i) if kinds[j] != (None, None)]
            turned.update(back or range(i + 1, min(i + 3, len(tokens))))
    stressed = {i + 1 for i, k in enumerate(said) if k[3]}
    total = weight = 0.0
    n = 0
    for i, (_, at) in enumerate(tokens):
        if kinds[i] != (None, None) and v.topic in text[max(0, at - NEAR) : at + NEAR]:
            for word, sign in zip(kinds[i], (1, -1), strict=True):
                if word:
                    w = weights.get(word, UNKNOWN_WEIGHT) * (STRESS if i in stressed else 1.0)
                    total += w * (-sign if i in turned else sign)
                    weight += w
                    n += 1
    good, bad = sum(e in text for e in v.emoticons_good), sum(e in text for e in v.emoticons_bad)
    total, weight, n = total + EMOTICON_WEIGHT * (good - bad), weight + EMOTICON_WEIGHT * (good + bad), n + good + bad
    if not n:
        return relevance, 0.0, 3.0, 0
    mean = total / weight
    signs = sum(bool(p.search(text)) for p in NOTICES) + all(p.search(text) for p in GUIDES)
    score = 3.0 + mean * 2.0 * DAMPING.get(n, 1.0) * NOTICE[min(signs, 2)]
    half_up = lambda x, k: (x * k + 0.5) // 1 / k
    return relevance, half_up(mean, 1000), half_up(max(1.0, min(5.0, score)), 100), n


def sentiment(text: Column, vocabulary: Feelings | None = None, weights: dict[str, float] | None = None) -> Column:
    """struct(relevance, raw, score, matches); null texts count as empty."""
    v, idf = vocabulary or Feelings(), dict(weights or {})
    known = Tokens(v)
    kind = pa.struct([("relevance", pa.float64()), ("raw", pa.float64()), ("score", pa.float64()), ("matches", pa.int32())])

    @F.arrow_udf("relevance double, raw double, score double, matches int")
    def of(texts: pa.Array) -> pa.Array:
        parts = [pa.array([], kind)]
        for at in range(0, len(texts), SLICE):  # only the texts of a slice are Python strings at a time
            columns = zip(*[analyze(t or "", v, idf, known) for t in texts.slice(at, SLICE).to_pylist()], strict=True)
            parts.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind)))
        return pa.concat_arrays(parts)

    return of(text)


def text_scores(rows: DataFrame, title: str, content: str, vocabulary: Feelings | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """rows with relevance_score (0-100), sentiment_score (null without matches) and is_positive."""
    s = rows.withColumn("_s", sentiment(F.concat_ws(" ", title, content), vocabulary, weights))
    some = F.col("_s.matches") > 0
    return s.withColumns({"relevance_score": F.floor(F.col("_s.relevance") * 100 + 0.5).cast("int"), "sentiment_score": F.when(some, F.col("_s.score")), "is_positive": F.when(some, F.when(F.col("_s.raw") > 0, 1).when(F.col("_s.raw") < 0, 0))}).drop("_s")


def text_rollup(rows: DataFrame, key: str, text: str, published: str, now: str, vocabulary: Feelings | None = None) -> DataFrame:
    """Per key the mean sentiment of relevant texts, weighted by relevance and age, their number and their effective number."""
    s = rows.select(key, published, sentiment(F.col(text), vocabulary).alias("s")).filter("s.relevance > 0.3")
    w = F.col("s.relevance") * time_decay(F.col(published), F.lit(now).cast("timestamp"))
    out = s.groupBy(key).agg(F.sum(w * F.col("s.score")).alias("_a"), F.sum(w).alias("_b"), F.count("*").alias("count"), F.count_if(F.col("s.relevance") >= 0.7).alias("_n"))
    return out.select(key, clamp(round_half_up(F.col("_a") / F.col("_b")), 1.0, 5.0).alias("score"), "count", round_half_up(F.col("_n") * 0.2).alias("effective_count"))
