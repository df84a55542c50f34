"""How much a text is about a place: relevance scores, match confidence, rule classes of full texts. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions import vocab
from wayfold.functions.columns import array_of, city, has_specific_identifier, name_keywords, occurrences, province, region, strip_html, trimmed, without_suffix, words_of


def _any_in(words: Column, text: Column) -> Column:
    return F.exists(words, lambda w: F.contains(text, w))


def _base(title: Column, body: Column, name: Column, address: Column) -> dict[str, Column]:
    t, b = F.lower(strip_html(title)), F.lower(strip_html(body))
    both = F.concat_ws(" ", t, b)
    words = F.filter(words_of(F.lower(region(address))), lambda w: F.length(w) >= 2)
    keys, town = name_keywords(name), city(address)
    return {
        "title": t, "body": b, "both": both, "keys": keys, "in_region": F.exists(words, lambda w: F.contains(t, w) | F.contains(b, w)), "in_city": (town != "") & F.contains(both, town),
        "in_title": _any_in(keys, t), "in_body": _any_in(keys, b), "specific": has_specific_identifier(name), "province": province(address),
    }


def _scored(x: dict[str, Column], bonus: Column, extra: Column, thin: Column | None, gate: Column) -> Column:
    """The additive score: region, name in title and body, bonuses; capped without a name, lowered elsewhere in the country."""
    matched = F.when(x["specific"], x["in_title"] | x["in_body"]).otherwise((x["in_title"] | x["in_body"]) & (x["in_region"] | x["in_city"]))
    names = F.when(matched, F.when(x["in_title"], 40).otherwise(0) + F.when(x["in_body"], 20).otherwise(0)).otherwise(0)
    score = F.when(x["in_region"], 20).otherwise(0) + names + extra + bonus
    score = F.when(matched, score).otherwise(F.least(score, F.lit(40)))
    elsewhere = matched & ~x["in_region"] & (x["province"] != "") & ~F.contains(x["both"], x["province"])
    score = F.when(elsewhere, F.greatest(F.lit(0), score - 30)).otherwise(score)
    if thin is not None:
        score = F.when(thin & matched, F.greatest(F.lit(0), score - 10)).otherwise(score)
    return F.when(gate, F.least(F.lit(100), score)).otherwise(0).cast("int")


def blog_relevance(title: Column, description: Column, name: Column, address: Column) -> Column:
    """0 to 100 for a search result."""
    x = _base(title, description, name, address)
    topic = F.contains(x["both"], F.lit("주차"))
    gate = (topic | F.contains(x["both"], F.lit("parking"))) & ~x["both"].rlike("|".join(vocab.NOISE))
    return _scored(x, F.when(topic, 20).otherwise(0), F.lit(0), None, gate)


def full_text_relevance(title: Column, text: Column, name: Column, address: Column) -> Column:
    """0 to 100 for a whole text: mentions count by number, and long texts that hardly name the place lose."""
    x = _base(title, text, name, address)
    topic = occurrences(x["both"], F.lit("주차"))
    gate = ((topic > 0) | F.contains(x["both"], F.lit("parking"))) & ~x["both"].rlike("|".join(vocab.NOISE)) & ~x["body"].rlike("|".join(vocab.FULL_TEXT_NOISE))
    named = F.aggregate(F.transform(x["keys"], lambda k: occurrences(x["body"], k)), F.lit(0), lambda a, n: a + n)
    both = (x["in_title"] | x["in_body"]) & (x["in_region"] | x["in_city"])
    extra = F.when(x["specific"], F.when(named >= 10, 10).when(named >= 3, 5).otherwise(0)).otherwise(F.when(both & (named >= 5), 5).otherwise(0))
    return _scored(x, F.when(topic >= 5, 25).when(topic >= 1, 20).otherwise(0), extra, (F.length(x["body"]) >= 3000) & (named <= 1), gate)


def match_confidence(title: Column, description: Column, name: Column, address: Column) -> Column:
    """score, and none, medium or high."""
    score = blog_relevance(title, description, name, address)
    both = F.lower(F.concat_ws(" ", strip_html(title), strip_html(description)))
    hits = F.filter(name_keywords(name), lambda k: F.contains(both, k))
    best = F.aggregate(hits, F.lit(""), lambda a, k: F.when(F.length(k) > F.length(a), k).otherwise(a))
    topic = F.contains(both, F.lit("주차")) | F.contains(both, F.lit("parking"))
    road = best.rlike("^.+(로|길|번길)$") & ~F.contains(best, F.lit("주차"))
    common = best.rlike("^(" + "|".join(vocab.COMMON_FACILITIES) + ")$")
    beside = name.rlike("[주변옆앞인근]") & ~F.contains(both, trimmed(without_suffix(name)))
    high = (F.length(best) >= 6) & topic & has_specific_identifier(name) & ~road & ~common & ~beside
    return F.struct(score.alias("score"), F.when(score < 40, "none").when(high, "high").otherwise("medium").alias("confidence"))


def rule_class(title: Column, text: Column, status: Column, rules: vocab.Rules | None = None) -> Column:
    """high, medium or low by fixed rules; texts that are missing, short, adverts, offers, notices or news are low."""
    rules = rules or vocab.Rules()
    has = lambda patterns: text.rlike("|".join(patterns)) if patterns else F.lit(False)
    told = F.regexp_count(text, F.lit("|".join(rules.narrative)))
    facts = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit("|".join(rules.concrete)), F.lit(0))))
    low = (status != "ok") | text.isNull() | (text == "") | (F.length(text) < rules.min_length) | has(rules.adverts) | _any_in(array_of([w.lower() for w in rules.low_words]), F.lower(text)) | has(rules.boilerplate) | has(rules.news)
    off = ~F.contains(title, F.lit(rules.topic)) & ((told < 2) | (facts == 0))
    return F.when(F.coalesce(low, F.lit(True)) | off, "low").when((told >= 2) & (facts >= 2), "high").otherwise("medium")


def search_keywords(title: Column, content: Column, stop: list[str], most: int = 5) -> Column:
    """Up to five words of letters and digits, 2 to 15 long, in order, from the title and the start of the content."""
    text = F.substring(F.concat_ws(" ", title, content), 1, 500)
    words = words_of(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", " ")))
    fit = F.filter(words, lambda w: (F.length(w) >= 2) & (F.length(w) <= 15) & ~F.rlike(w, F.lit(r"^\d+$")))
    return F.slice(F.array_distinct(F.array_except(fit, array_of(stop)) if stop else fit), 1, most)


def quality_score(length: Column, relevance: Column, kind_weight: Column, keywords: Column, sentiment: Column, lots_of_url: Column) -> Column:
    """How useful a web text is for a place, 0 to about 0.85, three decimals; texts that many places share lose."""
    penalty = F.when(lots_of_url > 5, F.least(0.03 * (lots_of_url - 5), F.lit(0.2))).otherwise(0.0)
    feeling = F.coalesce(0.05 * F.least(F.abs(sentiment - 3) / 2, F.lit(1.0)), F.lit(0.0))
    total = 0.3 * F.least(length / 2000, F.lit(1.0)) + 0.3 * F.least(relevance / 100, F.lit(1.0)) + 0.1 * kind_weight + 0.1 * F.least(keywords / 5, F.lit(1.0)) + feeling - penalty
    return F.floor(F.greatest(total, F.lit(0.0)) * 1000 + 0.5) / 1000
