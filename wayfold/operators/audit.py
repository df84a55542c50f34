"""Audits of what is shown: pages of the site, generated texts, verdicts that a language model gave as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import vocab
from wayfold.functions.columns import any_of, clamp, trimmed, words_of

#: Characters of a summary from which a verdict may pass.
LEAST_SUMMARY = 200
BANDS = [(80, "strong"), (60, "moderate"), (40, "weak")]
LINK = r"(?i)<a\s[^>]*href=[\"']([^\"']*)[\"']"


def page_facts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Title, description, canonical, robots, headings, length of the visible text, links and structured data of each page.

    By patterns on the markup, inside Spark; links are internal if relative or to the page's own host. Null pages count as empty.
    """
    h = F.coalesce(html, F.lit(""))
    tight = lambda c: trimmed(F.regexp_replace(c, r"\s+", " "))
    meta = lambda name: tight(F.regexp_extract(h, rf"(?i)<meta\s[^>]*name=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1))
    body = F.regexp_replace(F.regexp_replace(h, r"(?is)<(script|style|title)[^>]*>.*?</(script|style|title)>", " "), r"<[^>]*>", " ")
    links = F.regexp_extract_all(h, F.lit(LINK), 1)
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-z]+://([^/?#:]*)", 1)
    linked = lambda u: F.regexp_extract(u, r"^[a-z]+://([^/?#:]*)", 1)
    own = F.size(F.filter(links, lambda u: (linked(u) == "") | (linked(u) == host)))
    return pages.withColumns({
        "title": tight(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)), "description": meta("description"), "robots": F.lower(meta("robots")),
        "canonical": F.regexp_extract(h, r"(?i)<link\s[^>]*rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']*)[\"']", 1),
        "h1_count": F.regexp_count(h, F.lit(r"(?i)<h1[\s>]")), "body_length": F.length(tight(body)), "internal_links": own,
        "external_links": F.size(links) - own, "json_ld": F.regexp_count(h, F.lit(r"(?i)application/ld\+json")),
    })


def index_potential(canonical_self: Column, in_sitemap: Column, from_home: Column, status: Column, structured: Column, sources: Column, high_sources: Column, reviews: Column) -> Column:
    """0 to 100 by weights that add up, over the columns of page_facts(); at most 39 for a page that can't be indexed."""
    no_index = F.contains("robots", F.lit("noindex"))
    worth = [
        (10, in_sitemap), (10, from_home), (10, status == 200), (10, ~no_index), (10, canonical_self), (6, F.length("title") >= 12), (6, F.length("description") >= 45), (5, F.col("h1_count") > 0),
        (7, F.col("body_length") >= 900), (5, F.col("body_length") >= 1800), (6, F.col("json_ld") > 0), (3, F.col("internal_links") >= 5), (2, F.col("internal_links") >= 10),
        (5, structured), (5, (sources >= 3) | (reviews >= 1)), (5, (high_sources >= 1) | (sources >= 10)),
    ]
    score = sum([F.when(c, n).otherwise(0) for n, c in worth], F.lit(0))
    return F.when((status == 200) & ~no_index & canonical_self, F.least(score, F.lit(100))).otherwise(F.least(score, F.lit(39)))


def band(score: Column) -> Column:
    out = F.when(score.isNull(), "poor")
    for least, name in BANDS:
        out = out.when(score >= least, name)
    return out.otherwise("poor")


def page_issues(canonical_self: Column, score: Column) -> Column:
    """Array of severity and code of what is wrong with a page of page_facts()."""
    short = lambda c, n: (F.length(c) > 0) & (F.length(c) < n)
    rules = [
        ("error", "META_NOINDEX", F.contains("robots", F.lit("noindex"))), ("error", "CANONICAL_MISSING", F.col("canonical") == ""), ("error", "CANONICAL_MISMATCH", (F.col("canonical") != "") & ~canonical_self),
        ("warning", "TITLE_MISSING", F.col("title") == ""), ("warning", "TITLE_SHORT", short("title", 12)), ("warning", "DESCRIPTION_MISSING", F.col("description") == ""), ("warning", "DESCRIPTION_SHORT", short("description", 35)),
        ("warning", "H1_MISSING", F.col("h1_count") == 0), ("warning", "BODY_TEXT_THIN", F.col("body_length") < 500), ("warning", "INTERNAL_LINKS_LOW", F.col("internal_links") < 5), ("warning", "INDEX_POTENTIAL_LOW", score < 60),
    ]
    all_ = F.array(*[F.struct(F.lit(s).alias("severity"), F.when(c, code).alias("code")) for s, code, c in rules])
    return F.filter(all_, lambda i: i["code"].isNotNull())


# generated texts


def text_verdict(text: Column, name: Column, is_free: Column, start: Column, end: Column, summary: bool = False) -> Column:
    """NA without a text; DROP if it contradicts the place's data, REGEN for templates (summaries: nothing specific), FIX for banned words, else PASS."""
    has = lambda words: any_of([F.contains(text, F.lit(w)) for w in words])
    free = F.coalesce(is_free.cast("boolean"), F.lit(False))
    missing = lambda c: F.coalesce(c, F.lit("")) == ""
    conflict = (~free & (has(["완전 무료"]) | text.rlike(r"무료\s*주차"))) | (free & has(["요금 부담", "비싼 편"])) | (missing(start) & missing(end) & has(["24시간"])) | (~missing(end) & has(["언제든 이용"]))
    out = F.when(text.isNull() | (trimmed(text) == ""), "NA").when(conflict, "DROP").when(has(vocab.TEMPLATES), "REGEN").when(has(vocab.BANNED), "FIX")
    if summary:
        words = F.filter(words_of(trimmed(F.regexp_replace(name, "주차장$", ""))), lambda w: F.length(w) >= 2)
        out = out.when(~F.exists(words, lambda w: F.contains(text, w)) & (F.length(text) < 40), "REGEN")
    return out.otherwise("PASS")


def action(summary: Column, *tips: Column) -> Column:
    """What to do about a place's texts: hide, regenerate, edit, generate_tips or keep, in this precedence."""
    every = F.array(summary, *tips)
    has = lambda v: F.array_contains(every, v)
    no_tips = (summary == "PASS") & F.forall(F.array(*tips), lambda t: t == "NA")
    return F.when(has("DROP"), "hide").when(has("REGEN"), "regenerate").when(has("FIX"), "edit").when(no_tips, "generate_tips").otherwise("keep")


# verdicts as text


def salvaged_object(text: Column) -> Column:
    """The widest stretch of a text in braces if it is a JSON object, else null."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.json_object_keys(found).isNotNull(), found)


def salvaged_list(text: Column) -> Column:
    """The items, as JSON, of the widest stretch of a text in brackets if it is a JSON array, else null."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit("")), "array<string>")


def verdict(text: Column) -> Column:
    """passed, removed_by, keywords, sentiment (1 to 5, 3 if unknown), summary and tips of a model's reply; short summaries don't pass."""
    found = salvaged_object(text)
    get = lambda k: F.get_json_object(found, f"$.{k}")
    summary = F.coalesce(get("summary"), F.lit(""))
    said = ~F.coalesce(get("filter_passed"), F.lit("")).isin("", "false", "0")
    short = F.length(summary) < LEAST_SUMMARY
    removed = F.when(found.isNull(), "ai_error").when(short, "short_summary").when(~said, F.coalesce(get("removed_by"), F.lit("unknown")))
    number = get("sentiment_score").try_cast("double")
    sentiment = F.when(number.isNull() | (number == 0) | F.isnan(number), 3.0).otherwise(clamp(number, 1.0, 5.0))
    keywords = F.coalesce(F.from_json(get("difficulty_keywords"), "array<string>"), F.array().cast("array<string>"))
    tips = [F.nullif(get(k), F.lit("")).alias(k) for k in ("tip_pricing", "tip_visit", "tip_alternative")]
    return F.struct(
        (found.isNotNull() & said & ~short).alias("passed"), removed.alias("removed_by"), keywords.alias("keywords"), sentiment.alias("sentiment"),
        F.when(found.isNull(), "분류 실패").otherwise(summary).alias("summary"), *tips,
    )
