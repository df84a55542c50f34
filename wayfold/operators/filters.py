"""Which texts are kept and why not: tiers, reasons of low classes, a strict filter, an evaluator by experience, checks of search results.

Column expressions; null texts, titles and names are empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import vocab
from wayfold.functions.columns import KOREA, Box, any_of, clamp, in_box, occurrences, strip_html, trimmed, words_of
from wayfold.operators.cascade import place_core
from wayfold.operators.relevance import blog_relevance, rule_class


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _one_of(patterns: list[str]) -> str:
    return "|".join(patterns)


def mentions(name: Column, text: Column) -> Column:
    """How often a text names a place: without its kind where three characters are left."""
    core = place_core(_text(name))
    return occurrences(_text(text), F.when(F.length(core) >= 3, core).otherwise(_text(name)))


def tier(relevance: Column, text: Column, name: Column) -> Column:
    """tier (high, medium, none) and the reason of none."""
    t = _text(text)
    named, told = mentions(name, t), F.regexp_count(t, F.lit(_one_of(vocab.NARRATIVE)))
    reasons = {
        "ad": t.rlike(_one_of(vocab.ADVERTS)),
        "irrelevant": relevance == 0,
        "low_relevance": relevance < 35,
        "too_short": F.length(t) < 500,
        "boilerplate": t.rlike(_one_of(vocab.TIER_TEMPLATES)),
        "news": t.rlike(_one_of(vocab.OFFICIAL)),
        "wrong_lot": (named == 0) & (relevance < 60),
        "thin": (told == 0) & ((named <= 1) | (relevance < 80)) | (told <= 1) & (named == 0),
    }
    reason = _first(reasons)
    high = (named >= 2) & (told >= 2) & t.rlike(_one_of(vocab.DESCRIBED))
    return F.struct(F.when(reason.isNotNull(), "none").when(high, "high").otherwise("medium").alias("tier"), reason.alias("reason"))


def _first(reasons: dict[str, Column]) -> Column:
    """The first reason that holds, or null."""
    return F.coalesce(*[F.when(c, name) for name, c in reasons.items()])


def low_reason(text: Column) -> Column:
    """Why the fixed rules call a text low; null if they do not."""
    t = _text(text)
    has = lambda words: any_of([F.contains(F.lower(t), F.lit(w)) for w in words])
    reasons = {
        "too_short": F.length(t) < 500,
        "ad": t.rlike(_one_of(vocab.ADVERTS)),
        "realestate": has(vocab.REAL_ESTATE),
        "event": has(vocab.EVENTS),
        "boilerplate": t.rlike(_one_of(vocab.BOILERPLATE + vocab.DIRECTORY)),
        "news": t.rlike(_one_of(vocab.OFFICIAL + vocab.PRESS)),
        "app_fragment": has(vocab.APP_PARTS),
    }
    return F.when(rule_class(F.lit(""), t, F.lit("ok")) == "low", F.coalesce(_first(reasons), F.lit("thin")))


def strict_filter(title: Column, text: Column) -> Column:
    """passed and removed_by: facts, opinions of use and precise tips pass at once; what no reason removes passes too."""
    t = F.concat_ws("\n", _text(title), _text(text))
    has = t.rlike
    facts = any_of([has(p) for p in (vocab.STRICT_PLACE, vocab.STRICT_HOURS, vocab.STRICT_PRICE, vocab.STRICT_SPACES)])
    passes = facts | has(vocab.STRICT_USE) & has(vocab.STRICT_OPINION) | has(vocab.STRICT_TIP) & has(vocab.STRICT_DETAIL)
    reason = _first({
        "thin": has(vocab.STRICT_BRIEF) & (F.length(t) < 80),
        "boilerplate": has(vocab.STRICT_LIST) & ~has(vocab.STRICT_FACTS),
        "ad": has(vocab.STRICT_ADVERT),
        "realestate": has(vocab.STRICT_ESTATE) & ~has(vocab.STRICT_EXPERIENCE),
        "news": has(vocab.STRICT_NEWS) & ~has(vocab.STRICT_READERS),
        "irrelevant": ~has(vocab.STRICT_TOPIC),
    })
    removed = F.when(~passes, reason)
    return F.struct(removed.isNull().alias("passed"), removed.alias("removed_by"))


def by_experience(title: Column, text: Column) -> Column:
    """passed, removed_by and a score of 1, 3 or 5, from the first 2,000 characters, which is the rule itself."""
    title, t = _text(title), F.left(_text(text), F.lit(2000))
    both = F.concat_ws(" ", t, title)
    head, has = F.left(both, F.lit(1000)), t.rlike
    topics = F.regexp_count(t, F.lit(vocab.TOPIC_WORDS)) + F.regexp_count(title, F.lit(vocab.TOPIC_WORDS))
    lived = has(vocab.PERSONAL) & any_of([has(p) for p in vocab.DETAILS])
    guide = F.left(t, F.lit(1000)).rlike(vocab.GUIDE) & ~has(vocab.SPONSORED)
    for p in vocab.GUIDE_FACTS:
        guide = guide & has(p)
    thin = (F.regexp_count(both, F.lit(r"[.!?]")) < 3) | (F.regexp_count(t, F.lit(vocab.TOPIC_LINES)) < 2)
    reason = F.coalesce(_first({
        "ad": both.rlike(vocab.PAID),
        "realestate": head.rlike(vocab.ESTATE),
        "news": head.rlike(vocab.BULLETIN),
        "thin": thin,
        "boilerplate": both.rlike(vocab.LISTING) & ~both.rlike(vocab.LISTING_EXCUSE),
    }), F.lit("thin"))
    removed = F.when(topics < 2, "irrelevant").when(~(lived | guide), reason)
    good, bad = has(vocab.PLEASED), has(vocab.ANNOYED)
    score = F.when((topics >= 2) & lived & good & ~bad, 5).when((topics >= 2) & lived & bad & ~good, 1).otherwise(3)
    return F.struct(removed.isNull().alias("passed"), removed.alias("removed_by"), score.alias("score"))


def comment_relevance(text: Column, name: Column) -> Column:
    """0 to 100 for a comment on a video."""
    t = F.lower(_text(text))
    has = lambda words: any_of([F.contains(t, F.lit(w)) for w in words])
    names = F.filter(words_of(F.regexp_replace(_text(name), "주차장|주차", "")), lambda w: F.length(w) >= 2)
    points = lambda c, n: F.when(c, n).otherwise(0)
    named = F.exists(names, lambda w: F.contains(t, F.lower(w)))
    return clamp(points(has(vocab.COMMENT_TOPIC), 30) + points(has(vocab.COMMENT_HARD), 40) + points(has(vocab.COMMENT_GOOD), 20) + points(named, 20) - points(F.length(_text(text)) < 10, 20), 0, 100).cast("int")


def checked_result(name: Column, location: Column, title: Column, category: Column, lat: Column, lng: Column, address: Column, box: Box | None = KOREA) -> Column:
    """valid, confidence and reason of a search result for a name: its kind, coordinates, region and words, in this order.

    Coordinates outside the box are a reason, without a box only missing ones.
    """
    title, address, location = strip_html(_text(title)), _text(address), _text(location)
    parts = F.filter(words_of(location), lambda w: F.length(w) >= 2)
    narrow = F.filter(parts, lambda w: ~w.isin(vocab.PROVINCES))
    within = lambda a: F.exists(a, lambda w: F.contains(address, w))
    known = ~location.isin(vocab.UNKNOWN_PLACES)
    words = F.filter(words_of(trimmed(F.regexp_replace(_text(name), vocab.RESULT_KINDS, ""))), lambda w: F.length(w) >= 2)
    hits = F.filter(words, lambda w: F.contains(F.lower(title), F.lower(w)))
    share = F.size(hits) / F.nullif(F.size(words), F.lit(0))
    high, medium = share >= 0.8, (share >= 0.5) & (F.size(words) <= 2)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    reason = F.coalesce(
        F.when(~F.contains(_text(category), F.lit("주차")) & ~F.contains(title, F.lit("주차")), "주차 카테고리/이름 아님"),
        F.when(lat.isNull() | lng.isNull(), "좌표 없음"),
        F.when(~in_box(lat, lng, box), "좌표 범위 밖"),
        F.when(known & (F.size(narrow) > 0) & ~within(narrow), F.concat(F.lit("지역 불일치: "), quoted(location), F.lit(" → "), quoted(F.array_join(narrow, ",")), F.lit(" not in "), quoted(address))),
        F.when(known & (F.size(narrow) == 0) & ~within(parts), F.concat(F.lit("지역 불일치: "), quoted(location), F.lit(" vs "), quoted(address))),
        F.when(F.size(words) == 0, "키워드 추출 실패"),
        F.when(~(high | medium), F.concat(F.lit("키워드 불일치 ("), F.array_join(hits, ","), F.lit("/"), F.array_join(words, ","), F.lit(")"))),
        F.lit(""),
    )
    return F.struct((reason == "").alias("valid"), F.when((reason == "") & high, "high").otherwise("medium").alias("confidence"), reason.alias("reason"))


def already_known(rows: DataFrame, key: str, lots: DataFrame, degrees: float = 0.002) -> DataFrame:
    """Rows (key, name, lat, lng) and in known the least id of a place of that name within so many degrees both ways, or null."""
    own = lots.select("name", F.col("id").alias("known"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    near = (F.abs(F.col("_lat") - F.col("lat")) < degrees) & (F.abs(F.col("_lng") - F.col("lng")) < degrees)
    found = rows.join(own, "name").filter(near).groupBy(key).agg(F.min("known").alias("known"))
    return rows.join(found, key, "left")


def name_prefixes(name: Column) -> Column:
    """The name without its kind, and its first four characters; of names of a kind alone, their first four characters."""
    core = place_core(name)
    short = F.left(F.regexp_replace(name, r"(?U)\s", ""), F.lit(4))
    each = F.when(F.length(core) >= 4, F.array(core, F.left(core, F.lit(4)))).when(F.length(core) >= 2, F.array(core)).otherwise(F.array(short))
    return F.array_distinct(F.filter(each, lambda w: F.length(w) >= 2))


def name_hit_rate(rows: DataFrame, title: Column, content: Column, name: Column) -> DataFrame:
    """One row: matched texts, those with the name in title and content, and the share with it in either (0 without texts)."""
    within = lambda c: F.exists(name_prefixes(name), lambda w: F.contains(F.lower(_text(c)), F.lower(w)))
    each = rows.select(within(title).alias("_title"), within(content).alias("_content"))
    counts = each.agg(F.count("*").alias("texts"), F.count_if("_title").alias("in_title"), F.count_if("_content").alias("in_content"), F.count_if(F.col("_title") | F.col("_content")).alias("_either"))
    return counts.select("texts", "in_title", "in_content", F.coalesce(F.col("_either") / F.nullif("texts", F.lit(0)), F.lit(0.0)).alias("rate"))


def within_size(items: Column, least: int, most: int) -> Column:
    """Whether an array has from least to most items."""
    return F.size(items).between(least, most)


def voter(user: Column, anonymous: Column) -> Column:
    """The user, else an anonymous id of the known form, else null."""
    return F.coalesce(F.nullif(user, F.lit("")), F.when(anonymous.startswith("anon_"), anonymous))


def resolved(missed: DataFrame, outcomes: DataFrame, key: str, now: Column) -> DataFrame:
    """Rows of missed names with status, place and time of their outcome (key, status, lot); others stay as they are."""
    out = outcomes.select(key, F.col("status").alias("_status"), F.col("lot").alias("_lot")).dropDuplicates([key])
    rows, done = missed.join(out, key, "left"), F.col("_status").isNotNull()
    new = {"resolution_status": F.col("_status"), "resolved_parking_lot_id": F.col("_lot"), "resolved_at": now}
    return rows.withColumns({c: F.when(done, v).otherwise(F.col(c)) for c, v in new.items()}).drop("_status", "_lot")


def relinked(missed: DataFrame, lots: DataFrame, least: int = 40) -> DataFrame:
    """New web rows of names resolved to a place, where the text is relevant to it; they go through merge.insert_ignore."""
    own = lots.select(F.col("id").alias("resolved_parking_lot_id"), F.col("name").alias("_name"), F.col("address").alias("_address"))
    rows = missed.filter("resolution_status = 'resolved_existing_lot'").join(own, "resolved_parking_lot_id")
    score = blog_relevance(F.col("title"), F.col("content"), F.col("_name"), F.col("_address"))
    link = F.concat_ws(":", "source_id", "resolved_parking_lot_id")
    rows = rows.withColumn("relevance_score", score).filter(F.col("relevance_score") >= least)
    return rows.select(F.col("resolved_parking_lot_id").alias("parking_lot_id"), "source", link.alias("source_id"), strip_html(F.col("title")).alias("title"), strip_html(F.col("content")).alias("content"), "relevance_score")


def taken_over(lots: DataFrame, matches: DataFrame, columns: list[str], now: Column, blank: tuple[str, ...] = ()) -> DataFrame:
    """Places with columns of their matched public record (id and columns): all are overwritten, nulls included.

    Columns in blank take an empty string for null. Places without a record stay as they are.
    """
    own = matches.dropDuplicates(["id"]).select("id", F.lit(True).alias("_found"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    new = {c: F.coalesce(f"_new_{c}", F.lit("")) if c in blank else F.col(f"_new_{c}") for c in columns}
    new |= {"verified_source": F.lit("public_api"), "verified_at": now}
    have = {c: F.col(c) if c in lots.columns else F.lit(None) for c in new}
    rows = lots.join(own, "id", "left")
    return rows.withColumns({c: F.when(F.col("_found"), v).otherwise(have[c]) for c, v in new.items()}).drop("_found", *[f"_new_{c}" for c in columns])
