"""Column builders: text, dates, numbers, places. All stay inside Spark's own expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions import vocab

KM, M = 6371.0, 6_371_000.0
#: Least and greatest latitude, then longitude, between which a place counts as one of the country.
Box = tuple[float, float, float, float]
KOREA: Box = (33.0, 39.0, 124.0, 132.0)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def array_of(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def trimmed(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words_of(c: Column) -> Column:
    return F.split(c, r"(?U)\s+")


# numbers


def round_half_up(c: Column, digits: int = 2) -> Column:
    """Halves go up, negative ones too, as scores are rounded."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = _haversine(lat1, lng1, lat2, lng2)
    return F.lit(2 * KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return F.lit(2 * M) * F.asin(F.least(F.lit(1.0), F.sqrt(_haversine(lat1, lng1, lat2, lng2))))


def _haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    return half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)


def in_box(lat: Column, lng: Column, box: Box | None) -> Column:
    """Whether a point lies in a box, its edges included; without a box every point does."""
    return F.lit(True) if box is None else lat.between(box[0], box[1]) & lng.between(box[2], box[3])


def in_korea(lat: Column, lng: Column) -> Column:
    return in_box(lat, lng, KOREA)


# dates; `now` is always a parameter


def days_between(earlier: Column, later: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(8.64e10)


def time_decay(published: Column, now: Column) -> Column:
    """0.5 for each 365 days; unknown dates count as a year old, those to come as new."""
    days = days_between(published, now)
    return F.when(published.isNull(), 0.5).when(days < 0, 1.0).otherwise(F.pow(F.lit(0.5), days / 365))


def postdate(c: Column) -> Column:
    """'20240101' as '2024-01-01', null unless of eight characters."""
    return F.when(F.length(c) == 8, F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2)))


def local_time(now: Column, zone: str = "Asia/Seoul") -> tuple[Column, Column]:
    """Day of the week (1: Sunday) and HH:MM in a zone."""
    local = F.from_utc_timestamp(now.cast("timestamp"), zone)
    return F.dayofweek(local), F.date_format(local, "HH:mm")


# text


def strip_html(c: Column) -> Column:
    c = F.regexp_replace(c, "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&nbsp;", " "), ("&#39;", "'")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return trimmed(c)


def strip_links(c: Column) -> Column:
    """Markdown links and images and addresses as a space each."""
    return F.regexp_replace(F.regexp_replace(c, r"!?\[[^\]\n]*\]\([^)\n]*\)", " "), r"https?://\S+", " ")


def region(address: Column) -> Column:
    """The first two parts that name a district, town or road."""
    skip = F.lit("^(" + "|".join(vocab.PROVINCES) + ")")
    parts = F.filter(words_of(address), lambda p: ~F.rlike(p, skip) & ~(p.endswith("시")) & F.rlike(p, F.lit("(구|군|동|읍|면|로|길)$")))
    return F.array_join(F.slice(parts, 1, 2), " ")


def city(address: Column) -> Column:
    found = F.regexp_extract(address, r"(?U)\s(\S+?)(시|군)\s", 1)
    return F.when(found.rlike("특별|광역"), "").otherwise(found)


def province(address: Column) -> Column:
    return F.regexp_extract(address, "^(" + "|".join(vocab.PROVINCES) + ")", 1)


def is_generic_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)\s", "").rlike("|".join(vocab.GENERIC_NAMES))


def without_suffix(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), vocab.NAME_SUFFIX, "")


def has_specific_identifier(name: Column) -> Column:
    c = trimmed(F.regexp_replace(without_suffix(name), "주차$", ""))
    for w in vocab.GENERIC_WORDS:
        c = F.replace(c, F.lit(w), F.lit(""))
    rest = F.array_join(F.filter(words_of(c), lambda w: ~F.rlike(w, F.lit("[시군구동읍면리]$"))), "")
    return F.length(trimmed(rest)) >= 2


def name_keywords(name: Column) -> Column:
    """Distinct keywords of a name, in order: whole, words, as written, up to a place, before a kind, up to a facility, Latin start."""
    bare = without_suffix(name)
    whole = trimmed(bare)
    tight = F.regexp_replace(whole, r"(?U)\s", "")
    some = lambda c, n: F.when(F.length(c) >= n, F.array(c)).otherwise(array_of([]))
    long_enough = lambda c: F.when(F.length(tight) >= 4, some(c, 2)).otherwise(array_of([]))
    parts = [
        some(whole, 2),
        F.filter(words_of(bare), lambda w: F.length(w) >= 2),
        some(F.lower(name), 3),
        some(F.regexp_extract(whole, "^(.+?[동읍면리구])", 1), 2),
        long_enough(F.regexp_extract(tight, "^(.+?)(공영|민영|유료|무료|노상|노외)$", 1)),
        long_enough(F.regexp_extract(tight, "^(.+?(?:" + "|".join(vocab.FACILITIES) + "))", 1)),
        long_enough(F.regexp_extract(tight, "^([a-z]+)", 1)),
    ]
    return F.array_except(F.array_distinct(F.concat(*parts)), array_of(vocab.GENERIC_WORDS))


def occurrences(text: Column, part: Column) -> Column:
    """How often part stands in text, without overlaps."""
    n = F.length(part)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / n).cast("int")).otherwise(0)


def url_hash(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def slug(name: Column, key: Column) -> Column:
    return F.concat_ws("-", F.regexp_replace(F.regexp_replace(trimmed(name), r"(?U)\s+", "-"), r"[/\\?#%&=+]", ""), key)


def slug_id(c: Column) -> Column:
    found = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.coalesce(found(r"((?:KA|NV)-[\d_]+)$"), found(r"(\d{3}-\d+-\d+)$"))


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, 0.8 if one holds the other, else shared characters by the longer name; white space and case aside."""
    tight = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    x, y = tight(a), tight(b)
    shared = F.size(F.filter(F.split(x, ""), lambda ch: (ch != "") & F.contains(y, ch)))
    longer = F.greatest(F.length(x), F.length(y))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.8).otherwise(shared / longer)


def clean_text(c: Column) -> Column:
    """Control characters out, white space as one space."""
    return trimmed(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), r"(?U)\s+", " "))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(c) / 4))


def time_range(c: Column) -> Column:
    """'HH:MM ~ HH:MM' as start and end."""
    pattern = r"(\d{2}:\d{2})\s*~\s*(\d{2}:\d{2})"
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("start"), F.regexp_extract(c, pattern, 2).alias("end")))


def fee_won(c: Column) -> Column:
    """The number of '1,000 원'."""
    return F.replace(F.regexp_extract(c, r"([\d,]+)\s*원", 1), F.lit(","), F.lit("")).try_cast("int")


def number_list(c: Column, kind: str = "array<string>") -> Column:
    """A JSON array; bad or missing ones are empty."""
    return F.coalesce(F.from_json(c, kind), F.array().cast(kind))


def difficulty_label(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= 4.0, "easy").when(score >= 3.3, "decent").when(score >= 2.7, "normal").when(score >= 2.0, "bad").when(score >= 1.5, "very_bad").otherwise("hell")


def reliability_rank(c: Column) -> Column:
    return F.when(c == "confirmed", 4).when(c == "estimated", 3).when(c == "reference", 2).when(c == "structural", 1).otherwise(0)
