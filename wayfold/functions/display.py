"""What readers see of a place: hours, prices, distances, questions and answers, structured data; and search queries for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions import vocab
from wayfold.functions.columns import is_generic_name, region, slug, strip_links, trimmed

SITE = "https://example.org"


def some(c: Column) -> Column:
    """c, null if empty."""
    return F.when(c != "", c)


def number(c: Column) -> Column:
    return F.format_number(c, 0)


def no_hours(start: Column, end: Column) -> Column:
    """No hours, or the whole day, which stands for none."""
    return F.coalesce(start, F.lit("")).isin("") | F.coalesce(end, F.lit("")).isin("") | (trimmed(start).isin("0:00", "00:00") & (trimmed(end) == "24:00"))


def hours_display(weekday: tuple[Column, Column], saturday: tuple[Column, Column], holiday: tuple[Column, Column]) -> Column:
    """primary, secondary (null if there is none) and is_unknown."""
    unknown = no_hours(*weekday) & no_hours(*saturday) & no_hours(*holiday)
    span = lambda label, t: F.concat(F.lit(label), F.coalesce(t[0], F.lit("")), F.lit("-"), F.coalesce(t[1], F.lit("")))
    part = lambda label, t: F.when(~no_hours(*t), span(label, t))
    primary = F.when(unknown, "운영시간 정보 없음").otherwise(span("평일 ", weekday))
    secondary = some(F.concat_ws(" · ", part("토 ", saturday), part("공휴일 ", holiday)))
    return F.struct(primary.alias("primary"), F.when(~unknown, secondary).alias("secondary"), unknown.alias("is_unknown"))


def pricing_display(is_free: Column, base_time: Column, base_fee: Column, extra_time: Column, extra_fee: Column, daily_max: Column) -> Column:
    """primary, secondary (null if there is none) and is_unknown; missing numbers count as 0."""
    base_time, base_fee, extra_time, extra_fee, daily_max = (F.coalesce(c, F.lit(0)) for c in (base_time, base_fee, extra_time, extra_fee, daily_max))
    free = F.coalesce(is_free.cast("boolean"), F.lit(False))
    unknown = ~free & (base_fee <= 0) & (base_time <= 0)
    fee = lambda label, minutes, unit, won: F.concat(F.lit(label), minutes.cast("string"), F.lit(unit), number(won), F.lit("원"))
    extra = F.when((extra_time > 0) & (extra_fee > 0), fee("추가 ", extra_time, "분당 ", extra_fee))
    daily = F.when(daily_max != 0, F.concat(F.lit("1일 최대 "), number(daily_max), F.lit("원")))
    primary = F.when(free, "무료").when(unknown, "요금 정보 없음").otherwise(fee("기본 ", base_time, "분 ", base_fee))
    return F.struct(primary.alias("primary"), F.when(~free & ~unknown, some(F.concat_ws(" · ", extra, daily))).alias("secondary"), unknown.alias("is_unknown"))


def spaces_display(spaces: Column) -> Column:
    return F.when(spaces > 0, F.concat(F.lit("총 "), spaces.cast("string"), F.lit("면")))


def phone_display(phone: Column) -> Column:
    return some(trimmed(phone))


def distance_display(km: Column) -> Column:
    return F.when(km < 1, F.concat(F.floor(km * 1000 + 0.5).cast("string"), F.lit("m"))).otherwise(F.concat(one_decimal(km), F.lit("km")))


#: One digit after the point in SQL, of a number x that is not negative: the nearest tenth by the exact binary value, ties up.
#: 16x + 4x and what its sum rounds away are 20x exactly, and a tenth is reached from the odd numbers of twentieths on.
ONE_DECIMAL = "CAST(floor((floor(16*({x})+4*({x})) + 1) / 2) - CASE WHEN 16*({x})+4*({x}) = floor(16*({x})+4*({x})) AND floor(16*({x})+4*({x})) % 2 = 1 AND (16*({x}) - ((16*({x})+4*({x})) - ((16*({x})+4*({x})) - 16*({x})))) + (4*({x}) - ((16*({x})+4*({x})) - 16*({x}))) < 0 THEN 1 ELSE 0 END AS BIGINT)"


def one_decimal_sql(x: str) -> str:
    tenths = ONE_DECIMAL.replace("{x}", x)
    return f"(({tenths}) // 10 || '.' || ({tenths}) % 10)"


def one_decimal(c: Column) -> Column:
    """One digit after the point: the nearest tenth by the exact binary value, ties up; the sign stands before it."""
    x = F.abs(c.cast("double"))
    a, b = 16 * x, 4 * x
    s = a + b
    lost = (a - (s - (s - a))) + (b - (s - a))
    whole = F.floor(s)
    below = (s == whole) & (whole % 2 == 1) & (lost < 0)
    tenths = F.floor((whole + 1) / 2) - below.cast("long")
    text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), text)


def faq(name: Column, pricing: Column, hours: Column, is_free: Column, score: Column, spaces: Column, nearby: Column, tip_pricing: Column, tip_alternative: Column) -> Column:
    """Up to five pairs of question and answer; pricing and hours as displayed, nearby an array of names, of which three are told."""
    answer = lambda d, sep: F.concat(F.concat_ws(sep, d["primary"], d["secondary"]), F.lit("."))
    s = F.concat(F.lit("쉬움 점수 "), one_decimal(score))
    ease = (
        F.when(score.isNull(), "난이도 정보가 충분하지 않습니다.").when(score >= 4.0, F.concat(s, F.lit("점으로 초보운전자도 편하게 이용할 수 있습니다.")))
        .when(score >= 3.3, F.concat(s, F.lit("점으로 무난한 편이라 초보운전자도 큰 어려움 없이 이용할 수 있습니다."))).when(score >= 2.7, F.concat(s, F.lit("점으로 보통 수준의 주차장입니다.")))
        .when(score >= 2.0, F.concat(s, F.lit("점으로 다소 어려운 편이라 초보운전자는 주의가 필요합니다."))).when(score >= 1.5, F.concat(s, F.lit("점으로 어려운 주차장이라 초보운전자에게는 비추천합니다.")))
        .otherwise(F.concat(s, F.lit("점으로 매우 어려운 주차장입니다. 사전에 경로를 확인하고 신중히 진입하세요.")))
    )
    free = F.coalesce(is_free.cast("boolean"), F.lit(False))
    price = F.coalesce(some(tip_pricing), F.when(~pricing["is_unknown"], F.when(free, "무료 주차장입니다.").otherwise(answer(pricing, ". "))))
    open_ = F.when(hours["is_unknown"], "정확한 운영시간은 방문 전 확인하세요.").otherwise(answer(hours, ", "))
    near = F.when(F.size(nearby) > 0, F.concat(F.lit("인근 주차장으로 "), F.array_join(F.slice(nearby, 1, 3), ", "), F.lit(" 등이 있습니다.")))
    items = [
        (" 주차요금이 얼마인가요?", price), ("은 초보운전자도 이용할 수 있나요?", ease), (" 운영시간이 어떻게 되나요?", open_),
        (" 주차면수는 몇 개인가요?", F.when(spaces > 0, F.concat(spaces_display(spaces), F.lit(" 규모입니다.")))), (" 근처에 다른 주차장도 있나요?", F.coalesce(some(tip_alternative), near)),
    ]
    return F.filter(F.array(*[F.struct(F.concat(name, F.lit(q)).alias("question"), a.alias("answer")) for q, a in items]), lambda i: i["answer"].isNotNull())


def faq_json(items: Column) -> Column:
    """Structured data of a page of questions; null for fewer than three."""
    entity = F.transform(items, lambda i: F.struct(F.lit("Question").alias("@type"), i["question"].alias("name"), F.struct(F.lit("Answer").alias("@type"), i["answer"].alias("text")).alias("acceptedAnswer")))
    return F.when(F.size(items) >= 3, F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("FAQPage").alias("@type"), entity.alias("mainEntity"))))


def place_json(id_: Column, name: Column, address: Column, lat: Column, lng: Column, spaces: Column, phone: Column, is_free: Column, base_time: Column, base_fee: Column, score: Column, reviews: Column, site: str = SITE) -> Column:
    """Structured data of a place; what is unknown is left out."""
    free = F.coalesce(is_free.cast("boolean"), F.lit(False))
    path = F.replace(F.replace(F.url_encode(slug(name, id_)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    fee = F.concat(F.lit("기본 "), F.coalesce(base_time, F.lit(0)).cast("string"), F.lit("분 "), number(F.coalesce(base_fee, F.lit(0))), F.lit("원"))
    rating = F.struct(F.lit("AggregateRating").alias("@type"), one_decimal(score).alias("ratingValue"), F.lit("5").alias("bestRating"), F.lit("1").alias("worstRating"), F.greatest(F.coalesce(reviews, F.lit(0)), F.lit(1)).alias("ratingCount"))
    return F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"), F.array(F.lit("LocalBusiness"), F.lit("ParkingFacility")).alias("@type"), name.alias("name"),
            F.struct(F.lit("PostalAddress").alias("@type"), address.alias("streetAddress"), F.lit("KR").alias("addressCountry")).alias("address"),
            F.struct(F.lit("GeoCoordinates").alias("@type"), lat.alias("latitude"), lng.alias("longitude")).alias("geo"), F.concat(F.lit(f"{site}/wiki/"), path).alias("url"),
            F.when(spaces > 0, spaces).alias("maximumAttendeeCapacity"), some(phone).alias("telephone"), free.alias("isAccessibleForFree"), F.when(~free, fee).alias("priceRange"), F.when(score.isNotNull(), rating).alias("aggregateRating"),
        )
    )


# search queries and texts


def base_name(name: Column) -> Column:
    short = trimmed(F.regexp_replace(F.regexp_replace(name, r"(공영|노외|노상|부설|민영|시영|구영)?\s*주차장$", ""), "주차타워$", ""))
    return F.when(F.length(short) >= 2, short).otherwise(name)


def lot_queries(name: Column, address: Column, poi_tags: Column) -> Column:
    """Array of strategy and query: six for a name of its own (five without a point of interest), the region's for a generic one."""
    area, base = region(address), base_name(name)
    one = lambda strategy, *parts: F.struct(F.lit(strategy).alias("strategy"), trimmed(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).alias("query"))
    poi = F.get(F.from_json(poi_tags, "array<string>"), F.lit(0))
    named = [one("name_region", base, " 주차장 ", area), one("review", base, " 주차 후기"), one("price", base, " 주차 요금"), one("free", base, " 무료주차"), one("hours", base, " 주차 운영시간"), one("poi", poi, " 주차장")]
    own = F.filter(F.array(*named), lambda q: q["query"].isNotNull())
    return F.when(~is_generic_name(name), own).when(area != "", F.array(one("region", area, " 주차장 추천"))).otherwise(F.slice(own, 1, 0))


def crawl_query(name: Column, address: Column) -> Column:
    area = region(address)
    return F.when(~is_generic_name(name), trimmed(F.concat(name, F.lit(" 주차장 "), area))).otherwise(F.concat(area, F.lit(" 주차장 추천")))


def topic_context(text: Column, topic: str = "주차", around: int = 200, most: int = 1500) -> Column:
    """Stretches of `around` characters before and after each start of topic, those that touch as one, joined by ' … ' and cut at most."""
    after = around - len(topic)
    parts = F.split(trimmed(F.regexp_replace(strip_links(text), r"(?U)\s+", " ")), topic)
    between = lambda p: F.when(F.length(p) <= around + after, p).otherwise(F.concat(F.left(p, F.lit(after)), F.lit(" … "), F.right(p, F.lit(around))))
    bound = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # noqa: E731  c is computed once, however often f names it

    def joined(own: Column) -> Column:
        last = F.size(own) - 1
        shown = F.transform(own, lambda p, i: F.when(i == 0, F.right(p, F.lit(around))).when(i == last, F.left(p, F.lit(after))).otherwise(between(p)))
        return F.when(last > 0, F.array_join(shown, topic)).otherwise("")

    cut = lambda t: F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("..."))).otherwise(t)
    return bound(bound(parts, joined), cut)


def chrome(text: Column) -> Column:
    """The name of the first pattern of page frames that a text holds, else null."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(n)) for n, p in vocab.CHROME.items()])
