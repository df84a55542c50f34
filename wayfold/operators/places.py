"""Reading places: viewport and nearest-neighbour search, filters, text search, details."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.columns import any_of, local_time

#: Bounds of the difficulty classes, from easiest to hardest (low included, high excluded).
BANDS = [(4.0, None), (3.3, 4.0), (2.7, 3.3), (2.0, 2.7), (1.5, 2.0), (1.0, 1.5)]


def with_scores(lots: DataFrame, stats: DataFrame) -> DataFrame:
    """Places with their score, number of reviews and reliability; places without any keep null and 0."""
    own = stats.select(F.col("parking_lot_id").alias("_lot"), F.col("final_score").alias("avg_score"), "review_count", "reliability")
    return lots.join(own, lots["id"] == F.col("_lot"), "left").drop("_lot").withColumn("review_count", F.coalesce("review_count", F.lit(0)))


def in_bounds(south: float, north: float, west: float, east: float) -> Column:
    return F.col("lat").between(south, north) & F.col("lng").between(west, east)


def difficulty(score: Column, wanted: list[bool]) -> Column:
    """Classes that are wanted, joined by or. All: no condition; none: nothing; unknown scores go as soon as a class is left out."""
    if all(wanted):
        return F.lit(True)
    own = [score >= low if high is None else (score >= low) & (score < high) for on, (low, high) in zip(wanted, BANDS, strict=True) if on]
    return any_of(own) if own else F.lit(False)


def difficulty_of_points(score: Column, wanted: list[bool]) -> Column:
    """The same for points on the map: unknown scores stay, and scores below 1 belong to the hardest class."""
    own = [score >= low if high is None else (score >= low if i < 5 else F.lit(True)) & (score < high) for i, (on, (low, high)) in enumerate(zip(wanted, BANDS, strict=True)) if on]
    return score.isNull() | (any_of(own) if own else F.lit(False))


def fee_at_most(cap: int) -> Column:
    """Free, without a fee, or at most cap an hour (the hourly fee is cut to a whole number)."""
    hourly = (F.col("base_fee") * 60.0 / F.col("base_time")).cast("int")
    return (F.col("is_free") == 1) | F.col("base_fee").isNull() | (F.col("base_fee") == 0) | F.coalesce((F.col("base_time") > 0) & (hourly <= cap), F.lit(False))


def open_at(now: Column, days: dict[str, tuple[str, str]] | None = None) -> Column:
    """Open at a time (UTC). days: columns of start and end for 'weekday', 'saturday' and 'sunday'; an end of 00:00 is midnight."""
    day, t = local_time(now)
    days = days or dict.fromkeys(("weekday", "saturday", "sunday"), ("weekday_start", "weekday_end"))
    pick = lambda i: F.when(day == 7, F.col(days["saturday"][i])).when(day == 1, F.col(days["sunday"][i])).otherwise(F.col(days["weekday"][i]))
    s, e = pick(0), pick(1)
    return F.coalesce((s != "") & ((e == "00:00") | ((s <= e) & (s <= t) & (e > t)) | ((s > e) & ((s <= t) | (e > t)))), F.lit(False))


def is_public(key: Column) -> Column:
    return ~key.startswith("KA-") & ~key.startswith("NV-")


def matches_all_words(text: str, columns: list[str]) -> Column:
    """Every word of text is in one of the columns, case aside."""
    one = lambda w: any_of([F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(w.lower())) for c in columns])
    return reduce(lambda a, b: a & b, [one(w) for w in text.split()], F.lit(True))


def lots_in_bounds(lots: DataFrame, stats: DataFrame, bounds: tuple[float, float, float, float], limit: int = 200, conditions: list[Column] | None = None) -> DataFrame:
    rows = with_scores(lots.filter(in_bounds(*bounds)), stats)
    for c in conditions or []:
        rows = rows.filter(c)
    return rows.orderBy("id").limit(limit)


def search(lots: DataFrame, stats: DataFrame, text: str, limit: int = 20) -> DataFrame:
    return with_scores(lots.filter(matches_all_words(text, ["name", "address"])), stats).orderBy("id").limit(limit)


def nearby(lots: DataFrame, lat: float, lng: float, exclude: str, limit: int = 5, reach: float = 0.01) -> DataFrame:
    """Nearest by the sum of degrees within a square."""
    rows = lots.filter(in_bounds(lat - reach, lat + reach, lng - reach, lng + reach) & (F.col("id") != exclude))
    return rows.withColumn("distance", F.abs(F.col("lat") - lat) + F.abs(F.col("lng") - lng)).orderBy("distance", "id").limit(limit)


def related(lots: DataFrame, stats: DataFrame, web: DataFrame, lat: float, lng: float, exclude: str, limit: int = 8, reach: float = 0.04) -> DataFrame:
    """Nearest by squared degrees within a square; ties go to more web signals, then more reviews."""
    near = lots.filter(in_bounds(lat - reach, lat + reach, lng - reach, lng + reach) & (F.col("id") != exclude))
    counts = web.groupBy("parking_lot_id").agg(F.count("*").alias("web_sources"))
    rows = with_scores(near, stats).join(counts, F.col("id") == counts["parking_lot_id"], "left").drop("parking_lot_id").withColumn("web_sources", F.coalesce("web_sources", F.lit(0)))
    d = (F.col("lat") - lat) * (F.col("lat") - lat) + (F.col("lng") - lng) * (F.col("lng") - lng)
    return rows.withColumn("distance", d).orderBy("distance", F.desc("web_sources"), F.desc("review_count"), "id").limit(limit)


def within_metres(lots: DataFrame, lat: float, lng: float, metres: float = 3000, limit: int = 10) -> DataFrame:
    """Nearest on a plane of 111 km a degree of latitude and 88 km a degree of longitude."""
    y, x = metres / 111_000, metres / 88_000
    rows = lots.filter(in_bounds(lat - y, lat + y, lng - x, lng + x))
    d = F.sqrt(F.pow((F.col("lat") - lat) * 111_000, F.lit(2.0)) + F.pow((F.col("lng") - lng) * 88_000, F.lit(2.0)))
    return rows.withColumn("metres", F.round(d).cast("long")).orderBy("metres", "id").limit(limit)


def detail(lots: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """One place as nested structs; ids of over 64 characters find nothing."""
    rows = with_scores(lots.filter(F.lit(len(key) <= 64) & (F.col("id") == key)), stats)
    return rows.select(
        "id", "name", "type", "address", "lat", "lng", "total_spaces",
        F.struct(F.col("weekday_start").alias("start"), F.col("weekday_end").alias("end")).alias("weekday"),
        F.struct((F.col("is_free") == 1).alias("is_free"), F.coalesce("base_time", F.lit(0)).alias("base_time"), F.coalesce("base_fee", F.lit(0)).alias("base_fee")).alias("pricing"),
        F.struct(F.col("avg_score").alias("score"), "review_count", "reliability").alias("difficulty"), "notes", "curation_tag",
    )
