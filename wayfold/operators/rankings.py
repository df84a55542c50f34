"""Rankings, pages, top rows per group and summaries of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions.columns import reliability_rank
from wayfold.operators.places import with_scores
from wayfold.sources.files import running_total


def top_per_group(rows: DataFrame, keys: list[str], order: list, n: int, name: str = "rn") -> DataFrame:
    """The first n rows of each group; Spark keeps no more than n of a group in each task before the shuffle."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)


def best_per_group(rows: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """The whole row of the highest score (a struct compares field by field), summed up within tasks before the shuffle."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), score).alias("_best")).select(*keys, "_best.*")


def diverse(rows: DataFrame, keys: list[str], kind: str, order: list, n: int) -> DataFrame:
    """n rows of each group: first the best of different kinds up to half of n, then the best of the rest."""
    own = W.partitionBy(*keys)
    rows = rows.withColumn("_in_kind", F.row_number().over(W.partitionBy(*keys, kind).orderBy(*order)))
    firsts = F.when(F.col("_in_kind") == 1, 0).otherwise(1)
    rows = rows.withColumn("_first", F.row_number().over(own.orderBy(firsts, *order)))
    chosen = (F.col("_in_kind") == 1) & (F.col("_first") <= (n + 1) // 2)
    rows = rows.withColumn("_at", F.row_number().over(own.orderBy(F.when(chosen, 0).otherwise(1), *order)))
    return rows.filter(F.col("_at") <= n).drop("_in_kind", "_first", "_at")


def page(rows: DataFrame, order: list, number: int, size: int = 100) -> DataFrame:
    """A page (from 1; lower numbers are 1) and the number of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    own = rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)
    return own.join(F.broadcast(total))  # one row


def site_stats(lots: DataFrame, reviews: DataFrame, web: DataFrame, media: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(lots, "lots").join(one(reviews, "reviews")).join(one(web.filter("filter_passed_v2 = 1"), "w")).join(one(media, "m"))  # a row each
    return out.select("lots", "reviews", (F.col("w") + F.col("m")).alias("posts"))


def tab_counts(lots: DataFrame, reviews: DataFrame, web: DataFrame, media: DataFrame) -> DataFrame:
    """Three counts a place: all rows are counted in one pass over their union, so each place is joined once."""
    kinds = {"reviews": reviews, "posts": web.filter("relevance_score >= 40"), "media": media}
    every = None
    for k, df in kinds.items():
        own = df.select("parking_lot_id", F.lit(k).alias("kind"))
        every = own if every is None else every.unionByName(own)
    counts = every.groupBy("parking_lot_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    return lots.select("id").join(counts, F.col("id") == F.col("parking_lot_id"), "left").select("id", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


def posts(web: DataFrame, lot: str, boost: Column, offset: int = 0, limit: int = 10, least: int = 40) -> DataFrame:
    rows = web.filter((F.col("parking_lot_id") == lot) & (F.col("relevance_score") >= least)).withColumn("boost", boost)
    return rows.orderBy(F.desc(F.col("relevance_score") + F.col("boost")), F.desc_nulls_last("published_at"), "id").offset(offset).limit(limit).select("id", "relevance_score", "published_at", "boost")


def reviews_of(reviews: DataFrame, lot: str, limit: int = 20) -> DataFrame:
    author = F.coalesce(F.col("source_type"), F.when(F.col("is_seed") == 1, "익명").otherwise("사용자"))
    return reviews.filter(F.col("parking_lot_id") == lot).withColumn("author", author).orderBy(F.desc("created_at"), "id").limit(limit)


def region_summary(lots: DataFrame, regions: list[str]) -> DataFrame:
    """A row per region that has places. Regions are a short list, so an address is held against each without a join."""
    found = F.explode(F.filter(F.array(*[F.lit(r) for r in regions]), lambda r: F.contains(F.col("address"), r)))
    rows = lots.withColumn("region", found)
    return rows.groupBy("region").agg(F.count("*").alias("total"), F.count_if(F.col("is_free") == 1).alias("free"), F.round(F.avg(F.when(F.col("total_spaces") > 0, F.col("total_spaces")))).cast("long").alias("spaces"))


def home(lots: DataFrame, stats: DataFrame, reviews: DataFrame, n: int) -> DataFrame:
    """Five rankings. One pass over the scored places gives four of them: a place stands once per ranking that takes it."""
    scored = with_scores(lots, stats)
    last = reviews.groupBy("parking_lot_id").agg(F.max("created_at").alias("last"))
    rows = scored.join(last, F.col("id") == F.col("parking_lot_id"), "left").drop("parking_lot_id")
    when = lambda c, name, key: F.when(c, F.struct(F.lit(name).alias("ranking"), key.cast("double").alias("key")))
    kinds = F.array_compact(F.array(
        when(F.col("total_spaces") > 0, "spacious", F.col("total_spaces")), when(F.col("avg_score") >= 3.3, "easy", F.col("avg_score")), when(F.col("is_free") == 1, "free", F.col("total_spaces")),
        when(F.col("review_count") > 0, "popular", F.col("review_count")), when(F.col("last").isNotNull(), "recent", F.unix_micros(F.col("last").cast("timestamp"))),
    ))
    each = rows.select("id", F.explode(kinds).alias("k")).select("id", "k.*")
    return top_per_group(each, ["ranking"], [F.desc_nulls_last("key"), "id"], n, "place").select("ranking", "place", "id")


def quartiles(stats: DataFrame) -> DataFrame:
    """The quarter of each place by score, ties by id. Ranks are exact and counted over ranges of (score, id), however many places share a score."""
    rows = stats.withColumn("_key", F.struct(F.coalesce("final_score", F.lit(0.0)).alias("score"), F.col("parking_lot_id").alias("id")))
    total = rows.agg(F.count("*").alias("_all"))
    rows = running_total(rows, "_key", F.lit(1), "_upto").join(F.broadcast(total))  # one row
    at, small, more = F.col("_upto") - 1, F.floor(F.col("_all") / 4), F.col("_all") % 4
    edge = more * (small + 1)
    tile = F.when(at < edge, F.floor(at / (small + 1))).otherwise(more + F.floor((at - edge) / F.greatest(small, F.lit(1))))
    return rows.withColumn("quartile", (tile + 1).cast("int")).drop("_key", "_upto", "_all")


def priority(lots: DataFrame, stats: DataFrame, web: DataFrame, n: int) -> DataFrame:
    counts = web.filter("filter_passed_v2 = 1").groupBy("parking_lot_id").agg(F.count("*").alias("web"))
    rows = lots.select("id", "total_spaces").join(stats.select(F.col("parking_lot_id").alias("id"), "review_count", "reliability"), "id").join(counts.withColumnRenamed("parking_lot_id", "id"), "id", "left")
    return rows.orderBy(F.desc(reliability_rank(F.col("reliability"))), F.desc("review_count"), F.desc(F.coalesce("web", F.lit(0))), F.desc_nulls_last("total_spaces"), "id").limit(n).select("id")
