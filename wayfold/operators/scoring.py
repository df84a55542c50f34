"""The score of a place: a structural prior blended with reviews and web signals, decayed by age and weighted by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.columns import clamp, round_half_up, time_decay

#: Parameters of the model.
PRIOR_WEIGHT, REVIEW_SHARE, WEB_SHARE, HELL_CAP = 2.5, 0.6, 0.4, 2.9
MECHANICAL, SMALL, LARGE, XLARGE, UNDERGROUND = -0.2, -0.1, 0.05, 0.0, -0.15
SEED, SOURCED, DIRECT = 0.3, 0.6, 3.0
MATCH_FACTORS = {"direct": 1.0, "ai_high": 0.8, "ai_medium": 0.5}
RELEVANT, HIGH, TEXT_WEIGHT = 60, 70, 0.1


def structural_prior(name: Column, notes: Column, total_spaces: Column, kind: Column) -> Column:
    text = F.lower(F.concat_ws(" ", name, F.coalesce(notes, F.lit(""))))
    score = F.lit(3.0) + F.when(F.contains(text, F.lit("기계")), MECHANICAL).otherwise(0.0)
    score = score + F.when(total_spaces < 30, SMALL).otherwise(0.0)
    score = score + F.when(total_spaces > 500, XLARGE).when(total_spaces > 200, LARGE).otherwise(0.0)
    score = score + F.when(F.contains(text, F.lit("지하")), UNDERGROUND).otherwise(0.0)
    return clamp(score, 1.0, 5.0)


def review_weight(is_seed: Column, source_type: Column) -> Column:
    return F.when(is_seed == 1, SEED).when(source_type.isNotNull(), SOURCED).otherwise(DIRECT)


def match_factor(match_type: Column) -> Column:
    out = None
    for k, v in MATCH_FACTORS.items():
        out = (F if out is None else out).when(match_type == k, v)
    return out.otherwise(0.5)


def web_signals(web: DataFrame, ai_matches: DataFrame) -> DataFrame:
    """Signals that passed the filter: those of the place itself, and those matched to it (high and medium confidence only)."""
    passed = web.filter((F.col("filter_passed_v2") == 1) & (F.col("relevance_score") >= RELEVANT))
    own = passed.select("parking_lot_id", "relevance_score", "sentiment_score", "published_at", F.lit("direct").alias("match_type"))
    sure = ai_matches.filter(F.col("confidence").isin("high", "medium")).select("web_source_id", F.col("parking_lot_id").alias("lot"), F.concat(F.lit("ai_"), "confidence").alias("match_type"))
    matched = passed.join(sure, passed["id"] == sure["web_source_id"]).filter(F.col("parking_lot_id").isNull() | (F.col("parking_lot_id") != F.col("lot")))
    return own.unionByName(matched.select(F.col("lot").alias("parking_lot_id"), "relevance_score", "sentiment_score", "published_at", "match_type"))


def review_scores(reviews: DataFrame, now: Column) -> DataFrame:
    """One row per place: decayed and weighted mean, number, and undecayed weight."""
    w = review_weight(F.col("is_seed"), F.col("source_type"))
    wd = w * time_decay(F.col("created_at"), now)
    return reviews.groupBy("parking_lot_id").agg(
        round_half_up(F.sum(wd * F.col("overall_score")) / F.nullif(F.sum(wd), F.lit(0.0))).alias("review_score"), F.count("*").alias("review_count"), F.sum(w).alias("review_effective")
    )


def web_scores(signals: DataFrame, now: Column) -> DataFrame:
    """One row per place. The weight of a high signal depends on their number, which factors out of the sum: one pass is enough."""
    own = signals.filter((F.col("relevance_score") >= RELEVANT) & F.col("sentiment_score").isNotNull())
    factor = match_factor(F.col("match_type"))
    w = F.col("relevance_score") / 100 * factor * time_decay(F.col("published_at"), now)
    high = F.col("relevance_score") >= HIGH
    out = own.groupBy("parking_lot_id").agg(
        round_half_up(F.sum(w * F.col("sentiment_score")) / F.nullif(F.sum(w), F.lit(0.0))).alias("web_score"), F.count("*").alias("web_count"),
        F.count_if(high).alias("n_high"), F.sum(F.when(high, factor).otherwise(0.0)).alias("high_factor"),
    )
    return out.withColumn("web_effective", F.when(F.col("n_high") == 0, 0.0).otherwise(F.least(F.lit(TEXT_WEIGHT), 1 / F.col("n_high")) * F.col("high_factor"))).drop("n_high", "high_factor")


def final_score(prior: Column, review: Column, web: Column, n: Column, review_count: Column) -> tuple[Column, Column]:
    """The blended score, rounded, and how reliable it is."""
    none = review.isNull() & web.isNull()
    shares = F.when(review.isNotNull(), REVIEW_SHARE).otherwise(0.0) + F.when(web.isNotNull(), WEB_SHARE).otherwise(0.0)
    raw = F.coalesce(REVIEW_SHARE / shares * review, F.lit(0.0)) + F.coalesce(WEB_SHARE / shares * web, F.lit(0.0))
    blended = (PRIOR_WEIGHT * prior + n * raw) / (PRIOR_WEIGHT + n)
    floored = F.when((n < 1) & (review_count == 0), F.greatest(blended, prior)).otherwise(blended)
    score = F.when(none, round_half_up(prior)).otherwise(clamp(round_half_up(floored), 1.0, 5.0))
    label = F.when(none, F.when(prior != 3.0, "structural").otherwise("none")).when(n >= 5, "confirmed").when(n >= 1, "estimated").when(n > 0, "reference").otherwise("structural")
    return score, label


def recompute(lots: DataFrame, reviews: DataFrame, web: DataFrame, ai_matches: DataFrame, now: str, only: DataFrame | None = None) -> DataFrame:
    """Scores of all places, or of those whose id is in `only` (parking_lot_id): the incremental form gives the same rows.

    Signals are summed per place before they meet the places, so nothing but sums is joined.
    """
    at, signals = F.lit(now).cast("timestamp"), web_signals(web, ai_matches)
    if only is not None:
        ids = only.select("parking_lot_id").distinct()
        lots = lots.join(ids.withColumnRenamed("parking_lot_id", "id"), "id", "left_semi")
        reviews, signals = (df.join(ids, "parking_lot_id", "left_semi") for df in (reviews, signals))
    rows = lots.select(F.col("id").alias("parking_lot_id"), structural_prior(F.col("name"), F.col("notes"), F.col("total_spaces"), F.col("type")).alias("prior"), "curation_tag")
    rows = rows.join(review_scores(reviews, at), "parking_lot_id", "left").join(web_scores(signals, at), "parking_lot_id", "left")
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    n = round_half_up(zero("review_effective", 0.0) + zero("web_effective", 0.0))
    rows = rows.withColumns({"n_effective": n, "review_count": zero("review_count", 0).cast("long"), "web_count": zero("web_count", 0).cast("long")})
    score, label = final_score(F.col("prior"), F.col("review_score"), F.col("web_score"), F.col("n_effective"), F.col("review_count"))
    capped = F.when(F.col("curation_tag") == "hell", F.least(score, F.lit(HELL_CAP))).otherwise(score)
    return rows.select("parking_lot_id", round_half_up(F.col("prior")).alias("structural_prior"), "review_score", "review_count", "web_score", "web_count", "n_effective", capped.alias("final_score"), label.alias("reliability"))
