"""Reports, reviews under limits, and the queues and lists of the administration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_targets(reports: DataFrame, targets: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Reports with the title of what they are about; targets: by type, rows with an id, and their title.

    Each type is a left join on id and type, so it stays a hash join; a report whose target is gone has no title.
    """
    titles = []
    for kind, (rows, title) in targets.items():
        own = rows.select(F.col("id").alias(f"_{kind}"), title.alias(f"_title_{kind}"))
        reports = reports.join(own, (F.col("target_type") == kind) & (F.col("target_id") == F.col(f"_{kind}")), "left").drop(f"_{kind}")
        titles.append(F.when(F.col("target_type") == kind, F.col(f"_title_{kind}")))
    return reports.withColumn("title", F.coalesce(*titles)).drop(*[f"_title_{k}" for k in targets])


def once(reports: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, such as one report of a visitor about a target."""
    rest = [c for c in reports.columns if c not in keys]
    first = reports.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*keys, "_first.*")


def without_resolved(targets: DataFrame, kind: str, reports: DataFrame) -> DataFrame:
    """Targets of a type less those that a resolved report is about."""
    gone = reports.filter((F.col("target_type") == kind) & (F.col("status") == "resolved")).select(F.col("target_id").alias("id"))
    return targets.join(gone, "id", "left_anti")


def within_limit(new: DataFrame, old: DataFrame, by: list[str], at: str, hours: int = 24) -> DataFrame:
    """New rows whose author has no old one at the same place in the hours before."""
    past = old.select(*[F.col(c).alias(f"_{c}") for c in [*by, at]])
    same = [F.col(c) == F.col(f"_{c}") for c in by]
    recent = (F.col(f"_{at}") > F.col(at) - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(f"_{at}") <= F.col(at))
    return new.join(past, [*same, recent], "left_anti")


def half_steps(score: Column, low: float = 0.5, high: float = 5.0) -> Column:
    """Whether a score is one of the half steps from low to high."""
    return F.coalesce(score.between(low, high) & (score * 2 == F.floor(score * 2)), F.lit(False))


def owned(rows: DataFrame, requests: DataFrame, owner: str) -> DataFrame:
    """Rows less those whose own author asks for removal; requests: id and the author's column."""
    return rows.join(requests.select("id", owner), ["id", owner], "left_anti")


def with_lots(signals: DataFrame, matches: DataFrame) -> DataFrame:
    """Signals with their places as one array, in order; an empty one without any."""
    lots = matches.groupBy(F.col("web_source_id").alias("id")).agg(F.sort_array(F.collect_set("parking_lot_id")).alias("lots"))
    return signals.join(lots, "id", "left").withColumn("lots", F.coalesce("lots", F.array().cast("array<string>")))


def video_queue(lots: DataFrame, stats: DataFrame, media: DataFrame, curated: Column) -> DataFrame:
    """Places without media to look up videos for, by the first reason that fits: curated, reviewed, on the web, large."""
    rows = lots.withColumn("_curated", F.coalesce(curated, F.lit(False))).join(media.select(F.col("parking_lot_id").alias("id")), "id", "left_anti")
    rows = rows.join(stats.select(F.col("parking_lot_id").alias("id"), F.coalesce("review_count", F.lit(0)).alias("_reviews"), F.coalesce("web_count", F.lit(0)).alias("_web")), "id", "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("_curated"), 1), F.when(~F.col("_curated") & (F.col("_reviews") > 0), 2), F.when(~F.col("_curated") & (F.col("_web") >= 3) & (F.col("_reviews") == 0), 3),
        F.when(~F.col("_curated") & (F.col("total_spaces") >= 100) & (F.coalesce("_web", F.lit(0)) < 3), 4),
    ))
    return rows.withColumn("priority", F.array_min(reasons)).filter("priority IS NOT NULL").select(*lots.columns, "priority")


def last_changes(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Per key the latest of two times."""
    return rows.groupBy(key).agg(F.max(F.greatest(a, b)).alias("changed"))


def shared_by_few(matches: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Keys of at most so many matches, and how many."""
    return matches.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") <= most)
