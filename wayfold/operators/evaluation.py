"""Audits and evaluation: histograms, confusion matrices, errors, exact quantiles, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.sources.files import numbered_pages, running_total


def histogram(rows: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """Rows per bucket: below the first edge, between edges (low included), from the last on, and null."""
    names = [f"<{edges[0]:g}", *[f"{a:g}-{b:g}" for a, b in zip(edges, edges[1:], strict=False)], f">={edges[-1]:g}"]
    bucket = F.when(value.isNull(), "null")
    for edge, name in zip(edges, names, strict=False):
        bucket = bucket.when(value < edge, name)
    return rows.groupBy(bucket.otherwise(names[-1]).alias("bucket")).agg(F.count("*").alias("n"))


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: the four counts, precision, recall and F1 (null without cases)."""
    c = rows.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))
    c = c.withColumns({"precision": F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), "recall": F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))})
    return c.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))


def errors(rows: DataFrame, guess: Column, truth: Column, by: list[Column] | None = None) -> DataFrame:
    d = guess - truth
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(d)), 6).alias("mae"), F.round(F.sqrt(F.avg(d * d)), 6).alias("rmse"), F.round(F.avg(d), 6).alias("bias"))


def quantiles(rows: DataFrame, value: str, at: list[float]) -> DataFrame:
    """Exact quantiles: the value of place floor((n-1)q), from 0. Values are counted first, then the counts summed over ranges of values."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("all"))
    each = running_total(counts, value, F.col("c"), "upto").join(F.broadcast(total)).withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in at])))  # one row
    place = F.floor((F.col("all") - 1) * F.col("q"))
    return each.filter((place < F.col("upto")) & (place >= F.col("upto") - F.col("c"))).select("q", F.col(value).alias("value"))


def stratified(rows: DataFrame, stratum: Column, key: str, n: int) -> DataFrame:
    """n rows of each stratum, chosen by a hash of the key: the same ones each time."""
    return rows.withColumn("stratum", stratum).withColumn("_nth", F.row_number().over(W.partitionBy("stratum").orderBy(F.md5(F.col(key).cast("string")), key))).filter(F.col("_nth") <= n).drop("_nth")


def chunked(rows: DataFrame, key: str, chunks: int) -> DataFrame:
    """Contiguous slices of ascending keys, of ceil(n / chunks) rows each."""
    size = max(1, -(-rows.count() // chunks))
    return numbered_pages(rows, key, size).withColumnRenamed("page", "chunk")
