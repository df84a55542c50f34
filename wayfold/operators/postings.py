"""The word index of the catalogue as a table that follows changes, instead of one that each query builds anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.matching import token_index

POSTINGS, CHANGED = "token string, lot string, segment long", "lot string, segment long"


def apply_changes(changes: DataFrame, path: str, segment: int) -> None:
    """Adds a batch of changes as a segment: the words of places that were inserted or updated, and which places changed at all.

    changes: id, seq, op (insert, update or delete), name, address; of several changes of a place in the batch the last by seq
    counts. Segments are numbered in order of their batches; one that is applied again overwrites itself. Only the batch
    is read and written, whatever the size of the index. Null ids are left out.
    """
    last = changes.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct("op", "name", "address"), "seq").alias("c")).select("id", "c.*")
    token_index(last.filter("op <> 'delete'")).withColumn("segment", F.lit(segment).cast("long")).write.mode("overwrite").parquet(f"{path}/postings/part={segment}")
    last.select(F.col("id").alias("lot"), F.lit(segment).cast("long").alias("segment")).write.mode("overwrite").parquet(f"{path}/changed/part={segment}")


def current_postings(spark: SparkSession, path: str) -> DataFrame:
    """token and lot, as token_index() would give them for the places as they are now: of each place the segment that changed it last."""
    read = lambda kind, schema: spark.read.option("basePath", f"{path}/{kind}").schema(schema).parquet(f"{path}/{kind}/part=*").drop("part")
    latest = read("changed", CHANGED).groupBy("lot").agg(F.max("segment").alias("segment"))
    return read("postings", POSTINGS).join(latest, ["lot", "segment"]).select("token", "lot")


def compacted(spark: SparkSession, path: str, to: str, segment: int) -> None:
    """Another index with the same postings, all in one segment of a number not below those so far; later changes go on from it.

    The old one stays as it was, for queries that began on it.
    """
    rows = current_postings(spark, path).withColumn("segment", F.lit(segment).cast("long"))
    rows.write.mode("overwrite").parquet(f"{to}/postings/part={segment}")
    spark.read.parquet(f"{to}/postings/part={segment}").select("lot", "segment").distinct().write.mode("overwrite").parquet(f"{to}/changed/part={segment}")
