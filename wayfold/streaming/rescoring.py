"""Micro-batches: rescoring of places that messages name, idempotent ingest, stages one after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def named_lots(messages: DataFrame) -> DataFrame:
    """Places to score again: distinct within a batch (a later batch may name one again), empty ids left out."""
    return messages.filter(F.coalesce("lot_id", F.lit("")) != "").select(F.col("lot_id").alias("parking_lot_id")).distinct()


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Works off what is there, in micro-batches. A batch may come again after a failure, so `handle` must be idempotent by its number."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def rescore_stream(messages: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Each batch's scores go to a folder of the batch's number, which a repeated batch overwrites."""

    def handle(batch: DataFrame, number: int) -> None:
        score(named_lots(batch)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_batches(messages, handle, checkpoint)


def latest(results: DataFrame, key: str = "parking_lot_id") -> DataFrame:
    """The row of the latest batch of each key."""
    return results.groupBy(key).agg(F.max_by(F.struct(*[c for c in results.columns if c != key]), "batch").alias("_r")).select(key, "_r.*")


def ingest_stream(rows: DataFrame, keys: list[str], out: str, checkpoint: str) -> None:
    """Appends rows of keys that are not there yet; a batch overwrites its own folder, so it may come again."""
    spark = rows.sparkSession

    def handle(batch: DataFrame, number: int) -> None:
        from wayfold.operators.merge import insert_ignore

        try:
            old = spark.read.option("basePath", out).schema(batch.schema).parquet(f"{out}/batch=*").filter(F.col("batch") < number) if number else None
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # else nothing was written so far
                raise
            old = None
        new = insert_ignore(old, batch, keys) if old is not None else batch.dropDuplicates(keys)
        new.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_batches(rows, handle, checkpoint)


def run_stages(stages: list[tuple[str, Callable[[], None]]]) -> dict[str, str]:
    """Runs stages in order; the failure of one is noted and does not stop the others."""
    out = {}
    for name, f in stages:
        try:
            f()
            out[name] = "ok"
        except Exception as e:
            out[name] = f"failed: {type(e).__name__}: {e}"[:300]
    return out


def changed_since(rows: DataFrame, at: str, mark: str, default: str = "2000-01-01 00:00:00") -> DataFrame:
    """Rows after the high-water mark."""
    return rows.filter(F.col(at) > F.lit(mark or default).cast("timestamp"))


def due(keys: DataFrame, progress: DataFrame, key: str, prefix: str, now: str, days: int = 30) -> DataFrame:
    """Keys never visited or last visited over so many days ago, never visited ones first. progress is keyed prefix + key."""
    p = progress.select(F.col("crawler_id").alias("_c"), "last_run_at")
    rows = keys.join(p, F.concat(F.lit(prefix), F.col(key)) == F.col("_c"), "left").drop("_c")
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_run_at").cast("timestamp"))) / F.lit(8.64e10)
    return rows.filter(F.col("last_run_at").isNull() | (age > days)).orderBy(F.asc_nulls_first("last_run_at"), key)
