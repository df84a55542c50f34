"""Small helpers that the operators share: shared folders, ordered buckets, Arrow loops."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python task works on at a time.
CHUNK_CHARS = 1_000_000
#: Bits of a filter that goes to all tasks (8 MB).
SLOTS = 1 << 26


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local run uses a folder of its own and a cluster raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file:///tmp/wayfold-{os.getuid()}"
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/wayfold/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    """Tasks for a shuffle of all of df: as many as its scan has, or spark.sql.shuffle.partitions if more."""
    return max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def boundaries(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending values of the whole-number column key that cut its rows into about even ranges.

    Only the key column is read; the driver gets n numbers. Null keys are left out.
    """
    if n < 2:
        return []
    cuts = [i / n for i in range(1, n)]
    row = df.select(F.percentile_approx(F.col(key), F.array(*map(F.lit, cuts)), F.lit(max(10_000, 20 * n))).alias("b")).first()
    return sorted({int(b) for b in (row.b or [])})


def byte_cuts(df: DataFrame, key: str, size: Column, most: int, bins: int = 4096) -> list[int]:
    """Ascending values of the whole-number column key that cut its rows into ranges of about `most` of the summed size.

    They depend on the rows only, not on how these are split: sizes are summed in ranges of equal width, ranges of more than
    `most` again in narrower ones. The driver gets one number for each range. Null keys are left out; one key is never cut.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), size.cast("long").alias("s")).filter("k IS NOT NULL")
    low, high, total = rows.agg(F.min("k"), F.max("k"), F.sum("s")).first()
    if low is None or total <= most:
        return []
    cuts: list[int] = []

    def cut(low: int, high: int, total: int) -> None:
        width = max(1, -(-(high - low + 1) // max(bins, 4 * total // most)))
        nth = F.floor((F.col("k").cast("double") - float(low)) / float(width)).cast("long")
        own = rows.filter(F.col("k").between(low, high)).groupBy(nth.alias("i")).agg(F.sum("s").alias("s")).orderBy("i").toArrow()
        held = 0
        for i, s in zip(own.column("i").to_pylist(), own.column("s").to_pylist(), strict=True):
            a = max(low, low + i * width)
            if held and held + s > most:
                cuts.append(a)
                held = 0
            if s > most and width > 1:
                cut(a, min(high, a + width - 1), s)
                held = most
            else:
                held += s

    cut(low, high, total)
    return sorted(set(cuts))


def bucket_of(key: str, cuts: list[int]):
    """Column: 0 for null keys and those below cuts[0], i for keys from cuts[i - 1] on."""
    edges = np.array(cuts, dtype=np.int64)

    @F.arrow_udf("int")
    def bucket(values: pa.Array) -> pa.Array:
        got = np.searchsorted(edges, values.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(np.int64), side="right")
        return pa.array(got.astype(np.int32))

    return bucket(F.col(key).cast("long"))


def dealt_by_range(df: DataFrame, key: str, sort: list, like: DataFrame | None = None) -> DataFrame:
    """df with a column _bucket, ascending in key; each bucket lies in one task, sorted there by _bucket and sort.

    like: the scan whose keys give the ranges, where df is more than a scan.
    """
    like = df if like is None else like
    n = partitions(like)
    cuts = boundaries(like, key, n)
    return df.withColumn("_bucket", bucket_of(key, cuts)).repartition(max(1, n), "_bucket").sortWithinPartitions("_bucket", *sort)


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch of at most about `most` bytes of text (one text at least), with their texts; null texts are empty.

    Only the texts of one slice at a time become Python strings.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = 0
    while start < len(sizes):
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), most, side="right")))
        part = batch.slice(start, stop - start)
        yield part, [t if t is not None else "" for t in part.column(text).to_pylist()]
        start = stop
    pa.default_memory_pool().release_unused()


def folded(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep, and all others in one struct _rest, where their names clash with nothing."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in keep]
    return docs.select(*[c for c in docs.columns if c in keep], (F.struct(*rest) if rest else F.lit(0)).alias("_rest"))


def unfolded(df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """The columns `names` of a table that folded() made."""
    return df.select(*[F.col(c) if c in keep else F.col(f"_rest.`{c}`") for c in names])


def slots_of(df: DataFrame, column: str) -> np.ndarray:
    """SLOTS bits: those of the values of a long column are set (each by its value modulo SLOTS). The driver gets at most SLOTS / 8 bytes, whatever df holds."""
    slot = F.col(column).bitwiseAND(F.lit(SLOTS - 1))
    words = df.select(F.shiftright(slot, 6).alias("i"), F.expr(f"shiftleft(1L, cast({column} & 63 AS int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(SLOTS >> 6, dtype=np.int64)
    bits[words.column("i").to_numpy()] = words.column("b").to_numpy()
    return bits


def slotted(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether a value's slot is set: true for all values that slots_of() saw, and for few others as long as these are few."""
    slot = values & (SLOTS - 1)
    return (bits[slot >> 6] >> (slot & 63)) & 1 == 1


def in_slots(column: str, bits: np.ndarray) -> Column:
    """Column: slotted() of a long column without nulls."""

    @F.arrow_udf("boolean")
    def among(values: pa.Array) -> pa.Array:
        return pa.array(slotted(bits, values.to_numpy()))

    return among(F.col(column))


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def running_start(totals: DataFrame, order: str, value: str, group: int = 1024) -> DataFrame:
    """totals (one row per value of the whole number `order`) with `start`, the sum of value over all lower rows.

    Summed in two levels so that no task sees more than one group of rows and one row per group.
    """
    from pyspark.sql import Window as W

    rows = totals.withColumn("_g", F.floor(F.col(order) / group).cast("long"))
    below = rows.groupBy("_g").agg(F.sum(value).alias("_v"))
    below = below.withColumn("_base", F.coalesce(F.sum("_v").over(W.orderBy("_g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_v")
    inner = W.partitionBy("_g").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(below, "_g").withColumn("start", (F.col("_base") + F.col("_in")).cast("long")).drop("_g", "_base", "_in")


def file_system(path: str):
    """pyarrow's file system of a path or URI, and the path in it; tasks open shared files by it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:/"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def commit(path: str, content: bytes) -> None:
    """Writes a file whole: under a temporary name of its own first, then moved to its place. Writing it again is harmless."""
    files, own = file_system(path)
    files.create_dir(own.rsplit("/", 1)[0], recursive=True)
    tmp = f"{own}.tmp-{uuid.uuid4().hex}"
    with files.open_output_stream(tmp, compression=None) as f:
        f.write(content)
    try:
        files.move(tmp, own)
    except OSError:  # some stores don't replace: an earlier attempt of the task wrote the same bytes
        files.delete_file(own)
        files.move(tmp, own)


def content(path: str, at: int = 0, size: int | None = None) -> bytes:
    """A file's bytes, or `size` of them from `at` on without the rest."""
    files, own = file_system(path)
    if size is None:
        with files.open_input_stream(own, compression=None) as f:
            return f.read()
    with files.open_input_file(own) as f:
        return f.read_at(size, at)
