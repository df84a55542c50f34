"""Stored results, found again by what they were made from: a fingerprint of the input, and an age after which they are made anew."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from wayfold.sources.shared import shared_path


def files_fingerprint(*frames: DataFrame) -> str:
    """A hash of the names, lengths and times of the files that the frames read: another file, or one overwritten in place, changes it.

    The driver asks the files' store for each file's state; no data is read.
    """
    spark = frames[0].sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    own = set()
    for name in {f for df in frames for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        state = path.getFileSystem(conf).getFileStatus(path)
        own.add((name, state.getLen(), state.getModificationTime()))
    return hashlib.sha256(repr(sorted(own)).encode()).hexdigest()


@dataclass
class Entry:
    fingerprint: str
    made: float
    path: str
    frame: DataFrame


class ResultCache:
    """One stored result for each name and application. It is used as long as its fingerprint is the input's and it is younger than max_age seconds.

    A result that is replaced is forgotten at once; its files go when it is replaced once more, so that a query which began on
    it can end. Results lie in the shared folder, where executors and driver see them.
    """

    def __init__(self, max_age: float = 3600.0, clock: Callable[[], float] = time.time):
        self.max_age, self.clock = max_age, clock
        self.entries: dict[tuple[str, str], Entry] = {}
        self.replaced: dict[tuple[str, str], str] = {}

    def get(self, spark: SparkSession, name: str, fingerprint: str, make: Callable[[], DataFrame]) -> DataFrame:
        key, now = (spark.sparkContext.applicationId, name), self.clock()
        old = self.entries.get(key)
        if old and old.fingerprint == fingerprint and now - old.made < self.max_age:
            return old.frame
        df, path = make(), shared_path(spark, "stored")
        df.write.parquet(path)
        if old:
            if key in self.replaced:
                self._drop(spark, self.replaced[key])
            self.replaced[key] = old.path
        self.entries[key] = Entry(fingerprint, now, path, spark.read.schema(df.schema).parquet(path))
        return self.entries[key].frame

    def _drop(self, spark: SparkSession, path: str) -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
