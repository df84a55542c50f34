"""WARC files: the same bytes however the table is split, files that roll, hot ids, and reading in linear time."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from wayfold.llm import warc
from wayfold.llm.common import byte_cuts, load, shared_path


def written(spark, pages, **how) -> dict[str, str]:
    manifest = warc.write(pages, shared_path(spark, "warc-test"), **how)
    rows = spark.read.parquet(manifest).collect()
    return {r.file.rsplit("/", 1)[1]: (r.records, r.first, r.last, r.sha1) for r in rows}


def test_the_same_bytes_under_other_parallelism(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in (3, 8):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(written(spark, pages.repartition(n), range_bytes=20_000, file_bytes=4_000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and len(found[0]) > 10
    assert sum(r[0] for r in found[0].values()) == pages.count()


def test_hot_ids_are_split(spark):
    rows = [(7, "u", f"{i} " * 500) for i in range(200)] + [(None, "u", f"{i} " * 500) for i in range(100)] + [(i, "u", f"{i} " * 300) for i in range(100)]
    rows += [(7, "u", "0 " * 500)] * 5
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = shared_path(spark, "warc-test")
    manifest = warc.write(pages, folder, range_bytes=50_000)
    files = spark.read.parquet(manifest).collect()
    assert max(r.records for r in files) < 150 and len({(r.bucket, r.part) for r in files}) > 5
    got = warc.read(spark, manifest).collect()
    assert len(got) == len(rows)
    assert sorted((r.page_id, r.payload.decode()) for r in got if r.type == "response") == sorted({(i, t) for i, _, t in rows if i is not None})
    assert {(r.page_id, r.refers_to) for r in got if r.type == "revisit"} == {(None, 7), (7, 7)}


def test_ids_of_records_and_what_revisits_refer_to(spark):
    body = "x" * 2000
    pages = spark.createDataFrame([(1, "a", body), (2, "b", body), (2, "c", body), (3, "d", "short"), (3, "d", "short")], "page_id long, url string, html string")
    folder = shared_path(spark, "warc-test")
    (file,) = spark.read.parquet(warc.write(pages, folder)).collect()
    found = [h for h, _ in warc.records(warc.content(file.file))]
    assert [h["WARC-Type"] for h in found] == ["warcinfo", "revisit", "response", "revisit", "response", "response"]
    assert len({h["WARC-Record-ID"] for h in found}) == 6
    assert {h["WARC-Refers-To"] for h in found if h["WARC-Type"] == "revisit"} == {found[2]["WARC-Record-ID"]}


def test_many_small_records_are_read_in_linear_time():
    one = warc.member(warc.record("response", "1", "u", b"small", "0" * 40, None))
    began = time.perf_counter()
    assert sum(1 for _ in warc.records(one * 100_000)) == 100_000
    assert time.perf_counter() - began < 60


def test_cuts_follow_the_bytes(spark):
    df = spark.range(10_000).select(F.when(F.col("id") < 9_000, F.col("id")).otherwise(F.col("id") * 10**12).alias("k"))
    cuts = byte_cuts(df, "k", F.lit(1), 500, bins=64)
    sizes = [df.filter((F.col("k") >= a) & (F.col("k") < b)).count() for a, b in zip([0, *cuts], [*cuts, 10**17], strict=True)]
    assert sum(sizes) == 10_000 and max(sizes) <= 500 and len(sizes) < 60
