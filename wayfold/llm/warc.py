"""Operator 9: deterministic sharded WARC writer, and a reader of what it wrote.

Records are dealt to ranges of page_id of about `range_bytes` and sorted within them by page_id, digest, url and html; a
task writes a range as gzip members, one per record after a warcinfo, and rolls to the next file when the compressed size
reaches the limit. Ranges, order, headers, record ids, dates and digests depend on the rows only, neither on the cluster nor
on how the table is split: a task that runs again, or another cluster, writes the same bytes. Ids with more than a range
of rows (and rows without one) are split by digest. A file is written under a temporary name and moved to its place; the
manifest (a table of files with ranges, record numbers, sizes and digests) is written last, and readers read only files
that it names.

Of records with equal payloads of at least `least` bytes the one of the largest page_id is a response, the others are
revisits of it. Null html is an empty payload, a null url is an empty target. Rows without a page_id come first and are
never referred to; repeated rows each give a record, and of several with the largest page_id one is the response. Other
columns do not matter; an empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayfold.llm.common import bucket_of, byte_cuts, commit, content, partitions, shared_path

LEAST, FILE_BYTES, RANGE_BYTES, LEVEL = 1000, 64 << 20, 64 << 20, 6
#: The date of all records (a rewrite must not change them) and the base of record ids.
DATE, IDS = "2000-01-01T00:00:00Z", uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page: str, digest: str, nth: int) -> str:
    """The id of the nth record of a page with a payload."""
    return f"<urn:uuid:{uuid.uuid5(IDS, f'{page} {digest} {nth}')}>"


def record(kind: str, page: str, url: str, payload: bytes, digest: str, refers_to: str | None, nth: int = 0) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but says whose it is."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page, digest, nth)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"X-Page-ID: {page}", f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest, 0)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str) -> bytes:
    """The warcinfo record that a file starts with."""
    block = b"format: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(IDS, name)}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value)


def member(data: bytes) -> bytes:
    """A gzip member without time or name."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def revisits(sized: DataFrame, least: int = LEAST) -> DataFrame:
    """digest, bytes and page_id of the response of each payload that several records share. sized: page_id, digest, bytes."""
    return sized.filter(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).filter("n > 1")


def ranged(rows: DataFrame, pages: DataFrame, most: int) -> DataFrame:
    """rows (page_id, digest) with _bucket, ascending in page_id: ranges of about `most` bytes of pages; heavy ids in parts by digest."""
    size = F.coalesce(F.length("html"), F.lit(0)) + 500
    cuts = byte_cuts(pages, "page_id", size, most)
    heavy = pages.groupBy("page_id").agg(F.sum(size).alias("s")).filter(F.col("s") > most).select("page_id", F.ceil(F.col("s") / most).cast("int").alias("parts"))
    parts = {r.page_id: r.parts for r in heavy.collect()}  # no more ids than there are ranges
    part = F.lit(0)
    if parts:
        many = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in parts.items() if k is not None for x in (k, v)] or [F.lit(0), F.lit(1)]), F.col("page_id")), F.lit(1))
        if None in parts:
            many = F.when(F.col("page_id").isNull(), F.lit(parts[None])).otherwise(many)
        part = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), many)
    return rows.withColumn("_range", bucket_of("page_id", cuts)).withColumn("_part", part.cast("int"))


def write(pages: DataFrame, folder: str, least: int = LEAST, file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES) -> str:
    """Writes pages (page_id, url, html) as WARC files under folder; returns the manifest's path."""
    html = F.coalesce("html", F.lit(""))
    body = F.encode(html, "utf-8")
    sized = pages.select("page_id", F.sha1(body).alias("digest"), F.length(body).alias("bytes"))
    marks = sized.join(revisits(sized, least), ["digest", "bytes"]).select("page_id", "digest", "target").distinct()
    rows = pages.select("page_id", F.sha1(body).alias("digest"), F.lit(None).cast(pages.schema["page_id"].dataType).alias("target"), F.lit(False).alias("mark"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    rows = rows.unionByName(marks.select("page_id", "digest", "target", F.lit(True).alias("mark"), F.lit("").alias("url"), F.lit("").alias("html")))
    dealt = ranged(rows, pages, range_bytes).repartition(partitions(pages), "_range", "_part")
    dealt = dealt.sortWithinPartitions("_range", "_part", F.col("page_id").asc_nulls_first(), "digest", F.col("mark").desc(), "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = number = count = nth = 0
        bucket = name = first = last = key = target = None

        def rolled() -> pa.RecordBatch:
            data = b"".join(held)
            commit(f"{folder}/{name}", data)
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "bucket": [bucket[0]], "part": [bucket[1]], "number": [number], "records": [count], "first": [first], "last": [last], "bytes": [len(data)], "sha1": [hashlib.sha1(data).hexdigest()]}, schema=MANIFEST)

        for batch in batches:
            for row in (r for k in range(0, batch.num_rows, 256) for r in batch.slice(k, 256).to_pylist()):
                if key != (row["_range"], row["_part"], row["page_id"], row["digest"]):
                    key, target, nth = (row["_range"], row["_part"], row["page_id"], row["digest"]), None, 0
                if row["mark"]:  # before the records of its page and digest
                    target = row["target"]
                    continue
                page = row["page_id"]
                if bucket != key[:2] or size >= file_bytes:
                    if held:
                        yield rolled()
                    number = number + 1 if bucket == key[:2] else 0
                    bucket, first = key[:2], str(page)
                    name = f"part-{bucket[0]:06d}-{bucket[1]:04d}-{number:05d}.warc.gz"
                    held, count = [member(info(name))], 0
                    size = len(held[0])
                response = target is None or target == page and not nth
                held.append(member(record("response" if response else "revisit", str(page), row["url"], row["html"].encode("utf-8", "surrogatepass"), row["digest"], None if response else str(target), nth)))
                size, last, nth, count = size + len(held[-1]), str(page), nth + 1, count + 1
        if held:
            yield rolled()

    manifest = f"{folder}/manifest"
    dealt.mapInArrow(run, "file string, bucket int, part int, number int, records long, first string, last string, bytes long, sha1 string").write.parquet(manifest)
    return manifest


MANIFEST = pa.schema([("file", pa.string()), ("bucket", pa.int32()), ("part", pa.int32()), ("number", pa.int32()), ("records", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("bytes", pa.int64()), ("sha1", pa.string())])


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file of gzip members; members are fed to the decompressor in small windows."""
    at, view = 0, memoryview(data)
    while at < len(data):
        z, out, window = zlib.decompressobj(31), [], 2048
        while not z.eof:
            piece = view[at : at + window]
            if not len(piece):
                raise ValueError("a gzip member ends early")
            out.append(z.decompress(piece))
            at += len(piece)
            window = min(2 * window, 1 << 20)
        at -= len(z.unused_data)
        head, _, rest = b"".join(out).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def read(spark: SparkSession, manifest: str, key: str = "bigint") -> DataFrame:
    """Records of the files that a manifest names: page_id, url, type, digest, payload size, referred page, payload (null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, sha1 in zip(batch.column("file").to_pylist(), batch.column("sha1").to_pylist(), strict=True):
                data = content(name)
                if hashlib.sha1(data).hexdigest() != sha1:
                    raise ValueError(f"{name} is not what the manifest says")
                out: list[tuple] = []
                size = 0
                for h, block in records(data):
                    if hashlib.sha1(block).hexdigest() != h["WARC-Block-Digest"].removeprefix("sha1:"):
                        raise ValueError(f"{name}: a block does not have its digest")
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    revisit = h["WARC-Type"] == "revisit"
                    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
                    out.append((h["X-Page-ID"], h["WARC-Target-URI"], h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"]), h.get("X-Refers-To-Page-ID"), payload))
                    size += len(payload or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], NAMES)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], NAMES)

    files = spark.read.parquet(manifest).select("file", "sha1")
    files = files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")
    raw = files.mapInArrow(run, "page string, url string, type string, digest string, payload_bytes long, refers string, payload binary")
    number = lambda c: F.when(F.col(c) != "None", F.col(c)).cast(key)
    return raw.select(number("page").alias("page_id"), "url", "type", "digest", "payload_bytes", number("refers").alias("refers_to"), "payload")


NAMES = ["page", "url", "type", "digest", "payload_bytes", "refers", "payload"]
TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]


def archived(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder, reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Sizes and digests of responses are taken from the payloads read, those of revisits from their headers.
    """
    spark = pages.sparkSession
    manifest = write(pages, shared_path(spark, "warc"))
    back = read(spark, manifest, pages.schema["page_id"].dataType.simpleString())
    return back.select("page_id", F.coalesce(F.length("payload"), "payload_bytes").cast("long").alias("payload_bytes"), F.coalesce(F.sha1("payload"), "digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
