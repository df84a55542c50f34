"""Operator 8: document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases: each is the shortest stretch, from where the last ended, that is not yet in the
dictionary, and joins it. The set of phrases stands for the text as a compressor sees it. The fingerprint holds the
`SIZE` least hashes of the set, and the likeness of two is the share of the least hashes of their union that both have,
which estimates how alike the sets are.

Null and empty texts have an empty fingerprint; two empty ones are wholly alike, an empty and another one not at all.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import boundaries, bucket_of, chunks, partitions

SIZE = 128


def parse(text: str, start: int, known: set[str]) -> tuple[list[str], int]:
    """New phrases of text from start on, which are added to known, and where the unfinished last one starts.

    All prefixes of a phrase are phrases, so the search may begin at three characters and go either way.
    """
    i, n, new = start, len(text), []
    add, found = known.add, new.append
    while i + 3 <= n:
        j = i + 3
        w = text[i:j]
        if w in known:
            j += 1
            w = text[i:j]
            while w in known and j < n:
                j += 1
                w = text[i:j]
            if w in known:
                return new, i
        elif (shorter := w[:2]) not in known:
            w = w[:1] if w[0] not in known else shorter
        add(w)
        found(w)
        i += len(w)
    j = i + 1
    while j <= n:
        w = text[i:j]
        if w in known:
            j += 1
        else:
            add(w)
            found(w)
            i = j
            j = i + 1
    return new, i


def hashes(phrases: list[str]) -> np.ndarray:
    """Well mixed 32-bit hashes."""
    crc = zlib.crc32
    x = np.array([crc(p.encode("utf-8", "surrogatepass")) for p in phrases], dtype=np.uint64)
    x = (x ^ x >> np.uint64(16)) * np.uint64(0x85EBCA6B) & np.uint64(0xFFFFFFFF)
    x = (x ^ x >> np.uint64(13)) * np.uint64(0xC2B2AE35) & np.uint64(0xFFFFFFFF)
    return (x ^ x >> np.uint64(16)).astype(np.uint32)


def sketch(values: np.ndarray) -> np.ndarray:
    return np.unique(values)[:SIZE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SIZE]
    return float((np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)).mean())


def as_text(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def fingerprint(text: str) -> np.ndarray:
    return sketch(hashes(parse(text, 0, set())[0]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([as_text(fingerprint(t)) for t in texts], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose latter half is the start of the next document's.

    Order is by doc_id (nulls first, then by text for repeated ids). Documents are dealt to ranges of doc_id; a range's
    first document also goes, as a guard, to the range before (the first of all to the last range), so that each
    range knows what follows it.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(rows)
    cuts = boundaries(rows, "doc_id", n)
    ranged = rows.withColumn("_b", bucket_of("doc_id", cuts))
    firsts = sorted((r._b, r.doc_id) for r in rows.select("doc_id").withColumn("_b", bucket_of("doc_id", cuts)).groupBy("_b").agg(F.min(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))).alias("doc_id")).collect())
    starts = np.array([first for _, first in firsts], dtype=np.int64)  # at most one per range
    homes = np.array([firsts[i - 1][0] for i in range(len(firsts))], dtype=np.int32)

    @F.arrow_udf("int")
    def guarded(ids: pa.Array) -> pa.Array:
        """The range before, for the first document of a range; else null."""
        own = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.minimum(np.searchsorted(starts, own), len(starts) - 1)
        return pa.array(homes[at], mask=starts[at] != own)

    home = F.struct(F.col("_b"), F.lit(False).alias("_guard"))
    homes_of = F.when(F.col("_to").isNull(), F.array(home)).otherwise(F.array(home, F.struct(F.col("_to").alias("_b"), F.lit(True).alias("_guard"))))
    dealt = ranged.withColumn("_to", guarded(F.col("doc_id").cast("long"))).withColumn("_home", F.explode(homes_of)).select("doc_id", "text", F.col("_home._b").alias("_b"), F.col("_home._guard").alias("_guard"))
    dealt = dealt.repartition(n, "_b").sortWithinPartitions("_b", "_guard", F.col("doc_id").asc_nulls_first(), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document that waits for its next: bucket, id, text, and its own parse
        for batch in batches:
            for part, texts in chunks(batch):
                out = []
                for doc, text, b, guard in zip(part.column("doc_id").to_pylist(), texts, part.column("_b").to_pylist(), part.column("_guard").to_pylist(), strict=True):
                    if held and held[0] == b:
                        now = finished(held, text)
                        out.append(now[0])
                        held = (b, doc, text, now[1]) if not guard else None
                    elif not guard:
                        held = (b, doc, text, None)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [part.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def finished(held, following: str):
        """The row of the held document, and the sketch of the following one."""
        _, doc, text, own = held
        half = len(text) // 2
        known: set[str] = set()
        head, at = parse(text[: len(text) - half], 0, known)
        edited = text[: len(text) - half] + following[:half]
        head_hashes = hashes(head)
        changed = sketch(np.concatenate([head_hashes, hashes(parse(edited, at, set(known))[0])]))
        if own is None:
            own = sketch(np.concatenate([head_hashes, hashes(parse(text, at, known)[0])]))
        after = own if following == text else fingerprint(following)
        row = (doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(changed), likeness(own, changed), likeness(own, after))
        return row, after

    return dealt.mapInArrow(run, schema)
