"""Operator 10: token ids in a binary format coded by a static range asymmetric numeral system (rANS).

A file holds whole documents in ascending doc_id order. Its ids share one static frequency table (counted over the file,
scaled to 2^SCALE_BITS, every id that occurs at least 1). They are coded in blocks of at most BLOCK ids, each by
LANES interleaved states, so numpy codes all lanes of a block at once. A block holds whole documents; only a document longer
than a block takes several. Such a run of blocks is a unit: its checkpoint (place in the file, first document, first id) and
the CRC-32 of each block are in the header, and the manifest lists the units, so tasks read and decode units, not files,
in parallel and from any place. Files are committed under temporary names and named by the manifest.

Layout, all little-endian: magic, header length, CRC-32 of the header, compressed JSON header (table, documents, units), then
the blocks. A block: states (LANES uint64), then 32-bit words in the order the decoder takes them.

Null texts are empty: the end id only. Rows without a doc_id come first. Repeated rows each get their ids.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.bpe import BYTE_BPE, encoder
from wayfold.llm.common import chunks, commit, content, dealt_by_range, running_start, shared_path, written

SCALE_BITS, LANES, BLOCK, FILE_IDS, READ_IDS = 20, 1024, 1 << 18, 1 << 21, 1 << 23
#: States stay in [LOW, LOW << 32) between ids.
LOW = 1 << 31
MAGIC = b"RANSIDS2"
MANIFEST = pa.schema({"file": pa.string(), "bucket": pa.int32(), "number": pa.int32(), "ids": pa.int64(), "crc32": pa.int64(), "base": pa.int64(), "units": pa.list_(pa.struct({"unit": pa.int32(), "at": pa.int64(), "bytes": pa.int64()}))})


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2^SCALE_BITS, at least 1 where counts are."""
    total, size = int(counts.sum()), 1 << SCALE_BITS
    if (counts > 0).sum() > size:
        raise ValueError("more different ids than the scale has room for")
    freq = np.where(counts > 0, np.maximum(1, counts * size // max(total, 1)), 0).astype(np.int64)
    over = int(freq.sum()) - size
    order = np.argsort(-freq, kind="stable")
    while over > 0:  # take from the most frequent in turn, at most half of each
        take = np.minimum(freq[order] - 1, np.maximum(1, freq[order] // 2))
        take = np.minimum(take, np.maximum(0, over - (np.cumsum(take) - take)))
        freq[order] -= take
        over -= int(take.sum())
    freq[order[0]] -= over
    return freq


class Table:
    """Frequencies of the symbols that occur, their starts, and the symbol of each slot."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols.astype(np.int64), freq.astype(np.uint32)
        self.start = (np.cumsum(freq) - freq).astype(np.uint32)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
        self.wide_freq, self.wide_start = self.freq.astype(np.uint64), self.start.astype(np.uint64)

    def encode(self, index: np.ndarray) -> bytes:
        """index: places of symbols in the table. Lane k codes every LANES-th from k on, from the last to the first."""
        n = len(index)
        rows = -(-n // LANES)
        state = np.full(LANES, LOW, dtype=np.uint64)
        out: list[np.ndarray] = []
        for r in range(rows - 1, -1, -1):
            own = index[r * LANES : (r + 1) * LANES]
            f, s, x = self.wide_freq[own], self.wide_start[own], state[: len(own)]
            full = x >= f << np.uint64(63 - SCALE_BITS)
            if full.any():
                out.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")[::-1])
                x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[: len(own)] = (q << np.uint64(SCALE_BITS)) + (x - q * f) + s
        words = np.concatenate(out)[::-1] if out else np.zeros(0, dtype="<u4")
        return state.astype("<u8").tobytes() + words.tobytes()

    def decode(self, data: bytes, n: int) -> np.ndarray:
        state = np.frombuffer(data, dtype="<u8", count=LANES).copy()
        words = np.frombuffer(data, dtype="<u4", offset=8 * LANES)
        out, at = np.empty(n, dtype=np.int64), 0
        mask = np.uint64((1 << SCALE_BITS) - 1)
        for r in range(-(-n // LANES)):
            own = min(LANES, n - r * LANES)
            x = state[:own]
            low = x & mask
            i = self.slot[low]
            out[r * LANES : r * LANES + own] = i
            x = self.wide_freq[i] * (x >> np.uint64(SCALE_BITS)) + low - self.wide_start[i]
            need = x < LOW
            k = int(need.sum())
            if k:
                x[need] = x[need] << np.uint64(32) | words[at : at + k].astype(np.uint64)
                at += k
            state[:own] = x
        if at != len(words) or (state != LOW).any():
            raise ValueError("a block does not decode to its end")
        return self.symbols[out]


def runs(sizes: list[int], block: int) -> list[tuple[int, int, int]]:
    """First document, documents and ids of each unit: whole documents of at most `block` ids together, or one longer document."""
    out, first, n = [], 0, 0
    for k, size in enumerate(sizes):
        if k > first and n + size > block:
            out.append((first, k - first, n))
            first, n = k, 0
        n += size
    return [*out, (first, len(sizes) - first, n)] if sizes else out


def file_bytes(docs: list, ids: np.ndarray, sizes: list[int], block: int = BLOCK) -> tuple[bytes, int, list[dict]]:
    """A file of documents (their keys as text or None) with so many ids each, where its blocks start, and its units' places."""
    counts = np.bincount(ids)  # ids are small numbers, so nothing is sorted
    symbols = np.flatnonzero(counts)
    place = np.zeros(len(counts), dtype=np.int32)
    place[symbols] = np.arange(len(symbols), dtype=np.int32)
    index = place[ids]
    table = Table(symbols, scaled(counts[symbols]))
    units, parts, at, first_id = [], [], 0, 0
    for first, n_docs, n in runs(sizes, block):
        own, begin = [], at
        for a in range(first_id, first_id + n, block):
            data = table.encode(index[a : min(a + block, first_id + n)])
            own.append([len(data), min(block, first_id + n - a), zlib.crc32(data)])
            parts.append(data)
            at += len(data)
        units.append({"at": begin, "first": first, "docs": n_docs, "first_id": first_id, "blocks": own})
        first_id += n
    header = json.dumps({"symbols": np.diff(symbols, prepend=0).tolist(), "freq": table.freq.tolist(), "docs": docs, "sizes": sizes, "units": units}, separators=(",", ":")).encode()
    header = zlib.compress(header, 6)
    start = MAGIC + len(header).to_bytes(8, "little") + zlib.crc32(header).to_bytes(4, "little") + header
    places = [{"unit": k, "at": len(start) + u["at"], "bytes": sum(b[0] for b in u["blocks"])} for k, u in enumerate(units)]
    return start + b"".join(parts), len(start), places


def header_of(data: bytes) -> tuple[dict, Table]:
    """The header and table of a file that starts with data."""
    size = int.from_bytes(data[8:16], "little")
    raw = data[20 : 20 + size]
    if data[:8] != MAGIC or zlib.crc32(raw) != int.from_bytes(data[16:20], "little"):
        raise ValueError("not a file of this format, or a damaged one")
    header = json.loads(zlib.decompress(raw))
    return header, Table(np.cumsum(header["symbols"]), np.array(header["freq"]))


def unit_ids(data: bytes, table: Table, blocks: list[list[int]]) -> np.ndarray:
    """The ids of a unit from its bytes alone; a block that is not what its checksum says raises."""
    out, at = [], 0
    for size, n, crc in blocks:
        own = data[at : at + size]
        if zlib.crc32(own) != crc:
            raise ValueError("a block does not have its checksum")
        out.append(table.decode(own, n))
        at += size
    return np.concatenate(out)


def write(docs: DataFrame, folder: str, tokenizer: str = BYTE_BPE, end: int = 2, file_ids_limit: int = FILE_IDS, block: int = BLOCK) -> str:
    """Tokenizes docs in ascending doc_id order and writes files under folder; returns the manifest's path.

    The manifest has for each file its range, number within the range, ids, checksum, where its blocks start, its units'
    places, and the ids of all files before it.
    """
    dealt = dealt_by_range(docs.select("doc_id", "text"), "doc_id", [F.col("doc_id").asc_nulls_first(), "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        bucket, number, held, keys, sizes, n = None, 0, [], [], [], 0

        def rolled() -> pa.RecordBatch:
            name = f"{folder}/part-{bucket:06d}-{number:05d}.rans"
            data, base, units = file_bytes(keys, np.concatenate(held), sizes, block)
            commit(name, data)
            row = {"file": name, "bucket": bucket, "number": number, "ids": n, "crc32": zlib.crc32(data), "base": base, "units": units}
            return pa.RecordBatch.from_pylist([row], MANIFEST)

        for batch in batches:
            for part, texts in chunks(batch):
                for key, b, ids in zip(part.column("doc_id").to_pylist(), part.column("_bucket").to_pylist(), enc.encode(texts), strict=True):
                    if b != bucket or n >= file_ids_limit:
                        if keys:
                            yield rolled()
                        number = number + 1 if b == bucket else 0
                        bucket, held, keys, sizes, n = b, [], [], [], 0
                    held.append(np.append(ids, np.uint32(end)).astype(np.uint16 if len(enc.tokens) <= 65536 else np.uint32))
                    keys.append(key)
                    sizes.append(len(held[-1]))
                    n += sizes[-1]
        if keys:
            yield rolled()

    files = written(dealt.mapInArrow(run, "file string, bucket int, number int, ids long, crc32 long, base long, units array<struct<unit: int, at: long, bytes: long>>"), "rans-files")
    starts = running_start(files.groupBy("bucket").agg(F.sum("ids").alias("ids")), "bucket", "ids").select("bucket", F.col("start").alias("_before"))
    from pyspark.sql import Window as W

    inner = F.coalesce(F.sum("ids").over(W.partitionBy("bucket").orderBy("number").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    manifest = f"{folder}/manifest"
    files.join(starts, "bucket").withColumn("start", (F.col("_before") + inner).cast("long")).drop("_before").write.parquet(manifest)
    return manifest


def read(spark: SparkSession, manifest: str) -> DataFrame:
    """doc_id (as text), start, n_tokens and ids_crc32 of each document in the files that a manifest names.

    Tasks take units, neighbours together, about READ_IDS ids each; of a file they read the header and their units' bytes only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = header = table = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != opened:
                    opened, (header, table) = row["file"], header_of(content(row["file"], 0, row["base"]))
                unit = header["units"][row["unit"]]
                raw = unit_ids(content(row["file"], row["at"], row["bytes"]), table, unit["blocks"]).astype("<u4").tobytes()
                own = slice(unit["first"], unit["first"] + unit["docs"])
                sizes = np.array(header["sizes"][own], dtype=np.int64)
                stops = np.cumsum(sizes)
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((stops - sizes).tolist(), stops.tolist(), strict=True)]
                keys = pa.array([None if k is None else str(k) for k in header["docs"][own]], pa.string())
                yield pa.RecordBatch.from_arrays([keys, pa.array(row["start"] + unit["first_id"] + stops - sizes), pa.array(sizes), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.parquet(manifest)
    ids = files.agg(F.sum("ids")).first()[0] or 0
    units = files.select("file", "base", "start", F.explode("units").alias("u")).select("file", "base", "start", "u.*")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ids // READ_IDS))
    units = units.repartitionByRange(max(1, tasks), "file", "unit").sortWithinPartitions("file", "unit")
    return units.mapInArrow(run, "doc_id string, start long, n_tokens long, ids_crc32 long")


def stored(docs: DataFrame, tokenizer: str = BYTE_BPE, end: int = 2) -> DataFrame:
    """Writes the ids of docs to files in the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    back = read(spark, write(docs, shared_path(spark, "rans"), tokenizer, end))
    return back.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
