"""Sets of word shingles that operator 11 and the pipeline's near-dedup join: how they are made, cut into parts and compared.

A set holds 64-bit hashes of its text's shingles. Sets a and b, a the smaller, that share at least `least` percent of their
union differ in at most D = a * (100 - least) // least hashes: the union is at most 100 * a / least, and what differs is
at most (100 - least) percent of it. So of any D + 1 disjoint ranges of hash values at least one holds the same hashes in both.

Sizes are in bands, from a power of two to the next; a pair lies in one band or in two that follow each other. The ranges of
a band divide all values evenly, SPREAD times as many as the largest sets of the band may differ in. A set goes through them from below,
takes those that hold at least FULL of its hashes until it has D + 1 for its own size, and puts a hash of what each holds in a
bucket: a part. It does so under its own band's ranges and, if it may be alike to a set of the band below, under those with the D of
that band's largest size at most. Of two alike sets take the one that ends first: it took D + 1 ranges, one of them holds the same hashes in the other,
which has not ended before and so took it too. A set that finds too few ranges takes all it has and, besides, its prefix:
two such sets, neither of which ended, share a hash of the prefixes of n - ceil(least % of n) + 1 hashes. Parts of
two hashes and more are hardly ever shared by chance, so buckets grow with the input, not with its square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import CHUNK_CHARS, slots_of, slotted, written

#: Ranges of a band for each that its largest sets need, and hashes that a part has at least.
SPREAD, FULL = 1.6, 2
#: Places of the parities.
BITS = 1024
#: Partners that a node's set is sent to at a time.
STRIP = 256
#: Set keys that a task remembers having written.
SEEN = 1 << 20

#: Bytes of a text that are hashed at a time; a shingle of more than half of that is hashed alone.
BLOCK = 1 << 17

P, Q = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * P
    return h ^ (h >> np.uint64(29))


#: A number for each byte, and powers of an odd number and of its inverse: a shingle's hash is the sum of its bytes' numbers times the powers of their places in it.
BYTES = mixed(mixed(np.arange(1, 257, dtype=np.uint64) * Q))
BASE = 0x5851F42D4C957F2B
POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(BLOCK, BASE, dtype=np.uint64))])
INVERSE = np.concatenate([[np.uint64(1)], np.cumprod(np.full(BLOCK, pow(BASE, -1, 1 << 64), dtype=np.uint64))])


def distinct(h: np.ndarray) -> np.ndarray:
    """Ascending distinct values, as signed; by sorting, which here is several times as fast as numpy's own unique()."""
    h = np.sort(h.view(np.int64))
    first = np.ones(len(h), dtype=bool)
    np.not_equal(h[1:], h[:-1], out=first[1:])
    return h[first]


def hashed(line: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the parts of at most BLOCK bytes, by differences of running sums."""
    sums = np.zeros(len(line) + 1, dtype=np.uint64)
    np.cumsum(BYTES[line] * POWERS[: len(line)], out=sums[1:])
    return mixed(mixed((sums[ends] - sums[starts]) * INVERSE[starts] + (ends - starts).astype(np.uint64) * Q))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Ascending distinct hashes (as signed) of the text's shingles, words joined by one space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    joined = b" ".join(words)
    line = np.frombuffer(joined, dtype=np.uint8)
    ends = np.append(np.flatnonzero(line == 32), len(line))
    starts = np.concatenate([[0], ends[:-1] + 1])
    wide = min(width, len(ends))
    starts, ends = starts[: len(ends) - wide + 1], ends[wide - 1 :]
    if len(line) <= BLOCK // 2:
        return distinct(hashed(line, starts, ends))
    out = []
    alone = ends - starts > BLOCK // 2
    for i in np.flatnonzero(alone).tolist():
        out.append(np.array([xxhash.xxh64_intdigest(joined[starts[i] : ends[i]], 42)], dtype=np.uint64))
    starts, ends = starts[~alone], ends[~alone]
    for at in range(0, len(line), BLOCK // 2):
        i, j = np.searchsorted(starts, [at, at + BLOCK // 2])
        if i < j:
            out.append(hashed(line[at : at + BLOCK], starts[i:j] - at, ends[i:j] - at))
    return distinct(np.concatenate(out))


def prefix_size(n: int, least: int) -> int:
    return n - -(-n * least // 100) + 1 if n else 0


def key_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)


def parities(own: np.ndarray) -> np.ndarray:
    """For each of BITS places, whether an odd number of hashes fall there, as longs."""
    odd = np.bincount((own.view(np.uint64) >> np.uint64(7)) % np.uint64(BITS), minlength=BITS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def most_apart(n: int, least: int) -> int:
    """Hashes that a set of n and one that is not smaller differ in at most, if they are alike."""
    return n * (100 - least) // least


def lowest(own: np.ndarray, least: int) -> np.ndarray:
    """A set's prefix in the order of the hashes."""
    return own[: prefix_size(len(own), least)]


def parts_of(own: np.ndarray, least: int, prefix: Callable[[np.ndarray, int], np.ndarray] = lowest) -> np.ndarray:
    """Hashes of a set's parts, and of its prefix where it has too few; sets that may only be alike to equal ones have none."""
    n, out = len(own), []
    band = n.bit_length() - 1
    values = own.view(np.uint64) ^ np.uint64(1 << 63)  # ascending, as own is as signed
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(values))])
    for j in (band, band - 1):
        top = (2 << j) - 1 if j >= 0 else 0
        need = most_apart(min(n, top), least) + 1
        if need == 1 or n * least > 100 * top:
            continue
        mark = mixed(np.array([j], dtype=np.uint64))
        ranges = int(SPREAD * (most_apart(top, least) + 1)) + 1
        at = (values >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        ends = np.append(starts[1:], n)
        full = ends - starts >= FULL
        starts, ends = starts[full][:need], ends[full][:need]
        out.append(mixed((sums[ends] - sums[starts]) ^ mark))
        if len(starts) < need:
            out.append(mixed(mixed(prefix(own, least).view(np.uint64) * Q) ^ mark))
    return np.concatenate([np.zeros(0, dtype=np.uint64), *out]).view(np.int64)


def texts_in(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with their texts as bytes; null texts are empty."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    start = 0
    while start < len(sizes):
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), CHUNK_CHARS, side="right")))
        part = batch.slice(start, stop - start)
        yield part, [t or b"" for t in part.column("text").to_pylist()]
        start = stop
    pa.default_memory_pool().release_unused()


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else [], kind))


def made(docs: DataFrame, wanted: np.ndarray | None, make: Callable[[np.ndarray], list[np.ndarray]], width: int, names: list[str]) -> DataFrame:
    """key and make(set), an array for each of the names, for the texts whose hash may be among `wanted`, at most once a key and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(slotted(wanted, batch.column("th").to_numpy())))
            for _, texts in texts_in(batch):
                keys, out = [], []
                for t in texts:
                    s = shingle_set(t, width)
                    k = key_of(s)
                    if k not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(k)
                        keys.append(k)
                        out.append(make(s))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[lists([o[i] for o in out], pa.int64()) for i in range(len(names))]], ["key", *names])

    return docs.select(F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "key long, " + ", ".join(f"{n} array<long>" for n in names))


def fit(n: str | Column, m: str | Column, least: int) -> Column:
    """Sets of sizes n and m may share enough."""
    return 100 * F.least(n, m) >= least * F.greatest(n, m)


def with_ends(pairs: DataFrame, nodes: DataFrame, names: list[str]) -> DataFrame:
    """pairs (a, b) with columns of both nodes, as name_a and name_b."""
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("key").alias(end), *[F.col(n).alias(f"{n}_{end}") for n in names]), end)
    return pairs


def close(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose sizes and parities allow a link."""
    both = F.col("n_a") + F.col("n_b")
    differ = F.expr("aggregate(zip_with(bits_a, bits_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    got = with_ends(pairs, nodes, ["n", "bits"]).filter(fit("n_a", F.col("n_b"), least))
    return got.filter(differ <= both - 2 * F.ceil(least * both / (100 + least))).select("a", "b")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, least: int) -> DataFrame:
    """The pairs (a, b) whose whole sets share enough. The end with more pairs is the centre: its set meets its partners' in strips."""
    pairs = written(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("d"))
    rows = with_ends(pairs, ends, ["d"])
    centre = F.expr("d_a > d_b OR d_a = d_b AND a < b")
    rows = rows.select(F.when(centre, F.col("a")).otherwise(F.col("b")).alias("centre"), F.when(centre, F.col("b")).otherwise(F.col("a")).alias("key"), F.ceil(F.greatest("d_a", "d_b") / STRIP).cast("int").alias("strips"))
    rows = written(rows.withColumn("strip", F.pmod(F.xxhash64("key"), "strips").cast("int")), "strips")  # it is read twice: in one plan it would be there twice
    centres = rows.select("centre", F.col("centre").alias("key"), "strip").distinct()
    roles = rows.select("centre", "key", "strip", F.lit(1).alias("partner")).unionByName(centres.withColumn("partner", F.lit(0)))
    texts = nodes.join(ends, "key", "left_semi").select("th")
    sets = made(docs, slots_of(texts, "th"), lambda s: [s], width, ["own"])
    sets = sets.groupBy("key").agg(F.first("own").alias("own"))
    met = roles.join(sets, "key").repartition("centre", "strip").sortWithinPartitions("centre", "strip", "partner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, np.zeros(0, dtype=np.int64)
        for batch in batches:
            centre, key, strip, partner = (batch.column(c).to_numpy() for c in ("centre", "key", "strip", "partner"))
            own = batch.column("own")
            ends, flat = own.offsets.to_numpy(), own.values.to_numpy()
            a, b = [], []
            for i in range(len(key)):
                s = flat[ends[i] : ends[i + 1]]
                if not partner[i]:
                    group, held = (centre[i], strip[i]), s.copy()
                elif group == (centre[i], strip[i]) and len(s) and len(held):
                    shared = int((held[np.minimum(np.searchsorted(held, s), len(held) - 1)] == s).sum())
                    if 100 * shared >= least * (len(s) + len(held) - shared):
                        a.append(centre[i])
                        b.append(key[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            del own, flat, batch
            pa.default_memory_pool().release_unused()

    return written(met.select("centre", "strip", "partner", "key", "own").mapInArrow(run, "a long, b long"), "alike")


def in_shared_parts(docs: DataFrame, width: int, least: int, prefix: Callable[[np.ndarray, int], np.ndarray] = lowest) -> DataFrame:
    """h and key for the buckets that parts of two sets or more are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, texts in texts_in(batch):
                keys, parts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
                for t in texts:
                    s = shingle_set(t, width)
                    k = key_of(s)
                    if k not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(k)
                        parts.append(parts_of(s, least, prefix))
                        keys.append(np.full(len(parts[-1]), k, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(parts))], ["key", "h"])

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "key long, h long").filter("h IS NOT NULL").repartition("h")
    shared = rows.groupBy("h").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select("h")
    return written(rows.distinct().join(shared.hint("shuffle_hash"), "h", "left_semi"), "members")  # distinct first: both sides then use one shuffle
