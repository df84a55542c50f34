"""Operator 6: SimHash near-duplicates by covering locality-sensitive hashing.

Words of a text (A-Z lower-cased, cut at ASCII white space) make shingles of `width` words; bit b of the fingerprint is
set if it is set in over half of the shingles' XXH64 values. Fingerprints at `radius` or fewer differing bits link.

Each bit has a vector of radius + 1 bits; mask v (all v but zero) keeps the bits whose vector has an odd product with v.
At most `radius` differing bits leave some v orthogonal to all their vectors, so under that mask the two agree: every
pair within the radius meets in some of the 2^(radius + 1) - 1 tables. Equal fingerprints are one node. A bucket of two
gives its pair at once; larger ones are compared in blocks of bounded size, spread over tasks by pairs of blocks, and
give only links that join what they connect, never all pairs. Components are found by star contraction.

Null and blank texts have fingerprint zero, linked like any other. Repeated rows each give a row. Rows without a doc_id
get a component like others; the smallest doc_id leaves nulls out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import chunks, written

#: Members of a bucket that are compared with one another in one place.
BLOCK = 2048
#: Members that small buckets have at most; they are compared many buckets at a time.
SMALL = 64


def shingle_hashes(text: str, width: int, seed: int = 42) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    h = xxhash.xxh64_intdigest
    return np.array([h(line[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                fps = np.array([fingerprint(shingle_hashes(t, width)) for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def masks(radius: int, bits: int = 64) -> list[int]:
    """One mask for each v: the vectors of bits go round all values of radius + 1 bits, so masks keep about half of the bits."""
    size = 1 << (radius + 1)
    return [sum(1 << b for b in range(bits) if (b % size & v).bit_count() % 2) for v in range(1, size)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def joined(members: np.ndarray, radius: int) -> np.ndarray:
    """For rows of equally many fingerprints: for each the least place in its row that it is connected with."""
    near = np.bitwise_count(members[:, :, None] ^ members[:, None, :]) <= radius
    n = members.shape[1]
    labels = np.broadcast_to(np.arange(n), members.shape).copy()
    while True:
        new = np.where(near, labels[:, None, :], n).min(axis=2)
        if (new == labels).all():
            return labels
        labels = new


def joined_large(members: np.ndarray, radius: int) -> np.ndarray:
    """The same for one larger group, in strips."""
    n, strip = len(members), 256
    near = np.empty((n, n), dtype=bool)
    for i in range(0, n, strip):
        near[i : i + strip] = np.bitwise_count(members[i : i + strip, None] ^ members[None, :]) <= radius
    labels = np.arange(n)
    while True:
        new = np.concatenate([np.where(near[i : i + strip], labels[None, :], n).min(axis=1) for i in range(0, n, strip)])
        if (new == labels).all():
            return labels
        labels = new


def group_links(groups: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """groups: ascending numbers of whole groups. Links from each member to the first that it is connected with."""
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(groups)]]))
    left, right = [], []
    for size in np.unique(sizes):
        if size < 2:
            continue
        own = starts[sizes == size]
        step = max(1, (1 << 20) // int(size * size)) if size <= SMALL else 1
        for i in range(0, len(own), step):
            members = fps[own[i : i + step, None] + np.arange(size)[None, :]].view(np.uint64)
            labels = joined(members, radius) if size <= SMALL else joined_large(members[0], radius)[None, :]
            moved = labels != np.arange(size)[None, :]
            left.append(members[moved])
            right.append(np.take_along_axis(members, labels, axis=1)[moved])
    empty = np.zeros(0, dtype=np.uint64)
    return np.concatenate([empty, *left]).view(np.int64), np.concatenate([empty, *right]).view(np.int64)


def links(nodes: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """nodes: distinct fp. Links (a, b) that connect exactly what pairs within the radius connect."""
    tables = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks(radius)])).alias("t", "key")
    rows = nodes.select("fp", tables)
    buckets = rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    buckets = written(buckets, "buckets")
    pairs = buckets.filter("n = 2").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    blocks = F.ceil(F.col("n") / block).cast("int")
    large = rows.join(buckets.filter("n > 2").select("t", "key", blocks.alias("blocks")), ["t", "key"])
    large = large.withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other"))
    large = large.select(group.alias("g"), "fp").repartition("g").sortWithinPartitions("g", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, fps = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            groups, fps = np.concatenate([groups, batch.column("g").to_numpy()]), np.concatenate([fps, batch.column("fp").to_numpy()])
            whole = int(np.searchsorted(groups, groups[-1], side="left")) if len(groups) else 0  # the last group may go on
            if whole:
                a, b = group_links(groups[:whole], fps[:whole], radius)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                groups, fps = groups[whole:], fps[whole:]
        if len(groups):
            a, b = group_links(groups, fps, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return pairs.unionByName(large.mapInArrow(run, "a long, b long"))


def are_stars(edges: DataFrame) -> bool:
    """Whether distinct edges (a, b) with a > b lead each a to its root: an a has one edge, and is no b of another."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("leads")), F.struct(F.col("b").alias("node"), F.lit(0).alias("leads")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.max("leads").alias("leads"), F.count("*").alias("n")).filter("leads = 1 AND n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): node and root, the least node connected with it, for all nodes but roots.

    Large and small star steps in turn, until all edges lead to roots: each joins the neighbours of a node to the least of them.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # edges hold a > b; seen from b, the larger neighbour a goes to b's least
        edges = edges.join(least.withColumnRenamed("a", "b"), "b").filter("a <> m").select("a", F.col("m").alias("b")).distinct()
        edges = written(edges, "edges")  # it is read twice: in one plan the step so far would be there twice
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = edges.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = written(edges, "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def connected(roots: DataFrame, new: DataFrame) -> DataFrame:
    """node and root after new links (a, b), where components() gave roots before them."""
    return roots if new.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new))


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id reachable by links."""
    marked = written(fingerprints(docs, width), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(classes, "fp").select("doc_id", text.alias("fingerprint"), "component_id")
