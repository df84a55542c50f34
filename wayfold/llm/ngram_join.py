"""Operator 11: documents whose sets of word shingles are alike, by first tokens under several orders and by shared parts of sets.

A text (A-Z lower-cased, cut at ASCII white space) has the set of its distinct shingles of `width` words; with fewer words
the whole sequence is one, with none the set is empty and links with nothing. Two texts link if their sets share at least
`least` percent of their union. Texts of equal sets are one node.

1. Nodes that share the very first token under one of ORDERS orders of all tokens are compared with one node of that bucket;
   near copies mostly are joined here, so that later buckets hold few components.
2. Two alike sets share a part of theirs, whatever they are (`wayfold/llm/shingles.py` has the proof); a set that has too few
   parts brings its prefix as well. Buckets of the parts that hold one component say nothing new.
3. In the others, members outside the largest component are compared with all by the parities of their sets (blocks of
   bounded size). Of the pairs that may be alike first only a forest is taken that would connect them all, the closest pairs
   first; then, where members are still apart, all. What is left is compared by its whole sets.

Null and blank texts have no shingles and are components of their own. Rows without a doc_id get a component like others; the
smallest doc_id leaves nulls out, so it is null only where no row of the component has one. Repeated rows each give a row, an
empty table none; other columns do not matter. A very long text is one array of its tokens in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import written
from wayfold.llm.jaccard import compared, group_pairs, rooted
from wayfold.llm.shingles import close, in_shared_parts, key_of, lists, parities, prefix_size, shingle_set, texts_in, verified
from wayfold.llm.simhash import components, connected

#: Words of a shingle, and percent of the union that linked sets share.
WIDTH, LEAST = 4, 85
#: Odd factors: a token's place in an order is its product with the order's factor, modulo 2^64.
ORDERS = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def places(tokens: np.ndarray, factor: int) -> np.ndarray:
    return tokens.view(np.uint64) * np.uint64(factor)


def prefixes_of(own: np.ndarray, common: np.ndarray, powers: np.ndarray, least: int) -> list[np.ndarray]:
    """The first tokens of a set under each order; common: ascending common tokens, powers: powers of two of their counts."""
    if not len(own):
        return [own for _ in ORDERS]
    late = np.zeros(len(own), dtype=np.uint64)
    if len(common):
        near = np.minimum(np.searchsorted(common, own), len(common) - 1)
        late = np.where(common[near] == own, powers[near], 0).astype(np.uint64) << np.uint64(58)
    last, out = prefix_size(len(own), least) - 1, []
    for factor in ORDERS:
        at = late | (places(own, factor) >> np.uint64(6))
        out.append(own[at <= np.partition(at, last)[last]])
    return out


def prefix_of(own: np.ndarray, least: int) -> np.ndarray:
    """A set's prefix under the first order."""
    none = np.zeros(0, dtype=np.int64)
    return prefixes_of(own, none, none, least)[0]


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, th (hash of the text), key (hash of the set), n (its size), parities and the first token under each order."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in texts_in(batch):
                sets = [shingle_set(t, width) for t in texts]
                firsts = [np.array([s[places(s, f).argmin()] for f in ORDERS], dtype=np.int64) if len(s) else np.zeros(len(ORDERS), dtype=np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array([key_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), lists([parities(s) for s in sets], pa.int64()), lists(firsts, pa.int64())], ["doc_id", "th", "key", "n", "bits", "firsts"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, th long, key long, n int, bits array<long>, firsts array<long>")


def first_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b): each node with one node of each bucket of first tokens."""
    rows = nodes.select("key", F.posexplode("firsts").alias("o", "h"))
    one = rows.groupBy("o", "h").agg(F.min(F.struct(F.xxhash64("key"), "key")).alias("one"))
    return rows.join(one, ["o", "h"]).filter("key <> one.key").select(F.least("key", "one.key").alias("a"), F.greatest("key", "one.key").alias("b")).distinct()


def forest_pairs(keys: np.ndarray, sizes: np.ndarray, roots: np.ndarray, bits: np.ndarray, likeliest: bool, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a group's pairs that the parities allow as many as connect what they all connect, the closest of each member first."""
    _, which, counts = np.unique(roots, return_inverse=True, return_counts=True)
    label, n, left, right = which.copy(), sizes.astype(np.int64), [], []
    for x in np.flatnonzero(which != counts.argmax()).tolist():
        apart = np.flatnonzero((label != label[x]) & (100 * np.minimum(n, n[x]) >= least * np.maximum(n, n[x])))
        if not len(apart):
            continue
        both = n[apart] + n[x]
        differ = np.bitwise_count(bits[apart] ^ bits[x]).sum(axis=1, dtype=np.int64)
        fits = differ <= both - 2 * -(-least * both // (100 + least))
        apart, slack = apart[fits], differ[fits] / both[fits]
        for j in apart[np.argsort(slack, kind="stable")].tolist():
            if label[j] != label[x]:
                left.append(min(keys[x], keys[j]))
                right.append(max(keys[x], keys[j]))
                label[label == label[j]] = label[x]
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def in_buckets(members: DataFrame, nodes: DataFrame, likeliest: bool, least: int) -> DataFrame:
    """Pairs (a, b) of members of a bucket that are not connected and whose parities allow a link: all, or those that would connect the most likely.

    A bucket of two is its pair; larger ones go to compared().
    """
    sizes = members.groupBy("h").agg(F.count("*").alias("size"), F.min("key").alias("a"), F.max("key").alias("b"))
    twos = close(sizes.filter("size = 2").select("a", "b").distinct(), nodes, least)
    larger = members.join(sizes.filter("size > 2").select("h"), "h", "left_semi")
    pick = forest_pairs if likeliest else group_pairs
    return written(twos.unionByName(compared(larger, nodes, likeliest, least, pick=pick)).distinct(), "compared")


def roots_of(docs: DataFrame, nodes: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """node and root (keys) for all nodes but roots of the components that pairs of alike sets make."""
    full = nodes.filter("n > 0")
    roots = components(verified(close(first_pairs(full), full, least), full, docs, width, least))
    now = in_shared_parts(docs, width, least, prefix_of).join(full.select("key", "n"), "key")
    for likeliest in (True, False):
        now = rooted(now.select("h", "key", "n"), roots)
        if now.isEmpty():
            break
        roots = connected(roots, verified(in_buckets(now, full, likeliest, least), full, docs, width, least))
    return roots


def joined(docs: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links."""
    marked = written(signatures(docs, width), "sets")
    nodes = marked.groupBy("key").agg(F.min("doc_id").alias("first"), F.min("th").alias("th"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("firsts").alias("firsts"))
    nodes = written(nodes, "nodes")
    roots = roots_of(docs, nodes, width, least)
    named = nodes.filter("n > 0").select("key", "first").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = written(named.join(named.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("key", "component_id"), "classes")
    own: Column = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return marked.select("doc_id", "key", "n").join(classes, "key", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))
