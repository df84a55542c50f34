"""SimHash near-duplicates with an exact check, for the pipeline: texts link if their shingle sets are alike enough.

The set of a text holds the hashes of its shingles (by default of five words). Two texts link if their sets share at least
LEAST percent of what they hold together. Equal sets are one node. Candidates come in two ways:

* SimHash with covering tables (operator 6, here over the shingles of the sets' width): every pair within RADIUS bits. This
  joins most copies, and what it joined is not compared again.
* Sets may be alike enough and still lie farther apart in bits (up to 13 of 64 were seen at 80 percent; covering tables for
  that need keys of a few bits, whose buckets grow with the square of the corpus). The rest is found by parts of the sets: two
  such sets hold the same hashes in one of so many ranges of values (`wayfold/llm/shingles.py`).

Each candidate pair passes two exact tests: parities of the sets' hashes in BITS places differ in no more places than the
sets may; then the sets themselves, made anew from the texts of these pairs only. Buckets are first compared with one member,
which joins most of a group of copies. Then members that are still apart are compared by their parities, in blocks of bounded
size, each member outside the bucket's largest component with all others: first each is paired with the likeliest member of
each other component, and of those that are apart after that, with all that the parities allow.

Null and blank texts have an empty set and are one node. Rows without a doc_id get a component like others; the smallest
doc_id leaves nulls out. Repeated rows each give a row, an empty table none; other columns do not matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.llm import simhash
from wayfold.llm.common import folded, in_slots, slots_of, unfolded, written
from wayfold.llm.shingles import close, in_shared_parts, key_of, lists, parities, shingle_set, texts_in, verified
from wayfold.llm.simhash import components, connected, fingerprint

#: Words of a shingle, percent that sets share, and bits of the SimHash that candidates of the first way differ in.
WIDTH, LEAST, RADIUS = 5, 80, 4
#: Members of a bucket in a block.
BLOCK = 2048


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, th (a hash of the text), key (a hash of the set), n (its size), fp (the SimHash of the set) and its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in texts_in(batch):
                sets = [shingle_set(t, width) for t in texts]
                prints = np.array([fingerprint(s.view(np.uint64)) for s in sets], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array([key_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(prints), lists([parities(s) for s in sets], pa.int64())], ["doc_id", "th", "key", "n", "fp", "bits"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, key long, n int, fp long, bits array<long>")


def rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members of buckets that hold more than one component, with the root of theirs."""
    rows = members.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    apart = rows.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("h")
    return written(rows.join(apart, "h", "left_semi"), "apart")


def group_pairs(keys: np.ndarray, sizes: np.ndarray, roots: np.ndarray, bits: np.ndarray, likeliest: bool, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one group's members of different components that the parities allow; likeliest: for each member and component the closest."""
    _, which, counts = np.unique(roots, return_inverse=True, return_counts=True)
    own = np.flatnonzero(which != counts.argmax())
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    sizes = sizes.astype(np.int64)
    strip = max(1, (1 << 18) // len(keys))
    for i in range(0, len(own), strip):
        x = own[i : i + strip]
        n, m = sizes[x, None], sizes[None, :]
        differ = np.bitwise_count(bits[x, None, :] ^ bits[None, :, :]).sum(axis=2, dtype=np.int64)
        open_ = (which[x, None] != which[None, :]) & (100 * np.minimum(n, m) >= least * np.maximum(n, m)) & (differ <= n + m - 2 * -(-least * (n + m) // (100 + least)))
        at, to = np.nonzero(open_)
        if likeliest and len(at):
            order = np.lexsort((differ[at, to], which[to], at))
            at, to = at[order], to[order]
            first = np.concatenate([[True], (at[1:] != at[:-1]) | (which[to][1:] != which[to][:-1])])
            at, to = at[first], to[first]
        left.append(np.minimum(keys[x[at]], keys[to]))
        right.append(np.maximum(keys[x[at]], keys[to]))
    return np.concatenate(left), np.concatenate(right)


def compared(members: DataFrame, nodes: DataFrame, likeliest: bool, least: int = LEAST, block: int = BLOCK, pick: Callable = group_pairs) -> DataFrame:
    """Pairs (a, b) of keys in a bucket that may be alike and are not connected; members: h, key, n, root. pick: what gives a group's pairs."""
    blocks = members.groupBy("h").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = members.join(blocks, "h").join(nodes.select("key", "bits"), "key")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")).alias("g")
    rows = rows.select(group, "key", "n", "root", "bits").repartition("g").sortWithinPartitions("g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            now = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if now is None or not now.num_rows:
                continue
            now = now.combine_chunks()
            g, keys, sizes, roots = (now.column(c).to_numpy() for c in ("g", "key", "n", "root"))
            bits = now.column("bits").chunk(0).flatten().to_numpy().view(np.uint64).reshape(len(g), -1)
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])).tolist()
            ends = [*starts[1:], len(g)]
            if batch is not None:  # the last group may go on
                held = now.slice(starts[-1])
                starts, ends = starts[:-1], ends[:-1]
            pairs = [pick(keys[a:b], sizes[a:b], roots[a:b], bits[a:b], likeliest, least) for a, b in zip(starts, ends, strict=True)]
            empty = np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *[p[i] for p in pairs]])) for i in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def simhash_pairs(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of keys that connect what lies within the radius: by the links of operator 6, and those of one fingerprint with the first of them."""
    one = nodes.groupBy("fp").agg(F.min("key").alias("own"))
    same = nodes.join(one, "fp").filter("key <> own").select(F.col("own").alias("a"), F.col("key").alias("b"))
    near = simhash.links(one.select("fp"), radius)
    for end in ("a", "b"):
        near = near.join(one.select(F.col("fp").alias(end), F.col("own").alias(f"key_{end}")), end)
    return same.unionByName(near.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")))


def roots_of(docs: DataFrame, nodes: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """node and root (keys) for all nodes but roots of the components that pairs that share enough make; each new link goes on from the roots before it."""
    full = nodes.filter("n > 0")
    roots = components(verified(close(simhash_pairs(full), full, least), full, docs, width, least))
    now = rooted(in_shared_parts(docs, width, least).join(full.select("key", "n"), "key"), roots)
    one = now.groupBy("h").agg(F.min(F.struct(F.xxhash64("key"), "key", "root")).alias("one"))
    pairs = now.join(one, "h").filter(F.col("root") != F.col("one.root"))
    pairs = pairs.select(F.least("key", "one.key").alias("a"), F.greatest("key", "one.key").alias("b")).distinct()
    roots = connected(roots, verified(close(pairs, full, least), full, docs, width, least))
    for likeliest in (True, False):
        now = rooted(now.select("h", "key", "n"), roots)
        if now.isEmpty():
            break
        roots = connected(roots, verified(compared(now, full, likeliest, least), full, docs, width, least))
    return roots


def near_duplicates(docs: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """doc_id, th (xxhash64 of the text), component_id, the smallest doc_id reachable by links, and component, a number of it that is never null."""
    marked = written(signatures(docs, width), "signatures")
    nodes = written(marked.groupBy("key").agg(F.min("doc_id").alias("first"), F.min("th").alias("th"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("bits").alias("bits")), "nodes")
    roots = roots_of(docs, nodes, width, least)
    named = nodes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.select("key", "root").join(smallest, "root").select("key", F.col("root").alias("component"), "component_id")
    return marked.select("doc_id", "th", "key").join(classes, "key").select("doc_id", "th", "component_id", "component")


def deduplicated(docs: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id, then of the least text hash; columns as in docs.

    Rows are told apart by doc_id and text, so different texts of one doc_id stay, and rows without a doc_id, which come
    last, are deduplicated too. Only texts whose hash may be among those of rows that go are shuffled; a filter of fixed size tells the others.
    """
    names, own = docs.columns, ["doc_id", "text"]
    each = near_duplicates(docs, width, least).groupBy("doc_id", "th", "component").agg(F.count("*").alias("n"))
    each = written(each, "groups")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    best = each.groupBy("component").agg(F.min(order).alias("best"))
    marked = each.join(best, "component").withColumn("stays", F.expr("doc_id <=> best.doc_id AND th = best.th"))
    goes = written(marked.filter("NOT stays OR n > 1").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("stays").alias("_once")), "goes")
    every = folded(docs, own).withColumn("_x", F.xxhash64("text"))
    may_go = in_slots("_x", slots_of(goes, "_th"))
    rows = every.filter(may_go)
    same = F.expr("doc_id <=> _id AND _x = _th")
    once = rows.join(goes.filter("_once"), same, "left_semi")
    first = W.partitionBy("doc_id", "_x").orderBy(F.lit(0))
    once = once.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")
    return unfolded(every.filter(~may_go).unionByName(rows.join(goes, same, "left_anti")).unionByName(once), names, own)
