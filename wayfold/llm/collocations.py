"""Operator 12: phrase collocations from suffix arrays over word ids.

A text (A-Z lower-cased) is cut at [.,;:!?\\x0A-\\x0D] into pieces, these at spaces and tabs into words. Everything is per lang
(null: `und`). Each task numbers the words of a shard (about SHARD words of one lang, whole pieces), sorts the shard's suffixes
by prefix doubling (by one word, by two, by four, with numpy; no phrase is longer) and takes the lengths of the prefixes that
neighbours share: an interval of neighbours that share at least m words is a phrase of m words, its width is how often the
shard has it. Counts of a phrase are summed over shards by the phrase itself.

Most phrases are rare, and a phrase is never more frequent than what it holds. So words are counted first; then pairs of
frequent words, by hashes alone (two pairs of one hash count together, so that none is missed); then, by their words, the phrases of
which each two neighbours are a frequent pair. What is frequent goes to the tasks as a filter of SLOTS bits (one bit a hash): it
lets through all that is frequent and, the more there is, some that is not, whose count then says so. No phrase is lost by it.

A candidate of a occurrences is cut into a first part (l occurrences) and a rest (r): its score is the least of
floor(2000000 * a / (l + r)) over its cuts, by decimals. Candidates within a longer one that has 80 % of their occurrences go.
The first TOP of each lang are found among the first TOP of each of SPREAD parts of the lang.

Null and empty texts have no words. Repeated rows count each. An empty table gives no rows; other columns do not matter. A very
long text is worked through in slices that end at a piece's end; a piece without one is held whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.llm.common import slots_of, slotted, written

#: Least occurrences, most words of a phrase, percent that a longer phrase must hold to replace a part, phrases returned for each lang.
LEAST, WORDS, HELD, TOP = 30, 4, 80, 2000
#: Words of a shard; shards' worth of words that a task holds over all langs; bytes of text that are cut at a time; parts of a lang for the first ranking.
SHARD, LANGS, SLICE, SPREAD = 1 << 20, 4, 1 << 22, 64
#: Phrases that are put together at a time, and an odd number that mixes hashes.
ROWS, MIX = 50_000, np.uint64(0x9FB21C651E98DF25)
#: What a lang's null stands for.
UNKNOWN = "und"

#: A-Z lower-cased, marks that end a piece to line ends, tabs to spaces.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")


def slices(text: bytes) -> Iterator[bytes]:
    """The text in slices of about SLICE bytes, cut where pieces end."""
    text, at = text.translate(TABLE), 0
    while at < len(text):
        end = len(text) if len(text) - at <= SLICE else text.find(b"\n", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end + 1


class WordIds(dict):
    """Ids by word, given on demand from 1 on. 0 ends a piece; its sign is a comma, which slices() leaves in no text."""

    def __init__(self):
        super().__init__({b",": 0})
        self.words = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self.words)
        self.words.append(word)
        return self[word]


class Shard:
    """Word ids of one lang's pieces."""

    def __init__(self, lang: str):
        self.lang, self.ids, self.parts, self.size = lang, WordIds(), [], 0

    @property
    def words(self) -> list[bytes]:
        return self.ids.words

    def add(self, text: bytes) -> int:
        found = text.replace(b"\n", b" , ").split()
        self.parts += [np.fromiter(map(self.ids.__getitem__, found), dtype=np.int64, count=len(found)), np.zeros(1, dtype=np.int64)]
        self.size += len(found) + 1
        return len(found) + 1

    def sequence(self) -> np.ndarray:
        return np.concatenate([*self.parts, np.zeros(WORDS, dtype=np.int64)])


def hashed(lang: str, phrases: list[bytes]) -> np.ndarray:
    """Hashes of keys, as xxhash64() gives in Spark."""
    head = lang.encode() + b"\n"
    return np.array([xxhash.xxh64_intdigest(head + p, 42) for p in phrases], dtype=np.uint64).view(np.int64)


def parts_of(k: Column) -> list[Column]:
    """lang and phrase of a key: lang, a line end, phrase. A phrase holds no line end, so the last one counts."""
    phrase = F.substring_index(k, "\n", -1)
    return [F.left(k, F.length(k) - F.length(phrase) - 1).alias("lang"), phrase.alias("phrase")]


def doubled(rank: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and ranks of suffixes by their first 2 * by words, from ranks by their first `by`."""
    after = np.concatenate([rank[by:], np.zeros(by, dtype=np.int64)])
    key = rank * (int(rank.max(initial=0)) + 1) + after
    order = np.argsort(key, kind="stable")
    new = np.empty_like(rank)
    new[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
    return order, new


def intervals(seq: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For m = 2 .. most: m, a place of each phrase of m words (none of them 0), and how often it occurs."""
    rank, by = seq, 1
    while by < most:
        order, rank = doubled(rank, by)
        by *= 2
    padded = np.concatenate([seq, np.zeros(most, dtype=np.int64)])
    same = np.ones(len(order), dtype=bool)  # whether a suffix shares its first m words with the one before it
    whole = np.ones(len(order), dtype=bool)
    same[:1] = False
    for m in range(1, most + 1):
        word = padded[order + m - 1]
        same[1:] &= word[1:] == word[:-1]
        whole &= word > 0
        if m > 1:
            starts = np.flatnonzero(~same)
            counts = np.diff(np.concatenate([starts, [len(order)]]))
            sound = whole[starts]
            yield m, order[starts[sound]], counts[sound]


def phrases_at(shard: Shard, seq: np.ndarray, at: np.ndarray, m: int) -> list[bytes]:
    words = shard.words
    return [b" ".join([words[i] for i in own]) for own in seq[at[:, None] + np.arange(m)[None, :]].tolist()]


def sharded(docs: DataFrame, count: Callable[[Shard], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The batches that `count` makes of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                lang = lang.as_py()
                for part in slices(text.as_py()):
                    shard = shards.setdefault(lang, Shard(lang))
                    held += shard.add(part)
                    if shard.size >= SHARD or held >= LANGS * SHARD:
                        for s in [shard] if shard.size >= SHARD else [*shards.values()]:
                            held -= s.size
                            yield from count(shards.pop(s.lang))
                        pa.default_memory_pool().release_unused()
        for shard in shards.values():
            yield from count(shard)

    rows = docs.filter("text IS NOT NULL").select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, schema)


PHRASES = "k string, c long"


def rows_of(shard: Shard, seq: np.ndarray, at: np.ndarray, m: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """k (lang, line end, phrase: one column is a smaller shuffle than two) and c, ROWS at a time."""
    head = shard.lang.encode() + b"\n"
    for i in range(0, len(at), ROWS):
        own = pa.array([head + p for p in phrases_at(shard, seq, at[i : i + ROWS], m)], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([own, pa.array(counts[i : i + ROWS])], ["k", "c"])


def word_counts(shard: Shard) -> Iterator[pa.RecordBatch]:
    """Counts of words, and of all words under the empty one."""
    counts = np.bincount(shard.sequence(), minlength=len(shard.words))
    counts[0] = counts[1:].sum()
    yield from rows_of(shard, np.arange(len(shard.words)), np.arange(len(shard.words)), 1, counts)


def word_hashes(shard: Shard, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shard's words, and its sequence with rare words as ends of pieces."""
    hashes = np.concatenate([[0], hashed(shard.lang, shard.words[1:])])
    stays = slotted(words, hashes)
    stays[0] = False
    seq = shard.sequence()
    return hashes, np.where(stays[seq], seq, 0)


def pair_hashes(hashes: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs of words, by those of the words."""
    h = hashes[first].view(np.uint64) * MIX + hashes[second].view(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * MIX
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def pair_counts(words: np.ndarray) -> Callable[[Shard], Iterator[pa.RecordBatch]]:
    """h and c for each pair of words that may be frequent: numbers only, as most pairs are rare."""

    def count(shard: Shard) -> Iterator[pa.RecordBatch]:
        hashes, seq = word_hashes(shard, words)
        for _, at, counts in intervals(seq, 2):
            yield pa.RecordBatch.from_arrays([pa.array(pair_hashes(hashes, seq[at], seq[at + 1])), pa.array(counts)], ["h", "c"])

    return count


def phrase_counts(words: np.ndarray, pairs: np.ndarray, most: int) -> Callable[[Shard], Iterator[pa.RecordBatch]]:
    """lang, phrase and c for the phrases of which each two neighbours may be a frequent pair."""

    def count(shard: Shard) -> Iterator[pa.RecordBatch]:
        hashes, seq = word_hashes(shard, words)
        joined = (seq[:-1] > 0) & (seq[1:] > 0)
        joined[joined] = slotted(pairs, pair_hashes(hashes, seq[:-1][joined], seq[1:][joined]))
        joined = np.concatenate([joined, [False]])
        # words of no frequent pair end pieces too
        seq = np.where(joined | np.concatenate([[False], joined[:-1]]), seq, 0)
        for m, at, counts in intervals(seq, most):
            held = joined[at[:, None] + np.arange(m - 1)[None, :]].all(axis=1)
            yield from rows_of(shard, seq, at[held], m, counts[held])

    return count


def top_phrases(docs: DataFrame, least: int = LEAST, most: int = WORDS, held: int = HELD, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    counted = lambda count: sharded(docs, count, PHRASES).groupBy("k").agg(F.sum("c").alias("f")).select("k", *parts_of(F.col("k")), "f")
    held_words = written(counted(word_counts).filter((F.col("f") >= least) | (F.col("phrase") == "")), "words")
    totals = held_words.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    words = held_words.filter((F.col("f") >= least) & (F.col("phrase") != ""))
    frequent = slots_of(words.select(F.xxhash64("k").alias("h")), "h")
    pairs = sharded(docs, pair_counts(frequent), "h long, c long").groupBy("h").agg(F.sum("c").alias("f")).filter(F.col("f") >= least)
    phrases = written(counted(phrase_counts(frequent, slots_of(pairs, "h"), most)).filter(F.col("f") >= least), "phrases")
    candidates = phrases.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    known = words.unionByName(phrases)
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"), "w")
    first, rest = F.array_join(F.slice("w", 1, F.col("k")), " "), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", first.alias("first"), rest.alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr("(CAST(a AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(7,0))) DIV CAST(l + r AS DECIMAL(20,0))"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.array_join(F.slice(F.col("w"), i, m), " "))))
    within = candidates.filter(F.size("w") > 2).select("lang", F.col("a").alias("longer"), F.explode(parts).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(within, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < held * F.col("a").cast("decimal(20,0)"))).drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spread = F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))
    near = left.withColumn("_part", spread).withColumn("_nth", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_nth") <= top)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
