"""Operator 1: best-fit packing by a configuration linear program over the length histogram.

Documents become pieces of at most `capacity` tokens. Only the histogram of piece lengths (at most `capacity` numbers)
reaches the driver. There the configuration LP (fewest patterns of lengths that cover all pieces) is solved by
multiplicative weights: each length has a price; a knapsack dynamic program finds the dearest fill of every room, and so the
dearest pattern that holds each length; patterns within SLACK of the dearest of all are used until the scarcest of their
lengths is covered, and the prices of what they cover fall. An epoch ends when the whole need is covered. Prices, over the
price of the dearest pattern, are a dual solution and bound the number of sequences from below. While the cover is not
within GAP of the best bound, further rounds of weights move the prices (what the dearest patterns cover falls, the rest
rises), which raises the bound, and another epoch covers the need with them.
The fractional counts are rounded down; only the rest that rounding leaves is packed by whole patterns, each the largest
piece left and the best fill for it, or by best fit decreasing, whichever takes fewer.
The plan says for each length which ranks go to which sequences, so pieces find their places by a rank within their
length, which is counted in two levels (within a task, and over tasks) and needs no shuffle of a length into one task.

Null texts count as empty: one end token. Empty tables give no rows. Repeated rows are packed one by one. Other columns do
not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayfold.llm.bpe import WORD_BPE, encoder
from wayfold.llm.common import chunks, written

CAPACITY = 2048
#: The fractional cover is within GAP of the lower bound, or the best of so many epochs after the first.
GAP, EPOCHS = 0.005, 2
#: Rounds of weights between epochs, and how far a round moves prices at first.
ROUNDS, STEP = 120, 0.1
#: Patterns of one knapsack table at most, how far they may be from the dearest, and how fast prices fall.
BATCH, SLACK, FALL = 24, 0.001, 0.05
#: Prices of the first epoch are this power of the length, so that long pieces are placed first.
BEND = 1.05


def pieces(docs: DataFrame, tokenizer: str = WORD_BPE, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the task and the rank within it and the length; one row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for part, texts in chunks(batch):
                rows: list[tuple] = []
                source: list[int] = []
                for i, ids in enumerate(enc.encode(texts)):
                    raw = np.append(ids, np.uint32(end)).astype("<u4").tobytes()
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[at : at + 4 * capacity]
                        rows.append((k, at // 4, len(own) // 4, zlib.crc32(own)))
                        source.append(i)
                cut = np.array(rows, dtype=np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(source, pa.int64())), pa.array(cut[:, 0].astype(np.int32)), *[pa.array(cut[:, i]) for i in (1, 2, 3)], pa.array(np.full(len(cut), task, dtype=np.int32)), pa.array(ranks(cut[:, 2], seen))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, task int, rank long")


def ranks(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """For each its rank among those of its length, after those counted in seen, which is counted on."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    first = np.searchsorted(ordered, ordered, side="left")
    out = np.empty(len(lengths), dtype=np.int64)
    out[order] = np.arange(len(lengths)) - first
    out += seen[lengths]
    np.add.at(seen, lengths, 1)
    return out


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over lengths 1..capacity (price 0 unused, minus infinity: not for use): the best worth of each room, and a length to take (0: leave one token)."""
    worth = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, dtype=np.int64)
    back = np.zeros(capacity + 1)  # worth, from the far end: back[capacity - c] = worth[c]
    for c in range(1, capacity + 1):
        offer = price[1 : c + 1] + back[capacity - c + 1 :]
        k = int(offer.argmax())
        if offer[k] > worth[c - 1]:
            worth[c], take[c] = offer[k], k + 1
        else:
            worth[c] = worth[c - 1]
        back[capacity - c] = worth[c]
    return worth, take


def filled(first: int, take: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The best pattern that holds a length: its lengths, and times each."""
    out, c = [first], capacity - first
    while c > 0:
        if take[c]:
            out.append(int(take[c]))
            c -= int(take[c])
        else:
            c -= 1
    return np.unique(np.array(out, dtype=np.int64), return_counts=True)


Cover = list[tuple[np.ndarray, np.ndarray, float]]


def epoch(need: np.ndarray, start: np.ndarray, capacity: int) -> Cover:
    """Patterns (lengths, times each, uses) that cover the whole need."""
    left, price = need.astype(float), np.where(need > 0, start, -np.inf)
    out: Cover = []
    while (open_ := left > 0).any():
        now = np.where(open_, price, -np.inf)
        worth, take = knapsack(now, capacity)
        value = now[1:] + worth[capacity - 1 :: -1]
        good = np.flatnonzero(value >= (1 - SLACK) * value.max()) + 1
        done = 0
        for k in [int(value.argmax()) + 1, *good[::-1].tolist()]:
            if done == BATCH:
                break
            lengths, times = filled(k, take, capacity)
            if not (left[lengths] > 0).all():
                continue
            use = float((left[lengths] / times).min())
            left[lengths] -= use * times
            left[lengths[left[lengths] < 1e-9]] = 0
            price[lengths] *= np.exp(-FALL * use * times / need[lengths])
            out.append((lengths, times, use))
            done += 1
    return out


def priced(need: np.ndarray, price: np.ndarray, capacity: int, goal: float, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Multiplicative weights on the prices alone, until they prove `goal` sequences: the prices of the best bound, and the bound.

    Each round `goal` sequences are dealt to the dearest patterns; prices fall where they hold more than the need, and rise where less.
    """
    best, bound = price, 0.0
    for i in range(rounds):
        now = np.where(need > 0, price, -np.inf)
        worth, take = knapsack(now, capacity)
        if (proven := float(need[need > 0] @ price[need > 0]) / float(worth[capacity])) > bound:
            best, bound = price, proven
        if bound >= goal:
            break
        value = now[1:] + worth[capacity - 1 :: -1]
        step, total, held = STEP / (1 + i / 8), 0.0, np.zeros(capacity + 1)
        for k in (np.flatnonzero(value >= (1 - step / 2) * value.max()) + 1).tolist():
            lengths, times = filled(k, take, capacity)
            use = float(need[k]) / float(times[np.searchsorted(lengths, k)])
            held[lengths] += use * times
            total += use
        met = np.divide(held * goal / total, need, out=np.zeros(capacity + 1), where=need > 0)
        price = price * np.exp(step * np.clip(1 - met, -8, 1))
        price = np.minimum(price / worth[capacity], 1.0)
    return best, bound


def fractional(need: np.ndarray, capacity: int, gap: float = GAP, epochs: int = EPOCHS) -> tuple[Cover, float]:
    """The best fractional cover of the whole need, and a lower bound for all covers."""
    if not need.any():
        return [], 0.0
    price = np.arange(capacity + 1) / capacity
    best, bound = epoch(need, price**BEND, capacity), float(need @ price)  # these prices are a dual solution as they stand
    for _ in range(epochs):
        size = sum(u for _, _, u in best)
        if size <= (1 + gap) * bound:
            break
        price, proven = priced(need, price, capacity, size / (1 + gap))
        bound = max(bound, proven)
        best = min(best, epoch(need, price, capacity), key=lambda c: sum(u for _, _, u in c))
    return best, bound


def whole_fill(left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns for small numbers of pieces: each the largest left and the lengths that fill it up best, longer ones first."""
    left, out = left.copy(), []
    while True:
        some = np.flatnonzero(left)
        if not len(some):
            return out
        top = int(some[-1])
        left[top] -= 1
        gap, fill = capacity - top, []
        small = [(int(k), int(min(left[k], gap // k))) for k in some[::-1] if k <= gap and left[k] > 0]
        reach, layers = 1, []
        mask = (1 << (gap + 1)) - 1
        for k, n in small:
            before, step = reach, 1
            while n > 0:
                m = min(step, n)
                reach |= reach << (k * m) & mask
                n -= m
                step *= 2
            layers.append((k, before))
            if reach >> gap & 1:
                break
        c = reach.bit_length() - 1
        for k, before in reversed(layers):
            while not before >> c & 1:
                fill.append(k)
                c -= k
        pattern, times = np.unique(np.array([top, *fill], dtype=np.int64), return_counts=True)
        left[top] += 1
        use = int(np.min(left[pattern] // times))
        left[pattern] -= use * times
        out.append((np.repeat(pattern, times), use))


def best_fit_decreasing(left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns of best fit decreasing; like sequences are kept together, by the room they have left."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {capacity: []}
    rooms = 0  # bit i: there are sequences with i tokens of room
    for k in np.flatnonzero(left)[::-1].tolist():
        n = int(left[k])
        while n:
            fitting = rooms >> k
            if fitting:
                room = k + (fitting & -fitting).bit_length() - 1
                held, count = groups[room].pop()
                m = min(n, count)
                if m < count:
                    groups[room].append((held, count - m))
                if not groups[room]:
                    rooms &= ~(1 << room)
            else:
                room, held, m = capacity, (), max(1, n // (capacity // k))
            groups.setdefault(room - k, []).append(((*held, k), m))
            rooms |= 1 << room - k
            n -= m
    return [(np.array(held, dtype=np.int64), count) for own in groups.values() for held, count in own]


def solve(need: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[np.ndarray, int]], dict[str, float]]:
    """Whole patterns (their lengths, repeats included) and how often each is used; together they hold exactly the need.

    And what was measured: the fractional cover's size, the lower bound, and the share of tokens that rounding left over.
    """
    cover, bound = fractional(need, capacity)
    left, out = need.copy(), []
    for lengths, times, use in cover:
        n = int(use + 1e-6)
        if n:
            left[lengths] -= n * times
            out.append((np.repeat(lengths, times), n))
    ends = [end(left, capacity) for end in (whole_fill, best_fit_decreasing)]
    size = np.arange(capacity + 1)
    told = {"cover": sum(u for _, _, u in cover), "bound": bound, "rest": float(left @ size) / max(1.0, float(need @ size))}
    return out + min(ends, key=lambda e: sum(n for _, n in e)), told


def plan_of(patterns: list[tuple[np.ndarray, int]]) -> dict[str, np.ndarray]:
    """By length and rank: where each run of ranks of a length goes. Its j-th piece goes to sequence first + j // times."""
    runs, done, first = [], {}, 0
    for lengths, use in patterns:
        at = 0
        for k, times in zip(*np.unique(lengths, return_counts=True), strict=True):
            k, times = int(k), int(times)
            low = done.get(k, 0)
            runs.append((k, low, first, times, at))
            done[k] = low + times * use
            at += k * times
        first += use
    cols = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "low", "first", "times", "at"), cols.T, strict=True))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (pieces with length, task and rank, unique within length and task) with sequence_id and offset."""
    per_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    base = per_task.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    need = np.zeros(capacity + 1, dtype=np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        need[row.length] = row.n
    plan = plan_of(solve(need, capacity)[0])
    key = plan["length"] << 48 | plan["low"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            run = np.searchsorted(key, length << 48 | rank, side="right") - 1
            nth, slot = np.divmod(rank - plan["low"][run], plan["times"][run])
            kept = [i for i, n in enumerate(batch.schema.names) if n not in ("task", "rank", "base")]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(plan["first"][run] + nth), pa.array(plan["at"][run] + slot * length)], [*[batch.schema.names[i] for i in kept], "sequence_id", "offset"])

    ranked = cut.join(base.select("length", "task", "base"), ["length", "task"])
    names = [c for c in cut.columns if c not in ("task", "rank")]
    schema = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in names)
    return ranked.select(*names, "rank", "base").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str = WORD_BPE, capacity: int = CAPACITY) -> DataFrame:
    return pack(written(pieces(docs, tokenizer, capacity), "pieces"), capacity)
