"""State machines, breakers and queues against plain Python, in batches and with restarts."""

from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from wayfold.streaming import states
from wayfold.streaming.states import FETCHING, Machine, attempts_until_stop, consume, current_states, enqueue, outcome, state_moves, state_stream

T0 = datetime.datetime(2002, 1, 1)
EVENTS = [("a", 1, 0, "ok"), ("a", 2, 5, "error"), ("b", 1, 0, "timeout"), ("b", 2, 60, "pending"), ("b", 3, 8 * 86400, "ok"), ("c", 2, 30, "pending"), ("c", 1, 10, "error"), ("c", 3, 90, "ok"), ("d", 1, 0, "nonsense")]
WANT = {
    ("a", 1, "pending", "ok", True), ("a", 2, "ok", "error", False), ("b", 1, "pending", "timeout", True), ("b", 2, "timeout", "pending", True), ("b", 3, "pending", "timeout", True), ("b", 3, "timeout", "ok", False),
    ("c", 1, "pending", "error", True), ("c", 2, "error", "pending", True), ("c", 3, "pending", "ok", True), ("d", 1, "pending", "nonsense", False),
}


def events(spark, rows):
    return spark.createDataFrame([(k, s, T0 + datetime.timedelta(seconds=t), to) for k, s, t, to in rows], "text string, seq long, at timestamp, to string")


def test_moves_of_a_table(spark):
    rows = events(spark, EVENTS).unionByName(spark.createDataFrame([(None, 1, T0, "ok"), ("e", None, T0, "ok"), ("e", 1, T0, None)], "text string, seq long, at timestamp, to string"))
    moves = state_moves(rows, "text", FETCHING)
    assert {(r["text"], r["seq"], r["from"], r["to"], r["legal"]) for r in moves.collect()} == WANT
    assert {(r["text"], r["state"]) for r in current_states(moves, "text").collect()} == {("a", "ok"), ("b", "timeout"), ("c", "ok")}
    assert state_moves(rows.limit(0), "text", FETCHING).count() == 0


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """The same moves whether the events come at once or in files with a restart after each; then a timer without any event."""
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    clock = [("z", 1, 0, "ok")]
    parts = [[e for e in EVENTS if e[1] == 1], [e for e in EVENTS if e[1] == 2], [e for e in EVENTS if e[1] == 3], [("f", 1, 9 * 86400, "error"), ("f", 2, 9 * 86400 + 1, "pending")], [("z", 2, 30 * 86400, "x")], [("z", 3, 31 * 86400, "x")]]
    parts[0] = parts[0] + clock
    for i, part in enumerate(parts):
        events(spark, part).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
        stream = spark.readStream.schema("text string, seq long, at timestamp, to string").option("recursiveFileLookup", "true").parquet(folder)
        moves = state_stream(stream, "text", FETCHING, "1 hour")
        moves.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = {(r["text"], r["seq"], r["from"], r["to"], r["legal"]) for r in spark.read.parquet(out).collect()}
    timed = {g for g in got if g[1] is None}
    # f's timer, and that of d, of which no more is heard, ran out by the clock alone
    assert timed >= {("f", None, "pending", "timeout", True), ("d", None, "pending", "timeout", True)}
    assert {g[:1] + g[2:] for g in got if g[0] not in "zf"} == {w[:1] + w[2:] for w in WANT} | {("d", "pending", "timeout", True)}


def brute_breaker(rows, most, carry):
    state = {g: list(v) for g, v in carry.items()}
    tried = set()
    for g, o, bad, quota in sorted(rows, key=lambda r: r[1]):
        run, stopped = state.get(g, [0, False])
        if not stopped:
            tried.add((g, o))
            run = run + 1 if bad else 0
            stopped = run >= most or bool(quota)
        state[g] = [run, stopped]
    return tried, state


@pytest.mark.parametrize("seed", range(3))
def test_breaker_over_batches(spark, seed):
    rng = random.Random(seed)
    n, most = 240, 3
    rows = [(rng.choice(["a", "b", "b", "b", None]), o, rng.choice([True, False, False, None] if o < 150 else [True, False]), rng.random() < 0.004) for o in range(n)]
    carry, known = None, {}
    for at in range(0, n, 80):
        part = rows[at : at + 80]
        shuffled = rng.sample(part, len(part))
        df = spark.createDataFrame(shuffled, "source string, nth long, bad boolean, quota boolean").repartition(3)
        told, after = attempts_until_stop(df, "source", "nth", F.col("bad"), F.col("quota"), carry, most, span=7)
        tried, known = brute_breaker(part, most, known)
        assert {(r.source, r.nth) for r in told.filter("tried").collect()} == tried and told.count() == len(part)
        after = after.collect()
        for r in after:
            assert r.stopped == known[r.source][1] and (r.stopped or r.run == known[r.source][0])
        carry = spark.createDataFrame([(r.source, r.run, r.stopped) for r in after], "source string, run long, stopped boolean")


def test_poison_ends_after_three_tries(spark, tmp_path):
    queue, out, checkpoint = (str(tmp_path / n) for n in ("queue", "out", "checkpoint"))
    schema = "id long, lot string"
    seen: list[list[int]] = []

    def handle(batch):
        seen.append(sorted(r.id for r in batch.collect()))
        return batch.filter(F.startswith("lot", F.lit("poison")) | ((F.col("lot") == "late") & F.lit(len(seen) < 2))).select("id", F.concat(F.lit("bad "), "lot").alias("error"))

    def run():
        consume(spark.readStream.schema(schema).json(queue), "id", handle, out, checkpoint)

    assert enqueue(spark.createDataFrame([(1, "a"), (2, "poison"), (3, "late"), (1, "a"), (None, "x")], schema), queue)
    run()
    assert seen == [[1, 2, 3], [2, 3], [2]]
    assert {(r.id, r.attempts, r.error) for r in outcome(spark, out, "dead").collect()} == {(2, 3, "bad poison")}
    assert enqueue(spark.createDataFrame([(4, "b"), (5, "poison2")], schema), queue)
    run()
    assert seen[3:] == [[4, 5], [5], [5]]
    assert sorted((r.id, r.attempts) for r in outcome(spark, out, "handled").collect()) == [(1, 1), (3, 2), (4, 1)]
    assert {r.id for r in outcome(spark, out, "dead").collect()} == {2, 5}


def test_a_handler_that_raises_fails_its_batch_only(spark, tmp_path):
    queue, out = str(tmp_path / "queue"), str(tmp_path / "out")
    enqueue(spark.createDataFrame([(1, "a")], "id long, lot string"), queue)

    def handle(batch):
        raise RuntimeError("down")

    consume(spark.readStream.schema("id long, lot string").json(queue), "id", handle, out, str(tmp_path / "checkpoint"))
    row = outcome(spark, out, "dead").first()
    assert (row.id, row.attempts) == (1, 3) and "down" in row.error


def test_sending_never_raises(spark, tmp_path):
    (tmp_path / "file").write_text(json.dumps(1))
    assert not enqueue(spark.range(1), f"{tmp_path}/file")


def test_schedule():
    assert states.due_stages(0)[0] == "blogs" and states.due_stages(30) == ["second_search"] and states.due_stages(7) == []


def test_timers_chain():
    m = Machine("x", {"x": frozenset("y"), "y": frozenset("z"), "late": frozenset("z")}, {"x": (10, "y"), "y": (5, "late")})
    assert list(m.step("x", 0.0, 100.0, "z")) == [(10.0, "x", "y", True), (15.0, "y", "late", True), (100.0, "late", "z", True)]
