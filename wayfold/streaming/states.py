"""Crawl states: a state machine for each text, breakers that stop failing sources, a queue with retries and dead letters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayfold.streaming.rescoring import run_batches


@dataclass(frozen=True)
class Machine:
    """States, the moves that are legal, and for some states how long they last before they turn into another by themselves."""

    start: str
    moves: dict[str, frozenset[str]]
    patience: dict[str, tuple[float, str]] = field(default_factory=dict)

    def step(self, state: str, since: float | None, at: float, to: str) -> Iterator[tuple[float, str, str, bool]]:
        """The moves (time, from, to, legal) of an event: a state whose time has run out by then turns first."""
        while since is not None and state in self.patience and at > since + self.patience[state][0]:
            seconds, later = self.patience[state]
            since += seconds
            yield since, state, later, True
            state = later
        yield at, state, to, to in self.moves.get(state, ())


# What becomes of a text that is fetched. Failures that may pass are tried again; what is settled stays.
FETCHING = Machine(
    start="pending",
    moves={"pending": frozenset("ok blocked not_found too_short timeout error".split()), "timeout": frozenset(["pending"]), "error": frozenset(["pending"])},
    patience={"pending": (7 * 86400.0, "timeout")},
)

MOVES = "seq long, at timestamp, from string, to string, legal boolean"


def _moves(machine: Machine, key, state: str, since: float | None, events: pd.DataFrame) -> tuple[list[tuple], str, float | None]:
    out = []
    for seq, at, to in zip(events["seq"], events["at"].to_numpy().astype("datetime64[us]").astype("int64") / 1e6, events["to"], strict=True):
        since = at if since is None else since
        for when, before, after, legal in machine.step(state, since, at, to):
            out.append((key, seq, pd.Timestamp(round(when * 1e6), unit="us"), before, after, legal))
            if legal:
                state, since = after, when
    return out, state, since


def state_moves(events: DataFrame, key: str, machine: Machine) -> DataFrame:
    """All moves of a table of events: key, seq, at, from, to, legal; a move that a timer makes has the seq of the event that showed it.

    events: key, seq (long, the order of a key's events), at, to. A key starts in machine.start at its first event. Illegal
    events change nothing and are reported. Rows without key, seq, at or to are left out. A key's events follow each other
    in one task, of which one state is held at a time.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, "seq", "at", "to").dropna().repartition(key).sortWithinPartitions(key, "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for frame in frames:
            out = []
            for k, own in frame.groupby(key, sort=False):
                state, since = known.get(k, (machine.start, None))
                got, *after = _moves(machine, k, state, since, own)
                out += got
                known = {k: after}  # keys come one after another
            yield pd.DataFrame(out, columns=[key, "seq", "at", "from", "to", "legal"])

    return rows.mapInPandas(run, f"{key} {kind}, {MOVES}")


def current_states(moves: DataFrame, key: str) -> DataFrame:
    """The state of each key after its last legal move, and since when."""
    legal = moves.filter("legal")
    return legal.groupBy(key).agg(F.max_by(F.struct(F.col("to").alias("state"), F.col("at").alias("since")), F.struct("seq", "at")).alias("s")).select(key, "s.*")


def state_stream(events: DataFrame, key: str, machine: Machine, late: str = "0 seconds") -> DataFrame:
    """state_moves() over a stream: the state is kept from batch to batch, and timers run on event time.

    The watermark of `at` sets the clock: when it passes the end of a state's time, the state turns without any event (seq is
    then null). A key's events must come in order of seq over batches; within a batch they are sorted. After a restart the
    stream goes on from its checkpoint, with the same states and timers.
    """
    kind = events.schema[key].dataType.simpleString()
    columns = [key, "seq", "at", "from", "to", "legal"]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, since = state.get if state.exists else (machine.start, None)
        if state.hasTimedOut:
            seconds, later = machine.patience[now]
            since += seconds
            out = [(k[0], None, pd.Timestamp(round(since * 1e6), unit="us"), now, later, True)]
            now = later
        else:
            own = pd.concat(list(frames)).sort_values("seq")
            out, now, since = _moves(machine, k[0], now, since, own)
        state.update((now, since))
        if now in machine.patience and since is not None:
            end = int((since + machine.patience[now][0]) * 1000) + 1
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=columns)

    rows = events.select(key, "seq", "at", "to").dropna().withWatermark("at", late)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {MOVES}", "state string, since double", "append", GroupStateTimeout.EventTimeTimeout)


# breakers


def attempts_until_stop(attempts: DataFrame, group: str, order: str, failed: Column, quota: Column, carry: DataFrame | None = None, most: int = 3, span: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """attempts with `tried`, and what the next batch must know (group, run, stopped).

    A group stops after `most` failures one after another, or at once where its quota is used up; what comes after that is not
    tried. `order` is a whole number, unique in the group. carry: the state that earlier batches left; a group that stopped
    stays stopped. Null outcomes are no failures. Null groups are a group.

    A group may hold any part of the rows: runs are found within spans of the order (at most `span` rows of a group each),
    and spans are joined by what they begin and end with.
    """
    rows = attempts.withColumn("_span", F.floor(F.col(order) / span)).withColumn("_bad", F.coalesce(failed, F.lit(False)).cast("int")).withColumn("_quota", F.coalesce(quota, F.lit(False)))
    own = W.partitionBy(group, "_span").orderBy(order)
    last_good = F.max(F.when(F.col("_bad") == 0, F.col(order))).over(own)
    # failures since the last success, or since the span began
    marked = rows.withColumn("_since", last_good).withColumn("_run", F.sum("_bad").over(W.partitionBy(group, "_span", "_since").orderBy(order)))
    lead = F.when(F.col("_since").isNull() & (F.col("_run") < most + 1), F.col(order))
    spans = marked.groupBy(group, "_span").agg(
        F.count("*").alias("n"), F.sum("_bad").alias("bad"), F.array_sort(F.collect_list(lead)).alias("lead"),  # at most `most` entries
        F.max_by("_run", order).alias("tail"), F.min(F.when(F.col("_quota") | (F.col("_run") >= most), F.col(order))).alias("stop"),
    )
    if carry is None:
        spans = spans.withColumns({"_carried": F.lit(0).cast("bigint"), "_stopped": F.lit(False)})
    else:
        given = carry.select(F.col(group).alias("_g"), F.col("run").cast("bigint").alias("_carried"), F.col("stopped").alias("_stopped"))
        spans = spans.join(given, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g").withColumns({"_carried": F.coalesce("_carried", F.lit(0)), "_stopped": F.coalesce("_stopped", F.lit(False))})
    before = W.partitionBy(group).orderBy("_span")
    broken = F.when(F.col("bad") < F.col("n"), F.struct("_span", "tail"))
    spans = spans.withColumn("_from", F.max(broken).over(before.rowsBetween(W.unboundedPreceding, -1)))
    whole = F.coalesce(F.sum(F.when(F.col("bad") == F.col("n"), F.col("n")).otherwise(0)).over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = spans.withColumn("_whole", whole)
    # failures that a span begins after: the last broken span's tail and the whole spans of failures since
    since = F.max(F.when(F.col("bad") < F.col("n"), F.col("_whole"))).over(before.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("_in", F.when(F.col("_from").isNull(), F.col("_carried") + F.col("_whole")).otherwise(F.col("_from.tail") + F.col("_whole") - since))
    need = F.greatest(F.lit(1), F.lit(most) - F.col("_in")).cast("int")
    early = F.when(F.col("_in") > 0, F.get("lead", need - 1))
    spans = spans.withColumn("_end", F.least("stop", early))
    ends = spans.groupBy(group).agg(F.min("_end").alias("_end"), F.max("_stopped").alias("_stopped"), F.max_by(F.when(F.col("bad") == F.col("n"), F.col("_in") + F.col("n")).otherwise(F.col("tail")), "_span").alias("_run"))
    ends = ends.withColumnRenamed(group, "_g")
    told = rows.drop("_span", "_bad", "_quota").join(ends, F.col(group).eqNullSafe(F.col("_g")))
    told = told.withColumn("tried", ~F.col("_stopped") & (F.col("_end").isNull() | (F.col(order) <= F.col("_end")))).drop("_g", "_end", "_stopped", "_run")
    after = ends.select(F.col("_g").alias(group), F.col("_run").alias("run"), (F.col("_stopped") | F.col("_end").isNotNull()).alias("stopped"))
    if carry is not None:
        after = after.unionByName(carry.join(after.select(F.col(group).alias("_g")), F.col(group).eqNullSafe(F.col("_g")), "left_anti").select(group, F.col("run").cast("bigint").alias("run"), "stopped"))
    return told, after


# queues


def enqueue(messages: DataFrame, folder: str) -> bool:
    """Appends messages to a queue's folder. It never raises: whoever sends a message goes on when the queue cannot be reached."""
    try:
        messages.write.mode("append").json(folder)
        return True
    except Exception as e:  # the caller must not fail for it
        print(f"messages were not sent to {folder}: {type(e).__name__}: {str(e)[:200]}")
        return False


def _left(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def consume(messages: DataFrame, key: str, handle: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, tries: int = 3) -> None:
    """Works off a stream of messages; a message that fails is tried again with the next batches, and after `tries` times is a dead letter.

    handle(batch) gives key and error for the messages it could not work off (and does the work for the others); one message
    does not stop the others. If handle itself raises, all messages of the batch count as failed once, with its error. When the
    stream has no more, what still waits is tried until it is done or dead. out/waiting, out/dead and out/handled hold a folder
    for each batch; a batch that comes again after a failure reads what the batch before it left and overwrites its own.
    Each message has one row, by its key; null keys are left out.
    """
    spark = messages.sparkSession
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema.fields)
    waiting = f"{fields}, attempts int, error string"

    def work(batch: DataFrame, old: DataFrame, name: str) -> DataFrame:
        new = batch.filter(F.col(key).isNotNull()).dropDuplicates([key]).withColumns({"attempts": F.lit(0), "error": F.lit(None).cast("string")})
        path = lambda kind: f"{out}/{kind}/batch={name}"
        old.unionByName(new.join(old.select(key), key, "left_anti")).write.mode("overwrite").parquet(path("inbox"))
        rows = spark.read.schema(waiting).parquet(path("inbox"))
        try:
            handle(rows.drop("attempts", "error")).select(F.col(key), F.col("error").alias("_error")).dropDuplicates([key]).write.mode("overwrite").parquet(path("failed"))
            failed = spark.read.parquet(path("failed"))
        except Exception as e:
            failed = rows.select(key, F.lit(f"{type(e).__name__}: {str(e)[:200]}").alias("_error"))
        tried = rows.withColumn("attempts", F.col("attempts") + 1).join(failed, key, "left").withColumn("error", F.col("_error"))
        bad = F.col("_error").isNotNull()
        put = lambda df, kind: df.drop("_error").write.mode("overwrite").parquet(path(kind))
        put(tried.filter(~bad), "handled")
        put(tried.filter(bad & (F.col("attempts") >= tries)), "dead")
        put(tried.filter(bad & (F.col("attempts") < tries)), "waiting")
        return _left(spark, path("waiting"), waiting)

    last: list[int] = []

    def batch(df: DataFrame, number: int) -> None:
        work(df, _left(spark, f"{out}/waiting/batch={number - 1}", waiting), str(number))
        last[:] = [number]

    run_batches(messages, batch, checkpoint)
    for number in last:
        left, again = _left(spark, f"{out}/waiting/batch={number}", waiting), 0
        while not left.isEmpty():
            again += 1
            left = work(spark.createDataFrame([], messages.schema), left, f"{number}-{again}")
        if again:  # nothing waits for the next stream
            left.limit(0).write.mode("overwrite").parquet(f"{out}/waiting/batch={number}")


def outcome(spark: SparkSession, out: str, name: str) -> DataFrame:
    """All rows of `dead` or `handled`."""
    return spark.read.option("basePath", f"{out}/{name}").parquet(f"{out}/{name}/batch=*").drop("batch")


#: Jobs of the hour by minute, as the two clocks of the crawl start them.
SCHEDULE = {0: ["blogs", "videos", "search", "filter", "match", "score"], 30: ["second_search"]}


def due_stages(minute: int, schedule: dict[int, list[str]] | None = None) -> list[str]:
    """The stages that a clock starts at a minute of the hour; run_stages() runs them."""
    return list((schedule or SCHEDULE).get(minute, []))
