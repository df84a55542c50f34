"""Changes to tables as joins: upserts, insert-ignore, three-way differences, dedupes, folds. Inputs stay; results are new tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """old with the given columns taken from new where a key is there, and the keys that only new has. Other columns stay old's."""
    a = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys], F.lit(1).alias("_")).alias("_o"))
    b = new.select(*keys, F.struct(*columns, F.lit(1).alias("_")).alias("_n"))
    rows = a.join(b, keys, "full_outer")
    pick = lambda c: F.when(F.col("_n").isNotNull(), F.col(f"_n.`{c}`")).otherwise(F.col(f"_o.`{c}`")) if c in columns else F.col(f"_o.`{c}`")
    return rows.select(*keys, *[pick(c).alias(c) for c in old.columns if c not in keys])


def add_counters(old: DataFrame, new: DataFrame, keys: list[str], counters: list[str], latest: list[str]) -> DataFrame:
    """Counters add up, dates take the later one."""
    cols = [*keys, *counters, *latest]
    return old.select(*cols).unionByName(new.select(*cols)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters], *[F.max(c).alias(c) for c in latest])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new to append: keys that old has not, once each (the first by all columns)."""
    first = new.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys] or keys))).filter("_nth = 1").drop("_nth")
    return first.join(old.select(*keys), keys, "left_anti")


def difference(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """new, changed, unchanged or missing for each key. Values are compared as text, null as empty."""
    text = lambda side: F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias(side)
    rows = old.select(*keys, text("_o")).join(new.select(*keys, text("_n")), keys, "full_outer")
    change = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "missing").when(F.col("_o") == F.col("_n"), "unchanged").otherwise("changed")
    return rows.select(*keys, change.alias("change"))


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def toggled(events: DataFrame, keys: list[str], kind: str, order: str, kinds: tuple[str, str]) -> DataFrame:
    """The state after toggles: the same kind again takes it back, another replaces it; keys without a state are left out.

    Only the last run of one kind matters: its first event sets the state, each repeat flips it. So two sums a key do.
    """
    last = {k: F.max(F.when(F.col(kind) == k, F.col(order))).over(W.partitionBy(*keys)) for k in kinds}
    rows = events.withColumns({"_a": last[kinds[0]], "_b": last[kinds[1]]})
    final = F.when(F.col("_b").isNull() | (F.col("_a") > F.col("_b")), kinds[0]).otherwise(kinds[1])
    other = F.coalesce(F.when(F.col("_b").isNull() | F.col("_a").isNull(), None).otherwise(F.least("_a", "_b")), F.lit(-1))
    run = rows.withColumn("_final", final).filter(F.col(order) > other)
    return run.groupBy(*keys).agg(F.first("_final").alias(kind), F.count("*").alias("_n")).filter("_n % 2 = 1").drop("_n")


def fill_blanks(old: Column, new: Column, blank: tuple = ("", "00:00")) -> Column:
    return F.when(old.isNull() | old.cast("string").isin(*blank), new).otherwise(old)


def rekeyed(children: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """children whose column is moved to another key. mapping: duplicate and keeper."""
    m = mapping.select(F.col("duplicate").alias(column), "keeper")
    return children.join(m, column, "left").withColumn(column, F.coalesce("keeper", column)).select(*children.columns)


def without_duplicates(rows: DataFrame, mapping: DataFrame, fill: list[str], key: str = "id") -> DataFrame:
    """Keepers with blanks filled from their duplicates (the least duplicate first), duplicates gone."""
    extra = rows.join(mapping.select(F.col("duplicate").alias(key), "keeper"), key).groupBy("keeper").agg(*[F.min(F.struct(F.when(F.col(c).isNull(), 1).otherwise(0).alias("n"), F.col(key).alias("k"), F.col(c).alias("v"))).alias(f"_{c}") for c in fill])
    kept = rows.join(mapping.select(F.col("duplicate").alias(key)), key, "left_anti").join(extra.withColumnRenamed("keeper", key), key, "left")
    return kept.select(*[(F.coalesce(c, F.col(f"_{c}.v")) if c in fill else F.col(c)).alias(c) for c in rows.columns])


def accepted_update(old: Column, new: Column, chrome: list[str], shortest: int = 200, longest: int = 800) -> Column:
    """Why a new text is not taken, null if it is: too short, page chrome, too long, not better."""
    bad = reduce(lambda a, b: a | b, [new.rlike(p) for p in chrome], F.lit(False))
    better = old.isNull() | (F.length(old) < shortest) | (F.length(new) > F.length(old))
    return F.when(new.isNull() | (F.length(new) < shortest), "short").when(bad, "chrome").when(F.length(new) > longest, "long").when(~better, "not_better")
