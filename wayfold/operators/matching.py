"""Texts to places: an inverted index of tokens, candidates by shared tokens, the best match of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions.columns import words_of
from wayfold.functions.vocab import NAME_STRIP
from wayfold.operators.relevance import match_confidence


def token_index(lots: DataFrame) -> DataFrame:
    """token and lot: distinct lower-case words of name and address."""
    words = F.array_distinct(F.filter(words_of(F.lower(F.concat_ws(" ", "name", "address"))), lambda w: w != ""))
    return lots.select(F.explode(words).alias("token"), F.col("id").alias("lot"))


def candidates(texts: DataFrame, key: str, keywords: str, index: DataFrame, most: int = 20) -> DataFrame:
    """Per text the places that share most of its keywords (ties by id), `most` at most, as the catalogue's search gives them.

    Hits are summed within tasks before the shuffle; the join is on tokens, and Spark splits tokens that very many share.
    """
    each = texts.select(key, F.explode(keywords).alias("token"))
    hits = each.join(index, "token").groupBy(key, "lot").agg(F.count("*").alias("hits"))
    return hits.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("hits"), "lot"))).filter(F.col("rank") <= most)


def all_words(texts: DataFrame, key: str, keywords: str, index: DataFrame) -> DataFrame:
    """Pairs of texts and places that have all of a text's keywords."""
    each = texts.select(key, F.size(F.array_distinct(keywords)).alias("n"), F.explode(F.array_distinct(keywords)).alias("token"))
    return each.join(index, "token").groupBy(key, "lot", "n").agg(F.count_distinct("token").alias("hits")).filter("hits = n").select(key, "lot")


def best_matches(texts: DataFrame, lots: DataFrame, pairs: DataFrame, key: str, title: str, content: str) -> DataFrame:
    """The place of the best confidence and score of each text, of the pairs (key, lot) given; none is left out."""
    rows = pairs.join(texts, key).join(lots.select(F.col("id").alias("lot"), F.col("name").alias("_name"), F.col("address").alias("_address")), "lot")
    rows = rows.withColumn("m", match_confidence(F.col(title), F.col(content), F.col("_name"), F.col("_address"))).filter("m.confidence <> 'none'")
    rank = F.struct((F.col("m.confidence") == "high").alias("high"), F.col("m.score").alias("score"), (-F.xxhash64("lot")).alias("tie"))
    return rows.groupBy(key).agg(F.max_by(F.struct("lot", "m.score", "m.confidence"), rank).alias("b")).select(key, "b.*")


def stripped_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), NAME_STRIP, "")


def affix_similarity(a: Column, b: Column) -> Column:
    """Shorter by longer name if one holds the other, else their common start by the longer; kinds, case and white space aside."""
    x, y = (F.regexp_replace(stripped_name(c), r"(?U)\s+", "") for c in (a, b))
    m, n = F.length(x), F.length(y)
    common = F.size(F.filter(F.sequence(F.lit(1), F.least(m, n)), lambda k: F.left(x, k) == F.left(y, k)))
    held = F.contains(x, y) | F.contains(y, x)
    return F.when((m == 0) | (n == 0), 0.0).when(held, F.least(m, n) / F.greatest(m, n)).otherwise(common / F.greatest(m, n))


def by_name(texts: DataFrame, key: str, name: str, lots: DataFrame, least: float = 0.7) -> DataFrame:
    """Places whose names are like a text's: of those with all its words or, if none has, those whose name holds its first word.

    The second search joins on the first two characters of the word, then looks for all of it; no pair is made that
    does not share them. Words are of two characters at least; texts without any find nothing.
    """
    words = F.array_distinct(F.filter(words_of(stripped_name(F.col(name))), lambda w: F.length(w) >= 2))
    asked = texts.select(key, F.col(name).alias("_asked"), words.alias("_words")).filter(F.size("_words") > 0)
    direct = all_words(asked, key, "_words", token_index(lots))
    rest = asked.join(direct.select(key).distinct(), key, "left_anti").withColumn("_word", F.get("_words", F.lit(0))).withColumn("_two", F.left("_word", F.lit(2)))
    named = lots.select(F.col("id").alias("lot"), F.lower("name").alias("_lower"))
    twos = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_lower") - 1)), lambda i: F.substring(F.col("_lower"), i, F.lit(2))))
    found = rest.join(named.withColumn("_two", F.explode(twos)), "_two").filter(F.contains("_lower", F.col("_word"))).select(key, "lot")
    pairs = direct.unionByName(found).join(asked.select(key, "_asked"), key).join(lots.select(F.col("id").alias("lot"), F.col("name").alias("_found")), "lot")
    return pairs.withColumn("similarity", affix_similarity(F.col("_asked"), F.col("_found"))).filter(F.col("similarity") >= least).select(key, "lot", "similarity")
