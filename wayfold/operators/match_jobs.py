"""Texts to places as jobs: the cascade with its second way by coordinates, and the match job with verdicts and stored links."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfold.functions.columns import KOREA, Box, strip_html
from wayfold.operators.cascade import MOST, best_places, place_keywords, places_by_kind, same_text, with_their_like, word_places
from wayfold.operators.discovery import SAME_PLACE_M, candidate_type, hints, normal_name, with_evidence
from wayfold.operators.merge import insert_ignore
from wayfold.operators.relevance import blog_relevance, match_confidence, search_keywords
from wayfold.sources.shared import stored

# Kinds of names that are not looked for, results of a search that count, and candidates of a text.
NOISE = ["generic_term", "region_name", "page_or_service", "unknown"]
RESULTS, CANDIDATES, FEW, LOOKED_UP = 5, 20, 3, 3


def _plain(c: Column) -> Column:
    return strip_html(F.coalesce(c, F.lit("")))


def placed_texts(texts: DataFrame, key: str, title: str, content: str, full_text: str, lots: DataFrame, results: DataFrame, metres: float = SAME_PLACE_M, most: int = MOST, box: Box | None = KOREA) -> DataFrame:
    """Every text once: key, stage, lot, score, and the name that its title tells.

    First by name (best_places). A text without such a place may tell a name: if it is noise, it ends there (stage noise).
    Else the search results for it decide (an input table: key, id, name, category, address, lat, lng; the first RESULTS of
    a text by id count): if all parking places among them lie within `metres` of places of the catalogue, and the closest is
    about the name, the text goes to that place (stage coordinates). The others are missed.

    lots: id, name, address, lat, lng of active places. A repeated key counts once (the least title and content). A null key,
    which could meet no result, is left out; null texts are empty.
    """
    texts = texts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(F.coalesce(title, F.lit("")).alias("t"), F.coalesce(content, F.lit("")).alias("c"), F.coalesce(full_text, F.lit("")).alias("f"))).alias("x"))
    texts = texts.select(key, strip_html(F.col("x.t")).alias("_title"), strip_html(F.col("x.c")).alias("_content"), F.col("x.f").alias("_text"))
    texts = texts.withColumn("name", F.array_join(place_keywords(F.col("_title"), F.col("_content")), " "))
    texts = stored(texts, "texts")
    named = stored(best_places(texts, key, "_title", "_content", "_text", lots, most).select(key, "lot", "score"), "by-name")
    left = texts.join(named.select(key), key, "left_anti").withColumn("_noise", candidate_type(normal_name(F.col("name"))).isin(NOISE))
    asked = left.filter("NOT _noise").select(F.col(key).alias("candidate"), "name", hints(F.concat_ws(" ", "_title", "_content")).alias("hints"))
    first = W.partitionBy(key).orderBy("id")
    own = results.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= RESULTS).withColumnRenamed(key, "candidate")
    found = with_evidence(own, lots.filter(F.col("lat").isNotNull()), asked, metres, box).filter("label = 'all_existing' AND relevant").select(F.col("candidate").alias(key), F.col("lot").alias("_lot"))
    shown = lots.select(F.col("id").alias("_lot"), F.col("name").alias("_name"), F.col("address").alias("_address"))
    rest = left.join(found.join(shown, "_lot"), key, "left")
    stage = F.when(F.col("_noise"), "noise").when(F.col("_lot").isNotNull(), "coordinates").otherwise("missed")
    score = F.when(F.col("_lot").isNotNull(), blog_relevance(F.col("_title"), F.col("_content"), F.col("_name"), F.col("_address")))
    rest = rest.select(key, stage.alias("stage"), F.col("_lot").alias("lot"), score.alias("score"), "name")
    return texts.join(named, key).select(key, F.lit("name").alias("stage"), "lot", "score", "name").unionByName(rest)


def prefix_index(lots: DataFrame, longest: int = 15) -> DataFrame:
    """prefix and lot: beginnings, of two characters at least, of the words of names and addresses; what a search for `word OR word*` meets."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", "name", "address")), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2))
    starts = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(2), F.least(F.length(w), F.lit(longest))), lambda n: F.left(w, n))))
    return lots.select(F.explode(F.array_distinct(starts)).alias("token"), F.col("id").alias("lot"))


def searched(texts: DataFrame, key: str, keywords: str, lots: DataFrame, most: int = CANDIDATES, few: int = FEW) -> DataFrame:
    """Per text up to `most` places: those that share most of its keywords' beginnings (ties by id); with fewer than `few` of them,
    also places whose names hold one of its first LOOKED_UP keywords, in order of keyword and id.

    Texts of equal keywords are looked up once, and so are places of an equal name and address.
    """
    return _searched(texts, key, keywords, places_by_kind(lots, most), most, few).select(key, "lot", "rank")


def _searched(texts: DataFrame, key: str, keywords: str, kinds: DataFrame, most: int = CANDIDATES, few: int = FEW) -> DataFrame:
    """searched() over places_by_kind(), with the least id of each place's like (_same)."""
    lots = kinds.filter("_nth = 1")
    rows = texts.select(key, F.transform(keywords, F.lower).alias("_words")).filter(F.size("_words") > 0).withColumn("_set", F.sha2(F.array_join("_words", "\n"), 256))
    rows = stored(rows, "keywords")
    sets = rows.select("_set", "_words").dropDuplicates(["_set"])
    each = sets.select("_set", F.explode(F.array_distinct("_words")).alias("token"))
    hits = each.join(prefix_index(lots), "token").groupBy("_set", "lot").agg(F.count("*").alias("_hits"))
    top = lambda df, order: df.withColumn("_nth", F.row_number().over(W.partitionBy("_set").orderBy(*order, "lot"))).filter(F.col("_nth") <= most).drop("_nth")
    first = stored(with_their_like(top(hits, [F.desc("_hits")]), kinds, "_set", [F.desc("_hits")], most, "_nth"), "first")
    enough = first.groupBy("_set").agg(F.count("*").alias("_n")).filter(F.col("_n") >= few).select("_set")
    asked = sets.join(enough, "_set", "left_anti").select("_set", F.posexplode(F.slice("_words", 1, LOOKED_UP)).alias("_at", "_word"))
    names = word_places(asked, "_word", lots, F.array(F.lower(F.coalesce("name", F.lit("")))))
    # with so few found all of them are among the first, and so are all of their like
    more = asked.join(names, "_word").groupBy("_set", "lot").agg(F.min("_at").alias("_at")).join(first.select("_set", F.col("_same").alias("lot")), ["_set", "lot"], "left_anti")
    more = with_their_like(top(more, [F.col("_at")]), kinds, "_set", [F.col("_at")], most, "_nth")
    both = first.select("_set", "lot", "_same", F.lit(-1).alias("_at"), "_nth").unionByName(more.select("_set", "lot", "_same", "_at", F.lit(0).alias("_nth")))
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("_set").orderBy("_at", "_nth", "lot"))).filter(F.col("rank") <= most)
    return rows.select(key, "_set").join(ranked.select("_set", "lot", "_same", "rank"), "_set").select(key, "lot", "rank", "_same")


def decided_pairs(raw: DataFrame, lots: DataFrame, verdicts: DataFrame, stop: list[str]) -> DataFrame:
    """Candidate pairs of texts and places that are alike at all, with what decides them: id, lot, score, confidence, decision.

    raw: id (unique), title, content, filter_tier; verdicts: id, lot, filter_passed, as a model gave them, one for each pair.
    A sure match of a text of the high tier is linked by rule; all others by their verdict (model or rejected). Pairs without one are open.
    Equal texts are searched for and held against places of an equal name and address once.
    """
    rows = raw.select("id", _plain(F.col("title")).alias("title"), _plain(F.col("content")).alias("content"), "filter_tier")
    rows = rows.withColumn("_each", same_text(F.col("title"), F.col("content")))
    each = stored(rows.select("_each", "title", "content").dropDuplicates(["_each"]), "different-texts")
    kinds = places_by_kind(lots, CANDIDATES)
    pairs = stored(_searched(each.withColumn("_keys", search_keywords(F.col("title"), F.col("content"), stop)), "_each", "_keys", kinds), "searched")
    shown = kinds.filter("_nth = 1").select("_same", F.col("name").alias("_name"), F.col("address").alias("_address"))
    held = pairs.select("_each", "_same").distinct().join(each, "_each").join(shown, "_same")
    held = held.select("_each", "_same", match_confidence(F.col("title"), F.col("content"), F.col("_name"), F.col("_address")).alias("m"))
    alike = stored(held, "held").filter("m.confidence <> 'none'").join(pairs.select("_each", "_same", "lot"), ["_each", "_same"])
    met = rows.select("id", "filter_tier", "_each").join(alike, "_each")
    met = met.join(verdicts.select("id", "lot", F.col("filter_passed").alias("_passed")), ["id", "lot"], "left")
    by_rule = (F.col("m.confidence") == "high") & (F.coalesce("filter_tier", F.lit("")) == "high")
    decision = F.when(by_rule, "rule").when(F.col("_passed"), "model").when(F.col("_passed").isNotNull(), "rejected").otherwise("open")
    return met.select("id", "lot", "m.score", "m.confidence", decision.alias("decision"))


def links_of(pairs: DataFrame, raw: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of the link table for the pairs that are linked; a verdict's sentiment and keywords go before the text's own, but not for links by rule."""
    given = verdicts.select("id", "lot", F.col("sentiment_score").alias("_s"), F.col("keywords").alias("_k"))
    linked = pairs.filter(F.col("decision").isin("rule", "model"))
    rows = linked.join(given, ["id", "lot"], "left").join(raw.drop("lot"), "id")
    model = F.col("decision") == "model"
    own = lambda theirs, ours: F.coalesce(F.when(model, F.col(theirs)), F.col(ours)).alias(ours)
    return rows.select(
        F.col("lot").alias("parking_lot_id"), "source", F.concat_ws(":", "source_id", "lot").alias("source_id"), _plain(F.col("title")).alias("title"), _plain(F.col("content")).alias("content"), "source_url",
        "author", "published_at", F.col("score").alias("relevance_score"), F.col("id").alias("raw_source_id"), own("_s", "sentiment_score"), own("_k", "keywords"),
    )


def earlier(spark: SparkSession, path: str, batch: int, schema: StructType) -> DataFrame:
    """The rows that batches before this one left under a path; none where nothing was written yet."""
    try:
        return spark.read.option("basePath", path).schema(schema).parquet(f"{path}/batch=*").filter(F.col("batch") < batch).drop("batch")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_match_job(raw: DataFrame, lots: DataFrame, verdicts: DataFrame, out: str, batch: int, stop: list[str], now: str) -> None:
    """One run over the texts that passed the filter and are not done: links, open pairs and done texts as tables of the batch.

    out/links, out/open and out/done hold a folder for each batch. Links are inserted where their (source, source_id) is
    not there yet. A text is done once it was tried (it had keywords) and none of its pairs is open; open pairs wait for
    their verdicts, and the text is tried again. `done` is written last, so a run that broke off is simply run again under its
    number: it overwrites what it had written and finds the same texts. raw: id, source, source_id, source_url, title, content,
    author, published_at, sentiment_score, keywords, filter_passed, filter_tier.
    """
    spark = raw.sparkSession
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")
    done = earlier(spark, f"{out}/done", batch, raw.select("id").schema)
    asked = raw.filter("filter_passed = 1").join(done, "id", "left_anti")
    put(decided_pairs(asked, lots, verdicts, stop), "pairs")
    pairs = spark.read.parquet(f"{out}/pairs/batch={batch}")
    links = links_of(pairs, asked, verdicts)
    put(insert_ignore(earlier(spark, f"{out}/links", batch, links.select("source", "source_id").schema), links, ["source", "source_id"]), "links")
    waiting = pairs.filter("decision = 'open'").select("id", "lot")
    told = asked.select("id", _plain(F.col("title")).alias("title"), _plain(F.col("content")).alias("content"))
    put(waiting.join(told, "id").join(lots.select(F.col("id").alias("lot"), F.col("name").alias("lot_name"), F.col("address").alias("lot_address")), "lot"), "open")
    tried = told.filter(F.size(search_keywords(F.col("title"), F.col("content"), stop)) > 0).select("id")
    put(tried.join(waiting.select("id"), "id", "left_anti").withColumn("matched_at", F.lit(now).cast("timestamp")), "done")


def stored_links(spark: SparkSession, out: str) -> DataFrame:
    """The link table of all batches."""
    return spark.read.option("basePath", f"{out}/links").parquet(f"{out}/links/batch=*").drop("batch")
