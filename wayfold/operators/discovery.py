"""Places that texts mention and the catalogue lacks: names classified, evidence merged, search results resolved."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions import vocab
from wayfold.functions.columns import KOREA, Box, any_of, array_of, in_box, round_half_up, trimmed, words_of
from wayfold.operators.spatial import nearest

#: Kinds of names that are worth a search, and the metres within which a found place is one of the catalogue.
SEARCHED, SAME_PLACE_M = ["parking_lot_name", "facility_name"], 60.0
HINT = "([가-힣]{2,}(?:구|군|동|읍|면|리|로|길))"


def compatible_form(c: Column) -> Column:
    """Unicode's NFKC, which Spark has no function for."""

    @F.arrow_udf("string")
    def form(names: pa.Array) -> pa.Array:
        return pa.array([n if n is None else unicodedata.normalize("NFKC", n) for n in names.to_pylist()], pa.string())

    return form(c)


def normal_name(c: Column) -> Column:
    """Compatible characters, white space as one space, no brackets, quotes, dots or dashes at the ends."""
    c = trimmed(F.regexp_replace(compatible_form(c), r"(?U)\s+", " "))
    return trimmed(F.regexp_replace(trimmed(F.regexp_replace(c, r"""^[\[("'·-]+""", "")), r"""[\])"'·-]+$""", ""))


def meaningful_words(c: Column) -> Column:
    return F.array_except(F.filter(words_of(c), lambda w: F.length(w) >= 2), array_of(vocab.MISSED_FRAGMENTS + vocab.MISSED_GENERIC))


def candidate_type(n: Column) -> Column:
    """One of seven kinds of a normal name; the first rule that fits."""
    provinces = "|".join(vocab.FULL_PROVINCES)
    a_region = n.rlike(r"(?:^|\s)\S+" + vocab.ADMIN_TAIL) | n.rlike(rf"^({provinces})( ({provinces}))*$")
    named = F.size(meaningful_words(F.regexp_replace(n, vocab.PARKING_KIND, ""))) > 0
    return (
        F.when(n.isNull() | (n == "") | (F.length(n) > 40), "unknown").when(n.rlike(vocab.MISSED_PAGES), "page_or_service").when(n.isin(vocab.MISSED_GENERIC), "generic_term")
        .when(n.rlike(vocab.PARKING_NAME), F.when(named, "parking_lot_name").otherwise("generic_term")).when(n.rlike(vocab.MISSED_ORGANIZATIONS), "organization_name")
        .when(a_region, "region_name").when(F.size(meaningful_words(n)) == 0, "generic_term").otherwise("facility_name")
    )


def extraction_confidence(kind: Column, n: Column, evidence: Column, sources: Column) -> Column:
    base = F.create_map(*[F.lit(x) for pair in vocab.MISSED_CONFIDENCE.items() for x in pair])[kind]
    more = F.when(n.rlike(vocab.PARKING_NAME_STRONG), 0.1).otherwise(0.0) + F.when(evidence >= 2, 0.05).otherwise(0.0) + F.when(sources >= 2, 0.05).otherwise(0.0)
    return F.least(F.lit(0.95), round_half_up(base + more))


def missed_candidates(rows: DataFrame, name: str = "missed_lot_name", source: str = "source") -> DataFrame:
    """One row per normal name, case aside, of rows with name and source: evidence, sources, kind and confidence.

    Names that are null or have nothing left are no candidates. Spellings are shown by the least one. Evidence is summed
    per spelling and source before the shuffle by name, so a name that a third of the rows hold is few rows there.
    """
    each = rows.groupBy(name, source).agg(F.count("*").alias("n")).withColumn("normalized_name", normal_name(F.col(name))).filter("normalized_name <> ''")
    out = each.groupBy(F.lower("normalized_name").alias("key")).agg(
        F.min("normalized_name").alias("normalized_name"), F.sum("n").alias("evidence_count"), F.count_distinct(source).alias("source_count")
    )
    out = out.withColumn("candidate_type", candidate_type(F.col("normalized_name")))
    confidence = extraction_confidence(F.col("candidate_type"), F.col("normalized_name"), F.col("evidence_count"), F.col("source_count"))
    return out.withColumn("extraction_confidence", confidence).withColumn("search_eligible", F.col("candidate_type").isin(SEARCHED))


def merged_mentions(mentions: DataFrame, group: str, name: str, order: str, least: int = 1, key: Column | None = None) -> DataFrame:
    """Mentions of a place per group by key, which is the name without case and spaces if none is given: how many, in how many texts, first name, category and tip.

    mentions also has text_id, category and tip. First means by `order`; tips that are null or empty are passed over.
    """
    key = F.lower(F.regexp_replace(name, r"(?U)\s", "")) if key is None else key
    tip = F.when(F.col("tip") != "", F.struct(F.col(order).alias("at"), "tip"))
    first = F.min_by(F.struct(F.col(name).alias("name"), "category"), order)
    out = mentions.groupBy(group, key.alias("key")).agg(first.alias("first"), F.min(tip)["tip"].alias("tip"), F.count("*").alias("mention_count"), F.count_distinct("text_id").alias("text_count"))
    return out.filter(F.col("mention_count") >= least).select(group, "key", "first.name", "first.category", "tip", "mention_count", "text_count")


def hints(text: Column) -> Column:
    """Distinct names of districts and roads in a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(HINT), 1))


def with_evidence(results: DataFrame, lots: DataFrame, names: DataFrame, metres: float = SAME_PLACE_M, box: Box | None = KOREA) -> DataFrame:
    """resolved_places() with the place of the catalogue that the best result lies at, where all exist (lot), and whether
    that result is about the candidate (relevant): its address has one of the hints, or its name a word of the candidate's."""
    cores = F.filter(words_of(F.regexp_replace("normal", vocab.PARKING_KIND, " ")), lambda w: F.length(w) >= 2)
    names = names.select("candidate", F.col("name").alias("normal"), "hints").withColumn("cores", cores)
    parking = results.filter((F.contains("category", F.lit("주차")) | F.contains("name", F.lit("주차"))) & in_box(F.col("lat"), F.col("lng"), box))
    near = nearest(parking.select("id", "lat", "lng"), lots.select("id", "lat", "lng"), 0.003).select(F.col("left_id").alias("id"), F.col("right_id").alias("lot"), "metres")
    rows = parking.join(near, "id", "left").join(names, "candidate")
    score = F.size(F.filter("hints", lambda h: F.contains(F.col("address"), h)))
    rows = rows.withColumn("new", F.coalesce(F.col("metres") > metres, F.lit(True))).withColumn("region_score", F.greatest(F.lit(0), score))
    rows = rows.withColumn("relevant", (F.col("region_score") > 0) | F.exists("cores", lambda t: F.contains(F.col("name"), t)))
    # first by candidate and score, then by candidate
    by_score = rows.groupBy("candidate", "new", "region_score").agg(
        F.count("*").alias("n"), F.min_by(F.struct("id", "relevant"), "id").alias("first"), F.min(F.struct(F.coalesce("metres", F.lit(1e9)).alias("m"), "id", "lot", "relevant")).alias("closest")
    )
    new_only = lambda c: F.when(F.col("new"), c)
    out = by_score.groupBy("candidate").agg(
        F.sum("n").alias("parking_count"), F.coalesce(F.sum(new_only(F.col("n"))), F.lit(0)).alias("new_count"),
        F.max_by(F.struct("first", "region_score", F.col("n").alias("ties")), new_only(F.col("region_score"))).alias("top"), F.min("closest").alias("closest"),
    )
    out = names.select("candidate").join(out, "candidate", "left")
    sure = F.when(F.col("new_count") == 1, F.col("top.first.relevant")).otherwise((F.col("top.region_score") > 0) & (F.col("top.ties") == 1))
    label = F.when(F.col("parking_count").isNull(), "negative").when(F.col("new_count") == 0, "all_existing").when(sure, "resolved_new").otherwise("ambiguous_new")
    existing = F.col("new_count") == 0
    best = F.when(existing, F.col("closest.id")).otherwise(F.col("top.first.id"))
    relevant = F.when(existing, F.col("closest.relevant")).otherwise(F.col("top.first.relevant"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("candidate", label.alias("label"), zero("parking_count"), zero("new_count"), best.alias("best"), F.when(existing, F.col("closest.lot")).alias("lot"), F.coalesce(relevant, F.lit(False)).alias("relevant"))


def resolved_places(results: DataFrame, lots: DataFrame, names: DataFrame, metres: float = SAME_PLACE_M, box: Box | None = KOREA) -> DataFrame:
    """What search results say of each candidate: resolved_new, ambiguous_new, all_existing or negative, with the best result.

    results: candidate, id (unique), name, category, address, lat, lng; names: candidate, its name (normal) and hints.
    Results count if they are parking places in the box (the country; without one, anywhere); those within `metres` of a place of the catalogue exist already.
    Of several new ones the best has the most hints in its address (ties: the least id) and is sure if alone at the top.
    """
    return with_evidence(results, lots, names, metres, box).select("candidate", "label", "parking_count", "new_count", "best")


def capped_text(rows: DataFrame, key: str, text: str, order: str, most: int = 4000) -> DataFrame:
    """Texts of a key joined by spaces in order; a text is added as long as those before it have fewer than `most` characters.

    Each text adds a character at least, so only the first most + 1 rows of a key matter; tasks leave the others out
    before the shuffle. Null texts count as empty.
    """
    own = W.partitionBy(key).orderBy(order)
    first = rows.select(key, order, F.coalesce(text, F.lit("")).alias("t")).withColumn("_nth", F.row_number().over(own)).filter(F.col("_nth") <= most + 1)
    before = F.coalesce(F.sum(F.length("t") + 1).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = first.withColumn("_before", before).filter(F.col("_before") <= most)
    parts = F.array_sort(F.collect_list(F.struct("_nth", "t")))
    return kept.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"))


def crawl_relevance(title: Column, description: Column, name: Column, address_region: Column) -> Column:
    """0 to 100: how far a search result is about a place, by its name's words in title and description, region and topic."""
    words = F.filter(words_of(F.regexp_replace(F.lower(name), vocab.CRAWL_SUFFIXES, "")), lambda w: F.length(w) >= 2)
    special = lambda a: F.filter(a, lambda w: ~w.isin(vocab.CRAWL_COMMON))
    inside = lambda a, t: F.filter(a, lambda w: F.contains(t, w))
    in_title, in_text = inside(words, title), inside(words, description)
    special_title, special_text = F.size(special(in_title)), F.size(special(in_text))
    score = F.when(F.size(in_title) >= 2, 50).when(special_title >= 1, 40).when(F.size(in_title) == 1, 25).otherwise(0)
    score += F.when(F.size(in_text) >= 2, 20).when(special_text >= 1, 15).when(F.size(in_text) == 1, 5).otherwise(0)
    regions = F.filter(words_of(F.lower(address_region)), lambda w: F.length(w) >= 2)
    score += F.when(F.exists(regions, lambda w: F.contains(title, w) | F.contains(description, w)), 20).otherwise(0)
    score += F.when(any_of([F.contains(title, F.lit("주차")), F.contains(description, F.lit("주차"))]), 10).otherwise(0)
    score = F.when((F.size(in_title) == 0) & (F.size(in_text) == 0), F.least(score, F.lit(30))).otherwise(score)
    only_common = (F.size(special(words)) > 0) & (special_title == 0) & (special_text == 0)
    return F.when(only_common, F.least(score, F.lit(45))).otherwise(score)
