"""Work of those who keep the catalogue: searches, tags, candidates for texts and reviews, targets in order, reports of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.columns import name_similarity
from wayfold.operators.spatial import within
from wayfold.sources.files import running_total

# Words of bad experiences, sources of texts, reasons of reports, cities in order of importance.
HARD_WORDS = ["좁", "무서", "힘들", "골뱅이", "긁", "기계식", "나선", "경사"]
SOURCES = ["naver_blog", "naver_cafe", "poi", "youtube_comment", "naver_place", "brave_search", "ddg_search", "tistory_blog", "all"]
CITIES = ["서울", "경기", "인천", "부산", "대구"]


def searched_places(lots: DataFrame, asked: str, limit: int = 10) -> DataFrame:
    """The first places by name (then id) whose name or address holds the words asked for; case of Latin letters aside."""
    part = F.lit(asked.lower())
    found = F.contains(F.lower(F.coalesce("name", F.lit(""))), part) | F.contains(F.lower(F.coalesce("address", F.lit(""))), part)
    return lots.filter(found).orderBy("name", "id").limit(limit).select("id", "name", "address")


def allowed(value: str, values: list[str], what: str) -> str:
    """The value, if it is one of those allowed; else an error before any job runs."""
    if value not in values:
        raise ValueError(f"{what} must be one of {', '.join(values)}; got {value!r}")
    return value


def of_source(rows: DataFrame, source: str) -> DataFrame:
    """Rows of one source, or of all."""
    return rows if allowed(source, SOURCES, "source") == "all" else rows.filter(F.col("source") == source)


def of_sources(rows: DataFrame, listed: str) -> DataFrame:
    """Rows of the sources in a comma-separated list, or of all."""
    return rows if listed == "all" else rows.filter(F.col("source").isin([s.strip() for s in listed.split(",")]))


def valid_report(kind: Column, reason: Column, detail: Column, target: Column, reasons: dict[str, list[str]]) -> Column:
    """Why a report is refused, null if it is taken: unknown kind, no target, a reason that the kind has not, other without a detail."""
    known = reduce(lambda a, b: a | b, [(kind == k) & reason.isin(r) for k, r in reasons.items()], F.lit(False))
    bare = (reason == "other") & (F.length(F.trim(F.coalesce(detail, F.lit("")))) < 2)
    return F.when(~F.coalesce(kind.isin(list(reasons)), F.lit(False)), "kind").when(target.isNull(), "target").when(~F.coalesce(known, F.lit(False)), "reason").when(bare, "detail")


def edited(rows: DataFrame, edits: DataFrame, key: str, columns: list[str], at: str, now: Column) -> DataFrame:
    """rows with the columns that edits set (null sets null), the last edit of a key by seq, and the time of it in `at`; keys without a row change nothing."""
    last = edits.groupBy(key).agg(F.max_by(F.struct(*columns), "seq").alias("_e"))
    out = rows.join(last, key, "left")
    hit = F.col("_e").isNotNull()
    return out.withColumns({**{c: F.when(hit, F.col(f"_e.{c}")).otherwise(F.col(c)) for c in columns}, at: F.when(hit, now).otherwise(F.col(at))}).drop("_e")


def relinked_pairs(pairs: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs after additions and removals (op add or remove, in order of seq); the last change of a pair decides, adding one that is there changes nothing."""
    last = changes.groupBy(*keys).agg(F.max_by("op", "seq").alias("_op"))
    added = last.filter("_op = 'add'").select(*keys)
    return pairs.select(*keys).join(last.select(*keys), keys, "left_anti").unionByName(added).distinct()


def split_signals(rows: DataFrame, now_order: list[str]) -> tuple[DataFrame, DataFrame]:
    """One table of (title, place) rows as two: signals, one for each title with a number, and the places of each signal, once.

    url, snippet and sentiment are the least of a title's, the score the greatest; numbers follow the order given, then the title.
    """
    signals = rows.groupBy("title").agg(
        F.min("url").alias("url"), F.min("snippet").alias("snippet"), F.min("sentiment").alias("sentiment"), F.max("score").alias("score"), F.min("created_at").alias("created_at")
    )
    numbered = running_total(signals.withColumn("_key", F.struct(*now_order, "title")), "_key", F.lit(1), "signal_id").drop("_key")
    places = rows.select("title", "lot").distinct().join(numbered.select("title", "signal_id"), "title").select("signal_id", "lot")
    return numbered, places


def replaced_values(rows: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """rows with a column emptied and set anew where `new` has the key (the greatest value, should it have several)."""
    own = new.groupBy(key).agg(F.max(column).alias("_v"))
    return rows.drop(column).join(own, key, "left").withColumnRenamed("_v", column)


def without_short(rows: DataFrame, text: str, least: int, only: DataFrame | None = None, key: str = "id") -> DataFrame:
    """rows whose texts of fewer than `least` characters are null; only: keys that this is limited to."""
    short = F.length(text) < least
    if only is None:
        return rows.withColumn(text, F.when(~F.coalesce(short, F.lit(False)), F.col(text)))
    marked = rows.join(only.select(key).distinct().withColumn("_asked", F.lit(True)), key, "left")
    return marked.withColumn(text, F.when(~F.coalesce(short & F.col("_asked"), F.lit(False)), F.col(text))).drop("_asked")


def hard_places(lots: DataFrame, texts: DataFrame, text: str, words: list[str] | None = None, least: int = 2, limit: int = 50) -> DataFrame:
    """Places that are not curated and whose texts tell of bad experiences `least` times or more: id and neg, the most first (ties by id)."""
    hit = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words or HARD_WORDS])
    counts = texts.filter(hit).groupBy(F.col("parking_lot_id").alias("id")).agg(F.count("*").alias("neg")).filter(F.col("neg") >= least)
    return lots.filter(F.col("curation_tag").isNull()).select("id").join(counts, "id").orderBy(F.desc("neg"), "id").limit(limit)


def hinted(raw: DataFrame, lots: DataFrame, source: str, limit: int) -> DataFrame:
    """Texts of a source that no filter has seen yet, with the place that they were searched for, in order of id."""
    named = lots.select(F.col("id").alias("search_lot_hint"), F.col("name").alias("hint_lot_name"), F.col("address").alias("hint_lot_address"))
    waiting = raw.filter((F.col("source") == source) & F.col("filter_passed").isNull() & F.col("search_lot_hint").isNotNull())
    return waiting.join(named, "search_lot_hint").orderBy("id").limit(limit)


def searched_first(candidates: DataFrame, limit: int) -> DataFrame:
    """Candidates worth a search: the most evidence first, then sources, then confidence (ties by key)."""
    return candidates.filter("search_eligible").orderBy(F.desc("evidence_count"), F.desc("source_count"), F.desc("extraction_confidence"), "key").limit(limit)


def by_city(lots: DataFrame, limit: int, offset: int = 0, cities: list[str] | None = None) -> DataFrame:
    """Places without opening hours that are to be looked up, those of the important cities first, then by id."""
    first = cities or CITIES
    rank = F.coalesce(*[F.when(F.startswith("address", F.lit(c)), i) for i, c in enumerate(first, 1)], F.lit(len(first) + 1))
    return lots.filter(F.coalesce("weekday_start", F.lit("")) == "").select("id", rank.alias("city")).orderBy("city", "id").offset(offset).limit(limit)


def examples(lots: DataFrame, web: DataFrame, reviews: DataFrame, seed: int = 0) -> DataFrame:
    """One place of each kind, drawn by a hash of seed and id: rich (6 texts or more), middle (1 to 3, with spaces), meta (no text or review, but hours and fee), bare (none of these)."""
    n = web.groupBy(F.col("parking_lot_id").alias("id")).agg(F.count("*").alias("web"))
    rows = lots.join(n, "id", "left").join(reviews.select(F.col("parking_lot_id").alias("id")).distinct().withColumn("reviewed", F.lit(True)), "id", "left")
    web_count, silent = F.coalesce("web", F.lit(0)), F.col("web").isNull() & F.col("reviewed").isNull()
    kind = F.when(web_count >= 6, "rich").when(web_count.between(1, 3) & (F.col("total_spaces") > 0), "middle")
    kind = kind.when(silent & F.col("weekday_start").isNotNull() & F.col("base_fee").isNotNull(), "meta").when(silent & F.col("weekday_start").isNull() & F.col("base_fee").isNull(), "bare")
    drawn = F.min_by("id", F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id"))), "id"))
    return rows.withColumn("kind", kind).filter(F.col("kind").isNotNull()).groupBy("kind").agg(drawn.alias("id"))


def seedable(lots: DataFrame, web: DataFrame, reviews: DataFrame, least: int = 40) -> DataFrame:
    """Curated places without a seed review that have relevant texts, with how many: id and blogs."""
    blogs = web.filter(F.col("relevance_score") >= least).groupBy(F.col("parking_lot_id").alias("id")).agg(F.count("*").alias("blogs"))
    seeded = reviews.filter("is_seed = 1").select(F.col("parking_lot_id").alias("id"))
    return lots.filter(F.col("curation_tag").isNotNull()).select("id").join(seeded, "id", "left_anti").join(blogs, "id").orderBy(F.desc("blogs"), "id")


def public_matches(targets: DataFrame, public: DataFrame, metres: float = 150.0, least: float = 0.5) -> DataFrame:
    """For each target the public place that fits best: id, match, metres, similarity.

    Of those within the distance and alike enough in name the one of the most 100 * similarity - metres / 10 (ties by id).
    """
    near = within(public, targets, metres).select(F.col("left_id").alias("match"), F.col("right_id").alias("id"), "metres")
    named = near.join(targets.select("id", F.col("name").alias("_a")), "id").join(public.select(F.col("id").alias("match"), F.col("name").alias("_b")), "match")
    alike = named.withColumn("similarity", name_similarity(F.col("_a"), F.col("_b"))).filter(F.col("similarity") >= least)
    best = F.min_by(F.struct("match", "metres", "similarity"), F.struct((F.col("metres") / 10 - F.col("similarity") * 100).alias("s"), "match"))
    return alike.groupBy("id").agg(best.alias("b")).select("id", "b.*")


def null_rates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """For each column how many rows have it null or empty, and all rows: field, empty, total. One pass."""
    one = rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(f"_{c}") for c in columns])
    return one.select("total", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_{c}").alias("empty")) for c in columns])).alias("x")).select("x.field", "x.empty", "total")


def markdown(table: DataFrame, title: str, columns: list[str], order: list[str], most: int = 1000) -> str:
    """A section of a report: a heading and the rows of a small table, `most` at most; the driver holds no more than these."""
    rows = table.select(*columns).orderBy(*order).limit(most).collect()
    cell = lambda v: "" if v is None else f"{v:,}" if isinstance(v, int) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *["| " + " | ".join(cell(v) for v in r) + " |" for r in rows], ""]
    return "\n".join(lines)

