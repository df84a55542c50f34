"""Queries of those who keep the catalogue, of crawl states and queues, of the maintained index and of sitemaps as a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import curation, places, postings, spatial
from wayfold.operators.discovery import missed_candidates
from wayfold.plans.page_queries import METRES
from wayfold.plans.registry import ORACLE, query
from wayfold.sources import files
from wayfold.sources.shared import shared_path, stored
from wayfold.streaming import states

NOW_SQL = "TIMESTAMP '2002-01-01'"


@query("admin_search", "SELECT id, name, address FROM p_lots WHERE contains(lower(name), 'building') OR contains(lower(address), 'building') ORDER BY name, id LIMIT 10")
def _(c):
    return curation.searched_places(c.lots, "Building")


@query("web_of_source", "SELECT id, parking_lot_id, relevance_score FROM p_web WHERE source = 'ddg_search'")
def _(c):
    return curation.of_source(c.web, "ddg_search").select("id", "parking_lot_id", "relevance_score")


@query("web_of_sources", "SELECT id, source, relevance_score FROM p_web WHERE source IN ('naver_blog', 'tistory_blog')")
def _(c):
    return curation.of_sources(c.web, "naver_blog, tistory_blog").select("id", "source", "relevance_score")


@query("refused_reports", "SELECT id, CASE WHEN target_type = 'media' THEN 'kind' WHEN id % 7 = 0 THEN 'target' WHEN id % 3 = 0 AND target_type = 'review' THEN 'reason' WHEN id % 3 = 1 AND id % 2 = 0 THEN 'detail' END AS refused FROM p_reports")
def _(c):
    reason = F.when(F.col("id") % 3 == 0, "spam").when(F.col("id") % 3 == 1, "other").otherwise("wrong")
    detail = F.when(F.col("id") % 2 == 0, " x ").otherwise("lies")
    target = F.when(F.col("id") % 7 != 0, F.col("target_id"))
    reasons = {"web_source": ["spam", "other", "wrong"], "review": ["other", "wrong"]}
    return c.reports.select("id", curation.valid_report(F.col("target_type"), reason, detail, target, reasons).alias("refused"))


@query("tagged_signals", f"SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 5 END ELSE id % 4 END AS score, CASE WHEN id % 3 = 0 THEN {NOW_SQL} END AS updated_at FROM p_docs")
def _(c):
    rows = c.docs.select("id", (F.col("id") % 4).alias("score"), F.lit(None).cast("timestamp").alias("updated_at"))
    edits = c.docs.filter("id % 3 = 0").select("id", F.lit(2).alias("seq"), F.when(F.col("id") % 2 == 0, 5).cast("long").alias("score"))
    edits = edits.unionByName(edits.withColumns({"seq": F.lit(1), "score": F.lit(1).cast("long")}))
    return curation.edited(rows, edits, "id", ["score"], "updated_at", F.lit("2002-01-01").cast("timestamp"))


@query("signal_places", "SELECT DISTINCT web_source_id, parking_lot_id FROM p_ai_matches WHERE web_source_id % 3 <> 0 UNION SELECT web_source_id, 'PB-2' FROM p_ai_matches WHERE web_source_id % 2 = 0")
def _(c):
    own = c.ai_matches.select("web_source_id", "parking_lot_id")
    removed = own.filter("web_source_id % 3 = 0").withColumns({"op": F.lit("remove"), "seq": F.lit(1)})
    added = own.filter("web_source_id % 2 = 0").withColumns({"parking_lot_id": F.lit("PB-2"), "op": F.lit("add"), "seq": F.lit(2)})
    return curation.relinked_pairs(own, removed.unionByName(added), ["web_source_id", "parking_lot_id"])


SIGNAL = "SELECT 'title ' || CAST(id % 97 AS STRING) AS title, parking_lot_id AS lot, source AS url, CAST(relevance_score AS STRING) AS snippet, CASE WHEN id % 2 = 0 THEN 'neutral' ELSE 'bad' END AS sentiment, id % 5 AS score, published_at AS created_at FROM p_web"


@query("split_signals", f"WITH s AS ({SIGNAL}), one AS (SELECT title, row_number() OVER (ORDER BY min(created_at), title) AS signal_id, min(url) AS url, min(snippet) AS snippet, min(sentiment) AS sentiment, max(score) AS score FROM s GROUP BY title) SELECT signal_id, title, url, snippet, sentiment, score, lots FROM one JOIN (SELECT title, count(DISTINCT lot) AS lots FROM s GROUP BY title) USING (title)")
def _(c):
    rows = c.web.select(F.concat(F.lit("title "), (F.col("id") % 97).cast("string")).alias("title"), F.col("parking_lot_id").alias("lot"), F.col("source").alias("url"), F.col("relevance_score").cast("string").alias("snippet"), F.when(F.col("id") % 2 == 0, "neutral").otherwise("bad").alias("sentiment"), (F.col("id") % 5).alias("score"), F.col("published_at").alias("created_at"))
    signals, places = curation.split_signals(rows, ["created_at"])
    return signals.join(places.groupBy("signal_id").agg(F.count("*").alias("lots")), "signal_id").select("signal_id", "title", "url", "snippet", "sentiment", "score", "lots")


@query("recomputed_sentiment", "SELECT id, CASE WHEN relevance_score >= 60 AND filter_passed_v2 = 1 THEN relevance_score / 20e0 END AS sentiment_score FROM (SELECT id, max(relevance_score) AS relevance_score, 1 AS filter_passed_v2 FROM p_web WHERE filter_passed_v2 = 1 GROUP BY id)")
def _(c):
    rows = c.web.filter("filter_passed_v2 = 1").groupBy("id").agg(F.max("relevance_score").alias("relevance_score"), F.min("sentiment_score").alias("sentiment_score"))
    new = rows.filter("relevance_score >= 60").select("id", (F.col("relevance_score") / 20).alias("sentiment_score"))
    return curation.replaced_values(rows, new, "id", "sentiment_score").select("id", "sentiment_score")


@query("short_titles_emptied", "SELECT id, CASE WHEN length(title) >= 40 OR id % 2 = 1 THEN title END AS title FROM p_docs")
def _(c):
    return curation.without_short(c.docs.select("id", "title"), "title", 40, c.docs.filter("id % 2 = 0"))


@query("hard_places", "SELECT l.id, count(*) AS neg FROM p_lots l JOIN p_missed m ON 'KA-' || (m.id % 1500) = l.id WHERE curation_tag IS NULL AND (contains(content, 'er') OR contains(content, 'the')) GROUP BY l.id HAVING count(*) >= 2 ORDER BY neg DESC, l.id LIMIT 50")
def _(c):
    texts = c.missed.select(F.concat(F.lit("KA-"), (F.col("id") % 1500).cast("string")).alias("parking_lot_id"), "content")
    return curation.hard_places(c.lots, texts, "content", ["er", "the"])


@query("hinted_texts", "SELECT r.id, l.id AS search_lot_hint, l.name AS hint_lot_name FROM p_raw r JOIN p_lots l ON l.id = 'KA-' || (r.id * 3) WHERE r.id % 4 <> 1 AND r.id % 5 = 0 ORDER BY r.id LIMIT 20")
def _(c):
    raw = c.raw.select("id", F.lit("youtube_video").alias("source"), F.when(F.col("id") % 5 != 0, 1).alias("filter_passed"), F.when(F.col("id") % 4 != 1, F.concat(F.lit("KA-"), (F.col("id") * 3).cast("string"))).alias("search_lot_hint"))
    return curation.hinted(raw, c.lots, "youtube_video", 20).select("id", "search_lot_hint", "hint_lot_name")


@query("searched_first", f"SELECT key, evidence_count, source_count, extraction_confidence FROM ({ORACLE['missed_candidates']}) WHERE search_eligible ORDER BY evidence_count DESC, source_count DESC, extraction_confidence DESC, key LIMIT 50")
def _(c):
    return curation.searched_first(missed_candidates(c.missed), 50).select("key", "evidence_count", "source_count", "extraction_confidence")


@query("lots_by_city", "SELECT id, CASE WHEN starts_with(address, 'ASIA') THEN 1 WHEN starts_with(address, 'EUROPE') THEN 2 ELSE 3 END AS city FROM p_lots WHERE coalesce(weekday_start, '') = '' ORDER BY city, id LIMIT 100 OFFSET 5")
def _(c):
    return curation.by_city(c.lots, 100, 5, ["ASIA", "EUROPE"])


@query("example_places", """WITH n AS (SELECT l.*, (SELECT count(*) FROM p_web w WHERE w.parking_lot_id = l.id) AS web, (SELECT count(*) FROM p_reviews r WHERE r.parking_lot_id = l.id) AS reviews FROM p_lots l),
 k AS (SELECT id, CASE WHEN web >= 6 THEN 'rich' WHEN web BETWEEN 1 AND 3 AND total_spaces > 0 THEN 'middle' WHEN web + reviews = 0 AND weekday_start IS NOT NULL AND base_fee IS NOT NULL THEN 'meta' WHEN web + reviews = 0 AND weekday_start IS NULL AND base_fee IS NULL THEN 'bare' END AS kind FROM n)
 SELECT kind, arg_min(id, (md5('7:' || id), id)) AS id FROM k WHERE kind IS NOT NULL GROUP BY kind""")
def _(c):
    return curation.examples(c.lots, c.web, c.reviews, 7)


@query("seedable_places", "SELECT l.id, count(*) AS blogs FROM p_lots l JOIN p_web w ON w.parking_lot_id = l.id AND w.relevance_score >= 40 WHERE curation_tag IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p_reviews r WHERE r.parking_lot_id = l.id AND is_seed = 1) GROUP BY l.id")
def _(c):
    return curation.seedable(c.lots, c.web, c.reviews)


SIMILAR = "CASE WHEN a = b THEN 1e0 WHEN contains(a, b) OR contains(b, a) THEN 0.8e0 ELSE len(list_filter(string_split(a, ''), lambda ch: ch <> '' AND contains(b, ch))) / greatest(length(a), length(b)) END"


@query("public_matches", f"""WITH near AS (SELECT r.id, l.id AS match, {METRES} AS metres, replace(lower(replace(r.name, 'Supplier', 'Customer')), ' ', '') AS a, lower(replace(l.name, ' ', '')) AS b FROM p_results r JOIN p_lots l ON abs(r.lat - l.lat) < 0.003 AND abs(r.lng - l.lng) < 0.003),
 fit AS (SELECT *, {SIMILAR} AS similarity FROM near WHERE metres <= 150) SELECT id, match, round(metres, 3) AS metres, similarity FROM fit WHERE similarity >= 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY metres / 10 - similarity * 100, match) = 1""")
def _(c):
    targets = c.results.select("id", F.replace("name", F.lit("Supplier"), F.lit("Customer")).alias("name"), "lat", "lng")
    return curation.public_matches(targets, c.lots).select("id", "match", F.round("metres", 3).alias("metres"), "similarity")


@query("null_rates", "SELECT field, empty, total FROM (SELECT count(*) AS total, count(*) FILTER (weekday_start IS NULL OR weekday_start = '') AS a, count(*) FILTER (base_fee IS NULL) AS b, count(*) FILTER (notes IS NULL OR notes = '') AS c FROM p_lots), LATERAL (VALUES ('weekday_start', a), ('base_fee', b), ('notes', c)) AS t(field, empty)")
def _(c):
    return curation.null_rates(c.lots, ["weekday_start", "base_fee", "notes"])


# states, breakers, queues

STATUS = "CASE event_type WHEN 'view' THEN 'ok' WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'error' ELSE 'lost' END"
MOVES = f"""RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) / 1e6 AS moment, {STATUS} AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events),
 m AS (SELECT key, 0::BIGINT AS nth, 0::BIGINT AS seq, 0e0 AS moment, '' AS before, '' AS after, false AS legal, 'pending' AS state, moment AS since, false AS timed FROM e WHERE nth = 1
 UNION ALL SELECT key, CASE WHEN late THEN nth ELSE nth + 1 END, seq, CASE WHEN late THEN since + 7200 ELSE moment END, state, CASE WHEN late THEN 'timeout' ELSE status END, late OR fits,
  CASE WHEN late THEN 'timeout' WHEN fits THEN status ELSE state END, CASE WHEN late THEN since + 7200 WHEN fits THEN moment ELSE since END, late
  FROM (SELECT m.key, m.nth, m.state, m.since, e.seq, e.moment, e.status, m.state = 'pending' AND e.moment > m.since + 7200 AS late, m.state = 'pending' AND e.status IN ('ok', 'timeout', 'error') OR m.state IN ('timeout', 'error') AND e.status = 'pending' AS fits FROM m JOIN e ON e.key = m.key AND e.nth = m.nth + 1))"""
PATIENT = states.Machine("pending", states.FETCHING.moves, {"pending": (7200.0, "timeout")})


def crawl_events(c):
    return c.events.select("user_id", F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.expr(STATUS).alias("to"))


@query("text_state_moves", f"WITH {MOVES} SELECT key AS user_id, seq, CAST(round(moment * 1e6) AS BIGINT) AS at, before, after, legal FROM m WHERE nth > 0 OR timed")
def _(c):
    moves = states.state_moves(crawl_events(c), "user_id", PATIENT)
    return moves.select("user_id", "seq", F.unix_micros("at").alias("at"), F.col("from").alias("before"), F.col("to").alias("after"), "legal")


BROKEN = "(CASE WHEN event_type IN ('error', 'click') THEN 1 ELSE 0 END)"


@query("attempts_until_stop", f"""WITH r AS (SELECT event_id, user_id % 20 AS source, {BROKEN} AS bad, sum(1 - {BROKEN}) OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS island FROM events),
 n AS (SELECT *, sum(bad) OVER (PARTITION BY source, island ORDER BY event_id) AS run FROM r), s AS (SELECT source, min(event_id) AS stop FROM n WHERE run >= 4 GROUP BY source)
 SELECT event_id, source, coalesce(event_id <= stop, true) AS tried FROM r LEFT JOIN s USING (source)""")
def _(c):
    rows = c.events.select("event_id", (F.col("user_id") % 20).alias("source"), (F.expr(BROKEN) == 1).alias("bad"))
    return states.attempts_until_stop(rows, "source", "event_id", F.col("bad"), F.lit(False), most=4, span=1000)[0].select("event_id", "source", "tried")


@query("dead_letters", "SELECT event_id, 3 AS attempts, 'closed place ' || lot_id AS error FROM p_messages WHERE lot_id NOT IN (SELECT id FROM p_lots WHERE total_spaces <= 100)")
def _(c):
    """The queue of messages as a stream; those about a place that is closed (here: too large) are tried three times and kept apart."""
    spark, out = c.spark, shared_path(c.spark, "queue")
    events = spark.readStream.schema(c.events.schema).option("pathGlobFilter", "events.parquet").parquet(c.sf_dir)
    messages = events.filter(F.col("event_type").isin("signup", "purchase")).select("event_id", F.concat(F.lit("KA-"), ((F.col("user_id") * 3) % 1500).cast("string")).alias("lot_id"))
    lots = c.lots.filter("total_spaces <= 100").select(F.col("id").alias("lot_id"))

    def handle(batch):
        return batch.join(lots, "lot_id", "left_anti").select("event_id", F.concat(F.lit("closed place "), "lot_id").alias("error"))

    states.consume(messages, "event_id", handle, out, shared_path(spark, "checkpoint"))
    return states.outcome(spark, out, "dead").select("event_id", "attempts", "error")


# a maintained index, sitemaps as a source

CHANGED = "SELECT id, CASE WHEN total_spaces % 3 = 0 THEN name || ' new' ELSE name END AS name, address FROM p_lots WHERE total_spaces % 5 <> 0"


@query("maintained_index", f"SELECT DISTINCT unnest(list_filter(string_split_regex(lower(name || ' ' || address), '\\s+'), lambda w: w <> '')) AS token, id AS lot FROM ({CHANGED})")
def _(c):
    path = shared_path(c.spark, "index")
    rows = c.lots.select("id", F.lit(1).alias("seq"), F.lit("insert").alias("op"), "name", "address", "total_spaces")
    updates = rows.filter("total_spaces % 3 = 0").withColumns({"op": F.lit("update"), "name": F.concat("name", F.lit(" new"))})
    deletes = rows.filter("total_spaces % 5 = 0").withColumns({"op": F.lit("delete"), "seq": F.lit(2)})
    for i, batch in enumerate((rows, updates.unionByName(deletes))):
        postings.apply_changes(batch.drop("total_spaces"), path, i)
    return postings.current_postings(c.spark, path)


@query("sitemap_round_trip", "SELECT 'https://example.org/lot/' || l.id AS loc, CAST(CAST(max(published_at) AS DATE) AS STRING) AS lastmod FROM p_lots l JOIN p_web w ON w.parking_lot_id = l.id GROUP BY l.id")
def _(c):
    """Places written as paged sitemaps with an index, and read back from the index."""
    folder = shared_path(c.spark, "sitemap")
    rows = c.lots.select("id").join(c.web.groupBy(F.col("parking_lot_id").alias("id")).agg(F.max("published_at").alias("modified")), "id")
    files.write_sitemaps(files.numbered_pages(rows, "id", 400), "https://example.org/lot/", folder)
    entries = files.expanded_sitemap(c.spark, f"{folder}/index", lambda loc: f"{folder}/pages/page={loc.rsplit('/', 1)[1].removesuffix('.xml')}")
    return entries.select("loc", F.col("lastmod").cast("string").alias("lastmod"))


@query("radius_clusters")
def _(c):
    """Clusters by radius at three zooms, with the zoom at which each comes apart."""
    tree = stored(spatial.cluster_tree(places.with_scores(c.lots, c.stats), [4, 8, 11]), "tree")
    expansion = spatial.expansion_zooms(tree)
    return tree.join(expansion, ["zoom", "id"]).select("zoom", "id", "parent", "points", "count_score", "easy", "hard", "expansion")
