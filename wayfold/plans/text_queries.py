"""Queries over texts, changes, audits and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import columns as C
from wayfold.functions.vocab import Feelings, Rules
from wayfold.operators import evaluation, matching, merge, places, rankings, relevance, sentiment
from wayfold.operators.scoring import recompute
from wayfold.plans.registry import query
from wayfold.sources.shared import shared_path
from wayfold.sources import files
from wayfold.sources.views import NOW
from wayfold.streaming import rescoring

#: Words that occur in the driver's prose, in the roles of the built-in vocabulary.
RULES = Rules(topic="the", adverts=["@"], low_words=["secret"], boilerplate=["licen"], news=[], narrative=["thth", "thre"], concrete=["tion", "ther", "thon"])
FEELINGS = Feelings(topic="the", positive=["that", "with", "for"], negative=["was", "this"], not_after={}, not_before={}, emoticons_bad=[], emoticons_good=[], intensifiers=["are"], negations=["from"], experience=["that", "with", "for", "was", "this"])


@query("rule_classes", "SELECT id, CASE WHEN full_text_status <> 'ok' OR full_text IS NULL OR length(full_text) < 500 OR contains(full_text, '@') OR contains(lower(full_text), 'secret') OR contains(full_text, 'licen') THEN 'low' WHEN NOT contains(title, 'the') AND (len(regexp_extract_all(full_text, 'thth|thre')) < 2 OR len(regexp_extract_all(full_text, 'tion|ther|thon')) = 0) THEN 'low' WHEN len(regexp_extract_all(full_text, 'thth|thre')) >= 2 AND len(list_distinct(regexp_extract_all(full_text, 'tion|ther|thon'))) >= 2 THEN 'high' ELSE 'medium' END AS class FROM p_docs")
def _(c):
    return c.docs.select("id", relevance.rule_class(F.col("title"), F.col("full_text"), F.col("full_text_status"), RULES).alias("class"))


@query("text_cleanup", r"SELECT id, length(trim(regexp_replace(full_text, 'https?://\S+', ' ', 'g'), chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12))) AS plain_length, greatest(1, CAST(ceil(length(full_text) / 4.0) AS BIGINT)) AS tokens, substring(sha256(title), 1, 16) AS title_hash FROM p_docs")
def _(c):
    return c.docs.select("id", F.length(C.trimmed(F.regexp_replace("full_text", r"https?://\S+", " "))).alias("plain_length"), C.token_estimate(F.col("full_text")).alias("tokens"), C.url_hash(F.col("title")).alias("title_hash"))


@query("pages_as_text", r"SELECT id, md5(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(content, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', chr(34)), '&nbsp;', ' '), '&#39;', chr(39)), '^\s+|\s+$', '', 'g')) AS text FROM p_raw")
def _(c):
    return c.raw.select("id", F.md5(C.strip_html(F.col("content"))).alias("text"))


@query("cleaned_texts", r"SELECT id, md5(trim(regexp_replace(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '\s+', ' ', 'g'))) AS text, md5(regexp_replace(regexp_replace(t, '!?\[[^\]\n]*\]\([^)\n]*\)', ' ', 'g'), 'https?://\S+', ' ', 'g')) AS bare FROM (SELECT id, full_text || chr(7) || '  [link](http://a.b/c) ![i](x) ' || chr(9) || 'see https://d.e/f now ' AS t FROM p_docs)")
def _(c):
    t = F.concat("full_text", F.lit("\x07  [link](http://a.b/c) ![i](x) \tsee https://d.e/f now "))
    return c.docs.select("id", F.md5(C.clean_text(t)).alias("text"), F.md5(C.strip_links(t)).alias("bare"))


@query("stripped_pages", "SELECT id, length(regexp_replace(content, '<[^>]*>', '', 'g')) AS n FROM p_raw")
def _(c):
    return c.raw.select("id", F.length(F.regexp_replace("content", "<[^>]*>", "")).alias("n"))


@query("raw_ingest", "SELECT source, source_id, min(id) AS id FROM p_raw GROUP BY 1, 2")
def _(c):
    return merge.keep_first(c.raw.select("source", "source_id", "id"), ["source", "source_id"], ["id"])


@query("search_keywords", None)
def _(c):
    return c.docs.select("id", relevance.search_keywords(F.col("title"), F.col("full_text"), ["the", "der", "les"]).alias("keywords"))


@query("sentiment_scores", None)
def _(c):
    return c.docs.select("id", sentiment.sentiment(F.col("full_text"), FEELINGS).alias("s")).select("id", "s.*")


@query("sentiment_rollup", None)
def _(c):
    rows = c.docs.withColumn("published", F.lit("2001-06-01").cast("timestamp"))
    return sentiment.text_rollup(rows, "source", "full_text", "published", NOW, FEELINGS)


@query("blog_relevance", None)
def _(c):
    # each text with the place it was crawled for: here the one of its number
    lots = c.lots.select(F.col("id").alias("lot"), "name", "address", F.substring("id", 4, 18).cast("long").alias("number"))
    rows = c.docs.join(lots, F.col("id") == F.col("number"))
    return rows.select("id", "lot", relevance.blog_relevance(F.col("title"), F.col("full_text"), F.col("name"), F.col("address")).alias("score"))


ADDRESSES = "SELECT address, list_distinct(string_split(lower(address), ' ')) AS words FROM (SELECT DISTINCT address FROM p_lots)"
TOKENS = "SELECT DISTINCT unnest(string_split(lower(name || ' ' || address), ' ')) AS token, id AS lot FROM p_lots"


@query("match_candidates", f"SELECT address, lot, hits, rank FROM (SELECT address, lot, count(*) AS hits, row_number() OVER (PARTITION BY address ORDER BY count(*) DESC, lot) AS rank FROM (SELECT address, unnest(words) AS token FROM ({ADDRESSES})) a JOIN ({TOKENS}) t USING (token) GROUP BY 1, 2) WHERE rank <= 20")
def _(c):
    texts = c.lots.select("address").distinct().withColumn("words", C.words_of(F.lower("address")))
    return matching.candidates(texts.withColumn("words", F.array_distinct("words")), "address", "words", matching.token_index(c.lots))


@query("match_all_words", f"SELECT address, lot FROM (SELECT address, words, lot, count(DISTINCT token) AS n FROM (SELECT address, words, unnest(words) AS token FROM ({ADDRESSES})) a JOIN ({TOKENS}) t USING (token) GROUP BY 1, 2, 3) WHERE n = len(words)")
def _(c):
    texts = c.lots.select("address").distinct().withColumn("words", C.words_of(F.lower("address")))
    return matching.all_words(texts, "address", "words", matching.token_index(c.lots))


# changes


@query("votes_toggled", "SELECT user_id, parking_lot_id, vote_type FROM (SELECT user_id, parking_lot_id, vote_type, seq, max(seq) FILTER (vote_type <> final) OVER w AS other, final FROM (SELECT *, last_value(vote_type) OVER (PARTITION BY user_id, parking_lot_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM p_votes) WINDOW w AS (PARTITION BY user_id, parking_lot_id)) WHERE seq > coalesce(other, -1) GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1")
def _(c):
    return merge.toggled(c.votes, ["user_id", "parking_lot_id"], "vote_type", "seq", ("up", "down"))


@query("stats_upsert", "SELECT parking_lot_id, CASE WHEN parking_lot_id LIKE 'KA-%' THEN final_score ELSE 1e0 END AS final_score, CASE WHEN parking_lot_id LIKE 'PB-%' OR parking_lot_id LIKE 'NV-%' THEN 'old' END AS summary FROM p_stats")
def _(c):
    old = c.stats.filter("parking_lot_id NOT LIKE 'KA-%'").select("parking_lot_id", F.lit(1.0).alias("final_score"), F.lit("old").alias("summary"))
    return merge.upsert(old, c.stats.filter("parking_lot_id LIKE 'KA-%'").select("parking_lot_id", "final_score"), ["parking_lot_id"], ["final_score"])


@query("progress_counters", "SELECT crawler_id, CAST(sum(completed_count) AS BIGINT) AS completed_count, max(last_run_at) AS last_run_at FROM (SELECT * FROM p_progress UNION ALL SELECT crawler_id, last_run_at, 1 FROM p_progress WHERE completed_count > 60) GROUP BY 1")
def _(c):
    more = c.progress.filter("completed_count > 60").withColumn("completed_count", F.lit(1).cast("long"))
    return merge.add_counters(c.progress, more, ["crawler_id"], ["completed_count"], ["last_run_at"])


@query("lots_difference", "SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'missing' WHEN o.name = n.name AND coalesce(CAST(o.base_fee AS STRING), '') = coalesce(CAST(n.base_fee AS STRING), '') THEN 'unchanged' ELSE 'changed' END AS change FROM (SELECT * FROM p_lots WHERE total_spaces > 50) o FULL JOIN (SELECT id, name, CASE WHEN id LIKE '%7' THEN 1 ELSE base_fee END AS base_fee FROM p_lots WHERE total_spaces < 500) n ON o.id = n.id")
def _(c):
    new = c.lots.filter("total_spaces < 500").withColumn("base_fee", F.when(F.col("id").endswith("7"), 1).otherwise(F.col("base_fee")))
    return merge.difference(c.lots.filter("total_spaces > 50"), new, ["id"], ["name", "base_fee"])


@query("media_dedupe", "SELECT parking_lot_id, url, min(id) AS id FROM p_media GROUP BY 1, 2")
def _(c):
    return merge.keep_first(c.media.select("parking_lot_id", "url", "id"), ["parking_lot_id", "url"], ["id"])


@query("reviews_rekeyed", "SELECT parking_lot_id, count(*) AS n FROM (SELECT CASE WHEN parking_lot_id LIKE 'KA-%' THEN replace(parking_lot_id, 'KA-', 'K2-') ELSE parking_lot_id END AS parking_lot_id FROM p_reviews) GROUP BY 1")
def _(c):
    mapping = c.lots.filter("id LIKE 'KA-%'").select(F.col("id").alias("duplicate"), F.replace("id", F.lit("KA-"), F.lit("K2-")).alias("keeper"))
    return merge.rekeyed(c.reviews, mapping, "parking_lot_id").groupBy("parking_lot_id").agg(F.count("*").alias("n"))


# admin and audits


@query("admin_source_stats", "SELECT source, CAST(sum(CASE WHEN filter_passed_v2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS passed, CAST(sum(CASE WHEN sentiment_score IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unscored, count(*) AS n FROM p_web GROUP BY 1")
def _(c):
    return c.web.groupBy("source").agg(F.count_if(F.col("filter_passed_v2") == 1).alias("passed"), F.count_if(F.col("sentiment_score").isNull()).alias("unscored"), F.count("*").alias("n"))


@query("admin_review_sources", "SELECT coalesce(source_type, 'direct') AS kind, count(*) AS n, round(avg(overall_score), 4) AS score FROM p_reviews GROUP BY 1")
def _(c):
    return c.reviews.groupBy(F.coalesce("source_type", F.lit("direct")).alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("overall_score"), 4).alias("score"))


@query("lots_without_anything", "SELECT id FROM p_lots l WHERE NOT EXISTS (SELECT 1 FROM p_reviews r WHERE r.parking_lot_id = l.id) AND NOT EXISTS (SELECT 1 FROM p_web w WHERE w.parking_lot_id = l.id) AND NOT EXISTS (SELECT 1 FROM p_media m WHERE m.parking_lot_id = l.id)")
def _(c):
    out = c.lots.select("id")
    for t in (c.reviews, c.web, c.media):
        out = out.join(t.select(F.col("parking_lot_id").alias("id")), "id", "left_anti")
    return out


@query("indexable_lots", "SELECT id FROM p_lots l WHERE EXISTS (SELECT 1 FROM p_web w WHERE w.parking_lot_id = l.id AND filter_passed_v2 = 1) OR (CAST(total_spaces > 0 AS INT) + CAST(base_fee IS NOT NULL AS INT) + CAST(weekday_start IS NOT NULL AS INT) + CAST(notes IS NOT NULL AS INT)) >= 3")
def _(c):
    passed = c.web.filter("filter_passed_v2 = 1").select(F.col("parking_lot_id").alias("id")).distinct().withColumn("has_web", F.lit(True))
    signals = sum([F.coalesce(x, F.lit(False)).cast("int") for x in (F.col("total_spaces") > 0, F.col("base_fee").isNotNull(), F.col("weekday_start").isNotNull(), F.col("notes").isNotNull())], F.lit(0))
    return c.lots.join(passed, "id", "left").filter(F.col("has_web") | (signals >= 3)).select("id")


@query("shared_sources", "SELECT id, count(DISTINCT parking_lot_id) AS lots FROM p_web GROUP BY 1 HAVING count(DISTINCT parking_lot_id) > 1")
def _(c):
    return c.web.groupBy("id").agg(F.count_distinct("parking_lot_id").alias("lots")).filter("lots > 1")


@query("sources_per_lot", "SELECT parking_lot_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM p_web GROUP BY 1")
def _(c):
    return c.web.groupBy("parking_lot_id").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))  # a set of two


@query("signals_per_lot", "SELECT l.id, coalesce(n, 0) AS signals, coalesce(best, 0) AS best FROM p_lots l LEFT JOIN (SELECT parking_lot_id, count(*) AS n, max(relevance_score) AS best FROM p_signals GROUP BY 1) s ON s.parking_lot_id = l.id")
def _(c):
    from wayfold.operators.scoring import web_signals

    s = web_signals(c.web, c.ai_matches).groupBy(F.col("parking_lot_id").alias("id")).agg(F.count("*").alias("n"), F.max("relevance_score").alias("b"))
    return c.lots.select("id").join(s, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("signals"), F.coalesce("b", F.lit(0)).alias("best"))


@query("score_histogram", "SELECT CASE WHEN final_score IS NULL THEN 'null' WHEN final_score < 2 THEN '<2' WHEN final_score < 2.5 THEN '2-2.5' WHEN final_score < 3 THEN '2.5-3' WHEN final_score < 3.5 THEN '3-3.5' ELSE '>=3.5' END AS bucket, count(*) AS n FROM p_stats GROUP BY 1")
def _(c):
    return evaluation.histogram(c.stats, F.col("final_score"), [2, 2.5, 3, 3.5])


@query("reliability_counts", "SELECT reliability, count(*) AS n FROM p_stats GROUP BY 1")
def _(c):
    return c.stats.groupBy("reliability").agg(F.count("*").alias("n"))


@query("filter_confusion", "SELECT tp, fp, fn, tn, tp/nullif(tp+fp, 0) AS precision, tp/nullif(tp+fn, 0) AS recall, 2e0*tp/nullif(2*tp+fp+fn, 0) AS f1 FROM (SELECT count(*) FILTER (relevance_score >= 60 AND filter_passed_v2 = 1) AS tp, count(*) FILTER (relevance_score >= 60 AND filter_passed_v2 <> 1) AS fp, count(*) FILTER (relevance_score < 60 AND filter_passed_v2 = 1) AS fn, count(*) FILTER (relevance_score < 60 AND filter_passed_v2 <> 1) AS tn FROM p_web)")
def _(c):
    return evaluation.confusion(c.web, F.col("relevance_score") >= 60, F.col("filter_passed_v2") == 1)


@query("score_errors", "SELECT reliability, count(*) AS n, round(avg(abs(final_score - structural_prior)), 6) AS mae, round(sqrt(avg((final_score - structural_prior)*(final_score - structural_prior))), 6) AS rmse, round(avg(final_score - structural_prior), 6) AS bias FROM p_stats GROUP BY 1")
def _(c):
    return evaluation.errors(c.stats, F.col("final_score"), F.col("structural_prior"), [F.col("reliability")])


@query("length_quantiles", "SELECT q, list_extract(v, CAST(floor((len(v)-1)*q) AS BIGINT) + 1) AS value FROM (SELECT list(n_chars ORDER BY n_chars) AS v FROM p_docs), (SELECT unnest([0.1e0, 0.5e0, 0.9e0]) AS q)")
def _(c):
    return evaluation.quantiles(c.docs, "n_chars", [0.1, 0.5, 0.9])


@query("stratified_sample", "SELECT floor(final_score * 2) / 2 AS stratum, parking_lot_id FROM p_stats QUALIFY row_number() OVER (PARTITION BY floor(final_score * 2) / 2 ORDER BY md5(parking_lot_id), parking_lot_id) <= 25")
def _(c):
    return evaluation.stratified(c.stats, F.floor(F.col("final_score") * 2) / 2, "parking_lot_id", 25).select("stratum", "parking_lot_id")


@query("lot_chunks", "SELECT chunk, count(*) AS n, min(id) AS first FROM (SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / ceil((SELECT count(*) FROM p_lots)/7e0)) AS BIGINT) AS chunk FROM p_lots) GROUP BY 1")
def _(c):
    return evaluation.chunked(c.lots.select("id"), "id", 7).groupBy("chunk").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("crawl_queue", "SELECT l.id FROM p_lots l LEFT JOIN p_progress p ON p.crawler_id = 'naver_blogs_lot:' || l.id LEFT JOIN p_stats s ON s.parking_lot_id = l.id WHERE p.last_run_at IS NULL OR epoch_us(TIMESTAMP '2024-01-05 00:00:00') - epoch_us(p.last_run_at) > 30*86400000000 ORDER BY CASE s.reliability WHEN 'none' THEN 0 WHEN 'structural' THEN 1 WHEN 'reference' THEN 2 WHEN 'estimated' THEN 3 ELSE 4 END, p.last_run_at ASC NULLS FIRST, l.id LIMIT 50")
def _(c):
    rows = rescoring.due(c.lots.select("id"), c.progress, "id", "naver_blogs_lot:", "2024-01-05 00:00:00")
    r = F.col("reliability")
    rank = F.when(r == "none", 0).when(r == "structural", 1).when(r == "reference", 2).when(r == "estimated", 3).otherwise(4)
    return rows.join(c.stats.select(F.col("parking_lot_id").alias("id"), "reliability"), "id", "left").orderBy(rank, F.asc_nulls_first("last_run_at"), "id").limit(50).select("id")


@query("table_fingerprint", "SELECT count(*) || '-' || coalesce(strftime(max(created_at), '%Y-%m-%d %H:%M:%S'), '') AS fingerprint FROM p_reviews")
def _(c):
    return files.fingerprint(c.reviews, "created_at")


@query("sitemap_difference", "SELECT id, 'missing' AS side FROM p_lots WHERE total_spaces <= 100 UNION ALL SELECT id, 'extra' FROM p_lots WHERE total_spaces >= 500")
def _(c):
    expected, found = c.lots.filter("total_spaces < 500").select("id"), c.lots.filter("total_spaces > 100").select("id")
    return expected.join(found, "id", "left_anti").withColumn("side", F.lit("missing")).unionByName(found.join(expected, "id", "left_anti").withColumn("side", F.lit("extra")))


@query("tagged_counts", "SELECT 'reviews' AS kind, count(*) AS n FROM p_reviews UNION ALL SELECT 'web', count(*) FROM p_web UNION ALL SELECT 'media', count(*) FROM p_media")
def _(c):
    one = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return one(c.reviews, "reviews").unionByName(one(c.web, "web")).unionByName(one(c.media, "media"))


# streams


@query("stream_rescoring", "SELECT * FROM p_stats WHERE parking_lot_id IN (SELECT lot_id FROM p_messages)")
def _(c):
    spark = c.spark
    events = spark.readStream.schema(c.events.schema).option("pathGlobFilter", "events.parquet").parquet(c.sf_dir)
    kinds = F.when(F.col("event_type") == "signup", "review_created").otherwise("review_deleted")
    messages = events.filter(F.col("event_type").isin("signup", "purchase")).select(F.concat(F.lit("KA-"), ((F.col("user_id") * 3) % 1500).cast("string")).alias("lot_id"), kinds.alias("reason"))
    out = shared_path(spark, "scores")
    rescoring.rescore_stream(messages, lambda lots: recompute(c.lots, c.reviews, c.web, c.ai_matches, NOW, only=lots), out, shared_path(spark, "checkpoint"))
    return rescoring.latest(spark.read.option("basePath", out).parquet(f"{out}/batch=*")).drop("batch")


@query("easy_and_hard_places", "SELECT id, CASE WHEN final_score >= 4 THEN 'easy' WHEN final_score >= 3.3 THEN 'decent' WHEN final_score >= 2.7 THEN 'normal' WHEN final_score >= 2 THEN 'bad' WHEN final_score >= 1.5 THEN 'very_bad' WHEN final_score IS NULL THEN 'unknown' ELSE 'hell' END AS label FROM p_lots JOIN p_stats ON parking_lot_id = id")
def _(c):
    return places.with_scores(c.lots, c.stats).select("id", C.difficulty_label(F.col("avg_score")).alias("label"))


@query("best_web_row", "SELECT parking_lot_id, id, relevance_score FROM p_web QUALIFY row_number() OVER (PARTITION BY parking_lot_id ORDER BY relevance_score DESC, id DESC, published_at DESC) = 1")
def _(c):
    return rankings.best_per_group(c.web, ["parking_lot_id"], F.struct("relevance_score", "id", "published_at")).select("parking_lot_id", "id", "relevance_score")
