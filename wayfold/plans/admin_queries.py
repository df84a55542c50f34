"""Queries of the administration: reports, limits, queues, addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import addresses
from wayfold.operators import moderation
from wayfold.plans.registry import query


@query("report_list", "SELECT r.id, r.target_type, CASE target_type WHEN 'review' THEN v.parking_lot_id WHEN 'web_source' THEN w.source ELSE m.url END AS title FROM p_reports r LEFT JOIN p_reviews v ON target_type = 'review' AND v.id = target_id LEFT JOIN p_web w ON target_type = 'web_source' AND w.id = target_id LEFT JOIN p_media m ON target_type = 'media' AND m.id = target_id")
def _(c):
    targets = {"review": (c.reviews, F.col("parking_lot_id")), "web_source": (c.web, F.col("source")), "media": (c.media, F.col("url"))}
    return moderation.with_targets(c.reports, targets).select("id", "target_type", "title")


@query("reports_once", "SELECT id, target_type, target_id, visitor FROM (SELECT id, target_type, target_id, sha256(ip) AS visitor, row_number() OVER (PARTITION BY target_type, target_id, ip ORDER BY created_at, id) AS n FROM p_reports) WHERE n = 1")
def _(c):
    rows = c.reports.withColumn("visitor", addresses.visitor(F.col("ip")))
    return moderation.once(rows, ["target_type", "target_id", "visitor"], ["created_at", "id"]).select("id", "target_type", "target_id", "visitor")


@query("reviews_after_reports", "SELECT id FROM p_reviews WHERE id NOT IN (SELECT target_id FROM p_reports WHERE target_type = 'review' AND status = 'resolved')")
def _(c):
    return moderation.without_resolved(c.reviews.select("id"), "review", c.reports)


@query("report_stats", "SELECT target_type, count(*) AS n, count(*) FILTER (status = 'open') AS open FROM p_reports GROUP BY target_type")
def _(c):
    return c.reports.groupBy("target_type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "open").alias("open"))


@query("votes_within_limit", "SELECT seq FROM p_votes n WHERE vote_type = 'down' AND NOT EXISTS (SELECT 1 FROM p_votes o WHERE o.vote_type = 'up' AND o.user_id = n.user_id AND o.parking_lot_id = n.parking_lot_id AND o.created_at > n.created_at - INTERVAL 24 HOURS AND o.created_at <= n.created_at)")
def _(c):
    new, old = c.votes.filter("vote_type = 'down'"), c.votes.filter("vote_type = 'up'")
    return moderation.within_limit(new, old, ["user_id", "parking_lot_id"], "created_at").select("seq")


@query("valid_reviews", "SELECT id FROM p_reviews WHERE overall_score + id % 3 / 4e0 BETWEEN 0.5 AND 5 AND (overall_score + id % 3 / 4e0) * 2 = floor((overall_score + id % 3 / 4e0) * 2)")
def _(c):
    return c.reviews.filter(moderation.half_steps(F.col("overall_score") + F.col("id") % 3 / F.lit(4.0))).select("id")


@query("reviews_kept_by_owner", "SELECT id, source_type FROM p_reviews WHERE NOT (id % 4 = 0 AND coalesce(source_type, '') = 'clien')")
def _(c):
    asked = c.reviews.filter("id % 4 = 0").select("id", F.lit("clien").alias("source_type"))
    return moderation.owned(c.reviews.select("id", "source_type"), asked, "source_type")


@query("signals_with_lots", "SELECT w.id, coalesce(string_agg(DISTINCT m.parking_lot_id, ',' ORDER BY m.parking_lot_id), '') AS lots FROM p_web w LEFT JOIN p_ai_matches m ON m.web_source_id = w.id GROUP BY w.id")
def _(c):
    return moderation.with_lots(c.web.select("id").distinct(), c.ai_matches).select("id", F.array_join("lots", ",").alias("lots"))


@query("lots_with_sure_matches", "SELECT DISTINCT l.id, l.name FROM p_lots l JOIN p_ai_matches m ON m.parking_lot_id = l.id WHERE m.confidence = 'high'")
def _(c):
    sure = c.ai_matches.filter("confidence = 'high'").select(F.col("parking_lot_id").alias("id"))
    return c.lots.select("id", "name").join(sure, "id", "left_semi")


@query("video_queue", """SELECT id, min(priority) AS priority FROM (
 SELECT id, 1 AS priority FROM p_lots WHERE coalesce(curation_tag, '') = 'easy' UNION ALL
 SELECT l.id, 2 FROM p_lots l JOIN p_stats s ON s.parking_lot_id = l.id WHERE s.review_count > 0 AND coalesce(curation_tag, '') <> 'easy' UNION ALL
 SELECT l.id, 3 FROM p_lots l JOIN p_stats s ON s.parking_lot_id = l.id WHERE s.web_count >= 3 AND s.review_count = 0 AND coalesce(curation_tag, '') <> 'easy' UNION ALL
 SELECT id, 4 FROM p_lots WHERE total_spaces >= 100 AND coalesce(curation_tag, '') <> 'easy' AND id NOT IN (SELECT parking_lot_id FROM p_stats WHERE web_count >= 3))
 WHERE id NOT IN (SELECT parking_lot_id FROM p_media) GROUP BY id""")
def _(c):
    return moderation.video_queue(c.lots, c.stats, c.media, F.col("curation_tag") == "easy").select("id", "priority")


@query("large_lot_queue", "SELECT id FROM p_lots WHERE curation_tag = 'easy' OR total_spaces >= 200 ORDER BY curation_tag = 'easy' DESC NULLS LAST, total_spaces DESC, id LIMIT 50")
def _(c):
    easy = F.col("curation_tag") == "easy"
    return c.lots.filter(easy | (F.col("total_spaces") >= 200)).orderBy(easy.desc_nulls_last(), F.desc("total_spaces"), "id").limit(50).select("id")


@query("last_changes", "SELECT parking_lot_id, CAST(max(greatest(published_at, TIMESTAMP '1996-01-01')) AS TIMESTAMP) AS changed FROM p_web GROUP BY 1")
def _(c):
    rows = c.web.select("parking_lot_id", F.col("published_at").cast("timestamp").alias("published_at"), F.lit("1996-01-01").cast("timestamp").alias("seen_at"))
    return moderation.last_changes(rows, "parking_lot_id", "published_at", "seen_at")


@query("lots_of_few_matches", "SELECT parking_lot_id, count(*) AS n FROM p_ai_matches GROUP BY 1 HAVING count(*) <= 64")
def _(c):
    return moderation.shared_by_few(c.ai_matches, "parking_lot_id", 64)


@query("pending_texts", "SELECT id FROM p_docs WHERE full_text_status = 'ok' AND source <> 'web' AND id % 3 = 0")
def _(c):
    docs = c.docs.withColumn("filtered_at", F.when(F.col("id") % 3 != 0, F.current_timestamp()))
    return docs.filter(F.col("filtered_at").isNull() & (F.col("full_text_status") == "ok") & (F.col("source") != "web")).select("id")


LONG = "CASE total_spaces % 4 WHEN 0 THEN ' 서울특별시' WHEN 1 THEN '경기도' WHEN 2 THEN '강원특별자치도' ELSE '제주특별자치도' END || ' ' || name || ' 16 (' || type || ') '"
SHORT = "regexp_replace(replace(replace(replace(replace({x}, '서울특별시', '서울'), '경기도', '경기'), '강원특별자치도', '강원'), '제주특별자치도', '제주'), '\\s*\\([^)]*\\)\\s*|\\s+', '', 'g')"


@query("addresses_compared", f"SELECT id, {SHORT.replace('{x}', LONG)} AS address, CASE total_spaces % 4 WHEN 0 THEN '서울' WHEN 1 THEN '경기' WHEN 3 THEN '제주' END AS region FROM p_lots")
def _(c):
    rows = c.lots.select("id", F.expr(LONG).alias("long"))
    return rows.select("id", addresses.normalized(F.col("long")).alias("address"), addresses.region_of(F.col("long")).alias("region"))


@query("mobile_links", "SELECT id, CASE WHEN id % 2 = 0 THEN 'https://m.blog.naver.com/a/' ELSE 'https://blog.naver.com/a/' END || id AS url, 'https://img.youtube.com/vi/' || lpad(CAST(id AS STRING), 11, 'v') || '/mqdefault.jpg' AS thumbnail FROM p_docs")
def _(c):
    link = F.concat(F.lit("https://blog.naver.com/a/"), F.col("id").cast("string"))
    video = F.concat(F.lit("https://www.youtube.com/watch?t=1&v="), F.lpad(F.col("id").cast("string"), 11, "v"))
    source = F.when(F.col("id") % 2 == 0, "naver_blog").otherwise("ddg_search")
    return c.docs.select("id", addresses.mobile_url(link, source).alias("url"), addresses.thumbnail(addresses.video_id(video)).alias("thumbnail"))


@query("same_day_votes", "SELECT seq FROM p_votes WHERE CAST(created_at AS DATE) = DATE '2024-01-05'")
def _(c):
    return c.votes.filter(addresses.same_day(F.col("created_at"), F.lit("2024-01-05 12:00:00").cast("timestamp"))).select("seq")
