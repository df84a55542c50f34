"""Queries over places: viewport, search, neighbours, rankings, pages, guides."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions import columns as C
from wayfold.functions.vocab import SUMMARY_REGIONS
from wayfold.operators import places, rankings, spatial
from wayfold.operators.scoring import recompute
from wayfold.plans.registry import query
from wayfold.sources.views import NOW

SCORED = "SELECT l.*, s.final_score AS avg_score, coalesce(s.review_count, 0) AS review_count, s.reliability FROM p_lots l LEFT JOIN p_stats s ON s.parking_lot_id = l.id"
BOX = (34.0, 37.0, 125.0, 130.0)
IN_BOX = "lat BETWEEN 34 AND 37 AND lng BETWEEN 125 AND 130"


@query("score_recompute", "SELECT * FROM p_stats")
def _(c):
    return recompute(c.lots, c.reviews, c.web, c.ai_matches, NOW)


@query("score_recompute_changed", "SELECT * FROM p_stats WHERE parking_lot_id IN (SELECT parking_lot_id FROM p_web WHERE published_at >= TIMESTAMP '1998-06-01')")
def _(c):
    changed = c.web.filter(F.col("published_at") >= F.lit("1998-06-01").cast("timestamp_ntz")).select("parking_lot_id")
    return recompute(c.lots, c.reviews, c.web, c.ai_matches, NOW, only=changed)


@query("lots_in_bounds", f"SELECT * FROM ({SCORED}) WHERE {IN_BOX} ORDER BY id LIMIT 200")
def _(c):
    return places.lots_in_bounds(c.lots, c.stats, BOX)


@query("lots_filtered", f"""SELECT * FROM ({SCORED}) WHERE {IN_BOX} AND id NOT LIKE 'KA-%' AND id NOT LIKE 'NV-%' AND type <> '노상' AND total_spaces >= 50
 AND (avg_score >= 4.0 OR (avg_score >= 2.7 AND avg_score < 3.3)) AND (is_free = 1 OR base_fee IS NULL OR base_fee = 0 OR (base_time > 0 AND CAST(trunc(base_fee*60e0/base_time) AS INT) <= 6000)) ORDER BY id LIMIT 200""")
def _(c):
    conditions = [places.is_public(F.col("id")), F.col("type") != "노상", F.col("total_spaces") >= 50, places.difficulty(F.col("avg_score"), [True, False, True, False, False, False]), places.fee_at_most(6000)]
    return places.lots_in_bounds(c.lots, c.stats, BOX, conditions=conditions)


@query("lots_open_now", f"SELECT id FROM p_lots WHERE {IN_BOX} AND weekday_start <> '' AND (weekday_end = '00:00' OR (weekday_start <= weekday_end AND weekday_start <= '19:30' AND weekday_end > '19:30') OR (weekday_start > weekday_end AND (weekday_start <= '19:30' OR weekday_end > '19:30')))")
def _(c):
    return c.lots.filter(places.in_bounds(*BOX) & places.open_at(F.lit("2002-01-03 10:30:00"))).select("id")


@query("difficulty_none", "SELECT parking_lot_id FROM p_stats WHERE 1 = 0")
def _(c):
    return c.stats.filter(places.difficulty(F.col("final_score"), [False] * 6)).select("parking_lot_id")


@query("difficulty_of_points", "SELECT parking_lot_id, final_score FROM p_stats WHERE final_score IS NULL OR final_score < 1.5 OR (final_score >= 3.3 AND final_score < 4)")
def _(c):
    return c.stats.filter(places.difficulty_of_points(F.col("final_score"), [False, True, False, False, False, True])).select("parking_lot_id", "final_score")


@query("all_points", "SELECT l.id, lat, lng, type, s.final_score AS score FROM p_lots l LEFT JOIN p_stats s ON s.parking_lot_id = l.id")
def _(c):
    return places.with_scores(c.lots, c.stats).select("id", "lat", "lng", "type", F.col("avg_score").alias("score"))


@query("search_lots", f"SELECT * FROM ({SCORED}) WHERE (lower(name) LIKE '%customer%' OR lower(address) LIKE '%customer%') AND (lower(name) LIKE '%asia%' OR lower(address) LIKE '%asia%') ORDER BY id LIMIT 20")
def _(c):
    return places.search(c.lots, c.stats, "Customer asia")


@query("lot_detail", f"SELECT id, name, type, address, lat, lng, total_spaces, weekday_start, weekday_end, is_free = 1 AS free, coalesce(base_time, 0) AS base_time, coalesce(base_fee, 0) AS base_fee, avg_score, review_count, reliability FROM ({SCORED}) WHERE id = 'NV-1'")
def _(c):
    return places.detail(c.lots, c.stats, "NV-1").select("id", "name", "type", "address", "lat", "lng", "total_spaces", F.col("weekday.start").alias("weekday_start"), F.col("weekday.end").alias("weekday_end"), F.col("pricing.is_free").alias("free"), "pricing.base_time", "pricing.base_fee", F.col("difficulty.score").alias("avg_score"), "difficulty.review_count", "difficulty.reliability")


@query("nearby_lots", "SELECT id, round(abs(lat-35.0) + abs(lng-127.5), 6) AS distance FROM p_lots WHERE lat BETWEEN 34.5 AND 35.5 AND lng BETWEEN 127 AND 128 AND id <> 'KA-3' ORDER BY abs(lat-35.0) + abs(lng-127.5), id LIMIT 5")
def _(c):
    return places.nearby(c.lots, 35.0, 127.5, "KA-3", reach=0.5).select("id", F.round("distance", 6).alias("distance"))


@query("related_lots", f"SELECT id, web_sources, review_count FROM (SELECT x.*, coalesce(n, 0) AS web_sources FROM ({SCORED}) x LEFT JOIN (SELECT parking_lot_id, count(*) AS n FROM p_web GROUP BY 1) w ON w.parking_lot_id = x.id) WHERE lat BETWEEN 34.5 AND 35.5 AND lng BETWEEN 127 AND 128 AND id <> 'KA-3' ORDER BY (lat-35.0)*(lat-35.0) + (lng-127.5)*(lng-127.5), web_sources DESC, review_count DESC, id LIMIT 8")
def _(c):
    return places.related(c.lots, c.stats, c.web, 35.0, 127.5, "KA-3", reach=0.5).select("id", "web_sources", "review_count")


@query("lots_within_metres", "SELECT id, CAST(round(sqrt(pow((lat-35.0)*111000e0, 2) + pow((lng-127.5)*88000e0, 2))) AS BIGINT) AS metres FROM p_lots WHERE lat BETWEEN 35.0-30000e0/111000 AND 35.0+30000e0/111000 AND lng BETWEEN 127.5-30000e0/88000 AND 127.5+30000e0/88000 ORDER BY 2, 1 LIMIT 10")
def _(c):
    return places.within_metres(c.lots, 35.0, 127.5, 30_000).select("id", "metres")


@query("lots_by_distance", "SELECT id, round(2*6371*atan2(sqrt(a), sqrt(1-a)), 3) AS km FROM (SELECT id, pow(sin(radians(lat-35.0)/2), 2) + cos(radians(35.0))*cos(radians(lat))*pow(sin(radians(lng-127.5)/2), 2) AS a FROM p_lots)")
def _(c):
    return c.lots.select("id", F.round(C.haversine_km(F.lit(35.0), F.lit(127.5), F.col("lat"), F.col("lng")), 3).alias("km"))


@query("site_stats", "SELECT (SELECT count(*) FROM p_lots) AS lots, (SELECT count(*) FROM p_reviews) AS reviews, (SELECT count(*) FROM p_web WHERE filter_passed_v2 = 1) + (SELECT count(*) FROM p_media) AS posts")
def _(c):
    return rankings.site_stats(c.lots, c.reviews, c.web, c.media)


@query("tab_counts", "SELECT l.id, (SELECT count(*) FROM p_reviews r WHERE r.parking_lot_id = l.id) AS reviews, (SELECT count(*) FROM p_web w WHERE w.parking_lot_id = l.id AND relevance_score >= 40) AS posts, (SELECT count(*) FROM p_media m WHERE m.parking_lot_id = l.id) AS media FROM p_lots l")
def _(c):
    return rankings.tab_counts(c.lots, c.reviews, c.web, c.media)


@query("blog_posts", "SELECT w.id, relevance_score, published_at, CASE WHEN instr(w.source, 'blog') > 0 THEN 30 ELSE 0 END AS boost FROM p_web w JOIN p_lots l ON l.id = w.parking_lot_id WHERE l.id = 'PB-2' AND relevance_score >= 40 ORDER BY relevance_score + CASE WHEN instr(w.source, 'blog') > 0 THEN 30 ELSE 0 END DESC, published_at DESC NULLS LAST, w.id LIMIT 10 OFFSET 5")
def _(c):
    return rankings.posts(c.web, "PB-2", boost=F.when(F.instr("source", "blog") > 0, 30).otherwise(0), offset=5)


@query("lot_media", "SELECT id, url FROM p_media WHERE parking_lot_id = 'KA-3' ORDER BY created_at DESC, id LIMIT 20")
def _(c):
    return c.media.filter("parking_lot_id = 'KA-3'").orderBy(F.desc("created_at"), "id").limit(20).select("id", "url")


@query("lot_reviews", "SELECT id, overall_score, CASE WHEN source_type IS NOT NULL THEN source_type WHEN is_seed = 1 THEN '익명' ELSE '사용자' END AS author FROM p_reviews WHERE parking_lot_id = 'NV-1' ORDER BY created_at DESC, id LIMIT 20")
def _(c):
    return rankings.reviews_of(c.reviews, "NV-1").select("id", "overall_score", "author")


@query("vote_summary", "SELECT parking_lot_id, coalesce(sum(CASE WHEN vote_type = 'up' THEN 1 ELSE 0 END), 0) AS up, coalesce(sum(CASE WHEN vote_type = 'down' THEN 1 ELSE 0 END), 0) AS down FROM p_votes GROUP BY 1")
def _(c):
    return c.votes.groupBy("parking_lot_id").agg(F.count_if(F.col("vote_type") == "up").alias("up"), F.count_if(F.col("vote_type") == "down").alias("down"))


@query("guide_list", "SELECT r.region, count(*) AS total, CAST(sum(CASE WHEN is_free = 1 THEN 1 ELSE 0 END) AS BIGINT) AS free, CAST(round(avg(CASE WHEN total_spaces > 0 THEN total_spaces END)) AS BIGINT) AS spaces FROM (SELECT unnest(['ASIA','EUROPE','AFRICA','AMERICA','MIDDLE EAST','NOWHERE']) AS region) r JOIN p_lots l ON contains(l.address, r.region) GROUP BY 1")
def _(c):
    return rankings.region_summary(c.lots, ["ASIA", "EUROPE", "AFRICA", "AMERICA", "MIDDLE EAST", "NOWHERE"])


@query("guide_regions", None)
def _(c):
    return rankings.region_summary(c.lots, SUMMARY_REGIONS)


TOP = "SELECT '{0}' AS ranking, row_number() OVER (ORDER BY {1}) AS place, id FROM ({2}) WHERE {3}"


@query("wiki_home", "SELECT * FROM (" + " UNION ALL ".join("(" + TOP.format(n, o, SCORED if n != "recent" else "SELECT l.*, r.last FROM p_lots l JOIN (SELECT parking_lot_id, max(created_at) AS last FROM p_reviews GROUP BY 1) r ON r.parking_lot_id = l.id", w) + ")" for n, o, w in (
    ("spacious", "total_spaces DESC NULLS LAST, id", "total_spaces > 0"), ("easy", "avg_score DESC NULLS LAST, id", "avg_score >= 3.3"), ("free", "total_spaces DESC NULLS LAST, id", "is_free = 1"), ("popular", "review_count DESC, id", "review_count > 0"), ("recent", "last DESC, id", "1 = 1"))) + ") WHERE place <= 8")
def _(c):
    return rankings.home(c.lots, c.stats, c.reviews, 8)


@query("top_per_region", f"SELECT region, place, id FROM (SELECT split_part(address, ' ', 1) AS region, id, row_number() OVER (PARTITION BY split_part(address, ' ', 1) ORDER BY avg_score DESC NULLS LAST, id) AS place FROM ({SCORED})) WHERE place <= 8")
def _(c):
    rows = places.with_scores(c.lots, c.stats).withColumn("region", F.split_part("address", F.lit(" "), F.lit(1)))
    return rankings.top_per_group(rows, ["region"], [F.desc_nulls_last("avg_score"), "id"], 8, "place").select("region", "place", "id")


@query("all_lots_page", "SELECT id, name, (SELECT count(*) FROM p_lots WHERE contains(address, 'EUROPE')) AS total FROM p_lots WHERE contains(address, 'EUROPE') ORDER BY name, id LIMIT 100 OFFSET 100")
def _(c):
    return rankings.page(c.lots.filter(F.contains("address", F.lit("EUROPE"))), ["name", "id"], 2).select("id", "name", "total")


@query("grid_clusters", "SELECT z.zoom, CAST(floor((lng+180)/360*pow(2, z.zoom)*2.56) AS BIGINT) AS x, CAST(floor((1-ln(tan(radians(lat))+1/cos(radians(lat)))/pi())/2*pow(2, z.zoom)*2.56) AS BIGINT) AS y, count(*) AS points, round(sum(coalesce(final_score, 0)), 2) AS sum_score, count(final_score) AS count_score, count(*) FILTER (final_score >= 4) AS easy, count(*) FILTER (final_score < 2) AS hard FROM p_lots l LEFT JOIN p_stats s ON s.parking_lot_id = l.id, (SELECT unnest([0,4,8,11]) AS zoom) z GROUP BY 1, 2, 3")
def _(c):
    return spatial.grid_clusters(places.with_scores(c.lots, c.stats), [0, 4, 8, 11]).select("zoom", "x", "y", "points", "sum_score", "count_score", "easy", "hard")


@query("near_duplicate_places", "SELECT a.id AS a, b.id AS b FROM p_lots a JOIN p_lots b ON split_part(a.address, ' ', 1) = split_part(b.address, ' ', 1) AND abs(a.lat-b.lat) < 0.05 AND abs(a.lng-b.lng) < 0.05 AND a.id LIKE 'KA-%' AND b.id NOT LIKE 'KA-%' AND b.id NOT LIKE 'NV-%'")
def _(c):
    lots = c.lots.withColumn("key", F.split_part("address", F.lit(" "), F.lit(1)))
    return spatial.same_name_nearby(lots.filter(F.col("id").startswith("KA-")), lots.filter(places.is_public(F.col("id"))), "key", 0.05)


@query("proximity_pairs", "SELECT a.id AS a, b.id AS b, round(2*6371000*asin(least(1, sqrt(h))), 1) AS metres FROM (SELECT a.id, b.id AS bid, pow(sin(radians(b.lat-a.lat)/2), 2) + cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lng-a.lng)/2), 2) AS h FROM p_lots a JOIN p_lots b ON a.id LIKE 'KA-%' AND b.id LIKE 'NV-%') x JOIN p_lots a ON a.id = x.id JOIN p_lots b ON b.id = x.bid WHERE 2*6371000*asin(least(1, sqrt(h))) <= 5000")
def _(c):
    return spatial.within(c.lots.filter("id LIKE 'KA-%'"), c.lots.filter("id LIKE 'NV-%'"), 5000).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), F.round("metres", 1).alias("metres"))


@query("nearest_place", "SELECT a, b FROM (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY pow(sin(radians(b.lat-a.lat)/2), 2) + cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lng-a.lng)/2), 2), b.id) AS n FROM p_lots a JOIN p_lots b ON a.id LIKE 'KA-%' AND b.id LIKE 'NV-%' AND abs(a.lat-b.lat) <= 0.2 AND abs(a.lng-b.lng) <= 0.2) WHERE n = 1")
def _(c):
    return spatial.nearest(c.lots.filter("id LIKE 'KA-%'"), c.lots.filter("id LIKE 'NV-%'"), 0.2).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))


@query("score_quartiles", "SELECT quartile, count(*) AS n, min(final_score) AS low, max(final_score) AS high FROM (SELECT final_score, ntile(4) OVER (ORDER BY coalesce(final_score, 0), parking_lot_id) AS quartile FROM p_stats) GROUP BY 1")
def _(c):
    return rankings.quartiles(c.stats).groupBy("quartile").agg(F.count("*").alias("n"), F.min("final_score").alias("low"), F.max("final_score").alias("high"))


@query("web_per_lot_top3", "SELECT parking_lot_id, n, id, relevance_score FROM (SELECT *, row_number() OVER (PARTITION BY parking_lot_id ORDER BY relevance_score DESC, id, published_at) AS n FROM p_web) WHERE n <= 3")
def _(c):
    return rankings.top_per_group(c.web, ["parking_lot_id"], [F.desc("relevance_score"), "id", "published_at"], 3, "n").select("parking_lot_id", "n", "id", "relevance_score")


@query("review_labels", "SELECT parking_lot_id, string_agg('[R' || n || '] ' || CAST(overall_score AS STRING), ' ' ORDER BY n) AS reviews FROM (SELECT *, row_number() OVER (PARTITION BY parking_lot_id ORDER BY created_at DESC, id) AS n FROM p_reviews) WHERE n <= 30 GROUP BY 1")
def _(c):
    rows = rankings.top_per_group(c.reviews, ["parking_lot_id"], [F.desc("created_at"), "id"], 30, "n")
    text = F.concat(F.lit("[R"), F.col("n").cast("string"), F.lit("] "), F.col("overall_score").cast("string"))
    return rows.groupBy("parking_lot_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))), lambda x: x["t"]), " ").alias("reviews"))


@query("source_distribution", "SELECT source, count(*) AS n, count(DISTINCT parking_lot_id) AS lots, count(*) FILTER (relevance_score >= 60) AS relevant, round(avg(sentiment_score), 4) AS sentiment FROM p_web GROUP BY 1")
def _(c):
    return c.web.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("parking_lot_id").alias("lots"), F.count_if(F.col("relevance_score") >= 60).alias("relevant"), F.round(F.avg("sentiment_score"), 4).alias("sentiment"))


@query("diverse_sources", """WITH k AS (SELECT *, row_number() OVER (PARTITION BY parking_lot_id, source ORDER BY relevance_score DESC, id, published_at) AS a FROM p_web),
 f AS (SELECT *, row_number() OVER (PARTITION BY parking_lot_id ORDER BY CASE WHEN a = 1 THEN 0 ELSE 1 END, relevance_score DESC, id, published_at) AS b FROM k),
 g AS (SELECT *, row_number() OVER (PARTITION BY parking_lot_id ORDER BY CASE WHEN a = 1 AND b <= 3 THEN 0 ELSE 1 END, relevance_score DESC, id, published_at) AS c FROM f) SELECT parking_lot_id, id, source, relevance_score FROM g WHERE c <= 6""")
def _(c):
    """Up to six web rows a place: half of them of different sources, the rest by score."""
    return rankings.diverse(c.web, ["parking_lot_id"], "source", [F.desc("relevance_score"), "id", "published_at"], 6).select("parking_lot_id", "id", "source", "relevance_score")


@query("lot_slugs", "SELECT id, replace(replace(trim(name), ' ', '-'), '#', '') || '-' || id AS slug, CASE WHEN regexp_matches(id, '^(KA|NV)-') THEN id END AS parsed FROM p_lots")
def _(c):
    slug = C.slug(F.col("name"), F.col("id"))
    return c.lots.select("id", slug.alias("slug"), C.slug_id(slug).alias("parsed"))


@query("priority_sitemap", "SELECT id FROM (SELECT l.id, coalesce(n, 0) AS web, s.review_count, CASE WHEN s.reliability = 'confirmed' THEN 4 WHEN s.reliability = 'estimated' THEN 3 WHEN s.reliability = 'reference' THEN 2 WHEN s.reliability = 'structural' THEN 1 ELSE 0 END AS rank, l.total_spaces FROM p_lots l JOIN p_stats s ON s.parking_lot_id = l.id LEFT JOIN (SELECT parking_lot_id, count(*) AS n FROM p_web WHERE filter_passed_v2 = 1 GROUP BY 1) w ON w.parking_lot_id = l.id) ORDER BY rank DESC, review_count DESC, web DESC, total_spaces DESC NULLS LAST, id LIMIT 200")
def _(c):
    return rankings.priority(c.lots, c.stats, c.web, 200)


@query("sitemap_pages", "SELECT page, count(*) AS urls, min(id) AS first, max(id) AS last FROM (SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 500) AS BIGINT) AS page FROM p_lots) GROUP BY 1")
def _(c):
    from wayfold.sources.files import numbered_pages

    return numbered_pages(c.lots.select("id"), "id", 500).groupBy("page").agg(F.count("*").alias("urls"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("row_numbers_by_source", "SELECT source, id, n FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY md5(id || ':' || epoch_us(published_at)), id) AS n FROM p_web) WHERE n <= 25")
def _(c):
    w = W.partitionBy("source").orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.unix_micros(F.col("published_at").cast("timestamp")).cast("string"))), "id")
    return c.web.withColumn("n", F.row_number().over(w)).filter("n <= 25").select("source", "id", "n")
