"""Queries of the jobs that place texts: the cascade with its second way, decisions and links of the match job."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import vocab
from wayfold.operators import cascade, match_jobs
from wayfold.plans.match_queries import CONTENT, KEYWORDS, ONCE, OWN_ADDRESS, OWN_NAME, SCORED, SIGHT, TITLE, TOWN
from wayfold.plans.page_queries import MEANING, METRES
from wayfold.plans.registry import query
from wayfold.sources.shared import shared_path, stored
from wayfold.sources.views import NOW

_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_in = lambda words, text: f"len(list_filter({words}, lambda w: contains({text}, w))) > 0"
TIGHT = "regexp_replace({}, '\\s+', '', 'g')"
PROVINCE = "^(" + "|".join(vocab.PROVINCES) + ")"


def _without(words: list[str], text: str) -> str:
    for w in words:
        text = f"replace({text}, '{w}', '')"
    return text


def confidence_sql(source: str) -> str:
    """source (title, content, name, address, all plain) with keys, points and confidence."""
    one = lambda c, n: f"CASE WHEN length({c}) >= {n} THEN [{c}] ELSE [] END"
    long = lambda pattern: f"CASE WHEN length(tight) >= 4 THEN {one(f"regexp_extract(tight, '{pattern}', 1)", 2)} ELSE [] END"
    keys = f"list_concat({one('whole', 2)}, list_filter(string_split_regex(bare, '\\s+'), lambda w: length(w) >= 2), {one('lower(name)', 3)}, {one("regexp_extract(whole, '^(.+?[동읍면리구])', 1)", 2)}, {long('^(.+?)(공영|민영|유료|무료|노상|노외)$')}, {long('^(.+?(?:' + '|'.join(vocab.FACILITIES) + '))')}, {long('^([a-z]+)')})"
    rest = _without(vocab.GENERIC_WORDS, "trim(regexp_replace(bare, '주차$', ''))")
    return f"""SELECT *, CASE WHEN points < 40 THEN 'none' WHEN length(best) >= 6 AND topic AND specific AND NOT (regexp_matches(best, '^.+(로|길|번길)$') AND NOT contains(best, '주차')) AND NOT regexp_matches(best, '^({"|".join(vocab.COMMON_FACILITIES)})$')
  AND NOT (regexp_matches(name, '[주변옆앞인근]') AND NOT contains(said, whole)) THEN 'high' ELSE 'medium' END AS confidence
 FROM (SELECT *, CASE WHEN NOT topic OR regexp_matches(said, '{"|".join(vocab.NOISE)}') THEN 0 ELSE least(100, CASE WHEN matched AND NOT in_region AND prov <> '' AND NOT contains(said, prov) THEN greatest(0, raw - 30) ELSE raw END) END AS points
 FROM (SELECT *, CASE WHEN matched THEN total ELSE least(total, 40) END AS raw
 FROM (SELECT *, CASE WHEN in_region THEN 20 ELSE 0 END + CASE WHEN matched AND in_title THEN 40 ELSE 0 END + CASE WHEN matched AND in_body THEN 20 ELSE 0 END + CASE WHEN contains(said, '주차') THEN 20 ELSE 0 END AS total
 FROM (SELECT *, (in_title OR in_body) AND (specific OR in_region OR town <> '' AND contains(said, town)) AS matched
 FROM (SELECT *, {_in("regions", "t")} OR {_in("regions", "b")} AS in_region, {_in("keys", "t")} AS in_title, {_in("keys", "b")} AS in_body, contains(said, '주차') OR contains(said, 'parking') AS topic,
  coalesce(list_transform(list_sort(list_transform(list_filter(keys, lambda w: contains(said, w)), lambda w, i: {{'n': -length(w), 'i': i, 'w': w}})), lambda q: q.w)[1], '') AS best
 FROM (SELECT *, list_filter({ONCE.format("all_keys")}, lambda w: NOT list_contains({_list(vocab.GENERIC_WORDS)}, w)) AS keys, length(trim(array_to_string(list_filter(string_split_regex(rest, '\\s+'), lambda w: NOT regexp_matches(w, '[시군구동읍면리]$')), ''))) >= 2 AS specific,
  list_filter(string_split_regex(lower(array_to_string(parts[1:2], ' ')), '\\s+'), lambda w: length(w) >= 2) AS regions, CASE WHEN regexp_matches(city, '특별|광역') THEN '' ELSE city END AS town
 FROM (SELECT *, {keys} AS all_keys, {rest} AS rest, regexp_extract(address, '{PROVINCE}', 1) AS prov, regexp_extract(address, '\\s(\\S+?)(시|군)\\s', 1) AS city,
  list_filter(string_split_regex(address, '\\s+'), lambda p: NOT regexp_matches(p, '{PROVINCE}') AND NOT suffix(p, '시') AND regexp_matches(p, '(구|군|동|읍|면|로|길)$')) AS parts
 FROM (SELECT *, trim(bare) AS whole, {TIGHT.format("trim(bare)")} AS tight
 FROM (SELECT *, lower(title) AS t, lower(content) AS b, lower(title) || ' ' || lower(content) AS said, regexp_replace(lower(name), '{vocab.NAME_SUFFIX}', '') AS bare FROM ({source}))))))))))"""


LONG_TEXT = "CASE id % 3 WHEN 0 THEN repeat(content || ' ' || title || ' ', 12) ELSE content END"
OWN = f"own_lots AS (SELECT id, {OWN_NAME} AS name, {OWN_ADDRESS} AS address FROM p_lots)"
NAMED = f"""{OWN}, cascade AS (SELECT id AS text_id, lot, points AS score, row_number() OVER (PARTITION BY id ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, points DESC, place) AS nth FROM (SELECT *, keys[1] AS k, {TIGHT.format("lower(title || ' ' || text)")} AS close, lower(title || ' ' || text) AS open,
  list_filter(keys, lambda w: length(w) >= 3) AS longer, list_filter(string_split_regex(coalesce(keys[1], ''), '\\s+'), lambda w: length(w) >= 2) AS parts_of FROM ({confidence_sql(f"SELECT p.id, p.lot, p.place, q.title, q.content, q.text, l.name, l.address FROM placed p JOIN (SELECT *, {LONG_TEXT} AS text FROM ({KEYWORDS})) q ON q.id = p.id JOIN own_lots l ON l.id = p.lot WHERE p.place <= 5 AND (p.whole OR (len(p.core) > 0 AND (p.hits = len(p.core) OR p.hits >= 2)) OR len(list_filter(p.words, lambda k: contains(p.tight, k))) >= 2 OR len(list_filter(p.words, lambda k: contains(p.tight, k) AND length(k) >= 4)) > 0)")}))
 WHERE (length(text) <= 200 OR coalesce(length(k) >= 3 AND (contains(open, k) OR length({TIGHT.format("k")}) >= 4 AND contains(close, {TIGHT.format("k")}) OR len(parts_of) >= 2 AND (length(array_to_string(list_reverse(parts_of), '')) >= 4 AND contains(close, array_to_string(list_reverse(parts_of), '')) OR len(list_filter(parts_of, lambda w: NOT contains(close, w))) = 0)), false)
  OR len(list_filter(longer, lambda w: contains(open, w) OR contains(close, {TIGHT.format("w")}))) >= least(2, len(longer)))
 AND (WITH own AS (SELECT list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(lower(name), '주차장\\s*\\d*', ' ', 'g'), '주차\\s*\\d*', ' ', 'g'), '\\s+'), lambda w: regexp_replace(regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g'), '\\d+$', '')), lambda w: length(w) >= 2 AND NOT list_contains({_list(vocab.NAME_GENERIC)}, w)) AS c)
  SELECT CASE WHEN len(list_filter(c, lambda w: length(w) >= 4)) > 0 THEN len(list_filter(c, lambda w: length(w) >= 4 AND contains(close, w))) > 0 ELSE length(array_to_string(c, '')) >= 4 AND contains(close, array_to_string(c, '')) END FROM own))"""


def asks(c):
    return c.supplier.select(F.col("s_suppkey").alias("text_id"), F.col("s_suppkey").alias("id"), F.expr(TITLE).alias("title"), F.expr(CONTENT).alias("content")).withColumn("text", F.expr(LONG_TEXT))


def places(c):
    return c.lots.select("id", F.expr(OWN_NAME).alias("name"), F.expr(OWN_ADDRESS).alias("address"), "lat", "lng")


@query("best_place_of_texts", f"WITH {SCORED}, {NAMED} SELECT text_id, lot, score FROM cascade WHERE nth = 1")
def _(c):
    return cascade.best_places(asks(c).drop("id"), "text_id", "title", "content", "text", places(c)).select("text_id", "lot", "score")


NAME_KIND = f"""CASE WHEN n = '' OR length(n) > 40 THEN 'unknown' WHEN regexp_matches(n, '{vocab.MISSED_PAGES}') THEN 'page_or_service' WHEN list_contains({_list(vocab.MISSED_GENERIC)}, n) THEN 'generic_term'
 WHEN regexp_matches(n, '{vocab.PARKING_NAME}') THEN 'parking' WHEN regexp_matches(n, '{vocab.MISSED_ORGANIZATIONS}') THEN 'organization_name' WHEN regexp_matches(n, '(^|\\s)\\S+{vocab.ADMIN_TAIL}') THEN 'region_name' WHEN {MEANING} = 0 THEN 'generic_term' ELSE 'facility_name' END"""
FOUND_NAME, FOUND_ADDRESS = f"concat({SIGHT}, ' 주차장')".replace("{}", "id"), f"concat(address, ' ', {TOWN}, '군')".replace("{}", "id")
FOUND = f"found AS (SELECT id, id AS text_id, {FOUND_NAME} AS name, category, {FOUND_ADDRESS} AS address, lat, lng FROM p_results)"


@query("placed_texts", f"""WITH {SCORED}, {NAMED}, {FOUND},
 said AS (SELECT id AS text_id, title, content, array_to_string(words, ' ') AS name FROM ({KEYWORDS})),
 rest AS (SELECT *, trim(name) AS n FROM said WHERE text_id NOT IN (SELECT text_id FROM cascade)),
 loud AS (SELECT *, {NAME_KIND} IN ('generic_term', 'region_name', 'page_or_service', 'unknown') AS noise FROM rest),
 parking AS (SELECT f.* FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY id) AS nth FROM found) f WHERE nth <= 5),
 near AS (SELECT r.id, min(struct_pack(m := {METRES}, l := l.id)) AS x FROM parking r JOIN p_lots l ON abs(r.lat-l.lat) <= 0.003e0 AND abs(r.lng-l.lng) <= 0.003e0 GROUP BY 1),
 spots AS (SELECT p.text_id, bool_and(coalesce(x.m <= 60, false)) AS known, min(struct_pack(m := x.m, i := p.id, l := x.l, nm := p.name, ad := p.address)) AS x FROM parking p LEFT JOIN near USING (id) GROUP BY 1),
 back AS (SELECT o.text_id, m.x.l AS lot FROM loud o JOIN spots m USING (text_id) WHERE NOT noise AND known AND (len(list_filter(regexp_extract_all(title || ' ' || content, '([가-힣]{{2,}}(?:구|군|동|읍|면|리|로|길))'), lambda h: contains(m.x.ad, h))) > 0
  OR len(list_filter(string_split_regex(regexp_replace(n, '{vocab.PARKING_KIND}', ' ', 'g'), '\\s+'), lambda w: length(w) >= 2 AND contains(m.x.nm, w))) > 0)),
 worth AS (SELECT text_id, lot, points FROM ({confidence_sql(f"SELECT b.text_id, b.lot, s.title, s.content, l.name, l.address FROM back b JOIN said s USING (text_id) JOIN own_lots l ON l.id = b.lot")}))
 SELECT text_id, CASE WHEN k.lot IS NOT NULL THEN 'name' WHEN noise THEN 'noise' WHEN w.lot IS NOT NULL THEN 'coordinates' ELSE 'missed' END AS stage, coalesce(k.lot, w.lot) AS lot, coalesce(k.score, w.points) AS score, s.name
 FROM said s LEFT JOIN (SELECT * FROM cascade WHERE nth = 1) k USING (text_id) LEFT JOIN loud o USING (text_id) LEFT JOIN worth w USING (text_id)""")
def _(c):
    results = c.results.select("id", F.col("id").alias("text_id"), F.expr(FOUND_NAME).alias("name"), "category", F.expr(FOUND_ADDRESS).alias("address"), "lat", "lng")
    return match_jobs.placed_texts(asks(c).drop("id"), "text_id", "title", "content", "text", places(c), results, box=None)


STOPPED = ["주차장", "주차", "후기", "정보"]
SEARCH = f"""SELECT id, title, content, tier, {ONCE.format("kw")}[1:5] AS words FROM (SELECT *, list_filter(string_split_regex(lower(regexp_replace(left(title || ' ' || content, 500), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g')), '\\s+'), lambda w: length(w) BETWEEN 2 AND 15 AND NOT regexp_matches(w, '^\\d+$') AND NOT list_contains({_list(STOPPED)}, w)) AS kw
 FROM (SELECT s_suppkey AS id, {TITLE} AS title, {CONTENT} AS content, CASE WHEN s_suppkey % 3 = 0 THEN 'high' ELSE 'medium' END AS tier FROM supplier))"""
DECIDED = f"""asked AS ({SEARCH}), named AS (SELECT id AS lot, {OWN_NAME} AS name, {OWN_ADDRESS} AS address FROM p_lots),
 tokens AS (SELECT lot, list_distinct(list_filter(string_split_regex(lower(name || ' ' || address), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 2)) AS own FROM named),
 hits AS (SELECT id, lot, row_number() OVER (PARTITION BY id ORDER BY hits DESC, lot) AS nth FROM (SELECT id, lot, len(list_filter(words, lambda k: len(list_filter(own, lambda w: starts_with(w, k))) > 0)) AS hits FROM asked, tokens) WHERE hits > 0),
 first AS (SELECT * FROM hits WHERE nth <= 20),
 few AS (SELECT id, words FROM asked WHERE (SELECT count(*) FROM first f WHERE f.id = asked.id) < 3),
 more AS (SELECT id, lot, min(pos) AS pos FROM (SELECT id, lot, list_position(words[1:3], k) AS pos FROM (SELECT id, words, unnest(words[1:3]) AS k FROM few) JOIN named ON contains(lower(name), k)) WHERE (id, lot) NOT IN (SELECT id, lot FROM first) GROUP BY id, lot),
 found AS (SELECT id, lot FROM (SELECT id, lot, row_number() OVER (PARTITION BY id ORDER BY pos, nth, lot) AS rank FROM (SELECT id, lot, 0 AS pos, nth FROM first UNION ALL SELECT id, lot, pos, 0 FROM more)) WHERE rank <= 20),
 decided AS (SELECT id, lot, points AS score, confidence, CASE WHEN confidence = 'high' AND tier = 'high' THEN 'rule' WHEN (id * 31 + length(lot)) % 4 = 0 THEN 'model' WHEN (id * 31 + length(lot)) % 4 = 1 THEN 'rejected' ELSE 'open' END AS decision
  FROM ({confidence_sql("SELECT f.id, f.lot, a.title, a.content, a.tier, n.name, n.address FROM found f JOIN asked a USING (id) JOIN named n USING (lot)")}) WHERE confidence <> 'none')"""


def raw(c):
    row = c.supplier.select(F.col("s_suppkey").alias("id"), F.expr(TITLE).alias("title"), F.expr(CONTENT).alias("content"), F.when(F.col("s_suppkey") % 3 == 0, "high").otherwise("medium").alias("filter_tier"))
    return row.select("id", F.lit("naver_blog").alias("source"), F.col("id").cast("string").alias("source_id"), F.lit("u").alias("source_url"), "title", "content", F.lit("w").alias("author"), F.lit("2001-01-01").alias("published_at"), F.lit(2.5).alias("sentiment_score"), F.lit("[]").alias("keywords"), F.lit(1).alias("filter_passed"), "filter_tier")


def verdicts(c):
    """As of a model: one for every second pair of text and place that it might be asked for."""
    pairs = match_jobs.decided_pairs(raw(c), places(c), c.spark.createDataFrame([], "id long, lot string, filter_passed boolean"), STOPPED).select("id", "lot", (F.expr("(id * 31 + length(lot)) % 4")).alias("k"))
    return pairs.filter("k < 2").select("id", "lot", (F.col("k") == 0).alias("filter_passed"), F.lit(4.5).alias("sentiment_score"), F.lit('["좁음"]').alias("keywords"))


@query("match_decisions", f"WITH {DECIDED} SELECT id, lot, score, confidence, decision FROM decided")
def _(c):
    return match_jobs.decided_pairs(raw(c), places(c), verdicts(c), STOPPED)


@query("match_job_links", f"WITH {DECIDED} SELECT lot AS parking_lot_id, id AS raw_source_id, id || ':' || lot AS source_id, score AS relevance_score, CASE decision WHEN 'model' THEN 4.5e0 ELSE 2.5e0 END AS sentiment_score FROM decided WHERE decision IN ('rule', 'model')")
def _(c):
    """Two runs of the job: the second finds only texts with open pairs, and adds no link twice."""
    out, given = shared_path(c.spark, "match-job"), stored(verdicts(c), "verdicts")
    for batch in range(2):
        match_jobs.run_match_job(raw(c), places(c), given, out, batch, STOPPED, NOW)
    return match_jobs.stored_links(c.spark, out).select("parking_lot_id", "raw_source_id", "source_id", "relevance_score", "sentiment_score")
