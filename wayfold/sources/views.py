"""Tables: scans, and views that give the driver's tables the shape of a place catalogue.

The views' SQL runs in Spark and, but for the name of one hash, in DuckDB, so oracles can be written over the same views.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from wayfold.sources.cache import ResultCache, files_fingerprint

VIEWS = {
    "p_lots": """SELECT concat(CASE c_custkey % 3 WHEN 0 THEN 'KA-' WHEN 1 THEN 'NV-' ELSE 'PB-' END, CAST(c_custkey AS STRING)) AS id, c_name AS name,
        CASE c_mktsegment WHEN 'BUILDING' THEN '부설' WHEN 'AUTOMOBILE' THEN '노상' ELSE '노외' END AS type, concat(r_name,' ',n_name,' ',c_mktsegment) AS address,
        33 + CAST((c_custkey*37) % 6000 AS DOUBLE)/1000 AS lat, 124 + CAST((c_custkey*53) % 8000 AS DOUBLE)/1000 AS lng, CAST((c_custkey*7) % 600 AS INT) AS total_spaces,
        CAST(c_nationkey % 2 AS INT) AS is_free, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 30 END AS base_time, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST((c_custkey*100) % 5000 AS INT) END AS base_fee,
        CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '09:00' WHEN 2 THEN '20:00' ELSE '00:00' END AS weekday_start,
        CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '18:00' WHEN 2 THEN '06:00' ELSE '00:00' END AS weekday_end,
        CASE c_custkey % 50 WHEN 0 THEN 'hell' WHEN 1 THEN 'easy' END AS curation_tag, CASE c_custkey % 10 WHEN 0 THEN '기계식' WHEN 1 THEN '지하' END AS notes
        FROM {customer} JOIN {nation} ON n_nationkey=c_nationkey JOIN {region} ON r_regionkey=n_regionkey""",
    "p_reviews": """SELECT o_orderkey AS id, concat(CASE o_custkey % 3 WHEN 0 THEN 'KA-' WHEN 1 THEN 'NV-' ELSE 'PB-' END, CAST(o_custkey AS STRING)) AS parking_lot_id,
        0.5e0 + CAST(o_orderkey % 10 AS DOUBLE)/2 AS overall_score, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS is_seed, CASE WHEN o_orderpriority='5-LOW' THEN 'clien' END AS source_type, o_orderdate AS created_at
        FROM {orders} WHERE o_custkey % 4 <> 0""",
    "p_web": """SELECT l_orderkey*10+l_linenumber AS id, concat(CASE o_custkey % 3 WHEN 0 THEN 'KA-' WHEN 1 THEN 'NV-' ELSE 'PB-' END, CAST(o_custkey AS STRING)) AS parking_lot_id,
        CASE l_linestatus WHEN 'O' THEN 'naver_blog' ELSE 'ddg_search' END AS source, CAST((l_partkey*13) % 101 AS INT) AS relevance_score,
        CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE 1 + CAST(l_suppkey % 9 AS DOUBLE)/2 END AS sentiment_score, CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END AS filter_passed_v2, l_shipdate AS published_at
        FROM {lineitem} JOIN {orders} ON o_orderkey=l_orderkey WHERE o_custkey % 3 <> 1""",
    "p_ai_matches": "SELECT id AS web_source_id, concat('PB-', CAST((id*3+2) % 1500 AS STRING)) AS parking_lot_id, CASE id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM {p_web} WHERE id % 20 = 3 GROUP BY id",
    "p_raw": "SELECT page_id AS id, 'pages' AS source, substring(sha2(url,256),1,16) AS source_id, url AS source_url, html AS content FROM {pages}",
    "p_docs": "SELECT doc_id AS id, source, substring(text,1,40) AS title, text AS full_text, CASE WHEN n_chars < 200 THEN 'too_short' ELSE 'ok' END AS full_text_status, n_chars FROM {documents}",
    "p_votes": "SELECT user_id, concat('KA-', CAST((event_id*3) % 1500 AS STRING)) AS parking_lot_id, CASE event_type WHEN 'click' THEN 'up' ELSE 'down' END AS vote_type, ts AS created_at, event_id AS seq FROM {events} WHERE event_type IN ('click','error')",
    "p_messages": "SELECT event_id, ts, concat('KA-', CAST((user_id*3) % 1500 AS STRING)) AS lot_id, CASE event_type WHEN 'signup' THEN 'review_created' ELSE 'review_deleted' END AS reason FROM {events} WHERE event_type IN ('signup','purchase')",
    "p_progress": "SELECT concat('naver_blogs_lot:KA-', CAST((user_id*3) % 1500 AS STRING)) AS crawler_id, max(ts) AS last_run_at, count(*) AS completed_count FROM {events} GROUP BY 1",
    "p_missed": "SELECT conv_id*100+turn AS id, split_part(text,' ',1) AS missed_lot_name, role AS source, text AS content FROM {conversations}",
    "p_results": """SELECT s_suppkey AS id, concat('c', CAST(s_nationkey AS STRING)) AS candidate, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN '음식점' ELSE '주차장' END AS category, concat(r_name,' ',n_name) AS address,
        33 + CAST((s_suppkey*37) % 6000 AS DOUBLE)/1000 + CASE WHEN s_suppkey % 3 = 0 THEN 0.0001e0 ELSE 0.0015e0 END AS lat, 124 + CAST((s_suppkey*53) % 8000 AS DOUBLE)/1000 AS lng
        FROM {supplier} JOIN {nation} ON n_nationkey=s_nationkey JOIN {region} ON r_regionkey=n_regionkey WHERE s_nationkey % 7 <> 6""",
    "p_reports": """SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'review' WHEN 1 THEN 'web_source' ELSE 'media' END AS target_type,
        CASE event_id % 3 WHEN 1 THEN (event_id % 5000)*10+1 ELSE event_id % 5000 END AS target_id, concat('10.0.0.', CAST(user_id % 20 AS STRING)) AS ip, ts AS created_at,
        CASE event_id % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'dismissed' ELSE 'open' END AS status FROM {events} WHERE event_type IN ('error','signup')""",
    "p_media": "SELECT event_id AS id, concat('KA-', CAST((event_id*3) % 1500 AS STRING)) AS parking_lot_id, 'youtube' AS media_type, props AS url, ts AS created_at FROM {events} WHERE event_type='view'",
}


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frames = {n: view(spark, sf_dir, n) if n in VIEWS else scan(spark, sf_dir, n) for n in re.findall(r"\{(\w+)\}", VIEWS[name])}
    return spark.sql(VIEWS[name], **frames)


#: Stored scores, by the input's files and age.
STORED = ResultCache()


class Catalogue:
    """The tables of one folder: catalogue.lots, .reviews, .web, .stats and so on, each read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return view(self.spark, self.sf_dir, f"p_{name}") if f"p_{name}" in VIEWS else scan(self.spark, self.sf_dir, name)

    @cached_property
    def stats(self) -> DataFrame:
        """The stored scores of all places, as the batch job leaves them: reads do not run the score model.

        Made anew when a file of the inputs is another or has changed, or the scores are older than the cache keeps them.
        """
        from wayfold.operators.scoring import recompute

        inputs = [self.lots, self.reviews, self.web, self.ai_matches]
        return STORED.get(self.spark, f"stats of {self.sf_dir}", files_fingerprint(*inputs), lambda: recompute(*inputs, NOW))


#: The time that stands for now in all queries over the driver's tables.
NOW = "2002-01-01 00:00:00"
