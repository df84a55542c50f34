"""Queries by name, each with its equivalent in SQL where there is one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.sources.views import NOW, VIEWS, Catalogue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The score model in SQL, over the views; oracles refer to it as p_stats.
STATS = f"""SELECT parking_lot_id, floor(prior*100+0.5)/100 AS structural_prior, review_score, review_count, web_score, web_count, n_effective,
 CASE WHEN curation_tag = 'hell' THEN least(score, 2.9e0) ELSE score END AS final_score,
 CASE WHEN review_score IS NULL AND web_score IS NULL THEN CASE WHEN prior <> 3.0e0 THEN 'structural' ELSE 'none' END WHEN n_effective >= 5 THEN 'confirmed' WHEN n_effective >= 1 THEN 'estimated' WHEN n_effective > 0 THEN 'reference' ELSE 'structural' END AS reliability
 FROM (SELECT *, CASE WHEN review_score IS NULL AND web_score IS NULL THEN floor(prior*100+0.5)/100 ELSE greatest(1e0, least(5e0, floor((CASE WHEN n_effective < 1 AND review_count = 0 THEN greatest(blended, prior) ELSE blended END)*100+0.5)/100)) END AS score
 FROM (SELECT *, (2.5e0*prior + n_effective*(coalesce(0.6e0/shares*review_score, 0e0) + coalesce(0.4e0/shares*web_score, 0e0)))/(2.5e0+n_effective) AS blended
 FROM (SELECT *, (CASE WHEN review_score IS NOT NULL THEN 0.6e0 ELSE 0e0 END + CASE WHEN web_score IS NOT NULL THEN 0.4e0 ELSE 0e0 END) AS shares
 FROM (SELECT l.id AS parking_lot_id, l.curation_tag,
  greatest(1e0, least(5e0, 3e0 + CASE WHEN contains(lower(l.name || ' ' || coalesce(l.notes,'')), '기계') THEN -0.2e0 ELSE 0e0 END + CASE WHEN l.total_spaces < 30 THEN -0.1e0 ELSE 0e0 END + CASE WHEN l.total_spaces > 500 THEN 0e0 WHEN l.total_spaces > 200 THEN 0.05e0 ELSE 0e0 END + CASE WHEN contains(lower(l.name || ' ' || coalesce(l.notes,'')), '지하') THEN -0.15e0 ELSE 0e0 END)) AS prior,
  r.review_score, coalesce(r.review_count, 0) AS review_count, w.web_score, coalesce(w.web_count, 0) AS web_count, floor((coalesce(r.weight, 0e0) + coalesce(w.weight, 0e0))*100+0.5)/100 AS n_effective
 FROM p_lots l
 LEFT JOIN (SELECT parking_lot_id, floor(sum(w*d*overall_score)/nullif(sum(w*d), 0)*100+0.5)/100 AS review_score, count(*) AS review_count, sum(w) AS weight FROM (SELECT *, CASE WHEN is_seed = 1 THEN 0.3e0 WHEN source_type IS NOT NULL THEN 0.6e0 ELSE 3e0 END AS w, CASE WHEN created_at IS NULL THEN 0.5e0 WHEN created_at > TIMESTAMP '{NOW}' THEN 1e0 ELSE pow(0.5e0, (epoch_us(TIMESTAMP '{NOW}')-epoch_us(created_at))/8.64e10/365) END AS d FROM p_reviews) GROUP BY 1) r ON r.parking_lot_id = l.id
 LEFT JOIN (SELECT parking_lot_id, floor(sum(w*sentiment_score)/nullif(sum(w), 0)*100+0.5)/100 AS web_score, count(*) AS web_count, CASE WHEN count(*) FILTER (relevance_score >= 70) = 0 THEN 0e0 ELSE least(0.1e0, 1e0/count(*) FILTER (relevance_score >= 70)) * sum(CASE WHEN relevance_score >= 70 THEN f ELSE 0e0 END) END AS weight
  FROM (SELECT *, relevance_score/100e0*f*CASE WHEN published_at IS NULL THEN 0.5e0 WHEN published_at > TIMESTAMP '{NOW}' THEN 1e0 ELSE pow(0.5e0, (epoch_us(TIMESTAMP '{NOW}')-epoch_us(published_at))/8.64e10/365) END AS w FROM p_signals WHERE sentiment_score IS NOT NULL) GROUP BY 1) w ON w.parking_lot_id = l.id))))"""
SIGNALS = """SELECT parking_lot_id, relevance_score, sentiment_score, published_at, 'direct' AS match_type, 1e0 AS f FROM p_web WHERE filter_passed_v2 = 1 AND relevance_score >= 60
 UNION ALL SELECT m.parking_lot_id, w.relevance_score, w.sentiment_score, w.published_at, 'ai_' || m.confidence, CASE m.confidence WHEN 'high' THEN 0.8e0 ELSE 0.5e0 END FROM p_ai_matches m JOIN p_web w ON w.id = m.web_source_id
 WHERE m.confidence IN ('high','medium') AND w.filter_passed_v2 = 1 AND w.relevance_score >= 60 AND (w.parking_lot_id IS NULL OR w.parking_lot_id <> m.parking_lot_id)"""

DEFINITIONS = {**{k: re.sub(r"\{(\w+)\}", r"\1", v).replace("sha2(url,256)", "sha256(url)") for k, v in VIEWS.items()}, "p_signals": SIGNALS, "p_stats": STATS}


def with_views(sql: str) -> str:
    """sql with the definitions of all views that it names, in order."""
    needed: dict[str, str] = {}

    def add(text: str) -> None:
        for name in re.findall(r"\bp_\w+", text):
            if name in DEFINITIONS and name not in needed:
                add(DEFINITIONS[name])
                needed[name] = DEFINITIONS[name]

    add(sql)
    views = [f"{k} AS ({v})" for k, v in needed.items()]
    own = re.match(r"\s*WITH\b", sql)
    if own:
        return f"WITH {', '.join(views)}, {sql[own.end() :]}" if views else sql
    return f"WITH {', '.join(views)} {sql}" if views else sql


def query(name: str, sql: str | None = None):
    """Registers f(catalogue) as a query, and the SQL that gives the same rows."""

    def register(f: Callable[[Catalogue], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
        if sql:
            ORACLE[name] = with_views(sql)
        return f

    return register
