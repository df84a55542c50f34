"""The operators' queries: each takes (spark, sf_dir), applies an operator to its whole table and returns the full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import bpe, collocations, html_extract, lzprint, ngram_join, packing, pii, quality, rans, simhash, sort_means, toxicity, warc
from wayfold.llm.common import load


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(load(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(load(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(load(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(load(spark, sf_dir, "documents"))


def op8_lzprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.with_edits(load(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(load(spark, sf_dir, "pages"))


def op10_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.stored(load(spark, sf_dir, "documents"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(load(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_phrases(load(spark, sf_dir, "documents"))


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.clustered(load(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_pii, op3_toxicity, op4_html, op5_bpe, op6_simhash, op7_quality, op8_lzprint, op9_warc, op10_rans, op11_ngram_join, op12_collocations, op13_sort_means)}


#: Operator 7 by lists and joins of the lines themselves instead of their hashes.
QUALITY_SQL = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, host, text, list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines FROM t),
o AS (SELECT r, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM w),
p AS (SELECT r, i, x || ' ' || lead(x, 1) OVER z || ' ' || lead(x, 2) OVER z || ' ' || lead(x, 3) OVER z || ' ' || lead(x, 4) OVER z AS five FROM o WINDOW z AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM p WHERE five IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest(range(0, 5)) AS k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, host, lower(trim(regexp_replace(unnest(lines), '[ \\t-\\r]+', ' ', 'g'))) AS h FROM w),
s AS (SELECT r, host, array_to_string(list_sort(list(DISTINCT h)), chr(10)) AS own FROM l GROUP BY r, host),
e AS (SELECT r, host, '' AS own FROM w WHERE len(lines) = 0),
sizes AS (SELECT host, count(DISTINCT own) AS docs FROM (SELECT * FROM s UNION ALL SELECT * FROM e) GROUP BY host),
held AS (SELECT l.host, l.h, count(DISTINCT s.own) AS docs FROM l JOIN s USING (r) GROUP BY l.host, l.h),
common AS (SELECT host, h FROM held JOIN sizes USING (host) WHERE held.docs > 20 AND held.docs > 0.01 * sizes.docs),
gone AS (SELECT r, sum(len(string_split(h, ' '))) AS removed FROM l JOIN common USING (host, h) GROUP BY r),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed
  FROM w LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_words - removed < 10 OR n_words - removed < 0.2 * n_words) AS kept, removed
FROM m
"""

#: Operator 9 without files.
WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
x AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS target FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> target THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> target THEN target END AS refers_to
FROM x
"""


LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: Operator 11 by joining the shingles themselves, and reachability by recursion.
NGRAM_SQL = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {LOWER}), '[ \\t-\\r]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(words) >= 4 THEN list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS own FROM w),
x AS (SELECT r, len(own) AS n, unnest(own) AS h FROM s),
pairs AS (SELECT a.r AS a, b.r AS b FROM x AS a JOIN x AS b ON a.h = b.h AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT r AS a, r AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN s ON s.r = reach.b GROUP BY a)
SELECT doc_id, len(own)::BIGINT AS n_shingles, component_id FROM s JOIN least USING (r)
"""

#: Operator 12 by counting all phrases.
PHRASE_SQL = f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, {LOWER}), '[.,;:!?\\n-\\r]')) AS piece FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM t),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM p, (SELECT unnest([1, 2, 3, 4]) AS m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT lang, phrase, a, w, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, a, x.f AS l, y.f AS r, k, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score FROM k JOIN f AS x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f AS y ON y.lang = k.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT lang, phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
gone AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN c ON c.lang = b.lang AND c.phrase <> b.phrase AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.a >= 80 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b ANTI JOIN gone USING (lang, phrase) JOIN n USING (lang) QUALIFY rank <= 2000
"""

#: Operator 13: every distance, round by round.
MEANS_SQL = (
    """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(embedding) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('1:' || vec_id), v LIMIT 16),
"""
    + "".join(
        f"""a{i} AS MATERIALIZED (SELECT r, min([list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c.c]) AS best FROM v, c{i} AS c GROUP BY r),
s{i} AS (SELECT best[2] AS c, d, sum(v[d])::HUGEINT AS s, count(*) AS n FROM a{i} JOIN v USING (r), (SELECT unnest(range(1, 65)) AS d) GROUP BY ALL),
m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY d) AS v FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{i} AS o LEFT JOIN m{i} AS m USING (c)),
"""
        for i in range(3)
    )
    + """a3 AS MATERIALIZED (SELECT r, min([list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c.c]) AS best FROM v, c3 AS c GROUP BY r),
e AS (SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance FROM a3 JOIN v USING (r))
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256 FROM e JOIN c3 ON c3.c = e.cluster
"""
)


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it expresses whole; tests hold the others against brute force, round trips or labels."""
    return {"op7_quality": QUALITY_SQL, "op9_warc": WARC_SQL, "op11_ngram_join": NGRAM_SQL, "op12_collocations": PHRASE_SQL, "op13_sort_means": MEANS_SQL}
