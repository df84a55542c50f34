"""Operator 7: quality rules from cross-document line frequency, with DataFrame functions only.

A line (white space collapsed, A-Z and the like lower-cased) is hashed; per host (the source) the distinct documents that
hold it are counted. A line that too many documents of a host share is boilerplate and removed; a document of which too
little is left is rejected. Copies of one document are not boilerplate: documents of a host with the same set of lines
count once, for a line and for the host alike.

Base measures come from the text itself: words, their code points, symbols, repeated lines, and words in windows of five
that occur twice or more. Null and empty texts have no words and fail. A null source is a host of its own. Repeated rows
each give a row; they count once for a line. An empty table gives no rows. verdicts() takes no notice of other columns;
cleaned() passes them on as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import folded, unfolded, written

#: A line is boilerplate if over LEAST_DOCS and over SHARE of a host's distinct documents hold it.
LEAST_DOCS, SHARE = 20, 0.01
#: A document is depleted if fewer words are left, or less than this part of its words.
LEAST_WORDS, LEAST_LEFT = 10, 0.2
#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

SPACE = r"[ \\t-\\r]+"


def _normal(line: str) -> str:
    return f"lower(trim(regexp_replace({line}, '{SPACE}', ' ')))"


def measured(docs: DataFrame) -> DataFrame:
    """Row number, doc_id, host, base measures, the hashes of the document's distinct lines, their hash, and all lines with words."""
    t = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("row", F.monotonically_increasing_id())
    t = t.withColumn("words", F.expr(f"filter(split(text, '{SPACE}'), w -> w <> '')"))
    t = t.withColumn("n_words", F.size("words").cast("long"))
    t = t.withColumn("word_chars", F.length(F.concat_ws("", "words")).cast("long"))
    t = t.withColumn("n_symbols", F.expr("regexp_count(text, '[#*$%&|<>]')").cast("long"))
    t = t.withColumn("windows", F.expr(f"CASE WHEN n_words >= {WINDOW} THEN transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW}))) ELSE array() END"))
    t = t.withColumn("lines", F.expr("filter(split(text, '\\n'), x -> x rlike '[^ \\\\t-\\\\r]')"))
    t = t.select("row", "doc_id", "host", "n_words", "word_chars", "n_symbols", "windows", "lines")
    t = t.withColumn("n_dup_lines", F.expr("size(lines) - size(array_distinct(lines))").cast("long"))
    # repeated windows: hashes with their places, sorted, so that equals are neighbours; most texts have none
    t = t.withColumn("sorted", F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN sort_array(transform(windows, (h, i) -> struct(h, i))) ELSE array() END"))
    t = t.withColumn("repeats", F.expr("array_sort(transform(filter(sorted, (x, i) -> x.h = sorted[greatest(i - 1, 0)].h AND i > 0 OR x.h = sorted[least(i + 1, size(sorted) - 1)].h AND i + 1 < size(sorted)), x -> x.i))"))
    t = t.withColumn("n_repeat_words", F.expr(f"aggregate(repeats, struct(0L AS n, -{WINDOW} AS last), (a, i) -> struct(a.n + least({WINDOW}, i - a.last) AS n, i AS last), a -> a.n)"))
    t = t.withColumn("hashes", F.expr(f"transform(lines, x -> xxhash64({_normal('x')}))"))
    t = t.withColumn("sizes", F.expr(f"transform(lines, x -> size(split({_normal('x')}, ' ')))"))
    t = t.withColumn("line_set", F.expr("sort_array(array_distinct(hashes))"))
    t = t.withColumn("set_hash", F.xxhash64("line_set"))
    t = t.withColumn("line_list", F.expr("arrays_zip(hashes, sizes)"))
    return t.select("row", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_set", "set_hash", "line_list")


def frequent_lines(marked: DataFrame) -> DataFrame:
    """host and h of boilerplate lines."""
    one = marked.select("host", "set_hash", F.explode("line_set").alias("h")).distinct()
    per_line = one.groupBy("host", "h").agg(F.count("*").alias("docs")).filter(F.col("docs") > LEAST_DOCS)
    per_host = marked.select("host", "set_hash").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    return per_line.join(per_host, "host").filter(F.col("docs") > SHARE * F.col("host_docs")).select("host", "h")


def judged(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts (row, doc_id, host, measures, words removed, base_failed, kept), and lines to remove by host."""
    marked = written(measured(docs), "measured")
    common = written(frequent_lines(marked), "common-lines")
    lines = marked.select("row", "host", F.explode("line_list").alias("x")).select("row", "host", F.col("x.hashes").alias("h"), F.col("x.sizes").alias("words"))
    removed = lines.join(common, ["host", "h"], "left_semi").groupBy("row").agg(F.sum("words").alias("removed"))
    out = marked.drop("line_set", "set_hash", "line_list").join(removed, "row", "left").withColumn("removed", F.coalesce("removed", F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    left = F.col("n_words") - F.col("removed")
    depleted = (left < LEAST_WORDS) | (left < LEAST_LEFT * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted), common


def verdicts(docs: DataFrame) -> DataFrame:
    return judged(docs)[0].select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed")


def cleaned(docs: DataFrame) -> DataFrame:
    """Kept documents without boilerplate lines, n_chars counted anew; columns as in docs.

    Rows find their verdicts by doc_id, source and text hash, so repeated rows share one. Other columns pass as they are.
    """
    names, own = docs.columns, ["doc_id", "source", "text", "n_chars"]
    host = F.coalesce("source", F.lit("")).alias("host")
    verdict, common = judged(docs.select(F.struct("doc_id", F.xxhash64("text").alias("th")).alias("doc_id"), "source", "text"))
    by = verdict.filter("kept").groupBy(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.th").alias("_th"), "host").agg(F.max("removed").alias("removed"))
    hit = by.filter("removed > 0").select("_id", "_th", "host")
    hashes = F.expr(f"array_distinct(transform(filter(split(text, '\\n'), x -> x rlike '[^ \\\\t-\\\\r]'), x -> xxhash64({_normal('x')})))")
    lines = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"), host, F.explode(hashes).alias("h"))
    found = lines.join(common, ["host", "h"], "left_semi").groupBy("_id", "_th", "host").agg(F.collect_set("h").alias("_lines"))
    found = found.select(F.col("_id").alias("_i"), F.col("_th").alias("_t"), F.col("host").alias("_h"), "_lines").join(hit, F.expr("_i <=> _id AND _t = _th AND _h = host"), "left_semi")
    by = by.join(found, F.expr("_id <=> _i AND _th = _t AND host = _h"), "left").select("_id", "_th", F.col("host").alias("_host"), "_lines")
    rows = folded(docs, own).withColumns({"_x": F.xxhash64("text"), "_s": F.coalesce("source", F.lit(""))})
    rows = rows.join(by, F.expr("doc_id <=> _id AND _x = _th AND _s = _host"))
    text = F.expr(f"CASE WHEN _lines IS NULL THEN text ELSE array_join(filter(split(text, '\\n'), x -> NOT coalesce(array_contains(_lines, xxhash64({_normal('x')})), false) OR NOT x rlike '[^ \\\\t-\\\\r]'), '\\n') END")
    return unfolded(rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")), names, own)
