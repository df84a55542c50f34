"""Landing files in and derived files out: feeds, dictionaries, dumps; sharded, paged and XML output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions.columns import in_korea

#: Schema of a public feed of places, all strings as delivered.
FEED = "prkplceNo string, prkplceNm string, prkplceType string, rdnmadr string, lnmadr string, prkcmprt string, latitude string, longitude string, parkingchrgeInfo string, phoneNumber string"


def landed_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines as they landed, with control characters taken out of every string."""
    rows = spark.read.schema(schema).json(path)
    return rows.select(*[F.regexp_replace(F.col(c), r"[\x00-\x1f]", " ").alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])


def feed_to_lots(feed: DataFrame) -> DataFrame:
    """Places of the public feed; rows without an id or outside the country are left out."""
    rows = feed.select(
        F.col("prkplceNo").alias("id"), F.trim("prkplceNm").alias("name"), F.coalesce("prkplceType", F.lit("")).alias("type"), F.coalesce(F.nullif("rdnmadr", F.lit("")), "lnmadr").alias("address"),
        F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lng"), F.coalesce(F.col("prkcmprt").try_cast("int"), F.lit(0)).alias("total_spaces"),
        F.when(F.col("parkingchrgeInfo") == "무료", 1).otherwise(0).alias("is_free"), F.nullif("phoneNumber", F.lit("")).alias("phone"),
    )
    return rows.filter((F.coalesce("id", F.lit("")) != "") & in_korea(F.col("lat"), F.col("lng")))


def places_of_search(items: DataFrame, engine: str) -> DataFrame:
    """Results of search engines in one shape; one engine gives coordinates in ten-millionths of a degree."""
    scale = 1e7 if engine == "naver" else 1.0
    x, y = ("mapx", "mapy") if engine == "naver" else ("x", "y")
    rows = items.select(F.regexp_replace("title", "<[^>]*>", "").alias("title"), "address", "category", (F.col(y).try_cast("double") / scale).alias("lat"), (F.col(x).try_cast("double") / scale).alias("lng"))
    return rows.filter(in_korea(F.col("lat"), F.col("lng"))).withColumn("engine", F.lit(engine))


def destinations(items: DataFrame, limit: int = 5) -> DataFrame:
    """Suggestions other than parking places themselves."""
    return items.filter(~F.contains(F.coalesce("category", F.lit("")), F.lit("주차장"))).orderBy("title").limit(limit)


def web_results(pages: DataFrame, html: str = "html") -> DataFrame:
    """Links of result pages with title and snippet, in order: class names of the page say which; else all outer links."""
    block = F.regexp_extract_all(html, F.lit(r'(?s)<a[^>]*class="[^"]*result__a[^"]*"[^>]*href="([^"]*)"[^>]*>(.*?)</a>'), F.lit(0))
    plain = F.regexp_extract_all(html, F.lit(r'(?s)<a[^>]*href="(https?://[^"]*)"[^>]*>(.*?)</a>'), F.lit(0))
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(F.when(F.size(block) > 0, block).otherwise(plain)).alias("position", "link"))
    return rows.withColumns({"url": F.regexp_extract("link", r'href="([^"]*)"', 1), "title": F.trim(F.regexp_replace(F.regexp_extract("link", r"(?s)>(.*)</a>", 1), "<[^>]*>", ""))}).drop("link")


def fetch_status(code: Column, text: Column, shortest: int = 200) -> Column:
    """ok, blocked, not_found, too_short or error of a fetched page."""
    return F.when(code.isin(403, 429), "blocked").when(code.isin(404, 410), "not_found").when(code.isNull() | (code >= 400), "error").when(F.length(F.coalesce(text, F.lit(""))) < shortest, "too_short").otherwise("ok")


def updates_of_dump(spark: SparkSession, path: str, column: str) -> DataFrame:
    """id and new text of the UPDATE statements of SQL files; doubled quotes are one."""
    pattern = rf"(?s)UPDATE\s+\w+\s+SET\s+{column}\s*=\s*'((?:[^']|'')*)'[^;]*?WHERE\s+\w+\s*=\s*'((?:[^']|'')*)'"
    rows = spark.read.option("lineSep", ";\n").text(path)
    one = lambda i: F.replace(F.regexp_extract("value", pattern, i), F.lit("''"), F.lit("'"))
    return rows.filter(F.col("value").rlike(pattern)).select(one(2).alias("id"), one(1).alias("text"))


def weights_of(spark: SparkSession, path: str) -> dict[str, float]:
    """A small JSON dictionary of word and weight, for the driver: one object in one file."""
    row = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,double>").alias("m")).first()
    return dict(row.m or {}) if row else {}


def write_shards(df: DataFrame, path: str, key: str, shards: int, per_file: int = 500) -> None:
    """JSON files of at most per_file rows, in a folder per shard of the key's hash."""
    shard = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
    df.withColumn("shard", shard).repartition(shards, "shard").write.option("maxRecordsPerFile", per_file).partitionBy("shard").json(path)


def running_total(rows: DataFrame, key: str, weight: Column, name: str) -> DataFrame:
    """rows with the sum of weight over all rows up to each in ascending order of key, which may be a struct.

    Summed in two steps: within ranges of the key, and over ranges, so no task sees all rows. Rows of equal keys follow each
    other in any order and stay in one range.
    """
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("_weight", weight).repartitionByRange(n, key)
    counts = dealt.groupBy(F.spark_partition_id().alias("_part")).agg(F.sum("_weight").alias("_n"), F.min(key).alias("_low"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_low").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_low", before.alias("_before"))
    edges = starts.agg(F.array_sort(F.collect_list(F.struct("_low", "_before"))).alias("_edges"))  # one row of as many entries as there are ranges
    found = dealt.join(F.broadcast(edges)).withColumn("_edge", F.element_at(F.filter("_edges", lambda e: e["_low"] <= F.col(key)), -1)).drop("_edges")
    upto = F.sum("_weight").over(W.partitionBy("_edge._low").orderBy(key).rowsBetween(W.unboundedPreceding, 0)) + F.col("_edge._before")
    return found.withColumn(name, upto).drop("_weight", "_edge")


def numbered_pages(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows with their page, `size` rows each in ascending order of the unique key."""
    numbered = running_total(rows, key, F.lit(1), "_upto")
    return numbered.withColumn("page", F.floor((F.col("_upto") - 1) / size).cast("long")).drop("_upto")


def sitemap(pages: DataFrame, base: str, key: str = "id", modified: str = "modified") -> DataFrame:
    """One XML document per page of a table with columns page, key and modified."""
    entry = F.concat(F.lit(f"<url><loc>{base}"), F.col(key), F.lit("</loc><lastmod>"), F.regexp_extract(F.col(modified).cast("string"), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("</lastmod></url>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), entry.alias("x")))), lambda e: e["x"]), "")
    head = '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    return pages.groupBy("page").agg(F.concat(F.lit(head), body, F.lit("</urlset>")).alias("xml"))


def sitemap_urls(xml: DataFrame, column: str = "xml") -> DataFrame:
    return xml.select(F.explode(F.regexp_extract_all(column, F.lit(r"<loc>\s*([^<]*?)\s*</loc>"), F.lit(1))).alias("url"))


def sitemap_index(pages: DataFrame, base: str) -> DataFrame:
    """One XML document that names the document of each page: base followed by its number and .xml."""
    entry = F.concat(F.lit(f"<sitemap><loc>{base}"), F.col("page").cast("string"), F.lit(".xml</loc></sitemap>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", entry.alias("x")))), lambda e: e["x"]), "")
    head = '<?xml version="1.0" encoding="UTF-8"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    return pages.select("page").distinct().agg(F.concat(F.lit(head), body, F.lit("</sitemapindex>")).alias("xml"))


def write_sitemaps(pages: DataFrame, base: str, folder: str, key: str = "id", modified: str = "modified") -> None:
    """The documents of all pages in folders by page, and the index that names them."""
    sitemap(pages, base, key, modified).select("xml", "page").write.mode("overwrite").partitionBy("page").text(f"{folder}/pages")
    sitemap_index(pages, base).write.mode("overwrite").text(f"{folder}/index")


def sitemap_entries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """loc, lastmod (a date; null where it is missing or no date) and file of the entries of url documents, read by Spark's XML source.

    Entries without an address are left out; references are decoded and white space around addresses goes.
    """
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    rows = rows.select(F.trim("loc").alias("loc"), F.left(F.trim("lastmod"), F.lit(10)).try_cast("date").alias("lastmod"), F.col("_metadata.file_path").alias("file"))
    return rows.filter(F.coalesce("loc", F.lit("")) != "")


def indexed_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """The addresses that index documents name."""
    rows = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path)
    return rows.select(F.trim("loc").alias("loc")).filter(F.coalesce("loc", F.lit("")) != "")


def expanded_sitemap(spark: SparkSession, index: str, place: Callable[[str], str]) -> DataFrame:
    """sitemap_entries() of all documents that an index names. place() gives the path at which a document of an address has landed.

    The driver holds the index: at most 50,000 addresses a document, as the format allows.
    """
    paths = sorted({place(r.loc) for r in indexed_sitemaps(spark, index).distinct().collect()})
    return sitemap_entries(spark, paths) if paths else spark.createDataFrame([], "loc string, lastmod date, file string")


def fingerprint(df: DataFrame, modified: str) -> DataFrame:
    """count-max(modified): changes as soon as a row is added, taken away or modified; the key of a stored result."""
    return df.agg(F.concat_ws("-", F.count("*").cast("string"), F.coalesce(F.max(modified).cast("string"), F.lit(""))).alias("fingerprint"))
