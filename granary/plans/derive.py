"""The catalog's tables derived from the driver's: archives and entries from pages and documents, layouts from documents, changes and
access logs from events. Each has its DuckDB text beside it, for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

HOST, PATH = r"^https?://([^/?#]+)", r"^https?://[^/?#]+/([^?#]*)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, archive_key (the host's labels from the last, as folders), internal_path, size."""
    p = table(spark, sf_dir, "pages")
    host = F.array_join(F.reverse(F.split(F.regexp_extract("url", HOST, 1), r"\.")), "/")
    return p.select("page_id", F.concat(host, F.lit(".zip")).alias("archive_key"), F.concat(F.regexp_extract("url", PATH, 1), F.lit(".html")).alias("internal_path"), F.octet_length("html").cast("long").alias("size"))


PAGE_PATHS = f"""page_paths AS (SELECT page_id, array_to_string(list_reverse(string_split(regexp_extract(url, '{HOST}', 1), '.')), '/') || '.zip' AS archive_key,
  regexp_extract(url, '{PATH}', 1) || '.html' AS internal_path, strlen(html)::BIGINT AS size FROM pages)"""


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_paths(spark, sf_dir).groupBy(F.col("archive_key").alias("virtual_path")).agg(F.sum("size").cast("long").alias("size_bytes")).withColumn("format_id", F.lit("zip"))


ARCHIVES = PAGE_PATHS + ", archives AS (SELECT archive_key AS virtual_path, sum(size)::BIGINT AS size_bytes, 'zip' AS format_id FROM page_paths GROUP BY 1)"


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by archive and path; of pages with one path the last stays."""
    w = Window.partitionBy("archive_key", "internal_path").orderBy(F.desc("page_id"))
    return page_paths(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k").withColumn("is_directory", F.lit(False))


PAGE_ENTRIES = ARCHIVES + """, page_entries AS (SELECT * EXCLUDE k, false AS is_directory FROM (SELECT *, row_number() OVER (PARTITION BY archive_key, internal_path ORDER BY page_id DESC) AS k FROM page_paths) WHERE k = 1)"""


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries of one archive a source, in order of id: archive_key, internal_path (three folders deep), offset, compressed_size, size."""
    d = table(spark, sf_dir, "documents")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    d = d.select("doc_id", F.concat(F.lit("corpus/"), "source", F.lit(".zip")).alias("archive_key"), F.concat_ws("/", "lang", (F.col("doc_id") % 3).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("internal_path"), size.alias("size"))
    d = d.withColumn("compressed_size", F.floor(F.col("size") * 2 / 5).cast("long") + F.col("doc_id") % 7)
    before = Window.partitionBy("archive_key").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    gap = (F.col("doc_id") * 37) % 400 + 40  # headers and entries of others
    return d.withColumn("offset", F.coalesce(F.sum(F.col("compressed_size") + gap).over(before), F.lit(0)).cast("long")).withColumn("is_directory", F.lit(False))


LAYOUT = """sized AS (SELECT doc_id, 'corpus/' || source || '.zip' AS archive_key, concat_ws('/', lang, (doc_id % 3)::VARCHAR, doc_id::VARCHAR || '.txt') AS internal_path, strlen(coalesce(text, ''))::BIGINT AS size FROM documents),
packed AS (SELECT *, (size * 2 // 5)::BIGINT + doc_id % 7 AS compressed_size FROM sized),
layout AS (SELECT *, coalesce(sum(compressed_size + (doc_id * 37) % 400 + 40) OVER (PARTITION BY archive_key ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", false AS is_directory FROM packed)"""


def triggers(layout_: DataFrame) -> DataFrame:
    """Reads of every document."""
    return layout_.select("archive_key", "internal_path", F.col("offset").alias("trigger_offset"))


TRIGGERS = LAYOUT + """, triggers AS (SELECT archive_key, regexp_replace(internal_path, '/[^/]*$', '') AS directory, "offset" AS trigger_offset FROM layout)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events: root (by user), path, op, ts, seq."""
    e = table(spark, sf_dir, "events").where("event_type IN ('signup', 'purchase', 'view', 'click')")
    op = F.when(F.col("event_type").isin("signup", "view"), "created").otherwise("deleted")
    return e.select(F.concat(F.lit("root"), (F.col("user_id") % 4).cast("string")).alias("root"), F.concat(F.lit("a"), F.col("user_id").cast("string"), F.lit(".zip")).alias("path"), op.alias("op"), "ts", F.col("event_id").alias("seq"))


EVENTS = """changes AS (SELECT 'root' || (user_id % 4) AS root, 'a' || user_id || '.zip' AS path, CASE WHEN event_type IN ('signup', 'view') THEN 'created' ELSE 'deleted' END AS op, ts, event_id AS seq FROM events WHERE event_type IN ('signup', 'purchase', 'view', 'click'))"""


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("cache"), (F.col("user_id") % 8).cast("string")).alias("cache"), F.concat("event_type", F.lit(":"), (F.col("user_id") % 200).cast("string")).alias("key"), F.floor(F.coalesce("value", F.lit(0.0)) * 100).cast("long").alias("size"), "ts", F.col("event_id").alias("seq"))


ACCESS_LOG = """access_log AS (SELECT 'cache' || (user_id % 8) AS cache, event_type || ':' || (user_id % 200) AS key, floor(coalesce(value, 0) * 100)::BIGINT AS size, ts, event_id AS seq FROM events)"""


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that an access log leaves: size at the last access, first access as creation."""
    g = access_log(spark, sf_dir).groupBy("cache", "key").agg(F.max_by("size", "seq").alias("size"), F.min("ts").alias("created"), F.max("ts").alias("last_access"), F.count("*").alias("accesses"))
    return g.withColumns({"ttl_seconds": F.lit(86400 * 10), "borrowed": (F.col("accesses") % 5 == 0).cast("int")})


CACHE_ENTRIES = ACCESS_LOG + """, cache_entries AS (SELECT cache, key, arg_max(size, seq) AS size, min(ts) AS created, max(ts) AS last_access, count(*) AS accesses, 864000 AS ttl_seconds, (count(*) % 5 = 0)::INT AS borrowed FROM access_log GROUP BY 1, 2)"""
