"""Queries over the archive catalog derived from the driver's tables, each with DuckDB SQL for its rows where SQL can say it."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import fields, paths
from granary.operators import caching, catalog, changes, planning
from granary.plans import derive as D
from granary.sources import rarscan, registry, zipscan
from granary.streaming import consolidate

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


# Paths

_MESSY = r"""messy AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '\' || replace(regexp_replace(url, '^https?:/', ''), '/', '\') || '\\' WHEN 1 THEN '//' || regexp_replace(url, '^https?:', '') WHEN 2 THEN '  ' ELSE url END AS raw FROM pages)"""


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.table(spark, sf_dir, "pages")
    k = F.col("page_id") % 4
    bare = F.regexp_replace("url", "^https?:/", "")
    raw = F.when(k == 0, F.concat(F.lit("\\"), F.replace(bare, F.lit("/"), F.lit("\\")), F.lit("\\\\"))).when(k == 1, F.concat(F.lit("//"), F.regexp_replace("url", "^https?:", ""))).when(k == 2, "  ").otherwise(F.col("url"))
    return p.select("page_id", raw.alias("raw"))


@query(f"""WITH {_MESSY} SELECT page_id, CASE WHEN trim(regexp_replace(replace(raw, '\\', '/'), '/+', '/', 'g')) = '' THEN '' ELSE trim(regexp_replace(replace(raw, '\\', '/'), '/+', '/', 'g'), '/') END AS path FROM messy""")
def normalize_path(spark, sf_dir):
    return _messy(spark, sf_dir).select("page_id", paths.normalize(F.col("raw")).alias("path"))


@query(f"""WITH {_MESSY}, n AS (SELECT page_id, trim(regexp_replace(replace(raw, '\\', '/'), '/+', '/', 'g'), '/') AS p FROM messy)
SELECT page_id, string_split(p, '/')[-1] AS name, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '' END AS directory, (length(p) - length(replace(p, '/', '')))::INT AS depth FROM n""")
def path_parts(spark, sf_dir):
    p = F.btrim(F.regexp_replace(F.replace("raw", F.lit("\\"), F.lit("/")), "/+", "/"), F.lit("/"))
    return _messy(spark, sf_dir).withColumn("p", p).select("page_id", paths.last_segment(F.col("p")).alias("name"), paths.directory_of(F.col("p")).alias("directory"), paths.depth(F.col("p")).alias("depth"))


_SHELL = r"""asked AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '\a.zip\Desktop.INI' WHEN 1 THEN '\$RECYCLE.BIN\' || page_id WHEN 2 THEN '\a.zip\$RECYCLE.BIN\file.txt' WHEN 3 THEN 'thumbs.db' ELSE '\x' || page_id || '\readme.txt' END AS path FROM pages)"""


@query(f"""WITH {_SHELL} SELECT page_id, path FROM asked WHERE NOT (lower(string_split(path, '\\')[-1]) IN ('desktop.ini', 'autorun.inf', 'thumbs.db', 'folder.jpg', 'folder.gif', 'icon.ico') OR lower(string_split(ltrim(path, '\\'), '\\')[1]) IN ('$recycle.bin', 'system volume information'))""")
def shell_filter(spark, sf_dir):
    k, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    path = F.when(k == 0, r"\a.zip\Desktop.INI").when(k == 1, F.concat(F.lit("\\$RECYCLE.BIN\\"), n)).when(k == 2, r"\a.zip\$RECYCLE.BIN\file.txt").when(k == 3, "thumbs.db").otherwise(F.concat(F.lit("\\x"), n, F.lit("\\readme.txt")))
    return D.table(spark, sf_dir, "pages").select("page_id", path.alias("path")).where(~paths.shell_metadata(F.col("path")))


@query(f"WITH {D.PAGE_ENTRIES} SELECT archive_key, internal_path FROM page_entries WHERE regexp_matches(string_split(internal_path, '/')[-1], '(?i)^.2.*\\.HTML$')")
def wildcard_filter(spark, sf_dir):
    return D.page_entries(spark, sf_dir).where(paths.matches(paths.last_segment(F.col("internal_path")), "?2*.HTML")).select("archive_key", "internal_path")


@query(f"WITH {D.ARCHIVES} SELECT virtual_path FROM archives WHERE length(virtual_path) - length(replace(virtual_path, '/', '')) < 3")
def depth_filter(spark, sf_dir):
    return D.archives(spark, sf_dir).where(paths.depth(F.col("virtual_path")) < 3).select("virtual_path")


@query(f"WITH {D.ARCHIVES}, v AS (SELECT CASE WHEN size_bytes % 3 = 0 THEN upper(virtual_path) WHEN size_bytes % 3 = 1 THEN regexp_replace(virtual_path, 'zip$', 'Rar') ELSE virtual_path || '.7z' END AS p FROM archives) SELECT p, CASE WHEN lower(p) LIKE '%.zip' THEN 'zip' WHEN lower(p) LIKE '%.rar' THEN 'rar' END AS format FROM v")
def detect_format(spark, sf_dir):
    k, v = F.col("size_bytes") % 3, F.col("virtual_path")
    p = F.when(k == 0, F.upper(v)).when(k == 1, F.regexp_replace(v, "zip$", "Rar")).otherwise(F.concat(v, F.lit(".7z")))
    return D.archives(spark, sf_dir).select(p.alias("p")).select("p", paths.format_of(F.col("p")).alias("format"))


# Catalog

_ASKED = """asked AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN archive_key WHEN 1 THEN upper(archive_key) || '/' || internal_path WHEN 2 THEN string_split(archive_key, '/')[1] || '/' || string_split(archive_key, '/')[2] WHEN 3 THEN 'nope/' || archive_key WHEN 4 THEN '' ELSE archive_key || '/' || string_split(internal_path, '/')[1] END AS path FROM page_paths)"""
_FOLDERS = """folders AS (SELECT DISTINCT array_to_string(list_slice(string_split(virtual_path, '/'), 1, k), '/') AS folder FROM archives, generate_series(1, 8) g(k) WHERE k < len(string_split(virtual_path, '/')))"""
_RESOLVED = f"""{D.ARCHIVES}, {_ASKED}, {_FOLDERS}, hits AS (SELECT page_id, path, max_by(virtual_path, length(virtual_path)) AS archive FROM asked LEFT JOIN archives ON upper(path) = upper(virtual_path) OR starts_with(upper(path), upper(virtual_path) || '/') GROUP BY 1, 2),
resolved AS (SELECT page_id, path, CASE WHEN path = '' THEN 'VirtualRoot' WHEN archive IS NOT NULL AND length(path) <= length(archive) THEN 'ArchiveRoot' WHEN archive IS NOT NULL THEN 'InsideArchive' WHEN folder IS NOT NULL THEN 'VirtualFolder' ELSE 'NotFound' END AS status, archive,
 CASE WHEN archive IS NULL THEN '' ELSE substr(path, length(archive) + 2) END AS internal_path, CASE WHEN archive IS NULL THEN folder END AS virtual_folder FROM hits LEFT JOIN (SELECT upper(folder) AS u, min(folder) AS folder FROM folders GROUP BY 1) ON upper(path) = u)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, i, k = F.col("archive_key"), F.col("internal_path"), F.col("page_id") % 6
    path = F.when(k == 0, a).when(k == 1, F.concat_ws("/", F.upper(a), i)).when(k == 2, F.substring_index(a, "/", 2)).when(k == 3, F.concat(F.lit("nope/"), a)).when(k == 4, "").otherwise(F.concat_ws("/", a, F.substring_index(i, "/", 1)))
    return D.page_paths(spark, sf_dir).select("page_id", path.alias("path"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.resolve(_asked(spark, sf_dir), D.archives(spark, sf_dir))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.with_parents(D.page_entries(spark, sf_dir))


_PARENTS = f"""{D.PAGE_ENTRIES}, up AS (SELECT DISTINCT archive_key, array_to_string(list_slice(string_split(internal_path, '/'), 1, k), '/') || '/' AS internal_path FROM page_entries, generate_series(1, 8) g(k) WHERE k < len(string_split(internal_path, '/'))),
entries AS (SELECT archive_key, internal_path, false AS is_directory, size, 128 AS attributes, false AS synthesized FROM page_entries UNION ALL SELECT archive_key, internal_path, true, 0, 16, true FROM up)"""


@query(f"WITH {_RESOLVED} SELECT * FROM resolved")
def resolve_longest_prefix(spark, sf_dir):
    return _resolved(spark, sf_dir).select("page_id", "path", "status", "archive", "internal_path", "virtual_folder")


@query(f"WITH {D.ARCHIVES}, {_FOLDERS} SELECT folder FROM folders")
def virtual_folders(spark, sf_dir):
    return catalog.virtual_folders(D.archives(spark, sf_dir))


@query(f"""WITH {D.ARCHIVES}, up AS (SELECT DISTINCT array_to_string(list_slice(p, 1, k - 1), '/') AS folder, p[k] AS name, k = len(p) AS is_archive, CASE WHEN k = len(p) THEN virtual_path END AS archive FROM (SELECT virtual_path, string_split(virtual_path, '/') AS p FROM archives), generate_series(1, 9) g(k) WHERE k <= len(p))
SELECT min(folder) AS folder, min(name) AS name, max(is_archive) AS is_archive, min(archive) AS archive FROM up GROUP BY upper(folder), upper(name)""")
def list_virtual_folder(spark, sf_dir):
    return catalog.list_folders(D.archives(spark, sf_dir))


@query(f"""WITH {_PARENTS} SELECT archive_key, CASE WHEN contains(rtrim(internal_path, '/'), '/') THEN regexp_replace(rtrim(internal_path, '/'), '/[^/]*$', '') ELSE '' END AS directory, string_split(rtrim(internal_path, '/'), '/')[-1] AS name, archive_key || '/' || rtrim(internal_path, '/') AS full_path, is_directory, CASE WHEN is_directory THEN 0 ELSE size END::BIGINT AS size FROM entries""")
def list_children(spark, sf_dir):
    return catalog.children(_entries(spark, sf_dir))


@query(f"WITH {_PARENTS} SELECT archive_key, internal_path, is_directory, size, attributes, synthesized FROM entries")
def synthesize_parents(spark, sf_dir):
    return _entries(spark, sf_dir)


@query(f"WITH {_PARENTS} SELECT archive_key, internal_path, CASE WHEN synthesized THEN 17 ELSE 128 END::INT AS attributes, CASE WHEN synthesized THEN 17 ELSE 129 END::INT AS listed FROM entries")
def listing_attributes(spark, sf_dir):
    """Directories as RAR archives have them, and every entry as the listing shows it: read-only."""
    e = catalog.with_parents(D.page_entries(spark, sf_dir), fields.DIRECTORY | fields.READ_ONLY)
    return e.select("archive_key", "internal_path", "attributes", F.col("attributes").bitwiseOR(F.lit(fields.READ_ONLY)).alias("listed"))


_LOOKUP = f"""{_PARENTS}, asked AS (SELECT page_id, archive_key, CASE page_id % 4 WHEN 0 THEN internal_path WHEN 1 THEN string_split(internal_path, '/')[1] WHEN 2 THEN 'no/' || internal_path ELSE string_split(internal_path, '/')[1] || '/' END AS internal_path FROM page_paths)"""


def _lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = F.col("internal_path"), F.col("page_id") % 4
    first = F.substring_index(i, "/", 1)
    path = F.when(k == 0, i).when(k == 1, first).when(k == 2, F.concat(F.lit("no/"), i)).otherwise(F.concat(first, F.lit("/")))
    return D.page_paths(spark, sf_dir).select("page_id", "archive_key", path.alias("internal_path"))


@query(f"""WITH {_LOOKUP} SELECT a.page_id, a.archive_key, a.internal_path, coalesce(e.internal_path, d.internal_path) AS found_path, coalesce(e.is_directory, d.is_directory, false) AS found_directory, coalesce(e.size, d.size, -1)::BIGINT AS found_size
FROM asked a LEFT JOIN entries e ON a.archive_key = e.archive_key AND a.internal_path = e.internal_path LEFT JOIN entries d ON a.archive_key = d.archive_key AND a.internal_path || '/' = d.internal_path""")
def entry_lookup_fallback(spark, sf_dir):
    return catalog.lookup(_lookups(spark, sf_dir), _entries(spark, sf_dir)).fillna({"found_directory": False, "found_size": -1})


@query(f"WITH {_LOOKUP} SELECT a.page_id, a.archive_key, a.internal_path FROM asked a SEMI JOIN (SELECT * FROM entries WHERE NOT is_directory) e ON a.archive_key = e.archive_key AND a.internal_path = e.internal_path")
def file_exists(spark, sf_dir):
    return catalog.files_that_exist(_lookups(spark, sf_dir), _entries(spark, sf_dir)).select("page_id", "archive_key", "internal_path")


@query(f"""WITH {_RESOLVED}, {_PARENTS.removeprefix(D.ARCHIVES + ', ')} SELECT r.page_id, r.path, r.status FROM resolved r WHERE status IN ('VirtualRoot', 'VirtualFolder', 'ArchiveRoot') OR status = 'InsideArchive' AND EXISTS (SELECT 1 FROM entries e WHERE e.archive_key = r.archive AND e.is_directory AND e.internal_path = rtrim(r.internal_path, '/') || '/')""")
def directory_exists(spark, sf_dir):
    return catalog.directories_that_exist(_resolved(spark, sf_dir), _entries(spark, sf_dir)).select("page_id", "path", "status")


@query(f"""WITH {_RESOLVED}, {_PARENTS.removeprefix(D.ARCHIVES + ', ')}, f AS (SELECT r.*, coalesce(e.is_directory, d.is_directory) AS dir, coalesce(e.size, d.size) AS n, a.size_bytes FROM resolved r LEFT JOIN entries e ON e.archive_key = r.archive AND e.internal_path = r.internal_path LEFT JOIN entries d ON d.archive_key = r.archive AND d.internal_path = r.internal_path || '/' LEFT JOIN archives a ON a.virtual_path = r.archive)
SELECT page_id, path, status, string_split(path, '/')[-1] AS name, CASE WHEN status = 'InsideArchive' THEN dir ELSE true END AS is_directory, CASE WHEN status = 'InsideArchive' AND NOT dir THEN n WHEN status = 'ArchiveRoot' THEN size_bytes ELSE 0 END::BIGINT AS size FROM f WHERE status != 'NotFound' AND (status != 'InsideArchive' OR dir IS NOT NULL)""")
def get_file_info(spark, sf_dir):
    r = _resolved(spark, sf_dir)
    return catalog.file_info(r, D.archives(spark, sf_dir), _entries(spark, sf_dir)).distinct().join(r.select("page_id", "path"), "path").select("page_id", "path", "status", "name", "is_directory", "size")


@query(f"WITH {D.ARCHIVES} SELECT 'corpus of pages from the open web'[:32] AS volume_label, 'NTFS' AS file_system, sum(size_bytes)::BIGINT AS total_bytes, 0::BIGINT AS free_bytes, true AS read_only FROM archives")
def volume_info(spark, sf_dir):
    return catalog.volume(D.archives(spark, sf_dir), "corpus of pages from the open web")


@query(f"WITH {_PARENTS} SELECT archive_key, count(*)::BIGINT AS n_entries, coalesce(sum(CASE WHEN NOT is_directory THEN size END), 0)::BIGINT AS total_uncompressed, coalesce(sum(CASE WHEN NOT is_directory THEN (size * 2 // 5) + 1 END), 0)::BIGINT AS total_compressed, (1024 + count(*) * 114)::BIGINT AS memory_bytes FROM entries GROUP BY 1")
def archive_totals(spark, sf_dir):
    packed_ = D.page_entries(spark, sf_dir).withColumn("compressed_size", F.floor(F.col("size") * 2 / 5) + 1)
    return catalog.totals(catalog.with_parents(packed_))


_TWO = """memory AS (SELECT virtual_path FROM archives WHERE size_bytes % 3 != 0), disk AS (SELECT upper(virtual_path) AS virtual_path FROM archives WHERE size_bytes % 3 != 1)"""


@query(f"WITH {D.ARCHIVES}, {_TWO} SELECT virtual_path, 'remove' AS action FROM memory WHERE upper(virtual_path) NOT IN (SELECT upper(virtual_path) FROM disk) UNION ALL SELECT virtual_path, 'add' FROM disk WHERE upper(virtual_path) NOT IN (SELECT upper(virtual_path) FROM memory)")
def reconcile(spark, sf_dir):
    a = D.archives(spark, sf_dir)
    return catalog.reconcile(a.where("size_bytes % 3 != 0"), a.where("size_bytes % 3 != 1").withColumn("virtual_path", F.upper("virtual_path")))


@query(f"""WITH {D.ARCHIVES}, old AS (SELECT * FROM archives WHERE size_bytes % 2 = 0), new AS (SELECT CASE WHEN size_bytes % 5 = 0 THEN virtual_path || ' (NOT SUPPORTED)' ELSE virtual_path END AS virtual_path, CASE WHEN size_bytes % 5 = 0 THEN 0 ELSE size_bytes + 1 END::BIGINT AS size_bytes, format_id FROM archives WHERE size_bytes % 3 = 0)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE virtual_path NOT IN (SELECT virtual_path FROM new)""")
def add_archives(spark, sf_dir):
    a = D.archives(spark, sf_dir)
    new = a.where("size_bytes % 3 = 0").withColumns({"supported": F.col("size_bytes") % 5 != 0, "size_bytes": F.col("size_bytes") + 1})
    return catalog.add(a.where("size_bytes % 2 = 0"), new, hide_unsupported=False)


@query(f"WITH {D.ARCHIVES} SELECT virtual_path, size_bytes FROM archives WHERE size_bytes % 4 != 0")
def remove_archives(spark, sf_dir):
    a = D.archives(spark, sf_dir)
    return catalog.remove(a, a.where("size_bytes % 4 = 0").select(F.upper("virtual_path").alias("virtual_path"))).select("virtual_path", "size_bytes")


@query(f"WITH {_PARENTS} SELECT archive_key, string_split(rtrim(internal_path, '/'), '/')[-1] AS name, archive_key || '/' || rtrim(internal_path, '/') AS full_path, is_directory, CASE WHEN is_directory THEN 0 ELSE size END::BIGINT AS size FROM entries WHERE NOT contains(rtrim(internal_path, '/'), '/')")
def listing(spark, sf_dir):
    """The root of every archive: each archive's path is resolved, and its top entries are listed."""
    roots = catalog.resolve(D.archives(spark, sf_dir).select(paths.normalize(F.concat(F.lit("\\"), F.col("virtual_path"))).alias("path")), D.archives(spark, sf_dir)).where("status = 'ArchiveRoot'")
    top = catalog.children(_entries(spark, sf_dir)).where("directory = ''")
    return top.join(roots.select(F.col("archive").alias("archive_key")), "archive_key").select("archive_key", "name", "full_path", "is_directory", "size")


# Fields, sizes, chunks


@query("""WITH w AS (SELECT o_orderkey, (o_orderkey * 7919 % 65536)::INT AS d, (o_orderkey * 104729 % 65536)::INT AS t FROM orders), f AS (SELECT o_orderkey, (d >> 9) + 1980 AS y, CASE WHEN (d >> 5) & 15 BETWEEN 1 AND 12 THEN (d >> 5) & 15 ELSE 1 END AS mo, CASE WHEN d & 31 BETWEEN 1 AND 31 THEN d & 31 ELSE 1 END AS dd,
 CASE WHEN t >> 11 <= 23 THEN t >> 11 ELSE 0 END AS h, CASE WHEN (t >> 5) & 63 <= 59 THEN (t >> 5) & 63 ELSE 0 END AS mi, CASE WHEN (t & 31) * 2 <= 59 THEN (t & 31) * 2 ELSE 0 END AS s FROM w)
SELECT o_orderkey, coalesce(try_strptime(printf('%04d-%02d-%02d %02d:%02d:%02d', y, mo, dd, h, mi, s), '%Y-%m-%d %H:%M:%S'), TIMESTAMP '0001-01-01 00:00:00')::VARCHAR AS modified FROM f""")
def dos_datetime(spark, sf_dir):
    k = F.col("o_orderkey")
    return D.table(spark, sf_dir, "orders").select("o_orderkey", fields.dos_timestamp(k * 7919 % 65536, k * 104729 % 65536).cast("string").alias("modified"))


@query("""WITH w AS (SELECT o_orderkey, o_orderkey % 256 AS ext, (o_orderkey // 7) % 4 AS host, CASE WHEN o_orderkey % 11 = 0 THEN 'a/' ELSE 'a' END AS name FROM orders)
SELECT o_orderkey, (name LIKE '%/' OR ext & 16 != 0) AS is_directory, CASE WHEN name LIKE '%/' OR ext & 16 != 0 THEN 16 WHEN host = 3 THEN 128 ELSE 128 | (ext & 39) END::INT AS attributes FROM w""")
def attribute_flags(spark, sf_dir):
    k = F.col("o_orderkey")
    w = D.table(spark, sf_dir, "orders").select("o_orderkey", (k % 256).alias("ext"), (F.floor(k / 7) % 4).alias("host"), F.when(k % 11 == 0, "a/").otherwise("a").alias("name"))
    w = w.withColumn("is_directory", fields.is_directory(F.col("name"), F.col("ext")))
    return w.select("o_orderkey", "is_directory", fields.attributes(F.col("is_directory"), F.col("host"), F.col("ext")).alias("attributes"))


@query("SELECT o_orderkey, (o_orderkey % 65536) & 2048 != 0 AS utf8, (o_orderkey % 65536) & 1 != 0 AS encrypted, (o_orderkey % 65536) & 8 != 0 AS descriptor, ((o_orderkey % 65536) >> 8)::INT AS host_os, (30 + o_orderkey % 97 + o_orderkey % 13)::BIGINT AS header_size FROM orders")
def header_flags(spark, sf_dir):
    k = F.col("o_orderkey")
    w = (k % 65536).cast("int")
    return D.table(spark, sf_dir, "orders").select("o_orderkey", fields.flag(w, zipscan.UTF8).alias("utf8"), fields.flag(w, zipscan.ENCRYPTED).alias("encrypted"), fields.flag(w, zipscan.DESCRIPTOR).alias("descriptor"), fields.host_os(w).alias("host_os"), fields.header_size(k % 97, k % 13).alias("header_size"))


@query(f"WITH {D.LAYOUT} SELECT doc_id, CASE WHEN size = 0 THEN 0 ELSE round_even((1.0::DOUBLE - compressed_size::DOUBLE / size) * 100, 1) END::DOUBLE AS ratio FROM layout")
def compression_ratio(spark, sf_dir):
    return D.layout(spark, sf_dir).select("doc_id", fields.compression_ratio(F.col("compressed_size"), F.col("size")).alias("ratio"))


_SIZES = "sizes AS (SELECT o_orderkey, (o_totalprice * o_totalprice / 20)::BIGINT AS size FROM orders)"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * F.col("o_totalprice") / 20).cast("long").alias("size"))


@query(f"WITH {_SIZES} SELECT o_orderkey, CASE WHEN size < 1024 THEN 'tiny' WHEN size < 1048576 THEN 'small' WHEN size < 10485760 THEN 'medium' WHEN size < 52428800 THEN 'large' WHEN size < 524288000 THEN 'xlarge' ELSE 'huge' END AS bucket FROM sizes")
def size_bucket(spark, sf_dir):
    return _sizes(spark, sf_dir).select("o_orderkey", fields.size_bucket(F.col("size")).alias("bucket"))


@query(f"WITH {_SIZES} SELECT CASE WHEN size < 52428800 THEN 'memory' ELSE 'disk' END AS tier, count(*)::BIGINT AS n, sum(size)::BIGINT AS bytes FROM sizes GROUP BY 1")
def tier_route(spark, sf_dir):
    return _sizes(spark, sf_dir).groupBy(fields.tier(F.col("size")).alias("tier")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(f"WITH {D.LAYOUT} SELECT doc_id, k::BIGINT AS chunk_index, (k * 1000)::BIGINT AS chunk_offset, least(1000, size - k * 1000)::BIGINT AS chunk_length, (k * 1000 // 1000)::BIGINT AS index_of_offset FROM layout, generate_series(0, 100000) g(k) WHERE k < ceil(size / 1000.0)")
def chunk_layout(spark, sf_dir):
    n = fields.chunk_count(F.col("size"), 1000)
    d = D.layout(spark, sf_dir).where("size > 0").withColumn("chunk_index", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    at = F.col("chunk_index") * 1000
    return d.select("doc_id", "chunk_index", at.alias("chunk_offset"), fields.chunk_length(F.col("chunk_index"), F.col("size"), 1000).alias("chunk_length"), fields.chunk_index(at, 1000).alias("index_of_offset"))


@query("SELECT doc_id, greatest(0, least(300, strlen(coalesce(text, '')) - doc_id % 500))::BIGINT AS n_read, sha256(CASE WHEN doc_id % 500 < strlen(coalesce(text, '')) THEN from_hex(substr(hex(coalesce(text, '')), 2 * (doc_id % 500)::INT + 1, 600)) ELSE ''::BLOB END) AS sha256 FROM documents")
def range_read(spark, sf_dir):
    b = F.coalesce("text", F.lit("")).cast("binary")
    at, n = F.col("doc_id") % 500, F.lit(300)
    return D.table(spark, sf_dir, "documents").select("doc_id", fields.clamped(F.octet_length(b).cast("long"), at, n.cast("long")).alias("n_read"), F.sha2(fields.read_range(b, at, n), 256).alias("sha256"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, ''))::BIGINT AS size FROM documents")
def content_sha256(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return D.table(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("sha256"), F.octet_length(t).cast("long").alias("size"))


@query(f"WITH {D.LAYOUT} SELECT doc_id, round(CASE WHEN size = 0 THEN 1.0 ELSE least(size, doc_id * 10)::DOUBLE / size END, 9) AS progress, substr('corpus/' || archive_key, 8) AS relative, archive_key || ' (NOT SUPPORTED)' AS shown FROM layout")
def extraction_progress(spark, sf_dir):
    size, key = F.col("size"), F.col("archive_key")
    return D.layout(spark, sf_dir).select(
        "doc_id", F.round(fields.progress(F.least(size, F.col("doc_id") * 10), size), 9).alias("progress"),
        paths.relative(F.concat(F.lit("C:\\corpus\\"), key), F.lit("C:/corpus/")).alias("relative"), paths.unsupported_name(key).alias("shown"),
    )


# Reading ahead

_NEAR = f"""{D.TRIGGERS}, found AS (SELECT l.*, t.trigger_offset FROM layout l JOIN triggers t ON l.archive_key = t.archive_key AND regexp_replace(l.internal_path, '/[^/]*$', '') = t.directory WHERE l.size <= 20000),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive_key, trigger_offset ORDER BY abs("offset" - trigger_offset), "offset") AS r FROM found) WHERE r <= 30 AND "offset" != trigger_offset),
placed AS (SELECT *, row_number() OVER w - 1 AS place, count(*) OVER p AS n, sum(("offset" < trigger_offset)::INT) OVER p AS pos FROM near WINDOW p AS (PARTITION BY archive_key, trigger_offset), w AS (PARTITION BY archive_key, trigger_offset ORDER BY "offset")),
bound AS (SELECT *, least(n, greatest(0, least(pos, n - 1) - 5) + 10) AS e FROM placed),
win AS (SELECT archive_key, internal_path, trigger_offset, "offset", compressed_size FROM bound WHERE place >= greatest(0, e - 10) AND place < e)"""


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.layout(spark, sf_dir)
    return planning.nearest(d, D.triggers(d), 20000, 30)


def _window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.centered(_near(spark, sf_dir).where("offset != trigger_offset"), 10)


@query(f"WITH {D.LAYOUT} SELECT archive_key, regexp_replace(internal_path, '/[^/]*$', '') AS directory, internal_path, \"offset\" FROM layout WHERE size <= 20000")
def prefetch_candidates(spark, sf_dir):
    return planning.candidates(D.layout(spark, sf_dir), 20000).select("archive_key", "directory", "internal_path", "offset")


@query(f'WITH {_NEAR} SELECT archive_key, trigger_offset, "offset", r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY archive_key, trigger_offset ORDER BY abs("offset" - trigger_offset), "offset") AS r FROM found) WHERE r <= 30')
def nearest_k_offsets(spark, sf_dir):
    return _near(spark, sf_dir).select("archive_key", "trigger_offset", "offset", "rank")


@query(f'WITH {_NEAR} SELECT archive_key, trigger_offset, "offset", compressed_size FROM win')
def span_window(spark, sf_dir):
    return _window(spark, sf_dir).select("archive_key", "trigger_offset", "offset", "compressed_size")


@query(f"""WITH RECURSIVE {_NEAR}, w AS (SELECT archive_key, trigger_offset, list("offset" ORDER BY "offset") AS o, list(compressed_size ORDER BY "offset") AS c FROM win GROUP BY 1, 2),
step AS (SELECT *, 1 AS lo, len(o) AS hi FROM w UNION ALL SELECT archive_key, trigger_offset, o, c, CASE WHEN first >= last THEN lo + 1 ELSE lo END, CASE WHEN first >= last THEN hi ELSE hi - 1 END FROM (SELECT *,
 CASE WHEN o[hi] + c[hi] - o[lo] <= 0 THEN 1.0 ELSE list_sum(c[lo:hi])::DOUBLE / (o[hi] + c[hi] - o[lo]) END AS now, CASE WHEN o[hi] + c[hi] - o[lo + 1] <= 0 THEN 1.0 ELSE list_sum(c[lo + 1:hi])::DOUBLE / (o[hi] + c[hi] - o[lo + 1]) END AS first,
 CASE WHEN o[hi - 1] + c[hi - 1] - o[lo] <= 0 THEN 1.0 ELSE list_sum(c[lo:hi - 1])::DOUBLE / (o[hi - 1] + c[hi - 1] - o[lo]) END AS last FROM step) WHERE hi > lo AND now < 0.8)
SELECT archive_key, trigger_offset, (hi - lo + 1)::INT AS n, o[lo] AS span_start, o[hi] + c[hi] AS span_end FROM (SELECT *, row_number() OVER (PARTITION BY archive_key, trigger_offset ORDER BY hi - lo) AS k FROM step) WHERE k = 1""")
def span_shrink(spark, sf_dir):
    return planning.shrunk(_window(spark, sf_dir), 0.8).select("archive_key", "trigger_offset", F.size("plan").alias("n"), "span_start", "span_end")


@query(f'WITH {_NEAR} SELECT archive_key, trigger_offset, round(CASE WHEN max("offset") + arg_max(compressed_size, "offset") - min("offset") <= 0 THEN 1.0 ELSE sum(compressed_size)::DOUBLE / (max("offset") + arg_max(compressed_size, "offset") - min("offset")) END, 9) AS fill_ratio FROM win GROUP BY 1, 2')
def fill_ratio(spark, sf_dir):
    return planning.fill_ratio(_window(spark, sf_dir)).withColumn("fill_ratio", F.round("fill_ratio", 9))


@query(f"WITH {_NEAR} SELECT archive_key, trigger_offset, internal_path FROM win WHERE compressed_size % 3 != 0")
def not_cached(spark, sf_dir):
    w = _window(spark, sf_dir)
    return planning.still_wanted(w, w.where("compressed_size % 3 = 0").select("archive_key", "internal_path")).select("archive_key", "trigger_offset", "internal_path")


@query(f"""WITH {D.LAYOUT}, asked AS (SELECT DISTINCT size AS ask FROM layout) SELECT ask, archive_key, "offset" FROM (SELECT ask, l.*, row_number() OVER (PARTITION BY ask ORDER BY "offset", archive_key) AS k FROM asked JOIN layout l ON l.size = ask AND l.doc_id % 2 = ask % 2) WHERE k = 1""")
def trigger_by_stat(spark, sf_dir):
    d = D.layout(spark, sf_dir).withColumn("modified", F.col("doc_id") % 2)
    asked = d.select(F.col("size").alias("ask"), "size", (F.col("size") % 2).alias("modified")).distinct()
    return planning.trigger_by_stat(d, asked).select("ask", "archive_key", "offset")


# Changes

_FOLD = """folded AS (SELECT {keys}, n, 1 AS k, CASE WHEN ops[1] = 'created' THEN 'Added' ELSE 'Removed' END AS kind, ops FROM grouped
UNION ALL SELECT {keys}, n, k + 1, CASE WHEN ops[k + 1] = 'created' THEN CASE WHEN kind = 'Removed' THEN 'Modified' ELSE 'Added' END WHEN kind = 'Added' THEN 'Noop' ELSE 'Removed' END, ops FROM folded WHERE k < n)"""


@query(f"""WITH RECURSIVE {D.EVENTS}, grouped AS (SELECT root, path, count(*) AS n, list(op ORDER BY ts, seq) AS ops FROM changes GROUP BY 1, 2), {_FOLD.format(keys='root, path')}
SELECT root, path, n::BIGINT AS n_events, kind FROM folded WHERE k = n AND kind != 'Noop'""")
def change_fold(spark, sf_dir):
    return changes.changes(D.events(spark, sf_dir), ["root", "path"]).select("root", "path", "n_events", "kind")


_BATCHES = f"""{D.EVENTS}, marked AS (SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL 5 SECOND, true) AS new FROM changes WINDOW w AS (PARTITION BY root ORDER BY ts, seq)),
batched AS (SELECT *, max(CASE WHEN new THEN ts END) OVER (PARTITION BY root ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS batch FROM marked)"""


@query(f"WITH {_BATCHES} SELECT root, batch, count(*)::BIGINT AS n, max(ts) AS last FROM batched GROUP BY 1, 2")
def change_sessions(spark, sf_dir):
    return changes.batches(D.events(spark, sf_dir)).groupBy("root", "batch").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


@query(f"""WITH RECURSIVE {_BATCHES}, grouped AS (SELECT root, batch, path, count(*) AS n, list(op ORDER BY ts, seq) AS ops FROM batched GROUP BY 1, 2, 3), {_FOLD.format(keys='root, batch, path')}
SELECT root, batch AS session_start, path, kind FROM folded WHERE k = n AND kind != 'Noop'""")
def session_deltas(spark, sf_dir):
    """The streaming form's logic on a static table."""
    return consolidate.deltas(consolidate.sessions(D.events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query(f"""WITH RECURSIVE {D.EVENTS}, grouped AS (SELECT root, path, count(*) AS n, list(op ORDER BY ts, seq) AS ops FROM changes GROUP BY 1, 2), {_FOLD.format(keys='root, path')}
SELECT kind, count(*)::BIGINT AS n, min(root || '/' || path) AS first_path FROM folded WHERE k = n AND kind != 'Noop' GROUP BY 1""")
def delta_lists(spark, sf_dir):
    c = changes.changes(D.events(spark, sf_dir), ["root", "path"]).withColumn("path", F.concat_ws("/", "root", "path"))
    return changes.delta(c).groupBy("kind").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


@query("""WITH r AS (SELECT 'root' AS root, ts, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'a' || user_id || '.zip' END AS o, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'b' || user_id || '.zip' END AS n FROM events WHERE event_type = 'error')
SELECT root, o AS path, 'deleted' AS op, ts, (event_id * 2)::BIGINT AS seq FROM r WHERE o IS NOT NULL UNION ALL SELECT root, n, 'created', ts, (event_id * 2 + 1)::BIGINT FROM r WHERE n IS NOT NULL""")
def rename_events(spark, sf_dir):
    e, u = D.table(spark, sf_dir, "events").where("event_type = 'error'"), F.col("user_id").cast("string")
    return changes.renamed(e.select(F.lit("root").alias("root"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("a"), u, F.lit(".zip"))).alias("old_path"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("b"), u, F.lit(".zip"))).alias("new_path"), "ts", F.col("event_id").alias("seq")))


@query(f"""WITH RECURSIVE {D.ARCHIVES}, c AS (SELECT virtual_path AS path, CASE size_bytes % 4 WHEN 0 THEN 'Added' WHEN 1 THEN 'Removed' WHEN 2 THEN 'Modified' END AS kind FROM archives)
SELECT virtual_path, CASE size_bytes % 4 WHEN 3 THEN size_bytes ELSE size_bytes + 7 END::BIGINT AS size_bytes FROM archives WHERE size_bytes % 4 != 1""")
def apply_delta(spark, sf_dir):
    a, k = D.archives(spark, sf_dir).select("virtual_path", "size_bytes"), F.col("size_bytes") % 4
    c = a.select(F.col("virtual_path").alias("path"), F.when(k == 0, "Added").when(k == 1, "Removed").when(k == 2, "Modified").alias("kind")).where("kind IS NOT NULL")
    return changes.applied(a.where("size_bytes % 4 != 0"), c, a.withColumn("size_bytes", F.col("size_bytes") + 7))


# Caches

_NEEDS = """needs AS (SELECT cache, sum(size)::BIGINT AS current, (sum(size) * 4 // 5)::BIGINT AS capacity, 1000::BIGINT AS required FROM cache_entries GROUP BY 1)"""


@query(f"""WITH {D.CACHE_ENTRIES}, {_NEEDS}, f AS (SELECT e.cache, e.key, e.size, coalesce(sum(e.size) OVER (PARTITION BY e.cache ORDER BY last_access, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, required - (capacity - current) AS need FROM cache_entries e JOIN needs USING (cache) WHERE borrowed = 0)
SELECT cache, key, size FROM f WHERE freed < need""")
def lru_victims(spark, sf_dir):
    e = D.cache_entries(spark, sf_dir)
    needs = e.groupBy("cache").agg(F.sum("size").alias("current")).withColumns({"capacity": F.floor(F.col("current") * 4 / 5), "required": F.lit(1000)})
    return caching.lru_victims(e, needs).select("cache", "key", "size")


@query(f"WITH {D.CACHE_ENTRIES}, n AS (SELECT max(ts) AS now FROM events) SELECT cache, key FROM cache_entries, n WHERE now > created + INTERVAL 864000 SECOND AND borrowed = 0")
def expired_entries(spark, sf_dir):
    e = D.cache_entries(spark, sf_dir)
    now = D.table(spark, sf_dir, "events").agg(F.max("ts").cast("string")).first()[0]  # one row
    return caching.expired(e, now).select("cache", "key")


@query(f"WITH {D.ACCESS_LOG}, f AS (SELECT cache, count(*) - count(DISTINCT key) AS hits, count(DISTINCT key) AS misses FROM access_log GROUP BY 1) SELECT cache, hits::BIGINT AS hits, misses::BIGINT AS misses, round(hits::DOUBLE / (hits + misses), 9) AS hit_rate FROM f")
def hit_rate(spark, sf_dir):
    g = D.access_log(spark, sf_dir).groupBy("cache", "key").agg(F.count("*").alias("n")).groupBy("cache").agg((F.sum("n") - F.count("*")).alias("hits"), F.count("*").alias("misses"))
    return g.withColumn("hit_rate", F.round(fields.hit_rate(F.col("hits"), F.col("misses")), 9))


@query(f"WITH {D.ACCESS_LOG}, f AS (SELECT cache, count(*) - count(DISTINCT key) AS h, count(DISTINCT key) AS m FROM access_log GROUP BY 1) SELECT round(sum(h::DOUBLE / (h + m) * m) / sum(m), 9) AS hit_rate FROM f")
def two_tier_hit_rate(spark, sf_dir):
    g = hit_rate(spark, sf_dir).select("hits", "misses", F.col("misses").alias("n_entries"))
    return caching.two_tier_hit_rate(g).withColumn("hit_rate", F.round("hit_rate", 9))


@query(f"WITH {D.CACHE_ENTRIES} SELECT cache, count(*)::BIGINT AS n_entries, count_if(borrowed > 0)::BIGINT AS n_borrowed, sum(size)::BIGINT AS bytes, round(sum(size)::DOUBLE / 1000000, 9) AS utilisation FROM cache_entries GROUP BY 1")
def cache_gauges(spark, sf_dir):
    return caching.gauges(D.cache_entries(spark, sf_dir), 1_000_000).withColumn("utilisation", F.round("utilisation", 9))


@query(f"WITH {D.CACHE_ENTRIES} SELECT regexp_extract(key, '^([^:]*)', 1) AS archive_key, count(DISTINCT key)::BIGINT AS n_keys, min(key) AS first_key FROM cache_entries GROUP BY 1")
def cached_keys(spark, sf_dir):
    return caching.cached_keys(D.cache_entries(spark, sf_dir)).select("archive_key", "n_keys", F.element_at("keys", 1).alias("first_key"))


@query(f"WITH {D.CACHE_ENTRIES} SELECT cache, key FROM cache_entries WHERE regexp_extract(key, '^([^:]*)', 1) NOT IN ('click', 'view')")
def invalidate_archives(spark, sf_dir):
    gone = spark.createDataFrame([("click",), ("view",)], "archive_key string")
    return caching.without_archives(D.cache_entries(spark, sf_dir), gone).select("cache", "key")


@query("SELECT event_type, user_id % 3 AS tier, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def cache_counters(spark, sf_dir):
    return caching.counters(D.table(spark, sf_dir, "events").withColumn("tier", F.col("user_id") % 3), "event_type", "tier")


@query("SELECT event_type, CASE WHEN value <= 10 THEN 10.0 WHEN value <= 50 THEN 50.0 WHEN value <= 100 THEN 100.0 END::DOUBLE AS upto, count(*)::BIGINT AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def latency_histogram(spark, sf_dir):
    return caching.histogram(D.table(spark, sf_dir, "events"), "event_type", "value", [10, 50, 100])


@query(f"WITH {D.CACHE_ENTRIES}, n AS (SELECT max(ts) AS now FROM events) SELECT cache, key FROM cache_entries, n WHERE now > created + INTERVAL 864000 SECOND AND borrowed = 0 ORDER BY created, key LIMIT 20")
def maintenance_sweep(spark, sf_dir):
    now = D.table(spark, sf_dir, "events").agg(F.max("ts").cast("string")).first()[0]  # one row
    return caching.swept(D.cache_entries(spark, sf_dir), now, 20).select("cache", "key")


@query()
def cache_simulation(spark, sf_dir):
    log = D.access_log(spark, sf_dir).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return caching.simulated(log, 200_000, 3600.0)


@query("SELECT event_type, count(*)::BIGINT AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    p = caching.percentiles(D.table(spark, sf_dir, "events"), "event_type", "value")
    return p.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "max")])


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('0:' || event_id)) AS k FROM events) WHERE k <= 100")
def reservoir_sample(spark, sf_dir):
    return caching.reservoir(D.table(spark, sf_dir, "events"), "event_type", "event_id", 100).select("event_type", "event_id")


# Archives in bytes


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archive_key and content: every archive of pages as a ZIP file, made where its pages are."""

    def build(key, pdf):
        import pandas as pd

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for r in pdf.sort_values("page_id").itertuples():
                z.writestr(zipfile.ZipInfo(r.internal_path, (2024, 2, 29, 12, 30, 58)), r.html or "", zipfile.ZIP_DEFLATED if r.page_id % 2 else zipfile.ZIP_STORED)
        return pd.DataFrame({"archive_key": [key[0]], "content": [out.getvalue()]})

    p = D.page_entries(spark, sf_dir).join(D.table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return p.select("page_id", "archive_key", "internal_path", "html").groupBy("archive_key").applyInPandas(build, "archive_key string, content binary")


@query(f"WITH {D.PAGE_ENTRIES} SELECT archive_key, internal_path, is_directory, size, TIMESTAMP '2024-02-29 12:30:58' AS modified, false AS encrypted, (CASE WHEN page_id % 2 = 1 THEN 8 ELSE 0 END)::INT AS method FROM page_entries")
def zip_scan_roundtrip(spark, sf_dir):
    return zipscan.entries(packed(spark, sf_dir)).select("archive_key", "internal_path", "is_directory", "size", "modified", "encrypted", "method")


@query(f"WITH {D.PAGE_ENTRIES} SELECT e.archive_key, e.internal_path, sha256(coalesce(p.html, '')) AS sha256, NULL::VARCHAR AS error FROM page_entries e JOIN pages p USING (page_id)")
def zip_extract(spark, sf_dir):
    files = packed(spark, sf_dir)
    wanted = zipscan.entries(files).withColumns({"read_at": F.lit(None).cast("long"), "read_length": F.lit(None).cast("long")})
    return zipscan.extracted(files, wanted, verify=True).select("archive_key", "internal_path", F.sha2("data", 256).alias("sha256"), "error")


@query(f"WITH {D.PAGE_ENTRIES} SELECT e.archive_key, e.internal_path, sha256(from_hex(substr(hex(coalesce(p.html, '')), 201, 1000))) AS sha256 FROM page_entries e JOIN pages p USING (page_id)")
def zip_read_range(spark, sf_dir):
    files = packed(spark, sf_dir)
    wanted = zipscan.entries(files).withColumns({"read_at": F.lit(100).cast("long"), "read_length": F.lit(500).cast("long")})
    return zipscan.extracted(files, wanted).select("archive_key", "internal_path", F.sha2("data", 256).alias("sha256"))


def _vint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _rar(files: list[tuple[str, bytes]], five: bool) -> bytes:
    """A RAR archive of stored files, in the format of either version, without checksums of its headers."""
    if not five:
        out = bytearray(rarscan.RAR4 + struct.pack("<HBHHHL", 0, 0x73, 0, 13, 0, 0))
        for name, data in files:
            n = name.encode()
            out += struct.pack("<HBHH", 0, 0x74, 0x8000, 32 + len(n)) + struct.pack("<LLBLLBBHL", len(data), len(data), 3, zlib.crc32(data), 0, 20, 0x30, len(n), 0) + n + data
        return bytes(out)
    block = lambda body, data=b"": bytes(4) + _vint(len(body)) + body + data
    out = bytearray(rarscan.RAR5 + block(_vint(1) + _vint(0) + _vint(0)))
    for name, data in files:
        n = name.encode()
        out += block(_vint(2) + _vint(2) + _vint(len(data)) + _vint(4) + _vint(len(data)) + _vint(32) + struct.pack("<L", zlib.crc32(data)) + _vint(0) + _vint(1) + _vint(len(n)) + n, data)
    return bytes(out)


def packed_rar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archive_key and content: every archive of pages as a RAR file, of version 5 or 4 by the length of its key."""

    def build(key, pdf):
        import pandas as pd

        files = [(r.internal_path, (r.html or "").encode()) for r in pdf.sort_values("page_id").itertuples()]
        return pd.DataFrame({"archive_key": [key[0]], "content": [_rar(files, len(key[0]) % 2 == 1)]})

    p = D.page_entries(spark, sf_dir).join(D.table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return p.select("page_id", "archive_key", "internal_path", "html").groupBy("archive_key").applyInPandas(build, "archive_key string, content binary")


@query(f"WITH {D.PAGE_ENTRIES} SELECT archive_key, internal_path, is_directory, size, size AS compressed_size, true AS stored, NULL::VARCHAR AS error, CASE WHEN length(archive_key) % 2 = 1 THEN 5 ELSE 4 END::INT AS version FROM page_entries")
def rar_scan(spark, sf_dir):
    files = packed_rar(spark, sf_dir)
    e = rarscan.entries(files).join(files.select("archive_key", rarscan.version(F.col("content")).alias("version")), "archive_key")
    return e.select("archive_key", "internal_path", "is_directory", "size", "compressed_size", "stored", "error", "version")


@query(f"WITH {D.PAGE_ENTRIES} SELECT e.archive_key, e.internal_path, sha256(coalesce(p.html, '')) AS sha256, NULL::VARCHAR AS error FROM page_entries e JOIN pages p USING (page_id)")
def rar_extract(spark, sf_dir):
    files = packed_rar(spark, sf_dir)
    wanted = rarscan.entries(files).withColumns({"read_at": F.lit(None).cast("long"), "read_length": F.lit(None).cast("long")})
    return registry.RAR.read(files, wanted).select("archive_key", "internal_path", F.sha2("data", 256).alias("sha256"), "error")


@query(f"WITH {D.PAGE_ENTRIES} SELECT e.archive_key, e.internal_path, sha256(coalesce(p.html, '')) AS sha256, NULL::VARCHAR AS error FROM page_entries e JOIN pages p USING (page_id)")
def prefetch_read(spark, sf_dir):
    """Every file of every archive, read by spans: one sequential read a span, from which its entries are taken and the holes dropped."""
    files = packed(spark, sf_dir)
    return zipscan.read_spans(files, zipscan.entries(files), 16_384).select("archive_key", "internal_path", F.sha2("data", 256).alias("sha256"), "error")
