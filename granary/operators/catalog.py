"""The catalog: archives by virtual path, entries by archive and internal path. All are joins on equal keys.

archives: virtual_path, size_bytes, format_id and what else they carry. entries: archive_key, internal_path (directories end
in a slash), is_directory, size. requests: path (normalised) and what else they carry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import fields, paths


def virtual_folders(archives: DataFrame) -> DataFrame:
    """Every proper ancestor of an archive: folder."""
    return archives.select(F.explode(paths.prefixes(F.col("virtual_path"), whole=False)).alias("folder")).distinct()


def resolve(requests: DataFrame, archives: DataFrame, ignore_case: bool = True) -> DataFrame:
    """requests with status, archive, internal_path and virtual_folder, by the longest archive path that is a prefix at a segment.

    Each distinct path is split into its prefixes, which are looked up by equality, so no row meets another but its own key's.
    """
    fold = lambda c: paths.fold(F.col(c), ignore_case)
    asked = requests.select("path").distinct()
    known = archives.select(F.col("virtual_path").alias("archive"), fold("virtual_path").alias("key"))
    hits = asked.select("path", F.explode(paths.prefixes(F.col("path"))).alias("prefix")).withColumn("key", fold("prefix")).join(known, "key")
    best = hits.groupBy("path").agg(F.max_by("archive", F.struct(F.length("prefix"), "archive")).alias("archive"), F.max(F.length("prefix")).alias("n"))
    folders = virtual_folders(archives).select(fold("folder").alias("key"), F.col("folder").alias("virtual_folder")).groupBy("key").agg(F.min("virtual_folder").alias("virtual_folder"))
    found = asked.join(best, "path", "left").withColumn("key", fold("path")).join(folders, "key", "left")
    rest = F.expr("substring(path, n + 2)")
    found = found.select(
        "path",
        F.when(F.col("path") == "", "VirtualRoot").when(F.col("archive").isNotNull() & (rest == ""), "ArchiveRoot").when(F.col("archive").isNotNull(), "InsideArchive")
        .when(F.col("virtual_folder").isNotNull(), "VirtualFolder").otherwise("NotFound").alias("status"),
        F.when(F.col("path") != "", F.col("archive")).alias("archive"),
        F.when(F.col("archive").isNotNull(), rest).otherwise("").alias("internal_path"),
        F.when(F.col("archive").isNull(), F.col("virtual_folder")).alias("virtual_folder"),
    )
    return requests.join(found, "path")


def list_folders(archives: DataFrame) -> DataFrame:
    """Children of every virtual folder: folder ('' is the root), name, is_archive, archive. Names that differ in case are one; the
    least spelling stands for them."""
    parts = F.split("virtual_path", "/")
    up = archives.select("virtual_path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"), parts.alias("parts"))
    up = up.select(
        F.array_join(F.slice("parts", F.lit(1), F.col("k") - 1), "/").alias("folder"), F.element_at("parts", F.col("k")).alias("name"),
        (F.col("k") == F.size("parts")).alias("is_archive"), F.when(F.col("k") == F.size("parts"), F.col("virtual_path")).alias("archive"),
    )
    key = [paths.fold(F.col("folder")).alias("f"), paths.fold(F.col("name")).alias("n")]
    got = up.groupBy(*key).agg(F.min("folder").alias("folder"), F.min("name").alias("name"), F.max("is_archive").alias("is_archive"), F.min("archive").alias("archive"))
    return got.select("folder", "name", "is_archive", "archive")


def last_written(entries: DataFrame, order: str) -> DataFrame:
    """One entry for each archive and path: that with the greatest order."""
    rank = F.row_number().over(Window.partitionBy("archive_key", "internal_path").orderBy(F.desc(order)))
    return entries.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def with_parents(entries: DataFrame, attribute: int = fields.DIRECTORY, modified: str = fields.MIN_TIME, order: str | None = None) -> DataFrame:
    """archive_key, internal_path, is_directory, size, attributes, synthesized, and compressed_size if entries have it: entries and all
    their missing ancestors.

    With order (compatible mode), an ancestor is made only from files, and only as far up as no directory entry with a smaller
    order is on the way.
    """
    packed = ["compressed_size"] * ("compressed_size" in entries.columns)
    base = entries.select("archive_key", "internal_path", "is_directory", "size", *packed, *([order] if order else []))
    bare = F.regexp_replace("internal_path", "/$", "")
    up = base.where("NOT is_directory") if order else base
    up = up.withColumn("dir", F.explode(paths.prefixes(bare, whole=False))).withColumn("dir", F.concat("dir", F.lit("/")))
    own = base.where("is_directory").select("archive_key", F.col("internal_path").alias("dir"), *([F.col(order).alias("_at")] if order else []))
    if order:
        far = Window.partitionBy("archive_key", "internal_path")
        up = up.join(own, ["archive_key", "dir"], "left")
        up = up.withColumn("_stop", F.coalesce(F.max(F.when(F.col("_at") < F.col(order), F.length("dir"))).over(far), F.lit(0))).where(F.length("dir") > F.col("_stop"))
    made = up.select("archive_key", "dir").distinct().join(own.select("archive_key", "dir").distinct(), ["archive_key", "dir"], "left_anti")
    made = made.select("archive_key", F.col("dir").alias("internal_path"), F.lit(True).alias("is_directory"), F.lit(0).cast("long").alias("size"), F.lit(attribute).alias("attributes"), F.lit(True).alias("synthesized"), *[F.lit(0).cast("long").alias(c) for c in packed])
    kept = base.select("archive_key", "internal_path", "is_directory", "size", F.when(F.col("is_directory"), attribute).otherwise(fields.NORMAL).alias("attributes"), F.lit(False).alias("synthesized"), *packed)
    return kept.unionByName(made)


def children(entries: DataFrame) -> DataFrame:
    """Every entry under its directory: archive_key, directory ('' is the top), name, full_path, is_directory, size (0 for directories)."""
    return entries.select(
        "archive_key", paths.directory_of(F.col("internal_path")).alias("directory"), paths.last_segment(F.col("internal_path")).alias("name"),
        F.concat_ws("/", "archive_key", F.regexp_replace("internal_path", "/$", "")).alias("full_path"), "is_directory",
        F.when(F.col("is_directory"), 0).otherwise(F.col("size")).cast("long").alias("size"),
    )


def lookup(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """requests (archive_key, internal_path) with the entry at the path, or else at the path with a slash: found_path, is_directory, size."""
    e = entries.select("archive_key", F.regexp_replace("internal_path", "/$", "").alias("bare"), F.struct(F.endswith("internal_path", F.lit("/")).alias("slash"), "internal_path", "is_directory", "size").alias("e"))
    e = e.groupBy("archive_key", "bare").agg(F.min("e").alias("file"), F.max("e").alias("dir"))
    r = requests.withColumn("bare", F.regexp_replace("internal_path", "/$", "")).join(e, ["archive_key", "bare"], "left")
    asks = F.endswith("internal_path", F.lit("/"))
    pick = F.when(asks & F.col("dir.slash"), F.col("dir")).when(~asks, F.col("file"))
    return r.withColumn("_e", pick).select(*requests.columns, F.col("_e.internal_path").alias("found_path"), F.col("_e.is_directory").alias("found_directory"), F.col("_e.size").alias("found_size"))


def files_that_exist(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """requests whose exact path is a file."""
    return requests.join(entries.where("NOT is_directory").select("archive_key", "internal_path").distinct(), ["archive_key", "internal_path"], "left_semi")


def directories_that_exist(resolved: DataFrame, entries: DataFrame) -> DataFrame:
    """resolved requests that are the root, a folder, an archive or a directory in one."""
    dirs = entries.where("is_directory").select(F.col("archive_key").alias("archive"), F.regexp_replace("internal_path", "/$", "").alias("internal_path"), F.lit(True).alias("_dir")).distinct()
    r = resolved.withColumn("_plain", F.regexp_replace("internal_path", "/$", ""))
    r = r.join(dirs.withColumnRenamed("internal_path", "_plain"), ["archive", "_plain"], "left")
    return r.where((F.col("status").isin("VirtualRoot", "VirtualFolder", "ArchiveRoot")) | (F.col("status") == "InsideArchive") & F.coalesce("_dir", F.lit(False))).select(resolved.columns)


def file_info(resolved: DataFrame, archives: DataFrame, entries: DataFrame) -> DataFrame:
    """name, full_path, is_directory, size for every resolved request that exists."""
    r = resolved.join(archives.select(F.col("virtual_path").alias("archive"), "size_bytes"), "archive", "left")
    r = lookup(r.withColumnRenamed("archive", "archive_key"), entries)
    inside = F.col("status") == "InsideArchive"
    r = r.where((F.col("status") != "NotFound") & (~inside | F.col("found_path").isNotNull()))
    size = F.when(inside & ~F.col("found_directory"), F.col("found_size")).when(F.col("status") == "ArchiveRoot", F.col("size_bytes")).otherwise(0)
    return r.select("path", "status", F.when(F.col("path") == "", "").otherwise(paths.last_segment(F.col("path"))).alias("name"), F.when(inside, F.col("found_directory")).otherwise(True).alias("is_directory"), size.cast("long").alias("size"))


def volume(archives: DataFrame, label: str) -> DataFrame:
    return archives.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("total_bytes")).select(
        paths.volume_label(F.lit(label)).alias("volume_label"), F.lit("NTFS").alias("file_system"), "total_bytes", F.lit(0).cast("long").alias("free_bytes"), F.lit(True).alias("read_only"))


def totals(entries: DataFrame, format_id: str = "zip") -> DataFrame:
    """Per archive: entries (synthesized ones too), bytes of files, unpacked and (if entries tell) packed, estimated memory."""
    total = lambda c: F.coalesce(F.sum(F.when(~F.col("is_directory"), F.col(c))), F.lit(0)).cast("long")
    sums = [total("size").alias("total_uncompressed")] + [total("compressed_size").alias("total_compressed")] * ("compressed_size" in entries.columns)
    return entries.groupBy("archive_key").agg(
        F.count("*").alias("n_entries"), *sums
    ).withColumn("memory_bytes", fields.structure_bytes(F.col("n_entries"), F.lit(format_id)))


def add(archives: DataFrame, new: DataFrame, hide_unsupported: bool = True) -> DataFrame:
    """archives with new ones (supported tells which can be read). The last of one path wins; unsupported ones are hidden, or kept under
    a name that says so, without bytes."""
    new = new.where("supported") if hide_unsupported else new.withColumns({"virtual_path": F.when(F.col("supported"), F.col("virtual_path")).otherwise(paths.unsupported_name(F.col("virtual_path"))), "size_bytes": F.when(F.col("supported"), F.col("size_bytes")).otherwise(0)})
    both = archives.withColumn("_new", F.lit(0)).unionByName(new.drop("supported").withColumn("_new", F.lit(1)))
    last = Window.partitionBy(paths.fold(F.col("virtual_path"))).orderBy(F.desc("_new"))
    return both.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "_new")


def remove(archives: DataFrame, gone: DataFrame) -> DataFrame:
    keys = gone.select(paths.fold(F.col("virtual_path")).alias("_key")).distinct()
    return archives.withColumn("_key", paths.fold(F.col("virtual_path"))).join(keys, "_key", "left_anti").drop("_key")


def reconcile(memory: DataFrame, disk: DataFrame) -> DataFrame:
    """virtual_path and action: remove what only memory has, add what only the disk has; case is ignored."""
    side = lambda df, n: df.select(paths.fold(F.col("virtual_path")).alias("key"), F.col("virtual_path").alias(n)).groupBy("key").agg(F.min(n).alias(n))
    both = side(memory, "m").join(side(disk, "d"), "key", "full_outer").where("m IS NULL OR d IS NULL")
    return both.select(F.coalesce("m", "d").alias("virtual_path"), F.when(F.col("d").isNull(), "remove").otherwise("add").alias("action"))
