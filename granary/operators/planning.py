"""Plans for reading ahead: which neighbours of an entry to read with it in one pass, as DataFrame expressions.

layout: archive_key, internal_path, is_directory, offset (of the local header), compressed_size, size. triggers: archive_key,
internal_path and trigger_offset of the entries that were read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import paths


def candidates(layout: DataFrame, most_bytes: int) -> DataFrame:
    """The files of at most most_bytes, with their directory: what may be read with any other file of it."""
    return layout.where(~F.col("is_directory") & (F.col("size") <= most_bytes)).withColumn("directory", paths.directory_of(F.col("internal_path")))


def nearest(layout: DataFrame, triggers: DataFrame, most_bytes: int, most_files: int) -> DataFrame:
    """Of each trigger's directory the most_files candidates nearest by offset, the lower first at equal distance, as rows with rank.

    A directory is sorted by offset once, which numbers its files and tells how many stand before each trigger. The files lie in
    chunks of most_files; a trigger meets the chunks around its place, three at most, so no trigger meets its whole directory.
    """
    keys = ["archive_key", "directory"]
    files = candidates(layout, most_bytes)
    columns = [c for c in files.columns if c not in keys]
    asks = triggers.select("archive_key", paths.directory_of(F.col("internal_path")).alias("directory"), "trigger_offset").distinct()
    one = files.select(*keys, F.col("offset").alias("at"), F.struct("offset", *[c for c in columns if c != "offset"]).alias("file"))
    both = one.unionByName(asks.select(*keys, F.col("trigger_offset").alias("at")), allowMissingColumns=True)
    earlier = Window.partitionBy(*keys).orderBy("at", F.col("file").isNotNull(), "file.internal_path").rowsBetween(Window.unboundedPreceding, -1)
    placed = both.withColumn("place", F.coalesce(F.count("file").over(earlier), F.lit(0)))
    chunk = lambda c: F.floor(c / most_files)
    chunks = placed.where("file IS NOT NULL").groupBy(*keys, chunk(F.col("place")).alias("chunk")).agg(F.collect_list("file").alias("files"))  # most_files a row
    place = F.col("place")
    asked = placed.where("file IS NULL").select(*keys, F.col("at").alias("trigger_offset"), F.explode(F.sequence(chunk(F.greatest(place - most_files, F.lit(0))), chunk(place + most_files - 1))).alias("chunk"))
    near = asked.join(chunks, [*keys, "chunk"]).groupBy(*keys, "trigger_offset").agg(F.flatten(F.collect_list("files")).alias("files"))  # three chunks
    by_distance = F.array_sort(F.transform("files", lambda x: F.struct(F.abs(x["offset"] - F.col("trigger_offset")).alias("distance"), x["offset"].alias("lower"), x.alias("file"))))
    out = near.select(*keys, "trigger_offset", F.posexplode(F.slice(by_distance, 1, most_files)).alias("rank", "x"))
    return out.select(*keys, "trigger_offset", (F.col("rank") + 1).alias("rank"), "x.file.*")


def centered(found: DataFrame, most_files: int) -> DataFrame:
    """The window of most_files candidates around the place where the trigger would stand by offset, moved inwards at the ends."""
    w = Window.partitionBy("archive_key", "trigger_offset")
    n = F.count("*").over(w)
    d = found.withColumns({"place": F.row_number().over(w.orderBy("offset")) - 1, "n": n, "at": F.sum((F.col("offset") < F.col("trigger_offset")).cast("int")).over(w)})
    at = F.greatest(F.lit(0), F.least(F.col("at"), F.col("n") - 1))
    end = F.least(F.col("n"), F.greatest(F.lit(0), at - most_files // 2) + most_files)
    start = F.greatest(F.lit(0), end - most_files)
    return d.where((F.col("place") >= start) & (F.col("place") < end)).drop("place", "n", "at")


def ratio(window: Column, lo: Column, hi: Column) -> Column:
    """Bytes wanted by bytes spanned of window[lo..hi], structs of offset and compressed_size in order of offset; 0 if empty, 1 if no
    bytes are spanned."""
    part = F.slice(window, lo + 1, F.greatest(hi - lo + 1, F.lit(0)))
    useful = F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x["compressed_size"])
    span = F.get(window, hi)["offset"] + F.get(window, hi)["compressed_size"] - F.get(window, lo)["offset"]
    return F.when(lo > hi, 0.0).when(span <= 0, 1.0).otherwise(useful / span)


def shrunk(found: DataFrame, least_ratio: float) -> DataFrame:
    """One row a trigger: the window (array by offset) after dropping ends while less than least_ratio of its span is wanted, the end whose loss
    leaves the better ratio first, the first at a tie; with span_start and span_end."""
    w = found.groupBy("archive_key", "trigger_offset").agg(F.array_sort(F.collect_list(F.struct("offset", "compressed_size"))).alias("w"))  # at most a window
    keep = F.aggregate(
        F.sequence(F.lit(1), F.size("w")),
        F.struct(F.lit(0).alias("lo"), (F.size("w") - 1).alias("hi")),
        lambda a, _: F.when((a["hi"] <= a["lo"]) | (ratio(F.col("w"), a["lo"], a["hi"]) >= least_ratio), a).when(
            ratio(F.col("w"), a["lo"] + 1, a["hi"]) >= ratio(F.col("w"), a["lo"], a["hi"] - 1), F.struct((a["lo"] + 1).alias("lo"), a["hi"].alias("hi"))
        ).otherwise(F.struct(a["lo"].alias("lo"), (a["hi"] - 1).alias("hi"))),
    )
    w = w.withColumn("k", keep).withColumn("w", F.slice("w", F.col("k.lo") + 1, F.col("k.hi") - F.col("k.lo") + 1))
    last = F.element_at("w", -1)
    return w.select("archive_key", "trigger_offset", F.col("w").alias("plan"), F.element_at("w", 1)["offset"].alias("span_start"), (last["offset"] + last["compressed_size"]).alias("span_end"))


def span_plan(layout: DataFrame, triggers: DataFrame, most_bytes: int = 10 * 1024 * 1024, most_listed: int = 300, most_files: int = 20, least_ratio: float = 0.8) -> DataFrame:
    near = nearest(layout, triggers, most_bytes, most_listed).where("offset != trigger_offset")
    return shrunk(centered(near, most_files), least_ratio)


def still_wanted(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """wanted entries without those whose key is cached (archive_key, internal_path)."""
    return wanted.join(cached, ["archive_key", "internal_path"], "left_anti")


def trigger_by_stat(candidates_: DataFrame, asked: DataFrame) -> DataFrame:
    """For asked rows (ask, size, modified) whose path is unknown: the candidate with the same size and time, the first by offset.
    Candidates are reduced to one for each size and time before they meet what is asked."""
    one = candidates_.groupBy("size", "modified").agg(F.min(F.struct("offset", "archive_key")).alias("first"))
    return asked.join(one, ["size", "modified"]).select("ask", "size", "modified", "first.archive_key", "first.offset")


def fill_ratio(found: DataFrame) -> DataFrame:
    """Per trigger: bytes of the window's entries by the bytes from its first to the end of its last."""
    end = F.max_by(F.col("offset") + F.col("compressed_size"), "offset")
    span = end - F.min("offset")
    g = found.groupBy("archive_key", "trigger_offset").agg(F.sum("compressed_size").alias("useful"), span.alias("span"))
    return g.select("archive_key", "trigger_offset", F.when(F.col("span") <= 0, 1.0).otherwise(F.col("useful") / F.col("span")).alias("fill_ratio"))
