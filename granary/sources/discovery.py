"""Archives found below a folder, by listing alone: contents are not read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import paths

LEAST_DEPTH, MOST_DEPTH = 1, 6


def discover(spark: SparkSession, root: str, most_depth: int = MOST_DEPTH, pattern: str = "*.[zZrR][iIaA][pPrR]") -> DataFrame:
    """archives below root: virtual_path, physical_path, size_bytes, modified, format_id. most_depth counts folders from root, which is 1, and
    is held between 1 and 6. A missing root raises; files of other formats are left out. Only path, length and time are asked of the
    source, so Spark doesn't open the files."""
    depth = max(LEAST_DEPTH, min(MOST_DEPTH, most_depth))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length", "modificationTime")
    bare = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")
    found = files.select(
        paths.relative(bare(F.col("path")), bare(F.lit(root))).alias("virtual_path"), F.col("path").alias("physical_path"), F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"), paths.format_of(F.col("path")).alias("format_id"),
    )
    return found.where(F.col("format_id").isNotNull() & (paths.depth(F.col("virtual_path")) < depth))


def describe(spark: SparkSession, root: str, path: str) -> DataFrame:
    """The archive row of one file below root; no row if its format is unknown or it is missing."""
    none = spark.createDataFrame([], "virtual_path string, physical_path string, size_bytes long, modified timestamp, format_id string")
    if not path.lower().endswith((".zip", ".rar")):
        return none
    try:
        files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return none
    name = path[len(root.rstrip("/")) + 1 :] if path.startswith(root.rstrip("/") + "/") else path.rsplit("/", 1)[-1]
    return files.select(F.lit(name).alias("virtual_path"), F.col("path").alias("physical_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), paths.format_of(F.col("path")).alias("format_id"))
