"""Shared pieces: scratch tables, block packing and exact cogroups, connected components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary folder of this process if Spark runs in it alone, as in
    tests. A cluster's executors do not see that folder, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="granary-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return "file://" + _own["dir"]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: lineage is cut and a lost executor costs nothing done before."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again, and release()."""
    spark = tables[0].sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(conf).delete(path, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are gone; it learns of those from the JVM's garbage collector,
    which may otherwise not run before the disk is full."""
    gc.collect()
    spark._jvm.System.gc()


def text_bytes(col: Column) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(col, F.lit("")).cast("binary")


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has no more than rows rows; otherwise as it is, so that Spark shuffles the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node that it reaches.

    Alternating large-star and small-star rounds, each an aggregation and a join on the edges, until no edge
    changes. A hub's edges never meet in one row or list; the joins leave AQE to split what is skewed.
    """
    e = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct()
    e = written(e, name)
    last = None
    while True:  # each round lowers labels or changes nothing, so it ends
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("lo < hi").distinct()
        small_least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.join(small_least, large.hi == small_least.u).select(
            F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")))).alias("x")
        ).select("x.lo", "x.hi").where("lo < hi").distinct()
        before, e = e, written(small, name)
        forget(before)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    tops = e.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(tops)
