"""Change events folded to what has changed. events: root, path, op ('created' or 'deleted'), ts, seq (their order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def renamed(events: DataFrame) -> DataFrame:
    """Renames (root, old_path, new_path, ts, seq) as a deletion and then a creation; null sides, which aren't archives, are left out."""
    two = F.array(
        F.struct(F.col("old_path").alias("path"), F.lit("deleted").alias("op"), (F.col("seq") * 2).alias("seq")),
        F.struct(F.col("new_path").alias("path"), F.lit("created").alias("op"), (F.col("seq") * 2 + 1).alias("seq")),
    )
    return events.select("root", "ts", F.explode(two).alias("e")).select("root", "e.path", "e.op", "ts", "e.seq").where("path IS NOT NULL")


def batches(events: DataFrame, quiet_seconds: int = 5) -> DataFrame:
    """events with batch: the start of the run of events of a root without a pause of more than quiet_seconds."""
    w = Window.partitionBy("root").orderBy("ts", "seq")
    pause = F.col("ts").cast("timestamp_ntz") > F.lag("ts").over(w) + F.expr(f"INTERVAL {quiet_seconds} SECONDS")
    marked = events.withColumn("_new", F.coalesce(pause, F.lit(True)))
    return marked.withColumn("batch", F.max(F.when(F.col("_new"), F.col("ts"))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def folded(ops: Column, compatible: bool = True) -> Column:
    """The state after an array of operations. A creation makes a removed archive modified and any other added; a deletion makes an
    added one noop and any other removed. Unless compatible, a creation leaves a modified archive modified."""

    def step(state: Column, op: Column) -> Column:
        after = F.when(state == "Removed", "Modified")
        after = (after if compatible else after.when(state == "Modified", "Modified")).otherwise("Added")
        return F.when(op == "created", after).otherwise(F.when(state == "Added", "Noop").otherwise("Removed"))
    return F.aggregate(ops, F.lit("Noop"), step)


def changes(events: DataFrame, keys: list[str], compatible: bool = True) -> DataFrame:
    """One row for keys: kind (Added, Removed, Modified; Noop rows are gone) and n_events. A path's events of one batch are one array."""
    ops = F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "op"))), lambda e: e["op"])
    g = events.groupBy(*keys).agg(F.count("*").alias("n_events"), ops.alias("ops"))
    return g.withColumn("kind", folded(F.col("ops"), compatible)).where("kind != 'Noop'").drop("ops")


def delta(changed: DataFrame) -> DataFrame:
    """The lists of paths of each kind, as rows: kind and path."""
    return changed.select("kind", "path")


def applied(archives: DataFrame, changed: DataFrame, disk: DataFrame) -> DataFrame:
    """archives after the change: removed and modified ones gone, then modified and added ones as the disk has them."""
    gone = changed.where("kind IN ('Removed', 'Modified')").select(F.col("path").alias("virtual_path"))
    come = disk.join(changed.where("kind IN ('Added', 'Modified')").select(F.col("path").alias("virtual_path")), "virtual_path", "left_semi")
    kept = archives.join(gone, "virtual_path", "left_anti").join(come.select("virtual_path"), "virtual_path", "left_anti")
    return kept.unionByName(come)
