"""Debounced consolidation of change events as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.changes import folded


def sessions(events: DataFrame, quiet_seconds: int = 5, late_seconds: int = 5) -> DataFrame:
    """events (root, path, op, ts, seq), a stream or not, as one row for each run of a root's events without a longer pause: root, window, and the
    events in order. As a stream it needs a watermark, which the batch form has no use for; late events beyond it are dropped."""
    return events.withWatermark("ts", f"{late_seconds} seconds").groupBy("root", F.session_window("ts", f"{quiet_seconds} seconds").alias("window")).agg(
        F.array_sort(F.collect_list(F.struct("ts", "seq", "path", "op"))).alias("events"))


def deltas(sessions_: DataFrame, compatible: bool = True) -> DataFrame:
    """root, session_start, path and kind of what each session has changed. Runs row by row, so it also follows a stream."""
    names = F.array_distinct(F.transform("events", lambda e: e["path"]))
    per = F.transform(names, lambda p: F.struct(p.alias("path"), folded(F.transform(F.filter("events", lambda e: e["path"] == p), lambda e: e["op"]), compatible).alias("kind")))
    return sessions_.select("root", F.col("window.start").alias("session_start"), F.explode(per).alias("c")).select("root", "session_start", "c.path", "c.kind").where("kind != 'Noop'")


def consolidated(events: DataFrame, sink, checkpoint: str, quiet_seconds: int = 5, late_seconds: int = 5):
    """Start the stream: sink(batch, id) gets each micro-batch's deltas once its sessions have closed. Restarts go on from checkpoint."""
    out = deltas(sessions(events, quiet_seconds, late_seconds))
    return out.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink).start()
