"""Cache replacement as queries over entries and access logs.

entries: cache, key, size, created, last_access, ttl_seconds, borrowed (handles out). accesses: cache, seq, ts (seconds), key, size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import fields


def expired(entries: DataFrame, now: str) -> DataFrame:
    """Entries past their time to live, counted from creation, that nobody holds."""
    end = F.col("created") + F.make_dt_interval(secs=F.col("ttl_seconds").cast("decimal(18,6)"))
    return entries.where((F.lit(now).cast("timestamp_ntz") > end) & (F.col("borrowed") == 0))


def victims(entries: DataFrame, needs: DataFrame, *policy: Column) -> DataFrame:
    """Entries to evict in the order of policy (ties by key), until a cache's needs (cache, required, current, capacity) are met;
    borrowed ones stay."""
    w = Window.partitionBy("cache").orderBy(*policy, "key").rowsBetween(Window.unboundedPreceding, -1)
    need = F.col("required") - (F.col("capacity") - F.col("current"))
    freed = F.coalesce(F.sum("size").over(w), F.lit(0))
    return entries.where("borrowed = 0").join(needs, "cache").withColumn("freed", freed).where(F.col("freed") < need).drop("required", "current", "capacity", "freed")


def lru_victims(entries: DataFrame, needs: DataFrame) -> DataFrame:
    """The policy of the longest unused first."""
    return victims(entries, needs, F.col("last_access"))


def cached_keys(entries: DataFrame) -> DataFrame:
    """Per archive how many keys are cached, and which. A key is archive:path."""
    archive = F.regexp_extract("key", "^([^:]*)", 1)
    return entries.groupBy(archive.alias("archive_key")).agg(F.array_sort(F.collect_set("key")).alias("keys")).withColumn("n_keys", F.size("keys").cast("long"))


def without_archives(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """entries without all keys of the gone archives (archive_key)."""
    return entries.withColumn("archive_key", F.regexp_extract("key", "^([^:]*)", 1)).join(gone, "archive_key", "left_anti").drop("archive_key")


def two_tier_hit_rate(tiers: DataFrame) -> DataFrame:
    """Hit rate of tiers (hits, misses, n_entries) together, weighted by their entries."""
    rate = fields.hit_rate(F.col("hits"), F.col("misses"))
    return tiers.agg(F.coalesce(F.try_divide(F.sum(rate * F.col("n_entries")), F.sum("n_entries")), F.lit(0.0)).cast("double").alias("hit_rate"))


def gauges(entries: DataFrame, capacity: int) -> DataFrame:
    """Per cache: entries, borrowed entries, bytes and how full it is."""
    return entries.groupBy("cache").agg(F.count("*").alias("n_entries"), F.count_if(F.col("borrowed") > 0).alias("n_borrowed"), F.sum("size").cast("long").alias("bytes")).withColumn("utilisation", F.col("bytes") / F.lit(capacity))


def simulated(accesses: DataFrame, capacity: int, ttl_seconds: float) -> DataFrame:
    """Every access with hit, evicted (how many, by time and then by LRU, after the insertion, which stays) and bytes held after it.

    A cache is replayed in order, so each is one group; caches are independent of each other.
    """

    def replay(log: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, list] = {}  # in order of last access: size, created
        total, rows = 0, []
        for r in log.sort_values("seq").itertuples(index=False):
            e = held.get(r.key)
            hit = e is not None and not r.ts > e[1] + ttl_seconds
            gone = 0
            if hit:
                held[r.key] = held.pop(r.key)
            else:
                if e is not None:
                    total -= held.pop(r.key)[0]
                held[r.key] = [r.size, r.ts]
                total += r.size
                if total > capacity:
                    for k in [k for k, (_, at) in held.items() if k != r.key and r.ts > at + ttl_seconds]:
                        total -= held.pop(k)[0]
                        gone += 1
                    for k in list(held):
                        if total <= capacity or k == r.key:
                            break
                        total -= held.pop(k)[0]
                        gone += 1
            rows.append((r.cache, r.seq, r.key, hit, gone, total))
        return pd.DataFrame(rows, columns=["cache", "seq", "key", "hit", "evicted", "bytes_held"])

    return accesses.groupBy("cache").applyInPandas(replay, "cache string, seq long, key string, hit boolean, evicted long, bytes_held long")


def percentiles(measured: DataFrame, by: str, value: str) -> DataFrame:
    """p50, p95 and p99 with linear interpolation, and the maximum."""
    p = lambda q: F.percentile(value, F.lit(q))
    return measured.groupBy(by).agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max(value).alias("max"))


def reservoir(rows: DataFrame, by: str, key: str, most: int, seed: int = 0) -> DataFrame:
    """Up to most rows of each group, chosen by a hash of key and seed."""
    w = Window.partitionBy(by).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")))
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def counters(log: DataFrame, *tags: str) -> DataFrame:
    """How often each combination of tags (hits, misses, evictions by reason ...) came."""
    return log.groupBy(*tags).agg(F.count("*").alias("n"))


def histogram(measured: DataFrame, by: str, value: str, bounds: list[float]) -> DataFrame:
    """How many values of each group are up to each bound, the last bucket being open."""
    bucket = F.get(F.filter(F.array(*(F.lit(float(b)) for b in bounds)).cast("array<double>"), lambda b: F.col(value) <= b), F.lit(0))
    return measured.where(F.col(value).isNotNull()).groupBy(by, bucket.alias("upto")).agg(F.count("*").alias("n"))


def hits_of_rate(tiers: DataFrame) -> DataFrame:
    """tiers (hit_rate, misses) with the hits that the rate implies; null where the rate is 1 and says nothing of them."""
    return tiers.withColumn("hits", F.when(F.col("hit_rate") < 1, F.floor(F.col("misses") * F.col("hit_rate") / (1 - F.col("hit_rate")) + 0.5).cast("long")))


def swept(entries: DataFrame, now: str, most: int = 100) -> DataFrame:
    """What one round of maintenance takes: expired entries nobody holds, the longest expired first, at most so many."""
    return expired(entries, now).orderBy(F.col("created"), "key").limit(most)
