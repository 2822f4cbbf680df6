"""Sharding by fixed virtual slots, with a versioned map from slots to shards.

A document's slot is a hash of its id modulo SLOTS and never changes. The map says which shard holds a slot; its
versions are edited, not recomputed: growing by a shard moves whole slots into the new shard and no others, and
rebalancing moves single slots between shards by the bytes counted in them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import scratch_root, written

#: Virtual slots; the map has one row for each, whatever the number of documents.
SLOTS = 4096
#: Parts of a slot in which its rows are numbered.
SALTS = 16


def slot_of(doc_id: Column, slots: int = SLOTS) -> Column:
    """The slot of an id: the first 32 bits of the MD5 of its decimal digits, modulo slots; null ids go to slot 0."""
    return F.coalesce(F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % slots, F.lit(0)).cast("int")


@dataclass
class SlotMap:
    """shard_of[v][slot] is the shard of a slot in version v, from 0. Edits give a map with one version more."""

    shard_of: list[list[int]] = field(default_factory=list)

    @classmethod
    def even(cls, shards: int, slots: int = SLOTS) -> "SlotMap":
        """Version 0: slots dealt in turn. It depends on the number of shards alone."""
        return cls([[s % shards for s in range(slots)]])

    @property
    def latest(self) -> list[int]:
        return self.shard_of[-1]

    def grow(self) -> "SlotMap":
        """A version with one more shard, which takes an even share of slots, the last ones of the fullest shards."""
        now, new = list(self.latest), max(self.latest) + 1
        own: dict[int, list[int]] = {}
        for s, k in enumerate(now):
            own.setdefault(k, []).append(s)
        for _ in range(len(now) // (new + 1)):
            k = max(own, key=lambda x: (len(own[x]), -x))
            now[own[k].pop()] = new
        return SlotMap([*self.shard_of, now])

    def rebalance(self, slot_bytes: dict[int, int], tolerance: float = 0.02) -> "SlotMap":
        """A version in which slots have moved from the fullest shard to the emptiest until their bytes are near."""
        now = list(self.latest)
        load = dict.fromkeys(now, 0)
        for s, k in enumerate(now):
            load[k] += slot_bytes.get(s, 0)
        mean = sum(load.values()) / len(load)
        while True:
            top, low = max(load, key=load.get), min(load, key=load.get)
            gap = load[top] - load[low]
            fit = [s for s, k in enumerate(now) if k == top and 0 < slot_bytes.get(s, 0) < gap]
            if gap <= tolerance * mean or not fit:
                return SlotMap([*self.shard_of, now])
            s = min(fit, key=lambda x: abs(slot_bytes[x] - gap / 2))
            now[s] = low
            load[top] -= slot_bytes[s]
            load[low] += slot_bytes[s]

    def table(self, spark: SparkSession, slot_bytes: DataFrame | None = None) -> DataFrame:
        """The stored map: version, vslot, shard, and the rows and bytes of each slot if they were counted."""
        rows = [(v, s, k) for v, m in enumerate(self.shard_of) for s, k in enumerate(m)]
        t = spark.createDataFrame(rows, "version int, vslot int, shard int")
        return t if slot_bytes is None else t.join(slot_bytes, "vslot", "left").fillna(0, ["rows", "bytes"])

    def lookup(self, vslot: Column, version: int = -1) -> Column:
        """The shard of a slot in a version, as an expression: the map is a constant array of SLOTS integers."""
        return F.element_at(F.array(*map(F.lit, self.shard_of[version])), vslot + 1)

    def store(self, spark: SparkSession, folder: str, slot_bytes: DataFrame | None = None) -> None:
        """Add the versions that the folder does not hold yet; stored versions never change."""
        known = len(SlotMap.load(spark, folder, missing=True).shard_of)
        t = self.table(spark, slot_bytes).where(F.col("version") >= known)
        t.coalesce(1).write.mode("append").parquet(folder)  # slots rows a version

    @classmethod
    def load(cls, spark: SparkSession, folder: str, missing: bool = False) -> "SlotMap":
        """The map in a folder, all its versions; empty if there is none and that is expected."""
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if missing and not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return cls()
        rows = spark.read.parquet(folder).select("version", "vslot", "shard").collect()  # slots rows a version
        out: list[list[int]] = [[] for _ in range(1 + max(r.version for r in rows))]
        for r in sorted(rows, key=lambda r: (r.version, r.vslot)):
            out[r.version].append(r.shard)
        return cls(out)


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, null: none, plus 16), text_crc32 (null: as the empty text) and vslot."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), slot_of(F.col("doc_id"), slots).alias("vslot"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    """Rows and bytes of every slot that has any; counted on each task first, so at most SLOTS rows a task are shuffled."""
    return rows.groupBy("vslot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def assign(docs: DataFrame, shards: int, slots: int = SLOTS, folder: str | None = None) -> tuple[DataFrame, SlotMap, DataFrame]:
    """Documents with shard, place in the shard (gapless from 0) and the shard they would have with one more; the map; and the
    map as it is stored in folder, with its slots' rows and bytes.

    The map is read from folder, and the latest version of it with that number of shards is used; where there is none, a map that deals the slots
    evenly is stored. A version with one more shard is the edit of it that is stored next to it. Repeated rows are documents of
    their own in the same shard, with places of their own; null ids are one id, in slot 0, and null and empty texts have 16 bytes;
    rows with one id are placed in no stated order; a very long text is a row like others. An empty table gives empty results.
    Columns beside doc_id and text are not read.
    """
    spark = docs.sparkSession
    folder = folder or f"{scratch_root(spark)}/slots-{uuid.uuid4().hex}"
    # Rows of one slot are numbered in SALTS parts, so that an id that a third of the rows have is not one task's.
    rows = written(sized(docs, slots).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "sized")
    parts = written(rows.groupBy("vslot", "salt").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")), "parts")  # slots * SALTS rows
    counts = parts.groupBy("vslot").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    maps = SlotMap.load(spark, folder, missing=True)
    fits = [v for v, m in enumerate(maps.shard_of) if max(m) + 1 == shards]
    if not fits:
        if maps.shard_of:
            raise ValueError(f"no version of the map has {shards} shards; edit the map and store it")
        maps, fits = SlotMap.even(shards, slots), [0]
    grown = next((v for v in range(fits[-1] + 1, len(maps.shard_of)) if max(maps.shard_of[v]) == shards), None)
    if grown is None:
        maps = SlotMap([*maps.shard_of, SlotMap([maps.shard_of[fits[-1]]]).grow().latest])
        grown = len(maps.shard_of) - 1
    maps.store(spark, folder, counts)
    stored = spark.read.parquet(folder)
    now = stored.where(F.col("version") == fits[-1]).select("vslot", "shard")
    after = stored.where(F.col("version") == grown).select("vslot", F.col("shard").alias("grown_shard"))
    # A document's place: rows in the shard's earlier slots and parts, and its place in its part.
    earlier = Window.partitionBy("shard").orderBy("vslot", "salt").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.join(now, "vslot").withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).join(after, "vslot")
    place = F.row_number().over(Window.partitionBy("vslot", "salt").orderBy("doc_id", "text_crc32", "size")) - 1
    out = rows.withColumn("place", place).join(F.broadcast(before.select("vslot", "salt", "shard", "before", "grown_shard")), ["vslot", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("place")).cast("bigint").alias("slot"), "grown_shard", "vslot")
    return out, maps, stored
