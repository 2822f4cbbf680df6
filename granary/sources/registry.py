"""Formats by name: how each is probed, scanned and read. A format is added by registering its functions."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.catalog import with_parents
from granary.functions import fields
from granary.sources import rarscan, zipscan
from granary.sources.ranged import located, sources

#: Contents and rows after which a batch of read entries is sent on.
BATCH_BYTES, BATCH_ROWS = 4_000_000, 1000
COMMON = ["archive_key", "internal_path", "is_directory", "size", "attributes", "modified", "crc32"]


@dataclass(frozen=True)
class Format:
    """extensions; entries(archives) with COMMON columns at least; read(archives, wanted) with data and error; probe(archives) with supported
    and reason, None if all are supported; the attribute of synthesized directories; broken(archives) with error; cleanup(keys), called
    when archives go."""

    name: str
    extensions: tuple[str, ...]
    entries: Callable[[DataFrame], DataFrame]
    read: Callable[[DataFrame, DataFrame], DataFrame]
    probe: Callable[[DataFrame], DataFrame] | None = None
    directory: int = fields.DIRECTORY
    broken: Callable[[DataFrame], DataFrame] | None = None
    cleanup: Callable[[list[str]], None] | None = None


class Registry:
    def __init__(self, *formats: Format):
        self._by_name: dict[str, Format] = {}
        for f in formats:
            self.register(f)

    def register(self, f: Format) -> None:
        self._by_name[f.name] = f

    def get(self, name: str) -> Format:
        if name not in self._by_name:
            raise KeyError(f"no format {name}")
        return self._by_name[name]

    @property
    def extensions(self) -> dict[str, str]:
        return {e: f.name for f in self._by_name.values() for e in f.extensions}

    def entries(self, archives: DataFrame) -> DataFrame:
        """Entries of archives (archive_key, format_id, content) of all formats, missing directories included."""
        out = None
        for f in self._by_name.values():
            e = with_parents(f.entries(archives.where(F.col("format_id") == f.name)), f.directory)
            out = e if out is None else out.unionByName(e)
        return out

    def read(self, archives: DataFrame, wanted: DataFrame) -> DataFrame:
        out = None
        for f in self._by_name.values():
            mine = archives.where(F.col("format_id") == f.name)
            e = f.read(mine, f.entries(mine).join(wanted.drop("size", "is_directory"), ["archive_key", "internal_path"]))
            out = e if out is None else out.unionByName(e)
        return out

    def broken(self, archives: DataFrame) -> DataFrame:
        """archive_key and error of archives that can't be listed to their end."""
        out = archives.select("archive_key", F.lit("").alias("error")).limit(0)
        for f in self._by_name.values():
            if f.broken:
                out = out.unionByName(f.broken(archives.where(F.col("format_id") == f.name)))
        return out

    def cleaned(self, keys: list[str]) -> None:
        """Tell every format that archives are gone; one that fails doesn't keep the others from being told."""
        failed = []
        for f in self._by_name.values():
            if f.cleanup:
                try:
                    f.cleanup(keys)
                except Exception as e:  # noqa: BLE001
                    failed.append(e)
        if failed:
            raise ExceptionGroup("cleanup", failed)

    def probed(self, archives: DataFrame) -> DataFrame:
        """archive_key, supported, reason."""
        out = None
        for f in self._by_name.values():
            mine = archives.where(F.col("format_id") == f.name)
            e = f.probe(mine) if f.probe else mine.select("archive_key", F.lit(True).alias("supported"), F.lit(None).cast("string").alias("reason"))
            out = e if out is None else out.unionByName(e)
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["archive_key", "internal_path", "data", "error"])


def _read_rar(archives: DataFrame, wanted: DataFrame) -> DataFrame:
    w = wanted.groupBy("archive_key").agg(F.collect_list(F.struct("internal_path", "read_at", "read_length")).alias("wanted"))

    def run(batches):
        for b in batches:
            for (key, src), asks in zip(sources(b), b.column(2)):
                directory = None if isinstance(src, OSError) else rarscan.Directory(src.read(0, src.size))
                rows, size = [], 0
                for a in asks.as_py():
                    data = error = None
                    try:
                        if directory is None:
                            raise src
                        data = directory.read(a["internal_path"], a["read_at"] or 0, a["read_length"])
                    except (ValueError, IndexError, OSError, struct.error) as e:
                        error = str(e)
                    rows.append((key, a["internal_path"], data, error))
                    size += len(data or b"")
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return located(archives.join(w, "archive_key"), "wanted").mapInArrow(run, "archive_key string, internal_path string, data binary, error string")


ZIP = Format("zip", (".zip",), zipscan.entries, zipscan.extracted, broken=zipscan.broken)
RAR = Format(
    "rar", (".rar",), lambda a: rarscan.entries(a).where("error IS NULL"), _read_rar, rarscan.probed, fields.DIRECTORY | fields.READ_ONLY,
    lambda a: rarscan.entries(a).where("error IS NOT NULL").select("archive_key", "error"),
)


def default() -> Registry:
    return Registry(ZIP, RAR)
