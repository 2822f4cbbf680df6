"""A folder of archives as one read-only tree: a thin facade over the catalog's DataFrames."""

from __future__ import annotations

import json
import re

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import fields, paths
from granary.operators import catalog
from granary.sources import discovery, registry


class NotFound(LookupError):
    pass


class AccessDenied(PermissionError):
    pass


def options(*files: str, args: list[str] = ()) -> dict:
    """Settings from JSON texts with comments, later ones over earlier ones, then --Section:Key=value arguments; a bare first argument is
    the archive directory."""
    out: dict = {}

    def put(path: list[str], value) -> None:
        at = out
        for k in path[:-1]:
            at = at.setdefault(k, {})
        at[path[-1]] = value

    def merge(path: list[str], value) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                merge([*path, k], v)
        else:
            put(path, value)

    for text in files:
        bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
        merge([], json.loads(re.sub(r",(\s*[}\]])", r"\1", bare)))
    for k, a in enumerate(args):
        if k == 0 and not a.startswith("-"):
            put(["Mount", "ArchiveDirectory"], a)
        elif m := re.fullmatch(r"--?([^=]+)=(.*)", a, re.S):
            put(m[1].split(":"), m[2])
    return out


class VirtualFileSystem:
    """Mounted archives. Everything that changes data is refused; queries see the catalog as it was when they were planned.

    With a storage level, what the archives hold is listed once, when first needed or by warm(), and kept by the executors at that
    level, dealt by archive; lost pieces are listed again. Adding, removing and unmounting forget it. Without one, each query lists
    the archives that it asks about.
    """

    def __init__(self, spark: SparkSession, formats: registry.Registry | None = None, hide_unsupported: bool = True, storage: StorageLevel | None = None):
        self.spark, self.formats, self.hide, self.storage = spark, formats or registry.default(), hide_unsupported, storage
        self.archives: DataFrame | None = None
        self.label = ""
        self._kept: DataFrame | None = None

    def mount(self, root: str, most_depth: int = discovery.MOST_DEPTH) -> "VirtualFileSystem":
        self._take(discovery.discover(self.spark, root, most_depth), root.rstrip("/").rsplit("/", 1)[-1])
        return self

    def mount_file(self, path: str) -> bool:
        """Mount one archive under its folder; False if its format is unknown or it is missing."""
        found = discovery.describe(self.spark, path.rsplit("/", 1)[0], path)
        if found.isEmpty():
            return False
        self._take(found, path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
        return True

    def _take(self, found: DataFrame, label: str) -> None:
        self._forget()
        self.archives = catalog.add(found.limit(0), self._probed(found), self.hide).persist()
        self.label = label

    def _probed(self, found: DataFrame) -> DataFrame:
        got = self.formats.probed(self._contents(found)).select(F.col("archive_key").alias("virtual_path"), "supported")
        return found.join(got, "virtual_path", "left").fillna({"supported": True})

    def unmount(self) -> None:
        self._forget()
        if self.archives is not None:
            self.archives.unpersist()
        self.archives = None

    def _forget(self) -> None:
        if self._kept is not None:
            self._kept.unpersist()
        self._kept = None

    def warm(self) -> int:
        """List what all mounted archives hold, if there is a storage level to keep it; the number of entries. What is kept already
        is not listed again."""
        if self.storage is None:
            raise ValueError("no storage level")
        return self._entries().count()

    def _entries(self, key: str | None = None) -> DataFrame:
        """What the mounted archives hold, or the one of that key."""
        if self.storage is None:
            return self.formats.entries(self._contents(self._mounted()) if key is None else self._of(key))
        if self._kept is None:
            self._kept = self.formats.entries(self._contents(self._mounted())).repartition("archive_key").persist(self.storage)
        return self._kept if key is None else self._kept.where(F.col("archive_key") == key)

    def _contents(self, archives: DataFrame) -> DataFrame:
        """Where archives' bytes are; they are read there, by the workers, as far as a query needs them."""
        return archives.select(F.col("virtual_path").alias("archive_key"), "format_id", "physical_path")

    def _mounted(self) -> DataFrame:
        if self.archives is None:
            raise RuntimeError("nothing is mounted")
        return self.archives

    def _resolved(self, path: str) -> DataFrame:
        asked = self.spark.range(1).select(paths.normalize(F.lit(path)).alias("path"))
        return catalog.resolve(asked, self._mounted())

    def _of(self, key: str) -> DataFrame:
        return self._contents(self._mounted().where(F.col("virtual_path") == key))

    def file_info(self, path: str):
        r = self._resolved(path)
        one = r.first()
        entries = self._entries(one.archive) if one.status == "InsideArchive" else self.formats.entries(self._contents(self._mounted().limit(0)))
        got = catalog.file_info(r, self._mounted(), entries).first()
        if got is None:
            raise NotFound(path)
        return got

    def list_directory(self, path: str) -> DataFrame:
        """name, is_directory, size, full_path of what the directory holds. A missing folder inside an archive is empty."""
        r = self._resolved(path).first()
        if r.status == "NotFound":
            raise NotFound(path)
        if r.status in ("VirtualRoot", "VirtualFolder"):
            kids = catalog.list_folders(self._mounted()).where(paths.fold(F.col("folder")) == paths.fold(F.lit(r.path)))
            sized = kids.join(self._mounted().select(F.col("virtual_path").alias("archive"), "size_bytes"), "archive", "left")
            return sized.select("name", F.lit(True).alias("is_directory"), F.coalesce("size_bytes", F.lit(0)).alias("size"), F.concat_ws("/", F.nullif("folder", F.lit("")), "name").alias("full_path"))
        kids = catalog.children(self._entries(r.archive)).where(F.col("directory") == r.internal_path.rstrip("/"))
        return kids.select("name", "is_directory", "size", "full_path")

    def find(self, path: str, pattern: str) -> DataFrame:
        return self.list_directory(path).where(paths.matches(F.col("name"), pattern))

    def read(self, path: str, at: int = 0, most: int | None = None) -> bytes:
        """Bytes of a file from at; fewer at its end, none beyond."""
        r = self._resolved(path).first()
        if r.status == "NotFound":
            raise NotFound(path)
        if r.status != "InsideArchive":
            raise AccessDenied(path)
        wanted = self.spark.createDataFrame([(r.archive, r.internal_path, at, most)], "archive_key string, internal_path string, read_at long, read_length long")
        got = self.formats.read(self._of(r.archive), wanted).first()
        if got is None:
            if self.directory_exists(path):
                raise AccessDenied(path)
            raise NotFound(path)
        if got.error:
            raise OSError(got.error)
        return bytes(got.data)

    def file_exists(self, path: str) -> bool:
        try:
            return not self.file_info(path).is_directory
        except NotFound:
            return False

    def directory_exists(self, path: str) -> bool:
        try:
            return bool(self.file_info(path).is_directory)
        except NotFound:
            return False

    def volume(self):
        return catalog.volume(self._mounted(), self.label).first()

    def totals(self) -> DataFrame:
        """Per archive its entries, bytes and estimated memory."""
        return catalog.totals(self._entries()).withColumn("memory_bytes", fields.structure_bytes(F.col("n_entries"), paths.format_of(F.col("archive_key"))))

    def registered(self) -> DataFrame:
        return self._mounted().select("virtual_path", "physical_path", "size_bytes", "modified", "format_id")

    def add(self, found: DataFrame) -> None:
        """Add archives (as discover() gives them), the last of one path staying. They are probed as mounted ones are."""
        self._forget()
        self.archives = catalog.add(self._mounted(), self._probed(found), self.hide).persist()

    def remove(self, *virtual_paths: str) -> None:
        self._forget()
        gone = self.spark.createDataFrame([(p,) for p in virtual_paths], "virtual_path string")
        self.archives = catalog.remove(self._mounted(), gone).persist()
        self.formats.cleaned(list(virtual_paths))

    def broken(self) -> DataFrame:
        """archive_key and error of mounted archives that can't be listed to their end."""
        return self.formats.broken(self._contents(self._mounted()))

    def write(self, *_, **__):
        raise AccessDenied("the file system is read-only")

    delete = move = set_attributes = set_times = set_end = write
