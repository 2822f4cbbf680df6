"""RAR archives: version, solidity and entries from their headers, and contents of stored entries.

Compressed entries need a decoder that no library of this environment has; reading them gives an error value, as solid
archives do, which appear as one warning file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import fields, paths
from granary.sources.ranged import located, sources

#: Magic of the two versions. Fixed values.
RAR5, RAR4 = b"Rar!\x1a\x07\x01\x00", b"Rar!\x1a\x07\x00"
WARNING = "NOT_SUPPORTED_WARNING.txt"
WARNING_TEXT = b"This archive is solid: its files can only be read one after the other, which is not supported.\r\n"
MOST_BYTES = 2 * 1024**3


def version(content: Column) -> Column:
    """5, 4, or 0 for anything else."""
    return F.when(F.substring(content, 1, 8) == F.lit(RAR5), 5).when(F.substring(content, 1, 7) == F.lit(RAR4), 4).otherwise(0)


def _vint(b: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[at] & 0x7F) << shift
        at += 1
        if b[at - 1] < 0x80:
            return value, at
        shift += 7


def _five(b: bytes) -> Iterator[tuple]:
    at = len(RAR5)
    while at + 7 <= len(b):
        size, p = _vint(b, at + 4)
        after = p + size
        kind, p = _vint(b, p)
        flags, p = _vint(b, p)
        _, p = _vint(b, p) if flags & 1 else (0, p)
        data, p = _vint(b, p) if flags & 2 else (0, p)
        if kind == 1:
            yield "main", bool(_vint(b, p)[0] & 4)
        elif kind == 4:
            raise ValueError("encrypted headers")
        elif kind == 2:
            file_flags, p = _vint(b, p)
            unpacked, p = _vint(b, p)
            _, p = _vint(b, p)
            modified = struct.unpack_from("<L", b, p)[0] if file_flags & 2 else None
            p += 4 * bool(file_flags & 2)
            crc = struct.unpack_from("<L", b, p)[0] if file_flags & 4 else 0
            p += 4 * bool(file_flags & 4)
            method, p = _vint(b, p)
            _, p = _vint(b, p)
            n, p = _vint(b, p)
            yield "file", b[p : p + n].decode("utf-8", "replace"), bool(file_flags & 1), unpacked, data, (method >> 7 & 7) == 0, after, crc, modified
        elif kind == 5:
            return
        at = after + data


def _four(b: bytes) -> Iterator[tuple]:
    at = len(RAR4)
    while at + 7 <= len(b):
        _, kind, flags, size = struct.unpack_from("<HBHH", b, at)
        data = struct.unpack_from("<L", b, at + 7)[0] if flags & 0x8000 or kind in (0x74, 0x7A) else 0
        if size < 7 or kind == 0x7B:
            return
        if kind == 0x73:
            yield "main", bool(flags & 8)
        elif kind == 0x74:
            packed, unpacked, _, crc, _, _, method, n, _ = struct.unpack_from("<LLBLLBBHL", b, at + 7)
            p = at + 32
            if flags & 0x100:
                high, wide = struct.unpack_from("<LL", b, p)
                packed, unpacked, p = packed | high << 32, unpacked | wide << 32, p + 8
            data = packed
            yield "file", b[p : p + n].split(b"\0")[0].decode("utf-8", "replace"), flags & 0xE0 == 0xE0, unpacked, packed, method == 0x30, at + size, crc, None
        at += size + data


def headers(b: bytes) -> Iterator[tuple]:
    """('main', solid) and ('file', name, directory, size, packed, stored, data offset, crc32, unix time or None) rows."""
    if b.startswith(RAR5):
        return _five(b)
    if b.startswith(RAR4):
        return _four(b)
    raise ValueError("not a RAR archive")


def solid(b: bytes) -> bool:
    """Whether the archive is solid. Files that can't be read count as not, and fail when their entries are asked for."""
    try:
        return any(h[0] == "main" and h[1] for h in headers(b))
    except (ValueError, IndexError, struct.error):
        return False


def probed(archives: DataFrame) -> DataFrame:
    """archive_key, supported and reason of archives (archive_key, content)."""

    def run(batches):
        for b in batches:
            s = [not isinstance(x, OSError) and solid(x.read(0, x.size)) for _, x in sources(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([not x for x in s]), pa.array(["solid archive" if x else None for x in s], pa.string())], names=["archive_key", "supported", "reason"])

    return located(archives).mapInArrow(run, "archive_key string, supported boolean, reason string")


def entries(archives: DataFrame) -> DataFrame:
    """Entries: archive_key, internal_path, is_directory, size, compressed_size, crc32, modified, attributes, stored, offset, error. Empty names are
    left out; a missing time is the least timestamp; a solid archive has its warning file alone."""

    def run(batches):
        for b in batches:
            for key, src in sources(b):
                rows = []
                try:
                    if isinstance(src, OSError):
                        raise src
                    blob = src.read(0, src.size)
                    if solid(blob):
                        rows.append((key, WARNING, False, len(WARNING_TEXT), len(WARNING_TEXT), 0, None, True, -1, None))
                    else:
                        rows += [(key, *h[1:5], h[7], h[8], h[5], h[6], None) for h in headers(blob) if h[0] == "file"]
                except (ValueError, IndexError, OSError, struct.error) as e:
                    rows.append((key, None, None, None, None, None, None, None, None, str(e) or "cut off"))
                if rows:
                    kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["archive_key", "name", "is_directory", "size", "compressed_size", "crc32", "unix", "stored", "offset", "error"])

    got = located(archives).mapInArrow(run, "archive_key string, name string, is_directory boolean, size long, compressed_size long, crc32 long, unix long, stored boolean, offset long, error string")
    path = F.regexp_replace(paths.entry_name(F.col("name")), "/+$", "")
    return got.where("error IS NOT NULL OR regexp_replace(name, '[/\\\\\\\\]+$', '') != ''").select(
        "archive_key", F.when(F.col("is_directory"), F.concat(path, F.lit("/"))).otherwise(path).alias("internal_path"), "is_directory", "size", "compressed_size", "crc32",
        F.coalesce(F.timestamp_seconds("unix").cast("timestamp_ntz"), F.lit(fields.MIN_TIME).cast("timestamp_ntz")).alias("modified"),
        F.when(F.col("is_directory"), fields.DIRECTORY | fields.READ_ONLY).otherwise(fields.READ_ONLY).alias("attributes"), "stored", "offset", "error",
    )


class Directory:
    """An archive's files by their normalised names, from one pass over its headers."""

    def __init__(self, b: bytes):
        self.content, self.files, self.solid, self.error = b, {}, False, None
        try:
            for h in headers(b):
                if h[0] == "main":
                    self.solid |= h[1]
                elif not h[2]:
                    self.files.setdefault(h[1].replace("\\", "/").removeprefix("/"), h)  # the first that has a name
        except (ValueError, IndexError, struct.error) as e:
            self.error = e  # what was listed before the break stays

    def read(self, name: str, at: int = 0, most: int | None = None) -> bytes:
        """Bytes at to at + most of a stored entry."""
        if name == WARNING and self.solid:
            return WARNING_TEXT[at : None if most is None else at + most]
        h = self.files.get(name)
        if h is None:
            raise self.error or ValueError("no such entry")
        if h[3] > MOST_BYTES:
            raise ValueError("over 2 GB")
        if not h[5]:
            raise ValueError("compressed: no decoder")
        return self.content[h[6] + at : h[6] + (h[4] if most is None else min(h[4], at + most))]


def read_entry(b: bytes, name: str) -> bytes:
    """A stored entry's bytes, by its normalised name, the first that has it."""
    return Directory(b).read(name)
