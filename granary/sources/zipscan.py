"""ZIP archives as rows: directories parsed, entries read, by Arrow functions over archives (archive_key, and content or physical_path).

Of a file only its tail, its directory and the entries asked for are read, at their places, so archives may be of any size; content
is an archive's bytes in a row. Errors are values: a row that can't be read has its reason in the column error, or raises if asked to
be strict.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import fields, paths
from granary.sources import charset
from granary.sources.ranged import File, Held, located, sources

#: Layouts and signatures of the format. Fixed values.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
END_SIZE, MOST_COMMENT, CENTRAL_SIZE, LOCAL_SIZE, LOCATOR_SIZE = 22, 65535, 46, 30, 20
MOST_ENTRY = CENTRAL_SIZE + 3 * 65535
ENCRYPTED, DESCRIPTOR, UTF8 = 0x1, 0x8, 0x800
STORED, DEFLATED = 0, 8

ENTRY = (
    "archive_key string, entry_index long, name_bytes binary, version_made_by int, flags int, method int, dos_time int, dos_date int, crc32 long, "
    "compressed_size long, size long, external long, offset long, error string"
)


class BadArchive(ValueError):
    """What the archive's bytes break."""


class End(NamedTuple):
    entries: int
    directory_size: int
    directory_offset: int
    zip64: bool
    position: int
    comment: bytes


def end_record(src: Held | File) -> End:
    """The end record: the last signature in the file's last 22 + 65535 bytes, then its 64-bit form if any field overflows."""
    if src.size < END_SIZE:
        raise BadArchive("too short for an end record")
    low = max(0, src.size - END_SIZE - MOST_COMMENT - LOCATOR_SIZE)
    tail = src.read(low, src.size - low)
    at = tail.rfind(END, max(0, len(tail) - END_SIZE - MOST_COMMENT), len(tail) - END_SIZE + 4)
    if at < 0:
        raise BadArchive("no end record")
    disk, start_disk, _, n, size, offset, comment = struct.unpack_from("<4H2LH", tail, at + 4)
    zip64, note = False, tail[at + END_SIZE : at + END_SIZE + comment]
    if n == 0xFFFF or 0xFFFFFFFF in (size, offset) or disk == 0xFFFF:
        if at < LOCATOR_SIZE or tail[at - LOCATOR_SIZE : at - LOCATOR_SIZE + 4] != LOCATOR64:
            raise BadArchive("no locator of the 64-bit end record")
        (far,) = struct.unpack_from("<Q", tail, at - 12)
        record = src.read(far, 56) if far + 56 <= src.size else b""
        if record[:4] != END64:
            raise BadArchive("no 64-bit end record where its locator points")
        disk, start_disk, _, n, size, offset = struct.unpack_from("<2L4Q", record, 16)
        zip64, note = True, b""
    if disk or start_disk:
        raise BadArchive("more than one disk")
    if offset > src.size or offset + size > src.size:
        raise BadArchive("the directory reaches beyond the file")
    return End(n, size, offset, zip64, low + at, note)


def central_directory(src: Held | File, end: End, step: int = 1 << 20) -> Iterator[tuple]:
    """The fields of every entry, in file order: exactly as many as the end record says. The directory is read by steps."""
    at, b, low = 0, b"", end.directory_offset
    for _ in range(end.entries):
        if at + MOST_ENTRY > len(b):  # an entry may need more than is left
            b, low, at = b[at:] + src.read(low + len(b), step), low + at, 0
        if at + CENTRAL_SIZE > len(b):
            raise BadArchive("the directory is cut off")
        if b[at : at + 4] != CENTRAL:
            raise BadArchive("no directory entry where one should be")
        made, _, flags, method, time, date, crc, packed, size, n, m, k, _, _, external, offset = struct.unpack_from("<6H3L5H2L", b, at + 4)
        if at + CENTRAL_SIZE + n + m + k > len(b):
            raise BadArchive("the directory is cut off")
        name = b[at + CENTRAL_SIZE : at + CENTRAL_SIZE + n]
        if 0xFFFFFFFF in (packed, size, offset):
            size, packed, offset = _wide(b[at + CENTRAL_SIZE + n : at + CENTRAL_SIZE + n + m], size, packed, offset)
        yield name, made, flags, method, time, date, crc, packed, size, external, offset
        at += CENTRAL_SIZE + n + m + k


def _wide(extra: bytes, *values: int) -> list[int]:
    """Sizes and offset with the overflowing ones from the 64-bit extra field, which holds just those, in this order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{min(n, len(extra) - at - 4) // 8}Q", extra, at + 4))
            return [next(wide, v) if v == 0xFFFFFFFF else v for v in values]
        at += 4 + n
    return list(values)


def data_start(src: Held | File, offset: int) -> int:
    """Where an entry's data begins, after its local header."""
    head = src.read(offset, LOCAL_SIZE) if 0 <= offset <= src.size - LOCAL_SIZE else b""
    if not head:
        raise BadArchive("the local header is outside the file")
    if head[:4] != LOCAL:
        raise BadArchive("no local header where one should be")
    n, m = struct.unpack_from("<2H", head, 26)
    return offset + LOCAL_SIZE + n + m


def stream(src: Held | File, flags: int, method: int, packed: int, size: int, offset: int, at: int = 0, most: int | None = None, step: int = 1 << 20) -> Iterator[bytes]:
    """Bytes at to at + most of an entry, in pieces of up to step. Of a stored entry only the range is read; a deflated one is
    inflated from its begin, piece by piece, and no further than the range's end."""
    if flags & ENCRYPTED:
        raise BadArchive("encrypted")
    if method not in (STORED, DEFLATED):
        raise BadArchive(f"compression method {method}")
    start = data_start(src, offset)
    end = size if most is None else min(size, at + most)
    if method == STORED:
        for lo in range(at, min(end, packed), step):
            yield src.read(start + lo, min(step, min(end, packed) - lo))
        return
    z, done, taken, left = zlib.decompressobj(-15), 0, 0, b""
    while done < end and not z.eof:
        if not left:
            left = src.read(start + taken, min(step, packed - taken))
            taken += len(left)
        out = z.decompress(left, min(step, end - done))
        left = z.unconsumed_tail
        if done + len(out) > at:
            yield out[max(0, at - done) :]
        done += len(out)
        if not out and not left and taken >= packed:
            break


def read_entry(src: Held | File, flags: int, method: int, packed: int, size: int, offset: int, at: int = 0, most: int | None = None, crc: int | None = None) -> bytes:
    """Bytes at to at + most of an entry. Reading stops where the range ends. The checksum is looked at only if given, with the whole entry."""
    out = b"".join(stream(src, flags, method, packed, size, offset, at, most))
    if crc is not None and at == 0 and (most is None or most >= size) and zlib.crc32(out) != crc:
        raise BadArchive("checksum")
    return out


def contents(spark: SparkSession, root: str, pattern: str = "*.[zZ][iI][pP]") -> DataFrame:
    """archive_key (path below root) and content of the archives below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    bare = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")
    return files.select(paths.relative(bare(F.col("path")), bare(F.lit(root))).alias("archive_key"), "content")


def raw_entries(archives: DataFrame, strict: bool = False, batch: int = 50_000) -> DataFrame:
    """One row a directory entry of archives (archive_key, content), names undecoded; one row with error for an archive that breaks off."""

    def run(batches):
        for b in batches:
            for key, src in sources(b):
                rows = []
                try:
                    if isinstance(src, OSError):
                        raise src
                    for i, e in enumerate(central_directory(src, end_record(src))):
                        rows.append((key, i, *e, None))
                        if len(rows) >= batch:
                            yield _batch(rows)
                            rows = []
                except (BadArchive, OSError) as e:
                    if strict:
                        raise
                    rows.append((key, None, *[None] * 11, str(e)))
                if rows:
                    yield _batch(rows)

    return located(archives).mapInArrow(run, ENTRY)


def broken(archives: DataFrame) -> DataFrame:
    """archive_key and error of archives that can't be listed to their end. entries() has what was listed before that."""
    return raw_entries(archives).where("error IS NOT NULL").select("archive_key", "error")


_NAMES = [x.split()[0] for x in ENTRY.split(", ")]
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[x.split()[1]]) for c, x in zip(zip(*rows), ENTRY.split(", "))], names=_NAMES)


def entries(archives: DataFrame, fallback: str = "cp437", strict: bool = False) -> DataFrame:
    """Decoded entries of archives: archive_key, internal_path, is_directory, size, compressed_size, ratio, modified, attributes, crc32, encrypted,
    method, flags, offset, entry_index. Of equal paths the last stays. Parents are not made here; see with_parents()."""
    raw = raw_entries(archives, strict).where("error IS NULL")
    named = charset.decoded(raw, "archive_key", "name_bytes", fields.flag(F.col("flags"), UTF8), fallback)
    directory = fields.is_directory(F.col("name"), F.col("external"))
    path = F.regexp_replace(paths.entry_name(F.col("name")), "/+$", "")
    out = named.withColumn("is_directory", directory).select(
        "archive_key", F.when(F.col("is_directory"), F.concat(path, F.lit("/"))).otherwise(path).alias("internal_path"), "is_directory", "size", "compressed_size",
        fields.compression_ratio(F.col("compressed_size"), F.col("size")).alias("ratio"), fields.dos_timestamp(F.col("dos_date"), F.col("dos_time")).alias("modified"),
        fields.attributes(F.col("is_directory"), fields.host_os(F.col("version_made_by")), F.col("external")).alias("attributes"), "crc32",
        fields.flag(F.col("flags"), ENCRYPTED).alias("encrypted"), "method", "flags", "offset", "entry_index",
    )
    last = out.groupBy("archive_key", "internal_path").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("archive_key", "internal_path")]), "entry_index").alias("e"))
    return last.select("archive_key", "internal_path", "e.*")


EXTRACTED = "archive_key string, internal_path string, data binary, error string"


def _extracted(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[x.split()[1]]) for c, x in zip(zip(*rows), EXTRACTED.split(", "))], names=[x.split()[0] for x in EXTRACTED.split(", ")])


def extracted(archives: DataFrame, wanted: DataFrame, verify: bool = False) -> DataFrame:
    """wanted entries (archive_key, internal_path, flags, method, compressed_size, size, offset, crc32, and read_at and read_length, null for all) with
    data or error. An archive goes with the list of what is wanted of it, not with each entry."""
    w = wanted.groupBy("archive_key").agg(F.collect_list(F.struct("internal_path", "flags", "method", "compressed_size", "size", "offset", "crc32", "read_at", "read_length")).alias("wanted"))

    def run(batches):
        for b in batches:
            for (key, src), asks in zip(sources(b), b.column(2)):
                for a in asks.as_py():
                    data = error = None
                    try:
                        if isinstance(src, OSError):
                            raise src
                        data = read_entry(src, a["flags"], a["method"], a["compressed_size"], a["size"], a["offset"], a["read_at"] or 0, a["read_length"], a["crc32"] if verify else None)
                    except (BadArchive, OSError, zlib.error) as e:
                        error = str(e)
                    yield _extracted([(key, a["internal_path"], data, error)])

    return located(archives.join(w, "archive_key"), "wanted").mapInArrow(run, EXTRACTED)


def spans(wanted: list[dict], most_bytes: int, reach: int) -> Iterator[tuple[int, int, list[dict]]]:
    """Begin, end and entries of runs of entries in order of offset, each of at most most_bytes (or one entry). An entry may reach over its
    header by reach bytes."""
    run, low, high = [], 0, 0
    for a in sorted(wanted, key=lambda a: a["offset"]):
        end = a["offset"] + LOCAL_SIZE + reach + a["compressed_size"]
        if run and max(high, end) - low > most_bytes:
            yield low, high, run
            run, high = [], 0
        if not run:
            low = a["offset"]
        run.append(a)
        high = max(high, end)
    if run:
        yield low, high, run


class Window(Held):
    """A range of a file, read at once, that answers as the file; what lies outside is read from the file."""

    def __init__(self, src: Held | File, low: int, high: int):
        self.src, self.low, self.size = src, low, src.size
        self.content = src.read(low, high - low)

    def read(self, at: int, n: int) -> bytes:
        if self.low <= at and min(at + n, self.size) <= self.low + len(self.content):
            return self.content[at - self.low : at - self.low + n]
        return self.src.read(at, n)


def read_spans(archives: DataFrame, wanted: DataFrame, most_bytes: int = 10 * 1024 * 1024, reach: int = 512) -> DataFrame:
    """As extracted(), whole entries, by sequential reads: entries that lie together are read as one span of up to most_bytes, and what
    lies between them is dropped."""
    w = wanted.where("NOT is_directory").groupBy("archive_key").agg(F.collect_list(F.struct("internal_path", "flags", "method", "compressed_size", "size", "offset")).alias("wanted"))

    def run(batches):
        for b in batches:
            for (key, src), asks in zip(sources(b), b.column(2)):
                for low, high, some in spans(asks.as_py(), most_bytes, reach):
                    rows, window = [], src if isinstance(src, OSError) else Window(src, low, high)
                    for a in some:
                        data = error = None
                        try:
                            if isinstance(src, OSError):
                                raise src
                            data = read_entry(window, a["flags"], a["method"], a["compressed_size"], a["size"], a["offset"])
                        except (BadArchive, OSError, zlib.error) as e:
                            error = str(e)
                        rows.append((key, a["internal_path"], data, error))
                    yield _extracted(rows)

    return located(archives.join(w, "archive_key"), "wanted").mapInArrow(run, EXTRACTED)


def chunks(data: DataFrame, chunk: int) -> DataFrame:
    """data (archive_key, internal_path, data) in pieces: chunk_index, chunk_offset, bytes. Empty entries have none."""
    size = F.octet_length("data").cast("long")
    n = fields.chunk_count(size, chunk)
    out = data.where(size > 0).withColumn("chunk_index", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return out.select("archive_key", "internal_path", "chunk_index", (F.col("chunk_index") * chunk).alias("chunk_offset"), F.substring("data", (F.col("chunk_index") * chunk + 1).cast("int"), F.lit(chunk)).alias("bytes"))
