"""Column functions over archive header fields, sizes, chunks and ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attribute bits of listings. Fixed values.
READ_ONLY, HIDDEN, SYSTEM, DIRECTORY, ARCHIVE, NORMAL = 0x1, 0x2, 0x4, 0x10, 0x20, 0x80
UNIX = 3
KIB, MIB = 1024, 1024 * 1024
#: Upper bounds of size buckets, exclusive.
BUCKETS = {"tiny": KIB, "small": MIB, "medium": 10 * MIB, "large": 50 * MIB, "xlarge": 500 * MIB}
STRUCTURE_BYTES = {"zip": 114, "rar": 96}
MIN_TIME = "0001-01-01 00:00:00"


def dos_timestamp(date: Column, time: Column) -> Column:
    """The local time of a DOS date and time word. Fields out of range take their least value; dates that then still don't exist
    are the least timestamp."""
    bits = lambda w, shift, mask: F.shiftright(w.cast("int"), shift).bitwiseAND(mask)
    within = lambda v, lo, hi: F.when(v.between(lo, hi), v).otherwise(lo)
    day, month, year = within(bits(date, 0, 31), 1, 31), within(bits(date, 5, 15), 1, 12), bits(date, 9, 127) + 1980
    second, minute, hour = within(bits(time, 0, 31) * 2, 0, 59), within(bits(time, 5, 63), 0, 59), within(bits(time, 11, 31), 0, 23)
    made = F.try_make_timestamp_ntz(year, month, day, hour, minute, second.cast("decimal(8,6)"))
    return F.coalesce(made, F.lit(MIN_TIME).cast("timestamp_ntz"))


def is_directory(name: Column, external: Column) -> Column:
    return F.endswith(name, F.lit("/")) | (external.cast("long").bitwiseAND(F.lit(DIRECTORY).cast("long")) != 0)


def attributes(directory: Column, host: Column, external: Column) -> Column:
    """Listing attributes: Directory; Normal for entries made on Unix; else Normal with the DOS bits."""
    dos = F.lit(READ_ONLY | HIDDEN | SYSTEM | ARCHIVE).cast("long").bitwiseAND(external.cast("long"))
    return F.when(directory, DIRECTORY).when(host == UNIX, NORMAL).otherwise(F.lit(NORMAL).cast("long").bitwiseOR(dos)).cast("int")


def flag(bits: Column, mask: int) -> Column:
    return bits.cast("int").bitwiseAND(mask) != 0


def host_os(version_made_by: Column) -> Column:
    return F.shiftright(version_made_by.cast("int"), 8).bitwiseAND(255)


def header_size(name_length: Column, extra_length: Column) -> Column:
    return (F.lit(30) + name_length + extra_length).cast("long")


def compression_ratio(compressed: Column, uncompressed: Column) -> Column:
    """Per cent saved, to one place, halves to even; 0 for empty entries."""
    return F.when(uncompressed == 0, F.lit(0.0)).otherwise(F.bround((F.lit(1.0) - compressed / uncompressed) * 100, 1))


def size_bucket(size: Column) -> Column:
    out = F.when(size < 0, "tiny")
    for name, below in BUCKETS.items():
        out = out.when(size < below, name)
    return out.otherwise("huge")


def tier(size: Column, cutoff: int = 50 * MIB) -> Column:
    return F.when(size < cutoff, "memory").otherwise("disk")


def chunk_count(size: Column, chunk: int) -> Column:
    return F.ceil(size / F.lit(chunk)).cast("long")


def chunk_index(offset: Column, chunk: int) -> Column:
    return F.floor(offset / F.lit(chunk)).cast("long")


def chunk_length(index: Column, size: Column, chunk: int) -> Column:
    return F.least(F.lit(chunk).cast("long"), size - index * chunk)


def progress(done: Column, size: Column) -> Column:
    return F.when(size == 0, F.lit(1.0)).otherwise(done / size)


def clamped(size: Column, offset: Column, length: Column) -> Column:
    """Bytes that a read of length at offset gets."""
    return F.greatest(F.lit(0).cast("long"), F.least(length, size - offset)).cast("long")


def read_range(content: Column, offset: Column, length: Column) -> Column:
    size = F.octet_length(content)
    n = clamped(size.cast("long"), offset.cast("long"), length.cast("long")).cast("int")
    return F.when(n > 0, F.substring(content, offset.cast("int") + 1, n)).otherwise(F.lit(b""))


def structure_bytes(n_entries: Column, format_id: Column) -> Column:
    """Estimated memory of a parsed archive."""
    per = F.when(format_id == "rar", STRUCTURE_BYTES["rar"]).otherwise(STRUCTURE_BYTES["zip"])
    return (F.lit(1024) + n_entries * per).cast("long")


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.coalesce(F.try_divide(hits, hits + misses), F.lit(0.0)).cast("double")
