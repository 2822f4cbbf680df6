"""Path functions, lookups and hierarchy by fixed cases."""

import pytest
from pyspark.sql import functions as F

from granary.functions import fields, paths
from granary.operators import catalog


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [
    (None, ""), ("", ""), ("  ", ""), ("\\", ""), ("/", ""), ("\\games\\doom.zip\\maps\\e1m1.wad", "games/doom.zip/maps/e1m1.wad"),
    ("/games/doom.zip/maps/e1m1.wad", "games/doom.zip/maps/e1m1.wad"), ("games/doom.zip/", "games/doom.zip"), ("games\\doom.zip\\", "games/doom.zip"),
    ("games//doom.zip///maps/e1m1.wad", "games/doom.zip/maps/e1m1.wad"),
])
def test_normalize(spark, raw, want):
    assert one(spark, paths.normalize(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw, want", [("folder\\file.txt", "folder/file.txt"), ("/folder/file.txt", "folder/file.txt"), ("\\folder\\file.txt", "folder/file.txt"), ("", ""), ("//a", "/a")])
def test_entry_name(spark, raw, want):
    assert one(spark, paths.entry_name(F.lit(raw))) == want


@pytest.mark.parametrize("path, want", [("\\a.zip\\Desktop.INI", True), ("\\$RECYCLE.BIN\\x", True), ("\\System Volume Information", True), ("thumbs.db", True), ("\\archive.zip\\$RECYCLE.BIN\\file.txt", False), ("\\a.zip\\readme.txt", False), ("", False)])
def test_shell_metadata(spark, path, want):
    assert one(spark, paths.shell_metadata(F.lit(path))) is want


@pytest.mark.parametrize("name, pattern, want", [("readme.txt", "*.TXT", True), ("a.b", "?.b", True), ("ab.b", "?.b", False), ("x(1).zip", "x(1).*", True), ("any", "*.*", True), ("any", "", True)])
def test_wildcards(spark, name, pattern, want):
    assert one(spark, paths.matches(F.lit(name), pattern)) is want


@pytest.mark.parametrize("size, want", [(0, "tiny"), (1023, "tiny"), (1024, "small"), (1048575, "small"), (1048576, "medium"), (10485759, "medium"), (10485760, "large"), (52428799, "large"), (52428800, "xlarge"), (524287999, "xlarge"), (524288000, "huge"), (2**63 - 1, "huge")])
def test_size_bucket(spark, size, want):
    assert one(spark, fields.size_bucket(F.lit(size).cast("long"))) == want


def test_chunks_and_ranges(spark):
    assert [one(spark, fields.chunk_count(F.lit(s).cast("long"), 10)) for s in (100, 105, 10, 1, 0)] == [10, 11, 1, 1, 0]
    assert [one(spark, fields.chunk_index(F.lit(o).cast("long"), 10)) for o in (0, 9, 10, 25)] == [0, 0, 1, 2]
    assert one(spark, fields.chunk_length(F.lit(10).cast("long"), F.lit(105).cast("long"), 10)) == 5
    content = F.lit(b"0123456789")
    assert bytes(one(spark, fields.read_range(content, F.lit(8), F.lit(5)))) == b"89"
    assert bytes(one(spark, fields.read_range(content, F.lit(10), F.lit(5)))) == b""


def test_dos_time(spark):
    at = lambda d, t: str(one(spark, fields.dos_timestamp(F.lit(d), F.lit(t)).cast("string")))
    assert at(0x5521, 0) == "2022-09-01 00:00:00"
    assert at((44 << 9) | (2 << 5) | 30, 0) == "0001-01-01 00:00:00"  # 30 February
    assert at((44 << 9) | (13 << 5) | 0, 0xFFFF) == "2024-01-01 00:00:00"


def test_ratio_halves_to_even(spark):
    assert one(spark, fields.compression_ratio(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, fields.compression_ratio(F.lit(25), F.lit(100))) == 75.0


@pytest.fixture(scope="module")
def archives(spark):
    return spark.createDataFrame([("games/doom.zip", 10), ("games/doom.zip/inner.zip", 5), ("Docs/a.zip", 7), ("root.zip", 1)], "virtual_path string, size_bytes long")


def test_longest_prefix(spark, archives):
    asked = ["games/doom.zip/inner.zip/x", "games/doom.zip/x", "games/doom.zipper/x", "GAMES/DOOM.ZIP", "games", "docs", "", "nope", "games/doom.zip/inner.zip"]
    got = {r.path: (r.status, r.archive, r.internal_path) for r in catalog.resolve(spark.createDataFrame([(a,) for a in asked], "path string"), archives).collect()}
    assert got == {
        "games/doom.zip/inner.zip/x": ("InsideArchive", "games/doom.zip/inner.zip", "x"), "games/doom.zip/x": ("InsideArchive", "games/doom.zip", "x"), "games/doom.zipper/x": ("NotFound", None, ""),
        "GAMES/DOOM.ZIP": ("ArchiveRoot", "games/doom.zip", ""), "games": ("VirtualFolder", None, ""), "docs": ("VirtualFolder", None, ""), "": ("VirtualRoot", None, ""), "nope": ("NotFound", None, ""),
        "games/doom.zip/inner.zip": ("ArchiveRoot", "games/doom.zip/inner.zip", ""),
    }


def test_case_can_matter(spark, archives):
    got = catalog.resolve(spark.createDataFrame([("GAMES/DOOM.ZIP",)], "path string"), archives, ignore_case=False).first()
    assert got.status == "NotFound"


def test_folders(spark, archives):
    assert {r.folder for r in catalog.virtual_folders(archives).collect()} == {"games", "games/doom.zip", "Docs"}
    top = {(r.name, r.is_archive) for r in catalog.list_folders(archives).where("folder = ''").collect()}
    assert top == {("games", False), ("Docs", False), ("root.zip", True)}


ENTRY = "archive_key string, internal_path string, is_directory boolean, size long, i int"


def test_parents(spark):
    e = spark.createDataFrame([("z", "a/b/", True, 0, 0), ("z", "a/b/f", False, 3, 1), ("z", "c/d/g", False, 4, 2), ("z", "h", False, 5, 3)], ENTRY)
    made = lambda **k: {r.internal_path for r in catalog.with_parents(e, **k).where("synthesized").collect()}
    assert made() == {"a/", "c/", "c/d/"}
    assert made(order="i") == {"c/", "c/d/"}  # climbing stops at a/b/, listed before its file


def test_lookup_and_existence(spark):
    e = spark.createDataFrame([("z", "a/", True, 0, 0), ("z", "f", False, 3, 1), ("z", "a", False, 9, 2)], ENTRY)
    asks = spark.createDataFrame([("z", "a"), ("z", "a/"), ("z", "f"), ("z", "f/"), ("y", "f")], "archive_key string, internal_path string")
    got = {(r.archive_key, r.internal_path): r.found_path for r in catalog.lookup(asks, e).collect()}
    assert got == {("z", "a"): "a", ("z", "a/"): "a/", ("z", "f"): "f", ("z", "f/"): None, ("y", "f"): None}
    assert {tuple(r) for r in catalog.files_that_exist(asks, e).collect()} == {("z", "a"), ("z", "f")}


def test_add_hides_or_renames(spark, archives):
    new = spark.createDataFrame([("ROOT.zip", 50, True), ("s.rar", 9, False)], "virtual_path string, size_bytes long, supported boolean")
    assert {tuple(r) for r in catalog.add(archives, new).collect()} == {("games/doom.zip", 10), ("games/doom.zip/inner.zip", 5), ("Docs/a.zip", 7), ("ROOT.zip", 50)}
    assert ("s.rar (NOT SUPPORTED)", 0) in {tuple(r) for r in catalog.add(archives, new, hide_unsupported=False).collect()}


def test_empty_tables(spark, archives):
    none = archives.limit(0)
    assert catalog.volume(none, "x").first().total_bytes == 0
    assert catalog.virtual_folders(none).count() == catalog.reconcile(none, none).count() == 0
