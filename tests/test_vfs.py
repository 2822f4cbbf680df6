"""The facade over real archives, settings and the change source."""

import dataclasses
import io
import zipfile

import pytest
from pyspark import StorageLevel

from granary.plans import vfs
from granary.sources import registry, watch
from tests.test_sources import rar5


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("archives")
    for name in ("a.zip", "games/b.ZIP"):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("docs/readme.txt", b"hello world" * 20)
            z.writestr("top.bin", bytes(range(256)))
        (top / name).parent.mkdir(exist_ok=True)
        (top / name).write_bytes(out.getvalue())
    (top / "ok.rar").write_bytes(rar5(False))
    (top / "solid.rar").write_bytes(rar5(True))
    return top


def test_tree(spark, root):
    v = vfs.VirtualFileSystem(spark).mount(str(root))
    assert {r.virtual_path for r in v.registered().collect()} == {"a.zip", "games/b.ZIP", "ok.rar"}
    assert {(r.name, r.is_directory) for r in v.list_directory("\\").collect()} == {("a.zip", True), ("games", True), ("ok.rar", True)}
    assert {r.full_path for r in v.list_directory("GAMES/b.zip").collect()} == {"games/b.ZIP/docs", "games/b.ZIP/top.bin"}
    assert v.list_directory("a.zip/none").count() == 0
    assert {r.name for r in v.find("a.zip", "*.BIN").collect()} == {"top.bin"}
    assert v.read("a.zip/docs/readme.txt", 6, 5) == b"world" and v.read("a.zip/top.bin", 256, 9) == b"" and v.read("a.zip/top.bin", 250) == bytes(range(250, 256))
    assert v.read("ok.rar/d/f.x") == b"abc"
    assert v.file_exists("a.zip/top.bin") and not v.file_exists("a.zip/docs") and v.directory_exists("a.zip/docs") and v.directory_exists("games") and not v.directory_exists("a.zip/top.bin")
    assert v.file_info("a.zip/docs/readme.txt").size == 220
    for path, error in (("nope", vfs.NotFound), ("a.zip/nope", vfs.NotFound), ("a.zip", vfs.AccessDenied), ("a.zip/docs", vfs.AccessDenied)):
        with pytest.raises(error):
            v.read(path)
    with pytest.raises(vfs.AccessDenied):
        v.write("a.zip/x", b"")
    assert v.volume().total_bytes == sum((root / p).stat().st_size for p in ("a.zip", "games/b.ZIP", "ok.rar"))
    assert {r.archive_key: r.n_entries for r in v.totals().collect()} == {"a.zip": 3, "games/b.ZIP": 3, "ok.rar": 2}
    v.remove("A.zip")
    assert not v.directory_exists("a.zip")
    v.unmount()
    with pytest.raises(RuntimeError):
        v.volume()


def test_kept_structures(spark, root):
    """Archives are listed once while they are kept, again after a change, and answers are those without keeping."""
    listed = spark.sparkContext.accumulator(0)
    zips = registry.ZIP

    def entries(archives):
        def seen(batches):
            for b in batches:
                listed.add(b.num_rows)
                yield b

        return zips.entries(archives.mapInArrow(seen, archives.schema))

    formats = registry.Registry(dataclasses.replace(zips, entries=entries), registry.RAR)
    v, plain = vfs.VirtualFileSystem(spark, formats, storage=StorageLevel.MEMORY_AND_DISK), vfs.VirtualFileSystem(spark)
    v.mount(str(root)), plain.mount(str(root))
    n = v.warm()
    once = listed.value
    assert once > 0 and v.warm() == n == sum(r.n_entries for r in plain.totals().collect())
    assert sorted(v.list_directory("a.zip").collect()) == sorted(plain.list_directory("a.zip").collect())
    assert v.file_info("a.zip/docs/readme.txt") == plain.file_info("a.zip/docs/readme.txt") and v.directory_exists("games/b.zip/docs") and not v.file_exists("a.zip/nope")
    assert sorted(v.totals().collect()) == sorted(plain.totals().collect()) and listed.value == once
    v.remove("a.zip")
    assert not v.directory_exists("a.zip/docs") and v.file_info("games/b.zip/top.bin").size == 256 and {r.archive_key for r in v.totals().collect()} == {"games/b.ZIP", "ok.rar"}
    assert listed.value > once
    v.unmount()
    with pytest.raises(RuntimeError):
        v.warm()
    with pytest.raises(ValueError):
        plain.warm()


def test_unsupported_shown(spark, root):
    v = vfs.VirtualFileSystem(spark, hide_unsupported=False).mount(str(root))
    assert "solid.rar (NOT SUPPORTED)" in {r.virtual_path for r in v.registered().collect()}


def test_single_file(spark, root):
    v = vfs.VirtualFileSystem(spark)
    assert v.mount_file(str(root / "a.zip")) and v.label == "a" and not v.mount_file(str(root / "none.zip")) and not v.mount_file(str(root / "x.txt"))


def test_options():
    one = '{"Mount": {"MountPoint": "R:\\\\", /* drive */ "MaxDiscoveryDepth": 6,}, // all\n "Cache": {"Url": "http://x"}}'
    assert vfs.options(one, '{"Mount": {"MaxDiscoveryDepth": 2}}', args=["/data", "--Cache:MemoryMb=10"]) == {"Mount": {"MountPoint": "R:\\", "MaxDiscoveryDepth": 2, "ArchiveDirectory": "/data"}, "Cache": {"Url": "http://x", "MemoryMb": "10"}}


def test_watch(spark, tmp_path):
    assert watch.differences(["a", "b"], ["b", "c"]) == [("a", "deleted"), ("c", "created")]
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.zip").write_bytes(b"")
    spark.dataSource.register(watch.ArchiveChanges)
    seen = []
    q = spark.readStream.format("archive_changes").load(str(folder)).writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: seen.extend((r.path, r.op) for r in df.collect())).start()
    try:
        q.processAllAvailable()
        (folder / "a.zip").unlink()
        (folder / "sub/b.ZIP").write_bytes(b"")
        (folder / "note.txt").write_bytes(b"")
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen == [("a.zip", "created"), ("a.zip", "deleted"), ("sub/b.ZIP", "created")]


def test_retry(tmp_path):
    waited = []
    assert not watch.until_readable(str(tmp_path / "late.zip"), sleep=waited.append) and waited == [1, 2, 4]

    def arrives(s):
        waited.append(s)
        (tmp_path / "late.zip").write_bytes(b"")

    assert watch.until_readable(str(tmp_path / "late.zip"), sleep=arrives) and waited == [1, 2, 4, 1]
