"""Archive scans against zipfile, hand-made bytes and known names."""

import io
import struct
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from granary.plans.catalog_queries import _rar
from granary.sources import charset, discovery, rarscan, registry, zipscan
from granary.sources.ranged import File, Held

FILES = {"a.txt": b"hello " * 50, "dir/b.bin": bytes(range(256)) * 9, "dir/empty": b"", "ünï/c.txt": b"x"}


def made(method=zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.comment = b"PK not a signature"
        for name, data in FILES.items():
            z.writestr(name, data)
        z.writestr("dir/sub/", b"")
    return out.getvalue()


def frame(spark, **files):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "archive_key string, content binary")


def test_entries_and_contents(spark):
    files = frame(spark, one=made(), two=made(zipfile.ZIP_STORED))
    e = zipscan.entries(files)
    got = {(r.archive_key, r.internal_path): (r.size, r.is_directory) for r in e.collect()}
    assert got == {(k, n): (len(FILES.get(n, b"")), n.endswith("/")) for k in ("one", "two") for n in [*FILES, "dir/sub/"]}
    w = e.where("NOT is_directory").withColumns({"read_at": F.lit(None).cast("long"), "read_length": F.lit(None).cast("long")})
    assert {(r.archive_key, r.internal_path): bytes(r.data) for r in zipscan.extracted(files, w, verify=True).collect()} == {(k, n): d for k in ("one", "two") for n, d in FILES.items()}


def test_ranges(spark):
    files = frame(spark, one=made())
    w = zipscan.entries(files).where("internal_path = 'dir/b.bin'").withColumns({"read_at": F.lit(2300).cast("long"), "read_length": F.lit(50).cast("long")})
    assert bytes(zipscan.extracted(files, w).first().data) == FILES["dir/b.bin"][2300:2350]


def test_broken_archives(spark):
    good = made()
    rows = {r.archive_key: r.error for r in zipscan.raw_entries(frame(spark, short=b"PK", none=b"x" * 100, cut=good[:40] + good[60:])).where("error IS NOT NULL").collect()}
    assert set(rows) == {"short", "none", "cut"}
    with pytest.raises(zipscan.BadArchive):
        zipscan.read_entry(Held(good), zipscan.ENCRYPTED, 0, 1, 1, 0)
    with pytest.raises(zipscan.BadArchive):
        zipscan.read_entry(Held(good), 0, 99, 1, 1, 0)
    with pytest.raises(zipscan.BadArchive):
        zipscan.data_start(Held(good), len(good))


def test_wide_fields():
    extra = struct.pack("<2H2Q", 1, 16, 5_000_000_000, 6_000_000_000)
    assert zipscan._wide(extra, 0xFFFFFFFF, 7, 0xFFFFFFFF) == [5_000_000_000, 7, 6_000_000_000]


def test_chunks(spark):
    d = spark.createDataFrame([("z", "p", bytearray(range(25))), ("z", "e", bytearray())], "archive_key string, internal_path string, data binary")
    assert [(r.chunk_index, r.chunk_offset, bytes(r.bytes)) for r in zipscan.chunks(d, 10).orderBy("chunk_index").collect()] == [(k, k * 10, bytes(range(25))[k * 10 : k * 10 + 10]) for k in range(3)]


@pytest.mark.parametrize("code, names", [
    ("cp932", ["テスト.txt", "ゲーム.exe", "データ.dat", "こんにちは.txt", "マップ.wad"]), ("gbk", ["游戏文件.txt", "中文说明.doc", "数据备份.zip", "图片资料.jpg", "安装程序.exe"]),
    ("cp949", ["한국어파일.txt", "게임데이터.dat", "설명서.doc", "사진첩.jpg", "음악파일.mp3"]), ("cp1251", ["Привет мир.txt", "документация.doc", "фотографии.jpg", "музыка и звуки.mp3", "установка.exe"]),
])
def test_charset(code, names):
    blob = b"\0".join(n.encode(code) for n in names)
    assert blob.decode(charset.detect(blob)) == "\0".join(names)


def test_ascii_and_threshold():
    assert charset.detect(b"plain.txt") is None
    assert charset.detect("да.txt".encode("cp1251"), threshold=0.99) is None
    assert charset.decode("é".encode("cp437"), None, "cp437", 0.99) == "é"


def test_discovery(spark, tmp_path):
    for name in ("a.zip", "sub/B.ZIP", "sub/deep/c.rar", "note.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(made())
    found = lambda depth: {(r.virtual_path, r.format_id) for r in discovery.discover(spark, str(tmp_path), depth).collect()}
    assert found(6) == {("a.zip", "zip"), ("sub/B.ZIP", "zip"), ("sub/deep/c.rar", "rar")}
    assert found(0) == found(1) == {("a.zip", "zip")}
    assert discovery.describe(spark, str(tmp_path), f"{tmp_path}/a.zip").count() == 1
    assert discovery.describe(spark, str(tmp_path), f"{tmp_path}/gone.zip").count() == discovery.describe(spark, str(tmp_path), f"{tmp_path}/note.txt").count() == 0


def rar5(solid: bool) -> bytes:
    """A version 5 archive: main header, and a stored file of three bytes."""
    main = bytes([3, 1, 0, 4 if solid else 0])[1:]
    head = lambda body: b"\0\0\0\0" + bytes([len(body)]) + body
    file = bytes([2, 2, 3, 4, 3, 0]) + struct.pack("<L", 7) + bytes([0, 0, 5]) + b"d/f.x"
    return rarscan.RAR5 + head(main) + head(file) + b"abc" + head(bytes([5, 0, 0]))


def test_rar(spark):
    files = frame(spark, plain=rar5(False), solid=rar5(True), bad=b"nothing")
    assert {r.archive_key: r.supported for r in rarscan.probed(files).collect()} == {"plain": True, "solid": False, "bad": True}
    got = {r.archive_key: (r.internal_path, r.size, r.error) for r in rarscan.entries(files).collect()}
    assert got["plain"] == ("d/f.x", 3, None) and got["solid"][0] == rarscan.WARNING and got["bad"][2]
    assert rarscan.read_entry(rar5(False), "d/f.x") == b"abc"
    assert rarscan.read_entry(rar5(True), rarscan.WARNING) == rarscan.WARNING_TEXT
    v = spark.createDataFrame([(bytearray(rarscan.RAR5),), (bytearray(rarscan.RAR4),), (bytearray(b"x"),)], "c binary").select(rarscan.version(F.col("c")).alias("v"))
    assert [r.v for r in v.collect()] == [5, 4, 0]


def test_charset_of_an_archive_from_all_its_names(spark):
    """The first 4,200 names in order of bytes look like Hangul; only later ones tell that they are Cyrillic."""
    names = [f"{k:05d}ЖЖЖЖ.txt" for k in range(4200)] + [f"9{k:04d}приветы.txt" for k in range(300)]
    rows = spark.createDataFrame([("a.zip", bytearray(n.encode("cp1251"))) for n in names], "archive_key string, n binary")
    got = charset.decoded(rows, "archive_key", "n", F.lit(False)).collect()
    assert sorted(r.name for r in got) == sorted(names)


def test_listing_a_large_archive_reads_its_ends_alone(spark, tmp_path):
    """A sparse file of 5 GB with 64-bit records: 5,000 entries, of which the last lies beyond 4 GB."""
    path, far = f"{tmp_path}/big.zip", 5_000_000_000
    names = [f"d/f{k:05}.txt".encode() for k in range(5000)]
    data = b"at the end"
    local = zipscan.LOCAL + struct.pack("<5H3L2H", 45, 0, 0, 0, 33, 0, len(data), len(data), len(names[-1]), 0) + names[-1]
    directory = b""
    for k, n in enumerate(names):
        wide = struct.pack("<2HQ", 1, 8, far) if n == names[-1] else b""
        directory += zipscan.CENTRAL + struct.pack("<6H3L5H2L", 45, 45, 0, 0, 0, 33, 0, len(data), len(data), len(n), len(wide), 0, 0, 0, 0, 0xFFFFFFFF if wide else k) + n + wide
    with open(path, "wb") as f:
        f.seek(far)
        f.write(local + data)
        at = f.tell()
        f.write(directory)
        end64 = f.tell()
        f.write(zipscan.END64 + struct.pack("<Q2H2L4Q", 44, 45, 45, 0, 0, 5000, 5000, len(directory), at) + zipscan.LOCATOR64 + struct.pack("<LQL", 0, end64, 1))
        f.write(zipscan.END + struct.pack("<4H2LH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    src = File("file:" + path)
    listed = list(zipscan.central_directory(src, zipscan.end_record(src)))
    assert [e[0] for e in listed] == names and listed[-1][-1] == far and src.read_bytes < 1_000_000
    archives = spark.createDataFrame([("big", path), ("gone", f"{tmp_path}/no.zip")], "archive_key string, physical_path string")
    e = zipscan.entries(archives)
    w = e.where("internal_path = 'd/f04999.txt'").withColumns({"read_at": F.lit(3).cast("long"), "read_length": F.lit(3).cast("long")})
    assert e.count() == 5000 and bytes(zipscan.extracted(archives, w).first().data) == b"the"
    assert [r.archive_key for r in zipscan.broken(archives).collect()] == ["gone"]


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_streams_in_pieces(step):
    for method in (zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED):
        src = Held(made(method))
        for e in zipscan.central_directory(src, zipscan.end_record(src), step=60):
            want = FILES.get(e[0].decode("utf-8"), b"")
            for at, most in ((0, None), (5, 100), (2300, 50), (9999, 1)):
                pieces = list(zipscan.stream(src, e[2], e[3], e[7], e[8], e[10], at, most, step))
                assert b"".join(pieces) == want[at : None if most is None else at + most] and all(len(p) <= step for p in pieces)


def test_spans_are_read_once(spark):
    files = frame(spark, one=made(), two=made(zipfile.ZIP_STORED))
    for most in (1, 300, 10**6):
        got = {(r.archive_key, r.internal_path): bytes(r.data) for r in zipscan.read_spans(files, zipscan.entries(files), most).collect()}
        assert got == {(k, n): d for k in ("one", "two") for n, d in FILES.items()}
    asks = [{"offset": o, "compressed_size": 10} for o in (0, 100, 5000)]
    assert [(low, [a["offset"] for a in some]) for low, _, some in zipscan.spans(asks, 1000, 50)] == [(0, [0, 100]), (5000, [5000])]


def test_rar_reads_headers_once(spark, monkeypatch):
    """An archive's headers are gone through once, however many of its entries are asked for: in both versions, with ranges, and up to a break."""
    files_ = {f"{k}{five}": (f"d/{k}.x", bytes([k]) * k, five) for k in range(200) for five in (True, False)}
    blobs = {five: _rar([(n, d) for n, d, f in files_.values() if f == five], five) for five in (True, False)}
    passes, walk = [], rarscan.headers
    monkeypatch.setattr(rarscan, "headers", lambda b: passes.append(1) or walk(b))
    for five, blob in blobs.items():
        d = rarscan.Directory(blob)
        assert all(d.read(n) == data and d.read(n, 2, 3) == data[2:5] and d.read(n, 2) == data[2:] for n, data, f in files_.values() if f == five)
        with pytest.raises(ValueError, match="no such entry"):
            d.read("none")
        half = rarscan.Directory(blob[: len(blob) // 2])
        assert half.read("d/9.x") == bytes([9]) * 9
    assert len(passes) == 4
    monkeypatch.undo()
    files = frame(spark, a5=blobs[True], a4=blobs[False])
    asked = [(f"a{5 if f else 4}", n, 1, 2) for n, _, f in files_.values()] + [("a5", "none", None, None)]
    wanted = spark.createDataFrame(asked, "archive_key string, internal_path string, read_at long, read_length long")
    got = {(r.archive_key, r.internal_path): (r.data and bytes(r.data), r.error) for r in registry.RAR.read(files, wanted).collect()}
    assert got.pop(("a5", "none")) == (None, "no such entry")
    assert got == {(f"a{5 if f else 4}", n): (d[1:3], None) if len(d) > 1 else (b"", None) for n, d, f in files_.values()}


def test_rar_is_made_in_linear_time():
    """Twenty times the files of 20 KB take far less than the square of that."""

    def seconds(n):
        t = time.process_time()
        b = _rar([(f"p/{k}.html", bytes(20_000)) for k in range(n)], n % 2 == 0)
        assert len(b) > n * 20_000
        return time.process_time() - t

    small = min(seconds(100) for _ in range(3))
    assert seconds(2000) < 100 * max(small, 0.001)
