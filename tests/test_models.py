"""Folds, windows, caches and streams against plain Python models."""

import itertools
import random

from pyspark.sql import functions as F

from granary.operators import caching, changes, planning
from granary.streaming import consolidate

FOLD = {("", "c"): "Added", ("", "d"): "Removed", ("Added", "c"): "Added", ("Added", "d"): "Noop", ("Noop", "c"): "Added", ("Noop", "d"): "Removed", ("Removed", "c"): "Modified", ("Removed", "d"): "Removed", ("Modified", "c"): "Added", ("Modified", "d"): "Removed"}


def test_fold_all_short_sequences(spark):
    rows, want = [], {}
    for n in range(1, 7):
        for seq in itertools.product("cd", repeat=n):
            state, path = "", "".join(seq)
            for k, op in enumerate(seq):
                state = FOLD[state, op]
                rows.append(("r", path, "created" if op == "c" else "deleted", k, k))
            want[path] = state
    got = {r.path: r.kind for r in changes.changes(spark.createDataFrame(rows, "root string, path string, op string, ts long, seq long"), ["path"]).collect()}
    assert got == {k: v for k, v in want.items() if v != "Noop"}


def test_fold_intended_mode(spark):
    ops = spark.createDataFrame([(["deleted", "created", "created"],)], "ops array<string>")
    assert ops.select(changes.folded(F.col("ops"), True).alias("a"), changes.folded(F.col("ops"), False).alias("b")).first().asDict() == {"a": "Added", "b": "Modified"}


def shrink(w, least):
    ratio = lambda lo, hi: 0 if lo > hi else sum(c for _, c in w[lo : hi + 1]) / s if (s := w[hi][0] + w[hi][1] - w[lo][0]) > 0 else 1.0
    lo, hi = 0, len(w) - 1
    while hi > lo and ratio(lo, hi) < least:
        lo, hi = (lo + 1, hi) if ratio(lo + 1, hi) >= ratio(lo, hi - 1) else (lo, hi - 1)
    return w[lo : hi + 1]


def test_shrink_against_model(spark):
    rnd, rows, want = random.Random(5), [], {}
    for t in range(150):
        at, w = 0, []
        for _ in range(rnd.randint(1, 12)):
            at += rnd.randint(0, 400)
            c = rnd.randint(0, 500)
            w.append((at, c))
            at += c
        rows += [("z", t, o, c) for o, c in w]
        want[t] = shrink(sorted(w), 0.8)
    got = {r.trigger_offset: [tuple(x) for x in r.plan] for r in planning.shrunk(spark.createDataFrame(rows, "archive_key string, trigger_offset long, offset long, compressed_size long"), 0.8).collect()}
    assert got == want


def test_span_vectors(spark):
    d = spark.createDataFrame([("z", 4000, 0, 100), ("z", 4000, 8100, 100), ("y", 500, 0, 500), ("y", 500, 1000, 500)], "archive_key string, trigger_offset long, offset long, compressed_size long")
    assert {r.archive_key: len(r.plan) for r in planning.shrunk(d.where("archive_key = 'z'"), 0.8).union(planning.shrunk(d.where("archive_key = 'y'"), 0.65)).collect()} == {"z": 1, "y": 2}


def test_centered_window_moves_inwards(spark):
    rows = [("z", t, o) for t in (0, 55, 1000) for o in range(0, 100, 10)]
    got = planning.centered(spark.createDataFrame(rows, "archive_key string, trigger_offset long, offset long"), 4).groupBy("trigger_offset").agg(F.array_sort(F.collect_list("offset")).alias("o")).collect()
    assert {r.trigger_offset: r.o for r in got} == {0: [0, 10, 20, 30], 55: [40, 50, 60, 70], 1000: [60, 70, 80, 90]}


def test_lru_victims_against_model(spark):
    rnd, rows, needs, want = random.Random(3), [], [], set()
    for c in range(25):
        entries = [(f"c{c}", f"k{k}", rnd.randint(1, 50), k * 7 % 20, rnd.random() < 0.2) for k in range(20)]
        current, required = sum(e[2] for e in entries), rnd.randint(0, 200)
        needs.append((f"c{c}", required, current, current - rnd.randint(-100, 100)))
        need, freed = required - (needs[-1][3] - current), 0
        for e in sorted(entries, key=lambda e: (e[3], e[1])):
            if e[4]:
                continue
            if freed >= need:
                break
            freed += e[2]
            want.add(e[:2])
        rows += [(*e[:4], int(e[4])) for e in entries]
    got = caching.lru_victims(spark.createDataFrame(rows, "cache string, key string, size long, last_access long, borrowed int"), spark.createDataFrame(needs, "cache string, required long, current long, capacity long"))
    assert {(r.cache, r.key) for r in got.collect()} == want


def test_victims_by_a_policy_of_ones_own(spark):
    rows = [("c", "a", 10, 1, 0), ("c", "b", 40, 2, 0), ("c", "d", 40, 3, 0), ("c", "e", 90, 4, 1), ("x", "f", 5, 1, 0)]
    e = spark.createDataFrame(rows, "cache string, key string, size long, last_access long, borrowed int")
    needs = spark.createDataFrame([("c", 50, 180, 180)], "cache string, required long, current long, capacity long")
    assert {r.key for r in caching.victims(e, needs, F.col("size").desc()).collect()} == {"b", "d"}  # the largest that nobody holds
    assert {r.key for r in caching.victims(e, needs, F.col("last_access")).collect()} == {r.key for r in caching.lru_victims(e, needs).collect()} == {"a", "b"}


def test_simulation(spark):
    log = [("c", 0, 0.0, "a", 60), ("c", 1, 1.0, "b", 50), ("c", 2, 2.0, "a", 60), ("c", 3, 50.0, "b", 50), ("c", 4, 200.0, "b", 50), ("c", 5, 201.0, "big", 500)]
    got = caching.simulated(spark.createDataFrame(log, "cache string, seq long, ts double, key string, size long"), 100, 100.0).orderBy("seq").collect()
    assert [(r.hit, r.evicted, r.bytes_held) for r in got] == [(False, 0, 60), (False, 1, 50), (False, 1, 60), (False, 1, 50), (False, 0, 50), (False, 1, 500)]


def test_stream(spark, tmp_path):
    rows = [("r", "a.zip", "created", "2024-01-01 00:00:00", 0), ("r", "a.zip", "deleted", "2024-01-01 00:00:03", 1), ("r", "b.zip", "created", "2024-01-01 00:00:04", 2), ("r", "c.zip", "deleted", "2024-01-01 00:01:00", 3), ("r", "z.zip", "created", "2024-01-01 01:00:00", 4)]
    schema = "root string, path string, op string, ts timestamp, seq long"
    spark.createDataFrame([(*r[:3], __import__("datetime").datetime.fromisoformat(r[3]), r[4]) for r in rows], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    q = consolidate.consolidated(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda df, _: seen.extend((r.path, r.kind) for r in df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [("b.zip", "Added"), ("c.zip", "Removed")]


def test_nearest_by_chunks_is_nearest_of_all(spark):
    import random

    rnd = random.Random(4)
    rows = [("a", f"{rnd.choice('xy')}/{k}", False, o, 5, rnd.choice([10, 10, 99])) for k, o in enumerate(rnd.sample(range(1000), 80))]
    layout = spark.createDataFrame(rows, "archive_key string, internal_path string, is_directory boolean, offset long, compressed_size long, size long")
    triggers = layout.select("archive_key", "internal_path", F.col("offset").alias("trigger_offset"))
    for k in (1, 3, 100):
        got = {}
        for r in planning.nearest(layout, triggers, 50, k).collect():
            got.setdefault(r.trigger_offset, []).append((r.rank, r.offset))
        for _, path, _, at, _, _ in rows:
            want = sorted((abs(r[3] - at), r[3]) for r in rows if r[1][0] == path[0] and r[5] <= 50)[:k]
            assert [o for _, o in sorted(got.get(at, []))] == [o for _, o in want]
