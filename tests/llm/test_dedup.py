"""Jaccard join and substring removal against brute force."""

import collections
import hashlib
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import jaccard, substring
from granary.llm.blocks import Words, window_hashes
from granary.llm.common import release


def sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    s = {d: sets(t) for d, t in rows}
    up = {d: d for d in s}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    links = collections.Counter()
    for a in s:
        for b in s:
            if a < b and (s[a] or s[b]) and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
                links.update((a, b))
    return {d: (len(s[d]), top(d), links[d]) for d in s}


def test_components(docs, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.classes(docs)[0].collect()}
    assert got == brute_components([(r[0], r[1]) for r in corpus])


def test_blocks_of_large_clusters(docs, corpus, monkeypatch):
    """Clusters in many blocks and bands, hubs for every shared shingle, and small tables of marks."""
    for name, v in (("BLOCK_SHINGLES", 300), ("PAIRED", 2), ("CELLS", 2000), ("PIECE", 5000), ("FREQUENT", 50), ("MEMBERS", 1)):
        monkeypatch.setattr(jaccard, name, v)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.classes(docs)[0].collect()}
    assert got == brute_components([(r[0], r[1]) for r in corpus])


def near_copies(n=12, words=120):
    """Ids and texts that have all but their last shingle in common, and others alike by twos."""
    base = [f"w{k}" for k in range(words)]
    return [(k, " ".join([*base, f"end{k}"])) for k in range(n)] + [(n + k, " ".join(f"x{k // 2}y{i}" for i in range(40 + k % 2))) for k in range(6)]


def test_moved_texts_meet_their_tasks(spark, monkeypatch):
    """Sets above MEMBERS, in many blocks, of texts that are looked at one by one."""
    rows = near_copies()
    for name, v in (("BLOCK_SETS", 4), ("MEMBERS", 1), ("TOGETHER", 1), ("PIECE", 1)):
        monkeypatch.setattr(jaccard, name, v)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    assert got == brute_components(rows)


def test_memory_is_bounded_by_bytes(monkeypatch):
    """However many texts come at once, the arrays of words are those of TOGETHER bytes or one text."""
    texts, seen = [t.encode() for _, t in near_copies(200)], []
    want = jaccard.shingle_sets(texts)
    monkeypatch.setattr(jaccard, "Words", lambda t: seen.append(sum(map(len, t[:-1]))) or Words(t))
    monkeypatch.setattr(jaccard, "TOGETHER", 2000)
    assert all((x == y).all() for x, y in zip(jaccard.shingle_sets(texts), want, strict=True)) and len(seen) > 20 and max(seen) < 2000


def test_keys_of_the_same_sets_are_counted_first(spark):
    """Keys are as many pairs as their sets make, but keys with the same sets are one row of pairs."""
    some = [(key, node) for key in range(50) for node in range(10)] + [(50, 1), (50, 2), (50, 3)]
    got = jaccard._counted(spark.createDataFrame([(7, 8), (7, 8), (1, 2)], "low long, high long"), spark.createDataFrame(some, "key long, node long"))
    want = collections.Counter((a, b) for a in range(10) for b in range(a + 1, 10) for _ in range(50)) + collections.Counter([(1, 2), (1, 3), (2, 3), (7, 8), (7, 8), (1, 2)])
    assert {(r.a, r.b): r.c for r in got.collect()} == dict(want)
    assert "sum(c" in got._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]


def test_shuffle_files_go_before_the_clusters(docs, monkeypatch):
    """Of the steps before the clusters, no shuffle files are left when these begin."""
    disk, left = docs.sparkSession.sparkContext._jsc.sc().env().blockManager().diskBlockManager(), []

    def shuffles():
        files = disk.getAllFiles()
        return {files.apply(k).getName() for k in range(files.size())}

    release(docs.sparkSession)
    time.sleep(2)
    before, make = shuffles(), jaccard.components

    def components(*a):
        time.sleep(2)
        left.append(len([x for x in shuffles() - before if x.endswith(".data")]))
        return make(*a)

    monkeypatch.setattr(jaccard, "components", components)
    jaccard.classes(docs)
    assert left[0] <= 12  # of the last step alone


def test_trees_against_pairs():
    rnd = np.random.default_rng(4)
    base = rnd.choice(2**62, 80, replace=False).astype(np.uint64)
    many = []
    for k in range(150):
        keep = base[rnd.random(80) < rnd.choice([0.6, 0.85, 0.97])]
        more = rnd.choice(2**62, rnd.integers(0, 10)).astype(np.uint64)
        many.append((k, np.unique(np.concatenate([keep, more]))))
    want = [(a, b) for a, x in many for b, y in many if a < b and 9 * len(np.intersect1d(x, y)) >= 4 * (len(x) + len(y))]
    for sides in ((many, None), (many[:70], many[70:])):
        links = jaccard.Links()
        if sides[1]:
            jaccard.join_sets(sides[0], None, links), jaccard.join_sets(sides[1], None, links)
        jaccard.join_sets(sides[0], sides[1], links)
        plain = jaccard.Links()
        for a, b in want:
            plain.add(a, b)
        assert [links.top(k) for k in range(150)] == [plain.top(k) for k in range(150)]
        assert set(map(tuple, map(sorted, links.kept))) <= set(want)


def test_one_of_each(docs, corpus):
    want = {d for d, (n, c, _) in brute_components([(r[0], r[1]) for r in corpus]).items() if d == c}
    kept = jaccard.one_of_each(docs)
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns


def test_odd_rows(odd, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.classes(odd)[0].collect()), key=str)
    assert got == sorted([(None, 116, 5, 2), (None, 0, None, 0), (5, 116, 5, 2), (5, 116, 5, 2), (2, 0, 2, 0)], key=str)
    assert jaccard.classes(none)[0].count() == jaccard.one_of_each(none).count() == substring.digested(none).count() == 0
    s = {(r.doc_id, r.n_words, r.n_removed) for r in substring.digested(odd).collect()}
    assert s == {(None, 120, 120), (None, 0, 0), (5, 120, 0), (2, 0, 0)}


def test_one_of_each_of_odd_rows(spark, odd):
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(map(str, ((r.doc_id, bool(r.text)) for r in kept.collect()))) == sorted(map(str, [(None, False), (2, False), (5, True)]))
    # Repeated rows, one id with different texts, null ids alone, and null ids beside an id.
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(150)) for x in "abcd")
    rows = [(7, a)] * 300 + [(None, a)] * 20 + [(7, b), (8, b), (None, c), (None, c + " more"), (9, d), (9, d + " more"), (3, ""), (3, "")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r.text or "")[:1] for r in kept) == ["", "", "a", "b", "c", "d"]
    assert {(r.doc_id, r.text[:1]) for r in kept if r.text[:1] in "ad"} >= {(7, "a"), (9, "d")}


def brute_removed(rows, span=50):
    words = {d: (t or "").encode().split() for d, t in rows}
    first = {}
    for d, w in words.items():
        for i in range(len(w) - span + 1):
            k = tuple(w[i : i + span])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - span + 1):
            if first[tuple(w[i : i + span])] < d:
                gone.update(range(i, i + span))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_removed(docs, corpus, monkeypatch):
    want = brute_removed([(r[0], r[1]) for r in corpus])
    for size in (4_000_000, 3000):
        monkeypatch.setattr(substring.pack, "__defaults__", (size,))
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digested(docs).collect()} == want


def test_factors_rebuild_the_texts(docs, corpus, monkeypatch):
    """Every factor is what its source holds there, is as long as it can be, and the factors cover what is removed."""
    words = {r[0]: (r[1] or "").encode().split() for r in corpus}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            first.setdefault(tuple(words[d][i : i + 50]), (d, i))
    want = brute_removed([(r[0], r[1]) for r in corpus])
    copies = {d for d in words if len(words[d]) >= 50 and any(words[e] == words[d] for e in words if e < d)}
    found = []
    for size in (4_000_000, 3000):
        monkeypatch.setattr(substring.pack, "__defaults__", (size,))
        rows = sorted(map(tuple, substring.removed_spans(docs).collect()))
        found.append(rows)
        cover = collections.defaultdict(set)
        for d, at, n, source, there in rows:
            assert n >= 50 and source < d and words[d][at : at + n] == words[source][there : there + n]
            cover[d].update(range(at, at + n))
            if d not in copies:
                assert first[tuple(words[d][at : at + 50])] == (source, there)
                assert first.get(tuple(words[d][at + n - 49 : at + n + 1])) != (source, there + n - 49)
            else:
                assert n == len(words[d])
        assert {d: len(c) for d, c in cover.items()} == {d: n for d, (_, n, _) in want.items() if n}
    assert found[0] == found[1]


def test_kept_text(docs, corpus):
    by = dict((r[0], r[1]) for r in corpus)
    got = {r.doc_id: r for r in substring.deduplicated(docs).collect()}
    assert all(r.kept == " ".join((by[d] or "").split()) for d, r in got.items() if not r.n_removed)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\tab.,é¿'1"), max_size=40), max_size=6))
def test_words(texts):
    raw = [t.encode() for t in texts]
    w = Words(raw)
    assert w.at(np.arange(len(w))) == [x for t in raw for x in t.split()]
    assert w.n.tolist() == [len(t.split()) for t in raw]
    every = w.at(np.arange(len(w)))
    assert len(set(every)) == len(set(w.hash.tolist()))
    h = window_hashes(w.hash, 2)
    pairs = list(zip(every, every[1:]))
    assert len(set(pairs)) == len(set(h.tolist()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("\0\1 a"), max_size=12), max_size=5))
def test_words_with_null_characters(texts):
    """NUL is a character of words; the words \\0, \\0\\0, a and a\\0 differ."""
    w = Words([t.encode() for t in texts])
    every = w.at(np.arange(len(w)))
    assert every == [x for t in texts for x in t.encode().split()]
    assert [w.at(w.first)[k] for k in w.of] == every and len(w.first) == len(set(every)) == len(set(w.hash.tolist()))


def test_words_whose_sums_collide():
    """Words that agree in the sum modulo 2**64, whatever its odd factor, are told apart by their bytes."""
    a, b = b"a", b"b"
    for _ in range(11):
        a, b = a + b, b + a
    w = Words([a + b" " + b + b" x " + a])
    assert w.of[0] == w.of[3] and len({*w.of.tolist()}) == 3 and len(set(w.hash.tolist())) == 3
