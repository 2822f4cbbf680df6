"""Removal of passages that stand in an earlier document, by relative Lempel-Ziv parsing.

The reference is the corpus itself: every run of SPAN words is indexed at its first place, in the document with the smallest
id. A document is factored against it: a factor begins at the next word from which SPAN words stand in an earlier document,
and is the longest match from there, that is, it grows as long as the SPAN words that end with the next one are indexed at the
next place of the same document. As every run has one place in the index, there is one such match. Where a factor ends, the SPAN
words that begin in it and reach beyond its boundary are looked up like any others, so that the next factor may overlap it. Only
factors of SPAN words or more exist; their words are removed.

The index is kept by blocks of documents, each for its own. Between blocks, anchors tell which runs are worth asking
about: the least hash of the K-word sequences in a run is the same wherever the run stands, so a run in two blocks has an
anchor in two blocks. Runs with such an anchor are looked up exactly, by hash, across all blocks. A document that equals an earlier
one word for word is one factor, and is looked up as a whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.blocks import NO_ID, Words, column, each, each_with, pack, window_hashes
from granary.llm.common import forget, written

SPAN = 50
K = 8


class Parsed:
    """The words of a block's documents, one after the other, and their windows."""

    def __init__(self, ids: list[int], texts: list[bytes], span: int, anchors: bool = True):
        words = Words(texts)
        self.n, self.span = words.n, span
        self.starts = np.cumsum(self.n) - self.n
        h = words.hash
        k = min(K, span)
        # A hash of each whole document; 0 for those too short to hold a window.
        self.whole = np.zeros(len(ids), dtype=np.uint64)
        for d in np.flatnonzero(self.n >= span):
            self.whole[d] = window_hashes(h[self.starts[d] : self.starts[d] + self.n[d]], int(self.n[d]))[0] + np.uint64(self.n[d])
        self.ids = np.array(ids, dtype=np.int64)
        # Windows that reach into the next document are no windows.
        last = np.repeat(self.starts + self.n - span, self.n)
        self.at = np.flatnonzero(np.arange(len(h)) <= last)
        self.window = window_hashes(h, span)[self.at]
        self.doc = np.repeat(np.arange(len(ids)), self.n)[self.at]
        self.id = self.ids[self.doc]
        self.place = self.at - self.starts[self.doc]
        if anchors:
            g = window_hashes(h, k)
            self.anchor = _least(g, span - k + 1)[self.at] if len(self.at) else g[:0]


def _least(g: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive entries."""
    width, m = 1, g
    while width * 2 <= n:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(m) - (n - width)], m[n - width :]) if n > width else m


def _first(keys: np.ndarray, ids: np.ndarray, places: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct keys, the smallest id of each, and the first of that one's places."""
    by = np.lexsort((ids, keys) if places is None else (places, ids, keys))
    new = np.ones(len(by), dtype=bool)
    new[1:] = keys[by[1:]] != keys[by[:-1]]
    by = by[new]
    return (keys[by], ids[by]) if places is None else (keys[by], ids[by], places[by])


def _in(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted table."""
    if not len(table):
        return np.zeros(len(x), dtype=bool)
    k = np.searchsorted(table, x)
    k[k == len(table)] = 0
    return table[k] == x


def factors(p: Parsed, source: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Greedy longest factors: document, first word and length, source's id and first word there. source and place: the
    first place of each window of p; windows of which that is no earlier document begin no factor and are in none but by others'
    words."""
    f = np.flatnonzero(source < p.id)
    if not len(f):
        return f, f, f, f, f
    a, b = f[1:], f[:-1]
    begins = np.ones(len(f), dtype=bool)
    begins[1:] = (p.at[a] != p.at[b] + 1) | (p.doc[a] != p.doc[b]) | (source[a] != source[b]) | (place[a] != place[b] + 1)
    b = np.flatnonzero(begins)
    e = np.append(b[1:], len(f)) - 1
    return p.doc[f[b]], p.at[f[b]], p.at[f[e]] - p.at[f[b]] + p.span, source[f[b]], place[f[b]]


def _owners(p: Parsed, keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """The smallest id of a document with the same words as each, by the answers about whole documents and p's own."""
    real = p.whole != 0
    keys, owners = _first(np.concatenate([keys, p.whole[real]]), np.concatenate([owners, p.ids[real]]))
    out = p.ids.copy()
    if len(keys):
        out[real] = owners[np.searchsorted(keys, p.whole[real])]
    return out


def earlier(blocks: DataFrame, span: int = SPAN) -> DataFrame:
    """Answers for each block: (block, key, whole, owner, place) for the windows of the block that stand in another block's
    document with a smaller id than any document that has them in this one, and for its whole documents that are in other blocks
    too; owner is the smallest id, place the first there."""

    def anchors(k, ids, texts):
        p = Parsed(ids, texts, span)
        a = np.unique(p.anchor)
        real = p.whole != 0
        w, first = _first(p.whole[real], p.ids[real])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a) + len(w), k)), pa.array(np.concatenate([a, w]).view(np.int64)), pa.array([None] * len(a) + first.tolist(), pa.int64())], names=["block", "key", "first"]
        )

    rows = written(each(blocks, anchors, "block long, key long, first long"), "anchors")
    whole = F.col("first").isNotNull().alias("whole")
    shared = rows.groupBy("key", whole).agg(F.count("*").alias("m"), F.min("first").alias("owner")).where("m > 1").select("key", "whole", "owner")
    asked = written(rows.select("block", "key", whole).join(shared, ["key", "whole"]).select("block", "key", "owner"), "asked")
    forget(rows)

    def windows(k, ids, texts, answers):
        p = Parsed(ids, texts, span)
        key = column(answers, "key").view(np.uint64)
        anchor = np.asarray(answers.column("owner").is_null()) if answers.num_rows else np.zeros(0, dtype=bool)
        copy = _owners(p, key[~anchor], _longs(answers, "owner")) < p.ids
        hot = _in(p.anchor, np.sort(key[anchor])) & ~copy[p.doc]
        w, d, at = _first(p.window[hot], p.id[hot], p.place[hot])
        return pa.table({"block": pa.array(np.full(len(w), k), pa.int64()), "window": pa.array(w.view(np.int64)), "first": pa.array(d), "place": pa.array(at.astype(np.int32))})

    w = written(each_with(blocks, asked, windows, "block long, window long, first long, place int"), "windows")
    spot = F.struct("first", "place")
    owner = w.groupBy("window").agg(F.min(spot).alias("owner"), F.max("first").alias("last")).where("owner.first < last").select("window", "owner")
    found = w.join(owner, "window").where("owner.first < first").select("block", F.col("window").alias("key"), F.lit(False).alias("whole"), F.col("owner.first").alias("owner"), F.col("owner.place").alias("place"))
    copies = asked.where("owner IS NOT NULL").select("block", "key", F.lit(True), "owner", F.lit(0))
    out = written(found.union(copies), "earlier")
    forget(w, asked)
    return out


def _longs(answers: pa.Table, name: str) -> np.ndarray:
    """The values of a column that are not null."""
    return answers.column(name).drop_null().to_numpy() if answers.num_rows else np.zeros(0, dtype=np.int64)


def _parse(ids, texts, answers, span):
    p = Parsed(ids, texts, span, anchors=False)
    whole = np.asarray(answers.column("whole"), dtype=bool) if answers.num_rows else np.zeros(0, dtype=bool)
    key, owner, place = column(answers, "key").view(np.uint64), column(answers, "owner"), column(answers, "place")
    w, d, at = _first(np.concatenate([p.window, key[~whole]]), np.concatenate([p.id, owner[~whole]]), np.concatenate([p.place, place[~whole]]))
    k = np.searchsorted(w, p.window)
    source, at = d[k], at[k]
    first = _owners(p, key[whole], owner[whole])
    copy = (first < p.ids)[p.doc]
    return p, *factors(p, np.where(copy, first[p.doc], source), np.where(copy, p.place, at))


def removed_spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """The factors: doc_id, first_word and n_words (word places from 0 in the document), source_id and source_word."""
    blocks = pack(docs)

    def make(k, ids, texts, answers):
        p, doc, at, n, source, place = _parse(ids, texts, answers, span)
        every = p.ids[doc]
        return pa.table({"doc_id": pa.array(every, mask=every == NO_ID), "first_word": pa.array(at - p.starts[doc]), "n_words": pa.array(n), "source_id": pa.array(source), "source_word": pa.array(place)})

    return each_with(blocks, earlier(blocks, span), make, "doc_id long, first_word long, n_words long, source_id long, source_word long")


def deduplicated(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by single spaces) and n_factors of every document.

    Null and empty texts have no words; null ids come after all others and give nothing to look up for one another; repeated rows
    have one id and so remove nothing from each other; an empty table gives an empty result; columns beside doc_id and text are
    not read. A text is read whole, whatever its length.
    """
    return _deduplicated(docs, span, lambda kept: kept, "kept binary").withColumn("kept", F.decode("kept", "UTF-8"))


def digested(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """As deduplicated(), with the kept text's SHA-256 in its place, computed where the text is."""
    return _deduplicated(docs, span, lambda kept: hashlib.sha256(kept).hexdigest(), "kept_sha256 string")


def _deduplicated(docs: DataFrame, span: int, show, column_ddl: str) -> DataFrame:
    blocks = pack(docs)
    name, kind = column_ddl.split()

    def make(k, ids, texts, answers):
        p, doc, at, n, _, _ = _parse(ids, texts, answers, span)
        cover = np.zeros(int(p.n.sum()) + 1, dtype=np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + n, -1)
        gone = np.cumsum(cover)[:-1] > 0
        lost = np.add.reduceat(np.append(gone, False).astype(np.int64), p.starts) if len(p.n) else p.n
        lost[p.n == 0] = 0
        shown = []
        for d, text in enumerate(texts):
            words = text.split()
            if lost[d]:
                g = gone[p.starts[d] : p.starts[d] + p.n[d]]
                words = [words[i] for i in np.flatnonzero(~g)]
            shown.append(show(b" ".join(words)))
        every = np.array(ids, dtype=np.int64)
        return pa.table({
            "doc_id": pa.array(every, mask=every == NO_ID), "n_words": pa.array(p.n), "n_removed": pa.array(lost),
            name: pa.array(shown, pa.binary() if kind == "binary" else pa.string()), "n_factors": pa.array(np.bincount(doc, minlength=len(ids)).astype(np.int64)),
        })

    return each_with(blocks, earlier(blocks, span), make, f"doc_id long, n_words long, n_removed long, {column_ddl}, n_factors long")
