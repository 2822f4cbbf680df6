"""Benchmark decontamination by the q-gram lemma.

An item of m characters that a text holds with at most k edits shares at least m - q + 1 - k*q of its q-grams with
the text, all on neighbouring diagonals. Hits are counted in overlapping bands of diagonals; bands that reach an item's
bound are verified by banded alignment. Texts and items are compared in lower case, with every run of white space and
ASCII punctuation as one space.

Q-grams that stand at more than POSTINGS places of the items are left out of the count, and of the bound. Items that have no
bound then, such as runs of one character or near copies of many others, are found another way, as exactly: regions of a
text that hold enough of an item's q-grams, each place counted once, are searched by bit-parallel alignment. Items shorter than
q are looked up as whole words.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import bounded, forget, scratch_root, written

Q = 12
#: Edits allowed per character of an item.
EDITS = 0.06
#: Bytes of items handled in one pass over the texts; a larger benchmark takes several passes.
PASS_BYTES = 2_000_000
#: Bytes of texts taken together; a longer text is taken in pieces that overlap by what an item can cover.
PIECE = 128_000
#: Places of the items at which a q-gram may stand to be counted. PIECE * POSTINGS bounds the hits held at once.
POSTINGS = 16
#: Keys of contaminated texts that are sent to the documents; more are joined by shuffle.
AT_ONCE = 200_000
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(PLAIN).split())


def grams(b: bytes) -> np.ndarray:
    """A 64-bit code of the q-gram at every position of b."""
    n = len(b) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    head = np.ndarray((n,), dtype="<u8", buffer=b, strides=(1,))
    tail = np.ndarray((n,), dtype="<u4", buffer=b, offset=8, strides=(1,)).astype(np.uint64)
    h = head * MIX_A
    h ^= h >> np.uint64(29)
    h += tail * MIX_B
    h *= MIX_A
    return h


@dataclass
class Index:
    """Distinct items with their ids, their bounds, and where each of their q-grams is. least is 0 for items that are not counted:
    dense holds the q-grams of those of Q characters or more, short the others by their number of words."""

    ids: list[list[int]]
    items: list[bytes]
    edits: np.ndarray
    least: np.ndarray
    shift: np.ndarray
    codes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    dense: dict[int, np.ndarray]
    short: dict[int, dict[tuple, int]]

    @classmethod
    def of(cls, rows: list[tuple[int, bytes]], edits: float = EDITS, postings: int = POSTINGS) -> "Index":
        ids: dict[bytes, list[int]] = {}
        for i, b in rows:
            if b:
                ids.setdefault(b, []).append(i)
        items = list(ids)
        m = np.array([len(b) for b in items], dtype=np.int64)
        # Items too short for a bound at their number of edits have fewer edits; under Q characters, none.
        k = np.maximum(np.minimum((m * edits).astype(np.int64), (m - Q) // Q), 0) if len(m) else m
        shift = np.array([max(5, int(x).bit_length()) + 1 for x in k], dtype=np.int64)
        codes = [grams(b) for b in items]
        item = np.repeat(np.arange(len(items)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes] or [np.zeros(0, dtype=np.int64)])
        every = np.concatenate(codes or [np.zeros(0, dtype=np.uint64)])
        uniq, of, n = np.unique(every, return_inverse=True, return_counts=True)
        rare = n[of] <= postings
        least = np.maximum(np.bincount(item[rare], minlength=len(items)) - k * Q, 0)
        kept = rare & (least > 0)[item]
        dense = {i: np.unique(codes[i]) for i in np.flatnonzero((least == 0) & (m >= Q)).tolist()}
        short: dict[int, dict[tuple, int]] = {}
        for i in np.flatnonzero(m < Q).tolist():
            words = tuple(items[i].split())
            short.setdefault(len(words), {})[words] = i
        every, item, place = every[kept], item[kept], place[kept]
        by = np.argsort(every, kind="stable")
        uniq, first = np.unique(every[by], return_index=True)
        wanted = np.unique(np.concatenate([uniq, *dense.values()]))
        bits = min(26, max(18, len(wanted).bit_length() + 6))
        seen = np.zeros(1 << bits, dtype=bool)
        seen[wanted >> np.uint64(64 - bits)] = True
        return cls(list(ids.values()), items, k, least, shift, uniq, np.append(first, len(by)), item[by].astype(np.int32), place[by].astype(np.int32), seen, dense, short)


def anywhere(item: bytes, text: bytes, most: int) -> bool:
    """Whether a part of text is within most edits of item: columns of differences as bits of integers."""
    m = len(item)
    at: dict[int, int] = defaultdict(int)
    for k, c in enumerate(item):
        at[c] |= 1 << k
    full, top, score = (1 << m) - 1, 1 << (m - 1), m
    up, down = full, 0
    if score <= most:
        return True
    for c in text:
        same = at.get(c, 0)
        x = same | down
        d = (((same & up) + up) ^ up) | same
        rise = down | (full & ~(d | up))
        fall = up & d
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            if score <= most:
                return True
        rise, fall = rise << 1, fall << 1
        up = (fall | ~(x | rise)) & full
        down = rise & x & full
    return False


def within(item: bytes, text: bytes, most: int, lo: int, hi: int) -> int | None:
    """Least edits between item and a part of text that starts on diagonals lo to hi (place in text less place in
    item), or None if over most. Cells outside the diagonals lo - most to hi + most can't matter."""
    lo, hi = lo - most, hi + most
    width = hi - lo + 1
    far = most + 1
    a, t = np.frombuffer(item, dtype=np.uint8), np.frombuffer(text, dtype=np.uint8)
    steps = np.arange(width)
    padded = np.zeros(len(a) + width + 1, dtype=np.int16)
    padded[:] = -1
    s, e = max(lo, 0), min(hi + len(a), len(t))
    if e <= s:
        return None
    padded[s - lo : s - lo + e - s] = t[s:e]
    inside = np.zeros(len(padded) + 1, dtype=bool)
    inside[s - lo : e - lo + 1] = True  # places in text from s to e can begin or end a part
    row = np.where(inside[:width], 0, far)
    for i, c in enumerate(a):
        down = np.append(row[1:], far) + 1
        here = np.minimum(row + (padded[i : i + width] != c), down)
        here[padded[i : i + width] < 0] = down[padded[i : i + width] < 0]
        here = np.minimum.accumulate(here - steps) + steps
        row = np.minimum(np.where(inside[i + 1 : i + 1 + width], here, far), far)
        if row.min() > most:
            return None
    return int(row.min())


def find(texts: list[bytes], index: Index) -> list[list[int]]:
    """For every text the places in index of the items that it holds, ascending."""
    found: list[set[int]] = [set() for _ in texts]
    if index.short:
        for n, t in enumerate(texts):
            words = t.split()
            for k, those in index.short.items():
                found[n].update(those[w] for w in those.keys() & set(zip(*(words[i:] for i in range(k)))))
    # What an item covers in a text, with a q-gram beside it, lies within one piece.
    lap = max((len(b) for b in index.items), default=0) * 2 + 2 * Q
    step = max(PIECE, 4 * lap)
    pieces = [(n, t[lo : lo + step + lap]) for n, t in enumerate(texts) for lo in range(0, max(1, len(t) - lap), step)]
    at = 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (end == at or size + len(pieces[end][1]) <= PIECE):
            size += len(pieces[end][1]) + Q
            end += 1
        part = pieces[at:end]
        _find([t for _, t in part], index, [found[n] for n, _ in part])
        at = end
    return [sorted(f) for f in found]


def _find(texts: list[bytes], index: Index, found: list[set[int]]) -> None:
    # No q-gram of normal text holds a zero byte, so none reaches from one text into the next.
    gap = b"\0" * Q
    starts = np.cumsum([0] + [len(t) + Q for t in texts])
    h = grams(gap.join(texts))
    spots = np.flatnonzero(index.seen[h >> np.uint64(65 - len(index.seen).bit_length())])
    if not len(spots):
        return
    h = h[spots]
    doc = np.searchsorted(starts, spots, side="right") - 1
    if len(index.codes):
        _counted(texts, index, found, h, spots - starts[doc], doc)
    for i, codes in index.dense.items():
        k = np.searchsorted(codes, h)
        k[k == len(codes)] = 0
        mine = np.flatnonzero(codes[k] == h)
        if len(mine):
            _searched(texts, index, found, i, (spots - starts[doc])[mine], doc[mine])


def _counted(texts: list[bytes], index: Index, found: list[set[int]], h: np.ndarray, spots: np.ndarray, doc: np.ndarray) -> None:
    k = np.searchsorted(index.codes, h)
    k[k == len(index.codes)] = 0
    real = index.codes[k] == h
    spots, k, doc = spots[real], k[real], doc[real]
    # Postings of all hits; the places of an item that a text hits are first counted without regard to diagonals, which only
    # drops pairs that no band could keep. A place counts once, however often the text repeats its q-gram.
    n = index.first[k + 1] - index.first[k]
    rep = np.repeat(np.arange(len(n)), n)
    post = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.first[k], n)
    pair = doc[rep] * len(index.items) + index.item[post]
    longest = max(map(len, index.items))
    pairs = np.unique(pair * longest + index.place[post]) // longest
    pairs, count = np.unique(pairs, return_counts=True)
    pairs = pairs[count >= index.least[pairs % len(index.items)]]
    if not len(pairs):
        return
    at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
    enough = pairs[at] == pair
    at, post, rep = at[enough], post[enough], rep[enough]
    diagonal, shift = spots[rep] - index.place[post], index.shift[index.item[post]]
    for half in (0, 1):
        band = ((diagonal + (half << (shift - 1))) >> shift) + longest  # from 0
        bands = int(band.max()) + 1
        groups = np.unique((at * bands + band) * longest + index.place[post]) // longest
        groups, count = np.unique(groups, return_counts=True)
        for g, c in zip(groups.tolist(), count.tolist()):
            x, i = divmod(int(pairs[g // bands]), len(index.items))
            if c >= index.least[i] and i not in found[x]:
                wide = int(index.shift[i])
                low = ((g % bands - longest) << wide) - (half << wide - 1)
                if within(index.items[i], texts[x], int(index.edits[i]), low, low + (1 << wide) - 1) is not None:
                    found[x].add(i)


def _searched(texts: list[bytes], index: Index, found: list[set[int]], i: int, spots: np.ndarray, doc: np.ndarray) -> None:
    """Search the regions of texts in which places with q-grams of item i are dense enough."""
    m, k = len(index.items[i]), int(index.edits[i])
    least, reach = m - Q + 1 - k * Q, m + k
    # Places in order of text and place; a window from each must hold least of them.
    key = doc.astype(np.int64) * (1 << 40) + spots
    ok = np.searchsorted(key, key + reach, side="right") - np.arange(len(key)) >= least
    last, stop = -1, 0
    for x, s in zip(doc[ok].tolist(), spots[ok].tolist()):
        if i in found[x]:
            continue
        if x == last and s - reach <= stop:
            stop = s + reach + Q
            continue
        if last >= 0 and i not in found[last] and anywhere(index.items[i], texts[last][begin:stop], k):
            found[last].add(i)
            if x == last:
                continue
        last, begin, stop = x, max(0, s - reach), s + reach + Q
    if last >= 0 and i not in found[last] and anywhere(index.items[i], texts[last][begin:stop], k):
        found[last].add(i)


def passes(benchmark: DataFrame, edits: float = EDITS, pass_bytes: int = PASS_BYTES):
    """Indexes of the benchmark, each of at most pass_bytes of items (or one item)."""
    rows, size = [], 0
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL AND item_id IS NOT NULL").orderBy("item_id").toLocalIterator():
        b = normal(r[1])
        if rows and size + len(b) > pass_bytes:
            yield Index.of(rows, edits)
            rows, size = [], 0
        rows.append((r[0], b))
        size += len(b)
    if rows:
        yield Index.of(rows, edits)


def _key():
    """A text's key: what a text holds depends on it alone. Null texts are empty."""
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def held(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """key and item_id for every item that a text holds. Each pass is a job of its own, whose rows are written before the
    next, so that one index is in memory at a time."""
    spark = docs.sparkSession
    path = f"{scratch_root(spark)}/held-{uuid.uuid4().hex}"
    schema = "key string, item_id long"
    spark.createDataFrame([], schema).write.parquet(path)
    texts = docs.select(_key().alias("key"), "text").where("text IS NOT NULL")
    for index in passes(benchmark, edits, pass_bytes):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for b in batches:
                keys, ids = [], []
                for key, got in zip(b.column(0).to_pylist(), find([normal(t) for t in b.column(1).to_pylist()], sent.value)):
                    for k in got:
                        ids += sent.value.ids[k]
                        keys += [key] * len(sent.value.ids[k])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64())], names=["key", "item_id"])

        texts.mapInArrow(run, schema).write.mode("append").parquet(path)
        sent.destroy()
    out = spark.read.schema(schema).parquet(path)
    out.written_path = path
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, contaminated, n_items and item_ids (ascending) of every document.

    A document is contaminated if it holds a whole item with at most floor(edits * characters) edits (fewer where an
    item is too short for the lemma's bound; none under Q characters). Null and empty texts hold nothing, and null and
    empty items are held by nothing; a very long text is searched whole, in overlapping pieces; repeated rows give repeated rows,
    and items that repeat a text are all named, each id once; empty tables give clean or no rows; columns beside doc_id and text
    are not read. Items go to the texts, in passes of bounded size; what is shuffled is what was found.
    """
    found = held(docs, benchmark, edits, pass_bytes).groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    found = written(found, "leaks")
    ids = F.coalesce("item_ids", F.array().cast("array<long>"))
    return docs.select("doc_id", _key().alias("key")).join(bounded(found, AT_ONCE), "key", "left").select("doc_id", (F.size(ids) > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs, all columns, without the contaminated documents."""
    found = held(docs, benchmark, edits, pass_bytes)
    keys = written(found.select(F.col("key").alias(name := f"key_{uuid.uuid4().hex}")).distinct(), "leaks")
    forget(found)
    return docs.join(bounded(keys, AT_ONCE), _key() == F.col(name), "left_anti")
