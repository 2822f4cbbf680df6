"""Blocks of documents, and word hashes.

Operators that look up something about every word or window of the corpus do it by blocks: documents are packed,
compressed, into blocks of a few megabytes; a block asks for each distinct key once, and the answers come back to the block by
its number. A key that every document holds is then one row a block, not one a document.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from granary.llm.common import text_bytes, written

#: Stands for a null doc_id: such documents come after all others.
NO_ID = (1 << 63) - 1
BLOCK_BYTES = 4_000_000
#: Blocks in a task that meets them with their answers, on average.
BLOCKS_A_TASK = 6
#: Bytes that are compared or hashed at once, which bounds the arrays that this takes.
SEGMENT = 1 << 20
ODD, BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


SPACES = np.zeros(256, dtype=bool)
SPACES[[32, *range(9, 14)]] = True
SIGNS, LETTERS, MOST_SIGNS = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool), 4
SIGNS[list(b".,;:!?*#$%&")] = True
LETTERS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True

def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of ODD and of its inverse modulo 2**64, as many as were ever asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n - 1, x, dtype=np.uint64)])) for x in (ODD, BACK))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _range_hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of x[start:end] for every range, by polynomial sums modulo 2**64. Ranges that differ only in zeros at their end have
    the same one, so x must not hold zeros or the ranges must be of one length."""
    up, down = _powers.upto(len(x))
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.add.accumulate(x * down, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * up[starts])


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive entries of h."""
    m = len(h) - n + 1
    return _range_hashes(h, np.arange(m), np.arange(n, n + m)) if m > 0 else np.zeros(0, dtype=np.uint64)


def distinct(items: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct items, by their bytes, in order of first appearance, and the place among them of each item."""
    place = {w: k for k, w in enumerate(dict.fromkeys(items))}
    return list(place), np.fromiter(map(place.__getitem__, items), np.int64, len(items))


class Words:
    """The words of texts, one after the other: hash, first byte and end of each in buffer, and how many each text has. With
    cut, up to MOST_SIGNS signs after a letter or digit (of ASCII or Latin-1) are a word of their own.

    first and of: one place of every distinct word, and for each word the place in first of its own. They are told apart by
    their bytes: a sum of bytes groups them, and each word is compared with the first of its group. A word's hash is the XXH3 of
    its bytes."""

    def __init__(self, texts: list[bytes], cut: bool = False):
        self.buffer = b"\n".join([*texts, b""])
        raw = np.frombuffer(self.buffer, dtype=np.uint8)
        space = np.empty(len(raw) + 1, dtype=bool)
        space[0] = True
        np.take(SPACES, raw, out=space[1:])
        turns = np.flatnonzero(space[1:] != space[:-1])  # the buffer ends in a space, so they come in pairs
        self.starts, self.ends = turns[::2], turns[1::2]
        if cut:
            e = self.ends.copy()
            for _ in range(MOST_SIGNS):
                e -= (e > self.starts) & SIGNS[raw[e - 1]]
            last = raw[e - 1]
            latin = (raw[np.maximum(e - 2, 0)] == 0xC3) & (last >= 128) & (last != 0x97) & (last != 0xB7) & (e - self.starts > 1)
            two = np.flatnonzero((e > self.starts) & (e < self.ends) & (LETTERS[last] | latin))
            self.starts = np.insert(self.starts, two + 1, e[two])
            self.ends = np.insert(self.ends, two, e[two])
        stops = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, dtype=np.int64)
        self.n = np.diff(np.searchsorted(self.starts, stops), prepend=0)
        self._group(raw)

    def _group(self, raw: np.ndarray) -> None:
        """Sets first and of."""
        key = np.empty(len(self.starts), dtype=np.uint64)
        for i, j, lo, hi in self._segments():
            key[i:j] = _range_hashes(raw[lo:hi].astype(np.uint64) + np.uint64(1), self.starts[i:j] - lo, self.ends[i:j] - lo)
        _, self.first, self.of = np.unique(key, return_index=True, return_inverse=True)
        del key
        if not self._same(raw):
            every, self.of = distinct(self.at(np.arange(len(self.starts))))
            self.first = np.zeros(len(every), dtype=np.int64)
            self.first[self.of[::-1]] = np.arange(len(self.of))[::-1]

    def _segments(self):
        """Runs of words of about SEGMENT bytes: first, end, first byte and end."""
        i = 0
        while i < len(self.starts):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + SEGMENT, side="right")))
            yield i, j, int(self.starts[i]), int(self.ends[j - 1])
            i = j

    def _same(self, raw: np.ndarray) -> bool:
        """Whether every word has the bytes of the first of its group."""
        own = self.first[self.of]
        size = self.ends - self.starts
        if not (size == size[own]).all():
            return False
        for i, j, _, _ in self._segments():
            n = size[i:j]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            if not (raw[np.repeat(self.starts[i:j], n) + step] == raw[np.repeat(self.starts[own[i:j]], n) + step]).all():
                return False
        return True

    @property
    def hash(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.at(self.first)), np.uint64, len(self.first))[self.of]

    def __len__(self) -> int:
        return len(self.starts)

    def at(self, places: np.ndarray) -> list[bytes]:
        b = self.buffer
        return [b[s:e] for s, e in zip(self.starts[places].tolist(), self.ends[places].tolist())]


def pieces(batches, most: int):
    """(number, ids, texts) of about most bytes of text, from batches of doc_id and text bytes; numbers differ between tasks."""
    k, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
    for b in batches:
        for d, t in zip(b.column(0).to_pylist(), b.column(1)):
            ids.append(NO_ID if d is None else d)
            texts.append(t.as_py())
            size += len(texts[-1])
            if size >= most:
                yield k, ids, texts
                k, ids, texts, size = k + 1, [], [], 0
    if ids:
        yield k, ids, texts


def pack(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of whole documents: block, n_docs, blob. As a written table, so block numbers stay what they are."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=3)
        for k, ids, texts in pieces(batches, block_bytes):
            blob = z.compress(pickle.dumps((ids, texts), protocol=5))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())], names=["block", "n_docs", "blob"])

    rows = docs.select(F.col("doc_id").cast("long"), text_bytes(F.col("text")).alias("text"))
    return written(rows.mapInArrow(run, "block long, n_docs long, blob binary"), "blocks")


def empty_table(schema: str) -> pa.Table:
    return to_arrow_schema(_parse_datatype_string(schema)).empty_table()


def unpack(blob: bytes) -> tuple[list[int], list[bytes]]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def each(blocks: DataFrame, make, schema: str) -> DataFrame:
    """make(block, doc_ids, texts) -> pa.RecordBatch for every block."""

    def run(batches):
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1)):
                yield make(k, *unpack(blob.as_py()))

    return blocks.select("block", "blob").mapInArrow(run, schema)


def each_with(blocks: DataFrame, answers: DataFrame, make, schema: str) -> DataFrame:
    """make(block, doc_ids, texts, its rows of answers) -> pa.Table for every block."""

    empty = empty_table(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [make(k, *unpack(blob.as_py()), right) for k, blob in zip(left.column("block").to_pylist(), left.column("blob"))]
        return pa.concat_tables(parts) if parts else empty

    # A task's blocks are as many on any input.
    n = max(1, -(-blocks.count() // BLOCKS_A_TASK))
    left, right = (df.repartition(n, "block").groupBy("block") for df in (blocks.select("block", "blob"), answers))
    return left.cogroup(right).applyInArrow(run, schema)


def column(table: pa.Table, name: str, kind=np.int64) -> np.ndarray:
    return table.column(name).to_numpy().astype(kind, copy=False) if table.num_rows else np.zeros(0, dtype=kind)
