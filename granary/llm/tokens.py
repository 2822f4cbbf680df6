"""Token ids in canonical length-limited Huffman files.

Texts are encoded with a public tokenizer in ascending doc_id order. One set of code lengths is made from the ids' counts
over the whole corpus. Files are sequences of blocks; each block holds whole documents, is decoded without any
other, and has a bit offset for every CHECKPOINT ids, from which decoding can start.

A token folder holds two Parquet tables. codebook: id, length; codes are canonical (by length, then id). blocks: file (files ascend
by doc_id), start (ids before the block in its file), doc_ids, doc_lens (ids with the end id), bits (big-endian codes,
zero-padded) and checkpoints (bit offsets).
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.blocks import Words
from granary.llm.common import forget, scratch_root, written

#: Longest code; a table-driven decoder has 2**MAX_LENGTH entries.
MAX_LENGTH = 20
#: Ids from one checkpoint to the next.
CHECKPOINT = 256
#: Ids a block holds at least, unless its file ends; a document is never divided.
BLOCK_IDS = 262_144
#: Distinct words after which a worker forgets those it has not met of late.
REMEMBERED = 300_000
END_ID = 2
#: Bytes of text encoded at once.
PIECE = 4_000_000
#: Groups in which the tasks' counts are added up.
SUMS = 16


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Vocabulary:
    """A tokenizer, and the ids (little-endian, 32 bits) of words that it has met, in a table of bounded size.

    The vocabulary's pre-tokenizer never joins what ASCII white space parts and drops the white space, and it parts letters and
    digits from signs, so a text's ids are the ids of its words and of the signs after them. It also folds case, so words are looked
    up in lower case.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends[k] = token.endswith("</w>")

    def _encode(self, words: list[bytes]) -> None:
        """Learn words: those of letters alone together, for each is one pre-token and ends where a token ends a word."""
        plain, other = [], []
        for w in words:
            (plain if w.isalpha() or w.decode().isalpha() else other).append(w)
        for lo in range(0, len(plain), 2_000):
            part = plain[lo : lo + 2_000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(part) or cut[-1] != len(ids):
                other += part
                continue
            blob, at = ids.tobytes(), 0
            for w, e in zip(part, (cut * 4).tolist()):
                self.known[w] = blob[at:e]
                at = e
        for lo in range(0, len(other), 2_000):
            part = other[lo : lo + 2_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                self.known[w] = array("I", e.ids).tobytes()

    def learn(self, words: list[bytes]) -> None:
        """Learn distinct words that are not known."""
        if len(self.known) > REMEMBERED:  # words met again since move on; the others go
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        for w in words:
            if (i := older.get(w)) is None:
                new.append(w)
            else:
                known[w] = i
        self._encode(new)

    def ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        got = list(map(self.known.get, words))
        new = [k for k, g in enumerate(got) if g is None]
        if new:
            self.learn([words[k] for k in new])
            for k in new:
                got[k] = self.known[words[k]]
        return got


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """This process's vocabulary of a path."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encode_texts(path: str, texts: list[bytes]) -> list[np.ndarray]:
    """Ids of every text, without the end id. Texts that may hold special tokens, which know case, are not put in lower case."""
    v, out, k = vocabulary(path), [], 0
    while k < len(texts):  # by pieces, so that a batch of long texts needs little more memory than its longest
        first, size = k, 0
        while k < len(texts) and (k == first or size < PIECE):
            size += len(texts[k])
            k += 1
        words = Words([t if b"<|" in t else t.lower() for t in texts[first:k]], cut=True)
        of = words.of
        got = v.ids(words.at(words.first))
        n = np.fromiter(map(len, got), np.int64, len(got)) // 4
        ids = np.frombuffer(b"".join(got), dtype="<u4")
        # Each word's ids, from where its distinct word has them.
        m = n[of]
        ends = np.cumsum(m)
        every = ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat((np.cumsum(n) - n)[of] - (ends - m), m)]
        cuts = np.append(0, ends)[np.cumsum(words.n)]
        out += np.split(every, cuts[:-1])
    return out


def code_lengths(counts: np.ndarray, most: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most `most` bits for symbols with these counts, by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.int64)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << most:
        raise ValueError(f"{n} symbols need codes over {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels = []  # of each level, whether its items, by weight, are leaves
    items = leaves
    for _ in range(most - 1):
        levels.append(None)
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, pairs])
        by = np.argsort(merged, kind="stable")
        items = merged[by]
        levels[-1] = by < n
    take = 2 * n - 2
    for leaf in reversed(levels):
        mine = int(leaf[:take].sum())
        lengths[order[:mine]] += 1
        take = 2 * (take - mine)
    lengths[order[:take]] += 1
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    by = np.lexsort((np.arange(len(lengths)), lengths))
    by = by[lengths[by] > 0]
    if len(by):
        width = lengths[by]
        steps = 1 << (width.max() - width)
        at = np.concatenate([[0], np.cumsum(steps)[:-1]])
        codes[by] = (at >> (width.max() - width)).astype(np.uint64)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, list[int]]:
    """The ids' codes as big-endian bits, and the checkpoints."""
    width = lengths[ids]
    ends = np.cumsum(width)
    at = ends - width
    word, used = at >> 5, (at & 31) + width
    both = codes[ids] << (64 - used).astype(np.uint64)
    n = int(ends[-1] + 31 >> 5) + 1 if len(ids) else 0
    # Codes share no bits, so sums of the 32-bit halves are their unions, exact as doubles.
    out = np.bincount(word, (both >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (both & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return out.astype(np.uint64).astype(">u4").tobytes(), at[::CHECKPOINT].tolist()


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each value of the next `top` bits, the symbol they begin with and its length."""
    by = np.lexsort((np.arange(len(lengths)), lengths))
    by = by[lengths[by] > 0]
    top = int(lengths.max()) if len(by) else 1
    spans = 1 << (top - lengths[by])
    symbol = np.zeros(1 << top, dtype=np.uint32)
    width = np.ones(1 << top, dtype=np.int64)
    n = int(spans.sum())
    symbol[:n] = np.repeat(by, spans)
    width[:n] = np.repeat(lengths[by], spans)
    return symbol, width, top


def unpack(bits: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """n ids. All checkpoints' runs are decoded side by side, one id of each at a step."""
    symbol, width, top = table
    if not n:
        return np.zeros(0, dtype=np.uint32)
    b = np.frombuffer(bits + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    four = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    at = np.asarray(checkpoints, dtype=np.int64).copy()
    out = np.zeros((len(at), CHECKPOINT), dtype=np.uint32)
    tail = n - (len(at) - 1) * CHECKPOINT
    for k in range(CHECKPOINT if len(at) > 1 else tail):
        if k == tail:
            at = at[:-1]
        v = (four[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - top)
        out[: len(at), k] = symbol[v]
        at += width[v]
    return out.reshape(-1)[:n]


def _blocks(path: str, end_id: int):
    """Texts in order to blocks of ids, then a row with this task's counts of ids."""

    def run(batches):
        file, start = TaskContext.get().partitionId(), 0
        counts = np.zeros(0, dtype=np.int64)
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        held = 0
        z = zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], dtype="<u4")

        def row(kind: int, blob: bytes, n: int, d: list, lens: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([start if not kind else None], pa.int64()), pa.array([d], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())), pa.array([n], pa.int64()),
                 pa.array([None if kind else blob], pa.binary()), pa.array([blob if kind else None], pa.binary())],
                names=["file", "start", "doc_ids", "doc_lens", "n", "ids", "counts"],
            )

        def flush() -> pa.RecordBatch:
            nonlocal counts
            every = np.concatenate(ids)
            c = np.bincount(every)
            if len(c) > len(counts):
                counts = np.concatenate([counts, np.zeros(len(c) - len(counts), dtype=np.int64)])
            counts[: len(c)] += c
            small = every.astype("<u2") if every.max() < 65536 else every
            return row(0, bytes([small.itemsize]) + z.compress(small.tobytes()), len(every), docs, [len(x) for x in ids])

        for b in batches:
            names = b.column(0).to_pylist()
            texts = b.column(1)
            for lo in range(0, len(names), 1024):
                for d, x in zip(names[lo : lo + 1024], encode_texts(path, texts.slice(lo, 1024).to_pylist())):
                    ids.append(np.concatenate([x, end]))
                    docs.append(d)
                    held += len(ids[-1])
                    if held >= BLOCK_IDS:
                        yield flush()
                        start += held
                        ids, docs, held = [], [], 0
        if held:
            yield flush()
        yield row(1, counts.astype("<i8").tobytes(), len(counts), [], [])

    return run


def write_tokens(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID) -> str:
    """Write docs' ids as a token folder and return its path.

    Null texts are empty and hold the end id alone; rows are ordered by doc_id, null ids first, rows with one id by a hash of
    their text, and repeated rows stay, next to each other; a very long text is encoded whole, in one block; an empty table gives
    a folder without blocks; columns beside doc_id and text are not read.
    """
    spark = docs.sparkSession
    path = path or vocabulary_path()
    folder = folder or f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
    # The text's hash parts rows without an id, or with the same one, between files.
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    raw = written(rows.mapInArrow(_blocks(path, end_id), "file int, start long, doc_ids array<long>, doc_lens array<long>, n long, ids binary, counts binary"), "ids")

    def summed(t: pa.Table) -> pa.Table:
        total = np.zeros(0, dtype=np.int64)
        for c in t.column("counts"):
            v = np.frombuffer(c.as_py(), dtype="<i8")
            total = np.pad(total, (0, max(0, len(v) - len(total))))
            total[: len(v)] += v
        return pa.table({"counts": pa.array([total.tobytes()], pa.binary())})

    # A table of the vocabulary's size from each task, added up in SUMS groups.
    parts = raw.where("counts IS NOT NULL").select((F.col("file") % SUMS).alias("part"), "counts").groupBy("part").applyInArrow(summed, "counts binary").collect()
    counts = np.zeros(max([1, *(len(r["counts"]) // 8 for r in parts)]), dtype=np.int64)
    for r in parts:
        v = np.frombuffer(r["counts"], dtype=np.int64)
        counts[: len(v)] += v
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)

    def coded(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for r in b.to_pylist():
                blob = z.decompress(r["ids"][1:])
                ids = np.frombuffer(blob, dtype=f"<u{r['ids'][0]}").astype(np.int64)
                bits, points = pack(ids, lengths, codes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["file"]], pa.int32()), pa.array([r["start"]], pa.int64()), pa.array([r["doc_ids"]], pa.list_(pa.int64())), pa.array([r["doc_lens"]], pa.list_(pa.int64())), pa.array([bits], pa.binary()), pa.array([points], pa.list_(pa.int64()))],
                    names=["file", "start", "doc_ids", "doc_lens", "bits", "checkpoints"],
                )

    raw.where("ids IS NOT NULL").select("file", "start", "doc_ids", "doc_lens", "ids").mapInArrow(coded, "file int, start long, doc_ids array<long>, doc_lens array<long>, bits binary, checkpoints array<long>").write.parquet(f"{folder}/blocks")
    used = np.flatnonzero(lengths)
    forget(raw)
    spark.createDataFrame([(int(i), int(lengths[i]), int(counts[i])) for i in used], "id int, length int, count long").coalesce(1).write.parquet(f"{folder}/codebook")
    return folder


def read_tokens(spark: SparkSession, folder: str, decode) -> DataFrame:
    """decode(file, start, doc_ids, doc_lens, ids) of every block, a pyarrow record batch whose columns are those of
    decode.schema, from a token folder. Blocks are decoded where they are read."""
    book = spark.read.parquet(f"{folder}/codebook").toPandas()  # as many rows as the vocabulary has ids
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, dtype=np.int64)
    lengths[book["id"].to_numpy()] = book["length"].to_numpy()

    def run(batches):
        table = decoding_table(lengths)
        for b in batches:
            for r in b.to_pylist():
                ids = unpack(r["bits"], r["checkpoints"], sum(r["doc_lens"]), table)
                yield decode(r["file"], r["start"], r["doc_ids"], r["doc_lens"], ids)

    return spark.read.parquet(f"{folder}/blocks").mapInArrow(run, decode.schema)


def _digest(file: int, start: int, doc_ids: list, lens: list, ids: np.ndarray) -> pa.RecordBatch:
    ends = np.cumsum(lens)
    at = ends - lens
    little = ids.astype("<u4")
    crc = [zlib.crc32(little[a:e]) for a, e in zip(at, ends)]
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * len(lens), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(at + start, pa.int64()), pa.array(lens, pa.int64()), pa.array(crc, pa.int64())],
        names=["file", "doc_id", "at", "n_tokens", "ids_crc32"],
    )


_digest.schema = "file int, doc_id long, at long, n_tokens long, ids_crc32 long"


def _ids(file: int, start: int, doc_ids: list, lens: list, ids: np.ndarray) -> pa.RecordBatch:
    ends = np.cumsum(lens)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array([ids[e - n : e].astype(np.int64) for e, n in zip(ends, lens)], pa.list_(pa.int64()))], names=["doc_id", "ids"]
    )


_ids.schema = "doc_id long, ids array<long>"


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and ids of every document of a token folder."""
    return read_tokens(spark, folder, _ids)


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files of a token folder."""
    d = written(read_tokens(spark, folder, _digest), "digest")
    files = d.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a file
    return d.join(before, "file").select("doc_id", (F.col("before") + F.col("at")).cast("long").alias("start"), "n_tokens", "ids_crc32", "file")
