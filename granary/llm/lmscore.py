"""Language-model scores of whole texts: a causal self-attention model over subword ids, trained in numpy.

A text is the subword ids of its words, and an end. Every id of the vocabulary belongs to one of KINDS kinds by the company that it
keeps: ids whose training windows hold alike ids are of one kind, so kinds follow languages and forms of text. Every id and the end
belong to one of CLASSES classes, cut within each kind from the ids in order of whether they end a word and how often the training
texts have them. One layer of masked self-attention over the
ids before, by their classes, gives the distribution of the next id's class; an id's probability is P(class | ids before) *
P(id | class), the second from the training texts' counts. Both sum to 1.

A word comes about in one of two ways, and its probability is the sum of both. It is spelled id by id, each id of it being the
word's last or not with the share that id has of this in the training texts. The first id's share of its class is
that among words' first ids; the others' probability is the one above mixed with how often the training texts have that id after
the one before inside a word. Or the word is a word of the training texts,
taken whole: P(class of its first id | ids before) * its share of the training words whose first id is of that class. How often
words are spelled is the Good-Turing estimate of new words: the share of training words that occur once. The words and the end
that may come next have a sum of at most 1, so the score is a log probability of the text.

Queries, keys and values depend on classes alone, so they are rows of tables, made once a batch; what attention adds for their
distance is a learned bias.

Texts are scored in windows of LENGTH ids that overlap by OVERLAP; the overlap is context only, so each id is scored once.
Counts come from all training texts. The model is trained on all windows of the training texts, each id once a round, by
each task on its own, and averaged after every round.

Words are counted exactly, by their bytes, and so are pairs of ids inside words. Each block of documents asks about each of its
distinct words and pairs once; those of all blocks are dealt by hash into parts of bounded size, added up there, and the counts go
back to the blocks.
"""

from __future__ import annotations

import pickle
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from granary.llm.blocks import NO_ID, Words, empty_table, pieces
from granary.llm.common import forget, text_bytes, written
from granary.llm.tokens import REMEMBERED, vocabulary, vocabulary_path

CLASSES = 64
WIDTH = 16
LENGTH, OVERLAP = 32, 8
#: Kinds of ids; numbers that stand for an id's company; windows whose company an id is taken to have had beside its own, of the average kind.
KINDS, SKETCH, PRIOR = 12, 8, 10
#: Rounds of averaging; groups in which tasks' models and counts are summed, and then those groups.
ROUNDS, SUMS = 1, (4096, 16, 1)
#: Windows in a step of training and in a step of scoring.
BATCH, SCORED = 128, 192
RATE = 0.02
SMOOTH = 0.1
BLOCK_BYTES = 2_000_000
#: Distinct words or pairs of blocks in a part, on average, and blocks whose words meet in one task. More blocks are added up in groups first.
PART_WORDS, GROUP_BLOCKS = 500_000, 4096
#: Pairs of ids are dealt by their product with this odd number, modulo 2 ** 64.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
START = CLASSES  # the class before the first id


def held_out(doc_id: int, folds: int = 10) -> bool:
    """Whether crc32 of the id as text leaves remainder 0; null ids are trained on."""
    return doc_id != NO_ID and zlib.crc32(str(doc_id).encode()) % folds == 0


def _places(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """s, s + 1 to s + k - 1 for every s, k of starts and n, one after the other."""
    if not n.all():
        starts, n = starts[n > 0], n[n > 0]
    if not len(n):
        return np.zeros(0, dtype=np.int64)
    out = np.ones(int(n.sum()), dtype=np.int64)
    out[0], out[np.cumsum(n)[:-1]] = starts[0], starts[1:] - starts[:-1] - n[:-1] + 1
    return np.cumsum(out, out=out)


def _spread(values: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[s:s + k] for every s, k of starts and n, one after the other."""
    return values.take(_places(starts, n))


def _array(ends: np.ndarray, letters: np.ndarray) -> pa.Array:
    """Words that lie in letters one after the other, from each of ends to the next."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(letters)])


def _listed(words: pa.Array) -> list[bytes]:
    """Arrow's own to_pylist is slower."""
    _, ends, text = words.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    first, text = (int(ends[0]), text[int(ends[0]) : int(ends[-1])].to_pybytes()) if text and len(words) else (0, b"")
    ends = (ends - first).tolist()
    return [text[i:j] for i, j in zip(ends, ends[1:])]


class _Words(Words):
    """Words whose distinct ones, every, are found by Arrow's table of their bytes; of: for each word its place there."""

    def _group(self, raw: np.ndarray) -> None:
        letters = raw[(raw != 32) & (raw - np.uint8(9) >= 5)]
        both = _array(np.append(0, np.cumsum(self.ends - self.starts)), letters).dictionary_encode()
        self.every, self.of = _listed(both.dictionary), both.indices.to_numpy().astype(np.int64)


#: What a byte of UTF-8 is to the vocabulary's model, and the second bytes of small letters of Latin-1 after LEAD.
_SIGNS = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
MAPPED = np.arange(256).astype("<u2")
MAPPED[[b for b in range(256) if b not in _SIGNS]] = 256 + np.arange(256 - len(_SIGNS))
MAPPED[32] = 32  # between words
SMALL, SECOND, LEAD = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool), 0xC3
SMALL[ord("a") : ord("z") + 1] = True
SECOND[0x9F:0xC0], SECOND[0xB7] = True, False


def of_small_letters(words: list[bytes]) -> np.ndarray:
    """Which words hold small letters of Latin-1 only, in UTF-8."""
    raw = np.frombuffer(b" ".join([b"", *words, b""]), dtype=np.uint8)
    lead, second = raw[:-1] == LEAD, SECOND[raw[1:]]
    fine = SMALL[raw]
    fine[:-1] |= lead & second
    fine[1:] |= lead & second
    wrong = np.append(0, np.cumsum(~fine))
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n + 1)
    return (n > 0) & (wrong[ends] == wrong[ends - n])


class _Met:
    """Words with their places, and by these their ids and how many they are."""

    def __init__(self) -> None:
        self.place: dict[bytes, int] = {}
        self.sub, self.n = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        self.begin = self.n

    def at(self, words: list[bytes]) -> np.ndarray:
        """The words' places, or -1."""
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.n[places]
        return _spread(self.sub, self.begin[places], n), n

    def add(self, words: list[bytes], sub: np.ndarray, n: np.ndarray) -> None:
        self.place.update(zip(words, range(len(self.n), len(self.n) + len(words))))
        self.sub, self.n = np.append(self.sub, sub), np.append(self.n, n)
        self.begin = np.cumsum(self.n) - self.n


class Encoder:
    """The ids of distinct words, and those of words met before in arrays of bounded size. Words of small letters of Latin-1 are their
    own normal form and one pre-token each, so they go to the vocabulary's model in its signs for bytes, without the tokenizer's normalizer
    and patterns, which take longer than the model."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.model = Tokenizer(self.vocabulary.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.now, self.older = _Met(), _Met()

    def _plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of small letters; each has one id that ends a word, its last."""
        got = []
        for lo in range(0, len(words), 2_000):
            text = MAPPED[np.frombuffer(b" ".join(words[lo : lo + 2_000]), dtype=np.uint8)].tobytes().decode("utf-16-le")
            got.append(np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4"))
        sub = np.concatenate(got)
        n = np.diff(np.flatnonzero(self.vocabulary.ends[sub]), prepend=-1)
        if len(n) != len(words) or n.sum() != len(sub):
            return self._other(words)
        return sub, n

    def _other(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = self.vocabulary.ids(words)
        return np.frombuffer(b"".join(got), dtype="<u4"), np.fromiter(map(len, got), np.int64, len(got)) // 4

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one word after the other, and how many each has."""
        if len(self.now.place) > REMEMBERED:  # words met again since move on; the others go
            self.now, self.older = _Met(), self.now
        at = self.now.at(words)
        if (new := np.flatnonzero(at < 0)).size:
            fresh = [words[k] for k in new.tolist()]
            was = self.older.at(fresh)
            plain = of_small_letters(fresh)
            for some, make in ((was >= 0, None), ((was < 0) & plain, self._plain), ((was < 0) & ~plain, self._other)):
                own = [fresh[k] for k in np.flatnonzero(some).tolist()]
                if own:
                    self.now.add(own, *(make(own) if make else self.older.of(was[some])))
            at[new] = self.now.at(fresh)
        return self.now.of(at)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def subwords(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of distinct words, one word after the other, and how many each has."""
    parts = _Words([b"\n".join(words)], cut=True)  # the words and the signs after them, each distinct one encoded once
    ids, n = encoder(path).ids(parts.every)
    m = n[parts.of]
    every = _spread(ids, (np.cumsum(n) - n)[parts.of], m)
    begins = np.cumsum([0] + [len(w) + 1 for w in words])[:-1]
    first = np.searchsorted(parts.starts, begins)
    total = np.cumsum(np.append(0, m))
    return every, np.diff(np.append(total[first], total[-1]))


def _planes(x: np.ndarray) -> list[bytes]:
    """Unsigned 32-bit numbers byte by byte, which packs better."""
    return [(x >> np.uint32(k)).astype(np.uint8).tobytes() for k in (0, 8, 16, 24)]


def _unplaned(planes: list[bytes]) -> np.ndarray:
    return sum(np.frombuffer(p, dtype=np.uint8).astype(np.uint32) << np.uint32(8 * k) for k, p in enumerate(planes))


class Text:
    """A block's documents: for each word its place among the block's distinct words, which are in order of their hash, and those words'
    ids. The run of ids has the end after each document."""

    def __init__(self, ids: list[int], texts: list[bytes], path: str):
        words = _Words([t.lower() for t in texts])
        key = WordItems.keys(words.every)
        by = np.argsort(key, kind="stable")
        place = np.empty(len(by), dtype=np.int64)
        place[by] = np.arange(len(by))
        self.key, self.words = key[by], [words.every[k] for k in by.tolist()]
        self.of, self.n = place[words.of], words.n
        self.sub, self.n_sub = subwords(path, self.words)
        self.ids = np.array(ids, dtype=np.int64)
        self.held = np.array([held_out(d) for d in ids], dtype=bool)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs of ids inside distinct words, as numbers in order; for each id of the words after another its pair, and
        its place."""
        inner = np.ones(len(self.sub), dtype=bool)
        inner[(np.cumsum(self.n_sub) - self.n_sub)[self.n_sub > 0]] = False
        inner = np.flatnonzero(inner)
        both = (self.sub[inner - 1].astype(np.uint64) << np.uint64(32)) | self.sub[inner].astype(np.uint64)
        return *np.unique(both * SPREAD, return_inverse=True), inner

    def packed(self) -> bytes:
        """What scoring needs of the texts: no words, but places and ids."""
        common = np.argsort(-np.bincount(self.of, minlength=len(self.n_sub)), kind="stable")
        rank = np.empty(len(common), dtype=np.uint32)
        rank[common] = np.arange(len(common), dtype=np.uint32)
        state = (self.ids, self.n, self.held, _planes(common.astype(np.uint32)), _planes(rank[self.of]), self.sub.astype(np.uint32), self.n_sub.astype(np.int32))
        return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(state, protocol=5))

    @classmethod
    def unpacked(cls, blob: bytes) -> "Text":
        t = cls.__new__(cls)
        t.ids, t.n, t.held, common, ranks, t.sub, n_sub = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
        t.n_sub = n_sub.astype(np.int64)
        t.of = _unplaned(common)[_unplaned(ranks)].astype(np.int64)
        return t

    def run(self, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids with the end after each document, and where each document's begin and how many they are."""
        m = self.n_sub[self.of]
        flat = _spread(self.sub, (np.cumsum(self.n_sub) - self.n_sub)[self.of], m)
        total = np.append(0, np.cumsum(m))
        stops = total[np.cumsum(self.n)]
        long = np.diff(stops, prepend=0) + 1
        out = np.full(len(flat) + len(self.n), end, dtype=np.uint32)
        inner = np.ones(len(out), dtype=bool)
        inner[np.cumsum(long) - 1] = False
        out[inner] = flat
        return out, np.cumsum(long) - long, long


def windows(starts: np.ndarray, n: np.ndarray, docs: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of docs: document, first place, and the first place that is scored."""
    step = LENGTH - overlap
    count = 1 + np.maximum(0, -(-(n[docs] - LENGTH) // step))
    doc = np.repeat(docs, count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = starts[doc] + k * step
    return doc, first, np.where(k > 0, first + overlap, first)


def signatures(vocab: int) -> np.ndarray:
    """SKETCH random signs for every id, the same in every task; the end has zeros."""
    signs = np.random.default_rng(0).choice(np.array([-1, 1], dtype=np.float32), (vocab + 1, SKETCH))
    signs[vocab] = 0
    return signs


def company(t: Text, signs: np.ndarray) -> np.ndarray:
    """For every id, over its places in the windows of training texts: the sum of the signatures of the other ids of the window
    (SKETCH rows), and how many these are (the last row). Whole numbers, so sums over blocks are exact."""
    vocab = len(signs) - 1
    ids, starts, n = t.run(vocab)
    doc, first, _ = windows(starts, n, np.flatnonzero(~t.held), 0)
    size = np.minimum(first + LENGTH, (starts + n)[doc]) - first
    every = ids[np.repeat(~t.held, n)].astype(np.int64)  # these windows have no gaps or overlap
    out, stops = np.zeros((SKETCH + 1, vocab + 1), dtype=np.int64), np.append(0, np.cumsum(size))
    # Two sums to a double: those of a part are under 2 ** 25.
    two = [signs[:, k].astype(float) + signs[:, k + 1] * 2.0**26 for k in range(0, SKETCH, 2)]
    for lo in range(0, len(doc), 1 << 14):
        some = size[lo : lo + (1 << 14)]
        own = every[stops[lo] : stops[lo + len(some)]]
        for k, x in enumerate(two):
            x = np.bincount(own, np.repeat(np.add.reduceat(x.take(own), np.cumsum(some) - some), some), vocab + 1)
            high = np.rint(x * 2.0**-26)
            out[2 * k] += (x - high * 2.0**26).astype(np.int64)
            out[2 * k + 1] += high.astype(np.int64)
        out[SKETCH] += np.bincount(own, np.repeat(some - 1, some), vocab + 1).astype(np.int64)
    out[:SKETCH] -= (signs.T * np.bincount(every, minlength=vocab + 1)).astype(np.int64)
    return out


def kinds(sums: np.ndarray, counts: np.ndarray, starts: int = 4, rounds: int = 25) -> np.ndarray:
    """The kind of every id but the end: k-means over ids' mean company, the best of some starts. An id weighs its count, but no
    more than the root of its count times a thousandth of all: else the commonest ids would be kinds of their own."""
    sums, own = sums[:, :-1].astype(float), counts[:-1].astype(float)
    if not own.sum() or not sums[SKETCH].sum():
        return np.zeros(len(own), dtype=np.int64)
    mean, prior = sums[:SKETCH].sum(axis=1) / sums[SKETCH].sum(), PRIOR * LENGTH
    x = ((sums[:SKETCH] - mean[:, None] * sums[SKETCH]) / (sums[SKETCH] + prior)).T
    weight = np.minimum(own, np.sqrt(own * own.sum() / 1000))
    best, least = None, np.inf
    for seed in range(starts):
        r, far, centres = np.random.default_rng(seed), np.ones(len(x)), np.zeros((0, SKETCH))
        while len(centres) < KINDS and (far * weight).sum() > 0:
            centres = np.append(centres, x[[r.choice(len(x), p=far * weight / (far * weight).sum())]], axis=0)
            far = np.minimum(far if len(centres) > 1 else np.inf, ((x - centres[-1]) ** 2).sum(axis=1))
        for _ in range(rounds):
            of = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
            mass = np.bincount(of, weight, len(centres))
            moved = np.stack([np.bincount(of, weight * x[:, k], len(centres)) for k in range(SKETCH)], axis=1)
            centres = np.where(mass[:, None] > 0, moved / np.maximum(mass, 1e-9)[:, None], centres)
        apart = (centres**2).sum(axis=1) - 2 * x @ centres.T
        cost = float((weight * apart.min(axis=1)).sum())
        if cost < least:
            best, least = apart.argmin(axis=1), cost
    return best


class Classes:
    """Which class each id is in, and its log share of the class. Class 0 is the end's alone."""

    def __init__(self, counts: np.ndarray, ends: np.ndarray, kind: np.ndarray | None = None):
        """counts of all ids, the end's last; ends: which ids end a word; kind of each id, all the same if there is none. A kind has
        as many classes as are its share of the counts, but one at least."""
        vocab = len(counts) - 1
        kind = np.zeros(vocab, dtype=np.int64) if kind is None else np.unique(kind, return_inverse=True)[1]
        share = np.bincount(kind, counts[:-1] + SMOOTH)
        room = 1 + np.floor((CLASSES - 1 - len(share)) * share / max(share.sum(), 1e-9)).astype(np.int64)
        if vocab:
            room[share.argmax()] += CLASSES - 1 - room.sum()
        self.of = np.zeros(vocab + 1, dtype=np.uint8)
        for k, (n, before) in enumerate(zip(room.tolist(), (np.cumsum(room) - room).tolist())):
            own = np.flatnonzero(kind == k)
            by = own[np.lexsort((own, -counts[own], ends[own]))]
            mass = np.cumsum(counts[by] + SMOOTH)
            self.of[by] = 1 + before + np.minimum((mass - mass[0] / 2) * n / mass[-1], n - 1).astype(np.int64)
        weight = counts + SMOOTH
        total = np.bincount(self.of, weight, CLASSES)
        self.share = np.log(weight) - np.log(total[self.of])
        self.log_mass = np.log(np.maximum(total, 1e-9) / total.sum())


class Spelling:
    """Log10 probabilities that a word ends with an id, and that it goes on; by how much an id's log10 share of its class is another
    among words' first ids; the log10 number of training words by the class of their first id; and how often words are spelled (new)
    or taken whole."""

    def __init__(self, classes: Classes, every: np.ndarray, first: np.ndarray, last: np.ndarray, n_words: int, n_once: int):
        """every, first, last: how often training texts have each id, as a word's first and as a word's last."""
        self.follows = every - last  # ids inside words that come after each id
        self.stop, self.go = np.log10(last + SMOOTH) - np.log10(every + 2 * SMOOTH), np.log10(every - last + SMOOTH) - np.log10(every + 2 * SMOOTH)
        total = np.bincount(classes.of, first + SMOOTH, CLASSES)
        self.first = np.log10(first + SMOOTH) - np.log10(total[classes.of]) - classes.share / np.log(10)
        self.mass = np.log10(np.maximum(np.bincount(classes.of, first, CLASSES), 1))
        self.new = (n_once + 1) / (n_words + 2)

    def mixed(self, sub: np.ndarray, inner: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the ids of distinct words, where inner are those after another id and pairs how often training texts have them so: what
        the counts say of the id, and the weight of what attention says. The weight falls as the id before is seen more often."""
        seen, rest = np.zeros(len(sub)), np.ones(len(sub))
        n = self.follows[sub[inner - 1]]
        a = 1 + np.sqrt(n)
        seen[inner], rest[inner] = pairs / (n + a), a / (n + a)
        return seen, rest

    def tails(self, sub: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For distinct words of n ids each: that they go on to their last id and end there, with the first id's other share."""
        out = self.go[sub]
        last = (np.cumsum(n) - 1)[n > 0]
        out[last] = self.stop[sub[last]]
        begin = (np.cumsum(n) - n)[n > 0]
        out[begin] += self.first[sub[begin]]
        return np.bincount(np.repeat(np.arange(len(n)), n), out, len(n))


#: The model's arrays, in one vector.
SHAPES = {"embed": (CLASSES + 1, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "near": (LENGTH,), "out": (WIDTH, CLASSES), "bias": (CLASSES,)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())
#: The distance from each place of a window to each place before it; LENGTH: not before it.
BACK = np.arange(LENGTH)[:, None] - np.arange(LENGTH)
BACK[BACK < 0] = LENGTH
ONES = np.ones((LENGTH, 1), dtype=np.float32)
COLUMN = np.ones((CLASSES + 1, 1), dtype=np.float32)
#: Scores of pairs that are larger are taken as this, up or down.
LARGE = 30


_ENDS = np.cumsum([int(np.prod(s)) for s in SHAPES.values()]).tolist()


def parts(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays, as views."""
    return {name: flat[at:end].reshape(shape) for (name, shape), at, end in zip(SHAPES.items(), [0, *_ENDS], _ENDS)}


def fresh(log_mass: np.ndarray, seed: int = 0) -> np.ndarray:
    """A model that predicts the classes' shares whatever comes before."""
    flat = (np.random.default_rng(seed).standard_normal(SIZE) * 0.2).astype(np.float32)
    m = parts(flat)
    m["out"][:], m["near"][:] = 0, -0.1 * np.arange(LENGTH)
    m["bias"][:] = log_mass
    return flat


def tables(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What attention needs of all classes and of all distances. Values have a column of ones: their means hold the one that meets the
    bias, a row of out."""
    q, k, v = m["embed"] @ (m["q"] * np.float32(WIDTH**-0.5)), m["embed"] @ m["k"], m["embed"] @ m["v"]
    near = np.append(np.exp(np.clip(m["near"], -LARGE, LARGE)), 0).astype(np.float32)
    # Values are averaged, so no logit is larger than this.
    most = (np.abs(m["embed"]).max(axis=0) + np.abs(v).max(axis=0)) @ np.abs(m["out"]) + np.abs(m["bias"])
    return {
        "q": q, "k": k, "v": np.concatenate([v, COLUMN], axis=1), "near": near[BACK], "embed": np.concatenate([m["embed"], 0 * COLUMN], axis=1),
        "out": np.concatenate([m["out"], m["bias"][None]]), "back": np.ascontiguousarray(m["out"].T), "large score": not np.abs(q @ k.T).max() <= LARGE, "large logit": not most.max() <= 80,
    }


def _turned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def attend(m: dict[str, np.ndarray], t: dict[str, np.ndarray], before: np.ndarray, begin: int = 0) -> tuple:
    """Batched masked attention: hidden states (window, place, WIDTH and a one) of the places from begin on, the mean values in them,
    weights, pairs of large scores, and queries, keys and values."""
    own = before[:, begin:]
    q, k, v = (t[x].take(y, axis=0, mode="clip") for x, y in (("q", own), ("k", before), ("v", before)))
    a = q @ _turned(k)
    large = np.abs(a) > LARGE if t["large score"] else None
    if large is not None:
        np.clip(a, -LARGE, LARGE, out=a)
    np.exp(a, out=a)
    a *= t["near"][begin:]
    a /= a @ ONES
    mean = a @ v
    h = t["embed"].take(own, axis=0, mode="clip")
    h += mean
    return h, mean, a, large, q, k, v


def logits(t: dict[str, np.ndarray], hidden: np.ndarray) -> np.ndarray:
    z = hidden @ t["out"]
    return np.clip(z, -80, 80, out=z) if t["large logit"] else z


def log_probs(t: dict[str, np.ndarray], hidden: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probabilities of the classes, for hidden states (window, place, WIDTH and a one)."""
    z = logits(t, hidden)
    own = z.reshape(-1).take(np.arange(0, z.size, CLASSES) + target.reshape(-1)).reshape(target.shape)
    np.exp(z, out=z)
    return own - np.log(z @ np.ones(CLASSES, dtype=np.float32))


def gradients(m: dict[str, np.ndarray], before: np.ndarray, target: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, float]:
    """The gradient, as one vector, of the mean log loss over real places, and that loss. Products are made window by window, since
    large thin ones are slow, and what scales whole rows of logits is left to their narrow sides."""
    t = tables(m)
    h, mean, a, large, q, k, v = attend(m, t, before)
    flat = np.zeros(SIZE, dtype=np.float32)
    g = parts(flat)
    weight, n = real.astype(np.float32), max(1, int(real.sum()))
    p = logits(t, h)
    own = np.arange(0, p.size, CLASSES) + target.reshape(-1)
    right = p.reshape(-1).take(own)
    np.exp(p, out=p)
    total = p @ np.ones(CLASSES, dtype=np.float32)
    loss = float((np.log(total).reshape(-1).astype(np.float64) - right) @ weight.reshape(-1)) / n
    p.reshape(-1)[own] = np.exp(right) - total.reshape(-1)
    scale = (weight / total)[:, :, None]
    h *= scale
    both = (h.transpose(0, 2, 1) @ p).sum(axis=0)
    g["out"][:], g["bias"][:] = both[:WIDTH], both[WIDTH]
    dh = p @ t["back"]
    dh *= scale
    turned = a.transpose(0, 2, 1)
    dv = turned @ dh
    # Of the pairs' scores; masked pairs have weight 0, so they add nothing.
    low = np.einsum("wpk,wpk->wp", dh, mean[:, :, :WIDTH])[:, :, None]
    da = dh @ _turned(v[:, :, :WIDTH])
    da -= low
    a *= da
    near = a.sum(axis=0)
    if large is not None:
        a[large] = 0
    g["near"][:] = np.bincount(BACK.reshape(-1), near.reshape(-1), LENGTH + 1)[:LENGTH]
    row = before.reshape(-1)
    count = np.bincount(row, minlength=CLASSES + 1)
    some, by = np.flatnonzero(count), np.argsort(row.astype(np.uint8, copy=False), kind="stable")  # bytes are sorted by their digits
    first, by_class = (np.cumsum(count) - count)[some], np.zeros((4, CLASSES + 1, WIDTH), dtype=np.float32)
    for x, grown in zip(by_class, (dh, dv, a @ k, turned @ q)):
        x[some] = np.add.reduceat(grown.reshape(-1, WIDTH).take(by, axis=0, mode="clip"), first, axis=0)
    dh, dv, dq, dk = by_class
    dq *= np.float32(WIDTH**-0.5)
    g["embed"][:] = dh + dv @ m["v"].T + dq @ m["q"].T + dk @ m["k"].T
    g["v"][:], g["q"][:], g["k"][:] = m["embed"].T @ dv, m["embed"].T @ dq, m["embed"].T @ dk
    flat /= np.float32(n)
    return flat, loss


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t = np.float32(rate), 0
        self.one, self.two = np.zeros(SIZE, dtype=np.float32), np.zeros(SIZE, dtype=np.float32)

    def step(self, flat: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.one += np.float32(0.1) * (g - self.one)
        self.two += np.float32(0.01) * (g * g - self.two)
        flat -= self.rate * np.float32(1 / (1 - 0.9**self.t)) * self.one / (np.sqrt(self.two * np.float32(1 / (1 - 0.99**self.t))) + np.float32(1e-6))


def inputs(cls: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class before each place."""
    out = np.empty(len(cls), dtype=np.uint8)
    out[1:] = cls[:-1]
    out[starts] = START
    return out


def learn(t: Text, classes: Classes, flat: np.ndarray, opt: Adam, seed: int) -> int:
    """Train on the windows of a block's training texts, each id once, in batches of equal size; the number of ids."""
    ids, starts, n = t.run(len(classes.of) - 1)
    cls = classes.of[ids]
    before = inputs(cls, starts)
    doc, first, _ = windows(starts, n, np.flatnonzero(~t.held), 0)
    ends = (starts + n)[doc]
    m, seen = parts(flat), 0
    order = np.random.default_rng(seed).permutation(len(doc))
    for w in np.array_split(order, -(-len(order) // BATCH)) if len(order) else []:
        at = first[w, None] + np.arange(LENGTH)
        real = at < ends[w, None]
        at *= real
        seen += int(np.count_nonzero(real))
        opt.step(flat, gradients(m, before.take(at), cls.take(at), real)[0])
    return seen


def train(texts: DataFrame, classes: Classes, model: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The model after rounds of training on texts (packed blocks): each task trains a copy on its windows; copies are
    averaged by their ids."""
    for k in range(rounds):

        def local(batches, start=model, rate=RATE / (1 + k), k=k):
            m, seen, opt = start.copy(), 0, Adam(rate)
            for b in batches:
                for blob in b.column(0):
                    seen += learn(Text.unpacked(blob.as_py()), classes, m, opt, k)
            if seen:
                yield _sums_row(seen, m.astype(np.float64) * seen)

        sums = _summed(texts.mapInArrow(local, SUMS_DDL))
        if not sums:
            return model
        model = (sum(x for _, x in sums) / sum(n for n, _ in sums)).astype(np.float32)
    return model


SUMS_DDL = "part int, seen long, total binary"


def _sums_row(seen: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMS[0]], pa.int32()), pa.array([seen], pa.int64()), pa.array([total.astype(np.float64).tobytes()], pa.binary())], names=["part", "seen", "total"])


def _adder(groups: int):
    """Adds up the vectors of one part, as a part of fewer groups."""

    def total(t: pa.Table) -> pa.Table:
        flat = 0.0
        for x in t.column("total"):
            flat = flat + np.frombuffer(x.as_py(), dtype=np.float64)
        return pa.table({"part": pa.array([p % groups for p in t.column("part").to_pylist()[:1]], pa.int32()), "seen": pa.array([sum(t.column("seen").to_pylist())]), "total": pa.array([flat.tobytes()], pa.binary())})

    return total


def _summed(rows: DataFrame) -> list[tuple[int, np.ndarray]]:
    """The tasks' vectors, added up in groups, and those in fewer, so that no task adds up many: one vector, or none."""
    for groups in (*SUMS[1:], 1):
        rows = rows.groupBy("part").applyInArrow(_adder(groups), SUMS_DDL)
    return [(r["seen"], np.frombuffer(r["total"], dtype=np.float64)) for r in rows.collect()]


def _joined(words: list[bytes]) -> bytes:
    """Words as one string; none holds a line break."""
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


class WordItems:
    """Words as what is counted; they are added up and found in Arrow's arrays, and dealt as lists."""

    @staticmethod
    def listed(blob: bytes) -> list[bytes]:
        return zstandard.ZstdDecompressor().decompress(blob).split(b"\n")

    @staticmethod
    def cut(blob: bytes) -> pa.Array:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
        stops = np.append(np.flatnonzero(raw == 10), len(raw))
        return _array(np.append(0, stops - np.arange(len(stops))), raw[raw != 10])

    @staticmethod
    def joined(items: pa.Array | list[bytes]) -> bytes:
        return _joined(items if isinstance(items, list) else _listed(items))

    @staticmethod
    def keys(items: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, items), np.uint64, len(items))

    @staticmethod
    def together(rows: list[pa.Array]) -> pa.Array:
        return pa.concat_arrays(rows)

    @staticmethod
    def added(rows: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
        some = [np.flatnonzero(c) for _, c in rows]
        both = pa.concat_arrays([x.take(pa.array(k)) for (x, _), k in zip(rows, some)]).dictionary_encode()
        of, counts = both.indices.to_numpy(), np.concatenate([c[k] for (_, c), k in zip(rows, some)])
        total = np.zeros(len(both.dictionary), dtype=np.int64)
        np.add.at(total, of, counts)
        return both.dictionary, total

    @staticmethod
    def finder(items: pa.Array, counts: np.ndarray):
        counts = np.append(counts, 0)
        return lambda asked: counts[pc.index_in(asked, value_set=items).fill_null(len(items)).to_numpy()]


class PairItems:
    """Pairs of ids, as numbers, as what is counted."""

    @staticmethod
    def cut(blob: bytes) -> np.ndarray:
        return np.frombuffer(blob, dtype="<u8")

    listed = cut

    @staticmethod
    def joined(items: np.ndarray) -> bytes:
        return np.asarray(items).astype("<u8").tobytes()

    @staticmethod
    def keys(items: np.ndarray) -> np.ndarray:
        return items

    together = staticmethod(np.concatenate)

    @staticmethod
    def added(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        items, counts = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
        items, counts = items[counts > 0], counts[counts > 0]
        by = np.argsort(items, kind="stable")
        items, counts = items[by], counts[by]
        first = np.flatnonzero(np.append(True, items[1:] != items[:-1])[: len(items)])
        return items[first], np.add.reduceat(counts, first) if len(first) else counts

    @staticmethod
    def finder(items: np.ndarray, counts: np.ndarray):
        def find(asked: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(items, asked), max(0, len(items) - 1))
            return np.where(items[at] == asked, counts[at], 0) if len(items) else np.zeros(len(asked), dtype=np.int64)

        return find


def _added(t: pa.Table, kind):
    return kind.added([(kind.cut(x.as_py()), np.frombuffer(c.as_py(), dtype=np.int64)) for x, c in zip(t.column("items"), t.column("counts"))])


def counted(blocks: DataFrame, kind, part_words: int = PART_WORDS, group_blocks: int = GROUP_BLOCKS) -> tuple[DataFrame, int, int, int]:
    """For blocks (block, n, items, counts: the block's distinct items in order of their keys and how often its training texts
    have them): rows (block, part, counts of the whole corpus for the items of the part, in the same order); and the number of
    items, of distinct items and of items that occur once in all training texts."""
    sums = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_parts, n_groups = max(1, -(-sums[0] // part_words)), max(1, -(-sums[1] // group_blocks))
    fences = [(k << 64) // n_parts for k in range(1, n_parts)]

    def dealt(batches):
        for b in batches:
            for block, blob, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                x, c = kind.listed(blob.as_py()), np.frombuffer(counts.as_py(), dtype=np.int64)
                cuts = [0, *np.searchsorted(kind.keys(x), np.array(fences, dtype=np.uint64)).tolist(), len(x)]
                rows = [(k, lo, hi) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _, _ in rows], pa.int64()), pa.array([xxhash.xxh3_64_intdigest(str(block)) % n_groups] * len(rows), pa.int64()), pa.array([block] * len(rows), pa.int64()),
                     pa.array([kind.joined(x[lo:hi]) for _, lo, hi in rows], pa.binary()), pa.array([c[lo:hi].tobytes() for _, lo, hi in rows], pa.binary())],
                    names=["part", "group", "block", "items", "counts"],
                )

    asked = written(blocks.where("n > 0").select("block", "items", "counts").mapInArrow(dealt, "part long, group long, block long, items binary, counts binary"), "asked")

    def merged(t: pa.Table) -> pa.Table:
        items, c = _added(t, kind)
        return pa.table({
            "part": pa.array(t.column("part").to_pylist()[:1], pa.int64()), "items": pa.array([kind.joined(items)], pa.binary()), "counts": pa.array([c.tobytes()], pa.binary()),
            "n": pa.array([int(c.sum())]), "v": pa.array([len(c)]), "once": pa.array([int((c == 1).sum())]),
        })

    ddl = "part long, items binary, counts binary, n long, v long, once long"
    totals = asked.select("part", "group", "items", "counts").groupBy("part", "group").applyInArrow(merged, ddl)
    if n_groups > 1:
        totals = totals.groupBy("part").applyInArrow(merged, ddl)
    totals = written(totals, "totals")
    n, v, once = totals.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("n", "v", "once")]).first()

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = [kind.cut(x.as_py()) for x in left.column("items")]
        every = kind.finder(*_added(right, kind))(kind.together(asked)).astype(np.int64) if asked else []
        got = [x.tobytes() for x in np.split(every, np.cumsum([len(x) for x in asked])[:-1])] if asked else []
        return pa.table({"block": left.column("block"), "part": left.column("part"), "counts": pa.array(got, pa.binary())})

    sent = totals.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))).alias("group"), "items", "counts")
    out = asked.select("part", "group", "block", "items").groupBy("part", "group").cogroup(sent.groupBy("part", "group")).applyInArrow(answered, "block long, part long, counts binary")
    out = written(out, "answers")
    forget(asked, totals)
    return out, n, v, once


def log10_ids(t: Text, classes: Classes, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log10 probability of every id of a block's documents, their ends included, and where each document's begin."""
    ids, starts, n = t.run(len(classes.of) - 1)
    cls = classes.of[ids]
    before = inputs(cls, starts)
    m = parts(model)
    table = tables(m)
    out = classes.share[ids]
    doc, first, scored_from = windows(starts, n, np.arange(len(n)), OVERLAP)
    ends = (starts + n)[doc]
    for begin in (0, OVERLAP):  # a document's first window has no overlap; of the others only the places after it are queries
        own = np.flatnonzero(scored_from - first == begin)
        for lo in range(0, len(own), SCORED):
            w = own[lo : lo + SCORED]
            at = first[w, None] + np.arange(LENGTH)
            real = at[:, begin:] < ends[w, None]
            np.minimum(at, len(ids) - 1, out=at)
            place = at[:, begin:]
            got = log_probs(table, attend(m, table, before.take(at), begin)[0], cls.take(place))
            out[place[real]] += got[real]
    return out / np.log(10), starts


def _power(x: np.ndarray) -> np.ndarray:
    """10 ** x; numpy is slower with the general power."""
    return np.exp(x * np.log(10))


def log10_words(t: Text, classes: Classes, spelling: Spelling, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The log10 probability of every word of a block's documents, from those of its ids and the counts of its distinct words and of
    their distinct pairs of ids in the training texts. Words without ids are not seen by the model and have 0."""
    n = t.n_sub[t.of]
    inner = np.ones(len(ids), dtype=bool)
    inner[np.append(starts[1:], len(ids))[: len(starts)] - 1] = False  # the ends
    own = ids[inner]
    begin = np.cumsum(t.n_sub) - t.n_sub
    _, pair, after = t.pairs()
    places = _places(begin[t.of], n)
    seen, rest = (x.take(places) for x in spelling.mixed(t.sub, after, pairs[pair]))
    out = np.bincount(np.repeat(np.arange(len(n)), n), np.log(seen + rest * _power(own)) / np.log(10), len(n))
    some, known = n > 0, counts > 0
    each = spelling.tails(t.sub, t.n_sub) + np.log10(spelling.new)
    out[some] += each[t.of[some]]
    # What a word taken whole has in place of the share of its first id.
    whole = np.full(len(counts), -np.inf)
    known &= t.n_sub > 0
    first = t.sub[begin[known]]
    whole[known] = np.log10(counts[known]) - spelling.mass[classes.of[first]] - classes.share[first] / np.log(10) + np.log10(1 - spelling.new)
    at = (np.cumsum(n) - n)[some]
    taken = own[at] + whole[t.of[some]]
    high = np.maximum(out[some], taken)
    out[some] = high + np.log10(1 + _power(np.minimum(out[some], taken) - high))
    return out


def score(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_ids and id_score of every document.

    score is the log10 probability of the text's words and its end; id_score is that of its n_ids subword ids by attention alone, its
    end included. Null and empty texts are an end alone; a
    very long text is scored whole, in windows, and makes a block of its own; null ids are trained on; repeated rows are documents of
    their own; without training texts every token is unknown; an empty table gives an empty result; columns beside doc_id and text
    are not read.
    """
    path = path or vocabulary_path()
    word_ends = vocabulary(path).ends
    vocab = len(word_ends)

    def blocks(batches):
        """A row for each block, then one with this task's counts of ids and its number of training texts."""
        names = ["block", "texts", "n_words", "words", "counts", "n_pairs", "pairs", "times", "seen", "total"]
        schema = pa.schema([(x, pa.binary() if x in ("texts", "words", "counts", "pairs", "times", "total") else pa.int64()) for x in names])
        every, trained = np.zeros((3 + SKETCH + 1, vocab + 1), dtype=np.int64), 0  # of ids, of words' first ids, of their last; company
        signs = signatures(vocab)
        for k, ids, texts in pieces(batches, block_bytes):
            t = Text(ids, texts, path)
            c = np.bincount(t.of[np.repeat(~t.held, t.n)], minlength=len(t.words))
            stops, some = np.cumsum(t.n_sub), t.n_sub > 0
            for row, at, n in ((0, slice(None), np.repeat(c, t.n_sub)), (1, (stops - t.n_sub)[some], c[some]), (2, stops[some] - 1, c[some])):
                every[row, :vocab] += np.bincount(t.sub[at], n, vocab).astype(np.int64)
            every[3:] += company(t, signs)
            trained += int((~t.held).sum())
            two, pair, after = t.pairs()
            times = np.bincount(pair, np.repeat(c, t.n_sub)[after], len(two)).astype(np.int64)
            row = [k, t.packed(), len(t.words), _joined(t.words), c.astype(np.int64).tobytes(), len(two), PairItems.joined(two), times.tobytes(), None, None]
            yield pa.RecordBatch.from_pylist([dict(zip(names, row))], schema)
        every[0, vocab] = trained
        if trained:
            blob = zstandard.ZstdCompressor(level=1).compress(every.astype("<i8").tobytes())
            yield pa.RecordBatch.from_pylist([{"seen": trained, "total": blob}], schema)

    rows = docs.select(F.col("doc_id").cast("long"), text_bytes(F.col("text")).alias("text"))
    made = written(rows.mapInArrow(blocks, "block long, texts binary, n_words long, words binary, counts binary, n_pairs long, pairs binary, times binary, seen long, total binary"), "words")

    def widened(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for n, x in zip(b.column(0).to_pylist(), b.column(1)):
                yield _sums_row(n, np.frombuffer(z.decompress(x.as_py()), dtype="<i8"))

    sums = _summed(made.where("seen IS NOT NULL").select("seen", "total").mapInArrow(widened, SUMS_DDL))  # one row of (4 + SKETCH) times the vocabulary's size
    n_docs = sum(n for n, _ in sums)
    total = sum((x for _, x in sums), np.zeros((4 + SKETCH) * (vocab + 1))).reshape(4 + SKETCH, -1)
    every, first, last = total[:3]
    classes = Classes(every, word_ends, kinds(total[3:], every))
    texts = made.where("texts IS NOT NULL")
    model = train(texts.select("texts"), classes, fresh(classes.log_mass), rounds)
    answers, n_words, v_words, n_once = counted(texts.selectExpr("block", "n_words n", "words items", "counts"), WordItems)
    paired = counted(texts.selectExpr("block", "n_pairs n", "pairs items", "times counts"), PairItems)[0]
    answers = answers.withColumn("kind", F.lit(0)).unionByName(paired.withColumn("kind", F.lit(1)))
    spelling = Spelling(classes, every, first, last, n_words, n_once)
    n_all, v_all = n_words + n_docs, v_words + (n_docs > 0)
    whole = np.log10(n_all + SMOOTH * (v_all + 1))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        t = Text.unpacked(left.column("texts")[0].as_py())
        got = sorted(zip(right.column("kind").to_pylist(), right.column("part").to_pylist(), right.column("counts")), key=lambda x: x[:2]) if right.num_rows else []
        c, pairs = (np.frombuffer(b"".join(x.as_py() for k, _, x in got if k == kind), dtype=np.int64) for kind in (0, 1))
        stops = np.append(0, np.cumsum(t.n))
        sums = lambda x: np.diff(np.append(0, np.cumsum(x))[stops])
        known, each = sums((c > 0)[t.of].astype(np.int64)), np.log10(c + SMOOTH)[t.of]
        # A document's own sum, not a difference of two large ones.
        some = np.flatnonzero(t.n)
        base = np.zeros(len(t.n))
        if len(some):
            base[some] = np.add.reduceat(each, stops[:-1][some])
        base += np.log10(n_docs + SMOOTH) - (t.n + 1) * whole
        ids, starts = log10_ids(t, classes, model)
        ends = np.append(starts[1:], len(ids))
        total = ids[ends - 1]
        if len(some):
            total[some] += np.add.reduceat(log10_words(t, classes, spelling, ids, starts, c, pairs), stops[:-1][some])
        return pa.table({
            "doc_id": pa.array(t.ids, mask=t.ids == NO_ID), "held_out": pa.array(t.held), "n_tokens": pa.array(t.n + 1), "n_known": pa.array(known + (n_docs > 0)), "train_tokens": pa.array(np.full(len(t.n), n_all)),
            "base_score": pa.array(base), "score": pa.array(total), "n_ids": pa.array(ends - starts), "id_score": pa.array(np.add.reduceat(ids, starts)),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_ids long, id_score double"
    empty = empty_table(schema)
    return texts.select("block", "texts").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, schema)
