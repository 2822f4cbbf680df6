"""Huffman token files: exact round trips."""

import heapq
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def test_round_trip(spark, docs, corpus, tokenizer):
    folder = tokens.write_tokens(docs)
    want = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t, *_ in corpus}
    assert {r.doc_id: r.ids for r in tokens.read_ids(spark, folder).collect()} == want
    start = 0
    for r in tokens.digest(spark, folder).orderBy("doc_id").collect():
        ids = np.array(want[r.doc_id], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_small_blocks(spark, docs, corpus, tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_IDS", 500)
    folder = tokens.write_tokens(docs)
    assert spark.read.parquet(f"{folder}/blocks").count() > 10
    assert {r.doc_id: len(r.ids) for r in tokens.read_ids(spark, folder).collect()} == {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t, *_ in corpus}


def test_odd_rows(spark, odd, none):
    got = sorted(((r.doc_id is None, r.n_tokens) for r in tokens.digest(spark, tokens.write_tokens(odd)).collect()))
    assert len(got) == 5 and got.count((True, 1)) == 1 and got.count((False, 1)) == 1
    assert tokens.digest(spark, tokens.write_tokens(none)).count() == 0


WORDS = st.text(alphabet=st.sampled_from("aBcé.,!?'#$ \n\t»…1２ß漢<|>Σσ́\0"), max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=5))
def test_encoding_by_words_is_the_librarys(texts):
    t = tokens.vocabulary(tokens.vocabulary_path()).tokenizer
    got = tokens.encode_texts(tokens.vocabulary_path(), [x.encode() for x in texts])
    assert [g.tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_special_strings(tokenizer):
    for x in ["a <|endoftext|> b", "A <|ENDOFTEXT|> B", "x<|startoftext|>y.", "don't STOP'S we're"]:
        assert tokens.encode_texts(tokens.vocabulary_path(), [x.encode()])[0].tolist() == tokenizer.encode(x, add_special_tokens=False).ids


def huffman_cost(counts):
    h = [int(c) for c in counts if c]
    heapq.heapify(h)
    total = h[0] if len(h) == 1 else 0
    while len(h) > 1:
        x = heapq.heappop(h) + heapq.heappop(h)
        total += x
        heapq.heappush(h, x)
    return total


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=200), st.integers(0, 2000), st.integers(0, 2**32))
def test_codes(counts, n, seed):
    c = np.array(counts)
    lengths = tokens.code_lengths(c)
    used = np.flatnonzero(c)
    if not len(used):
        return
    assert (2.0 ** -lengths[used].astype(float)).sum() <= 1 and not lengths[c == 0].any()
    if lengths.max() < tokens.MAX_LENGTH:
        assert (lengths * c).sum() == huffman_cost(c)
    ids = np.random.default_rng(seed).choice(used, n)
    bits, points = tokens.pack(ids, lengths, tokens.canonical_codes(lengths))
    assert (tokens.unpack(bits, np.array(points), n, tokens.decoding_table(lengths)) == ids).all()


def test_length_limit():
    lengths = tokens.code_lengths(2 ** np.arange(40))
    assert lengths.max() == tokens.MAX_LENGTH and (2.0 ** -lengths.astype(float)).sum() == 1


def test_null_characters_are_part_of_words(tokenizer):
    for x in ["a\0 a", "\0 a \0a", "a a\0\0 \0"]:
        assert tokens.encode_texts(tokens.vocabulary_path(), [x.encode()])[0].tolist() == tokenizer.encode(x, add_special_tokens=False).ids
