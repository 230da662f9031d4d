"""The encoders and codecs against the libraries, brute force and round trips."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavemill.llm import golomb, lm, packing, perfect_hash
from wavemill.llm.counts import Splicer
from wavemill.llm.encoding import Encoder

PIECES = ["a", "b", "E", " ", "  ", "\n", "é", "É", "ß", "漢", "𝛀", "hello ", "The ", "ing", "0", "12", ".", "!!", "'", "'s", "'ll", "<|endoftext|>", "<|", "|>", "<|ENDOFTEXT|>", "\u0301", "\u00a0", "\x1c", "\x00", "×", "µ", "İ", "Σ", "ς", "…", "\x85", "ﬁ", "가", "ᄀ", "ᅡ", "²", "<s>", "</s>", "▁", "<0x0A>", "======"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=80).map("".join)


@pytest.fixture(scope="module")
def words():
    return Encoder(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def splicer():
    return Splicer(public_tokenizers.path("piece_bpe_32k.model"), chunk_chars=40, overlap_chars=6)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_word_cache_is_exact(words, text):
    want = np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, words.dtype).tobytes()
    assert words.by_word and words.encode(text) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=12))
def test_texts_together_are_exact(words, texts):
    ids, sizes = words.encode_many(texts)
    want = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from([chr(c) for c in range(1, 256)]), max_size=40), max_size=6))
def test_latin_texts_together_are_exact(words, texts):
    ids, sizes = words.encode_many(texts)
    want = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_other_vocabularies_are_used_whole():
    own = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert own.encode_many(["a b", "", "c"])[1].tolist() == [len(own.tokenizer.encode(t).ids) for t in ("a b", "", "c")]
    assert not own.by_word and np.frombuffer(own.encode("Hello, world"), own.dtype).tolist() == own.tokenizer.encode("Hello, world", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_splicing_is_exact(splicer, text):
    assert splicer.ids(text).tolist() == splicer.sp.encode(text)


def test_splicing_without_any_boundary(splicer):
    for text in ("e" * 1000, "th" * 500, "=" * 777, "漢" * 300, " " * 500):
        assert splicer.ids(text).tolist() == splicer.sp.encode(text)
    assert splicer.counts(["", "a", "word " * 100]) == [len(splicer.sp.encode(t)) for t in ("", "a", "word " * 100)]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=200))
def test_golomb_round_trip(numbers):
    x = np.array(sorted(numbers), np.uint64)
    assert golomb.decode(golomb.encode(x)).tolist() == x.tolist()


def test_golomb_is_compact():
    x = np.unique(np.random.default_rng(0).integers(0, 2**63, 100_000).astype(np.uint64))
    assert len(golomb.encode(x)) < 6.3 * len(x)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300))
def test_perfect_hash_is_minimal_and_perfect(keys):
    x = np.array(sorted(keys), np.int64).view(np.uint64)
    table = perfect_hash.PerfectHash.build(x)
    assert sorted(table.number(x).tolist()) == list(range(len(x)))


def test_perfect_hash_lists_what_no_level_settles(monkeypatch):
    monkeypatch.setattr(perfect_hash, "LEVELS", 1)
    x = np.arange(5000, dtype=np.uint64)
    table = perfect_hash.PerfectHash.build(x)
    assert len(table.rest) and sorted(table.number(x).tolist()) == list(range(5000))


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_visits_neighbours(n, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
    key = packing.hilbert(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), max_size=50), st.integers(1, 9))
def test_count_and_hash_packing(counts, owners):
    c = np.array(counts, np.int64)
    assert lm.unpack_counts(lm.pack_counts(c), len(c)).tolist() == counts
    h = np.unique(np.random.default_rng(len(counts)).integers(0, 2**63, 200).astype(np.uint64) * np.uint64(2))
    got = []
    for o in range(owners):
        low, high = lm.owner_range(o, owners)
        own = h[(h >> np.uint64(48) >= low) & (h >> np.uint64(48) < high)]
        got += lm.unpack_hashes(lm.pack_hashes(own, low, high), low, high).tolist()
    assert got == h.tolist()


def test_slices_cut_no_word():
    text = b"aa bbb  cccccccccc d" * 9
    assert b"".join(lm.slices(text, 7)) == text and b" ".join(x for s in lm.slices(text, 7) for x in s.split()).split() == text.split()
    assert list(lm.slices(b"", 7)) == [b""] and list(lm.slices(b"abcdefgh", 3)) == [b"abcdefgh"]
