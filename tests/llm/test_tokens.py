"""Token counts, codec and packing, against the libraries themselves."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from heddle.llm import bpe_count, bpe_duckdb, packing


@pytest.fixture(scope="module")
def counter():
    return bpe_count.Counter(public_tokenizers.path(bpe_count.VOCABULARY))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe_count.VOCABULARY))


@pytest.fixture(scope="module")
def codec():
    return bpe_duckdb.Codec(public_tokenizers.path(bpe_duckdb.VOCABULARY))


@pytest.fixture(scope="module")
def encoding(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@pytest.fixture(scope="module")
def word_encoder():
    return packing.Encoder(public_tokenizers.path(packing.VOCABULARY))


TEXT = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sabcEÉé.,|<>_0½́Σİ")), max_size=80)
MORE = ["a" * 5000, "abcabcab" * 300, "<|endoftext|> x<|ENDOFTEXT|>", "\x1c\x1d a\x1e\x1f b\x85c", "J̌ É ΑΣ ǅ K"]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_counts_like_the_library(counter, library, texts):
    assert counter.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=3))
def test_codec_like_the_library(codec, encoding, texts):
    ids = codec.encode(texts)
    assert [x.tolist() for x in ids] == [encoding.encode_ordinary(t) for t in texts]
    assert [x.decode() for x in codec.decode(ids)] == texts
    # decoding goes by the ids and their order, not by the texts that were encoded
    assert [x for x in codec.decode([x[::-1] for x in ids])] == [encoding.decode_bytes(x[::-1].tolist()) for x in ids]


def long_words():
    import random

    rng = random.Random(1)
    syllables = ["tion", "er", "the", "un", "ver", "ing", "schaft", "re", "qu", "ly"]
    return [
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)),
        "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(200_000)),
        "".join(rng.choice("ACGT") for _ in range(20_000)),
        "a" * 100_001,
        "".join(rng.choice(syllables) for _ in range(800)) + " " + "".join(rng.choice(syllables) for _ in range(300)),
    ]


def test_long_words(codec, encoding, counter, library):
    words = long_words()
    ids = codec.encode(words)
    assert [x.tolist() for x in ids] == [encoding.encode_ordinary(t) for t in words]
    assert [x.decode() for x in codec.decode(ids)] == words
    assert counter.count(words) == [len(e.ids) for e in library.encode_batch(words, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_words_encode_like_the_whole(word_encoder, texts):
    want = [e.ids for e in word_encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in word_encoder.encode(texts)] == want


def test_long_and_special_texts(counter, library, codec, encoding, word_encoder):
    assert counter.count(MORE) == [len(e.ids) for e in library.encode_batch(MORE, add_special_tokens=False)]
    assert list(map(len, codec.encode(MORE))) == [len(encoding.encode_ordinary(t)) for t in MORE]
    assert [len(x) // 4 for x in word_encoder.encode(MORE)] == [len(e.ids) for e in word_encoder.tokenizer.encode_batch(MORE, add_special_tokens=False)]


def test_count_query_on_odd_rows(odd, empty, texts, library):
    got = Counter(tuple(r) for r in bpe_count.token_counts(odd).collect())
    want = Counter()
    for i, t in texts:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 1024] += 1
    assert got == want
    assert bpe_count.token_counts(empty).count() == 0


def test_codec_query_on_odd_rows(odd, empty, texts, encoding):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = Counter(tuple(r) for r in bpe_duckdb.encoded_digests(odd).collect())
    want = Counter()
    for i, t in texts:
        ids = encoding.encode_ordinary(t or "")
        want[i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())] += 1
    assert got == want
    assert bpe_duckdb.encoded_digests(empty).count() == 0
    back = Counter(tuple(r) for r in bpe_duckdb.decode_documents(bpe_duckdb.encode_documents(odd)).collect())
    assert back == Counter((i, t or "") for i, t in texts)


def check_packing(rows, texts, library, capacity):
    """Every id once, in place; returns the number of sequences."""
    spans = defaultdict(list)
    for r in rows:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= capacity
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = Counter()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a : a + capacity], dtype="<u4")
            want[i, k, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert got == want
    return len(spans)


def test_packing_of_odd_rows(odd, empty, texts, word_encoder):
    check_packing(packing.pack_documents(odd).collect(), texts, word_encoder.tokenizer, 4096)
    check_packing(packing.pack_documents(odd, capacity=64).collect(), texts, word_encoder.tokenizer, 64)
    assert packing.pack_documents(empty).count() == 0


def test_words_to_pack_like_the_library(word_encoder):
    """Lower-case ASCII words are encoded by the model alone, all others by the whole tokenizer; ids are the library's."""
    rng = np.random.default_rng(7)
    letters = list("etaoinshrdlcumw") + list("0179.,-&!#(<|")
    words = ["".join(rng.choice(letters, rng.integers(1, 14))) for _ in range(3_000)] + ["it's", "x" * 90, "1", "12", "&&", "<|endoftext|>", "été", "über-12", "naïve"]
    texts = [" ".join(words[a : a + 50]) for a in range(0, len(words), 50)]
    want = [word_encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    fresh = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in fresh.encode(texts)] == want
    fresh.seen.clear()
    fresh.tokenizer = None  # not asked for these
    text = "these are plain words, 2x as quick"
    assert np.frombuffer(fresh.encode([text])[0], dtype="<u4").tolist() == word_encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_query(spark, small, word_encoder):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = packing.query(spark, small).collect()
    n = check_packing(rows, texts, word_encoder.tokenizer, 4096)
    assert n <= 1.05 * -(-sum(r["length"] for r in rows) // 4096) + 1


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30), st.integers(1, 12))
def test_plan_places_each_item_once(histogram, groups):
    ranks, fill = defaultdict(set), defaultdict(list)
    for length, first, n, seq, offset in packing.plan(histogram, 64, groups):
        for k in range(n):
            assert first + k not in ranks[length]
            ranks[length].add(first + k)
            fill[seq + k].append((offset, length))
    assert {x: set(range(n)) for x, n in histogram.items()} == dict(ranks)
    for own in fill.values():
        own.sort()
        at = 0
        for offset, length in own:
            assert offset == at
            at += length
        assert at <= 64
    assert set(fill) == set(range(len(fill)))


def test_plan_of_many_lengths_is_close_to_the_bound():
    rng = np.random.default_rng(0)
    lengths = Counter(np.clip(rng.lognormal(6, 1, 50_000).astype(int), 1, 4096).tolist())
    n = max(s + k for _, _, k, s, _ in packing.plan(lengths))
    assert n <= 1.02 * sum(x * k for x, k in lengths.items()) / 4096


@pytest.mark.parametrize("letters", ["a", "ab", "-=", "aeinrst", "=", "的一是不了人", "ÿ"])
def test_codec_of_long_words(codec, encoding, letters):
    """Words in windows: random and periodic, of lengths about a window's and far beyond it."""
    rng = np.random.default_rng(5)
    for n in (40, 95, 96, 97, 143, 144, 145, 700, 9_001):
        for word in ("".join(rng.choice(list(letters), n)), (letters * n)[:n]):
            got = np.frombuffer(codec.encode_words([word.encode()])[0], "<i4").tolist()
            assert got == encoding._encode_single_piece(word.encode())


def test_codec_makes_windows_longer_that_do_not_fit(codec, encoding):
    word = ("=" * 997 + "-") * 7
    assert codec.joined(("=" * 1_000).encode(), 48) is None
    assert np.frombuffer(codec.encode_words([word.encode()])[0], "<i4").tolist() == encoding._encode_single_piece(word.encode())


def test_codec_of_a_word_of_millions_of_letters(codec):
    word = "a" * 3_000_000
    (ids,) = codec.encode([word])
    assert codec.decode([ids]) == [word.encode()]
    assert ids.tolist() == codec.encode(["a" * 3_000])[0].tolist() * 1_000
