"""Byte-level BPE against the tiktoken library and against merging one pair at a time."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from wavepanel.llm import byte_bpe as B

FILES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def content():
    return B.read_ranks(P.path(FILES[0]))


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    ranks = B.parse_ranks(B.read_ranks(P.path(request.param)))
    return B.MatrixBpe(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def same(pair, text):
    own, other = pair
    return ids(own.encode(text)) == other.encode_ordinary(text) and own.decode(own.encode(text)) == text.encode()


def one_by_one(word, ranks):
    """The leftmost pair of the least rank, merged again and again."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[k : k + 1] for k in range(len(word))]
    while True:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, k = min(found)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_sample_and_random_texts(pair, sample):
    assert all(same(pair, t or "") for _, t in sample)
    rng = random.Random(1)
    alphabet = "aabbcdeist'’ 1\n\tÀéßΣσςİ<|endoftext|>日本語́ẞꟋ\x85\x1c ſK٣½　"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert same(pair, text), text


def test_every_code_point(content):
    ranks = B.parse_ranks(content)
    pair = B.MatrixBpe(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for lo in range(0, 0x110000, 8192):
        text = " ".join(f"a{chr(c)}1{chr(c)}\n{chr(c)}!" for c in range(lo, lo + 8192) if not 0xD800 <= c <= 0xDFFF)
        assert same(pair, text), hex(lo)


def test_long_pre_tokens(pair):
    rng = random.Random(2)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6000))
    for text in ["a" * 5000, "ab" * 4000, "=" * 9000, letters, " " * 3000 + "x", "日本" * 1500, "", " "]:
        assert same(pair, text)


def test_random_vocabularies_where_merges_make_lower_pairs():
    rng = random.Random(5)
    for trial in range(60):
        more = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(1, 25))}
        strings = [bytes([b]) for b in range(256)] + sorted(more, key=lambda t: rng.random())
        ranks = {t: k for k, t in enumerate(strings)}
        own = B.MatrixBpe(ranks, r"\S+|\s+")
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30))) for _ in range(60)]
        assert [ids(x) for x in own.encode_words(words)] == [one_by_one(w, ranks) for w in words], trial


def test_pair_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 300, (5000, 2)), axis=0)
    table = B.PairTable(keys[:, 0], keys[:, 1], np.arange(len(keys), dtype=np.int32))
    assert table.ranks(keys[:, 0], keys[:, 1]).tolist() == list(range(len(keys)))
    assert (table.ranks(keys[:, 0] + 300, keys[:, 1]) == B._NONE).all()


def test_small_caches_change_nothing(pair, sample, monkeypatch):
    own, _ = pair
    texts = [t or "" for _, t in sample[:30]]
    want = own.encode_all(texts)
    monkeypatch.setattr(B, "CACHE", 50)
    monkeypatch.setattr(B, "AT_ONCE", 20)
    monkeypatch.setattr(B, "CELLS", 64)
    own._words.clear()
    assert own.encode_all(texts) == want


def test_tables_and_edges(docs, content):
    rows = [(1, "Hello there"), (2, None), (3, ""), (4, "Hello there"), (4, "Hello there"), (5, "word " * 60_000), (None, "é<|endoftext|>")]
    t = docs(rows).withColumn("IDS", F.lit("x")).withColumn("a b", F.lit(1))
    out = B.decode(B.encode(t, content, P.PATTERN), content, P.PATTERN).orderBy(F.col("doc_id").asc_nulls_last()).collect()
    assert [None if r["decoded"] is None else bytes(r["decoded"]).decode() for r in out] == [r[1] for r in rows]
    assert out[1]["ids"] is None and out[2]["ids"] == b"" and out[0]["a b"] == 1 and out[3]["ids"] == out[4]["ids"]
    assert B.encode(docs([]), content, P.PATTERN).count() == 0
