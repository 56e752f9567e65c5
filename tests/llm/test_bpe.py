"""BPE against the tokenizers library, and exact round trips."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wavepanel.llm import bpe


@pytest.fixture(scope="module")
def spec():
    return bpe.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def pair(spec):
    return bpe.BacktrackingBpe(spec), Tokenizer.from_str(spec)


def same(pair, text):
    own, other = pair
    want = other.encode(text, add_special_tokens=False).ids
    ids = own.encode(text)
    return np.frombuffer(ids, "<u4").tolist() == want and own.decode(ids).decode() == other.decode(want, skip_special_tokens=False)


def test_every_token_is_its_own_encoding(pair):
    own, other = pair
    vocab = other.get_vocab(with_added_tokens=False)
    assert len(own._shorter) == len(vocab)  # so none is left out of the automaton
    assert np.frombuffer(own._encode_word("the"), "<u4").tolist() == [vocab["the</w>"]]


def test_sample(pair, sample):
    assert all(same(pair, t) for _, t in sample)


def test_random_texts(pair):
    rng = random.Random(1)
    alphabet = "aabbcdeist'’ 1\n\tÀéßΣσςİ<|endoftext|>日本語́ẞꟋ\x85\x1c ſK٣½"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        if rng.random() < 0.1:
            text += "<|endoftext|>" + text + "<|startoftext|>"
        assert same(pair, text), text


def test_every_code_point(pair):
    for lo in range(0, 0x11000, 37):
        text = " ".join(f"a{chr(c)}b{chr(c)}" for c in range(lo, lo + 37) if not 0xD800 <= c <= 0xDFFF)
        assert same(pair, text), hex(lo)


def test_long_runs(pair):
    for text in ["a" * 3000, "ab" * 2000, "=" * 5000, "the" * 3000, "abababc" * 999, " ", "", "<|endoftext|>", "ΑΣ ", "'s 're'll"]:
        assert same(pair, text)


def test_whole_tables_and_edges(spark, docs, spec, pair):
    from pyspark.sql import functions as F

    rows = [(1, "Hello"), (2, None), (3, ""), (4, "Hello"), (4, "Hello"), (5, "word " * 20_000)]
    t = docs(rows).withColumn("ids", F.lit("x")).withColumn("a b", F.lit(1))
    out = bpe.decode(bpe.encode(t, spec), spec).orderBy("doc_id").collect()
    assert [r["decoded"] for r in out[:5]] == ["hello</w>", None, "", "hello</w>", "hello</w>"]
    assert len(out[5]["ids"]) == 80_000 and out[0]["a b"] == 1 and out[1]["ids"] is None
    assert bpe.encode(docs([]), spec).count() == 0
    once = bpe.round_trip(t.withColumn("Decoded", F.lit(0)), spec)
    assert once.columns == [*[c for c in t.columns if c not in ("text", "ids")], "ids", "decoded"]
    assert sorted(map(str, once.select("doc_id", "ids", "decoded").collect())) == sorted(map(str, bpe.decode(bpe.encode(t, spec), spec).select("doc_id", "ids", "decoded").collect()))
    assert bpe.round_trip(docs([]), spec).count() == 0


def test_a_worker_holds_one_vocabulary_and_bounded_pairs(pair, sample, monkeypatch):
    own, _ = pair
    assert own._own.get_vocab_size() == 0  # of the file only the rules of normalising and splitting
    monkeypatch.setattr(bpe, "CACHE", 50)
    own._joins.clear(), own._words.clear()
    for _, t in list(sample)[:50]:
        assert same(pair, t)
        assert len(own._joins) <= 50 and len(own._words) <= 50
