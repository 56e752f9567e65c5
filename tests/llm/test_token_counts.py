"""Trie counts against plain dynamic programming and against a library's unigram model."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from wavepanel.llm import token_counts as T


@pytest.fixture(scope="module")
def scores():
    return T.zipf_scores(T.read_pieces(public_tokenizers.path("piece_bpe_32k.model")))


def plain(word, scores, known, least):
    best = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        found = [(best[i][0] + scores[word[i:j]], best[i][1] - 1) for i in range(j) if word[i:j] in scores]
        if word[j - 1] not in known:
            size = len(word[j - 1].encode())
            found.append((best[j - 1][0] + size * (least + T.OTHER), best[j - 1][1] - size))
        best.append(max(found))
    return -best[-1][1]


def test_words_of_a_table(scores, sample):
    words = {T.MARK + w for _, t in sample for w in t.split()} | {T.MARK + w for w in ("日本語ẞ", "a", "thethethe" * 9, "ß", "🙂x")}
    counter = T.TrieCounter(scores)
    library = Tokenizer(models.Unigram([("<unk>", counter.least), *scores.items()], unk_id=0))
    for w in words:
        n = counter.count(w)
        assert n == plain(w, scores, counter.known, counter.least)
        if all(c in counter.known for c in w):
            assert n == len(library.encode(w).ids)
    assert counter.computed < sum(map(len, words))  # prefixes are shared
    before = counter.computed
    assert [counter.count(w) for w in words] and counter.computed == before


def test_small_trie_gives_the_same(scores, monkeypatch):
    words = [T.MARK + f"word{i}ing日" for i in range(300)] + [T.MARK + "longest" * 40]
    whole = [T.TrieCounter(scores).count(w) for w in words]
    monkeypatch.setattr(T, "NODES", 50)
    small = T.TrieCounter(scores)
    assert [small.count(w) for w in words] == whole


def test_tables_and_edges(docs, scores):
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (3, " \n\x0b"), (4, "the the"), (4, "the the"), (5, "the " * 30_000), (6, "a\u00a0b")]
    t = docs(rows).withColumn("n_tokens", F.lit("x")).withColumn("count", F.lit(1))
    got = {(r["doc_id"], r["n_pre_tokens"], r["n_tokens"], r["count"]) for r in T.token_counts(t, scores).collect()}
    one = T.TrieCounter(scores).count("▁the")
    nbsp = T.TrieCounter(scores).count("▁a\u00a0b")
    assert got == {(1, 0, 0, 1), (2, 0, 0, 1), (3, 0, 0, 1), (4, 2, 2 * one, 1), (5, 30_000, 30_000 * one, 1), (6, 1, nbsp, 1)}
    assert T.token_counts(docs([]), scores).count() == 0
