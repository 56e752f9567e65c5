"""Phrase mining against counting all runs of words in Python."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavepanel.llm import phrases as P

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest=5, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    inner = collections.defaultdict(int)
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inner[lang, w[i : i + k]] = max(inner[lang, w[i : i + k]], a)
    out = collections.defaultdict(list)
    for (lang, w), a in found.items():
        if inner[lang, w] >= a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, i + 1, phrase.decode(), -a, l, r, n[lang], -s) for lang, xs in out.items() for i, (s, a, phrase, l, r) in enumerate(sorted(xs)[:top])
    )


def check(spark, rows, **how):
    t = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = sorted(tuple(r) for r in P.collocations(t, **how).collect())
    assert got == plain(rows, **how)
    return got


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    vocabulary = [f"{c}{d}" for c in "abé" for d in "xyz日"]
    rows = []
    for i in range(150):
        words = [rng.choice(vocabulary[: rng.choice((3, 12))]) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " ; "]) for w in words)
        if i % 3 == 0:
            text += " One Fixed phrase of five words here!" * 2
        rows.append((rng.choice(["en", "en", "de", None]), text))
    return rows


def test_against_plain_version(spark, texts):
    got = check(spark, texts, least=5)
    assert max(len(r[2].split(" ")) for r in got) == 5 and {r[0] for r in got} == {"en", "de", "und"}
    check(spark, texts, least=5, top=3)
    check(spark, texts, least=2, longest=3)


def test_blocks_runs_and_seeds_change_nothing(spark, texts, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 3)  # phrases across the ends of blocks
    check(spark, texts, least=5)
    data = " ".join(t for _, t in texts).encode()
    batch = P.pa.RecordBatch.from_arrays([P.pa.array(["en", "de"]), P.pa.array([data.decode(), "x y. z"])], names=["lang", "text"])
    whole = list(P.runs(iter([batch])))
    cut = list(P.runs(iter([batch]), 97))
    assert len(whole) == 1 and len(cut) > 20
    words = lambda rs: [(w.langs[k], w.words[k]) for r in rs for w in [P.Words(*r[:3])] for k in w.which]
    assert words(whole) == words(cut)


def test_places_of_cut_texts(monkeypatch):
    """Adjacent places are those of neighbours in one piece, wherever a text is cut."""
    monkeypatch.setattr(P.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 2})()))
    text = "a b  c.d e\tf ,, g    h " * 40 + " " * 200 + "i j" + " , " * 70 + "k " + " " * 150 + "l"
    batch = P.pa.RecordBatch.from_arrays([P.pa.array(["en"]), P.pa.array([text])], names=["lang", "text"])
    sent = type("B", (), {"value": np.full(1 << P.FILTER - 3, 255, np.uint8)})()
    pairs = collections.Counter(p for piece in re.split(r"[.,]", text) for w in [piece.split()] for p in zip(w, w[1:]))
    names = {x: w for x, w in zip((P.xxhash.xxh3_64_intdigest(b"en\n" + c.encode(), 0) for c in "abcdefghijkl"), "abcdefghijkl")}
    for most in (1 << 20, 64, 17):
        runs = P.runs
        with monkeypatch.context() as m:
            m.setattr(P, "runs", lambda batches, most=most: runs(batches, most))
            rows = [dict(block=r["block"], at=a, id=i) for b in P._occurrences(0, sent)(iter([batch])) for r in b.to_pylist() for a, i in zip(r["at"], r["id"])]
        at = {(r["block"] << P.BLOCK) + r["at"]: names[r["id"] % (1 << 64)] for r in rows if r["at"] < 1 << P.BLOCK}
        assert collections.Counter((w, at[k + 1]) for k, w in at.items() if k + 1 in at) == pairs, most


def test_edges(spark, docs):
    rows = [("en", None), (None, None), (None, ""), ("en", "a b a b a b"), ("en", "a b a b a b"), ("de", " \t\n"), ("fr", "x y"), ("en", "aa " * 5000), (None, "q " * 9)]
    got = check(spark, rows, least=3)
    assert ("en", "aa aa aa aa aa") in {(r[0], r[2]) for r in got}
    assert P.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    t = docs([(1, "a b " * 9)]).withColumn("n", F.lit(1)).withColumn("id", F.lit(1)).withColumn("phrase", F.lit("x"))
    assert P.collocations(t, least=2).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_products_beyond_64_bits(spark):
    row = spark.sql("SELECT (1000BD * cast(9000000000000000 as decimal(16, 0)) * cast(9999999999999999 as decimal(16, 0))) div (cast(9000000000000001 as decimal(16, 0)) * cast(70001 as decimal(16, 0))) AS s").first()
    assert row["s"] == 1000 * 9000000000000000 * 9999999999999999 // (9000000000000001 * 70001)


def test_joins_use_the_buckets(spark, texts):
    t = spark.createDataFrame(texts, "lang string, text string")
    words, seed = P.words_of_corpus(t)
    sent = spark.sparkContext.broadcast(np.full(1 << P.FILTER - 3, 255, np.uint8))
    relation = P.Relation(P.occurrences(t, seed, sent, 4), 4)
    with P._joined_by_buckets(spark):
        plan = P._pairs(relation)._jdf.queryExecution().executedPlan().toString()
    relation.drop()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
