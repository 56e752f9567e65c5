"""Fill-in-middle against a plain version over code points, and exact round trips."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavepanel.llm import arrowblocks
from wavepanel.llm import fill_middle as M

COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def plain(doc_id, text):
    text = text or ""
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < 20
    return (doc_id, n, "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")


def check(docs, rows):
    made = M.restore(M.fill_middle(docs(rows)))
    got = sorted((tuple(r) for r in made.select(*COLUMNS, "restored").collect()), key=repr)
    assert got == sorted([(*plain(*r), r[1] or "") for r in rows], key=repr)
    return got


def test_index_against_python_strings():
    rng = random.Random(3)
    for alphabet in ("ab", "aé", "a日🙂é́", "🙂"):
        for _ in range(50):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            data = text.encode()
            index = M.ExceptionIndex(np.frombuffer(data, np.uint8))
            assert len(index) == sum(ord(c) > 127 for c in text)
            at = [len(text[:k].encode()) for k in range(len(text) + 1)]
            assert index.to_bytes(np.arange(len(text) + 1)).tolist() == at
            assert index.to_points(np.array(at)).tolist() == list(range(len(text) + 1))


def test_sample_and_all_forms(docs, sample):
    got = check(docs, sample)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_edges(docs, monkeypatch):
    rng = random.Random(4)
    odd = ["<", "P>", "<S", ">", "<M", "é", "🙂", "a", "\n", "\u0000", " "]
    rows = [(i, "".join(rng.choice(odd) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "a<P>b"), (1003, "a"), (1003, "a"), (None, "null id é"), (None, "null id é"), (-7, "é" * 9), (1004, "日本語 word " * 30_000)]
    got = check(docs, rows)
    assert len(got) == len(rows)
    monkeypatch.setattr(arrowblocks, "PART", 64)  # of several parts
    check(docs, rows[:60])


def test_empty_tables_and_clashing_columns(docs):
    assert M.restore(M.fill_middle(docs([]))).count() == 0
    t = docs([(1, "some text")]).withColumn("N", F.lit("x")).withColumn("output", F.lit(1)).withColumn("restored", F.lit(1)).withColumn("a b", F.lit(5))
    row = M.restore(M.fill_middle(t)).first()
    assert row["n"] == 9 and row["restored"] == "some text" and row["a b"] == 5
    nothing = t.select(F.lit(None).cast("string").alias("output"), F.lit("psm").alias("form"))
    assert M.restore(nothing).first()["restored"] is None


def test_wrong_markers(docs, spark):
    with pytest.raises(ValueError):
        M.fill_middle(docs([]), markers=("aba", "cc", "d"))
    with pytest.raises(Exception, match="do not fit"):
        M.restore(spark.createDataFrame([("<P>a<M>b", "psm")], "output string, form string")).collect()
