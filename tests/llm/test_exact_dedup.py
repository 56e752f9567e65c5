"""Exact dedup: one batch, several batches, edges."""

import hashlib
import re
import uuid

import pytest

from wavepanel.llm.exact_dedup import DigestIndex, exact_dedup


@pytest.fixture()
def index(spark):
    i = DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=4)
    yield i
    i.drop()


def judged(docs, index, rows):
    return sorted((tuple(r)[:4] for r in exact_dedup(docs(rows), index).collect()), key=repr)


def test_longest_then_smallest_stays(docs, index):
    rows = [(3, "a b"), (1, "ab"), (2, "a b"), (4, "a  b"), (5, None), (6, ""), (7, " \n"), (8, "é"), (9, "e"), (None, "n"), (10, "n"), (11, "x" * 100_000)]
    got = judged(docs, index, rows)
    want = [(3, 4, 4, False), (1, 4, 4, False), (2, 4, 4, False), (4, 4, 4, True), (5, 7, 3, False), (6, 7, 3, False), (7, 7, 3, True)]
    want += [(8, 8, 1, True), (9, 9, 1, True), (None, 10, 2, False), (10, 10, 2, True), (11, 11, 1, True)]
    assert got == sorted(want, key=repr)
    assert index.read().count() == 6


def test_second_batch_meets_the_index(docs, index):
    assert judged(docs, index, [(10, "one"), (11, "two")]) == [(10, 10, 1, True), (11, 11, 1, True)]
    # shorter or longer, the text of the first batch stays
    assert judged(docs, index, [(1, "o n e"), (2, "three"), (2, "three")]) == [(1, 10, 1, False), (2, 2, 2, True), (2, 2, 2, True)]
    assert judged(docs, index, []) == []
    assert index.read().count() == 3
    plan = index.read().hint("merge").join(index.read().hint("merge"), "digest")._jdf.queryExecution().toString()
    assert "Exchange" not in plan  # bucketed: a join by digest doesn't shuffle the index


def test_clashing_columns(docs, index):
    from pyspark.sql import functions as F

    t = docs([(1, "a")]).withColumn("digest", F.lit(1)).withColumn("n", F.lit(2)).withColumn("keep_id", F.lit(3))
    assert exact_dedup(t, index).first()["keep_id"] == 1


def plain(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i is None, i or 0, i))
    return sorted(((i, min(groups[k])[3], len(groups[k])) for i, text in rows for k in [re.sub(r"[\x20\x09-\x0D]", "", text or "")]), key=repr)


def test_batches_settled_are_one_batch(docs, index, sample):
    rows = [*sample, *[(i + 5000, f" {t}\n" if i % 2 else t) for i, t in sample[::3]], (None, sample[0][1]), (None, None)]
    for k in range(3):
        exact_dedup(docs([r for j, r in enumerate(rows) if j % 3 == k]), index)
    settled = {bytes(r["digest"]).hex(): (r["keep_id"], r["group_size"]) for r in index.settled().collect()}
    sha = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
    assert sorted(((i, *settled[sha(t)]) for i, t in rows), key=repr) == plain(rows)
    assert index.read().count() == len(settled) and index.spark.table(index.met).count() > 0


def test_the_query_goes_through_its_index(spark, tmp_path):
    from wavepanel.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {t.name for t in spark.catalog.listTables()}
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in queries.op3_exact_dedup(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert got == plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {t.name for t in spark.catalog.listTables()} == before  # and its tables are gone
