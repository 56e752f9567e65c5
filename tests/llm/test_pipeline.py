"""The pipeline against a chain of the plain versions, and its stages alone."""

import collections

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_line_dedup, test_mixing, test_near_dedup, test_quality
from wavepanel.llm import quality

SF = "/root/testdata/sf0.001"


def test_run_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] == 1 and r["toxic"] == 0}
    rows = {r["doc_id"]: (r["text"], r["source"]) for r in docs}
    judged = test_quality.plain([(i, t) for i, (t, _) in rows.items()], good, quality.BUCKETS, quality.MIN_SCORE)
    rows = {r[0]: rows[r[0]] for r in judged if r[7]}
    cut = test_line_dedup.plain([(i, t) for i, (t, _) in rows.items()])
    rows = {r[0]: (r[4], rows[r[0]][1]) for r in cut}
    near = test_near_dedup.plain([(i, t) for i, (t, _) in rows.items()], 5, 80)
    rows = {r[0]: rows[r[0]] for r in near if r[3]}
    mixed = test_mixing.plain([(i, t, s) for i, (t, s) in rows.items()])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, s, *_ in mixed:
        ids = tokenizer.encode(rows[i][0], add_special_tokens=False).ids
        want[i, s, len(ids), tokenizer.decode(ids, skip_special_tokens=False)] += 1
    got = collections.Counter((r["doc_id"], r["source"], r["n_tokens"], r["decoded"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and 0 < len(got) < len(docs)


def test_stages_keep_the_columns_and_bear_odd_rows(spark, tmp_path):
    line = "a clean line of words that says something about nothing at all "
    rows = [(1, line, "en", "s", 5), (1, line, "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0), (None, line + "and more of it here", "en", None, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("x")).withColumn("_k", F.lit(1))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for source in (table, table.limit(0)):
        docs = source
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "bpe":
                assert out.columns == table.columns, name
            if name == "quality_rules" and source is table:
                assert out.where("doc_id = 1").count() == 2
            docs = out
        assert docs.count() <= 4 * len(rows) * (source is table)
    kept = corpus_pipeline.near_duplicates(spark, table, str(tmp_path))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3]


def test_near_duplicates_drops_the_rows_judged(docs, spark):
    words = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    rows = [(3, words("a")), (None, words("a") + " end"), (None, words("b")), (None, words("c"))]  # null ids: a near copy, two unique texts
    rows += [(4, words("d")), (9, words("d") + " end"), (9, words("e"))]  # a near copy's doc_id, with a unique text
    rows += [(5, words("f")), (5, words("f") + " end"), (6, words("f") + " of it")]  # near copies under one doc_id
    rows += [(None, words("g")), (None, words("g") + " end")]  # near copies without a doc_id
    rows += [(7, words("h")), (7, words("h")), (None, ""), (None, ""), (None, None)]
    got = collections.Counter((r["doc_id"], (r["text"] or "-").split(" ")[0]) for r in corpus_pipeline.near_duplicates(spark, docs(rows), "").collect())
    want = [(3, "a0"), (None, "b0"), (None, "c0"), (4, "d0"), (9, "e0"), (5, "f0"), (None, "g0"), (7, "h0"), (None, "-"), (None, "-")]
    assert got == collections.Counter((i, w or "-") for i, w in want)


def test_near_duplicates_of_one_id_and_text_differ_elsewhere(spark):
    text = " ".join(f"w{i}" for i in range(60))
    t = spark.createDataFrame([(1, text, "en", "y", 1), (1, text, "en", "x", 1), (None, text, "de", "x", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [(r["doc_id"], r["source"]) for r in corpus_pipeline.near_duplicates(spark, t, "").collect()] == [(1, "x")]
