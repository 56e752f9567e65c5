"""Quality rules against a plain version in Python."""

import collections
import math
import re

import xxhash

from wavepanel.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def xx(data: bytes, seed: int) -> int:
    h = xxhash.xxh64_intdigest(data, seed=seed)
    return h - (1 << 64) if h >= 1 << 63 else h


def grams(text, buckets):
    h = [xx(w.encode(), 42) for w in WORD.findall(text or "")]
    pairs = [xx(b.to_bytes(8, "little", signed=True), xx(a.to_bytes(8, "little", signed=True), 42) & (1 << 64) - 1) for a, b in zip(h, h[1:])]
    return [x % buckets for x in h + pairs]


def plain(rows, trusted, buckets, least):
    t, n = [0] * buckets, [0] * buckets
    for i, text in rows:
        for g in grams(text, buckets):
            n[g] += 1
            t[g] += i in trusted
    # the trusted share, smoothed with as many n-grams again that are spread as the corpus is, over the corpus share
    share = [b / sum(n) for b in n] if sum(n) else n
    ratio = [math.log((a + sum(t) * p) / (2 * sum(t)) / p) if p and sum(t) else 0.0 for a, p in zip(t, share)]
    out = []
    for i, text in rows:
        text = text or ""
        w = WORD.findall(text)
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        g = grams(text, buckets)
        score = sum(ratio[x] for x in g) / max(1, len(g))
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed, not failed and score >= least, score))
    return out


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lm_score"]


def check(spark, docs, rows, trusted):
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    got = sorted(tuple(r) for r in quality.quality_rules(docs(rows), ids, buckets=500).select(COLUMNS).collect())
    want = sorted(plain(rows, set(trusted), 500, quality.MIN_SCORE))
    assert [r[:-1] for r in got] == [r[:-1] for r in want]
    assert all(abs(a[-1] - b[-1]) < 1e-9 for a, b in zip(got, want))
    return got


def test_against_plain_version(spark, docs, sample):
    got = check(spark, docs, sample, [i for i, _ in sample if i % 3])
    assert {r[7] for r in got} == {True, False}


def test_edges(spark, docs):
    line = "one two three four five six seven eight nine ten"
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, line), (4, line), (5, line + "\n" + line), (6, "a b c d e f a b c d e"), (7, "é " * 12), (8, "#" * 50), (9, "w%d " % 1 * 3000 + "end"), (10, " ".join(f"w{i}" for i in range(5000)))]
    got = check(spark, docs, rows, [4, 10])
    assert [r[0] for r in got].count(4) == 2
    assert not any(r[7] for r in got if r[0] in (1, 2, 3, 5, 8, 9))


def test_no_trusted_rows_and_clashing_columns(spark, docs):
    from pyspark.sql import functions as F

    text = " ".join("abcdefghijkl")
    table = docs([(1, text)]).withColumn("kept", F.lit("x")).withColumn("N_Words", F.lit(0)).withColumn("h", F.lit(1)).withColumn("a b", F.lit(2))
    none = spark.createDataFrame([], "doc_id long")
    row = quality.quality_rules(table, none).first()
    assert row["kept"] is True and row["n_words"] == 12 and row["h"] == 1 and row["a b"] == 2
    assert quality.quality_rules(docs([]), none).count() == 0


def test_no_python_in_the_plan(spark, docs):
    plan = quality.quality_rules(docs([(1, "a b")]), spark.createDataFrame([(1,)], "doc_id long"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_verdicts_do_not_follow_the_size_of_the_table(spark, docs, sample):
    ids = spark.createDataFrame([(i,) for i, _ in sample if i % 3], "doc_id long")
    verdicts = lambda rows: {(r["doc_id"], r["kept"], round(r["lm_score"], 9)) for r in quality.quality_rules(docs(rows), ids).collect()}
    assert verdicts(sample) == verdicts(sample * 4)
    # one trusted document, alone or beside one other
    line = "a clean line of words that says something about nothing at all"
    one = spark.createDataFrame([(1,)], "doc_id long")
    for rows in ([(1, line)], [(1, line), (2, line + " and more of it here")], [(1, line)] * 3 + [(2, "quite other words " * 3)]):
        assert all(r["kept"] for r in quality.quality_rules(docs(rows), one).where("doc_id = 1").collect())


def test_held_out_labels(spark):
    """Trusted rows are those of four folds; the labels of the fifth tell how the fixed threshold does."""
    from pyspark.sql import functions as F

    at = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    judged = quality.quality_rules(spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text"), labels.where("quality = 1 and toxic = 0").where(~out).select("doc_id"))
    rows = judged.where("not base_failed").join(labels.where(out), "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()
    rate = {r["quality"]: r["kept"] / r["n"] for r in rows}
    assert rate[1] >= 0.95 and rate[0] <= 0.5, rate
