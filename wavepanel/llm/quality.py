"""Quality rules: counted text statistics and a hashed n-gram log-likelihood ratio.

A trusted set of documents gives one multinomial over hashed n-grams, the whole
corpus another.  A document's score is the mean, over its n-grams, of the log of
the ratio of the two.  Every document is judged by the same fixed threshold.
DataFrame expressions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavepanel.llm.common import checked_broadcast, let, packed, unpacked, words_of

BUCKETS = 10_000  # of hashed words and word pairs
MIN_SCORE = -0.04  # nats for each n-gram: documents below are likelier as raw text than as trusted text by 4 % at each n-gram
PRIOR = 1.0  # weight of the corpus shares in the trusted shares, in trusted n-grams for each trusted n-gram
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5  # words


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _at(array: Column, i: Column) -> Column:
    return F.get(array, i)


def features(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of a document's words and of its pairs of adjacent words."""

    def of(h):
        words = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
        pairs = F.transform(
            F.sequence(F.lit(0), F.size(h) - 2),
            lambda i: F.pmod(F.xxhash64(_at(h, i), _at(h, i + 1)), F.lit(buckets)).cast("int"),
        )
        return F.when(F.size(h) < 2, words).otherwise(F.concat(words, pairs))

    return let(hashes, of)


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found at least twice, the first one included.

    Windows are compared by a 64-bit hash.  Only a text with equal windows pays
    for the sort that finds which ones they are.
    """

    def covered(ws):
        ordered = F.sort_array(F.transform(ws, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(s):
            twice = F.transform(
                s,
                lambda x, j: F.when((_at(s, j - 1)["h"] == x["h"]) | (_at(s, j + 1)["h"] == x["h"]), x["i"]),
            )
            return F.sort_array(F.filter(twice, lambda i: i.isNotNull()))

        def total(p):
            reach = F.transform(p, lambda v, j: F.least(F.lit(window), F.coalesce(_at(p, j + 1) - v, F.lit(window))))
            return F.aggregate(reach, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return let(let(ordered, marked), total)

    def of(h):
        windows = F.transform(
            F.sequence(F.lit(0), F.size(h) - window),
            lambda i: F.xxhash64(*[_at(h, i + k) for k in range(window)]),
        )
        counted = let(
            windows,
            lambda ws: F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0).cast("long")).otherwise(covered(ws)),
        )
        return F.when(F.size(h) <= window, F.lit(0).cast("long")).otherwise(counted)

    return let(hashes, of)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> list[float]:
    """log(trusted share / corpus share) of every bucket.

    The trusted share is smoothed towards the corpus share: to ``nt`` trusted
    n-grams come ``prior * nt`` spread as the corpus is.  An n-gram that no
    trusted text has thus weighs log(prior / (1 + prior)) at any size, and a
    table written several times over gives the same ratios.

    ``trusted`` has a ``doc_id`` for each trusted document.  Counted over every
    document in one pass; each task sums its own buckets before the shuffle.
    The result is one number for each bucket, whatever the size of the corpus.
    """
    ids = checked_broadcast(trusted.select(F.col("doc_id").alias("_trusted")).where("_trusted is not null").distinct())
    seen = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_trusted"), "left")
    counts = (
        seen.select(F.col("_trusted").isNotNull().cast("long").alias("t"), F.explode(features(word_hashes(F.col("text")), buckets)).alias("b"))
        .groupBy("b")
        .agg(F.sum("t").alias("t"), F.count("*").alias("n"))
        .collect()  # one row for each bucket at most
    )
    target, raw = [0] * buckets, [0] * buckets
    for r in counts:
        target[r["b"]] += r["t"]
        raw[r["b"]] += r["n"]
    nt, nr = sum(target), sum(raw)
    if not nt:  # nothing trusted, nothing to compare with
        return [0.0] * buckets
    return [math.log((t / nt * (nr / r) + prior) / (1 + prior)) if r else 0.0 for t, r in zip(target, raw)]


def quality_rules(docs: DataFrame, trusted: DataFrame, *, buckets: int = BUCKETS, min_score: float = MIN_SCORE) -> DataFrame:
    """Add to each row of ``docs`` its statistics, score and verdict.

    Columns added: ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words`` (long), ``base_failed`` (boolean), ``lm_score`` (double: the
    length-normalised log-likelihood ratio, 0 for a text without words) and
    ``kept``.  Columns of ``docs`` with these names are replaced.

    A null text counts as an empty one: no words, so ``base_failed``.  Repeated
    rows are judged each.  Without trusted rows every ratio is 1, and only the
    base rules decide.  An empty table gives an empty table.
    """
    ratios = F.split(F.lit(",".join(map(repr, log_ratios(docs, trusted, buckets)))), ",").cast("array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))

    def measured(w):
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            F.transform(w, lambda x: F.xxhash64(x)).alias("h"),
        )

    def judged(m):
        h = m["h"]
        score = let(
            features(h, buckets),
            lambda f: F.aggregate(f, F.lit(0.0), lambda acc, b: acc + F.get(ratios, b)) / F.greatest(F.size(f), F.lit(1)),
        )
        return F.struct(
            m["n_words"].alias("n_words"),
            m["word_chars"].alias("word_chars"),
            m["n_symbols"].alias("n_symbols"),
            m["n_dup_lines"].alias("n_dup_lines"),
            repeated_words(h).alias("n_repeat_words"),
            score.alias("lm_score"),
        )

    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lm_score", "base_failed", "kept"]
    rows = packed(docs, added, "text").withColumn("_q", let(let(words_of(F.col("text")), measured), judged))
    rows = unpacked(rows, "_q.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("lm_score") >= min_score))
