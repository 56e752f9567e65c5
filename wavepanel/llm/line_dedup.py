"""Line dedup: repeated chunks of lines, cut where the content says so.

A rolling hash over the hashes of two lines stands at each line; a chunk ends
where it is less than at the lines before and behind.  So an inserted or deleted
line moves the boundaries near it only, two boundaries are never adjacent, and no
chunk of a text of two lines or more is a single line.  A chunk that occurs more
than once in the corpus, compared byte by byte, is removed but for its first
place.  DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavepanel.llm.common import checked_broadcast, forget, let, materialise, packed, unpacked

MULTIPLIER = 65_599  # of the rolling hash, modulo 2^32


def line_hash(line: Column) -> Column:
    """First 32 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunk_starts(lines: Column) -> Column:
    """Index of the first line of each chunk of an array of lines."""

    def of(h):
        rolled = F.transform(h, lambda x, i: (F.coalesce(F.get(h, i - 1), F.lit(0)) * MULTIPLIER + x) % (1 << 32))

        def least(r):
            low = F.filter(F.sequence(F.lit(1), F.size(r) - 3), lambda i: (F.get(r, i) < F.get(r, i - 1)) & (F.get(r, i) < F.get(r, i + 1)))
            return F.concat(F.array(F.lit(0)), F.transform(low, lambda i: i + 1))

        return F.when(F.size(h) < 4, F.array(F.lit(0))).otherwise(let(rolled, least))

    return let(F.transform(lines, line_hash), of)


def chunks(lines: Column) -> Column:
    """(index, number of lines, text) of each chunk."""

    def of(ls):
        def cut(s):
            def chunk(a, k):
                n = F.coalesce(F.get(s, k + 1), F.size(ls)) - a
                return F.struct(
                    k.cast("long").alias("k"), n.cast("long").alias("n"), F.array_join(F.slice(ls, a + 1, n), "\n").alias("text")
                )

            return F.transform(s, chunk)

        return let(chunk_starts(ls), cut)

    return let(lines, of)


def line_dedup(docs: DataFrame) -> DataFrame:
    """Remove repeated multi-line chunks from each text.

    Returns the columns of ``docs`` with ``text`` replaced, and ``n_lines``,
    ``n_removed_lines``, ``n_removed_chunks`` (long); columns of ``docs`` with
    these names are replaced.  The first place of a chunk is the one with the
    smallest doc_id (null before any), then hash of the text, then position.

    A null text stays null and counts as one empty line; a text whose lines all
    go becomes empty, its row stays.  Rows with one doc_id and one text are one
    document: none of them is a repeat of another.  A long text is one row's
    array of lines, linear in its bytes.  An empty table gives an empty table.
    """
    rows = packed(docs, ["n_lines", "n_removed_lines", "n_removed_chunks"], "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = rows.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("_th", F.xxhash64(text))
    ref = F.struct(F.col("doc_id"), F.col("_th"), F.col("c.k").alias("k"))
    cut = (
        keyed.select("doc_id", "_id", "_th", F.explode(chunks(F.split(text, "\n"))).alias("c"))
        .where("c.n > 1")
        .select("doc_id", "_id", "_th", "c", F.xxhash64("c.text").alias("h"), ref.alias("ref"))
    )
    # hashes met in two places; each task has summed its own before the shuffle
    seen = cut.groupBy("h").agg(F.min("ref").alias("lo"), F.max("ref").alias("hi")).where("lo != hi").select("h")
    seen = materialise(seen, "lines-hashes")
    # the text of those chunks only; equal bytes decide, not the hash
    maybe = materialise(cut.join(checked_broadcast(seen), "h", "left_semi").select("h", "_id", "_th", "ref", "c.k", "c.n", "c.text"), "lines-maybe")
    first = maybe.groupBy("h", "text").agg(F.min("ref").alias("first"), F.max("ref").alias("last")).where("first != last")
    first = materialise(first.select("h", "text", "first"), "lines-first")
    gone = (
        maybe.join(first.hint("merge"), ["h", "text"])
        .where("ref != first")
        .select("_id", "_th", "k", "n")
        .distinct()
        .groupBy("_id", "_th")
        .agg(F.collect_set("k").alias("ks"))
    )
    gone = materialise(gone, "lines-gone")
    forget(seen, maybe, first)

    def kept(cs, ks):
        def of(stay):
            kept_lines = F.aggregate(stay, F.lit(0).cast("long"), lambda a, k: a + F.get(cs, k)["n"])
            return F.struct(
                (F.aggregate(cs, F.lit(0).cast("long"), lambda a, c: a + c["n"]) - kept_lines).alias("n_removed_lines"),
                F.size(ks).cast("long").alias("n_removed_chunks"),
                F.array_join(F.transform(stay, lambda k: F.get(cs, k)["text"]), "\n").alias("text"),
            )

        every = F.sequence(F.lit(0).cast("long"), F.size(cs).cast("long") - 1)
        return let(F.transform(F.array_except(every, ks), lambda k: k.cast("int")), of)

    joined = keyed.join(gone.hint("merge"), ["_id", "_th"], "left").withColumn(
        "_gone",
        F.when(
            F.col("ks").isNotNull(),
            let(F.struct(chunks(F.split(text, "\n")).alias("cs"), F.col("ks").alias("ks")), lambda x: kept(x["cs"], x["ks"])),
        ),
    )
    new_text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.col("_gone.text"))
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return unpacked(
        joined.withColumn("_text", new_text),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce("_gone.n_removed_lines", F.lit(0)).cast("long").alias("n_removed_lines"),
        F.coalesce("_gone.n_removed_chunks", F.lit(0)).cast("long").alias("n_removed_chunks"),
        text=F.col("_text"),
    )
