"""Phrase mining by relations of occurrences (SETM), and collocation scores of the phrases.

Words are counted first.  Occurrences of frequent words are written as a relation
(block, at, id), bucketed by block and sorted by place.  Places number the words
of all texts and leave a gap between pieces, so two words are neighbours in one
piece if their places differ by one; ``at`` is a place within its block of 4,096,
and a block has the first places of the next one, too.  A merge join of the relation with itself on
adjacent places gives the occurrences of longer phrases; they are counted by
group, and only those of frequent groups (a semi-join) make the next relation.

Ids are 64-bit hashes that are proved to be different for the words, and for the
frequent phrases, of this corpus; another seed is taken where two are equal.
"""

from __future__ import annotations

import contextlib
import gc
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavepanel.llm.arrowblocks import parts, utf8
from wavepanel.llm.common import checked_broadcast, forget, map_arrow, materialise, shared_dir

LEAST = 100  # occurrences of a phrase
LONGEST = 5  # words
TOP = 2000  # phrases of a language
PART = 2 << 20  # bytes of text that are worked on together
BLOCK = 12  # bits: places of a block
FILTER = 26  # bits: 8 MiB, which words are frequent
ROWS_A_BUCKET = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SEPARATES = _ENDS_PIECE.copy()
_SEPARATES[[0x20, 0x09]] = True


def _segments(data: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Cuts of a text behind separators, at about ``most`` bytes, and whether the piece goes on from the cut before."""
    lo, goes_on = 0, False
    while lo < len(data):
        hi = min(lo + most, len(data))
        if hi < len(data):
            last = np.flatnonzero(_SEPARATES[data[lo:hi]])
            if len(last):
                hi = lo + int(last[-1]) + 1
            else:  # a word longer than that
                rest = np.flatnonzero(_SEPARATES[data[hi:]])
                hi = hi + int(rest[0]) + 1 if len(rest) else len(data)
        yield data[lo:hi], goes_on
        goes_on = not _ENDS_PIECE[data[hi - 1]]
        lo = hi


def runs(batches: Iterator[pa.RecordBatch], most: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray, list[str], bool]]:
    """Texts (lang, text) as bytes in lower case, a line feed between: (bytes, where each text begins, their languages, whether the piece goes on)."""
    for batch in batches:
        for part in parts(batch, 1, most):
            data, starts = utf8(part.column(1))
            langs = ["und" if x is None else x for x in part.column(0).to_pylist()]
            if len(langs) == 1:
                for cut, goes_on in _segments(data, most):
                    yield _LOWER[cut], np.zeros(1, np.int64), langs, goes_on
                continue
            at = starts[:-1] + np.arange(len(langs))
            whole = np.full(len(data) + len(langs), ord("\n"), np.uint8)
            inside = np.ones(len(whole), bool)
            inside[at[1:] - 1] = False
            inside[-1] = False
            whole[inside] = _LOWER[data]
            yield whole, at, langs, False


class Words:
    """The words of a run: which distinct (lang, word) each is, and whether a piece ends before it."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, langs: list[str]):
        apart = _SEPARATES[data]
        turns = np.diff(np.concatenate([[True], apart, [True]]).astype(np.int8))
        first, last = np.flatnonzero(turns == -1), np.flatnonzero(turns == 1)
        ended = np.cumsum(_ENDS_PIECE[data])
        sums = ended[first] if len(first) else np.zeros(0, np.int64)
        self.new_piece = np.diff(sums, prepend=0) > 0  # of the first word: whether separators before it end a piece
        self.ended = bool(len(data)) and int(ended[-1]) > (int(sums[-1]) if len(sums) else 0)  # whether separators behind the last word do
        offsets = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int64)
        text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[~apart])))
        found = text.dictionary_encode()
        names, of = np.unique(np.array(langs, object), return_inverse=True)
        lang = of[np.searchsorted(starts, first, "right") - 1]
        distinct, self.which = np.unique(found.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(names) + lang, return_inverse=True)
        _, at, raw = found.dictionary.buffers()[:3]
        at, raw = np.frombuffer(at, np.int64), b"" if raw is None else raw.to_pybytes()
        self.words = [raw[at[k] : at[k + 1]] for k in (distinct // len(names)).tolist()]
        self.langs = [names[k] for k in (distinct % len(names)).tolist()]

    def ids(self, seed: int) -> np.ndarray:
        """64-bit hash of each distinct (lang, word)."""
        keys = (f"{lang}\n".encode("utf-8", "surrogatepass") + w for lang, w in zip(self.langs, self.words))
        return np.fromiter((xxhash.xxh3_64_intdigest(k, seed) for k in keys), np.uint64, len(self.words))


def _counted(seed: int):
    """Task: distinct words of each run with their numbers."""

    def task(batches):
        for data, starts, langs, _ in runs(batches):
            w = Words(data, starts, langs)
            n = np.bincount(w.which, minlength=len(w.words))
            text = pa.array(w.words, pa.binary())
            text = pa.StringArray.from_buffers(len(text), text.buffers()[1], text.buffers()[2])
            yield pa.RecordBatch.from_arrays([pa.array(w.langs, pa.string()), text, pa.array(w.ids(seed).view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "word", "id", "n"])

    return task


def _occurrences(seed: int, sent):
    """Task: (block, places, ids) of words that may be frequent beside another such; the first places of a block are in the one before too.

    A block's words travel as arrays, half as many bytes as a row each.
    """

    def task(batches):
        often = sent.value
        at, ended = TaskContext.get().partitionId() << 40, True  # a task's places are its own
        for data, starts, langs, goes_on in runs(batches):
            w = Words(data, starts, langs)
            ended |= not goes_on
            if not len(w.which):
                ended |= w.ended
                continue
            ids = w.ids(seed)
            slot = ids >> np.uint64(64 - FILTER)
            kept = (often[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)[w.which]
            gap = w.new_piece.astype(np.int64)
            gap[0] = int(w.new_piece[0] or ended)
            places = at + np.arange(len(gap)) + np.cumsum(gap)
            at, ended = int(places[-1]) + 1, w.ended
            near = np.zeros(len(kept), bool)
            both = kept[1:] & kept[:-1] & ~w.new_piece[1:]
            near[1:] |= both
            near[:-1] |= both
            near[[0, -1]] |= kept[[0, -1]]  # a text that goes on in the next run
            places, found = places[near], ids[w.which[near]].view(np.int64)
            block = places >> BLOCK
            inside = (places & ((1 << BLOCK) - 1)).astype(np.int16)
            edge = inside < LONGEST - 1
            block, inside, found = (np.concatenate(x) for x in ((block, block[edge] - 1), (inside, inside[edge] + np.int16(1 << BLOCK)), (found, found[edge])))
            order = np.lexsort((inside, block))
            blocks, starts = np.unique(block[order], return_index=True)
            offsets = pa.array(np.append(starts, len(order)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (inside, found)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks), *lists], names=["block", "at", "id"])

    return task


def occurrences(docs: DataFrame, seed: int, sent, buckets: int) -> DataFrame:
    """(block, at, id), dealt out by block."""
    blocks = map_arrow(docs.select("lang", "text"), _occurrences(seed, sent), "block long, at array<short>, id array<long>").repartition(buckets, "block")
    return blocks.select("block", F.explode(F.arrays_zip("at", "id")).alias("x")).select("block", F.col("x.at").cast("int").alias("at"), "x.id")


class Relation:
    """A table of occurrences in the shared folder, bucketed by block and sorted by place; places are written as their differences."""

    COMPACT = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#at": "false"}

    def __init__(self, rows: DataFrame, buckets: int):
        self.spark = rows.sparkSession
        self.name = f"llm_occurrences_{uuid.uuid4().hex}"
        self.path = os.path.join(shared_dir(self.spark), self.name)
        rows.write.options(**self.COMPACT).bucketBy(buckets, "block").sortBy("block", "at").option("path", self.path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def _joined_by_buckets(spark: SparkSession):
    """Tables bucketed by some of the join's keys are joined as they lie."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def _pairs(relation: Relation) -> DataFrame:
    """Occurrences of two phrases at adjacent places: (block, at, p, q)."""
    left = relation.read().select("block", "at", F.col("id").alias("p"))
    right = relation.read().select("block", (F.col("at") - 1).alias("at"), F.col("id").alias("q"))
    return left.hint("merge").join(right, ["block", "at"])


def _own() -> Column:
    """Whether an occurrence is one of the block's own, not one that is repeated from the next."""
    return F.col("at") < (1 << BLOCK)


def _release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that have ended: it does so when the driver's JVM finds their plans unused."""
    gc.collect()
    spark._jvm.System.gc()


def _unique(table: DataFrame) -> bool:
    return table.groupBy("id").count().where("count > 1").isEmpty()


def words_of_corpus(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, id, n) of all distinct words, written, and the seed for which no two share an id."""
    for seed in range(64):
        words = map_arrow(docs.select("lang", "text"), _counted(seed), "lang string, word string, id long, n long")
        words = materialise(words.groupBy("lang", "word", "id").agg(F.sum("n").alias("n")), "phrases-words")
        if _unique(words):
            return words, seed
        forget(words)
    raise ValueError("no seed gives different ids")


def _filter(frequent: DataFrame) -> np.ndarray:
    """A bitmap of the leading bits of the ids of frequent words, of 8 MiB for any corpus; it comes to the driver in parts of 4 KiB."""
    slot = F.shiftrightunsigned("id", 64 - FILTER)
    found = frequent.groupBy(F.shiftright(slot, 15).alias("part")).agg(F.bitmap_construct_agg(slot.bitwiseAND(32_767)).alias("bits"))
    bits = np.zeros(1 << FILTER - 3, np.uint8)
    for r in found.collect():
        bits[r["part"] << 12 : r["part"] + 1 << 12] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def frequent_phrases(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """Tables (id, p, q, lang, phrase, n) of the phrases of 1, 2, ... words with at least ``least`` occurrences, and (lang, n) of all words.

    p and q are the ids of a phrase without its last and without its first word.
    """
    spark = docs.sparkSession
    words, seed = words_of_corpus(docs)
    totals = materialise(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-totals")
    none = F.lit(None).cast("long")
    levels = [materialise(words.where(F.col("n") >= least).select("id", none.alias("p"), none.alias("q"), "lang", F.col("word").alias("phrase"), "n"), "phrases-1")]
    forget(words)
    rows = levels[0].agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_BUCKET))
    sent = spark.sparkContext.broadcast(_filter(levels[0]))  # 8 MiB
    relation = Relation(occurrences(docs, seed, sent, buckets), buckets)
    _release(spark)
    with _joined_by_buckets(spark):
        for k in range(2, longest + 1):
            pairs = _pairs(relation)
            groups = materialise(pairs.where(_own()).groupBy("p", "q").agg(F.count("*").alias("n")).where(F.col("n") >= least), f"phrases-groups-{k}")
            for seed in range(64):
                hashed = F.xxhash64("p", "q", F.lit(seed))
                if _unique(groups.select(hashed.alias("id"))):
                    break
            else:
                raise ValueError("no seed gives different ids")
            before = levels[-1]
            first = before.select(F.col("id").alias("p"), "lang", "phrase")
            last = before.select(F.col("id").alias("q"), F.element_at(F.split("phrase", " "), -1).alias("word"))
            named = groups.join(first, "p").join(last, "q").select(hashed.alias("id"), "p", "q", "lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), "n")
            levels.append(materialise(named, f"phrases-{k}"))
            if k < longest:
                kept = groups.select("p", "q")
                small = checked_broadcast(kept)
                following = pairs.join(small, ["p", "q"], "left_semi").select("block", "at", hashed.alias("id"))
                if small is kept:  # too many groups to send: the semi-join has dealt the rows out by phrase
                    following = following.repartition(buckets, "block")
                following = Relation(following, buckets)
                relation.drop()
                relation = following
            forget(groups)
            _release(spark)
    relation.drop()
    return levels, totals


def collocations(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has ``lang`` (null: ``und``) and ``text`` (null: empty).  A candidate
    has 2 to ``longest`` words and a >= ``least`` occurrences, counted over every
    text, repeated rows and overlaps included.  Its score is floor(1000 a n / (l r))
    for the cut in two for which that is least, of equal ones the cut after fewer
    words; n counts the language's words.  A candidate that stands in a longer one
    of as many occurrences is dropped.  Products are decimals of up to 38 digits.

    Long texts go through in blocks of PART bytes and long pieces in blocks of
    4,096 places, so neither bounds a task.  An empty table gives an empty table.
    """
    levels, totals = frequent_phrases(docs, least=least, longest=longest)
    every = levels[0].select("lang", "phrase", "n")
    for level in levels[1:-1]:
        every = every.unionByName(level.select("lang", "phrase", "n"))
    # a phrase in a longer one of as many occurrences stands in one that is longer by a word, too
    candidates = None
    for level, longer in zip(levels[1:], [*levels[2:], None]):
        left = level.select("id", "lang", "phrase", F.col("n").alias("a"))
        if longer is not None:
            inside = longer.select(F.col("p").alias("id"), "n").unionByName(longer.select(F.col("q").alias("id"), "n")).groupBy("id").agg(F.max("n").alias("most"))
            left = left.join(inside, "id", "left").where(F.coalesce("most", F.lit(0)) < F.col("a"))
        left = left.select("lang", "phrase", "a")
        candidates = left if candidates is None else candidates.unionByName(left)
    words = F.split("phrase", " ")
    cuts = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1),
        lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("head"), F.array_join(F.slice(words, k + 1, F.size(words)), " ").alias("tail")),
    )
    cut = candidates.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    cut = cut.join(every.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cut = cut.join(every.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    scored = cut.join(totals, "lang").withColumn(
        "score", F.expr("(1000BD * cast(a as decimal(16, 0)) * cast(n as decimal(16, 0))) div (cast(l as decimal(16, 0)) * cast(r as decimal(16, 0)))")
    )
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("x")
    best = scored.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
