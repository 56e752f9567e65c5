"""Near-duplicate documents: MinHash bands, odd sketches, exact sets.

Each document's set of word shingles gives MinHash samples.  Bands of samples
propose pairs; an odd sketch (the parity of how often the samples hit each of
512 bits) estimates a pair's similarity from the population count of an XOR;
pairs that it doesn't rule out are confirmed on the full sets.

No group is expanded into pairs.  Equal sets are one class.  The classes of a
band bucket are compared with one of them, in a few rounds each with another;
then only those that are still not connected are compared with one another.
The parity bitmap of the full set, whose XOR count is never more than what two
sets differ by, rules out most of the pairs under the threshold without loss.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavepanel.llm.common import checked_broadcast, forget, map_arrow, materialise
from wavepanel.llm.textblocks import grouped, mix64, words_by_text

SAMPLES = 512  # MinHash samples of a document, all folded into its sketch
SKETCH_BITS = 512
BANDS, ROWS = 24, 5  # of the first samples; a pair of similarity 0.85 is missed with a chance of 8e-7
PARITY_BITS = 2048  # of the full set's own bitmap
ROUNDS = 2  # with another leader in each bucket that is not connected
SLACK = 5.0  # standard deviations of the sketch's estimate that a pair may lie under the threshold

_rng = np.random.default_rng(20_177)
_A = (_rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_SPOT = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """Sorted 64-bit hashes of the distinct ``size``-word shingles of each text; with fewer words, of all words as one."""
    for _, run in grouped(texts):
        h, at = words_by_text(run)
        rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for k in range(size):
            rolled = mix64(rolled * np.uint64(3) + h[k : k + len(rolled)])
        for lo, hi in zip(at[:-1], at[1:]):
            if hi - lo >= size:
                yield np.unique(rolled[lo : hi - size + 1])
            elif hi > lo:
                one = np.zeros(1, np.uint64)
                for k in range(lo, hi):
                    one = mix64(one * np.uint64(3) + h[k] + np.uint64(7))
                yield one
            else:
                yield np.zeros(0, np.uint64)


def samples(found: np.ndarray) -> np.ndarray:
    """The smallest value of each of ``SAMPLES`` random permutations of a set."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 512):
        least = np.minimum(least, (x[lo : lo + 512, None] * _A + _B).min(axis=0))
    return least


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parity of the number of samples on each bit, as signed 64-bit words."""
    spots = mix64(least.astype(np.uint64) + _SPOT) % np.uint64(SKETCH_BITS)
    parity = np.bincount(spots.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def parity(found: np.ndarray) -> np.ndarray:
    """Parity bitmap of the full set: two of them differ in no more bits than the sets in members."""
    counts = np.bincount((found % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(counts.astype(np.uint8)).view(np.int64)


def bands(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = mix64(key * np.uint64(3) + rows[:, k])
    return key.view(np.int64)


def most_differing_bits(percent: int) -> int:
    """Greatest XOR count that a pair of at least ``percent`` similarity shows, but for ``SLACK`` deviations."""
    j, k, n = percent / 100, SAMPLES, SKETCH_BITS
    left = math.exp(-4 * k * (1 - j) / n)  # 2k(1 - j) toggles differ
    mean = n / 2 * (1 - left)
    of_samples = 2 * k * left * math.sqrt(j * (1 - j) / k)
    of_sketch = math.sqrt(max(1.0, n / 4 * (1 - left * left)))
    return math.ceil(mean + SLACK * math.hypot(of_samples, of_sketch))


def text_key(text: Column) -> Column:
    """MD5 of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, n_shingles, cid (digest of the set; null if empty), bands, sketch, parity."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n, cid, band, sketch, own = [], [], [], [], []
                for found in shingle_sets(part.column(1).to_pylist(), size):
                    n.append(len(found))
                    if len(found):
                        least = samples(found)
                        cid.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                        band.append(bands(least))
                        sketch.append(odd_sketch(least))
                        own.append(parity(found))
                    else:
                        cid.append(None), band.append(None), sketch.append(None), own.append(None)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(cid, pa.binary()), *(pa.array(x, longs) for x in (band, sketch, own))],
                    names=["doc_id", "text_key", "n_shingles", "cid", "bands", "sketch", "parity"],
                )

    schema = f"doc_id {id_type}, text_key binary, n_shingles long, cid binary, bands array<long>, sketch array<long>, parity array<long>"
    return map_arrow(docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key")), run, schema)


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """cid and its full set (sorted 64-bit hashes, as bytes)."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                found = [x.tobytes() for x in shingle_sets(batch.column(0).slice(lo, 256).to_pylist(), size)]
                cid = [hashlib.blake2b(x, digest_size=16).digest() for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(cid, pa.binary()), pa.array(found, pa.binary())], names=["cid", "members"])

    return map_arrow(docs.select("text"), run, "cid binary, members binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the similarity."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("cid").alias("a"), F.col("members").alias("x")), "a")
    both = left.join(sets.select(F.col("cid").alias("b"), F.col("members").alias("y")), "b")
    return map_arrow(both.select("a", "b", "x", "y"), run, "a binary, b binary")


def _differing(x: Column, y: Column, bits: int) -> Column:
    total = F.lit(0)
    for i in range(bits // 64):
        total = total + F.bit_count(x[i].bitwiseXOR(y[i]))
    return total


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether two classes (structs with n, sketch, parity) can reach the similarity."""
    x, y = F.col(x), F.col(y)
    estimated = _differing(x["sketch"], y["sketch"], SKETCH_BITS) <= most_differing_bits(percent)
    differing = _differing(x["parity"], y["parity"], PARITY_BITS)
    return estimated & ((100 + percent) * differing <= (100 - percent) * (x["n"] + y["n"]))


def components(edges: DataFrame) -> DataFrame:
    """(cid, root): the smallest node of the component of each node in ``edges`` (a, b).

    Alternates the two star operations: every node links its larger, then its
    smaller, neighbours with the smallest.  Few rounds, each written down.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "near-edges")

    def star(e: DataFrame, both_ways: bool) -> DataFrame:
        near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else e
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        if both_ways:  # larger neighbours of u go to its smallest neighbour, or to u itself
            least = least.select("u", F.least("u", "m").alias("m"))
            return near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        linked = e.join(least, "u")
        return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()

    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    was = now.agg(F.count("*"), mark).first()
    while was[0]:
        then = materialise(star(star(now, True), False), "near-stars")
        forget(now)
        now, seen = then, then.agg(F.count("*"), mark).first()
        if seen == was:
            break
        was = seen
    return now.select(F.col("u").alias("cid"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("cid"), F.col("v").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document's set is its
    distinct ``size``-word shingles, or all its words as one if they are fewer.
    Documents are linked when 100 * intersection >= ``percent`` * union, and
    component_id is the smallest doc_id that can be reached.

    Null and empty texts have no shingles, are linked with nothing and are kept.
    Rows with equal sets (repeated rows too) are one class.  Rows without a
    doc_id take part in linking but can't name a component: one whose component
    has no doc_id at all has a null component_id, and is kept.  An empty table
    gives an empty table.
    """
    return judged(docs, size=size, percent=percent).select("doc_id", "n_shingles", "component_id", "kept")


def judged(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """``near_duplicates`` with text_key, which with doc_id tells the judged rows apart, and root.

    root is the same for all rows of one component, those without a doc_id
    too, and null where a text has no shingles.
    """
    sig = materialise(signatures(docs, size), "near-signatures")
    known = sig.where("cid is not null")
    one = F.min_by(F.struct("doc_id", "bands", F.struct(F.col("n_shingles").alias("n"), "sketch", "parity").alias("of")), F.struct(F.col("doc_id").isNull(), F.col("doc_id")))
    classes = materialise(known.groupBy("cid").agg(one.alias("x")).select("cid", "x.*"), "near-classes")
    rows = classes.select("cid", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("cid").alias("first"), F.max("cid").alias("last")).where("first != last").select("band")
    shared = materialise(shared, "near-buckets")
    met = materialise(rows.join(shared, "band"), "near-met")  # (band, cid) in buckets of several classes
    of = classes.select("cid", "of")

    # the full sets of those classes, from one more pass over the texts
    ids = checked_broadcast(classes.join(met.select("cid").distinct(), "cid", "left_semi").select(F.col("doc_id").alias("_doc")).distinct())
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    sets = materialise(full_sets(texts, size).groupBy("cid").agg(F.first("members").alias("members")), "near-sets")

    def checked(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, b), each judged on the full sets."""
        pairs = materialise(pairs.distinct(), "near-pairs")
        named = checked_broadcast(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
        links = materialise(confirm(pairs, sets.join(named, "cid", "left_semi"), percent), "near-links")
        forget(pairs)
        return links

    roots = materialise(classes.select("cid", F.col("cid").alias("root")).limit(0), "near-roots")
    for turn in range(ROUNDS + 1):
        # buckets whose classes are not all connected: their members, each with its component
        labelled = met.withColumn("root", F.col("cid"))
        if turn:  # before the first round no class is connected
            labelled = met.join(roots, "cid", "left").select("band", "cid", F.coalesce("root", "cid").alias("root"))
            open_ = labelled.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("band")
            labelled = labelled.join(open_, "band", "left_semi")
        rest = materialise(labelled.join(of, "cid").select("band", "cid", "root", "of"), "near-rest")
        if rest.isEmpty():
            break
        a = rest.select("band", F.col("cid").alias("a"), F.col("root").alias("ra"), F.col("of").alias("x"))
        b = rest.select("band", F.col("cid").alias("b"), F.col("root").alias("rb"), F.col("of").alias("y"))
        apart = (F.col("ra") != F.col("rb")) & _may_link("x", "y", percent)
        if turn < ROUNDS:  # one class of each bucket, another in each round, with the rest
            leader = F.min_by(F.struct("a", "ra", "x"), F.xxhash64("a", F.lit(turn)))
            a = materialise(a.groupBy("band").agg(leader.alias("l")).select("band", "l.*"), "near-leaders")
            pairs = a.join(b, "band").where(apart)
        else:
            pairs = a.join(b, "band").where((F.col("a") < F.col("b")) & apart)
        found = checked(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        if found.isEmpty():
            continue
        # links between components, and what they make of the classes met so far
        ends = found.join(roots.select(F.col("cid").alias("a"), F.col("root").alias("ra")), "a", "left")
        ends = ends.join(roots.select(F.col("cid").alias("b"), F.col("root").alias("rb")), "b", "left")
        joined = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
        renamed = roots.join(joined.select(F.col("cid").alias("root"), F.col("root").alias("r")), "root", "left").select("cid", F.coalesce("r", "root").alias("root"))
        roots = materialise(renamed.unionByName(joined.join(roots, "cid", "left_anti")), "near-roots")
        forget(rest)
    linked = classes.select("cid", "doc_id").join(roots, "cid", "left")
    best = linked.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component_id = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    named = linked.join(best, "root", "left").select("cid", F.coalesce("root", "cid").alias("root"), component_id)
    named = materialise(named, "near-named")
    forget(shared, met, classes, sets)
    # read from files on both sides, so that AQE can split the partition of a large class
    out = sig.select("doc_id", "text_key", "n_shingles", "cid").join(named, "cid", "left")
    component_id = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    out = out.select("doc_id", "text_key", "n_shingles", component_id, "root")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
