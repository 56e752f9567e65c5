"""Exact dedup against a persistent index of digests.

The index is a table bucketed and sorted by digest.  New data are reduced to one
row for each digest, compared with the index by a sort-merge anti-join that
shuffles the new side only, and appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavepanel.llm.common import WHITE_SPACE, materialise

BUCKETS = 16  # of the index; about one for each 128 MB that the index shall have


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE + "+", "")


class DigestIndex:
    """One row (digest, keep_id, n, group_size) for each text, as its first batch had it; and one for each later batch that met it.

    ``path`` is the folder of the tables, where the warehouse is not to hold
    them.  Each batch adds a file to each bucket: rewrite the tables (read, write
    under another name, drop) after some hundred batches.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = BUCKETS, path: str | None = None):
        self.spark, self.table, self.met, self.buckets, self.path = spark, table, f"{table}_met", buckets, path

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def _add(self, rows: DataFrame, table: str) -> None:
        writer = rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append")
        if self.path:
            writer = writer.option("path", f"{self.path}/{table}")
        writer.saveAsTable(table)

    def append(self, found: DataFrame) -> None:
        """Add the rows of ``found`` (unique by digest) whose digest the index lacks; of the others, that they were met."""
        rows = found.select("digest", "keep_id", "n", "group_size")
        if self.exists():
            self._add(rows.join(self.read().select("digest").hint("merge"), "digest", "left_semi"), self.met)
            rows = rows.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        self._add(rows, self.table)

    def settled(self) -> DataFrame:
        """(digest, keep_id, group_size) over all batches: the row that stays as if they had come as one."""
        if not self.spark.catalog.tableExists(self.met):
            return self.read().select("digest", "keep_id", "group_size")
        later = self.spark.table(self.met).groupBy("digest").agg(F.min(_order("keep_id")).alias("later"), F.sum("group_size").alias("more"))
        both = self.read().join(later.hint("merge"), "digest", "left")  # both lie by digest: nothing is shuffled
        total = F.col("group_size") + F.coalesce("more", F.lit(0))
        return both.select("digest", F.least(_order("keep_id"), F.col("later"))["id"].alias("keep_id"), total.alias("group_size"))

    def drop(self) -> None:
        for table in (self.table, self.met):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        if self.path:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def _order(key: str) -> Column:
    """Least for the row that stays: the most code points, then the smallest id (null after all others)."""
    return F.struct((-F.col("n")).alias("n"), F.col(key).isNull().alias("none"), F.col(key).alias("id"))


def exact_dedup(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Judge every row of ``docs`` against the index and the other rows, and extend the index.

    Returns doc_id, keep_id (of the row that stays), group_size (rows of this
    batch with the text), kept, text_sha256.  Texts are equal when identical
    without white space.  A text that the index has keeps the row it kept then;
    else the row with the most code points stays, then the smallest doc_id
    (null after all others).  Null texts count as empty, and empty texts are
    equal.  Of repeated rows with one doc_id all are marked as kept.  An empty
    table gives an empty table and leaves the index as it is.  Of a long text the
    digest alone goes on.  Columns but doc_id and text are not read, whatever
    their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialise(
        docs.select("doc_id", F.char_length(text).alias("n"), F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest")), "exact-rows"
    )
    groups = rows.groupBy("digest").agg(F.min(_order("doc_id"))["id"].alias("keep_id"), F.max("n").alias("n"), F.count("*").alias("group_size"))
    met = groups = materialise(groups, "exact-groups")
    if index.exists():
        known = index.read().select("digest", F.col("keep_id").alias("was"), F.lit(True).alias("old"))
        groups = groups.join(known.hint("merge"), "digest", "left").select(
            "digest", F.when(F.col("old"), F.col("was")).otherwise(F.col("keep_id")).alias("keep_id"), "group_size"
        )
        groups = materialise(groups, "exact-judged")
    index.append(met)
    # both sides are read from files, so that AQE can split the partition of a hot digest
    return rows.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
