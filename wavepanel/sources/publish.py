"""Sinks (S9-S13): durable tables, ordered CSV exports, one-pass row counts,
and a data dictionary built from the published frames' schemas."""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wavepanel.session import checkpoint_dir


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), bucket_by: tuple[int, str] | None = None, name: str | None = None) -> None:
    """Drop-and-recreate a durable table (parquet).

    ``bucket_by=(n, key)`` writes a bucketed table (needs ``name``) so later
    joins and groupings on ``key`` skip their shuffle.
    """
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by is not None:
        n, key = bucket_by
        w.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name or path.rstrip("/").split("/")[-1])
    else:
        w.parquet(path)


def shared_dir(spark: SparkSession, name: str) -> str:
    """Folder under the cluster's shared checkpoint location for a named table."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}"


def materialize(spark: SparkSession, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts lineage;
    survives executor loss, unlike a local checkpoint).  ``partition_by``
    lays the copy out by those columns so later filters prune partitions."""
    path = shared_dir(spark, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    schema = df.schema  # the types of folder columns are not guessed from their names
    w.parquet(path)
    return spark.read.schema(schema).parquet(path)


def materialize_bucketed(spark: SparkSession, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` as a table bucketed and sorted by ``key`` in the shared folder.

    Two tables bucketed on the same key with the same bucket count join and
    group on that key without any shuffle (the scans report the bucketing).
    """
    table = "wp_" + "".join(ch if ch.isalnum() else "_" for ch in name)
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", shared_dir(spark, name)).saveAsTable(table)
    return spark.table(table)


def drop_run(spark: SparkSession, run: str, bucketed: Sequence[str] = ()) -> None:
    """Drop the copies that ``materialize`` and ``materialize_bucketed`` wrote under ``run``."""
    for name in bucketed:
        spark.sql("DROP TABLE IF EXISTS wp_" + "".join(ch if ch.isalnum() else "_" for ch in f"{run}/{name}"))
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark, run))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def publish_csv(df: DataFrame, path: str, order: Sequence[str] = (), single_file_rows: int = 1_000_000) -> int:
    """S11 + S12: ordered CSV with header; returns the row count.

    The query runs once, into a copy in the shared folder, whose count is
    observed on the way.  At most ``single_file_rows`` rows become one file; more
    are dealt by ranges of the order into numbered parts of about that many
    rows, each sorted, with a header of its own: the parts in the order of their names
    hold the rows in order.  Rows that tie, and those of a frame without
    ``order``, keep the frame's own ordering, so that a hot value is split too.
    Spark's CSV writer leaves out a row whose only column is null; it counts.
    """
    spark = df.sparkSession
    run = f"wavepanel-csv-{uuid.uuid4().hex}"
    obs = Observation("published")
    ordered = df.orderBy(*[F.col(c).asc_nulls_last() for c in order]) if order else df
    placed = ordered.withColumn("_place", F.monotonically_increasing_id()).observe(obs, F.count(F.lit(1)).alias("rows"))
    try:
        copy = materialize(spark, placed, run)
        rows = int(obs.get["rows"])
        if rows <= single_file_rows:
            out = copy.coalesce(1).sortWithinPartitions("_place")
        else:
            out = copy.repartitionByRange(math.ceil(rows / single_file_rows), "_place").sortWithinPartitions("_place")
        out.drop("_place").write.mode("overwrite").option("header", True).csv(path)
        return rows
    finally:
        drop_run(spark, run)


def described(df: DataFrame, comments: Mapping[str, str]) -> DataFrame:
    """``df`` with a comment on each named column, kept in the schema: Parquet copies and tables carry it."""
    for c, text in comments.items():
        df = df.withMetadata(c, {**df.schema[c].metadata, "comment": text})
    return df


def column_dictionary(spark: SparkSession, frames: Mapping[str, DataFrame]) -> DataFrame:
    """S13 by column: file, place (from 1), name, type and comment of every column, read from the schemas."""
    rows = [(name, i, f.name, f.dataType.simpleString(), f.metadata.get("comment", "")) for name, df in frames.items() for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "file STRING, place INT, column STRING, type STRING, comment STRING")


def store_view(df: DataFrame, view: str, path: str, query: str = "SELECT * FROM {table}", partition_by: Sequence[str] = ()) -> str:
    """Save ``df`` as a table of the catalog and a view over it; returns the table's name.

    The view is the catalog's and not the session's: other sessions on that
    catalog read it.  ``query`` is its text, ``{table}`` the saved table.
    """
    table = f"{view}_stored"
    df.write.mode("overwrite").option("path", path).saveAsTable(table, partitionBy=list(partition_by) or None)
    df.sparkSession.sql(f"CREATE OR REPLACE VIEW {view} AS " + query.format(table=table))
    return table


def data_dictionary(spark: SparkSession, frames: Mapping[str, DataFrame], descriptions: Mapping[str, str]) -> DataFrame:
    """One row per published folder: its name, columns, description."""
    rows = [(name, ", ".join(df.columns), descriptions.get(name, "")) for name, df in frames.items()]
    return spark.createDataFrame(rows, "file STRING, columns STRING, description STRING")
