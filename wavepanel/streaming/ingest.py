"""Snapshot ingest as a Structured Streaming job.

Extracts arrive as files in one folder per period.  Each folder is a
file-source stream of text lines; lines are split with the same malformed-row
policy as the batch reader and written by the parquet file sink (exactly
once, via the checkpoint) partitioned by period, with rejected lines going to
a quarantine sink.  ``trigger(availableNow=True)`` processes whatever has
arrived and stops, so the job can be scheduled like a batch load and resumed
after failures without re-reading finished files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wavepanel.session import checkpoint_dir
from wavepanel.sources.text import SNAPSHOT_FIELDS, split_rows


def snapshot_lines_stream(spark: SparkSession, folder: str, period: str, period_col: str = "extract_month", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(folder)
    return lines.select("value", F.col("_metadata.file_path").alias("source_file"), F.lit(period).alias(period_col))


def start_snapshot_ingest(
    spark: SparkSession,
    period_folders: Mapping[str, str],
    out_path: str,
    quarantine_path: str,
    fields: Sequence[str] = SNAPSHOT_FIELDS,
    checkpoint_root: str | None = None,
    period_col: str = "extract_month",
) -> list[StreamingQuery]:
    """Start the available-now streams (good rows, quarantine) over all period folders.

    Checkpoints live under ``checkpoint_root`` or the shared folder named by
    ``spark.checkpoint.dir``.
    """
    root = (checkpoint_root or checkpoint_dir(spark)).rstrip("/")
    # one source per period folder, unioned: a file sink takes one writer
    lines = None
    for period, folder in period_folders.items():
        part = snapshot_lines_stream(spark, folder, period, period_col)
        lines = part if lines is None else lines.unionByName(part)
    good, bad = split_rows(lines, fields, keep=(period_col, "source_file"))
    rows_q = (
        good.writeStream.format("parquet")
        .partitionBy(period_col)
        .option("path", out_path)
        .option("checkpointLocation", f"{root}/ingest-rows")
        .trigger(availableNow=True)
        .start()
    )
    bad_q = (
        bad.writeStream.format("parquet")
        .option("path", quarantine_path)
        .option("checkpointLocation", f"{root}/ingest-quarantine")
        .trigger(availableNow=True)
        .start()
    )
    return [rows_q, bad_q]


def run_snapshot_ingest(spark: SparkSession, period_folders: Mapping[str, str], out_path: str, quarantine_path: str, **kw) -> None:
    """Process everything that has arrived, then return."""
    for q in start_snapshot_ingest(spark, period_folders, out_path, quarantine_path, **kw):
        q.awaitTermination()
