"""Tolerant delimited-text ingest.

The reference reads headerless tab-separated extracts with quoting off and
errors ignored: short rows dropped, over-long rows cut to the declared
fields, blank lines skipped, empty fields NULL, stray quotes kept.  Spark's CSV
reader cannot reproduce that (PERMISSIVE pads short rows; DROPMALFORMED also
drops long rows and miscounts under column pruning), so lines are read with
the text source and split with ``split(value, '\\t', -1)``.  Rejected lines
are not lost: they go to a quarantine frame with a reason.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wavepanel.functions.scalar import try_date

# The 38 fields of a registration snapshot line, in file order.
SNAPSHOT_FIELDS = (
    "county_code",
    "voter_id",
    "name_last",
    "name_suffix",
    "name_first",
    "name_middle",
    "public_records_exemption",
    "residence_address_1",
    "residence_address_2",
    "residence_city",
    "residence_state",
    "residence_zipcode",
    "mailing_address_1",
    "mailing_address_2",
    "mailing_address_3",
    "mailing_city",
    "mailing_state",
    "mailing_zipcode",
    "mailing_country",
    "gender",
    "race",
    "birth_date",
    "registration_date",
    "party_affiliation",
    "precinct",
    "precinct_group",
    "precinct_split",
    "precinct_suffix",
    "voter_status",
    "congressional_district",
    "house_district",
    "senate_district",
    "county_commission_district",
    "school_board_district",
    "daytime_area_code",
    "daytime_phone_number",
    "daytime_phone_extension",
    "email_address",
)
# The 5 fields of an event-history line.
EVENT_FIELDS = ("county_code", "voter_id", "election_date_str", "election_type", "history_code")


def split_rows(lines: DataFrame, fields: Sequence[str], value: str = "value", sep: str = "\t", keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Split lines into declared string fields; return (good, quarantined).

    good: lines with at least ``len(fields)`` parts, cut to that many, empty
    parts -> NULL.  quarantined: blank and short lines with ``reason`` and
    ``n_fields``.  ``keep`` columns (period tag, file name) ride along.
    """
    n = len(fields)
    parts = F.split(F.col(value), sep, -1)
    tagged = lines.select(*keep, F.col(value), parts.alias("_parts"))
    good = tagged.filter(F.size("_parts") >= n).select(
        *keep, *[F.nullif(F.col("_parts")[i], F.lit("")).alias(name) for i, name in enumerate(fields)]
    )
    bad = tagged.filter(F.size("_parts") < n).select(
        *keep,
        F.col(value).alias("line"),
        F.size("_parts").alias("n_fields"),
        F.when(F.trim(F.col(value)) == "", F.lit("blank")).otherwise(F.lit("short")).alias("reason"),
    )
    return good, bad


def tag_rows(lines: DataFrame, fields: Sequence[str], value: str = "value", sep: str = "\t", keep: Sequence[str] = ()) -> DataFrame:
    """S4 in one frame: the declared fields of good lines, and of rejected ones ``line``, ``n_fields`` and ``reason``.

    ``rejected`` tells them apart, so one parse can be written with a folder for each.
    """
    n = len(fields)
    parts = F.split(F.col(value), sep, -1)
    tagged = lines.select(*keep, F.col(value), parts.alias("_parts")).withColumn("rejected", F.size("_parts") < n)
    bad = F.col("rejected")
    return tagged.select(
        *keep,
        *[F.when(~bad, F.nullif(F.get("_parts", F.lit(i)), F.lit(""))).alias(name) for i, name in enumerate(fields)],
        F.when(bad, F.col(value)).alias("line"),
        F.when(bad, F.size("_parts")).alias("n_fields"),
        F.when(bad, F.when(F.trim(F.col(value)) == "", F.lit("blank")).otherwise(F.lit("short"))).alias("reason"),
        "rejected",
    )


def good_rows(tagged: DataFrame, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return tagged.filter(~F.col("rejected")).select(*keep, *fields)


def rejected_rows(tagged: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return tagged.filter("rejected").select(*keep, "line", "n_fields", "reason")


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text lines with their file name (S3 lineage via the file metadata column)."""
    df = spark.read.text(path if isinstance(path, str) else list(path))
    return df.select("value", F.col("_metadata.file_path").alias("source_file"))


def read_snapshots(
    spark: SparkSession, period_globs: Mapping[str, str | Sequence[str]], fields: Sequence[str] = SNAPSHOT_FIELDS, period_col: str = "extract_month"
) -> tuple[DataFrame, DataFrame]:
    """One glob per period, rows stacked across periods.

    Each period's files are listed by an explicit glob (sibling folders that
    must not be read are simply not matched).  Returns (rows, quarantine).
    """
    goods, bads = [], []
    for period, glob in period_globs.items():
        lines = read_lines(spark, glob).withColumn(period_col, F.lit(period))
        g, b = split_rows(lines, fields, keep=(period_col, "source_file"))
        goods.append(g)
        bads.append(b)
    rows, quarantine = goods[0], bads[0]
    for g, b in zip(goods[1:], bads[1:]):
        rows, quarantine = rows.unionByName(g), quarantine.unionByName(b)
    return rows, quarantine


def read_tagged(
    spark: SparkSession, period_globs: Mapping[str, str | Sequence[str]], fields: Sequence[str] = SNAPSHOT_FIELDS, period_col: str = "extract_month"
) -> DataFrame:
    """``read_snapshots`` as one frame of good and rejected lines (see ``tag_rows``)."""
    out = None
    for period, glob in period_globs.items():
        part = tag_rows(read_lines(spark, glob).withColumn(period_col, F.lit(period)), fields, keep=(period_col, "source_file"))
        out = part if out is None else out.unionByName(part)
    return out


def append_period(
    spark: SparkSession, path: str, period: str, glob: str | Sequence[str], fields: Sequence[str] = SNAPSHOT_FIELDS, period_col: str = "extract_month"
) -> dict[str, int]:
    """Load one period's files into the stored snapshot table, in one parse; returns rows and rejected lines.

    The table lies in folders by ``rejected`` and period.  Only the period's own
    folders are written anew (dynamic partition overwrite): other periods are
    neither read nor touched, and a repeated or corrected delivery replaces the
    one before.  A period that had rejected lines and now has none keeps no old ones.
    """
    seen = Observation(f"append-{period}")
    tagged = read_tagged(spark, {period: glob}, fields, period_col)
    tagged = tagged.observe(seen, F.count_if(~F.col("rejected")).alias("rows"), F.count_if("rejected").alias("rejected"))
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rejected", period_col).parquet(path)
    counts = {k: int(v or 0) for k, v in seen.get.items()}
    for flag, n in (("false", counts["rows"]), ("true", counts["rejected"])):
        if not n:  # dynamic overwrite leaves a folder without new rows as it was
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/rejected={flag}/{period_col}={period}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return counts


def stored_snapshots(spark: SparkSession, path: str, fields: Sequence[str] = SNAPSHOT_FIELDS, period_col: str = "extract_month") -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines) of the table that ``append_period`` writes."""
    kinds = ", ".join(f"`{f}` string" for f in ("source_file", *fields, "line"))
    stored = spark.read.schema(f"{kinds}, n_fields int, reason string, rejected boolean, {period_col} string").parquet(path)
    keep = (period_col, "source_file")
    return good_rows(stored, fields, keep), rejected_rows(stored, keep)


def parse_events(lines: DataFrame, fields: Sequence[str] = EVENT_FIELDS, date_field: str = "election_date_str", date_out: str = "election_date") -> tuple[DataFrame, DataFrame]:
    """S5 on a frame of lines: 5 string fields plus the tolerant parsed date."""
    good, bad = split_rows(lines, fields)
    return good.withColumn(date_out, try_date(date_field)), bad


def read_events(spark: SparkSession, glob: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Event-history files (newest extract only holds the full history)."""
    return parse_events(read_lines(spark, glob).select("value"))


def quarantine_summary(quarantine: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of rejected lines by reason (and optional keys)."""
    return quarantine.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("lines"))
