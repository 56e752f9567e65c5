"""Public-series readers (S6-S8): nested JSON index, bracket CSV, wide CSV.

Each reader has a path form and a frame form (documents or lines already in
a DataFrame), so the parsing is the same whether the bytes come from files
or from data Spark derived upstream.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavepanel.functions.scalar import month_key

# {"Results": {"series": [{"data": [{"year": "2022", "period": "M12", "value": "296.797"}]}]}}
CPI_SCHEMA = T.StructType(
    [
        T.StructField(
            "Results",
            T.StructType(
                [
                    T.StructField(
                        "series",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField(
                                        "data",
                                        T.ArrayType(
                                            T.StructType(
                                                [
                                                    T.StructField("year", T.StringType()),
                                                    T.StructField("period", T.StringType()),
                                                    T.StructField("value", T.StringType()),
                                                ]
                                            )
                                        ),
                                    )
                                ]
                            )
                        ),
                    )
                ]
            ),
        )
    ]
)


def cpi_from_documents(docs: DataFrame, col: str = "json") -> DataFrame:
    """S6 on JSON strings: first series' data -> (year_month, cpi_value).

    Keeps monthly periods M01..M12 (drops the M13 annual average and
    anything non-monthly), skips values that do not parse as numbers.
    """
    parsed = docs.select(F.from_json(F.col(col), CPI_SCHEMA).alias("_d"))
    return _cpi_rows(parsed.select(F.explode(F.col("_d.Results.series")[0]["data"]).alias("r")))


def _cpi_rows(recs: DataFrame) -> DataFrame:
    period = F.col("r.period")
    month = F.expr("try_cast(substring(r.period, 2) AS INT)")
    value = F.expr("try_cast(r.value AS DOUBLE)")
    rows = recs.select(F.col("r.year").alias("_y"), period.alias("_p"), month.alias("_m"), value.alias("cpi_value"))
    ok = F.col("_p").startswith("M") & F.col("_m").between(1, 12) & F.col("cpi_value").isNotNull()
    return rows.filter(ok).select(F.format_string("%s-%02d", F.col("_y"), F.col("_m")).alias("year_month"), "cpi_value")


def read_cpi(spark: SparkSession, path: str) -> DataFrame:
    """One multi-line JSON document per file."""
    doc = spark.read.schema(CPI_SCHEMA).option("multiLine", True).json(path)
    return _cpi_rows(doc.select(F.explode(F.col("Results.series")[0]["data"]).alias("r")))


BRACKET_TYPES = {"STATE": "STRING", "zipcode": "BIGINT", "N1": "DOUBLE", "A00100": "DOUBLE"}


def typed_brackets(raw: DataFrame, *more: str) -> DataFrame:
    """The used columns of headered rows, by name, typed tolerantly (what doesn't parse is NULL)."""
    return raw.select(*[F.expr(f"try_cast(`{c}` AS {t})").alias(c) for c, t in BRACKET_TYPES.items()], *more)


def brackets_from_lines(lines: DataFrame, header: Sequence[str], value: str = "value") -> DataFrame:
    """S7 on CSV lines already in a frame: header lines dropped, fields named by ``header``."""
    ddl = ", ".join(f"`{c}` STRING" for c in header)
    body = lines.filter(~F.col(value).startswith(header[0]))
    return body.select(F.from_csv(F.col(value), ddl).alias("_r")).select("_r.*")


def read_income_brackets(spark: SparkSession, year_paths: Mapping[int, str]) -> DataFrame:
    """Headered CSV per tax year (a declared schema would map columns by position)."""
    frames = [typed_brackets(spark.read.option("header", True).csv(p)).withColumn("tax_year", F.lit(int(y))) for y, p in year_paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def date_columns(columns: Sequence[str]) -> list[str]:
    """Wide-series date columns: names starting with 19/20 and containing '-'."""
    return [c for c in columns if c.startswith(("19", "20")) and "-" in c]


def wide_to_long(wide: DataFrame, id_cols: Sequence[str], value: str = "typical_home_value") -> DataFrame:
    """S8 + R1: discover the date columns from the schema, unpivot, drop NULLs,
    key by month."""
    dates = date_columns(wide.columns)
    cells = wide.select(*id_cols, *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in dates])
    long = cells.unpivot(list(id_cols), dates, "date_str", value).filter(F.col(value).isNotNull())
    d = F.expr("try_cast(date_str AS DATE)")
    return long.select(*id_cols, d.alias("month_date"), month_key(d).alias("year_month"), F.col(value))


def read_wide_series(spark: SparkSession, path: str, id_cols: Sequence[str], state: str | None = None) -> DataFrame:
    """Headered wide CSV (one column per month-end date), read as strings
    (no inference pass); values are cast after the unpivot."""
    wide = spark.read.option("header", True).csv(path)
    if state is not None:
        wide = wide.filter(F.col("State") == state)
    return wide_to_long(wide, id_cols)
