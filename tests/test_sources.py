"""Tolerant ingest: malformed text rows, file lineage, JSON index, CSV, wide series."""

import json

from pyspark.sql import functions as F

from wavepanel.sources import external as X
from wavepanel.sources import text as TX


def test_split_rows_policy(spark):
    lines = spark.createDataFrame(
        [("a\tb\tc",), ("a\tb",), ("",), ("a\tb\tc\td",), ('a\t"b\tc',), ("a\t\tc",), (" a \tb\tc",)], "value string"
    )
    good, bad = TX.split_rows(lines, ["x", "y", "z"])
    g = [tuple(r) for r in good.collect()]
    assert g == [("a", "b", "c"), ("a", "b", "c"), ("a", '"b', "c"), ("a", None, "c"), (" a ", "b", "c")]
    reasons = sorted((r["reason"], r["n_fields"]) for r in bad.collect())
    assert reasons == [("blank", 1), ("short", 2)]


def test_read_snapshots_from_files(spark, tmp_path):
    fields = TX.SNAPSHOT_FIELDS
    row = ["X"] * len(fields)
    for month, rows in {"m1": [row, row[:-2]], "m2": [row + ["extra"], []]}.items():
        d = tmp_path / month
        d.mkdir()
        (d / "ALA_x.txt").write_text("\n".join("\t".join(r) for r in rows) + "\n")
        (tmp_path / month / "skip").mkdir()
        (tmp_path / month / "skip" / "verify.txt").write_text("not\ta\tsnapshot\n")
    rows, bad = TX.read_snapshots(spark, {"2026-03": str(tmp_path / "m1" / "*.txt"), "2026-04": str(tmp_path / "m2" / "*.txt")})
    got = rows.groupBy("extract_month").count().orderBy("extract_month").collect()
    assert [(r[0], r[1]) for r in got] == [("2026-03", 1), ("2026-04", 1)]
    assert rows.filter(F.col("source_file").endswith("ALA_x.txt")).count() == 2
    assert set(rows.columns) >= set(fields) | {"extract_month", "source_file"}
    assert bad.filter(F.col("reason") == "short").count() == 1


def test_cpi_documents(spark):
    doc = {
        "Results": {
            "series": [
                {
                    "data": [
                        {"year": "2022", "period": "M12", "value": "296.797"},
                        {"year": "2022", "period": "M13", "value": "292.655"},
                        {"year": "2022", "period": "M11", "value": "-"},
                        {"year": "2022", "period": "S01", "value": "1.0"},
                        {"year": "2023", "period": "M01", "value": "299.170"},
                    ]
                }
            ]
        }
    }
    df = spark.createDataFrame([(json.dumps(doc),)], "json string")
    got = sorted(tuple(r) for r in X.cpi_from_documents(df).collect())
    assert got == [("2022-12", 296.797), ("2023-01", 299.17)]


def test_read_cpi_file(spark, tmp_path):
    doc = {"Results": {"series": [{"data": [{"year": "2026", "period": "M05", "value": "320.5"}]}]}}
    p = tmp_path / "cpi.json"
    p.write_text(json.dumps(doc, indent=2))
    assert [tuple(r) for r in X.read_cpi(spark, str(p)).collect()] == [("2026-05", 320.5)]


def test_wide_series_discovery(spark):
    wide = spark.createDataFrame(
        [("32601", "Gainesville", 100.0, None, 120.0), ("32602", "Gainesville", None, 90.0, 95.0)],
        "RegionName string, City string, `2000-01-31` double, `2000-02-29` double, `2000-03-31` double",
    )
    assert X.date_columns(wide.columns) == ["2000-01-31", "2000-02-29", "2000-03-31"]
    long = X.wide_to_long(wide, ["RegionName", "City"])
    assert long.count() == 4  # NULL cells dropped
    assert {r["year_month"] for r in long.collect()} == {"2000-01", "2000-02", "2000-03"}


def test_bracket_lines(spark):
    lines = spark.createDataFrame([("STATE,zipcode,N1,A00100",), ("FL,32601,100,5000",), ("FL,0,5,1",)], "value string")
    got = [tuple(r) for r in X.typed_brackets(X.brackets_from_lines(lines, ("STATE", "zipcode", "N1", "A00100"))).collect()]
    assert got == [("FL", 32601, 100, 5000), ("FL", 0, 5, 1)]
