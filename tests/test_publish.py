"""Sinks: large ordered CSVs in parts, comments that stay with columns, stored views, mergeable distinct counts."""

import glob

from pyspark.sql import functions as F

from wavepanel.operators.measures import distinct_sketches, estimated, unite_sketches
from wavepanel.sources.publish import column_dictionary, described, publish_csv, store_view


def parts(path):
    return sorted(glob.glob(f"{path}/part-*.csv"))


def lines(path):
    found = []
    for p in parts(path):
        with open(p) as f:
            head, *rest = f.read().splitlines()
        found.append((head, rest))
    return found


def test_large_frame_in_ordered_parts(spark, tmp_path):
    n = 1_000_000
    # half of the rows share one value: ties are split over parts
    df = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(n - F.col("id")).alias("k"), "id").repartition(8)
    assert publish_csv(df, str(tmp_path / "big"), ["k", "id"], single_file_rows=100_000) == n
    found = lines(tmp_path / "big")
    assert len(found) == 10 and {h for h, _ in found} == {"k,id"}
    assert max(len(r) for _, r in found) < 300_000
    rows = [tuple(map(int, r.split(","))) for _, rest in found for r in rest]
    assert len(rows) == n and rows == sorted(rows)


def test_small_frame_is_one_file_in_its_own_order(spark, tmp_path):
    df = spark.createDataFrame([(k, "x") for k in (3, 1, 2, None)], "k int, v string").repartition(4)
    assert publish_csv(df.orderBy(F.col("k").desc_nulls_last()), str(tmp_path / "own")) == 4
    assert lines(tmp_path / "own") == [("k,v", ["3,x", "2,x", "1,x", ",x"])]
    assert publish_csv(df, str(tmp_path / "asked"), ["k"]) == 4
    assert lines(tmp_path / "asked") == [("k,v", ["1,x", "2,x", "3,x", ",x"])]
    assert publish_csv(df.where("k > 9"), str(tmp_path / "none")) == 0


def test_comments_come_back(spark, tmp_path):
    df = described(spark.createDataFrame([(1, "x")], "n int, s string"), {"n": "how many"})
    df.write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    rows = column_dictionary(spark, {"t": back}).orderBy("place").collect()
    assert [tuple(r) for r in rows] == [("t", 1, "n", "int", "how many"), ("t", 2, "s", "string", "")]


def test_view_is_read_by_another_session(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "g string, n int")
    table = store_view(df, "wp_view_test", str(tmp_path / "v"), "SELECT g, SUM(n) AS n FROM {table} GROUP BY g", ["g"])
    try:
        other = spark.newSession()
        assert sorted(map(tuple, other.table("wp_view_test").collect())) == [("a", 3), ("b", 5)]
    finally:
        spark.sql("DROP VIEW wp_view_test")
        spark.sql(f"DROP TABLE {table}")


def test_sketches_unite(spark):
    df = spark.range(200_000).select((F.col("id") % 3).alias("p"), (F.col("id") % 5).alias("f"), (F.col("id") % 30_000).alias("v"), F.lit(None).cast("string").alias("e"))
    kept = distinct_sketches(df, ["p", "f"], ["v", "e"])
    late = kept.where("p = 2")
    united = unite_sketches(unite_sketches(kept.where("p < 2")).unionByName(late.drop("p", "f")))
    r = estimated(united).first()
    assert r["rows"] == 200_000 and abs(r["distinct_v"] - 30_000) <= 1200 and r["distinct_e"] == 0
    for r in estimated(unite_sketches(kept, ["p"])).collect():
        assert abs(r["distinct_v"] - 10_000) <= 400
