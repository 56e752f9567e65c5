"""Scalar helpers on the edge rows of the fixture list (dates, bands, directions)."""

import datetime as dt

from pyspark.sql import functions as F

from wavepanel.functions.scalar import band, changed_when_present, decode, pct, try_date, year_diff, zip5
from wavepanel.operators.transitions import absolute_direction, relative_direction


def test_try_date_tolerant(spark):
    df = spark.createDataFrame(
        [("2/3/2024",), ("02/30/2024",), ("*",), ("",), ("02/03/2024 ",), ("02/03/24",), (None,), ("12/31/2001",)], "s string"
    )
    got = [r[0] for r in df.select(try_date("s")).collect()]
    assert got == [dt.date(2024, 2, 3), None, None, None, dt.date(2024, 2, 3), None, None, dt.date(2001, 12, 31)]


def test_year_diff_counts_boundaries(spark):
    df = spark.createDataFrame([(dt.date(2001, 12, 31),), (dt.date(2002, 1, 1),)], "b date")
    got = [r[0] for r in df.select(year_diff("b", F.lit("2026-05-01").cast("date"))).collect()]
    assert got == [25, 24]  # calendar-year difference, not completed years


def test_age_band_edges(spark):
    from wavepanel.plans.registration import AGE_CUTS

    df = spark.createDataFrame([(17,), (24,), (25,), (119,), (120,), (-3,), (None,)], "a int")
    got = [r[0] for r in df.select(band("a", AGE_CUTS, "unknown", "unknown")).collect()]
    assert got == ["18-24", "18-24", "25-34", "75+", "unknown", "18-24", "unknown"]


def test_income_band_exact_cuts(spark):
    from wavepanel.plans.registration import INCOME_CUTS, INCOME_TOP

    df = spark.createDataFrame([(35000.0,), (55000.0,), (80000.0,), (120000.0,), (200000.0,), (34999.99,)], "m double")
    got = [r[0] for r in df.select(band("m", INCOME_CUTS, INCOME_TOP, INCOME_TOP)).collect()]
    assert got == ["2: $35-55K", "3: $55-80K", "4: $80-120K", "5: $120-200K", "6: $200K+", "1: under $35K"]


def test_decode_null_and_unknown(spark):
    from wavepanel.operators.events import RACE_LABELS

    df = spark.createDataFrame([("1",), ("7",), ("9",), (None,)], "r string")
    got = [r[0] for r in df.select(decode("r", RACE_LABELS, "9 Unknown")).collect()]
    assert got == ["1 American Indian / Alaskan", "7 Multi-racial", "9 Unknown", "9 Unknown"]


def test_changed_when_present_never_null(spark):
    df = spark.createDataFrame([("A", "B"), ("A", "A"), (None, "A"), ("A", None), (None, None)], "a string, b string")
    got = [r[0] for r in df.select(changed_when_present("a", "b")).collect()]
    assert got == [True, False, False, False, False]


def test_directions_exact_thresholds(spark):
    from wavepanel.operators.transitions import AFFORD_DIRECTION, INCOME_DIRECTION

    df = spark.createDataFrame([(100.0, 115.0), (100.0, 85.0), (100.0, 100.0), (None, 1.0), (2.0, 3.0), (3.0, 2.0), (2.0, 2.5)], "s double, d double")
    rel = [r[0] for r in df.select(relative_direction("s", "d", 1.15, 0.85, INCOME_DIRECTION)).collect()]
    assert rel[:4] == ["up (>=+15%)", "down (<=-15%)", "lateral (+/-15%)", "unknown"]
    ab = [r[0] for r in df.select(absolute_direction("s", "d", 1.0, AFFORD_DIRECTION)).collect()]
    assert ab[4:] == ["to less affordable (+1.0+ ratio)", "to more affordable (-1.0+ ratio)", "similar pressure"]


def test_zip5_pads_and_truncates(spark):
    df = spark.createDataFrame([(7,), (32601,), (123456,)], "z long")
    assert [r[0] for r in df.select(zip5("z")).collect()] == ["00007", "32601", "12345"]


def test_pct_divides_safely(spark):
    df = spark.createDataFrame([(1, 3), (1, 0), (None, 2)], "n long, d long")
    got = [r[0] for r in df.select(pct("n", "d")).collect()]
    assert abs(got[0] - 100.0 / 3) < 1e-12 and got[1] is None and got[2] is None


def test_not_in_with_null_is_not_true(spark):
    df = spark.createDataFrame([("DEM",), ("LPF",), (None,)], "p string")
    assert df.filter(~F.col("p").isin("DEM", "REP", "NPA")).count() == 1


def test_count_distinct_tuple_counts_null_parts(spark):
    df = spark.createDataFrame([(None, "GEN"), ("d", None), ("d", "GEN"), ("d", "GEN")], "a string, b string")
    assert df.select(F.countDistinct(F.struct("a", "b"))).first()[0] == 3
