"""Area indicators and publishing measures on edge fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from wavepanel.functions.scalar import band
from wavepanel.operators import areas as A
from wavepanel.operators import measures as M
from wavepanel.plans import registration as R


def _income(spark, rows):
    return spark.createDataFrame(rows, "zip_code string, tax_year int, mean_agi_per_return double, real_mean_agi double, income_band string")


def _series(spark, rows):
    return spark.createDataFrame(rows, "zip_code string, year_month string, typical_home_value double, home_value_yoy_change double, home_value_5yr_change double")


def test_affordability_sd_zero_is_unknown(spark):
    inc = _income(spark, [("00001", 2022, 100.0, 100.0, "x"), ("00002", 2022, 100.0, 100.0, "x")])
    hv = _series(spark, [("00001", "2026-05", 500.0, None, None), ("00002", "2026-05", 500.0, None, None)])
    out = A.affordability(inc, hv, 2022, 2020)
    assert {r["affordability_band"] for r in out.collect()} == {"unknown"}


def test_affordability_single_area_and_bands(spark):
    inc = _income(spark, [("00001", 2022, 100.0, 100.0, "x")])
    hv = _series(spark, [("00001", "2026-05", 500.0, None, None), ("00001", "2026-04", 1.0, None, None)])
    out = A.affordability(inc, hv, 2022, 2020).collect()
    assert len(out) == 1 and out[0]["affordability_band"] == "unknown"  # one area: sd undefined
    assert out[0]["typical_home_value_latest"] == 500.0  # latest month anywhere in the series


def test_affordability_of_every_area(spark):
    inc = _income(spark, [("00001", 2022, 100.0, 100.0, "x"), ("00002", 2022, 200.0, 200.0, "y"), ("00003", 2022, 0.0, 0.0, "z")])
    hv = _series(spark, [("00001", "2026-05", 500.0, None, None), ("00003", "2026-05", 700.0, None, None), ("00002", "2026-04", 9.0, None, None)])
    some = {r["zip_code"]: r for r in A.affordability(inc, hv, 2022, 2020).collect()}
    every = {r["zip_code"]: r for r in A.affordability(inc, hv, 2022, 2020, every_area=True).collect()}
    assert set(some) == {"00001", "00003"} and set(every) == {"00001", "00002", "00003"}
    assert all(every[z] == some[z] for z in some)  # the scores don't change
    assert every["00003"]["affordability_band"] == "unknown" and every["00003"]["home_value_to_income_ratio"] is None
    left = every["00002"]  # no value in the latest month
    assert left["income_band"] == "y" and left["affordability_band"] is None and left["typical_home_value_latest"] is None


def test_pressure_band_edges(spark):
    df = spark.createDataFrame([(-0.75,), (-0.25,), (0.25,), (0.75,), (-0.7500001,)], "z double")
    got = [r[0] for r in df.select(band("z", A.PRESSURE_CUTS, A.PRESSURE_TOP)).collect()]
    assert got == ["2: below average", "3: average", "4: above average", "5: high pressure", "1: low pressure"]


def test_area_income_filters_and_pads(spark):
    br = spark.createDataFrame(
        [("FL", 32601, 2022, 10, 1000), ("FL", 32601, 2022, 10, 1000), ("FL", 0, 2022, 5, 1), ("GA", 30301, 2022, 5, 1), ("FL", 7, 2022, 0, 0), ("FL", 1234, 2022, 2, 70)],
        "STATE string, zipcode long, tax_year int, N1 long, A00100 long",
    )
    cpi = spark.createDataFrame([("2022-12", 100.0, "2026-05", 1.25)], "year_month string, cpi_value double, base_month string, real_factor double")
    out = {r["zip_code"]: r for r in A.area_income(br, cpi, R.INCOME).collect()}
    assert set(out) == {"32601", "01234"}  # state filter, '0' dropped, zero returns dropped, 4-digit padded
    assert out["32601"]["mean_agi_per_return"] == 100000.0 and out["32601"]["real_mean_agi"] == 125000.0
    assert out["01234"]["income_band"] == "2: $35-55K"


def test_positional_lag_with_gap(spark):
    rows = [("00001", dt.date(2000, m, 1), float(m)) for m in range(1, 13)] + [("00001", dt.date(2001, 2, 1), 26.0)]
    long = spark.createDataFrame(rows, "zip_code string, month_date date, typical_home_value double")
    out = A.area_series(long).orderBy("month_date").collect()
    last = out[-1]
    # 12 rows back by position is 2000-01 (value 1.0); by calendar it would be 2000-02
    assert last["hv_1y_ago"] == 1.0 and last["home_value_yoy_change"] == 25.0
    assert out[0]["hv_1y_ago"] is None


def test_deflators_fallback_to_latest(spark):
    cpi = spark.createDataFrame([("2026-03", 300.0), ("2026-04", 320.0)], "year_month string, cpi_value double")
    out = {r["year_month"]: r for r in A.deflators(cpi, "2026-05").collect()}
    assert out["2026-03"]["base_month"] == "2026-04" and out["2026-03"]["real_factor"] == 320.0 / 300.0


def test_suppress_edges(spark):
    df = spark.createDataFrame([("a", 9), ("b", 10), ("c", 11), (None, 10)], "k string, voters long")
    assert sorted((r[0] or "-") for r in M.suppress(df, 10).collect()) == ["-", "b", "c"]


def test_shares_sum_to_100(spark):
    df = spark.createDataFrame([("g1", "x", 1), ("g1", "y", 2), ("g2", "x", 7)], "g string, p string, n long")
    out = M.share_within(df, ["g"], "n", "pct")
    sums = {r[0]: r[1] for r in out.groupBy("g").agg(F.sum("pct")).collect()}
    assert abs(sums["g1"] - 100.0) < 1e-9 and abs(sums["g2"] - 100.0) < 1e-9


def test_top_bottom_deterministic_ties(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1), ("d", 9)], "k string, m long")
    got = [(r["side"], r["rank"], r["k"]) for r in M.top_bottom(df, "k", "m", 2).collect()]
    assert sorted(got) == sorted([("top", 1, "d"), ("top", 2, "a"), ("bottom", 1, "c"), ("bottom", 2, "a")])


def test_period_profile_exact_and_approx(spark):
    df = spark.createDataFrame([("m1", "a"), ("m1", "a"), ("m1", "b"), ("m2", "c")], "p string, e string")
    exact = {r["p"]: r for r in M.period_profile(df, "p", "e").collect()}
    assert exact["m1"]["rows"] == 3 and exact["m1"]["distinct_entity_ids"] == 2 and exact["m1"]["duplicate_rows"] == 1
    approx = {r["p"]: r for r in M.period_profile(df, "p", "e", approx=True).collect()}
    assert approx["m1"]["distinct_entity_ids"] == 2  # exact at this size


def test_pivot_counts_fills_missing(spark):
    df = spark.createDataFrame([("g1", "x"), ("g1", "y"), ("g2", "x")], "g string, v string")
    out = {r["g"]: r for r in M.pivot_counts(df, ["g"], "v", ["x", "y", "z"], ["x", "y", "z"]).collect()}
    assert (out["g2"]["n_x"], out["g2"]["n_y"], out["g2"]["n_z"], out["g2"]["total"]) == (1, 0, 0, 1)


def test_calendar_lags_across_a_gap(spark):
    months = [dt.date(2000 + m // 12, m % 12 + 1, 28) for m in range(75) if m != 20]
    rows = [("00001", d, 100.0 + k) for k, d in enumerate(months)] + [("00002", dt.date(2001, 1, 31), 7.0), ("00002", dt.date(2002, 1, 31), 0.0), ("00002", dt.date(2003, 1, 31), None)]
    long = spark.createDataFrame(rows, "zip_code string, month_date date, typical_home_value double")
    value = {(z, d.year * 12 + d.month): v for z, d, v in rows if v is not None}
    for r in A.area_series_calendar(long).collect():
        z, m = r["zip_code"], r["month_date"].year * 12 + r["month_date"].month
        for name, growth, k in (("hv_1y_ago", "home_value_yoy_change", 12), ("hv_5y_ago", "home_value_5yr_change", 60)):
            ago = value.get((z, m - k))
            assert r[name] == ago
            assert r[growth] == (None if not ago else value[z, m] / ago - 1)
    by_position = {(r["zip_code"], r["month_date"]): r["hv_1y_ago"] for r in A.area_series(long).collect()}
    by_calendar = {(r["zip_code"], r["month_date"]): r["hv_1y_ago"] for r in A.area_series_calendar(long).collect()}
    after = ("00001", dt.date(2002, 9, 28))  # a year after the month that is missing
    assert by_calendar[after] is None and by_position[after] is not None
    before = ("00001", dt.date(2001, 8, 28))
    assert by_calendar[before] == by_position[before]


def test_sample_is_the_same_for_any_order_and_mergeable(spark):
    rows = [(f"g{i % 3}", i) for i in range(200)] + [(None, 900), (None, 901)]
    t = spark.createDataFrame(rows, "g string, k long")
    pick = lambda df: {tuple(r) for r in M.sample_rows(df, 5, ["k"], ["g"]).collect()}
    want = pick(t)
    assert len(want) == 17 and pick(t.orderBy(F.rand(3)).repartition(7)) == want
    parts = [M.sample_rows(t.filter(F.col("k") % 2 == i), 5, ["k"], ["g"]) for i in (0, 1)]
    assert pick(parts[0].unionByName(parts[1])) == want
    assert M.sample_rows(t, 4, ["k"]).count() == 4
