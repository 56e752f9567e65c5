"""Change panel on an edge fixture (registration preset names)."""

from pyspark.sql import functions as F

from wavepanel.operators import panel as P
from wavepanel.plans import registration as R

COLS = "voter_id string, extract_month string, source_file string, county_code string, residence_zipcode string, party_affiliation string, voter_status string, birth_date string, registration_date string, gender string, race string"
M, A, Y = "2026-03", "2026-04", "2026-05"


def _rows():
    def r(v, m, county, zip_="32601", party="DEM", status="ACT", f="a.txt", birth="01/15/1980", race="5"):
        return (v, m, f, county, zip_, party, status, birth, "03/01/2000", "F", race)

    return [
        # v1 present in all; ZIP -> ZIP+4 in May; party A->B->A; status ACT->INA->ACT
        r("v1", M, "ALA", party="DEM", status="ACT"),
        r("v1", A, "ALA", party="REP", status="INA"),
        r("v1", Y, "ALA", zip_="32601-1234", party="DEM", status="ACT"),
        # the other six non-empty presence patterns
        r("v2", M, "BAY"), r("v2", A, "BAY"),
        r("v3", M, "BAY"),
        r("v4", A, "BAY"), r("v4", Y, "BAY"),
        r("v5", Y, "BAY", birth="12/31/2001"),
        r("v6", A, "BAY", birth="*"),
        r("v7", M, "BAY"), r("v7", Y, "BAY"),
        # a row exists in April but its county is NULL: not present in April
        r("v8", M, "BAY"), r("v8", A, None), r("v8", Y, "BAY"),
        # two rows in one period with different values and NULLs: the row of
        # the lexically first file is kept whole (no mixing of columns)
        r("v9", M, "ALA", party=None, f="a.txt"), r("v9", M, "BAY", party="DEM", f="b.txt"),
    ]


def _panel(spark):
    snap = spark.createDataFrame(_rows(), COLS)
    return R.voter_changes(snap)


def test_presence_patterns_and_flags(spark):
    p = {r["voter_id"]: r for r in _panel(spark).collect()}
    pat = {v: (r["appeared_in_march"], r["appeared_in_april"], r["appeared_in_may"]) for v, r in p.items()}
    assert pat["v1"] == (True, True, True)
    assert pat["v2"] == (True, True, False)
    assert pat["v3"] == (True, False, False)
    assert pat["v4"] == (False, True, True)
    assert pat["v5"] == (False, False, True)
    assert pat["v6"] == (False, True, False)
    assert pat["v7"] == (True, False, True)
    assert pat["v8"] == (True, False, True)  # presence by witness, not row existence
    v1 = p["v1"]
    assert v1["zip_changed_apr_may"] and not v1["zip_changed_mar_apr"]
    assert v1["party_changed_mar_apr"] and v1["party_changed_apr_may"]
    assert v1["status_changed_mar_apr"] and v1["status_changed_apr_may"]
    assert v1["party_last_known"] == "DEM" and v1["zip_last_known"] == "32601-1234"
    v7 = p["v7"]
    assert v7["missing_after_march"] and v7["new_in_may"] and not v7["new_in_may_only"]
    assert p["v5"]["new_in_may_only"]
    # no change flag when one side is absent
    assert not p["v7"]["county_changed_mar_apr"] and not p["v7"]["county_changed_apr_may"]
    # flags are never NULL
    flags = [c for c in _panel(spark).columns if c.startswith(("appeared_", "new_", "missing_")) or "_changed_" in c]
    assert all(v[f] is not None for v in p.values() for f in flags)


def test_dedupe_keeps_whole_row(spark):
    v9 = [r for r in _panel(spark).collect() if r["voter_id"] == "v9"][0]
    assert v9["county_mar"] == "ALA" and v9["party_mar"] is None


def test_ages_and_bands(spark):
    p = {r["voter_id"]: r for r in _panel(spark).collect()}
    assert p["v5"]["age_at_may_2026"] == 25 and p["v5"]["age_band"] == "25-34"  # year-boundary age
    assert p["v6"]["age_at_may_2026"] is None and p["v6"]["age_band"] == "unknown"
    assert p["v1"]["registration_age_years"] == 26


def test_identity_new_minus_departures_is_population_change(spark):
    p = _panel(spark)
    s = p.agg(
        F.sum(F.col("new_in_april").cast("int") + F.col("new_in_may").cast("int")).alias("new"),
        F.sum(F.col("missing_after_march").cast("int") + F.col("missing_after_april").cast("int")).alias("gone"),
        F.sum(F.col("appeared_in_march").cast("int")).alias("first"),
        F.sum(F.col("appeared_in_may").cast("int")).alias("last"),
    ).first()
    assert s["new"] - s["gone"] == s["last"] - s["first"]


def test_fused_equals_two_step(spark):
    snap = spark.createDataFrame(_rows(), COLS).select(
        "voter_id", "extract_month", "source_file",
        F.lit("").alias("_line"),
        *[F.col(k).alias(v) for k, v in R.ROLES.items()],
        "birth_date", "registration_date", "gender", "race",
    )
    fused = P.build_panel_wide(snap, R.SPEC)
    two = P.pivot_panel(P.dedupe_snapshot(snap, R.SPEC), R.SPEC).select(*fused.columns)
    assert sorted(map(tuple, fused.collect())) == sorted(map(tuple, two.collect()))


def test_panel_independent_of_row_order_and_partitioning(spark):
    import random

    rows = _rows()  # includes in-period duplicates with different values
    shuffled = rows[:]
    random.Random(7).shuffle(shuffled)
    a = R.voter_changes(spark.createDataFrame(rows, COLS).coalesce(1))
    b = R.voter_changes(spark.createDataFrame(shuffled, COLS).repartition(7))
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
