"""Semantic traps of the survey (T7, T8, T20) pinned down."""

from pyspark.sql import functions as F

from wavepanel.operators import areas as A
from wavepanel.plans import registration as R
from wavepanel.plans.exports import ordered

COLS = "voter_id string, extract_month string, source_file string, county_code string, residence_zipcode string, party_affiliation string, voter_status string, birth_date string, registration_date string, gender string, race string"


def test_published_order_puts_nulls_last(spark):
    df = spark.createDataFrame([(None, 1), ("b", 2), ("a", 3)], "band string, n long")
    assert [r[0] for r in ordered(df, "band").collect()] == ["a", "b", None]


def test_unmatched_area_null_band_vs_unknown(spark):
    panel = spark.createDataFrame([("v1", "32601"), ("v2", "99999"), ("v3", "32605")], "voter_id string, zip_last_known string")
    metrics = spark.createDataFrame([("32601", "3 250-350%"), ("32605", "unknown")], "zip_code string, hv_growth_25yr_band string")
    got = {r["voter_id"]: r["hv_growth_25yr_band"] for r in A.attach_area(panel, metrics).collect()}
    assert got == {"v1": "3 250-350%", "v2": None, "v3": "unknown"}


def test_last_known_per_attribute(spark):
    rows = [
        ("v1", "2026-03", "a.txt", "ALA", "32601", "DEM", "ACT", "", "", "F", "5"),
        ("v1", "2026-05", "a.txt", "ALA", "32605", None, "ACT", "", "", "F", "5"),
    ]
    p = R.voter_changes(spark.createDataFrame(rows, COLS)).first()
    # party from March (May's is NULL), zip from May: the last-known values mix periods
    assert p["party_last_known"] == "DEM" and p["zip_last_known"] == "32605"
