"""Accounting identities of the published cuts as properties on generated panels."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavepanel.operators import measures as M
from wavepanel.plans import registration as R

COLS = "voter_id string, extract_month string, source_file string, county_code string, residence_zipcode string, party_affiliation string, voter_status string, birth_date string, registration_date string, gender string, race string"
MONTHS = [p.label for p in R.PERIODS]

cell = st.one_of(st.none(), st.tuples(st.sampled_from(["ALA", "BAY", None]), st.sampled_from(["32601", "32605"]), st.sampled_from(["DEM", "REP", "NPA", None]), st.sampled_from(["ACT", "INA"])))
entity = st.tuples(cell, cell, cell, st.integers(0, 2))


def _rows(entities):
    rows = []
    for i, (a, b, c, dups) in enumerate(entities):
        for m, v in zip(MONTHS, (a, b, c)):
            if v is None:
                continue
            for k in range(dups + 1):
                county, zip_, party, status = v
                rows.append((f"v{i}", m, f"f{k}.txt", county if k == 0 else "BAY", zip_, party, status, "01/01/1980", "01/01/2000", "F", "5"))
    return rows


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(entity, min_size=1, max_size=25))
def test_identities(spark, entities):
    rows = _rows(entities)
    if not rows:
        return
    panel = R.voter_changes(spark.createDataFrame(rows, COLS))
    s = panel.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("new_in_april").cast("int") + F.col("new_in_may").cast("int")).alias("new"),
        F.sum(F.col("missing_after_march").cast("int") + F.col("missing_after_april").cast("int")).alias("gone"),
        F.sum(F.col("appeared_in_march").cast("int")).alias("first"),
        F.sum(F.col("appeared_in_may").cast("int")).alias("last"),
        F.count_if(F.col("new_in_april") & F.col("new_in_may")).alias("both_new"),
        F.count_if(F.col("missing_after_march") & F.col("missing_after_april")).alias("both_gone"),
    ).first()
    # (3) arrivals minus departures telescope to the change in present entities
    assert s["new"] - s["gone"] == s["last"] - s["first"]
    # new flags exclude each other, as do departure flags
    assert s["both_new"] == 0 and s["both_gone"] == 0
    # (1) every cut by any key sums back to the entity count
    by_age = M.movement_counts(panel, ["age_band", "party_last_known"], {"x": ["new_in_april"]})
    assert by_age.agg(F.sum("voters")).first()[0] == s["n"]
    # (6) suppression only removes cells; (7) shares sum to 100 per group
    kept = M.suppress(by_age, 2)
    assert kept.count() <= by_age.count()
    shares = M.share_within(by_age, ["age_band"], "voters", "pct").groupBy("age_band").agg(F.sum("pct").alias("t")).collect()
    assert all(abs(r["t"] - 100.0) < 1e-9 for r in shares)
