"""Event labelling and cohorts on the edge rows of the fixture list."""

import datetime as dt

from pyspark.sql import functions as F

from wavepanel.operators import areas as A
from wavepanel.operators import events as EV

COLS = "county_code string, entity_id string, election_date date, election_type string, history_code string"


def test_codes_buckets_and_null_dates(spark):
    d = dt.date(2020, 11, 3)
    ev = spark.createDataFrame(
        [("ALA", "1", d, "GEN", "A"), ("ALA", "1", d, "GEN", "A"), ("ALA", "1", d, "XYZ", "Q"), ("ALA", "1", d, None, None), ("ALA", "1", None, "GEN", "Y")],
        COLS,
    )
    got = EV.label_events(ev).collect()
    assert len(got) == 4  # NULL date dropped, duplicates kept
    unk = [r for r in got if r["history_code"] in ("Q", None)]
    assert {r["method_label"] for r in unk} == {"9 Unknown"} and {r["method_bucket"] for r in unk} == {"other"}
    assert {r["counted_vote"] for r in unk} == {0}
    assert {r["election_type_label"] for r in got if r["election_type"] in ("XYZ", None)} == {"9 Unknown"}


def test_consistency_bucket_over_five_is_null(spark):
    rows = [("ALA", "1", dt.date(y, 11, 1), "GEN", "Y") for y in (2016, 2018, 2020, 2022, 2024)] + [("ALA", "1", dt.date(2020, 11, 5), "GEN", "E")]
    rows += [("ALA", "2", dt.date(2019, 3, 1), "PRI", "Y")]
    lab = EV.label_events(spark.createDataFrame(rows, COLS))
    per = {r["entity_id"]: r for r in EV.per_entity_cycle_votes(lab, (2016, 2018, 2020, 2022, 2024)).withColumn("b", EV.consistency_bucket()).collect()}
    assert per["1"]["general_votes"] == 6 and per["1"]["b"] is None  # no ELSE: kept as NULL
    assert "2" not in per  # prefilter: no row in the cycle years
    all_rows = {r["entity_id"]: r for r in EV.per_entity_cycle_votes(lab, (2016, 2018, 2020, 2022, 2024), prefilter=False).collect()}
    assert all_rows["2"]["general_votes"] == 0


def test_era_boundary(spark):
    ev = spark.createDataFrame([("A", "1", dt.date(2020, 11, 2), "GEN", "Y"), ("A", "1", dt.date(2020, 11, 3), "GEN", "Y")], COLS)
    era = F.when(F.col("election_date") < F.lit("2020-11-03").cast("date"), "pre").otherwise("post")
    assert [r[0] for r in EV.label_events(ev).orderBy("election_date").select(era).collect()] == ["pre", "post"]


def test_missing_december_and_zero_values(spark):
    cpi = spark.createDataFrame([("2020-12", 260.0), ("2021-11", 270.0), ("2022-12", 0.5)], "year_month string, cpi_value double")
    assert A.missing_december(A.deflators(cpi, "2026-05"), [2020, 2021, 2022]) == [2021]
    months = [dt.date(2000 + (m - 1) // 12, (m - 1) % 12 + 1, 1) for m in range(1, 14)]
    long = spark.createDataFrame([("00001", d, 0.0 if i == 0 else 5.0) for i, d in enumerate(months)], "zip_code string, month_date date, typical_home_value double")
    last = A.area_series(long).orderBy("month_date").collect()[-1]
    assert last["hv_1y_ago"] == 0.0 and last["home_value_yoy_change"] is None  # NULLIF(0): no infinity, no error


def test_salted_enrich_equals_plain_join_with_a_hot_entity(spark):
    from wavepanel.plans import commerce as C

    sf = "/root/testdata/sf0.001"
    ev = C.events(spark, sf)
    # make one entity hold about a third of all events
    hot = ev.limit(1).select("entity_id").first()[0]
    skewed = ev.unionByName(ev.withColumn("entity_id", F.lit(hot)))
    panel = C.panel(spark, sf)
    cols = ["party_last_known", "age_band", "race", "county_last_known"]
    plain = EV.attach_entity(EV.label_events(skewed), panel, "entity_id", cols)
    salted = EV.enrich_events(skewed, panel)
    assert salted.columns == plain.columns
    a = sorted(map(tuple, plain.collect()), key=repr)
    b = sorted(map(tuple, salted.collect()), key=repr)
    assert a == b
    plan = salted._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan
    # the same holds against a materialised panel, as a release has it
    copy = panel.select("entity_id", *cols).checkpoint()
    assert "_salt" in EV.enrich_events(skewed, copy)._jdf.queryExecution().executedPlan().toString()


def test_salting_spreads_exact_copies(spark):
    from wavepanel.operators.events import salted_attach

    df = spark.createDataFrame([("hot", "same")] * 400 + [("cold", "x")], "entity_id string, v string").repartition(8)
    panel = spark.createDataFrame([("hot", "DEM"), ("cold", "REP")], "entity_id string, party_last_known string")
    out = salted_attach(df, panel, "entity_id", ["party_last_known"], salts=8)
    assert out.count() == 401 and out.filter("party_last_known IS NULL").count() == 0
    # the hot entity's identical rows do not all share one salt
    salted = df.withColumn("_s", F.pmod(F.xxhash64("entity_id", "v", F.spark_partition_id()), F.lit(8)))
    assert salted.filter("entity_id = 'hot'").select("_s").distinct().count() > 1
