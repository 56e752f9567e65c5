"""Append of one period: stored snapshots and the panel brought forward against a rebuild from all extracts."""

from dataclasses import replace

from pyspark.sql import functions as F

from tests.test_registration_e2e import vrow, write
from wavepanel.operators import panel as P
from wavepanel.plans import registration as R
from wavepanel.sources import text as TX
from wavepanel.sources.publish import save_table

M, A, Y = R.PERIODS
SPEC = replace(R.SPEC, order_by=("source_file",))


def extracts(folder):
    write(folder / "mar/a.txt", [vrow("ALA", "1", "32601", "DEM"), vrow("ALA", "2", "32601", "REP"), vrow("BAY", "3", "32401", "NPA"), "short\trow", ""])
    write(folder / "apr/a.txt", [vrow("ALA", "1", "32605", "DEM"), vrow("ALA", "2", "32601", "DEM", birth="01/15/1990"), vrow("ALA", "5", "32601", "DEM")])
    write(folder / "apr/b.txt", [vrow("ALA", "2", "99999", "LPF"), "bad"])
    write(folder / "may/a.txt", [vrow("ALA", "1", "32605-1234", "DEM"), vrow("BAY", "4", "32401", "REP")])
    return {p.label: f"{folder}/{p.short}/*.txt" for p in R.PERIODS}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_two_periods_and_an_append_are_three_rebuilt(spark, tmp_path):
    globs = extracts(tmp_path / "in")
    store = str(tmp_path / "store")
    counts = [TX.append_period(spark, store, p, globs[p]) for p in (M.label, A.label, Y.label)]
    assert counts == [{"rows": 3, "rejected": 2}, {"rows": 4, "rejected": 1}, {"rows": 2, "rejected": 0}]
    all_rows, all_bad = TX.read_snapshots(spark, globs)
    rows, bad = TX.stored_snapshots(spark, store)
    assert rows_of(rows.select(sorted(rows.columns))) == rows_of(all_rows.select(sorted(rows.columns)))
    assert rows_of(bad.select(sorted(bad.columns))) == rows_of(all_bad.select(sorted(bad.columns)))
    # the panel, a period at a time, each on the table written before
    stored = None
    for k, p in enumerate(R.PERIODS):
        table = f"wp_refresh_{k}_{abs(hash(str(tmp_path)))}"
        save_table(R.append_to_panel(stored, rows, p), str(tmp_path / f"panel-{k}"), bucket_by=(4, "voter_id"), name=table)
        stored = spark.table(table)
    want = R.voter_changes(all_rows)
    assert rows_of(R.panel_of_periods(stored, R.PERIODS).select(want.columns)) == rows_of(want)
    two = R.panel_of_periods(stored, (M, A))
    assert two.count() == 5 and "missing_after_march" in two.columns and "county_may" not in two.columns
    # a repeat changes nothing, in the store and in the panel
    before = rows_of(rows)
    assert TX.append_period(spark, store, A.label, globs[A.label]) == counts[1]
    rows = TX.stored_snapshots(spark, store)[0]
    assert rows_of(rows) == before
    assert rows_of(R.panel_of_periods(R.append_to_panel(stored, rows, A), R.PERIODS).select(want.columns)) == rows_of(want)


def test_a_corrected_delivery_replaces_its_period_alone(spark, tmp_path):
    globs = extracts(tmp_path / "in")
    store = str(tmp_path / "store")
    for p in (M.label, A.label):
        TX.append_period(spark, store, p, globs[p])
    rows, _ = TX.stored_snapshots(spark, store)
    stored = R.append_to_panel(R.append_to_panel(None, rows, M), rows, A).checkpoint()
    march = rows_of(rows.filter("extract_month = '2026-03'"))
    write(tmp_path / "in/apr/a.txt", [vrow("ALA", "2", "32608", "DEM")])
    write(tmp_path / "in/apr/b.txt", [vrow("ALA", "6", "32608", "DEM")])
    assert TX.append_period(spark, store, A.label, globs[A.label]) == {"rows": 2, "rejected": 0}
    rows, bad = TX.stored_snapshots(spark, store)
    assert rows_of(rows.filter("extract_month = '2026-03'")) == march
    assert {r["extract_month"] for r in bad.collect()} == {"2026-03"}  # the rejected line of the first delivery went with it
    panel = {r["voter_id"]: r for r in R.panel_of_periods(R.append_to_panel(stored, rows, A), (M, A)).collect()}
    assert set(panel) == {"1", "2", "3", "6"}  # voter 5 was in the first delivery of April only
    assert panel["2"]["zip_apr"] == "32608" and panel["1"]["missing_after_march"] and panel["6"]["new_in_april"]


def test_only_the_new_period_is_read_and_shuffled(spark, tmp_path):
    globs = extracts(tmp_path / "in")
    store = str(tmp_path / "store")
    for p in globs:
        TX.append_period(spark, store, p, globs[p])
    rows, _ = TX.stored_snapshots(spark, store)
    table = f"wp_refresh_plan_{abs(hash(str(tmp_path)))}"
    save_table(R.append_to_panel(R.append_to_panel(None, rows, M), rows, A), str(tmp_path / "panel"), bucket_by=(8, "voter_id"), name=table)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = R.append_to_panel(spark.table(table), rows, Y)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "SortMergeJoin" in plan and "hashpartitioning(_e" not in plan  # the stored side lies as the join needs it
    assert plan.count("Exchange hashpartitioning(voter_id") <= 3  # the new period's rows; those without an id, which are merged apart
    scans = [line for line in plan.splitlines() if "FileScan" in line and "extract_month" in line]
    assert scans and all("2026-05" in s.split("PartitionFilters")[1] and "rejected" in s.split("PartitionFilters")[1] for s in scans)


def test_rows_without_an_id_are_one_entity(spark):
    cols = "voter_id string, extract_month string, source_file string, " + ", ".join(f"{c} string" for c in (*R.ROLES.values(), "birth_date", "registration_date", "gender", "race"))
    line = lambda v, m, zip_: (v, m, "f", *[zip_ for _ in R.ROLES], "01/15/1980", "01/15/2000", "F", "5")
    snap = spark.createDataFrame([line(None, "2026-03", "1"), line("a", "2026-03", "1"), line(None, "2026-04", "2"), line("b", "2026-05", "3")], cols)
    stored = None
    for p in R.PERIODS:
        stored = P.bring_forward(stored, P.period_rows(snap, SPEC, p), SPEC, p)
    want = P.build_panel_wide(snap, SPEC)
    assert rows_of(P.wide_from_periods(stored, SPEC).select(want.columns)) == rows_of(want)


def test_one_parse_of_every_line(spark, tmp_path):
    globs = extracts(tmp_path / "in")
    tagged = TX.read_tagged(spark, globs)
    lines = sum(spark.read.text(g).count() for g in globs.values())
    assert tagged.count() == lines == 12
    assert tagged._jdf.queryExecution().optimizedPlan().toString().count("value#") > 0
    keep = ("extract_month", "source_file")
    good, bad = TX.read_snapshots(spark, globs)
    assert rows_of(TX.good_rows(tagged, TX.SNAPSHOT_FIELDS, keep)) == rows_of(good)
    assert rows_of(TX.rejected_rows(tagged, keep)) == rows_of(bad)
    # a release reads its text once: both frames come from one copy
    src = R.Sources(snapshots=tuple(globs.items()), events="", cpi="", income=(), home_values="")
    assert R.snapshot_rows(spark, src).filter(F.col("extract_month") == "2026-05").count() == 2
    assert R.quarantine(spark, src).count() == 3 and "snapshot_lines" in R.RELEASE_CORE and "quarantine" not in R.RELEASE_CORE
