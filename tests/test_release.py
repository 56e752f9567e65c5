"""Release run: materialized intermediates give the same exports as the raw plans."""

from wavepanel.plans import commerce as C
from wavepanel.plans.registry import load_all
from wavepanel.plans.release import publish_exports

SF = "/root/testdata/sf0.001"


def test_publish_exports(spark, tmp_path):
    reg = load_all()
    names = ["e04_voter_movement_summary", "e11_movers_income_direction", "e23_vh_voter_consistency", "e15_zip_pressure_metrics"]
    expected = {n: sorted(map(tuple, reg[n][0](spark, SF).collect())) for n in names}
    C.clear_plans()
    counts = publish_exports(spark, SF, str(tmp_path / "out"), names)
    for n in names:
        assert counts[n] == len(expected[n])
        back = spark.read.option("header", True).csv(str(tmp_path / "out" / n.split("_", 1)[1]))
        assert back.count() == len(expected[n])
    d = spark.read.option("header", True).csv(str(tmp_path / "out" / "data_dictionary"))
    rows = {r["file"]: r["description"] for r in d.collect()}
    assert set(rows) == {n.split("_", 1)[1] for n in names} and all(rows.values())


def test_bucketed_panel_is_not_shuffled(spark):
    """Events pre-aggregated per (entity, cell) join the entity-bucketed panel.

    The event side shuffles partially aggregated rows by (entity, cell) and
    then the (small) aggregated cells by entity; the bucketed panel side is
    never shuffled."""
    from wavepanel.operators import events as EV
    from wavepanel.plans.release import drop_run, materialize_core

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        run = materialize_core(spark, SF)
        cells = EV.entity_cells(C.labelled_events(spark, SF), C.panel(spark, SF), ["method_bucket"], ["party_last_known"])
        plan = cells._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan
        assert "partial_sum" in plan  # map-side pre-aggregation before the first exchange
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        C.clear_plans()
        drop_run(spark, f"wavepanel-{run}", ["panel"])
        assert not spark.catalog.tableExists(f"wp_wavepanel_{run}_panel")


def test_register_views_for_sql(spark):
    from wavepanel.plans.release import register_views

    names = register_views(spark, SF)
    assert "voter_changes" in names
    n = spark.sql("SELECT COUNT(*) FROM voter_changes").first()[0]
    assert n == C.panel(spark, SF).count()
    m = spark.sql("SELECT income_direction, COUNT(*) AS movers FROM movers_long GROUP BY 1").count()
    assert m >= 1
