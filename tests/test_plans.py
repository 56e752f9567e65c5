"""Plan-shape assertions: shuffles, broadcasts, pushdown."""

from wavepanel.plans import commerce as C
from wavepanel.plans.registry import load_all

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_panel_single_entity_exchange(spark):
    """Dedupe + pivot + flags plan one hash exchange on the entity key."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        snap = spark.read.parquet(f"{SF}/orders.parquet").selectExpr(
            "'1997-1998' AS extract_month", "o_custkey AS entity_id", "o_orderkey AS order_key", "o_orderstatus AS county",
            "o_orderstatus AS zip", "o_orderpriority AS party", "o_orderstatus AS status", "'01/01/1970' AS birth_date",
            "'01/01/1990' AS registration_date", "'F' AS gender", "'1' AS race",
        )
        from wavepanel.operators.panel import build_panel

        plan = _plan(build_panel(snap, C.SPEC, C.AGES))
        assert plan.count("Exchange hashpartitioning(entity_id") == 1
        assert plan.count("Exchange") == 1
        # a hot entity is collapsed map-side: the partial min_by sits below the exchange
        lines = plan.splitlines()
        ex = next(i for i, l in enumerate(lines) if "Exchange hashpartitioning(entity_id" in l)
        assert any("partial_min_by" in l for l in lines[ex + 1 :])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_area_dims_are_broadcast(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = load_all()["e06_movement_by_affordability"][0](spark, SF)
        df.collect()
        final = load_all()["e07_zip_affordability_export"][0](spark, SF)
        assert "CartesianProduct" not in _plan(final)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_order_and_no_year_is_left_out(spark):
    """Every order is in a period, every order of a customer in a tax year."""
    reg = load_all()
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert reg["e01_county_month_summary"][0](spark, SF).agg({"voter_count": "sum"}).first()[0] == orders
    assert C.snapshot(spark, SF, with_static=False).count() == orders
    brackets = C.income_brackets(spark, SF).where("zipcode <> 0").agg({"N1": "sum"}).first()[0]
    assert C.zip_income(spark, SF).agg({"total_returns": "sum"}).first()[0] == brackets
    events = C.labelled_events(spark, SF)
    y0, y1 = C.EVENT_YEARS
    assert events.where(f"election_year NOT BETWEEN {y0} AND {y1}").count() == 0


def test_area_plans_read_the_lines_twice_at_most(spark):
    """Prices by month and values by area: one scan each, exchanges reused."""
    for name, most in (("c05_deflators", 1), ("c06_area_income", 1), ("c08_affordability", 2), ("e07_zip_affordability_export", 2), ("e15_zip_pressure_metrics", 2)):
        df = load_all()[name][0](spark, SF)
        df.collect()
        final = _plan(df).split("+- == Initial Plan ==")[0]
        scans = [x for x in final.splitlines() if "FileScan parquet" in x and "l_extendedprice" in x]
        assert len(scans) <= most, (name, len(scans))


def test_registry_complete():
    reg = load_all()
    ids = {n.split("_")[0] for n in reg}
    for i in range(1, 27):
        assert f"e{i:02d}" in ids
    for i in range(1, 13):
        assert f"h{i:02d}" in ids and f"q{i:02d}" in ids
    for i in range(1, 26):
        assert f"d{i:02d}" in ids
    assert all(q for _, (_, q) in reg.items())


def test_no_cross_joins_or_python_udfs(spark):
    """No registered query plans a cartesian product, a nested-loop join or a
    Python UDF evaluation (everything stays JVM-side)."""
    bad = {}
    for name, (fn, _) in sorted(load_all().items()):
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        hits = [k for k in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython") if k in plan]
        if hits:
            bad[name] = hits
    assert not bad, bad
