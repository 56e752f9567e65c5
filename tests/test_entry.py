"""Driver contract: entry runs on sf0.001; every query has an oracle."""

import __spark_entry__ as E


def test_entry_and_registry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and df.columns[:3] == ["county_code", "party_affiliation", "voters"]
    q, o = E.queries(), E.oracle_sql()
    own = {n for n in q if n not in E._llm()}
    assert own <= set(o) <= set(q) and len(own) >= 97
    assert all(callable(f) for f in q.values())


def test_results_do_not_depend_on_session_time_zone(spark):
    """Inputs are naive timestamps; no query may shift with the session zone."""
    from wavepanel.plans import memo
    from wavepanel.plans.registry import load_all

    reg = load_all()
    names = ["e01_county_month_summary", "s05_event_lines_parsed", "q06_event_date_range", "c07_area_series"]
    before = {n: sorted(map(tuple, reg[n][0](spark, "/root/testdata/sf0.001").collect()), key=repr) for n in names}
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        memo.clear_plans()
        after = {n: sorted(map(tuple, reg[n][0](spark, "/root/testdata/sf0.001").collect()), key=repr) for n in names}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        memo.clear_plans()
    assert before == after
