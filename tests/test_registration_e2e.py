"""Registration preset end to end on files in the extract formats."""

import json

from pyspark.sql import functions as F

from wavepanel.operators import areas as A
from wavepanel.operators import events as EV
from wavepanel.plans import registration as R
from wavepanel.sources import external as X
from wavepanel.sources import text as TX

IDX = {n: i for i, n in enumerate(TX.SNAPSHOT_FIELDS)}


def vrow(county, vid, zip_, party, status="ACT", birth="01/15/1980", race="5"):
    r = [""] * len(TX.SNAPSHOT_FIELDS)
    for k, v in dict(county_code=county, voter_id=vid, residence_zipcode=zip_, party_affiliation=party, voter_status=status,
                     birth_date=birth, registration_date="03/01/2000", gender="F", race=race).items():
        r[IDX[k]] = v
    return "\t".join(r)


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def test_registration_chain(spark, tmp_path):
    ex = tmp_path / "extracted"
    write(ex / "20260310/detail/ALA_20260310.txt", [vrow("ALA", "1", "32601", "DEM"), vrow("ALA", "2", "32601", "REP"), vrow("ALA", "3", "32601", "NPA")])
    apr = ex / "20260414/detail/20260414_VoterDetail"
    write(apr / "ALA_20260414.txt", [vrow("ALA", "1", "32605", "DEM"), vrow("ALA", "2", "32601", "DEM"), "short\trow"])
    write(apr / "VerificationFiles/ALA_verify.txt", [vrow("ALA", "9", "32601", "DEM")])
    write(ex / "20260512/detail/ALA_20260512.txt", [vrow("ALA", "1", "32605-1234", "DEM"), vrow("ALA", "2", "32601", "DEM"), vrow("ALA", "4", "32605", "REP")])
    globs = {
        "2026-03": str(ex / "20260310/detail/*.txt"),
        "2026-04": str(apr / "*.txt"),
        "2026-05": str(ex / "20260512/detail/*.txt"),
    }
    rows, bad = R.read_month_snapshots(spark, globs)
    assert rows.filter(F.col("voter_id") == "9").count() == 0  # sibling folder not read
    assert bad.count() == 1
    panel = R.voter_changes(rows)
    p = {r["voter_id"]: r for r in panel.collect()}
    assert p["1"]["zip_changed_mar_apr"] and p["1"]["zip_changed_apr_may"]  # ZIP+4 rewrite counts as a move
    assert p["2"]["party_changed_mar_apr"] and not p["2"]["party_changed_apr_may"]
    assert p["3"]["missing_after_march"] and p["4"]["new_in_may"] and p["4"]["new_in_may_only"]

    # price index: no May 2026 -> base falls back to the latest month
    cpi_doc = {"Results": {"series": [{"data": [
        {"year": "2020", "period": "M12", "value": "260.0"}, {"year": "2021", "period": "M12", "value": "280.0"},
        {"year": "2022", "period": "M12", "value": "300.0"}, {"year": "2022", "period": "M13", "value": "290.0"},
        {"year": "2026", "period": "M04", "value": "330.0"}, {"year": "2026", "period": "M05", "value": "-"}]}]}}
    (tmp_path / "cpi.json").write_text(json.dumps(cpi_doc, indent=1))
    cpi = A.deflators(X.read_cpi(spark, str(tmp_path / "cpi.json")), R.BASE_MONTH)
    assert {r["base_month"] for r in cpi.collect()} == {"2026-04"}

    paths = {}
    for y, scale in ((2020, 1.0), (2021, 1.1), (2022, 1.2)):
        f = tmp_path / f"irs_{y}.csv"
        f.write_text("STATE,zipcode,agi_stub,N1,A00100\n" + "\n".join([
            f"FL,32601,1,100,{int(4000 * scale)}", f"FL,32601,2,100,{int(6000 * scale)}",
            f"FL,32605,1,50,{int(9000 * scale)}", "FL,0,1,999,999", "FL,00000,1,999,999", "GA,30301,1,10,10"]) + "\n")
        paths[y] = str(f)
    income = A.area_income(X.read_income_brackets(spark, paths), cpi, R.INCOME)
    inc22 = {r["zip_code"]: r for r in income.filter("tax_year = 2022").collect()}
    assert set(inc22) == {"32601", "32605"}
    assert inc22["32601"]["mean_agi_per_return"] == 60000.0
    assert abs(inc22["32601"]["real_mean_agi"] - 60000.0 * 330.0 / 300.0) < 1e-6

    months = ["2000-01-31", "2021-04-30", "2025-04-30", "2026-04-30"]
    z = tmp_path / "zhvi.csv"
    z.write_text("RegionName,City,State,CountyName,Metro," + ",".join(months) + "\n"
                 "32601,Gainesville,FL,Alachua County,Gainesville,100000,300000,380000,400000\n"
                 "32605,Gainesville,FL,Alachua County,Gainesville,,150000,190000,200000\n"
                 "30301,Atlanta,GA,Fulton County,Atlanta,1,1,1,1\n")
    long = X.read_wide_series(spark, str(z), ["RegionName", "City", "CountyName", "Metro"], state="FL")
    long = long.select(F.lpad("RegionName", 5, "0").alias("zip_code"), F.col("City").alias("city"), F.col("CountyName").alias("county"),
                       F.col("Metro").alias("metro"), "month_date", "typical_home_value")
    series = A.area_series(long)
    assert series.count() == 7  # empty cell dropped, other state dropped
    afford = A.affordability(income, series, 2022, 2020)
    assert afford.count() == 2
    press = {r["zip_code"]: r for r in A.area_pressure(series, income, R.PRESSURE).collect()}
    assert press["32601"]["first_month"] == "2000-01" and press["32605"]["first_month"] == "2021-04"  # first available
    assert press["32601"]["hv_growth_since_first"] == 3.0 and press["32601"]["hv_growth_25yr_band"] == "3 250-350%"
    assert abs(press["32601"]["hv_growth_5yr"] - (400000 / 300000 - 1)) < 1e-12

    mv = R.movers(panel, income, afford).collect()
    m1 = [r for r in mv if r["voter_id"] == "1" and r["window"] == "2026-03 -> 2026-04"][0]
    # 32601 mean 60,000 -> 32605 mean 216,000: up
    assert m1["income_direction"] == "up (>=+15%)" and m1["crossed_county"] is False
    m2 = [r for r in mv if r["voter_id"] == "1" and r["window"] == "2026-04 -> 2026-05"][0]
    assert m2["income_direction"] == "unknown"  # ZIP+4 destination has no area data

    write(ex / "20260512/history/ALA_H.txt", [
        "ALA\t1\t11/08/2016\tGEN\tA", "ALA\t1\t11/03/2020\tGEN\tE", "ALA\t2\t11/03/2020\tGEN\tY",
        "ALA\t2\t11/03/20\tGEN\tY", "ALA\t7\t11/08/2022\tGEN\tB", "bad"])
    ev, ev_bad = TX.read_events(spark, str(ex / "20260512/history/*.txt"))
    assert ev_bad.count() == 1 and ev.filter(F.col("election_date").isNull()).count() == 1  # two-digit year
    enriched = EV.enrich_events(ev, panel, EV.EventSpec(entity="voter_id"))
    assert enriched.count() == 4
    got = {(r["voter_id"], r["method_bucket"], r["counted_vote"]) for r in enriched.collect()}
    assert ("1", "mail", 1) in got and ("7", "mail", 0) in got
    assert enriched.filter("voter_id = '7'").first()["party_last_known"] is None  # not in panel


def _fixture_sources(tmp_path):
    ex = tmp_path / "x"
    rows = {
        "20260310": [vrow("ALA", str(i), "32601", ["DEM", "REP", "NPA"][i % 3], birth=f"01/15/{1950 + i % 50}", race=str(1 + i % 7)) for i in range(40)],
        "20260414": [vrow("ALA", str(i), "32605" if i % 4 == 0 else "32601", ["DEM", "REP", "NPA", "LPF"][i % 4], status="INA" if i % 5 == 0 else "ACT") for i in range(2, 40)],
        "20260512": [vrow("BAY" if i % 6 == 0 else "ALA", str(i), "32605" if i % 4 == 0 else "32601", ["DEM", "REP", "NPA"][i % 3]) for i in range(3, 45)],
    }
    for day, lines in rows.items():
        write(ex / day / "detail" / f"ALA_{day}.txt", lines)
    write(ex / "history" / "h.txt", [f"ALA\t{i}\t11/0{3 + i % 5}/{2016 + 2 * (i % 5)}\tGEN\t{'AEYBN'[i % 5]}" for i in range(45)])
    cpi = {"Results": {"series": [{"data": [{"year": str(y), "period": "M12", "value": str(250.0 + y - 2020)} for y in (2020, 2021, 2022)]
                                  + [{"year": "2026", "period": "M05", "value": "320.0"}]}]}}
    (tmp_path / "cpi.json").write_text(json.dumps(cpi))
    inc = {}
    for y in (2020, 2021, 2022):
        f = tmp_path / f"irs{y}.csv"
        f.write_text("STATE,zipcode,N1,A00100\nFL,32601,100,5000\nFL,32605,100,9000\n")
        inc[y] = str(f)
    z = tmp_path / "z.csv"
    z.write_text("RegionName,City,State,CountyName,Metro,2000-01-31,2021-04-30,2026-04-30\n"
                 "32601,Gainesville,FL,Alachua County,Gainesville,100000,300000,400000\n"
                 "32605,Gainesville,FL,Alachua County,Gainesville,90000,150000,330000\n")
    return R.Sources(
        snapshots=(("2026-03", str(ex / "20260310/detail/*.txt")), ("2026-04", str(ex / "20260414/detail/*.txt")), ("2026-05", str(ex / "20260512/detail/*.txt"))),
        events=str(ex / "history/*.txt"),
        cpi=str(tmp_path / "cpi.json"),
        income=tuple(sorted(inc.items())),
        home_values=str(z),
    )


def test_published_exports_on_extracts(spark, tmp_path):
    out = R.published_exports(spark, _fixture_sources(tmp_path))
    assert len(out) == 26
    results = {n: df.collect() for n, df in out.items()}
    assert out["e05"].columns == ["age_band", "party_affiliation", "voters", "new_registrations", "departures", "zip_changes", "county_changes", "party_changes", "status_changes"]
    assert out["e10"].columns == [
        "voters_march", "voters_april", "voters_may", "active_voters_may", "dem_may", "rep_may", "npa_may", "other_party_may",
        "new_in_april", "new_in_may", "missing_after_march", "missing_after_april",
        "zip_changes_mar_apr", "zip_changes_apr_may", "county_changes_mar_apr", "county_changes_apr_may", "party_changes_mar_apr", "party_changes_apr_may",
    ]
    kpi = results["e10"][0]
    assert (kpi["voters_march"], kpi["voters_april"], kpi["voters_may"]) == (40, 38, 42)
    assert kpi["new_in_may"] - kpi["missing_after_april"] + kpi["new_in_april"] - kpi["missing_after_march"] == 42 - 40
    assert out["e11"].columns == ["income_direction", "race_label", "party_after", "movers", "movers_who_also_changed_party", "crossed_county"]
    assert out["e20"].columns == ["election_year", "party", "method_bucket", "counted_votes"]
    assert sum(r["voters"] for r in results["e05"]) == 45  # every voter once
    # suppression at the registration floor of 10
    assert all(r["voters"] >= 10 for r in results["e08"]) and all(r["counted_votes"] >= 10 for r in results["e26"])


def test_headlines_and_profiles_on_extracts(spark, tmp_path):
    out = R.headline_queries(spark, _fixture_sources(tmp_path))
    assert len(out) == 24
    got = {n: df.collect() for n, df in out.items()}
    assert got["q02"][0]["rows"] == 40 and got["q07"]  # rows of the first extract; presence patterns
    assert set(out["q07"].columns) >= {"appeared_in_march", "appeared_in_april", "appeared_in_may"}
    assert out["q08"].columns[:2] == ["new_in_april", "new_in_may"]
    assert {r["party"] for r in got["h12"]} <= {"DEM", "REP", "NPA"}


def test_report_measures_on_extracts(spark, tmp_path):
    out = R.report_measures(spark, _fixture_sources(tmp_path))
    assert len(out) >= 29
    got = {n: df.collect() for n, df in out.items()}
    assert out["d12"].columns == ["boomerangs", "single_mar", "single_apr", "single_may", "present_all"]
    assert {r["window"] for r in got["d09"]} == {"2026-03 -> 2026-04", "2026-04 -> 2026-05"}
    assert {r["days"] for r in got["d09"]} == {35, 28}  # gaps between extract dates
    assert "share_dem" in out["d15b"].columns and "n_other" in out["d15b"].columns
    assert sum(r["entities"] for r in got["d08"]) == 45


def test_release_on_extracts(spark, tmp_path):
    from wavepanel.plans import memo
    from wavepanel.plans.release import publish_exports

    src = _fixture_sources(tmp_path)
    expected = {n: df.count() for n, df in R.published_exports(spark, src).items()}
    memo.clear_plans()
    counts = publish_exports(spark, src, str(tmp_path / "out"), P=R)
    assert counts.pop("rejected_lines") == R.quarantine(spark, src).count()
    assert {n.split("_")[0]: c for n, c in counts.items()} == expected


def test_dedupe_does_not_depend_on_the_order_of_rows(spark):
    """Rows of one file that differ in birth date only: the same one is kept however they are dealt."""
    cols = ["county_code", "voter_id", "residence_zipcode", "party_affiliation", "voter_status", "birth_date", "registration_date", "gender", "race", "extract_month", "source_file"]
    rows = [("ALA", "1", "32601", "DEM", "ACT", f"0{d}/01/1980", "01/01/2000", "F", "5", "2026-03", "a.txt") for d in range(1, 8)]
    kept = set()
    for order in (rows, rows[::-1]):
        for n in (1, 5):
            df = spark.createDataFrame(order, ", ".join(f"{c} string" for c in cols)).repartition(n)
            kept.add(str(R.voter_changes(df).first()["birth_date_parsed"]))
    assert kept == {"1980-01-01"}


def test_missing_december_stops_the_build(spark, tmp_path):
    import dataclasses
    import json

    import pytest

    src = _fixture_sources(tmp_path)
    doc = {"Results": {"series": [{"data": [{"year": "2026", "period": "M05", "value": "320.0"}]}]}}
    (tmp_path / "short.json").write_text(json.dumps(doc))
    with pytest.raises(ValueError, match="December"):
        R.zip_income(spark, dataclasses.replace(src, cpi=str(tmp_path / "short.json")))


def test_release_prunes_periods(spark, tmp_path):
    from pyspark.sql import functions as F

    from wavepanel.plans import memo
    from wavepanel.plans.release import materialize_core

    src = _fixture_sources(tmp_path)
    try:
        materialize_core(spark, src, P=R)
        rows = R.snapshot(spark, src, with_static=False).filter(F.col("extract_month") == "2026-05")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(extract_month" in plan and "2026-05" in plan
        assert rows.count() == 42
    finally:
        memo.clear_plans()


def test_flagship_on_extracts_matches_duckdb(spark, tmp_path):
    """E4 on the extract files, recomputed independently in DuckDB from the raw TSV."""
    import duckdb

    src = _fixture_sources(tmp_path)
    spark_rows = sorted(map(tuple, R.published_exports(spark, src)["e04"].collect()), key=repr)

    months = [p.label for p in R.PERIODS]
    sfx = [p.short for p in R.PERIODS]
    longs = [p.long for p in R.PERIODS]
    idx = {n: i for i, n in enumerate(TX.SNAPSHOT_FIELDS)}
    reads = " UNION ALL ".join(
        f"SELECT '{m}' AS m, column{idx['voter_id']:02d} AS voter_id, column{idx['county_code']:02d} AS county, "
        f"column{idx['residence_zipcode']:02d} AS zip, column{idx['party_affiliation']:02d} AS party, column{idx['voter_status']:02d} AS status, filename "
        f"FROM read_csv('{glob}', delim='\\t', header=false, quote='', escape='', all_varchar=true, filename=true, auto_detect=false, "
        f"columns={{{', '.join(repr(f'column{i:02d}') + ': ' + repr('VARCHAR') for i in range(len(TX.SNAPSHOT_FIELDS)))}}})"
        for m, glob in src.snapshots
    )
    attrs = ["county", "zip", "party", "status"]
    pv = ", ".join(f"MAX(CASE WHEN m = '{m}' THEN {a} END) AS {a}_{s}" for a in attrs for m, s in zip(months, sfx))
    w = list(zip(range(len(sfx) - 1), range(1, len(sfx))))
    flags = [f"(county_{sfx[i]} IS NULL AND county_{sfx[j]} IS NOT NULL) AS new_in_{longs[j]}" for i, j in w]
    flags += [f"(county_{sfx[i]} IS NOT NULL AND county_{sfx[j]} IS NULL) AS missing_after_{longs[i]}" for i, j in w]
    names = [f"new_in_{longs[j]}" for i, j in w] + [f"missing_after_{longs[i]}" for i, j in w]
    for a in ("zip", "county", "party", "status"):
        for i, j in w:
            n = f"{a}_changed_{sfx[i]}_{sfx[j]}"
            flags.append(f"({a}_{sfx[i]} IS DISTINCT FROM {a}_{sfx[j]} AND {a}_{sfx[i]} IS NOT NULL AND {a}_{sfx[j]} IS NOT NULL) AS {n}")
            names.append(n)
    q = (
        f"WITH raw AS ({reads}), "
        "dedup AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY m, voter_id ORDER BY filename, county, zip, party, status) AS rn FROM raw) t WHERE rn = 1), "
        f"pv AS (SELECT voter_id, {pv} FROM dedup GROUP BY voter_id), "
        f"fl AS (SELECT *, COALESCE(county_{sfx[2]}, county_{sfx[1]}, county_{sfx[0]}) AS ck, COALESCE(party_{sfx[2]}, party_{sfx[1]}, party_{sfx[0]}) AS pk, "
        + ", ".join(flags)
        + " FROM pv) "
        "SELECT ck AS county_code, pk AS party_affiliation, COUNT(*) AS voters, "
        + ", ".join(f"CAST(SUM(CAST({n} AS INT)) AS BIGINT) AS {n}" for n in names)
        + " FROM fl WHERE ck IS NOT NULL GROUP BY 1, 2"
    )
    duck_rows = sorted(map(tuple, duckdb.connect().execute(q).fetchall()), key=repr)
    assert spark_rows == duck_rows


def test_age_and_kpi_exports_on_extracts_match_duckdb(spark, tmp_path):
    """E5 (ages from raw date strings) and E10 (KPIs over raw rows), recomputed in DuckDB."""
    import duckdb

    src = _fixture_sources(tmp_path)
    out = R.published_exports(spark, src)
    idx = {n: i for i, n in enumerate(TX.SNAPSHOT_FIELDS)}
    cols = "{" + ", ".join(repr(f"column{i:02d}") + ": 'VARCHAR'" for i in range(len(TX.SNAPSHOT_FIELDS))) + "}"
    c = lambda n: f"column{idx[n]:02d}"
    reads = " UNION ALL ".join(
        f"SELECT '{m}' AS m, {c('voter_id')} AS voter_id, {c('county_code')} AS county, {c('party_affiliation')} AS party, "
        f"{c('voter_status')} AS status, {c('birth_date')} AS birth, filename FROM read_csv('{g}', delim='\\t', header=false, quote='', "
        f"escape='', filename=true, auto_detect=false, columns={cols})"
        for m, g in src.snapshots
    )
    band = "CASE WHEN age IS NULL THEN 'unknown' " + " ".join(f"WHEN age < {u} THEN '{lab}'" for u, lab in R.AGE_CUTS) + " ELSE 'unknown' END"
    con = duckdb.connect()
    base = (
        f"WITH raw AS ({reads}), dedup AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY m, voter_id ORDER BY filename) rn FROM raw) t WHERE rn = 1), "
        "pv AS (SELECT voter_id, MAX(CASE WHEN m='2026-03' THEN county END) c1, MAX(CASE WHEN m='2026-04' THEN county END) c2, "
        "MAX(CASE WHEN m='2026-05' THEN county END) c3, MAX(CASE WHEN m='2026-03' THEN party END) p1, MAX(CASE WHEN m='2026-04' THEN party END) p2, "
        "MAX(CASE WHEN m='2026-05' THEN party END) p3, MAX(birth) birth FROM dedup GROUP BY voter_id), "
        "ag AS (SELECT *, CAST(date_diff('year', CAST(TRY_STRPTIME(birth, '%m/%d/%Y') AS DATE), DATE '2026-05-01') AS INTEGER) AS age FROM pv) "
    )
    e5 = con.execute(
        base + f"SELECT {band} AS age_band, COALESCE(p3, p2, p1) AS party_affiliation, COUNT(*) AS voters, "
        "CAST(SUM(CAST(c1 IS NULL AND c2 IS NOT NULL AS INT) + CAST(c2 IS NULL AND c3 IS NOT NULL AS INT)) AS BIGINT) AS new_registrations, "
        "CAST(SUM(CAST(c1 IS NOT NULL AND c2 IS NULL AS INT) + CAST(c2 IS NOT NULL AND c3 IS NULL AS INT)) AS BIGINT) AS departures "
        "FROM ag GROUP BY 1, 2"
    ).fetchall()
    got5 = out["e05"].select("age_band", "party_affiliation", "voters", "new_registrations", "departures").collect()
    assert sorted(map(tuple, got5), key=repr) == sorted(map(tuple, e5), key=repr)
    e10 = con.execute(
        f"WITH raw AS ({reads}) SELECT "
        "COUNT(*) FILTER (WHERE m='2026-03'), COUNT(*) FILTER (WHERE m='2026-04'), COUNT(*) FILTER (WHERE m='2026-05'), "
        "COUNT(*) FILTER (WHERE m='2026-05' AND status='ACT'), COUNT(*) FILTER (WHERE m='2026-05' AND party='DEM'), "
        "COUNT(*) FILTER (WHERE m='2026-05' AND party NOT IN ('DEM','REP','NPA')) FROM raw"
    ).fetchone()
    k = out["e10"].first()
    assert (k["voters_march"], k["voters_april"], k["voters_may"], k["active_voters_may"], k["dem_may"], k["other_party_may"]) == tuple(e10)


def test_release_entry_point(spark, tmp_path):
    from wavepanel.__main__ import main

    src = _fixture_sources(tmp_path)
    argv = ["release", *[a for m, g in src.snapshots for a in ("--snapshot", f"{m}={g}")], "--events", src.events, "--cpi", src.cpi,
            *[a for y, p in src.income for a in ("--income", f"{y}={p}")], "--home-values", src.home_values, "--out", str(tmp_path / "pub")]
    counts = main(argv, spark)
    assert len(counts) == 27 and (tmp_path / "pub" / "data_dictionary").exists()
    assert spark.read.parquet(str(tmp_path / "pub" / "rejected_lines")).count() == counts["rejected_lines"]


def test_vote_method_export_on_extracts_matches_duckdb(spark, tmp_path):
    """E20 on the extract files: events parsed from raw TSV, party from the panel, floor 10."""
    import duckdb

    import dataclasses

    src = _fixture_sources(tmp_path)
    # denser history: every voter votes in three elections per cycle year, one per method
    lines = [
        f"ALA\t{i}\t11/0{3 + k}/{y}\t{t}\t{'AEY'[(i + k) % 3]}"
        for i in range(45) for y in (2016, 2018, 2020, 2022, 2024) for k, t in enumerate(("GEN", "PRI", "PPP"))
    ]
    write(tmp_path / "dense" / "h.txt", lines)
    src = dataclasses.replace(src, events=str(tmp_path / "dense" / "*.txt"))
    got = sorted(map(tuple, R.published_exports(spark, src)["e20"].collect()), key=repr)
    assert len(got) >= 10  # cells above the floor exist
    idx = {n: i for i, n in enumerate(TX.SNAPSHOT_FIELDS)}
    cols = "{" + ", ".join(repr(f"column{i:02d}") + ": 'VARCHAR'" for i in range(len(TX.SNAPSHOT_FIELDS))) + "}"
    snaps = " UNION ALL ".join(
        f"SELECT '{m}' AS m, column{idx['voter_id']:02d} AS voter_id, column{idx['county_code']:02d} AS county, "
        f"column{idx['party_affiliation']:02d} AS party, filename FROM read_csv('{g}', delim='\\t', header=false, quote='', escape='', "
        f"filename=true, auto_detect=false, columns={cols})"
        for m, g in src.snapshots
    )
    q = (
        f"WITH raw AS ({snaps}), dedup AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY m, voter_id ORDER BY filename) rn FROM raw) t WHERE rn = 1), "
        "pv AS (SELECT voter_id, COALESCE(MAX(CASE WHEN m='2026-05' THEN party END), MAX(CASE WHEN m='2026-04' THEN party END), "
        "MAX(CASE WHEN m='2026-03' THEN party END)) AS party FROM dedup GROUP BY voter_id), "
        f"ev AS (SELECT c1 AS voter_id, CAST(TRY_STRPTIME(c2, '%m/%d/%Y') AS DATE) AS d, c4 AS code FROM read_csv('{src.events}', delim='\\t', "
        "header=false, quote='', escape='', auto_detect=false, columns={'c0': 'VARCHAR', 'c1': 'VARCHAR', 'c2': 'VARCHAR', 'c3': 'VARCHAR', 'c4': 'VARCHAR'})) "
        "SELECT CAST(year(ev.d) AS BIGINT) AS election_year, pv.party, CASE WHEN code IN ('A','L','B') THEN 'mail' WHEN code = 'E' THEN 'early' "
        "WHEN code = 'Y' THEN 'polls' ELSE 'other' END AS method_bucket, COUNT(*) AS counted_votes "
        "FROM ev LEFT JOIN pv ON ev.voter_id = pv.voter_id WHERE ev.d IS NOT NULL AND code IN ('A','E','Y') AND pv.party IS NOT NULL "
        "AND year(ev.d) BETWEEN 2016 AND 2026 GROUP BY 1, 2, 3 HAVING COUNT(*) >= 10"
    )
    want = sorted(map(tuple, duckdb.connect().execute(q).fetchall()), key=repr)
    assert got == want
