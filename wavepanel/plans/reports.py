"""Report measures D1-D25: questions the report pages answer from the tables.

All run on the panel, the mover/enriched-event tables or the area tables
with built-in aggregates and windows over small aggregated frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavepanel.functions.scalar import band, decode, pct, safe_div
from wavepanel.operators import events as EV
from wavepanel.operators import measures as M
from wavepanel.operators import transitions as T
from wavepanel.plans import commerce as C
from wavepanel.plans.exports import MAIN_SQL, Flags, ordered
from wavepanel.plans.headlines import general_voters, method_shift
from wavepanel.plans.oracle import RACE_CASE, add_cte, sql
from wavepanel.plans.registry import REGISTRY, register

K = C.MIN_CELL
P1, P2, P3 = C.PERIODS
WINDOWS = C.SPEC.windows()
ACT, INA = C.ACTIVE_STATUS, C.INACTIVE_STATUS


def _wl(a, b) -> str:
    return T.window_label(a, b)


# ----------------------------------------------------------------- D1 / D2 / D3 / D7
def _net_sql(attr: str, name: str) -> str:
    return (
        f"{name} AS (SELECT {attr}, CAST(SUM(f) AS BIGINT) AS n_first, CAST(SUM(l) AS BIGINT) AS n_last, "
        "CAST(SUM(l) - SUM(f) AS BIGINT) AS net_change, 100.0 * CAST(SUM(l) - SUM(f) AS DOUBLE) / NULLIF(SUM(f), 0) AS pct_change "
        f"FROM (SELECT {attr}_p1 AS {attr}, 1 AS f, 0 AS l FROM panel UNION ALL SELECT {attr}_p3, 0, 1 FROM panel) t "
        f"WHERE {attr} IS NOT NULL GROUP BY {attr})"
    )


add_cte("net_county", ("panel",), _net_sql("county", "net_county"))
add_cte("net_zip", ("panel",), _net_sql("zip", "net_zip"))


@register("d01_net_change_by_county", sql("SELECT * FROM net_county", "net_county"))
def d01(spark, d, P=C):
    return ordered(M.net_change(P.panel(spark, d), "county", f"county_{P.PERIODS[0].short}", f"county_{P.PERIODS[-1].short}"), "county")


def net_zip(spark, d, P=C) -> DataFrame:
    return M.net_change(P.panel(spark, d), "zip", f"zip_{P.PERIODS[0].short}", f"zip_{P.PERIODS[-1].short}")


@register(
    "d02_top_bottom_zips_by_net_change",
    sql(
        "SELECT * FROM (SELECT n.*, ROW_NUMBER() OVER (ORDER BY net_change DESC, zip) AS rank, 'top' AS side FROM net_zip n) t WHERE rank <= 10 "
        "UNION ALL SELECT * FROM (SELECT n.*, ROW_NUMBER() OVER (ORDER BY net_change ASC, zip) AS rank, 'bottom' AS side FROM net_zip n) t WHERE rank <= 5",
        "net_zip",
    ),
)
def d02(spark, d, P=C):
    return M.top_bottom(net_zip(spark, d, P), "zip", "net_change", P.TOP_K, P.BOTTOM_K)


@register(
    "d02c_top_bottom_counties_by_net_change",
    sql(
        "SELECT *, 'top' AS side, row_number() OVER (ORDER BY net_change DESC, county) AS rank FROM net_county QUALIFY rank <= 10 "
        "UNION ALL BY NAME SELECT *, 'bottom' AS side, row_number() OVER (ORDER BY net_change, county) AS rank FROM net_county QUALIFY rank <= 5",
        "net_county",
    ),
)
def d02c(spark, d, P=C):
    """The counties that gained most and least."""
    return M.top_bottom(d01(spark, d, P), "county", "net_change", P.TOP_K, P.BOTTOM_K)


@register(
    "d03_outlier_areas",
    sql(
        "SELECT zip, pct_change, ROUND((pct_change - m) / NULLIF(sd, 0), 9) AS z_score, "
        "COALESCE(ABS((pct_change - m) / NULLIF(sd, 0)) >= 1.5, FALSE) AS outlier, "
        "COALESCE(pct_change <= -10.0, FALSE) AS large_loss FROM net_zip "
        "CROSS JOIN (SELECT AVG(pct_change) AS m, STDDEV_SAMP(pct_change) AS sd FROM net_zip) s",
        "net_zip",
    ),
)
def d03(spark, d, P=C):
    return _outliers(net_zip(spark, d, P), "zip", P)


def _outliers(net: DataFrame, key: str, P) -> DataFrame:
    z = M.zscore(net, "pct_change", "_z")
    return z.select(
        key,
        "pct_change",
        F.round("_z", 9).alias("z_score"),
        F.coalesce(F.abs("_z") >= P.OUTLIER_Z, F.lit(False)).alias("outlier"),
        F.coalesce(F.col("pct_change") <= P.LOSS_PCT, F.lit(False)).alias("large_loss"),
    )


@register(
    "d03c_outlier_counties",
    sql(
        "SELECT county, pct_change, round(z, 9) AS z_score, ifnull(abs(z) >= 1.5, false) AS outlier, ifnull(pct_change <= -10, false) AS large_loss FROM "
        "(SELECT *, (pct_change - avg(pct_change) OVER ()) / nullif(stddev_samp(pct_change) OVER (), 0) AS z FROM net_county)",
        "net_county",
    ),
)
def d03c(spark, d, P=C):
    """Counties whose change stands out, or that lost a large share."""
    return _outliers(d01(spark, d, P), "county", P)


@register(
    "d07_tier_growth",
    sql(
        "SELECT tier, COUNT(*) AS areas, CAST(SUM(n_first) AS BIGINT) AS n_first, CAST(SUM(n_last) AS BIGINT) AS n_last, "
        "CAST(SUM(n_last) - SUM(n_first) AS BIGINT) AS net_change, 100.0 * CAST(SUM(n_last) - SUM(n_first) AS DOUBLE) / NULLIF(SUM(n_first), 0) AS pct_change "
        "FROM (SELECT n.*, CASE WHEN share IS NULL THEN 'unknown' WHEN share < 3.8 THEN 'small' WHEN share < 4.2 THEN 'mid' ELSE 'large' END AS tier "
        "FROM (SELECT n.*, 100.0 * CAST(n_first AS DOUBLE) / t.tot AS share FROM net_zip n CROSS JOIN (SELECT SUM(n_first) AS tot FROM net_zip) t) n) x "
        "GROUP BY tier",
        "net_zip",
    ),
)
def d07(spark, d, P=C):
    return _tiers(net_zip(spark, d, P), P.TIER_CUTS)


def _tiers(n: DataFrame, cuts) -> DataFrame:
    tot = n.agg(F.sum("n_first")).scalar()
    tiers = n.withColumn("tier", band(pct("n_first", tot), cuts, "large"))
    out = tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("areas"), F.sum("n_first").alias("n_first"), F.sum("n_last").alias("n_last"))
    out = out.withColumn("net_change", F.col("n_last") - F.col("n_first")).withColumn("pct_change", pct(F.col("n_last") - F.col("n_first"), "n_first"))
    return ordered(out, "tier")


@register(
    "d07c_county_tier_growth",
    sql(
        "SELECT tier, count(*) AS areas, sum(n_first)::BIGINT AS n_first, sum(n_last)::BIGINT AS n_last, (sum(n_last) - sum(n_first))::BIGINT AS net_change, "
        "100.0 * (sum(n_last) - sum(n_first))::DOUBLE / nullif(sum(n_first), 0) AS pct_change FROM (SELECT *, 100.0 * n_first::DOUBLE / sum(n_first) OVER () AS share, "
        "CASE WHEN share IS NULL THEN 'unknown' WHEN share >= 21 THEN 'large' WHEN share >= 19 THEN 'mid' ELSE 'small' END AS tier FROM net_county) GROUP BY tier",
        "net_county",
    ),
)
def d07c(spark, d, P=C):
    """Growth by size tier of the counties."""
    return _tiers(d01(spark, d, P), P.COUNTY_TIER_CUTS)


# ----------------------------------------------------------------- D4 party-share change
@register(
    "d04_party_share_change_by_county",
    sql(
        "SELECT county, party, n_first, n_last, share_first, share_last, share_last - share_first AS change_pp FROM ("
        "SELECT county, party, n_first, n_last, 100.0 * CAST(n_first AS DOUBLE) / NULLIF(tf, 0) AS share_first, "
        "100.0 * CAST(n_last AS DOUBLE) / NULLIF(tl, 0) AS share_last, tf FROM ("
        "SELECT county, party, n_first, n_last, SUM(n_first) OVER (PARTITION BY county) AS tf, SUM(n_last) OVER (PARTITION BY county) AS tl FROM ("
        "SELECT county, party, CAST(SUM(f) AS BIGINT) AS n_first, CAST(SUM(l) AS BIGINT) AS n_last FROM ("
        "SELECT county_p1 AS county, party_p1 AS party, 1 AS f, 0 AS l FROM panel UNION ALL SELECT county_p3, party_p3, 0, 1 FROM panel) u "
        f"WHERE county IS NOT NULL AND party IS NOT NULL GROUP BY 1, 2) c) w) s WHERE tf >= 50",
        "panel",
    ),
)
def d04(spark, d, P=C):
    p = P.panel(spark, d)
    sides = p.select(
        F.explode(
            F.array(
                F.struct(F.col(f"county_{P.PERIODS[0].short}").alias("county"), F.col(f"party_{P.PERIODS[0].short}").alias("party"), F.lit(1).alias("f"), F.lit(0).alias("l")),
                F.struct(F.col(f"county_{P.PERIODS[-1].short}").alias("county"), F.col(f"party_{P.PERIODS[-1].short}").alias("party"), F.lit(0).alias("f"), F.lit(1).alias("l")),
            )
        ).alias("_s")
    ).select("_s.*")
    cells = (
        sides.filter(F.col("county").isNotNull() & F.col("party").isNotNull())
        .groupBy("county", "party")
        .agg(F.sum("f").cast("bigint").alias("n_first"), F.sum("l").cast("bigint").alias("n_last"))
    )
    w = Window.partitionBy("county")
    out = cells.withColumn("_tf", F.sum("n_first").over(w)).withColumn("_tl", F.sum("n_last").over(w))
    out = out.withColumn("share_first", pct("n_first", "_tf")).withColumn("share_last", pct("n_last", "_tl"))
    out = out.filter(F.col("_tf") >= P.MIN_BASE).withColumn("change_pp", F.col("share_last") - F.col("share_first"))
    return ordered(out.drop("_tf", "_tl"), "county", "party")


# ----------------------------------------------------------------- D5 / D6 / D11 flows
def _pairs_sql(attr: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{_wl(a, b)}' AS window, {attr}_{a.short} AS src, {attr}_{b.short} AS dst FROM panel" for a, b in WINDOWS
    )


add_cte(
    "flow_party",
    ("panel",),
    f"flow_party AS (SELECT \"window\", src, dst, COUNT(*) AS entities FROM ({_pairs_sql('party')}) p WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2, 3)",
)
add_cte(
    "flow_status",
    ("panel",),
    f"flow_status AS (SELECT \"window\", src, dst, COUNT(*) AS entities FROM ({_pairs_sql('status')}) p WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2, 3)",
)


@register("d05_party_flow_matrix", sql("SELECT * FROM flow_party", "flow_party"))
def d05(spark, d, P=C):
    return T.flow_matrix(P.panel(spark, d), P.SPEC, "party")


@register(
    "d06_party_ledger",
    sql(
        "SELECT \"window\", value, CAST(SUM(g) AS BIGINT) AS gained, CAST(SUM(l) AS BIGINT) AS lost, CAST(SUM(g) - SUM(l) AS BIGINT) AS net FROM ("
        "SELECT \"window\", dst AS value, entities AS g, 0 AS l FROM flow_party WHERE src <> dst "
        "UNION ALL SELECT \"window\", src, 0, entities FROM flow_party WHERE src <> dst) t GROUP BY 1, 2",
        "flow_party",
    ),
)
def d06(spark, d, P=C):
    return T.ledger(T.flow_matrix(P.panel(spark, d), P.SPEC, "party"))


@register(
    "d11_status_transitions",
    sql(
        "SELECT f.\"window\", f.src, f.dst, f.entities, COALESCE(r.entities, 0) AS reverse_entities, "
        "f.entities - COALESCE(r.entities, 0) AS net, CAST(f.entities AS DOUBLE) / NULLIF(r.entities, 0) AS ratio "
        "FROM flow_status f LEFT JOIN flow_status r ON f.\"window\" = r.\"window\" AND f.src = r.dst AND f.dst = r.src WHERE f.src <> f.dst",
        "flow_status",
    ),
)
def d11(spark, d, P=C):
    f = T.flow_matrix(P.panel(spark, d), P.SPEC, "status").filter(F.col("src") != F.col("dst"))
    r = f.select(F.col("window").alias("_w"), F.col("src").alias("_rs"), F.col("dst").alias("_rd"), F.col("entities").alias("_re"))
    j = f.join(r, (f.window == r._w) & (f.src == r._rd) & (f.dst == r._rs), "left")
    rev = F.coalesce("_re", F.lit(0).cast("bigint"))
    return j.select(
        "window", "src", "dst", "entities", rev.alias("reverse_entities"), (F.col("entities") - rev).alias("net"), safe_div(F.col("entities").cast("double"), "_re").alias("ratio")
    )


# ----------------------------------------------------------------- D8 / D12 / D13 presence
def pattern_labels(P) -> list[tuple[str, str]]:
    """Labels of the presence patterns, in the words of the preset's periods."""
    _, mid, last = (p.long for p in P.PERIODS)
    first = P.PERIODS[0].long
    return [
        ("YYY", "present in all"),
        ("YYN", f"left after {mid}"),
        ("YNN", f"left after {first}"),
        ("NYY", f"joined in {mid}"),
        ("NNY", f"joined in {last}"),
        ("NYN", f"{mid} only"),
        ("YNY", "boomerang"),
        ("NNN", "never present"),
    ]


def _pattern_sql() -> str:
    yn = " || ".join(f"CASE WHEN appeared_in_{p.long} THEN 'Y' ELSE 'N' END" for p in C.PERIODS)
    lab = "CASE pattern " + " ".join(
        f"WHEN '{k}' THEN '{v}'"
        for k, v in zip(
            ("YYY", "YYN", "YNN", "NYY", "NNY", "NYN", "YNY", "NNN"),
            ("present in all", "left after p2", "left after p1", "joined in p2", "joined in p3", "p2 only", "boomerang", "never present"),
        )
    ) + " END"
    return (
        f"SELECT pattern, {lab} AS label, entities, 100.0 * CAST(entities AS DOUBLE) / SUM(entities) OVER () AS pct FROM "
        f"(SELECT {yn} AS pattern, COUNT(*) AS entities FROM panel GROUP BY 1) t"
    )


@register("d08_presence_pattern_table", sql(_pattern_sql(), "panel"))
def d08(spark, d, P=C):
    p = P.panel(spark, d)
    yn = F.concat(*[F.when(F.col(f"appeared_in_{q.long}"), F.lit("Y")).otherwise(F.lit("N")) for q in P.PERIODS])
    cells = p.groupBy(yn.alias("pattern")).agg(F.count(F.lit(1)).alias("entities"))
    tot = cells.agg(F.sum("entities")).scalar()
    out = cells.select("pattern", decode("pattern", pattern_labels(P), None).alias("label"), "entities", pct("entities", tot).alias("pct"))
    return ordered(out, "pattern")


@register(
    "d12_boomerangs_and_single_period",
    sql(
        "SELECT CAST(SUM(CASE WHEN appeared_in_p1 AND NOT appeared_in_p2 AND appeared_in_p3 THEN 1 ELSE 0 END) AS BIGINT) AS boomerangs, "
        "CAST(SUM(CASE WHEN appeared_in_p1 AND NOT appeared_in_p2 AND NOT appeared_in_p3 THEN 1 ELSE 0 END) AS BIGINT) AS single_p1, "
        "CAST(SUM(CASE WHEN NOT appeared_in_p1 AND appeared_in_p2 AND NOT appeared_in_p3 THEN 1 ELSE 0 END) AS BIGINT) AS single_p2, "
        "CAST(SUM(CASE WHEN NOT appeared_in_p1 AND NOT appeared_in_p2 AND appeared_in_p3 THEN 1 ELSE 0 END) AS BIGINT) AS single_p3, "
        "CAST(SUM(CASE WHEN appeared_in_p1 AND appeared_in_p2 AND appeared_in_p3 THEN 1 ELSE 0 END) AS BIGINT) AS present_all FROM panel",
        "panel",
    ),
)
def d12(spark, d, P=C):
    pres = [F.col(f"appeared_in_{p.long}") for p in P.PERIODS]
    only = []
    for i, p in enumerate(P.PERIODS):
        cond = pres[i]
        for j, q in enumerate(pres):
            if j != i:
                cond = cond & ~q
        only.append(F.count_if(cond).alias(f"single_{p.short}"))
    # absent in some middle period yet present at both ends
    boomerang = pres[0] & pres[-1]
    gap = None
    for q in pres[1:-1]:
        gap = ~q if gap is None else gap | ~q
    everywhere = pres[0]
    for q in pres[1:]:
        everywhere = everywhere & q
    return P.panel(spark, d).agg(F.count_if(boomerang & gap).alias("boomerangs"), *only, F.count_if(everywhere).alias("present_all"))


def _window_rows(p: DataFrame, fields, windows=WINDOWS) -> DataFrame:
    """One row per (entity, window) with the given per-window expressions."""
    structs = [F.struct(F.lit(_wl(a, b)).alias("window"), *[fn(a.short, b.short).alias(n) for n, fn in fields]) for a, b in windows]
    return p.select(F.explode(F.array(*structs)).alias("_w")).select("_w.*")


def _both(x, y):
    return lambda a, b: (F.col(f"{x}_changed_{a}_{b}") & F.col(f"{y}_changed_{a}_{b}")).cast("int")


@register(
    "d13_double_switchers",
    sql(
        "SELECT \"window\", CAST(SUM(cp) AS BIGINT) AS county_and_party, CAST(SUM(zp) AS BIGINT) AS zip_and_party FROM ("
        + " UNION ALL ".join(
            f"SELECT '{_wl(a, b)}' AS window, CAST(county_changed_{a.short}_{b.short} AND party_changed_{a.short}_{b.short} AS INT) AS cp, "
            f"CAST(zip_changed_{a.short}_{b.short} AND party_changed_{a.short}_{b.short} AS INT) AS zp FROM panel"
            for a, b in WINDOWS
        )
        + ") t GROUP BY \"window\"",
        "panel",
    ),
)
def d13(spark, d, P=C):
    rows = _window_rows(P.panel(spark, d), [("cp", _both("county", "party")), ("zp", _both("zip", "party"))], P.SPEC.windows())
    return ordered(rows.groupBy("window").agg(F.sum("cp").cast("bigint").alias("county_and_party"), F.sum("zp").cast("bigint").alias("zip_and_party")), "window")


@register(
    "d13b_party_switched_twice",
    sql(
        "SELECT party_last_known AS party, count(*) AS switched_twice, count(*) FILTER (party_p1 = party_p3) AS returned FROM panel "
        "WHERE party_changed_p1_p2 AND party_changed_p2_p3 GROUP BY ALL",
        "panel",
    ),
)
def d13b(spark, d, P=C):
    """Entities whose party changed in every window, and those that came back to their first party."""
    p = P.panel(spark, d)
    for flag in Flags(P).changes("party"):
        p = p.filter(F.col(flag))
    back = F.col(f"party_{P.PERIODS[0].short}") == F.col(f"party_{P.PERIODS[-1].short}")
    out = p.groupBy(F.col("party_last_known").alias("party")).agg(F.count(F.lit(1)).alias("switched_twice"), F.count_if(back).alias("returned"))
    return ordered(out, "party")


# ----------------------------------------------------------------- D9 per-week rates
def _days(a, b, P=C) -> int:
    import datetime as dt

    starts = dict(zip([p.short for p in P.PERIODS], P.PERIOD_DATES))
    return (dt.date.fromisoformat(starts[b.short]) - dt.date.fromisoformat(starts[a.short])).days


_D9 = [("new_entities", "new_in_{bl}"), ("departures", "missing_after_{al}"), ("zip_changes", "zip_changed_{a}_{b}"), ("party_changes", "party_changed_{a}_{b}")]


@register(
    "d09_weekly_rates",
    sql(
        " UNION ALL ".join(
            f"SELECT '{_wl(a, b)}' AS window, {_days(a, b)} AS days, "
            + ", ".join(f"CAST(SUM(CAST({t.format(a=a.short, b=b.short, al=a.long, bl=b.long)} AS INT)) AS BIGINT) AS {n}" for n, t in _D9)
            + ", "
            + ", ".join(f"7.0 * CAST(SUM(CAST({t.format(a=a.short, b=b.short, al=a.long, bl=b.long)} AS INT)) AS DOUBLE) / {_days(a, b)} AS {n}_per_week" for n, t in _D9)
            + " FROM panel"
            for a, b in WINDOWS
        ),
        "panel",
    ),
)
def d09(spark, d, P=C):
    p = P.panel(spark, d)
    structs = []
    for a, b in P.SPEC.windows():
        fields = [F.lit(_wl(a, b)).alias("window"), F.lit(_days(a, b, P)).alias("days")]
        fields += [F.col(t.format(a=a.short, b=b.short, al=a.long, bl=b.long)).cast("int").alias(n) for n, t in _D9]
        structs.append(F.struct(*fields))
    rows = p.select(F.explode(F.array(*structs)).alias("_w")).select("_w.*")
    out = rows.groupBy("window", "days").agg(*[F.sum(n).cast("bigint").alias(n) for n, _ in _D9])
    for n, _ in _D9:
        out = out.withColumn(f"{n}_per_week", F.lit(7.0) * F.col(n).cast("double") / F.col("days"))
    return ordered(out, "window")


# ----------------------------------------------------------------- D10 cohorts
def _d10_sql(exclude_transient: bool) -> str:
    new = "(new_in_p2 OR new_in_p3)"
    gone = "(missing_after_p1 OR missing_after_p2)"
    if exclude_transient:
        new += " AND county_p3 IS NOT NULL AND county_p1 IS NULL"
        gone += " AND county_p1 IS NOT NULL AND county_p3 IS NULL"
    return sql(
        "SELECT c.cohort, c.party, c.n, 100.0 * CAST(c.n AS DOUBLE) / SUM(c.n) OVER (PARTITION BY c.cohort) AS pct_of_cohort, b.base_n, "
        "b.pct_of_base, 100.0 * CAST(c.n AS DOUBLE) / SUM(c.n) OVER (PARTITION BY c.cohort) - b.pct_of_base AS diff_pp FROM ("
        "SELECT cohort, party, COUNT(*) AS n FROM ("
        f"SELECT 'new' AS cohort, party_last_known AS party FROM panel WHERE {new} "
        f"UNION ALL SELECT 'removed', party_last_known FROM panel WHERE {gone}) u "
        "WHERE party IS NOT NULL GROUP BY 1, 2) c LEFT JOIN ("
        "SELECT party_last_known AS party, COUNT(*) AS base_n, 100.0 * CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER () AS pct_of_base "
        "FROM panel WHERE party_last_known IS NOT NULL GROUP BY 1) b ON c.party = b.party",
        "panel",
    )


def _d10(spark, d, exclude_transient: bool, P=C, key: str = "party", value: Column | None = None):
    from wavepanel.operators.panel import cohort_flags

    value = F.col("party_last_known") if value is None else value
    p = P.panel(spark, d).withColumn("_key", value).filter(F.col("_key").isNotNull())
    is_new, gone = cohort_flags(P.SPEC, exclude_transient)
    cohorts = p.select(
        F.col("_key").alias(key),
        F.explode(F.filter(F.array(F.when(is_new, F.lit("new")), F.when(gone, F.lit("removed"))), lambda x: x.isNotNull())).alias("cohort"),
    )
    cells = M.share_within(cohorts.groupBy("cohort", key).agg(F.count(F.lit(1)).alias("n")), ["cohort"], "n", "pct_of_cohort")
    base = M.share_within(p.groupBy(F.col("_key").alias(key)).agg(F.count(F.lit(1)).alias("base_n")), [], "base_n", "pct_of_base")
    j = cells.join(base, key, "left")
    return ordered(j.withColumn("diff_pp", F.col("pct_of_cohort") - F.col("pct_of_base")), "cohort", key)


def _cohort_sql(value: str, key: str) -> str:
    """Cohort and base shares from one list of cohorts per entity."""
    return sql(
        "cohorts AS (SELECT unnest(list_filter(['base', CASE WHEN new_in_p2 OR new_in_p3 THEN 'new' END, "
        f"CASE WHEN missing_after_p1 OR missing_after_p2 THEN 'removed' END], lambda x: x IS NOT NULL)) AS cohort, {value} AS {key} FROM panel LEFT JOIN races ON race = code), "
        f"shares AS (SELECT cohort, {key}, count(*) AS n, 100.0 * count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY cohort) AS pct FROM cohorts GROUP BY cohort, {key}) "
        f"SELECT c.cohort, c.{key}, c.n, c.pct AS pct_of_cohort, b.n AS base_n, b.pct AS pct_of_base, c.pct - b.pct AS diff_pp FROM shares c "
        f"JOIN shares b ON b.cohort = 'base' AND b.{key} = c.{key} WHERE c.cohort <> 'base'",
        "panel",
        "races",
    ).replace(") cohorts AS", "), cohorts AS")


@register("d10c_cohort_vs_base_by_age", _cohort_sql("age_band", "age_band"))
def d10c(spark, d, P=C):
    """New and removed cohorts by age band against all entities."""
    return _d10(spark, d, False, P, "age_band", F.col("age_band"))


@register("d10d_cohort_vs_base_by_race", _cohort_sql("ifnull(race_label, '9 Unknown')", "race_label"))
def d10d(spark, d, P=C):
    """New and removed cohorts by race against all entities."""
    return _d10(spark, d, False, P, "race_label", decode("race", EV.RACE_LABELS, "9 Unknown"))


@register("d10_cohort_vs_base", _d10_sql(False))
def d10(spark, d, P=C):
    """New and removed cohorts by party against the base distribution (flag definition)."""
    return _d10(spark, d, False, P)


@register("d10b_cohort_vs_base_lasting", _d10_sql(True))
def d10b(spark, d, P=C):
    """Same, counting only lasting arrivals and departures (no middle-only entities, no boomerangs)."""
    return _d10(spark, d, True, P)


# ----------------------------------------------------------------- D14 rates by age band
def _react_sql(cond: str) -> str:
    return " + ".join(cond.format(a=a.short, b=b.short) for a, b in WINDOWS)


@register(
    "d14_change_and_reactivation_rates",
    sql(
        "SELECT age_band, COUNT(*) AS entities, CAST(SUM(CAST(party_changed_p1_p2 AS INT) + CAST(party_changed_p2_p3 AS INT)) AS BIGINT) AS party_changes, "
        "100.0 * CAST(SUM(CAST(party_changed_p1_p2 AS INT) + CAST(party_changed_p2_p3 AS INT)) AS DOUBLE) / COUNT(*) AS party_change_rate, "
        f"CAST(SUM({_react_sql(f'(CASE WHEN status_{{a}} = {INA!r} AND status_{{b}} = {ACT!r} THEN 1 ELSE 0 END)')}) AS BIGINT) AS reactivations, "
        f"CAST(SUM({_react_sql(f'(CASE WHEN status_{{a}} = {INA!r} AND status_{{b}} IS NOT NULL THEN 1 ELSE 0 END)')}) AS BIGINT) AS at_risk, "
        f"100.0 * CAST(SUM({_react_sql(f'(CASE WHEN status_{{a}} = {INA!r} AND status_{{b}} = {ACT!r} THEN 1 ELSE 0 END)')}) AS DOUBLE) / "
        f"NULLIF(SUM({_react_sql(f'(CASE WHEN status_{{a}} = {INA!r} AND status_{{b}} IS NOT NULL THEN 1 ELSE 0 END)')}), 0) AS reactivation_rate "
        "FROM panel GROUP BY age_band",
        "panel",
    ),
)
def d14(spark, d, P=C):
    p = P.panel(spark, d)

    def per_window(cond):
        expr = None
        for a, b in P.SPEC.windows():
            term = F.when(cond(a.short, b.short), 1).otherwise(0)
            expr = term if expr is None else expr + term
        return F.sum(expr).cast("bigint")

    react = per_window(lambda a, b: (F.col(f"status_{a}") == P.INACTIVE_STATUS) & (F.col(f"status_{b}") == P.ACTIVE_STATUS))
    risk = per_window(lambda a, b: (F.col(f"status_{a}") == P.INACTIVE_STATUS) & F.col(f"status_{b}").isNotNull())
    out = p.groupBy("age_band").agg(
        F.count(F.lit(1)).alias("entities"),
        M.window_sum(Flags(P).changes("party")).alias("party_changes"),
        react.alias("reactivations"),
        risk.alias("at_risk"),
    )
    out = M.rates(out, {"party_change_rate": "party_changes", "reactivation_rate": "reactivations"}, "entities")
    out = out.withColumn("reactivation_rate", pct("reactivations", "at_risk"))
    return ordered(out.select("age_band", "entities", "party_changes", "party_change_rate", "reactivations", "at_risk", "reactivation_rate"), "age_band")


# ----------------------------------------------------------------- D15 / D16 / D17 / D18 / D19 segments
@register(
    "d15_plurality_by_age_band",
    sql(
        "SELECT age_band, party AS plurality_value, n AS plurality_n, CAST(tot AS BIGINT) AS group_total, 100.0 * CAST(n AS DOUBLE) / tot AS plurality_share FROM ("
        "SELECT age_band, party, n, SUM(n) OVER (PARTITION BY age_band) AS tot, ROW_NUMBER() OVER (PARTITION BY age_band ORDER BY n DESC, party) AS rk FROM ("
        "SELECT age_band, party_last_known AS party, COUNT(*) AS n FROM panel WHERE party_last_known IS NOT NULL GROUP BY 1, 2) c) r WHERE rk = 1",
        "panel",
    ),
)
def d15(spark, d, P=C):
    cells = P.panel(spark, d).filter(F.col("party_last_known").isNotNull()).groupBy("age_band", "party_last_known").agg(F.count(F.lit(1)).alias("n"))
    out = M.plurality(cells, ["age_band"], "party_last_known", "n")
    return ordered(out.withColumn("plurality_share", pct("plurality_n", "group_total")), "age_band")


@register(
    "d16_attribute_by_party_shares",
    sql(
        "SELECT dimension, value, party, n, 100.0 * CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY dimension, value) AS pct FROM ("
        "SELECT dimension, value, party, COUNT(*) AS n FROM ("
        "SELECT 'gender' AS dimension, gender AS value, party_last_known AS party FROM panel "
        "UNION ALL SELECT 'status', status_last_known, party_last_known FROM panel) u WHERE party IS NOT NULL GROUP BY 1, 2, 3) c",
        "panel",
    ),
)
def d16(spark, d, P=C):
    p = P.panel(spark, d).filter(F.col("party_last_known").isNotNull())
    rows = p.select(
        F.col("party_last_known").alias("party"),
        F.explode(
            F.array(
                F.struct(F.lit("gender").alias("dimension"), F.col("gender").alias("value")),
                F.struct(F.lit("status").alias("dimension"), F.col("status_last_known").alias("value")),
            )
        ).alias("_d"),
    ).select("_d.*", "party")
    cells = rows.groupBy("dimension", "value", "party").agg(F.count(F.lit(1)).alias("n"))
    return ordered(M.share_within(cells, ["dimension", "value"], "n", "pct"), "dimension", "value", "party")


@register(
    "d17_race_age_party_cube",
    sql(
        "SELECT race_label, age_band, party, COUNT(*) AS voters, CAST(GROUPING(race_label, age_band, party) AS BIGINT) AS grouping_id FROM ("
        f"SELECT {RACE_CASE.format(race='race')} AS race_label, age_band, party_last_known AS party FROM panel) t "
        f"GROUP BY CUBE (race_label, age_band, party) HAVING COUNT(*) >= {K}",
        "panel",
    ),
)
def d17(spark, d, P=C):
    p = P.panel(spark, d).select(decode("race", EV.RACE_LABELS, "9 Unknown").alias("race_label"), "age_band", F.col("party_last_known").alias("party"))
    cells = p.groupBy("race_label", "age_band", "party").agg(F.count(F.lit(1)).alias("n"))  # the cube expands cells, not entities
    out = cells.cube("race_label", "age_band", "party").agg(F.sum("n").cast("bigint").alias("voters"), F.grouping_id().cast("bigint").alias("grouping_id"))
    return M.suppress(out, P.MIN_CELL)


@register(
    "d18_overlapping_district_rollup",
    sql(
        "SELECT system, district, party, COUNT(*) AS voters FROM ("
        "SELECT 'supplier_nation' AS system, p.zip_last_known AS district, p.party_last_known AS party FROM panel p "
        "UNION ALL SELECT 'supplier_region', p.county_last_known, p.party_last_known FROM panel p "
        "UNION ALL SELECT 'customer_nation', LPAD(CAST(c.c_nationkey AS VARCHAR), 5, '0'), p.party_last_known FROM panel p JOIN customer c ON p.entity_id = c.c_custkey "
        "UNION ALL SELECT 'market_segment', c.c_mktsegment, p.party_last_known FROM panel p JOIN customer c ON p.entity_id = c.c_custkey) u "
        f"WHERE district IS NOT NULL GROUP BY 1, 2, 3 HAVING COUNT(*) >= {K}",
        "panel",
    ),
)
def d18(spark, d, P=C):
    """Several district systems overlap the same entities: unpivot the system
    columns into (system, district) and roll up once."""
    frame = P.district_frame(spark, d)
    long = frame.unpivot(["party"], list(P.DISTRICT_SYSTEMS), "system", "district")
    out = long.filter(F.col("district").isNotNull()).groupBy("system", "district", "party").agg(F.count(F.lit(1)).alias("voters"))
    return ordered(M.suppress(out, P.MIN_CELL), "system", "district", "party")


@register(
    "d19_mean_tenure_by_party",
    sql("SELECT party_last_known AS party, COUNT(*) AS entities, AVG(registration_age_years) AS mean_tenure_years FROM panel GROUP BY 1", "panel"),
)
def d19(spark, d, P=C):
    out = P.panel(spark, d).groupBy(F.col("party_last_known").alias("party")).agg(
        F.count(F.lit(1)).alias("entities"), F.avg("registration_age_years").alias("mean_tenure_years")
    )
    return ordered(out, "party")


# ----------------------------------------------------------------- D20-D24 events
@register(
    "d20_event_coverage",
    sql(
        "SELECT COUNT(*) AS entities, CAST(SUM(has) AS BIGINT) AS entities_with_events, 100.0 * CAST(SUM(has) AS DOUBLE) / COUNT(*) AS pct_with_events, "
        f"CAST(SUM(CASE WHEN status_last_known = '{ACT}' THEN 1 ELSE 0 END) AS BIGINT) AS active_entities, "
        f"CAST(SUM(CASE WHEN status_last_known = '{ACT}' THEN has ELSE 0 END) AS BIGINT) AS active_with_events, "
        f"100.0 * CAST(SUM(CASE WHEN status_last_known = '{ACT}' THEN has ELSE 0 END) AS DOUBLE) / "
        f"NULLIF(SUM(CASE WHEN status_last_known = '{ACT}' THEN 1 ELSE 0 END), 0) AS pct_active_with_events "
        "FROM (SELECT p.status_last_known, CASE WHEN e.entity_id IS NULL THEN 0 ELSE 1 END AS has FROM panel p "
        "LEFT JOIN (SELECT DISTINCT entity_id FROM ev) e ON p.entity_id = e.entity_id) t",
        "panel",
        "ev",
    ),
)
def d20(spark, d, P=C):
    ids = P.events(spark, d).groupBy(F.col(P.SPEC.entity).alias("_e")).agg(F.lit(1).alias("has"))
    p = P.panel(spark, d).select(P.SPEC.entity, "status_last_known")
    j = p.join(ids, p[P.SPEC.entity] == ids._e, "left").withColumn("has", F.coalesce("has", F.lit(0)))
    act = F.col("status_last_known") == P.ACTIVE_STATUS
    out = j.agg(
        F.count(F.lit(1)).alias("entities"),
        F.sum("has").cast("bigint").alias("entities_with_events"),
        F.count_if(act).alias("active_entities"),
        F.sum(F.when(act, F.col("has")).otherwise(0)).cast("bigint").alias("active_with_events"),
    )
    return out.select(
        "entities",
        "entities_with_events",
        pct("entities_with_events", "entities").alias("pct_with_events"),
        "active_entities",
        "active_with_events",
        pct("active_with_events", "active_entities").alias("pct_active_with_events"),
    )


@register(
    "d21_rejection_rates",
    sql(
        "SELECT CASE WHEN GROUPING(age_band) = 1 THEN 'all' ELSE COALESCE(age_band, 'unmatched') END AS age_band, "
        "CAST(SUM(CASE WHEN history_code IN ('A','B','L') THEN 1 ELSE 0 END) AS BIGINT) AS mail_total, "
        "CAST(SUM(CASE WHEN history_code IN ('B','L') THEN 1 ELSE 0 END) AS BIGINT) AS rejected, "
        "100.0 * CAST(SUM(CASE WHEN history_code IN ('B','L') THEN 1 ELSE 0 END) AS DOUBLE) / "
        "NULLIF(SUM(CASE WHEN history_code IN ('A','B','L') THEN 1 ELSE 0 END), 0) AS rejection_rate FROM vhe GROUP BY ROLLUP (age_band)",
        "vhe",
    ),
)
def d21(spark, d, P=C):
    per = EV.entity_cells(
        P.labelled_events(spark, d),
        P.panel(spark, d),
        [],
        ["age_band"],
        [F.count_if(F.col("history_code").isin("A", "B", "L")).alias("_mail"), F.count_if(F.col("history_code").isin("B", "L")).alias("_rej")],
        entity=P.SPEC.entity,
    )
    per = per.groupBy("age_band").agg(F.sum("_mail").alias("_mail"), F.sum("_rej").alias("_rej"))
    out = per.rollup("age_band").agg(
        F.grouping("age_band").alias("_g"), F.sum("_mail").cast("bigint").alias("mail_total"), F.sum("_rej").cast("bigint").alias("rejected")
    )
    label = F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.coalesce("age_band", F.lit("unmatched")))
    return ordered(out.select(label.alias("age_band"), "mail_total", "rejected", pct("rejected", "mail_total").alias("rejection_rate")), "age_band")


@register(
    "d22_method_share_change_pp",
    "SELECT party, method_bucket, MAX(CASE WHEN era = 'pre' THEN pct END) AS pct_pre, MAX(CASE WHEN era = 'post' THEN pct END) AS pct_post, "
    "MAX(CASE WHEN era = 'post' THEN pct END) - MAX(CASE WHEN era = 'pre' THEN pct END) AS change_pp FROM ("
    + REGISTRY["h10_method_share_pre_post"][1]
    + ") y GROUP BY 1, 2",
)
def d22(spark, d, P=C):
    s = method_shift(spark, d, P)
    out = s.groupBy("party", "method_bucket").agg(
        F.max(F.when(F.col("era") == "pre", F.col("pct"))).alias("pct_pre"), F.max(F.when(F.col("era") == "post", F.col("pct"))).alias("pct_post")
    )
    return ordered(out.withColumn("change_pp", F.col("pct_post") - F.col("pct_pre")), "party", "method_bucket")


@register(
    "d23_general_dropoff",
    sql(
        "SELECT election_year, party, voters, LAG(voters) OVER (PARTITION BY party ORDER BY election_year) AS prev_voters, "
        "100.0 * CAST(voters - LAG(voters) OVER (PARTITION BY party ORDER BY election_year) AS DOUBLE) / "
        "LAG(voters) OVER (PARTITION BY party ORDER BY election_year) AS change_pct, "
        "100.0 * CAST(voters AS DOUBLE) / SUM(voters) OVER (PARTITION BY election_year) AS pct_of_year, "
        "voters - MAX(voters) OVER (PARTITION BY election_year) AS gap_to_leader FROM ("
        "SELECT election_year, party_last_known AS party, COUNT(DISTINCT entity_id) AS voters FROM vhe "
        f"WHERE election_type = 'GEN' AND counted_vote = 1 AND election_year IN {tuple(C.CYCLE_YEARS)} AND party_last_known IN {MAIN_SQL} GROUP BY 1, 2) g",
        "vhe",
    ),
)
def d23(spark, d, P=C):
    g = general_voters(spark, d, P)
    prev = F.lag("voters").over(Window.partitionBy("party").orderBy("election_year"))
    out = g.withColumn("prev_voters", prev).withColumn("change_pct", pct(F.col("voters") - F.col("prev_voters"), "prev_voters"))
    out = M.share_within(out, ["election_year"], "voters", "pct_of_year")
    out = out.withColumn("gap_to_leader", F.col("voters") - F.max("voters").over(Window.partitionBy("election_year")))
    return ordered(out, "party", "election_year")


@register(
    "d23b_two_party_gap",
    sql(
        "SELECT election_year, max(n) FILTER (party = '1-URGENT') AS first_party, max(n) FILTER (party = '2-HIGH') AS second_party, "
        "ifnull(max(n) FILTER (party = '1-URGENT'), 0) - ifnull(max(n) FILTER (party = '2-HIGH'), 0) AS gap FROM "
        "(SELECT election_year, party, count(*) AS n FROM (SELECT DISTINCT election_year, entity_id, party_last_known AS party FROM vhe "
        "WHERE election_type = 'GEN' AND counted_vote = 1 AND election_year BETWEEN 1996 AND 2000 AND party_last_known IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) GROUP BY ALL) "
        "GROUP BY election_year",
        "vhe",
    ),
)
def d23b(spark, d, P=C):
    """General-election voters of the two leading parties of the preset per cycle, and the gap between them."""
    one, two = P.MAIN_PARTIES[:2]
    g = general_voters(spark, d, P)
    out = g.groupBy("election_year").agg(
        F.max(F.when(F.col("party") == one, F.col("voters"))).alias("first_party"), F.max(F.when(F.col("party") == two, F.col("voters"))).alias("second_party")
    )
    gap = F.coalesce("first_party", F.lit(0)) - F.coalesce("second_party", F.lit(0))
    return ordered(out.withColumn("gap", gap.cast("bigint")), "election_year")


@register(
    "d24_race_by_method_share",
    sql(
        "SELECT race_label, method_bucket, votes, 100.0 * CAST(votes AS DOUBLE) / SUM(votes) OVER (PARTITION BY race_label) AS pct FROM ("
        "SELECT race_label, method_bucket, CAST(SUM(counted_vote) AS BIGINT) AS votes FROM vhe WHERE counted_vote = 1 GROUP BY 1, 2) t",
        "vhe",
    ),
)
def d24(spark, d, P=C):
    e = P.labelled_events(spark, d).filter(F.col("counted_vote") == 1)
    c = EV.entity_cells(e, P.panel(spark, d), ["method_bucket"], ["race"], entity=P.SPEC.entity)
    cells = c.groupBy("race_label", "method_bucket").agg(F.sum("votes").cast("bigint").alias("votes"))
    return ordered(M.share_within(cells, ["race_label"], "votes", "pct"), "race_label", "method_bucket")


# ----------------------------------------------------------------- D25 data quality
@register(
    "d25_data_quality_by_period",
    sql(
        "SELECT extract_month, COUNT(*) AS rows, COUNT(DISTINCT entity_id) AS entities, COUNT(*) - COUNT(DISTINCT entity_id) AS duplicate_rows, "
        "CAST(SUM(CASE WHEN county IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_county_rows, "
        "CAST(SUM(CASE WHEN TRY_STRPTIME(birth_date, '%m/%d/%Y') IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS masked_birth_rows, "
        "CAST(SUM(CASE WHEN zip IS NOT NULL AND a.zip_code IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unmatched_area_rows, "
        "100.0 * CAST(SUM(CASE WHEN TRY_STRPTIME(birth_date, '%m/%d/%Y') IS NULL THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS pct_masked_birth, "
        "100.0 * CAST(SUM(CASE WHEN zip IS NOT NULL AND a.zip_code IS NULL THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS pct_unmatched_area "
        f"FROM snap s LEFT JOIN (SELECT zip_code FROM zip_income WHERE tax_year = {C.INCOME_YEAR}) a ON s.zip = a.zip_code GROUP BY extract_month",
        "snap",
        "zip_income",
    ),
)
def d25(spark, d, P=C):
    from wavepanel.functions.scalar import try_date

    e = P.SPEC.entity
    areas = P.zip_income(spark, d).filter(F.col("tax_year") == P.INCOME_YEAR).select(F.col("zip_code").alias("_a")).distinct()
    # a row per (period, entity, area, county there or not): a hot entity's rows are few before any join
    birth = [] if hasattr(P, "attach_static") else ["birth_date"]
    s = P.snapshot(spark, d, with_static=bool(birth)).withColumn("_no_county", F.col("county").isNull())
    cells = s.groupBy("extract_month", e, "zip", "_no_county", *birth).agg(F.count(F.lit(1)).alias("_n"))
    j = cells.join(areas, cells.zip == areas._a, "left")
    masked = [F.sum(F.when(try_date("birth_date").isNull(), F.col("_n")).otherwise(0)).alias("_masked")] if birth else []
    per = j.groupBy("extract_month", e).agg(
        F.sum("_n").alias("_n"),
        F.sum(F.when(F.col("_no_county"), F.col("_n")).otherwise(0)).alias("_no_county"),
        F.sum(F.when(F.col("zip").isNotNull() & F.col("_a").isNull(), F.col("_n")).otherwise(0)).alias("_no_area"),
        *masked,
    )
    if not birth:  # one row per (period, entity) meets the entity's attributes
        per = P.attach_static(per, spark, d).withColumn("_masked", F.when(try_date("birth_date").isNull(), F.col("_n")).otherwise(0))
    out = per.groupBy("extract_month").agg(
        F.sum("_n").cast("bigint").alias("rows"),
        F.count(e).alias("entities"),
        F.sum("_no_county").cast("bigint").alias("null_county_rows"),
        F.sum("_masked").cast("bigint").alias("masked_birth_rows"),
        F.sum("_no_area").cast("bigint").alias("unmatched_area_rows"),
    )
    out = out.withColumn("duplicate_rows", F.col("rows") - F.col("entities"))
    out = out.withColumn("pct_masked_birth", pct("masked_birth_rows", "rows")).withColumn("pct_unmatched_area", pct("unmatched_area_rows", "rows"))
    cols = ["extract_month", "rows", "entities", "duplicate_rows", "null_county_rows", "masked_birth_rows", "unmatched_area_rows"]
    return ordered(out.select(*cols, "pct_masked_birth", "pct_unmatched_area"), "extract_month")


@register(
    "d24b_county_consistency",
    sql(
        "SELECT v.county_last_known AS county, COUNT(*) AS entities, AVG(pv.general_votes) AS mean_general_votes, "
        f"CAST(SUM(CASE WHEN pv.general_votes = {len(C.CYCLE_YEARS)} THEN 1 ELSE 0 END) AS BIGINT) AS always_voters, "
        f"100.0 * CAST(SUM(CASE WHEN pv.general_votes = {len(C.CYCLE_YEARS)} THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS pct_always "
        "FROM (SELECT entity_id, CAST(SUM(CASE WHEN election_type = 'GEN' AND election_year IN "
        + "(" + ", ".join(str(y) for y in C.CYCLE_YEARS) + ")"
        + " AND counted_vote = 1 THEN 1 ELSE 0 END) AS BIGINT) AS general_votes FROM vhe WHERE election_year IN "
        + "(" + ", ".join(str(y) for y in C.CYCLE_YEARS) + ")"
        + " GROUP BY entity_id) pv LEFT JOIN panel v ON pv.entity_id = v.entity_id GROUP BY 1",
        "vhe",
        "panel",
    ),
)
def d24b(spark, d, P=C):
    """Consistency by area: mean counted general votes per entity and share of always-voters."""
    per = EV.per_entity_cycle_votes(P.labelled_events(spark, d), P.CYCLE_YEARS, entity=P.SPEC.entity)
    pan = P.panel(spark, d).select(F.col(P.SPEC.entity).alias("_e"), "county_last_known")
    j = per.join(pan, per[P.SPEC.entity] == pan._e, "left")
    out = j.groupBy(F.col("county_last_known").alias("county")).agg(
        F.count(F.lit(1)).alias("entities"),
        F.avg("general_votes").alias("mean_general_votes"),
        F.count_if(F.col("general_votes") == len(P.CYCLE_YEARS)).alias("always_voters"),
    )
    return ordered(out.withColumn("pct_always", pct("always_voters", "entities")), "county")


@register(
    "d24c_type_participation_by_party",
    sql(
        "SELECT election_type_label, party, votes, 100.0 * CAST(votes AS DOUBLE) / SUM(votes) OVER (PARTITION BY election_type_label) AS pct FROM ("
        "SELECT election_type_label, party_last_known AS party, CAST(SUM(counted_vote) AS BIGINT) AS votes FROM vhe "
        "WHERE counted_vote = 1 AND party_last_known IS NOT NULL GROUP BY 1, 2) t",
        "vhe",
    ),
)
def d24c(spark, d, P=C):
    e = P.labelled_events(spark, d).filter(F.col("counted_vote") == 1)
    c = EV.entity_cells(e, P.panel(spark, d), ["election_type_label"], ["party_last_known"], entity=P.SPEC.entity).filter(F.col("party_last_known").isNotNull())
    cells = c.groupBy("election_type_label", F.col("party_last_known").alias("party")).agg(F.sum("votes").cast("bigint").alias("votes"))
    return ordered(M.share_within(cells, ["election_type_label"], "votes", "pct"), "election_type_label", "party")


_DOMAIN_COLS = ("party", "status", "gender", "race")


@register(
    "d25b_code_domains",
    sql(
        "SELECT code_column, code, COUNT(*) AS rows FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS code_column, {c} AS code FROM snap" for c in _DOMAIN_COLS)
        + ") t GROUP BY 1, 2",
        "snap",
    ),
)
def d25b(spark, d, P=C):
    """Code-domain check: every value (NULL included) of each coded column, with row counts."""
    if hasattr(P, "attach_static"):  # counts per entity meet the entity's attributes
        s = P.snapshot(spark, d, with_static=False).groupBy(P.SPEC.entity, "party", "status").agg(F.count(F.lit(1)).alias("_n"))
        s = P.attach_static(s, spark, d)
    else:
        s = P.snapshot(spark, d).withColumn("_n", F.lit(1))
    cells = s.groupBy(*_DOMAIN_COLS).agg(F.sum("_n").alias("_n"))
    long = cells.unpivot(["_n"], list(_DOMAIN_COLS), "code_column", "code")
    return ordered(long.groupBy("code_column", "code").agg(F.sum("_n").cast("bigint").alias("rows")), "code_column", "code")


@register(
    "d15c_race_party_share_table",
    sql(
        "SELECT *, CASE WHEN n_urgent >= greatest(n_high, n_medium) THEN 'urgent' WHEN n_high >= n_medium THEN 'high' ELSE 'medium' END AS winner, "
        "100.0 * n_urgent::DOUBLE / total AS share_urgent, 100.0 * n_high::DOUBLE / total AS share_high, 100.0 * n_medium::DOUBLE / total AS share_medium, "
        "100.0 * n_other::DOUBLE / total AS share_other FROM (SELECT ifnull(race_label, '9 Unknown') AS race_label, count(*) FILTER (party_last_known = '1-URGENT') AS n_urgent, "
        "count(*) FILTER (party_last_known = '2-HIGH') AS n_high, count(*) FILTER (party_last_known = '3-MEDIUM') AS n_medium, "
        "count(*) FILTER (party_last_known NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS n_other, count(*) AS total "
        "FROM panel LEFT JOIN races ON race = code WHERE party_last_known IS NOT NULL GROUP BY ALL)",
        "panel",
        "races",
    ),
)
def d15c(spark, d, P=C):
    """Share table by race, with the main party that has most entities (ties: the first of the preset's)."""
    labs = [*P.MAIN_KPIS, ("other", "other")]
    p = P.panel(spark, d).filter(F.col("party_last_known").isNotNull()).withColumn("race_label", decode("race", EV.RACE_LABELS, "9 Unknown"))
    pg = F.when(F.col("party_last_known").isin(*[v for v, _ in labs[:-1]]), F.col("party_last_known")).otherwise(F.lit("other"))
    out = M.pivot_counts(p, ["race_label"], pg, [v for v, _ in labs], [lab for _, lab in labs])
    most = F.greatest(*[F.col(f"n_{lab}") for _, lab in P.MAIN_KPIS])
    winner = F.coalesce(*[F.when(F.col(f"n_{lab}") == most, F.lit(lab)) for _, lab in P.MAIN_KPIS])
    out = out.withColumns({f"share_{lab}": pct(f"n_{lab}", "total") for _, lab in labs}).withColumn("winner", winner)
    return ordered(out, "race_label")


_PARTY_LABS = [*C.MAIN_KPIS, ("other", "other")]


@register(
    "d15b_age_party_share_table",
    sql(
        "SELECT age_band, "
        + ", ".join(f"n_{lab}" for _, lab in _PARTY_LABS)
        + ", total, "
        + ", ".join(f"100.0 * CAST(n_{lab} AS DOUBLE) / total AS share_{lab}" for _, lab in _PARTY_LABS)
        + " FROM (SELECT age_band, "
        + ", ".join(
            f"CAST(SUM(CASE WHEN pg = '{v}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{lab}" for v, lab in _PARTY_LABS
        )
        + ", COUNT(*) AS total FROM (SELECT age_band, CASE WHEN party_last_known IN "
        + MAIN_SQL
        + " THEN party_last_known ELSE 'other' END AS pg FROM panel WHERE party_last_known IS NOT NULL) t GROUP BY age_band) c",
        "panel",
    ),
)
def d15b(spark, d, P=C):
    """Share table: one row per age band, one count and share column per party
    (main parties, the rest as 'other'), via a pivot with the values given."""
    labs = [*P.MAIN_KPIS, ("other", "other")]
    p = P.panel(spark, d).filter(F.col("party_last_known").isNotNull())
    pg = F.when(F.col("party_last_known").isin(*[v for v, _ in labs[:-1]]), F.col("party_last_known")).otherwise(F.lit("other"))
    out = M.pivot_counts(p, ["age_band"], pg, [v for v, _ in labs], [lab for _, lab in labs])
    out = out.withColumns({f"share_{lab}": pct(f"n_{lab}", "total") for _, lab in labs})
    return ordered(out, "age_band")


def report_queries(spark, src, P) -> dict:
    """All report measures (D1-D25 and variants) for a preset and its sources."""
    names = sorted(n for n in globals() if n[:1] == "d" and n[1:3].isdigit() and callable(globals()[n]))
    return {n: globals()[n](spark, src, P) for n in names}


@register(
    "d25c_hot_entity_share",
    sql(
        "SELECT extract_month, CAST(SUM(n) AS BIGINT) AS rows, MAX(n) AS max_rows_one_entity, "
        "100.0 * CAST(MAX(n) AS DOUBLE) / SUM(n) AS pct_max_entity FROM ("
        "SELECT extract_month, entity_id, COUNT(*) AS n FROM snap GROUP BY 1, 2) t GROUP BY extract_month",
        "snap",
    ),
)
def d25c(spark, d, P=C):
    """Hot-key diagnostic: per period, the most rows any one entity has and its
    share of the period (pre-aggregated per entity, then per period)."""
    per = P.snapshot(spark, d, with_static=False).groupBy("extract_month", P.SPEC.entity).agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("extract_month").agg(F.sum("n").cast("bigint").alias("rows"), F.max("n").alias("max_rows_one_entity"))
    return ordered(out.withColumn("pct_max_entity", pct("max_rows_one_entity", "rows")), "extract_month")
