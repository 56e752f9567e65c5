"""Ingest round-trips (S1, S4-S8) and operator-level tables.

The ingest queries render a driver table to the source format (tab lines,
JSON documents, CSV lines, a wide pivot), damage some rows by a rule on the
key, and parse them back with the library's readers; the oracle derives the
surviving rows directly from the table.  Every row of the table is rendered
and parsed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wavepanel.functions.scalar import decode
from wavepanel.operators import areas as A
from wavepanel.operators import panel as P
from wavepanel.plans import commerce as C
from wavepanel.plans.oracle import _case, sql
from wavepanel.plans.registry import register
from wavepanel.sources import external as X
from wavepanel.sources import text as TX

ORDER_FIELDS = ("order_key", "entity", "status", "order_date", "priority")


def _order_lines(spark, d):
    o = C.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    r = F.col("o_orderkey") % 10
    status = F.when(r == 6, F.concat(F.lit(" "), "o_orderstatus", F.lit(" "))).otherwise(F.col("o_orderstatus"))
    prio = F.when(r == 3, F.lit("")).when(r == 4, F.concat(F.lit('"'), "o_orderpriority")).otherwise(F.col("o_orderpriority"))
    head = [F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), status, F.date_format("o_orderdate", "MM/dd/yyyy")]
    line = (
        F.when(r == 5, F.lit(""))  # blank line
        .when(r == 1, F.concat_ws("\t", *head))  # short row
        .when(r == 2, F.concat_ws("\t", *head, prio, F.lit("EXTRA")))  # over-long row
        .otherwise(F.concat_ws("\t", *head, prio))
    )
    return o.select(line.alias("value"))


@register(
    "s01_snapshot_lines_parsed",
    "SELECT CAST(o_orderkey AS VARCHAR) AS order_key, CAST(o_custkey AS VARCHAR) AS entity, "
    "CASE WHEN o_orderkey % 10 = 6 THEN ' ' || o_orderstatus || ' ' ELSE o_orderstatus END AS status, "
    "strftime(o_orderdate, '%m/%d/%Y') AS order_date, "
    "CASE WHEN o_orderkey % 10 = 3 THEN NULL WHEN o_orderkey % 10 = 4 THEN '\"' || o_orderpriority ELSE o_orderpriority END AS priority "
    "FROM orders WHERE o_orderkey % 10 NOT IN (1, 5)",
)
def s01(spark, d):
    good, _ = TX.split_rows(_order_lines(spark, d), ORDER_FIELDS)
    return good


@register(
    "s04_quarantine_summary",
    "SELECT CASE WHEN o_orderkey % 10 = 1 THEN 'short' ELSE 'blank' END AS reason, COUNT(*) AS lines FROM orders "
    "WHERE o_orderkey % 10 IN (1, 5) GROUP BY 1",
)
def s04(spark, d):
    _, bad = TX.split_rows(_order_lines(spark, d), ORDER_FIELDS)
    return TX.quarantine_summary(bad)


@register(
    "s04b_one_parse_by_reason",
    "SELECT CASE o_orderkey % 10 WHEN 1 THEN 'short' WHEN 5 THEN 'blank' END AS reason, o_orderkey % 10 IN (1, 5) AS rejected, COUNT(*) AS lines, "
    "COUNT(*) FILTER (o_orderkey % 10 NOT IN (1, 5)) AS with_order_key FROM orders GROUP BY 1, 2",
)
def s04b(spark, d):
    """Good and rejected lines of one parse, counted in one pass."""
    tagged = TX.tag_rows(_order_lines(spark, d), ORDER_FIELDS)
    return tagged.groupBy("reason", "rejected").agg(F.count(F.lit(1)).alias("lines"), F.count("order_key").alias("with_order_key"))


def _event_lines(spark, d):
    li = C.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = C.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    ds = F.date_format("l_shipdate", "MM/dd/yyyy")
    date_str = (
        F.when(F.col("l_linenumber") == 5, F.lit("*"))
        .when(F.col("l_linenumber") == 6, F.concat(F.lit("02/30/"), F.year("l_shipdate").cast("string")))
        .when(F.col("l_linenumber") == 7, F.concat(ds, F.lit(" ")))
        .otherwise(ds)
    )
    fields = [
        F.col("o_orderstatus"),
        F.col("o_custkey").cast("string"),
        date_str,
        decode("o_orderpriority", C.PRIORITY_TYPES, None),
        decode("l_linenumber", C.LINE_CODES, None),
    ]
    return j.select(F.concat_ws("\t", *fields).alias("value"))


@register(
    "s05_event_lines_parsed",
    "SELECT o_orderstatus AS county_code, CAST(o_custkey AS VARCHAR) AS voter_id, "
    "CASE l_linenumber WHEN 5 THEN '*' WHEN 6 THEN '02/30/' || CAST(year(l_shipdate) AS VARCHAR) "
    "WHEN 7 THEN strftime(l_shipdate, '%m/%d/%Y') || ' ' ELSE strftime(l_shipdate, '%m/%d/%Y') END AS election_date_str, "
    + _case("o_orderpriority", C.PRIORITY_TYPES, None)
    + " AS election_type, "
    + _case("l_linenumber", C.LINE_CODES, None)
    + " AS history_code, CASE WHEN l_linenumber IN (5, 6) THEN NULL ELSE CAST(l_shipdate AS DATE) END AS election_date "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def s05(spark, d):
    good, _ = TX.parse_events(_event_lines(spark, d))
    return good


def _cpi_docs(spark, d):
    monthly = C.cpi_series(spark, d)
    y = F.substring("year_month", 1, 4)
    recs = monthly.select(
        y.alias("year"),
        F.concat(F.lit("M"), F.substring("year_month", 6, 2)).alias("period"),
        # unpublished months appear as '-'
        F.when(F.col("year_month").between("2001-10", "2001-12"), F.lit("-")).otherwise(F.col("cpi_value").cast("string")).alias("value"),
    )
    annual = monthly.groupBy(y.alias("year")).agg(F.lit("M13").alias("period"), F.avg("cpi_value").cast("string").alias("value"))
    recs = recs.unionByName(annual)
    docs = recs.groupBy("year").agg(F.collect_list(F.struct("year", "period", "value")).alias("data"))
    doc = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("data").alias("data"))).alias("series")).alias("Results")))
    return docs.select(doc.alias("json"))


@register(
    "s06_price_index_json",
    sql("SELECT year_month, cpi_value FROM cpi_raw WHERE year_month NOT BETWEEN '2001-10' AND '2001-12'", "cpi_raw"),
)
def s06(spark, d):
    """Nested JSON documents (one per year, 12 months + annual M13) -> monthly rows."""
    return X.cpi_from_documents(_cpi_docs(spark, d))


@register(
    "s07_income_bracket_csv",
    sql("SELECT STATE, CAST(zipcode AS BIGINT) AS zipcode, CAST(N1 AS DOUBLE) AS N1, CAST(A00100 AS DOUBLE) AS A00100, CAST(tax_year AS BIGINT) AS tax_year FROM brackets", "brackets"),
)
def s07(spark, d):
    """Bracket rows as CSV lines with more columns than are used -> the reader's typed rows."""
    header = ("STATE", "zipcode", "agi_stub", "N1", "A00100", "tax_year")
    lines = C.income_brackets(spark, d).select(F.concat_ws(",", *[F.col(c).cast("string") for c in header]).alias("value"))
    return X.typed_brackets(X.brackets_from_lines(lines, header), F.col("tax_year").cast("bigint").alias("tax_year"))


@register(
    "s08_wide_series_unpivot",
    sql("SELECT zip_code, city, county, metro, month_date, strftime(month_date, '%Y-%m') AS year_month, typical_home_value FROM hv_long", "hv_long"),
)
def s08(spark, d):
    """Wide file shape (one column per month-end date) -> long rows."""
    ids = ["zip_code", "city", "county", "metro"]
    long = C.home_values_long(spark, d).withColumn("month_key", F.date_format("month_date", "yyyy-MM-dd"))
    wide = long.groupBy(*ids).pivot("month_key").agg(F.first("typical_home_value"))
    return X.wide_to_long(wide, ids)


# ---------------------------------------------------------------- operator tables
_DEDUP_COLS = ["entity_id", "extract_month", "county", "zip", "party", "status", "birth_date", "registration_date", "gender", "race"]


@register("c01_dedupe_snapshot", sql("SELECT " + ", ".join(_DEDUP_COLS) + " FROM dedup", "dedup"))
def c01(spark, d):
    rows = P.dedupe_snapshot(C.snapshot(spark, d, with_static=False), C.SPEC_CORE)
    return C.attach_static(rows, spark, d).select(*_DEDUP_COLS)


@register("c02_pivot_panel", sql("SELECT * FROM pv", "pv"))
def c02(spark, d):
    """Unfused path: dedupe by (entity, period), then pivot by entity (the
    second aggregate reuses the first one's partitioning on the entity)."""
    wide = P.pivot_panel(P.dedupe_snapshot(C.snapshot(spark, d, with_static=False), C.SPEC_CORE), C.SPEC_CORE)
    return C.attach_static(wide, spark, d)


@register("c02b_panel_brought_forward", sql("SELECT * FROM pv", "pv"))
def c02b(spark, d):
    """The panel of two periods, brought forward by the rows of the third alone (and by the second once more)."""
    rows = C.snapshot(spark, d, with_static=False)
    stored = None
    for k in (0, 1, 1, 2):
        period = C.SPEC_CORE.periods[k]
        stored = P.bring_forward(stored, P.period_rows(rows, C.SPEC_CORE, period), C.SPEC_CORE, period)
    return C.attach_static(P.wide_from_periods(stored, C.SPEC_CORE), spark, d)


@register("c03_change_panel", sql("SELECT * FROM panel", "panel"))
def c03(spark, d):
    return C.panel(spark, d)


@register("c05_deflators", sql("SELECT * FROM cpi_monthly", "cpi_monthly"))
def c05(spark, d):
    return C.cpi_monthly(spark, d)


@register("c06_area_income", sql("SELECT * FROM zip_income", "zip_income"))
def c06(spark, d):
    return C.zip_income(spark, d)


@register("c07_area_series", sql("SELECT * FROM zip_home_values", "zip_home_values"))
def c07(spark, d):
    return C.zip_home_values(spark, d)


_LESS = "SELECT * FROM hv_long WHERE strftime(month_date, '%Y-%m') <> '1997-06'"
_AGO = "(SELECT max(b.typical_home_value) FROM less b WHERE b.zip_code = a.zip_code AND last_day(b.month_date) = last_day(a.month_date - INTERVAL {} MONTH))"


@register(
    "c07b_area_series_calendar",
    sql(
        "SELECT *, typical_home_value / nullif(hv_1y_ago, 0) - 1 AS home_value_yoy_change, typical_home_value / nullif(hv_5y_ago, 0) - 1 AS home_value_5yr_change FROM ("
        f"WITH less AS ({_LESS}) SELECT zip_code, city, county, metro, month_date, typical_home_value, strftime(month_date, '%Y-%m') AS year_month, "
        f"{_AGO.format(12)} AS hv_1y_ago, {_AGO.format(60)} AS hv_5y_ago FROM less a)",
        "hv_long",
    ),
)
def c07b(spark, d):
    """Lags by the calendar on a series in which a month is missing: NULL a year after the gap, right elsewhere."""
    gap = C.home_values_long(spark, d).filter(F.date_format("month_date", "yyyy-MM") != "1997-06")
    return A.area_series_calendar(gap)


@register(
    "c08_affordability",
    sql("SELECT * REPLACE (ROUND(affordability_pressure_score, 9) AS affordability_pressure_score) FROM zip_affordability", "zip_affordability"),
)
def c08(spark, d):
    return C.zip_affordability(spark, d).withColumn("affordability_pressure_score", F.round("affordability_pressure_score", 9))


@register("c09_transitions_movers", sql("SELECT * FROM movers", "movers"))
def c09(spark, d):
    return C.movers(spark, d)


@register("c12_area_pressure", sql("SELECT * REPLACE (ROUND(log_growth_cagr, 9) AS log_growth_cagr) FROM zip_pressure", "zip_pressure"))
def c12(spark, d):
    z = C.zip_pressure(spark, d)
    return z.withColumn("log_growth_cagr", F.round("log_growth_cagr", 9))


@register("c13_attach_area", sql("SELECT * FROM vpl", "vpl"))
def c13(spark, d):
    return C.entity_pressure(spark, d)


@register("c14_enrich_events", sql("SELECT * FROM vhe", "vhe"))
def c14(spark, d):
    return C.enriched_events(spark, d)


_AGE_COLS = ["entity_id", "birth_date_parsed", "age_at_as_of", "age_band", "registration_date_parsed", "registration_age_years"]


@register("c04_ages_and_tenure", sql("SELECT " + ", ".join(_AGE_COLS) + " FROM panel", "panel"))
def c04(spark, d):
    """C4: calendar-year ages and tenure at the as-of date, age band (NULL / >= 120 -> unknown)."""
    return C.panel(spark, d).select(*_AGE_COLS)


_DIR_COLS = ["entity_id", "window", "src_mean_agi", "dst_mean_agi", "income_direction"]


@register("c10_relative_direction", sql("SELECT " + ", ".join(f'"{c}"' if c == "window" else c for c in _DIR_COLS) + " FROM movers", "movers"))
def c10(spark, d):
    """Ratio rule on the two ends' area means (up / down / lateral / unknown)."""
    return C.movers(spark, d).select(*_DIR_COLS)


_AFF_COLS = ["entity_id", "window", "src_hv_to_income", "dst_hv_to_income", "affordability_direction"]


@register("c11_absolute_direction", sql("SELECT " + ", ".join(f'"{c}"' if c == "window" else c for c in _AFF_COLS) + " FROM movers", "movers"))
def c11(spark, d):
    """C11: difference rule on the two ends' value-to-income ratios."""
    return C.movers(spark, d).select(*_AFF_COLS)


@register(
    "c15_suppress_cells",
    sql(
        "SELECT zip_last_known AS zip_code, party_last_known AS party, COUNT(*) AS voters FROM panel "
        f"GROUP BY 1, 2 HAVING COUNT(*) >= {C.MIN_CELL}",
        "panel",
    ),
)
def c15(spark, d):
    """Cells below the floor are dropped (primary count)."""
    from wavepanel.operators.measures import suppress

    cells = C.panel(spark, d).groupBy(F.col("zip_last_known").alias("zip_code"), F.col("party_last_known").alias("party")).agg(
        F.count(F.lit(1)).alias("voters")
    )
    return suppress(cells, C.MIN_CELL)


@register(
    "c16_movement_counts",
    sql(
        "SELECT status_last_known AS status, COUNT(*) AS voters, "
        "CAST(SUM(CAST(new_in_p2 AS INT) + CAST(new_in_p3 AS INT)) AS BIGINT) AS new_registrations, "
        "CAST(SUM(CAST(status_changed_p1_p2 AS INT) + CAST(status_changed_p2_p3 AS INT)) AS BIGINT) AS status_changes "
        "FROM panel GROUP BY 1",
        "panel",
    ),
)
def c16(spark, d):
    """Count plus flag sums over the consecutive windows, by any key."""
    from wavepanel.operators.measures import movement_counts

    return movement_counts(
        C.panel(spark, d),
        [F.col("status_last_known").alias("status")],
        {"new_registrations": ["new_in_p2", "new_in_p3"], "status_changes": ["status_changed_p1_p2", "status_changed_p2_p3"]},
    )


@register(
    "c17_share_within",
    sql(
        "SELECT county, party, n, 100.0 * CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY county) AS pct FROM ("
        "SELECT county_last_known AS county, party_last_known AS party, COUNT(*) AS n FROM panel GROUP BY 1, 2) t",
        "panel",
    ),
)
def c17(spark, d):
    """C17: percentage of the group total (window over aggregated cells)."""
    from wavepanel.operators.measures import share_within

    cells = C.panel(spark, d).groupBy(F.col("county_last_known").alias("county"), F.col("party_last_known").alias("party")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return share_within(cells, ["county"], "n", "pct")


@register(
    "c18_rates",
    sql(
        "SELECT age_band, COUNT(*) AS voters, CAST(SUM(CAST(party_changed_p1_p2 AS INT)) AS BIGINT) AS party_changes, "
        "100.0 * CAST(SUM(CAST(party_changed_p1_p2 AS INT)) AS DOUBLE) / NULLIF(COUNT(*), 0) AS pct_party_changes FROM panel GROUP BY 1",
        "panel",
    ),
)
def c18(spark, d):
    """100 * numerator / NULLIF(denominator, 0), unrounded."""
    from wavepanel.operators.measures import flag_sum, rates

    out = C.panel(spark, d).groupBy("age_band").agg(F.count(F.lit(1)).alias("voters"), flag_sum("party_changed_p1_p2").alias("party_changes"))
    return rates(out, {"pct_party_changes": "party_changes"}, "voters")
