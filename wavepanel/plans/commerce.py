"""Commerce preset: the driver's TPC-H-like tables stand in for snapshot,
area and event data, so every operator runs on tables whose size grows with
the scale factor.

Stand-ins (roles use the registration vocabulary):

* entity = ``o_custkey``; snapshot period = span of ``o_orderdate`` (up to
  1996, 1997-1998, from 1999: every order is in one); duplicates per (period,
  entity) are a customer's several orders, deduplicated by lowest
  ``o_orderkey``.
* party = ``o_orderpriority``; status = ``o_orderstatus``.
* zip = zero-padded nation key of the supplier of the order's first line
  (lowest line number, then supplier key); county = that nation's region
  (NULL when the order has no lines, which exercises presence by witness).
* static: birth date from the customer key, masked for every 97th key;
  registration date = customer's first order date; gender / race codes
  from the customer key.
* events = lineitem x orders: date = ship date, code from the line number,
  type from the order priority.
* income brackets = customer nation x year x priority: returns = orders,
  AGI (thousands) = order value; price index = monthly mean line price;
  home values = supplier nation x ship month mean line price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavepanel.functions.scalar import decode, exact_mean, money, zip5
from wavepanel.operators import areas as A
from wavepanel.operators import events as EV
from wavepanel.operators import panel as P
from wavepanel.operators import transitions as T
from wavepanel.session import written

# ---------------------------------------------------------------- parameters
# three periods that tile all dates: the first and the last have open ends
PERIODS = (P.Period("1995-1996", "p1", "p1"), P.Period("1997-1998", "p2", "p2"), P.Period("1999-2001", "p3", "p3"))
PERIOD_STARTS = ("1995-01-01", "1997-01-01", "1999-01-01")
PERIOD_DATES = PERIOD_STARTS  # reference date of each period (weekly-rate denominators)
AS_OF = "2001-08-01"
TRACKED = ("county", "zip", "party", "status")
STATIC = ("birth_date", "registration_date", "gender", "race")
SPEC = P.PanelSpec(
    entity="entity_id",
    period="extract_month",
    periods=PERIODS,
    tracked=TRACKED,
    static=STATIC,
    witness="county",
    order_by=("order_key",),
    date_fields=("birth_date", "registration_date"),
)
# Age bands (upper-exclusive) shared with the registration preset.
AGE_CUTS = (
    (25, "18-24"),
    (35, "25-34"),
    (45, "35-44"),
    (55, "45-54"),
    (65, "55-64"),
    (75, "65-74"),
    (120, "75+"),
)
AGES = P.AgeSpec(birth="birth_date_parsed", registration="registration_date_parsed", as_of=AS_OF, age_col="age_at_as_of", cuts=AGE_CUTS)

MIN_CELL = 3
MIN_GROUP = 20  # group-total floor of the share headlines
MIN_BASE = 50  # D4: smallest group that counts
TOP_K, BOTTOM_K = 10, 5  # D2
OUTLIER_Z = 1.5  # D3
LOSS_PCT = -10.0  # D3: a group losing at least this share between the first and last period
TIER_CUTS = ((3.8, "small"), (4.2, "mid"))  # D7: an area's share of the first period, in percent
COUNTY_TIER_CUTS = ((19.0, "small"), (21.0, "mid"))
MAIN_PARTIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")
MAIN_KPIS = (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("3-MEDIUM", "medium"))
ACTIVE_STATUS = "O"
INACTIVE_STATUS = "F"

# income: tax years, band cuts on mean order value per return
INCOME_YEARS = None  # all tax years of the data
INCOME_YEAR = 2000
INCOME_BASE_YEAR = 1996
BASE_MONTH = "1998-06"
INCOME_CUTS = ((235000, "1: under 235K"), (245000, "2: 235-245K"), (255000, "3: 245-255K"), (265000, "4: 255-265K"), (275000, "5: 265-275K"))
INCOME_TOP = "6: 275K+"
INCOME = A.IncomeSpec(years=INCOME_YEARS, cuts=INCOME_CUTS, top_label=INCOME_TOP, state=None)
VALUE_MONTH = None  # the latest month of the series
PRESSURE = A.PressureSpec(
    anchor_month="1996-06",
    income_year=INCOME_YEAR,
    base_year=INCOME_BASE_YEAR,
    growth_cuts=((-0.02, "1 <-2% (low)"), (0.0, "2 -2-0%"), (0.02, "3 0-2%"), (0.04, "4 2-4%")),
    growth_top="5 >=4% (high)",
    recent_cuts=((-0.02, "1 <-2% (cool)"), (0.0, "2 -2-0%"), (0.02, "3 0-2%"), (0.04, "4 2-4%")),
    recent_top="5 >=4% (hot)",
    income_change_cuts=((-0.04, "1 declined >4%"), (0.0, "2 declined 0-4%"), (0.04, "3 grew 0-4%"), (0.08, "4 grew 4-8%")),
    income_change_top="5 grew >=8%",
)
MOVE_UP, MOVE_DOWN, AFFORD_DELTA = 1.03, 0.97, 0.01
INCOME_DIRECTION = {"unknown": "unknown", "up": "up (>=+3%)", "down": "down (<=-3%)", "lateral": "lateral (+/-3%)"}
AFFORD_DIRECTION = {
    "unknown": "unknown",
    "up": "to less affordable (+0.01+ ratio)",
    "down": "to more affordable (-0.01+ ratio)",
    "lateral": "similar pressure",
}

# events
CYCLE_YEARS = (1996, 1997, 1998, 1999, 2000)
EVENT_YEARS = (1995, 2001)  # the whole log
ERA_CUT = "1998-01-01"
COUNTY_FROM_YEAR = 1998

# Stand-in code tables (commerce preset only).
LINE_CODES = [(1, "A"), (2, "B"), (3, "E"), (4, "L"), (5, "N"), (6, "P"), (7, "Y")]
PRIORITY_TYPES = [("1-URGENT", "GEN"), ("2-HIGH", "PRI"), ("3-MEDIUM", "PPP"), ("4-NOT SPECIFIED", "RUN"), ("5-LOW", "OTH")]
GENDER_CODES = [(0, "F"), (1, "M"), (2, "U")]


from wavepanel.plans.memo import clear_plans, override, shared  # noqa: E402,F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- snapshot
def first_line_supplier(lineitem: DataFrame) -> DataFrame:
    """Supplier of each order's first line: lowest (line number, supplier).

    A partial (map-side) aggregate per order key; the result stays
    hash-partitioned by order key for the join with orders.
    """
    return lineitem.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_suppkey")).alias("_first")).select(
        "l_orderkey", F.col("_first.l_suppkey").alias("first_suppkey")
    )


@shared
def customer_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity-level attributes, one row per customer that has orders.

    Everything derives from the customer key and the first order date, so
    this is an aggregate of orders by customer (partial aggregation; no scan
    of the customer table).  Being an aggregate on the key, Spark knows the
    key is unique here and drops the whole left join from queries that use
    none of these attributes.
    """
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("_ck")).agg(F.min("o_orderdate").alias("_first_order"))
    birth = F.date_add(F.lit("1920-01-01").cast("date"), ((F.col("_ck") * 7919) % 24000).cast("int"))
    return first.select(
        "_ck",
        F.when(F.col("_ck") % 97 == 0, F.lit("*")).otherwise(F.date_format(birth, "MM/dd/yyyy")).alias("birth_date"),
        F.date_format("_first_order", "MM/dd/yyyy").alias("registration_date"),
        decode((F.col("_ck") % 3).cast("int"), GENDER_CODES, None).alias("gender"),
        (F.col("_ck") % 8).cast("string").alias("race"),
    )


def period_of(date_col: str) -> F.Column:
    c = F.col(date_col)
    return (
        F.when(c < F.lit(PERIOD_STARTS[1]).cast("timestamp_ntz"), F.lit(PERIODS[0].label))
        .when(c < F.lit(PERIOD_STARTS[2]).cast("timestamp_ntz"), F.lit(PERIODS[1].label))
        .otherwise(F.lit(PERIODS[2].label))
    )


@shared
def snapshot(spark: SparkSession, sf_dir: str, with_static: bool = True) -> DataFrame:
    """Stand-in snapshot rows: one per order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    loc = first_line_supplier(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # nation (25 rows) and region (5 rows) are fixed-size dimensions.
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    region = F.broadcast(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    rows = (
        orders.join(loc, orders.o_orderkey == loc.l_orderkey, "left")
        .join(supplier, F.col("first_suppkey") == supplier.s_suppkey, "left")
        .join(nation, F.col("s_nationkey") == nation.n_nationkey, "left")
        .join(region, F.col("n_regionkey") == region.r_regionkey, "left")
        .select(
            period_of("o_orderdate").alias("extract_month"),
            F.col("o_custkey").alias("entity_id"),
            F.col("o_orderkey").alias("order_key"),
            F.col("r_name").alias("county"),
            F.when(F.col("s_nationkey").isNotNull(), zip5("s_nationkey")).alias("zip"),
            F.col("o_orderpriority").alias("party"),
            F.col("o_orderstatus").alias("status"),
            F.concat(F.lit("orders_"), F.date_format("o_orderdate", "yyyyMM")).alias("source_file"),
        )
    )
    if not with_static:
        return rows
    static = customer_static(spark, sf_dir)
    return rows.join(static, rows.entity_id == static._ck, "left").drop("_ck")


SPEC_CORE = P.PanelSpec(
    entity=SPEC.entity, period=SPEC.period, periods=SPEC.periods, tracked=SPEC.tracked, witness=SPEC.witness, order_by=SPEC.order_by
)


def attach_static(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join the entity-level attributes after the entity aggregate.

    Joining them to the snapshot rows instead would put every row of a hot
    entity into one join task whose partitioning the aggregate then reuses
    (so AQE could not split it); after the aggregate both sides have one row
    per entity (or per entity and period).
    """
    static = customer_static(spark, sf_dir)
    return df.join(static, df.entity_id == static._ck, "left").drop("_ck")


@shared
def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-entity change panel (voter_changes equivalent).

    Static attributes are constant per customer in this preset, so the max
    over the kept rows equals the entity's attribute; they are attached
    after the aggregate (see ``attach_static``).
    """
    wide = attach_static(P.build_panel_wide(snapshot(spark, sf_dir, with_static=False), SPEC_CORE), spark, sf_dir)
    return P.build_panel_from_wide(wide, SPEC, AGES)


# ---------------------------------------------------------------- areas
@shared
def cpi_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_extendedprice")
    return li.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("year_month")).agg(exact_mean("l_extendedprice").alias("cpi_value"))


@shared
def cpi_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.deflators(cpi_series(spark, sf_dir), BASE_MONTH)


@shared
def income_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracket rows: (STATE, zipcode, tax_year, agi_stub, N1, A00100 in thousands)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.groupBy(
        F.col("c_nationkey").alias("zipcode"), F.year("o_orderdate").alias("tax_year"), F.col("o_orderpriority").alias("agi_stub")
    ).agg(
        F.lit("ALL").alias("STATE"),
        F.count(F.lit(1)).alias("N1"),
        F.floor(F.sum(money("o_totalprice")).cast("double") / F.lit(1000.0)).cast("bigint").alias("A00100"),
    )


@shared
def zip_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.area_income(income_brackets(spark, sf_dir), cpi_monthly(spark, sf_dir), INCOME)


@shared
def home_values_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area x month values with place attributes (one row per area-month).

    Lines are first reduced to (supplier, month) sums and counts (exact
    decimal sums, partial aggregation) so the join with suppliers carries one
    row per supplier-month instead of one per line; the mean is the ratio of
    the re-aggregated sum and count.
    """
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice")
    per = li.groupBy("l_suppkey", F.last_day("l_shipdate").alias("month_date")).agg(
        F.sum(money("l_extendedprice")).alias("_sum"), F.count(F.lit(1)).alias("_n")
    )
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    region = F.broadcast(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    j = per.join(s, per.l_suppkey == s.s_suppkey).join(nation, F.col("s_nationkey") == nation.n_nationkey).join(
        region, F.col("n_regionkey") == region.r_regionkey
    )
    return j.groupBy(
        zip5("s_nationkey").alias("zip_code"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("county"),
        F.concat(F.col("r_name"), F.lit(" metro")).alias("metro"),
        "month_date",
    ).agg((F.sum("_sum").cast("double") / F.sum("_n")).alias("typical_home_value"))


@shared
def zip_home_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.area_series(home_values_long(spark, sf_dir))


@shared
def zip_affordability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.affordability(zip_income(spark, sf_dir), zip_home_values(spark, sf_dir), INCOME_YEAR, INCOME_BASE_YEAR, VALUE_MONTH)


@shared
def zip_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.area_pressure(zip_home_values(spark, sf_dir), zip_income(spark, sf_dir), PRESSURE)


@shared
def entity_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel LEFT JOIN pressure metrics on last-known zip."""
    cols = [
        "zip_code",
        "hv_growth_since_first",
        "hv_growth_5yr",
        "real_income_change",
        "hv_growth_25yr_band",
        "hv_growth_5yr_band",
        "real_income_change_band",
    ]
    return A.attach_area(panel(spark, sf_dir), zip_pressure(spark, sf_dir).select(*cols))


@shared
def movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = A.affordability(zip_income(spark, sf_dir), zip_home_values(spark, sf_dir), INCOME_YEAR, INCOME_BASE_YEAR, VALUE_MONTH, every_area=True)
    return T.movers(
        panel(spark, sf_dir),
        SPEC,
        None,
        areas,
        EV.RACE_LABELS,
        MOVE_UP,
        MOVE_DOWN,
        AFFORD_DELTA,
        INCOME_DIRECTION,
        AFFORD_DIRECTION,
    )


# ---------------------------------------------------------------- events
@shared
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in event log: one row per line (entity, date string, type, code)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("o_orderstatus").alias("county_code"),
        F.col("o_custkey").alias("entity_id"),
        F.date_format("l_shipdate", "MM/dd/yyyy").alias("election_date_str"),
        F.col("l_shipdate").cast("date").alias("election_date"),  # s05 tests the text form
        decode("o_orderpriority", PRIORITY_TYPES, None).alias("election_type"),
        decode("l_linenumber", LINE_CODES, None).alias("history_code"),
    )


@shared
def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.label_events(events(spark, sf_dir))


@shared
def enriched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.enrich_events(events(spark, sf_dir), panel(spark, sf_dir), once=written)


movers_long = movers  # uniform builder name across presets

DISTRICT_SYSTEMS = ("supplier_nation", "supplier_region", "customer_nation", "market_segment")


@shared
def district_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity: party and the district of each overlapping system."""
    cust = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("_c"), zip5("c_nationkey").alias("customer_nation"), F.col("c_mktsegment").alias("market_segment")
    )
    p = panel(spark, sf_dir).select(
        "entity_id", F.col("zip_last_known").alias("supplier_nation"), F.col("county_last_known").alias("supplier_region"), F.col("party_last_known").alias("party")
    )
    return p.join(cust, p.entity_id == cust._c, "left").select("party", *DISTRICT_SYSTEMS)
