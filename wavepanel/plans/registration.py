"""Registration preset: the voter-file domain the operators were built for.

Three monthly full-population extracts (headerless 38-field TSV), one event
history extract (5-field TSV), and public income / home-value / price-index
series.  The functions here wire the generic operators with this domain's
names and constants; inputs are paths, so the same plan runs on a cluster
against the real extracts.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavepanel.functions.scalar import zip5
from wavepanel.operators import areas as A
from wavepanel.operators import events as EV
from wavepanel.operators import panel as P
from wavepanel.operators import transitions as T
from wavepanel.plans.memo import shared
from wavepanel.sources import external as X
from wavepanel.sources import text as TX

# Periods of the surveyed extracts and the panel's as-of date.
PERIODS = (P.Period("2026-03", "mar", "march"), P.Period("2026-04", "apr", "april"), P.Period("2026-05", "may", "may"))
AS_OF = "2026-05-01"
PERIOD_DATES = ("2026-03-10", "2026-04-14", "2026-05-12")  # extract dates (weekly-rate denominators)
INACTIVE_STATUS = "INA"
MIN_CELL = 10
MIN_GROUP = 100  # group-total floor of the share headlines
MIN_BASE = 50
TOP_K, BOTTOM_K = 10, 5
OUTLIER_Z = 1.5
LOSS_PCT = -10.0
TIER_CUTS = ((0.05, "small"), (0.2, "mid"))  # an area's share of the first period, in percent
COUNTY_TIER_CUTS = ((0.5, "small"), (2.5, "mid"))
MAIN_PARTIES = ("DEM", "REP", "NPA")
MAIN_KPIS = (("DEM", "dem"), ("REP", "rep"), ("NPA", "npa"))
ACTIVE_STATUS = "ACT"

# Age bands (upper-exclusive), NULL and >= 120 -> 'unknown'.
AGE_CUTS = ((25, "18-24"), (35, "25-34"), (45, "35-44"), (55, "45-54"), (65, "55-64"), (75, "65-74"), (120, "75+"))

# Income bands on mean AGI per return (upper-exclusive).
INCOME_CUTS = (
    (35000, "1: under $35K"),
    (55000, "2: $35-55K"),
    (80000, "3: $55-80K"),
    (120000, "4: $80-120K"),
    (200000, "5: $120-200K"),
)
INCOME_TOP = "6: $200K+"
INCOME = A.IncomeSpec(years=(2020, 2021, 2022), cuts=INCOME_CUTS, top_label=INCOME_TOP, state="FL")
BASE_MONTH = "2026-05"

# Long-run pressure bands and the five-year anchor month.
PRESSURE = A.PressureSpec(
    anchor_month="2021-04",
    income_year=2022,
    base_year=2020,
    growth_cuts=((1.50, "1 <150% (low)"), (2.50, "2 150-250%"), (3.50, "3 250-350%"), (4.50, "4 350-450%")),
    growth_top="5 >=450% (high)",
    recent_cuts=((0.20, "1 <20% (cool)"), (0.40, "2 20-40%"), (0.60, "3 40-60%"), (0.80, "4 60-80%")),
    recent_top="5 >=80% (hot)",
    income_change_cuts=((-0.05, "1 declined >5%"), (0.00, "2 declined 0-5%"), (0.05, "3 grew 0-5%"), (0.10, "4 grew 5-10%")),
    income_change_top="5 grew >=10%",
)
INCOME_YEAR = PRESSURE.income_year
INCOME_BASE_YEAR = PRESSURE.base_year
# Mover direction thresholds (ratio of area means; difference of ratios).
MOVE_UP, MOVE_DOWN, AFFORD_DELTA = 1.15, 0.85, 1.0
INCOME_DIRECTION = T.INCOME_DIRECTION
AFFORD_DIRECTION = T.AFFORD_DIRECTION

# Event cuts.
CYCLE_YEARS = (2016, 2018, 2020, 2022, 2024)
EVENT_YEARS = (2016, 2026)
ERA_CUT = "2020-11-03"
COUNTY_FROM_YEAR = 2020

# snapshot column -> panel role
ROLES = {"county_code": "county", "residence_zipcode": "zip", "party_affiliation": "party", "voter_status": "status"}
SPEC = P.PanelSpec(
    entity="voter_id",
    period="extract_month",
    periods=PERIODS,
    tracked=("county", "zip", "party", "status"),
    static=("birth_date", "registration_date", "gender", "race"),
    witness="county",
    order_by=("source_file", "_line"),
    date_fields=("birth_date", "registration_date"),
)
AGES = P.AgeSpec(birth="birth_date_parsed", registration="registration_date_parsed", as_of=AS_OF, age_col="age_at_may_2026", cuts=AGE_CUTS)


def read_month_snapshots(spark: SparkSession, period_globs: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """All extracts stacked with their period tag and file; plus the quarantine."""
    rows, bad = TX.read_snapshots(spark, period_globs)
    return rows, bad


def voter_changes(snapshot: DataFrame) -> DataFrame:
    """Snapshot rows (38 fields + extract_month + source_file) -> per-voter panel.

    Duplicates within a period keep the row of the lexically first source
    file; ties are broken by all attributes that are kept, so the choice doesn't
    depend on the order of rows or tasks.
    """
    return P.build_panel(_panel_rows(snapshot), SPEC, AGES)


def _panel_rows(snapshot: DataFrame) -> DataFrame:
    return snapshot.select(
        "voter_id",
        "extract_month",
        "source_file",
        F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) for c in (*ROLES, "birth_date", "registration_date", "gender", "race")]).alias("_line"),
        *[F.col(src).alias(role) for src, role in ROLES.items()],
        "birth_date",
        "registration_date",
        "gender",
        "race",
    )


def append_to_panel(stored: DataFrame | None, snapshot: DataFrame, period: P.Period) -> DataFrame:
    """The kept rows of each period, brought forward by ``period`` of the stored snapshots.

    Of ``snapshot`` (``sources.text.stored_snapshots``) only that period's folder
    is read; ``stored`` is the table of the periods before, bucketed by voter
    (``sources.publish.save_table``), which is not shuffled.
    """
    return P.bring_forward(stored, P.period_rows(_panel_rows(snapshot), SPEC, period), SPEC, period)


def panel_of_periods(stored: DataFrame, periods: tuple[P.Period, ...]) -> DataFrame:
    """The per-voter panel over the stored periods named."""
    spec = replace(SPEC, periods=periods)
    return P.build_panel_from_wide(P.wide_from_periods(stored, spec), spec, AGES)


def movers(panel: DataFrame, income: DataFrame, afford: DataFrame) -> DataFrame:
    return T.movers(panel, SPEC, income.filter(F.col("tax_year") == PRESSURE.income_year), afford, EV.RACE_LABELS, MOVE_UP, MOVE_DOWN, AFFORD_DELTA)


# ---------------------------------------------------------------- builders over files
@dataclass(frozen=True)
class Sources:
    """Where the extracts and public series live (hashable: it keys the plan memo)."""

    snapshots: tuple[tuple[str, str], ...]  # (period label, glob of that period's files)
    events: str  # glob of the newest event-history extract
    cpi: str  # price-index JSON document
    income: tuple[tuple[int, str], ...]  # (tax year, bracket CSV)
    home_values: str  # wide home-value CSV
    state: str = "FL"


EVENT_SPEC = EV.EventSpec(entity="voter_id")
# Release run: the parsed text extracts are written once as parquet (snapshot
# rows partitioned by period), then everything else is built on those copies.
RELEASE_CORE = (
    "snapshot_lines",
    "events",
    "panel",
    "zip_income",
    "zip_home_values",
    "zip_affordability",
    "zip_pressure",
    "movers_long",
    "entity_pressure",
)


@shared
def snapshot_lines(spark: SparkSession, src: Sources) -> DataFrame:
    """All lines of the snapshots, parsed once: good and rejected ones (a release writes them with a folder for each)."""
    return TX.read_tagged(spark, dict(src.snapshots))


@shared
def snapshot_rows(spark: SparkSession, src: Sources) -> DataFrame:
    return TX.good_rows(snapshot_lines(spark, src), TX.SNAPSHOT_FIELDS, ("extract_month", "source_file"))


@shared
def quarantine(spark: SparkSession, src: Sources) -> DataFrame:
    """Lines of the snapshots that could not be read; a release writes and counts them."""
    return TX.rejected_rows(snapshot_lines(spark, src), ("extract_month", "source_file"))


@shared
def snapshot(spark: SparkSession, src: Sources, with_static: bool = True) -> DataFrame:
    """Snapshot rows with role names (county, zip, party, status)."""
    rows = snapshot_rows(spark, src)
    cols = ["voter_id", "extract_month", "source_file", *[F.col(c).alias(r) for c, r in ROLES.items()]]
    if with_static:
        cols += ["birth_date", "registration_date", "gender", "race"]
    return rows.select(*cols)


@shared
def panel(spark: SparkSession, src: Sources) -> DataFrame:
    return voter_changes(snapshot_rows(spark, src))


@shared
def cpi_monthly(spark: SparkSession, src: Sources) -> DataFrame:
    return A.deflators(X.read_cpi(spark, src.cpi), BASE_MONTH)


@shared
def zip_income(spark: SparkSession, src: Sources) -> DataFrame:
    spec = A.IncomeSpec(years=INCOME.years, cuts=INCOME.cuts, top_label=INCOME.top_label, state=src.state)
    cpi = cpi_monthly(spark, src)
    absent = A.missing_december(cpi, [y for y, _ in src.income])
    if absent:
        raise ValueError(f"the price index lacks December of {absent}: real incomes of those years can't be given")
    return A.area_income(X.read_income_brackets(spark, dict(src.income)), cpi, spec)


@shared
def home_values_long(spark: SparkSession, src: Sources) -> DataFrame:
    long = X.read_wide_series(spark, src.home_values, ["RegionName", "City", "CountyName", "Metro"], state=src.state)
    return long.select(
        zip5("RegionName").alias("zip_code"),
        F.col("City").alias("city"),
        F.col("CountyName").alias("county"),
        F.col("Metro").alias("metro"),
        "month_date",
        "typical_home_value",
    )


@shared
def zip_home_values(spark: SparkSession, src: Sources) -> DataFrame:
    return A.area_series(home_values_long(spark, src))


@shared
def zip_affordability(spark: SparkSession, src: Sources) -> DataFrame:
    return A.affordability(zip_income(spark, src), zip_home_values(spark, src), INCOME_YEAR, INCOME_BASE_YEAR)


@shared
def zip_pressure(spark: SparkSession, src: Sources) -> DataFrame:
    return A.area_pressure(zip_home_values(spark, src), zip_income(spark, src), PRESSURE)


@shared
def entity_pressure(spark: SparkSession, src: Sources) -> DataFrame:
    cols = ["zip_code", "hv_growth_since_first", "hv_growth_5yr", "real_income_change", "hv_growth_25yr_band", "hv_growth_5yr_band", "real_income_change_band"]
    return A.attach_area(panel(spark, src), zip_pressure(spark, src).select(*cols))


@shared
def movers_long(spark: SparkSession, src: Sources) -> DataFrame:
    return movers(panel(spark, src), zip_income(spark, src), zip_affordability(spark, src))


@shared
def events(spark: SparkSession, src: Sources) -> DataFrame:
    ev, _ = TX.read_events(spark, src.events)
    return ev


@shared
def labelled_events(spark: SparkSession, src: Sources) -> DataFrame:
    return EV.label_events(events(spark, src), EVENT_SPEC)


@shared
def enriched_events(spark: SparkSession, src: Sources) -> DataFrame:
    return EV.enrich_events(events(spark, src), panel(spark, src), EVENT_SPEC)


# The overlapping district systems of the extract.
DISTRICT_SYSTEMS = ("congressional_district", "house_district", "senate_district", "county_commission_district", "school_board_district")


@shared
def district_frame(spark: SparkSession, src: Sources) -> DataFrame:
    """One row per voter of the latest extract: party and the five districts
    (the row of the lexically first file when a voter appears twice)."""
    last = snapshot_rows(spark, src).filter(F.col("extract_month") == PERIODS[-1].label)
    kept = [F.col("party_affiliation").alias("party"), *[F.col(c) for c in DISTRICT_SYSTEMS]]
    row = F.min(F.struct(F.col("source_file"), F.struct(*kept).alias("kept")))["kept"]  # ties: by all that is kept
    return last.groupBy("voter_id").agg(row.alias("_r")).select("_r.*")


def published_exports(spark: SparkSession, src: Sources) -> dict[str, DataFrame]:
    """All 26 published cross-tabs (E1-E26) on the real extracts.

    The same builders the registered queries use, run with this preset's
    builders, names and fixed values.  Publish them with
    ``sources.publish.publish_csv`` (or materialize the core first, as in
    ``plans.release``).
    """
    import sys

    from wavepanel.plans import exports

    me = sys.modules[__name__]
    names = sorted(n for n in dir(exports) if n[:1] == "e" and n[1:3].isdigit() and len(n) == 3)
    return {n: getattr(exports, n)(spark, src, me) for n in names}


def headline_queries(spark: SparkSession, src: Sources) -> dict[str, DataFrame]:
    """The printed headline rollups (H1-H12) and load profiles (Q1-Q12) on the real extracts."""
    import sys

    from wavepanel.plans import headlines, profiles

    me = sys.modules[__name__]
    out = {}
    for mod, prefix in ((headlines, "h"), (profiles, "q")):
        for n in sorted(dir(mod)):
            if n[:1] == prefix and n[1:3].isdigit() and len(n) == 3:
                out[n] = getattr(mod, n)(spark, src, me)
    for n, band in (("h06", "hv_growth_25yr_band"), ("h07", "real_income_change_band"), ("h09", "hv_growth_5yr_band")):
        out[n] = headlines._band_share(band)[1](spark, src, me)
    return dict(sorted(out.items()))


def report_measures(spark: SparkSession, src: Sources) -> dict[str, DataFrame]:
    """The report measures (D1-D25 and variants) on the real extracts."""
    import sys

    from wavepanel.plans import reports

    return reports.report_queries(spark, src, sys.modules[__name__])
