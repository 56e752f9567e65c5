"""Area indicators (C5-C8, C12, C13): deflate, aggregate, unpivot, lag, z-score, band.

Every output here is keyed by area (ZIP-like code) or by area x period, so its
row count is bounded by the number of areas times periods, not by the number
of entities; AQE broadcasts such a side when its measured size allows.
Whole-table statistics (z-score moments, latest month) are windows over one row
per area.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavepanel.functions.scalar import band, month_key, month_start, ratio_minus_one, safe_div, year_diff, zip5


# --------------------------------------------------------------------------
# C5 deflators
# --------------------------------------------------------------------------
def deflators(cpi: DataFrame, base_month: str) -> DataFrame:
    """Monthly price index -> factor to the base month's prices.

    Base = the index at ``base_month`` if published, else the latest month
    (the chosen month is carried in ``base_month``).  Input columns:
    ``year_month`` ('yyyy-MM'), ``cpi_value``.
    """
    # windows over the whole (monthly) index: it is read once
    whole = Window.partitionBy(F.lit(0))
    at_base = F.col("year_month") == base_month
    base_cpi = F.coalesce(F.max(F.when(at_base, F.col("cpi_value"))).over(whole), F.max_by("cpi_value", "year_month").over(whole))
    base_ym = F.coalesce(F.max(F.when(at_base, F.col("year_month"))).over(whole), F.max("year_month").over(whole))
    return cpi.select("year_month", "cpi_value", base_ym.alias("base_month"), (base_cpi / F.col("cpi_value")).alias("real_factor"))


# --------------------------------------------------------------------------
# C6 area income
# --------------------------------------------------------------------------
@dataclass(frozen=True)
class IncomeSpec:
    years: tuple[int, ...] | None  # None: all years of the input
    cuts: tuple[tuple[float, str], ...]
    top_label: str
    state: str | None = None  # keep only this STATE; None keeps all
    agi_unit: float = 1000.0  # A00100 is in thousands


def area_income(brackets: DataFrame, cpi_monthly: DataFrame, spec: IncomeSpec) -> DataFrame:
    """Bracket rows (STATE, zipcode, tax_year, N1, A00100) -> one row per (area, year).

    Mean income per return, the same deflated to base-month prices with the
    December index of the tax year, and an income band.
    """
    z = F.col("zipcode").cast("string")
    rows = brackets.filter(F.col("zipcode").isNotNull() & (z != "0") & (z != "00000"))
    if spec.years is not None:
        rows = rows.filter(F.col("tax_year").isin(list(spec.years)))
    if spec.state is not None:
        rows = rows.filter(F.col("STATE") == spec.state)
    agg = (
        rows.groupBy(zip5("zipcode").alias("zip_code"), F.col("tax_year").cast("int").alias("tax_year"))
        .agg(
            F.sum("N1").cast("double").alias("total_returns"),
            (F.sum("A00100") * F.lit(spec.agi_unit)).cast("double").alias("total_agi_dollars"),
        )
        .filter(F.col("total_returns") > 0)
    )
    # December index of each tax year; bounded by the number of years.
    december = cpi_monthly.select(
        F.substring("year_month", 1, 4).cast("int").alias("tax_year"),
        F.col("real_factor").alias("_deflator"),
        F.col("year_month"),
    ).filter(F.substring("year_month", 6, 2) == "12").drop("year_month")
    mean = safe_div("total_agi_dollars", "total_returns")
    return (
        agg.join(december, "tax_year", "left")
        .select(
            "zip_code",
            "tax_year",
            "total_returns",
            "total_agi_dollars",
            mean.alias("mean_agi_per_return"),
            (mean * F.col("_deflator")).alias("real_mean_agi"),
            band(mean, spec.cuts, spec.top_label, spec.top_label).alias("income_band"),
        )
    )


def missing_december(cpi_monthly: DataFrame, years: Sequence[int]) -> list[int]:
    """Tax years whose December index is absent (T18 check; small action)."""
    have = {
        int(r[0])
        for r in cpi_monthly.filter(F.substring("year_month", 6, 2) == "12").select(F.substring("year_month", 1, 4)).collect()
    }
    return [y for y in years if y not in have]


# --------------------------------------------------------------------------
# C7 area series: unpivot + positional lags
# --------------------------------------------------------------------------
def unpivot_wide(wide: DataFrame, id_cols: Sequence[str], date_cols: Sequence[str], name: str = "date_str", value: str = "value") -> DataFrame:
    """Wide date columns -> long rows; NULL values dropped."""
    long = wide.unpivot(list(id_cols), list(date_cols), name, value)
    return long.filter(F.col(value).isNotNull())


def area_series(long: DataFrame, area: str = "zip_code", date: str = "month_date", value: str = "typical_home_value") -> DataFrame:
    """Monthly series -> 'yyyy-MM' key plus 12- and 60-row lag growth.

    Lags are by row position within the area (T10): a gap in the series
    shifts "one year ago".  The window partitions by area, so each task sees
    at most one area's months.
    """
    w = Window.partitionBy(area).orderBy(date)
    base = long.filter(F.col(value).isNotNull()).withColumn("year_month", month_key(date))
    lag12 = F.lag(value, 12).over(w)
    lag60 = F.lag(value, 60).over(w)
    return (
        base.withColumn("hv_1y_ago", lag12)
        .withColumn("hv_5y_ago", lag60)
        .withColumn("home_value_yoy_change", ratio_minus_one(value, "hv_1y_ago"))
        .withColumn("home_value_5yr_change", ratio_minus_one(value, "hv_5y_ago"))
    )


def area_series_calendar(long: DataFrame, area: str = "zip_code", date: str = "month_date", value: str = "typical_home_value") -> DataFrame:
    """``area_series`` with lags by the calendar: the value 12 and 60 months before, NULL where that month is missing.

    A RANGE frame over the number of the month finds it without filling gaps.
    Of several values in a month the latest date's is taken.
    """
    month = (F.year(date) * 12 + F.month(date)).cast("int")
    base = long.filter(F.col(value).isNotNull()).withColumn("year_month", month_key(date)).withColumn("_m", month)

    def before(months: int):
        frame = Window.partitionBy(area).orderBy("_m").rangeBetween(-months, -months)
        return F.max_by(value, date).over(frame)

    return (
        base.withColumn("hv_1y_ago", before(12))
        .withColumn("hv_5y_ago", before(60))
        .drop("_m")
        .withColumn("home_value_yoy_change", ratio_minus_one(value, "hv_1y_ago"))
        .withColumn("home_value_5yr_change", ratio_minus_one(value, "hv_5y_ago"))
    )


# --------------------------------------------------------------------------
# C8 affordability
# --------------------------------------------------------------------------
# Affordability z-score bands (upper-exclusive) and the top label.
PRESSURE_CUTS = ((-0.75, "1: low pressure"), (-0.25, "2: below average"), (0.25, "3: average"), (0.75, "4: above average"))
PRESSURE_TOP = "5: high pressure"


def affordability(
    income: DataFrame,
    series: DataFrame,
    income_year: int,
    base_year: int,
    value_month: str | None = None,
    every_area: bool = False,
) -> DataFrame:
    """Value-to-income ratio per area, z-scored across areas, in five bands.

    ``value_month`` None takes the latest month present anywhere in the
    series.  A NULL ratio or an undefined score (sd 0 or NULL) gets 'unknown'.
    With ``every_area``, areas of the income year without a value in that month
    stay with NULL metrics and a NULL band, so that one frame has all incomes too.
    """
    now, then = F.col("tax_year") == income_year, F.col("tax_year") == base_year
    inc = (
        income.filter(now | then)
        .groupBy("zip_code")
        .agg(
            F.max(F.when(now, F.struct("mean_agi_per_return", "real_mean_agi", "income_band"))).alias("_now"),
            F.max(F.when(then, F.col("real_mean_agi"))).alias("_then"),
        )
        .filter(F.col("_now").isNotNull())
        .select("zip_code", "_now.*", ratio_minus_one("_now.real_mean_agi", "_then").alias("real_income_growth"))
    )
    value = F.struct(
        F.col("typical_home_value").alias("typical_home_value_latest"), F.col("home_value_yoy_change"), F.col("home_value_5yr_change")
    ).alias("_hv")
    if value_month is None:
        # the latest month of the whole series, over one row per area: an area without it drops out
        hv = series.groupBy("zip_code").agg(F.max(F.struct("year_month", value)).alias("_last")).select("zip_code", "_last.year_month", "_last._hv")
        hv = hv.withColumn("_latest", F.max("year_month").over(Window.partitionBy(F.lit(0)))).filter(F.col("year_month") == F.col("_latest"))
    else:
        hv = series.filter(F.col("year_month") == value_month).select("zip_code", value)
    valued = hv.select("zip_code", "_hv.*", F.lit(True).alias("_valued"))
    combined = inc.join(valued, "zip_code", "left" if every_area else "inner").withColumn(
        "home_value_to_income_ratio", safe_div("typical_home_value_latest", "mean_agi_per_return")
    )
    # moments over one row per area (NULL ratios don't count)
    whole = Window.partitionBy(F.lit(0))
    ratio = F.col("home_value_to_income_ratio")
    score = safe_div(ratio - F.avg(ratio).over(whole), F.stddev_samp(ratio).over(whole))
    return combined.withColumn("affordability_pressure_score", score).withColumn(
        "affordability_band",
        F.when(F.col("_valued") & ratio.isNull(), F.lit("unknown")).when(F.col("_valued"), band("affordability_pressure_score", PRESSURE_CUTS, PRESSURE_TOP, "unknown")),
    ).drop("_valued")


# --------------------------------------------------------------------------
# C12 long-run pressure metrics
# --------------------------------------------------------------------------
@dataclass(frozen=True)
class PressureSpec:
    anchor_month: str  # fixed month of the "5-year" comparison
    income_year: int
    base_year: int
    growth_cuts: tuple
    growth_top: str
    recent_cuts: tuple
    recent_top: str
    income_change_cuts: tuple
    income_change_top: str


def area_pressure(series: DataFrame, income: DataFrame, spec: PressureSpec) -> DataFrame:
    """First/last value per area (first = each area's first available month),
    growth since first, growth since the anchor month, log growth per calendar
    year, real income change between two tax years; three bands.

    One aggregate over the series (min_by / max_by instead of MIN/MAX plus
    self-joins) and one conditional aggregate over income.
    """
    v = "typical_home_value"
    per_area = (
        series.filter(F.col(v).isNotNull())
        .groupBy("zip_code")
        .agg(
            F.min("year_month").alias("first_month"),
            F.max("year_month").alias("last_month"),
            F.min_by(v, "year_month").alias("hv_first"),
            F.max_by(v, "year_month").alias("hv_last"),
            F.max(F.when(F.col("year_month") == spec.anchor_month, F.col(v))).alias("hv_5y_ago"),
        )
    )
    inc = (
        income.filter(F.col("tax_year").isin(spec.income_year, spec.base_year))
        .groupBy(F.col("zip_code").alias("_z"))
        .agg(
            F.max(F.when(F.col("tax_year") == spec.income_year, F.col("real_mean_agi"))).alias("real_agi_latest"),
            F.max(F.when(F.col("tax_year") == spec.base_year, F.col("real_mean_agi"))).alias("real_agi_base"),
            F.max(F.when(F.col("tax_year") == spec.income_year, F.col("mean_agi_per_return"))).alias("mean_agi_latest"),
            F.max(F.when(F.col("tax_year") == spec.income_year, F.col("income_band"))).alias("income_band"),
        )
    )
    years = year_diff(month_start("first_month"), month_start("last_month"))
    joined = per_area.join(inc, per_area.zip_code == inc._z, "left").select(
        "zip_code",
        "first_month",
        "last_month",
        "hv_first",
        "hv_last",
        "hv_5y_ago",
        safe_div(F.ln(safe_div("hv_last", "hv_first")), years).alias("log_growth_cagr"),
        ratio_minus_one("hv_last", "hv_first").alias("hv_growth_since_first"),
        ratio_minus_one("hv_last", "hv_5y_ago").alias("hv_growth_5yr"),
        "real_agi_latest",
        "real_agi_base",
        ratio_minus_one("real_agi_latest", "real_agi_base").alias("real_income_change"),
        "mean_agi_latest",
        "income_band",
    )
    return joined.select(
        "*",
        band("hv_growth_since_first", spec.growth_cuts, spec.growth_top).alias("hv_growth_25yr_band"),
        band("hv_growth_5yr", spec.recent_cuts, spec.recent_top).alias("hv_growth_5yr_band"),
        band("real_income_change", spec.income_change_cuts, spec.income_change_top).alias("real_income_change_band"),
    )


# --------------------------------------------------------------------------
# C13 attach area metrics to entities
# --------------------------------------------------------------------------
def attach_area(panel: DataFrame, metrics: DataFrame, panel_key: str = "zip_last_known", area_key: str = "zip_code") -> DataFrame:
    """Entity panel LEFT JOIN area metrics (one row per area; AQE broadcasts them if small).

    Unmatched entities get NULL metric columns and NULL bands, which are kept
    distinct from the 'unknown' band of matched-but-uncomputable areas (T8).
    """
    m = metrics.withColumnRenamed(area_key, "_area")
    return panel.join(m, panel[panel_key] == m["_area"], "left").drop("_area")
