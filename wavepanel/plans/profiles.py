"""Profile / sanity queries Q1-Q12 printed by the reference after each load."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavepanel.functions.scalar import pct
from wavepanel.operators.measures import distinct_sketches, estimated, period_profile, profile_top, sample_rows, unite_sketches
from wavepanel.plans import commerce as C
from wavepanel.plans.exports import Flags, ordered
from wavepanel.plans.oracle import sql
from wavepanel.plans.registry import register

P1 = C.PERIODS[0].label


@register(
    "q01_profile_top10",
    sql(
        "SELECT county AS county_code, status AS voter_status, party AS party_affiliation, COUNT(*) AS n FROM snap "
        f"WHERE extract_month = '{P1}' GROUP BY 1, 2, 3 ORDER BY n DESC, 1 NULLS LAST, 2 NULLS LAST, 3 NULLS LAST LIMIT 10",
        "snap",
    ),
)
def q01(spark, d, P=C):
    """Top-10 (county, status, party) cells of one snapshot period."""
    s = P.snapshot(spark, d, with_static=False).filter(F.col("extract_month") == P.PERIODS[0].label)
    s = s.select(F.col("county").alias("county_code"), F.col("status").alias("voter_status"), F.col("party").alias("party_affiliation"))
    return profile_top(s, ["county_code", "voter_status", "party_affiliation"], 10)


@register(
    "o04_sample_per_period",
    sql(
        "SELECT extract_month, order_key, entity_id, party FROM snap "
        "QUALIFY row_number() OVER (PARTITION BY extract_month ORDER BY md5(order_key::VARCHAR), order_key) <= 3",
        "snap",
    ),
)
def o04(spark, d, P=C):
    """A look at three rows of each period, the same ones every time."""
    s = P.snapshot(spark, d, with_static=False)
    return sample_rows(s, 3, ["order_key"], ["extract_month"]).select("extract_month", "order_key", "entity_id", "party")


@register(
    "q02_rows_files_ids_per_period",
    sql(
        "SELECT extract_month, COUNT(*) AS rows, COUNT(DISTINCT source_file) AS files, COUNT(DISTINCT county) AS counties, "
        "COUNT(DISTINCT entity_id) AS distinct_entity_ids, COUNT(*) - COUNT(DISTINCT entity_id) AS duplicate_rows FROM snap GROUP BY extract_month",
        "snap",
    ),
)
def q02(spark, d, P=C):
    s = P.snapshot(spark, d, with_static=False)
    out = period_profile(s, "extract_month", P.SPEC.entity, ["source_file", "county"])
    out = out.withColumnRenamed("distinct_source_file", "files").withColumnRenamed("distinct_county", "counties")
    return ordered(out, "extract_month")


@register(
    "a03_distinct_by_sketches",
    sql(
        "SELECT COALESCE(extract_month, 'all') AS extract_month, COUNT(*) AS rows, COUNT(DISTINCT entity_id) AS entities, "
        "COUNT(DISTINCT source_file) AS files, TRUE AS entities_close, TRUE AS files_close FROM snap GROUP BY ROLLUP (extract_month)",
        "snap",
    ),
)
def a03(spark, d, P=C):
    """Distinct entities and files per period and over all, by sketches kept per (period, file); each within 4 % (five standard errors) of the exact count."""
    s = P.snapshot(spark, d, with_static=False)
    entity = P.SPEC.entity
    kept = distinct_sketches(s.withColumn("file", F.col("source_file")), ["extract_month", "source_file"], [entity, "file"])
    months = unite_sketches(kept, ["extract_month"])
    over_all = unite_sketches(kept).withColumn("extract_month", F.lit("all"))
    found = estimated(months.unionByName(over_all))
    per = s.groupBy("extract_month", "source_file", entity).agg(F.lit(1).alias("_one"))
    exact = per.rollup("extract_month").agg(F.countDistinct(entity).alias("entities"), F.countDistinct("source_file").alias("files"))
    exact = exact.withColumn("extract_month", F.coalesce("extract_month", F.lit("all")))

    def close(estimate, count):
        return F.abs(F.col(estimate) - F.col(count)) * 100 <= F.col(count) * 4

    out = found.join(exact, "extract_month")
    return ordered(
        out.select(
            "extract_month", "rows", "entities", "files",
            close(f"distinct_{entity}", "entities").alias("entities_close"), close("distinct_file", "files").alias("files_close"),
        ),
        "extract_month",
    )


@register(
    "q03_event_totals",
    sql(
        "SELECT COUNT(*) AS total_rows, COUNT(DISTINCT entity_id) AS entities, COUNT(DISTINCT (election_date, election_type)) AS elections FROM ev",
        "ev",
    ),
)
def q03(spark, d, P=C):
    e = P.events(spark, d)
    # the events are read once, into cells; NULL parts of a pair count
    cells = e.groupBy(P.SPEC.entity, "election_date", "election_type").agg(F.count(F.lit(1)).alias("_n"))
    return cells.agg(
        F.sum("_n").cast("bigint").alias("total_rows"),
        F.countDistinct(P.SPEC.entity).alias("entities"),
        F.countDistinct(F.struct("election_date", "election_type")).alias("elections"),
    )


@register(
    "q04_history_code_distribution",
    sql(
        "SELECT history_code, COUNT(*) AS rows, 100.0 * CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER () AS pct FROM ev GROUP BY history_code",
        "ev",
    ),
)
def q04(spark, d, P=C):
    cells = P.events(spark, d).groupBy("history_code").agg(F.count(F.lit(1)).alias("rows"))
    # grand total as a scalar subquery rather than an empty-partition window
    total = cells.agg(F.sum("rows")).scalar()
    return ordered(cells.select("history_code", "rows", pct("rows", total).alias("pct")), "history_code")


@register("q05_election_type_distribution", sql("SELECT election_type, COUNT(*) AS rows FROM ev GROUP BY election_type", "ev"))
def q05(spark, d, P=C):
    return P.events(spark, d).groupBy("election_type").agg(F.count(F.lit(1)).alias("rows"))


@register(
    "q06_event_date_range",
    sql(
        "SELECT MIN(election_date) AS min_date, MAX(election_date) AS max_date, COUNT(DISTINCT EXTRACT(YEAR FROM election_date)) AS years "
        "FROM ev WHERE election_date IS NOT NULL",
        "ev",
    ),
)
def q06(spark, d, P=C):
    e = P.events(spark, d).filter(F.col("election_date").isNotNull())
    return e.agg(F.min("election_date").alias("min_date"), F.max("election_date").alias("max_date"), F.countDistinct(F.year("election_date")).alias("years"))


@register(
    "q07_presence_patterns",
    sql("SELECT appeared_in_p1, appeared_in_p2, appeared_in_p3, COUNT(*) AS voters FROM panel GROUP BY 1, 2, 3", "panel"),
)
def q07(spark, d, P=C):
    p = P.panel(spark, d)
    return p.groupBy(*[f"appeared_in_{q.long}" for q in P.PERIODS]).agg(F.count(F.lit(1)).alias("voters")).orderBy(F.col("voters").desc())


_Q8 = ["new_in_p2", "new_in_p3", "missing_after_p1", "missing_after_p2"] + [
    f"{a}_changed_{x}_{y}" for a in ("county", "zip", "party", "status") for x, y in (("p1", "p2"), ("p2", "p3"))
]


@register("q08_global_flag_sums", sql("SELECT " + ", ".join(f"CAST(SUM(CAST({f} AS INT)) AS BIGINT) AS {f}" for f in _Q8) + " FROM panel", "panel"))
def q08(spark, d, P=C):
    fl = Flags(P)
    return P.panel(spark, d).agg(*[F.sum(F.col(f).cast("int")).cast("bigint").alias(f) for f in fl.per_flag()])


@register("q09_age_band_distribution", sql("SELECT age_band, COUNT(*) AS voters FROM panel GROUP BY age_band", "panel"))
def q09(spark, d, P=C):
    return ordered(P.panel(spark, d).groupBy("age_band").agg(F.count(F.lit(1)).alias("voters")), "age_band")


@register(
    "q10_value_series_counts",
    sql(
        "SELECT COUNT(*) AS rows, COUNT(DISTINCT zip_code) AS zips, COUNT(DISTINCT year_month) AS months FROM zip_home_values", "zip_home_values"
    ),
)
def q10(spark, d, P=C):
    hv = P.zip_home_values(spark, d)
    return hv.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("zip_code").alias("zips"), F.countDistinct("year_month").alias("months"))


@register(
    "q11_affordability_band_profile",
    sql(
        "SELECT affordability_band, COUNT(*) AS zips, ROUND(AVG(home_value_to_income_ratio), 6) AS mean_ratio, "
        "ROUND(AVG(typical_home_value_latest), 6) AS mean_home_value, ROUND(AVG(mean_agi_per_return), 6) AS mean_agi "
        "FROM zip_affordability GROUP BY affordability_band",
        "zip_affordability",
    ),
)
def q11(spark, d, P=C):
    a = P.zip_affordability(spark, d)
    out = a.groupBy("affordability_band").agg(
        F.count(F.lit(1)).alias("zips"),
        F.round(F.avg("home_value_to_income_ratio"), 6).alias("mean_ratio"),
        F.round(F.avg("typical_home_value_latest"), 6).alias("mean_home_value"),
        F.round(F.avg("mean_agi_per_return"), 6).alias("mean_agi"),
    )
    return ordered(out, "affordability_band")


@register(
    "q12_metric_coverage",
    sql(
        "SELECT COUNT(*) AS zips, COUNT(hv_growth_since_first) AS zips_with_growth, COUNT(real_income_change) AS zips_with_income_change "
        "FROM zip_pressure",
        "zip_pressure",
    ),
)
def q12(spark, d, P=C):
    z = P.zip_pressure(spark, d)
    return z.agg(
        F.count(F.lit(1)).alias("zips"), F.count("hv_growth_since_first").alias("zips_with_growth"), F.count("real_income_change").alias("zips_with_income_change")
    )
