"""Publishing measures.

All of these run on already-aggregated frames (cells), whose size is bounded
by the product of the key domains, so the windows here partition by group
keys of small frames.  Whole-frame totals are scalar subqueries instead of an
empty-partition window (which would pull everything into one task).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavepanel.functions.scalar import pct, safe_div


def suppress(df: DataFrame, min_cell: int, count_cols: Sequence[str] = ("voters",)) -> DataFrame:
    """Drop cells whose count(s) fall below ``min_cell`` (primary count by default)."""
    cond = None
    for c in count_cols:
        part = F.col(c) >= F.lit(min_cell)
        cond = part if cond is None else cond & part
    return df.filter(cond)


def share_within(df: DataFrame, group: Sequence[str], n: str, out: str = "pct", total_out: str | None = None) -> DataFrame:
    """C17: 100 * n / sum(n) within ``group`` (window over an aggregated frame)."""
    # grand total: a scalar subquery, not an empty-partition window
    total = F.sum(n).over(Window.partitionBy(*group)) if group else df.agg(F.sum(n)).scalar()
    res = df.withColumn("_total", total).withColumn(out, pct(n, "_total"))
    return res.withColumnRenamed("_total", total_out) if total_out else res.drop("_total")


def rates(df: DataFrame, numerators: Mapping[str, str], den: str) -> DataFrame:
    """``{out: numerator}`` -> 100 * numerator / NULLIF(den, 0)."""
    return df.withColumns({out: pct(num, den) for out, num in numerators.items()})


def window_sum(flags: Sequence[str]) -> Column:
    """Sum of several boolean flags (events across consecutive windows)."""
    expr = None
    for f in flags:
        term = F.col(f).cast("int")
        expr = term if expr is None else expr + term
    return F.sum(expr).cast("bigint")


def flag_sum(flag: str) -> Column:
    """A5: SUM(CAST(flag AS INT))."""
    return F.sum(F.col(flag).cast("int")).cast("bigint")


def movement_counts(df: DataFrame, keys: Sequence[Column | str], sums: Mapping[str, Sequence[str]], count_name: str = "voters") -> DataFrame:
    """Count plus flag sums per key; ``sums`` maps output -> flags summed."""
    aggs = [F.count(F.lit(1)).alias(count_name)]
    aggs += [(flag_sum(fl[0]) if len(fl) == 1 else window_sum(fl)).alias(out) for out, fl in sums.items()]
    return df.groupBy(*keys).agg(*aggs)


def net_change(df: DataFrame, group: str, first: str, last: str) -> DataFrame:
    """Entities per group in the first and last period, net and % growth.

    Each entity contributes to the group it had in the first and in the last
    period; one explode then one aggregate.
    """
    sides = df.select(
        F.explode(
            F.array(
                F.struct(F.col(first).alias("g"), F.lit(1).alias("f"), F.lit(0).alias("l")),
                F.struct(F.col(last).alias("g"), F.lit(0).alias("f"), F.lit(1).alias("l")),
            )
        ).alias("_s")
    ).select("_s.*")
    agg = (
        sides.filter(F.col("g").isNotNull())
        .groupBy(F.col("g").alias(group))
        .agg(F.sum("f").cast("bigint").alias("n_first"), F.sum("l").cast("bigint").alias("n_last"))
    )
    return agg.withColumn("net_change", F.col("n_last") - F.col("n_first")).withColumn(
        "pct_change", pct(F.col("n_last") - F.col("n_first"), "n_first")
    )


def top_bottom(df: DataFrame, key: str, measure: str, k: int, bottom_k: int | None = None) -> DataFrame:
    """Top-k and bottom-k groups by a measure with rank (ties broken by key).

    Each side is a distributed top-k (TakeOrderedAndProject); the rank is then
    assigned within the k kept rows.
    """
    top = df.orderBy(F.col(measure).desc(), F.col(key).asc()).limit(k)
    bottom = df.orderBy(F.col(measure).asc(), F.col(key).asc()).limit(k if bottom_k is None else bottom_k)
    rt = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(measure).desc(), F.col(key).asc()))).withColumn(
        "side", F.lit("top")
    )
    rb = bottom.withColumn("rank", F.row_number().over(Window.orderBy(F.col(measure).asc(), F.col(key).asc()))).withColumn(
        "side", F.lit("bottom")
    )
    return rt.unionByName(rb).withColumn("rank", F.col("rank").cast("bigint"))


def zscore(df: DataFrame, col: str, out: str = "z") -> DataFrame:
    """Sample z-score of a column across all rows (moments as scalar subqueries)."""
    mean, sd = df.agg(F.avg(col)).scalar(), df.agg(F.stddev_samp(col)).scalar()
    return df.withColumn(out, safe_div(F.col(col) - mean, sd))


def plurality(df: DataFrame, group: Sequence[str], value: str, n: str) -> DataFrame:
    """Per group, the value with the largest n (ties -> smallest value)."""
    return df.groupBy(*group).agg(
        F.min_by(F.col(value), F.struct((-F.col(n)).alias("_neg"), F.col(value).alias("_v"))).alias("plurality_value"),
        F.max(n).alias("plurality_n"),
        F.sum(n).alias("group_total"),
    )


def pivot_counts(df: DataFrame, group: Sequence[str], pivot_col: Column | str, values: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Counts with one column per listed value (``n_<label>``) plus ``total``.

    The values are given, so the pivot needs no extra job to discover them;
    missing cells are 0.
    """
    pc = F.col(pivot_col) if isinstance(pivot_col, str) else pivot_col
    wide = df.withColumn("_pv", pc).groupBy(*group).pivot("_pv", list(values)).agg(F.count(F.lit(1)))
    cols = [F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("bigint").alias(f"n_{lab}") for v, lab in zip(values, labels)]
    out = wide.select(*group, *cols)
    total = None
    for lab in labels:
        total = F.col(f"n_{lab}") if total is None else total + F.col(f"n_{lab}")
    return out.withColumn("total", total)


def profile_top(df: DataFrame, cols: Sequence[str], k: int, count_name: str = "n") -> DataFrame:
    """Q1: the k most frequent value combinations (ties broken by the values)."""
    cells = df.groupBy(*cols).agg(F.count(F.lit(1)).alias(count_name))
    return cells.orderBy(F.col(count_name).desc(), *[F.col(c).asc_nulls_last() for c in cols]).limit(k)


def period_profile(df: DataFrame, period: str, entity: str, distinct_cols: Sequence[str] = (), approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Q2: rows, distinct values and duplicate rows per period.

    Each distinct count has an aggregate of its own on (period, value), which
    every task reduces first; the small per-period results are then combined.
    One aggregate with several distinct counts would multiply the raw rows.
    ``approx=True`` counts by HyperLogLog++ in one aggregate instead.
    """
    if approx:
        aggs = [F.approx_count_distinct(c, rsd).alias(f"distinct_{c}") for c in distinct_cols]
        aggs.append(F.approx_count_distinct(entity, rsd).alias("distinct_entity_ids"))
        out = df.groupBy(period).agg(F.count(F.lit(1)).alias("rows"), *aggs)
        return out.withColumn("duplicate_rows", F.col("rows") - F.col("distinct_entity_ids"))
    per = df.groupBy(period, entity).agg(F.count(F.lit(1)).alias("_n"))
    out = per.groupBy(period).agg(F.sum("_n").cast("bigint").alias("rows"), F.count(entity).alias("distinct_entity_ids"))
    for c in distinct_cols:
        values = df.select(period, c).distinct().groupBy(F.col(period).alias("_p")).agg(F.count(c).alias(f"distinct_{c}"))
        out = out.join(values, out[period].eqNullSafe(values["_p"])).drop("_p")
    return out.select(period, "rows", *[f"distinct_{c}" for c in distinct_cols], "distinct_entity_ids").withColumn(
        "duplicate_rows", F.col("rows") - F.col("distinct_entity_ids")
    )


def distinct_sketches(df: DataFrame, keys: Sequence[str], cols: Sequence[str], lg_k: int = 14) -> DataFrame:
    """A3, kept: rows and an HLL sketch of each column's distinct values per key.

    A sketch has at most 2^lg_k bytes, whatever it has seen (standard error
    about 0.8 % at 14), and can be stored and united later, so that a further period or file costs its
    own rows only.  NULLs count as no value; a group of NULLs alone has an empty sketch.
    """
    empty = F.hll_sketch_agg(F.lit(None).cast("string"), F.lit(lg_k))
    sketches = [F.coalesce(F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg_k)), empty).alias(f"sketch_{c}") for c in cols]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *sketches)


def unite_sketches(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Stored ``distinct_sketches`` (of any parts of a table) added up per ``keys``, in the same form."""
    cols = [c for c in sketches.columns if c.startswith("sketch_")]
    return sketches.groupBy(*keys).agg(F.sum("rows").cast("bigint").alias("rows"), *[F.hll_union_agg(c).alias(c) for c in cols])


def estimated(sketches: DataFrame) -> DataFrame:
    """Each ``sketch_<column>`` as ``distinct_<column>``, its estimate."""
    return sketches.select(*[F.hll_sketch_estimate(c).alias("distinct_" + c[len("sketch_"):]) if c.startswith("sketch_") else F.col(c) for c in sketches.columns])


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """``n`` rows of each group, those with the smallest hash of their ``keys``.

    The same rows on every run and cluster, whatever the order of the input;
    samples of parts of a table, sampled again together, give that of the whole.
    Each task keeps ``n`` rows of a group before the shuffle.
    """
    order = [F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), *[F.col(k) for k in keys]]
    if not groups:
        return df.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
