"""Transitions between consecutive periods.

The long event table is produced by one scan of the panel: each entity row
emits an array of per-window structs (only the windows where it changed),
which is exploded.  That replaces a UNION ALL of one scan per window.
Area attributes of both ends come from one pre-joined area dimension.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavepanel.functions.scalar import decode
from wavepanel.operators.panel import PanelSpec


def window_label(a, b) -> str:
    return f"{a.label} -> {b.label}"


def transitions(
    panel: DataFrame,
    spec: PanelSpec,
    trigger: str,
    carry: Sequence[str],
    extra: Sequence[str] = (),
) -> DataFrame:
    """C9 (first half): one row per (entity, window) where ``trigger`` changed.

    ``carry`` attributes are emitted as ``src_<attr>`` / ``dst_<attr>``;
    ``extra`` are entity-level columns passed through.
    """
    structs = []
    for a, b in spec.windows():
        fields = [F.lit(window_label(a, b)).alias("window")]
        for attr in carry:
            fields += [F.col(f"{attr}_{a.short}").alias(f"src_{attr}"), F.col(f"{attr}_{b.short}").alias(f"dst_{attr}")]
        structs.append(F.when(F.col(f"{trigger}_changed_{a.short}_{b.short}"), F.struct(*fields)))
    moves = F.filter(F.array(*structs), lambda m: m.isNotNull())
    return panel.select(spec.entity, *extra, F.explode(moves).alias("_m")).select(spec.entity, "_m.*", *extra)


def relative_direction(src: str | Column, dst: str | Column, up: float, down: float, labels: Mapping[str, str]) -> Column:
    """Dst >= up*src -> up; dst <= down*src -> down; else lateral; NULL side -> unknown."""
    s, d = (F.col(src) if isinstance(src, str) else src), (F.col(dst) if isinstance(dst, str) else dst)
    return (
        F.when(s.isNull() | d.isNull(), F.lit(labels["unknown"]))
        .when(d >= F.lit(up) * s, F.lit(labels["up"]))
        .when(d <= F.lit(down) * s, F.lit(labels["down"]))
        .otherwise(F.lit(labels["lateral"]))
    )


def absolute_direction(src: str | Column, dst: str | Column, delta: float, labels: Mapping[str, str]) -> Column:
    """C11: dst - src >= delta -> up; <= -delta -> down; else lateral; NULL side -> unknown."""
    s, d = (F.col(src) if isinstance(src, str) else src), (F.col(dst) if isinstance(dst, str) else dst)
    diff = d - s
    return (
        F.when(s.isNull() | d.isNull(), F.lit(labels["unknown"]))
        .when(diff >= F.lit(delta), F.lit(labels["up"]))
        .when(diff <= F.lit(-delta), F.lit(labels["down"]))
        .otherwise(F.lit(labels["lateral"]))
    )


# Direction labels of the registration preset.
INCOME_DIRECTION = {"unknown": "unknown", "up": "up (>=+15%)", "down": "down (<=-15%)", "lateral": "lateral (+/-15%)"}
AFFORD_DIRECTION = {
    "unknown": "unknown",
    "up": "to less affordable (+1.0+ ratio)",
    "down": "to more affordable (-1.0+ ratio)",
    "lateral": "similar pressure",
}


def movers(
    panel: DataFrame,
    spec: PanelSpec,
    income_latest: DataFrame | None,
    afford: DataFrame,
    race_labels,
    up: float,
    down: float,
    delta: float,
    income_labels=INCOME_DIRECTION,
    afford_labels=AFFORD_DIRECTION,
) -> DataFrame:
    """Long mover events with both ends' area attributes and directions.

    ``income_latest`` None: ``afford`` has every area (``affordability(every_area=True)``)
    and so the incomes, which then are not built a second time.
    """
    moves = transitions(panel, spec, "zip", ["zip", "party", "county"], ["race"])
    metrics = ("affordability_band", "home_value_to_income_ratio")
    if income_latest is None:
        dim = afford.select("zip_code", "mean_agi_per_return", "income_band", *metrics)
    else:
        dim = income_latest.select("zip_code", "mean_agi_per_return", "income_band").join(afford.select("zip_code", *metrics), "zip_code", "left")
    src = dim.select([F.col(c).alias(f"s_{c}") for c in dim.columns])
    dst = dim.select([F.col(c).alias(f"d_{c}") for c in dim.columns])
    j = moves.join(src, moves.src_zip == src.s_zip_code, "left").join(
        dst, moves.dst_zip == dst.d_zip_code, "left"
    )
    return j.select(
        spec.entity,
        "window",
        "src_zip",
        "dst_zip",
        "src_county",
        "dst_county",
        (F.col("src_county") != F.col("dst_county")).alias("crossed_county"),
        "src_party",
        "dst_party",
        (F.col("src_party") != F.col("dst_party")).alias("party_changed"),
        decode("race", race_labels, "9 Unknown").alias("race_label"),
        F.col("s_mean_agi_per_return").alias("src_mean_agi"),
        F.col("d_mean_agi_per_return").alias("dst_mean_agi"),
        F.col("s_income_band").alias("src_income_band"),
        F.col("d_income_band").alias("dst_income_band"),
        F.col("s_affordability_band").alias("src_affordability_band"),
        F.col("d_affordability_band").alias("dst_affordability_band"),
        F.col("s_home_value_to_income_ratio").alias("src_hv_to_income"),
        F.col("d_home_value_to_income_ratio").alias("dst_hv_to_income"),
        relative_direction("s_mean_agi_per_return", "d_mean_agi_per_return", up, down, income_labels).alias("income_direction"),
        absolute_direction("s_home_value_to_income_ratio", "d_home_value_to_income_ratio", delta, afford_labels).alias(
            "affordability_direction"
        ),
    )


def flow_matrix(panel: DataFrame, spec: PanelSpec, attr: str) -> DataFrame:
    """Origin -> destination counts per consecutive window.

    Only entities present with a value in both periods count.  Pre-aggregated
    per window with a hash aggregate; output is bounded by values^2 x windows.
    """
    structs = []
    for a, b in spec.windows():
        structs.append(
            F.struct(
                F.lit(window_label(a, b)).alias("window"),
                F.col(f"{attr}_{a.short}").alias("src"),
                F.col(f"{attr}_{b.short}").alias("dst"),
            )
        )
    pairs = panel.select(F.explode(F.array(*structs)).alias("_p")).select("_p.*")
    return (
        pairs.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
        .groupBy("window", "src", "dst")
        .agg(F.count(F.lit(1)).alias("entities"))
    )


def ledger(flows: DataFrame) -> DataFrame:
    """Gained / lost / net per value from a flow matrix (changes only)."""
    moved = flows.filter(F.col("src") != F.col("dst"))
    sides = moved.select(
        "window",
        F.explode(
            F.array(
                F.struct(F.col("dst").alias("value"), F.col("entities").alias("gained"), F.lit(0).cast("bigint").alias("lost")),
                F.struct(F.col("src").alias("value"), F.lit(0).cast("bigint").alias("gained"), F.col("entities").alias("lost")),
            )
        ).alias("_s"),
    ).select("window", "_s.*")
    return sides.groupBy("window", "value").agg(
        F.sum("gained").alias("gained"), F.sum("lost").alias("lost"), (F.sum("gained") - F.sum("lost")).alias("net")
    )
