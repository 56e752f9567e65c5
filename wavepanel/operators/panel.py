"""Snapshot -> per-entity change panel.

Plan shape: every operator here groups by the entity key only, so one hash
exchange on the entity serves dedupe, pivot and the static attributes.  The
fused ``build_panel`` does it in a single aggregate: for each period it keeps
the whole row with the lowest ordering key (``min_by`` over a struct), which is
the deterministic replacement for an order-dependent ANY_VALUE.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavepanel.functions.scalar import band, changed_when_present, last_known, try_date, year_diff


@dataclass(frozen=True)
class Period:
    label: str  # value in the period column, e.g. '2026-03'
    short: str  # suffix of per-period values and change flags, e.g. 'mar'
    long: str  # suffix of presence / arrival / departure flags, e.g. 'march'


@dataclass(frozen=True)
class PanelSpec:
    entity: str
    period: str
    periods: tuple[Period, ...]
    tracked: tuple[str, ...]
    static: tuple[str, ...] = ()
    witness: str | None = None  # tracked attribute whose presence marks presence (T14)
    order_by: tuple[str, ...] = ()  # dedupe order inside (entity, period)
    date_fields: tuple[str, ...] = ()  # static string dates parsed to <name>_parsed
    date_format: str = "M/d/yyyy"

    @property
    def presence(self) -> str:
        return self.witness or self.tracked[0]

    def windows(self) -> list[tuple[Period, Period]]:
        return list(zip(self.periods[:-1], self.periods[1:]))


def _order_key(order_by: tuple[str, ...]) -> Column:
    if len(order_by) == 1:
        return F.col(order_by[0])
    return F.struct(*[F.col(c) for c in order_by])


def dedupe_snapshot(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row per (entity, period): the whole row with the lowest order key.

    Grouped by (entity, period) so a later grouping by entity reuses the
    partitioning and sort order.
    """
    attrs = list(spec.tracked) + list(spec.static)
    row = F.min_by(F.struct(*[F.col(a) for a in attrs]), _order_key(spec.order_by)).alias("_row")
    return df.groupBy(spec.entity, spec.period).agg(row).select(spec.entity, spec.period, "_row.*")


def pivot_panel(deduped: DataFrame, spec: PanelSpec) -> DataFrame:
    """Tracked attributes -> one column per period; static attributes -> max."""
    aggs = []
    for attr in spec.tracked:
        for p in spec.periods:
            aggs.append(F.max(F.when(F.col(spec.period) == F.lit(p.label), F.col(attr))).alias(f"{attr}_{p.short}"))
    aggs += [F.max(s).alias(s) for s in spec.static]
    return deduped.groupBy(spec.entity).agg(*aggs)


def build_panel_wide(snapshot: DataFrame, spec: PanelSpec) -> DataFrame:
    """C1+C2 fused: one aggregate, one exchange on the entity key.

    For each period keep the row with the lowest order key among that
    period's rows (rows of other periods have a NULL ordering value and are
    ignored by ``min_by``).  Static attributes are the max over the kept rows.
    """
    attrs = list(spec.tracked) + list(spec.static)
    key = _order_key(spec.order_by)
    aggs = [
        F.min_by(F.struct(*[F.col(a) for a in attrs]), F.when(F.col(spec.period) == F.lit(p.label), key)).alias(f"_s_{p.short}")
        for p in spec.periods
    ]
    return wide_from_periods(snapshot.groupBy(spec.entity).agg(*aggs), spec)


def period_rows(snapshot: DataFrame, spec: PanelSpec, period: Period) -> DataFrame:
    """One row per entity of one period: the entity and its kept row as the struct ``_s_<short>``."""
    attrs = list(spec.tracked) + list(spec.static)
    row = F.min_by(F.struct(*[F.col(a) for a in attrs]), _order_key(spec.order_by)).alias(f"_s_{period.short}")
    return snapshot.filter(F.col(spec.period) == F.lit(period.label)).groupBy(spec.entity).agg(row)


def bring_forward(stored: DataFrame | None, rows: DataFrame, spec: PanelSpec, period: Period) -> DataFrame:
    """Kept rows of the periods so far and of one more, one row per entity.

    ``stored`` holds what earlier calls returned (None: nothing yet), ``rows``
    the ``period_rows`` of the period.  A period that is stored already is
    replaced, so that a repeated or corrected delivery counts once; entities
    left without any period go.  Only ``rows`` is aggregated, and of a table
    bucketed by entity only they are shuffled.
    """
    new = f"_s_{period.short}"
    if stored is None:
        return rows.select(spec.entity, new)
    kept = [c for c in stored.columns if c not in (spec.entity, new)]
    if not kept:
        return rows.select(spec.entity, new)
    # equality, so that the bucketing of the stored table serves the join; rows without an id are one entity, merged apart
    left = stored.filter(F.col(spec.entity).isNotNull()).select(F.col(spec.entity).alias("_e"), *kept)
    both = left.join(rows.filter(F.col(spec.entity).isNotNull()), F.col("_e") == F.col(spec.entity), "full")
    out = both.select(F.coalesce("_e", spec.entity).alias(spec.entity), *kept, new)
    none = stored.select(spec.entity, *kept).unionByName(rows.select(spec.entity, new), allowMissingColumns=True).filter(F.col(spec.entity).isNull())
    out = out.unionByName(none.groupBy(spec.entity).agg(*[F.max(c).alias(c) for c in [*kept, new]]))
    present = F.lit(False)
    for c in [*kept, new]:
        present = present | F.col(c).isNotNull()
    return out.filter(present)


def wide_from_periods(stored: DataFrame, spec: PanelSpec) -> DataFrame:
    """The frame that ``build_panel_wide`` returns, from the kept rows of each period."""
    cols = [F.col(spec.entity)]
    for attr in spec.tracked:
        cols += [F.col(f"_s_{p.short}.{attr}").alias(f"{attr}_{p.short}") for p in spec.periods]
    for s in spec.static:
        values = [F.col(f"_s_{p.short}.{s}") for p in spec.periods]
        cols.append((F.greatest(*values) if len(values) > 1 else values[0]).alias(s))
    return stored.select(*cols)


def change_flags(wide: DataFrame, spec: PanelSpec) -> DataFrame:
    """C3 + P13: presence, arrivals, departures, per-attribute changes, last-known.

    Presence in a period is the witness attribute being non-NULL there (not
    row existence).  Change flags are true only when both sides are present,
    so none of the flags is ever NULL.
    """
    w = spec.presence
    ps = spec.periods
    pres = {p.short: F.col(f"{w}_{p.short}").isNotNull() for p in ps}
    cols: list[Column] = [F.col(spec.entity)]
    cols += [pres[p.short].alias(f"appeared_in_{p.long}") for p in ps]
    cols += [(~pres[a.short] & pres[b.short]).alias(f"new_in_{b.long}") for a, b in spec.windows()]
    if len(ps) > 2:
        only = pres[ps[-1].short]
        for p in ps[:-1]:
            only = only & ~pres[p.short]
        cols.append(only.alias(f"new_in_{ps[-1].long}_only"))
    cols += [(pres[a.short] & ~pres[b.short]).alias(f"missing_after_{a.long}") for a, b in spec.windows()]
    for attr in spec.tracked:
        for a, b in spec.windows():
            cols.append(
                changed_when_present(f"{attr}_{a.short}", f"{attr}_{b.short}").alias(f"{attr}_changed_{a.short}_{b.short}")
            )
    for attr in spec.tracked:
        cols += [F.col(f"{attr}_{p.short}") for p in ps]
    for d in spec.date_fields:
        cols.append(try_date(d, spec.date_format).alias(f"{d}_parsed"))
    cols += [F.col(s) for s in spec.static if s not in spec.date_fields]
    for attr in spec.tracked:
        cols.append(last_known([f"{attr}_{p.short}" for p in reversed(ps)]).alias(f"{attr}_last_known"))
    return wide.select(*cols)


def derive_years(panel: DataFrame, date_col: str, as_of: str, out: str) -> DataFrame:
    """C4: calendar-year difference from ``date_col`` to ``as_of`` (NULL stays NULL)."""
    return panel.withColumn(out, year_diff(F.col(date_col), F.lit(as_of).cast("date")))


def derive_age_band(panel: DataFrame, age_col: str, cuts, else_label: str = "unknown", out: str = "age_band") -> DataFrame:
    """C4: age band with upper-exclusive cuts; NULL and >= last cut -> 'unknown'."""
    return panel.withColumn(out, band(age_col, cuts, else_label, "unknown"))


@dataclass(frozen=True)
class AgeSpec:
    birth: str  # parsed birth date column
    registration: str | None  # parsed registration date column
    as_of: str  # 'yyyy-MM-dd'
    age_col: str = "age_at_as_of"
    cuts: tuple = field(default_factory=tuple)


def build_panel(snapshot: DataFrame, spec: PanelSpec, ages: AgeSpec | None = None) -> DataFrame:
    """Snapshot rows -> one row per entity with values, flags, last-known and ages."""
    return build_panel_from_wide(build_panel_wide(snapshot, spec), spec, ages)


def build_panel_from_wide(wide: DataFrame, spec: PanelSpec, ages: AgeSpec | None = None) -> DataFrame:
    """Flags, last-known values and ages on an already pivoted frame."""
    panel = change_flags(wide, spec)
    if ages is None:
        return panel
    as_of = F.lit(ages.as_of).cast("date")
    age = year_diff(F.col(ages.birth), as_of)
    cols = {ages.age_col: age}
    if ages.registration:
        cols["registration_age_years"] = year_diff(F.col(ages.registration), as_of)
    cols["age_band"] = band(age, ages.cuts, "unknown", "unknown")
    return panel.withColumns(cols)


def cohort_flags(spec: PanelSpec, exclude_transient: bool = False) -> tuple[Column, Column]:
    """(arrived, departed) cohort membership over the whole span.

    Default: any arrival / any departure flag (event definition, as the flag
    sums count).  ``exclude_transient`` keeps only lasting changes: arrivals
    still present at the end and absent at the start, departures present at
    the start and gone at the end (no middle-only entities, no boomerangs).
    """
    ps = spec.periods
    w = spec.presence
    first, last = F.col(f"{w}_{ps[0].short}").isNotNull(), F.col(f"{w}_{ps[-1].short}").isNotNull()
    arrived = None
    departed = None
    for a, b in spec.windows():
        pa, pb = F.col(f"{w}_{a.short}").isNotNull(), F.col(f"{w}_{b.short}").isNotNull()
        arrived = (~pa & pb) if arrived is None else arrived | (~pa & pb)
        departed = (pa & ~pb) if departed is None else departed | (pa & ~pb)
    if exclude_transient:
        arrived = arrived & last & ~first
        departed = departed & first & ~last
    return arrived, departed
