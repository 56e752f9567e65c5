"""Event-log enrichment and cohorts.

``enrich_events`` is the large-large join of the workload (events x panel on
the entity key).  The panel side is pruned to the few columns the cuts use,
so the shuffle carries only those, and the rows of hot entities are spread over
salts.  Cuts that count pre-aggregate per (entity, cell) instead and join after.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavepanel.functions.scalar import bucket, decode


# Event code and type labels, counted codes and method buckets.
METHOD_LABELS = [
    ("A", "1 Mail (counted)"),
    ("B", "5 Mail (rejected)"),
    ("E", "2 Early in person"),
    ("L", "6 Mail (late, rejected)"),
    ("N", "7 Did not vote"),
    ("P", "8 Provisional (rejected)"),
    ("Y", "3 Polls (election day)"),
]
ELECTION_LABELS = [
    ("GEN", "1 General"),
    ("PRI", "2 Primary"),
    ("PPP", "3 Presidential Preference Primary"),
    ("RUN", "4 Runoff"),
    ("OTH", "5 Other / Special / Local"),
]
COUNTED_CODES = ("A", "E", "Y")
METHOD_BUCKETS = [(("A", "L", "B"), "mail"), (("E",), "early"), (("Y",), "polls")]
RACE_LABELS = [
    ("1", "1 American Indian / Alaskan"),
    ("2", "2 Asian / Pacific Islander"),
    ("3", "3 Black, Not Hispanic"),
    ("4", "4 Hispanic"),
    ("5", "5 White, Not Hispanic"),
    ("6", "6 Other"),
    ("7", "7 Multi-racial"),
]


@dataclass(frozen=True)
class EventSpec:
    entity: str = "entity_id"
    date: str = "election_date"
    type_col: str = "election_type"
    code_col: str = "history_code"


def label_events(events: DataFrame, spec: EventSpec = EventSpec()) -> DataFrame:
    """Event labels, year, counted flag and method bucket; NULL dates dropped.

    No join: per-entity rollups aggregate these rows first (the partial
    aggregate collapses a hot entity before any shuffle) and attach entity
    attributes afterwards, one row per entity.
    """
    ev = events.filter(F.col(spec.date).isNotNull())
    return ev.select(
        *[c for c in events.columns if c != "election_date_str"],
        F.year(spec.date).cast("bigint").alias("election_year"),
        decode(spec.type_col, ELECTION_LABELS, "9 Unknown").alias("election_type_label"),
        decode(spec.code_col, METHOD_LABELS, "9 Unknown").alias("method_label"),
        F.when(F.col(spec.code_col).isin(list(COUNTED_CODES)), 1).otherwise(0).alias("counted_vote"),
        bucket(spec.code_col, METHOD_BUCKETS, "other").alias("method_bucket"),
    )


def attach_entity(df: DataFrame, panel: DataFrame, entity: str, cols: Sequence[str], how: str = "left") -> DataFrame:
    """Entity attributes from the panel (race decoded to its label)."""
    right = panel.select(F.col(entity).alias("_e"), *cols)
    j = df.join(right, df[entity] == right["_e"], how)
    extra = [F.col(c) for c in cols if c != "race"]
    if "race" in cols:
        extra.append(decode("race", RACE_LABELS, "9 Unknown").alias("race_label"))
    return j.select(*[df[c] for c in df.columns], *extra)


def entity_cells(
    labelled: DataFrame,
    panel: DataFrame,
    keys: Sequence,
    panel_cols: Sequence[str],
    measures: Sequence | None = None,
    entity: str = "entity_id",
) -> DataFrame:
    """Pre-aggregate events per (entity, cell keys), then attach entity attributes.

    The partial aggregate collapses a hot entity's events to at most one row
    per cell before anything is shuffled for the join, so the join sees a
    bounded number of rows per entity.  ``measures`` default to the counted
    votes (``votes``).  Callers sum the measures over the cells they publish.
    """
    aggs = list(measures) if measures else [F.sum("counted_vote").cast("bigint").alias("votes")]
    cells = labelled.groupBy(entity, *keys).agg(*aggs)
    return attach_entity(cells, panel, entity, list(panel_cols))


HOT_SHARE = 1000  # an entity with at least one row in so many is hot: there are at most 1,000 of them


def salted_attach(df: DataFrame, panel: DataFrame, entity: str, cols: Sequence[str], hot_share: int = HOT_SHARE, salts: int = 32) -> DataFrame:
    """``attach_entity`` (left join) with the rows of hot entities spread over salts.

    AQE can't split a hot entity here: the panel side is an aggregate on the
    entity (or a bucketed table), not a shuffle of its own.  Hot is who has at
    least 1 / ``hot_share`` of the rows, so the list has ``hot_share`` entries at
    most, whatever the input, and is broadcast.  Their rows get one of
    ``salts`` sub-keys and their panel rows are replicated ``salts`` times;
    every other entity joins on salt 0.  Same result as the plain join.
    """
    counts = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") * hot_share >= counts.agg(F.sum("_n")).scalar()).select(F.col(entity).alias("_hot"))
    hot = F.broadcast(hot.withColumn("_is_hot", F.lit(True)))
    left = df.join(hot, df[entity] == hot["_hot"], "left")
    # hash of the row and its input partition: exact copies spread too, and a
    # retried task (same partition, same input order) reproduces its salts
    row_hash = F.xxhash64(*[F.col(c) for c in df.columns], F.spark_partition_id())
    left = left.withColumn("_salt", F.when(F.col("_is_hot"), F.pmod(row_hash, F.lit(salts))).otherwise(F.lit(0))).drop("_hot", "_is_hot")
    right = panel.select(F.col(entity).alias("_e"), *cols).join(hot, F.col("_e") == hot["_hot"], "left")
    right = right.withColumn(
        "_salt", F.explode(F.when(F.col("_is_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    ).drop("_hot", "_is_hot")
    j = left.join(right, (left[entity] == right["_e"]) & (left["_salt"] == right["_salt"]), "left")
    extra = [F.col(c) for c in cols if c != "race"]
    if "race" in cols:
        extra.append(decode("race", RACE_LABELS, "9 Unknown").alias("race_label"))
    return j.select(*[left[c] for c in df.columns], *extra)


def enrich_events(
    events: DataFrame,
    panel: DataFrame,
    spec: EventSpec = EventSpec(),
    panel_cols: Sequence[str] | None = None,
    once: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """C14: labelled events + current entity attributes (left join on entity).

    Rows with a NULL event date are dropped; events of entities missing from
    the panel keep NULL attributes.  The panel side is pruned to the columns
    the cuts use; the rows of hot entities are spread over salts.

    The list of hot entities takes a pass over the entity column of the events,
    and their number another.  ``once`` (``session.written``) is for events that
    are costly to make: they are made once, and those passes read the copy.
    """
    cols = list(panel_cols or ["party_last_known", "age_band", "race", "county_last_known"])
    labelled = label_events(events, spec)
    return salted_attach(once(labelled) if once else labelled, panel, spec.entity, cols)


# Consistency buckets (counted general-election votes over the cycles).
CONSISTENCY_LABELS = [(0, "0 (none)"), (1, "1"), (2, "2"), (3, "3"), (4, "4"), (5, "5 (every general)")]


def per_entity_cycle_votes(labelled: DataFrame, cycle_years: Sequence[int], general: str = "GEN", prefilter: bool = True, entity: str = "entity_id") -> DataFrame:
    """A17 step 1: counted general-election votes per entity over the cycle years.

    ``prefilter`` keeps only rows in the cycle years before grouping (so an
    entity with no row in those years is absent); without it every entity
    with any event gets a row, possibly with 0.
    """
    years = [int(y) for y in cycle_years]
    rows = labelled.filter(F.col("election_year").isin(years)) if prefilter else labelled
    hit = (F.col("election_type") == general) & F.col("election_year").isin(years) & (F.col("counted_vote") == 1)
    return rows.groupBy(entity).agg(F.sum(F.when(hit, 1).otherwise(0)).cast("bigint").alias("general_votes"))


def consistency_bucket(col: str = "general_votes"):
    """CASE without ELSE: more than 5 -> NULL bucket (kept)."""
    expr = None
    for k, label in CONSISTENCY_LABELS:
        expr = F.when(F.col(col) == k, F.lit(label)) if expr is None else expr.when(F.col(col) == k, F.lit(label))
    return expr
