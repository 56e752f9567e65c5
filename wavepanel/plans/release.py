"""Publish the export set the way a scheduled release runs.

1. Materialize the intermediates that several exports share (snapshot, panel,
   area tables, mover events) once, as parquet in the cluster's shared folder
   (``spark.checkpoint.dir``): this cuts the lineage, survives executor loss,
   and stops each export from re-running the joins.  Events are read from
   their source by each cut, which reduces them before any join.
2. Point the plan builders at those copies.
3. Write each export as one ordered CSV with its row count taken from the
   same execution, then the data dictionary; lines that could not be read go
   to a folder of their own, with their count.
4. Drop the copies of the run.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from wavepanel.plans import commerce as C
from wavepanel.plans.memo import override
from wavepanel.plans.registry import load_all
from wavepanel.sources.publish import data_dictionary, drop_run, materialize, materialize_bucketed, publish_csv, save_table, shared_dir

# built in dependency order: later ones are built on the materialized earlier ones
CORE = ("snapshot", "panel", "zip_income", "zip_home_values", "zip_affordability", "zip_pressure", "movers_long", "entity_pressure")
# The panel (one row per entity, so no bucket can be hot) is written bucketed
# by entity; the events are not: a hot entity would make one bucket -- one
# task -- hold a third of them.  Event cuts pre-aggregate per (entity, cell)
# and then join the bucketed panel.
BUCKETED = ("panel",)
AT_ONCE = 4  # exports published at a time
# copies laid out by period (partition pruning for per-period cuts)
PARTITIONED = {"snapshot_lines": ("rejected", "extract_month")}

# copies of which a folder is a frame of its own: one parse serves both
FOLDERS = {"snapshot_lines": {"snapshot_rows": "rejected=false", "quarantine": "rejected=true"}}

DESCRIPTIONS = {
    "e01_county_month_summary": "Rows by period x county x party x status (raw rows, duplicates included).",
    "e02_county_party_age_summary": "Entities by last-known county x party x age band.",
    "e03_zip_month_summary": "Rows by period x area x party; small cells suppressed.",
    "e04_voter_movement_summary": "Movement flag counts by county and party.",
    "e05_movement_by_age_band": "Movement events by age band and party.",
    "e06_movement_by_affordability": "Movement events by area affordability band and party.",
    "e07_zip_affordability_export": "One row per area: income, values, affordability metrics.",
    "e08_zip_party_by_affordability": "Entities by affordability band x age band x party; small cells suppressed.",
    "e09_party_by_income_band": "Entities by area income band x party; small cells suppressed.",
    "e10_state_executive_summary": "Single-row KPI strip.",
    "e11_movers_income_direction": "Movers by area-income direction, race and party after; small cells suppressed.",
    "e12_movers_affordability_direction": "Movers by affordability direction, race and party after; small cells suppressed.",
    "e13_movers_band_to_band": "Movers from income band to income band by race and party after; small cells suppressed.",
    "e14_movers_party_change": "Movers who also changed party by direction, race and party pair; small cells suppressed.",
    "e15_zip_pressure_metrics": "One row per area: first/last values, long-run and recent growth, real income change, bands.",
    "e16_party_by_25yr_appreciation": "Entities by long-run value-growth band and party; small cells suppressed.",
    "e17_party_by_real_income_change": "Entities by real-income-change band and party; small cells suppressed.",
    "e18_movement_by_25yr_appreciation": "Movement events and rates by long-run value-growth band.",
    "e19_partychange_by_25yr_appreciation": "Party changes and rate by long-run value-growth band.",
    "e20_vh_method_by_party": "Counted votes by year, party and method; small cells suppressed.",
    "e21_vh_method_by_age_band": "Counted votes by age band, party and method; small cells suppressed.",
    "e22_vh_election_participation": "Counted votes by election, party and county; small cells suppressed.",
    "e23_vh_voter_consistency": "Entities by general-election consistency, party, age band and race; small cells suppressed.",
    "e24_vh_method_shift_pre_post": "Counted votes by era, party and method; small cells suppressed.",
    "e25_vh_dropoff_general_cycles": "Distinct general-election voters by cycle year and party; small cells suppressed.",
    "e26_vh_method_by_county": "Counted votes by county and method since the cut year; small cells suppressed.",
}


def materialize_core(spark: SparkSession, sf_dir, run_id: str | None = None, buckets: int | None = None, P=C) -> str:
    """Write the shared intermediates and make the builders read them; returns the run id.

    The panel is bucketed by entity (default bucket count: the session's
    shuffle partitions), so joins against it shuffle only the other side.
    """
    run = run_id or uuid.uuid4().hex[:12]
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    C.clear_plans()
    for name in getattr(P, "RELEASE_CORE", CORE):
        fn = getattr(P, name)
        df = fn(spark, sf_dir, with_static=False) if name == "snapshot" else fn(spark, sf_dir)
        where = f"wavepanel-{run}/{name}"
        if name in BUCKETED:
            copy = materialize_bucketed(spark, df, where, P.SPEC.entity, n)
        else:
            copy = materialize(spark, df, where, PARTITIONED.get(name, ()))
        for part, folder in FOLDERS.get(name, {}).items():
            at = f"{shared_dir(spark, where)}/{folder}"
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # else no line is of that kind
                override(spark, sf_dir, part, spark.read.schema(getattr(P, part)(spark, sf_dir).schema).parquet(at))
        key = {"with_static": False} if name == "snapshot" else {}
        override(spark, sf_dir, fn.__name__, copy, **key)  # the memo key is the builder's own name
    return run


def published(name: str) -> str:
    """Folder of an export: its query's name without the number."""
    return name.split("_", 1)[1]


def publish_exports(spark: SparkSession, sf_dir, out_dir: str, names: Sequence[str] | None = None, restore: bool = True, P=C) -> dict[str, int]:
    """Materialize the core, publish every export (E-queries by default) and the dictionary.

    ``P`` is the preset (commerce stand-in by default; ``plans.registration``
    with a ``Sources`` value for the real extracts)."""
    reg = load_all()
    names = list(names or sorted(n for n in reg if n.startswith("e")))
    run = materialize_core(spark, sf_dir, P=P)
    try:
        frames = {published(name): reg[name][0](spark, sf_dir, P) for name in names}

        def publish(name: str) -> int:
            return publish_csv(frames[published(name)], f"{out_dir.rstrip('/')}/{published(name)}")

        # small jobs on the copies: several at once fill the cores that one leaves idle
        with ThreadPoolExecutor(AT_ONCE) as pool:
            counts = dict(zip(names, pool.map(publish, names)))
        described = {published(n): text for n, text in DESCRIPTIONS.items()}
        publish_csv(data_dictionary(spark, frames, described), f"{out_dir.rstrip('/')}/data_dictionary", ["file"])
        if hasattr(P, "quarantine"):
            bad = P.quarantine(spark, sf_dir)
            save_table(bad, f"{out_dir.rstrip('/')}/rejected_lines")
            counts["rejected_lines"] = bad.count()
        return counts
    finally:
        if restore:
            C.clear_plans()
            drop_run(spark, f"wavepanel-{run}", [n for n in getattr(P, "RELEASE_CORE", CORE) if n in BUCKETED])


# view name -> builder (S10: reuse of a query by name, for SQL users)
VIEWS = {
    "voter_changes": "panel",
    "zip_income": "zip_income",
    "zip_home_values": "zip_home_values",
    "zip_affordability": "zip_affordability",
    "zip_pressure_metrics": "zip_pressure",
    "voter_pressure_long": "entity_pressure",
    "movers_long": "movers_long",
    "voter_history_enriched": "enriched_events",
}


def register_views(spark: SparkSession, src, P=C) -> list[str]:
    """Register a preset's core frames as temporary views (lazy: each view is
    the builder's plan, or its materialized copy after ``materialize_core``)."""
    for view, builder in VIEWS.items():
        getattr(P, builder)(spark, src).createOrReplaceTempView(view)
    return list(VIEWS)
