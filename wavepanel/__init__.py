"""wavepanel: snapshot-panel analytics as Spark DataFrame operators.

Periodic full-population snapshots plus an event log are turned into a
per-entity change panel, area indicators, transition events and
small-cell-suppressed cross-tabs.  Every operator is a DataFrame -> DataFrame
function built from Spark SQL expressions so Catalyst can prune, push down and
plan the shuffles.

Entry points:

* ``wavepanel.operators`` -- the operators (panel, areas, transitions, events, measures)
* ``wavepanel.sources`` -- tolerant text / JSON / CSV / wide readers and publishers
* ``wavepanel.plans.registration`` -- the voter-file preset over extract files
  (``Sources``, ``panel``, ``published_exports``, ``headline_queries``, ``report_measures``)
* ``wavepanel.plans.commerce`` -- the stand-in preset over the driver's tables
* ``wavepanel.plans.release`` -- materialize shared intermediates, publish every export
* ``wavepanel.streaming.ingest`` -- the snapshot ingest as an available-now stream
"""

__version__ = "0.1.0"
