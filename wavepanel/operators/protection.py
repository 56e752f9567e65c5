"""Complementary suppression: published margins must not give hidden cells away.

``suppress`` drops small cells; a reader who has the totals of a row gets a lone
hidden cell back by subtraction, and a chain of such steps reveals more.  Seen as
a graph with a node for each line of the table (rows, columns and the two lines
of totals) and an edge for each hidden cell, a cell follows from the totals if
and only if its edge lies on no cycle.  ``protect_margins`` hides further cells
until every hidden one is a corner of a rectangle of hidden cells, the shortest
cycle: then each may be one more or one less with all totals as published.

Everything is grouped by line or by the set of hidden columns of a row, with
partial aggregation; no line has to fit in a task, and no step is repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavepanel.session import written


def _lines(cells: DataFrame, rows: Sequence[str], cols: Sequence[str], count: str) -> DataFrame:
    """Cells and all margins as (r, c, n); a line is a struct of its flag of totals and its keys."""
    keyed = cells.select(F.struct(*rows).alias("_r"), F.struct(*cols).alias("_c"), F.col(count).alias("_n"))
    cube = keyed.cube("_r", "_c").agg(F.sum("_n").cast("bigint").alias("n"), F.grouping("_r").alias("_rt"), F.grouping("_c").alias("_ct"))
    return cube.select(
        F.struct(F.col("_rt").cast("int").alias("total"), *[F.col("_r")[k].alias(k) for k in rows]).alias("r"),
        F.struct(F.col("_ct").cast("int").alias("total"), *[F.col("_c")[k].alias(k) for k in cols]).alias("c"),
        "n",
    )


def _completed(table: DataFrame, line: str, other: str) -> DataFrame:
    """In each line with one hidden cell the smallest other one is hidden, too."""
    place = F.struct("n", other)
    lone = table.groupBy(F.col(line).alias("_line")).agg(F.count_if("hidden").alias("_h"), F.min(F.when(~F.col("hidden"), place)).alias("_next"))
    lone = lone.filter("_h = 1 and _next is not null").select("_line", "_next")
    joined = table.join(lone, F.col(line) == F.col("_line"), "left")
    return joined.withColumn("hidden", F.col("hidden") | F.coalesce(place == F.col("_next"), F.lit(False))).drop("_line", "_next")


def _unsupported(table: DataFrame, total_col: Column) -> DataFrame:
    """(r, c, mate): hidden cells that are no corner of a hidden rectangle, and the column to make one with.

    Rows with the same hidden columns are taken together, so that the pairs of
    columns are counted once for each such set and not for each row.
    """
    by_row = table.filter("hidden").groupBy("r").agg(F.array_sort(F.collect_set("c")).alias("own"))
    sets = by_row.groupBy("own").agg(F.count(F.lit(1)).alias("k"))
    others = F.array_remove(F.col("own"), F.col("c1"))
    pairs = sets.select("k", "own", F.explode("own").alias("c1")).select("k", "c1", F.explode(others).alias("c2"))
    support = pairs.groupBy("c1", "c2").agg(F.sum("k").alias("k"))
    seen = sets.select("own", F.explode("own").alias("c1")).select("own", "c1", F.explode_outer(others).alias("c2"))
    weak = seen.join(support, ["c1", "c2"], "left").groupBy("own", "c1").agg(F.max(F.coalesce("k", F.lit(0))).alias("k")).filter("k < 2")
    found = by_row.join(weak.select("own", "c1"), "own").select("r", F.col("c1").alias("c"), F.array_min(others).alias("mate"))
    free = table.filter("not hidden").groupBy("r").agg(F.min(F.struct("n", "c"))["c"].alias("_free"))
    only_totals = (F.col("r.total") == 1) & (F.col("c.total") == 0)  # two columns may have no row in common but that of totals
    mate = F.when(only_totals, total_col).otherwise(F.coalesce("mate", "_free"))
    return found.join(free, "r", "left").select("r", "c", mate.alias("mate")).filter("mate is not null")


def _corners(table: DataFrame, weak: DataFrame) -> DataFrame:
    """The other three corners, in the row where they hide least, of a rectangle for each weak cell."""
    wanted = weak.select("c", "mate").distinct()
    one = table.select("r", "c", F.when(F.col("hidden"), 0).otherwise(F.col("n")).alias("_cost1"))
    two = table.select("r", F.col("c").alias("mate"), F.when(F.col("hidden"), 0).otherwise(F.col("n")).alias("_cost2"))
    rows = one.join(wanted, "c").join(two, ["r", "mate"])
    rank = F.row_number().over(Window.partitionBy("c", "mate").orderBy(F.col("_cost1") + F.col("_cost2"), "r"))
    best = rows.withColumn("_rank", rank).filter("_rank <= 2").groupBy("c", "mate").agg(F.array_sort(F.collect_list(F.struct("_rank", "r"))).alias("_rows"))
    # the cheapest row, or the second where the cheapest is the cell's own
    across = F.when(F.col("_rows")[0]["r"] == F.col("r"), F.get("_rows", F.lit(1))["r"]).otherwise(F.col("_rows")[0]["r"])
    chosen = weak.join(best, ["c", "mate"]).select("r", "c", "mate", across.alias("x")).filter("x is not null")
    corner = F.explode(F.array(F.struct("r", F.col("mate").alias("c")), F.struct(F.col("x").alias("r"), "c"), F.struct(F.col("x").alias("r"), F.col("mate").alias("c"))))
    return chosen.select(corner.alias("_k")).select("_k.r", "_k.c").distinct()


def protect_margins(cells: DataFrame, rows: Sequence[str], cols: Sequence[str], count: str, min_cell: int) -> DataFrame:
    """The two-way table of ``cells`` with its margins, small counts and what would reveal them hidden.

    ``cells`` has one row for each combination of ``rows`` and ``cols`` with a
    ``count`` of at least 1.  Returns ``rows``, ``cols``, ``row_total`` and
    ``col_total`` (true for the margins, whose keys are NULL), ``count`` (NULL
    where hidden) and ``status``: published, primary (a count, also of a
    margin, under ``min_cell``) or secondary.
    """
    total_col = F.struct(F.lit(1).alias("total"), *[F.lit(None).cast(cells.schema[k].dataType).alias(k) for k in cols])
    table = _lines(cells, rows, cols, count).withColumn("hidden", F.col("n") < F.lit(min_cell))
    # the few cells of the table are written: each step reads them several times
    table = written(table.withColumn("primary", F.col("hidden")))
    table = written(_completed(_completed(table, "r", "c"), "c", "r"))
    corners = _corners(table, _unsupported(table, total_col)).withColumn("_corner", F.lit(True))
    table = table.join(corners, ["r", "c"], "left")
    hidden = F.col("hidden") | F.col("_corner").isNotNull()
    return table.select(
        *[F.col("r")[k].alias(k) for k in rows],
        *[F.col("c")[k].alias(k) for k in cols],
        (F.col("r.total") == 1).alias("row_total"),
        (F.col("c.total") == 1).alias("col_total"),
        F.when(~hidden, F.col("n")).alias(count),
        F.when(F.col("primary"), "primary").when(hidden, "secondary").otherwise("published").alias("status"),
    )
