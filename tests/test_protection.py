"""Hidden cells of two-way tables against linear algebra: none follows from the published cells and totals."""

import random

import numpy as np
import pytest

from wavepanel.operators.protection import protect_margins


def determined(lines):
    """Hidden (row, col) that the equations of all rows and columns, totals included, fix."""
    rows, cols = sorted({x["r"] for x in lines}, key=repr), sorted({x["c"] for x in lines}, key=repr)
    hidden = [(x["r"], x["c"]) for x in lines if x["n"] is None]
    if not hidden:
        return []
    a = np.zeros((len(rows) + len(cols), len(hidden)))
    for k, (r, c) in enumerate(hidden):
        a[rows.index(r), k] = 1 if c != "T" else -1  # the cells of a row less its total
        a[len(rows) + cols.index(c), k] = 1 if r != "T" else -1
    _, s, vt = np.linalg.svd(a)
    free = vt[(s > 1e-9).sum() :]
    return [h for k, h in enumerate(hidden) if not len(free) or np.abs(free[:, k]).max() < 1e-9]


def protected(spark, cells, least):
    t = spark.createDataFrame(cells, "area string, party string, n long")
    got = protect_margins(t, ["area"], ["party"], "n", least).collect()
    lines = [{"r": "T" if x["row_total"] else (x["area"],), "c": "T" if x["col_total"] else (x["party"],), "n": x["n"], "status": x["status"]} for x in got]
    assert len({(x["r"], x["c"]) for x in lines}) == len(lines)
    return lines


def check(spark, cells, least):
    lines = protected(spark, cells, least)
    full = {((r,), (c,)): n for r, c, n in cells}
    for r, c, n in cells:
        for key in (((r,), "T"), ("T", (c,)), ("T", "T")):
            full[key] = full.get(key, 0) + n
    assert {(x["r"], x["c"]) for x in lines} == set(full)
    for x in lines:
        n = full[x["r"], x["c"]]
        assert (x["status"] == "primary") == (n < least)
        assert x["n"] == (n if x["status"] == "published" else None)
    assert determined(lines) == []
    return lines


def test_the_check_itself_finds_cells_that_follow():
    lone = [{"r": ("a",), "c": ("x",), "n": None}, {"r": ("a",), "c": ("y",), "n": 5}, {"r": ("a",), "c": "T", "n": 8}]
    assert determined(lone) == [(("a",), ("x",))]
    # two rectangles joined by one cell: that cell lies on no cycle
    cells = {("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "z"), ("c", "w"), ("d", "z"), ("d", "w"), ("a", "z")}
    lines = [{"r": (r,), "c": (c,), "n": None if (r, c) in cells else 9} for r in "abcd" for c in "xyzw"]
    assert determined(lines) == [(("a",), ("z",))]


@pytest.mark.parametrize("seed", range(6))
def test_random_tables(spark, seed):
    rng = random.Random(seed)
    rows, cols = rng.randint(1, 9), rng.randint(1, 6)
    cells = [(f"r{i}", f"c{j}", rng.choice([1, 2, 3, 8, 20, 30])) for i in range(rows) for j in range(cols) if rng.random() < 0.8] or [("r", "c", 2)]
    check(spark, cells, 5)


def test_bridges_chains_and_lone_cells(spark):
    big = [(r, c, 50) for r in "abcd" for c in "xyzw"]
    small = {("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "z"), ("c", "w"), ("d", "z"), ("d", "w"), ("a", "z")}
    lines = check(spark, [(r, c, 2 if (r, c) in small else n) for r, c, n in big], 5)
    assert any(x["status"] == "secondary" for x in lines)
    check(spark, [("a", "x", 2)], 5)  # the totals are the cell
    check(spark, [("a", "x", 2), ("b", "y", 90)], 5)  # no row in common
    check(spark, [("a", "x", 2), ("a", "y", 90), ("b", "y", 70)], 5)
    check(spark, [(None, "x", 2), (None, None, 70), ("a", None, 60), ("a", "x", 50)], 5)  # null keys are keys


def test_nothing_small_nothing_hidden(spark):
    lines = check(spark, [(r, c, 9) for r in "ab" for c in "xy"], 5)
    assert {x["status"] for x in lines} == {"published"} and len(lines) == 9
    assert [x for x in protected(spark, [], 5) if x["n"]] == []


def test_no_line_in_one_task(spark):
    t = spark.createDataFrame([("a", "x", 2)], "area string, party string, n long")
    plan = protect_margins(t, ["area"], ["party"], "n", 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Exchange SinglePartition" not in plan
