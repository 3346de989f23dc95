"""Strands through drawn grids: no grid is drawn whole, and what is dealt by grid is moved once."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import shapes
from weftline.plans.queries import QUERIES


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["woven_strands", "strand_crossings", "polyline_cells"])
def test_strands_are_moved_once(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan  # the parts' numbers, before lines are drawn


def test_traced_equals_polyline_cells(spark):
    rng = random.Random(5)
    lines = {("g", k): [(rng.uniform(-6, 20), rng.uniform(-6, 30)) for _ in range(rng.randint(1, 5))] for k in range(8)}
    lines |= {("g", 8): [(3.0, 4.0), (3.0, 4.0), (3.0, 12.0), (9.0, 12.0)], ("h", 1): [(-9.0, -9.0), (-5.0, 90.0)], ("h", 2): [(0.0, 0.0), (13.0, 21.0), (0.0, 21.0)]}
    points = spark.createDataFrame([(*k, i, y, x) for k, p in lines.items() for i, (y, x) in enumerate(p)], "by string, line long, i int, py double, px double")
    cells = shapes.drawn(spark.createDataFrame([("g",), ("h",)], "by string"), 22, 14)
    for reach in (0.0, 1.0, 1.3, 9.5):
        got = told(shapes.traced(points, 22, 14, ["by"], "line", reach))
        assert got == told(shapes.polyline_cells(cells, points, ["by"], "line", reach)) and got


def test_windows_of_a_column_equal_a_table(spark):
    rng = random.Random(6)
    strands = [(g, k, y, x) for g in "gh" for k in "abc" for y in range(9) for x in range(9) if rng.random() < 0.4]
    df = spark.createDataFrame(strands, "by string, line string, y long, x long")
    over = F.when((F.col("y") + F.col("x")) % 4 == 0, "a").when(F.col("x") % 3 == 0, "b").when(F.col("y") % 2 == 0, "c")
    windows = shapes.drawn(spark.createDataFrame([("g",), ("h",)], "by string"), 11, 11).withColumn("over", over).filter("over IS NOT NULL")

    def top(y, x):
        return "a" if (y + x) % 4 == 0 else "b" if x % 3 == 0 else "c" if y % 2 == 0 else None

    at = set(strands)
    beside = lambda g, k, y, x: any((g, k, y + i, x + j) in at and top(y + i, x + j) == k for i in (-1, 0, 1) for j in (-1, 0, 1))
    lost = {(g, k, y, x) for g, k, y, x in strands if (u := top(y, x)) not in (None, k) and (g, u, y, x) not in at and beside(g, u, y, x)}
    want = sorted(at - lost, key=repr)
    assert told(shapes.woven(df, windows, ["by"], "line")) == want == told(shapes.woven(df, over, ["by"], "line")) and lost
