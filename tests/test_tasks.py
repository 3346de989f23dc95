"""What a task holds does not grow with the tables: rows are dealt over as many tasks as there are rows for, and pairs go out as they are found."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import intervals, shapes, sizes
from weftline.plans.queries import QUERIES

#: Queries whose last stage is a dealt one, and others that have a dealt stage before it.
LAST = ("boustrophedon_sequence", "rounds_sequence", "prefix_cells_before", "written_rows_text", "written_to_grid", "segments_fold", "run_overlay", "run_cross_check", "row_number_problems", "grammar_runs")
SOME = ("live_states", "cursor_lookup", "pass_rules", "cross_check_rows", "shaping_deltas", "shaping_sentences", "live_activities", "look_ahead_sentences", "stretches")


def test_parts_follow_rows(spark, monkeypatch):
    monkeypatch.setattr(sizes, "TASK_ROWS", 100)
    assert [sizes.parts(spark.range(n)) for n in (0, 1, 1000, 10000)] == [1, 1, 10, 100] and sizes.parts(spark.range(1000), 4) == 40


@pytest.mark.parametrize("name", LAST + SOME)
def test_large_tables_have_more_tasks(spark, sf, monkeypatch, name):
    monkeypatch.setattr(sizes, "TASK_ROWS", 600)
    d = QUERIES[name](spark, sf)
    assert "REPARTITION_BY_NUM" in d._jdf.queryExecution().executedPlan().toString()
    if name in LAST:
        assert d.rdd.getNumPartitions() >= 10  # a shuffle of the tests has four


def test_pairs_of_single_segments_are_not_moved(spark):
    lines = spark.createDataFrame([("k", 1, 0, 4), ("k", 2, 0, 9), ("k", 2, 1, 8), ("k", 3, 20, 30)], "key string, line long, s long, e long")
    spans = spark.createDataFrame([("k", "a", 0, 10), ("k", "b", 22, 24), ("k", "b", 26, 28)], "key string, span string, lo long, hi long")
    d = shapes.fitting_lines(lines, spans, ["key"])
    assert sorted(tuple(r) for r in d.collect()) == [("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b")]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union")  # an aggregate over all pairs came first before


def test_covered_pairs_nothing(spark):
    runs = spark.createDataFrame([("d", "A", 0, 5), ("d", "A", 3, 9), ("d", "A", 3, 9), ("d", "B", 0, 40), ("d", "A", 2, 0), ("d", "A", 7, None), ("d", None, 0, 9), ("e", "A", 0, 5)], "doc string, code string, x0 long, n long")
    inside = spark.createDataFrame([("d", "A", 0, 4), ("d", "B", 4, 3), ("d", "A", 7, 2), ("d", "A", 9, 30), ("d", None, 50, 2), ("d", "A", 90, 0)], "doc string, code string, x0 long, n long")
    d = intervals.covered(runs, inside, ["doc"])
    got = sorted(((r.code, r.x0, r.n, r.matched) for r in d.filter("doc = 'd'").collect()), key=repr)
    assert got == sorted([("A", 0, 5, 4), ("A", 3, 9, 6), ("A", 3, 9, 6), ("B", 0, 40, 3), ("A", 2, 0, 0), ("A", 7, None, 0), (None, 0, 9, 0)], key=repr)
    assert d.filter("doc = 'e'").select(F.sum("matched")).first()[0] == 0 and d.columns == [*runs.columns, "matched"]
    assert "Join" not in d._jdf.queryExecution().executedPlan().toString()
