"""What showed only on larger tables: parts of seconds, and plans that send a drawn table to the driver."""

import datetime as dt

from pyspark.sql import functions as F

from weftline.operators import islands, match, project, sequence, shapes

T0 = dt.datetime(2026, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_gap_has_parts_of_seconds(spark):
    d = spark.createDataFrame([(1, at(0), 0, 2), (1, at(1200), 1, 4), (1, at(2400.5), 2, 6)], "project long, t timestamp_ntz, seq long, pos long")
    got = islands.session_deltas(d).orderBy("start").collect()
    assert [(r.cells, r.active_seconds) for r in got] == [(4, 1200), (2, 0)]
    assert islands.sessions(d).count() == 2


def test_gap_of_projects_has_parts_of_seconds(spark):
    log = spark.createDataFrame([(1, "a", 1, at(0), 0, "advance", 2), (1, "a", 1, at(1200), 1, "advance", 3), (1, "a", 1, at(2400.5), 2, "advance", 4)], "project long, piece string, copy long, t timestamp_ntz, seq long, kind string, row long")
    manifest = spark.createDataFrame([(1, "a", 9)], "project long, piece string, total long")
    assert [r["rows"] for r in project.project_sessions(log, manifest).orderBy("start").collect()] == [2, 1]


def test_drawn_tables_do_not_go_to_the_driver(spark):
    few = spark.range(20).selectExpr("id AS grid_id", "id % 3 AS p_size")
    cells = shapes.drawn(few, 9, 6).withColumn("code", F.lit("A"))
    pages = spark.range(20).selectExpr("id AS grid_id", "explode(array(1, 2)) AS page", "1 AS a", "4 AS b", "6 AS width", "1 AS c", "5 AS d", "5 AS height")
    points = spark.range(20).selectExpr("id AS grid_id", "explode(array(0, 1)) AS i").selectExpr("grid_id", "'a' AS line", "i", "double(i) AS py", "double(i * 9) AS px")
    near = shapes.polyline_cells(cells.select("grid_id", "y", "x"), points, ["grid_id"], "line", 1.3)
    paged = cells.withColumn("page", F.lit(1))
    for d in (shapes.no_stitch_code(cells), match.orientation(cells, cells), sequence.tile_problems(pages, paged), near, shapes.crossings(near, ["grid_id"], "line", 4.0)):
        assert "BroadcastExchange" not in d._jdf.queryExecution().executedPlan().toString()
    assert cells.count() == 20 * 54
