"""Views of the test tables as grids, logs, intervals and lines; each also as a DuckDB common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sizes import parts, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of one row for each user: event types in order."""
    e = table(spark, sf_dir, "events")
    x = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    return e.select(F.col("user_id").alias("grid_id"), F.lit(0).cast("long").alias("y"), x.alias("x"), F.col("event_type").alias("code"))


CELLS_EVENTS = "cells AS (SELECT user_id AS grid_id, 0::BIGINT AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS x, event_type AS code FROM events)"


def cells_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid for each supplier: a row for each month shipped, and a cell for each line."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    y = ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1).cast("long")
    li = spread(li.withColumn("y", y), parts(li), "l_suppkey", "y")
    x = F.row_number().over(Window.partitionBy("l_suppkey", "y").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")).cast("long") - 1
    return li.select(F.col("l_suppkey").alias("grid_id"), "y", x.alias("x"), F.concat("l_returnflag", "l_linestatus").alias("code"))


CELLS_LINEITEM = """cells AS (SELECT grid_id, y, row_number() OVER (PARTITION BY grid_id, y ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS x, code FROM
  (SELECT l_suppkey AS grid_id, (year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS y, l_returnflag || l_linestatus AS code, l_shipdate, l_orderkey, l_linenumber, l_partkey FROM lineitem))"""

RUNS = """islands AS (SELECT *, sum(new) OVER (PARTITION BY grid_id, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS r FROM
  (SELECT *, CASE WHEN lag(code) OVER (PARTITION BY grid_id, y ORDER BY x) = code THEN 0 ELSE 1 END AS new FROM cells)),
runs AS (SELECT grid_id, y, (r - 1)::BIGINT AS run_no, code, count(*)::BIGINT AS n, min(x)::BIGINT AS x0 FROM islands GROUP BY grid_id, y, r, code)"""

PASSES = """p0 AS (SELECT *, dense_rank() OVER (PARTITION BY grid_id ORDER BY y DESC)::BIGINT AS pass_no FROM runs),
p1 AS (SELECT *, CASE WHEN pass_no % 2 = 1 THEN 'RS' ELSE 'WS' END AS side, CASE WHEN pass_no % 2 = 1 THEN 'rtl' ELSE 'ltr' END AS direction FROM p0),
p2 AS (SELECT grid_id, pass_no, side, direction, y AS grid_row, row_number() OVER (PARTITION BY grid_id, pass_no ORDER BY CASE WHEN direction = 'rtl' THEN -x0 ELSE x0 END) - 1 AS run_no, code, n, x0 FROM p1),
passes AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY grid_id ORDER BY pass_no, run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cells_before FROM p2)"""


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A progress log for each user; the position is the running count of purchases and clicks, less for returns back."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    pos = F.sum(F.when(F.pmod("event_id", F.lit(5)) == 0, -1).otherwise(2)).over(w)
    return e.select(F.col("user_id").alias("project"), F.col("ts").alias("t"), F.col("event_id").alias("seq"), pos.alias("pos"), "event_type")


LOG_EVENTS = "log AS (SELECT user_id AS project, ts AS t, event_id AS seq, sum(CASE WHEN event_id % 5 = 0 THEN -1 ELSE 2 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS pos FROM events)"
SESSIONS = """marked AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY project ORDER BY t, seq), 0) AS prev,
  CASE WHEN lag(t) OVER (PARTITION BY project ORDER BY t, seq) IS NOT NULL AND t <= lag(t) OVER (PARTITION BY project ORDER BY t, seq) + INTERVAL 1200 SECOND THEN 0 ELSE 1 END AS new FROM log),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY project ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS s FROM marked),
sessions AS (SELECT project, s, min(t) AS "start", max(t) AS "end", count(*)::BIGINT AS n_events, datesub('second', min(t), max(t))::BIGINT AS active_seconds,
  greatest(0, arg_max(pos, (t, seq)) - arg_min(prev, (t, seq)))::BIGINT AS cells FROM numbered GROUP BY project, s)"""


def intervals_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals for each nation over its customers' numbers: each begins at a customer and ends before the next but two; the last is open."""
    c = table(spark, sf_dir, "customer")
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    d = c.withColumn("k", F.row_number().over(w)).filter("k % 3 = 1")
    to = F.lead("c_custkey").over(w) - 1 - F.when(F.pmod("c_custkey", F.lit(7)) == 0, 2).otherwise(0)
    return d.select("c_nationkey", F.col("c_custkey").alias("from_"), to.alias("to_"), F.col("c_name").alias("text"))


INTERVALS = """picked AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
intervals AS (SELECT c_nationkey, c_custkey AS from_, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 - CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 0 END AS to_, c_name AS text FROM picked WHERE k % 3 = 1)"""


def palette_of(cells: DataFrame) -> DataFrame:
    return cells.select("code").distinct()
