"""Queries whose results depend on an order of steps; what SQL cannot express, tests hold against plain versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import machine, prose, runs, sequence
from ..operators.sizes import parts, spread
from ..sources import charts
from ..functions import color
from .adapters import CELLS_LINEITEM, PASSES, RUNS, cells_events, cells_lineitem, table


def _passes(s, d):
    return sequence.passes(runs.rle_encode(cells_lineitem(s, d)))


def segments_fold(s, d):
    return machine.segments(spread(_passes(s, d), parts(table(s, d, "lineitem")), "grid_id", "pass_no"))


def _log(s, d):
    e = table(s, d, "events")
    action = F.when(F.col("event_id") % 11 == 0, "jump").when(F.col("event_id") % 5 == 0, "back").otherwise("advance")
    return e.select(F.col("user_id").alias("project"), F.col("event_id").alias("seq"), action.alias("action"), (F.col("event_id") % 7 + 1).alias("row"))


def written_engine_replay(s, d):
    return machine.replay_written(_log(s, d), 40)


def greedy_clusters(s, d):
    """Clusters of the colours that parts' numbers give, by size."""
    i = F.col("p_partkey")
    p = table(s, d, "part").select(F.col("p_size").cast("long").alias("size"), (i % 97).alias("key"))
    c = color.lab(F.col("key") * 37 % 256, F.col("key") * 91 % 256, F.col("key") * 53 % 256)
    return machine.cluster_palette(p.withColumn("c", c).select("size", "key", "c.*"), "size", "key", ["l", "a", "b"], 12.0)


def prose_repeats(s, d):
    """Bodies with repeats, built from orders and expanded."""
    o = table(s, d, "orders").select("o_orderkey", F.concat(F.lit("2 A, ("), F.col("o_orderkey") % 5 + 1, F.lit(" B, 1 C) "), F.col("o_orderkey") % 4 + 1, F.lit(" times, 3 A")).alias("body"))
    return o.select("o_orderkey", F.posexplode(prose.expanded_runs(F.col("body"), F.lit(None).cast("int"))).alias("run_no", "r")).select("o_orderkey", "run_no", "r.code", "r.n")


def chart_documents(s, d):
    """A chart document for each supplier's grid."""
    r = runs.rle_encode(cells_lineitem(s, d))
    palette = r.select("grid_id", "code").distinct().select("grid_id", "code", F.col("code").alias("name"), F.lit("#00ff00").alias("hex"))
    return charts.chart_documents(r, palette, F.concat(F.lit("supplier "), F.col("grid_id")))


def csv_grids(s, d):
    return charts.csv_grid(cells_events(s, d))


QUERIES = {f.__name__: f for f in (segments_fold, written_engine_replay, greedy_clusters, prose_repeats, chart_documents, csv_grids)}
#: Segments of a table of passes.
SEGMENTS = """rs AS (SELECT grid_id, pass_no, list({'code': code, 'n': n} ORDER BY run_no) AS r, count(*)::BIGINT AS k FROM passes GROUP BY 1, 2),
e AS (SELECT *, CASE WHEN k >= 8 AND len(list_filter(r[1:8], lambda x: x.n > 4)) = 0 THEN 8 ELSE 0 END AS low, CASE WHEN k >= 16 AND len(list_filter(r[k - 7:k], lambda x: x.n > 4)) = 0 THEN k - 8 ELSE k END AS high FROM rs),
m AS (SELECT grid_id, pass_no, i, max(CASE WHEN reps >= 3 THEN reps * p * 10 + 5 - p END) AS best FROM (
  SELECT grid_id, pass_no, i, p, 1 + (coalesce(list_filter(range(i, high), lambda j: NOT (j + p < high AND r[j + 1] = r[j + p + 1]))[1], high) - i) // p AS reps FROM (SELECT *, unnest(range(low, high)) AS i FROM e), (VALUES (2), (3), (4)) v(p)) GROUP BY 1, 2, 3),
w AS (SELECT grid_id, pass_no, i, r[i + 1].n AS n, coalesce(best // 10, 1) AS size, CASE WHEN best IS NOT NULL THEN 5 - best % 10 END AS p FROM m JOIN e USING (grid_id, pass_no)),
g AS (SELECT grid_id, pass_no, low::BIGINT AS i FROM e UNION ALL SELECT g.grid_id, g.pass_no, (g.i + size)::BIGINT FROM g JOIN w USING (grid_id, pass_no, i)),
seg AS (SELECT grid_id, pass_no, CASE WHEN p IS NOT NULL THEN 'repeat' WHEN n >= 20 THEN 'fill' ELSE 'run' END AS kind, i AS "start", (i + size)::BIGINT AS "end", coalesce(p, 0)::BIGINT AS period, coalesce(size // p, 0)::BIGINT AS repetitions FROM g JOIN w USING (grid_id, pass_no, i)
UNION ALL SELECT grid_id, pass_no, 'braid', 0, 8, 0, 0 FROM e WHERE low > 0 UNION ALL SELECT grid_id, pass_no, 'braid', high, k, 0, 0 FROM e WHERE high < k)"""
ORACLE = {
    "segments_fold": f"WITH RECURSIVE {CELLS_LINEITEM}, {RUNS}, {PASSES}, {SEGMENTS} SELECT * FROM seg",
    "written_engine_replay": """WITH RECURSIVE l AS (SELECT user_id AS project, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE WHEN event_id % 11 = 0 THEN 'jump' WHEN event_id % 5 = 0 THEN 'back' ELSE 'advance' END AS action, event_id % 7 + 1 AS target FROM events),
s AS (SELECT DISTINCT project, 0::BIGINT AS seq, 0::BIGINT AS i, 1::BIGINT AS pos FROM l UNION ALL
  SELECT l.project, l.seq, l.i, (CASE action WHEN 'advance' THEN least(s.pos + 1, 41) WHEN 'back' THEN greatest(s.pos - 1, 1) ELSE target END)::BIGINT FROM s JOIN l ON l.project = s.project AND l.i = s.i + 1)
SELECT project, seq, least(pos, 40) AS "row", pos > 40 AS finished FROM s WHERE i > 0""",
    "chart_documents": f"""WITH {CELLS_LINEITEM}, {RUNS}, rw AS (SELECT grid_id, y, string_agg(n || code, '' ORDER BY run_no) AS runs, sum(n)::BIGINT AS w FROM runs GROUP BY 1, 2),
d AS (SELECT grid_id, list(runs ORDER BY y) AS rs, max(w) AS width, count(*) AS height FROM rw GROUP BY 1), p AS (SELECT grid_id, list(DISTINCT code) AS cs FROM runs GROUP BY 1),
j AS (SELECT grid_id, width, height, '["' || array_to_string(rs, '","') || '"]' AS rows_json, list_sort(cs) AS cs FROM d JOIN p USING (grid_id)),
i AS (SELECT *, 'sha256:' || sha256('{{"codes":["' || array_to_string(cs, '","') || '"],"rows":' || rows_json || '}}') AS id FROM j)
SELECT grid_id, id, '{{"schema":2,"pattern":{{"title":"supplier ' || grid_id || '"}},"chart":{{"id":"' || id || '","width":' || width || ',"height":' || height || '}},"palette":['
  || array_to_string(list_transform(cs, lambda c: '{{"code":"' || c || '","name":"' || c || '","hex":"#00ff00"}}'), ',') || '],"rows":' || rows_json || '}}' AS json FROM i""",
    "csv_grids": "SELECT user_id AS grid_id, 0::BIGINT AS y, string_agg(event_type, ',' ORDER BY ts, event_id) AS value FROM events GROUP BY 1",
    "prose_repeats": """WITH o AS (SELECT o_orderkey, o_orderkey % 5 + 1 AS b, o_orderkey % 4 + 1 AS t FROM orders), r AS (SELECT *, unnest(range(0, 2 * t + 2)) AS i FROM o)
SELECT o_orderkey, i::INTEGER AS run_no, CASE WHEN i = 0 OR i = 2 * t + 1 THEN 'A' WHEN i % 2 = 1 THEN 'B' ELSE 'C' END AS code, (CASE WHEN i = 0 THEN 2 WHEN i = 2 * t + 1 THEN 3 WHEN i % 2 = 1 THEN b ELSE 1 END)::INTEGER AS n FROM r""",
}
