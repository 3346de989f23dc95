"""Queries over projects of several pieces, shapes and units."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import units
from ..operators import match, project, runs, sequence, shapes, sizes, text
from ..operators.sizes import parts, spread
from .adapters import CELLS_LINEITEM, INTERVALS, LOG_EVENTS, PASSES, RUNS, SESSIONS, cells_lineitem, intervals_customers, table


def _entries(s, d):
    e = intervals_customers(s, d)
    count = F.when(F.col("from_") % 40 > 0, F.col("from_") % 9 + 1)
    return e.select((F.col("from_") % 60).alias("key"), "from_", F.when(F.col("from_") % 50 > 0, F.coalesce("to_", F.col("from_") + 3)).alias("to_"), count.alias("count"))


def written_totals(s, d):
    return project.written_totals(_entries(s, d), ["key"])


def stitches_before(s, d):
    cursors = _entries(s, d).select("key").distinct().withColumn("row", F.col("key") * 20 + 30)
    return project.stitches_before(_entries(s, d), cursors, ["key"])


def _log(s, d):
    e = table(s, d, "events")
    w = Window.partitionBy("user_id", F.col("event_id") % 3).orderBy("ts", "event_id")
    row = F.least(F.lit(9), F.row_number().over(w) / 3 + 1).cast("long")
    return e.select(F.col("user_id").alias("project"), F.concat(F.lit("p"), F.col("event_id") % 3).alias("piece"), F.lit(1).alias("copy"), F.col("ts").alias("t"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 == 0, "back").otherwise("advance").alias("kind"), row.alias("row"))


def _manifest(s, d):
    u = table(s, d, "events").select(F.col("user_id").alias("project")).distinct()
    return u.withColumn("piece", F.explode(F.array(F.lit("p0"), F.lit("p1")))).withColumn("total", F.when(F.col("piece") == "p0", 9)).withColumn("make", F.when(F.col("piece") == "p0", 2))


def project_sessions(s, d):
    return project.project_sessions(_log(s, d), _manifest(s, d))


def project_figures(s, d):
    p = _log(s, d).groupBy("project", "piece").agg((F.max("row") >= 9).alias("finished"))
    return project.project_figures(p, _manifest(s, d))


def estimated_finish(s, d):
    """When users have done 5,000 cells, by their last fourteen days before a fixed time."""
    from .logs import active_seconds_pace, session_cell_deltas

    remaining = active_seconds_pace(s, d).select("project", (5000 - F.col("cells")).alias("remaining"), F.col("cells_per_hour").alias("per_hour"))
    now = F.lit("2024-01-25 12:00:00").cast("timestamp_ntz")
    return project.estimated_finish(session_cell_deltas(s, d), remaining, now).withColumn("days", F.bround("days", 4))


def manifest_rollup(s, d):
    r = runs.rle_encode(cells_lineitem(s, d))
    return project.manifest_charts(runs.stats(r), r.select("grid_id", "code"))


def live_states(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("project"), F.col("c_custkey").alias("grid_id"), (F.col("c_custkey") % 30 + 1).alias("row"), (F.col("c_custkey") % 6).alias("run"))
    n = parts(table(s, d, "lineitem"))
    return project.live_state(c, spread(sequence.passes(runs.rle_encode(cells_lineitem(s, d))), n, "grid_id", "pass_no"), n)


def row_number_problems(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("long").alias("n"))
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 6).alias("height"))
    return project.row_number_problems(li, o, ["key"], "n", parts(table(s, d, "lineitem")))


def unique_slugs(s, d):
    p = table(s, d, "part").select((F.col("p_size") % 7).cast("long").alias("key"), "p_partkey", F.lower(F.substring("p_name", 1, 6)).alias("base"))
    return project.unique_slugs(p, "key", "p_partkey", "base")


def body_chunks(s, d):
    c = table(s, d, "customer").select("c_custkey", F.array_join(F.transform(F.sequence(F.lit(1), (F.col("c_custkey") % 23 + 1).cast("int")), lambda i: F.concat(i.cast("string"), F.lit(" A"))), ", ").alias("body"))
    return project.chunks(c, ["c_custkey"], "body", 5)


def gap_clusters(s, d):
    li = table(s, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return shapes.gap_clusters(li, ["l_suppkey"], "l_partkey")


def longest_runs(s, d):
    return shapes.longest_runs(cells_lineitem(s, d), "NO", 2)


def dilated(s, d):
    return shapes.dilate(cells_lineitem(s, d).filter("code = 'AF'"), ["grid_id"])


def filled_box(s, d):
    return shapes.rect(cells_lineitem(s, d), 10, 2, 20, 5, "ZZ").groupBy("grid_id", "code").agg(F.count("*").alias("n"))


def no_stitch_codes(s, d):
    """The ground of small shaped pieces made from the months' rows."""
    c = shapes.drawn(table(s, d, "part").select(F.col("p_partkey").alias("grid_id"), "p_size"), 9, 6)
    code = F.when((F.col("x") - 4 > -1 - F.col("y") % 4 + F.col("p_size") % 3) & (F.col("x") - 4 < 2 + F.col("y") % 3) & ((F.col("p_size") + F.col("y")) % 11 > 0), "A").otherwise("N")
    return shapes.no_stitch_code(c.select("grid_id", "y", "x", code.alias("code")))


def suppressed_boxes(s, d):
    p = table(s, d, "part")
    i = F.col("p_partkey")
    return shapes.suppress(p.select(F.floor(i / 40).alias("page"), i.alias("box"), (i * 37 % 200).alias("x0"), (i * 53 % 200).alias("y0"), (i * 37 % 200 + 20 + i * 7 % 90).alias("x1"), (i * 53 % 200 + 20 + i * 11 % 90).alias("y1")), "page")


def cell_medians(s, d):
    """Medians of cells of five pixels in pictures that parts' numbers draw."""
    p = shapes.drawn(table(s, d, "part").select(F.col("p_partkey").alias("picture")), 25, 25)
    v = lambda k: (F.col("picture") * k + F.col("y") * 13 + F.col("x") * 7) % 256
    return shapes.cell_medians(p.select("picture", F.col("y").alias("py"), F.col("x").alias("px"), v(3).alias("r"), v(5).alias("g"), v(11).alias("b")), 5)


def finished_sizes(s, d):
    p = table(s, d, "part").select("p_partkey", "p_size")
    unit = F.when(F.col("p_partkey") % 2 == 0, "cm").otherwise("in")
    per = units.cells_per_inch(F.col("p_size"), F.lit(4.0), unit)
    return p.select("p_partkey", units.finished_size(F.lit(100), per, unit).alias("size"), units.plain_number(F.col("p_size") / 2.0).alias("half"))


def stitch_names(s, d):
    p = table(s, d, "part").select("p_partkey")
    code = F.element_at(F.array(*[F.lit(x) for x in ("sc", " DC", "htr", "zz", "sl st")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", units.stitch_name(code, F.when(F.col("p_partkey") % 2 == 0, "uk").otherwise("us"), F.lit("own")).alias("name"))


def label_thinning(s, d):
    li = table(s, d, "lineitem").select("l_suppkey", F.col("l_partkey").cast("double").alias("at"))
    return shapes.thinned(li, ["l_suppkey"], "at", 16.0, 8)


def default_first(s, d):
    c = table(s, d, "customer").select("c_nationkey", "c_custkey", (F.col("c_custkey") % 17 == 0).alias("is_default"))
    return project.default_first(c, ["c_nationkey"], "c_custkey")


def section_fitting(s, d):
    """The section of each supplier's months that fits a height, else the longest."""
    cells = cells_lineitem(s, d).groupBy("grid_id", F.floor(F.col("y") / 12).alias("section")).agg(F.max(F.col("y") % 12 + 1).alias("last_row"), F.count_distinct("y").alias("n_rows"), F.max("x").alias("w"))
    sections_ = cells.select("grid_id", "section", "last_row", "n_rows", (F.col("w") % 2 == 0).alias("is_colour"))
    return project.section_fitting(sections_, table(s, d, "supplier").select(F.col("s_suppkey").alias("grid_id"), (F.col("s_suppkey") % 12 + 1).alias("height")), ["grid_id"])


def chart_versions(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("pattern"), F.col("o_orderpriority").alias("variant"), F.col("o_orderstatus").alias("gauge_key"), F.col("o_orderkey"))
    now = o.groupBy("pattern", "variant", "gauge_key").agg(F.max("o_orderkey").alias("id")).filter("id % 5 > 0")
    return project.chart_versions(o.select("pattern", "variant", "gauge_key", F.col("o_orderkey").alias("id")), now, ["pattern"])


def strided_rows(s, d):
    return project.strided(table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], 40)


def covered_parts(s, d):
    p, k = table(s, d, "part"), F.col("p_partkey")
    row1 = F.element_at(F.array(*[F.lit(x) for x in ("bottom-right", "bottom-left", "top-right", "top-left")]), (k % 4 + 1).cast("int"))
    return project.covered_part(p.select("p_partkey", (k % 9 + 1).alias("r0"), (k % 7 + 3).alias("r1"), (k % 5 + 2).alias("c0"), (k % 8 + 1).alias("c1"), F.lit(20).alias("width"), F.lit(30).alias("height"), row1.alias("row1")))


def _pictures(s, d):
    """A grid of six by five for each part."""
    p = shapes.drawn(table(s, d, "part").select(F.col("p_partkey").alias("grid_id"), "p_size"), 6, 5)
    return p.select("grid_id", "y", "x", ((F.col("p_size") * F.col("y") + F.col("x") * F.col("x") + F.col("grid_id") % 7 * F.col("x")) % 5).cast("string").alias("code"))


def orientations(s, d):
    """Grids against the same ones turned, by the part's number, and with a wrong cell in some."""
    g, k = _pictures(s, d), F.col("grid_id") % 5
    y, x = F.when(k.isin(1, 3), 4 - F.col("y")).otherwise(F.col("y")), F.when(k.isin(2, 3), 5 - F.col("x")).otherwise(F.col("x"))
    wrong = g.select("grid_id", y.alias("y"), x.alias("x"), F.when((k == 4) & (F.col("x") == 0) & (F.col("y") < F.col("grid_id") % 4), "Z").otherwise(F.col("code")).alias("code"))
    return match.orientation(wrong, g)


def page_tiles(s, d):
    """Each picture cut in pages of four columns, of which some are lost, and put together again."""
    g = _pictures(s, d).withColumn("page", F.when(F.col("x") >= 2, 1).otherwise(2))
    first = F.col("page") == 1
    cells = g.filter("NOT (page = 2 AND grid_id % 3 = 0 AND y = 0)").select("grid_id", "page", "y", F.when(first, F.col("x") - 2).otherwise(F.col("x")).alias("x"), "code")
    pages = sizes.dealt(table(s, d, "part").select(F.col("p_partkey").alias("grid_id")), "grid_id").select("grid_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("page"))
    headers = pages.select("grid_id", "page", F.when(first, 1).otherwise(5).alias("a"), F.when(first, 4).otherwise(6).alias("b"), F.lit(6).alias("width"), F.lit(1).alias("c"), F.lit(5).alias("d"), F.lit(5).alias("height"))
    return sequence.tile_problems(headers, cells)


def clean_runs(s, d):
    """Read runs of orders' lines against the names of colours, in which one is missing."""
    li = table(s, d, "lineitem").select(F.lit(1).alias("doc"), F.col("l_orderkey").alias("row"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("i"), F.concat(F.lit(" "), F.lower("l_returnflag")).alias("code"), (F.col("l_linenumber") % 4).cast("long").alias("n"))
    names = s.range(1).select(F.lit(1).alias("doc"), F.explode(F.array(F.struct(F.lit("A").alias("name"), F.lit("X").alias("code")), F.struct(F.lit("N").alias("name"), F.lit("N").alias("code")))).alias("c")).select("doc", "c.*")
    return text.clean_runs(li, ["doc", "row"], "i", names, "doc").drop("doc")


QUERIES = {f.__name__: f for f in (orientations, page_tiles, clean_runs, default_first, section_fitting, chart_versions, strided_rows, covered_parts, written_totals, stitches_before, project_sessions, project_figures, estimated_finish, manifest_rollup, live_states, row_number_problems, unique_slugs, body_chunks, gap_clusters, longest_runs, dilated, filled_box, no_stitch_codes, suppressed_boxes, cell_medians, finished_sizes, stitch_names, label_thinning)}

_ENTRIES = f"{INTERVALS}, ent AS (SELECT from_ % 60 AS key, from_, CASE WHEN from_ % 50 > 0 THEN coalesce(to_, from_ + 3) END AS to_, CASE WHEN from_ % 40 > 0 THEN from_ % 9 + 1 END AS cnt FROM intervals)"
_PROJECT = """lg AS (SELECT user_id AS project, 'p' || event_id % 3 AS piece, ts AS t, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'back' ELSE 'advance' END AS kind, least(9, floor(row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id) / 3 + 1))::BIGINT AS "row" FROM events)"""
_PICTURES = "pic AS (SELECT p_partkey AS g, y, x, ((p_size * y + x * x + p_partkey % 7 * x) % 5)::VARCHAR AS code FROM part, range(5) a(y), range(6) b(x))"
ORACLE = {
    "orientations": f"""WITH {_PICTURES}, w AS (SELECT g, CASE WHEN g % 5 IN (1, 3) THEN 4 - y ELSE y END AS y, CASE WHEN g % 5 IN (2, 3) THEN 5 - x ELSE x END AS x, CASE WHEN g % 5 = 4 AND x = 0 AND y < g % 4 THEN 'Z' ELSE code END AS code FROM pic),
f AS (SELECT g, i, CASE WHEN i IN (1, 3) THEN 4 - y ELSE y END AS y, CASE WHEN i IN (2, 3) THEN 5 - x ELSE x END AS x, code FROM pic, range(4) r(i)),
r AS (SELECT f.g, i, f.y, bool_or(f.code <> w.code) AS bad FROM f JOIN w ON w.g = f.g AND w.y = f.y AND w.x = f.x GROUP BY 1, 2, 3),
n AS (SELECT g, count(*) FILTER (bad AND i = 0) AS n0, count(*) FILTER (bad AND i = 1) AS n1, count(*) FILTER (bad AND i = 2) AS n2, count(*) FILTER (bad AND i = 3) AS n3 FROM r GROUP BY 1)
SELECT g AS grid_id, 5::BIGINT AS height, n0 AS n_rows, n0 > 1 AS refused, CASE WHEN n0 > 1 THEN CASE WHEN n1 = 0 THEN 'flipped_rows' WHEN n2 = 0 THEN 'flipped_columns' WHEN n3 = 0 THEN 'rotated' END END AS hint FROM n""",
    "page_tiles": "SELECT p_partkey AS grid_id, unnest(['size', 'uncovered']) AS kind, unnest([1, 2])::BIGINT AS n FROM part WHERE p_partkey % 3 = 0",
    "clean_runs": """WITH l AS (SELECT l_orderkey AS "row", CASE l_returnflag WHEN 'A' THEN 'X' ELSE 'N' END AS code, l_linenumber % 4 AS n, l_linenumber AS a, l_partkey AS b, l_suppkey AS c FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_linenumber % 4 > 0),
k AS (SELECT *, CASE WHEN lag(code) OVER (PARTITION BY "row" ORDER BY a, b, c) = code THEN 0 ELSE 1 END AS new FROM l), i AS (SELECT *, sum(new) OVER (PARTITION BY "row" ORDER BY a, b, c ROWS UNBOUNDED PRECEDING) - 1 AS run_no FROM k)
SELECT "row", run_no::BIGINT AS run_no, code, sum(n)::BIGINT AS n FROM i GROUP BY 1, 2, 3""",
    "default_first": "SELECT c_nationkey, c_custkey, c_custkey % 17 = 0 AS is_default, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_custkey % 17 = 0)::INTEGER DESC, c_custkey) AS place FROM customer",
    "section_fitting": f"""WITH {CELLS_LINEITEM}, s AS (SELECT grid_id, y // 12 AS section, max(y % 12 + 1) AS last_row, count(DISTINCT y) AS n_rows FROM cells GROUP BY 1, 2 HAVING max(x) % 2 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY CASE WHEN last_row = s_suppkey % 12 + 1 THEN 0 ELSE 1 END, CASE WHEN last_row = s_suppkey % 12 + 1 THEN 0 ELSE -n_rows END, section) AS k FROM s JOIN supplier ON s_suppkey = grid_id) SELECT grid_id, section FROM k WHERE k = 1""",
    "chart_versions": """WITH n AS (SELECT o_custkey, o_orderpriority, o_orderstatus, max(o_orderkey) AS now FROM orders GROUP BY 1, 2, 3 HAVING max(o_orderkey) % 5 > 0)
SELECT o_custkey AS pattern, o_orderpriority AS variant, o_orderstatus AS gauge_key, o_orderkey AS id, CASE WHEN now IS NULL THEN 'gone' WHEN now = o_orderkey THEN 'current' ELSE 'changed' END AS status FROM orders LEFT JOIN n USING (o_custkey, o_orderpriority, o_orderstatus)""",
    "strided_rows": """WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY l_suppkey) // 40) AS st FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM r WHERE i % st = 0""",
    "covered_parts": """WITH p AS (SELECT p_partkey, p_partkey % 9 + 1 AS r0, p_partkey % 7 + 3 AS r1, p_partkey % 5 + 2 AS c0, p_partkey % 8 + 1 AS c1, 20 AS width, 30 AS height, ['bottom-right', 'bottom-left', 'top-right', 'top-left'][p_partkey % 4 + 1] AS row1 FROM part)
SELECT *, CASE WHEN row1 LIKE 'bottom%' THEN 30 - greatest(r0, r1) ELSE least(r0, r1) - 1 END AS y0, CASE WHEN row1 LIKE 'bottom%' THEN 30 - least(r0, r1) + 1 ELSE greatest(r0, r1) END AS y1, CASE WHEN row1 LIKE '%right' THEN 20 - greatest(c0, c1) ELSE least(c0, c1) - 1 END AS x0, CASE WHEN row1 LIKE '%right' THEN 20 - least(c0, c1) + 1 ELSE greatest(c0, c1) END AS x1 FROM p""",
    "estimated_finish": f"""WITH {LOG_EVENTS}, {SESSIONS}, p AS (SELECT project, count(*) AS k, sum(cells) AS cells, sum(active_seconds) AS secs,
  sum(greatest(0, datesub('second', greatest("start", TIMESTAMP '2024-01-11 12:00:00'), least("end", TIMESTAMP '2024-01-25 12:00:00'))))::BIGINT AS win FROM sessions GROUP BY 1),
r AS (SELECT *, 5000 - cells AS rest, CASE WHEN secs > 0 THEN round_even(cells / (secs / 3600.0::DOUBLE), 1) END AS rate FROM p)
SELECT project, win AS window_seconds, CASE WHEN k < 3 OR rate IS NULL OR rate <= 0 THEN NULL WHEN rest <= 0 THEN 0.0 WHEN win > 0 THEN round_even((rest / rate) / (win / 3600.0::DOUBLE / 14), 4) END::DOUBLE AS days FROM r""",
    "unique_slugs": "WITH b AS (SELECT (p_size % 7)::BIGINT AS key, p_partkey, lower(substr(p_name, 1, 6)) AS base FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY key, base ORDER BY p_partkey) AS k FROM b) SELECT key, p_partkey, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM k",
    "no_stitch_codes": """WITH c AS (SELECT p_partkey AS grid_id, y, x, CASE WHEN x - 4 > -1 - y % 4 + p_size % 3 AND x - 4 < 2 + y % 3 AND (p_size + y) % 11 > 0 THEN 'A' ELSE 'N' END AS code FROM part, range(6) a(y), range(9) b(x)),
g AS (SELECT grid_id, code AS ground FROM c WHERE y IN (0, 5) AND x IN (0, 8) GROUP BY 1, 2 HAVING count(*) >= 3),
w AS (SELECT grid_id, ground, y, count(*) FILTER (code <> ground) AS n, max(x) FILTER (code <> ground) - min(x) FILTER (code <> ground) + 1 AS span FROM c JOIN g USING (grid_id) GROUP BY 1, 2, 3)
SELECT grid_id, ground AS code FROM w GROUP BY 1, 2 HAVING bool_and(n > 0 AND span = n)""",
    "suppressed_boxes": """WITH RECURSIVE p AS (SELECT p_partkey // 40 AS page, p_partkey AS box, p_partkey * 37 % 200 AS x0, p_partkey * 53 % 200 AS y0, p_partkey * 37 % 200 + 20 + p_partkey * 7 % 90 AS x1, p_partkey * 53 % 200 + 20 + p_partkey * 11 % 90 AS y1 FROM part),
o AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM p), b AS (SELECT page, list({'box': box, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'area': area} ORDER BY area DESC, box) AS bs FROM o GROUP BY 1),
r AS (SELECT page, 0::BIGINT AS i, bs[1:0] AS kept FROM b UNION ALL SELECT r.page, r.i + 1, CASE WHEN len(list_filter(kept, lambda k: greatest(0, least(k.x1, bs[r.i + 1].x1) - greatest(k.x0, bs[r.i + 1].x0)) * greatest(0, least(k.y1, bs[r.i + 1].y1) - greatest(k.y0, bs[r.i + 1].y0)) > 0.5 * greatest(1, least(k.area, bs[r.i + 1].area)))) > 0 THEN kept ELSE list_append(kept, bs[r.i + 1]) END FROM r JOIN b USING (page) WHERE r.i < len(bs))
SELECT page, unnest(kept).box AS box FROM r JOIN b USING (page) WHERE i = len(bs)""",
    "label_thinning": """WITH RECURSIVE t AS (SELECT DISTINCT l_suppkey, l_partkey AS p FROM lineitem), r AS (SELECT l_suppkey, min(p) AS pos, 1 AS k FROM t GROUP BY 1 UNION ALL
SELECT l_suppkey, pos, k FROM (SELECT r.l_suppkey, min(t.p) AS pos, r.k + 1 AS k FROM r JOIN t ON t.l_suppkey = r.l_suppkey AND t.p >= r.pos + 16 WHERE r.k < 8 GROUP BY r.l_suppkey, r.k) q)
SELECT l_suppkey, pos::DOUBLE AS "at" FROM r""",
    "written_totals": f"WITH {_ENTRIES} SELECT key, CASE WHEN bool_and(to_ IS NOT NULL) THEN max(to_) END AS total_rows, (CASE WHEN bool_and(to_ IS NOT NULL AND cnt IS NOT NULL) THEN sum((to_ - from_ + 1) * cnt) END)::BIGINT AS total_stitches FROM ent GROUP BY 1",
    "stitches_before": f'WITH {_ENTRIES} SELECT key, key * 20 + 30 AS "row", coalesce(sum(greatest(0, least(coalesce(to_, key * 20 + 29), key * 20 + 29) - from_ + 1) * cnt), 0)::BIGINT AS stitches_before FROM ent GROUP BY 1',
    "project_sessions": f"""WITH {_PROJECT}, k AS (SELECT *, CASE WHEN piece = 'p0' THEN 9 END AS total FROM lg WHERE piece <> 'p2'),
a AS (SELECT *, coalesce(lag("row") OVER w, 1) AS prev FROM k WINDOW w AS (PARTITION BY project, piece ORDER BY t, seq)),
b AS (SELECT *, CASE WHEN kind = 'advance' AND "row" = prev THEN coalesce(total, "row") ELSE "row" - 1 END AS after FROM a),
c AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY project, piece ORDER BY t, seq), 0) AS before, CASE WHEN t <= lag(t) OVER (PARTITION BY project ORDER BY t, seq) + INTERVAL 1200 SECOND THEN 0 ELSE 1 END AS new FROM b),
e AS (SELECT *, sum(new) OVER (PARTITION BY project ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS s FROM c),
p AS (SELECT project, s, piece, min(t) AS st, max(t) AS en, greatest(0, arg_max(after, (t, seq)) - arg_min(before, (t, seq))) AS r FROM e GROUP BY 1, 2, 3)
SELECT project, min(st) AS "start", max(en) AS "end", sum(r)::BIGINT AS rows FROM p GROUP BY project, s""",
    "project_figures": f"""WITH {_PROJECT}, f AS (SELECT project, piece, max("row") >= 9 AS fin FROM lg GROUP BY 1, 2) SELECT project, count(*) FILTER (fin AND piece <> 'p2')::BIGINT AS pieces_done, 3::BIGINT AS pieces_total FROM f GROUP BY 1""",
    "manifest_rollup": f"WITH {CELLS_LINEITEM}, {RUNS}, r AS (SELECT grid_id, y, sum(n) AS cells, count(*) AS k FROM runs GROUP BY 1, 2) SELECT r.grid_id, c.n AS colours, sum(cells)::BIGINT AS stitches, round_even(avg(k - 1), 1) AS changes_mean FROM r JOIN (SELECT grid_id, count(DISTINCT code)::BIGINT AS n FROM cells GROUP BY 1) c USING (grid_id) GROUP BY 1, 2",
    "live_states": f"""WITH {CELLS_LINEITEM}, {RUNS}, {PASSES}, q AS (SELECT *, lag(code) OVER w AS previous, lead(code) OVER w AS nxt FROM passes WINDOW w AS (PARTITION BY grid_id, pass_no ORDER BY run_no))
SELECT c_custkey AS project, c_custkey % 30 + 1 AS "row", c_custkey % 6 AS run, code, n, previous, nxt AS "next" FROM customer LEFT JOIN q ON grid_id = c_custkey AND pass_no = c_custkey % 30 + 1 AND run_no = c_custkey % 6""",
    "row_number_problems": """WITH d AS (SELECT l_orderkey AS key, l_linenumber::BIGINT AS k, o_orderkey % 6 AS height FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT key, 'duplicate' AS kind, k AS "at" FROM d GROUP BY key, k HAVING count(*) > 1 UNION ALL SELECT DISTINCT key, 'beyond', k FROM d WHERE k > height OR k < 1
UNION ALL SELECT key, 'missing', k FROM (SELECT o_orderkey AS key, unnest(range(1, o_orderkey % 6 + 1)) AS k FROM orders) w WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = w.key AND l_linenumber = w.k)""",
    "body_chunks": "WITH i AS (SELECT c_custkey, unnest(range(c_custkey % 23 + 1)) AS i FROM customer) SELECT c_custkey, (i // 5)::INTEGER AS chunk, string_agg((i + 1) || ' A', ', ' ORDER BY i) AS body FROM i GROUP BY 1, 2",
    "gap_clusters": """WITH l AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), g AS (SELECT *, l_partkey - lag(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS gap FROM l),
m AS (SELECT l_suppkey, median(gap) * 3 AS lim FROM g GROUP BY 1) SELECT l_suppkey, l_partkey, 1 + sum(CASE WHEN gap > lim THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY l_partkey ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM g JOIN m USING (l_suppkey)""",
    "longest_runs": f"""WITH {CELLS_LINEITEM}, n AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY grid_id, x ORDER BY y) <= 3 THEN 0 ELSE 1 END AS new FROM cells WHERE code = 'NO'),
i AS (SELECT *, sum(new) OVER (PARTITION BY grid_id, x ORDER BY y ROWS UNBOUNDED PRECEDING) AS i FROM n), r AS (SELECT grid_id, x, max(y) - min(y) + 1 AS n FROM i GROUP BY grid_id, x, i.i) SELECT grid_id, x, max(n) AS longest FROM r GROUP BY 1, 2""",
    "dilated": f"WITH {CELLS_LINEITEM} SELECT DISTINCT grid_id, y + i.i AS y, x + j.j AS x FROM cells, (VALUES (-1), (0), (1)) i(i), (VALUES (-1), (0), (1)) j(j) WHERE code = 'AF'",
    "filled_box": f"WITH {CELLS_LINEITEM} SELECT grid_id, CASE WHEN y BETWEEN 10 AND 19 AND x BETWEEN 2 AND 4 THEN 'ZZ' ELSE code END AS code, count(*)::BIGINT AS n FROM cells GROUP BY 1, 2",
    "cell_medians": """WITH p AS (SELECT p_partkey AS picture, y, x FROM part, range(25) a(y), range(25) b(x) WHERE y % 5 >= 1.5 AND y % 5 < 3.5 AND x % 5 >= 1.5 AND x % 5 < 3.5)
SELECT picture, y // 5 AS y, x // 5 AS x, median((picture * 3 + y * 13 + x * 7) % 256)::DOUBLE AS r, median((picture * 5 + y * 13 + x * 7) % 256)::DOUBLE AS g, median((picture * 11 + y * 13 + x * 7) % 256)::DOUBLE AS b FROM p GROUP BY 1, 2, 3""",
    "finished_sizes": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN round_even(100::DOUBLE / (p_size::DOUBLE / (4.0::DOUBLE / 2.54::DOUBLE)) * 2.54::DOUBLE, 1) ELSE round_even(100::DOUBLE / (p_size::DOUBLE / 4.0::DOUBLE), 1) END AS size, CASE WHEN p_size % 2 = 0 THEN (p_size // 2)::VARCHAR ELSE (p_size / 2.0::DOUBLE)::VARCHAR END AS half FROM part",
    "stitch_names": """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'own' ELSE 'single crochet' END WHEN 1 THEN 'double crochet' WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 'half treble' ELSE 'own' END WHEN 3 THEN 'own' ELSE 'slip stitch' END AS name FROM part""",
}
