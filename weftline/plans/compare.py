"""Queries that compare tables by runs and intervals: overlays, pass and row rules, lines in spans, logs, matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, islands, machine, match, project, runs, sequence, shapes, sizes, validate
from ..streaming import append
from .adapters import CELLS_LINEITEM, PASSES, RUNS, cells_lineitem, table
from .folds import SEGMENTS
from .grids import STRETCHES


def _two_readings(s, d):
    """The runs of all grids, and the same with some runs lost and some of another code."""
    a = runs.rle_encode(cells_lineitem(s, d))
    lost = a.filter((F.col("x0") + F.col("y")) % 5 > 0)
    return a, lost.withColumn("code", F.when((F.col("x0") + 2 * F.col("y")) % 7 == 0, "XX").otherwise(F.col("code")))


def _edge_parts(s, d):
    """Two readings of a line's run have four edges at most."""
    return sizes.parts(table(s, d, "lineitem"), 4)


def run_overlay(s, d):
    """The stretches on which two readings differ."""
    return intervals.differing_runs(*_two_readings(s, d), parts=_edge_parts(s, d))


def run_cross_check(s, d):
    return intervals.cross_check_runs(*_two_readings(s, d), parts=_edge_parts(s, d))


def _given(s, d):
    """Passes that documents give: the derived ones with some runs longer, and some of another code or none."""
    p = sequence.passes(runs.rle_encode(cells_lineitem(s, d)))
    n = F.when(F.col("x0") % 4 == 1, F.col("n") + 1).when(F.col("x0") % 9 == 8, 0).otherwise(F.col("n"))
    code = F.when((F.col("x0") + F.col("pass_no")) % 10 == 0, "ZZ").otherwise(F.col("code"))
    return p.select(F.col("grid_id").alias("doc"), "pass_no", "run_no", "grid_row", code.alias("code"), n.alias("n"), "x0")


def pass_rules(s, d):
    """Runs of given passes that the grids' cells do not bear out."""
    return validate.pass_problems(_given(s, d), cells_lineitem(s, d).withColumnRenamed("grid_id", "doc"), parts=sizes.parts(table(s, d, "lineitem"), 3))


def explicit_pass_rules(s, d):
    """The first rule that each run of a given pass breaks."""
    r = runs.rle_encode(cells_lineitem(s, d))
    codes = r.select(F.col("grid_id").alias("doc"), "code").distinct()
    palette = codes.filter("NOT (code = 'RF' AND doc % 3 = 0)").withColumn("stitch", ~((F.col("code") == "AF") & (F.col("doc") % 4 == 0)))
    extent = r.groupBy(F.col("grid_id").alias("doc"), "y").agg(F.sum("n").alias("width"))
    return validate.explicit_pass_problems(_given(s, d), palette, extent)


def row_rules(s, d):
    """Rules of rows over documents whose row strings are wrong in some ways."""
    r = runs.run_strings(runs.rle_encode(cells_lineitem(s, d))).withColumnRenamed("grid_id", "doc")
    k = (F.col("doc") + F.col("y")) % 23
    told = F.when(k == 0, F.concat("runs", F.lit("3QQ"))).when(k == 1, F.concat(F.lit("x"), "runs")).when(k == 2, F.lit("4AF2NO1AF")).otherwise(F.col("runs"))
    rows = r.filter("(doc + y) % 29 <> 5").select("doc", "y", told.alias("runs"))
    size = runs.rle_encode(cells_lineitem(s, d)).groupBy(F.col("grid_id").alias("doc"), "y").agg(F.sum("n").alias("w")).groupBy("doc").agg(F.max("w").alias("width"), F.count("*").alias("height"))
    palette = cells_lineitem(s, d).select(F.col("grid_id").alias("doc"), "code").distinct()
    return validate.row_problems(rows, palette, size, no_stitch=palette.filter("code = 'AF' AND doc % 2 = 0"))


def lines_in_spans(s, d):
    """Segments that orders draw on their customers' nations, against spans that customers have."""
    c = table(s, d, "customer")
    o = table(s, d, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    at, long = F.col("o_orderkey") * 7 % 9973, F.col("o_custkey") * F.col("o_orderkey") % 40 * F.when(F.col("o_orderkey") % 50 == 0, 60).otherwise(1)
    lines = o.select(F.col("c_nationkey").alias("key"), F.col("o_orderkey").alias("line"), at.alias("s"), (at + long).alias("e"))
    lo = F.col("c_custkey") * 13 % 9973
    spans = c.select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("span"), lo.alias("lo"), (lo + F.col("c_custkey") % 30 + F.when(F.col("c_custkey") % 40 == 0, 900).otherwise(0)).alias("hi"))
    return shapes.fitting_lines(lines, spans, ["key"], 16.0, sizes.parts(table(s, d, "orders"), 8))


def overlapping_orders(s, d):
    """Pairs of orders of one customer whose dates' weeks meet, by the join itself."""
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double").alias("day"))
    a = o.select("o_custkey", F.col("o_orderkey").alias("first"), F.col("day").alias("s"), (F.col("day") + 7 + F.col("o_orderkey") % 90).alias("e"))
    b = o.select("o_custkey", F.col("o_orderkey").alias("second"), F.col("day").alias("lo"), (F.col("day") + 3).alias("hi"))
    return intervals.overlapping(a, b, ["o_custkey"], ("s", "e"), ("lo", "hi"), 8.0).filter("first <> second").select("o_custkey", "first", "second")


def event_states(s, d):
    """Every user's cursor and finish, as projections of the log."""
    e = table(s, d, "events")
    kind = F.when(F.col("event_id") % 31 == 0, "finish").when(F.col("event_id") % 11 == 0, "back").when(F.col("event_id") % 17 == 0, "jump").otherwise("advance")
    log = e.select(F.col("user_id").alias("project"), F.col("event_id").alias("seq"), F.col("ts").alias("t"), kind.alias("kind"), (F.col("event_id") % 50 + 1).alias("row"), (F.col("event_id") % 7).alias("run"), (F.col("event_id") % 3).alias("stitch"))
    return append.state(log)


def log_appends(s, d):
    """Events of a batch that repeats some of itself and overlaps the log."""
    e = table(s, d, "events").select(F.col("user_id").alias("project"), F.col("event_id").alias("seq"), F.col("ts").alias("t"))
    log = e.filter("seq % 3 = 0").withColumn("day", F.to_date("t"))
    return append.new_events(e.union(e.filter("seq % 5 = 0")), log).select("project", "seq", F.col("day").cast("string").alias("day"))


def _clusters(s, d):
    """Clusters of a picture's colours: those of the codes, some split, some cells of a neighbour's, and one that no row reaches."""
    c = cells_lineitem(s, d)
    far = F.when(F.col("x") % 13 == 5, 7).when((F.col("grid_id") % 6 == 0) & (F.col("y") % 2 == 0), F.ascii("code") + 50).otherwise(F.ascii("code"))
    seen = c.withColumn("cluster", far)
    every = seen.select("grid_id", "cluster").distinct().union(c.select("grid_id", F.lit(999).alias("cluster")).filter("grid_id % 7 = 0").distinct())
    best = match.majority(seen.select("grid_id", "y", "x", "cluster"), c, ["grid_id", "y", "x"], "cluster", "code", ["grid_id"])
    return best, every


def match_rejections(s, d):
    best, every = _clusters(s, d)
    return match.match_report(best, every, ["grid_id"], "cluster", "code")


def matched_palettes(s, d):
    """Codes of grids that are not refused, with the hexes that the picture gives."""
    c = cells_lineitem(s, d)
    seen = c.withColumn("cluster", F.ascii("code") + F.when((F.col("grid_id") % 3 == 0) & (F.col("y") % 2 == 0), 50).otherwise(0))
    best = match.majority(seen.select("grid_id", "y", "x", "cluster"), c, ["grid_id", "y", "x"], "cluster", "code", ["grid_id"])
    every = seen.select("grid_id", "cluster").distinct().withColumn("hex", F.concat(F.lit("#0000"), F.lower(F.hex("cluster"))))
    key = c.select("grid_id", "code").distinct().unionByName(c.select("grid_id", F.lit("QQ").alias("code")).distinct())
    key = key.withColumn("hex", F.when(F.col("code") == "NO", F.when(F.col("grid_id") % 2 == 0, "#00004E").otherwise("#ABCDEF")))
    report = match.match_report(best, every, ["grid_id"], "cluster", "code")
    return match.matched_palette(best, report, key, every, ["grid_id"], "cluster", "code")


def chart_checks(s, d):
    """One report of all checks over all grids, cut to their first cells so that rows have one width."""
    c = sizes.dealt(table(s, d, "part").select(F.col("p_partkey").alias("grid_id"), "p_size"), "grid_id")
    g = shapes.drawn(c, 7, 6)
    code = F.when((F.col("y") == 5) & (F.col("p_size") % 3 == 0), "A").when((F.col("x") == 0) | (F.col("x") == 6), "A").when(F.col("p_size") % 4 == 0, F.char(65 + (F.abs(F.col("x") - 3) + F.col("y")) % 3)).otherwise(F.char(65 + (F.col("x") * F.col("p_size") + F.col("y")) % 4))
    cells = g.select("grid_id", "y", "x", code.alias("code")).filter("NOT (grid_id % 10 = 3 AND y = 2 AND x = 6)")
    palette = c.select("grid_id", F.explode(F.array(*[F.lit(x) for x in ("A", "B", "C")])).alias("code")).unionByName(c.filter("p_size % 5 > 0").select("grid_id", F.when(F.col("p_size") % 7 == 0, "D1").otherwise("D").alias("code")))
    opted = c.filter("grid_id % 2 = 0").select("grid_id", (F.col("grid_id") % 3).alias("solid_edge"), (F.col("grid_id") % 4).alias("mirror_lr"), (F.col("grid_id") % 5).alias("mirror_tb"), (F.col("grid_id") % 6 == 0).alias("first_row_solid"), F.lit("A").alias("edge_code"))
    return validate.checks(cells, runs.rle_encode(cells), palette, opted)


def _own_size(s, d):
    r = runs.rle_encode(cells_lineitem(s, d))
    gauge = r.select("grid_id").distinct().select("grid_id", ((F.col("grid_id") % 5 + 2) * 1.0).alias("stitches"), ((F.col("grid_id") % 3 + 3) * 1.0).alias("rows"), F.when(F.col("grid_id") % 7 == 0, "block").when(F.col("grid_id") % 7 == 1, "tile").alias("cell"), F.when(F.col("grid_id") % 2 == 1, "tiles").alias("unit"))
    ground = r.filter("code = 'AF' AND grid_id % 2 = 0").select("grid_id", "code").distinct()
    return r, gauge, ground


def chart_stats(s, d):
    """Cells, sizes and changes of all grids, without those of the ground."""
    r, gauge, ground = _own_size(s, d)
    return runs.chart_stats(r, gauge, ground).withColumn("changes", F.array_join("changes", ","))


def code_stats(s, d):
    """Cells and single runs of every code of a palette that has one more."""
    r, _, ground = _own_size(s, d)
    palette = r.select("grid_id", "code").distinct().unionByName(r.select("grid_id", F.lit("QQ").alias("code")).distinct())
    return runs.code_stats(r, palette, ground)


def manifests(s, d):
    """The charts of patterns, twenty grids each, in order."""
    r, gauge, _ = _own_size(s, d)
    charts = r.select("grid_id").distinct().select(F.floor(F.col("grid_id") / 20).alias("pattern"), (F.col("grid_id") * 7 % 20).alias("place"), "grid_id", F.concat(F.lit("v"), F.col("grid_id") % 3).alias("variant"), F.concat(F.lit("dist/"), F.col("grid_id").cast("string"), F.lit("/chart.json")).alias("path"), F.when(F.col("grid_id") % 2 == 0, "cm").otherwise("in").alias("unit"))
    palette = r.select("grid_id", "code").distinct()
    yards = runs.yarn(runs.code_stats(r, palette).select("grid_id", "code", "cells"), gauge.select("grid_id", "stitches", "rows", "cell"))
    out = project.manifests(charts, runs.chart_stats(r, gauge), yards, palette)
    e = out.select("pattern", "n_charts", F.posexplode("charts").alias("at", "c"))
    return e.select("pattern", "n_charts", "at", "c.*")


def stretch_kinds(s, d):
    """Stretches of pieces that parts draw, with their kinds; ties of colours by a palette that runs backwards."""
    g, r, i = F.col("grid_id"), F.col("pass_no"), F.col("run_no")
    block = F.floor((r - 1) / 3)
    period = 2 + (g + block) % 3
    p = sizes.dealt(table(s, d, "part").select(F.col("p_partkey").alias("grid_id")), "grid_id").withColumn("pass_no", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))))
    many = F.element_at(F.array(*[F.lit(x) for x in (2, 12, 14, 9)]), ((g + block) % 4 + 1).cast("int"))
    p = p.withColumn("run_no", F.explode(F.sequence(F.lit(0).cast("long"), many.cast("long") - 1)))
    extra = F.when(((i + g) % 11 == 0) & (block % 2 == 1), r * 4).otherwise(0)
    p = p.select("grid_id", "pass_no", "run_no", F.char(65 + i % period).alias("code"), (3 + i % period * 2 + extra).alias("n"))
    palette = p.select("grid_id", "code").distinct().withColumn("place", 100 - F.ascii("code"))
    return islands.stretch_kinds(islands.stretches(p, palette=palette), p, machine.segments(p))


QUERIES = {
    f.__name__: f
    for f in (
        run_overlay, run_cross_check, pass_rules, explicit_pass_rules, row_rules, lines_in_spans, overlapping_orders, event_states, log_appends, match_rejections, matched_palettes, chart_checks, chart_stats,
        code_stats, manifests, stretch_kinds,
    )
}

_CELL_RUNS = f"{CELLS_LINEITEM}, {RUNS}"
_READINGS = f"""{_CELL_RUNS}, b AS (SELECT grid_id, y, x0, n, CASE WHEN (x0 + 2 * y) % 7 = 0 THEN 'XX' ELSE code END AS code FROM runs WHERE (x0 + y) % 5 > 0),
bc AS (SELECT grid_id, y, code, unnest(range(x0, x0 + n)) AS x FROM b),
diff AS (SELECT c.grid_id, c.y, c.x, c.code AS a, bc.code AS b FROM cells c LEFT JOIN bc ON bc.grid_id = c.grid_id AND bc.y = c.y AND bc.x = c.x WHERE bc.code IS DISTINCT FROM c.code)"""
_GIVEN = f"""{_CELL_RUNS}, {PASSES}, given AS (SELECT grid_id AS doc, pass_no, run_no, grid_row, CASE WHEN (x0 + pass_no) % 10 = 0 THEN 'ZZ' ELSE code END AS code, CASE WHEN x0 % 4 = 1 THEN n + 1 WHEN x0 % 9 = 8 THEN 0 ELSE n END AS n, x0 FROM passes)"""
_SIZES = f"""{_CELL_RUNS}, gauge AS (SELECT DISTINCT grid_id, (grid_id % 5 + 2)::DOUBLE AS st, (grid_id % 3 + 3)::DOUBLE AS ro, CASE WHEN grid_id % 7 = 0 THEN 'block' WHEN grid_id % 7 = 1 THEN 'tile' ELSE 'stitch' END AS cell, CASE WHEN grid_id % 2 = 1 THEN 'tiles' ELSE 'stitches' END AS unit FROM runs)"""
_CHART = """rr AS (SELECT grid_id, y, sum(n) FILTER (NOT g) AS k, greatest(count(*) FILTER (NOT g) - 1, 0) AS c, max(x0 + n) AS w FROM own GROUP BY 1, 2),
st AS (SELECT r.grid_id, sum(coalesce(k, 0))::BIGINT AS cells, max(w) AS width, max(y) + 1 AS height, round_even(avg(c), 1) AS changes_mean, max(c) AS changes_max, string_agg(c, ',' ORDER BY y) AS changes FROM rr r GROUP BY 1),
cs AS (SELECT s.*, ((cell = 'stitch' AND unit = 'stitches') OR (cell = 'tile' AND unit = 'tiles')) AS sized, cell, st, ro FROM st s JOIN gauge USING (grid_id)),
chart AS (SELECT grid_id, cells, width, height, CASE WHEN sized THEN round_even(width / st, 1) END AS width_in, CASE WHEN sized THEN round_even(height / ro, 1) END AS height_in, changes_mean, changes_max, changes, CASE WHEN cell = 'stitch' THEN cells END AS stitches FROM cs)"""
_CLUSTER = f"""{CELLS_LINEITEM}, seen AS (SELECT *, CASE WHEN x % 13 = 5 THEN 7 WHEN grid_id % 6 = 0 AND y % 2 = 0 THEN ascii(code) + 50 ELSE ascii(code) END AS cluster FROM cells),
vote AS (SELECT grid_id, cluster, code, count(*) AS n FROM seen GROUP BY ALL), best AS (SELECT *, round_even(n / sum(n) OVER (PARTITION BY grid_id, cluster), 4) AS share FROM vote QUALIFY row_number() OVER (PARTITION BY grid_id, cluster ORDER BY n DESC, code) = 1)"""
ORACLE = {
    "run_overlay": f"""WITH {_READINGS}, m AS (SELECT *, CASE WHEN lag(x) OVER w = x - 1 AND lag(a) OVER w = a AND lag(b) OVER w IS NOT DISTINCT FROM b THEN 0 ELSE 1 END AS new FROM diff WINDOW w AS (PARTITION BY grid_id, y ORDER BY x)),
i AS (SELECT *, sum(new) OVER (PARTITION BY grid_id, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS i FROM m) SELECT grid_id, y, min(x) AS x0, count(*) AS n, a, b FROM i GROUP BY grid_id, y, i.i, a, b""",
    "run_cross_check": f"WITH {_READINGS} SELECT grid_id, y, count(*) AS n_differ, min(x) AS first_x FROM diff GROUP BY 1, 2",
    "pass_rules": f"""WITH {_GIVEN}, e AS (SELECT doc, pass_no, grid_row, code, unnest(range(x0, x0 + n)) AS x FROM given WHERE n > 0),
bad AS (SELECT doc, pass_no, count(*) AS n FROM e LEFT JOIN cells c ON c.grid_id = doc AND c.y = grid_row AND c.x = e.x WHERE c.code IS NULL OR c.code <> e.code GROUP BY 1, 2)
SELECT doc, 'pass_cells' AS rule, pass_no::VARCHAR AS "at", n || ' cell(s) do not match' AS message FROM bad UNION ALL SELECT doc, 'pass_count', pass_no::VARCHAR, 'the count is not positive' FROM given WHERE n < 1""",
    "explicit_pass_rules": f"""WITH {_GIVEN}, pal AS (SELECT DISTINCT grid_id AS doc, code, NOT (code = 'AF' AND grid_id % 4 = 0) AS stitch FROM cells WHERE NOT (code = 'RF' AND grid_id % 3 = 0)),
ext AS (SELECT grid_id AS doc, y, count(*) AS width FROM cells GROUP BY 1, 2),
r AS (SELECT g.*, CASE WHEN p.stitch IS NULL THEN 'pass_code' WHEN NOT p.stitch THEN 'pass_no_stitch' WHEN g.n < 1 THEN 'pass_count' WHEN g.x0 < 0 OR g.x0 + g.n > e.width THEN 'pass_outside' END AS rule FROM given g LEFT JOIN pal p ON p.doc = g.doc AND p.code = g.code LEFT JOIN ext e ON e.doc = g.doc AND e.y = g.grid_row)
SELECT doc, rule, pass_no || '/' || run_no AS "at", code AS message FROM r WHERE rule IS NOT NULL""",
    "row_rules": f"""WITH {_CELL_RUNS}, rs AS (SELECT grid_id AS doc, y, string_agg(n || code, '' ORDER BY run_no) AS t FROM runs GROUP BY 1, 2),
rw AS (SELECT doc, y, CASE (doc + y) % 23 WHEN 0 THEN t || '3QQ' WHEN 1 THEN 'x' || t WHEN 2 THEN '4AF2NO1AF' ELSE t END AS t FROM rs WHERE (doc + y) % 29 <> 5),
sz AS (SELECT doc, max(w) AS width, count(*) AS height FROM (SELECT grid_id AS doc, y, count(*) AS w FROM cells GROUP BY 1, 2) q GROUP BY 1), pal AS (SELECT DISTINCT grid_id AS doc, code FROM cells),
ok AS (SELECT *, regexp_full_match(t, '([0-9]+[A-Za-z]{{1,3}})+') AS well FROM rw),
pr AS (SELECT doc, y, unnest(regexp_extract_all(t, '([0-9]+)([A-Za-z]{{1,3}})', 1))::BIGINT AS n, unnest(regexp_extract_all(t, '([0-9]+)([A-Za-z]{{1,3}})', 2)) AS code, unnest(range(len(regexp_extract_all(t, '[0-9]+')))) AS i FROM ok WHERE well),
pl AS (SELECT *, sum(n) OVER (PARTITION BY doc, y ORDER BY i) - n AS x0 FROM pr),
ns AS (SELECT doc, y, sum(n) FILTER (NOT (code = 'AF')) AS n, min(x0) FILTER (code <> 'AF') AS lo, max(x0 + n) FILTER (code <> 'AF') AS hi FROM pl WHERE doc % 2 = 0 AND doc IN (SELECT doc FROM pal WHERE code = 'AF') GROUP BY 1, 2)
SELECT doc, 'run_string' AS rule, y::VARCHAR AS "at", 'is not a run string' AS message FROM ok WHERE NOT well
UNION ALL SELECT doc, 'width', y::VARCHAR, 'sums to ' || w || ', not ' || width FROM (SELECT doc, y, sum(n) AS w FROM pl GROUP BY 1, 2) q JOIN sz USING (doc) WHERE w <> width
UNION ALL SELECT doc, 'height', '', 'the height does not match the rows' FROM sz LEFT JOIN (SELECT doc, count(*) AS c FROM rw GROUP BY 1) q USING (doc) WHERE height <> coalesce(c, 0)
UNION ALL SELECT DISTINCT doc, 'unknown_code', y::VARCHAR, 'unknown code ' || code FROM pl WHERE NOT EXISTS (SELECT 1 FROM pal WHERE pal.doc = pl.doc AND pal.code = pl.code)
UNION ALL SELECT doc, 'no_stitches', y::VARCHAR, 'has no stitches' FROM ns WHERE n IS NULL UNION ALL SELECT doc, 'gap', y::VARCHAR, 'has more than one stitched span' FROM ns WHERE hi - lo <> n""",
    "lines_in_spans": """WITH l AS (SELECT c_nationkey AS key, o_orderkey AS line, o_orderkey * 7 % 9973 AS s, o_orderkey * 7 % 9973 + o_custkey * o_orderkey % 40 * CASE WHEN o_orderkey % 50 = 0 THEN 60 ELSE 1 END AS e FROM orders JOIN customer ON c_custkey = o_custkey),
p AS (SELECT c_nationkey AS key, c_custkey AS span, c_custkey * 13 % 9973 AS lo, c_custkey * 13 % 9973 + c_custkey % 30 + CASE WHEN c_custkey % 40 = 0 THEN 900 ELSE 0 END AS hi FROM customer)
SELECT l.key, line, span FROM l JOIN p ON p.key = l.key AND s <= hi AND lo <= e WHERE 2 * (least(e, hi) - greatest(s, lo)) >= hi - lo OR 2 * (least(e, hi) - greatest(s, lo)) >= e - s""",
    "overlapping_orders": """WITH o AS (SELECT o_custkey, o_orderkey, datediff('day', DATE '1992-01-01', o_orderdate::DATE) AS day FROM orders)
SELECT a.o_custkey, a.o_orderkey AS first, b.o_orderkey AS second FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND a.day <= b.day + 3 AND b.day <= a.day + 7 + a.o_orderkey % 90""",
    "event_states": """WITH l AS (SELECT user_id AS project, event_id AS seq, ts AS t, CASE WHEN event_id % 31 = 0 THEN 'finish' WHEN event_id % 11 = 0 THEN 'back' WHEN event_id % 17 = 0 THEN 'jump' ELSE 'advance' END AS kind FROM events),
g AS (SELECT project, count(*) AS n_events, max(t) AS last_worked, arg_max(seq, (t, seq)) AS s, max((t, seq)) FILTER (kind = 'finish') AS done, max((t, seq)) FILTER (kind IN ('back', 'jump')) AS reopened, max(t) FILTER (kind = 'finish') AS dt FROM l GROUP BY 1)
SELECT project, s % 50 + 1 AS "row", s % 7 AS run, s % 3 AS stitch, last_worked, CASE WHEN reopened IS NULL OR done > reopened THEN dt END AS finished, n_events FROM g""",
    "log_appends": "SELECT user_id AS project, event_id AS seq, ts::DATE::VARCHAR AS day FROM events WHERE event_id % 3 <> 0",
    "match_rejections": f"""WITH {_CLUSTER} SELECT grid_id, 'doubtful' AS kind, cluster::VARCHAR AS "at" FROM best WHERE share < 0.9 UNION ALL SELECT grid_id, 'shared', code FROM best GROUP BY 1, code HAVING count(*) > 1
UNION ALL SELECT DISTINCT grid_id, 'unmatched', '999' FROM cells WHERE grid_id % 7 = 0""",
    "matched_palettes": f"""WITH {CELLS_LINEITEM}, k AS (SELECT DISTINCT grid_id, code FROM cells UNION ALL SELECT DISTINCT grid_id, 'QQ' FROM cells),
seen AS (SELECT grid_id, code, ascii(code) + CASE WHEN grid_id % 3 = 0 AND y % 2 = 0 THEN 50 ELSE 0 END AS cluster FROM cells), v AS (SELECT grid_id, cluster, code, count(*) AS n FROM seen GROUP BY ALL),
best AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY grid_id, cluster ORDER BY n DESC, code) = 1), bad AS (SELECT grid_id FROM best GROUP BY grid_id, code HAVING count(*) > 1),
h AS (SELECT k.grid_id, k.code, CASE WHEN k.code = 'NO' THEN CASE WHEN k.grid_id % 2 = 0 THEN '#00004E' ELSE '#ABCDEF' END END AS hex, '#0000' || lower(to_hex(cluster)) AS seen FROM k LEFT JOIN best USING (grid_id, code) WHERE k.grid_id NOT IN (SELECT grid_id FROM bad))
SELECT grid_id, code, coalesce(hex, seen) AS hex, CASE WHEN seen IS NULL THEN 'unseen' WHEN hex IS NULL THEN 'new' WHEN lower(hex) = lower(seen) THEN 'same' ELSE 'differs' END AS status FROM h""",
    "chart_checks": """WITH c AS (SELECT p_partkey AS grid_id, p_size, y, x, CASE WHEN y = 5 AND p_size % 3 = 0 THEN 'A' WHEN x IN (0, 6) THEN 'A' WHEN p_size % 4 = 0 THEN chr(65 + ((abs(x - 3) + y) % 3)::INTEGER) ELSE chr(65 + ((x * p_size + y) % 4)::INTEGER) END AS code FROM part, range(6) a(y), range(7) b(x) WHERE NOT (p_partkey % 10 = 3 AND y = 2 AND x = 6)),
pal AS (SELECT p_partkey AS grid_id, unnest(['A', 'B', 'C']) AS code FROM part UNION ALL SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'D1' ELSE 'D' END FROM part WHERE p_size % 5 > 0),
o AS (SELECT p_partkey AS grid_id, p_partkey % 3 AS se, p_partkey % 4 AS lr, p_partkey % 5 AS tb, p_partkey % 6 = 0 AS fr FROM part WHERE p_partkey % 2 = 0),
m AS (SELECT *, CASE WHEN lag(code) OVER (PARTITION BY grid_id, y ORDER BY x) = code THEN 0 ELSE 1 END AS new FROM c), i AS (SELECT *, sum(new) OVER (PARTITION BY grid_id, y ORDER BY x) AS r FROM m),
rn AS (SELECT grid_id, y, r, count(*) AS n FROM i GROUP BY ALL), rw AS (SELECT grid_id, y, sum(n) AS w, count(*) - 1 AS ch, min(n) AS mn FROM rn GROUP BY ALL),
t AS (SELECT grid_id, bool_and(w = 7) AS ok, round_even(avg(ch), 1) AS mean, max(ch) AS most, min(mn) AS mn FROM rw GROUP BY 1)
SELECT grid_id, 'row totals' AS "check", ok, '6 rows of 7' AS detail FROM t
UNION ALL SELECT grid_id, 'palette codes', bool_and(regexp_full_match(code, '[A-Za-z]{1,3}')), 'codes: ' || string_agg(code, ', ' ORDER BY code) FROM pal GROUP BY 1
UNION ALL SELECT grid_id, 'palette closure', bool_and(code IN (SELECT code FROM pal WHERE pal.grid_id = u.grid_id)), 'used: ' || string_agg(code, ', ' ORDER BY code) FROM (SELECT DISTINCT grid_id, code FROM c) u GROUP BY 1
UNION ALL SELECT grid_id, 'solid edge', count(*) FILTER ((x < se OR x >= 7 - se OR y < se OR y >= 6 - se) AND code <> 'A') = 0, 'outer ' || se || ' cell(s)' FROM c JOIN o USING (grid_id) WHERE se > 0 GROUP BY 1, se
UNION ALL SELECT grid_id, 'first row solid', count(*) FILTER (y = 5 AND code <> 'A') = 0, '' FROM c JOIN o USING (grid_id) WHERE fr GROUP BY 1
UNION ALL SELECT a.grid_id, 'mirror left/right', count(*) FILTER ((a.x < lr OR a.x >= 7 - lr) AND a.code <> b.code) = 0, 'outer ' || lr || ' columns' FROM c a JOIN o USING (grid_id) LEFT JOIN c b ON b.grid_id = a.grid_id AND b.y = a.y AND b.x = 6 - a.x WHERE lr > 0 GROUP BY 1, lr
UNION ALL SELECT a.grid_id, 'mirror top/bottom', count(*) FILTER ((a.y < tb OR a.y >= 6 - tb) AND a.code <> b.code) = 0, 'outer ' || tb || ' rows' FROM c a JOIN o USING (grid_id) LEFT JOIN c b ON b.grid_id = a.grid_id AND b.x = a.x AND b.y = 5 - a.y WHERE tb > 0 GROUP BY 1, tb
UNION ALL SELECT grid_id, 'changes per row', true, 'mean ' || mean || ', max ' || most FROM t UNION ALL SELECT grid_id, 'min run', true, mn || ' cell(s)' FROM t""",
    "chart_stats": f"WITH {_SIZES}, own AS (SELECT *, code = 'AF' AND grid_id % 2 = 0 AS g FROM runs), {_CHART} SELECT * FROM chart",
    "code_stats": f"""WITH {_CELL_RUNS}, p AS (SELECT DISTINCT grid_id, code FROM runs UNION ALL SELECT DISTINCT grid_id, 'QQ' FROM runs)
SELECT p.grid_id, p.code, coalesce(sum(n), 0)::BIGINT AS cells, count(*) FILTER (n = 1) AS singles FROM p LEFT JOIN runs r ON r.grid_id = p.grid_id AND r.code = p.code WHERE NOT (p.code = 'AF' AND p.grid_id % 2 = 0) GROUP BY 1, 2""",
    "manifests": f"""WITH {_SIZES}, own AS (SELECT *, false AS g FROM runs), {_CHART}, ya AS (SELECT grid_id, sum(y)::BIGINT AS yards_est, count(*) AS colours FROM (SELECT r.grid_id, code, round_even(CASE WHEN any_value(cell) = 'stitch' THEN sum(n) * (1.0::DOUBLE / (any_value(st) * any_value(ro))) * 1.1::DOUBLE * 1.2::DOUBLE END, 0) AS y FROM runs r JOIN gauge USING (grid_id) GROUP BY 1, 2) q GROUP BY 1),
e AS (SELECT grid_id // 20 AS pattern, grid_id * 7 % 20 AS place, grid_id, 'v' || grid_id % 3 AS variant, 'dist/' || grid_id || '/chart.json' AS path, 'dist/' || grid_id || '/preview.png' AS preview, width, height,
CASE WHEN width_in IS NOT NULL THEN CASE WHEN grid_id % 2 = 0 THEN round_even(width_in * 2.54::DOUBLE, 1) || ' x ' || round_even(height_in * 2.54::DOUBLE, 1) || ' cm' ELSE width_in || ' x ' || height_in || ' in' END END AS size, colours, width * height AS stitches, changes_mean, changes_max, yards_est FROM chart JOIN ya USING (grid_id))
SELECT *, count(*) OVER (PARTITION BY pattern) AS n_charts, row_number() OVER (PARTITION BY pattern ORDER BY place, grid_id) - 1 AS "at", place = min(place) OVER (PARTITION BY pattern) AS "default" FROM e""",
    "stretch_kinds": f"""WITH RECURSIVE pr AS (SELECT p_partkey AS grid_id, r AS pass_no, (r - 1) // 3 AS b FROM part, range(1, 11) t(r)), pk AS (SELECT *, 2 + (grid_id + b) % 3 AS p, [2, 12, 14, 9][((grid_id + b) % 4 + 1)::INTEGER] AS k FROM pr),
passes AS (SELECT grid_id, pass_no, i AS run_no, chr((65 + i % p)::INTEGER) AS code, (3 + i % p * 2 + CASE WHEN (i + grid_id) % 11 = 0 AND b % 2 = 1 THEN pass_no * 4 ELSE 0 END)::BIGINT AS n FROM (SELECT *, unnest(range(k)) AS i FROM pk) q),
{SEGMENTS}, {STRETCHES},
sums AS (SELECT *, sum(n) OVER (PARTITION BY grid_id, pass_no ORDER BY run_no) AS t FROM passes),
band AS (SELECT s.grid_id, s.pass_no, max(b.t - a.t + a.n) AS band FROM seg s JOIN sums a ON a.grid_id = s.grid_id AND a.pass_no = s.pass_no AND a.run_no = s."start" JOIN sums b ON b.grid_id = s.grid_id AND b.pass_no = s.pass_no AND b.run_no = s."end" - 1 WHERE s.kind = 'repeat' GROUP BY 1, 2),
rep AS (SELECT x.grid_id, x.pass_no, coalesce(2 * max(band) >= sum(n), false) AS rep FROM passes x LEFT JOIN band USING (grid_id, pass_no) GROUP BY 1, 2),
listed AS (SELECT grid_id, stretch, string_agg(code, ',' ORDER BY cells DESC, code DESC) AS codes FROM col GROUP BY 1, 2),
allrep AS (SELECT s.grid_id, s.stretch, bool_and(rep) AS rep FROM stretches s JOIN rep r ON r.grid_id = s.grid_id AND r.pass_no BETWEEN s."start" AND s."end" GROUP BY 1, 2)
SELECT s.grid_id, s.stretch, "start", "end", n_rows, plain, l.codes, CASE WHEN plain THEN 'plain' WHEN rep THEN 'repeat' ELSE 'pattern' END AS kind FROM stretches s JOIN listed l USING (grid_id, stretch) JOIN allrep USING (grid_id, stretch)""",
}
