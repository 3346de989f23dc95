"""Queries over whole chart documents, manifests, OXS texts and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color
from ..operators import identity, machine, runs
from ..sources import charts
from .adapters import CELLS_LINEITEM, cells_events, cells_lineitem, table
from .compare import ORACLE as _COMPARE
from .staging import greedy_sql


def _pick(k, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))


def _meta(s, d):
    g = F.col("grid_id")
    m = cells_lineitem(s, d).select("grid_id").distinct()
    boundary = F.when(g % 2 == 0, F.struct(F.lit("turn").alias("kind"), (g % 3).cast("int").alias("chain"), F.when(g % 4 == 0, "next").alias("color")))
    technique = F.struct(F.lit("rows").alias("type"), F.lit("bottom-right").alias("start"), F.lit("RS").alias("first_side"), F.lit("rtl").alias("rs_direction"))
    return m.select(
        "grid_id", F.concat(F.lit("piece-"), g.cast("string")).alias("slug"), F.concat(F.lit("Piece "), g.cast("string")).alias("title"), F.lit("1.0").alias("version"), F.lit("crochet").alias("craft"),
        F.lit("final").alias("variant"), F.lit("sc").alias("gauge_key"), F.when(g % 9 > 0, "sc").alias("active_key"), ((g % 5 + 2) * 1.0).alias("stitches"), ((g % 3 + 3) * 1.0).alias("rows"),
        F.when(g % 2 == 1, "tiles").alias("unit"), _pick(g % 7, "block", "tile", None, None, None, None, None).alias("cell"), boundary.alias("boundary"), F.when(g % 5 == 0, 2).alias("first_stitch_in"), technique.alias("technique"),
    )


def chart_whole_documents(s, d):
    """The documents of all grids, taken apart again: what is said of pattern, chart, gauge, stats and foundation."""
    c = cells_lineitem(s, d)
    r = runs.rle_encode(c)
    codes = r.select("grid_id", "code").distinct()
    palette = codes.select("grid_id", F.ascii("code").alias("place"), "code", F.lower("code").alias("name"), F.concat(F.lit("#0000"), F.lower(F.hex(F.ascii("code")))).alias("hex"))
    ground = codes.filter("code = 'AF' AND grid_id % 2 = 0")
    docs = charts.full_documents(r, palette, _meta(s, d), ground)
    at = lambda path: F.get_json_object("json", f"$.{path}")
    return docs.select(
        "grid_id", (at("chart.id") == F.col("id")).alias("same_id"), at("schema").alias("schema"), at("pattern.id").alias("slug"), at("chart.cell.kind").alias("cell"), at("chart.width").alias("width"), at("chart.height").alias("height"),
        at("gauge.stitches").cast("double").alias("per_four"), at("gauge.boundary.chain").alias("chain"), at("stats.cells").alias("cells"), at("stats.counts.NO").alias("no_cells"), at("stats.counts.AF").alias("af_cells"), at("stats.single_stitch_runs.RF").alias("rf_singles"),
        at("stats.color_changes_per_row.max").alias("most_changes"), at("stats.stitches").alias("stitches"), at("stats.yards_est.NO").alias("no_yards"), at("stats.size_in[0]").cast("double").alias("width_in"), at("foundation.chain").alias("foundation"), F.sha2(at("rows"), 256).alias("rows"),
    )


def gauge_refusals(s, d):
    return charts.gauge_refusals(_meta(s, d))


def _patterns(s, d):
    p = table(s, d, "part")
    k = F.col("p_partkey")
    pattern = F.floor(k / 4)
    chart = F.struct(F.concat(F.lit("sha256:"), k.cast("string")).alias("id"), F.concat(F.lit("v"), (k % 4).cast("string")).alias("variant"), F.lit("sc").alias("gauge_key"), (k % 4 == 0).alias("default"), F.concat(F.lit("dist/"), k.cast("string"), F.lit("/chart.json")).alias("path"), F.lit("preview.png").alias("preview"), (k % 50).alias("width"), (k % 40).alias("height"))
    piece = F.struct(F.concat(F.lit("p"), (k % 4).cast("string")).alias("id"), F.concat(F.lit("Piece "), k.cast("string")).alias("title"), F.when(k % 3 == 0, 2).alias("make"), F.when(k % 2 == 0, F.concat(F.lit("sha256:"), k.cast("string"))).alias("chart"), F.when(k % 2 == 1, F.lit("rows.json")).alias("rows"), F.when(k % 2 == 1, F.lit("r")).alias("rows_id"), F.lit(None).cast("array<int>").alias("pages"))
    step = F.struct(F.concat(F.lit("Step "), (k % 4).cast("string")).alias("title"), F.lit(None).cast("string").alias("text"), F.array((k % 9 + 1).cast("int")).alias("pages"))
    g = p.groupBy(pattern.alias("pattern")).agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), chart.alias("c"), piece.alias("p"), step.alias("s")))).alias("x"))
    old = F.col("pattern") % 3 == 0
    part = lambda name: F.transform("x", lambda x: x[name])
    return g.select("pattern", F.concat(F.lit("id-"), F.col("pattern").cast("string")).alias("id"), F.lit("T").alias("title"), F.lit("1").alias("version"), F.lit("p.png").alias("preview"), part("c").alias("charts"), F.when(~old, part("p")).alias("pieces"), F.when(~old, part("s")).alias("assembly"))


def manifest_pieces(s, d):
    """Pieces of manifests that were written as JSON and read again; some texts are none."""
    texts = charts.manifest_texts(_patterns(s, d)).withColumn("value", F.when(F.col("pattern") % 11 == 5, F.lit("{broken")).when(F.col("pattern") % 11 == 6, F.lit('{"schema":9,"id":"x"}')).otherwise(F.col("value")))
    return charts.manifest_parts(charts.parsed_manifests(texts), "pieces", "pattern").select("pattern", "place", "id", "title", F.coalesce("make", F.lit(1)).alias("make"), "chart", "rows_id")


def manifest_assembly(s, d):
    m = charts.parsed_manifests(charts.manifest_texts(_patterns(s, d)))
    return charts.manifest_parts(m, "assembly", "pattern").select("pattern", "place", "title", F.element_at("pages", 1).alias("page"))


def oxs_texts(s, d):
    """OXS texts of users' grids, each with the palette that it uses."""
    c = cells_events(s, d)
    palette = c.select("grid_id", "code").distinct().withColumns({"name": F.col("code"), "hex": F.lit("#0000ff")})
    return charts.oxs_documents(c, palette)


def unknown_cells(s, d):
    """Codes that a palette lacks, and where they are first."""
    c = cells_lineitem(s, d)
    return charts.unknown_cells(c, c.select("grid_id", "code").distinct().filter("NOT (code = 'RF' AND grid_id % 3 = 0) AND NOT (code = 'AF' AND grid_id % 4 = 0)"))


def case_collisions(s, d):
    p = table(s, d, "part")
    k = F.col("p_partkey")
    name = F.substring("p_name", 1, 3)
    return identity.case_collisions(p.select(F.floor(k / 50).alias("bundle"), F.when(k % 3 == 0, F.upper(name)).when(k % 3 == 1, F.lower(name)).otherwise(name).alias("name")), ["bundle"], "name")


def rare_clusters(s, d):
    """Clusters of all parts' colours that hold few of them."""
    i = F.col("p_partkey")
    p = table(s, d, "part").select((i % 2).alias("half"), (i * i % 97).alias("key"))
    c = color.lab(F.col("key") * 37 % 256, F.col("key") * 91 % 256, F.col("key") * 53 % 256)
    samples = p.withColumn("c", c).select("half", "key", "c.*")
    return machine.rare_clusters(samples, machine.cluster_palette(samples, "half", "key", ["l", "a", "b"], 4.0), "half", "key", 0.02)


QUERIES = {f.__name__: f for f in (chart_whole_documents, gauge_refusals, manifest_pieces, manifest_assembly, oxs_texts, unknown_cells, case_collisions, rare_clusters)}

_PATTERN = "p AS (SELECT p_partkey AS k, p_partkey // 4 AS pattern, row_number() OVER (PARTITION BY p_partkey // 4 ORDER BY p_partkey) AS place FROM part)"
ORACLE = {
    "chart_whole_documents": f"""WITH st AS ({_COMPARE["chart_stats"]}), cs AS ({_COMPARE["code_stats"]}), rs AS (SELECT grid_id, y, string_agg(n || code, '' ORDER BY run_no) AS t FROM (WITH {CELLS_LINEITEM},
islands AS (SELECT *, sum(new) OVER (PARTITION BY grid_id, y ORDER BY x) AS r FROM (SELECT *, CASE WHEN lag(code) OVER (PARTITION BY grid_id, y ORDER BY x) = code THEN 0 ELSE 1 END AS new FROM cells) i0) SELECT grid_id, y, r AS run_no, code, count(*) AS n FROM islands GROUP BY ALL) q GROUP BY 1, 2),
rw AS (SELECT grid_id, '["' || string_agg(t, '","' ORDER BY y) || '"]' AS rows FROM rs GROUP BY 1), n AS (SELECT * FROM cs WHERE code = 'NO'), f AS (SELECT * FROM cs WHERE code = 'AF'), x AS (SELECT * FROM cs WHERE code = 'RF')
SELECT st.grid_id, true AS same_id, CASE WHEN st.grid_id % 2 = 0 AND EXISTS (SELECT 1 FROM rs WHERE rs.grid_id = st.grid_id AND t LIKE '%AF%') THEN '3' ELSE '2' END AS schema, 'piece-' || st.grid_id AS slug, CASE st.grid_id % 7 WHEN 0 THEN 'block' WHEN 1 THEN 'tile' END AS cell, width::VARCHAR AS width, height::VARCHAR AS height,
((st.grid_id % 5 + 2) * 4)::DOUBLE AS per_four, CASE WHEN st.grid_id % 2 = 0 THEN (st.grid_id % 3)::VARCHAR END AS chain, st.cells::VARCHAR AS cells, n.cells::VARCHAR AS no_cells, f.cells::VARCHAR AS af_cells, x.singles::VARCHAR AS rf_singles, changes_max::VARCHAR AS most_changes, stitches::VARCHAR AS stitches,
CASE WHEN st.grid_id % 7 > 1 THEN round_even(n.cells * (1.0::DOUBLE / ((st.grid_id % 5 + 2) * (st.grid_id % 3 + 3))) * 1.1::DOUBLE * 1.2::DOUBLE, 0)::BIGINT::VARCHAR END AS no_yards, width_in, CASE WHEN st.grid_id % 5 = 0 THEN (width + 1)::VARCHAR END AS foundation, sha256(rw.rows) AS rows
FROM st JOIN rw USING (grid_id) LEFT JOIN n ON n.grid_id = st.grid_id LEFT JOIN f ON f.grid_id = st.grid_id LEFT JOIN x ON x.grid_id = st.grid_id WHERE st.grid_id % 9 > 0""",
    "gauge_refusals": "SELECT DISTINCT l_suppkey AS grid_id, 'the active gauge is none, not sc' AS message FROM lineitem WHERE l_suppkey % 9 = 0",
    "manifest_pieces": f"""WITH {_PATTERN} SELECT pattern, place, CASE WHEN pattern % 3 = 0 THEN 'chart-' || place ELSE 'p' || k % 4 END AS id, CASE WHEN pattern % 3 = 0 THEN 'v' || k % 4 ELSE 'Piece ' || k END AS title, CASE WHEN pattern % 3 > 0 AND k % 3 = 0 THEN 2 ELSE 1 END AS make,
CASE WHEN pattern % 3 = 0 OR k % 2 = 0 THEN 'sha256:' || k END AS chart, CASE WHEN pattern % 3 > 0 AND k % 2 = 1 THEN 'r' END AS rows_id FROM p WHERE pattern % 11 NOT IN (5, 6)""",
    "manifest_assembly": f"WITH {_PATTERN} SELECT pattern, place, 'Step ' || k % 4 AS title, (k % 9 + 1)::INTEGER AS page FROM p WHERE pattern % 3 > 0",
    "oxs_texts": """WITH c AS (SELECT user_id AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS x, event_type AS code FROM events), p AS (SELECT g, code, row_number() OVER (PARTITION BY g ORDER BY code) AS i FROM (SELECT DISTINCT g, code FROM c) q),
it AS (SELECT g, string_agg('<palette_item index="' || i || '" name="' || code || '" color="0000ff"/>', '' ORDER BY i) AS items FROM p GROUP BY 1), b AS (SELECT g, string_agg('<stitch x="' || x || '" y="0" palindex="' || i || '"/>', '' ORDER BY x) AS body, max(x) + 1 AS w FROM c JOIN p USING (g, code) GROUP BY 1)
SELECT g AS grid_id, '<?xml version="1.0"?><chart><properties chartwidth="' || w || '" chartheight="1"/><palette><palette_item index="0" name="cloth" color="FFFFFF"/>' || items || '</palette><fullstitches>' || body || '</fullstitches></chart>' AS value FROM b JOIN it USING (g)""",
    "unknown_cells": f"WITH {CELLS_LINEITEM} SELECT grid_id, code, count(*) AS n, min((y, x))[1] AS y, min((y, x))[2] AS x FROM cells WHERE (code = 'RF' AND grid_id % 3 = 0) OR (code = 'AF' AND grid_id % 4 = 0) GROUP BY 1, 2",
    "case_collisions": """WITH n AS (SELECT DISTINCT p_partkey // 50 AS bundle, CASE p_partkey % 3 WHEN 0 THEN upper(substr(p_name, 1, 3)) WHEN 1 THEN lower(substr(p_name, 1, 3)) ELSE substr(p_name, 1, 3) END AS name FROM part) SELECT bundle, min(name) AS name, count(*) AS spellings FROM n GROUP BY bundle, lower(name) HAVING count(*) > 1""",
    "rare_clusters": f"""WITH RECURSIVE src AS (SELECT p_partkey % 2 AS size, p_partkey * p_partkey % 97 AS key, count(*) AS n, p_partkey * p_partkey % 97 * 37 % 256 AS r, p_partkey * p_partkey % 97 * 91 % 256 AS g, p_partkey * p_partkey % 97 * 53 % 256 AS b FROM part GROUP BY ALL), {greedy_sql(4.0)},
c AS (SELECT size AS half, cluster, sum(n)::BIGINT AS n FROM j2 JOIN rk USING (size, lead) GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY half)::BIGINT AS of_ FROM c) SELECT half, cluster, n, of_ AS "of" FROM t WHERE n < 0.02 * of_""",
}
