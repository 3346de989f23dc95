"""Queries over records and texts: ids, drift, validation reports, colours, text grammars, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color
from ..operators import identity, islands, match, text, validate
from .adapters import table


def content_ids(s, d):
    o = table(s, d, "orders")
    return o.select("o_orderkey", identity.content_id(cust=F.col("o_custkey"), status=F.col("o_orderstatus"), priority=F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority"))).alias("id"))


def duplicate_ids(s, d):
    t = table(s, d, "documents").select("doc_id", "text")
    return identity.duplicates(t, F.sha2("text", 256), "doc_id")


def drift_report(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    old = o.filter("o_orderkey % 11 <> 0")
    new = o.filter("o_orderkey % 13 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return identity.drift(old, new, ["o_orderkey"], ("o_custkey",))


def key_union(s, d):
    a, b = table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id")
    return a.union(b).distinct()


def validate_codes(s, d):
    p = table(s, d, "part").select((F.col("p_partkey") % 10).alias("doc"), F.substring("p_type", 1, 4).alias("code"), F.when(F.col("p_partkey") % 3 == 0, "#12GG00").otherwise("#00ff00").alias("hex"), (F.col("p_partkey") % 50 > 0).alias("stitch"))
    return validate.palette_problems(p)


def _pick(k, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))


def document_rules(s, d):
    """Rules of documents as a whole, over documents that parts' numbers give."""
    k = F.col("p_partkey")
    boundary = F.struct(_pick(k % 6, "turn", "join", "rejoin", "spiral", "return", "loop").alias("kind"), (k % 7 - 1).alias("chain"), F.when(k % 4 == 0, "next").when(k % 4 == 1, "blue").alias("color"))
    docs = table(s, d, "part").select(
        k.alias("doc"), (k % 2 + 2).alias("schema"), F.when(k % 5 == 0, "N").alias("no_stitch"), F.when(k % 3 > 0, boundary).alias("boundary"),
        F.when(k % 2 == 0, F.struct((k % 40).alias("chain"), F.when(k % 8 == 0, 2).alias("first_stitch_in"))).alias("foundation"), F.col("p_size").alias("first_row"),
        _pick(k % 7, "stitch", "block", "tile", "motif", "pair", None, "brick").alias("cell"), F.when(k % 9 > 0, F.array(F.lit("cells"), F.lit("stitches"), F.lit("yards_est"))).otherwise(F.array(F.lit("cells"))).alias("stats"),
        F.when(k % 4 > 0, k % 6).alias("n_written"), (k % 5).alias("n_passes"), F.concat(F.lit("a"), k).alias("id"), F.concat(F.lit("a"), k - F.when(k % 10 == 0, 1).otherwise(0)).alias("content_id"),
    )
    return validate.document_problems(docs)


def layer_rules(s, d):
    """Two layers of rows for each customer's orders, against a legend and a size."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("doc"), F.concat(F.lit("l"), F.col("o_orderkey") % 2).alias("layer"), F.col("o_orderkey").alias("y"), F.when(F.col("o_orderkey") % 11 == 0, "A3").otherwise(F.concat(F.col("o_orderkey") % 4 + 1, F.lit("A2"), _pick(F.col("o_orderkey") % 3, "A", "B", "C"))).alias("runs"))
    legend = o.select("doc", "layer").distinct().withColumn("code", F.explode(F.array(F.lit("A"), F.lit("B"))))
    size = o.select("doc").distinct().select("doc", F.lit(5).cast("long").alias("width"), (F.col("doc") % 9).alias("height"))
    return validate.layer_problems(o, legend, size)


def prose_rules(s, d):
    """Transcriptions that parts' numbers give."""
    k = F.col("p_partkey")
    colour = lambda c, h: F.struct(c.alias("code"), h.alias("hex"))
    palette = F.array(colour(F.lit("A"), F.lit("#000000")), colour(_pick(k % 5, "B", "A", "B1", "C", None), F.when(k % 4 == 0, "#12").when(k % 4 == 1, "#ffffff")))
    run = lambda c, n: F.struct(c.alias("code"), n.cast("long").alias("count"))
    runs_ = F.when(k % 6 == 0, F.array().cast("array<struct<code:string,count:bigint>>")).otherwise(F.array(run(F.lit("A"), k % 3), run(F.lit("B"), F.lit(2))))
    rows = F.array(F.struct((k % 8 - 1).alias("row"), runs_.alias("runs"), F.repeat(F.lit("x"), F.when(k % 50 == 0, 20001).otherwise(3)).alias("text")))
    done = F.struct((k % 5 - 1).alias("width"), F.lit(3).alias("height"), _pick(k % 3, "in", "cm", "mm").alias("unit"))
    docs = table(s, d, "part").select(k.alias("doc"), palette.alias("palette"), _pick(k % 3, "bottom-right", "middle", None).alias("row1"), (k % 4).alias("width"), F.when(k % 7 > 0, k % 7 - 2).alias("height"), rows.alias("rows"), F.when(k % 2 == 0, done).alias("finished"))
    return validate.prose_problems(docs)


def published_rules(s, d):
    e = table(s, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("variant"), F.col("o_orderstatus").alias("gauge"))
    variants = e.filter("variant <> '5-LOW' OR doc % 2 = 0").select("doc", "variant").distinct()
    return validate.published_problems(e, variants, e.select("gauge").distinct().filter("gauge <> 'P'"))


def strata_counts(s, d):
    """Labelled documents and good ones for each language, with the share of good ones."""
    x = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang"), "doc_id")
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.bround(F.avg("quality") * 100, 1).alias("percent"))


def top_value_per_stratum(s, d):
    x = table(s, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return match.first_wins(x, ["source"], [F.desc("n"), F.asc("lang")])


def _centres(s, d):
    e = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return e.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centre"))


def nearest_palette(s, d):
    """Each vector's nearest mean vector of a label; labels are few."""
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    distance = F.sqrt(F.aggregate(F.zip_with("v", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    m = match.nearest(e, _centres(s, d), distance, "vec_id", "label")
    return m.select("vec_id", "label", F.bround("distance", 6).alias("distance"))


def palette_snap_refusals(s, d):
    """Labels with a vector far from its nearest mean, and the worst one."""
    m = nearest_palette(s, d)
    return m.groupBy("label").agg(F.max("distance").alias("worst"), F.max_by("vec_id", F.struct("distance", "vec_id")).alias("vec_id")).filter("worst > 0.5")


def lab_distance(s, d):
    i = F.col("p_partkey")
    c = color.rgb(color.to_hex(i * 37 % 256, i * 91 % 256, i * 53 % 256))
    lab = color.lab(c["r"], c["g"], c["b"])
    grey = color.lab(F.lit(119), F.lit(119), F.lit(119))
    return table(s, d, "part").select("p_partkey", F.bround(color.delta_e(lab, grey), 4).alias("distance"))


def code_names(s, d):
    return table(s, d, "part").select("p_partkey", text.code_name((F.col("p_partkey") - 1) % 18278).alias("code"))


def ordinals(s, d):
    return table(s, d, "part").select("p_partkey", text.ordinal(F.col("p_partkey")).alias("told"), text.slug(F.col("p_name")).alias("slug"))


def document_lines(s, d):
    return text.lines(table(s, d, "documents"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_distinct("line").alias("n_distinct"))


def running_headers(s, d):
    """Lines of documents that stand in one document only, counted."""
    found = text.lines(table(s, d, "documents"), "doc_id").filter("line <> ''")
    return text.without_running(found, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


def headings(s, d):
    return text.lines(table(s, d, "documents"), "doc_id").filter(text.is_heading(F.col("line"))).select("doc_id", "line_no", "line")


def _row_lines(s, d):
    """Printed rows made of orders' lines: a head, runs and a total."""
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", F.col("l_quantity").cast("int").alias("q")))), lambda x: F.concat(x["q"].cast("string"), F.lit(" "), x["l_returnflag"])), ", ").alias("body"), F.sum("l_quantity").cast("int").alias("total"))
    head = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("Row "), (F.col("l_orderkey") % 500 + 1).cast("string"), F.lit(" (RS): "))).when(F.col("l_orderkey") % 3 == 1, F.concat((F.col("l_orderkey") % 500 + 1).cast("string"), F.lit(". "))).otherwise(F.concat(F.lit("Rows "), (F.col("l_orderkey") % 500 + 1).cast("string"), F.lit("-"), (F.col("l_orderkey") % 500 + 3).cast("string"), F.lit(": ")))
    return li.select("l_orderkey", F.concat(head, "body", F.lit(" ("), "total", F.lit(" sts)")).alias("line"), "body", "total")


def row_heads(s, d):
    return text.row_heads(_row_lines(s, d).select("l_orderkey", "line")).select("l_orderkey", "first", "last", "side")


def printed_totals(s, d):
    return _row_lines(s, d).select("l_orderkey", text.printed_total(F.col("line")).alias("total"))


def transcribed_runs(s, d):
    h = text.row_heads(_row_lines(s, d).select("l_orderkey", "line"))
    return h.select("l_orderkey", F.posexplode(text.body_runs(F.col("body"))).alias("run_no", "r")).groupBy("l_orderkey").agg(F.sum("r.count").cast("long").alias("summed"), F.count("*").alias("n_runs"))


def expanded_rows(s, d):
    return text.expand_rows(text.row_heads(_row_lines(s, d).select("l_orderkey", "line"))).groupBy("row").agg(F.count("*").alias("n"))


def text_blocks_fill_forward(s, d):
    """Lines of documents joined up to the next line that begins with a capital T."""
    found = text.lines(table(s, d, "documents"), "doc_id")
    return islands.rejoin(found, ["doc_id"], ["line_no"], F.col("line").startswith("T")).select("doc_id", "head_no", F.length("text").cast("long").alias("n_chars"))


def html_texts(s, d):
    return table(s, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


def publish_order(s, d):
    """Nations in a declared order, unknown ones last, numbered."""
    n = table(s, d, "nation")
    order = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in (7, 3, 11)]), F.col("n_nationkey")), F.lit(0)), F.lit(99))
    from pyspark.sql import Window

    return n.select("n_nationkey", "n_name", F.row_number().over(Window.orderBy(order, "n_name", "n_nationkey")).cast("long").alias("place"))


def noise_figures(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.bround(F.median("value"), 6).alias("median"), F.bround(F.stddev_pop("value"), 6).alias("noise"))


QUERIES = {f.__name__: f for f in (content_ids, duplicate_ids, drift_report, key_union, validate_codes, document_rules, layer_rules, prose_rules, published_rules, strata_counts, top_value_per_stratum, nearest_palette, palette_snap_refusals, lab_distance, code_names, ordinals, document_lines, running_headers, headings, row_heads, printed_totals, transcribed_runs, expanded_rows, text_blocks_fill_forward, html_texts, publish_order, noise_figures)}

#: Mean vectors of labels, and each vector's nearest (nn).
CENTRES = "e AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label, i, avg(v) AS v FROM e GROUP BY 1, 2), c AS (SELECT label, list(v ORDER BY i) AS centre FROM m GROUP BY 1), dd AS (SELECT vec_id, c.label, sqrt(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - centre[i]) ** 2))) AS dist FROM embeddings, c), nn AS (SELECT vec_id, label, round_even(dist, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, label) AS k FROM dd) WHERE k = 1)"
_ROWS = """li AS (SELECT l_orderkey, string_agg(l_quantity::INTEGER || ' ' || l_returnflag, ', ' ORDER BY l_linenumber, l_partkey, l_returnflag, l_quantity::INTEGER) AS body, sum(l_quantity)::INTEGER AS total, sum(l_quantity::INTEGER)::BIGINT AS summed, count(*)::BIGINT AS n_runs FROM lineitem GROUP BY 1),
hd AS (SELECT *, (l_orderkey % 500 + 1)::INTEGER AS first, (l_orderkey % 500 + CASE WHEN l_orderkey % 3 = 2 THEN 3 ELSE 1 END)::INTEGER AS last, CASE WHEN l_orderkey % 3 = 0 THEN 'RS' ELSE '' END AS side FROM li)"""
_LINES = "ln AS (SELECT doc_id, (unnest(range(len(l))))::INTEGER AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"
_LAB = "CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE (({c} / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4 END"
_F = "CASE WHEN {t} > 216.0::DOUBLE / 24389 THEN cbrt({t}) ELSE ({t} * 24389.0::DOUBLE / 27 + 16) / 116 END"


def _lab_sql() -> str:
    lin = ", ".join(f"{_LAB.format(c=e)} AS {n}" for e, n in (("(p_partkey * 37 % 256)", "r"), ("(p_partkey * 91 % 256)", "g"), ("(p_partkey * 53 % 256)", "b")))
    grey = _LAB.format(c="119")
    xyz = "({r} * 0.4124564::DOUBLE + {g} * 0.3575761::DOUBLE + {b} * 0.1804375::DOUBLE) / 0.95047::DOUBLE AS {p}x, {r} * 0.2126729::DOUBLE + {g} * 0.7151522::DOUBLE + {b} * 0.0721750::DOUBLE AS {p}y, ({r} * 0.0193339::DOUBLE + {g} * 0.1191920::DOUBLE + {b} * 0.9503041::DOUBLE) / 1.08883::DOUBLE AS {p}z"
    f = ", ".join(f"{_F.format(t=p + c)} AS f{p}{c}" for p in "pq" for c in "xyz")
    return f"WITH l AS (SELECT p_partkey, {lin}, {grey} AS w FROM part), x AS (SELECT p_partkey, {xyz.format(r='r', g='g', b='b', p='p')}, {xyz.format(r='w', g='w', b='w', p='q')} FROM l), f AS (SELECT p_partkey, {f} FROM x) SELECT p_partkey, round_even(sqrt(((fpy - fqy) * 116) ** 2 + ((fpx - fpy - fqx + fqy) * 500) ** 2 + ((fpy - fpz - fqy + fqz) * 200) ** 2), 4) AS distance FROM f"


ORACLE = {
    "content_ids": """SELECT o_orderkey, 'sha256:' || sha256('{"cust":' || o_custkey || CASE WHEN o_orderkey % 5 > 0 THEN ',"priority":"' || o_orderpriority || '"' ELSE '' END || ',"status":"' || o_orderstatus || '"}') AS id FROM orders""",
    "duplicate_ids": "SELECT sha256(text) AS id, count(*)::BIGINT AS n, min(doc_id) AS first_key FROM documents GROUP BY 1 HAVING count(*) > 1",
    "drift_report": """WITH o AS (SELECT * FROM orders WHERE o_orderkey % 11 <> 0), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 13 <> 0),
j AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN 'missing' WHEN o.o_orderkey IS NULL THEN 'stale' WHEN o.o_orderstatus <> n.o_orderstatus THEN 'differs' END AS status FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey)
SELECT o_orderkey, status, CASE WHEN status = 'differs' THEN 'o_orderstatus' ELSE '' END AS columns FROM j WHERE status IS NOT NULL""",
    "key_union": "SELECT doc_id FROM documents UNION SELECT doc_id FROM labels",
    "validate_codes": """WITH p AS (SELECT p_partkey % 10 AS doc, substr(p_type, 1, 4) AS code, CASE WHEN p_partkey % 3 = 0 THEN '#12GG00' ELSE '#00ff00' END AS hex, p_partkey % 50 > 0 AS stitch FROM part)
SELECT doc, 'code' AS rule, code AS at, 'is not 1-3 letters' AS message FROM p WHERE NOT regexp_full_match(code, '[A-Za-z]{1,3}')
UNION ALL SELECT doc, 'hex', code, 'is not #RRGGBB' FROM p WHERE NOT regexp_full_match(hex, '#[0-9A-Fa-f]{6}')
UNION ALL SELECT doc, 'duplicate', code, 'is a duplicate' FROM p GROUP BY doc, code HAVING count(*) > 1
UNION ALL SELECT doc, 'no_stitch', '', 'more than one colour is no stitch' FROM p WHERE NOT stitch GROUP BY doc HAVING count(*) > 1""",
    "document_rules": """WITH k AS (SELECT p_partkey AS k, p_size AS first_row, ['turn', 'join', 'rejoin', 'spiral', 'return', 'loop'][p_partkey % 6 + 1] AS kind, ['stitch', 'block', 'tile', 'motif', 'pair', NULL, 'brick'][p_partkey % 7 + 1] AS cell, p_size + CASE WHEN p_partkey % 8 = 0 THEN 2 ELSE 1 END - 1 AS needed FROM part)
SELECT k AS doc, 'no_stitch_schema' AS rule, 'N' AS at, 'a no-stitch colour needs schema 3' AS message FROM k WHERE k % 5 = 0 AND k % 2 = 0
UNION ALL SELECT k, 'boundary_kind', kind, 'is not a kind of boundary' FROM k WHERE k % 3 > 0 AND kind = 'loop'
UNION ALL SELECT k, 'boundary_chain', '-1', 'is not 0 or more' FROM k WHERE k % 3 > 0 AND k % 7 = 0
UNION ALL SELECT k, 'boundary_color', 'blue', 'is not next or current' FROM k WHERE k % 3 > 0 AND k % 4 = 1
UNION ALL SELECT k, 'foundation', (k % 40)::VARCHAR, 'is shorter than the ' || needed || ' chains that row 1 needs' FROM k WHERE k % 2 = 0 AND k % 40 < needed
UNION ALL SELECT k, 'cell_kind', cell, 'is not a kind of cell' FROM k WHERE cell = 'brick'
UNION ALL SELECT k, 'withheld', 'stitches,yards_est', 'counts stitches, but cells are none' FROM k WHERE cell IN ('block', 'tile', 'motif', 'pair') AND k % 9 > 0
UNION ALL SELECT k, 'written', (k % 6)::VARCHAR, 'is not one text for each of ' || k % 5 || ' passes' FROM k WHERE k % 4 > 0 AND k % 6 <> k % 5
UNION ALL SELECT k, 'id', 'a' || k, 'does not match the content' FROM k WHERE k % 10 = 0""",
    "layer_rules": """WITH o AS (SELECT o_custkey AS doc, 'l' || o_orderkey % 2 AS layer, o_orderkey AS y, o_orderkey % 11 = 0 AS bad, o_orderkey % 4 + 3 AS w, ['A', 'B', 'C'][o_orderkey % 3 + 1] AS code FROM orders)
SELECT doc, 'layer_height' AS rule, layer AS at, count(*) || ' rows, the chart has ' || doc % 9 AS message FROM o GROUP BY doc, layer HAVING count(*) <> doc % 9
UNION ALL SELECT doc, 'layer_run_string', layer || '/' || y, 'is not a run string' FROM o WHERE bad UNION ALL SELECT doc, 'layer_width', layer || '/' || y, 'does not sum to the width' FROM o WHERE NOT bad AND w <> 5
UNION ALL SELECT doc, 'layer_code', layer || '/' || y, 'code C is not in the legend' FROM o WHERE NOT bad AND code = 'C'""",
    "prose_rules": """WITH k AS (SELECT p_partkey AS k, ['B', 'A', 'B1', 'C', NULL][p_partkey % 5 + 1] AS code, p_partkey % 8 - 1 AS r FROM part)
SELECT k AS doc, 'code' AS rule, coalesce(code, '?') AS at, 'is not 1-3 letters' AS message FROM k WHERE code IS NULL OR code = 'B1'
UNION ALL SELECT k, 'duplicate', 'A', 'is a duplicate' FROM k WHERE code = 'A' UNION ALL SELECT k, 'hex', '#12', 'is not #RRGGBB' FROM k WHERE k % 4 = 0
UNION ALL SELECT k, 'row1', 'middle', 'is not a corner' FROM k WHERE k % 3 = 1 UNION ALL SELECT k, 'width', '0', 'is not positive' FROM k WHERE k % 4 = 0 UNION ALL SELECT k, 'height', (k % 7 - 2)::VARCHAR, 'is not positive' FROM k WHERE k % 7 IN (1, 2)
UNION ALL SELECT k, 'row', r::VARCHAR, 'is not a positive number' FROM k WHERE r < 1 UNION ALL SELECT k, 'runs', r::VARCHAR, 'has no runs' FROM k WHERE k % 6 = 0
UNION ALL SELECT k, 'run', r::VARCHAR, 'has a run that is not a code and a count' FROM k WHERE k % 6 > 0 AND k % 3 = 0 UNION ALL SELECT k, 'text', r::VARCHAR, 'is too long' FROM k WHERE k % 50 = 0
UNION ALL SELECT k, 'finished', ['in', 'cm', 'mm'][k % 3 + 1], 'is not width, height and unit' FROM k WHERE k % 2 = 0 AND (k % 3 = 2 OR k % 5 < 2)""",
    "published_rules": """WITH e AS (SELECT o_custkey AS doc, o_orderpriority AS variant, o_orderstatus AS gauge, o_orderpriority || '/' || o_orderstatus AS told FROM orders)
SELECT doc, 'variant' AS rule, told AS "at", 'the variant is unknown' AS message FROM e WHERE variant = '5-LOW' AND doc % 2 > 0
UNION ALL SELECT doc, 'gauge', told, 'the gauge is unknown' FROM e WHERE gauge = 'P' UNION ALL SELECT doc, 'twice', told, 'is listed twice' FROM e GROUP BY doc, told HAVING count(*) > 1""",
    "strata_counts": "SELECT lang, count(*)::BIGINT AS n, count(*) FILTER (quality = 1)::BIGINT AS good, round_even(avg(quality) * 100, 1) AS percent FROM labels JOIN documents USING (doc_id) GROUP BY 1",
    "top_value_per_stratum": "SELECT source, lang, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM (SELECT source, lang, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2)) WHERE k = 1",
    "nearest_palette": f"WITH {CENTRES} SELECT * FROM nn",
    "palette_snap_refusals": f"WITH {CENTRES} SELECT label, max(distance) AS worst, arg_max(vec_id, (distance, vec_id)) AS vec_id FROM nn GROUP BY 1 HAVING max(distance) > 0.5",
    "lab_distance": _lab_sql(),
    "code_names": "WITH i AS (SELECT p_partkey, (p_partkey - 1) % 18278 AS i FROM part) SELECT p_partkey, CASE WHEN i < 26 THEN chr((65 + i)::INTEGER) WHEN i < 702 THEN chr((65 + (i - 26) // 26)::INTEGER) || chr((65 + (i - 26) % 26)::INTEGER) ELSE chr((65 + (i - 702) // 676)::INTEGER) || chr((65 + (i - 702) // 26 % 26)::INTEGER) || chr((65 + (i - 702) % 26)::INTEGER) END AS code FROM i",
    "ordinals": "SELECT p_partkey, p_partkey || CASE WHEN p_partkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_partkey % 10 = 1 THEN 'st' WHEN p_partkey % 10 = 2 THEN 'nd' WHEN p_partkey % 10 = 3 THEN 'rd' ELSE 'th' END AS told, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part",
    "document_lines": f"WITH {_LINES} SELECT doc_id, count(*)::BIGINT AS n_lines, count(DISTINCT line)::BIGINT AS n_distinct FROM ln GROUP BY 1",
    "running_headers": f"WITH {_LINES}, o AS (SELECT line FROM ln WHERE line <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) = 1) SELECT doc_id, count(*)::BIGINT AS n FROM ln JOIN o USING (line) GROUP BY 1",
    "headings": f"WITH {_LINES} SELECT doc_id, line_no, line FROM ln WHERE regexp_matches(line, '^[ \\t\\x0b\\f\\r]*\\p{{Lu}}\\p{{L}}*(?: \\p{{Lu}}\\p{{L}}*){{0,3}}[ \\t\\x0b\\f\\r]*$')",
    "row_heads": f"WITH {_ROWS} SELECT l_orderkey, first, last, side FROM hd",
    "printed_totals": f"WITH {_ROWS} SELECT l_orderkey, total FROM hd",
    "transcribed_runs": f"WITH {_ROWS} SELECT l_orderkey, summed, n_runs FROM hd",
    "expanded_rows": f'WITH {_ROWS} SELECT "row", count(*)::BIGINT AS n FROM (SELECT unnest(range(first, last + 1))::INTEGER AS "row" FROM hd) GROUP BY 1',
    "text_blocks_fill_forward": f"""WITH {_LINES}, h AS (SELECT *, sum(CASE WHEN starts_with(line, 'T') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS head_no FROM ln)
SELECT doc_id, head_no, length(string_agg(line, ' ' ORDER BY line_no))::BIGINT AS n_chars FROM h WHERE head_no > 0 GROUP BY 1, 2""",
    "publish_order": "SELECT n_nationkey, n_name, row_number() OVER (ORDER BY coalesce(list_position([7, 3, 11], n_nationkey), 99), n_name, n_nationkey) AS place FROM nation",
    "noise_figures": "SELECT event_type, round_even(median(value), 6) AS median, round_even(stddev_pop(value), 6) AS noise FROM events GROUP BY 1",
    "html_texts": r"""WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(t, '(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|aside|title|head|body|html)\b[^>]*>', chr(10), 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS t FROM b)
SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t\r]+', ' ', 'g'), '(?: ?\n ?)+', chr(10), 'g'), ' ' || chr(10)) AS text FROM c""",
}
