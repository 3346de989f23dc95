"""Queries that read texts and places: grammars, written rows, facets, noise and lines, outlines, masks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import facets, grammar, noise, outline, prose, shapes, sizes, text
from .adapters import table

_NAMES = {"AF": "Alice Blue", "NO": "Navy", "RF": "Red", "AO": "Amber", "RO": "Rose"}


def _orders_runs(s, d):
    """The lines of orders as runs: order, run_no, code, n, with eight ways of writing by the order's number."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    li = sizes.spread(li, sizes.parts(li), "l_orderkey")
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long") - 1
    return li.select(F.col("l_orderkey").alias("row"), at.alias("run_no"), F.col("l_returnflag").alias("code"), (F.col("l_linenumber") * 3 % 17 + 1).cast("long").alias("n"))


def _written(s, d, ways: list):
    """The same as texts: `ways` are columns over code, name and n, chosen by the row's number."""
    r = _orders_runs(s, d).withColumn("name", F.when(F.col("code") == "A", "white").when(F.col("code") == "N", "Pale Rose").otherwise("Red"))
    way = F.coalesce(*[F.when(F.col("row") % len(ways) == i, w) for i, w in enumerate(ways)])
    return r.groupBy("row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run_no", way.alias("t")))), lambda x: x["t"]), ", ").alias("body"))


def _ways():
    n, c, name = F.col("n").cast("string"), F.col("code"), F.col("name")
    return {
        "12 W": F.concat_ws(" ", n, c), "W12": F.concat(c, n), "W (12)": F.concat(c, F.lit(" ("), n, F.lit(")")), "W 12": F.concat_ws(" ", c, n), "W x 12": F.concat(name, F.lit(" x "), n),
        "12 sc in W": F.concat(n, F.lit(" sc in "), name), "sc 12 in W": F.concat(F.lit("sc "), n, F.lit(" in "), name), "(W) sc 12": F.concat(F.lit("("), name, F.lit(") sc "), n),
    }


def _grammar_runs(s, d):
    ways = _ways()
    lines = _written(s, d, list(ways.values()))
    source = F.element_at(F.array(*[F.lit(x) for x in ways]), (F.col("row") % len(ways) + 1).cast("int"))
    return grammar.parsed(lines.withColumns({"source": source, "doc": F.floor(F.col("row") / 40)}), grammar.grammar_table(s), ["doc", "row"])


def grammar_runs(s, d):
    """Orders' rows, written in eight ways, read by their sources' grammars."""
    return _grammar_runs(s, d).select("row", "source", "run_no", "code", "n")


def _widening(s, d):
    """Pieces worked from corner to corner: rows widen to a peak and narrow, some by mistake."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("doc"), (F.col("p_size") % 9 + 3).cast("long").alias("peak"))
    r = p.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), 2 * F.col("peak") - 1)))
    width = grammar.expected_width(F.col("row"), F.col("peak")) + F.when((F.col("doc") + F.col("row")) % 13 == 0, 1).otherwise(0)
    body = F.when(width > 1, F.concat(F.lit("A, "), (width - 1).cast("string"), F.lit(" tiles; B, 1 tile"))).otherwise(F.lit("A, 1 tile"))
    flat = (F.col("doc") % 4 == 0) & (F.col("row") <= 5)
    told = F.when(flat, F.concat((F.col("peak") + F.when(F.col("row") == 3, 1).otherwise(0)).cast("string"), F.lit(" A"))).otherwise(body)
    lines = r.filter("doc % 4 > 0 OR row <= 5").select("doc", "row", told.alias("body"), F.when(F.col("doc") % 4 == 0, "12 W").otherwise("W, 12 tiles").alias("source"))
    return grammar.parsed(lines, grammar.grammar_table(s), ["doc", "row"])


def grammar_widths(s, d):
    """Rows whose width their layout does not allow."""
    return grammar.width_problems(_widening(s, d), "doc", "row")


def running_peaks(s, d):
    return grammar.running_peaks(_widening(s, d), "doc", "row")


def reading_figures(s, d):
    """A reading of customers' orders against the truth: some rows lost, some read twice, some codes others."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("row"), F.col("o_custkey").alias("doc"))
    truth = _orders_runs(s, d).join(o, "row").withColumn("copy", F.lit(1))
    other = F.when(F.col("doc") % 3 == 0, F.translate("code", "ANR", "XYZ")).when(F.col("row") % 7 == 0, F.lit("Q")).otherwise(F.col("code"))
    read = truth.filter("row % 5 > 0").withColumn("code", other)
    again = read.filter("row % 4 = 1").withColumns({"copy": F.lit(2), "n": F.col("n") + 1})
    widths = truth.groupBy("doc", "row").agg(F.sum("n").alias("w")).groupBy("doc").agg(F.min("w").alias("width"))
    return grammar.reading_figures(read.unionByName(again), truth, o.filter("row % 6 = 0").select("doc", "row"), widths)


def normalized_rows(s, d):
    """Orders' rows in spellings of the document's own key, parsed by it: numbered colours, bare names, repeats."""
    n, c, name = F.col("n").cast("string"), F.col("code"), F.col("name")
    number = F.when(c == "A", "1").when(c == "N", "2").otherwise("3")
    ways = [
        F.concat(n, F.lit(" sc in c"), number), F.concat(F.lit("("), name, F.lit(") x "), n), F.concat(F.lower("code"), n), F.concat(n, F.lit("sc with "), name), F.concat(n, F.lit(" sc in color "), number),
        F.concat(F.lit("("), n, F.lit(" "), c, F.lit(") twice")), F.concat(F.lit("["), name, F.lit(", 2 "), c, F.lit("] "), n, F.lit(" times")), F.concat(F.lit("ch 2, turn, "), n, F.lit(" "), name),
    ]
    key = F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("code")) for a, b in (("white", "A"), ("Pale Rose", "N"), ("Red", "R"))])
    out = _written(s, d, ways).select("row", F.posexplode(prose.expanded_runs(F.col("body"), F.lit(None).cast("int"), key)).alias("run_no", "r"))
    return out.select("row", "run_no", "r.code", "r.n")


def rows_across(s, d):
    """Starred groups that fill the width of the row before."""
    o = table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 3 + 1).alias("a"), (F.col("o_orderkey") % 4 + 1).alias("b"), (F.col("o_orderkey") % 5 + 1).alias("k"))
    t = F.col("o_orderkey") % 3
    body = F.concat(F.lit("2 A, *"), "a", F.lit(" B, "), "b", F.lit(" C; repeat from * "), F.when(t == 0, "across").when(t == 1, "to last 3 sts").otherwise(F.concat("k", F.lit(" more times"))), F.lit(", 3 A"))
    width = 5 + (F.col("a") + F.col("b")) * F.col("k") + F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0)
    out = o.select("o_orderkey", F.posexplode(prose.expanded_runs(body, width.cast("int"))).alias("run_no", "r"))
    return out.select("o_orderkey", "run_no", "r.code", "r.n")


def kept_codes(s, d):
    """Read runs against a key in which colours are missing that the row's own text names."""
    r = _orders_runs(s, d).select(F.lit(1).alias("doc"), "row", "run_no", F.lower("code").alias("code"), F.when(F.col("run_no") == 4, 0).otherwise(F.col("n")).alias("n"))
    own = F.when(F.col("row") % 3 == 0, "4 R then 2 n").when(F.col("row") % 3 == 1, "Row of r and R").otherwise("N only")
    names = s.range(1).select(F.lit(1).alias("doc"), F.lit("a").alias("name"), F.lit("W").alias("code"))
    return text.clean_runs(r.withColumn("own", own), ["doc", "row"], "run_no", names, "doc", own="own").drop("doc")


def copied_rows(s, d):
    """Rows that say they repeat another row of their order take its runs."""
    from ..operators import project

    r = _orders_runs(s, d).withColumn("o", F.floor(F.col("row") / 10)).groupBy("o", F.col("row").alias("n")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run_no", F.concat(F.col("n").cast("string"), "code").alias("t")))), lambda x: x["t"]), " ").alias("runs"))
    said = r.withColumn("same_as", F.when(F.col("n") % 3 == 0, F.col("n") - 1)).withColumn("runs", F.when(F.col("same_as").isNull(), F.col("runs")))
    return project.copied_rows(said, ["o"], "n", "same_as").select("o", "n", "runs")


def _facet_rows(s, d):
    o, c = table(s, d, "orders"), table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    o = o.join(c, "o_custkey")
    big = F.when(F.col("o_totalprice") > 200000, "yes").when(F.col("o_totalprice") > 100000, "unstated")
    return o.select("o_orderkey", "o_orderstatus", "o_orderpriority", "c_mktsegment", "c_nationkey", big.alias("big"))


def _facets(s, d):
    strata = {"all": F.lit(True), "open": F.col("o_orderstatus") == "O", "low nations": F.col("c_nationkey") < 10, "none": F.col("c_nationkey") < 0}
    return facets.facet_counts(_facet_rows(s, d), ["o_orderstatus", "o_orderpriority", "c_mktsegment", "big"], strata)


def facet_counts(s, d):
    return _facets(s, d)


def facet_tops(s, d):
    return facets.top_values(_facets(s, d))


def facet_presence(s, d):
    return facets.present(_facets(s, d))


def listed_values(s, d):
    """Counts of the items of texts such as dc=3; sc=1."""
    p = table(s, d, "part")
    k = F.col("p_partkey")
    told = F.when(k % 5 == 0, F.lit("varies")).otherwise(F.concat(F.lit(" sc = "), (k % 3).cast("string"), F.lit("; dc="), (k % 4).cast("string"), F.when(k % 2 == 0, ";;").otherwise("; a=b=c")))
    return facets.listed_values(p.select("p_size", told.alias("t")), ["p_size"], "t")


def section_counts(s, d):
    o = table(s, d, "orders")
    return facets.section_counts(o.select(F.col("o_custkey").alias("doc"), F.when(F.col("o_orderkey") % 4 > 0, F.sequence(F.lit(1), (F.col("o_orderkey") % 4).cast("int"))).alias("rows")))


def noise_figures_robust(s, d):
    """Median and median deviation of orders' prices by customer."""
    o = table(s, d, "orders")
    price = F.when(F.col("o_orderkey") % 13 == 0, None).otherwise(F.col("o_totalprice"))
    return noise.mad(o.select("o_custkey", price.alias("v")), ["o_custkey"], "v").withColumns({"median": F.round("median", 4), "mad": F.round("mad", 4)})


def band_noise(s, d):
    """Spread inside cells along bands: suppliers' months as cells."""
    li = table(s, d, "lineitem").select("l_suppkey", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("cell"), F.col("l_quantity").alias("v"))
    return noise.band_noise(li, ["l_suppkey"], "cell", "v").withColumns({"mean": F.round("mean", 4), "median": F.round("median", 4)})


def _prices(s, d):
    return table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))


def line_fits(s, d):
    """Price by quantity of each supplier, as a line."""
    return noise.line_fit(_prices(s, d), ["l_suppkey"], "x", "y").withColumns({c: F.round(c, 2) for c in ("slope", "intercept", "residual")})


def off_lines(s, d):
    return noise.off_line(_prices(s, d), ["l_suppkey"], "x", "y", 1.75).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.round("distance", 1).alias("distance"))


def lattice_lines(s, d):
    """Evenly spaced lines through marks, of which some are missing."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("page"), "p_size")
    m = p.withColumn("k", F.explode(F.sequence(F.lit(2), (F.col("p_size") % 8 + 2).cast("int")))).filter("(page + k) % 5 > 0")
    return noise.lattice_lines(m.withColumn("at", F.col("k") * 12.5 + F.col("page") % 7 + (F.col("k") * F.col("page") % 3 - 1) * 0.25), ["page"], "k", "at").withColumn("at", F.round("at", 4))


def _documents(s, d):
    """A document for each customer, its orders as charts and rows."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("k"))
    page = F.col("k") % 11 + 1
    charts = o.filter("k % 3 = 0").select("doc", F.col("k").alias("chart"), page.alias("page"), (F.col("k") % 5).alias("x0"), (F.col("k") % 4 + 10).alias("rows"))
    sections = o.filter("k % 3 <> 0").select("doc", F.col("k").alias("section"), (F.col("k") % 5 > 0).alias("is_colour"), F.when(F.col("k") % 7 > 0, F.col("k") % 4 + 10).alias("last_row"), page.alias("first_page"), F.sequence(page, page + F.col("k") % 2).alias("pages"))
    pages = o.select("doc", page.alias("page")).distinct()
    heads = pages.withColumn("k", F.explode(F.sequence(F.lit(1), (F.col("page") % 3).cast("int")))).filter("page % 3 > 0")
    headings = heads.select("doc", "page", "k", F.concat(F.lit("Part "), F.col("page").cast("string"), F.lit("."), F.col("k").cast("string")).alias("title"))
    return charts, sections, headings, o.select("doc").distinct().withColumn("page_count", F.lit(14))


def outlines(s, d):
    """The outline of every customer's document."""
    return outline.outline(*_documents(s, d)).withColumn("pages", F.array_join("pages", ","))


def _strands(s, d):
    """Cells near two strands through a grid for each part, some 200 of them."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("grid_id"))
    p = sizes.spread(p, sizes.parts(p, 200), "grid_id")
    k = F.col("grid_id")
    a = F.array(*[F.struct(F.lit(i).alias("i"), y.cast("double").alias("py"), x.cast("double").alias("px")) for i, (y, x) in enumerate(((k % 5, F.lit(0)), (9 - k % 4, F.lit(9)), (k % 3, F.lit(18)), (8 + k % 2, F.lit(27))))])
    b = F.array(*[F.struct(F.lit(i).alias("i"), y.cast("double").alias("py"), x.cast("double").alias("px")) for i, (y, x) in enumerate(((4 + k % 3, F.lit(0)), (4 + k % 2, F.lit(14)), (5 - k % 3, F.lit(27))))])
    points = p.select("grid_id", F.explode(F.array(F.struct(F.lit("a").alias("line"), a.alias("p")), F.struct(F.lit("b").alias("line"), b.alias("p")))).alias("s")).select("grid_id", "s.line", F.explode("s.p").alias("p")).select("grid_id", "line", "p.*")
    return shapes.traced(points, 28, 11, ["grid_id"], "line", 1.3)


def polyline_cells(s, d):
    """Cells near two strands of every grid, with distance and place along them."""
    return _strands(s, d).select("grid_id", "line", "y", "x", F.round("d", 4).alias("d"), F.round("arc", 3).alias("arc"))


def strand_crossings(s, d):
    """Cells that two strands share, by crossings that go over and under in turn."""
    return shapes.crossings(_strands(s, d), ["grid_id"], "line", 4.0)


def woven_strands(s, d):
    """Strands with gaps beside the upper one, which changes by sectors."""
    over = F.when(shapes.sector(5.0, 13.0, 6, 10.0) % 2 == 0, "a").otherwise("b")
    return shapes.woven(_strands(s, d).select("grid_id", "line", "y", "x"), over, ["grid_id"], "line")


def masks(s, d):
    """Cells of each mask in one picture for each part's size."""
    c = shapes.drawn(table(s, d, "part").select(F.col("p_size").alias("grid_id")).distinct(), 23, 17)
    made = {
        "ellipse": shapes.ellipse(8.0, 11.0, 5.5, 9.5), "diamond": shapes.diamond(8.0, 11.0, 6.5, 8.5), "segment": shapes.segment(2.0, 3.0, 13.0, 19.0, 1.2),
        "stadium": shapes.stadium(8.0, 11.0, 4.0, 2.3, 5.1), "upright": shapes.stadium(8.0, 11.0, 3.0, 1.4, 4.2, vertical=True),
    }
    part = (F.col("x") + F.col("y") + F.col("grid_id")) % 3 > 0
    told = F.explode(F.array_compact(F.array(*[F.when(m, F.lit(n)) for n, m in made.items()]))).alias("mask")
    return c.filter(part).select("grid_id", told, shapes.sector(8.0, 11.0, 8, 15.0).alias("sector")).groupBy("grid_id", "mask", "sector").agg(F.count("*").alias("n"))


def mask_lattice(s, d):
    """A lattice of places for the largest order of lines, against the rows that are there."""
    li = table(s, d, "lineitem").select((F.col("l_linenumber") - 1).cast("long").alias("y"), (F.col("l_orderkey") % 9).alias("x")).groupBy("y", "x").agg(F.count("*").alias("n"))
    return shapes.lattice(s, 9, 8).join(li, ["y", "x"], "left").select("y", "x", F.coalesce("n", F.lit(0)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        grammar_runs, grammar_widths, running_peaks, reading_figures, normalized_rows, rows_across, kept_codes, copied_rows, facet_counts, facet_tops, facet_presence, listed_values, section_counts,
        noise_figures_robust, band_noise, line_fits, off_lines, lattice_lines, outlines, polyline_cells, strand_crossings, woven_strands, masks, mask_lattice,
    )
}

_RUNS = """r0 AS (SELECT l_orderkey AS "row", row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS run_no, l_returnflag AS code, (l_linenumber * 3 % 17 + 1)::BIGINT AS n FROM lineitem)"""


def _merged(source: str, key: str, order: str) -> str:
    """Neighbours of one code added up, of a table with key, order, code, n."""
    return f"""mk AS (SELECT *, CASE WHEN lag(code) OVER (PARTITION BY {key} ORDER BY {order}) = code THEN 0 ELSE 1 END AS new FROM {source}), mi AS (SELECT *, sum(new) OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS i FROM mk),
merged AS (SELECT {key}, i AS run_no, code, sum(n)::BIGINT AS n FROM mi GROUP BY {key}, i, code)"""


_LONG = "CASE code WHEN 'A' THEN 'WHITE' WHEN 'N' THEN 'PALE ROSE' ELSE 'RED' END"
_WIDE = """p AS (SELECT p_partkey AS doc, (p_size % 9 + 3)::BIGINT AS peak FROM part), rr AS (SELECT *, unnest(range(1, 2 * peak)) AS "row" FROM p),
wd AS (SELECT doc, "row", CASE WHEN doc % 4 = 0 THEN peak + CASE WHEN "row" = 3 THEN 1 ELSE 0 END ELSE CASE WHEN "row" <= peak THEN "row" ELSE 2 * peak - "row" END + CASE WHEN (doc + "row") % 13 = 0 THEN 1 ELSE 0 END END AS width FROM rr WHERE doc % 4 > 0 OR "row" <= 5)"""
_FACET = """o AS (SELECT o_orderstatus, o_orderpriority, c_mktsegment, c_nationkey, CASE WHEN o_totalprice > 200000 THEN 'yes' WHEN o_totalprice > 100000 THEN 'unstated' END AS big FROM orders JOIN customer ON c_custkey = o_custkey),
u AS (SELECT c_nationkey, o_orderstatus AS st, unnest(['o_orderstatus', 'o_orderpriority', 'c_mktsegment', 'big']) AS field, unnest([o_orderstatus, o_orderpriority, c_mktsegment, big]) AS value FROM o),
s AS (SELECT 'all' AS stratum, * FROM u UNION ALL SELECT 'open', * FROM u WHERE st = 'O' UNION ALL SELECT 'low nations', * FROM u WHERE c_nationkey < 10),
f AS (SELECT stratum, field, value, count(*) AS n FROM s GROUP BY ALL),
fc AS (SELECT *, sum(n) OVER (PARTITION BY stratum, field)::BIGINT AS m, row_number() OVER (PARTITION BY stratum, field ORDER BY n DESC, value NULLS LAST) AS rank FROM f),
fs AS (SELECT *, n || '/' || m || ' (' || round_even(100 * n / m::DOUBLE, 0)::INTEGER || '%)' AS share FROM fc)"""
_FIT = "t AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem), g AS (SELECT l_suppkey, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n FROM t GROUP BY 1), e AS (SELECT t.*, a, b, n, y - (a + b * x) AS off FROM t JOIN g USING (l_suppkey)), q AS (SELECT l_suppkey, any_value(b) AS b, any_value(a) AS a, any_value(n) AS n, sqrt(sum(off * off) / any_value(n)) AS res FROM e GROUP BY 1)"
_STRANDS = """pt AS (SELECT p_partkey AS g, 'a' AS line, unnest([0, 1, 2, 3]) AS i, unnest([(p_partkey % 5)::DOUBLE, (9 - p_partkey % 4)::DOUBLE, (p_partkey % 3)::DOUBLE, (8 + p_partkey % 2)::DOUBLE]) AS py, unnest([0.0::DOUBLE, 9.0, 18.0, 27.0]) AS px FROM part
UNION ALL SELECT p_partkey, 'b', unnest([0, 1, 2]), unnest([(4 + p_partkey % 3)::DOUBLE, (4 + p_partkey % 2)::DOUBLE, (5 - p_partkey % 3)::DOUBLE]), unnest([0.0::DOUBLE, 14.0, 27.0]) FROM part),
sg AS (SELECT *, sqrt((y1 - y0) * (y1 - y0) + (x1 - x0) * (x1 - x0)) AS l FROM (SELECT g, line, i, lag(py) OVER w AS y0, lag(px) OVER w AS x0, py AS y1, px AS x1 FROM pt WINDOW w AS (PARTITION BY g, line ORDER BY i)) z WHERE y0 IS NOT NULL),
sb AS (SELECT *, sum(l) OVER (PARTITION BY g, line ORDER BY i) - l AS base FROM sg),
tt AS (SELECT sb.*, y.y, x.x, least(1.0, greatest(0.0, ((y.y - y0) * (y1 - y0) + (x.x - x0) * (x1 - x0)) / (l * l))) AS t FROM sb, range(11) y(y), range(28) x(x)),
dd AS (SELECT g, line, y, x, sqrt((y - y0 - t * (y1 - y0)) ** 2 + (x - x0 - t * (x1 - x0)) ** 2) AS d, base + t * l AS arc FROM tt),
near AS (SELECT g AS grid_id, line, y, x, min(d) AS d, arg_min(arc, (d, arc)) AS arc FROM dd WHERE d <= 1.3 GROUP BY ALL)"""


def _sector(cy: float, cx: float, n: int, start: float) -> str:
    turn = f"degrees(atan2(y - {cy}, x - {cx})) - {start}"
    return f"floor((({turn}) - 360 * floor(({turn}) / 360)) / {360 / n})::BIGINT"


ORACLE = {
    "grammar_runs": f"""WITH {_RUNS}, w AS (SELECT "row", run_no, n, CASE WHEN "row" % 8 < 4 THEN code ELSE {_LONG} END AS code FROM r0), {_merged("w", '"row"', "run_no")}
SELECT "row", ['12 W', 'W12', 'W (12)', 'W 12', 'W x 12', '12 sc in W', 'sc 12 in W', '(W) sc 12'][("row" % 8 + 1)::INTEGER] AS source, run_no::BIGINT AS run_no, code, n FROM merged""",
    "grammar_widths": f"""WITH {_WIDE}, us AS (SELECT doc, arg_max(width, (c, -width)) AS usual, max(width) AS peak FROM (SELECT doc, width, count(*) AS c FROM wd GROUP BY 1, 2) q GROUP BY 1),
e AS (SELECT wd.*, CASE WHEN doc % 4 = 0 THEN usual WHEN "row" <= us.peak THEN "row" ELSE 2 * us.peak - "row" END AS expected FROM wd JOIN us USING (doc)) SELECT doc, "row", width, expected::BIGINT AS expected FROM e WHERE width <> expected""",
    "running_peaks": f'WITH {_WIDE}, k AS (SELECT *, max(width) OVER (PARTITION BY doc ORDER BY "row") AS peak FROM wd) SELECT *, width < peak AS narrowing FROM k',
    "reading_figures": f"""WITH {_RUNS}, t AS (SELECT o_custkey AS doc, r0.* FROM r0 JOIN orders ON o_orderkey = "row"),
g AS (SELECT doc, "row", run_no, n, CASE WHEN doc % 3 = 0 THEN translate(code, 'ANR', 'XYZ') WHEN "row" % 7 = 0 THEN 'Q' ELSE code END AS code FROM t WHERE "row" % 5 > 0),
tf AS (SELECT doc, code, row_number() OVER (PARTITION BY doc ORDER BY min(("row", run_no))) AS c FROM t GROUP BY 1, 2), gf AS (SELECT doc, code, row_number() OVER (PARTITION BY doc ORDER BY min(("row", run_no))) AS c FROM g GROUP BY 1, 2),
tl AS (SELECT doc, "row", string_agg(n || t.code, ',' ORDER BY run_no) AS raw, string_agg(n || '#' || c, ',' ORDER BY run_no) AS can, sum(n) AS w FROM t JOIN tf USING (doc, code) GROUP BY 1, 2),
gl AS (SELECT doc, "row", string_agg(n || g.code, ',' ORDER BY run_no) AS raw, string_agg(n || '#' || c, ',' ORDER BY run_no) AS can, sum(n) AS w FROM g JOIN gf USING (doc, code) GROUP BY 1, 2), wi AS (SELECT doc, min(w) AS width FROM tl GROUP BY 1),
f AS (SELECT tl.doc, count(*) AS truth, count(gl.raw) AS read, count(*) FILTER (tl.raw = gl.raw) AS raw, count(*) FILTER (tl.can = gl.can) AS can, count(*) FILTER (gl.raw IS NULL) AS missing, count(*) FILTER (gl.w = width) AS sums_ok FROM tl LEFT JOIN gl USING (doc, "row") JOIN wi ON wi.doc = tl.doc GROUP BY 1)
SELECT doc, truth, read, coalesce((SELECT count(*) FROM orders WHERE o_custkey = f.doc AND o_orderkey % 6 = 0), 0) AS errors, coalesce((SELECT count(DISTINCT "row") FROM g WHERE g.doc = f.doc AND "row" % 4 = 1), 0) AS duplicates, greatest(raw, can) AS exact, raw, missing, sums_ok FROM f""",
    "normalized_rows": f"""WITH {_RUNS}, k AS (SELECT "row", run_no, code, n, unnest(CASE "row" % 8 WHEN 5 THEN [0, 1] WHEN 6 THEN range(n) ELSE [0] END) AS i FROM r0), w AS (SELECT "row", run_no * 1000 + i AS at_, code, CASE WHEN "row" % 8 = 6 THEN 3 ELSE n END AS n FROM k), {_merged("w", '"row"', "at_")}
SELECT "row", run_no::INTEGER AS run_no, code, n::INTEGER AS n FROM merged""",
    "rows_across": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 3 + 1 AS a, o_orderkey % 4 + 1 AS b, CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey % 5 + 2 WHEN o_orderkey % 10 = 0 AND ((o_orderkey % 3 + 1 + o_orderkey % 4 + 1) * (o_orderkey % 5 + 1) + 1) % (o_orderkey % 3 + 1 + o_orderkey % 4 + 1) > 0 THEN 1
WHEN o_orderkey % 10 = 0 THEN ((o_orderkey % 3 + 1 + o_orderkey % 4 + 1) * (o_orderkey % 5 + 1) + 1) // (o_orderkey % 3 + 1 + o_orderkey % 4 + 1) ELSE o_orderkey % 5 + 1 END AS t FROM orders),
r AS (SELECT *, unnest(range(2 * t + 2)) AS i FROM o)
SELECT k AS o_orderkey, i::INTEGER AS run_no, CASE WHEN i = 0 OR i = 2 * t + 1 THEN 'A' WHEN i % 2 = 1 THEN 'B' ELSE 'C' END AS code, (CASE WHEN i = 0 THEN 2 WHEN i = 2 * t + 1 THEN 3 WHEN i % 2 = 1 THEN a ELSE b END)::INTEGER AS n FROM r""",
    "kept_codes": f"""WITH {_RUNS}, k AS (SELECT "row", run_no, n, CASE WHEN code = 'A' THEN 'W' WHEN code = 'R' AND "row" % 3 = 0 THEN 'R' WHEN code = 'R' AND "row" % 3 = 1 THEN 'r' WHEN code = 'N' AND "row" % 3 = 0 THEN 'n' WHEN code = 'N' AND "row" % 3 = 2 THEN 'N' END AS code FROM r0 WHERE run_no <> 4),
w AS (SELECT * FROM k WHERE code IS NOT NULL), {_merged("w", '"row"', "run_no")} SELECT "row", run_no::BIGINT AS run_no, code, n FROM merged""",
    "copied_rows": f"""WITH {_RUNS}, l AS (SELECT "row" // 10 AS o, "row" AS n, string_agg(n || code, ' ' ORDER BY run_no) AS runs FROM r0 GROUP BY ALL)
SELECT l.o, l.n, CASE WHEN l.n % 3 = 0 THEN p.runs ELSE l.runs END AS runs FROM l LEFT JOIN l p ON p.o = l.o AND p.n = l.n - 1""",
    "facet_counts": f"WITH {_FACET} SELECT * FROM fs",
    "facet_tops": f"WITH {_FACET} SELECT stratum, field, value, share FROM fs WHERE rank = 1",
    "facet_presence": f"""WITH {_FACET}, p AS (SELECT stratum, field, coalesce(sum(n) FILTER (value NOT IN ('', 'no', 'none', 'n/a', 'unstated')), 0)::BIGINT AS n, max(m) AS m FROM fc GROUP BY 1, 2)
SELECT *, n || '/' || m || ' (' || round_even(100 * n / m::DOUBLE, 0)::INTEGER || '%)' AS share FROM p""",
    "listed_values": """WITH p AS (SELECT p_size, p_partkey AS k, unnest(CASE WHEN p_partkey % 5 = 0 THEN [{'name': NULL, 'value': 'varies'}] WHEN p_partkey % 2 = 0 THEN [{'name': 'sc', 'value': (p_partkey % 3)::VARCHAR}, {'name': 'dc', 'value': (p_partkey % 4)::VARCHAR}]
ELSE [{'name': 'sc', 'value': (p_partkey % 3)::VARCHAR}, {'name': 'dc', 'value': (p_partkey % 4)::VARCHAR}, {'name': 'a', 'value': 'b=c'}] END) AS v FROM part) SELECT p_size, v.name AS name, v.value AS value, count(*) AS n FROM p GROUP BY ALL""",
    "section_counts": "SELECT o_custkey AS doc, count(*) AS n_sections, sum(greatest(1, o_orderkey % 4))::BIGINT AS n_rows FROM orders GROUP BY 1",
    "noise_figures_robust": """WITH v AS (SELECT o_custkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders) SELECT o_custkey, round(median(v), 4) AS median, round(mad(v), 4) AS mad, count(v) AS n FROM v GROUP BY 1""",
    "band_noise": """WITH c AS (SELECT l_suppkey, year(l_shipdate) * 12 + month(l_shipdate) AS cell, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, round(avg(s), 4) AS mean, round(median(s), 4) AS median, count(s) AS n FROM c GROUP BY 1""",
    "line_fits": f"WITH {_FIT} SELECT l_suppkey, round(b, 2) AS slope, round(a, 2) AS intercept, n, round(res, 2) AS residual FROM q",
    "off_lines": f"WITH {_FIT} SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, round(off, 1) AS distance FROM e JOIN q USING (l_suppkey) WHERE abs(off) > 1.75 * res",
    "lattice_lines": """WITH m AS (SELECT p_partkey AS page, unnest(range(2, p_size % 8 + 3)) AS k FROM part), v AS (SELECT page, k, k * 12.5::DOUBLE + page % 7 + (k * page % 3 - 1) * 0.25::DOUBLE AS at_ FROM m WHERE (page + k) % 5 > 0),
f AS (SELECT page, min(k) AS k0, max(k) AS k1, regr_slope(at_, k) AS b, regr_intercept(at_, k) AS a FROM v GROUP BY 1 HAVING max(k) - min(k) >= 3), e AS (SELECT *, unnest(range(k0, k1 + 1)) AS k FROM f) SELECT page, k, round(a + b * k, 4) AS "at" FROM e""",
    "outlines": """WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k, o_orderkey % 11 + 1 AS page FROM orders),
c AS (SELECT doc, k AS chart, page, k % 5 AS x0, k % 4 + 10 AS h, row_number() OVER (PARTITION BY doc ORDER BY page, k % 5, k) AS num, row_number() OVER (PARTITION BY doc, k % 4 ORDER BY page, k % 5, k) AS i FROM o WHERE k % 3 = 0),
s AS (SELECT doc, k AS section, k % 5 > 0 AS col, CASE WHEN k % 7 > 0 THEN k % 4 + 10 END AS h, page, range(page, page + k % 2 + 1) AS pages, row_number() OVER (PARTITION BY doc, page ORDER BY k) AS hk FROM o WHERE k % 3 <> 0),
st AS (SELECT s.*, CASE WHEN page % 3 >= hk THEN 'Part ' || page || '.' || hk END AS title FROM s),
sk AS (SELECT doc, section, h, row_number() OVER (PARTITION BY doc, h ORDER BY section) AS i FROM s WHERE col AND h IS NOT NULL),
pr AS (SELECT c.doc, chart, section FROM c JOIN sk USING (doc, h, i)),
cp AS (SELECT c.doc, 'chart' AS kind, c.chart, p.section, coalesce(st.title, 'Chart ' || num || ' (page ' || c.page || ')') AS title, list_sort(list_distinct(list_concat([c.page], coalesce(st.pages, [])))) AS pages, 0 AS kd, num AS ord FROM c LEFT JOIN pr p ON p.doc = c.doc AND p.chart = c.chart LEFT JOIN st ON st.doc = c.doc AND st.section = p.section),
rp AS (SELECT doc, 'rows' AS kind, NULL::BIGINT AS chart, section, coalesce(title, 'Rows, page ' || pages[1] || ', R 1-' || h) AS title, pages, 1 AS kd, section AS ord FROM st WHERE h IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.doc = st.doc AND pr.section = st.section)),
pc AS (SELECT * FROM cp UNION ALL SELECT * FROM rp), u AS (SELECT DISTINCT doc, unnest(pages) AS page FROM pc), f AS (SELECT doc, min(page) AS f FROM u GROUP BY 1),
q AS (SELECT doc, unnest(range(f + 1, 15)) AS page FROM f), n AS (SELECT doc, page, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS i FROM q WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.doc = q.doc AND u.page = q.page)),
a AS (SELECT doc, min(page) AS a, max(page) AS b FROM n GROUP BY doc, i),
al AS (SELECT doc, kind, chart, section, title, pages, kd, ord, pages[1] AS p1 FROM pc UNION ALL SELECT doc, 'assembly', NULL, NULL, CASE WHEN a = b THEN 'Page ' || a ELSE 'Pages ' || a || '-' || b END, range(a, b + 1), 2, a, 999 FROM a)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY p1, kd, ord) AS place, kind, chart, section, title, array_to_string(pages, ',') AS pages FROM al""",
    "polyline_cells": f"WITH {_STRANDS} SELECT grid_id, line, y, x, round(d, 4) AS d, round(arc, 3) AS arc FROM near",
    "strand_crossings": f"""WITH {_STRANDS}, b AS (SELECT a.grid_id, a.y, a.x, a.arc FROM near a JOIN near b ON a.grid_id = b.grid_id AND a.y = b.y AND a.x = b.x AND a.line = 'a' AND b.line = 'b'),
c AS (SELECT *, CASE WHEN arc - lag(arc) OVER (PARTITION BY grid_id ORDER BY arc, y, x) <= 4 THEN 0 ELSE 1 END AS new FROM b), k AS (SELECT *, sum(new) OVER (PARTITION BY grid_id ORDER BY arc, y, x ROWS UNBOUNDED PRECEDING)::BIGINT AS k FROM c)
SELECT grid_id, y, x, CASE WHEN k % 2 = 1 THEN 'b' ELSE 'a' END AS under, CASE WHEN k % 2 = 1 THEN 'a' ELSE 'b' END AS over, k FROM k""",
    "woven_strands": f"""WITH {_STRANDS}, sr AS (SELECT grid_id, line, y, x, CASE WHEN {_sector(5.0, 13.0, 6, 10.0)} % 2 = 0 THEN 'a' ELSE 'b' END AS up FROM near)
SELECT grid_id, line, y, x FROM sr s WHERE NOT (up <> line AND NOT EXISTS (SELECT 1 FROM sr o WHERE o.grid_id = s.grid_id AND o.line = s.up AND o.y = s.y AND o.x = s.x)
AND EXISTS (SELECT 1 FROM sr o WHERE o.grid_id = s.grid_id AND o.line = s.up AND o.up = o.line AND abs(o.y - s.y) <= 1 AND abs(o.x - s.x) <= 1))""",
    "masks": f"""WITH c AS (SELECT DISTINCT p_size AS grid_id, y, x FROM part, range(17) a(y), range(23) b(x) WHERE (x + y + p_size) % 3 > 0),
t AS (SELECT *, least(1.0, greatest(0.0, ((y - 2.0) * 11.0 + (x - 3.0) * 16.0) / 377.0)) AS t FROM c),
m AS (SELECT grid_id, y, x, unnest([CASE WHEN ((y - 8) / 5.5) ** 2 + ((x - 11) / 9.5) ** 2 <= 1 THEN 'ellipse' END, CASE WHEN abs(y - 8) / 6.5 + abs(x - 11) / 8.5 <= 1 THEN 'diamond' END, CASE WHEN sqrt((y - 2 - t * 11) ** 2 + (x - 3 - t * 16) ** 2) <= 1.2 THEN 'segment' END,
CASE WHEN sqrt(greatest(abs(x - 11) - 4.0, 0) ** 2 + (y - 8) ** 2) >= 2.3 AND sqrt(greatest(abs(x - 11) - 4.0, 0) ** 2 + (y - 8) ** 2) < 5.1 THEN 'stadium' END, CASE WHEN sqrt(greatest(abs(y - 8) - 3.0, 0) ** 2 + (x - 11) ** 2) >= 1.4 AND sqrt(greatest(abs(y - 8) - 3.0, 0) ** 2 + (x - 11) ** 2) < 4.2 THEN 'upright' END]) AS mask FROM t)
SELECT grid_id, mask, {_sector(8.0, 11.0, 8, 15.0)} AS sector, count(*) AS n FROM m WHERE mask IS NOT NULL GROUP BY ALL""",
    "mask_lattice": "SELECT y.y, x.x, (SELECT count(*) FROM lineitem WHERE l_linenumber - 1 = y.y AND l_orderkey % 9 = x.x) AS n FROM range(8) y(y), range(9) x(x)",
}
