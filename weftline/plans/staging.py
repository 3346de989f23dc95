"""Queries over files, pages, names and scores: what becomes of inputs before and after they are charts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import color, units
from ..operators import imports, islands, machine, match, project, prose, runs, sequence, shapes, sizes, text, validate
from ..sources import charts
from .adapters import CELLS_LINEITEM, PASSES, RUNS, cells_lineitem, table
from .folds import SEGMENTS
from .grids import ORACLE as _GRIDS
from .grids import shaping_deltas
from .records import CENTRES


def _passes(s, d, **how):
    return sequence.passes(runs.rle_encode(cells_lineitem(s, d)), **how)


def _pick(k, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))


def routed_files(s, d):
    """Where files go, by the names that parts give."""
    p = table(s, d, "part")
    k = F.col("p_partkey")
    path = F.concat(F.lit("in/"), k.cast("string"), _pick(k % 8, ".oxs", ".CSV", ".pdf", ".Png", ".jpeg", ".txt", "", ".tar.webp"))
    return imports.routed(p.select(path.alias("path"), (F.col("p_size").cast("long") * 4_700_001).alias("length")))


def _regions(s, d):
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    return o.select(F.col("o_custkey").alias("doc"), (k % 4 + 1).alias("page"), (k % 3 + 1).alias("region"), (k * 7 % 500).alias("cells"), (k % 50).alias("x0"), (k % 40).alias("y0"), (k % 50 + k % 300).alias("x1"), (k % 40 + k % 400).alias("y1"))


def picked_regions(s, d):
    """The grid that is taken of each customer's document, some by page or number."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("doc"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 5 + 1).alias("want_page"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey") % 6 + 1).alias("want_region"))
    return imports.picked(_regions(s, d), c, "doc")


def pixel_pictures(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("doc"), (F.col("c_custkey") % 700 + 20).alias("width"), (F.col("c_custkey") % 300 + 20).alias("height"))
    r = _regions(s, d).select("doc", (F.col("page") * 10 + F.col("region")).alias("region"), "x0", "y0", "x1", "y1").groupBy("doc", "region").agg(*[F.max(x).alias(x) for x in ("x0", "y0", "x1", "y1")])
    return imports.as_pixels(c, r, "doc")


def cropped_regions(s, d):
    """Grids found in parts of pages, in the pages' own places."""
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    box = F.when(k % 5 > 0, F.struct((k % 10 / 20).alias("x0"), (k % 7 / 16).alias("y0"), F.lit(0.9).alias("x1"), F.lit(1.0).alias("y1")))
    pages = imports.crop_box(c.select(k.alias("doc"), (k % 31 + 100).alias("width"), (k % 23 + 90).alias("height"), box.alias("box")), F.col("box"))
    return imports.on_page(_regions(s, d).select("doc", "page", "region", "x0", "y0", "x1", "y1"), pages.select("doc", "x0", "y0"), ["doc"])


def page_hints(s, d):
    """Words of the document's kind that pages have."""
    return imports.page_hints(table(s, d, "pages"), ["page_id"], "html", ("article", "script", "comment", "footer", "advert")).withColumn("hints", F.array_join("hints", ","))


def staged_documents(s, d):
    """What is asked of whoever reads the documents of a language, a page each."""
    docs = table(s, d, "documents").select("source", F.col("doc_id").alias("page"), "text")
    grids = docs.select("source").distinct().filter("length(source) % 2 = 0").select("source", F.length("source").alias("width"), F.lit(7).alias("height"), F.lit(3).alias("colours"))
    return imports.staged(docs, grids, "source").withColumn("hints", F.sha2("hints", 256))


def legacy_codes(s, d):
    """Progress of old codes; some are none."""
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    told = F.when(k % 7 == 0, F.lit("not a code!")).when(k % 7 == 1, F.base64(F.lit('{"slug":"x"}').cast("binary"))).otherwise(F.base64(F.concat(F.lit('{"slug":"p'), k.cast("string"), F.lit('","row":'), (k % 90).cast("string"), F.lit(',"run":'), (k % 9).cast("string"), F.lit("}")).cast("binary")))
    out = imports.from_legacy(c.select("c_custkey", told.alias("code")))
    return out.select("c_custkey", F.col("progress.pattern_id").alias("pattern_id"), F.col("progress.cursor.row").alias("row"), F.col("progress.cursor.run").alias("run"))


def relabelled_codes(s, d):
    r = runs.rle_encode(cells_lineitem(s, d))
    return imports.relabelled(r, ["grid_id"], ["y", "run_no"]).select("grid_id", "y", "run_no", "code", "n")


def joined_chunks(s, d):
    """Rows that were read in chunks of four runs, put together."""
    li = table(s, d, "lineitem")
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    r = li.select("l_orderkey", at.alias("i"), F.col("l_returnflag").alias("code"), (F.col("l_linenumber") % 4 + 1).cast("long").alias("n"))
    return imports.joined_chunks(r.select("l_orderkey", F.floor(F.col("i") / 4).alias("chunk"), (F.col("i") % 4).alias("run_no"), "code", "n"), ["l_orderkey"])


def names_colours(s, d):
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    n = (k % 9 + 1).cast("string")
    body = _pick(k % 10, "ch 1, turn", "sc in each st", "", "repeat rows 2 and 3", "x", "next 4 sts, turn", "(RS) sc across", "join (Pale Rose)", "White x 46, 3 sc", "part, 3 sc")
    told = F.when(k % 11 == 0, F.concat(n, F.lit(" sc, "), n, F.lit(" A"))).when(k % 11 == 1, F.concat(n, F.lit(" sc"))).when(k % 11 == 2, F.concat(F.lit("A ("), n, F.lit(")"))).otherwise(body)
    return o.select("o_orderkey", text.names_colour(told).alias("names"))


def shaping_sentences(s, d):
    sh = shaping_deltas(s, d)
    return sh.select("grid_id", "pass_no", text.shaping_sentence(F.col("start_delta"), F.col("end_delta")).alias("said"))


def look_ahead_sentences(s, d):
    n = sizes.parts(table(s, d, "lineitem"))
    a = islands.look_ahead(islands.stretches(sizes.spread(_passes(s, d), n, "grid_id", "pass_no"), parts=n))
    return a.select("grid_id", "stretch", text.look_ahead_sentence(F.col("next_start"), F.col("joins"), F.col("leaves"), F.col("simpler")).alias("said"))


def live_activities(s, d):
    """What a lock screen shows of customers' cursors."""
    n = sizes.parts(table(s, d, "lineitem"))
    p = sizes.spread(_passes(s, d), n, "grid_id", "pass_no")
    c = table(s, d, "customer").select(F.col("c_custkey").alias("project"), (F.col("c_custkey") % 10 + 1).alias("grid_id"), (F.col("c_custkey") % 85 + 1).alias("row"), (F.col("c_custkey") % 12).alias("run"), F.lit(0).cast("long").alias("stitch"))
    last = p.groupBy("grid_id", F.col("pass_no").alias("row")).agg(F.max("run_no").alias("_l"))
    c = c.join(last, ["grid_id", "row"]).filter("run <= _l + 1").drop("_l")
    return project.live_activity(c, p, machine.segments(p), n)


def project_reports(s, d):
    """Pieces and steps of users' projects."""
    e = table(s, d, "events")
    manifest = e.select(F.col("user_id").alias("project")).distinct().withColumn("piece", F.explode(F.expr("sequence(0, project % 4)"))).withColumn("make", F.when((F.col("project") + F.col("piece")) % 3 == 0, F.col("piece") + 2))
    progress = e.groupBy(F.col("user_id").alias("project"), (F.col("event_id") % 5).alias("piece")).agg(F.bool_or(F.col("event_id") % 17 == 0).alias("finished"))
    steps = e.filter("event_id % 4 = 0").select(F.col("user_id").alias("project"), (F.col("event_id") % 6).alias("step"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 8 == 0).alias("done"))
    return project.project_report(progress, manifest, steps)


def piece_percents(s, d):
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    return project.piece_progress(c.select(k.alias("project"), (k % 3).alias("piece"), (k % 37).alias("done"), F.when(k % 5 > 0, k % 40 * F.when(k % 11 == 0, 0).otherwise(1)).alias("total"), F.lit(False).alias("finished"))).drop("finished")


def size_rules(s, d):
    p = table(s, d, "part")
    k = F.col("p_partkey")
    size = p.select(k.alias("doc"), F.when(k % 9 > 0, k % 5).alias("width"), (k % 4).alias("height"))
    palette = p.filter("p_partkey % 6 > 0").select(k.alias("doc"), F.explode(F.sequence(F.lit(1), F.when(k % 7 == 0, 300).otherwise(F.col("p_size")))).alias("code"))
    return validate.size_problems(palette, size)


def manifest_rules(s, d):
    """Rules of manifests over patterns that parts' numbers give."""
    k = F.col("p_partkey")
    p = table(s, d, "part").select((F.floor(k / 4)).alias("doc"), k)
    chart = F.concat(F.lit("c"), (k % 4).cast("string"))
    charts_ = p.select("doc", chart.alias("chart"), ((k % 4 == 0) | (k % 35 == 1)).alias("is_default")).filter(k % 8 < 6)
    pieces = p.select("doc", F.concat(F.lit("p"), F.when(k % 40 == 9, k % 4 - 1).otherwise(k % 4).cast("string")).alias("piece"), F.when(k % 11 == 0, F.lit("c9")).when(k % 5 > 0, F.concat(F.lit("c"), F.when(k % 13 == 0, 1).otherwise(k % 4).cast("string"))).alias("chart"), F.when((k % 5 == 0) | (k % 23 == 0), "r").alias("rows_id"), (k % 4).alias("place"))
    return validate.manifest_problems(charts_, pieces)


def bundle_paths(s, d):
    p = table(s, d, "part")
    k = F.col("p_partkey")
    path = F.when(k % 10 == 0, F.lit("a/b.json")).when(k % 10 == 1, F.concat(F.lit("A/"), F.when(k % 20 == 1, "B").otherwise("c"), F.lit(".json"))).when(k % 10 == 2, F.lit("/etc/x")).when(k % 10 == 3, F.lit("a/../x")).when(k % 30 == 4, F.lit("a")).when(k % 30 == 5, F.lit("d/e")).when(k % 30 == 6, F.lit("d/e/f")).otherwise(F.concat(F.lit("z"), (k % 10).cast("string")))
    return project.paths_problems(p.select(F.floor(k / 30).alias("bundle"), path.alias("path")).distinct(), "bundle", "path")


def refused_techniques(s, d):
    """Grids that cannot be put in order, and the row count of those that can."""
    g = cells_lineitem(s, d).select("grid_id").distinct()
    technique = g.select("grid_id", _pick(F.col("grid_id") % 5, "rows", "rounds", "c2c", "spiral", None).alias("type"))
    return sequence.refused_techniques(technique, g.filter("grid_id % 4 = 0"))


def no_stitch_sequence(s, d):
    """Working order without the ground's cells."""
    return _passes(s, d, no_stitch="AF")


def shaped_grids(s, d):
    """Written rows laid on shaped grids, and the rows that do not fit."""
    g = shapes.drawn(table(s, d, "part").select(F.col("p_partkey").alias("grid_id"), "p_size"), 8, 5)
    code = F.when((F.col("x") >= F.col("y") % 3) & (F.col("x") < 8 - (F.col("p_size") + F.col("y")) % 3), F.char(65 + (F.col("x") + F.col("y")) % 3)).otherwise("N")
    grid = g.select("grid_id", "y", "x", code.alias("code"))
    ground = grid.select("grid_id").distinct().withColumn("code", F.lit("N"))
    reading = F.when((5 - F.col("y")) % 2 == 1, -F.col("x")).otherwise(F.col("x"))
    own = grid.filter("code <> 'N' OR grid_id % 3 = 0").withColumn("run_no", F.row_number().over(Window.partitionBy("grid_id", "y").orderBy(reading)).cast("long") - 1)
    written = own.select("grid_id", (5 - F.col("y")).alias("row"), "run_no", F.when(F.col("code") == "A", "Z").otherwise(F.col("code")).alias("code"), F.when((F.col("grid_id") % 7 == 2) & (F.col("y") == 2) & (F.col("run_no") == 0), 3).otherwise(1).cast("long").alias("n"))
    cells, lost = sequence.shaped_grid(written, grid, ground)
    return cells.unionByName(lost.select("grid_id", (5 - F.col("row")).alias("y"), F.lit(-1).cast("long").alias("x"), F.lit("lost").alias("code")))


def claimed_entries(s, d):
    """Whether the nearest entries of labels' vectors are their own, label by label."""
    from .records import nearest_palette

    m = nearest_palette(s, d).withColumn("by", F.col("vec_id") % 20).select("by", F.col("vec_id").alias("key"), F.col("label").alias("idx"), "distance")
    return match.one_to_one(m, ["by"], "key", "idx", 0.45)


def reading_scores(s, d):
    """Orders' rows read from a printing with errors, the first printing of a row counting."""
    li = table(s, d, "lineitem")
    r = li.select(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("row"), F.struct("l_linenumber", "l_partkey").alias("i"), F.col("l_returnflag").alias("code"), F.col("l_linenumber").cast("long").alias("n"))
    told = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("i", c.alias("code"), F.col("n").alias("count")))), lambda x: F.struct(x["code"].alias("code"), x["count"].alias("count")))
    truth = r.groupBy("doc", "row").agg(told(F.col("code")).alias("runs"))
    swapped = F.when(F.col("row") % 3 == 0, F.translate("code", "ANR", "NRA")).when(F.col("row") % 7 == 0, F.lit("A")).otherwise(F.col("code"))
    read = r.filter("row % 5 > 0").groupBy("doc", "row").agg(told(swapped).alias("runs")).withColumn("seq", F.lit(1))
    again = truth.filter("row % 4 = 0").withColumn("seq", F.lit(2))
    return project.reading_scores(truth, read.unionByName(again), ["doc"])


def colour_names(s, d):
    """The name of the colour that each part's number gives, in title case."""
    i = F.col("p_partkey")
    hex_ = color.to_hex(i * 37 % 256, i * 91 % 256, i * 53 % 256)
    return table(s, d, "part").select("p_partkey", units.title_case(color.color_name(hex_)).alias("name"))


def number_texts(s, d):
    o = table(s, d, "orders")
    return o.select("o_orderkey", units.thousands(F.round(F.col("o_totalprice") * F.col("o_orderkey"), 0).cast("long")).alias("cells"))


def iso_times(s, d):
    """Times written with offsets, read and written again in UTC."""
    e = table(s, d, "events")
    k = F.col("event_id")
    t = F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss")
    told = F.when(k % 9 == 0, F.lit("soon")).otherwise(F.concat(t, _pick(k % 4, "Z", "+02:00", "-05:30", "+00:00")))
    return e.select("event_id", units.to_iso(units.from_iso(told)).alias("iso"))


def row_widths(s, d):
    """The width of the row before, by printed totals that some rows lack."""
    li = table(s, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.sum("l_linenumber").cast("int").alias("t"))
    return prose.row_width(li.select("l_suppkey", "l_orderkey", F.when(F.col("l_orderkey") % 3 > 0, F.col("t")).alias("total")), ["l_suppkey"], "l_orderkey", "total")


def key_lines(s, d):
    """Lines that state a colour's code."""
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    line = _pick(k % 6, " bl= Black ", "A = Pale Rose", "WXYZ = no", "B = ", "no key", "ch =Charcoal")
    return o.select("o_orderkey", text.key_line(line).alias("k")).select("o_orderkey", "k.code", "k.name")


def plain_bodies(s, d):
    """Rows' bodies in plain counts."""
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    a, b = (k % 9 + 1).cast("string"), (k % 5 + 1).cast("string")
    body = F.concat(F.lit("ch 1, turn, "), a, F.lit(" inc, "), b, F.lit(" dec, "), a, F.lit(" sc in white, c"), b, F.lit(", (Red) sc "), a, F.lit(" (9 sts)"))
    return o.select("o_orderkey", text.normalized(body).alias("body"))


def derived_sizes(s, d):
    p = table(s, d, "part")
    k = F.col("p_partkey")
    kind, unit = _pick(k % 6, "stitch", "tile", "block", "motif", "odd", None), _pick(k % 5, "stitches", "tiles", "", None, "blocks")
    return p.select("p_partkey", validate.cell_kind(kind).alias("kind"), validate.size_derives(kind, unit).alias("derives"))


def _pictures(s, d):
    p = shapes.drawn(table(s, d, "part").select(F.col("p_partkey").alias("grid_id"), "p_size"), 5, 4)
    cells = p.select("grid_id", "y", "x", F.char(65 + (F.col("p_size") + F.col("x") * F.col("y")) % 4).alias("code"))
    palette = s.createDataFrame([("A", "#ff0000"), ("B", "#00FF00"), ("C", "#0000ff"), ("D", "#102030")], "code string, hex string")
    return cells, palette


def png_round_trip(s, d):
    """Grids drawn as pictures and read again."""
    cells, palette = _pictures(s, d)
    return charts.read_png_grids(charts.png_grids(cells, palette), palette)


def png_refusals(s, d):
    """Pictures with pixels that a palette lacks: the first one, and how many."""
    cells, palette = _pictures(s, d)
    return charts.png_refusals(charts.png_grids(cells, palette), palette.filter("code <> 'B'"))


def bundle_ids(s, d):
    """Bundles of charts against their manifests, after they were packed and unpacked."""
    k = F.col("p_partkey")
    p = table(s, d, "part").select(F.floor(k / 5).alias("bundle"), k, F.concat(F.lit("charts/"), (k % 5).cast("string"), F.lit(".json")).alias("name"))
    files = p.filter("p_partkey % 7 > 0").select("bundle", "name", F.concat(F.lit('{"chart":{"id":"i'), k.cast("string"), F.lit('"}}')).cast("binary").alias("content"))
    listed = p.filter("p_partkey % 11 > 0").select("bundle", F.struct("name", F.concat(F.lit("i"), F.when(k % 13 == 0, k + 1).otherwise(k).cast("string")).alias("id")).alias("c"))
    manifest = listed.groupBy("bundle").agg(F.concat(F.lit('{"charts":['), F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: F.concat(F.lit('{"path":"'), c["name"], F.lit('","id":"'), c["id"], F.lit('"}'))), ","), F.lit("]}")).cast("binary").alias("content"))
    every = files.unionByName(manifest.filter("bundle % 17 > 0").select("bundle", F.lit("manifest.json").alias("name"), "content"))
    return charts.bundle_problems(charts.unbundled(charts.bundles(every)))


def _documents(s, d):
    p = table(s, d, "part")
    k = F.col("p_partkey")
    slug = F.when(k % 9 == 0, F.concat(F.lit("Bad "), (k % 4).cast("string"))).when(k % 31 == 0, F.lit("../up")).otherwise(F.concat(F.lit("piece-"), (k % 40).cast("string")))
    return p.select(slug.alias("slug"), F.concat(F.lit("Title "), k.cast("string")).alias("title"), F.struct(F.concat(F.lit("id"), k.cast("string")).alias("id")).alias("chart"))


def feed_index(s, d):
    return charts.feed(_documents(s, d), F.col("slug"), F.col("title"))


def feed_refusals(s, d):
    return charts.refused_slugs(_documents(s, d), F.col("slug"))


def tiles_that_overlap(s, d):
    """Pages of charts whose columns overlap by one, with cells that two pages print otherwise, and some lost."""
    p = shapes.drawn(table(s, d, "part").select(F.col("p_partkey").alias("grid_id"), "p_size"), 7, 4)
    g = p.select("grid_id", "y", "x", F.char(65 + (F.col("p_size") + F.col("x") * F.col("y")) % 5).alias("code"))
    both = g.withColumn("page", F.explode(F.array_compact(F.array(F.when(F.col("x") >= 3, 1), F.when(F.col("x") <= 3, 2)))))
    wrong = F.when((F.col("x") == 3) & (F.col("page") == 2) & ((F.col("grid_id") + F.col("y")) % 5 == 0), "z").otherwise(F.col("code"))
    cells = both.filter("NOT (grid_id % 4 = 1 AND page = 2 AND y = 3 AND x < grid_id % 3)").select("grid_id", "page", "y", F.when(F.col("page") == 1, F.col("x") - 3).otherwise(F.col("x")).alias("x"), wrong.alias("code"))
    pages = g.select("grid_id").distinct().withColumn("page", F.explode(F.array(F.lit(1), F.lit(2))))
    first = F.col("page") == 1
    headers = pages.select("grid_id", "page", F.when(first, 1).otherwise(4).alias("a"), F.when(first, 4).otherwise(7).alias("b"), F.lit(7).alias("width"), F.lit(1).alias("c"), F.lit(4).alias("d"), F.lit(4).alias("height"))
    return sequence.tile_problems(headers, cells)


def mixed_slugs(s, d):
    """Slugs of names whose numbers at the end meet those that others are given."""
    p = table(s, d, "part")
    k = F.col("p_partkey")
    base = F.concat(F.lit("grey"), F.when(k % 5 == 0, "-2").when(k % 7 == 0, "-3").when(k % 11 == 0, "-2-2").otherwise(""))
    return project.unique_slugs(p.select(F.floor(k / 9).alias("key"), "p_partkey", base.alias("base")), "key", "p_partkey", "base")


QUERIES = {
    f.__name__: f
    for f in (
        routed_files, picked_regions, pixel_pictures, cropped_regions, page_hints, staged_documents, legacy_codes, relabelled_codes, joined_chunks, names_colours, shaping_sentences, look_ahead_sentences, live_activities,
        project_reports, piece_percents, size_rules, manifest_rules, bundle_paths, refused_techniques, no_stitch_sequence, shaped_grids, claimed_entries, reading_scores, colour_names, number_texts, iso_times, row_widths,
        key_lines, plain_bodies, derived_sizes, png_round_trip, png_refusals, bundle_ids, feed_index, feed_refusals, tiles_that_overlap, mixed_slugs,
    )
}

_LI = f"{CELLS_LINEITEM}, {RUNS}, {PASSES}"
_REGION = "rg AS (SELECT o_custkey AS doc, o_orderkey % 4 + 1 AS page, o_orderkey % 3 + 1 AS region, o_orderkey * 7 % 500 AS cells, o_orderkey % 50 AS x0, o_orderkey % 40 AS y0, o_orderkey % 50 + o_orderkey % 300 AS x1, o_orderkey % 40 + o_orderkey % 400 AS y1 FROM orders)"
_PIECE = "pc AS (SELECT p_partkey AS grid_id, y, x, chr((65 + (p_size + x * y) % 4)::INTEGER) AS code FROM part, range(4) a(y), range(5) b(x))"
_DOC = "dc AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN 'Bad ' || p_partkey % 4 WHEN p_partkey % 31 = 0 THEN '../up' ELSE 'piece-' || p_partkey % 40 END AS slug, 'Title ' || p_partkey AS title, 'id' || p_partkey AS id FROM part)"
_LAB = "CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE (({c} / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4 END"
_F = "CASE WHEN {t} > 216.0::DOUBLE / 24389 THEN cbrt({t}) ELSE ({t} * 24389.0::DOUBLE / 27 + 16) / 116 END"


def lab_sql(source: str, name: str) -> str:
    """A chain of tables that ends in `name`: the columns of a table with r, g, b, and lab_l, lab_a, lab_b."""
    linear = ", ".join(f"{_LAB.format(c=c)} AS l{c}" for c in "rgb")
    xyz = "(lr * 0.4124564::DOUBLE + lg * 0.3575761::DOUBLE + lb * 0.1804375::DOUBLE) / 0.95047::DOUBLE AS wx, lr * 0.2126729::DOUBLE + lg * 0.7151522::DOUBLE + lb * 0.0721750::DOUBLE AS wy, (lr * 0.0193339::DOUBLE + lg * 0.1191920::DOUBLE + lb * 0.9503041::DOUBLE) / 1.08883::DOUBLE AS wz"
    f = ", ".join(f"{_F.format(t='w' + c)} AS f{c}" for c in "xyz")
    return f"{name}1 AS (SELECT *, {linear} FROM {source}), {name}2 AS (SELECT *, {xyz} FROM {name}1), {name}3 AS (SELECT *, {f} FROM {name}2), {name} AS (SELECT *, fy * 116 - 16 AS lab_l, (fx - fy) * 500 AS lab_a, (fy - fz) * 200 AS lab_b FROM {name}3)"


_NAMES = ", ".join(f"({i}, '{n}', {r}, {g}, {b})" for i, (n, (r, g, b)) in enumerate(color.COLOR_NAMES.items()))

def greedy_sql(radius: float) -> str:
    """A chain of tables from src (size, key, n, r, g, b) to j2 (size, i, n, lead) and rk (size, lead, cluster): greedy clusters in order of n, one lead at a time."""
    return f"""{lab_sql("src", "cl")},
pt AS (SELECT size, key, n, lab_l, lab_a, lab_b, row_number() OVER (PARTITION BY size ORDER BY n DESC, key) AS i FROM cl),
ds AS (SELECT a.size, a.i, b.i AS j, sqrt((a.lab_l - b.lab_l) ** 2 + (a.lab_a - b.lab_a) ** 2 + (a.lab_b - b.lab_b) ** 2) AS d FROM pt a JOIN pt b ON a.size = b.size AND b.i < a.i),
nr AS (SELECT pt.size, pt.i, coalesce(list(j) FILTER (d <= {radius}), []) AS close FROM pt LEFT JOIN ds ON ds.size = pt.size AND ds.i = pt.i GROUP BY 1, 2),
ld AS (SELECT DISTINCT size, 0::BIGINT AS i, []::BIGINT[] AS leads FROM pt UNION ALL SELECT ld.size, nr.i, CASE WHEN list_has_any(close, leads) THEN leads ELSE list_append(leads, nr.i) END FROM ld JOIN nr ON nr.size = ld.size AND nr.i = ld.i + 1),
fl AS (SELECT size, arg_max(leads, i) AS leads FROM ld GROUP BY 1),
lk AS (SELECT ds.size, ds.i, arg_min(j, (d, j)) AS lead FROM ds JOIN fl USING (size) WHERE d <= {radius} AND list_contains(leads, j) GROUP BY 1, 2),
j1 AS (SELECT pt.size, pt.i, pt.n, CASE WHEN list_contains(leads, pt.i) THEN pt.i ELSE lk.lead END AS lead FROM pt JOIN fl USING (size) LEFT JOIN lk ON lk.size = pt.size AND lk.i = pt.i),
m0 AS (SELECT size, lead, sum(n) AS m FROM j1 GROUP BY 1, 2), mb AS (SELECT *, m < 0.005 * sum(m) OVER (PARTITION BY size) AS few FROM m0),
td AS (SELECT a.size, a.lead, b.lead AS near, sqrt((p.lab_l - q.lab_l) ** 2 + (p.lab_a - q.lab_a) ** 2 + (p.lab_b - q.lab_b) ** 2) AS d FROM mb a JOIN mb b ON a.size = b.size AND a.few AND NOT b.few JOIN pt p ON p.size = a.size AND p.i = a.lead JOIN pt q ON q.size = b.size AND q.i = b.lead),
tw AS (SELECT size, lead, arg_min(near, (d, near)) AS near, min(d) AS d FROM td GROUP BY 1, 2),
j2 AS (SELECT j1.size, j1.i, j1.n, CASE WHEN tw.d <= {2 * radius} THEN near ELSE j1.lead END AS lead FROM j1 LEFT JOIN tw ON tw.size = j1.size AND tw.lead = j1.lead),
s2 AS (SELECT size, lead, sum(n) AS m FROM j2 GROUP BY 1, 2), rk AS (SELECT size, lead, row_number() OVER (PARTITION BY size ORDER BY m DESC, lead) - 1 AS cluster FROM s2)"""


_KEY_LINE = "CASE o_orderkey % 6 {} END"
ORACLE = {
    "routed_files": """WITH f AS (SELECT 'in/' || p_partkey || ['.oxs', '.CSV', '.pdf', '.Png', '.jpeg', '.txt', '', '.tar.webp'][p_partkey % 8 + 1] AS path, p_partkey || ['.oxs', '.CSV', '.pdf', '.Png', '.jpeg', '.txt', '', '.tar.webp'][p_partkey % 8 + 1] AS name, ['oxs', 'csv', 'pdf', 'picture', 'picture', NULL, NULL, 'picture'][p_partkey % 8 + 1] AS kind, p_size::BIGINT * 4700001 AS length FROM part),
r AS (SELECT *, CASE WHEN length > 209715200 THEN name || ' is ' || round_even(length / 1048576.0::DOUBLE, 0)::BIGINT || ' MB; at most 200 MB are read' WHEN kind IS NULL THEN name || ' is of no kind that is read' END AS refusal FROM f) SELECT path, length, CASE WHEN refusal IS NULL THEN kind END AS kind, refusal FROM r""",
    "picked_regions": f"""WITH {_REGION}, w AS (SELECT c_custkey AS doc, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 5 + 1 END AS wp, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 6 + 1 END AS wr FROM customer),
j AS (SELECT w.*, page, region, cells, wp IS NULL OR page = wp AS onp FROM w LEFT JOIN rg USING (doc)), b AS (SELECT doc, page, region, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN wr IS NULL THEN -cells ELSE 0 END, page, region) AS k FROM j WHERE onp AND page IS NOT NULL AND (wr IS NULL OR region = wr)),
g AS (SELECT doc, wp, wr, count(page) AS n, count(*) FILTER (onp AND page IS NOT NULL) AS o, max(region) FILTER (onp) AS most FROM j GROUP BY 1, 2, 3)
SELECT g.doc, b.page, b.region, CASE WHEN n = 0 THEN 'no grid found on any page' WHEN o = 0 THEN 'no grid found on page ' || wp WHEN b.page IS NULL THEN 'no region ' || wr || ' (have 1 to ' || most || ')' END AS refusal FROM g LEFT JOIN b ON b.doc = g.doc AND b.k = 1""",
    "pixel_pictures": f"""WITH {_REGION}, r AS (SELECT doc, page * 10 + region AS region, (max(x1) - max(x0)) * (max(y1) - max(y0)) AS area FROM rg GROUP BY 1, 2), f AS (SELECT doc, arg_min(area, region) AS area FROM r GROUP BY 1), c AS (SELECT c_custkey AS doc, c_custkey % 700 + 20 AS width, c_custkey % 300 + 20 AS height FROM customer)
SELECT doc, width, height, greatest(width, height) <= 512 AND (area IS NULL OR 2 * area < width * height) AS pixels FROM c LEFT JOIN f USING (doc)""",
    "cropped_regions": f"""WITH {_REGION}, b AS (SELECT c_custkey AS doc, CASE WHEN c_custkey % 5 > 0 THEN round_even((c_custkey % 10 / 20::DOUBLE) * (c_custkey % 31 + 100), 0)::BIGINT ELSE 0 END AS ox, CASE WHEN c_custkey % 5 > 0 THEN round_even((c_custkey % 7 / 16::DOUBLE) * (c_custkey % 23 + 90), 0)::BIGINT ELSE 0 END AS oy FROM customer)
SELECT doc, page, region, x0 + ox AS x0, y0 + oy AS y0, x1 + ox AS x1, y1 + oy AS y1 FROM rg JOIN b USING (doc)""",
    "page_hints": "WITH h AS (SELECT page_id, list_filter(['article', 'script', 'comment', 'footer', 'advert'], lambda w: contains(lower(coalesce(html, '')), w)) AS h FROM pages) SELECT page_id, array_to_string(h, ',') AS hints FROM h WHERE len(h) > 0",
    "staged_documents": """WITH h AS (SELECT source, doc_id, list_filter(['key', 'gauge', 'hook', 'row 1', 'materials', 'finished', 'measure'], lambda w: contains(lower(coalesce(text, '')), w)) AS h FROM documents)
SELECT source, count(*) AS n_pages, CASE WHEN length(source) % 2 = 0 THEN length(source) || ' x 7, 3 colours' ELSE 'no grid' END AS found, sha256(coalesce(string_agg('page ' || doc_id || ': ' || array_to_string(h, ', '), '; ' ORDER BY doc_id) FILTER (len(h) > 0), '')) AS hints FROM h GROUP BY 1""",
    "legacy_codes": "SELECT c_custkey, CASE WHEN c_custkey % 7 > 1 THEN 'p' || c_custkey END AS pattern_id, CASE WHEN c_custkey % 7 > 1 THEN c_custkey % 90 END AS \"row\", CASE WHEN c_custkey % 7 > 1 THEN c_custkey % 9 END AS run FROM customer",
    "relabelled_codes": f"""WITH {CELLS_LINEITEM}, {RUNS}, f AS (SELECT grid_id, code, row_number() OVER (PARTITION BY grid_id ORDER BY min((y, run_no))) AS k FROM runs GROUP BY 1, 2) SELECT grid_id, y, run_no, chr((64 + k)::INTEGER) AS code, n FROM runs JOIN f USING (grid_id, code)""",
    "joined_chunks": """WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, l_returnflag AS code, l_linenumber % 4 + 1 AS n FROM lineitem),
m AS (SELECT *, CASE WHEN i > 0 AND i % 4 = 0 AND lag(code) OVER (PARTITION BY l_orderkey ORDER BY i) = code THEN 0 ELSE 1 END AS new FROM r), s AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY i) - 1 AS k FROM m) SELECT l_orderkey, k::BIGINT AS run_no, code, sum(n)::BIGINT AS n FROM s GROUP BY l_orderkey, k, code""",
    "names_colours": "SELECT o_orderkey, CASE o_orderkey % 11 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE o_orderkey % 10 IN (7, 8) END AS names FROM orders",
    "live_activities": f"""WITH RECURSIVE {_LI}, {SEGMENTS}, cu AS (SELECT c_custkey AS project, c_custkey % 10 + 1 AS grid_id, c_custkey % 85 + 1 AS "row", c_custkey % 12 AS run FROM customer),
qq AS (SELECT *, lead(code) OVER (PARTITION BY grid_id, pass_no ORDER BY run_no) AS nx FROM passes), la AS (SELECT grid_id, pass_no, max(run_no) AS l, arg_min(code, run_no) AS f, max(cells_before + n) AS e FROM passes GROUP BY 1, 2), wh AS (SELECT grid_id, max(pass_no) AS top, sum(n) AS total FROM passes GROUP BY 1),
jj AS (SELECT cu.*, la.l, la.e, wh.top, wh.total, q.code, q.n, q.nx, q.cells_before, a.f AS ahead, run > la.l AS fin FROM cu JOIN la ON la.grid_id = cu.grid_id AND la.pass_no = cu."row" JOIN wh ON wh.grid_id = cu.grid_id LEFT JOIN qq AS q ON q.grid_id = cu.grid_id AND q.pass_no = cu."row" AND q.run_no = cu.run LEFT JOIN la a ON a.grid_id = cu.grid_id AND a.pass_no = cu."row" + 1 WHERE run <= la.l + 1)
SELECT project, jj."row", run, code, n, CASE WHEN fin THEN ahead ELSE nx END AS "next", (CASE WHEN fin THEN e ELSE cells_before END)::BIGINT AS cells_done, round_even(100.0::DOUBLE * (CASE WHEN fin THEN e ELSE cells_before END) / total, 1) AS percent, fin AND "row" <> top AS at_boundary, run >= l AS last_in_row, fin AND "row" = top AS finished,
(run - s."start") // s.period + 1 AS repetition, s.repetitions FROM jj LEFT JOIN seg s ON s.kind = 'repeat' AND s.grid_id = jj.grid_id AND s.pass_no = jj."row" AND run >= s."start" AND run < s."end" """,
    "project_reports": """WITH m AS (SELECT project, unnest(range(project % 4 + 1)) AS piece FROM (SELECT DISTINCT user_id AS project FROM events) u), t AS (SELECT project, sum(CASE WHEN (project + piece) % 3 = 0 THEN piece + 2 ELSE 1 END)::BIGINT AS pieces_total FROM m GROUP BY 1),
d AS (SELECT user_id AS project, event_id % 5 AS piece, bool_or(event_id % 17 = 0) AS fin FROM events GROUP BY 1, 2), s AS (SELECT user_id AS project, event_id % 6 AS step, bool_or(event_id % 3 > 0 AND event_id % 8 = 0) AS done FROM events WHERE event_id % 4 = 0 GROUP BY 1, 2)
SELECT project, coalesce((SELECT count(*) FROM d JOIN m USING (project, piece) WHERE d.project = t.project AND fin), 0) AS pieces_done, pieces_total, coalesce((SELECT count(*) FROM s WHERE s.project = t.project AND done), 0) AS assembly_done, coalesce((SELECT count(*) FROM s WHERE s.project = t.project), 0) AS assembly_total FROM t""",
    "piece_percents": "WITH p AS (SELECT c_custkey AS project, c_custkey % 3 AS piece, c_custkey % 37 AS done, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 40 * CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 1 END END AS total FROM customer) SELECT *, CASE WHEN total > 0 THEN round_even(100.0::DOUBLE * done / total, 1) WHEN total = 0 THEN 0.0 END::DOUBLE AS percent FROM p",
    "size_rules": """WITH s AS (SELECT p_partkey AS doc, CASE WHEN p_partkey % 9 > 0 THEN p_partkey % 5 END AS width, p_partkey % 4 AS height, CASE WHEN p_partkey % 6 = 0 THEN 0 WHEN p_partkey % 7 = 0 THEN 300 ELSE p_size END AS n FROM part)
SELECT doc, 'palette_size' AS rule, n::VARCHAR AS "at", 'colours are not 1 to 255' AS message FROM s WHERE n < 1 OR n > 255 UNION ALL SELECT doc, 'width', coalesce(width::VARCHAR, ''), 'is not 1 or more' FROM s WHERE width IS NULL OR width < 1 UNION ALL SELECT doc, 'height', height::VARCHAR, 'is not 1 or more' FROM s WHERE height < 1""",
    "manifest_rules": """WITH p AS (SELECT p_partkey // 4 AS doc, p_partkey AS k FROM part), c AS (SELECT doc, 'c' || k % 4 AS chart, k % 4 = 0 OR k % 35 = 1 AS d FROM p WHERE k % 8 < 6),
q AS (SELECT doc, 'p' || CASE WHEN k % 40 = 9 THEN k % 4 - 1 ELSE k % 4 END AS piece, CASE WHEN k % 11 = 0 THEN 'c9' WHEN k % 5 > 0 THEN 'c' || CASE WHEN k % 13 = 0 THEN 1 ELSE k % 4 END END AS chart, CASE WHEN k % 5 = 0 OR k % 23 = 0 THEN 'r' END AS r, k % 4 AS place FROM p),
f AS (SELECT doc, arg_min(chart, place) AS chart FROM q WHERE chart IS NOT NULL GROUP BY 1)
SELECT doc, 'default_first' AS rule, chart AS "at", 'is the first chart piece, but not the default' AS message FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc = f.doc AND c.chart = f.chart AND d)
UNION ALL SELECT doc, 'default', '', 'there must be one default chart' FROM c GROUP BY 1 HAVING count(*) FILTER (d) <> 1
UNION ALL SELECT doc, 'chart_or_rows', piece, 'a piece has either a chart or rows' FROM q WHERE (chart IS NULL) = (r IS NULL) UNION ALL SELECT doc, 'duplicate', piece, 'is a duplicate' FROM q GROUP BY doc, piece HAVING count(*) > 1
UNION ALL SELECT doc, 'unused', chart, 'no piece names this chart' FROM c WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.doc = c.doc AND q.chart = c.chart) UNION ALL SELECT doc, 'unknown', piece, 'names a chart that isn''t there' FROM q WHERE chart IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc = q.doc AND c.chart = q.chart)
UNION ALL SELECT doc, 'shared', chart, 'is named by several pieces' FROM q WHERE chart IS NOT NULL GROUP BY doc, chart HAVING count(*) > 1""",
    "bundle_paths": """WITH f AS (SELECT DISTINCT p_partkey // 30 AS bundle, CASE WHEN p_partkey % 10 = 0 THEN 'a/b.json' WHEN p_partkey % 10 = 1 THEN 'A/' || CASE WHEN p_partkey % 20 = 1 THEN 'B' ELSE 'c' END || '.json' WHEN p_partkey % 10 = 2 THEN '/etc/x' WHEN p_partkey % 10 = 3 THEN 'a/../x' WHEN p_partkey % 30 = 4 THEN 'a' WHEN p_partkey % 30 = 5 THEN 'd/e' WHEN p_partkey % 30 = 6 THEN 'd/e/f' ELSE 'z' || p_partkey % 10 END AS path FROM part)
SELECT bundle, path, 'unusable' AS kind FROM f WHERE path IN ('/etc/x', 'a/../x') UNION ALL SELECT bundle, min(path), 'duplicate' FROM f GROUP BY bundle, lower(path) HAVING count(*) > 1
UNION ALL SELECT DISTINCT f.bundle, f.path, 'nested' FROM f JOIN f g ON g.bundle = f.bundle AND f.path <> g.path AND starts_with(f.path, g.path || '/')""",
    "refused_techniques": "WITH g AS (SELECT DISTINCT l_suppkey AS grid_id FROM lineitem) SELECT grid_id, ['rows', 'rounds', 'c2c', 'spiral', NULL][grid_id % 5 + 1] AS type FROM g WHERE grid_id % 5 > 1 AND grid_id % 4 > 0",
    "no_stitch_sequence": f"WITH {CELLS_LINEITEM}, r0 AS (SELECT * FROM (WITH {RUNS} SELECT * FROM runs) q WHERE code <> 'AF'), {PASSES.replace('FROM runs)', 'FROM r0)')} SELECT * FROM passes",
    "shaped_grids": """WITH g AS (SELECT p_partkey AS grid_id, y, x, CASE WHEN x >= y % 3 AND x < 8 - (p_size + y) % 3 THEN chr((65 + (x + y) % 3)::INTEGER) ELSE 'N' END AS code FROM part, range(5) a(y), range(8) b(x)),
k AS (SELECT *, CASE WHEN (5 - y) % 2 = 1 THEN -x ELSE x END AS rd FROM g), o AS (SELECT *, row_number() OVER (PARTITION BY grid_id, y ORDER BY rd) - 1 AS i FROM k WHERE code <> 'N' OR grid_id % 3 = 0),
w AS (SELECT grid_id, y, i, CASE WHEN code = 'A' THEN 'Z' ELSE code END AS code, CASE WHEN grid_id % 7 = 2 AND y = 2 AND i = 0 THEN 3 ELSE 1 END AS n FROM o), e AS (SELECT grid_id, y, code, i, unnest(range(n)) AS j FROM w),
t AS (SELECT grid_id, y, code, row_number() OVER (PARTITION BY grid_id, y ORDER BY i, j) AS k FROM e), z AS (SELECT grid_id, y, count(*) AS n FROM t GROUP BY 1, 2), s AS (SELECT grid_id, y, count(*) FILTER (code <> 'N') AS off FROM g GROUP BY 1, 2),
f AS (SELECT z.*, n = 8 AS al, n = 8 OR n = off AS ok FROM z JOIN s USING (grid_id, y)), c AS (SELECT k.grid_id, k.y, k.x, row_number() OVER (PARTITION BY k.grid_id, k.y ORDER BY rd) AS k FROM k JOIN f USING (grid_id, y) WHERE ok AND (al OR code <> 'N'))
SELECT grid_id, y, x, t.code FROM c JOIN t USING (grid_id, y, k) UNION ALL SELECT grid_id, y, -1, 'lost' FROM f WHERE NOT ok""",
    "reading_scores": """WITH t AS (SELECT l_suppkey AS doc, l_orderkey AS "row", list(l_returnflag ORDER BY l_linenumber, l_partkey, l_returnflag) AS c, list(l_linenumber ORDER BY l_linenumber, l_partkey, l_returnflag) AS n FROM lineitem GROUP BY 1, 2),
g AS (SELECT *, CASE WHEN "row" % 3 = 0 THEN list_transform(c, lambda x: translate(x, 'ANR', 'NRA')) WHEN "row" % 7 = 0 THEN list_transform(c, lambda x: 'A') ELSE c END AS gc FROM t),
s AS (SELECT *, list_transform(c, lambda x: list_position(c, x)) AS a, list_transform(gc, lambda x: list_position(gc, x)) AS b FROM g)
SELECT doc, count(*) AS n_truth, count(*) FILTER ("row" % 5 > 0 OR "row" % 4 = 0) AS n_read, count(*) FILTER (("row" % 5 > 0 AND gc = c) OR ("row" % 5 = 0 AND "row" % 4 = 0)) AS n_exact, count(*) FILTER (("row" % 5 > 0 AND a = b) OR ("row" % 5 = 0 AND "row" % 4 = 0)) AS n_relabelled FROM s GROUP BY 1""",
    "colour_names": f"""WITH nm(i, name, r, g, b) AS (VALUES {_NAMES}), pt AS (SELECT p_partkey, p_partkey * 37 % 256 AS r, p_partkey * 91 % 256 AS g, p_partkey * 53 % 256 AS b FROM part), {lab_sql("nm", "nl")}, {lab_sql("pt", "pl")},
d AS (SELECT p_partkey, name, i, sqrt((pl.lab_l - nl.lab_l) ** 2 + (pl.lab_a - nl.lab_a) ** 2 + (pl.lab_b - nl.lab_b) ** 2) AS d FROM pl, nl)
SELECT p_partkey, array_to_string(list_transform(string_split(arg_min(name, (d, i)), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM d GROUP BY 1""",
    "number_texts": "SELECT o_orderkey, format('{:,}', round(o_totalprice * o_orderkey, 0)::BIGINT) AS cells FROM orders",
    "iso_times": """WITH t AS (SELECT event_id, date_trunc('second', ts) AS t FROM events) SELECT event_id, CASE WHEN event_id % 9 > 0 THEN strftime(t + CASE event_id % 4 WHEN 1 THEN INTERVAL '-2 hours' WHEN 2 THEN INTERVAL '330 minutes' ELSE INTERVAL 0 SECOND END, '%Y-%m-%dT%H:%M:%SZ') END AS iso FROM t""",
    "row_widths": """WITH t AS (SELECT l_suppkey, l_orderkey, CASE WHEN l_orderkey % 3 > 0 THEN sum(l_linenumber)::INTEGER END AS total FROM lineitem GROUP BY 1, 2) SELECT *, last_value(total IGNORE NULLS) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS width FROM t""",
    "key_lines": f"SELECT o_orderkey, {_KEY_LINE.format('''WHEN 0 THEN 'BL' WHEN 1 THEN 'A' WHEN 5 THEN 'CH' ''')} AS code, {_KEY_LINE.format('''WHEN 0 THEN 'Black' WHEN 1 THEN 'Pale Rose' WHEN 5 THEN 'Charcoal' ''')} AS name FROM orders",
    "plain_bodies": "WITH k AS (SELECT o_orderkey, o_orderkey % 9 + 1 AS a, o_orderkey % 5 + 1 AS b FROM orders) SELECT o_orderkey, (2 * a + b) || ' sc, ' || a || ' white, ' || b || ' c, ' || a || ' Red' AS body FROM k",
    "derived_sizes": """WITH k AS (SELECT p_partkey, ['stitch', 'tile', 'block', 'motif', 'odd', NULL][p_partkey % 6 + 1] AS k, ['stitches', 'tiles', '', NULL, 'blocks'][p_partkey % 5 + 1] AS u FROM part), n AS (SELECT p_partkey, CASE WHEN k IN ('tile', 'block', 'motif') THEN k ELSE 'stitch' END AS kind, coalesce(nullif(u, ''), 'stitches') AS u FROM k)
SELECT p_partkey, kind, (kind = 'stitch' AND u = 'stitches') OR (kind = 'tile' AND u = 'tiles') AS derives FROM n""",
    "png_round_trip": f"WITH {_PIECE} SELECT * FROM pc",
    "png_refusals": f"WITH {_PIECE} SELECT grid_id, min((y, x))[1] AS y, min((y, x))[2] AS x, '#00ff00' AS hex, count(*) AS n FROM pc WHERE code = 'B' GROUP BY 1",
    "bundle_ids": """WITH p AS (SELECT p_partkey // 5 AS bundle, p_partkey AS k, 'charts/' || p_partkey % 5 || '.json' AS name FROM part), f AS (SELECT * FROM p WHERE k % 7 > 0), l AS (SELECT *, CASE WHEN k % 13 = 0 THEN k + 1 ELSE k END AS want FROM p WHERE k % 11 > 0 AND bundle % 17 > 0), m AS (SELECT DISTINCT bundle FROM l)
SELECT DISTINCT bundle, 'manifest.json' AS name, 'no_manifest' AS kind FROM f WHERE bundle NOT IN (SELECT bundle FROM m) UNION ALL SELECT bundle, name, 'lost' FROM l WHERE k % 7 = 0 UNION ALL SELECT bundle, name, 'unlisted' FROM f WHERE k % 11 = 0 AND bundle IN (SELECT bundle FROM m)
UNION ALL SELECT bundle, name, 'id' FROM l WHERE k % 7 > 0 AND want <> k""",
    "feed_index": f"WITH {_DOC} SELECT slug, min(title) AS title, count(*) AS n_charts, min(id) AS first_id FROM dc WHERE slug LIKE 'piece-%' GROUP BY 1",
    "feed_refusals": f"WITH {_DOC} SELECT slug, count(*) AS n FROM dc WHERE slug NOT LIKE 'piece-%' GROUP BY 1",
    "tiles_that_overlap": """WITH g AS (SELECT p_partkey AS grid_id, p_partkey % 3 AS lost, len(list_filter(range(4), lambda y: (p_partkey + y) % 5 = 0)) AS two FROM part)
SELECT grid_id, 'size' AS kind, 1 AS n FROM g WHERE grid_id % 4 = 1 AND lost > 0 UNION ALL SELECT grid_id, 'uncovered', lost FROM g WHERE grid_id % 4 = 1 AND lost > 0 UNION ALL SELECT grid_id, 'overlap', two FROM g WHERE two > 0""",
    "mixed_slugs": """WITH RECURSIVE b AS (SELECT p_partkey // 9 AS key, p_partkey, 'grey' || CASE WHEN p_partkey % 5 = 0 THEN '-2' WHEN p_partkey % 7 = 0 THEN '-3' WHEN p_partkey % 11 = 0 THEN '-2-2' ELSE '' END AS base, row_number() OVER (PARTITION BY p_partkey // 9 ORDER BY p_partkey) AS i FROM part),
r AS (SELECT DISTINCT key, 0::BIGINT AS i, NULL::BIGINT AS p_partkey, []::VARCHAR[] AS taken FROM b UNION ALL
SELECT r.key, b.i, b.p_partkey, list_append(taken, CASE WHEN NOT list_contains(taken, base) THEN base ELSE base || '-' || list_filter(range(2, 20), lambda j: NOT list_contains(taken, base || '-' || j))[1] END) FROM r JOIN b ON b.key = r.key AND b.i = r.i + 1)
SELECT key, p_partkey, taken[-1] AS slug FROM r WHERE i > 0""",
    "shaping_sentences": f"""WITH q AS ({_GRIDS["shaping_deltas"]}), t AS (SELECT grid_id, pass_no, CASE WHEN start_delta <> 0 THEN CASE WHEN start_delta > 0 THEN 'add ' ELSE 'leave ' END || abs(start_delta) || CASE WHEN abs(start_delta) = 1 THEN ' stitch' ELSE ' stitches' END || ' at the start' END AS a,
CASE WHEN end_delta <> 0 THEN CASE WHEN end_delta > 0 THEN 'add ' ELSE 'leave ' END || abs(end_delta) || CASE WHEN abs(end_delta) = 1 THEN ' stitch' ELSE ' stitches' END || ' at the end' END AS b FROM q) SELECT grid_id, pass_no, nullif(concat_ws(', ', a, b), '') AS said FROM t""",
    "look_ahead_sentences": f"""WITH q AS ({_GRIDS["stretch_changes"]}), t AS (SELECT *, concat_ws(', ', joins || ' joins', leaves || ' leaves', CASE WHEN simpler THEN 'plain rows' END) AS p FROM q) SELECT grid_id, stretch, CASE WHEN next_start IS NOT NULL AND p <> '' THEN 'From row ' || next_start || ': ' || p END AS said FROM t""",
    "claimed_entries": f"""WITH {CENTRES}, cl AS (SELECT vec_id % 20 AS by_, label, count(*) AS n, list(vec_id ORDER BY vec_id) FILTER (distance > 0.45) AS far FROM nn GROUP BY 1, 2)
SELECT by_ AS "by", count(*) FILTER (n > 1) = 0 AS ok, coalesce(string_agg(label::VARCHAR, ',' ORDER BY label) FILTER (n > 1), '') AS shared, array_to_string(list_sort(flatten(list(coalesce(far, [])))), ',') AS far FROM cl GROUP BY 1""",
    "greedy_clusters": f"""WITH RECURSIVE src AS (SELECT p_size::BIGINT AS size, p_partkey % 97 AS key, count(*) AS n, p_partkey % 97 * 37 % 256 AS r, p_partkey % 97 * 91 % 256 AS g, p_partkey % 97 * 53 % 256 AS b FROM part GROUP BY ALL), {greedy_sql(12.0)}
SELECT j2.size, p.key, rk.cluster, q.key AS lead FROM j2 JOIN pt p ON p.size = j2.size AND p.i = j2.i JOIN pt q ON q.size = j2.size AND q.i = j2.lead JOIN rk ON rk.size = j2.size AND rk.lead = j2.lead""",
}
