"""Rules that report every problem: each gives (doc, rule, at, message); a report is their union, a refusal a non-empty one."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import covered
from .runs import RUN_STRING, rle_encode, rows_to_runs
from .sizes import unsized

#: A palette code and a colour.
CODE, HEX = r"\A[A-Za-z]{1,3}\z", r"\A#[0-9A-Fa-f]{6}\z"
#: Kinds of boundaries, colours of chains, kinds of cells, corners of row 1, units of lengths; stats that count stitches.
BOUNDARY_KINDS = ("turn", "join", "rejoin", "spiral", "return")
CHAIN_COLORS = ("next", "current")
CELL_KINDS = ("stitch", "block", "tile", "motif", "pair")
ROW1 = ("bottom-right", "bottom-left", "top-right", "top-left")
UNITS = ("in", "cm")
STITCH_STATS = ("stitches", "yards_est", "skeins_364yd")
#: The most rows, colours and characters of a field that a transcription may have.
MOST_ROWS, MOST_COLOURS, MOST_TEXT = 5000, 64, 20_000


def problem(df: DataFrame, rule: str, doc: str, at, message) -> DataFrame:
    return df.select(F.col(doc).alias("doc"), F.lit(rule).alias("rule"), at.cast("string").alias("at"), message.alias("message"))


def report(*parts: DataFrame) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def palette_problems(palette: DataFrame, doc: str = "doc") -> DataFrame:
    """palette: doc, code, hex, stitch (false: no stitch)."""
    twice = palette.groupBy(doc, "code").count().filter("count > 1")
    marked = palette.filter("stitch = false").groupBy(doc).count().filter("count > 1")
    return report(
        problem(palette.filter(~F.coalesce(F.col("code").rlike(CODE), F.lit(False))), "code", doc, F.col("code"), F.lit("is not 1-3 letters")),
        problem(palette.filter(~F.coalesce(F.col("hex").rlike(HEX), F.lit(False))), "hex", doc, F.col("code"), F.lit("is not #RRGGBB")),
        problem(twice, "duplicate", doc, F.col("code"), F.lit("is a duplicate")),
        problem(marked, "no_stitch", doc, F.lit(""), F.lit("more than one colour is no stitch")),
    )


def size_problems(palette: DataFrame, size: DataFrame, doc: str = "doc", most: int = 255) -> DataFrame:
    """palette: doc, code; size: doc, width, height. At least one colour and `most` at most; a width and a height of 1 or more."""
    n = palette.groupBy(doc).agg(F.count("*").alias("n"))
    d = size.join(n, doc, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _listed(d, doc, [
        ("palette_size", (F.col("n") < 1) | (F.col("n") > most), F.col("n"), F.lit(f"colours are not 1 to {most}")),
        ("width", ~F.coalesce(F.col("width") >= 1, F.lit(False)), F.coalesce(F.col("width").cast("string"), F.lit("")), F.lit("is not 1 or more")),
        ("height", ~F.coalesce(F.col("height") >= 1, F.lit(False)), F.coalesce(F.col("height").cast("string"), F.lit("")), F.lit("is not 1 or more")),
    ])


def row_problems(rows: DataFrame, palette: DataFrame, size: DataFrame, doc: str = "doc", no_stitch: DataFrame | None = None) -> DataFrame:
    """rows: doc, y, runs (run strings); palette: doc, code; size: doc, width, height; no_stitch: doc, code."""
    well = F.coalesce(F.col("runs").rlike(RUN_STRING), F.lit(False))
    runs = rows_to_runs(rows.filter(well).withColumnRenamed(doc, "grid_id")).withColumnRenamed("grid_id", doc)
    width = runs.groupBy(doc, "y").agg(F.sum("n").alias("n")).join(size, doc).filter("n <> width")
    height = size.join(rows.groupBy(doc).agg(F.count("*").alias("n")), doc, "left").filter("height <> coalesce(n, 0)")
    unknown = runs.join(palette.select(doc, "code"), [doc, "code"], "left_anti").select(doc, "y", "code").distinct()
    parts = [
        problem(rows.filter(~well), "run_string", doc, F.col("y"), F.lit("is not a run string")),
        problem(width, "width", doc, F.col("y"), F.concat(F.lit("sums to "), "n", F.lit(", not "), "width")),
        problem(height, "height", doc, F.lit(""), F.lit("the height does not match the rows")),
        problem(unknown, "unknown_code", doc, F.col("y"), F.concat(F.lit("unknown code "), "code")),
    ]
    if no_stitch is not None:
        own = runs.join(no_stitch.select(doc, F.col("code").alias("_ns")), doc).groupBy(doc, "y").agg(F.sum(F.when(F.col("code") != F.col("_ns"), F.col("n"))).alias("n"), F.min(F.when(F.col("code") != F.col("_ns"), F.col("x0"))).alias("lo"), F.max(F.when(F.col("code") != F.col("_ns"), F.col("x0") + F.col("n"))).alias("hi"))
        parts += [problem(own.filter("n IS NULL"), "no_stitches", doc, F.col("y"), F.lit("has no stitches")), problem(own.filter("hi - lo <> n"), "gap", doc, F.col("y"), F.lit("has more than one stitched span"))]
    return report(*parts)


def pass_problems(given: DataFrame, cells: DataFrame, doc: str = "doc", parts: int | None = None) -> DataFrame:
    """given: doc, pass_no, grid_row, code, n, x0 of explicit passes; cells: doc, y, x, code. Runs that the cells don't bear out.

    Runs are compared with the rows' own runs by running sums (over `parts` tasks, if given), so what is moved grows with runs,
    not with cells.
    """
    own = rle_encode(cells, (doc, "y"))
    asked = given.filter("n > 0").select(doc, "pass_no", F.col("grid_row").alias("y"), "code", "n", "x0", F.monotonically_increasing_id().alias("_run"))
    lost = covered(asked, own, [doc, "y"], parts).groupBy(doc, "pass_no").agg(F.sum(F.col("n") - F.col("matched")).alias("n")).filter("n > 0")
    return report(problem(lost, "pass_cells", doc, F.col("pass_no"), F.concat("n", F.lit(" cell(s) do not match"))), problem(given.filter("n IS NULL OR n < 1"), "pass_count", doc, F.col("pass_no"), F.lit("the count is not positive")))


def tiling_problems(entries: DataFrame, key: list[str]) -> DataFrame:
    """entries (from_, to_; null: open) of a key that don't tile: key, from_, kind (gap, overlap, open)."""
    w = Window.partitionBy(*key).orderBy("from_", "to_")
    d = entries.withColumn("_prev", F.lag("to_").over(w)).withColumn("_has", F.lag("from_").over(w).isNotNull())
    kind = F.when(F.col("_has") & F.col("_prev").isNull(), "open").when(F.col("from_") > F.col("_prev") + 1, "gap").when(F.col("from_") <= F.col("_prev"), "overlap")
    return d.withColumn("kind", kind).filter("kind IS NOT NULL").select(*key, "from_", "kind")


def total_problems(rows: DataFrame, parts: DataFrame, key: list[str], printed: str, part: str) -> DataFrame:
    """key, printed, summed of rows whose printed total is not the sum of their parts (none counts as 0)."""
    summed = parts.groupBy(*key).agg(F.sum(part).alias("summed"))
    return rows.join(summed, key, "left").withColumn("summed", F.coalesce("summed", F.lit(0))).filter(F.col(printed) != F.col("summed")).select(*key, F.col(printed).alias("printed"), "summed")


def manifest_problems(charts: DataFrame, pieces: DataFrame) -> DataFrame:
    """charts: doc, chart, is_default; pieces: doc, piece, chart, rows_id, and place (their order) if it is to be checked.

    One default; chart or rows; every chart in one piece; the first chart piece has the default.
    """
    defaults = charts.groupBy("doc").agg(F.count_if("is_default").alias("n")).filter("n <> 1")
    both = pieces.filter(F.col("chart").isNull() == F.col("rows_id").isNull())
    twice = pieces.groupBy("doc", "piece").count().filter("count > 1")
    lost = charts.join(pieces.filter("chart IS NOT NULL"), ["doc", "chart"], "left_anti")
    unknown = pieces.filter("chart IS NOT NULL").join(charts, ["doc", "chart"], "left_anti")
    often = pieces.filter("chart IS NOT NULL").groupBy("doc", "chart").count().filter("count > 1")
    parts = []
    if "place" in pieces.columns:
        first = pieces.filter("chart IS NOT NULL").groupBy("doc").agg(F.min_by("chart", "place").alias("chart"))
        late = first.join(charts.filter("is_default").select("doc", "chart"), ["doc", "chart"], "left_anti")
        parts = [problem(late, "default_first", "doc", F.col("chart"), F.lit("is the first chart piece, but not the default"))]
    return report(
        *parts,
        problem(defaults, "default", "doc", F.lit(""), F.lit("there must be one default chart")),
        problem(both, "chart_or_rows", "doc", F.col("piece"), F.lit("a piece has either a chart or rows")),
        problem(twice, "duplicate", "doc", F.col("piece"), F.lit("is a duplicate")),
        problem(lost, "unused", "doc", F.col("chart"), F.lit("no piece names this chart")),
        problem(unknown, "unknown", "doc", F.col("piece"), F.lit("names a chart that isn't there")),
        problem(often, "shared", "doc", F.col("chart"), F.lit("is named by several pieces")),
    )


def closure(used: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys that are used and not known."""
    return used.select(*on).distinct().join(known.select(*on), on, "left_anti")


def _listed(df: DataFrame, doc: str, rules: list[tuple]) -> DataFrame:
    """Problems of rules that look at one row alone: (rule, where it is broken, at, message); one pass, nothing is shuffled."""
    told = [F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(rule).alias("rule"), at.cast("string").alias("at"), message.alias("message"))) for rule, broken, at, message in rules]
    return df.select(F.col(doc).alias("doc"), F.explode(F.array_compact(F.array(*told))).alias("p")).select("doc", "p.*")


def cell_kind(kind: Column) -> Column:
    """What a grid's cell is: a known kind, else a stitch."""
    return F.when(kind.isin(*CELL_KINDS), kind).otherwise("stitch")


def size_derives(kind: Column, unit: Column) -> Column:
    """Whether a finished size follows from the gauge: cells and gauge must count the same thing."""
    of = F.when(cell_kind(kind) == "stitch", "stitches").when(cell_kind(kind) == "tile", "tiles")
    return F.coalesce(of == F.coalesce(F.nullif(unit, F.lit("")), F.lit("stitches")), F.lit(False))


def document_problems(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Rules of a document as a whole; absent parts are null.

    docs: doc, schema, no_stitch (code), boundary and foundation (structs kind, chain, color; chain, first_stitch_in),
    first_row (stitches that pass 1 works), cell, stats (names), n_written, n_passes, id, content_id.
    """
    b, f, nothing = F.col("boundary"), F.col("foundation"), F.lit("")
    needed = F.col("first_row") + F.coalesce(f["first_stitch_in"], F.lit(1)) - 1
    kind, withheld = cell_kind(F.col("cell")), F.array_intersect("stats", F.array(*[F.lit(x) for x in STITCH_STATS]))
    return _listed(docs, doc, [
        ("no_stitch_schema", F.col("no_stitch").isNotNull() & ~F.col("schema").eqNullSafe(3), F.col("no_stitch"), F.lit("a no-stitch colour needs schema 3")),
        ("boundary_kind", b.isNotNull() & ~F.coalesce(b["kind"].isin(*BOUNDARY_KINDS), F.lit(False)), F.coalesce(b["kind"], nothing), F.lit("is not a kind of boundary")),
        ("boundary_chain", b.isNotNull() & ~F.coalesce(b["chain"] >= 0, F.lit(False)), F.coalesce(b["chain"].cast("string"), nothing), F.lit("is not 0 or more")),
        ("boundary_color", b["color"].isNotNull() & ~b["color"].isin(*CHAIN_COLORS), b["color"], F.lit("is not next or current")),
        ("foundation", f["chain"] < needed, f["chain"], F.concat(F.lit("is shorter than the "), needed.cast("string"), F.lit(" chains that row 1 needs"))),
        ("cell_kind", F.col("cell").isNotNull() & ~F.col("cell").isin(*CELL_KINDS), F.col("cell"), F.lit("is not a kind of cell")),
        ("withheld", (kind != "stitch") & (F.size(withheld) > 0), F.array_join(withheld, ","), F.lit("counts stitches, but cells are none")),
        ("written", F.col("n_written") != F.col("n_passes"), F.col("n_written"), F.concat(F.lit("is not one text for each of "), F.col("n_passes").cast("string"), F.lit(" passes"))),
        ("id", ~F.col("id").eqNullSafe(F.col("content_id")), F.coalesce("id", nothing), F.lit("does not match the content")),
    ])


def layer_problems(rows: DataFrame, legend: DataFrame, size: DataFrame, doc: str = "doc") -> DataFrame:
    """rows: doc, layer, y, runs; legend: doc, layer, code; size: doc, width, height. At: layer or layer/y."""
    at = F.concat_ws("/", "layer", F.col("y").cast("string"))
    well = F.coalesce(F.col("runs").rlike(RUN_STRING), F.lit(False))
    height = rows.groupBy(doc, "layer").agg(F.count("*").alias("n")).join(size, doc).filter("n <> height")
    runs = rows_to_runs(rows.filter(well), row=(doc, "layer", "y"))
    width = runs.groupBy(doc, "layer", "y").agg(F.sum("n").alias("n")).join(size, doc).filter("n <> width")
    unknown = runs.join(legend.select(doc, "layer", "code"), [doc, "layer", "code"], "left_anti").select(doc, "layer", "y", "code").distinct()
    return report(
        problem(height, "layer_height", doc, F.col("layer"), F.concat("n", F.lit(" rows, the chart has "), "height")),
        problem(rows.filter(~well), "layer_run_string", doc, at, F.lit("is not a run string")),
        problem(width, "layer_width", doc, at, F.lit("does not sum to the width")),
        problem(unknown, "layer_code", doc, at, F.concat(F.lit("code "), "code", F.lit(" is not in the legend"))),
    )


def explicit_pass_problems(given: DataFrame, palette: DataFrame, extent: DataFrame, doc: str = "doc") -> DataFrame:
    """given: doc, pass_no, run_no, grid_row, code, n, x0; palette: doc, code, stitch; extent: doc, y, width of each row as parsed.

    A run breaks the first rule that applies: unknown code, no-stitch colour, count, outside the grid.
    """
    at = F.concat_ws("/", F.col("pass_no").cast("string"), F.col("run_no").cast("string"))
    known = palette.groupBy(doc, "code").agg(F.bool_or(F.coalesce(F.col("stitch"), F.lit(True))).alias("_stitch"))
    d = given.join(known, [doc, "code"], "left").join(extent.select(doc, F.col("y").alias("grid_row"), F.col("width").alias("_width")), [doc, "grid_row"], "left")
    placed = F.col("grid_row").isNotNull() & F.col("x0").isNotNull()
    outside = placed & (F.col("_width").isNull() | (F.col("x0") < 0) | (F.col("x0") + F.col("n") > F.col("_width")))
    rule = F.when(F.col("_stitch").isNull(), "pass_code").when(~F.col("_stitch"), "pass_no_stitch").when(~F.coalesce(F.col("n") >= 1, F.lit(False)), "pass_count").when(outside, "pass_outside")
    return d.withColumn("rule", rule).filter("rule IS NOT NULL").select(F.col(doc).alias("doc"), "rule", at.alias("at"), F.coalesce("code", F.lit("")).alias("message"))


def prose_problems(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Rules of a transcription: docs: doc, palette (array of code, hex), row1, width, height, rows (array of row, runs (array of code, count), text), finished (width, height, unit).

    Every rule is an expression over a document's own arrays, so a table of documents is checked in one pass.
    """
    codes = F.transform("palette", lambda p: p["code"])
    bad_code = F.filter(codes, lambda c: ~F.coalesce(c.rlike(CODE), F.lit(False)))
    twice = F.filter(F.array_distinct(codes), lambda c: F.size(F.filter(codes, lambda x: x == c)) > 1)
    bad_hex = F.filter("palette", lambda p: p["hex"].isNotNull() & ~p["hex"].rlike(HEX))
    bad_row = F.filter("rows", lambda r: ~F.coalesce(r["row"] >= 1, F.lit(False)))
    empty = F.filter("rows", lambda r: F.coalesce(F.size(r["runs"]), F.lit(0)) < 1)
    bad_run = F.filter("rows", lambda r: F.exists(F.coalesce(r["runs"], F.array().cast("array<struct<code:string,count:bigint>>")), lambda x: ~F.coalesce(x["code"].rlike(CODE) & (x["count"] >= 1), F.lit(False))))
    long = F.filter("rows", lambda r: F.length(r["text"]) > MOST_TEXT)
    rows_of = lambda a: F.array_join(F.transform(a, lambda r: F.coalesce(r["row"].cast("string"), F.lit("?"))), ",")
    done = F.col("finished")
    return _listed(docs, doc, [
        ("code", F.size(bad_code) > 0, F.array_join(bad_code, ",", "?"), F.lit("is not 1-3 letters")),
        ("duplicate", F.size(twice) > 0, F.array_join(F.array_sort(twice), ","), F.lit("is a duplicate")),
        ("hex", F.size(bad_hex) > 0, F.array_join(F.transform(bad_hex, lambda p: p["hex"]), ","), F.lit("is not #RRGGBB")),
        ("row1", F.col("row1").isNotNull() & ~F.col("row1").isin(*ROW1), F.col("row1"), F.lit("is not a corner")),
        ("width", F.col("width") < 1, F.col("width"), F.lit("is not positive")), ("height", F.col("height") < 1, F.col("height"), F.lit("is not positive")),
        ("most_rows", F.size("rows") > MOST_ROWS, F.size("rows"), F.lit("rows are too many")), ("most_colours", F.size("palette") > MOST_COLOURS, F.size("palette"), F.lit("colours are too many")),
        ("row", F.size(bad_row) > 0, rows_of(bad_row), F.lit("is not a positive number")), ("runs", F.size(empty) > 0, rows_of(empty), F.lit("has no runs")),
        ("run", F.size(bad_run) > 0, rows_of(bad_run), F.lit("has a run that is not a code and a count")), ("text", F.size(long) > 0, rows_of(long), F.lit("is too long")),
        ("finished", done.isNotNull() & ~F.coalesce(done["unit"].isin(*UNITS) & (done["width"] > 0) & (done["height"] > 0), F.lit(False)), F.coalesce(done["unit"], F.lit("")), F.lit("is not width, height and unit")),
    ])


def published_problems(entries: DataFrame, variants: DataFrame, gauges: DataFrame, doc: str = "doc") -> DataFrame:
    """entries: doc, variant, gauge; variants: doc, variant; gauges: gauge. Unknown variants and gauges, and entries listed twice."""
    at = F.concat_ws("/", "variant", "gauge")
    return report(
        problem(entries.join(variants, [doc, "variant"], "left_anti"), "variant", doc, at, F.lit("the variant is unknown")),
        problem(entries.join(gauges, "gauge", "left_anti"), "gauge", doc, at, F.lit("the gauge is unknown")),
        problem(entries.groupBy(doc, "variant", "gauge").agg(F.count("*").alias("n")).filter("n > 1"), "twice", doc, at, F.lit("is listed twice")),
    )


def checks(cells: DataFrame, runs: DataFrame, palette: DataFrame, opted: DataFrame) -> DataFrame:
    """grid_id, check, ok, detail of every grid: one report of all checks.

    cells: grid_id, y, x, code; runs: of rle_encode; palette: grid_id, code; opted: grid_id, solid_edge, mirror_lr,
    mirror_tb (numbers of outer lines, 0 or null: not asked), first_row_solid, edge_code. Row totals, codes and closure are
    asked of all grids, edges, first row and mirrors of those that opted in; changes and the shortest run only report.
    """
    size = cells.groupBy("grid_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    rows = runs.groupBy("grid_id", "y").agg(F.sum("n").alias("_n"), F.count("*").alias("_r"), F.min("n").alias("_min"), F.count_if(F.col("n") < 1).alias("_none"))
    whole = rows.join(unsized(size), "grid_id").groupBy("grid_id", "_h", "_w").agg(
        F.bool_and((F.col("_n") == F.col("_w")) & (F.col("_none") == 0)).alias("_totals"), F.count("*").alias("_rows"), F.bround(F.avg(F.col("_r") - 1), 1).alias("_mean"), F.max(F.col("_r") - 1).alias("_max"), F.min("_min").alias("_min")
    )
    codes = palette.groupBy("grid_id").agg(F.bool_and(F.coalesce(F.col("code").rlike(CODE), F.lit(False))).alias("_well"), (F.count("*") == F.count_distinct("code")).alias("_once"), F.array_join(F.array_sort(F.collect_set("code")), ", ").alias("_codes"))
    used = runs.select("grid_id", "code").distinct()
    unknown = used.join(unsized(palette), ["grid_id", "code"], "left_anti").groupBy("grid_id").agg(F.count("*").alias("_unknown"))
    listed = used.groupBy("grid_id").agg(F.array_join(F.array_sort(F.collect_list("code")), ", ").alias("_used"))
    at = cells.join(unsized(size), "grid_id").join(unsized(opted), "grid_id")
    edge = F.coalesce("solid_edge", F.lit(0))
    outer = (F.col("x") < edge) | (F.col("x") >= F.col("_w") - edge) | (F.col("y") < edge) | (F.col("y") >= F.col("_h") - edge)
    other = F.col("code") != F.coalesce("edge_code", F.lit(""))
    edges = at.groupBy("grid_id").agg(F.count_if(outer & other).alias("_edge"), F.count_if((F.col("y") == F.col("_h") - 1) & other).alias("_first"))
    # A cell and its reflection have one key, the smaller of the two places: one aggregate for each direction, no join.
    flipped = lambda line, end: F.least(F.col(line), F.col(end) - 1 - F.col(line))
    broken = None
    for name, line, keep, end in (("mirror_lr", "x", "y", "_w"), ("mirror_tb", "y", "x", "_h")):
        near = at.filter(flipped(line, end) < F.coalesce(name, F.lit(0))).groupBy("grid_id", keep, flipped(line, end).alias("_k")).agg(F.count_distinct("code").alias("_c"))
        one = near.groupBy("grid_id").agg(F.count_if(F.col("_c") > 1).alias(f"_{name}"))
        broken = one if broken is None else broken.join(unsized(one), "grid_id", "full")
    d = whole
    for other_ in (codes, unknown, listed, opted, edges, broken):
        d = d.join(unsized(other_), "grid_id", "left")
    no = lambda c: F.coalesce(c, F.lit(0)) == 0
    line = lambda name, ok, detail, asked=F.lit(True): F.when(asked, F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.alias("detail")))
    text = lambda *parts: F.concat(*[F.lit(p) if i % 2 == 0 else F.col(p).cast("string") for i, p in enumerate(parts)])
    wants = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    return d.select("grid_id", F.explode(F.array_compact(F.array(
        line("row totals", F.col("_totals") & (F.col("_rows") == F.col("_h")), text("", "_h", " rows of ", "_w")),
        line("palette codes", F.col("_well") & F.col("_once"), F.concat(F.lit("codes: "), F.coalesce("_codes", F.lit("")))),
        line("palette closure", no("_unknown"), text("used: ", "_used")),
        line("solid edge", no("_edge"), text("outer ", "solid_edge", " cell(s)"), wants("solid_edge")),
        line("first row solid", no("_first"), F.lit(""), F.coalesce("first_row_solid", F.lit(False))),
        line("mirror left/right", no("_mirror_lr"), text("outer ", "mirror_lr", " columns"), wants("mirror_lr")),
        line("mirror top/bottom", no("_mirror_tb"), text("outer ", "mirror_tb", " rows"), wants("mirror_tb")),
        line("changes per row", F.lit(True), text("mean ", "_mean", ", max ", "_max")),
        line("min run", F.lit(True), text("", "_min", " cell(s)")),
    ))).alias("c")).select("grid_id", "c.*")
