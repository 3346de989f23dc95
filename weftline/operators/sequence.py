"""Working order: passes over a grid's rows, prefix positions, cursors, shaping, written rows and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import spread, unsized

#: Techniques whose order can be derived, flat and in the round.
TECHNIQUES = ("rows", "rounds")


def passes(runs: DataFrame, *, start: str = "bottom", first_side: str = "RS", rs_direction: str = "rtl", rounds: bool = False, no_stitch: str | None = None) -> DataFrame:
    """Runs in working order: grid_id, pass_no, side, direction, grid_row (y), run_no, code, n, x0, cells_before.

    Flat work alternates sides, and the wrong side is read the other way; rounds keep side and direction. Reading from
    right to left reverses a row's runs, while x0 stays the leftmost column. cells_before counts within the grid.
    """
    if no_stitch is not None:
        runs = runs.filter(F.col("code") != no_stitch)
    # Rows are summed where their runs are; a window over a whole grid sees one line a row. All else is inside a row.
    order = Window.partitionBy("grid_id").orderBy(F.desc("y") if start == "bottom" else F.asc("y"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = runs.groupBy("grid_id", "y").agg(F.sum("n").alias("_n"))
    ranks = rows.select("grid_id", "y", F.row_number().over(order).cast("long").alias("pass_no"), before("_n", order).alias("_base"))
    other = {"RS": "WS", "WS": "RS", "rtl": "ltr", "ltr": "rtl"}
    d = runs.join(ranks, ["grid_id", "y"])
    even = F.lit(rounds) | (F.col("pass_no") % 2 == 1)
    ws_direction = other[rs_direction]
    d = d.withColumn("side", F.when(even, first_side).otherwise(other[first_side]))
    d = d.withColumn("direction", F.when(F.col("side") == "RS", rs_direction).otherwise(rs_direction if rounds else ws_direction))
    inside = Window.partitionBy("grid_id", "y").orderBy(F.when(F.col("direction") == "rtl", -F.col("x0")).otherwise(F.col("x0")))
    d = d.withColumns({"run_no": (F.row_number().over(inside) - 1).cast("long"), "cells_before": F.col("_base") + before("n", inside)})
    return d.select("grid_id", "pass_no", "side", "direction", F.col("y").alias("grid_row"), "run_no", "code", "n", "x0", "cells_before")


def explicit_passes(derived: DataFrame, given: DataFrame, technique: DataFrame) -> DataFrame:
    """Passes of documents: those that a document gives win over derived ones; grids of unknown technique have none else.

    derived and given: grid_id, pass_no, side, direction, grid_row, run_no, code, n, x0; technique: grid_id, type.
    """
    columns = ["grid_id", "pass_no", "side", "direction", "grid_row", "run_no", "code", "n", "x0"]
    known = technique.filter(F.col("type").isin(*TECHNIQUES)).select("grid_id")
    own = derived.join(known, "grid_id", "left_semi").join(given.select("grid_id").distinct(), "grid_id", "left_anti")
    return given.select(*columns).unionByName(own.select(*columns))


def refused_techniques(technique: DataFrame, given: DataFrame) -> DataFrame:
    """grid_id, type of grids that cannot be put in order: of a technique that isn't known, without passes of their own."""
    return technique.filter(~F.coalesce(F.col("type").isin(*TECHNIQUES), F.lit(False))).join(given.select("grid_id").distinct(), "grid_id", "left_anti").select("grid_id", "type")


def with_before(runs: DataFrame) -> DataFrame:
    """runs with cells_before: cells of the grid before the run. Passes are summed first, so one window is over passes only."""
    per_pass = runs.groupBy("grid_id", "pass_no").agg(F.sum("n").alias("_n"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    per_pass = per_pass.select("grid_id", "pass_no", F.coalesce(F.sum("_n").over(upto(Window.partitionBy("grid_id").orderBy("pass_no"))), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("n").over(upto(Window.partitionBy("grid_id", "pass_no").orderBy("run_no"))), F.lit(0))
    return runs.withColumn("_in", inside).join(per_pass, ["grid_id", "pass_no"]).withColumn("cells_before", F.col("_base") + F.col("_in")).drop("_base", "_in")


def cursor_cells(cursors: DataFrame, runs: DataFrame, parts: int | None = None) -> DataFrame:
    """cursors (grid_id, row, run, stitch) with valid and cells_done; a cursor at a pass's end counts the whole pass.

    A pass's end is one more run, of one place, so one join (over `parts` tasks, if given) finds runs and ends.
    """
    at = runs.select("grid_id", F.col("pass_no").alias("row"), F.col("run_no").alias("run"), F.col("n").alias("_n"), F.col("cells_before").alias("_before"))
    end = runs.groupBy("grid_id", F.col("pass_no").alias("row")).agg((F.max("run_no") + 1).alias("run"), F.lit(1).alias("_n"), F.max(F.col("cells_before") + F.col("n")).alias("_before"))
    d = cursors.join(spread(at.unionByName(end), parts, "grid_id", "row", "run"), ["grid_id", "row", "run"], "left")
    valid = F.coalesce((F.col("stitch") >= 0) & (F.col("stitch") < F.col("_n")), F.lit(False))
    return d.withColumns({"valid": valid, "cells_done": F.when(valid, F.col("_before") + F.col("stitch")).cast("long")}).drop("_n", "_before")


def shaping(runs: DataFrame) -> DataFrame:
    """Each pass's change of its first and last stitched edge against the pass before, in reading direction; null for the first."""
    spans = runs.groupBy("grid_id", "pass_no", "direction").agg(F.min("x0").alias("lo"), F.max(F.col("x0") + F.col("n")).alias("hi"))
    w = Window.partitionBy("grid_id").orderBy("pass_no")
    left, right = F.lag("lo").over(w) - F.col("lo"), F.col("hi") - F.lag("hi").over(w)
    rtl = F.col("direction") == "rtl"
    return spans.select("grid_id", "pass_no", F.when(rtl, right).otherwise(left).alias("start_delta"), F.when(rtl, left).otherwise(right).alias("end_delta"))


def written_rows(runs: DataFrame, turn: int | None = None) -> DataFrame:
    """The text of each pass: Row n (side): [ch c, turn,] runs (total sts)."""
    part = F.struct("run_no", F.concat_ws(" ", F.col("n").cast("string"), "code").alias("s"))
    d = runs.groupBy("grid_id", "pass_no", "side").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["s"]), ", ").alias("told"), F.sum("n").alias("total"))
    lead = F.when(F.col("pass_no") > 1, f"ch {turn}, turn, ").otherwise("") if turn is not None else F.lit("")
    return d.select("grid_id", "pass_no", F.concat(F.lit("Row "), F.col("pass_no"), F.lit(" ("), "side", F.lit("): "), lead, "told", F.lit(" ("), F.col("total"), F.lit(" sts)")).alias("text"))


def written_to_grid(written: DataFrame, *, first_from_right: bool = True, alternate: bool = True) -> DataFrame:
    """Cells of transcribed runs (grid_id, row, run_no, code, n): row 1 at the bottom, read from its right corner, then alternating."""
    upto = Window.partitionBy("grid_id", "row").orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
    # Widths and heights are of rows, and joined by row: cells are made last and are not moved.
    rows = written.groupBy("grid_id", "row").agg(F.sum("n").alias("_width")).withColumn("_h", F.max("row").over(Window.partitionBy("grid_id")))
    d = written.withColumn("_at", F.coalesce(F.sum("n").over(upto), F.lit(0))).filter("n > 0").join(rows, ["grid_id", "row"])
    cells = d.select("grid_id", "row", "code", "_width", "_h", F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("n") - 1)).alias("i"))
    odd = (F.col("row") % 2 == 1) | F.lit(not alternate)
    from_right = odd if first_from_right else ~odd
    x = F.when(from_right, F.col("_width") - 1 - F.col("i")).otherwise(F.col("i"))
    return cells.select("grid_id", (F.col("_h") - F.col("row")).cast("long").alias("y"), x.cast("long").alias("x"), "code")


def shaped_grid(written: DataFrame, grid: DataFrame, ground: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of written rows laid on a shaped grid's own cells, and the rows that do not fit: (cells, grid_id and row).

    written: grid_id, row, run_no, code, n, row 1 at the bottom, read from its right corner, then alternating; grid:
    grid_id, y, x, code; ground: grid_id, code. A row as long as the grid's is laid on all its cells, another on those
    off the ground, in reading order.
    """
    upto = Window.partitionBy("grid_id", "row").orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
    d = written.filter("n > 0").withColumn("_at", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    told = d.select("grid_id", "row", "code", F.explode(F.sequence(F.col("_at") + 1, F.col("_at") + F.col("n"))).alias("k"))
    length = d.groupBy("grid_id", "row").agg(F.sum("n").alias("_n"))
    height = grid.groupBy("grid_id").agg((F.max("y") + 1).alias("_h"))
    cells = grid.join(unsized(height), "grid_id").join(unsized(ground.select("grid_id", F.col("code").alias("_ground"))), "grid_id", "left").withColumn("row", F.col("_h") - F.col("y"))
    off = ~F.col("code").eqNullSafe(F.col("_ground"))
    sizes = cells.groupBy("grid_id", "row").agg(F.count("*").alias("_width"), F.count_if(off).alias("_off"))
    fits = length.join(unsized(sizes), ["grid_id", "row"], "left").withColumn("_all", F.col("_n") == F.col("_width")).withColumn("_ok", F.coalesce(F.col("_all") | (F.col("_n") == F.col("_off")), F.lit(False)))
    reading = F.when(F.col("row") % 2 == 1, -F.col("x")).otherwise(F.col("x"))
    own = cells.withColumn("_off", off).join(unsized(fits.filter("_ok").select("grid_id", "row", "_all")), ["grid_id", "row"]).filter("_all OR _off")
    ranked = own.withColumn("k", F.row_number().over(Window.partitionBy("grid_id", "row").orderBy(reading))).select("grid_id", "row", "k", "y", "x")
    return ranked.join(unsized(told), ["grid_id", "row", "k"]).select("grid_id", "y", "x", "code"), fits.filter("NOT _ok").select("grid_id", "row")


def placed_tiles(headers: DataFrame, cells: DataFrame) -> DataFrame:
    """grid_id, y, x, code of a chart put together from its pages.

    headers: grid_id, page, a, b, width, c, d, height (columns a to b and rows c to d, counted from the bottom right
    corner, from 1); cells: grid_id, page, y, x, code (from a page's top left).
    """
    d = cells.join(unsized(headers), ["grid_id", "page"])
    return d.select("grid_id", (F.col("height") - F.col("d") + F.col("y")).alias("y"), (F.col("width") - F.col("b") + F.col("x")).alias("x"), "code").distinct()


def tile_problems(headers: DataFrame, cells: DataFrame) -> DataFrame:
    """grid_id, kind (size, uncovered, overlap), n: pages whose cells are not as many as their header says; cells of the chart on no page, or of two codes."""
    page = cells.groupBy("grid_id", "page").agg(F.count("*").alias("n"))
    wrong = headers.join(unsized(page), ["grid_id", "page"], "left").filter(F.coalesce("n", F.lit(0)) != (F.col("b") - F.col("a") + 1) * (F.col("d") - F.col("c") + 1)).groupBy("grid_id").agg(F.count("*").alias("n")).select("grid_id", F.lit("size").alias("kind"), "n")
    whole = headers.groupBy("grid_id").agg((F.max("width") * F.max("height")).alias("_whole"))
    places = placed_tiles(headers, cells).groupBy("grid_id", "y", "x").agg(F.count("*").alias("_c")).groupBy("grid_id").agg(F.count("*").alias("_have"), F.count_if(F.col("_c") > 1).alias("_two"))
    d = whole.join(unsized(places), "grid_id", "left")
    lost = d.select("grid_id", F.lit("uncovered").alias("kind"), (F.col("_whole") - F.coalesce("_have", F.lit(0))).alias("n")).filter("n > 0")
    return wrong.unionByName(lost).unionByName(d.filter("_two > 0").select("grid_id", F.lit("overlap").alias("kind"), F.col("_two").alias("n")))


def lookup_interval(points: DataFrame, intervals: DataFrame, at: str, key: list[str]) -> DataFrame:
    """points joined to the interval [from_, to_ or open] of the same key that holds them, with k and of (k-of-n; null if open).

    Intervals of a key must not overlap: a point's interval is the last that begins at or before it, found by one
    window over both tables, so no range join is made.
    """
    both = points.select(*key, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*[c for c in points.columns if c not in key]).alias("_p"), F.lit(None).cast(intervals.select(F.struct("from_", "to_", "text").alias("x")).schema["x"].dataType).alias("_i"))
    rows = intervals.select(*key, F.col("from_").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(both.schema["_p"].dataType).alias("_p"), F.struct("from_", "to_", "text").alias("_i"))
    w = Window.partitionBy(*key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    d = both.unionByName(rows).withColumn("_i", F.last("_i", ignorenulls=True).over(w)).filter("_kind = 1")
    hit = F.col("_i").isNotNull() & (F.col("_i.to_").isNull() | (F.col("_at") <= F.col("_i.to_")))
    k = F.when(hit, F.col("_at") - F.col("_i.from_") + 1)
    return d.select(*key, "_p.*", F.when(hit, F.col("_i.text")).alias("text"), k.cast("long").alias("k"), F.when(hit, F.col("_i.to_") - F.col("_i.from_") + 1).cast("long").alias("of"))


def tiles(cells: DataFrame, width: Column, height: Column, max_cols: int, max_rows: int) -> DataFrame:
    """cells with tile_col and tile_row of balanced tiles, numbered in working order from the bottom right."""
    per = lambda total, most: F.ceil(total / F.ceil(total / most))
    from_right, from_bottom = width - 1 - F.col("x"), height - 1 - F.col("y")
    return cells.withColumns({"tile_col": F.floor(from_right / per(width, max_cols)).cast("long"), "tile_row": F.floor(from_bottom / per(height, max_rows)).cast("long")})


def copies(pieces: DataFrame, make: str = "make") -> DataFrame:
    """pieces with copy 1 to make (1 if null); none where make is below 1."""
    n = F.coalesce(make, F.lit(1))
    return pieces.filter(n >= 1).withColumn("copy", F.explode(F.sequence(F.lit(1), n.cast("int"))))
