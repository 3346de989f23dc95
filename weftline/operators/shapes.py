"""Geometry over cells, lines and boxes: masks, dilation, overlap suppression, line clusters, cell medians, shaped pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import growing, grown, whole
from .intervals import overlapping
from .sizes import dealt, unsized


def lattice(spark: SparkSession, width: int, height: int) -> DataFrame:
    """All places (y, x) of a grid, made where they are used."""
    return spark.range(width * height).select((F.col("id") / width).cast("long").alias("y"), (F.col("id") % width).alias("x"))


def drawn(pictures: DataFrame, width: int, height: int) -> DataFrame:
    """pictures with a row for each place (y, x) of a grid of that size; they are dealt by their first column."""
    y = dealt(pictures, pictures.columns[0]).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long"))))
    return y.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))))


def ring(cy: float, cx: float, inner: float, outer: float) -> Column:
    d = F.pow(F.col("y") - cy, F.lit(2)) + F.pow(F.col("x") - cx, F.lit(2))
    return (d >= inner * inner) & (d <= outer * outer)


def ellipse(cy: float, cx: float, ry: float, rx: float) -> Column:
    return F.pow((F.col("y") - cy) / ry, F.lit(2)) + F.pow((F.col("x") - cx) / rx, F.lit(2)) <= 1


def diamond(cy: float, cx: float, ry: float, rx: float) -> Column:
    return F.abs(F.col("y") - cy) / ry + F.abs(F.col("x") - cx) / rx <= 1


def segment(y0: float, x0: float, y1: float, x1: float, half: float) -> Column:
    """Within half of the segment between two points."""
    dy, dx = y1 - y0, x1 - x0
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("y") - y0) * dy + (F.col("x") - x0) * dx) / ((dy * dy + dx * dx) or 1.0)))
    return F.sqrt(F.pow(F.col("y") - y0 - t * dy, F.lit(2)) + F.pow(F.col("x") - x0 - t * dx, F.lit(2))) <= half


def stadium(cy: float, cx: float, half: float, inner: float, outer: float, *, vertical: bool = False) -> Column:
    """From inner to outer (exclusive) around a segment of twice `half`."""
    along, across = (F.col("y") - cy, F.col("x") - cx) if vertical else (F.col("x") - cx, F.col("y") - cy)
    d = F.sqrt(F.pow(F.greatest(F.abs(along) - half, F.lit(0.0)), F.lit(2)) + F.pow(across, F.lit(2)))
    return (d >= inner) & (d < outer)


def sector(cy: float, cx: float, n: int, start: float = 0.0) -> Column:
    """Which of n equal sectors around a centre a place is in, from 0, by the angle from the x axis towards y."""
    turn = F.pmod(F.degrees(F.atan2(F.col("y") - cy, F.col("x") - cx)) - start, F.lit(360.0))
    return F.floor(turn / (360.0 / n)).cast("long")


def _on(c: str, t: str) -> Column:
    """The y or x of a segment at a share of its length."""
    return F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * F.col(t)


def _cut(points: DataFrame, by: list[str], line: str, block: float) -> DataFrame:
    """Segments of lines in parts no longer than a block, from _t0 to _t1 of their segment."""
    w = Window.partitionBy(*by, line).orderBy("i")
    seg = points.select(*by, line, "i", F.lag("py").over(w).alias("y0"), F.lag("px").over(w).alias("x0"), F.col("py").alias("y1"), F.col("px").alias("x1"))
    long = F.sqrt(F.pow(F.col("y1") - F.col("y0"), F.lit(2)) + F.pow(F.col("x1") - F.col("x0"), F.lit(2)))
    seg = seg.withColumn("_l", F.coalesce(long, F.lit(0.0))).withColumn("_base", F.sum("_l").over(w) - F.col("_l")).filter("y0 IS NOT NULL")
    parts = F.greatest(F.lit(1), F.ceil(F.col("_l") / block)).cast("int")
    return seg.withColumn("_p", F.explode(F.sequence(F.lit(0), parts - 1))).withColumns({"_t0": F.col("_p") / parts, "_t1": (F.col("_p") + 1) / parts})


def _placed(d: DataFrame) -> DataFrame:
    """Pairs of a place and a part of a segment, with _t (where on the segment the nearest point lies) and _d (how far away)."""
    dy, dx = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    t = F.when(F.col("_l") > 0, ((F.col("y") - F.col("y0")) * dy + (F.col("x") - F.col("x0")) * dx) / (F.col("_l") * F.col("_l"))).otherwise(0.0)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return d.withColumn("_t", t).withColumn("_d", F.sqrt(F.pow(F.col("y") - F.col("y0") - F.col("_t") * dy, F.lit(2)) + F.pow(F.col("x") - F.col("x0") - F.col("_t") * dx, F.lit(2))))


def _nearest(d: DataFrame, by: list[str], line: str, reach: float) -> DataFrame:
    """by, line, y, x, d, arc of the nearest point of a line (ties: the smaller arc); d: of `_placed`."""
    best = d.filter(F.col("_d") <= reach).groupBy(*by, line, "y", "x").agg(F.min(F.struct("_d", (F.col("_base") + F.col("_t") * F.col("_l")).alias("arc"))).alias("m"))
    return best.select(*by, line, "y", "x", F.col("m._d").alias("d"), "m.arc")


def polyline_cells(cells: DataFrame, points: DataFrame, by: list[str], line: str, reach: float) -> DataFrame:
    """by, line, y, x, d, arc: cells within reach of a polyline, their distance, and how far along it the nearest point lies.

    cells: by, y, x; points: by, line, i (order), py, px. Segments are cut into parts no longer than a block, and cells and
    parts meet by blocks that a part's surroundings touch, so no cell is compared with a whole line.
    """
    block = float(max(reach, 8.0))
    span = lambda c: F.sequence(F.floor((F.least(_on(c, "_t0"), _on(c, "_t1")) - reach) / block), F.floor((F.greatest(_on(c, "_t0"), _on(c, "_t1")) + reach) / block))
    near = _cut(points, by, line, block).withColumn("_by", F.explode(span("y"))).withColumn("_bx", F.explode(span("x")))
    d = cells.select(*by, "y", "x", F.floor(F.col("y") / block).alias("_by"), F.floor(F.col("x") / block).alias("_bx")).join(unsized(near), [*by, "_by", "_bx"])
    return _nearest(_placed(d), by, line, reach)


def traced(points: DataFrame, width: int, height: int, by: list[str], line: str, reach: float) -> DataFrame:
    """`polyline_cells` of all places of grids of that size: each part's surroundings are drawn where its points are.

    No grid is drawn whole, joined or moved; what is made of points that are dealt by `by` stays with them.
    """
    d, wide = _cut(points, by, line, float(max(reach, 8.0))), reach + 1e-6
    for c, size in (("y", height), ("x", width)):
        first = F.greatest(F.lit(0), F.ceil(F.least(_on(c, "_t0"), _on(c, "_t1")) - wide)).cast("long")
        last = F.least(F.lit(size - 1), F.floor(F.greatest(_on(c, "_t0"), _on(c, "_t1")) + wide)).cast("long")
        d = d.withColumns({"_first": first, "_last": last}).filter("_first <= _last").withColumn(c, F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    # A place is told by that part of a segment alone on which its nearest point lies.
    own = (F.col("_t") >= F.col("_t0")) & ((F.col("_t") < F.col("_t1")) | (F.col("_t1") == 1))
    return _nearest(_placed(d).filter(own), by, line, reach)


def crossings(near: DataFrame, by: list[str], line: str, gap: float) -> DataFrame:
    """by, y, x, under, over, k: cells that two polylines share, by crossings counted along the smaller line (from 1).

    near: of `polyline_cells`. A gap of more than `gap` along that line begins a new crossing; at odd ones it lies over.
    """
    # A cell's lines are listed, so that near is made once; the list is no longer than what comes out of the cell.
    listed = near.groupBy(*by, "y", "x").agg(F.collect_list(F.struct(F.col(line).alias("l"), "arc")).alias("_l")).filter(F.size("_l") > 1)
    d = listed.select(*by, "y", "x", "_l", F.explode("_l").alias("_1")).select(*by, "y", "x", F.col("_1.l").alias("_a"), "_1.arc", F.explode("_l.l").alias("_b")).filter("_a < _b")
    w = Window.partitionBy(*by, "_a", "_b").orderBy("arc", "y", "x")
    d = d.withColumn("_new", F.when(F.col("arc") - F.lag("arc").over(w) <= gap, 0).otherwise(1)).withColumn("k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    odd = F.col("k") % 2 == 1
    return d.select(*by, "y", "x", F.when(odd, F.col("_b")).otherwise(F.col("_a")).alias("under"), F.when(odd, F.col("_a")).otherwise(F.col("_b")).alias("over"), "k")


def woven(strands: DataFrame, windows: DataFrame | Column, by: list[str], line: str) -> DataFrame:
    """strands (by, line, y, x; each cell once) without the cells that another one, over them in a window, touches but does not cover.

    windows: by, y, x, over (the line that lies over there), or that line as a column over y and x, which moves nothing. The
    gap beside the upper strand shows which one it is. Cells send their neighbours on and meet them by place, so what is
    dealt by `by` stays there.
    """
    key = [*by, line, "y", "x"]

    def told(d: DataFrame) -> DataFrame:
        if isinstance(windows, Column):
            return d.withColumn("_over", F.coalesce(windows == F.col(line), F.lit(False)))
        over = windows.select(*by, F.col("over").alias(line), "y", "x").distinct().withColumn("_over", F.lit(True))
        return d.join(unsized(over), key, "left").withColumn("_over", F.coalesce("_over", F.lit(False)))

    place = lambda i, j: F.struct((F.col("y") + i).alias("y"), (F.col("x") + j).alias("x"), F.lit(i == j == 0).alias("_own"))
    near = F.array(*[place(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    d = told(strands.select(*key)).select(*by, line, F.explode(F.when(F.col("_over"), near).otherwise(F.array(place(0, 0)))).alias("p")).select(*by, line, "p.*")
    d = told(d.groupBy(*key).agg(F.bool_or("_own").alias("_own"))).filter("_own OR _over")
    w, beside = Window.partitionBy(*by, "y", "x"), F.when(~F.col("_own"), F.col(line))
    d = d.withColumns({"_lo": F.min(beside).over(w), "_hi": F.max(beside).over(w)})
    lost = F.coalesce(F.col("_lo") != F.col(line), F.lit(False)) | F.coalesce(F.col("_hi") != F.col(line), F.lit(False))
    return d.filter(F.col("_own") & ~lost).select(*key)


def rect(cells: DataFrame, y0: int, x0: int, y1: int, x1: int, code: str) -> DataFrame:
    """cells with a filled box (ends exclusive)."""
    inside = F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1)
    return cells.withColumn("code", F.when(inside, code).otherwise(F.col("code")))


def dilate(places: DataFrame, by: list[str]) -> DataFrame:
    """by, y, x of places and their eight neighbours."""
    near = F.array(*[F.struct((F.col("y") + i).alias("y"), (F.col("x") + j).alias("x")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return places.select(*by, F.explode(near).alias("p")).select(*by, "p.y", "p.x").distinct()


def no_stitch_code(cells: DataFrame) -> DataFrame:
    """grid_id, code of grids drawn on a ground: the code of three corners, if every row's other cells are one unbroken run."""
    size = cells.groupBy("grid_id").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    at = cells.join(unsized(size), "grid_id")
    corner = at.filter(F.col("y").isin(0) | (F.col("y") == F.col("h"))).filter(F.col("x").isin(0) | (F.col("x") == F.col("w")))
    ground = corner.groupBy("grid_id", "code").agg(F.count("*").alias("n")).filter("n >= 3").select("grid_id", F.col("code").alias("ground"))
    own = at.join(unsized(ground), "grid_id").groupBy("grid_id", "ground", "h", "y").agg(F.count_if(F.col("code") != F.col("ground")).alias("n"), F.min(F.when(F.col("code") != F.col("ground"), F.col("x"))).alias("lo"), F.max(F.when(F.col("code") != F.col("ground"), F.col("x"))).alias("hi"))
    whole = own.groupBy("grid_id", "ground", "h").agg(F.bool_and((F.col("n") > 0) & (F.col("hi") - F.col("lo") + 1 == F.col("n"))).alias("ok"), F.count("*").alias("rows"))
    return whole.filter("ok AND rows = h + 1").select("grid_id", F.col("ground").alias("code"))


def gap_clusters(lines: DataFrame, by: list[str], at: str, ratio: float = 3.0) -> DataFrame:
    """lines with cluster (from 1): a gap of more than ratio times the median gap of the group starts a new one."""
    w = Window.partitionBy(*by).orderBy(at)
    d = lines.withColumn("_gap", F.col(at) - F.lag(at).over(w))
    limit = d.groupBy(*by).agg((F.median("_gap") * ratio).alias("_limit"))
    d = d.join(limit, by)
    return d.withColumn("cluster", (1 + F.sum(F.when(F.col("_gap") > F.col("_limit"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("long")).drop("_gap", "_limit")


def longest_runs(cells: DataFrame, code: str, bridge: int = 0) -> DataFrame:
    """grid_id, x, longest: the longest vertical run of a code in each column, gaps of up to `bridge` cells counted in."""
    w = Window.partitionBy("grid_id", "x").orderBy("y")
    d = cells.filter(F.col("code") == code).select("grid_id", "x", "y")
    d = d.withColumn("_new", F.when(F.col("y") - F.lag("y").over(w) <= 1 + bridge, 0).otherwise(1)).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy("grid_id", "x", "_i").agg((F.max("y") - F.min("y") + 1).alias("n")).groupBy("grid_id", "x").agg(F.max("n").alias("longest"))


def fitting_lines(lines: DataFrame, spans: DataFrame, key: list[str], unit: float = 1.0, parts: int | None = None) -> DataFrame:
    """key, line, span: lines (a row of line, s, e for each of their segments) that belong to a span (span, lo, hi) of the same key.

    One segment covers half of the span, or lies half inside it. Pairs are found by `intervals.overlapping`. Those of a line
    and a span of one row each come once and go out as they are found; only those of lines of several segments, or of spans
    of several rows, are moved to be compared. `parts`: over how many tasks blocks are dealt.
    """
    overlap = F.least("e", "hi") - F.greatest("s", "lo")
    fits = (2 * overlap >= F.col("hi") - F.col("lo")) | (2 * overlap >= F.col("e") - F.col("s"))

    def found(a: DataFrame, b: DataFrame) -> DataFrame:
        return overlapping(a, b, key, ("s", "e"), ("lo", "hi"), unit, parts).filter(fits).select(*key, "line", "span")

    def parted(df: DataFrame, name: str, *at: str) -> tuple[DataFrame, DataFrame]:
        d = df.select(*key, name, *at).withColumn("_rows", F.count("*").over(Window.partitionBy(*key, name)))
        return d.filter("_rows = 1").drop("_rows"), d.filter("_rows > 1").drop("_rows")

    (line, more_lines), (span, more_spans) = parted(lines, "line", "s", "e"), parted(spans, "span", "lo", "hi")
    again = found(more_lines, span.unionByName(more_spans)).unionByName(found(line, more_spans))
    return found(line, span).unionByName(again.distinct())


def suppress(boxes: DataFrame, by: str, most: float = 0.5) -> DataFrame:
    """by, box of boxes that no larger kept one overlaps by more than `most` of the smaller (greedy by area, ties by box).

    boxes: by, box, x0, y0, x1, y1. The greedy order is a fold over one picture's boxes, in one array.
    """
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    listed = boxes.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-area).alias("order"), "box", "x0", "y0", "x1", "y1"))).alias("_b"))

    def hidden(x, k):
        over = lambda a, b: F.greatest(F.lit(0), F.least(x[b], k[b]) - F.greatest(x[a], k[a]))
        return over("x0", "x1") * over("y0", "y1") > most * F.greatest(F.lit(1), -F.greatest(x["order"], k["order"]))

    kept = F.aggregate("_b", F.slice("_b", 1, 0), lambda a, x: F.when(F.exists(a, lambda k: hidden(x, k)), a).otherwise(F.array_append(a, x)))
    return listed.select(by, F.explode(kept).alias("k")).select(by, "k.box")


def cell_medians(pixels: DataFrame, pitch: int, part: float = 0.4) -> DataFrame:
    """by picture, y, x: the median r, g, b of the middle part of each cell of `pitch` pixels (pixels: picture, py, px, r, g, b)."""
    margin = (1 - part) / 2 * pitch
    inside = lambda c: (F.pmod(F.col(c), F.lit(pitch)) >= margin) & (F.pmod(F.col(c), F.lit(pitch)) < pitch - margin)
    cell = lambda c: F.floor(F.col(c) / pitch)
    d = pixels.filter(inside("py") & inside("px"))
    return d.groupBy("picture", cell("py").alias("y"), cell("px").alias("x")).agg(*[F.median(c).alias(c) for c in "rgb"])


def thinned(ticks: DataFrame, by: list[str], at: str, least: float, most: int) -> DataFrame:
    """The ticks that are kept: each at least `least` after the last kept one, up to `most` of a group (a fold in one array)."""
    sorted_ = ticks.groupBy(*by).agg(F.sort_array(F.collect_set(F.col(at).cast("double"))).alias("_t"))
    none = F.struct(F.lit(float("-inf")).alias("at"), F.lit(0).alias("n"), growing("double").alias("out"))
    keeps = lambda a, x: (x - a["at"] >= least) & (a["n"] < most)
    kept = F.aggregate("_t", none, lambda a, x: F.when(keeps(a, x), F.struct(x.alias("at"), (a["n"] + 1).alias("n"), grown(a["out"], x).alias("out"))).otherwise(a))["out"]
    return sorted_.select(*by, F.explode(whole(kept)).alias(at))
