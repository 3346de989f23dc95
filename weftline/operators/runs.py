"""Run-length operators over long cell tables (grid_id, y, x, code) and over run strings such as 12C3K5C."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = ("grid_id", "y")
#: Fixed value: one run in a run string, a count and a code of one to three letters.
RUN = r"([0-9]+)([A-Za-z]{1,3})"
RUN_STRING = r"\A(?:[0-9]+[A-Za-z]{1,3})+\z"


def rle_encode(cells: DataFrame, row: tuple[str, ...] = ROW, order: str = "x", code: str = "code", block: int | None = None) -> DataFrame:
    """Runs of equal neighbours: row columns, run_no (from 0), code, n, x0.

    One exchange and one sort by the row's key serve both windows and the aggregation. With `block`, a row is first
    encoded in blocks of that many positions, so that no task sorts a whole long row; only runs at block ends meet again.
    """
    if block:
        parts = rle_encode(cells.withColumn("_block", F.floor(F.col(order) / block)), (*row, "_block"), order, code)
        w = Window.partitionBy(*row).orderBy("x0")
        new = F.when(F.lag("code").over(w).eqNullSafe(F.col("code")) & (F.lag("_block").over(w) != F.col("_block")), 0).otherwise(1)
        merged = parts.withColumn("_run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        out = merged.groupBy(*row, "_run", "code").agg(F.sum("n").alias("n"), F.min("x0").alias("x0"))
        return out.select(*row, (F.col("_run") - 1).cast("long").alias("run_no"), "code", "n", "x0")
    w = Window.partitionBy(*row).orderBy(order)
    new = F.when(F.lag(code).over(w).eqNullSafe(F.col(code)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    islands = cells.select(*row, F.col(order).alias("x"), F.col(code).alias("code"), new.alias("_new")).withColumn("_run", F.sum("_new").over(Window.partitionBy(*row).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy(*row, "_run", "code").agg(F.count("*").alias("n"), F.min("x").alias("x0"))
    return out.select(*row, (F.col("_run") - 1).cast("long").alias("run_no"), "code", "n", "x0")


def rle_decode(runs: DataFrame, row: tuple[str, ...] = ROW) -> DataFrame:
    """Cells of runs with x0 and n; runs of no cells give none."""
    return runs.filter("n > 0").select(*row, F.explode(F.sequence(F.col("x0").cast("long"), (F.col("x0") + F.col("n") - 1).cast("long"))).alias("x"), "code")


def run_strings(runs: DataFrame, row: tuple[str, ...] = ROW) -> DataFrame:
    """One run string for each row of a grid."""
    part = F.struct("run_no", F.concat(F.col("n").cast("string"), "code").alias("s"))
    return runs.groupBy(*row).agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["s"]), "").alias("runs"))


def parse_runs(text: Column) -> Column:
    """array<struct<code, count, x0>> of a run string; null where the string is not one (zero counts are read)."""
    counts = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(1)), lambda x: x.cast("long"))
    codes = F.regexp_extract_all(text, F.lit(RUN), F.lit(2))
    paired = F.zip_with(codes, counts, lambda c, n: F.struct(c.alias("code"), n.alias("count")))
    placed = F.transform(paired, lambda r, i: F.struct(r["code"].alias("code"), r["count"].alias("count"), F.aggregate(F.slice(counts, F.lit(1), i), F.lit(0).cast("long"), lambda a, b: a + b).alias("x0")))
    return F.when(text.rlike(RUN_STRING), placed)


def rows_to_runs(rows: DataFrame, column: str = "runs", row: tuple[str, ...] = ROW) -> DataFrame:
    """Runs (row columns, run_no, code, n, x0) of run strings."""
    return rows.select(*row, F.posexplode(parse_runs(F.col(column))).alias("run_no", "r")).select(*row, F.col("run_no").cast("long").alias("run_no"), "r.code", F.col("r.count").alias("n"), "r.x0")


def counts_by_code(runs: DataFrame, palette: DataFrame, by: tuple[str, ...] = ("grid_id",)) -> DataFrame:
    """Cells of every palette code (column code) in every grid, zero where it has none.

    The codes go to all tasks as one row, an array of distinct codes of a few letters.
    """
    have = runs.groupBy(*by, "code").agg(F.sum("n").alias("cells"))
    codes = palette.agg(F.collect_set("code").alias("_codes"))
    every = runs.select(*by).distinct().crossJoin(F.broadcast(codes)).withColumn("code", F.explode("_codes")).drop("_codes")
    return every.join(have, [*by, "code"], "left").select(*by, "code", F.coalesce("cells", F.lit(0)).cast("long").alias("cells"))


def changes(runs: DataFrame, row: tuple[str, ...] = ROW) -> DataFrame:
    """Colour changes and the shortest run of each row."""
    return runs.groupBy(*row).agg((F.count("*") - 1).alias("changes"), F.min("n").alias("min_run"))


def stats(runs: DataFrame, row: tuple[str, ...] = ROW, by: str = "grid_id") -> DataFrame:
    """Cells, rows, runs, runs of one cell, and the mean (half-even, one place) and most colour changes of a grid's rows."""
    rows = runs.groupBy(*row).agg(F.sum("n").alias("cells"), F.count("*").alias("runs"), F.count_if(F.col("n") == 1).alias("singles"))
    return rows.groupBy(by).agg(
        F.sum("cells").alias("cells"), F.count("*").alias("height"), F.sum("runs").alias("runs"), F.sum("singles").alias("single_runs"),
        F.bround(F.avg(F.col("runs") - 1), 1).alias("changes_mean"), F.max(F.col("runs") - 1).alias("changes_max"),
    )


def code_stats(runs: DataFrame, palette: DataFrame, ground: DataFrame | None = None) -> DataFrame:
    """grid_id, code, cells, singles (runs of one cell) of every palette code of a grid, zero where it has none.

    palette: grid_id, code; ground: grid_id, code of grids on a ground, whose cells are no stitches and are left out.
    """
    d, own = runs, palette.select("grid_id", "code").distinct()
    if ground is not None:
        d, own = (x.join(ground.select("grid_id", "code"), ["grid_id", "code"], "left_anti") for x in (d, own))
    have = d.groupBy("grid_id", "code").agg(F.sum("n").alias("cells"), F.count_if(F.col("n") == 1).alias("singles"))
    return own.join(have, ["grid_id", "code"], "left").select("grid_id", "code", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("cells", "singles")])


def chart_stats(runs: DataFrame, gauge: DataFrame, ground: DataFrame | None = None) -> DataFrame:
    """grid_id, cells, width, height, width_in, height_in, changes_mean, changes_max, changes (array by row), stitches.

    runs: grid_id, y, code, n, x0; gauge: grid_id, stitches and rows an inch, cell (kind), unit (what the gauge counts).
    Cells of the ground are in the size, but are neither counted nor change the colour. A size needs a gauge that counts
    the grid's cells; stitches are given where cells are stitches. Means are half-even, to one place.
    """
    d = runs.withColumn("_ground", F.lit(False))
    if ground is not None:
        d = runs.join(ground.select("grid_id", F.col("code").alias("_g")), "grid_id", "left").withColumn("_ground", F.col("code").eqNullSafe(F.col("_g")) & F.col("_g").isNotNull())
    own = ~F.col("_ground")
    rows = d.groupBy("grid_id", "y").agg(F.sum(F.when(own, F.col("n")).otherwise(0)).alias("_n"), F.greatest(F.count_if(own) - 1, F.lit(0)).alias("_c"), F.max(F.col("x0") + F.col("n")).alias("_w"))
    g = rows.groupBy("grid_id").agg(
        F.sum("_n").alias("cells"), F.max("_w").alias("width"), (F.max("y") + 1).alias("height"), F.bround(F.avg("_c"), 1).alias("changes_mean"), F.max("_c").alias("changes_max"),
        F.transform(F.array_sort(F.collect_list(F.struct("y", "_c"))), lambda x: x["_c"]).alias("changes"),
    ).join(gauge, "grid_id")
    kind, unit = F.coalesce("cell", F.lit("stitch")), F.coalesce("unit", F.lit("stitches"))
    sized = ((kind == "stitch") & (unit == "stitches")) | ((kind == "tile") & (unit == "tiles"))
    length = lambda n, per: F.when(sized, F.bround(F.try_divide(F.col(n).cast("double"), F.col(per)), 1))
    return g.select("grid_id", "cells", "width", "height", length("width", "stitches").alias("width_in"), length("height", "rows").alias("height_in"), "changes_mean", "changes_max", "changes", F.when(kind == "stitch", F.col("cells")).alias("stitches"))


def yarn(counts: DataFrame, gauge: DataFrame, by: str = "grid_id") -> DataFrame:
    """by, code, yards, skeins of each colour. counts: by, code, cells; gauge: by, stitches and rows an inch, cell (kind).

    1.1 yards a square inch and a fifth more for tails; 364 yards a skein. Only cells that are stitches have yarn: for
    other kinds both are null.
    """
    area = F.try_divide(F.lit(1.0), F.col("stitches") * F.col("rows"))
    yards = F.when(F.coalesce("cell", F.lit("stitch")) == "stitch", F.col("cells") * area * 1.1 * 1.2)
    d = counts.join(gauge, by).withColumn("_y", yards)
    return d.select(by, "code", F.bround("_y", 0).cast("long").alias("yards"), F.bround(F.col("_y") / 364, 1).alias("skeins"))


def work_hours(stitches: Column, changes_: Column, stitch: Column) -> Column:
    """Estimated hours: stitches over the rate of the stitch, and three seconds a change."""
    # Stitches an hour by stitch.
    rate = F.when(stitch == "sc", 1100).when(stitch == "hdc", 850).when(stitch == "dc", 700).otherwise(900)
    return F.bround(stitches / rate + changes_ * 3 / 3600.0, 1)
