"""Robust spread and straight lines of groups: medians of deviations, least squares with residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mad(values: DataFrame, by: list[str], value: str, accuracy: int | None = None) -> DataFrame:
    """by, median, mad (the median distance from it), n. Nulls and NaN do not count; a group of these alone has n 0.

    Two aggregates. Exact ones count each distinct value of a group in its state; with `accuracy` both medians come from
    mergeable sketches, of a rank error of 1 / accuracy, whatever the number of values.
    """
    middle = lambda c: F.median(c) if accuracy is None else F.percentile_approx(c, 0.5, accuracy).cast("double")
    d = values.select(*by, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("_v"))
    centre = d.groupBy(*by).agg(middle("_v").alias("median"), F.count("_v").alias("n"))
    spread = d.join(centre.select(*by, F.col("median").alias("_m")), by).groupBy(*by).agg(middle(F.abs(F.col("_v") - F.col("_m"))).alias("mad"))
    return centre.join(spread, by).select(*by, "median", "mad", "n")


def band_noise(pixels: DataFrame, by: list[str], cell: str, value: str) -> DataFrame:
    """by, mean, median, n: of the spreads (population standard deviations) of a band's cells."""
    cells = pixels.groupBy(*by, cell).agg(F.stddev_pop(value).alias("_s"))
    return cells.groupBy(*by).agg(F.avg("_s").alias("mean"), F.median("_s").alias("median"), F.count("_s").alias("n"))


def line_fit(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, slope, intercept, n, residual (the root mean square of what is left): least squares in one aggregate.

    Points without x or y do not count. A group whose x do not differ has no line: slope, intercept and residual are null.
    """
    d = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    g = d.groupBy(*by).agg(F.regr_sxx("_y", "_x").alias("_xx"), F.regr_sxy("_y", "_x").alias("_xy"), F.regr_syy("_y", "_x").alias("_yy"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), F.count("*").alias("n"))
    slope = F.when(F.col("_xx") > 0, F.col("_xy") / F.col("_xx"))
    left = F.greatest(F.lit(0.0), F.col("_yy") - slope * F.col("_xy"))
    return g.select(*by, slope.alias("slope"), (F.col("_my") - slope * F.col("_mx")).alias("intercept"), "n", F.when(slope.isNotNull(), F.sqrt(left / F.col("n"))).alias("residual"))


def off_line(points: DataFrame, by: list[str], x: str, y: str, most: float) -> DataFrame:
    """points that lie further from their group's line than `most` times its residual, with their distance."""
    d = points.join(line_fit(points, by, x, y), by)
    away = F.col(y) - (F.col("intercept") + F.col("slope") * F.col(x))
    return d.withColumn("distance", away).filter(F.abs("distance") > most * F.col("residual")).drop("slope", "intercept", "n", "residual")


def lattice_lines(marks: DataFrame, by: list[str], k: str, at: str, least: int = 3) -> DataFrame:
    """by, k, at: evenly spaced lines from the first to the last number k of marks (their places by least squares).

    Groups with fewer than `least` + 1 numbers, or with one number alone, have none.
    """
    first = marks.groupBy(*by).agg(F.min(k).alias("_k0"), F.max(k).alias("_k1"))
    fit = line_fit(marks.join(first, by).withColumn("_k", F.col(k) - F.col("_k0")), by, "_k", at)
    d = first.join(fit, by).filter((F.col("_k1") - F.col("_k0") >= least) & F.col("slope").isNotNull())
    d = d.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_k1") - F.col("_k0")).cast("long"))))
    return d.select(*by, (F.col("_k0") + F.col("_i")).alias(k), (F.col("intercept") + F.col("slope") * F.col("_i")).alias(at))
