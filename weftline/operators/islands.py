"""Gaps and islands: ranges, missing and repeated numbers, sessions, stretches, sections and fill-forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import spread, unsized

GAP_SECONDS = 1200


def ranges(numbers: DataFrame, key: list[str], n: str) -> DataFrame:
    """key, start, end, size of maximal ranges of consecutive distinct numbers."""
    d = numbers.select(*key, F.col(n).alias("_n")).filter("_n IS NOT NULL").distinct()
    d = d.withColumn("_island", F.col("_n") - F.row_number().over(Window.partitionBy(*key).orderBy("_n")))
    return d.groupBy(*key, "_island").agg(F.min("_n").alias("start"), F.max("_n").alias("end"), F.count("*").alias("size")).drop("_island")


def range_text(found: DataFrame, key: list[str]) -> DataFrame:
    """Ranges of a key as text such as 2-3, 5, 7-9."""
    one = F.when(F.col("start") == F.col("end"), F.col("start").cast("string")).otherwise(F.concat(F.col("start"), F.lit("-"), F.col("end")))
    return found.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", one.alias("s")))), lambda x: x["s"]), ", ").alias("ranges"))


def missing(numbers: DataFrame, key: list[str], n: str) -> DataFrame:
    """key, start, end of the gaps between a key's numbers (nothing is exploded, so a wide gap costs one row)."""
    d = numbers.select(*key, F.col(n).alias("_n")).filter("_n IS NOT NULL").distinct()
    d = d.withColumn("_next", F.lead("_n").over(Window.partitionBy(*key).orderBy("_n")))
    return d.filter("_next > _n + 1").select(*key, (F.col("_n") + 1).alias("start"), (F.col("_next") - 1).alias("end"))


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, n of keys that occur more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def within(before: Column, t: Column, gap_seconds: int) -> Column:
    """Whether t is at most so many seconds after `before`, to the microsecond; timestamp_diff would drop the part of a second."""
    return t <= before + F.make_dt_interval(secs=F.lit(gap_seconds))


def sessions(log: DataFrame, key: str = "project", t: str = "t", gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """key, start, end, n_events, active_seconds: a gap of more than gap_seconds starts a new session."""
    d = log.groupBy(key, F.session_window(F.col(t), f"{gap_seconds} seconds").alias("_w")).agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("n_events"))
    return d.select(key, "start", "end", "n_events", F.timestamp_diff("SECOND", F.col("start"), F.col("end")).alias("active_seconds"))


def session_deltas(log: DataFrame, key: str = "project", t: str = "t", tie: str = "seq", pos: str = "pos", gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """sessions with cells: how far the position (cells done) moved from before a session to its end, not below 0."""
    w = Window.partitionBy(key).orderBy(t, tie)
    new = F.when(within(F.lag(t).over(w), F.col(t), gap_seconds), 0).otherwise(1)
    d = log.select(key, t, tie, pos, F.coalesce(F.lag(pos).over(w), F.lit(0)).alias("_from"), new.alias("_new"))
    d = d.withColumn("_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.struct(t, tie)
    g = d.groupBy(key, "_s").agg(F.min(t).alias("start"), F.max(t).alias("end"), (F.max_by(pos, order) - F.min_by("_from", order)).alias("_d"))
    return g.select(key, "start", "end", F.greatest(F.lit(0), F.col("_d")).cast("long").alias("cells"), F.timestamp_diff("SECOND", F.col("start"), F.col("end")).alias("active_seconds"))


def pace(found: DataFrame, key: str = "project") -> DataFrame:
    """key, n_sessions, cells, active_seconds and cells_per_hour (null without active time)."""
    d = found.groupBy(key).agg(F.count("*").alias("n_sessions"), F.sum("cells").alias("cells"), F.sum("active_seconds").alias("active_seconds"))
    return d.withColumn("cells_per_hour", F.when(F.col("active_seconds") > 0, F.bround(F.col("cells") / (F.col("active_seconds") / 3600.0), 1)))


def overlap_seconds(found: DataFrame, start, end, key: str = "project") -> DataFrame:
    """key, seconds of sessions within [start, end]."""
    inside = F.timestamp_diff("SECOND", F.greatest(F.col("start"), start), F.least(F.col("end"), end))
    return found.groupBy(key).agg(F.sum(F.greatest(F.lit(0), inside)).cast("long").alias("seconds"))


def stretches(runs: DataFrame, ratio: float = 3.0, plain_runs: int = 3, palette: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """grid_id, start, end (passes), n_rows, plain, codes: neighbours of other codes, or of `ratio` times the runs, part; single rows join the stretch before.

    codes are by cells, most first; ties by their place in palette (grid_id, code, place), those without one last, then by code.
    Rows of a grid are dealt over `parts` tasks, if given.
    """
    # A row keeps the cells of its own codes, so that its runs are read once.
    per_code = runs.groupBy("grid_id", "pass_no", "code").agg(F.sum("n").alias("n"), F.count("*").alias("_k"))
    rows = per_code.groupBy("grid_id", "pass_no").agg(F.array_sort(F.collect_list("code")).alias("codes"), F.sum("_k").alias("runs"), F.collect_list(F.struct("code", "n")).alias("_own_codes"))
    rows = spread(rows, parts, "grid_id")
    w = Window.partitionBy("grid_id").orderBy("pass_no")
    cut = (F.lag("codes").over(w) != F.col("codes")) | (F.greatest("runs", F.lag("runs").over(w)) >= ratio * F.least("runs", F.lag("runs").over(w)))
    d = rows.withColumn("_new", F.when(F.lag("pass_no").over(w).isNull() | cut, 1).otherwise(0)).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count("*").over(Window.partitionBy("grid_id", "_i"))
    d = d.withColumn("_own", F.when((F.col("_new") == 1) & ((F.col("_i") == 1) | (size >= 2)), 1).otherwise(0))
    d = d.withColumn("stretch", F.sum("_own").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = d.groupBy("grid_id", "stretch").agg(F.min("pass_no").alias("start"), F.max("pass_no").alias("end"), F.count("*").alias("n_rows"), (F.max("runs") <= plain_runs).alias("plain"))
    colours = d.select("grid_id", "stretch", F.explode("_own_codes").alias("r")).groupBy("grid_id", "stretch", F.col("r.code").alias("code")).agg(F.sum("r.n").alias("cells"))
    if palette is not None:
        colours = colours.join(unsized(palette.select("grid_id", "code", "place")), ["grid_id", "code"], "left")
    place = F.lit(0) if palette is None else F.coalesce(F.col("place").cast("long"), F.lit((1 << 63) - 1))
    listed = colours.groupBy("grid_id", "stretch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("cells")).alias("c"), place.alias("p"), "code"))), lambda x: x["code"]), ",").alias("codes"))
    return spans.join(unsized(listed), ["grid_id", "stretch"])


def stretch_kinds(found: DataFrame, runs: DataFrame, segments: DataFrame) -> DataFrame:
    """stretches with kind: plain; repeat, if one band of repetitions holds half of the cells of each of its rows; else pattern.

    segments: of machine.segments over the same runs (grid_id, pass_no, run_no, n). Bands are run numbers, so their cells
    are a difference of running sums; rows are put to stretches by a window over both, and no range is made long.
    """
    upto = Window.partitionBy("grid_id", "pass_no").orderBy("run_no").rowsBetween(Window.unboundedPreceding, 0)
    sums = runs.select("grid_id", "pass_no", "run_no", "n", F.sum("n").over(upto).alias("_to"))
    bands = segments.filter("kind = 'repeat'").select("grid_id", "pass_no", F.col("start").alias("_first"), (F.col("end") - 1).alias("_last"))
    left = bands.join(unsized(sums.select("grid_id", "pass_no", F.col("run_no").alias("_first"), (F.col("_to") - F.col("n")).alias("_from"))), ["grid_id", "pass_no", "_first"])
    band = left.join(unsized(sums.select("grid_id", "pass_no", F.col("run_no").alias("_last"), "_to")), ["grid_id", "pass_no", "_last"])
    widest = band.groupBy("grid_id", "pass_no").agg(F.max(F.col("_to") - F.col("_from")).alias("_band"))
    rows = runs.groupBy("grid_id", "pass_no").agg(F.sum("n").alias("_n")).join(unsized(widest), ["grid_id", "pass_no"], "left").select("grid_id", F.col("pass_no").alias("_at"), F.coalesce(2 * F.col("_band") >= F.col("_n"), F.lit(False)).alias("_repeats"), F.lit(None).cast("bigint").alias("_stretch"))
    starts = found.select("grid_id", F.col("start").alias("_at"), F.lit(None).cast("boolean").alias("_repeats"), F.col("stretch").cast("bigint").alias("_stretch"))
    w = Window.partitionBy("grid_id").orderBy("_at", F.col("_stretch").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    each = starts.unionByName(rows).withColumn("stretch", F.last("_stretch", ignorenulls=True).over(w)).filter("_repeats IS NOT NULL")
    whole = each.groupBy("grid_id", "stretch").agg(F.bool_and("_repeats").alias("_repeats"))
    kind = F.when(F.col("plain"), "plain").when(F.coalesce("_repeats", F.lit(False)), "repeat").otherwise("pattern")
    return found.join(unsized(whole), ["grid_id", "stretch"], "left").withColumn("kind", kind).drop("_repeats")


def look_ahead(found: DataFrame) -> DataFrame:
    """stretches with the next one's rows, the first code that joins and the first that leaves, and whether it is simpler."""
    w = Window.partitionBy("grid_id").orderBy("stretch")
    d = found.withColumns({"_c": F.split("codes", ","), "_n": F.split(F.lead("codes").over(w), ","), "next_start": F.lead("start").over(w), "next_plain": F.lead("plain").over(w)})
    return d.select("grid_id", "stretch", "next_start", F.get(F.array_except("_n", "_c"), 0).alias("joins"), F.get(F.array_except("_c", "_n"), 0).alias("leaves"), (F.col("next_plain") & ~F.col("plain")).alias("simpler"))


def sections(rows: DataFrame, key: list[str], order: list[str], n: str) -> DataFrame:
    """rows with section (from 1): a new one begins where the number is 1 and one has been seen."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.greatest(F.lit(1), F.sum(F.when(F.col(n) == 1, 1).otherwise(0)).over(w)).cast("long"))


def rejoin(lines: DataFrame, key: list[str], order: list[str], is_head, text: str = "line") -> DataFrame:
    """key, head_no, text: lines up to the next head joined with a space; lines before the first head are dropped."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumn("head_no", F.sum(F.when(is_head, 1).otherwise(0)).over(w)).filter("head_no > 0")
    return d.groupBy(*key, F.col("head_no").cast("long").alias("head_no")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda x: x["_t"]), " ").alias("text"))


def take_while_consecutive(entries: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """entries before the first one of a key that doesn't begin where the one before it ended."""
    w = Window.partitionBy(*key).orderBy(start, end)
    d = entries.withColumn("_gap", F.when(F.col(start) != F.lag(end).over(w) + 1, 1).otherwise(0))
    return d.withColumn("_gap", F.max("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_gap = 0").drop("_gap")


def merge_near(points: DataFrame, key: list[str], at: str, weight: str, reach: float) -> DataFrame:
    """key, at (weighted mean), weight of points whose neighbours lie within reach."""
    w = Window.partitionBy(*key).orderBy(at)
    d = points.withColumn("_i", F.when(F.col(at) - F.lag(at).over(w) <= reach, 0).otherwise(1)).withColumn("_i", F.sum("_i").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*key, "_i").agg((F.sum(F.col(at) * F.col(weight)) / F.sum(weight)).alias("at"), F.sum(weight).alias("weight")).drop("_i")
