"""Projects of several pieces: totals, what is done, sessions over all pieces, estimates, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import GAP_SECONDS, within
from .sizes import spread


def written_totals(entries: DataFrame, key: list[str]) -> DataFrame:
    """key, total_rows and total_stitches of written rows (from_, to_, count): null if open, stitches also if one has no count."""
    closed, counted = F.bool_and(F.col("to_").isNotNull()), F.bool_and(F.col("count").isNotNull())
    rows, sts = F.max("to_"), F.sum((F.col("to_") - F.col("from_") + 1) * F.col("count"))
    return entries.groupBy(*key).agg(F.when(closed, rows).alias("total_rows"), F.when(closed & counted, sts).cast("long").alias("total_stitches"))


def stitches_before(entries: DataFrame, cursors: DataFrame, key: list[str]) -> DataFrame:
    """cursors (key, row) with the stitches of the rows before.

    An entry adds its count a row from its start on and takes it away after its end, so one running sum over the starts,
    ends and cursors of a key serves all cursors; no entry is paired with a cursor.
    """
    c = F.coalesce("count", F.lit(0)).cast("long")
    edge = lambda at, n, kind: F.struct(at.cast("long").alias("at"), n.alias("slope"), (n * at).cast("long").alias("base"), F.lit(kind).alias("kind"))
    edges = entries.select(*key, F.explode(F.array(edge(F.col("from_"), c, 1), edge(F.col("to_") + 1, -c, 1))).alias("e")).select(*key, "e.*").filter("at IS NOT NULL")
    asked = cursors.select(*key, F.col("row").cast("long").alias("at"), F.lit(0).cast("long").alias("slope"), F.lit(0).cast("long").alias("base"), F.lit(0).alias("kind"))
    w = Window.partitionBy(*key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)  # an edge at a cursor's row comes after it
    told = edges.unionByName(asked).withColumn("stitches_before", F.col("at") * F.coalesce(F.sum("slope").over(w), F.lit(0)) - F.coalesce(F.sum("base").over(w), F.lit(0)))
    return told.filter("kind = 0").select(*key, F.col("at").alias("row"), F.col("stitches_before").cast("long").alias("stitches_before"))


def piece_progress(pieces: DataFrame) -> DataFrame:
    """pieces (project, piece, done, total, finished) with percent (one place, half-even; null without a total)."""
    return pieces.withColumn("percent", F.when(F.col("total") > 0, F.bround(100.0 * F.col("done") / F.col("total"), 1)).when(F.col("total") == 0, 0.0))


def project_figures(progress: DataFrame, manifest: DataFrame) -> DataFrame:
    """project, pieces_done, pieces_total. progress: project, piece, finished; manifest: project, piece, make. Unknown pieces are skipped."""
    done = progress.join(manifest.select("project", "piece"), ["project", "piece"], "left_semi").groupBy("project").agg(F.count_if("finished").alias("pieces_done"))
    total = manifest.groupBy("project").agg(F.sum(F.coalesce("make", F.lit(1))).cast("long").alias("pieces_total"))
    return total.join(done, "project", "left").select("project", F.coalesce("pieces_done", F.lit(0)).cast("long").alias("pieces_done"), "pieces_total")


def project_sessions(log: DataFrame, manifest: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """project, start, end, rows of sessions over all pieces of a project; events of unknown pieces are left out first.

    log: project, piece, copy, t, seq, kind, row; manifest: project, piece, total (rows; null: open). A piece copy's
    state is its row and whether the event before was a finishing advance (one that left the row as it was); it is
    carried over gaps. A finished copy has all its rows done, another one those before its row.
    """
    d = log.join(manifest.select("project", "piece", "total"), ["project", "piece"])
    own = Window.partitionBy("project", "piece", "copy").orderBy("t", "seq")
    d = d.withColumn("_from", F.coalesce(F.lag("row").over(own), F.lit(1)))
    d = d.withColumn("_fin", (F.col("kind") == "advance") & (F.col("row") == F.col("_from")))
    done = lambda row, fin: F.when(fin, F.coalesce("total", row)).otherwise(row - 1)
    d = d.withColumn("_after", done(F.col("row"), F.col("_fin")))
    d = d.withColumn("_before", F.coalesce(F.lag("_after").over(own), F.lit(0)))
    w = Window.partitionBy("project").orderBy("t", "seq")
    new = F.when(within(F.lag("t").over(w), F.col("t"), gap_seconds), 0).otherwise(1)
    d = d.withColumn("_new", new).withColumn("_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.struct("t", "seq")
    per = d.groupBy("project", "_s", "piece", "copy").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.greatest(F.lit(0), F.max_by("_after", order) - F.min_by("_before", order)).alias("rows"))
    return per.groupBy("project", "_s").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("rows").cast("long").alias("rows")).drop("_s")


def estimated_finish(sessions: DataFrame, remaining: DataFrame, now: Column, days: int = 14, least: int = 3) -> DataFrame:
    """project, window_seconds, days: days from `now` until the end at the mean active time of the last `days` days.

    sessions: project, start, end; remaining: project, remaining, per_hour. Null before `least` sessions, without a rate,
    or without active time in the window; 0 if nothing remains.
    """
    begin = now - F.make_interval(days=F.lit(days))
    inside = F.timestamp_diff("SECOND", F.greatest(F.col("start"), begin), F.least(F.col("end"), now))
    seen = sessions.groupBy("project").agg(F.count("*").alias("_n"), F.sum(F.greatest(F.lit(0), inside)).cast("long").alias("window_seconds"))
    d = remaining.join(seen, "project", "left")
    hours_a_day = F.nullif(F.col("window_seconds") / 3600.0 / days, F.lit(0.0))
    late = F.when((F.coalesce("_n", F.lit(0)) < least) | F.coalesce(F.col("per_hour") <= 0, F.lit(True)), None).when(F.col("remaining") <= 0, 0.0).otherwise(F.try_divide(F.col("remaining") / F.col("per_hour"), hours_a_day))
    return d.select("project", F.coalesce("window_seconds", F.lit(0)).alias("window_seconds"), late.alias("days"))


def manifest_charts(stats: DataFrame, palette: DataFrame) -> DataFrame:
    """grid_id, colours, stitches, changes_mean of charts, for a manifest (stats: of runs.stats; palette: grid_id, code)."""
    colours = palette.groupBy("grid_id").agg(F.count_distinct("code").alias("colours"))
    return stats.join(colours, "grid_id", "left").select("grid_id", F.coalesce("colours", F.lit(0)).cast("long").alias("colours"), F.col("cells").alias("stitches"), "changes_mean")


def manifests(charts: DataFrame, stats: DataFrame, yards: DataFrame, palette: DataFrame) -> DataFrame:
    """pattern, n_charts, charts: array<struct> of each pattern's charts in order, the first the default.

    charts: pattern, place, grid_id, variant, path, unit (of sizes: in or cm); stats: of runs.chart_stats; yards: grid_id,
    code, yards (null where cells are no stitches); palette: grid_id, code. A chart is as long as its pattern's list, so one
    struct a chart is collected, not its rows.
    """
    colours = palette.groupBy("grid_id").agg(F.count_distinct("code").alias("colours"))
    yarn_ = yards.groupBy("grid_id").agg(F.sum("yards").cast("long").alias("yards_est"))
    d = charts.join(stats, "grid_id").join(colours, "grid_id", "left").join(yarn_, "grid_id", "left")
    per = lambda c: F.when(F.col("unit") == "cm", F.bround(F.col(c) * 2.54, 1)).otherwise(F.col(c))
    size = F.when(F.col("width_in").isNotNull() & F.col("height_in").isNotNull(), F.concat(per("width_in").cast("string"), F.lit(" x "), per("height_in").cast("string"), F.lit(" "), F.coalesce("unit", F.lit("in"))))
    is_first = F.col("place") == F.min("place").over(Window.partitionBy("pattern"))
    preview = F.concat(F.regexp_replace("path", r"[^/]*$", ""), F.lit("preview.png"))
    entry = F.struct(
        "place", "grid_id", "variant", is_first.alias("default"), "path", preview.alias("preview"), "width", "height", size.alias("size"), F.coalesce("colours", F.lit(0)).cast("long").alias("colours"),
        (F.col("width") * F.col("height")).alias("stitches"), "changes_mean", "changes_max", "yards_est",
    )
    return d.select("pattern", entry.alias("e")).groupBy("pattern").agg(F.count("*").alias("n_charts"), F.array_sort(F.collect_list("e")).alias("charts"))


def live_state(cursors: DataFrame, runs: DataFrame, parts: int | None = None) -> DataFrame:
    """cursors (project, grid_id, row, run) with the run there, and the codes of the runs before and after it in the pass; joined over `parts` tasks, if given."""
    w = Window.partitionBy("grid_id", "pass_no").orderBy("run_no")
    at = runs.select("grid_id", F.col("pass_no").alias("row"), F.col("run_no").alias("run"), "code", "n", F.lag("code").over(w).alias("previous"), F.lead("code").over(w).alias("next"))
    return cursors.join(spread(at, parts, "grid_id", "row", "run"), ["grid_id", "row", "run"], "left").select("project", "row", "run", "code", "n", "previous", "next")


def live_activity(cursors: DataFrame, runs: DataFrame, segments: DataFrame, parts: int | None = None) -> DataFrame:
    """cursors (project, grid_id, row, run, stitch) with code, n, next, cells_done, percent, at_boundary, last_in_row, finished, repetition, repetitions.

    runs: of sequence.passes (with cells_before); segments: of machine.segments. A cursor one beyond a row's last run stands
    between rows: next is then the next row's first run; at the last row's end the work is finished. repetition counts from
    1 within a band of repetitions. Grids are joined by cursor, row and run, over `parts` tasks, if given; a band is found by
    the run it begins at.
    """
    w = Window.partitionBy("grid_id", "pass_no").orderBy("run_no")
    at = runs.select("grid_id", F.col("pass_no").alias("row"), F.col("run_no").alias("run"), "code", "n", F.lead("code").over(w).alias("_next"), F.col("cells_before").alias("_before"))
    rows = runs.groupBy("grid_id", F.col("pass_no").alias("row")).agg(F.max("run_no").alias("_last"), F.min_by("code", "run_no").alias("_first"), F.max(F.col("cells_before") + F.col("n")).alias("_end"))
    ahead = rows.select("grid_id", (F.col("row") - 1).alias("row"), F.col("_first").alias("_ahead"))
    whole = runs.groupBy("grid_id").agg(F.max("pass_no").alias("_rows"), F.sum("n").alias("_total"))
    bands = segments.filter("kind = 'repeat'").select("grid_id", F.col("pass_no").alias("row"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("period").alias("_p"), F.col("repetitions").alias("_r"))
    d = cursors.join(rows, ["grid_id", "row"]).join(whole, "grid_id").join(ahead, ["grid_id", "row"], "left").join(spread(at, parts, "grid_id", "row", "run"), ["grid_id", "row", "run"], "left")
    band = d.select("project", "grid_id", "row", "run").join(bands, ["grid_id", "row"]).filter((F.col("run") >= F.col("_s")) & (F.col("run") < F.col("_e")))
    d = d.join(band.select("project", "grid_id", "row", "run", (F.floor((F.col("run") - F.col("_s")) / F.col("_p")) + 1).alias("repetition"), F.col("_r").alias("repetitions")), ["project", "grid_id", "row", "run"], "left")
    end = F.col("run") > F.col("_last")
    done = F.when(end, F.col("_end")).otherwise(F.col("_before") + F.col("stitch"))
    finished = end & (F.col("row") == F.col("_rows"))
    return d.select(
        "project", "row", "run", "code", "n", F.when(end, F.col("_ahead")).otherwise(F.col("_next")).alias("next"), done.cast("long").alias("cells_done"), F.bround(100.0 * done / F.col("_total"), 1).alias("percent"),
        (end & ~finished).alias("at_boundary"), (F.col("run") >= F.col("_last")).alias("last_in_row"), finished.alias("finished"), "repetition", "repetitions",
    )


def project_report(progress: DataFrame, manifest: DataFrame, assembly: DataFrame) -> DataFrame:
    """project, pieces_done, pieces_total, assembly_done, assembly_total: `project_figures` with the steps of putting together.

    assembly: project, step, done. Steps that are named twice count once, done if either is.
    """
    steps = assembly.groupBy("project", "step").agg(F.bool_or(F.coalesce("done", F.lit(False))).alias("_d")).groupBy("project").agg(F.count_if("_d").alias("assembly_done"), F.count("*").alias("assembly_total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return project_figures(progress, manifest).join(steps, "project", "left").select("project", "pieces_done", "pieces_total", zero("assembly_done"), zero("assembly_total"))


def unique_slugs(rows: DataFrame, by: str, order: str, base: str) -> DataFrame:
    """by, order, slug: taken slugs get -2, -3, ..., skipping those taken.

    Only names of one root (without -numbers at the end) can meet. Where all names of a root are alike, their number in
    order is the suffix; only the names of mixed roots are folded, in an array of that root alone.
    """
    d = rows.select(by, order, F.when(F.coalesce(base, F.lit("")) == "", "piece").otherwise(F.col(base)).alias("base"))
    d = d.withColumn("_root", F.regexp_replace("base", r"(-[0-9]+)+$", ""))
    w = Window.partitionBy(by, "_root")
    d = d.withColumns({"_k": F.row_number().over(w.orderBy(order)), "_mixed": F.min("base").over(w) != F.max("base").over(w)})
    alike = d.filter(~F.col("_mixed")).select(by, order, F.when(F.col("_k") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "_k")).alias("slug"))

    def step(a, x):
        tries = F.transform(F.sequence(F.lit(1), F.size(a) + 1), lambda k: F.when(k == 1, x["base"]).otherwise(F.concat_ws("-", x["base"], k)))
        free = F.get(F.filter(tries, lambda t: ~F.exists(a, lambda y: y["slug"] == t)), 0)
        return F.array_append(a, F.struct(x[order].alias(order), free.alias("slug")))

    mixed = d.filter("_mixed").groupBy(by, "_root").agg(F.array_sort(F.collect_list(F.struct(order, "base"))).alias("_n"))
    kind = f"array<struct<{order}:{dict(rows.dtypes)[order]},slug:string>>"
    folded = mixed.select(by, F.explode(F.aggregate("_n", F.array().cast(kind), step)).alias("s")).select(by, "s.*")
    return alike.unionByName(folded)


def copied_rows(rows: DataFrame, key: list[str], n: str, same_as: str) -> DataFrame:
    """rows whose `same_as` names another row of the key take that row's runs (one step, as printed patterns do)."""
    other = rows.select(*key, F.col(n).alias(same_as), F.col("runs").alias("_runs"))
    return rows.join(other, [*key, same_as], "left").withColumn("runs", F.coalesce("_runs", "runs")).drop("_runs")


def row_number_problems(rows: DataFrame, height: DataFrame, key: list[str], n: str, parts: int | None = None) -> DataFrame:
    """key, kind (duplicate, missing, beyond), at: numbers of rows against 1 to height (missing ones one by one); height: a row for each key.

    Numbers that are told and numbers that should be are counted together, dealt by key over `parts` tasks, if given.
    """
    numbers = rows.select(*key, F.col(n).cast("long").alias("at"))
    d = spread(numbers, parts, *key).join(spread(height, parts, *key), key)
    told = d.select(*key, "at", F.lit(1).alias("_told"), ((F.col("at") > F.col("height")) | (F.col("at") < 1)).alias("_beyond"))
    want = height.filter("height >= 1").select(*key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("height").cast("long"))).alias("at"), F.lit(0).alias("_told"), F.lit(False).alias("_beyond"))
    each = spread(told.unionByName(want), parts, *key).groupBy(*key, "at").agg(F.sum("_told").alias("_n"), F.bool_or("_beyond").alias("_beyond"))
    kinds = F.array_compact(F.array(F.when(F.col("_n") > 1, "duplicate"), F.when(F.col("_beyond"), "beyond"), F.when(F.col("_n") == 0, "missing")))
    return each.select(*key, F.explode(kinds).alias("kind"), "at")


def reading_scores(truth: DataFrame, read: DataFrame, key: list[str]) -> DataFrame:
    """key, n_truth, n_read, n_exact, n_relabelled of rows (row, runs): a reading's first printing of a row against the truth.

    Relabelled: equal after codes are renamed by order of first appearance in the row.
    """
    first = read.withColumn("_k", F.row_number().over(Window.partitionBy(*key, "row").orderBy("seq"))).filter("_k = 1").select(*key, "row", F.col("runs").alias("_read"))
    shape = lambda c: F.transform(c, lambda r: F.struct(F.array_position(F.array_distinct(F.transform(c, lambda x: x["code"])), r["code"]).alias("i"), r["count"].alias("n")))
    d = truth.join(first, [*key, "row"], "left")
    return d.groupBy(*key).agg(F.count("*").alias("n_truth"), F.count("_read").alias("n_read"), F.count_if(F.col("runs") == F.col("_read")).alias("n_exact"), F.count_if(shape(F.col("runs")) == shape(F.col("_read"))).alias("n_relabelled"))


def chunks(rows: DataFrame, key: list[str], body: str, most: int) -> DataFrame:
    """key, chunk, body: comma items of a body in pieces of at most `most`."""
    items = F.split(F.col(body), r"\s*,\s*")
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / most) - 1, F.lit(0)).cast("int")), lambda i: F.array_join(F.slice(items, i * most + 1, most), ", "))
    return rows.select(*key, F.posexplode(each).alias("chunk", "body"))


def paths_problems(files: DataFrame, key: str, path: str) -> DataFrame:
    """key, path, kind (unusable, duplicate, nested) of a bundle's paths."""
    bad = files.filter(F.col(path).startswith("/") | F.col(path).rlike(r"(^|/)\.\.?(/|$)|//|\\|^$")).select(key, F.col(path).alias("path"), F.lit("unusable").alias("kind"))
    twice = files.groupBy(key, F.lower(path).alias("_p")).agg(F.count("*").alias("n"), F.min(path).alias("path")).filter("n > 1").select(key, "path", F.lit("duplicate").alias("kind"))
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    parents = files.select(key, F.col(path).alias("path")).withColumn("up", F.explode(up)).filter("up <> path")
    nested = parents.join(files.select(key, F.col(path).alias("up")), [key, "up"], "left_semi").select(key, "path", F.lit("nested").alias("kind")).distinct()
    return bad.unionByName(twice).unionByName(nested)


def default_first(charts: DataFrame, key: list[str], order: str, chosen: str = "is_default") -> DataFrame:
    """charts with place (from 1): the chosen one of a key first, the others in order."""
    return charts.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(chosen), order)))


def section_fitting(sections: DataFrame, height: DataFrame, key: list[str]) -> DataFrame:
    """key, section: the first colour section that ends at a chart's height, else the longest (ties: the first).

    sections: key, section, last_row, n_rows, is_colour; height: key, height.
    """
    d = sections.filter("is_colour").join(height, key)
    fits = F.coalesce(F.col("last_row") == F.col("height"), F.lit(False))
    best = F.struct(fits.alias("fits"), F.when(fits, 0).otherwise(F.col("n_rows")).alias("n"), (-F.col("section")).alias("first"))
    return d.groupBy(*key).agg(F.max_by("section", best).alias("section"))


def chart_versions(stored: DataFrame, manifest: DataFrame, key: list[str]) -> DataFrame:
    """stored (key, variant, gauge_key, id) with status: current, changed (the manifest's chart has another id), or gone."""
    now = manifest.select(*key, "variant", "gauge_key", F.col("id").alias("_now"))
    status = F.when(F.col("_now").isNull(), "gone").when(F.col("_now") == F.col("id"), "current").otherwise("changed")
    return stored.join(now, [*key, "variant", "gauge_key"], "left").withColumn("status", status).drop("_now")


def strided(rows: DataFrame, key: list[str], order: list[str], most: int) -> DataFrame:
    """About `most` rows of each key, evenly by order: every (rows // most)-th."""
    w = Window.partitionBy(*key)
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / most))
    return rows.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_step": step}).filter("_i % _step = 0").drop("_i", "_step")


def covered_part(pages: DataFrame) -> DataFrame:
    """pages (r0, r1, c0, c1 as printed; width, height of the chart; row1 corner) with y0, y1, x0, x1: the part of the grid that a page shows (ends exclusive)."""
    top, bottom = F.least("r0", "r1"), F.greatest("r0", "r1")
    left, right = F.least("c0", "c1"), F.greatest("c0", "c1")
    up, back = F.col("row1").startswith("bottom"), F.col("row1").endswith("right")
    return pages.withColumns({
        "y0": F.when(up, F.col("height") - bottom).otherwise(top - 1), "y1": F.when(up, F.col("height") - top + 1).otherwise(bottom),
        "x0": F.when(back, F.col("width") - right).otherwise(left - 1), "x1": F.when(back, F.col("width") - left + 1).otherwise(right),
    })
