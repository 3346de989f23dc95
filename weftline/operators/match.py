"""Matching and lookups: majority votes, nearest palette entries, cross-checks of two readings, k-th to k-th pairing, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import spread, unsized


def majority(left: DataFrame, right: DataFrame, on: list[str], cluster: str, code: str, by: list[str]) -> DataFrame:
    """by, cluster, code, n, share of the code that most often stands where a cluster does (ties: the smaller code)."""
    pairs = left.join(right, on).groupBy(*by, cluster, code).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by, cluster)
    best = pairs.withColumn("_all", F.sum("n").over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.desc("n"), code))).filter("_k = 1")
    return best.select(*by, cluster, code, "n", F.bround(F.col("n") / F.col("_all"), 4).alias("share"))


def match_report(best: DataFrame, clusters: DataFrame, by: list[str], cluster: str, code: str, least: float = 0.9) -> DataFrame:
    """by, kind, at: what stands against the matches of `majority` (by, cluster, code, n, share); clusters: by, cluster.

    `doubtful` (a warning): a cluster whose code holds less than `least` of its cells. `shared`: a code that several
    clusters have; `unmatched`: a cluster that no row reaches. A group with either of these is refused.
    """
    said = lambda d, kind, at: d.select(*by, F.lit(kind).alias("kind"), F.col(at).cast("string").alias("at"))
    twice = best.groupBy(*by, code).agg(F.count("*").alias("_n")).filter("_n > 1")
    lost = clusters.select(*by, cluster).distinct().join(best, [*by, cluster], "left_anti")
    return said(best.filter(F.col("share") < least), "doubtful", cluster).unionByName(said(twice, "shared", code)).unionByName(said(lost, "unmatched", cluster))


def matched_palette(best: DataFrame, report_: DataFrame, key: DataFrame, clusters: DataFrame, by: list[str], cluster: str, code: str) -> DataFrame:
    """by, code, hex, status (new, same, differs, unseen) of the key's codes in groups that are not refused.

    key: by, code, hex (may be null); clusters: by, cluster, hex. A code without a hex takes its cluster's; one that the
    picture shows otherwise keeps its own; one that it does not show stays as it is.
    """
    refused = report_.filter("kind <> 'doubtful'").select(*by).distinct()
    seen = best.join(clusters.select(*by, cluster, F.col("hex").alias("_seen")), [*by, cluster]).select(*by, code, "_seen")
    d = key.join(refused, by, "left_anti").join(seen, [*by, code], "left")
    status = F.when(F.col("_seen").isNull(), "unseen").when(F.col("hex").isNull(), "new").when(F.lower("hex") == F.lower("_seen"), "same").otherwise("differs")
    return d.select(*by, code, F.coalesce("hex", "_seen").alias("hex"), status.alias("status"))


def cross_check(a: DataFrame, b: DataFrame, by: list[str] = ["grid_id"], parts: int | None = None) -> DataFrame:  # noqa: B006
    """by, y, n_differ, first_x of rows where two readings' cells differ (cells that only one has count); joined over `parts` tasks, if given."""
    key = [*by, "y", "x"]
    told = lambda d, name: spread(d.select(*key, F.col("code").alias(name)), parts, *key)
    d = told(a, "_a").join(told(b, "_b"), key, "full").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    return d.groupBy(*by, "y").agg(F.count("*").alias("n_differ"), F.min("x").alias("first_x"))


def nearest(samples: DataFrame, palette: DataFrame, distance: Column, key: str, idx: str, blocks: int = 4, salts: int = 16) -> DataFrame:
    """key, idx, distance of the nearest palette entry (ties: the smaller idx). distance: over columns of both, whose names differ.

    Both tables are dealt out to a lattice of `salts` by `blocks` groups, so a palette of any size is compared in parts;
    a small one goes to all tasks by Spark's own choice. Only the nearest of each part is shuffled.
    """
    s = samples.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts))).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    p = palette.withColumn("_block", F.pmod(F.xxhash64(idx), F.lit(blocks)).cast("int")).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    d = s.join(p, ["_salt", "_block"]).withColumn("_d", distance)
    return d.groupBy(key).agg(F.min(F.struct("_d", idx)).alias("_m")).select(key, F.col(f"_m.{idx}").alias(idx), F.col("_m._d").alias("distance"))


def one_to_one(found: DataFrame, by: list[str], key: str, idx: str, far: float = 25.0) -> DataFrame:
    """by, ok, shared, far: whether each key's nearest entry is its own; entries that several keys claim; keys beyond `far` of theirs.

    found: by, key, idx, distance (of `nearest`).
    """
    claims = found.groupBy(*by, idx).agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.when(F.col("distance") > far, F.col(key)))).alias("_far"))
    d = claims.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col("_n") > 1, F.col(idx)))).alias("shared"), F.array_sort(F.flatten(F.collect_list("_far"))).alias("far"))
    return d.select(*by, (F.size("shared") == 0).alias("ok"), F.array_join("shared", ",").alias("shared"), F.array_join("far", ",").alias("far"))


def kth_to_kth(left: DataFrame, right: DataFrame, key: list[str], left_order: list[str], right_order: list[str], how: str = "inner") -> DataFrame:
    """The k-th row of a key on the left joined to the k-th on the right; adds k."""
    rank = lambda order: F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long")
    return left.withColumn("k", rank(left_order)).join(right.withColumn("k", rank(right_order)), [*key, "k"], how)


def first_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; with a descending order, the last one."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_k = 1").drop("_k")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """old with new's rows in place of those of the same key; the largest `order` of a key wins, new over old."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_wins(both, key, [F.desc("_new"), F.desc(order)]).drop("_new")


def enrich(rows: DataFrame, names: DataFrame, on: str, name: str, other: str) -> DataFrame:
    """rows with `name` replaced by the other table's `other` where that is not empty."""
    return rows.join(names.select(on, F.col(other).alias("_o")), on, "left").withColumn(name, F.coalesce(F.nullif(F.col("_o"), F.lit("")), F.col(name))).drop("_o")


def landmarks(runs: DataFrame, reach: int = 10) -> DataFrame:
    """grid_id, pass_no, run_no, code, offset: the nearest start of a run in the pass before to the end of a run, within reach.

    Runs are paired by blocks of `reach` columns and their neighbours, so no pass is joined with all of another.
    """
    ltr = F.col("direction") == "ltr"
    ends = runs.select("grid_id", "pass_no", "run_no", ltr.alias("ltr"), F.when(ltr, F.col("x0") + F.col("n")).otherwise(F.col("x0")).alias("end"))
    ends = ends.withColumn("_b", F.explode(F.array(*[F.floor(F.col("end") / reach) + i for i in (-1, 0, 1)])))
    side = runs.select("grid_id", "pass_no", "direction").distinct()
    below = runs.select("grid_id", (F.col("pass_no") + 1).alias("pass_no"), "run_no", "code", "x0", "n").join(side, ["grid_id", "pass_no"])
    start = F.when(F.col("direction") == "ltr", F.col("x0")).otherwise(F.col("x0") + F.col("n"))
    below = below.select("grid_id", "pass_no", F.col("run_no").alias("_r"), "code", start.alias("start")).withColumn("_b", F.floor(F.col("start") / reach))
    d = ends.join(below, ["grid_id", "pass_no", "_b"]).withColumn("_d", F.abs(F.col("start") - F.col("end"))).filter(F.col("_d") <= reach)
    best = d.groupBy("grid_id", "pass_no", "run_no").agg(F.min(F.struct("_d", "_r", "code", F.when(F.col("ltr"), F.col("end") - F.col("start")).otherwise(F.col("start") - F.col("end")).alias("offset"))).alias("m"))
    return best.select("grid_id", "pass_no", "run_no", "m.code", F.col("m.offset").alias("offset"))


def mirrors(cells: DataFrame, outer: int | None = None, *, top_bottom: bool = False) -> DataFrame:
    """grid_id, line, n_broken: cells that differ from their reflection, among the outer lines if given.

    Left-right by rows (line is y), or top-bottom by columns (x).
    """
    line, at = ("x", "y") if top_bottom else ("y", "x")
    size = cells.groupBy("grid_id", line).agg((F.max(at) + 1).alias("_w"))
    d = cells.join(size, ["grid_id", line])
    if outer is not None:
        d = d.filter((F.col(at) < outer) | (F.col(at) >= F.col("_w") - outer))
    other = d.select("grid_id", line, (F.col("_w") - 1 - F.col(at)).alias(at), F.col("code").alias("_o"))
    return d.join(other, ["grid_id", line, at]).groupBy("grid_id", line).agg(F.count_if(F.col("code") != F.col("_o")).alias("n_broken"))


def orientation(written: DataFrame, grid: DataFrame, limit: float = 0.1) -> DataFrame:
    """grid_id, height, n_rows (that differ), refused (more than max(1, limit of the rows), rounded up), hint.

    Both: grid_id, y, x, code. The hint of a refused one: flipped_rows, flipped_columns or rotated, if the grid is then
    the same. Each cell is compared in the four positions by one join; nothing is collected.
    """
    size = grid.groupBy("grid_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    d = grid.join(unsized(size), "grid_id")
    up, back = F.col("_h") - 1 - F.col("y"), F.col("_w") - 1 - F.col("x")
    turned = F.array(*[F.struct(F.lit(i).alias("i"), y.alias("y"), x.alias("x")) for i, (y, x) in enumerate(((F.col("y"), F.col("x")), (up, F.col("x")), (F.col("y"), back), (up, back)))])
    four = d.select("grid_id", "_h", F.col("code").alias("_c"), F.explode(turned).alias("t")).select("grid_id", "_h", "_c", "t.*")
    both = four.join(unsized(written.select("grid_id", "y", "x", "code")), ["grid_id", "y", "x"], "left")
    rows = both.groupBy("grid_id", "_h", "i", "y").agg(F.bool_or(~F.col("_c").eqNullSafe(F.col("code"))).alias("_differs"))
    per = rows.groupBy("grid_id", F.col("_h").alias("height"), "i").agg(F.count_if("_differs").alias("n"))
    one = per.groupBy("grid_id", "height").agg(*[F.max(F.when(F.col("i") == i, F.col("n"))).alias(f"_n{i}") for i in range(4)])
    refused = F.col("_n0") > F.greatest(F.lit(1), F.ceil(F.col("height") * limit))
    hint = F.when(F.col("_n1") == 0, "flipped_rows").when(F.col("_n2") == 0, "flipped_columns").when(F.col("_n3") == 0, "rotated")
    return one.select("grid_id", "height", F.col("_n0").alias("n_rows"), refused.alias("refused"), F.when(refused, hint).alias("hint"))


def solid_edge(cells: DataFrame, edge: int = 1) -> DataFrame:
    """grid_id, n_codes, solid: whether the outer cells of all rows have one code."""
    width = cells.groupBy("grid_id", "y").agg((F.max("x") + 1).alias("_w"))
    d = cells.join(width, ["grid_id", "y"]).filter((F.col("x") < edge) | (F.col("x") >= F.col("_w") - edge))
    return d.groupBy("grid_id").agg(F.count_distinct("code").alias("n_codes")).withColumn("solid", F.col("n_codes") == 1)


def overlay(layers: DataFrame, transparent: str | None = None) -> DataFrame:
    """grid_id, y, x, code: for each place the code of the highest z that isn't transparent."""
    d = layers.filter(F.col("code") != transparent) if transparent is not None else layers
    return d.groupBy("grid_id", "y", "x").agg(F.max_by("code", F.struct("z", "code")).alias("code"))
