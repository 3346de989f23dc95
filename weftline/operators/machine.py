"""Folds whose order matters: segments of a pass, replay of logs over written rows, greedy colour clusters.

Segments are array expressions over a pass's runs, replays compositions of moves over blocks of a log. Clusters are a small
function for each group's table of distinct colours, applied by Spark to groups that are partitioned by key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import growing, grown, whole

#: Thresholds of segments.
BRAID_RUNS, BRAID_MOST, LEAST_REPEATS, FILL_CELLS = 8, 4, 3, 20
PERIODS = (2, 3, 4)


def _same_ahead(runs: Column, high: Column, period: int) -> Column:
    """For each run, how many runs from it on equal the run `period` further, before `high`."""
    same = lambda k: (k + period < high) & (F.get(runs, k)["code"] == F.get(runs, k + period)["code"]) & (F.get(runs, k)["n"] == F.get(runs, k + period)["n"])
    back = F.reverse(F.sequence(F.lit(0), F.size(runs) - 1))
    n = lambda a, k: F.when(same(k), a["n"] + 1).otherwise(F.lit(0))
    counted = F.aggregate(back, F.struct(F.lit(0).alias("n"), growing("int").alias("out")), lambda a, k: F.struct(n(a, k).alias("n"), grown(a["out"], n(a, k)).alias("out")))
    return F.reverse(whole(counted["out"]))


def segments(runs: DataFrame) -> DataFrame:
    """grid_id, pass_no, kind, start, end, period, repetitions of each pass (runs: grid_id, pass_no, run_no, code, n).

    Eight short runs at an end are a braid. Between, from left to right: the longest band of at least three repetitions
    of two to four runs that begins at a run (of equal ones, the shortest period), else one run, a fill if it is long.
    """
    d = runs.groupBy("grid_id", "pass_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("run_no", "code", "n"))), lambda r: F.struct(r["code"].alias("code"), r["n"].alias("n"))).alias("runs"))
    n, short = F.size("runs"), lambda a: F.forall(a, lambda r: r["n"] <= BRAID_MOST)
    ends = {
        "low": F.when((n >= BRAID_RUNS) & short(F.slice("runs", 1, BRAID_RUNS)), BRAID_RUNS).otherwise(0),
        "high": F.when((n >= 2 * BRAID_RUNS) & short(F.slice("runs", -BRAID_RUNS, BRAID_RUNS)), n - BRAID_RUNS).otherwise(n),
    }
    d = d.withColumns(ends).withColumns({f"same{p}": _same_ahead(F.col("runs"), F.col("high"), p) for p in PERIODS})
    segment = lambda kind, start, end, period, reps: F.struct(kind.alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"), period.cast("long").alias("period"), reps.cast("long").alias("repetitions"))
    kind_ = "struct<kind:string,start:bigint,end:bigint,period:bigint,repetitions:bigint>"
    none = F.array().cast(f"array<{kind_}>")

    def step(a, i):
        reps = {p: F.lit(1) + F.floor(F.get(F.col(f"same{p}"), i) / p).cast("int") for p in PERIODS}
        bands = F.array(*[F.when(reps[p] >= LEAST_REPEATS, F.struct((reps[p] * p).alias("cells"), F.lit(-p).alias("period"), reps[p].alias("reps"))) for p in PERIODS])
        best = F.array_max(bands)
        one = segment(F.when(F.get("runs", i)["n"] >= FILL_CELLS, "fill").otherwise("run"), i, i + 1, F.lit(0), F.lit(0))
        here = F.when(best.isNotNull(), segment(F.lit("repeat"), i, i + best["cells"], -best["period"], best["reps"])).otherwise(one)
        return F.when((i < a["next"]) | (i >= F.col("high")), a).otherwise(F.struct(here["end"].cast("int").alias("next"), grown(a["out"], here).alias("out")))

    walked = whole(F.aggregate(F.sequence(F.lit(0), n - 1), F.struct(F.col("low").alias("next"), growing(kind_).alias("out")), step)["out"])
    first = F.when(F.col("low") > 0, F.array(segment(F.lit("braid"), F.lit(0), F.col("low"), F.lit(0), F.lit(0)))).otherwise(none)
    last = F.when(F.col("high") < n, F.array(segment(F.lit("braid"), F.col("high"), n, F.lit(0), F.lit(0)))).otherwise(none)
    return d.select("grid_id", "pass_no", F.explode(F.concat(first, walked, last)).alias("s")).select("grid_id", "pass_no", "s.*")


def replay_written(log: DataFrame, last_row: int | None, block: int = 512) -> DataFrame:
    """project, seq, row, finished of a log over written rows: whole rows; the last row finishes in place, an open piece never.

    log: project, seq, action (advance, back, jump), row (of jumps). A jump to a row that isn't there changes nothing.
    Every event moves the position by a step and holds it between two bounds, and two such moves are one again. So the
    events of a block become one move, the moves before a block give the position it begins at, and each block is then
    walked on its own: no log of a project has to be in one place.
    """
    far = 1 << 60
    top = far if last_row is None else last_row  # a finished piece stands one beyond its last row
    move = lambda step, low, high: F.struct(step.alias("step"), low.alias("low"), high.alias("high"))
    n = lambda x: F.lit(x).cast("long")
    target = F.col("row").cast("long")
    there = F.coalesce((target >= 1) & (target <= top), F.lit(False))
    made = F.when(F.col("action") == "advance", move(n(1), n(-far), n(top + 1))).when(F.col("action") == "back", move(n(-1), n(1), n(far + 1))).when(there, move(n(0), target, target)).otherwise(move(n(0), n(-far), n(far + 1)))
    held = lambda x, m: F.least(F.greatest(x + m["step"], m["low"]), m["high"])
    within = lambda x, m: F.least(F.greatest(x, m["low"]), m["high"])
    both = lambda f, g: move(f["step"] + g["step"], within(f["low"] + g["step"], g), within(f["high"] + g["step"], g))
    at = F.floor((F.row_number().over(Window.partitionBy("project").orderBy("seq")) - 1) / block)
    d = log.select("project", "seq", made.alias("m"), at.alias("block"))
    blocks = d.groupBy("project", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "m"))), lambda e: F.struct(e["seq"].alias("seq"), e["m"].alias("m"))).alias("events"))
    whole = F.aggregate("events", move(n(0), n(-far), n(far + 1)), lambda a, e: both(a, e["m"]))
    moves = blocks.select("project", "block", whole.alias("m")).groupBy("project").agg(F.array_sort(F.collect_list(F.struct("block", "m"))).alias("moves"))
    none = F.array().cast("array<struct<block:bigint,start:bigint>>")
    begun = F.aggregate("moves", F.struct(n(1).alias("x"), none.alias("out")), lambda a, b: F.struct(held(a["x"], b["m"]).alias("x"), F.array_append(a["out"], F.struct(b["block"].alias("block"), a["x"].alias("start"))).alias("out")))["out"]
    starts = moves.select("project", F.explode(begun).alias("b")).select("project", "b.*")
    seq = dict(log.dtypes)["seq"]

    def walk(a, e):
        x = held(a["x"], e["m"])
        return F.struct(x.alias("x"), F.array_append(a["out"], F.struct(e["seq"].alias("seq"), x.alias("x"))).alias("out"))

    walked = F.aggregate("events", F.struct(F.col("start").alias("x"), F.array().cast(f"array<struct<seq:{seq},x:bigint>>").alias("out")), walk)["out"]
    out = blocks.join(starts, ["project", "block"]).select("project", F.explode(walked).alias("e"))
    return out.select("project", "e.seq", F.least(F.col("e.x"), n(top)).alias("row"), (F.col("e.x") > top).alias("finished"))


def greedy_clusters(colours: pd.DataFrame, radius: float = 6.0) -> pd.DataFrame:
    """Clusters of distinct points: columns key, n, l, a, b in; key, cluster (by members, most first) and lead out.

    By frequency (ties by key), a point joins the nearest lead within radius that comes before it, or is a lead; a cluster
    of under half a percent of all joins the nearest larger one whose lead is within twice the radius of its own.
    """
    d = colours.sort_values(["n", "key"], ascending=[False, True]).reset_index(drop=True)
    points, place = d[["l", "a", "b"]].to_numpy(float), np.arange(len(d))
    of, nearest = place.copy(), np.full(len(d), np.inf)
    while (free := np.flatnonzero(np.isinf(nearest))).size:  # the first point that no lead reaches is the next lead
        lead = free[0]
        away = np.linalg.norm(points - points[lead], axis=1)
        closer = (place > lead) & (away <= radius) & (away < nearest)
        of[closer], nearest[closer], nearest[lead] = lead, away[closer], 0.0
    members = np.bincount(of, d.n, len(d))
    leads = np.unique(of)
    little = members[leads] < 0.005 * members.sum()
    to = place.copy()
    if little.any() and not little.all():
        away = np.linalg.norm(points[leads[little], None] - points[None, leads[~little]], axis=2)
        near = away.min(1) <= 2 * radius
        to[leads[little][near]] = leads[~little][away.argmin(1)[near]]
    of = to[of]
    members = np.bincount(of, d.n, len(d))
    order = sorted(np.unique(of), key=lambda i: (-members[i], i))
    return pd.DataFrame({"key": d.key, "cluster": pd.Series(of).map({i: k for k, i in enumerate(order)}).astype("int64"), "lead": d.key.to_numpy()[of]})


def cluster_palette(samples: DataFrame, by: str, key: str, lab: list[str], radius: float = 6.0) -> DataFrame:
    """by, key, cluster, lead (the key that stands for it): greedy clusters of each group's distinct points (counted in Spark first, so a group is its palette)."""
    distinct = samples.groupBy(by, F.col(key).alias("key"), *[F.col(c).alias(n) for c, n in zip(lab, "lab", strict=True)]).agg(F.count("*").alias("n"))

    def fold(k, pdf: pd.DataFrame) -> pd.DataFrame:
        out = greedy_clusters(pdf, radius)
        out.insert(0, by, k[0])
        return out

    return distinct.groupBy(by).applyInPandas(fold, f"{by} long, key long, cluster long, lead long")


def rare_clusters(samples: DataFrame, clusters: DataFrame, by: str, key: str, least: float = 0.001) -> DataFrame:
    """by, cluster, n, of: clusters (of cluster_palette: by, key, cluster) that hold less than `least` of a group's samples."""
    n = samples.groupBy(by, F.col(key).alias("key")).agg(F.count("*").alias("_n")).join(clusters, [by, "key"]).groupBy(by, "cluster").agg(F.sum("_n").alias("n"))
    return n.join(n.groupBy(by).agg(F.sum("n").alias("of")), by).filter(F.col("n") < least * F.col("of")).select(by, "cluster", "n", "of")
