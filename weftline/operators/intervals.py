"""Intervals against intervals: overlap joins by levels of blocks, and two run tables laid over each other.

Intervals are closed: [start, end], whole or floating-point numbers; an interval whose end is before its start meets nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import spread

#: Levels of block widths, and how much wider each is than the one before. Longer intervals are listed in all their blocks of the last level.
LEVELS, WIDER = 7, 8


def _level(start: Column, end: Column, unit: float) -> Column:
    """The first level whose blocks are at least as wide as the interval, so that it meets two blocks there at most."""
    out = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        out = F.when(end - start <= unit * WIDER**k, k).otherwise(out)
    return out


def _blocks(at: Column, level: Column, unit: float) -> Column:
    return F.floor(at / (F.lit(float(unit)) * F.pow(F.lit(float(WIDER)), level)))


def overlapping(left: DataFrame, right: DataFrame, key: list[str], left_at: tuple[str, str], right_at: tuple[str, str], unit: float = 1.0, parts: int | None = None) -> DataFrame:
    """Pairs of rows of one key whose intervals meet, all columns of both (names must differ but for the key).

    Every interval has a level by its length. A pair is looked for in the blocks of the longer one's level alone, where
    neither has more than two blocks, by an equality join on key, level and block; it comes out of its home block, the one
    where the later start lies, so it comes once. Nothing is paired that does not share a block as wide as the longer of
    the two. `unit`: the width of the first level, about the length of short intervals; `parts`: over how many tasks blocks are
    dealt, where pairs are many more than rows.
    """

    def listed(df: DataFrame, at: tuple[str, str], own: bool, above: bool, side: str) -> DataFrame:
        start, end = F.col(at[0]), F.col(at[1])
        d = df.filter(start <= end).withColumn("_own", _level(start, end, unit))
        levels = F.array("_own") if own and not above else F.sequence(F.col("_own") + (0 if own else 1), F.lit(LEVELS - 1))
        if not own:
            d = d.filter(F.col("_own") < LEVELS - 1)
        d = d.withColumn("_level", F.explode(levels))
        d = d.withColumn("_block", F.explode(F.sequence(_blocks(start, F.col("_level"), unit), _blocks(end, F.col("_level"), unit))))
        return spread(d.drop("_own").withColumn(f"_s{side}", start), parts, *key, "_level", "_block")

    a, b = (left_at, "a"), (right_at, "b")
    on = [*key, "_level", "_block"]
    first = listed(left, a[0], True, False, "a").join(listed(right, b[0], True, True, "b"), on)
    second = listed(left, a[0], False, True, "a").join(listed(right, b[0], True, False, "b"), on)
    meets = (F.col(left_at[0]) <= F.col(right_at[1])) & (F.col(right_at[0]) <= F.col(left_at[1]))
    home = F.col("_block") == _blocks(F.greatest("_sa", "_sb"), F.col("_level"), unit)
    return first.unionByName(second).filter(meets & home).drop("_level", "_block", "_sa", "_sb")


def overlaid(a: DataFrame, b: DataFrame, row: tuple[str, ...] = ("grid_id", "y"), parts: int | None = None) -> DataFrame:
    """Row columns, x0, n, a, b: two run tables laid over each other, a piece for each stretch on which neither changes.

    Both: row columns, x0, n, code; the runs of a row do not overlap. a and b are the codes, in_a and in_b whether the
    table has a run there. Runs give two edges each, so one exchange (over `parts` tasks, if given) and one sort by the row
    serve; no cell is made.
    """

    def edges(runs: DataFrame, mine: str, other: str) -> DataFrame:
        start, end = F.col("x0").cast("long"), (F.col("x0") + F.col("n")).cast("long")
        state = F.struct(F.col("code").alias("code"), end.alias("end"))
        kind = state.alias(mine)
        none = F.lit(None).cast(f"struct<code:{dict(runs.dtypes)['code']},end:bigint>")
        both = F.array(F.struct(start.alias("at"), kind), F.struct(end.alias("at"), none.alias(mine)))
        return runs.filter("n > 0").select(*row, F.explode(both).alias("e")).select(*row, "e.at", f"e.{mine}").withColumn(other, none)

    events = spread(edges(a, "_a", "_b").unionByName(edges(b, "_b", "_a")), parts, *row)
    w = Window.partitionBy(*row).orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = events.select(*row, "at", F.lead("at").over(w).alias("_next"), F.last("_a", ignorenulls=True).over(upto).alias("_a"), F.last("_b", ignorenulls=True).over(upto).alias("_b"))
    here = lambda c: F.coalesce(F.col(f"{c}.end") > F.col("at"), F.lit(False))
    d = d.filter(F.col("_next") > F.col("at")).withColumns({"in_a": here("_a"), "in_b": here("_b")}).filter("in_a OR in_b")
    return d.select(*row, F.col("at").alias("x0"), (F.col("_next") - F.col("at")).alias("n"), F.when(F.col("in_a"), F.col("_a.code")).alias("a"), F.when(F.col("in_b"), F.col("_b.code")).alias("b"), "in_a", "in_b")


def differing_runs(a: DataFrame, b: DataFrame, row: tuple[str, ...] = ("grid_id", "y"), parts: int | None = None) -> DataFrame:
    """Row columns, x0, n, a, b of maximal stretches where two run tables differ in the same way (a code that only one has is null in the other)."""
    d = overlaid(a, b, row, parts).filter((F.col("in_a") != F.col("in_b")) | ~F.col("a").eqNullSafe(F.col("b")))
    w = Window.partitionBy(*row).orderBy("x0")
    state = F.struct("a", "b", "in_a", "in_b")
    joins = F.lag(state).over(w).eqNullSafe(state) & (F.lag(F.col("x0") + F.col("n")).over(w) == F.col("x0"))
    d = d.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*row, "_i", "a", "b").agg(F.min("x0").alias("x0"), F.sum("n").alias("n")).select(*row, "x0", "n", "a", "b")


def cross_check_runs(a: DataFrame, b: DataFrame, by: list[str] = ["grid_id"], parts: int | None = None) -> DataFrame:  # noqa: B006
    """What `match.cross_check` gives of cells, from runs: by, y, n_differ, first_x; rows go out in proportion to runs."""
    row = (*by, "y")
    d = overlaid(a, b, row, parts).filter((F.col("in_a") != F.col("in_b")) | ~F.col("a").eqNullSafe(F.col("b")))
    return d.groupBy(*row).agg(F.sum("n").alias("n_differ"), F.min("x0").alias("first_x"))


def covered(runs: DataFrame, inside: DataFrame, row: list[str], parts: int | None = None) -> DataFrame:
    """runs (row columns, code, x0, n) with matched: how many of a run's cells the other table's runs have with its code.

    Runs may overlap each other; `inside` is a table of row columns, code, x0, n whose runs of a row do not. What lies before
    a run's two ends is a running sum over both tables, so one exchange by the row (over `parts` tasks, if given) serves, and
    nothing is paired.
    """
    key, long = [*row, "code"], lambda c: F.col(c).cast("long")
    x0, n = long("x0"), F.greatest(F.coalesce(long("n"), F.lit(0)), F.lit(0))
    ends = F.explode(F.array(F.struct(F.lit(False).alias("end"), x0.alias("at")), F.struct(F.lit(True).alias("end"), (x0 + n).alias("at"))))
    asked = runs.select(*key, F.struct(*runs.columns).alias("_run"), ends.alias("_e")).select(*key, "_run", F.col("_e.end").alias("_end"), F.col("_e.at").alias("_at"), F.lit(None).cast("long").alias("_n"))
    own = inside.filter("n > 0").dropna(subset=key).select(*key, F.lit(None).cast(asked.schema["_run"].dataType).alias("_run"), F.lit(None).cast("boolean").alias("_end"), x0.alias("_at"), long("n").alias("_n"))
    upto = Window.partitionBy(*key).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    # All runs that begin before a place, less what the last of them has beyond it.
    beyond = F.last(F.col("_at") + F.col("_n"), ignorenulls=True).over(upto) - F.col("_at")
    before = F.coalesce(F.sum("_n").over(upto) - F.greatest(F.lit(0), beyond), F.lit(0))
    d = spread(asked.unionByName(own), parts, *row).withColumn("_before", before).filter("_end IS NOT NULL")
    g = d.groupBy(*key, "_run").agg((F.max(F.when(F.col("_end"), F.col("_before"))) - F.max(F.when(~F.col("_end"), F.col("_before")))).cast("long").alias("matched"), F.count_if("_end").cast("int").alias("_times"))
    return g.select(F.explode(F.array_repeat("_run", F.col("_times"))).alias("_run"), "matched").select("_run.*", "matched")
