"""Tables that are larger than the planner thinks: rows that explode adds are not in its estimates.

By its estimate such a table is as small as the one it was drawn from, so a join would send it whole to the driver and from
there to all tasks, and the few tasks that read the small table would draw it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def unsized(df: DataFrame) -> DataFrame:
    """df, joined by a sorted shuffle whatever its estimate."""
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over four partitions a core, or as many as shuffles have if those are fewer, to be exploded there; joins sort what becomes of it.

    What is made of a key's row stays with it, so aggregates, windows and joins by the keys need no other exchange.
    """
    spark = df.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return unsized(df.repartition(n, *keys))


#: About how many rows of a large table a task is given, and how few are worth a task of their own.
TASK_ROWS, LEAST_ROWS = 200_000, 10_000


def parts(df: DataFrame, each: float = 1.0) -> int:
    """Over how many tasks what is made of a table (`each` rows of every row) is dealt: in proportion to its rows, so a task's rows do not grow with it.

    Left to themselves, exchanges are put together to as many tasks as there are cores, or up to a size in bytes as they are
    compressed, which for short rows is tens of millions of them. Rows of a file are counted from its footer.
    """
    rows = int(df.count() * each)
    return max(1, min(df.sparkSession.sparkContext.defaultParallelism, rows // LEAST_ROWS), -(-rows // TASK_ROWS))


def spread(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """df dealt by keys over n tasks; as it is without n."""
    return df if n is None else df.repartition(n, *keys)
