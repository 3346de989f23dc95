"""An event log as a sink that may be given a batch again, and what the log says of its projects.

The log is the only thing that is written. A project's cursor and whether it is finished are projections of it, so they can
never disagree with it, whatever fails between two writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.publish import exists, publish

#: Kinds of events that un-finish a piece, and the one that finishes it.
REOPENS, FINISH = ("back", "jump"), "finish"
KEY = ["project", "seq"]


def new_events(batch: DataFrame, log: DataFrame | None, key: list[str] = KEY) -> DataFrame:
    """Events of a batch that are not in the log, each once (of events with one key the earliest).

    log has a column day; an event that comes again has its time, so only the batch's days are read of the log.
    """
    w = Window.partitionBy(*key).orderBy("t", F.xxhash64(*batch.columns))
    fresh = batch.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k").withColumn("day", F.to_date("t"))
    if log is None:
        return fresh
    days = [r["day"] for r in batch.select(F.to_date("t").alias("day")).distinct().collect()]  # a row a day
    return fresh.join(log.filter(F.col("day").isin(days)).select(*key, "day"), [*key, "day"], "left_anti")


def append(batch: DataFrame, batch_id: int, path: str, key: list[str] = KEY) -> bool:
    """Add a batch's new events to the log at path (project, seq, t, ...); False if this batch is in it already.

    A batch is one folder, put there by one rename, so a batch that is delivered twice or fails midway changes nothing.
    """
    spark = batch.sparkSession
    name = f"batch_id={batch_id}"
    if exists(spark, f"{path}/{name}"):
        return False
    return publish({"": new_events(batch, read_log(batch, path), key)}, path, name, partition_by={"": ["day"]})


def read_log(like: DataFrame, path: str) -> DataFrame | None:
    """The log at path, with batch_id and day; None where no batch has been written."""
    spark = like.sparkSession
    if not exists(spark, path):
        return None
    types = ", ".join(f"`{n}` {t}" for n, t in like.dtypes if n not in ("batch_id", "day"))
    return spark.read.schema(f"{types}, batch_id bigint, day date").option("basePath", path).parquet(path)


def append_stream(events: DataFrame, path: str, checkpoint: str, *, late: str = "1 day", key: list[str] = KEY) -> DataStreamWriter:
    """A stream of events (project, seq, t, ...) into the log at path; events later than the watermark are dropped.

    Repeats within the watermark are dropped in the stream's state, older ones by the log itself.
    """
    once = events.withWatermark("t", late).dropDuplicatesWithinWatermark(key)
    return once.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, i: append(batch, i, path, key))


def state(log: DataFrame, by: list[str] = ["project"]) -> DataFrame:  # noqa: B006
    """by, row, run, stitch (the cursor), last_worked, finished (a time or null), n_events.

    log: by, seq, t, kind, row, run, stitch. The cursor is the last event's. A piece is finished by its last finishing
    event, unless a step back or a jump comes after it. Three aggregates by maximum, so nothing is sorted.
    """
    order = F.struct("t", "seq")
    ends, opens = F.col("kind") == FINISH, F.col("kind").isin(*REOPENS)
    last = F.max_by(F.struct("row", "run", "stitch"), order)
    d = log.groupBy(*by).agg(last.alias("_c"), F.max("t").alias("last_worked"), F.max(F.when(ends, order)).alias("_done"), F.max(F.when(opens, order)).alias("_open"), F.count("*").alias("n_events"))
    finished = F.when(F.col("_open").isNull() | (F.col("_done") > F.col("_open")), F.col("_done.t"))
    return d.select(*by, "_c.row", "_c.run", "_c.stitch", "last_worked", finished.alias("finished"), "n_events")
