"""Arrays that a fold puts together, item by item, without copying all of them each time.

Spark's arrays do not change, so appending to one copies it. A growing array is kept as full chunks and a last one, so
an item costs a copy of one chunk, and one of the list of chunks now and then.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def growing(kind: str) -> Column:
    """An empty growing array of a type."""
    return F.struct(F.array().cast(f"array<array<{kind}>>").alias("full"), F.array().cast(f"array<{kind}>").alias("last"))


def grown(a: Column, item: Column) -> Column:
    """a growing array with one item more."""
    more = F.struct(a["full"].alias("full"), F.array_append(a["last"], item).alias("last"))
    return F.when(F.size(a["last"]) < CHUNK, more).otherwise(F.struct(F.array_append(a["full"], a["last"]).alias("full"), F.array(item).alias("last")))


def whole(a: Column) -> Column:
    """The items of a growing array."""
    return F.concat(F.flatten(a["full"]), a["last"])
