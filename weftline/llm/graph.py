"""Connected components of a graph given as a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Links that one task may hold (two rounds leave as many at most).
FEW = 20_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches. Nodes without links are not in the result.

    Up to FEW links are handled in one partition, without exchanges. Beyond that, every round is two shuffles of the links
    with partial minima, written to the shared folder, so a hub with a large part of all links never meets in one task's
    memory, and the rounds are logarithmic in a component's diameter.
    Null ends are dropped; a link from a node to itself makes a component of one.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u IS NOT NULL").distinct()
    e = materialise(e, "links")
    few = e.limit(FEW + 1).count() <= FEW
    one = (lambda d: d.coalesce(1)) if few else (lambda d: d)
    pair = lambda u, v, x, y: F.explode(F.array(F.struct(u.alias(x), v.alias(y)), F.struct(v.alias(x), u.alias(y))))
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    state, written = None, e
    while True:
        e = one(e)
        both = e.filter("u <> v").select(pair(u, v, "u", "v").alias("x")).select("x.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(v.alias("u"), m.alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(v.alias("u"), m.alias("v")), F.struct(u.alias("u"), m.alias("v")))).alias("x")).select("x.*")
        before, e = written, materialise(one(small.filter("u <> v").unionByName(e.filter("u = v"))).distinct(), "links")
        discard(before)
        written = e
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    nodes = one(e).select(F.explode(F.array(F.struct(u.alias("node"), v.alias("component")), F.struct(v.alias("node"), v.alias("component")))).alias("x")).select("x.*")
    return nodes.groupBy("node").agg(F.min("component").alias("component"))
