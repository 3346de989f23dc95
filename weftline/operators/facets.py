"""Counts of values by field and stratum, in one aggregate over one unpivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a field says where it says nothing.
ABSENT = ("", "no", "none", "n/a", "unstated")


def share_text(n: Column, m: Column) -> Column:
    """n/m (p%), without a percentage of nothing; halves go to the even number."""
    p = F.bround(100 * n / F.nullif(m, F.lit(0)), 0).cast("long")
    return F.concat(n.cast("string"), F.lit("/"), m.cast("string"), F.when(m > 0, F.concat(F.lit(" ("), p.cast("string"), F.lit("%)"))).otherwise(F.lit("")))


def facet_counts(rows: DataFrame, fields: list[str], strata: dict[str, Column]) -> DataFrame:
    """stratum, field, value (null for null), n, m (rows of the stratum), share, rank (by n, ties by value; null last).

    strata: names and conditions, that may overlap. A row becomes one for each stratum it is in and field; these are added
    up where they are made, and only counts are shuffled.
    """
    member = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in strata.items()]))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    d = rows.select(F.explode(member).alias("stratum"), pairs.alias("p")).select("stratum", F.explode("p").alias("p")).groupBy("stratum", "p.field", "p.value").agg(F.count("*").alias("n"))
    every = Window.partitionBy("stratum", "field")
    d = d.withColumn("m", F.sum("n").over(every)).withColumn("rank", F.row_number().over(every.orderBy(F.desc("n"), F.col("value").asc_nulls_last())).cast("long"))
    return d.withColumn("share", share_text(F.col("n"), F.col("m")))


def top_values(counts: DataFrame) -> DataFrame:
    """stratum, field, value, share of the most frequent values of `facet_counts`."""
    return counts.filter("rank = 1").select("stratum", "field", "value", "share")


def present(counts: DataFrame, absent: tuple[str, ...] = ABSENT) -> DataFrame:
    """stratum, field, n, m, share: rows whose field says something."""
    says = F.coalesce(~F.col("value").isin(*absent), F.lit(False))
    d = counts.groupBy("stratum", "field").agg(F.sum(F.when(says, F.col("n")).otherwise(0)).alias("n"), F.max("m").alias("m"))
    return d.withColumn("share", share_text(F.col("n"), F.col("m")))


def listed_values(rows: DataFrame, by: list[str], text: str, item: str = ";", pair: str = "=") -> DataFrame:
    """by, name, value, n: counts of the items of texts such as dc=3; sc=1, or of a plain value under no name."""
    items = F.filter(F.transform(F.split(text, item), lambda x: F.trim(x)), lambda x: x != "")
    d = rows.select(*by, F.explode(items).alias("_x"))
    named = F.instr("_x", pair) > 0
    name, value = F.when(named, F.trim(F.substring_index("_x", pair, 1))), F.trim(F.when(named, F.expr(f"substr(_x, instr(_x, '{pair}') + 1)")).otherwise(F.col("_x")))
    return d.select(*by, name.alias("name"), value.alias("value")).groupBy(*by, "name", "value").agg(F.count("*").alias("n"))


def section_counts(sections: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, n_sections, n_rows: a section (doc, rows: an array) without numbered rows counts as one."""
    return sections.groupBy(doc).agg(F.count("*").alias("n_sections"), F.sum(F.greatest(F.lit(1), F.coalesce(F.size("rows"), F.lit(0)))).cast("long").alias("n_rows"))
