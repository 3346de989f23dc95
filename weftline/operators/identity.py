"""Content-addressed ids, duplicates and drift between two versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_id(**fields: Column) -> Column:
    """sha256: of the fields as JSON with sorted keys and no spaces; a null field is left out."""
    ordered = F.struct(*[c.alias(k) for k, c in sorted(fields.items())])
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(ordered), 256))


def duplicates(df: DataFrame, id_: Column, key: str) -> DataFrame:
    """id, n, first_key of contents that occur more than once."""
    return df.groupBy(id_.alias("id")).agg(F.count("*").alias("n"), F.min(key).alias("first_key")).filter("n > 1")


def drift(old: DataFrame, new: DataFrame, key: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """key, status (missing, stale, differs), columns of rows that differ: new lacks them, only new has them, or by value.

    Rows that repeat a key are compared with all of the other side's rows of that key.
    """
    columns = [c for c in old.columns if c in new.columns and c not in key and c not in ignore]
    a = old.select(*key, F.struct(*columns).alias("_a"))
    b = new.select(*key, F.struct(*columns).alias("_b"))
    d = a.join(b, key, "full")
    changed = F.filter(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "stale").when(F.size(changed) > 0, "differs")
    return d.withColumn("status", status).filter("status IS NOT NULL").select(*key, "status", F.when(F.col("status") == "differs", F.array_join(changed, ",")).otherwise("").alias("columns"))


def case_collisions(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, spellings: values that differ in case alone, by the first of their spellings. A warning, not a duplicate."""
    d = rows.select(*by, F.col(value).alias("_v")).filter("_v IS NOT NULL").distinct()
    return d.groupBy(*by, F.lower("_v").alias("_l")).agg(F.min("_v").alias(value), F.count("*").alias("spellings")).filter("spellings > 1").drop("_l")
