"""Tables that become visible as a whole or not at all: staged beside their place, then put there by one rename.

Paths may be in any file system that Spark reads; a rename must be atomic there (as in HDFS and local ones).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder, beside what is published, in which tables are staged; Spark's readers pass over its name.
STAGING = "_staging"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def publish(tables: dict[str, DataFrame], root: str, name: str, *, partition_by: dict[str, list[str]] | None = None) -> bool:
    """Write each table as Parquet under root/name/<its name>; False, and nothing is written, if root/name is there already.

    All are written to a staging folder first. The only visible step is its rename to root/name: a failure before leaves
    nothing there, and a writer that comes second gives up its copy.
    """
    spark = next(iter(tables.values())).sparkSession
    root = root.rstrip("/")
    if exists(spark, f"{root}/{name}"):
        return False
    staged = f"{root}/{STAGING}/{uuid.uuid4().hex}"
    source, fs = _hadoop(spark, staged)
    try:
        for table, df in tables.items():
            df.write.partitionBy(*(partition_by or {}).get(table, [])).parquet(f"{staged}/{table}" if table else staged)
        target = _hadoop(spark, f"{root}/{name}")[0]
        fs.mkdirs(target.getParent())
        return not fs.exists(target) and fs.rename(source, target)
    finally:
        fs.delete(source, True)


def publish_valid(documents: dict[str, DataFrame], problems: DataFrame, root: str, name: str, doc: str = "doc") -> tuple[bool, DataFrame]:
    """Publish the tables' documents without a problem; (whether it was published, the problems of those that were refused).

    documents: tables with a column doc; problems: doc, rule, at, message, of `validate`'s rules. What a refused document
    has in any table is left out of all. Problems are written beside the tables, once, so rules run once.
    """
    spark = problems.sparkSession
    root = root.rstrip("/")
    told = f"{root}/{STAGING}/problems-{uuid.uuid4().hex}"
    problems.write.parquet(told)
    try:
        refused = spark.read.schema(problems.schema).parquet(told)
        bad = refused.select(F.col("doc").alias(doc)).distinct()
        done = publish({t: df.join(bad, doc, "left_anti") for t, df in documents.items()} | {"refused": refused}, root, name)
    finally:
        path, fs = _hadoop(spark, told)
        fs.delete(path, True)
    return done, spark.read.schema(problems.schema).parquet(f"{root}/{name}/refused")
