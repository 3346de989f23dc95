"""Grammars of written rows as rows of a table: which pattern a source's items have, where colour and count stand, how rows widen.

A grammar has: source; item, a regular expression of one item; codes and counts, the groups that may hold the colour and the
count (the first that does; without a count it is 1); layout, `flat` (all rows have one width) or `corner` (rows widen by one
from the first and narrow after the peak).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "source string, item string, codes array<int>, counts array<int>, layout string"
_NAME = r"[A-Za-z][A-Za-z ]*?"
#: This library's grammars, by the way they write twelve of a colour called White (W).
GRAMMARS = [
    ("12 W", r"(?<![A-Za-z0-9])([0-9]+)\s*([A-Z]{1,3})(?![A-Za-z0-9])", [2], [1], "flat"),
    ("W12", r"(?<![A-Za-z0-9])([A-Za-z]{1,3})([0-9]+)(?![A-Za-z0-9])", [1], [2], "flat"),
    ("W (12)", r"(?<![A-Za-z0-9])([A-Za-z]{1,3})\s*\(([0-9]+)\)", [1], [2], "flat"),
    ("W 12", r"(?<![A-Za-z0-9])([A-Z]{1,3})\s+([0-9]+)(?![A-Za-z0-9])", [1], [2], "flat"),
    ("W x 12", rf"(?:^|,)\s*(?:\(({_NAME})\)|({_NAME}))(?:\s*x\s*([0-9]+))?\s*(?=,|\.?$)", [1, 2], [3], "corner"),
    ("12 sc in W", rf"([0-9]+)\s*(?:sc|dc)\s+(?:in|with)\s+({_NAME}|[A-Za-z][0-9])\s*(?=,|\.?$)", [2], [1], "flat"),
    ("sc 12 in W", rf"(?:sc|dc)\s+([0-9]+)\s+(?:in|with)\s+({_NAME})\s*(?=,|\.?$)", [2], [1], "flat"),
    ("(W) sc 12", rf"\(({_NAME})\)\s*(?:sc|dc)\s*([0-9]+)", [1], [2], "flat"),
    ("12W", r"([0-9]+)([A-Za-z]{1,3})", [2], [1], "flat"),
    ("W, 12 tiles", r"([A-Z]{1,3}),\s*([0-9]+)\s+tiles?", [1], [2], "corner"),
]


def grammar_table(spark: SparkSession, grammars=GRAMMARS) -> DataFrame:
    return F.broadcast(spark.createDataFrame(grammars, SCHEMA))  # as long as a list of the driver


def _groups(body: Column, item: Column, groups: str) -> Column:
    """For each item of a body, the first of the groups that is not empty, or null."""
    got = lambda i: F.transform(F.regexp_extract_all(body, item, F.get(groups, i)), lambda x: F.nullif(F.trim(x), F.lit("")))
    return F.when(F.size(groups) > 1, F.zip_with(got(0), got(1), lambda a, b: F.coalesce(a, b))).otherwise(got(0))


def parsed(lines: DataFrame, grammars: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    """key, source, layout, run_no, code, n: the runs of lines (key, source, body) by their source's grammar, neighbours of one code merged.

    A source without a grammar gives nothing. The table of grammars is as long as there are sources: Spark sends it to all
    tasks or shuffles it, by its size.
    """
    d = lines.join(grammars, "source").withColumn("_codes", _groups(F.col(body), F.col("item"), "codes")).withColumn("_counts", _groups(F.col(body), F.col("item"), "counts"))
    items = d.select(*key, "source", "layout", F.posexplode(F.zip_with("_codes", "_counts", lambda c, n: F.struct(F.upper(c).alias("code"), F.coalesce(n.try_cast("long"), F.lit(1).cast("long")).alias("n")))).alias("_i", "r"))
    items = items.select(*key, "source", "layout", "_i", "r.*").filter("code IS NOT NULL AND n > 0")
    w = Window.partitionBy(*key, "source").orderBy("_i")
    d = items.withColumn("_new", F.when(F.lag("code").over(w) == F.col("code"), 0).otherwise(1)).withColumn("run_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return d.groupBy(*key, "source", "layout", "run_no", "code").agg(F.sum("n").alias("n"))


def expected_width(row: Column, peak: Column) -> Column:
    """Of a row worked from corner to corner: one more a row up to the peak, then one less."""
    return F.when(row <= peak, row).otherwise(2 * peak - row)


def width_problems(runs: DataFrame, doc: str, row: str) -> DataFrame:
    """doc, row, width, expected of rows whose width is not what their layout asks for.

    runs: of `parsed`, key (doc, row). `flat`: the width that most rows of the document have (ties: the smaller);
    `corner`: by the widest row. Rows are summed first, so windows are over rows alone.
    """
    rows = runs.groupBy(doc, row, "layout").agg(F.sum("n").alias("width"))
    usual = rows.groupBy(doc, "width").agg(F.count("*").alias("_n")).groupBy(doc).agg(F.max_by("width", F.struct("_n", -F.col("width"))).alias("_usual"), F.max("width").alias("_peak"))
    d = rows.join(usual, doc).withColumn("expected", F.when(F.col("layout") == "corner", expected_width(F.col(row), F.col("_peak"))).otherwise(F.col("_usual")))
    return d.filter("width <> expected").select(doc, row, "width", F.col("expected").cast("long").alias("expected"))


def running_peaks(runs: DataFrame, doc: str, row: str) -> DataFrame:
    """doc, row, width, peak (the widest row so far), narrowing: whether a row before was wider. For rows that come one by one."""
    rows = runs.groupBy(doc, row).agg(F.sum("n").alias("width"))
    w = Window.partitionBy(doc).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("peak", F.max("width").over(w)).withColumn("narrowing", F.col("width") < F.col("peak"))


def _canonical(runs: DataFrame, doc: str, row: str) -> DataFrame:
    """runs with code replaced by the number of its first appearance in the document."""
    first = runs.groupBy(doc, "code").agg(F.min(F.struct(row, "run_no")).alias("_f"))
    ranks = first.select(doc, "code", F.dense_rank().over(Window.partitionBy(doc).orderBy("_f")).alias("_c"))
    return runs.join(ranks, [doc, "code"]).withColumn("code", F.col("_c").cast("string")).drop("_c")


def reading_figures(read: DataFrame, truth: DataFrame, errors: DataFrame, widths: DataFrame, doc: str = "doc", row: str = "row") -> DataFrame:
    """doc, truth, read, errors, duplicates, exact, raw, missing, sums_ok of a reading against the truth.

    read and truth: doc, row, copy (of rows printed more than once, from 1; the first wins), run_no, code, n; errors: doc,
    row; widths: doc, width. exact: rows that are the same as they are, or after codes are numbered as they appear in each
    table, whichever are more. Rows are compared by a hash of their runs, one row of each a group.
    """
    told = F.sort_array(F.collect_list(F.struct("run_no", "code", "n")))

    def listed(d: DataFrame, name: str) -> DataFrame:
        return d.groupBy(doc, row).agg(F.sha2(F.to_json(told), 256).alias(name), F.sum("n").alias(f"{name}_sum"))

    first = lambda d: d.filter("copy = 1")
    got, want = first(read), first(truth)
    d = listed(want, "_t").join(listed(got, "_g"), [doc, row], "full").join(listed(_canonical(want, doc, row), "_tc"), [doc, row], "left").join(listed(_canonical(got, doc, row), "_gc"), [doc, row], "left").join(widths, doc, "left")
    in_truth, in_read = F.col("_t").isNotNull(), F.col("_g").isNotNull()
    figures = d.groupBy(doc).agg(
        F.count_if(in_truth).alias("truth"), F.count_if(in_read).alias("read"), F.count_if(F.col("_t") == F.col("_g")).alias("raw"), F.count_if(F.col("_tc") == F.col("_gc")).alias("_same"),
        F.count_if(in_truth & ~in_read).alias("missing"), F.count_if(in_truth & (F.col("_g_sum") == F.col("width"))).alias("sums_ok"),
    )
    wrong = errors.groupBy(doc).agg(F.count("*").alias("errors"))
    again = read.select(doc, row, "copy").filter("copy > 1").distinct().groupBy(doc).agg(F.count("*").alias("duplicates"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return figures.join(wrong, doc, "left").join(again, doc, "left").select(doc, "truth", "read", zero("errors"), zero("duplicates"), F.greatest("raw", "_same").alias("exact"), "raw", "missing", "sums_ok")
