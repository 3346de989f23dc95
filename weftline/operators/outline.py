"""The outline of a document: charts paired with their rows, the rows that are left as pieces, and pages that no piece uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .islands import ranges


def paired(charts: DataFrame, sections: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, chart, section: the k-th chart of a height and the k-th colour section whose last row is that height.

    charts: doc, chart, page, x0, rows; sections: doc, section, is_colour, last_row. A full join keeps what is left on
    either side, with null for the other; sections that are no colour rows are not asked.
    """
    rank = lambda w: F.row_number().over(w)
    c = charts.select(doc, "chart", F.col("rows").alias("_h"), rank(Window.partitionBy(doc, "rows").orderBy("page", "x0", "chart")).alias("_k"))
    s = sections.filter("is_colour").select(doc, "section", F.col("last_row").alias("_h"), rank(Window.partitionBy(doc, "last_row").orderBy("section")).alias("_k"))
    return c.join(s, [doc, "_h", "_k"], "full").select(doc, "chart", "section")


def section_titles(sections: DataFrame, headings: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, section, title: the k-th heading of a page titles the k-th section that starts there.

    sections: doc, section, first_page; headings: doc, page, k (from 1), title.
    """
    k = F.row_number().over(Window.partitionBy(doc, "first_page").orderBy("section"))
    return sections.select(doc, "section", F.col("first_page").alias("page"), k.alias("k")).join(headings, [doc, "page", "k"]).select(doc, "section", "title")


def outline(charts: DataFrame, sections: DataFrame, headings: DataFrame, documents: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, place (from 1), kind (chart, rows, assembly), chart, section, title, pages (sorted array).

    charts: doc, chart, page, x0, rows; sections: doc, section, is_colour, last_row, first_page, pages (array); headings:
    doc, page, k, title; documents: doc, page_count. Pieces stand by their first page, charts before rows, in reading
    order; runs of pages after the first used one that no piece uses follow as assembly.
    """
    pairs, titles = paired(charts, sections, doc), section_titles(sections, headings, doc)
    number = F.row_number().over(Window.partitionBy(doc).orderBy("page", "x0", "chart"))
    named = sections.join(titles, [doc, "section"], "left")
    with_rows = pairs.filter("chart IS NOT NULL AND section IS NOT NULL").join(named.select(doc, "section", "title", F.col("pages").alias("_pages")), [doc, "section"])
    c = charts.withColumn("_n", number).join(with_rows, [doc, "chart"], "left")
    told = F.coalesce("title", F.concat(F.lit("Chart "), F.col("_n").cast("string"), F.lit(" (page "), F.col("page").cast("string"), F.lit(")")))
    pages = F.array_sort(F.array_distinct(F.concat(F.array(F.col("page").cast("long")), F.coalesce("_pages", F.array().cast("array<bigint>")))))
    chart_pieces = c.select(doc, F.lit("chart").alias("kind"), "chart", "section", told.alias("title"), pages.alias("pages"), F.lit(0).alias("_kind"), F.col("_n").cast("long").alias("_order"))
    alone = named.join(with_rows.select(doc, "section"), [doc, "section"], "left_anti").filter("last_row IS NOT NULL AND size(pages) > 0")
    told = F.coalesce("title", F.concat(F.lit("Rows, page "), F.element_at(F.array_sort("pages"), 1).cast("string"), F.lit(", R 1-"), F.col("last_row").cast("string")))
    row_pieces = alone.select(doc, F.lit("rows").alias("kind"), F.lit(None).cast(dict(charts.dtypes)["chart"]).alias("chart"), "section", told.alias("title"), F.array_sort(F.array_distinct("pages")).cast("array<bigint>").alias("pages"), F.lit(1).alias("_kind"), F.col("section").cast("long").alias("_order"))
    pieces = chart_pieces.unionByName(row_pieces)
    used = pieces.select(doc, F.explode("pages").alias("page")).distinct()
    span = used.groupBy(doc).agg(F.min("page").alias("_first")).join(documents, doc).filter("_first < page_count")
    every = span.select(doc, F.explode(F.sequence(F.col("_first") + 1, F.col("page_count").cast("long"))).alias("page"))
    runs = ranges(every.join(used, [doc, "page"], "left_anti"), [doc], "page")
    told = F.when(F.col("start") == F.col("end"), F.concat(F.lit("Page "), F.col("start").cast("string"))).otherwise(F.concat(F.lit("Pages "), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))
    none = lambda name: F.lit(None).cast(dict(pieces.dtypes)[name]).alias(name)
    assembly = runs.select(doc, F.lit("assembly").alias("kind"), none("chart"), none("section"), told.alias("title"), F.sequence("start", "end").alias("pages"), F.lit(2).alias("_kind"), F.col("start").alias("_order"))
    first = F.when(F.col("_kind") < 2, F.element_at("pages", 1)).otherwise(F.lit(None).cast("long"))
    w = Window.partitionBy(doc).orderBy(first.asc_nulls_last(), "_kind", "_order")
    return pieces.unionByName(assembly).withColumn("place", F.row_number().over(w).cast("long")).select(doc, "place", "kind", "chart", "section", "title", "pages")
