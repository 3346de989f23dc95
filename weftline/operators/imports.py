"""What is done with files before they are charts: where each goes, which grid is taken, what its pages say, old progress codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of files by their endings, the most bytes of one, the side of a chart of one pixel a cell, words that pages are searched for.
KINDS = {"oxs": "oxs", "csv": "csv", "pdf": "pdf", **dict.fromkeys(("png", "jpg", "jpeg", "gif", "bmp", "webp"), "picture")}
MOST_BYTES, MOST_PIXELS = 200 * 1024 * 1024, 512
HINTS = ("key", "gauge", "hook", "row 1", "materials", "finished", "measure")


def routed(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """files (path, length) with kind (null if refused) and refusal; contents are not read."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ending = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), ending)
    large = F.concat(name, F.lit(" is "), F.bround(F.col("length") / (1 << 20), 0).cast("long").cast("string"), F.lit(f" MB; at most {most_bytes >> 20} MB are read"))
    refusal = F.when(F.col("length") > most_bytes, large).when(kind.isNull(), F.concat(name, F.lit(" is of no kind that is read")))
    return files.withColumns({"kind": F.when(refusal.isNull(), kind), "refusal": refusal})


def as_pixels(pictures: DataFrame, regions: DataFrame, by: str) -> DataFrame:
    """pictures (by, width, height) with pixels: whether a picture is a chart of one pixel a cell.

    It is small, and its first grid (regions: by, region, x0, y0, x1, y1; the smallest number) covers less than half of it.
    """
    first = regions.groupBy(by).agg(F.min_by((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), "region").alias("_area"))
    d = pictures.join(first, by, "left")
    small = F.greatest("width", "height") <= MOST_PIXELS
    return d.withColumn("pixels", small & (F.col("_area").isNull() | (2 * F.col("_area") < F.col("width") * F.col("height")))).drop("_area")


def crop_box(pictures: DataFrame, box: Column) -> DataFrame:
    """pictures (width, height) with x0, y0, x1, y1 of a box struct<x0, y0, x1, y1> in parts of the page, half-even; the whole page where it is null."""
    edge = lambda c, side, whole: F.coalesce(F.bround(box[c] * F.col(side), 0).cast("long"), whole)
    return pictures.withColumns({"x0": edge("x0", "width", F.lit(0).cast("long")), "y0": edge("y0", "height", F.lit(0).cast("long")), "x1": edge("x1", "width", F.col("width").cast("long")), "y1": edge("y1", "height", F.col("height").cast("long"))})


def on_page(found: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """found (by, x0, y0, x1, y1 inside the crop box of its page) in the page's own places; boxes: by, x0, y0 of the box."""
    at = boxes.select(*by, F.col("x0").alias("_ox"), F.col("y0").alias("_oy"))
    moved = {c: F.col(c) + F.coalesce(F.col("_ox" if c[0] == "x" else "_oy"), F.lit(0)) for c in ("x0", "y0", "x1", "y1")}
    return found.join(at, by, "left").withColumns(moved).drop("_ox", "_oy")


def picked(regions: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """by, page, region, refusal: the grid that is taken of each document's.

    regions: by, page, region, cells; wanted: by, want_page, want_region (null: any). The largest of the wanted page, or
    the first of the wanted number; ties go by page, then number. One aggregate: only the best of a document is kept.
    """
    any_page = F.col("want_page").isNull() | (F.col("page") == F.col("want_page"))
    fits = any_page & (F.col("want_region").isNull() | (F.col("region") == F.col("want_region")))
    order = F.struct(F.when(F.col("want_region").isNull(), F.col("cells")).otherwise(F.lit(0)).alias("c"), (-F.col("page")).alias("p"), (-F.col("region")).alias("r"))
    d = wanted.join(regions, by, "left")
    g = d.groupBy(by, "want_page", "want_region").agg(F.max(F.when(fits, order)).alias("_o"), F.count("page").alias("_n"), F.count_if(any_page & F.col("page").isNotNull()).alias("_on"), F.max(F.when(any_page, F.col("region"))).alias("_most"))
    lost = F.when(F.col("_n") == 0, "no grid found on any page").when(F.col("_on") == 0, F.concat(F.lit("no grid found on page "), F.col("want_page").cast("string")))
    lost = F.coalesce(lost, F.when(F.col("_o").isNull(), F.concat(F.lit("no region "), F.col("want_region").cast("string"), F.lit(" (have 1 to "), F.col("_most").cast("string"), F.lit(")"))))
    return g.select(by, (-F.col("_o.p")).alias("page"), (-F.col("_o.r")).alias("region"), lost.alias("refusal"))


def page_hints(pages: DataFrame, key: list[str], text: str = "text", words: tuple[str, ...] = HINTS) -> DataFrame:
    """key, hints: which of the words each page's text has, in their order; pages without any are left out."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return pages.select(*key, found.alias("hints")).filter(F.size("hints") > 0)


def staged(pages: DataFrame, grids: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, n_pages, found (the sentence on the grid), hints: what is asked of whoever reads a document's text.

    pages: doc, page, text; grids: doc, width, height, colours (no row: no grid was found).
    """
    hints = page_hints(pages, [doc, "page"]).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page", "hints"))).alias("_h"))
    told = F.array_join(F.transform("_h", lambda h: F.concat(F.lit("page "), h["page"].cast("string"), F.lit(": "), F.array_join(h["hints"], ", "))), "; ")
    d = pages.groupBy(doc).agg(F.count("*").alias("n_pages")).join(grids, doc, "left").join(hints, doc, "left")
    found = F.when(F.col("width").isNull(), "no grid").otherwise(F.concat(F.col("width").cast("string"), F.lit(" x "), F.col("height").cast("string"), F.lit(", "), F.col("colours").cast("string"), F.lit(" colours")))
    return d.select(doc, "n_pages", found.alias("found"), F.coalesce(F.when(F.col("_h").isNotNull(), told), F.lit("")).alias("hints"))


def from_legacy(codes: DataFrame, code: str = "code") -> DataFrame:
    """codes with progress: a document with a cursor alone, of an old base64 code of slug, row and run; null for one that is none."""
    raw = F.expr(f"try_to_binary(`{code}`, 'base64')")
    old = F.from_json(F.expr("try_validate_utf8(CAST(_raw AS STRING))"), "slug string, row long, run long")
    d = codes.withColumn("_raw", raw).withColumn("_o", old)
    doc = F.struct(F.lit(1).alias("schema"), F.col("_o.slug").alias("pattern_id"), F.lit(None).cast("string").alias("chart_id"), F.struct(F.col("_o.row").alias("row"), F.col("_o.run").alias("run")).alias("cursor"))
    whole = F.col("_o.slug").isNotNull() & F.col("_o.row").isNotNull() & F.col("_o.run").isNotNull()
    return d.withColumn("progress", F.when(whole, doc)).drop("_raw", "_o")


def relabelled(runs: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """runs with code replaced by A, B, ... in the order in which a group's codes first appear."""
    from .text import code_name

    first = runs.groupBy(*by, "code").agg(F.min(F.struct(*order)).alias("_f"))
    ranks = first.select(*by, "code", code_name((F.row_number().over(Window.partitionBy(*by).orderBy("_f")) - 1).cast("int")).alias("_c"))
    return runs.join(ranks, [*by, "code"]).withColumn("code", F.col("_c")).drop("_c")


def joined_chunks(runs: DataFrame, key: list[str]) -> DataFrame:
    """key, run_no, code, n of runs read in chunks (key, chunk, run_no, code, n): a run that a cut has parted is one again.

    Neighbours of one code are added only across a cut; inside a chunk they stay as they were read.
    """
    w = Window.partitionBy(*key).orderBy("chunk", "run_no")
    parted = (F.lag("code").over(w) == F.col("code")) & (F.lag("chunk").over(w) != F.col("chunk"))
    d = runs.withColumn("_i", F.when(parted, 0).otherwise(1))
    d = d.withColumn("_i", F.sum("_i").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*key, "_i", "code").agg(F.sum("n").alias("n")).select(*key, (F.col("_i") - 1).alias("run_no"), "code", "n")
