"""Charts as files: JSON documents, CSV grids, OXS (XML) grids and zip bundles, to and from cell tables."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.identity import content_id
from ..operators.runs import chart_stats, code_stats, run_strings, yarn

_TEXT, _INT = T.StringType(), T.LongType()
_RUNS = T.ArrayType(T.StructType([T.StructField("code", _TEXT), T.StructField("count", _INT), T.StructField("x0", _INT)]))
#: The fields of a chart document (unknown ones are ignored; an absent one is null).
CHART = T.StructType([
    T.StructField("schema", _INT),
    T.StructField("pattern", T.StructType([T.StructField(c, _TEXT) for c in ("id", "title", "version", "author", "license", "craft")])),
    T.StructField("chart", T.StructType([T.StructField("id", _TEXT), T.StructField("variant", _TEXT), T.StructField("width", _INT), T.StructField("height", _INT), T.StructField("cell", T.StructType([T.StructField("kind", _TEXT)]))])),
    T.StructField("palette", T.ArrayType(T.StructType([T.StructField("code", _TEXT), T.StructField("name", _TEXT), T.StructField("hex", _TEXT), T.StructField("stitch", T.BooleanType())]))),
    T.StructField("rows", T.ArrayType(_TEXT)),
    T.StructField("technique", T.StructType([T.StructField(c, _TEXT) for c in ("type", "start", "first_side", "rs_direction")])),
    T.StructField("passes", T.ArrayType(T.StructType([T.StructField("label", _TEXT), T.StructField("side", _TEXT), T.StructField("direction", _TEXT), T.StructField("grid_row", _INT), T.StructField("runs", _RUNS)]))),
    T.StructField("written", T.ArrayType(_TEXT)),
    T.StructField("_corrupt_record", _TEXT),
])


def read_charts(spark: SparkSession, path: str) -> DataFrame:
    """Chart documents, one JSON file each, with their file's path; a file that is not JSON has _corrupt_record."""
    return spark.read.schema(CHART).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("path", F.col("_metadata.file_path"))


def chart_rows(charts: DataFrame, id_: Column) -> DataFrame:
    """grid_id, y, runs (run strings) of chart documents."""
    return charts.select(id_.alias("grid_id"), F.posexplode("rows").alias("y", "runs"))


def chart_palette(charts: DataFrame, id_: Column) -> DataFrame:
    """doc, code, name, hex, stitch of chart documents' palettes."""
    return charts.select(id_.alias("doc"), F.explode("palette").alias("p")).select("doc", "p.*")


def chart_documents(runs: DataFrame, palette: DataFrame, title: Column) -> DataFrame:
    """grid_id, id, json of charts: rows as run strings, and a content-addressed id over palette codes and rows."""
    rows = run_strings(runs).groupBy("grid_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("y", "runs"))), lambda x: x["runs"]).alias("rows"))
    width = runs.groupBy("grid_id", "y").agg(F.sum("n").alias("w")).groupBy("grid_id").agg(F.max("w").alias("width"))
    colours = palette.groupBy("grid_id").agg(F.sort_array(F.collect_list(F.struct("code", "name", "hex"))).alias("palette"))
    d = rows.join(width, "grid_id").join(colours, "grid_id").withColumn("id", content_id(codes=F.transform("palette", lambda p: p["code"]), rows=F.col("rows")))
    doc = F.struct(F.lit(2).alias("schema"), F.struct(title.alias("title")).alias("pattern"), F.struct("id", "width", F.size("rows").alias("height")).alias("chart"), "palette", "rows")
    return d.select("grid_id", "id", F.to_json(doc).alias("json"))


def gauge_refusals(meta: DataFrame) -> DataFrame:
    """grid_id, message of charts whose active gauge is not the one that is asked for (meta: grid_id, gauge_key, active_key)."""
    message = F.concat(F.lit("the active gauge is "), F.coalesce("active_key", F.lit("none")), F.lit(", not "), F.col("gauge_key"))
    return meta.filter(~F.col("active_key").eqNullSafe(F.col("gauge_key"))).select("grid_id", message.alias("message"))


def full_documents(runs: DataFrame, palette: DataFrame, meta: DataFrame, ground: DataFrame | None = None) -> DataFrame:
    """grid_id, id, json of whole chart documents: pattern, chart, palette, rows, gauge, technique, stats, and a foundation where one is asked for.

    runs: grid_id, y, run_no, code, n, x0; palette: grid_id, place, code, name, hex; meta: grid_id, slug, title, version,
    craft, variant, gauge_key, active_key, stitches and rows (an inch), unit, cell, boundary (struct kind, chain, color),
    first_stitch_in, technique (struct type, start, first_side, rs_direction); ground: grid_id, code. Absent fields are
    left out. What a document's numbers count follows its cells: stats of stitches are given for stitches alone, a size
    only where gauge and grid count the same thing. Charts of another gauge than the active one are refused.
    """
    kept = meta.join(gauge_refusals(meta).select("grid_id"), "grid_id", "left_anti")
    told = run_strings(runs).groupBy("grid_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("y", "runs"))), lambda x: x["runs"]).alias("_rows"))
    no_stitch = F.lit(None).cast("boolean")
    if ground is not None:
        palette = palette.join(ground.select("grid_id", "code", F.lit(False).alias("stitch")), ["grid_id", "code"], "left")
        no_stitch = F.col("stitch")
    entry = F.struct("place", F.struct("code", "name", "hex", no_stitch.alias("stitch")).alias("e"))
    colours = palette.groupBy("grid_id").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]).alias("_palette"))
    gauge = kept.select("grid_id", "stitches", "rows", "cell", "unit")
    stats = chart_stats(runs, gauge, ground).withColumnRenamed("stitches", "_stitches")
    codes = code_stats(runs, palette.select("grid_id", "code"), ground)
    yards = yarn(codes.select("grid_id", "code", "cells"), gauge)
    as_map = lambda value: F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", value))))
    counted = codes.join(yards, ["grid_id", "code"], "left").groupBy("grid_id").agg(as_map("cells").alias("_counts"), as_map("singles").alias("_singles"), as_map("yards").alias("_yards"), as_map("skeins").alias("_skeins"))
    d = kept.join(told, "grid_id").join(colours, "grid_id").join(stats, "grid_id").join(counted, "grid_id")
    codes_ = F.transform("_palette", lambda p: p["code"])
    d = d.withColumn("id", content_id(codes=codes_, rows=F.col("_rows"), technique=F.col("technique")))
    are_stitches = F.coalesce("cell", F.lit("stitch")) == "stitch"
    numbers = F.struct(
        "cells", F.when(F.col("width_in").isNotNull(), F.array("width_in", "height_in")).alias("size_in"), F.col("_counts").alias("counts"), F.col("_singles").alias("single_stitch_runs"),
        F.struct(F.col("changes_mean").alias("mean"), F.col("changes_max").alias("max"), F.col("changes").alias("per_row")).alias("color_changes_per_row"), F.col("_stitches").alias("stitches"),
        F.when(are_stitches, F.col("_yards")).alias("yards_est"), F.when(are_stitches, F.col("_skeins")).alias("skeins_364yd"),
    )
    over = F.struct(F.lit(4).alias("value"), F.lit("in").alias("unit"))
    doc = F.struct(
        F.when(F.exists("_palette", lambda p: F.coalesce(~p["stitch"], F.lit(False))), 3).otherwise(2).alias("schema"), F.struct(F.col("slug").alias("id"), "title", "version", "craft").alias("pattern"),
        F.struct("id", "variant", "gauge_key", "width", "height", F.when(F.col("cell").isNotNull(), F.struct(F.col("cell").alias("kind"))).alias("cell")).alias("chart"), F.col("_palette").alias("palette"), F.col("_rows").alias("rows"),
        F.struct((F.col("stitches") * 4).alias("stitches"), (F.col("rows") * 4).alias("rows"), over.alias("over"), F.col("gauge_key").alias("stitch"), "unit", "boundary").alias("gauge"), "technique", numbers.alias("stats"),
        F.when(F.col("first_stitch_in").isNotNull(), F.struct((F.col("width") + F.col("first_stitch_in") - 1).alias("chain"), "first_stitch_in")).alias("foundation"),
    )
    return d.select("grid_id", "id", F.to_json(doc).alias("json"))


#: The fields of a manifest (unknown ones are ignored; an absent one is null).
MANIFEST = (
    "schema int, id string, title string, version string, preview string, charts array<struct<id:string,variant:string,gauge_key:string,`default`:boolean,path:string,preview:string,width:bigint,height:bigint>>, "
    "pieces array<struct<id:string,title:string,make:int,chart:string,rows:string,rows_id:string,pages:array<int>>>, assembly array<struct<title:string,text:string,pages:array<int>>>"
)


def manifest_texts(patterns: DataFrame) -> DataFrame:
    """pattern, value: JSON of manifests (columns of MANIFEST but schema, and pattern); schema 2 where there are pieces or assembly, else 1."""
    pieced = F.coalesce(F.size("pieces") > 0, F.lit(False)) | F.coalesce(F.size("assembly") > 0, F.lit(False))
    doc = F.struct(F.when(pieced, 2).otherwise(1).alias("schema"), "id", "title", "version", "preview", "charts", *[F.when(pieced, F.col(c)).alias(c) for c in ("pieces", "assembly")])
    return patterns.select("pattern", F.to_json(doc).alias("value"))


def parsed_manifests(texts: DataFrame) -> DataFrame:
    """texts (value) with manifest: a struct of MANIFEST, null where the text is none. In schema 1 the charts are the pieces, one each, by their order."""
    m = F.from_json("value", MANIFEST)
    d = texts.withColumn("_m", m).withColumn("_ok", F.col("_m.id").isNotNull() & F.col("_m.schema").isin(1, 2))
    kind = "array<struct<id:string,title:string,make:int,chart:string,rows:string,rows_id:string,pages:array<int>>>"
    own = F.transform("_m.charts", lambda c, i: F.struct(F.concat(F.lit("chart-"), (i + 1).cast("string")).alias("id"), c["variant"].alias("title"), F.lit(1).alias("make"), c["id"].alias("chart"), F.lit(None).cast("string").alias("rows"), F.lit(None).cast("string").alias("rows_id"), F.lit(None).cast("array<int>").alias("pages"))).cast(kind)
    pieces = F.when(F.col("_m.schema") == 1, own).otherwise(F.col("_m.pieces"))
    return d.withColumn("manifest", F.when(F.col("_ok"), F.col("_m").withField("pieces", pieces))).drop("_m", "_ok")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """path, manifest of manifest files."""
    return parsed_manifests(spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))).drop("value")


def manifest_parts(manifests: DataFrame, part: str, by: str) -> DataFrame:
    """by, place (from 1) and the fields of a manifest's charts, pieces or assembly."""
    return manifests.filter("manifest IS NOT NULL").select(by, F.posexplode(f"manifest.{part}").alias("_i", "_p")).select(by, (F.col("_i") + 1).alias("place"), "_p.*")


def read_csv_grid(spark: SparkSession, path: str) -> DataFrame:
    """grid_id (the file's path), y, x, code of CSV grids, a line of codes for each row."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("grid_id"), F.posexplode(F.split(F.regexp_replace("value", r"\s+\z", ""), r"\r?\n")).alias("y", "line"))
    return lines.select("grid_id", "y", F.posexplode(F.split("line", ",")).alias("x", "code")).withColumn("code", F.trim("code"))


def csv_grid(cells: DataFrame) -> DataFrame:
    """grid_id, y, value: a line of codes for each row."""
    return cells.groupBy("grid_id", "y").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "code"))), lambda c: c["code"]), ",").alias("value"))


def read_oxs(spark: SparkSession, path: str) -> DataFrame:
    """grid_id (the file's path), y, x, palindex of OXS charts."""
    schema = "_x long, _y long, _palindex long"
    d = spark.read.format("xml").option("rowTag", "stitch").schema(schema).load(path)
    return d.select(F.col("_metadata.file_path").alias("grid_id"), F.col("_y").alias("y"), F.col("_x").alias("x"), F.col("_palindex").alias("palindex"))


def oxs_documents(cells: DataFrame, palette: DataFrame) -> DataFrame:
    """grid_id, value: OXS text. cells: grid_id, y, x, code; palette: code, name, hex, and grid_id if grids have palettes of their own.

    Index 0 is the cloth, colours follow by code. Cells of codes that the palette lacks are left out (`unknown_cells` tells of them).
    """
    by = ["grid_id"] if "grid_id" in palette.columns else []
    index = palette.withColumn("palindex", F.row_number().over(Window.partitionBy(*by).orderBy("code")))  # a palette has at most a few hundred codes
    hexed = F.struct("palindex", "name", F.regexp_replace("hex", "#", "").alias("hex"))
    items = index.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(hexed)), lambda p: F.format_string('<palette_item index="%s" name="%s" color="%s"/>', p["palindex"], p["name"], p["hex"])), "").alias("items"))
    told = cells.join(index.select(*by, "code", "palindex"), [*by, "code"])
    one = F.struct("y", "x", F.format_string('<stitch x="%s" y="%s" palindex="%s"/>', "x", "y", "palindex").alias("s"))
    body = told.groupBy("grid_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda c: c["s"]), "").alias("body"), (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    both = body.join(items, "grid_id") if by else body.crossJoin(F.broadcast(items))
    return both.select("grid_id", F.concat(F.format_string('<?xml version="1.0"?><chart><properties chartwidth="%s" chartheight="%s"/><palette><palette_item index="0" name="cloth" color="FFFFFF"/>', "w", "h"), "items", F.lit("</palette><fullstitches>"), "body", F.lit("</fullstitches></chart>")).alias("value"))


def unknown_cells(cells: DataFrame, palette: DataFrame) -> DataFrame:
    """grid_id, code, n, y, x: codes of cells that the palette (code, and grid_id if it is of each grid) lacks, and the first place of each."""
    by = ["grid_id"] if "grid_id" in palette.columns else []
    lost = cells.join(palette.select(*by, "code"), [*by, "code"], "left_anti")
    return lost.groupBy("grid_id", "code").agg(F.count("*").alias("n"), F.min(F.struct("y", "x")).alias("f")).select("grid_id", "code", "n", "f.y", "f.x")


def unbundled(zips: DataFrame) -> DataFrame:
    """bundle, name, content of the files in zips (bundle, content); names that lead out of the bundle are left out."""

    def unzip(batches):
        for pdf in batches:
            out = []
            for p, content in zip(pdf.bundle, pdf.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    out += [(p, i.filename, z.read(i)) for i in z.infolist() if not i.is_dir() and ".." not in i.filename.split("/")]
            yield pd.DataFrame(out, columns=["bundle", "name", "content"])

    return zips.select("bundle", "content").mapInPandas(unzip, f"bundle {dict(zips.dtypes)['bundle']}, name string, content binary")


def read_bundles(spark: SparkSession, path: str, most_bytes: int = 200 * 1024 * 1024) -> DataFrame:
    """bundle (path), name, content of the files in zip bundles of up to most_bytes; larger ones are left out before they are read."""
    return unbundled(spark.read.format("binaryFile").load(path).filter(F.col("length") <= most_bytes).select(F.col("path").alias("bundle"), "content"))


def bundle_problems(files: DataFrame, manifest: str = "manifest.json") -> DataFrame:
    """bundle, name, kind (no_manifest, lost, unlisted, id) of bundles whose files (bundle, name, content) are not their manifest's.

    The manifest lists charts by path and id; a chart's file holds its id in chart.id.
    """
    text = F.expr("try_validate_utf8(CAST(content AS STRING))")
    listed = files.filter(F.col("name") == manifest).select("bundle", F.explode_outer(F.from_json(text, "charts array<struct<path:string,id:string>>")["charts"]).alias("c")).select("bundle", F.col("c.path").alias("name"), F.col("c.id").alias("want"))
    charts = files.filter(F.col("name") != manifest).select("bundle", "name", F.from_json(text, "chart struct<id:string>")["chart"]["id"].alias("have"), F.lit(True).alias("there"))
    none = files.groupBy("bundle").agg(F.bool_or(F.col("name") == manifest).alias("m")).filter("NOT m").select("bundle", F.lit(manifest).alias("name"), F.lit("no_manifest").alias("kind"))
    d = listed.filter("name IS NOT NULL").withColumn("listed", F.lit(True)).join(charts, ["bundle", "name"], "full").join(none.select("bundle"), "bundle", "left_anti")
    kind = F.when(F.col("there").isNull(), "lost").when(F.col("listed").isNull(), "unlisted").when(~F.col("want").eqNullSafe(F.col("have")), "id")
    return none.unionByName(d.select("bundle", "name", kind.alias("kind")).filter("kind IS NOT NULL"))


def refused_bundles(spark: SparkSession, path: str, most_bytes: int = 200 * 1024 * 1024) -> DataFrame:
    """bundle (path), length of the files that `read_bundles` leaves out; their contents are not read."""
    return spark.read.format("binaryFile").load(path).filter(F.col("length") > most_bytes).select(F.col("path").alias("bundle"), "length")


def bundles(files: DataFrame) -> DataFrame:
    """bundle, content: a stored zip of each bundle's files (bundle, name, content), sorted and dated 1980, so equal files give equal bytes."""

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, content in pdf.sort_values("name")[["name", "content"]].itertuples(index=False):
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
        return pd.DataFrame({"bundle": [key[0]], "content": [out.getvalue()]})

    return files.select("bundle", "name", "content").groupBy("bundle").applyInPandas(pack, f"bundle {dict(files.dtypes)['bundle']}, content binary")


def _png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_grids(cells: DataFrame, palette: DataFrame) -> DataFrame:
    """grid_id, content: a PNG of one pixel a cell. palette: code, hex; two codes of one colour are refused."""
    twice = palette.groupBy("hex").count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError("two codes have one colour, so the picture could not be read back")
    told = cells.join(F.broadcast(palette.select("code", "hex")), "code")  # a palette has at most a few hundred codes
    rows = told.groupBy("grid_id", "y").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", F.regexp_replace("hex", "#", "").alias("h")))), lambda c: c["h"]), "").alias("h"))
    grids = rows.groupBy("grid_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("y", "h"))), lambda r: r["h"]).alias("rows"))

    @F.pandas_udf("binary")
    def draw(many: pd.Series) -> pd.Series:
        def one(lines):
            raw = b"".join(b"\0" + bytes.fromhex(x) for x in lines)
            head = struct.pack(">IIBBBBB", len(lines[0]) // 6, len(lines), 8, 2, 0, 0, 0)
            return b"\x89PNG\r\n\x1a\n" + _png_chunk(b"IHDR", head) + _png_chunk(b"IDAT", zlib.compress(raw, 9)) + _png_chunk(b"IEND", b"")

        return many.map(one)

    return grids.select("grid_id", draw("rows").alias("content"))


def png_pixels(files: DataFrame) -> DataFrame:
    """grid_id, y, x, hex of what png_grids has drawn (grid_id, content)."""

    def read(batches):
        for pdf in batches:
            out = []
            for g, content in zip(pdf.grid_id, pdf.content, strict=True):
                width, height, at, data = *struct.unpack(">II", content[16:24]), 8, b""
                while at < len(content):
                    n, kind = struct.unpack(">I4s", content[at : at + 8])
                    data += content[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
                    at += 12 + n
                raw = zlib.decompress(data)
                for y in range(height):
                    line = raw[y * (3 * width + 1) + 1 : (y + 1) * (3 * width + 1)]
                    out += [(g, y, x, "#" + line[3 * x : 3 * x + 3].hex()) for x in range(width)]
            yield pd.DataFrame(out, columns=["grid_id", "y", "x", "hex"])

    return files.select("grid_id", "content").mapInPandas(read, "grid_id long, y long, x long, hex string")


def read_png_grids(files: DataFrame, palette: DataFrame) -> DataFrame:
    """grid_id, y, x, code of what png_grids has drawn; a colour that the palette (code, hex) lacks gives a null code."""
    return png_pixels(files).join(F.broadcast(palette.select("code", F.lower("hex").alias("hex"))), "hex", "left").select("grid_id", "y", "x", "code")


def png_refusals(files: DataFrame, palette: DataFrame) -> DataFrame:
    """grid_id, y, x, hex, n of pictures with pixels of no colour of the palette: the first one by rows, and how many there are."""
    lost = png_pixels(files).join(F.broadcast(palette.select(F.lower("hex").alias("hex"))), "hex", "left_anti")
    g = lost.groupBy("grid_id").agg(F.min(F.struct("y", "x", "hex")).alias("f"), F.count("*").alias("n"))
    return g.select("grid_id", "f.y", "f.x", "f.hex", "n")


#: Fixed value: a slug that may become a path.
SLUG = r"\A[a-z0-9]+(?:-[a-z0-9]+)*\z"


def feed(charts: DataFrame, slug: Column, title: Column) -> DataFrame:
    """One index row for each pattern: slug, title, n_charts, first chart's id; slugs must be lower-case words with hyphens."""
    d = charts.select(slug.alias("slug"), title.alias("title"), F.col("chart.id").alias("id")).filter(F.col("slug").rlike(SLUG))
    return d.groupBy("slug").agg(F.min("title").alias("title"), F.count("*").alias("n_charts"), F.min("id").alias("first_id"))


def refused_slugs(charts: DataFrame, slug: Column) -> DataFrame:
    """slug, n of charts that `feed` leaves out: a slug becomes a path, so one that is none is refused, not mended."""
    return charts.select(slug.alias("slug")).filter(~F.coalesce(F.col("slug").rlike(SLUG), F.lit(False))).groupBy("slug").agg(F.count("*").alias("n"))


def committed_charts(spark: SparkSession, root: str) -> DataFrame:
    """pattern, chart, path and the document of all charts under root/<pattern>/dist/charts/<chart>/chart.json, to be read in order of path."""
    d = read_charts(spark, f"{root.rstrip('/')}/*/dist/charts/*/chart.json")
    part = lambda i: F.regexp_extract("path", r"([^/]+)/dist/charts/([^/]+)/chart\.json$", i)
    return d.withColumns({"folder": part(1), "file": part(2)})
