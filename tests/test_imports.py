"""Files, bundles, manifests and small functions of imports, with odd rows."""

import base64
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.operators import identity, imports, machine, project, runs, sequence, text, validate
from weftline.sources import charts


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_routed(spark):
    d = spark.createDataFrame([("a/x.PNG", 10), ("a/x", 10), ("a.csv/x.doc", 10), ("b.pdf", 300 << 20), (".oxs", 0)], "path string, length long")
    assert rows(imports.routed(d), "path", "kind", "refusal") == [
        (".oxs", "oxs", None), ("a.csv/x.doc", None, "x.doc is of no kind that is read"), ("a/x", None, "x is of no kind that is read"), ("a/x.PNG", "picture", None), ("b.pdf", None, "b.pdf is 300 MB; at most 200 MB are read"),
    ]


def test_picked(spark):
    regions = spark.createDataFrame([("d", 1, 1, 50), ("d", 1, 2, 90), ("d", 2, 1, 90), ("e", 3, 1, 5)], "doc string, page long, region long, cells long")
    wanted = [("d", None, None), ("e", 1, None), ("f", None, None), ("d2", None, 1)]
    got = imports.picked(regions, spark.createDataFrame(wanted, "doc string, want_page long, want_region long"), "doc")
    assert rows(got, "doc", "page", "region", "refusal") == [("d", 1, 2, None), ("d2", None, None, "no grid found on any page"), ("e", None, None, "no grid found on page 1"), ("f", None, None, "no grid found on any page")]
    one = imports.picked(regions, spark.createDataFrame([("d", 1, 3)], "doc string, want_page long, want_region long"), "doc").first()
    assert one.refusal == "no region 3 (have 1 to 2)"


def test_legacy_codes(spark):
    code = lambda x: base64.b64encode(x if isinstance(x, bytes) else json.dumps(x).encode()).decode()
    values = [code({"slug": "s", "row": 3, "run": 1}), code({"slug": "s"}), code(b"\xff\xfe"), "%%%", "", None, code("text")]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, code string")
    got = {r.i: r.progress for r in imports.from_legacy(d).collect()}
    assert got[0].asDict(True) == {"schema": 1, "pattern_id": "s", "chart_id": None, "cursor": {"row": 3, "run": 1}} and all(got[i] is None for i in range(1, 7))


def test_chunks_join_only_across_cuts(spark):
    r = spark.createDataFrame([("k", 0, 0, "A", 2), ("k", 0, 1, "A", 1), ("k", 1, 0, "A", 4), ("k", 1, 1, "B", 1), ("k", 2, 0, "A", 1)], "k string, chunk long, run_no long, code string, n long")
    assert rows(imports.joined_chunks(r, ["k"]), "run_no", "code", "n") == [(0, "A", 2), (1, "A", 5), (2, "B", 1), (3, "A", 1)]


def test_relabelled(spark):
    r = spark.createDataFrame([(1, 0, 0, "Q"), (1, 0, 1, "B"), (1, 1, 0, "Q"), (2, 0, 0, "B")], "g long, y long, run_no long, code string")
    assert rows(imports.relabelled(r, ["g"], ["y", "run_no"]), "g", "y", "run_no", "code") == [(1, 0, 0, "A"), (1, 0, 1, "B"), (1, 1, 0, "A"), (2, 0, 0, "A")]


@pytest.mark.parametrize(("body", "want"), [("8 A", True), ("3G", True), ("A 23", True), ("White x 46", True), ("(Black) 3 sc", True), ("(RS) 3 sc", False), ("ch 1, turn", False), ("sc in next 4 sts", False), ("", False), (None, False), ("part, 3 sc", False), ("A (7)", True)])
def test_names_colour(spark, body, want):
    assert spark.createDataFrame([(body,)], "b string").select(text.names_colour(F.col("b"))).first()[0] is want


def test_sentences(spark):
    d = spark.createDataFrame([(1, -2), (0, 0), (None, None), (0, 3)], "a long, b long").select(text.shaping_sentence(F.col("a"), F.col("b")).alias("s"))
    assert [r.s for r in d.collect()] == ["add 1 stitch at the start, leave 2 stitches at the end", None, None, "add 3 stitches at the end"]
    d = spark.createDataFrame([(9, "A", None, True), (9, None, None, False), (None, "A", "B", True)], "r long, j string, l string, s boolean").select(text.look_ahead_sentence(*map(F.col, "rjls")).alias("t"))
    assert [r.t for r in d.collect()] == ["From row 9: A joins, plain rows", None, None]


def test_live_activity(spark):
    cells = spark.createDataFrame([(1, y, x, c) for y, row in enumerate(["AB" * 6, "AAAABBBBBBBB"]) for x, c in enumerate(row)], "grid_id long, y long, x long, code string")
    p = sequence.passes(runs.rle_encode(cells), start="top", rs_direction="ltr", rounds=True)
    segments = machine.segments(p.filter("pass_no = 2")).unionByName(spark.createDataFrame([(1, 1, "repeat", 0, 12, 2, 6)], "grid_id long, pass_no long, kind string, start long, end long, period long, repetitions long"))
    cursors = spark.createDataFrame([("a", 1, 1, 5, 0), ("b", 1, 1, 12, 0), ("c", 1, 2, 1, 3), ("d", 1, 2, 2, 0)], "project string, grid_id long, row long, run long, stitch long")
    got = {r.project: r for r in project.live_activity(cursors, p, segments).collect()}
    assert (got["a"].code, got["a"].next, got["a"].cells_done, got["a"].repetition, got["a"].repetitions) == ("B", "A", 5, 3, 6)
    assert (got["b"].code, got["b"].next, got["b"].at_boundary, got["b"].finished, got["b"].percent) == (None, "A", True, False, 50.0)
    assert (got["c"].cells_done, got["c"].last_in_row, got["c"].percent) == (19, True, 79.2) and (got["d"].finished, got["d"].percent, got["d"].at_boundary) == (True, 100.0, False)


def test_sizes_and_collisions(spark):
    palette = spark.createDataFrame([("a", str(i)) for i in range(256)] + [("b", "A")], "doc string, code string")
    size = spark.createDataFrame([("a", 1, 1), ("b", 0, None), ("c", 2, 2)], "doc string, width long, height long")
    assert rows(validate.size_problems(palette, size), "doc", "rule", "at") == [("a", "palette_size", "256"), ("b", "height", ""), ("b", "width", "0"), ("c", "palette_size", "0")]
    names = spark.createDataFrame([("k", "A/b"), ("k", "a/B"), ("k", "a/B"), ("k", "c"), ("l", "C"), ("k", None)], "k string, path string")
    assert rows(identity.case_collisions(names, ["k"], "path"), "k", "path", "spellings") == [("k", "A/b", 2)]


def test_committed_charts_and_manifests(spark, tmp_path):
    for p, c in (("one", "x"), ("one", "y"), ("two", "x")):
        f = tmp_path / "patterns" / p / "dist" / "charts" / c
        f.mkdir(parents=True)
        (f / "chart.json").write_text(json.dumps({"schema": 2, "chart": {"id": f"{p}-{c}"}}))
    (tmp_path / "patterns" / "one" / "dist" / "chart.json").write_text("{}")
    assert rows(charts.committed_charts(spark, str(tmp_path / "patterns")).select("folder", "file", F.col("chart.id").alias("id")), "folder", "file", "id") == [("one", "x", "one-x"), ("one", "y", "one-y"), ("two", "x", "two-x")]
    (tmp_path / "a.json").write_text(json.dumps({"schema": 1, "id": "p", "title": "t", "version": "1", "charts": [{"id": "c1", "variant": "final", "default": True}]}, indent=2))
    (tmp_path / "b.json").write_text("[]")
    read = charts.read_manifests(spark, str(tmp_path / "*.json"))
    assert rows(charts.manifest_parts(read, "pieces", "path"), "place", "title", "make", "chart") == [(1, "final", 1, "c1")] and read.filter("manifest IS NULL").count() == 1


def test_whole_documents_are_read_again(spark, tmp_path):
    cells = spark.createDataFrame([(1, y, x, c) for y, r in enumerate(["NAAN", "AABB"]) for x, c in enumerate(r)], "grid_id long, y long, x long, code string")
    palette = spark.createDataFrame([(1, i, c, c.lower(), "#00000" + str(i)) for i, c in enumerate("NAB")], "grid_id long, place int, code string, name string, hex string")
    kind = "grid_id long, slug string, title string, version string, craft string, variant string, gauge_key string, active_key string, stitches double, rows double, unit string, cell string, boundary struct<kind:string,chain:int,color:string>, first_stitch_in int, technique struct<type:string,start:string,first_side:string,rs_direction:string>"
    meta = spark.createDataFrame([(1, "s", "T", "1", None, "final", "sc", "sc", 4.0, 5.0, None, None, None, 2, ("rows", "bottom-right", "RS", "rtl"))], kind)
    ground = spark.createDataFrame([(1, "N")], "grid_id long, code string")
    r = charts.full_documents(runs.rle_encode(cells), palette, meta, ground).first()
    d = json.loads(r.json)
    assert d["schema"] == 3 and d["chart"] == {"id": r.id, "variant": "final", "gauge_key": "sc", "width": 4, "height": 2} and d["foundation"] == {"chain": 5, "first_stitch_in": 2}
    assert d["stats"]["counts"] == {"A": 4, "B": 2} and d["stats"]["cells"] == 6 and d["stats"]["size_in"] == [1.0, 0.4] and d["stats"]["color_changes_per_row"] == {"mean": 0.5, "max": 1, "per_row": [0, 1]}
    assert [p["code"] for p in d["palette"]] == ["N", "A", "B"] and d["palette"][0]["stitch"] is False and d["gauge"]["stitches"] == 16 and "boundary" not in d["gauge"]
    (tmp_path / "c.json").write_text(r.json)
    back = charts.read_charts(spark, str(tmp_path)).first()
    assert back.rows == ["1N2A1N", "2A2B"] and back.technique.first_side == "RS"
    other = meta.withColumn("active_key", F.lit("dc"))
    assert charts.full_documents(runs.rle_encode(cells), palette, other).count() == 0 and charts.gauge_refusals(other).first().message == "the active gauge is dc, not sc"


def test_bundles_against_their_manifests(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("manifest.json", json.dumps({"charts": [{"path": "c/1.json", "id": "a"}, {"path": "c/2.json", "id": "b"}]}))
        z.writestr("c/1.json", json.dumps({"chart": {"id": "other"}}))
        z.writestr("c/3.json", b"\xff not json")
        z.writestr("../out.json", "{}")
    with zipfile.ZipFile(tmp_path / "n.zip", "w") as z:
        z.writestr("c/1.json", "{}")
    found = charts.bundle_problems(charts.read_bundles(spark, str(tmp_path)))
    assert rows(found.withColumn("bundle", F.substring_index("bundle", "/", -1)), "bundle", "name", "kind") == [("b.zip", "c/1.json", "id"), ("b.zip", "c/2.json", "lost"), ("b.zip", "c/3.json", "unlisted"), ("n.zip", "manifest.json", "no_manifest")]


def test_feed(spark):
    d = spark.createDataFrame([("ok-1", "B", ("i2",)), ("ok-1", "A", ("i1",)), ("Bad", "x", ("i",)), ("../up", "x", ("i",)), (None, "x", ("i",))], "slug string, title string, chart struct<id:string>")
    assert rows(charts.feed(d, F.col("slug"), F.col("title")), "slug", "title", "n_charts", "first_id") == [("ok-1", "A", 2, "i1")]
    assert rows(charts.refused_slugs(d, F.col("slug")), "slug", "n") == [("../up", 1), ("Bad", 1), (None, 1)]


def test_refused_pixels(spark):
    cells = spark.createDataFrame([(1, y, x, c) for y, r in enumerate(["AB", "BA"]) for x, c in enumerate(r)], "grid_id long, y long, x long, code string")
    palette = spark.createDataFrame([("A", "#ff0000"), ("B", "#00FF00")], "code string, hex string")
    assert rows(charts.png_refusals(charts.png_grids(cells, palette), palette.filter("code = 'A'")), "grid_id", "y", "x", "hex", "n") == [(1, 0, 1, "#00ff00", 2)]
