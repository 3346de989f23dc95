"""Parsers, grammars, facets, robust figures, outlines and masks on small cases with known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import facets, grammar, noise, outline, prose, shapes, text


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


KEY = [("White", "A"), ("Pale Rose", "B"), ("Charcoal", "ch"), ("Rose", "D")]


@pytest.mark.parametrize(("body", "width", "want"), [
    ("ch 1, turn, 8 sc in white, sc 4 in Pale Rose, 2 inc, 1 dec (15 sts)", None, [("A", 8), ("B", 9)]),
    ("(Pale Rose), (White) x 13, a2, b3, a", None, [("B", 1), ("A", 15), ("B", 3), ("A", 1)]),
    ("8 sc in c1, 9sc with C2, 3 sc in color 4, 2 sc of colour 9", None, [("A", 8), ("B", 9), ("D", 5)]),
    ("3 A, *2 B, (1 A, 1 D) twice; rep from * to last 2 sts, 2 D", 17, [("A", 3), ("B", 2), ("A", 1), ("D", 1), ("A", 1), ("D", 1), ("B", 2), ("A", 1), ("D", 1), ("A", 1), ("D", 3)]),
    ("*1 A, 1 B; repeat from * to the end", 6, [("A", 1), ("B", 1)] * 3),
    ("*1 A, 1 B; repeat from * to the end", None, [("A", 1), ("B", 1)]),
    ("ch 3, 4 ch, 2 Charcoal, ch", None, [("ch", 7)]),  # a colour called ch, and a chain
    ("4 rose, 2 pale rose", None, [("D", 4), ("B", 2)]),  # the longest name wins
    ("Join in a new colour, 3 a", None, [("A", 3)]),
    ("((1 A, 2 B) x 2, 1 D) 2 times", None, [("A", 1), ("B", 2), ("A", 1), ("B", 2), ("D", 1)] * 2),
    ("[(White) x 3, 1 B] 2 x", None, [("A", 3), ("B", 1)] * 2),
    ("(14 boxes)", None, []), ("turn", None, []), ("", None, []), ("5 sc", None, [("", 5)]),
    ("* 2 A, 1 B", None, [("A", 2), ("B", 1)]), (") ] 2 A ( 1 B", None, [("A", 2), ("B", 1)]),  # unbalanced marks
    ("A (12), B x 3, D 4.", None, [("A", 12), ("B", 3), ("D", 4)]),
])
def test_rows_by_the_documents_key(body, width, want):
    assert prose.expand(body, width, KEY) == want


def test_limits_refuse_and_never_cut():
    assert prose.expand("(1 A, 1 B) 501 times") is None
    assert prose.expand("(" * 30 + "1 A" + ")" * 30) is None
    assert prose.expand(", ".join(f"1 {'AB'[i % 2]}" for i in range(5001))) is None
    assert len(prose.expand(", ".join(f"1 {'AB'[i % 2]}" for i in range(5000)))) == 5000


def test_random_bodies_expand_as_built():
    """Bodies made of nested groups, each spelled in one of several ways, give the runs they were made of."""
    rng = random.Random(7)

    def made(depth):
        runs, said = [], []
        for _ in range(rng.randint(1, 3)):
            if depth and rng.random() < 0.4:
                inner, t = made(depth - 1)
                k = rng.randint(1, 3)
                runs += inner * k
                said.append(f"({t}) {k} times" if k != 2 else f"[{t}] twice")
            else:
                (name, code), n = rng.choice(KEY), rng.randint(1, 20)
                runs.append((code, n))
                said.append(rng.choice([f"{n} {code}", f"{n} sc in {name}", f"({name}) x {n}", f"{name} x {n}", f"sc {n} with {name}", f"({name}) sc {n}"]))
        return runs, ", ".join(said)

    for _ in range(300):
        runs, said = made(3)
        want = []
        for code, n in runs:
            if want and want[-1][0] == code:
                want[-1] = (code, want[-1][1] + n)
            else:
                want.append((code, n))
        assert prose.expand(said, None, KEY) == want, said


def test_expanded_runs_with_and_without_a_key(spark):
    d = spark.createDataFrame([(1, "2 a, (White) x 3", [("White", "A")]), (2, "2 A, 1 b", None), (3, None, None), (4, "(1 A) 900 times", None)], "i long, body string, key array<struct<name:string,code:string>>")
    got = {r.i: r.x if r.x is None else [tuple(c) for c in r.x] for r in d.select("i", prose.expanded_runs(F.col("body"), F.lit(None).cast("int"), F.col("key")).alias("x")).collect()}
    assert got == {1: [("A", 5)], 2: [("A", 2), ("B", 1)], 3: [], 4: None}


def test_codes_of_the_rows_own_text_are_kept(spark):
    names = spark.createDataFrame([(1, "White", "A")], "doc long, name string, code string")
    read = spark.createDataFrame([(1, 1, 0, "white", 2, "2 A, 3 Zz, 1 zz"), (1, 1, 1, "zz", 3, "2 A, 3 Zz, 1 zz"), (1, 1, 2, "ZZ", 1, "2 A, 3 Zz, 1 zz"), (1, 1, 3, "q", 9, "2 A, 3 Zz, 1 zz"), (1, 2, 0, "q", 1, None)], "doc long, row long, i long, code string, n long, own string")
    assert rows(text.clean_runs(read, ["doc", "row"], "i", names, "doc", own="own"), "row", "run_no", "code", "n") == [(1, 0, "A", 2), (1, 1, "Zz", 4)]


def test_grammars(spark):
    lines = spark.createDataFrame([
        (1, "W x 12", "(Duck Egg) x 24, blue x 2, (Pale Rose), White x 14."), (2, "12W", "12A3B3B"), (3, "(W) sc 12", "(green) sc 10, (red) sc2"), (4, "12 sc in W", "8 sc in c1, 9 dc with c2"),
        (5, "W, 12 tiles", "A, 3 tiles; A, 1 tile; B, 2 tiles"), (6, "nobody's", "12 A"), (7, "12 W", None), (8, "12 W", "nothing here"), (9, "W 12", "A 3, B 4, A1"),
    ], "row long, source string, body string")
    got = {}
    for r in grammar.parsed(lines, grammar.grammar_table(spark), ["row"]).orderBy("row", "run_no").collect():
        got.setdefault(r.row, []).append((r.code, r.n))
    assert got == {
        1: [("DUCK EGG", 24), ("BLUE", 2), ("PALE ROSE", 1), ("WHITE", 14)], 2: [("A", 12), ("B", 6)], 3: [("GREEN", 10), ("RED", 2)], 4: [("C1", 8), ("C2", 9)], 5: [("A", 4), ("B", 2)], 9: [("A", 3), ("B", 4)],
    }


def test_corner_widths(spark):
    runs = lambda widths, layout: [(1, i, layout, 0, "A", w) for i, w in enumerate(widths, 1)]
    kind = "doc long, row long, layout string, run_no long, code string, n long"
    bad = lambda w, layout: rows(grammar.width_problems(spark.createDataFrame(runs(w, layout), kind), "doc", "row"), "row", "width", "expected")
    assert bad([1, 2, 3, 4, 3, 2, 1], "corner") == [] and bad([1, 2, 4, 3, 2], "corner") == [(3, 4, 3), (4, 3, 4), (5, 2, 3)]
    assert bad([5, 5, 6, 5], "flat") == [(3, 6, 5)] and bad([5, 6], "flat") == [(2, 6, 5)]


def test_reading_figures(spark):
    kind = "doc long, row long, copy int, run_no long, code string, n long"
    truth = spark.createDataFrame([(1, 1, 1, 0, "A", 2), (1, 1, 1, 1, "B", 3), (1, 2, 1, 0, "B", 5), (1, 3, 1, 0, "A", 5)], kind)
    read = spark.createDataFrame([(1, 1, 1, 0, "X", 2), (1, 1, 1, 1, "Y", 3), (1, 2, 1, 0, "Y", 5), (1, 2, 2, 0, "Y", 9), (1, 4, 1, 0, "X", 1)], kind)
    errors = spark.createDataFrame([(1, 4), (1, 9)], "doc long, row long")
    widths = spark.createDataFrame([(1, 5)], "doc long, width long")
    r = grammar.reading_figures(read, truth, errors, widths).first()
    assert (r.truth, r.read, r.errors, r.duplicates, r.exact, r.raw, r.missing, r.sums_ok) == (3, 3, 2, 1, 2, 0, 1, 2)


def test_facets(spark):
    d = spark.createDataFrame([(1, "a", None), (2, "a", "unstated"), (3, "b", ""), (4, "b", "x")], "i long, f string, g string")
    c = facets.facet_counts(d, ["f", "g"], {"all": F.lit(True), "late": F.col("i") > 2, "never": F.lit(False), "unknown": F.lit(None).cast("boolean")})
    assert rows(c.filter("field = 'f'"), "stratum", "value", "n", "m", "rank", "share") == [("all", "a", 2, 4, 1, "2/4 (50%)"), ("all", "b", 2, 4, 2, "2/4 (50%)"), ("late", "b", 2, 2, 1, "2/2 (100%)")]
    assert rows(facets.present(c).filter("field = 'g'"), "stratum", "n", "m", "share") == [("all", 1, 4, "1/4 (25%)"), ("late", 1, 2, "1/2 (50%)")]
    assert [r.t for r in spark.createDataFrame([(1, 8), (3, 8), (0, 0)], "n long, m long").select(facets.share_text(F.col("n"), F.col("m")).alias("t")).collect()] == ["1/8 (12%)", "3/8 (38%)", "0/0"]
    assert facets.facet_counts(d.filter("false"), ["f"], {"all": F.lit(True)}).collect() == []


def test_robust_figures(spark):
    rng = np.random.default_rng(5)
    data = {g: rng.normal(size=n) * 10 for g, n in ((1, 1), (2, 2), (3, 501), (4, 5000))}
    d = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs] + [(5, None), (5, float("nan")), (3, None)], "g long, v double")
    got = {r.g: r for r in noise.mad(d, ["g"], "v").collect()}
    for g, vs in data.items():
        assert got[g].median == pytest.approx(np.median(vs)) and got[g].mad == pytest.approx(np.median(np.abs(vs - np.median(vs)))) and got[g].n == len(vs)
    assert (got[5].median, got[5].mad, got[5].n) == (None, None, 0)
    rough = {r.g: r for r in noise.mad(d, ["g"], "v", accuracy=1000).collect()}
    assert abs(rough[4].mad - got[4].mad) < 0.2


def test_lines(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 50, 200)
    y = 3 * x - 7 + rng.normal(size=200)
    d = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)] + [(2, 4.0, 1.0), (2, 4.0, 2.0), (3, None, 1.0), (4, 1.0, 2.0), (4, 2.0, 4.0)], "g long, x double, y double")
    got = {r.g: r for r in noise.line_fit(d, ["g"], "x", "y").collect()}
    slope, intercept = np.polyfit(x, y, 1)
    assert got[1].slope == pytest.approx(slope) and got[1].intercept == pytest.approx(intercept) and got[1].residual == pytest.approx(np.sqrt(np.mean((y - slope * x - intercept) ** 2)))
    assert (got[2].slope, got[2].residual) == (None, None) and 3 not in got and got[4].residual == pytest.approx(0, abs=1e-9)
    far = {(round(r.x, 6)) for r in noise.off_line(d.filter("g = 1"), ["g"], "x", "y", 2.0).collect()}
    assert far == {round(float(a), 6) for a, b in zip(x, y) if abs(b - slope * a - intercept) > 2 * got[1].residual}


def test_outline(spark):
    charts = spark.createDataFrame([("d", 1, 2, 5, 77), ("d", 2, 2, 1, 77), ("d", 3, 1, 0, 9)], "doc string, chart long, page long, x0 long, rows long")
    sections = spark.createDataFrame([("d", 0, True, 77, 4, [4]), ("d", 1, True, 77, 4, [4, 5]), ("d", 2, False, 9, 7, [7]), ("d", 3, True, None, 8, [8])], "doc string, section long, is_colour boolean, last_row long, first_page long, pages array<bigint>")
    headings = spark.createDataFrame([("d", 4, 1, "Front"), ("d", 9, 1, "Lost")], "doc string, page long, k int, title string")
    got = outline.outline(charts, sections, headings, spark.createDataFrame([("d", 10)], "doc string, page_count long")).orderBy("place").collect()
    assert [(r.kind, r.chart, r.section, r.title, r.pages) for r in got] == [
        ("chart", 3, None, "Chart 1 (page 1)", [1]), ("chart", 2, 0, "Front", [2, 4]), ("chart", 1, 1, "Chart 3 (page 2)", [2, 4, 5]), ("rows", None, 2, "Rows, page 7, R 1-9", [7]),
        ("assembly", None, None, "Page 3", [3]), ("assembly", None, None, "Page 6", [6]), ("assembly", None, None, "Pages 8-10", [8, 9, 10]),
    ]


def test_polylines_equal_plain_distances(spark):
    """Long segments are cut and meet cells by blocks; distances and places along the line stay those of the whole."""
    rng = random.Random(8)
    lines = {1: [(0.0, 0.0), (30.0, 70.0), (30.0, 70.0), (5.0, 40.0)], 2: [(rng.uniform(0, 40), rng.uniform(0, 80)) for _ in range(6)]}
    points = spark.createDataFrame([("g", k, i, y, x) for k, p in lines.items() for i, (y, x) in enumerate(p)], "by string, line long, i int, py double, px double")
    cells = spark.range(41).selectExpr("id AS y").crossJoin(spark.range(81).selectExpr("id AS x")).withColumn("by", F.lit("g"))
    for reach in (0.8, 13.5):
        got = {(r.line, r.y, r.x): (r.d, r.arc) for r in shapes.polyline_cells(cells, points, ["by"], "line", reach).collect()}
        want = {}
        for k, p in lines.items():
            base = 0.0
            for (y0, x0), (y1, x1) in zip(p, p[1:]):
                long = math.hypot(y1 - y0, x1 - x0)
                for y in range(41):
                    for x in range(81):
                        t = min(1, max(0, ((y - y0) * (y1 - y0) + (x - x0) * (x1 - x0)) / long**2)) if long else 0
                        d = math.hypot(y - y0 - t * (y1 - y0), x - x0 - t * (x1 - x0))
                        if d <= reach:
                            want[k, y, x] = min(want.get((k, y, x), (9e9, 0)), (d, base + t * long))
                base += long
        assert got.keys() == want.keys() and all(got[c][0] == pytest.approx(want[c][0]) for c in want)


def test_woven_strands_leave_a_gap(spark):
    strands = [("g", "a", 2, x) for x in range(7)] + [("g", "b", y, 3) for y in range(5)]
    windows = [("g", y, x, "a") for y in range(5) for x in range(7)]
    got = rows(shapes.woven(spark.createDataFrame(strands, "by string, line string, y long, x long"), spark.createDataFrame(windows, "by string, y long, x long, over string"), ["by"], "line"), "line", "y", "x")
    assert [r for r in got if r[0] == "b"] == [("b", 0, 3), ("b", 2, 3), ("b", 4, 3)] and len([r for r in got if r[0] == "a"]) == 7
