"""Small hand-made grids, logs and documents, with known answers."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions import color
from weftline.operators import identity, islands, machine, match, prose, runs, sequence, text, validate


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def cells(spark, grid):
    return spark.createDataFrame([(1, y, x, c) for y, row in enumerate(grid) for x, c in enumerate(row)], "grid_id long, y long, x long, code string")


def test_rle_and_back(spark):
    grid = ["AAABBA", "CCCCCC", "ABABAB"]
    c = cells(spark, grid)
    enc = runs.rle_encode(c)
    assert rows(runs.run_strings(enc), "y", "runs") == [(0, "3A2B1A"), (1, "6C"), (2, "1A1B1A1B1A1B")]
    assert rows(runs.rle_decode(enc), "y", "x", "code") == rows(c, "y", "x", "code")
    for block in (1, 2, 4):
        assert rows(runs.rle_encode(c, block=block), "y", "run_no", "code", "n", "x0") == rows(enc, "y", "run_no", "code", "n", "x0")


def test_rle_random_blocks(spark):
    rng = random.Random(1)
    c = cells(spark, ["".join(rng.choice("AB") for _ in range(rng.randint(1, 40))) for _ in range(20)])
    a, b = runs.rle_encode(c), runs.rle_encode(c, block=7)
    assert rows(a, "y", "run_no", "code", "n", "x0") == rows(b, "y", "run_no", "code", "n", "x0")


def test_parse_runs(spark):
    d = spark.createDataFrame([("12C3KA",), ("7YB",), ("C3",), ("",), (None,), ("3A\n",)], "s string").select("s", runs.parse_runs(F.col("s")).alias("r"))
    got = {r["s"]: None if r["r"] is None else [tuple(x) for x in r["r"]] for r in d.collect()}
    assert got == {"12C3KA": [("C", 12, 0), ("KA", 3, 12)], "7YB": [("YB", 7, 0)], "C3": None, "": None, None: None, "3A\n": None}


def test_reversing_twice_and_relabelling(spark):
    grid = ["AABBBC", "CABAAA"]
    a = runs.rle_encode(cells(spark, grid))
    b = runs.rle_encode(cells(spark, [r[::-1] for r in grid]))
    assert rows(a.groupBy("y").agg(F.count("*").alias("n")), "y", "n") == rows(b.groupBy("y").agg(F.count("*").alias("n")), "y", "n")


def minimal(spark):
    """12 x 14 cells in two colours: 168 cells."""
    return runs.rle_encode(cells(spark, ["MMMMMMCCCCCC"] * 14))


def test_prefix_and_cursor(spark):
    p = sequence.passes(minimal(spark))
    assert p.agg(F.sum("n")).first()[0] == 168
    cursors = spark.createDataFrame([(1, 3, 1, 0), (1, 14, 2, 0), (1, 3, 1, 6), (1, 99, 0, 0), (1, 5, 1, 5)], "grid_id long, row long, run long, stitch long")
    assert rows(sequence.cursor_cells(cursors, p).select("row", "run", "stitch", "valid", F.coalesce("cells_done", F.lit(-1)).alias("c")), "row", "run", "stitch", "valid", "c") == [(3, 1, 0, True, 30), (3, 1, 6, False, -1), (5, 1, 5, True, 59), (14, 2, 0, True, 168), (99, 0, 0, False, -1)]


def test_passes_alternate(spark):
    p = sequence.passes(runs.rle_encode(cells(spark, ["AB", "CD"])))
    assert rows(p, "pass_no", "side", "direction", "grid_row", "run_no", "code", "x0") == [(1, "RS", "rtl", 1, 0, "D", 1), (1, "RS", "rtl", 1, 1, "C", 0), (2, "WS", "ltr", 0, 0, "A", 0), (2, "WS", "ltr", 0, 1, "B", 1)]
    p = sequence.passes(runs.rle_encode(cells(spark, ["AB", "CD"])), rounds=True)
    assert rows(p, "pass_no", "side", "run_no", "code") == [(1, "RS", 0, "D"), (1, "RS", 1, "C"), (2, "RS", 0, "B"), (2, "RS", 1, "A")]


def test_shaping(spark):
    grid = ["NNAAAAN", "NAAAAAN", "AAAAAAA", "NAAAAAN", "NNAAANN"][::1]
    p = sequence.passes(runs.rle_encode(cells(spark, grid)), no_stitch="N")
    got = {r.pass_no: (r.start_delta, r.end_delta) for r in sequence.shaping(p).collect()}
    assert got == {1: (None, None), 2: (1, 1), 3: (1, 1), 4: (-1, -1), 5: (0, -1)}


def test_written_to_grid_inverts_passes(spark):
    c = cells(spark, ["ABBC", "CCAB", "AAAA"])
    p = sequence.passes(runs.rle_encode(c)).withColumnRenamed("pass_no", "row")
    assert rows(sequence.written_to_grid(p), "y", "x", "code") == rows(c, "y", "x", "code")
    told = rows(sequence.written_rows(sequence.passes(runs.rle_encode(c)), turn=1), "pass_no", "text")
    assert told[0] == (1, "Row 1 (RS): 4 A (4 sts)") and told[1] == (2, "Row 2 (WS): ch 1, turn, 2 C, 1 A, 1 B (4 sts)")


def log(spark, seconds):
    t0 = dt.datetime(2026, 1, 1)
    return spark.createDataFrame([(1, t0 + dt.timedelta(seconds=s), i, p) for i, (s, p) in enumerate(seconds)], "project long, t timestamp_ntz, seq long, pos long")


def test_sessions(spark):
    d = log(spark, [(0, 10), (600, 30), (1800, 40), (3001, 52), (3541, 58)])
    assert [r.n_events for r in islands.sessions(d).orderBy("start").collect()] == [3, 2]
    got = islands.session_deltas(d).orderBy("start").collect()
    assert [(r.cells, r.active_seconds) for r in got] == [(40, 1800), (18, 540)]
    p = islands.pace(islands.session_deltas(d)).first()
    assert (p.n_sessions, p.cells, p.active_seconds, p.cells_per_hour) == (2, 58, 2340, 89.2)
    # A hole longer than the gap makes one session more.
    assert islands.sessions(log(spark, [(0, 1), (1200, 2), (2401, 3)])).count() == 2


def test_ranges_and_missing(spark):
    d = spark.createDataFrame([("a", n) for n in (2, 3, 5, 7, 8, 9, 9)], "k string, n long")
    assert rows(islands.ranges(d, ["k"], "n"), "start", "end", "size") == [(2, 3, 2), (5, 5, 1), (7, 9, 3)]
    assert islands.range_text(islands.ranges(d, ["k"], "n"), ["k"]).first().ranges == "2-3, 5, 7-9"
    assert rows(islands.missing(d, ["k"], "n"), "start", "end") == [(4, 4), (6, 6)]
    assert rows(islands.repeated(d.withColumnRenamed("n", "m"), ["k", "m"]), "m", "n") == [(9, 2)]


def test_stretches_merge_single_rows(spark):
    grid = ["ABABABABABAB", "AAAAAAAAAAAA", "AAAAAABBBBBB", "AAAAAABBBBBB", "AAAAAAAAAAAA", "AAAAAAAAAAAA"]
    got = rows(islands.stretches(sequence.passes(runs.rle_encode(cells(spark, grid)))), "start", "end", "plain", "codes")
    assert got == [(1, 2, True, "A"), (3, 6, False, "A,B")]


def test_sections_rejoin_and_take_while(spark):
    d = spark.createDataFrame([(1, i, n) for i, n in enumerate([3, 1, 2, 1, 2])], "k long, i long, n long")
    assert rows(islands.sections(d, ["k"], ["i"], "n"), "i", "section") == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2)]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["x", "Row 1: 2 A,", "3 B", "Row 2: 5 C"])], "k long, i long, line string")
    assert rows(islands.rejoin(lines, ["k"], ["i"], F.col("line").startswith("Row")), "head_no", "text") == [(1, "Row 1: 2 A, 3 B"), (2, "Row 2: 5 C")]
    e = spark.createDataFrame([(1, 1, 3), (1, 4, 6), (1, 8, 9), (1, 10, 11)], "k long, a long, b long")
    assert rows(islands.take_while_consecutive(e, ["k"], "a", "b"), "a", "b") == [(1, 3), (4, 6)]


def test_intervals(spark):
    e = spark.createDataFrame([(1, 27, 86, "x"), (1, 90, None, "y")], "k long, from_ long, to_ long, text string")
    pts = spark.createDataFrame([(1, n) for n in (26, 27, 31, 86, 88, 95)], "k long, n long")
    d = sequence.lookup_interval(pts.withColumnRenamed("k", "key"), e.withColumnRenamed("k", "key"), "n", ["key"])
    got = {r.n: (r.text, r.k, r.of) for r in d.collect()}
    assert got == {26: (None, None, None), 27: ("x", 1, 60), 31: ("x", 5, 60), 86: ("x", 60, 60), 88: (None, None, None), 95: ("y", 6, None)}
    assert rows(validate.tiling_problems(spark.createDataFrame([(1, 1, 3), (1, 5, 6), (1, 6, None), (1, 9, 9)], "k long, from_ long, to_ long"), ["k"]), "from_", "kind") == [(5, "gap"), (6, "overlap"), (9, "open")]


def test_matching(spark):
    a = cells(spark, ["AAB", "BBB"])
    b = cells(spark, ["AAC", "BB"])
    assert rows(match.cross_check(a, b), "y", "n_differ", "first_x") == [(0, 1, 2), (1, 1, 2)]
    m = match.majority(a.withColumnRenamed("code", "cluster"), b, ["grid_id", "y", "x"], "cluster", "code", ["grid_id"])
    assert rows(m, "cluster", "code", "n", "share") == [("A", "A", 2, 1.0), ("B", "B", 2, 0.6667)]
    assert rows(match.mirrors(cells(spark, ["ABA", "ABB"])), "y", "n_broken") == [(0, 0), (1, 2)]
    assert rows(match.solid_edge(cells(spark, ["ABA", "ACA"])), "solid") == [(True,)]
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, s long")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k long, v string, s long")
    assert rows(match.upsert(old, new, ["k"], "s"), "k", "v") == [(1, "a"), (2, "d"), (3, "e")]


def test_landmarks_against_all_pairs(spark):
    rng = random.Random(3)
    p = sequence.passes(runs.rle_encode(cells(spark, ["".join(rng.choice("AAAAAB") for _ in range(60)) for _ in range(8)])))
    pdf = p.toPandas()
    want = set()
    for r in pdf.itertuples():
        end = r.x0 + r.n if r.direction == "ltr" else r.x0
        best = min(((abs((b.x0 if r.direction == "ltr" else b.x0 + b.n) - end), b.run_no, b.code, (end - b.x0) if r.direction == "ltr" else (b.x0 + b.n - end)) for b in pdf[pdf.pass_no == r.pass_no - 1].itertuples()), default=None)
        if best and best[0] <= 10:
            want.add((r.pass_no, r.run_no, best[2], best[3]))
    assert set(rows(match.landmarks(p), "pass_no", "run_no", "code", "offset")) == want


def test_validation_reports_every_problem(spark):
    palette = spark.createDataFrame([("d", "A", "#000000", True), ("d", "A", "#00000", True), ("d", "A1", "#000000", False), ("d", "N", "#ffffff", False)], "doc string, code string, hex string, stitch boolean")
    got = rows(validate.palette_problems(palette), "rule", "at")
    assert got == [("code", "A1"), ("duplicate", "A"), ("hex", "A"), ("no_stitch", "")]
    r = spark.createDataFrame([("d", 0, "3A"), ("d", 1, "2A1B"), ("d", 2, "A3"), ("d", 3, "4A"), ("d", 4, "1A1N1A"), ("d", 5, "3N")], "doc string, y long, runs string")
    size = spark.createDataFrame([("d", 3, 7)], "doc string, width long, height long")
    got = rows(validate.row_problems(r, palette, size, no_stitch=spark.createDataFrame([("d", "N")], "doc string, code string")), "rule", "at")
    assert got == [("gap", "4"), ("height", ""), ("no_stitches", "5"), ("run_string", "2"), ("unknown_code", "1"), ("width", "3")]
    c = spark.createDataFrame([("d", 0, x, "A") for x in range(3)], "doc string, y long, x long, code string")
    given = spark.createDataFrame([("d", 1, 0, "A", 3, 0), ("d", 2, 0, "B", 1, 0), ("d", 3, 0, "A", 2, 2), ("d", 4, 0, "A", 0, 0)], "doc string, pass_no long, grid_row long, code string, n long, x0 long")
    assert rows(validate.pass_problems(given, c), "rule", "at") == [("pass_cells", "2"), ("pass_cells", "3"), ("pass_count", "4")]
    charts = spark.createDataFrame([("m", "c1", True), ("m", "c2", True), ("m", "c3", False)], "doc string, chart string, is_default boolean")
    pieces = spark.createDataFrame([("m", "a", "c1", None), ("m", "b", "c9", None), ("m", "c", None, None), ("m", "c", "c2", "r")], "doc string, piece string, chart string, rows_id string")
    got = rows(validate.manifest_problems(charts, pieces), "rule", "at")
    assert got == [("chart_or_rows", "c"), ("chart_or_rows", "c"), ("default", ""), ("duplicate", "c"), ("unknown", "b"), ("unused", "c3")]


def test_content_ids(spark):
    import hashlib

    d = spark.createDataFrame([("é/x", None, [1, 2])], "b string, a string, c array<int>").select(identity.content_id(b=F.col("b"), a=F.col("a"), c=F.col("c")).alias("id"))
    assert d.first().id == "sha256:" + hashlib.sha256('{"b":"é/x","c":[1,2]}'.encode()).hexdigest()
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, "d")], "k long, v string")
    assert rows(identity.drift(old, new, ["k"]), "k", "status", "columns") == [(2, "differs", "v"), (4, "stale", "")]


def test_text_grammars(spark):
    d = spark.createDataFrame([("Row 3 (RS): 2 A, 14 B (16 boxes)",), ("R 2 - R 26: 3 C",), ("1st row: 5 A",), ("7. 2G, 3R",), ("Rows 5 to 900: x",), ("Hello 3",)], "line string")
    got = rows(text.row_heads(d), "first", "last", "side", "body")
    assert got == [(1, 1, "", "5 A"), (2, 26, "", "3 C"), (3, 3, "RS", "2 A, 14 B (16 boxes)"), (7, 7, "", "2G, 3R")]
    one = spark.range(1).select(text.printed_total(F.lit("2 A (16 boxes)")).alias("t"), text.key_line(F.lit("bl= Black")).alias("k"), text.slug(F.lit("  Moss & Bee!")).alias("s"), text.is_heading(F.lit("Front Panel")).alias("h"), text.html_to_text(F.lit("<p>a&amp;b</p><script>x</script><!-- y --><b>c</b>")).alias("x")).first()
    assert (one.t, tuple(one.k), one.s, one.h, one.x) == (16, ("BL", "Black"), "moss-bee", True, "a&b\nc")
    names = spark.createDataFrame([(0,), (25,), (26,), (701,), (702,)], "i int").select("i", text.code_name(F.col("i")).alias("c"), text.ordinal(F.col("i")).alias("o"))
    assert rows(names, "i", "c", "o") == [(0, "A", "0th"), (25, "Z", "25th"), (26, "AA", "26th"), (701, "ZZ", "701st"), (702, "AAA", "702nd")]


def test_lab(spark):
    d = spark.range(1).select(color.lab(F.lit(255), F.lit(0), F.lit(0)).alias("c")).first().c
    assert np.allclose([d.l, d.a, d.b], [53.24, 80.09, 67.2], atol=0.02)


def plain_segments(runs):
    """Segments by their definition: braids, then at each run the longest band (of equal ones the shortest period), else one run."""
    n = len(runs)
    braid = lambda a: len(a) == 8 and all(c <= 4 for _, c in a)
    low, high = 8 * braid(runs[:8]), n - 8 * (n >= 16 and braid(runs[-8:]))
    out, i = [("braid", 0, 8, 0, 0)] * (low > 0), low
    while i < high:
        bands = [(r * p, -p, r) for p in (2, 3, 4) for r in range(3, n) if i + r * p <= high and runs[i : i + r * p] == runs[i : i + p] * r]
        cells, p, r = max(bands, default=(1, 0, 0))
        out.append(("repeat" if bands else "fill" if runs[i][1] >= 20 else "run", i, i + cells, -p, r))
        i += cells
    return out + [("braid", high, n, 0, 0)] * (high < n)


def test_segments(spark):
    rng, run = random.Random(4), [("A", 1), ("B", 2)]
    cases = [run * 3 + [("C", 25), ("D", 5)], run * 4 + [("C", 9)] + run * 4, [("A", 30)], run]
    cases += [[(rng.choice("AB"), rng.choice((1, 2, 30))) for _ in range(rng.randint(1, 30))] for _ in range(60)]
    assert plain_segments(cases[0]) == [("repeat", 0, 6, 2, 3), ("fill", 6, 7, 0, 0), ("run", 7, 8, 0, 0)]
    d = spark.createDataFrame([(1, p, k, *r) for p, c in enumerate(cases) for k, r in enumerate(c)], "grid_id long, pass_no long, run_no long, code string, n long")
    got = {p: [] for p in range(len(cases))}
    for r in machine.segments(d).orderBy("pass_no", "start").collect():
        got[r.pass_no].append((r.kind, r.start, r.end, r.period, r.repetitions))
    assert all(got[p] == plain_segments(c) for p, c in enumerate(cases))


def test_replay_written(spark):
    log_ = spark.createDataFrame([(1, i, a, r) for i, (a, r) in enumerate([("advance", 0)] * 3 + [("back", 0)] * 4 + [("jump", 3), ("advance", 0), ("jump", 2), ("jump", 9), ("advance", 0), ("advance", 0), ("advance", 0), ("back", 0)])], "project long, seq long, action string, row long")
    moves = [(2, False), (3, False), (3, True), (3, False), (2, False), (1, False), (1, False), (3, False), (3, True), (2, False), (2, False), (3, False), (3, True), (3, True), (3, False)]
    assert rows(machine.replay_written(log_, 3), "seq", "row", "finished") == [(i, *m) for i, m in enumerate(moves)]
    assert rows(machine.replay_written(log_, None), "seq", "row", "finished")[2] == (2, 4, False)


def test_clusters():
    d = pd.DataFrame({"key": [1, 2, 3, 4], "n": [1000, 50, 500, 1], "l": [0.0, 3.0, 50.0, 58.0], "a": 0.0, "b": 0.0})
    got = dict(zip(*machine.greedy_clusters(d)[["key", "cluster"]].to_numpy().T, strict=True))
    assert got == {1: 0, 2: 0, 3: 1, 4: 1}
    rng = np.random.default_rng(5)
    d = pd.DataFrame({"key": range(200), "n": rng.integers(1, 60, 200), "l": rng.random(200) * 60, "a": rng.random(200) * 40, "b": 0.0})
    got = machine.greedy_clusters(d, 9.0).set_index("key")
    leads, own = [], {}
    for r in d.sort_values(["n", "key"], ascending=[False, True]).itertuples():  # by the definition, a point at a time
        away = [(math.hypot(r.l - x.l, r.a - x.a), i) for i, x in enumerate(leads)]
        if away and min(away)[0] <= 9.0:
            own[r.key] = leads[min(away)[1]].key
        else:
            leads.append(r)
            own[r.key] = r.key
    total = {x.key: sum(d.n[d.key == k].item() for k in own if own[k] == x.key) for x in leads}
    big = [x for x in leads if total[x.key] >= 0.005 * d.n.sum()]
    for x in leads:
        if x not in big:
            away, y = min((math.hypot(x.l - y.l, x.a - y.a), i) for i, y in enumerate(big))
            if away <= 18.0:
                own = {k: big[y].key if v == x.key else v for k, v in own.items()}
    assert got.lead.to_dict() == own and got.cluster.nunique() == len({*own.values()})


def test_prose():
    assert prose.expand("2 A, (3 B, 1 C) 2 times, 1 A") == [("A", 2), ("B", 3), ("C", 1), ("B", 3), ("C", 1), ("A", 1)]
    assert prose.expand("*2 A, 2 B; repeat from * 2 times, 1 A") == [("A", 2), ("B", 2)] * 2 + [("A", 1)]
    assert prose.expand("*2 A, 2 B; repeat from * 2 more times, 1 A") == [("A", 2), ("B", 2)] * 3 + [("A", 1)]
    assert prose.expand("*2 A, 2 B; repeat from * across", 13) == [("A", 2), ("B", 2)]
    assert prose.expand("(1 A, 1 B) 501 times") is None and prose.expand("((((1 A, 1 B) 100 times) 100 times) 100 times) 9 times") is None
    assert prose.expand("*2 A, 2 B; repeat from * across", 12) == [("A", 2), ("B", 2)] * 3
    assert prose.expand("") == []


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables(spark, n):
    c = cells(spark, []).limit(n)
    assert runs.run_strings(runs.rle_encode(c)).count() == 0
    assert islands.stretches(sequence.passes(runs.rle_encode(c))).count() == 0


def test_project_totals_and_sessions(spark):
    from weftline.operators import project

    e = spark.createDataFrame([(1, 1, 3, 10), (1, 4, 6, 5), (2, 1, 2, None), (2, 3, 4, 7), (3, 1, 2, 4), (3, 3, None, 4)], "k long, from_ long, to_ long, count long")
    assert {r.k: (r.total_rows, r.total_stitches) for r in project.written_totals(e, ["k"]).collect()} == {1: (6, 45), 2: (4, None), 3: (None, None)}
    cursors = spark.createDataFrame([(1, 1), (1, 3), (1, 5), (3, 9)], "k long, row long")
    assert rows(project.stitches_before(e, cursors, ["k"]), "k", "row", "stitches_before") == [(1, 1, 0), (1, 3, 20), (1, 5, 35), (3, 9, 32)]
    t0 = dt.datetime(2026, 1, 1)
    log_ = [("a", 0, "advance", 2), ("a", 60, "advance", 3), ("a", 120, "advance", 3), ("x", 130, "advance", 2), ("a", 4000, "back", 3), ("a", 4060, "advance", 3), ("b", 4100, "advance", 2)]
    log_ = spark.createDataFrame([(1, p, 1, t0 + dt.timedelta(seconds=s), i, k, r) for i, (p, s, k, r) in enumerate(log_)], "project long, piece string, copy long, t timestamp_ntz, seq long, kind string, row long")
    manifest = spark.createDataFrame([(1, "a", 3, 1), (1, "b", None, 2)], "project long, piece string, total long, make long")
    got = project.project_sessions(log_, manifest).orderBy("start").collect()
    assert [r["rows"] for r in got] == [3, 1] and [(r.end - r.start).seconds for r in got] == [120, 100]
    done = spark.createDataFrame([(1, "a", True), (1, "b", False), (1, "x", True)], "project long, piece string, finished boolean")
    assert rows(project.project_figures(done, manifest), "pieces_done", "pieces_total") == [(1, 3)]


def test_numbers_slugs_scores_and_paths(spark):
    from weftline.operators import project

    d = spark.createDataFrame([(1, n) for n in (1, 2, 2, 4, 9)], "k long, n long")
    h = spark.createDataFrame([(1, 5)], "k long, height long")
    assert rows(project.row_number_problems(d, h, ["k"], "n"), "kind", "at") == [("beyond", 9), ("duplicate", 2), ("missing", 3), ("missing", 5)]
    names = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a", "a-2", "a", "a", ""])], "g long, i long, base string")
    assert rows(project.unique_slugs(names, "g", "i", "base"), "i", "slug") == [(0, "a"), (1, "a-2"), (2, "a-3"), (3, "a-4"), (4, "piece")]
    kind = "array<struct<code:string,count:int>>"
    truth = spark.createDataFrame([(1, 1, [("A", 2), ("B", 1)]), (1, 2, [("A", 5)]), (1, 3, [("B", 1)])], f"k long, row long, runs {kind}")
    read = spark.createDataFrame([(1, 1, 0, [("X", 2), ("Y", 1)]), (1, 2, 1, [("A", 5)]), (1, 2, 2, [("A", 6)])], f"k long, row long, seq long, runs {kind}")
    assert rows(project.reading_scores(truth, read, ["k"]), "n_truth", "n_read", "n_exact", "n_relabelled") == [(3, 2, 1, 2)]
    files = spark.createDataFrame([(1, p) for p in ("a/b.json", "A/b.json", "a/b.json/c", "../x", "ok.png")], "k long, path string")
    assert rows(project.paths_problems(files, "k", "path"), "path", "kind") == [("../x", "unusable"), ("A/b.json", "duplicate"), ("a/b.json/c", "nested")]
    body = spark.createDataFrame([(1, "1 A, 2 B, 3 C")], "k long, body string")
    assert rows(project.chunks(body, ["k"], "body", 2), "chunk", "body") == [(0, "1 A, 2 B"), (1, "3 C")]


def test_shapes(spark):
    from weftline.operators import shapes

    assert rows(shapes.no_stitch_code(cells(spark, ["ANAAN", "NAAAN", "AAAAN"])), "code") == []
    assert rows(shapes.no_stitch_code(cells(spark, ["NNAAN", "NAAAN", "NAANN"])), "code") == [("N",)]
    assert rows(shapes.no_stitch_code(cells(spark, ["NNAAN", "NANAN", "NAANN"])), "code") == []
    lines = spark.createDataFrame([(1, float(x)) for x in (0, 10, 20, 30, 100, 110)], "k long, at double")
    assert rows(shapes.gap_clusters(lines, ["k"], "at"), "at", "cluster") == [(0, 1), (10, 1), (20, 1), (30, 1), (100, 2), (110, 2)]
    boxes = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 1, 1, 6, 6), (1, 3, 9, 9, 14, 14)], "p long, box long, x0 long, y0 long, x1 long, y1 long")
    assert rows(shapes.suppress(boxes, "p"), "box") == [(1,), (3,)]
    column = spark.createDataFrame([(1, y, 0, c) for y, c in enumerate("AABAAAB")], "grid_id long, y long, x long, code string")
    assert rows(shapes.longest_runs(column, "A"), "longest") == [(3,)] and rows(shapes.longest_runs(column, "A", 1), "longest") == [(6,)]
    assert shapes.dilate(spark.createDataFrame([(1, 0, 0), (1, 0, 1)], "g long, y long, x long"), ["g"]).count() == 12
    ticks = spark.createDataFrame([(1, float(x)) for x in (0, 5, 16, 20, 40, 41)], "k long, at double")
    assert rows(shapes.thinned(ticks, ["k"], "at", 16.0, 8), "at") == [(0,), (16,), (40,)]
    assert shapes.lattice(spark, 21, 21).filter(shapes.ellipse(10, 10, 3, 5)).count() == sum((y / 3) ** 2 + (x / 5) ** 2 <= 1 for y in range(-10, 11) for x in range(-10, 11))
    assert shapes.lattice(spark, 9, 9).filter(shapes.diamond(4, 4, 2, 2)).count() == 13 and shapes.lattice(spark, 9, 9).filter(shapes.segment(4, 1, 4, 7, 0.5)).count() == 7


def test_explicit_passes_win_and_unknown_techniques_are_refused(spark):
    c = cells(spark, ["AB", "CD"])
    derived = sequence.passes(runs.rle_encode(c.unionByName(c.withColumn("grid_id", F.lit(2).cast("long"))).unionByName(c.withColumn("grid_id", F.lit(3).cast("long")))))
    given = derived.filter("grid_id = 2 AND pass_no = 1").withColumn("code", F.lit("Z"))
    technique = spark.createDataFrame([(1, "rows"), (2, "brioche"), (3, "brioche"), (4, None)], "grid_id long, type string")
    got = sequence.explicit_passes(derived, given, technique)
    assert rows(got.groupBy("grid_id").agg(F.count("*").alias("n"), F.max("code").alias("c")), "grid_id", "n", "c") == [(1, 4, "D"), (2, 2, "Z")]
    assert {r.grid_id for r in sequence.refused_techniques(technique, given).collect()} == {3, 4}


def test_finish_by_the_last_days(spark):
    from weftline.operators import project

    now = dt.datetime(2026, 2, 1)
    days = [(1, 1), (1, 3), (1, 20), (2, 1), (3, 30), (3, 31), (3, 32)]
    s = spark.createDataFrame([(p, now - dt.timedelta(days=k), now - dt.timedelta(days=k) + dt.timedelta(hours=7)) for p, k in days], "project long, start timestamp_ntz, end timestamp_ntz")
    r = spark.createDataFrame([(1, 100, 10.0), (2, 100, 10.0), (3, 100, 10.0), (4, 5, None)], "project long, remaining long, per_hour double")
    got = {x.project: (x.window_seconds, x.days) for x in project.estimated_finish(s, r, F.lit(now).cast("timestamp_ntz")).collect()}
    assert got == {1: (14 * 3600, 10.0), 2: (7 * 3600, None), 3: (0, None), 4: (0, None)}
    done = r.withColumn("remaining", F.lit(0))
    assert {x.project: x.days for x in project.estimated_finish(s, done, F.lit(now).cast("timestamp_ntz")).collect()} == {1: 0.0, 2: None, 3: 0.0, 4: None}


def test_explicit_pass_rules_and_sizes(spark):
    palette = spark.createDataFrame([("d", "A", True), ("d", "N", False)], "doc string, code string, stitch boolean")
    given = spark.createDataFrame([("d", 1, i, y, c, n, x) for i, (y, c, n, x) in enumerate([(0, "A", 2, 0), (0, "Q", 1, 0), (0, "N", 1, 0), (0, "A", 0, 0), (0, "A", 2, 2), (7, "A", 1, 0), (0, "A", 1, -1), (None, "A", 9, 0)])], "doc string, pass_no long, run_no long, grid_row long, code string, n long, x0 long")
    extent = spark.createDataFrame([("d", 0, 3)], "doc string, y long, width long")
    assert rows(validate.explicit_pass_problems(given, palette, extent), "at", "rule") == [("1/1", "pass_code"), ("1/2", "pass_no_stitch"), ("1/3", "pass_count"), ("1/4", "pass_outside"), ("1/5", "pass_outside"), ("1/6", "pass_outside")]
    d = spark.createDataFrame([("stitch", None), ("tile", "tiles"), ("tile", None), ("block", "stitches"), (None, "stitches"), ("x", "rounds")], "k string, u string")
    assert [r[0] for r in d.select(validate.size_derives(F.col("k"), F.col("u"))).collect()] == [True, True, False, False, True, False]


def test_one_to_one_pairing(spark):
    d = spark.createDataFrame([(1, 1, 1, 3.0), (1, 2, 2, 30.0), (2, 1, 1, 3.0), (2, 2, 1, 4.0)], "g long, key long, idx long, distance double")
    assert rows(match.one_to_one(d, ["g"], "key", "idx"), "g", "ok", "shared", "far") == [(1, True, "", "2"), (2, False, "1", "")]


def test_rows_on_a_shaped_grid(spark):
    grid = cells(spark, ["NAAN", "AAAA", "NNAN"])
    ground = spark.createDataFrame([(1, "N")], "grid_id long, code string")
    written = [(1, 0, "X", 1), (2, 0, "P", 1), (2, 1, "Q", 3), (3, 0, "Y", 1), (3, 1, "Z", 1)]
    written = spark.createDataFrame([(1, *r) for r in written], "grid_id long, row long, run_no long, code string, n long")
    got, wrong = sequence.shaped_grid(written, grid, ground)
    assert rows(got, "y", "x", "code") == [(0, 1, "Z"), (0, 2, "Y"), (1, 0, "P"), (1, 1, "Q"), (1, 2, "Q"), (1, 3, "Q"), (2, 2, "X")] and wrong.count() == 0
    _, wrong = sequence.shaped_grid(written.withColumn("n", F.col("n") + F.when(F.col("row") == 1, 1).otherwise(0)), grid, ground)
    assert rows(wrong, "row") == [(1,)]


def test_tiles_of_pages(spark):
    whole = cells(spark, ["ABC", "DEF"])
    headers = spark.createDataFrame([(1, 1, 1, 2, 3, 1, 2, 2), (1, 2, 3, 3, 3, 1, 2, 2)], "grid_id long, page long, a long, b long, width long, c long, d long, height long")
    pages = whole.filter("x >= 1").selectExpr("grid_id", "1L AS page", "y", "x - 1 AS x", "code").unionByName(whole.filter("x = 0").selectExpr("grid_id", "2L AS page", "y", "x", "code"))
    assert rows(sequence.placed_tiles(headers, pages), "y", "x", "code") == rows(whole, "y", "x", "code") and sequence.tile_problems(headers, pages).count() == 0
    assert rows(sequence.tile_problems(headers, pages.filter("NOT (page = 2 AND y = 0)")), "kind", "n") == [("size", 1), ("uncovered", 1)]


def test_orientation(spark):
    a = ["ABCD", "EFGH", "IJKL"]
    for other, hint, n in ((a, None, 0), (a[::-1], "flipped_rows", 2), ([r[::-1] for r in a], "flipped_columns", 3), ([r[::-1] for r in a[::-1]], "rotated", 3), (["ABCX"] + a[1:], None, 1), (["XBCD", "XFGH", "IJKL"], None, 2)):
        got = match.orientation(cells(spark, other), cells(spark, a)).first()
        assert (got.height, got.n_rows, got.refused, got.hint) == (3, n, n > 1, hint)


def test_normalized_bodies_and_clean_runs(spark):
    told = {
        "ch 1, turn, 2 inc, 3 dec (7 sts)": "4 sc, 3 sc", "8 sc in white, sc 4 in Pale Rose.": "8 white, 4 Pale Rose.", "(green) sc 10, c2, gh3": "10 green, 2 c, 3 gh",
        "2 sc, 3 sc, 1 A": "5 sc, 1 A", "dc2tog, sl 1": "dc2tog, sl 1", "": "",
    }
    told["ch 1, turn, 2 inc, 3 dec (7 sts)"] = "7 sc"
    d = spark.createDataFrame([*told.items()], "body string, want string").withColumn("got", text.normalized(F.col("body")))
    assert [(r.want, r.got) for r in d.collect() if r.want != r.got] == []
    names = spark.createDataFrame([(1, "White", "A"), (1, "A", "A"), (1, "B", "B")], "doc long, name string, code string")
    read = [("white", 2), ("a", 3), ("sc", 4), ("B", 0), ("B", 1), ("zz", 5), ("A", 1)]
    r = spark.createDataFrame([(1, 1, i, *x) for i, x in enumerate(read)], "doc long, row long, i long, code string, n long")
    assert rows(text.clean_runs(r, ["doc", "row"], "i", names, "doc"), "run_no", "code", "n") == [(0, "A", 5), (1, "B", 1), (2, "A", 1)]
    w = spark.createDataFrame([(1, 1, 10), (1, 2, None), (1, 3, 12), (1, 4, None)], "k long, row long, total int")
    assert {r.row: r.width for r in prose.row_width(w, ["k"], "row", "total").collect()} == {1: None, 2: 10, 3: 10, 4: 12}


def test_names_numbers_and_times(spark):
    from weftline.functions import units

    d = spark.createDataFrame([("#ff0000", "red"), ("#000000", "black"), ("#1a5032", "dark green"), ("#f5ebd3", "cream")], "hex string, want string")
    assert [(r.want, r.n) for r in d.select("want", color.color_name(F.col("hex")).alias("n")).collect() if r.want != r.n] == []
    one = spark.range(1).select(units.thousands(F.lit(1234567)).alias("a"), units.thousands(F.lit(999)).alias("b"), units.title_case(F.lit("dark green")).alias("c"), units.to_iso(units.from_iso(F.lit("2026-01-02T03:04:05+02:00"))).alias("d"), units.from_iso(F.lit("soon")).alias("e")).first()
    assert tuple(one) == ("1,234,567", "999", "Dark Green", "2026-01-02T01:04:05Z", None)


def test_stretch_kinds(spark):
    grid = ["AAAAABBBBB" * 4] * 2 + ["A" * 40] * 2 + ["AAAAABBBBBBB" + "A" * 20 + "BBABBBAB"] * 2
    p = sequence.passes(runs.rle_encode(cells(spark, grid)), start="top")
    got = islands.stretch_kinds(islands.stretches(p), p, machine.segments(p))
    assert rows(got, "start", "end", "kind") == [(1, 2, "repeat"), (3, 4, "plain"), (5, 6, "pattern")]


def test_default_is_the_first_chart_piece(spark):
    charts = spark.createDataFrame([("m", "c1", True), ("m", "c2", False)], "doc string, chart string, is_default boolean")
    pieces = spark.createDataFrame([("m", "a", None, "r", 1), ("m", "b", "c2", None, 2), ("m", "c", "c1", None, 3)], "doc string, piece string, chart string, rows_id string, place long")
    assert rows(validate.manifest_problems(charts, pieces), "rule", "at") == [("default_first", "c2")]
