"""Interval joins, overlays, commits and appends against brute force and failures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import intervals, islands, machine, match, runs, sequence, shapes, validate
from weftline.sources import publish
from weftline.streaming import append


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("unit", "longest", "seed"), [(1.0, 5, 1), (4.0, 3000, 2), (0.5, 10**7, 3)])
def test_overlap_join(spark, unit, longest, seed):
    """Each pair once, whatever the lengths: points, short ones, and ones beyond the widest level."""
    rng = random.Random(seed)

    def some(n):
        out = []
        for i in range(n):
            a = rng.randrange(-200, 2000)
            out.append((i % 3, i, a, a + rng.choice([0, 0, 1, -1, rng.randrange(longest), longest if i % 20 == 0 else 2])))
        return out

    left, right = some(120), some(110)
    a, b = spark.createDataFrame(left, "k long, i long, s long, e long"), spark.createDataFrame(right, "k long, j long, lo long, hi long")
    got = rows(intervals.overlapping(a, b, ["k"], ("s", "e"), ("lo", "hi"), unit), "k", "i", "j")
    assert got == sorted(((k, i, j) for k, i, s, e in left for k2, j, lo, hi in right if k == k2 and s <= e and lo <= hi and s <= hi and lo <= e), key=repr)
    assert len(got) == len({*got})


def test_overlap_join_pairs_no_whole_key(spark):
    """Many short intervals of one key: the join moves rows in proportion to them, and makes no pairs that are far apart."""
    d = spark.range(20000).selectExpr("1 AS k", "id AS i", "id * 10 AS s", "id * 10 + 3 AS e")
    other = d.selectExpr("k", "i AS j", "s AS lo", "e AS hi")
    assert intervals.overlapping(d, other, ["k"], ("s", "e"), ("lo", "hi"), 4.0).count() == 20000


def random_runs(rng, n_rows, holes):
    out = []
    for y in range(n_rows):
        x = 0
        for _ in range(rng.randrange(8)):
            n = rng.randrange(0, 5)
            if holes and rng.random() < 0.3:
                x += rng.randrange(1, 4)
            out.append((1, y, x, n, rng.choice("ABC") if rng.random() < 0.9 else None))
            x += n
    return out


@pytest.mark.parametrize("seed", range(3))
def test_overlay_equals_cells(spark, seed):
    rng = random.Random(seed)
    a, b = random_runs(rng, 30, True), random_runs(rng, 30, True)
    cells = lambda t: {(y, x + i): c for _, y, x, n, c in t for i in range(n)}
    ca, cb, kind = cells(a), cells(b), "grid_id long, y long, x0 long, n long, code string"
    da, db = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
    got = {}
    for r in intervals.overlaid(da, db).collect():
        for x in range(r.x0, r.x0 + r.n):
            assert (r.y, x) not in got
            got[r.y, x] = (r.a, r.b, r.in_a, r.in_b)
    assert got == {k: (ca.get(k), cb.get(k), k in ca, k in cb) for k in {*ca, *cb}}
    differ = {k for k in got if (k in ca) != (k in cb) or ca.get(k) != cb.get(k)}
    found = intervals.differing_runs(da, db).collect()
    assert {(r.y, x) for r in found for x in range(r.x0, r.x0 + r.n)} == differ
    edges = {(r.y, r.x0 + r.n): (r.a, r.b) for r in found}
    assert all(edges.get((r.y, r.x0)) != (r.a, r.b) or None in (r.a, r.b) for r in found)  # as long as can be
    want = {y: (sum(k[0] == y for k in differ), min(k[1] for k in differ if k[0] == y)) for y, _ in differ}
    assert {r.y: (r.n_differ, r.first_x) for r in intervals.cross_check_runs(da, db).collect()} == want


def test_long_runs_stay_runs(spark):
    """Runs of a billion cells are compared as quickly as short ones."""
    a = spark.createDataFrame([(1, 0, 0, 10**9, "A"), (1, 0, 10**9, 10**9, "B")], "grid_id long, y long, x0 long, n long, code string")
    b = spark.createDataFrame([(1, 0, 0, 2 * 10**9, "A")], a.schema)
    assert rows(intervals.differing_runs(a, b), "x0", "n", "a", "b") == [(10**9, 10**9, "B", "A")]


def test_covered_by_overlapping_runs(spark):
    """Runs that overlap each other count each; a repeated run counts twice in `pass_problems`."""
    cells = spark.createDataFrame([("d", 0, x, c) for x, c in enumerate("AABBBA")], "doc string, y long, x long, code string")
    given = spark.createDataFrame([("d", 1, 0, "A", 3, 0), ("d", 1, 0, "A", 3, 0), ("d", 1, 0, "B", 3, 2), ("d", 2, 9, "A", 2, 0), ("d", 3, 0, "A", 1, 5), ("d", 4, 0, "B", 0, 0)], "doc string, pass_no long, grid_row long, code string, n long, x0 long")
    assert rows(validate.pass_problems(given, cells), "at", "message") == [("1", "2 cell(s) do not match"), ("2", "2 cell(s) do not match"), ("4", "the count is not positive")]


def test_lines_of_no_length_and_wide_ones(spark):
    lines = spark.createDataFrame([("k", 1, 5.0, 5.0), ("k", 2, 0.0, 100.0), ("k", 3, 9.0, 30.0), ("k", 4, 21.0, 22.0), ("z", 5, 0.0, 9.0), ("k", 6, 9.0, 12.0)], "key string, line long, s double, e double")
    spans = spark.createDataFrame([("k", "a", 0.0, 10.0), ("k", "b", 40.0, 50.0)], "key string, span string, lo double, hi double")
    assert rows(shapes.fitting_lines(lines, spans, ["key"]), "line", "span") == [(1, "a"), (2, "a"), (2, "b")]


def test_one_band_holds_half_of_a_repeating_row(spark):
    """Two bands of thirty percent are a pattern; one of half is a repeat."""
    two = "AAABB" * 3 + "C" * 20 + "DDDEE" * 3
    one = "AAAAAABBBB" * 3 + "C" * 30
    cells = spark.createDataFrame([(g, y, x, c) for g, row in ((1, two), (2, one)) for y in range(2) for x, c in enumerate(row)], "grid_id long, y long, x long, code string")
    p = sequence.passes(runs.rle_encode(cells), start="top", first_side="WS")
    got = islands.stretch_kinds(islands.stretches(p), p, machine.segments(p))
    assert rows(got, "grid_id", "kind") == [(1, "pattern"), (2, "repeat")]


def test_ties_of_colours_by_palette(spark):
    p = spark.createDataFrame([(1, 1, 0, "A", 4), (1, 1, 1, "B", 4), (1, 1, 2, "C", 4), (1, 1, 3, "D", 9)], "grid_id long, pass_no long, run_no long, code string, n long")
    palette = spark.createDataFrame([(1, "C", 1), (1, "A", 2)], "grid_id long, code string, place long")
    assert rows(islands.stretches(p, palette=palette), "codes") == [("D,C,A,B",)] and rows(islands.stretches(p), "codes") == [("D,A,B,C",)]


def test_refused_matches(spark):
    best = spark.createDataFrame([(1, 10, "A", 9, 0.95), (1, 11, "A", 3, 0.5), (2, 10, "A", 9, 1.0)], "g long, cluster long, code string, n long, share double")
    every = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 10)], "g long, cluster long")
    report = match.match_report(best, every, ["g"], "cluster", "code")
    assert rows(report, "g", "kind", "at") == [(1, "doubtful", "11"), (1, "shared", "A"), (1, "unmatched", "12")]
    key = spark.createDataFrame([(1, "A", None), (2, "A", None), (2, "B", None)], "g long, code string, hex string")
    out = match.matched_palette(best, report, key, every.withColumn("hex", F.lit("#123456")), ["g"], "cluster", "code")
    assert rows(out, "g", "code", "hex", "status") == [(2, "A", "#123456", "new"), (2, "B", None, "unseen")]


# ---- commits


def listing(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file() and not p.name.startswith((".", "_")))


def documents(spark, title):
    charts = spark.createDataFrame([(d, f'{{"title":"{title} {d}"}}') for d in ("a", "b")], "doc string, json string")
    written = spark.createDataFrame([("a", 1, "Row 1"), ("b", 1, "Row 1"), ("b", 2, "Row 2")], "doc string, row long, text string")
    return {"charts": charts, "written": written}


def test_only_valid_documents_are_published(spark, tmp_path):
    palette = spark.createDataFrame([("a", "A", "#112233", True), ("b", "B1", "#112233", True), ("b", "C", "red", True)], "doc string, code string, hex string, stitch boolean")
    done, refused = publish.publish_valid(documents(spark, "x"), validate.palette_problems(palette), str(tmp_path), "dist")
    assert done and rows(refused, "doc", "rule", "at") == [("b", "code", "B1"), ("b", "hex", "C")]
    assert rows(spark.read.parquet(f"{tmp_path}/dist/charts"), "doc") == [("a",)] and rows(spark.read.parquet(f"{tmp_path}/dist/written"), "doc", "row") == [("a", 1)]
    before = listing(tmp_path)
    done, _ = publish.publish_valid(documents(spark, "y"), validate.palette_problems(palette.filter("doc = 'a'")), str(tmp_path), "dist")
    assert not done and listing(tmp_path) == before  # what is published is never written over


def test_a_failure_midway_leaves_nothing(spark, tmp_path):
    docs = documents(spark, "x")
    docs["written"] = docs["written"].withColumn("text", F.when(F.col("row") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    none = spark.createDataFrame([], "doc string, rule string, at string, message string")
    with pytest.raises(Exception, match="lost"):
        publish.publish_valid(docs, none, str(tmp_path), "dist")
    assert not (tmp_path / "dist").exists() and listing(tmp_path) == []
    assert publish.publish_valid(documents(spark, "x"), none, str(tmp_path), "dist")[0] and len(listing(tmp_path)) > 0


# ---- the event log


def event(p, seq, minute, kind="advance", row=1):
    return (p, seq, dt.datetime(2024, 1, 1, 12, 0) + dt.timedelta(minutes=minute), kind, row, 0, 0)


KIND = "project long, seq long, t timestamp, kind string, row long, run long, stitch long"


def test_a_batch_given_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    one = spark.createDataFrame([event(1, 1, 0), event(1, 2, 5, row=2), event(1, 2, 5, row=2), event(2, 1, 0)], KIND)
    two = spark.createDataFrame([event(1, 2, 5, row=2), event(1, 3, 9, "finish", 3), event(3, 1, 24 * 60)], KIND)
    assert append.append(one, 0, path) and not append.append(one, 0, path)
    assert append.append(two, 1, path) and not append.append(one, 1, path)
    log = append.read_log(one, path)
    assert rows(log, "project", "seq", "batch_id") == [(1, 1, 0), (1, 2, 0), (1, 3, 1), (2, 1, 0), (3, 1, 1)]
    assert append.append(spark.createDataFrame([event(1, 3, 9, "finish", 3)], KIND), 2, path)  # nothing new
    assert append.read_log(one, path).count() == 5
    state = {r.project: (r.row, r.finished is not None, r.n_events) for r in append.state(append.read_log(one, path)).collect()}
    assert state == {1: (3, True, 3), 2: (1, False, 1), 3: (1, False, 1)}


def test_back_and_jump_reopen(spark):
    log = [event(1, 1, 0, "finish", 9), event(1, 2, 1, "back", 8), event(2, 1, 0, "back", 8), event(2, 2, 1, "finish", 9), event(3, 1, 0, "finish", 9), event(3, 2, 0, "jump", 2), event(3, 3, 5, "advance", 3)]
    got = {r.project: (r.row, r.finished is not None) for r in append.state(spark.createDataFrame(log, KIND)).collect()}
    assert got == {1: (8, False), 2: (9, True), 3: (3, False)}


def test_appending_stream_with_late_and_repeated_events(spark, tmp_path):
    """Files are batches: repeats are dropped, events later than the watermark too, and a second start goes on."""
    source, log = tmp_path / "in", str(tmp_path / "log")
    day = 24 * 60
    batches = [
        [event(1, 1, 0), event(1, 2, 10), event(1, 2, 10)],
        [event(1, 2, 10), event(1, 3, 3 * day), event(2, 1, 20)],
        [event(1, 4, 3 * day + 5), event(2, 2, 30)],  # the last one is two days late
    ]
    spark.createDataFrame(batches[0], KIND).coalesce(1).write.parquet(f"{source}/0")

    def run():
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        q = append.append_stream(stream, log, str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    for i, b in enumerate(batches[1:], 1):
        spark.createDataFrame(b, KIND).coalesce(1).write.parquet(f"{source}/{i}")
        run()
    got = rows(append.read_log(spark.createDataFrame([], KIND), log), "project", "seq")
    assert got == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1)]


@pytest.mark.parametrize(("block", "last"), [(1, 5), (7, 5), (512, None), (4, 1)])
def test_replays_in_blocks(spark, block, last):
    """Moves that are put together by blocks give what a walk event by event gives."""
    rng = random.Random(block)
    log = [(p, i, rng.choice(["advance", "advance", "back", "jump"]), rng.choice([None, 0, 1, 3, 5, 6, -2])) for p in range(4) for i in range(rng.randint(1, 60))]
    want, at = {}, {}
    for p, i, action, target in log:
        x, top = at.get(p, 1), last or 10**12
        x = min(x + 1, top + 1) if action == "advance" else max(x - 1, 1) if action == "back" else target if target is not None and 1 <= target <= top else x
        at[p] = x
        want[p, i] = (min(x, top), x > top)
    rng.shuffle(log)
    got = {(r.project, r.seq): (r.row, r.finished) for r in machine.replay_written(spark.createDataFrame(log, "project long, seq long, action string, row long"), last, block).collect()}
    assert got == want


def test_growing_arrays(spark):
    from weftline.operators import arrays

    built = F.aggregate(F.sequence(F.lit(1), F.col("n")), arrays.growing("int"), lambda a, x: arrays.grown(a, x))
    got = {r.n: r.x for r in spark.createDataFrame([(1,), (255,), (256,), (257,), (1500,)], "n int").select("n", arrays.whole(built).alias("x")).collect()}
    assert all(x == [*range(1, n + 1)] for n, x in got.items())


def test_segments_of_a_long_row(spark):
    """Thirty thousand runs in one row: bands of three repetitions and single runs, as many as were laid."""
    unit = [("A", 5), ("B", 7)] * 3 + [("C", 9)]
    p = spark.range(30000).selectExpr("1 AS grid_id", "1 AS pass_no", "id AS run_no").withColumns({
        "code": F.element_at(F.array(*[F.lit(c) for c, _ in unit]), (F.col("run_no") % 7 + 1).cast("int")), "n": F.element_at(F.array(*[F.lit(n) for _, n in unit]), (F.col("run_no") % 7 + 1).cast("int")),
    })
    got = {r.kind: r.n for r in machine.segments(p).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert got == {"repeat": 4285, "run": 4285 + 30000 % 7}
