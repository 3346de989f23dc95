"""Clustering by differences against brute force, in whole numbers of any size."""

import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import clusters, queries


def brute(rows, dims, k, rounds, scale=64):
    """(id, cluster, distance) of each kept row, sorted, and the centroids; in Python's whole numbers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in order[:k]]
    if not c:
        return [], c
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), c


def run(spark, rows, parts=3, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("c") for c in ("v", "owner", "before", "distance", "cluster")}).repartition(parts)
    state, centroids = clusters.cluster(df, **how)
    return sorted(((r.vec_id, r.owner, r.distance) for r in state.collect()), key=repr), [list(map(int, c)) for c in centroids]


def test_query_equals_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = c.sql(queries.ORACLE["op11_delta_lloyd"])
    got = queries.QUERIES["op11_delta_lloyd"](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())


@pytest.mark.parametrize(("seed", "size"), [(1, 1.0), (2, 0.05), (3, 3e5), (4, 1e13)])
def test_differences_equal_whole_rounds(spark, seed, size):
    """Ties, repeated rows and ids, and numbers whose squares pass 53 and 63 bits."""
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-size, size) for _ in range(3)]) for i in range(150)]
    rows += rows[:20] + [(7, [0.0, 0.0, 0.0]), (None, [size, -size, 0.5]), (None, [size, -size, 0.5])]
    for rounds in (0, 1, 4, 30):
        want, c = brute(rows, 3, 5, rounds)
        got, centroids = run(spark, rows, dims=3, k=5, rounds=rounds)
        assert centroids == c
        assert got == [(i, j, d if d < 1 << 63 else None) for i, j, d in want]


def test_only_changes_are_compared(monkeypatch):
    """Vectors of unchanged centroids meet changed ones alone."""
    seen = []
    plain = clusters.distances
    monkeypatch.setattr(clusters, "distances", lambda v, c: seen.append((len(v), len(c))) or plain(v, c))
    v, c = np.array([[0, 0], [0, 1], [9, 9], [5, 5]]), np.array([[0, 0], [9, 9], [4, 4]])
    owner, distance = clusters.reassigned(v, np.array([0, 0, 1, 1]), np.array([0, 1, 0, 32]), np.ones(4, bool), c, np.array([False, False, True]))
    assert owner.tolist() == [0, 0, 1, 2] and distance.tolist() == [0, 1, 0, 2] and seen == [(4, 1)]


def test_transfers_cancel(spark):
    state = spark.createDataFrame([([1, 2], 0, 5, None), ([3, 4], 1, 5, 0), ([7, 7], 1, 0, 1)], "v array<bigint>, owner int, distance bigint, before int")
    got = {(r.cluster, r.pos): int(r.moved) for r in clusters.transfers(state, 2, 2).collect() if r.moved}
    assert got == {(0, 0): -2, (0, 1): -2, (1, 0): 3, (1, 1): 4, (1, -1): 1}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, 2.0, 3.0]), (6, [1.0, None]), (7, [nan, 0.0]), (8, [inf, 0.0]), (9, [0.0, -inf]), (10, [1e300, 0.0]), (11, [-1.0, -2.01]), (None, [9.0, 9.0]), (1, [1.0, 2.0])]
    got, _ = run(spark, rows, dims=2, k=2, rounds=3)
    want, _ = brute([r for r in rows if r[0] != 10], 2, 2, 3)
    assert got == want and Counter(i for i, *_ in got) == {1: 2, 11: 1, None: 1}
    assert run(spark, [(None, [1.0, 2.0])], dims=2)[0] == [] and run(spark, [], dims=2)[0] == []
    got, _ = run(spark, rows, dims=2, k=50, rounds=3)  # fewer vectors than clusters
    assert got == brute([r for r in rows if r[0] != 10], 2, 50, 3)[0]


def test_query_without_rows(spark, tmp_path):
    spark.createDataFrame([(1, [0.5]), (2, None)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.QUERIES["op11_delta_lloyd"](spark, str(tmp_path))
    assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
