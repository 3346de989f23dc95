"""Centroid clustering: Lloyd's rounds by differences (Delta Lloyd), exact in whole numbers.

Vectors become whole numbers, floor(scale * x). Their assignments (owner and distance) are persisted as one table a round
in the shared folder, and each cluster's sum and size are kept as exact whole numbers. A round does only what the last one
changed: a vector whose centroid stayed is compared with the changed centroids alone; one whose centroid changed is
compared with all. Vectors that change owner are signed transfers, minus for the old owner and plus for the new one, added
up in tasks and then by Spark to one number for each cluster and component: nothing is summed anew.

Every vector that counts is compared and counted; only centroids and these sums (k by dims) pass through the driver or go
to all tasks, whatever the number of vectors.

Kept are vectors with exactly `dims` components, none null, NaN or infinite, and none beyond LARGEST. Others have no row in
the result, and so has an empty table. Starts are the vectors with the smallest hashes of their ids (ties: the smaller
vector); rows without an id are assigned and counted, but no starts, and without any id in the table there is no result.
Rows that repeat stay and count each; with fewer vectors than k there are fewer clusters. Equal distances go to the smaller
number. A distance, or a sum of distances, beyond 63 bits is null. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise
from .lm import one_thread

K, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
#: Components above this size are not kept: their sums of squares would leave Spark's decimals.
LARGEST = float(1 << 52)
#: Up to this size of whole numbers, products of floating-point numbers are exact; beyond it, Python's whole numbers are used.
_EXACT = 1 << 22
_LONG = (1 << 63) - 1
_STATE = "v array<bigint>, owner int, distance bigint, before int"


def quantised(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """The id and v, the kept vectors as whole numbers."""
    good = (F.size(vector_col) == dims) & F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= LARGEST))  # NaN is greater
    return vectors.select(id_col, vector_col).filter(good).select(id_col, F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def starts(kept: DataFrame, *, id_col: str = "vec_id", k: int = K) -> np.ndarray:
    """The k vectors with the smallest hashes of 1:id, in the order of the hashes."""
    h = F.sha2(F.concat(F.lit("1:"), F.col(id_col).cast("string")), 256)
    rows = kept.filter(F.col(id_col).isNotNull()).select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], object)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids: whole numbers of floating point where they are exact, else Python's."""
    top = max(int(abs(x).max()) if x.size else 0 for x in (v, centroids))
    if top * top * v.shape[1] <= _EXACT * _EXACT * 64:
        a, b = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    a = v.astype(object)
    return np.stack([((a - c) ** 2).sum(1) for c in centroids], 1)


def reassigned(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, known: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances; `known`: vectors whose owner and distance hold if the owner's centroid has not changed."""
    owner, distance = owner.copy(), distance.astype(object)
    full = ~known | changed[owner]
    if full.any():
        d = distances(v[full], centroids)
        owner[full] = d.argmin(1)  # the first least: the smaller number
        distance[full] = d[np.arange(len(d)), owner[full]]
    some, rest = np.flatnonzero(changed), np.flatnonzero(~full)
    if len(some) and len(rest):
        d = distances(v[rest], centroids[some])
        j = d.argmin(1)
        least = d[np.arange(len(d)), j].astype(object)
        better = (least < distance[rest]) | ((least == distance[rest]) & (some[j] < owner[rest]))
        owner[rest[better]], distance[rest[better]] = some[j[better]], least[better]
    return owner, distance


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _assign(state: DataFrame, id_col: str, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """The next state: id, v, owner, distance, and the owner before (null in the first round)."""
    dims, first = centroids.shape[1], "owner" not in state.columns

    def run(batches):
        one_thread()
        for batch in batches:
            v, n = _vectors(batch, dims), batch.num_rows
            if first:
                before, distance, known = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
            else:
                before, known = batch.column("owner").to_numpy().astype(np.int64), batch.column("distance").is_valid().to_numpy(zero_copy_only=False)
                distance = batch.column("distance").fill_null(0).to_numpy()
            owner, distance = reassigned(v, before, distance, known, centroids, changed)
            fits = distance <= _LONG
            out = pa.array(np.where(fits, distance, 0).astype(np.int64), mask=~fits.astype(bool))
            last = pa.nulls(n, pa.int32()) if first else batch.column("owner")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("v"), pa.array(owner.astype(np.int32)), out, last], [id_col, "v", "owner", "distance", "before"])

    kind = dict(state.dtypes)[id_col]
    return state.select(id_col, "v", *([] if first else ["owner", "distance"])).mapInArrow(run, f"`{id_col}` {kind}, {_STATE}")


def transfers(state: DataFrame, k: int, dims: int) -> DataFrame:
    """cluster, pos, moved: what vectors that changed owner add to each component's sum, and to the size (pos -1)."""

    def run(batches):
        one_thread()
        total = np.zeros((k, dims + 1), object)
        for batch in batches:
            v = _vectors(batch, dims)
            v = np.concatenate([v, np.ones((len(v), 1), v.dtype)], 1)
            exact = not v.size or abs(v).max() * len(v) < 1 << 52
            for name, sign in (("owner", 1), ("before", -1)):
                who = batch.column(name).fill_null(-1).to_numpy()
                if exact:
                    total += sign * ((who == np.arange(k)[:, None]).astype(np.float64) @ v.astype(np.float64)).astype(np.int64).astype(object)
                else:
                    for c in range(k):
                        total[c] += sign * v[who == c].astype(object).sum(0)
        c, pos = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(np.where(pos == dims, -1, pos).astype(np.int32)), pa.array([Decimal(int(x)) for x in total[c, pos]], pa.decimal128(38, 0))], ["cluster", "pos", "moved"])

    gone = state.filter("before IS NULL OR before <> owner").select("v", "owner", "before")
    return gone.mapInArrow(run, "cluster int, pos int, moved decimal(38,0)").groupBy("cluster", "pos").agg(F.sum("moved").alias("moved"))


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, v, owner, distance) after so many rounds and a last assignment, and the centroids as whole numbers."""
    kept = quantised(vectors, id_col=id_col, vector_col=vector_col, dims=dims, scale=scale)
    centroids = starts(kept, id_col=id_col, k=k)
    if not len(centroids):
        return kept.filter("false").select(id_col, "v", F.lit(0).alias("owner"), F.lit(0).cast("long").alias("distance")), centroids
    k, sums = len(centroids), np.zeros((len(centroids), dims + 1), object)
    state, changed = kept, np.ones(k, bool)
    for r in range(rounds + 1):
        last, state = state, materialise(_assign(state, id_col, centroids, changed), "clusters")
        if r:
            discard(last)
        if r == rounds:
            break
        for t in transfers(state, k, dims).collect():  # k * (dims + 1) rows at most
            sums[t["cluster"], t["pos"]] += int(t["moved"])
        fresh = np.array([[s // row[-1] for s in row[:-1]] if row[-1] else list(c) for row, c in zip(sums, centroids)], object)
        changed = (fresh != centroids).any(1)
        centroids = fresh
        if not changed.any():
            break  # all later rounds would give the same
    return state.select(id_col, "v", "owner", "distance"), centroids


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kept embeddings with their cluster, distance, inertias and the digest of the centroid."""
    state, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = {r["owner"]: int(r["s"]) if not r["lost"] else None for r in state.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()}
    total = None if None in sums.values() else sum(sums.values())
    fit = lambda x: F.lit(x if x is not None and x <= _LONG else None).cast("long")
    digests = [hashlib.sha256(",".join(str(x) for x in c).encode()).hexdigest() for c in centroids]
    by_owner = lambda values: F.try_element_at(F.array(*values) if values else F.array().cast("array<string>"), F.col("owner") + 1)
    return state.select(
        "vec_id", F.col("owner").alias("cluster"), F.col("distance").cast("long").alias("distance"), by_owner([fit(sums.get(i)) for i in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        fit(total).alias("inertia"), by_owner([F.lit(d) for d in digests]).alias("centroid_sha256"),
    )


def _sql() -> str:
    """The rounds written out as a chain of tables: a* are assignments, c* centroids."""
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        f" WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {K}))",
    ]
    for r in range(ROUNDS + 1):
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT rid, vec_id, v, c, d FROM (SELECT k.*, c.c, list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::BIGINT AS d"
            f" FROM kept AS k, c{r} AS c) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"
        )
        if r < ROUNDS:
            parts.append(
                f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.v, o.v) AS v FROM c{r} AS o LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM"
                f" (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({DIMS})) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) AS n USING (c))"
            )
    return (
        "WITH " + ", ".join(parts) + f" SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,"
        f" sha256(array_to_string(f.v, ',')) AS centroid_sha256 FROM a{ROUNDS} AS a JOIN c{ROUNDS} AS f USING (c)"
    )


OP11_SQL = _sql()
