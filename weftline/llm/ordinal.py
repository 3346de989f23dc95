"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w . x - theta_k) with one weight vector for all grades and ordered thresholds. Features are
hashed: a text's distinct words, word beginnings and word ends (scaled by the root of their number), and bins of a few shares of the whole text.
The model is fitted in numpy on a bounded, documented sample of labelled rows (TRAIN_ROWS, those with the smallest hashes of
their ids); their features are computed in tasks and hashed, so a row's size is bounded whatever the length of its text.
Every document, of any length, is scored where it lies. The expected grade and the tail probabilities select documents.

A null or empty text has only its bins. Null ids are scored; they are never in the sample. If no labels are there, all
documents get the middle of the grades. Rows that repeat an id stay; of labels that disagree for one id, the lowest grade
counts. Equal texts have equal grades. An empty table gives an empty result. Other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_sample, mix, text_chunks, word_hashes, word_spans

BITS, BINS = 20, 16
#: Marks (up to so many) after a word are left off; the first bytes of a word are a feature as well.
MARK = np.zeros(256, bool)
MARK[[*b".,;:!?\"')]*#&$%|"]] = True
MARKS, PREFIX = 3, 6
#: The most labelled rows that the model is fitted on.
TRAIN_ROWS = 8000
EPOCHS, RATE, DECAY, BATCH = 60, 3.0, 1e-6, 256
#: Features that fewer labelled texts have keep no weight.
MIN_DF = 10

#: A document's grade by its labels (quality, toxic).
GRADES = {(0, 0): 0, (0, 1): 0, (1, 1): 1, (1, 0): 2}
TOP = 2


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of a chunk's rows: indexes, values, and where each row's features begin."""
    rows = len(offsets) - 1
    starts, ends, before = word_spans(data, offsets)
    size = np.diff(before)
    row = np.repeat(np.arange(rows), size)
    inner = ends.copy()
    for _ in range(MARKS if len(data) else 0):
        inner = inner - (MARK[data[inner - 1]] & (inner - starts > 1))
    h = word_hashes(data, starts, inner)
    head = word_hashes(data, starts, np.minimum(inner, starts + PREFIX))
    padded = np.concatenate([np.zeros(2, np.uint8), data]).astype(np.uint64)
    tail = padded[ends + 1] | (padded[ends] << np.uint64(8)) | (padded[ends - 1] << np.uint64(16))
    one = (mix(h) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    two = (mix(tail + np.uint64(1 << 40)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    three = (mix(head + np.uint64(1 << 41)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    key = np.unique(np.concatenate([(row << BITS) | x for x in (one, two, three)]))
    upper = (data >= 65) & (data <= 90)
    symbol = np.isin(data, np.frombuffer(b"#*$%&|<>!{}=_~^", np.uint8))
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    chars = np.maximum(np.diff(offsets), 1)
    distinct = np.bincount(np.unique((row << 40) | (h >> np.uint64(24)).astype(np.int64)) >> 40, minlength=rows)
    shares = [count(upper) / chars, count(symbol) / chars, distinct / np.maximum(size, 1), np.minimum(np.log2(size + 1) / 16, 1), count(data == 10) * 8 / chars, np.minimum(chars / np.maximum(size, 1) / 24, 1)]
    bins = np.stack([np.minimum((np.sqrt(np.clip(s, 0, 1)) * BINS).astype(np.int64), BINS - 1) + BINS * i for i, s in enumerate(shares)], 1)
    wide = np.bincount(key >> BITS, minlength=rows)
    index = np.concatenate([key & ((1 << BITS) - 1), ((1 << BITS) + bins).reshape(-1)])
    value = np.concatenate([1 / np.sqrt(np.maximum(wide, 1))[key >> BITS], np.full(bins.size, 0.5)])
    owner = np.concatenate([key >> BITS, np.repeat(np.arange(rows), bins.shape[1])])
    order = np.argsort(owner, kind="stable")
    return index[order], value[order], np.concatenate([[0], np.cumsum(wide + bins.shape[1])])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class CumulativeLink:
    """Weights, and thresholds as the first one and positive steps."""

    def __init__(self, grades: int = TOP):
        self.w, self.theta = np.zeros((1 << BITS) + 6 * BINS), np.linspace(-1, 1, grades)

    def fit(self, index, value, begin, grade) -> CumulativeLink:
        """AdaGrad over the log likelihood of grades, classes weighed by the root of their rarity."""
        n, k = len(grade), len(self.theta)
        seen = np.bincount(index, minlength=len(self.w)) >= MIN_DF  # others say nothing of other texts
        value = value * seen[index]
        freq = np.bincount(grade, minlength=k + 1)
        weight = np.sqrt(n / np.maximum(freq, 1))[grade]
        weight /= weight.mean()
        rng, g2, t2 = np.random.default_rng(1), np.full(len(self.w), 1e-2), np.full(k, 1e-2)
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for i in range(0, n, BATCH):
                some = order[i : i + BATCH]
                size = begin[some + 1] - begin[some]
                at = np.repeat(begin[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
                g, dt = self.gradient(index[at], value[at], np.repeat(np.arange(len(some)), size), grade[some], weight[some] / len(some))
                g += DECAY * self.w
                g2, t2 = g2 + g * g, t2 + dt * dt
                self.w -= RATE * g / np.sqrt(g2)
                self.theta = np.sort(self.theta - RATE * dt / np.sqrt(t2))
        return self

    def gradient(self, index, value, owner, grade, weight) -> tuple[np.ndarray, np.ndarray]:
        """Of the weighed negative log likelihood, by weights and thresholds; owner: the row of each feature."""
        k, r = len(self.theta), np.arange(len(grade))
        z = np.bincount(owner, self.w[index] * value, len(grade))
        p = _sigmoid(z[:, None] - self.theta)  # P(grade > j)
        full = np.concatenate([np.ones((len(grade), 1)), p, np.zeros((len(grade), 1))], 1)
        chance = np.maximum(full[r, grade] - full[r, grade + 1], 1e-9)
        slope = full * (1 - full)
        dz = -(slope[r, grade] - slope[r, grade + 1]) / chance * weight
        dt = np.zeros(k)
        np.add.at(dt, np.clip(grade - 1, 0, k - 1), np.where(grade > 0, slope[r, grade] / chance, 0) * weight)
        np.add.at(dt, np.clip(grade, 0, k - 1), np.where(grade < k, -slope[r, grade + 1] / chance, 0) * weight)
        return np.bincount(index, dz[owner] * value, len(self.w)), dt

    def tails(self, index, value, begin) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... of each row."""
        z = np.add.reduceat(self.w[index] * value, begin[:-1]) if len(index) else np.zeros(len(begin) - 1)
        return _sigmoid(z[:, None] - self.theta)


def fit_labels(docs: DataFrame, labels: DataFrame) -> CumulativeLink:
    """A model of the labelled documents: labels has doc_id, quality and toxic (0 or 1)."""
    pairs = [x for (q, t), g in GRADES.items() for x in (F.lit(q * 2 + t), F.lit(g))]
    graded = labels.select("doc_id", F.try_element_at(F.create_map(*pairs), (F.col("quality") * 2 + F.col("toxic")).cast("int")).alias("grade")).filter("grade IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    sample = hashed_sample(graded, "doc_id", TRAIN_ROWS)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch):
                index, value, begin = features(data, offsets)
                lists = [pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(x)) for x in (index.astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("grade").slice(i, j - i), *lists], ["doc_id", "grade", "index", "value"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = texts.select("doc_id", "text", F.col("grade").cast("int").alias("grade")).mapInArrow(run, f"doc_id {kind}, grade int, index array<int>, value array<double>")
    # Of texts that disagree for one id, one is taken by the order of its features.
    table = rows.groupBy("doc_id", "grade").agg(F.min(F.struct("index", "value")).alias("f")).select("doc_id", "grade", "f.index", "f.value").orderBy("doc_id").toArrow()
    model = CumulativeLink()
    if not table.num_rows:
        return model
    index, value = (table.column(c).combine_chunks() for c in ("index", "value"))
    size = np.diff(index.offsets.to_numpy())
    return model.fit(index.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)]), np.array(table.column("grade").to_pylist()))


def grade(docs: DataFrame, labels: DataFrame, *, least_tail: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_1, p_2 (chances of at least that grade) and kept (p_2 >= least_tail)."""
    model = fit_labels(docs, labels)
    weights = docs.sparkSession.sparkContext.broadcast((model.w.astype(np.float32), model.theta))  # a megabyte

    def run(batches):
        own = CumulativeLink()
        own.w, own.theta = weights.value
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch):
                p = own.tails(*features(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 1] >= least_tail)], ["doc_id", "expected_grade", "p_1", "p_2", "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_grade double, p_1 double, p_2 double, kept boolean")


def op9_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents graded by a model of the labels."""
    return grade(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
