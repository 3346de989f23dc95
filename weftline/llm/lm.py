"""Scores of texts by a small causal self-attention model over subword ids, and by a plain word model beside it.

The attention model is written in numpy. Its symbols are classes: the most frequent subwords are classes of their own,
the others share some by frequency; within a class, ids have their smoothed share of the corpus counts, which cover all
training documents. Classes are grouped in clusters; a prediction chooses a cluster, then a class in it, so that only
one cluster's classes are computed for a token. The output's biases are the log chances of classes after the class
before, counted over all training documents; attention over the window learns what these leave open.

Parameters start from a bounded sample of documents trained on the driver. Then training documents are dealt to shards
by a hash (as many as the corpus needs at SHARD_TOKENS each, so the model does not depend on how rows lie in partitions);
each shard trains a copy once on every token of its documents, in a fixed order, and the copies are averaged by their
tokens, in order of shards.

Scoring cuts each text in windows that overlap by a context; every token is scored once, with attention to what stands
before it in its window, batches of windows at a time. A text's score is the log10 probability of its ids and an end.

The word model (base_score) has add-one counts of all training words. The most frequent words' counts, of a bounded
number, go to every task; the other words of each document are joined with the table of counts.

A null or empty text is its end alone. A null id counts as training; rows that repeat an id stay. Equal texts have equal
scores, up to the rounding of single precision. A text of any length is scored whole, and in one row's memory. An empty
table gives an empty result. Other columns, whatever their names, are not read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import ctypes
import functools
import glob
import math
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, vocabulary_path
from .common import discard, hashed_sample, materialise, most_frequent, text_chunks, word_hashes, word_spans

FREQUENT, SHARED, CLUSTER = 1504, 32, 32
WIDTH, WINDOW, CONTEXT = 24, 48, 16
#: Inputs whose embeddings a place adds: its own and those just before.
BACK = 3
BATCH = 128
#: Batches of windows that a shard's texts are cut into at once.
HELD = 8
#: Windows scored at once, and those whose attention is computed at once.
SCORED, PART = 512, 48
#: Documents of the starting sample, of texts to so many characters; then shards train on all training documents.
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 200_000
STEPS, RATE, LOCAL_RATE = 400, 0.02, 0.005
#: Tokens of a shard (about), and groups in which copies are added.
SHARD_TOKENS, GROUPS = 1_000_000, 16
#: The weight of the chances without context in those after a class, in tokens.
PRIOR_TOKENS = 30.0
#: Words whose counts go to every task.
KNOWN_WORDS = 1 << 19
#: Words after which a worker reports its counts.
REPORT_WORDS = 2_000_000
_END_WORD = np.uint64(0x5EED0E4D)


@functools.cache
def one_thread() -> None:
    """Let numpy's BLAS use one thread in this process: its products are small, and Spark fills the cores with tasks."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break


class Classes:
    """Classes of ids, and the log share of each id in its class. The last id is the end."""

    def __init__(self, counts: np.ndarray):
        order = np.lexsort((np.arange(len(counts)), -counts))
        self.of = np.empty(len(counts), np.int64)
        self.of[order[:FREQUENT]] = np.arange(min(FREQUENT, len(counts)))
        rest = order[FREQUENT:]
        if len(rest):
            mass = np.cumsum(counts[rest] + 1.0)
            self.of[rest] = FREQUENT + np.minimum((mass - counts[rest] - 1) * SHARED / mass[-1], SHARED - 1).astype(np.int64)
        total = np.bincount(self.of, counts + 1.0, FREQUENT + SHARED)
        self.inside = np.log((counts + 1.0) / total[self.of])
        self.prior = (total + 1) / (total + 1).sum()
        self.n = FREQUENT + SHARED


class Attention:
    """One layer of causal self-attention. p: parameters by name (float32); before, inside: fixed biases by the class before.

    pairs: how often each class (column) follows each class or the start (row), over all training documents.
    """

    def __init__(self, prior: np.ndarray, pairs: np.ndarray | None = None, seed: int = 1):
        rng, d, c = np.random.default_rng(seed), WIDTH, len(prior)
        draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.p = {"embed": draw(BACK, c + 1, d), "place": draw(WINDOW, d), "qkv": draw(d, 3 * d), "o": draw(d, d), "pick": draw(d, c // CLUSTER), "pick_bias": np.zeros(c // CLUSTER, np.float32), "out": draw(c // CLUSTER, d, CLUSTER), "bias": np.zeros((c // CLUSTER, CLUSTER), np.float32)}
        self.mask = np.tril(np.ones((WINDOW, WINDOW), np.float32))
        chance = np.zeros((c + 1, c), np.float32) + prior.astype(np.float32) if pairs is None else (pairs + PRIOR_TOKENS * prior) / (pairs.sum(1, keepdims=True) + PRIOR_TOKENS)
        group = chance.reshape(c + 1, -1, CLUSTER).sum(2)
        self.before = np.log(group).astype(np.float32)
        self.inside = np.log(chance.reshape(c + 1, -1, CLUSTER) / group[:, :, None]).transpose(1, 0, 2).reshape(-1, CLUSTER).astype(np.float32)

    def pack(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in self.p.values()])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k, x in self.p.items():
            self.p[k], at = flat[at : at + x.size].reshape(x.shape).astype(np.float32), at + x.size

    def hidden(self, inputs: np.ndarray, first: int = 0):
        """States at the places from `first` on, and what led to them: embedded inputs, queries, keys, values, weights, sums."""
        p, d, n = self.p, WIDTH, len(inputs)
        x = p["embed"][0][inputs]
        x += p["place"]
        for back in range(1, BACK):
            x[:, back:] += p["embed"][back][inputs[:, :-back]]
        weights = p["qkv"].copy()
        weights[:, :d] /= np.float32(math.sqrt(d))
        if first:
            q = (x[:, first:].reshape(-1, d) @ weights[:, :d]).reshape(n, -1, d)
            kv = (x.reshape(-1, d) @ weights[:, d:]).reshape(n, WINDOW, 2 * d)
            k, v = kv[..., :d], kv[..., d:]
        else:
            qkv = (x.reshape(-1, d) @ weights).reshape(n, WINDOW, 3 * d)
            q, k, v = qkv[..., :d], qkv[..., d : 2 * d], qkv[..., 2 * d :]
        a = q @ k.transpose(0, 2, 1)
        if not (a.max(initial=0) < 20 and a.min(initial=0) > -20):
            a[:, self.mask[first:] == 0] = -np.inf
            a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        a *= self.mask[first:]
        a /= (a.reshape(-1, WINDOW) @ np.ones(WINDOW, a.dtype)).reshape(n, -1, 1)
        o = a @ v
        h = (o.reshape(-1, d) @ p["o"]).reshape(n, -1, d)
        h += x[:, first:]
        return x, q, k, v, a, o, h

    def log_chance(self, inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the targets under `scored` (flat, in order); before each stands its input."""
        out = np.empty(int(scored.sum()))
        place = np.cumsum(scored).reshape(scored.shape) - 1
        later = ~scored[:, :CONTEXT].any(1)  # windows whose first places are context alone
        for some, first in ((np.flatnonzero(~later), 0), (np.flatnonzero(later), CONTEXT)):
            for k in range(0, len(some), SCORED):
                which = some[k : k + SCORED]
                on = scored[which][:, first:]
                h = np.concatenate([self.hidden(inputs[which[i : i + PART]], first)[-1] for i in range(0, len(which), PART)])[on]
                out[place[which][:, first:][on]] = self._output(h, inputs[which][:, first:][on], targets[which][:, first:][on])[0]
        return out

    def _output(self, h: np.ndarray, previous: np.ndarray, t: np.ndarray, grads: dict | None = None):
        """Log probabilities of targets t after hidden states h and classes before; with grads, those of the summed loss are put there."""
        p, n = self.p, len(t)
        order = np.argsort(t.astype(np.int16), kind="stable")  # so that a cluster's rows are together
        states = np.ones((n, WIDTH + 1), h.dtype)  # the ones stand before the biases
        states[:, :-1] = h[order]
        previous, t = previous[order], t[order]
        group, rows = t // CLUSTER, np.arange(n)
        bounds = np.searchsorted(group, np.arange(len(p["out"]) + 1)).tolist()
        some = [(c, slice(i, j)) for c, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False)) if i < j]
        pick, out = np.concatenate([p["pick"], p["pick_bias"][None]]), np.concatenate([p["out"], p["bias"][:, None]], 1)
        z = states @ pick
        z += self.before[previous]
        y = self.inside[group * len(self.before) + previous]
        for c, at in some:
            y[at] += states[at] @ out[c]
        chance, dh = np.empty(n), None
        for x, own in ((z, group), (y, t % CLUSTER)):
            told = x[rows, own].astype(np.float64)
            np.exp(x, out=x)
            total = x @ np.ones(x.shape[1], x.dtype)
            told -= np.log(total)
            chance[order] = told if x is z else chance[order] + told
            if grads is not None:
                x *= (1 / total)[:, None]
                x[rows, own] -= 1
        if grads is not None:
            g_pick, g_out = states.T @ z, np.zeros_like(out)
            part = z @ p["pick"].T
            for c, at in some:
                g_out[c] = states[at].T @ y[at]
                part[at] += y[at] @ p["out"][c].T
            grads |= {"pick": g_pick[:-1], "pick_bias": g_pick[-1], "out": g_out[:, :-1], "bias": g_out[:, -1]}
            dh = np.empty_like(part)
            dh[order] = part
        return chance, dh

    def gradient(self, inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        p, d, g = self.p, WIDTH, {}
        x, q, k, v, a, o, h = self.hidden(inputs)
        chance, part = self._output(h[scored], inputs[scored], targets[scored], g)
        n = h.dtype.type(len(chance))
        g, loss = {name: y / n for name, y in g.items()}, -float(chance.mean())
        dh = np.zeros_like(h)
        dh[scored] = part / n
        flat = lambda y: y.reshape(-1, y.shape[-1])
        g["o"], do = flat(o).T @ flat(dh), (flat(dh) @ p["o"].T).reshape(dh.shape)
        ds = do @ v.transpose(0, 2, 1)
        ds -= np.einsum("ijk,ijk->ij", do, o)[..., None]
        ds *= a
        dqkv = np.concatenate([ds @ k, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ do], -1)
        dqkv[..., :d] /= h.dtype.type(math.sqrt(d))
        dx = np.zeros((dh.size // d + 1, d), h.dtype)  # a row of zeros at its end
        np.matmul(flat(dqkv), p["qkv"].T, out=dx[:-1])
        dx[:-1] += flat(dh)
        g |= {"qkv": flat(x).T @ flat(dqkv), "place": dx[:-1].reshape(len(dh), -1).sum(0).reshape(WINDOW, d), "embed": np.zeros_like(p["embed"])}
        seen = inputs.reshape(-1).astype(np.int16)
        order = np.argsort(seen, kind="stable")
        seen, place = seen[order], order % WINDOW
        first = np.concatenate([[0], np.flatnonzero(seen[1:] != seen[:-1]) + 1])
        moved = np.empty((len(order), BACK * d), h.dtype)
        for back in range(BACK):  # the place `back` further on sees this input
            moved[:, back * d : (back + 1) * d] = dx[np.where(place + back < WINDOW, order + back, len(order))]
        g["embed"][:, seen[first]] = np.add.reduceat(moved, first).reshape(-1, BACK, d).transpose(1, 0, 2)
        return g, loss


class Adam:
    def __init__(self, model: Attention, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate, wide = self.rate / (1 - 0.9**self.t), 1 / math.sqrt(1 - 0.99**self.t)
        for k, x in g.items():
            m, v, y = self.m[k], self.v[k], x * np.float32(0.1)  # y: room for what is computed
            m *= np.float32(0.9)
            m += y
            np.multiply(x, x, out=y)
            y *= np.float32(0.01)
            v *= np.float32(0.99)
            v += y
            np.sqrt(v, out=y)
            y *= np.float32(wide)
            y += np.float32(1e-7)
            np.divide(m, y, out=y)
            y *= np.float32(rate)
            self.model.p[k] -= y


def windows(classes: np.ndarray, where: np.ndarray, start: int, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts: inputs, targets, what is scored (windows x WINDOW), the position scored, and rows by window.

    classes: of the ids and ends of all texts; where: each text's bounds in them; start: the class that stands before;
    context: how many places of each window but a text's first are not scored.
    """
    size = np.diff(where)
    stride = WINDOW - context
    count = 1 + np.maximum(0, -(-(size - WINDOW) // stride))
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    place = (nth * stride)[:, None] + np.arange(WINDOW)
    real = place < size[row][:, None]
    at = where[row][:, None] + np.where(real, place, 0)
    scored = real & ((nth == 0)[:, None] | (np.arange(WINDOW) >= context))
    targets = classes[at]
    inputs = np.where(place == 0, start, classes[np.maximum(at - 1, 0)])
    inputs[~real] = start
    return inputs, targets, scored, at, row


def _subwords(enc, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a chunk's texts, each followed by the end's id (one more than the vocabulary's), and their bounds."""
    ids, where = enc.encode(data, offsets)
    end = len(enc.tokens)
    return np.insert(ids.astype(np.int64), where[1:], end), where + np.arange(len(where))


def _rows(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names)


def _counts(train: DataFrame, path: str) -> DataFrame:
    """kind 0: hashes of words and how often a worker saw them; kind 1: the same of subword ids."""

    def run(batches):
        enc = encoder(path)
        total, seen, held, texts = np.zeros(len(enc.tokens) + 1, np.int64), [], 0, 0

        def report():
            h, n = np.unique(np.concatenate([*seen, np.full(texts, _END_WORD)]), return_counts=True)
            return _rows([pa.array(np.zeros(len(h), np.int32)), pa.array(h.view(np.int64)), pa.array(n)], ["kind", "h", "n"])

        for batch in batches:
            for i, j, data, offsets in text_chunks(batch):
                starts, ends, _ = word_spans(data, offsets)
                seen.append(word_hashes(data, starts, ends))
                held, texts = held + len(starts), texts + j - i
                total += np.bincount(_subwords(enc, data, offsets)[0], minlength=len(total))
                if held > REPORT_WORDS:
                    yield report()
                    seen, held, texts = [], 0, 0
        if texts:
            yield report()
        some = np.flatnonzero(total)
        yield _rows([pa.array(np.ones(len(some), np.int32)), pa.array(some), pa.array(total[some])], ["kind", "h", "n"])

    return train.select("text").mapInArrow(run, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n"))


def _pieces(train: DataFrame, classes: Classes, path: str, shards: int) -> DataFrame:
    """kind 0: each text's classes (16-bit numbers in a binary) with its shard and order in it; kind 1: class pairs (order: their number) that a worker saw n times."""
    order = F.xxhash64("doc_id", "text")
    of = sc_broadcast(train, classes.of.astype(np.uint16))
    wide = classes.n

    def run(batches):
        enc, total = encoder(path), np.zeros((wide + 1) * wide, np.int64)
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch):
                ids, where = _subwords(enc, data, offsets)
                own = of.value[ids]
                previous = np.concatenate([[wide], own[:-1]]).astype(np.int64)
                previous[where[:-1]] = wide
                total += np.bincount(previous * wide + own, minlength=len(total))
                parts = [own[x:y].tobytes() for x, y in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]
                yield _rows([pa.array(np.zeros(j - i, np.int32)), batch.column("shard").slice(i, j - i), batch.column("order").slice(i, j - i), pa.array(np.diff(where)), pa.array(parts, pa.binary())], ["kind", "shard", "order", "n", "classes"])
        some = np.flatnonzero(total)
        yield _rows([pa.array(np.ones(len(some), np.int32)), pa.nulls(len(some), pa.int32()), pa.array(some), pa.array(total[some]), pa.nulls(len(some), pa.binary())], ["kind", "shard", "order", "n", "classes"])

    rows = train.select("text", F.pmod(order, F.lit(shards)).cast("int").alias("shard"), order.alias("order"))
    return rows.mapInArrow(run, "kind int, shard int, order long, n long, classes binary")


def sc_broadcast(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)


class Trainer:
    """One pass of a copy of the model over texts as they come, a batch of windows at a time; `finish` trains on the rest."""

    def __init__(self, model: Attention, begun: np.ndarray, start: int):
        model.unpack(begun)
        self.model, self.adam, self.start = model, Adam(model, LOCAL_RATE), start
        #: Texts that are held, and the windows of those before them that made no whole batch.
        self.held: list[np.ndarray] = []
        self.rest = [np.zeros((0, WINDOW), kind) for kind in (np.int64, np.int64, bool)]
        self.n_held, self.tokens = 0, 0

    def learn(self, some) -> None:
        self.adam.step(self.model.gradient(*some)[0])
        self.tokens += int(some[2].sum())

    def add(self, classes: np.ndarray) -> None:
        self.held.append(classes)
        self.n_held += -(-len(classes) // WINDOW)
        if self.n_held >= HELD * BATCH:
            self.learn_held(BATCH)

    def learn_held(self, least: int) -> None:
        """Learn the windows held, in batches, as long as there are `least` of them."""
        where = np.cumsum([0, *map(len, self.held)])
        some = self.rest
        if self.held:
            own = windows(np.concatenate(self.held).astype(np.int64), where, self.start, 0)
            some = [np.concatenate(x) for x in zip(some, own[:3], strict=True)]
        at, n = 0, len(some[0])
        while n - at >= least:
            self.learn([x[at : at + BATCH] for x in some])
            at = min(n, at + BATCH)
        self.rest, self.held, self.n_held = [x[at:].copy() for x in some], [], n - at

    def finish(self) -> tuple[np.ndarray, int]:
        if self.n_held:
            self.learn_held(1)
        return self.model.pack(), self.tokens


def started(sample: DataFrame, model: Attention, classes: Classes, path: str) -> None:
    """Train the model on a bounded sample of texts, on the driver."""
    texts = sample.orderBy("doc_id", "text").select("text").toArrow().combine_chunks()
    if not texts.num_rows:
        return
    enc = encoder(path)
    parts = [windows(classes.of[ids], where, classes.n, 0)[:3] for _, _, data, offsets in text_chunks(texts.to_batches()[0]) for ids, where in [_subwords(enc, data, offsets)]]
    inputs, targets, scored = (np.concatenate(x) for x in zip(*parts, strict=True))
    rng, epochs = np.random.default_rng(1), min(8, -(-STEPS * BATCH // len(inputs)))
    steps = min(STEPS, epochs * -(-len(inputs) // BATCH))
    adam, k = Adam(model, RATE), 0
    for _ in range(epochs):
        order = rng.permutation(len(inputs))
        for i in range(0, len(order), BATCH):
            if k == steps:
                return
            some = order[i : i + BATCH]
            adam.rate, k = RATE * (1 - 0.8 * k / steps), k + 1
            adam.step(model.gradient(inputs[some], targets[some], scored[some])[0])


def train_model(train: DataFrame, classes: Classes, path: str, tokens: int) -> Attention:
    """An attention model of the training texts (doc_id, text), which have so many tokens."""
    one_thread()
    shards = max(1, round(tokens / SHARD_TOKENS))
    pieces = materialise(_pieces(train, classes, path, shards), "pieces")
    pairs = np.zeros((classes.n + 1) * classes.n)
    seen = pieces.filter("kind = 1").groupBy("order").agg(F.sum("n").alias("n")).toArrow()  # at most one row for each pair of classes
    pairs[seen.column("order").to_numpy()] = seen.column("n").to_numpy()
    model = Attention(classes.prior, pairs.reshape(classes.n + 1, classes.n))
    started(hashed_sample(train.filter(F.length("text") <= SAMPLE_CHARS), "doc_id", SAMPLE_DOCS), model, classes, path)
    start, begun = classes.n, sc_broadcast(train, (model, model.pack()))

    def local(batches):
        one_thread()
        at, own = None, None

        def done():
            p, n = own.finish()
            return _rows([pa.array([at], pa.int32()), pa.array([(p * np.float64(n)).astype("<f8").tobytes()], pa.binary()), pa.array([float(n)])], ["shard", "p", "n"])

        for batch in batches:
            for shard, text in zip(batch.column("shard").to_pylist(), batch.column("classes"), strict=True):
                if shard != at:
                    if own:
                        yield done()
                    at, own = shard, Trainer(*begun.value, start)
                own.add(np.frombuffer(text.as_buffer(), np.uint16))
        if own:
            yield done()

    def added(batches):
        at, total, n = None, 0, 0.0
        for batch in batches:
            for group, p, k in zip(*[batch.column(c).to_pylist() for c in ("g", "p", "n")], strict=True):
                if group != at and n:
                    yield _rows([pa.array([at], pa.int32()), pa.array([total.astype("<f8").tobytes()], pa.binary()), pa.array([n])], ["shard", "p", "n"])
                    total, n = 0, 0.0
                at, total, n = group, total + np.frombuffer(p, "<f8"), n + k
        if n:
            yield _rows([pa.array([at], pa.int32()), pa.array([total.astype("<f8").tobytes()], pa.binary()), pa.array([n])], ["shard", "p", "n"])

    kind = "shard int, p binary, n double"
    dealt = pieces.filter("kind = 0").select("shard", "order", "classes").repartition("shard").sortWithinPartitions("shard", "order", "classes")
    copies = materialise(dealt.mapInArrow(local, kind), "copies")
    grouped = copies.withColumn("g", F.floor(F.col("shard") * F.lit(GROUPS) / F.lit(shards)).cast("int"))
    sums = grouped.repartition("g").sortWithinPartitions("g", "shard").select("g", "p", "n").mapInArrow(added, kind).collect()  # GROUPS rows of the parameters' size
    if sums:
        sums.sort(key=lambda r: r["shard"])
        model.unpack(sum(np.frombuffer(r["p"], "<f8") for r in sums) / sum(r["n"] for r in sums))
    discard(pieces, copies)
    return model


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    path = path or vocabulary_path()
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    train = docs.filter("NOT held_out")
    counts = materialise(_counts(train, path), "counts")
    words = counts.filter("kind = 0")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    low = total + distinct + 1
    top = most_frequent(words.select("h", "n"), "n", KNOWN_WORDS).toArrow()  # its size is bounded
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    known = docs.sparkSession.sparkContext.broadcast((h[order], n[order]))
    by_id = np.zeros(len(encoder(path).tokens) + 1, np.int64)
    for r in counts.filter("kind = 1").collect():  # at most one row for each id of the vocabulary
        by_id[r["h"]] = r["n"]
    classes = Classes(by_id)
    trained = sc_broadcast(docs, (train_model(train, classes, path, int(by_id.sum())), classes))

    def run(batches):
        one_thread()
        enc, (own, classes) = encoder(path), trained.value
        h, n = known.value
        # Where words whose hashes begin with 20 given bits begin in the sorted table.
        first = np.searchsorted(h, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44))
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch):
                rows = j - i
                starts, ends, before = word_spans(data, offsets)
                w = word_hashes(data, starts, ends)
                row = np.repeat(np.arange(rows), np.diff(before))
                w, row = np.concatenate([w, np.full(rows, _END_WORD)]), np.concatenate([row, np.arange(rows)])
                at, hit = first[(w >> np.uint64(44)).astype(np.int64)], np.zeros(len(w), bool)
                open_ = np.arange(len(w))
                while len(h) and len(open_):
                    here = h[np.minimum(at[open_], len(h) - 1)]
                    hit[open_[here == w[open_]]] = True
                    open_ = open_[(here < w[open_]) & (at[open_] < len(h))]
                    at[open_] += 1
                base = np.bincount(row[hit], np.log10(n[at[hit]] + 1.0), rows)
                n_hit = np.bincount(row[hit], minlength=rows)
                order = np.argsort(row[~hit], kind="stable")
                tail, tail_row = w[~hit][order], row[~hit][order]
                bounds = np.searchsorted(tail_row, np.arange(rows + 1))
                ids, where = _subwords(enc, data, offsets)
                inside = classes.inside[ids]
                result = np.add.reduceat(inside, where[:-1])
                inputs, targets, scored, at, of = windows(classes.of[ids], where, classes.n)
                result += np.bincount(np.repeat(of, scored.sum(1)), own.log_chance(inputs, targets, scored), rows)
                check = [zlib.crc32(data[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield _rows(
                    [batch.column("doc_id").slice(i, rows), batch.column("held_out").slice(i, rows), pa.array(np.diff(before) + 1), pa.array(n_hit), pa.array(base), pa.array(result / math.log(10)), pa.array(check, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tail.view(np.int64)))],
                    ["doc_id", "held_out", "n_tokens", "n_hit", "base", "score", "check", "tail"],
                )

    kind = "doc_id long, held_out boolean, n_tokens long, n_hit long, base double, score double, check long, tail array<long>"
    done = materialise(docs.mapInArrow(run, kind), "scores")
    key = F.xxhash64("doc_id", "check", "n_tokens", "score")
    # The rest of the words, and, without a join, one row for each document: rows that repeat a key are counted by it.
    rest = done.select(key.alias("key"), F.explode("tail").alias("h")).join(words.select("h", "n"), "h").select("key", F.log10(F.col("n") + 1.0).alias("more"), F.lit(1).alias("n_more"), F.lit(0).alias("copies"))
    own = done.select(key.alias("key"), F.lit(None).cast("double").alias("more"), F.lit(0).alias("n_more"), F.lit(1).alias("copies"))
    rest = rest.unionByName(own).groupBy("key").agg(F.sum("more").alias("more"), F.sum("n_more").alias("n_more"), F.sum("copies").alias("copies"))
    out = done.drop("tail").withColumn("key", key).join(rest, "key")
    n_known = (F.col("n_hit") + (F.col("n_more") / F.col("copies")).cast("long")).alias("n_known")
    base = (F.col("base") + F.coalesce("more", F.lit(0.0)) / F.col("copies") - F.col("n_tokens") * math.log10(low)).alias("base_score")
    return out.select("doc_id", "held_out", "n_tokens", n_known, F.lit(total).cast("long").alias("train_tokens"), base, "score")


def op5_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' scores."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
