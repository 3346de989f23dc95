"""Toxicity: many weak voters, a generative model of their errors, and a linear classifier of the labels it infers.

Voters say that a text may be toxic, or say nothing: some are patterns that are written down here (a short list of insults,
insults after a form of address, letters masked by signs, shouting, rows of marks), some are lexicons of words and of word
beginnings and ends that are mined from the labelled sample. A generative model explains which voters speak together: the
hidden label, each voter's chance to speak under either label (its accuracy), and a tree of dependences between voters given
the label (their correlations; Chow-Liu). A given label is one more, noisy voter, or abstains. The model is fitted by
expectation-maximisation to the counts of vote patterns (at most 2^12 by three states of the label) of all training
documents, labelled or not. A logistic regression on words, word beginnings and word ends is then trained on the posterior
labels of the sample, and scores every document where it lies, of any length.

Training rows are those whose crc32(doc_id as text) mod 5 is not 0. The sample holds TRAIN_ROWS labelled training rows at
most, those with the smallest hashes of their ids; its features are computed in tasks and hashed over BUCKETS, so a row's
size is bounded whatever its length. Only texts are inputs of a score.

A null text is an empty one, and empty texts get the score of a text without any feature. Rows without an id are scored, and
are neither held out nor labelled. Rows that repeat an id stay; of labels that disagree for one id the toxic one counts, of
texts that disagree one is taken by the order of their features. Equal texts have equal scores. Without labels of both kinds
all documents get the middle or the share of what there is. An empty table gives an empty result. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, discard, materialise, mix, text_chunks, word_hashes

#: The most labelled rows of the sample, the part of ids that is held out, and the buckets of features.
TRAIN_ROWS, HELD_OUT, BUCKETS = 12_000, 5, 1 << 22
#: Bytes of word beginnings and ends that are features, and how many distinct words with one are told apart.
HEADS, TAILS, LEVELS = (4, 5, 6, 7, 8), (4, 5), 3
#: Features the classifier may have, and how clear (z) a feature's difference between labels must be.
MOST_FEATURES, CLEAR = 4096, 2.5
#: Mined voters of either kind (words; beginnings and ends), features of each, and how alike two features' documents may be.
MINED, EACH, ALIKE = 3, 6, 0.8
STEPS, RATE, SHRINK, ROUNDS = 300, 0.05, 1.0, 40
#: The least share of toxic texts among those that have a mined voter's feature.
PRECISE = 0.6
#: How often a given label may be wrong, at most: P(1 | hidden 0), P(0 | hidden 1).
WRONG = (0.02, 0.02)

#: Insults, and forms of address that stand shortly before one.
INSULTS = """idiot moron stupid loser trash scum worthless pathetic disgusting clown dumb fool imbecile jerk creep garbage filth
idiotin dummkopf trottel arschloch depp blöd dumm abschaum versager dreckig
idiote imbécile crétin abruti connard débile minable raclure ordure nul
idiota imbécil estúpido tonto basura patético inútil asqueroso payaso escoria""".split()
ADDRESS = "you your youre du dein bist ihr euch tu toi vous es êtes eres tú usted sois".split()
NEAR = 3
PATTERNS = ("insults", "addressed", "masked", "shouting", "marks")
VOTERS = (*PATTERNS, *(f"words_{i}" for i in range(MINED)), *(f"parts_{i}" for i in range(MINED)), "quiet")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MASK = np.zeros(256, bool)
_MASK[[*b"*@$#"]] = True
_KINDS = {("word", 0): 1, **{("head", n): 10 + n for n in HEADS}, **{("tail", n): 30 + n for n in TAILS}}


def _hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return np.sort(word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


class Chunk:
    """The words of a chunk of texts: runs of letters and digits, each distinct word of a row once."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        inside, edge = _LETTER[data], np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        first, last = edge[:-1].copy(), edge[1:].copy()
        first[1:] |= ~inside[:-1]
        last[:-1] |= ~inside[1:]
        self.all_starts, self.all_ends = np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1
        self.all_row = np.searchsorted(offsets, self.all_starts, "right") - 1
        self.all_h = word_hashes(data, self.all_starts, self.all_ends)
        key = mix(self.all_h ^ mix(self.all_row.astype(np.uint64) + np.uint64(1)))
        one = np.unique(key, return_index=True)[1]
        self.starts, self.ends, self.row, self.h = self.all_starts[one], self.all_ends[one], self.all_row[one], self.all_h[one]

    def found(self, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, level) of all features, or of wanted ones: in how many distinct words of the row it is, up to LEVELS."""
        keys = []
        for (kind, n), salt in _KINDS.items():
            if kind == "word":
                row, h = self.row, self.h
            else:
                some = self.ends - self.starts > n
                a, b, row = self.starts[some], self.ends[some], self.row[some]
                h = word_hashes(self.data, a, a + n) if kind == "head" else word_hashes(self.data, b - n, b)
            f = (mix(h + np.uint64(salt)) & np.uint64(BUCKETS - 1)).astype(np.int64)
            if wanted is not None:
                row, f = row[wanted[f]], f[wanted[f]]
            keys.append(row * BUCKETS + f)
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        return key // BUCKETS, key % BUCKETS, np.minimum(n, LEVELS)

    def count(self, mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[self.offsets])

    def patterns(self) -> np.ndarray:
        """Whether each of PATTERNS speaks for each row."""
        d, out = self.data, np.zeros((self.rows, len(PATTERNS)), bool)
        if not len(d):
            return out
        insult, address = _among(self.all_h, _INSULTS), _among(self.all_h, _ADDRESS)
        out[:, 0] = np.bincount(self.all_row, insult, self.rows) > 0
        for k in range(1, NEAR + 1):
            close = insult[k:] & address[:-k] & (self.all_row[k:] == self.all_row[:-k])
            out[:, 1] |= np.bincount(self.all_row[k:], close, self.rows) > 0
        letter, low = _LETTER[d], LOWER[d]
        masked = np.zeros(len(d), bool)
        masked[1:-1] = _MASK[d[1:-1]] & letter[:-2] & letter[2:]
        out[:, 2] = self.count(masked) > 0
        upper = self.count(low != d)
        out[:, 3] = (upper > 20) & (2 * upper > self.count(letter))
        twice = np.zeros(len(d), bool)
        twice[1:] = (d[1:] == 33) & (d[:-1] == 33)
        out[:, 4] = self.count(twice) > 0
        return out


_INSULTS, _ADDRESS = _hashes(INSULTS), _hashes(ADDRESS)


class LabelModel:
    """A hidden label, voters that depend on it and along a tree on each other, and a given label that may err or be missing."""

    def fit(self, votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
        """votes: distinct patterns by voters; counts: of each pattern without a label, with label 0, with label 1."""
        x, n = votes.astype(float), counts.astype(float)
        given = n[:, 1:].sum(0)
        self.label = np.array([WRONG[0], 1 - WRONG[1]])  # P(given label is 1 | hidden label)
        share = np.clip((given[1] + 1) / (given.sum() + 2), 1e-3, 0.999)
        q = np.tile([share, 0.02, 0.98], (len(x), 1))
        self._learn(x, n * [0, 1, 1] if given.sum() else n, q)
        for _ in range(rounds):
            q = np.stack([self.posterior(votes, np.full(len(x), y)) for y in (-1, 0, 1)], 1)
            self._learn(x, n, q)
        return self

    def _learn(self, x: np.ndarray, n: np.ndarray, q: np.ndarray) -> None:
        w = np.stack([(n * (1 - q)).sum(1), (n * q).sum(1)])  # by hidden label
        size = w.sum(1)
        self.prior = (size[1] + 1) / (size.sum() + 2)
        for y, part in enumerate((1 - q, q)):
            one, both = (n * part)[:, 2].sum(), (n * part)[:, 1:].sum()
            self.label[y] = np.clip((one + (0.1, 9.5)[y]) / (both + 10), *((1e-4, WRONG[0]), (1 - WRONG[1], 0.999))[y])
        v = x.shape[1]
        pair = np.zeros((2, v, v, 2, 2))
        for y in (0, 1):
            for a in (0, 1):
                for b in (0, 1):
                    pair[y, :, :, a, b] = (np.abs(1 - a - x) * w[y][:, None]).T @ np.abs(1 - b - x)
        self.pair = pair = pair + 0.5
        p = pair / pair.sum((3, 4), keepdims=True)
        gain = (p * np.log(p / (p.sum(4, keepdims=True) * p.sum(3, keepdims=True)))).sum((3, 4))
        weight = (size[:, None, None] * gain).sum(0)
        self.parent, left = np.full(v, -1), set(range(1, v))
        best = {j: (weight[0, j], 0) for j in left}
        while left:  # the heaviest tree
            j = max(left, key=lambda k: best[k][0])
            self.parent[j] = best[j][1]
            left.remove(j)
            for k in left:
                best[k] = max(best[k], (weight[j, k], j))
        self.accuracy = p.sum(3)[:, 0, :, 1] if v else np.zeros((2, 0))  # P(speaks | label)
        self.chance = np.zeros((2, v, 2))  # P(speaks | label, what the parent does)
        for j in range(v):
            for y in (0, 1):
                self.chance[y, j] = pair[y, self.parent[j], j, :, 1] / pair[y, self.parent[j], j].sum(1) if j else pair[y, 0, 0, 1, 1] / (pair[y, 0, 0, 0, 0] + pair[y, 0, 0, 1, 1])

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """P(hidden label is 1) by votes and the given label (-1: none)."""
        votes = votes.astype(np.int64)
        logs = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for y in (0, 1):
            for j, parent in enumerate(self.parent):
                p = self.chance[y, j][votes[:, parent] if parent >= 0 else 0]
                logs[:, y] += np.log(np.where(votes[:, j] == 1, p, 1 - p))
            logs[:, y] += np.select([label == 1, label == 0], [np.log(self.label[y]), np.log(1 - self.label[y])], 0)
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))

    def correlations(self) -> list[tuple[int, int, float, float]]:
        """Voters on an edge of the tree, and how they correlate (phi) under label 0 and label 1."""
        out = []
        for j, i in enumerate(self.parent):
            if i >= 0:
                phi = []
                for t in self.pair[:, i, j]:
                    r, c = t.sum(1), t.sum(0)
                    phi.append(float((t[0, 0] * t[1, 1] - t[0, 1] * t[1, 0]) / np.sqrt(r.prod() * c.prod())))
                out.append((int(i), j, *phi))
        return out


class Model:
    """Mined voters, the label model, and the weights of features (sorted) by level."""

    def __init__(self):
        self.features, self.voter, self.level = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.weights, self.of_votes, self.bias, self.labels = np.zeros((0, LEVELS)), np.zeros(len(VOTERS)), 0.0, LabelModel()

    def wanted(self) -> np.ndarray:
        out = np.zeros(BUCKETS, bool)
        out[self.features] = True
        return out

    def votes(self, patterns: np.ndarray, row: np.ndarray, feature: np.ndarray, level: np.ndarray) -> np.ndarray:
        """All voters' votes: `quiet` speaks where no mined voter does."""
        out = np.zeros((len(patterns), len(VOTERS)), bool)
        out[:, : len(PATTERNS)] = patterns
        at = np.searchsorted(self.features, feature)
        speaks = (self.voter[at] >= 0) & (level >= self.level[at])
        out[row[speaks], len(PATTERNS) + self.voter[at][speaks]] = True
        out[:, -1] = ~out[:, len(PATTERNS) : -1].any(1)
        return out

    def score(self, votes: np.ndarray, row: np.ndarray, feature: np.ndarray, level: np.ndarray) -> np.ndarray:
        z = np.bincount(row, self.weights[np.searchsorted(self.features, feature), level - 1], len(votes)) + votes @ self.of_votes + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def mine(self, clear: list, row, feature, level) -> Model:
        """The features that differ between labels, and of those for toxic texts the mined voters.

        clear: feature, level, z, word, share of `clear_features`, the clearest first; row, feature, level: those of the sample.
        """
        order = sorted(clear, key=lambda r: r["feature"])
        self.features, self.level = np.array([r["feature"] for r in order], np.int64), np.array([r["level"] for r in order], np.int64)
        self.voter, self.weights = np.full(len(order), -1), np.zeros((len(order), LEVELS))
        taken: dict[bool, list[set]] = {True: [], False: []}
        for r in clear:  # nested ones speak for the same documents
            f, kind = r["feature"], bool(r["word"])
            if r["z"] <= 0 or r["share"] < PRECISE or len(taken[kind]) == MINED * EACH:
                continue
            mine = set(row[(feature == f) & (level >= r["level"])].tolist())
            if all(len(mine & s) < ALIKE * len(mine | s) for s in taken[kind]):
                self.voter[np.searchsorted(self.features, f)] = (0 if kind else MINED) + len(taken[kind]) % MINED
                taken[kind].append(mine)
        return self

    def train(self, votes: np.ndarray, row, feature, level, target: np.ndarray) -> Model:
        """Logistic regression on soft targets: a weight for each voter, and for each feature and level that a text reaches."""
        rows, wide = len(votes), len(self.features) * LEVELS
        at = np.searchsorted(self.features, feature)
        who, voter = np.nonzero(votes)
        row = np.concatenate([*(row[level >= k] for k in range(1, LEVELS + 1)), who])
        column = np.concatenate([*(at[level >= k] * LEVELS + k - 1 for k in range(1, LEVELS + 1)), wide + voter])
        share = np.clip(target.mean(), 1e-3, 0.999)
        w, bias = np.zeros(wide + len(VOTERS)), float(np.log(share / (1 - share)))
        g2, b2 = np.full(len(w), 1e-8), 1e-8
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[column], rows) + bias, -50, 50)))
            d = (p - target) / rows
            g, b = np.bincount(column, d[row], len(w)) + SHRINK / rows * w, d.sum()
            g2, b2 = 0.9 * g2 + 0.1 * g * g, 0.9 * b2 + 0.1 * b * b
            w -= RATE * g / np.sqrt(g2 + 1e-12)
            bias -= RATE * b / np.sqrt(b2 + 1e-12)
        self.weights, self.of_votes, self.bias = np.cumsum(w[:wide].reshape(-1, LEVELS), 1), w[wide:], float(bias)
        return self


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row takes no part in learning."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % HELD_OUT == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, patterns, and found: the features of the sample's rows, as (feature * LEVELS + level - 1) * 2 + whether it is a word."""
    usable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch):
                c = Chunk(data, offsets)
                row, feature, level = c.found(None)
                word = np.isin(feature, (mix(c.h + np.uint64(1)) & np.uint64(BUCKETS - 1)).astype(np.int64))
                at = np.searchsorted(row, np.arange(j - i + 1))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(((feature * LEVELS + level - 1) * 2 + word).astype(np.int32)))
                bits = (c.patterns() << np.arange(len(PATTERNS))).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("toxic").slice(i, j - i), pa.array(bits.astype(np.int32)), lists], ["doc_id", "toxic", "patterns", "found"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = texts.mapInArrow(run, f"doc_id {kind}, toxic int, patterns int, found array<int>")
    return materialise(rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("patterns", "found")).alias("x")).select("doc_id", "toxic", "x.patterns", "x.found"), "sample")


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row of each list's items, and the items."""
    code = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), code


def clear_features(sample: DataFrame, n0: int, n1: int) -> list:
    """feature, level (the clearest), z, word, share (of toxic texts) of at most MOST_FEATURES features, the clearest first: log odds ratios by their error."""

    def run(batches):
        for batch in batches:
            row, code = _codes(batch.column("found"))
            toxic = batch.column("toxic").to_numpy()[row]
            key = np.concatenate([((code // 2 // LEVELS * LEVELS + k) * 2 + code % 2)[code // 2 % LEVELS >= k] * 2 + toxic[code // 2 % LEVELS >= k] for k in range(LEVELS)])
            key, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key // 2), pa.array(np.where(key % 2 == 1, n, 0)), pa.array(np.where(key % 2 == 0, n, 0))], ["key", "one", "zero"])

    part = sample.select("found", "toxic").mapInArrow(run, "key long, one long, zero long").groupBy("key").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero")).filter("one + zero >= 5")
    odds = lambda c, n: F.log((F.col(c) + 0.5) / (n + 0.5 - F.col(c)))
    z = (odds("one", n1) - odds("zero", n0)) / F.sqrt(1 / (F.col("one") + 0.5) + 1 / (F.col("zero") + 0.5))
    d = part.withColumn("z", z).filter(F.abs("z") >= CLEAR)
    code = F.floor(F.col("key") / 2)
    d = d.select(F.floor(code / LEVELS).alias("feature"), (code % LEVELS + 1).alias("level"), "z", (F.col("key") % 2).alias("word"), (F.col("one") / (F.col("one") + F.col("zero"))).alias("share"))
    best = d.groupBy("feature").agg(F.max_by(F.struct("level", "z", "word", "share"), F.struct(F.abs("z"), -F.col("level"))).alias("b")).select("feature", "b.*")
    return best.orderBy(F.desc(F.abs("z")), "feature").limit(MOST_FEATURES).collect()


def known_features(sample: DataFrame, model: Model) -> pa.Table:
    """doc_id, toxic, patterns, found of the sample, with the model's features alone."""
    features = model.features

    def run(batches):
        for batch in batches:
            row, code = _codes(batch.column("found"))
            keep = np.isin(code // (2 * LEVELS), features)
            at = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(pa.array(at), pa.array(code[keep].astype(np.int32)))], ["doc_id", "toxic", "patterns", "found"])

    return sample.mapInArrow(run, sample.schema).orderBy("doc_id").toArrow()


def _bits(mask: np.ndarray, n: int) -> np.ndarray:
    return (mask[:, None] >> np.arange(n) & 1).astype(bool)


def vote_counts(docs: DataFrame, labels: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The vote patterns of all training documents, and how often each comes without a label, with 0 and with 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        wanted = model.wanted()
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch):
                c = Chunk(data, offsets)
                mask = (model.votes(c.patterns(), *c.found(wanted)) << np.arange(len(VOTERS))).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(mask.astype(np.int32))], ["doc_id", "votes"])

    kind = dict(docs.dtypes)["doc_id"]
    given = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    voted = docs.filter(~held_out()).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, votes int")
    counted = voted.groupBy("doc_id", "votes").count().join(given, "doc_id", "left").groupBy("votes", "toxic").agg(F.sum("count").alias("n")).collect()  # 2^12 * 3 rows at most
    masks = sorted({r["votes"] for r in counted})
    counts = np.zeros((len(masks), 3))
    for r in counted:
        counts[masks.index(r["votes"]), 0 if r["toxic"] is None else 1 + r["toxic"]] += r["n"]
    return _bits(np.array(masks, np.int64), len(VOTERS)), counts


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Voters, their label model, and the classifier trained on the labels that the model infers."""
    sample, model = _sample(docs, labels), Model()
    n = dict.fromkeys((0, 1), 0) | {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not all(n.values()):
        share = (n[1] + 1) / (n[0] + n[1] + 2)
        model.bias = float(np.log(share / (1 - share)))
        return model
    clear = clear_features(sample, n[0], n[1])
    model.features = np.array([r["feature"] for r in clear], np.int64)
    table = known_features(sample, model)
    discard(sample)
    found = table.column("found").combine_chunks()
    row, code = _codes(found if isinstance(found, pa.Array) else found.chunk(0))
    feature, level = code // (2 * LEVELS), code // 2 % LEVELS + 1
    toxic = np.array(table.column("toxic").to_pylist(), np.int64)
    model.mine(clear, row, feature, level)
    model.labels.fit(*vote_counts(docs, labels, model))
    votes = model.votes(_bits(np.array(table.column("patterns").to_pylist(), np.int64), len(PATTERNS)), row, feature, level)
    return model.train(votes, row, feature, level, model.labels.posterior(votes, toxic))


def score(docs: DataFrame, model: Model, *, least: float = 0.5) -> DataFrame:
    """doc_id, score, predicted (1 if the score is at least `least`) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_FEATURES * LEVELS weights

    def run(batches):
        model = shared.value
        wanted = model.wanted()
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch):
                c = Chunk(data, offsets)
                found = c.found(wanted)
                p = model.score(model.votes(c.patterns(), *found), *found)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(p), pa.array((p >= least).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).select("doc_id", held_out().alias("held_out"), "score", "predicted")
