"""Toxicity: the label model against known errors, the classifier on held-out labels and planted texts, odd rows."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import queries, toxicity
from weftline.llm.toxicity import BUCKETS, LEVELS, PATTERNS, VOTERS, Chunk, LabelModel


def chunk(*texts):
    raw = [t.encode() for t in texts]
    return Chunk(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


def brute_features(text):
    """How many distinct words (ASCII lower case) have each whole word, beginning or end, as bytes."""
    words = {re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())}
    out = Counter()
    for w in words:
        out["word", w] += 1
        out.update([("head", w[:n]) for n in toxicity.HEADS if len(w) > n] + [("tail", w[-n:]) for n in toxicity.TAILS if len(w) > n])
    return sorted(min(n, LEVELS) for n in out.values())


def test_features_equal_brute_force():
    rng = random.Random(4)
    texts = ["", "...", *("".join(rng.choice("aBéc d,3-") for _ in range(rng.randint(0, 200))) for _ in range(60))]
    row, feature, level = chunk(*texts).found(None)
    for i, t in enumerate(texts):
        assert sorted(level[row == i].tolist()) == brute_features(t)
    same = [chunk(t).found(None)[1].tolist() for t in texts]
    assert same == [feature[row == i].tolist() for i in range(len(texts))]  # whatever else is in the chunk


def test_patterns():
    texts = ["you are such an IDIOT", "idiots", "eres un payaso", "you there, far from any stupid one", "st*pid", "a * b", "A" * 21, "NO!!", "ok!", ""]
    got = chunk(*texts).patterns()
    assert [tuple(PATTERNS[j] for j in np.flatnonzero(r)) for r in got] == [("insults",), (), ("insults", "addressed"), ("insults",), ("masked",), (), ("shouting",), ("marks",), (), ()]
    assert chunk("you utter idiot").patterns()[0, 1] and not chunk("you", "idiot").patterns()[:, 1].any()


def test_label_model_recovers_errors_and_dependences():
    """Voters with known errors, two of which copy each other: accuracies, posteriors and the correlated pair come out."""
    rng = np.random.default_rng(1)
    n, speak = 60000, np.array([[0.02, 0.1, 0.3, 0.05, 0.01], [0.7, 0.6, 0.8, 0.4, 0.3]])
    y = (rng.random(n) < 0.15).astype(int)
    votes = rng.random((n, 5)) < speak[y]
    copy = rng.random(n) < 0.8
    votes[:, 4] = np.where(copy, votes[:, 3], votes[:, 4])
    label = np.where(rng.random(n) < 0.05, y, -1)
    patterns, of = np.unique(votes, axis=0, return_inverse=True)
    counts = np.zeros((len(patterns), 3))
    np.add.at(counts, (of.ravel(), label + 1), 1)
    m = LabelModel().fit(patterns, counts)
    assert abs(m.prior - 0.15) < 0.02 and np.abs(m.accuracy[:, :4] - speak[:, :4]).max() < 0.04
    edges = {frozenset((i, j)): phi for i, j, *phi in m.correlations()}
    assert len(edges) == 4 and min(edges.pop(frozenset((3, 4)))) > 0.5 and all(abs(p) < 0.15 for phi in edges.values() for p in phi)
    p = m.posterior(votes, label)
    assert np.mean((p > 0.5) == y) > 0.93
    for a, b in itertools.pairwise((0, 0.1, 0.3, 0.5, 0.7, 0.9, 1)):  # it is calibrated
        some = (p >= a) & (p <= b)
        assert some.sum() < 500 or abs(y[some].mean() - p[some].mean()) < 0.05


def test_posterior_is_bayes():
    rng = np.random.default_rng(2)
    patterns = np.array([*itertools.product([False, True], repeat=4)])
    m = LabelModel().fit(patterns, rng.integers(1, 50, (16, 3)), rounds=3)
    for label in (-1, 0, 1):
        got = m.posterior(patterns, np.full(16, label))
        for v, p in zip(patterns, got):
            joint = []
            for y in (0, 1):
                j = (1 - m.prior, m.prior)[y] * (m.label[y] if label == 1 else 1 - m.label[y] if label == 0 else 1)
                for k, parent in enumerate(m.parent):
                    c = m.chance[y, k, int(v[parent]) if parent >= 0 else 0]
                    j *= c if v[k] else 1 - c
                joint.append(j)
            assert p == pytest.approx(joint[1] / sum(joint))
    total = sum(  # chances of all patterns sum to one under either label
        np.prod([m.chance[1, k, int(v[q]) if q >= 0 else 0] if v[k] else 1 - m.chance[1, k, int(v[q]) if q >= 0 else 0] for k, q in enumerate(m.parent)]) for v in patterns
    )
    assert total == pytest.approx(1)


def test_held_out_accuracy(spark):
    """On sf0.1, by labels that the model has not seen."""
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.QUERIES["op12_toxicity"](spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    yes, no = [r.score for r in held if labels[r.doc_id]], [r.score for r in held if not labels[r.doc_id]]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in yes for b in no])
    assert auc > 0.97 and sum(s >= 0.5 for s in yes) > 0.85 * len(yes) and sum(s >= 0.5 for s in no) <= 0.005 * len(no)


def test_only_training_labels_count(spark, sf):
    """Labels of held-out documents, and other columns, change nothing."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.lit(0))
    run = lambda d, y: {r.doc_id: r.score for r in toxicity.score(d, toxicity.fit(d, y)).collect()}
    plain = run(docs, labels)
    assert plain == pytest.approx(run(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y"), "toxic": F.lit(1), "votes": F.lit(2)}).repartition(7), turned), abs=1e-9)


def test_planted_and_long_texts(spark):
    """A mined word and a mined beginning are found anywhere in a long text, and clean texts stay clean."""
    rng = random.Random(3)
    words = ["".join(rng.choice("bcdfgklmn") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = []
    for i in range(1500):
        w = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        toxic = i % 8 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["zorgle", "Vexnut", *("quibber" + x for x in rng.sample(words, 2))])
        rows.append((i, " ".join(w), int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(d.drop("toxic"), d.drop("text"))
    filler = " ".join(rng.choice(words) for _ in range(400_000))
    new = [(1, "tuna " + filler + " zorgle!"), (2, filler), (3, "la vexnut ne"), (4, "ba quibberlo quibberka"), (5, "lo la"), (6, ""), (7, None)]
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 1, 5: 0, 6: 0, 7: 0}


def test_odd_rows(spark):
    long = "Lorem ipsum dolor sit amet. " * 6000
    rows = [(1, None), (2, ""), (2, "other"), (3, "tie you idiot"), (4, "tie you idiot"), (None, "no id"), (None, None), (5, long), (6, "é 中文 😀  "), *((i, f"word{i} scum") for i in range(7, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("c") for c in ("toxic", "votes", "found", "patterns", "score", "count", "n", "x")})
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(3, 40)] + [(None, 1, 1), (7, None, 1), (8, 5, 1), (9, 0, 1), (9, 1, 1), (99, 1, 1)], "doc_id long, toxic int, text int")
    for given in (labels, labels.filter("false"), labels.filter("toxic = 1")):
        model = toxicity.fit(docs, given)
        got = toxicity.score(docs, model).collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows) and all(0 <= r.score <= 1 for r in got)
        by = {r.doc_id: r.score for r in got}
        assert by[3] == by[4] and by[1] in {r.score for r in got if r.doc_id == 2}
    none = docs.filter("false")
    assert toxicity.score(none, toxicity.fit(none, labels)).collect() == []
    assert len(VOTERS) <= 12 and BUCKETS & (BUCKETS - 1) == 0
