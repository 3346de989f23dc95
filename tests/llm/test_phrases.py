"""Phrase mining against brute force: lengths, collisions of buckets, long texts cut between pieces, exact scores."""

import random
import re
from collections import Counter
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import phrases, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=3, least=10, cover=50):
    """{(lang, phrase): (a, l, r, score)} of candidates that stay, and words by language."""
    f = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang or "und", tuple(w[i : i + s])) for s in range(1, longest + 1) for i in range(len(w) - s + 1))
    words = Counter()
    for (lang, p), n in f.items():
        words[lang] += n * (len(p) == 1)
    c = {k: n for k, n in f.items() if len(k[1]) > 1 and n >= least}
    covered = {(lang, p[i : i + s]) for (lang, p), n in c.items() for s in range(2, len(p)) for i in range(len(p) - s + 1) if 100 * n >= cover * f[lang, p[i : i + s]]}
    out = {}
    for (lang, p), a in c.items():
        if (lang, p) not in covered:
            cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            out[lang, " ".join(p)] = (a, f[lang, p[:k]], f[lang, p[k:]], s)
    return out, {k: n for k, n in words.items() if n}


def mined(spark, rows, parts=3, **how):
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("c") for c in ("phrase", "n", "segment", "a", "score", "w", "k", "size")}).repartition(parts)
    found, totals = phrases.collocations(df, **how)
    return {(r.lang, r.phrase): (r.a, r.l, r.r, r.score) for r in found.collect()}, {r.lang: r.n for r in totals.collect()}


def test_query_equals_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.sql(queries.ORACLE["op13_phrases"])
    got = queries.QUERIES["op13_phrases"](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())


def some_rows(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "ć", "Été", "d", "x" * 9, " ", "-"]
    text = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ".", ", ", "\n", "\r\n", ";"]) for _ in range(k))
    return [(rng.choice(["en", "en", "fr", None]), text(rng.randint(0, 40))) for _ in range(n)] + [("en", None), ("fr", ""), ("de", " \t.\n"), ("es", "one")]


@pytest.mark.parametrize(("buckets", "longest", "least"), [(1 << 24, 3, 10), (1 << 3, 3, 10), (1 << 5, 4, 7), (1 << 16, 2, 3), (1 << 15, 3, 300)])
def test_phrases_equal_brute_force(spark, buckets, longest, least):
    """With few buckets everything collides and nothing may change; counts over 255 need wider ones."""
    rows = some_rows(longest) * (8 if least > 255 else 1)
    assert mined(spark, rows, longest=longest, least=least, buckets=buckets) == brute(rows, longest, least)
    assert least > 3 or brute(rows, longest, least)[0]


def test_long_texts_are_cut_between_pieces():
    texts = ["", "a b c d e f g h i j k l m n o p q r s t u v w x y z", "a b. " * 40, "q" * 100 + " z", ".".join("ab cd ef" for _ in range(30)), None, "."]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = {}
    for i, data, offsets in phrases.text_parts(batch, 30):
        for k, (x, y) in enumerate(zip(offsets, offsets[1:])):
            got.setdefault(i + k, []).append(data[x:y].tobytes().decode())
    assert ["".join(got[i]) for i in range(len(texts))] == [t or "" for t in texts]
    assert all(p[-1] in ".," for parts in got.values() for p in parts[:-1]) and len(got[2]) > 3 and len(got[1]) == 1


def test_buckets_add_up(spark):
    """Segments of tasks, few or many in use, give the bits of all counts together."""
    rng = np.random.default_rng(3)
    parts, total = [], Counter()
    for size in (5, 40000, 3000):
        hashes = rng.integers(0, 1 << 15, size, dtype=np.uint64)
        b = phrases.Buckets(1 << 15, 3)
        for x in np.array_split(hashes, 4):
            b.add(x)
        total.update(hashes.tolist())
        parts += [(s, bytearray(c)) for s, c in b.segments()]
    bits = phrases.bitmap(spark.createDataFrame(parts, "segment int, counts binary"), 3, 1 << 15)
    assert {i for i, x in enumerate(np.unpackbits(bits)) if x} == {h for h, n in total.items() if n >= 3}


def test_scores_beyond_64_bits(spark):
    cases = [(10**12, 10**12, 10**12), (10**12 + 7, 10**12 + 9, 10**12 + 8), (3, 7, 11), (999_999_999_989, 10**15, 10**15)]
    got = spark.createDataFrame(cases, "a long, l long, r long").withColumn("s", phrases.score("a", "l", "r")).collect()
    assert [r.s for r in got] == [1000000 * a * a // (left * right) for a, left, right in cases]


def test_ranks_break_ties(spark):
    rows = [("en", f"p {chr(c)}", 10 + c % 2, 7) for c in chain(range(97, 123), (233, 0x4E2D, 0x1F600))] + [("fr", "x y", 10, 7)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, score long")
    got = [(r.rank, r.phrase) for r in phrases.best(df, 20).filter("lang = 'en'").orderBy("rank").collect()]
    want = sorted((r for r in rows if r[0] == "en"), key=lambda r: (-r[3], -r[2], r[1].encode()))[:20]
    assert got == [(i, r[1]) for i, r in enumerate(want, 1)]


def test_no_rows(spark):
    assert mined(spark, []) == ({}, {})
    assert mined(spark, [(None, None), ("en", "one two")]) == ({}, {"en": 2})
