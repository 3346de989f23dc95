"""Operators against brute force, exact round trips and held-out accuracy; odd rows in every operator."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe, chat, common, graph, jaccard, lm, mixing, ordinal, pii, quality, queries, rans, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "Lorem ipsum dolor sit amet consectetur. " * 6000


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a long one, ties, repeated rows and ids, and columns that operators use inside."""
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "Tie text of more than five words here."), (4, "Tie text of more than five words here."), (5, "Tie text of more than five words here."),
        (6, LONG), (None, "a row without an id, kept as it is"), (7, "x"), (8, "café ñandú 中文 😀 mail me@ex.org +1 (234) 555-7890 or 4111 1111 1111 1111 or 10.0.0.300 10.0.0.3"), (9, "x y"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    clash = {c: F.lit("c") for c in ("id", "n", "key", "h1", "kept", "score", "p_good", "n_words", "mix_copy", "email", "added", "fingerprint", "lang", "source", "t", "_key", "kind", "row", "sig", "ids")}
    return d.withColumns(clash).withColumn("n_chars", F.length("text").cast("long")).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def test_oracles_are_sql():
    """An operator's oracle is the text of a DuckDB query that parses, of a registered query."""
    for name, sql in queries.ORACLE.items():
        assert name in queries.QUERIES and isinstance(sql, str) and len(duckdb.extract_statements(sql)) == 1


# ---- words and graph


def test_word_hashes_tell_words_apart():
    rng = random.Random(1)
    words = [*{"".join(rng.choice("abAB cé") for _ in range(rng.randint(1, 6))).replace(" ", "") or "z" for _ in range(4000)}]
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(words)])], ["text"])
    for _, _, data, offsets in common.text_chunks(batch):
        s, e, _ = common.word_spans(data, offsets)
        assert len({*common.word_hashes(data, s, e, lower=False).tolist()}) == len(words)
        low = re.sub("[A-Z]", lambda m: m[0].lower(), " ".join(words)).split(" ")
        assert len({*common.word_hashes(data, s, e).tolist()}) == len({*low})


def test_chunks_cover_all_rows():
    values = ["a b", None, "", "c" * 50, "d e f"] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(["skip", *values])], ["text"]).slice(1)
    got = []
    for i, j, data, offsets in common.text_chunks(batch, limit=20):
        got += [data[x:y].tobytes().decode() for x, y in zip(offsets, offsets[1:])]
        assert j - i == len(offsets) - 1
    assert got == [v or "" for v in values]


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    for n, m in ((1, 1), (40, 30), (60, 90)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 140)]
        parent = {}

        def find(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for x in parent}


# ---- 1 quality rules


def base_counts(t):
    w, seen, twice = WORD.findall(t or ""), set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), twice, len(covered)


def test_quality_counts(spark, sf, texts):
    for r in queries.QUERIES["op1_quality_rules"](spark, sf).collect():
        want = base_counts(texts[r.doc_id])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_quality_counts_of_repeating_texts(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abc" if i % 2 else "abcdefghij") + rng.choice(["", "\n", "|"]) for _ in range(rng.randint(0, 400)))) for i in range(120)]
    got = quality.counted(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base_counts(r.text) for r in got)


def test_quality_verdicts_follow_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in queries.QUERIES["op1_quality_rules"](spark, d).collect() if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept == bool(labels[r.doc_id]) for r in got) >= 0.97 * len(got)


def test_em_finds_rules_that_err():
    rng, patterns = random.Random(3), collections.Counter()
    truth = []
    for _ in range(5000):
        good = rng.random() < 0.8
        votes = tuple((-1 if rng.random() < (0.02 if good else 0.6) else 0) for _ in range(4)) + ((1 if rng.random() < (0.9 if good else 0.4) else 0),)
        patterns[votes] += 1
        truth.append((votes, good))
    prior, chances = quality.fit([*patterns.items()])
    right = sum((quality.posterior(v, prior, chances) >= 0.5) == g for v, g in truth)
    assert right > 0.9 * len(truth) and abs(prior - 0.8) < 0.08


def test_posterior_decides_not_any_single_vote(spark):
    """Some documents with a vote against them are kept, as the other rules outweigh it; of two such votes, some are kept and some not."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    against = sum((rule() == -1).cast("int") for rule in quality.RULES.values())
    got = quality.judged(d).filter("NOT base_failed").groupBy(against.alias("against"), "kept", "quality").count().collect()
    kept, rejected = ({r.against: 0 for r in got} for _ in range(2))
    for r in got:
        (kept if r.kept else rejected)[r.against] += r["count"]
    assert kept[1] > 0 and kept[2] > 0 and rejected[2] > 0 and rejected[3] > 0
    assert sum(r["count"] for r in got if r.kept == bool(r.quality)) >= 0.99 * sum(r["count"] for r in got)


def test_documents_without_a_vote_against_them_can_be_rejected():
    rng, patterns = random.Random(5), collections.Counter()
    for _ in range(6000):
        good = rng.random() < 0.7
        patterns[tuple(rng.choices((-1, 0, 1), (0.02, 0.08, 0.9) if good else (0.3, 0.6, 0.1))[0] for _ in range(6))] += 1
    prior, chances = quality.fit([*patterns.items()])
    assert quality.posterior((0,) * 6, prior, chances) < 0.05 and quality.posterior((-1, 1, 1, 1, 1, 1), prior, chances) > 0.95


def test_quality_odd(odd, none):
    got = quality.judged(odd)
    assert got.count() == odd.count() and not got.filter("text IS NULL AND kept").count() and set(odd.columns) <= set(got.columns)
    assert quality.judged(none).count() == 0


# ---- 2 token ids


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.3, 300_000) % 49_000).astype("<u2")
    table = rans.Table.of_counts(np.bincount(ids, minlength=1 << 16))
    assert int(table.frequencies.sum()) == 1 << rans.SCALE
    for n in (0, 1, 2, 63, 64, 65, 129, 5000, len(ids)):
        assert (rans.decode_block(rans.encode_block(ids[:n], table), table) == ids[:n]).all()
    block, step = rans.encode_block(ids, table), rans.CHECKPOINT_ROWS * rans.LANES
    assert (rans.decode_block(block, table, 1, 2) == ids[step:][: 1 * step]).all() or len(ids) < step
    assert len(block) < 1.15 * sum(-math.log2(table.frequencies[i] / (1 << rans.SCALE)) for i in ids.tolist()) / 8
    for at in (9, 40, len(block) - 1):
        broken = bytearray(block)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            rans.decode_block(bytes(broken), table)
    one = rans.Table.of_counts(np.bincount([7] * 5, minlength=1 << 16))
    assert (rans.decode_block(rans.encode_block(np.full(5, 7, np.uint16), one), one) == 7).all()


def test_token_files(spark, sf, texts):
    tokenizer = bpe.encoder(bpe.vocabulary_path()).tokenizer
    got, start = {r.doc_id: r for r in queries.QUERIES["op2_rans"](spark, sf).collect()}, 0
    for k in sorted(texts):
        ids = [*tokenizer.encode(texts[k], add_special_tokens=False).ids, 2]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_odd(spark, odd, none, tmp_path):
    rans.write_ids(odd, str(tmp_path / "a"))
    got = rans.read_ids(spark, str(tmp_path / "a"))
    assert got.count() == odd.count()
    assert got.filter("doc_id = 1").first().ids == [2] and got.filter("doc_id IS NULL").first().start == 0
    rows = got.orderBy("start").collect()
    assert all(a.start + a.n_tokens == b.start and len(a.ids) == a.n_tokens for a, b in zip(rows, rows[1:]))
    rans.write_ids(none, str(tmp_path / "b"))
    assert rans.read_ids(spark, str(tmp_path / "b")).count() == 0


# ---- 3 near duplicates


def brute_components(texts):
    sets = {}
    for k, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for k in sorted(sets):
        both = collections.Counter(j for g in sets[k] for j in where[g])
        for g in sets[k]:
            where[g].append(k)
        for j, n in both.items():
            if 100 * n >= 75 * (len(sets[k]) + len(sets[j]) - n):
                a, b = find(k), find(j)
                parent[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_near_duplicates(spark, sf, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op3_ngram_join"](spark, sf).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_of_edits_and_shared_passages(spark, monkeypatch):
    """Families around the threshold, a chain, copies, a passage in many texts, and very short texts."""
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    passage, out = " ".join(rng.choice(vocab) for _ in range(50)), {}
    for f in range(14):
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 9, 14, 30, 70, 150, 400]))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out[len(out)] = " ".join(w)
            if rng.random() < 0.3:
                base = w
    for i in range(60):
        out[len(out)] = passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 60)))
    for i in range(40):
        out[len(out)] = " ".join(rng.choice("ab") for _ in range(rng.randint(1, 7)))
    df = spark.createDataFrame([*out.items()], "doc_id long, text string")
    want = brute_components(out)
    for few in (8, 2):
        monkeypatch.setattr(jaccard, "FEW", few)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()} == want
    monkeypatch.setattr(jaccard, "SPLIT_ROWS", 3)  # entries are split by salt
    monkeypatch.setattr(jaccard, "HOT_LEAST", 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()} == want


def test_near_duplicates_in_one_crowded_entry(spark, monkeypatch):
    """Variants of one text that differ in one word: those with close places are linked, so one star cannot reach all of them."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    out = {i: " ".join(base[:p] + [f"n{i}"] + base[p + 1 :]) for i in range(700) for p in [rng.randrange(60)]}
    out |= {1000 + i: " ".join(base[:30] + [f"m{i}-{j}" for j in range(25)]) for i in range(30)}  # share a passage, are not linked
    df, want = spark.createDataFrame([*out.items()], "doc_id long, text string"), brute_components(out)
    assert len({c for _, c in want.values()}) == 31
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard, "SPLIT_ROWS", 50)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()} == want
    docs = df.withColumnRenamed("doc_id", "id")
    sketched = jaccard._described(docs, 5, 75).filter("kind = 0").select("id", "n", "sketch")
    entries = docs.select(F.lit(64 + 5).cast("long").alias("sig"), "id", F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("component"))
    known = {i: min(i, want[i][1]) for i in out}
    for sets, most in ((2048, 1), (100, 7 * 8)):  # the whole entry as one group, and many pairs of blocks
        monkeypatch.setattr(jaccard, "BLOCK_SETS", sets)
        placed = jaccard._placed(entries, sketched)
        assert 0 < jaccard._forest(placed, 75).count() < most * len(out)
        links = [(r.x, r.r) for r in jaccard._across(placed, docs, 5, 75).collect()]
        assert 0 < len(links) < most * len(out)
        got = graph.components(spark.createDataFrame(links + [(i, 0) for i in range(1, 300)], "x long, r long"), "x", "r")
        assert {r.node: r.component for r in got.collect()} == {i: c for i, c in known.items() if i < 1000}


def test_near_duplicates_with_few_true_pairs_in_the_forest(spark, monkeypatch):
    """Where the pairs that join components by their sketches are not links, the second comparison finds the others."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    out = {i: " ".join(base[:p] + [f"n{i}"] + base[p + 1 :]) for i in range(150) for p in [rng.randrange(60)]}
    monkeypatch.setattr(jaccard, "_stars", lambda left: left.select(F.col("id").alias("x"), F.lit(0).cast("long").alias("r")).filter("id = 149").distinct())
    forest = jaccard._forest
    monkeypatch.setattr(jaccard, "_forest", lambda placed, percent: forest(placed, percent).withColumns({"x": F.lit(149).cast("long"), "r": F.lit(0).cast("long")}))
    monkeypatch.setattr(jaccard, "FEW", 2)
    df = spark.createDataFrame([*out.items()], "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()} == brute_components(out)


def crowd(n, copies):
    """Texts that share seven tenths and are not similar, and near copies without a central one, all with one passage."""
    rng = random.Random(n)
    passage = [f"p{i}" for i in range(140)]
    out = {i: " ".join(passage + [f"o{i}-{j}" for j in range(60)]) for i in range(n)}
    base = passage + [f"b{i}" for i in range(60)]
    for i in range(copies):
        w, at = list(base), rng.randrange(190)
        w[at : at + 4] = [f"e{i}-{j}" for j in range(4)]
        out[n + i] = " ".join(w)
    return out


def test_near_duplicates_that_share_a_passage(spark, monkeypatch):
    """What is compared and moved grows with the sets that share a passage, not with their pairs."""
    moved = {}
    entries, placed, verified = jaccard._front_entries, jaccard._placed, jaccard._alike

    def counting(name, f):
        def run(*args):
            out = f(*args).cache()
            moved[name] = moved.get(name, 0) + out.count()
            return out

        return run

    for name, f in (("_front_entries", entries), ("_placed", placed)):
        monkeypatch.setattr(jaccard, name, counting(name, f))
    monkeypatch.setattr(jaccard, "_alike", lambda pairs, *args: moved.__setitem__("pairs", moved.get("pairs", 0) + pairs.count()) or verified(pairs, *args))
    seen = []
    for n, copies in ((150, 60), (600, 240)):
        texts = crowd(n, copies)
        moved.clear()
        df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
        assert got == brute_components(texts)
        assert {c for k, (_, c) in got.items() if k >= n} == {n} and len({c for _, c in got.values()}) == n + 1
        seen.append(dict(moved))
    small, large = seen
    assert small["_front_entries"] > 0 and all(large[k] <= 6 * small[k] + 50 for k in small), seen


def test_fronts_of_similar_sets_meet():
    """For sets of all sizes that are just similar enough, whatever the order of shingles."""
    rng = np.random.default_rng(9)
    level = rng.integers(0, 20, jaccard.SHINGLE_BUCKETS).astype(np.uint8)
    for _ in range(300):
        a = rng.integers(1, 300)
        b = rng.integers(a, a * 100 // 75 + 1)
        same = -(-75 * (a + b) // 175)
        if same > a:
            continue
        pool = np.unique(rng.integers(0, 1 << 63, a + b).astype(np.uint64))
        rng.shuffle(pool)
        x, y = np.sort(pool[:a]), np.sort(pool[a - same : a - same + b])
        row, key = jaccard.fronts([x, y], level, 75)
        assert {*key[row == 0].tolist()} & {*key[row == 1].tolist()}


def test_near_duplicates_pool_an_ids_texts(spark):
    words = [f"v{i}" for i in range(40)]
    a, b = " ".join(words[:20]), " ".join(words[20:])
    rows = [(1, a), (2, b), (3, a), (3, b), (4, b + " more"), (5, "x y z")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)}


def test_spanning_links_join_what_is_linked():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 63, 80).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(base)[:70], rng.integers(0, 1 << 63, 3).astype(np.uint64)])) for _ in range(60)]
    own, every = np.arange(60), np.arange(60)
    n = np.array([len(x) for x in sets])
    words = min(len(jaccard.sketch(x)) for x in sets) // 8
    bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(jaccard.sketch(x), np.uint64).reshape(-1, words), axis=0) for x in sets])
    found = jaccard.spanning_links(own, n, bits, every, every, 75, lambda a, b: jaccard._similar(sets[a], sets[b], 75))
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in found:
        assert jaccard._similar(sets[i], sets[j], 75) and find(i) != find(j)
        parent[find(i)] = find(j)
    assert all(find(i) == find(j) for i in range(60) for j in range(i) if jaccard._similar(sets[i], sets[j], 75))


def test_sketches_bound_differences():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (40, 50), (300, 90), (5000, 4000)):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, m).astype(np.uint64)]))
        assert jaccard.sketches_differ(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_near_duplicates_odd(odd, none):
    got = jaccard.near_duplicates(odd)
    assert got.count() == odd.count()
    by = {r.doc_id: r for r in got.collect()}
    assert by[5].component_id == by[4].component_id == 4 and by[1].n_shingles == by[3].n_shingles == 0 and by[1].component_id == 1 and by[None].component_id is None
    assert jaccard.near_duplicates(none).count() == 0


# ---- 4 personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    def passes(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "phone":
            return 9 <= len(digits) <= 15
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits)))
        return kind == "email" or (13 <= len(digits) <= 19 and total % 10 == 0)

    return [f"{k}:{m.start()}:{m.end()}" for k, rx in BASE.items() for m in re.finditer(rx, t or "") if passes(k, m[0])]


def check_pii(df, texts):
    every = lambda added: F.array_join(F.flatten(F.array(*[pii._listed(k, added) for k in pii.KINDS])), ",")
    for r in pii.find(df, ["doc_id"]).select("doc.doc_id", every(False).alias("base"), every(True).alias("spans")).collect():
        assert r.base == ",".join(base_spans(texts[r.doc_id]))
        assert set(filter(None, r.base.split(","))) <= set(filter(None, r.spans.split(",")))


def test_base_entities(docs, texts):
    check_pii(docs, texts)


def test_base_entities_of_joined_pieces(spark):
    rng = random.Random(3)
    parts = ["a", "b.", "@", "@x.com", "-", "1", "23", " ", "  ", "+1 ", "4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4", "255.256.1.1", "%", "_", ".", "..", "(555)", "é", "\n", "5500005555555559"]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for i in range(1500)}
    check_pii(spark.createDataFrame([*texts.items()], "doc_id long, text string"), texts)


def test_contexts_discover_what_patterns_miss(spark):
    rows = [(i, f"please mail kontakt box user{i}@mail.com now, room {i}") for i in range(12)] + [(50, "please mail kontakt box user77(at)mail.com, now"), (51, "the room 12 is clean and 7 of 9 are not")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc.doc_id: r.added for r in pii.find(d, ["doc_id"]).collect()}
    assert [(x.kind, x.start, x.end) for x in found[50]] == [("email", 24, 42)] and not any(found[k] for k in found if k != 50)
    hidden = {r.doc_id: r.text for r in pii.redacted(d).collect()}
    assert hidden[50] == "please mail kontakt box [EMAIL], now" and hidden[0] == "please mail kontakt box [EMAIL] now, room 0" and hidden[51] == rows[-1][1]


def test_hidden_seeds_are_recovered(spark):
    """A tenth of the seeds, chosen by their text, is hidden: patterns of the others find most of them, and little else."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    d = pii.seeds(docs.select("doc_id", "text")).withColumn("_key", F.col("doc_id")).select("_key", *pii.ALL_KINDS, "mention")
    m = common.materialise(pii.mentions(d), "all")
    hidden = m.filter(F.col("kind").isNotNull() & (F.abs(F.hash("what")) % 10 == 0))
    told = m.withColumn("kind", F.when(F.abs(F.hash("what")) % 10 != 0, F.col("kind")))
    want = {(r._key, r.start, r.end): r.kind for r in hidden.collect()}
    got = {(r._key, r.start, r.end): r.kind for r in pii.discovered(told).collect()}
    right = sum(got.get(k) == v for k, v in want.items())
    assert len(want) > 60 and right >= 0.8 * len(want) and right >= 0.8 * len(got)
    by_kind = {k: [got.get(x) == k for x, y in want.items() if y == k] for k in pii.ALL_KINDS}
    assert all(sum(x) >= 0.6 * len(x) for x in by_kind.values() if len(x) >= 5), {k: (sum(x), len(x)) for k, x in by_kind.items()}
    added = pii.discovered(m).withColumnRenamed("kind", "found").join(m, ["_key", "start", "end"]).select("found", "what").collect()
    assert not any(r.found == "card" and len(re.sub("[^0-9]", "", r.what)) in range(13, 20) for r in added)  # no number without its check digit


def test_contexts_find_other_formats(spark):
    """Contexts planted in prose: seeds in the plain formats teach them, other formats in the same contexts are found, numbers elsewhere are not."""
    rng = random.Random(21)
    prose = "the river and hill of green stones under old trees where small birds sing near quiet houses every long summer day".split()
    some = lambda a, b: " ".join(rng.choice(prose) for _ in range(rng.randint(a, b)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(good=True):
        body = "4" + digits(14)
        check = next(c for c in "0123456789" if sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(x) for x in reversed(body + c))) % 10 == 0)
        return body + (check if good else str((int(check) + 3) % 10))

    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    contexts = {"email": ("write to", "mailbox:"), "phone": ("call us on", "phone:"), "card": ("charged to card", "card no:"), "ip": ("login from host", "address =")}
    plain = {"email": lambda: f"{name()}@{name()}.com", "phone": lambda: f"+1 {digits(3)} {digits(3)}-{digits(4)}", "card": card, "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4))}
    other = {"email": lambda: f"{name()} at {name()} dot com", "phone": lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", "card": lambda: (lambda c: f"{c[:5]}/{c[5:10]}/{c[10:]}")(card()), "ip": lambda: f"{digits(2)}-{digits(2)}-{digits(2)}-{digits(2)}"}
    rows, want, bad = [], set(), []
    for i in range(1600):
        kind = rng.choice([*contexts])
        said = rng.choice(contexts[kind])
        held = i % 10 == 0
        entity = (other if held else plain)[kind]()
        wrong = kind == "card" and i % 20 == 1
        if wrong:
            entity, held = card(good=False), False
        head = f"{some(3, 9)} {said} "
        rows.append((i, f"{head}{entity} {some(2, 9)} room {rng.randrange(900)} {some(1, 5)} since {rng.randrange(1900, 2020)}"))
        if held:
            want.add((i, kind, len(head), len(head) + len(entity)))
        if wrong:
            bad.append(i)
    got = {(r.doc.doc_id, x.kind, x.start, x.end) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect() for x in r.added}
    right = len(got & want)
    assert len(want) > 100 and len(bad) > 10 and right >= 0.9 * len(want) and right >= 0.9 * len(got), (right, len(want), len(got), sorted(got - want)[:5], sorted(want - got)[:5])
    assert not any(k == "card" and i in bad for i, k, *_ in got)
    for kind in contexts:
        mine = {x for x in want if x[1] == kind}
        assert len(got & mine) >= 0.9 * len(mine), kind


def test_rounds_go_on_while_they_find(spark):
    """Each round's finds make the next one's pattern confident: seeds give `alpha`, what it finds gives `beta`."""
    rows = [(i, f"x{i} alpha 10.0.0.{i} beta") for i in range(30)] + [(100 + i, f"y{i} alpha host{i}q{i}z beta") for i in range(3)]
    rows += [(200 + i, f"z gamma host{i}q{i}z-{'ab'[i % 2]} beta") for i in range(3)]
    got = {r.doc.doc_id: r.added for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert all(got[100 + i] for i in range(3)) and all(x.kind == "ip" for i in range(3) for x in got[200 + i])


def test_secrets_and_long_words(spark):
    secret, long = "0123456789abcdef0123456789abcdef", "k" * 300 + "=user@mail.example.com"
    d = spark.createDataFrame([(1, f'set token = "{secret}" now'), (2, long), (3, f"the token {secret} is not assigned")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redacted(d).collect()}
    assert got[1] == 'set token = "[SECRET]" now' and got[2] == "k" * 300 + "=[EMAIL]" and got[3].startswith("the token 0123")
    seen = pii.seeds(d.filter("doc_id = 2")).first().mention
    assert [x.what for x in seen] == [long]


def test_entities_odd(odd, none, texts):
    got = {(r.doc_id, r.text) for r in pii.redacted(odd).collect()}
    assert (8, "café ñandú 中文 😀 mail [EMAIL] [PHONE] or [CARD] or 10.0.0.300 [IP]") in got and (1, None) in got
    assert pii.redacted(odd).columns == odd.columns and pii.redacted(none).count() == 0


# ---- 5 scoring


def test_gradients():
    rng = np.random.default_rng(0)
    m = lm.Attention(np.ones(64) / 64, rng.integers(0, 9, (65, 64)))
    m.before, m.inside = m.before.astype(np.float64), m.inside.astype(np.float64)
    inputs, targets, scored = rng.integers(0, 64, (3, lm.WINDOW)), rng.integers(0, 64, (3, lm.WINDOW)), rng.random((3, lm.WINDOW)) < 0.7
    m.p = {k: v.astype(np.float64) * (1 if "bias" in k else 5) for k, v in m.p.items()}
    g, _ = m.gradient(inputs, targets, scored)
    for k, x in m.p.items():
        at = tuple(rng.integers(0, s) for s in x.shape)
        old, e = x[at], 1e-5
        x[at] = old + e
        up = m.gradient(inputs, targets, scored)[1]
        x[at] = old - e
        down = m.gradient(inputs, targets, scored)[1]
        x[at] = old
        assert abs(g[k][at] - (up - down) / 2 / e) < 1e-4


def test_chances_sum_to_one_and_look_back_only():
    m = lm.Attention(np.ones(64) / 64, np.random.default_rng(0).integers(0, 9, (65, 64)))
    inputs, scored = np.arange(lm.WINDOW)[None] % 64, np.zeros((1, lm.WINDOW), bool)
    scored[0, 20] = True
    total = sum(np.exp(m.log_chance(inputs, np.full((1, lm.WINDOW), t), scored)[0]) for t in range(64))
    assert abs(total - 1) < 1e-5
    later = inputs.copy()
    later[0, 21:] = 5
    assert np.allclose(m.log_chance(inputs, inputs, scored), m.log_chance(later, inputs, scored))
    c = lm.Classes(np.arange(5000))
    assert all(abs(np.exp(c.inside[c.of == k]).sum() - 1) < 1e-9 for k in (0, lm.FREQUENT, lm.FREQUENT + 3))


def test_tokens_after_a_cut_see_a_context():
    """The model's size is a choice of quality; a smaller one needs held-out figures in the README."""
    assert (lm.FREQUENT, lm.SHARED, lm.WIDTH, lm.WINDOW, lm.CONTEXT) >= (1504, 32, 24, 48, 16)
    inputs, targets, scored, at, row = lm.windows(np.arange(200), np.array([0, 200]), -1)
    assert all(at[k][s][0] - at[k][0] >= 16 for k, s in enumerate(scored) if k)


def test_large_products_stay_finite():
    m, d = lm.Attention(np.ones(64) / 64), lm.WIDTH
    for sign in (1, -1):
        m.p["qkv"][:, :d], m.p["qkv"][:, d : 2 * d] = np.eye(d, dtype=np.float32) * 200, np.eye(d, dtype=np.float32) * 200 * sign
        inputs, scored = np.arange(2 * lm.WINDOW).reshape(2, -1) % 64, np.ones((2, lm.WINDOW), bool)
        got = m.log_chance(inputs, inputs, scored)
        assert np.isfinite(got).all() and np.allclose(got, m._output(m.hidden(inputs)[-1][scored], inputs[scored], inputs[scored])[0], atol=1e-4)
        assert all(np.isfinite(x).all() for x in m.gradient(inputs, inputs, scored)[0].values())


def test_context_alone_is_not_computed_twice():
    """Windows whose first places are context alone give what whole ones give."""
    rng = np.random.default_rng(2)
    m = lm.Attention(np.ones(64) / 64, rng.integers(0, 9, (65, 64)))
    inputs, targets, scored = rng.integers(0, 64, (9, lm.WINDOW)), rng.integers(0, 64, (9, lm.WINDOW)), np.ones((9, lm.WINDOW), bool)
    scored[::2, : lm.CONTEXT] = False
    whole = m._output(m.hidden(inputs)[-1][scored], inputs[scored], targets[scored])[0]
    assert np.allclose(m.log_chance(inputs, targets, scored), whole, atol=1e-4)


def test_each_token_is_scored_once():
    for sizes in ([1], [lm.WINDOW], [lm.WINDOW + 1], [3, 200, 1, 77]):
        where = np.concatenate([[0], np.cumsum(sizes)])
        inputs, targets, scored, at, row = lm.windows(np.arange(where[-1]), where, -1)
        assert sorted(at[scored].tolist()) == [*range(where[-1])] and (targets[scored] == at[scored]).all()
        assert (inputs[scored] == np.where(np.isin(at[scored], where[:-1]), -1, at[scored] - 1)).all()


def test_all_training_tokens_are_learnt():
    """Also of a shard with less than a batch of windows."""
    rng = np.random.default_rng(3)
    for sizes in ([1], [5, 7000, 1, 48, 49], [20] * 300):
        model = lm.Attention(np.ones(64) / 64)
        begun = model.pack()
        trainer = lm.Trainer(model, begun, 64)
        for n in sizes:
            trainer.add(rng.integers(0, 64, n).astype(np.uint16))
        p, tokens = trainer.finish()
        assert tokens == sum(sizes) and not np.array_equal(p, begun)


def test_texts_are_cut_many_at_once(monkeypatch):
    """A shard's texts are put into windows together, in their order; batches are those of one text after another."""
    calls, learnt, rng = [], [], np.random.default_rng(4)
    cut = lm.windows
    monkeypatch.setattr(lm, "windows", lambda *x: calls.append(1) or cut(*x))
    trainer = lm.Trainer(lm.Attention(np.ones(64) / 64), lm.Attention(np.ones(64) / 64).pack(), 64)
    monkeypatch.setattr(trainer, "learn", lambda some: learnt.append(some))
    texts = [rng.integers(0, 64, n).astype(np.uint16) for n in rng.integers(1, 200, 900)]
    for t in texts:
        trainer.add(t)
    trainer.finish()
    assert len(calls) < 9 and all(len(x[0]) == lm.BATCH for x in learnt[:-1])
    one = [cut(t.astype(np.int64), np.array([0, len(t)]), 64, 0)[:3] for t in texts]
    for k in range(3):
        assert np.array_equal(np.concatenate([x[k] for x in learnt]), np.concatenate([x[k] for x in one]))


def test_steps_are_adams():
    model, rng = lm.Attention(np.ones(64) / 64), np.random.default_rng(5)
    adam, p = lm.Adam(model, 0.01), {k: x.astype(np.float64) for k, x in model.p.items()}
    m, v = ({k: 0 * x for k, x in p.items()} for _ in range(2))
    for t in range(1, 6):
        g = {k: rng.standard_normal(x.shape).astype(np.float32) for k, x in p.items()}
        adam.step({k: x.copy() for k, x in g.items()})
        for k, x in g.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.99 * v[k] + 0.01 * x.astype(np.float64) ** 2
            p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
    assert all(np.allclose(model.p[k], p[k], atol=1e-5) for k in p)


def test_scores_do_not_depend_on_partitions(docs, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 20_000)  # several shards
    a, b = ({r.doc_id: r.score for r in lm.score(docs.repartition(n)).collect()} for n in (2, 5))
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-4) for k in a)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_held_out_texts_are_likelier_than_by_words(spark, sf):
    got = queries.QUERIES["op5_attention_lm"](spark, f"/root/testdata/sf{sf}").filter("held_out")
    score, base, better, n = got.agg(F.sum("score"), F.sum("base_score"), F.count_if(F.col("score") > F.col("base_score")), F.count("*")).first()
    assert score > (0.94 if sf == "0.1" else 1.0) * base, (score, base, better, n)  # both are negative


def test_scores(spark, texts, docs):
    rows = lm.score(docs).collect()
    words = {k: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)), None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    c = collections.Counter(w for k in words if not held[k] for w in words[k])
    n, v = sum(c.values()), len(c)
    for r in rows:
        w = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0
    # Shuffled letters are less likely than the texts, a token for a token.
    mixed = docs.filter("doc_id < 40").withColumn("text", F.reverse("text"))
    both = lm.score(docs.unionByName(mixed.withColumn("doc_id", F.col("doc_id") + 100_000)))
    got = {r.doc_id: r.score / max(1, r.n_tokens) for r in both.collect()}
    assert sum(got[k] > got[k + 100_000] for k in range(40)) >= 34


def test_scores_odd(odd, none):
    got = lm.score(odd)
    assert got.count() == odd.count()
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1 and by[1].score == by[2].score and by[4].n_known == 9
    assert lm.score(none).count() == 0


# ---- 6 byte-pair encoding


def test_words_are_encoded_together(monkeypatch):
    """Plain words go to the library many as one text, and have the ids that each has on its own."""
    enc, asked = bpe.FragmentEncoder(bpe.vocabulary_path()), []

    class Told:
        model = enc.model

        def encode_batch_fast(self, texts, **k):
            asked.extend(texts)
            return self.model.encode_batch_fast(texts, **k)

    rng = np.random.default_rng(6)
    words = ["".join(rng.choice([*"abcdeéüßÀØost"], n)) for n in rng.integers(1, 30, 5000)] + ["don't", "a1", "!!", "</w>"]
    single = [enc.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    monkeypatch.setattr(enc, "model", Told())
    assert enc.fresh([w.encode() for w in words]) == single
    assert len(asked) == 5
    enc.last[:] = False  # a vocabulary without ends of words
    assert enc.fresh([w.encode() for w in words]) == single


def test_encoding_equals_the_library(spark, sf, texts):
    tokenizer = bpe.encoder(bpe.vocabulary_path()).tokenizer
    for r in queries.QUERIES["op6_bpe"](spark, sf).collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        told = " ".join(map(str, ids))
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(told.encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoding_of_joined_pieces(monkeypatch):
    rng = random.Random(1)
    parts = [*"abS 's!'\t\n,.09é\u0301\u00a0\u3000»…<|\0", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "ﬁ", "İ", "ß", "中", "文", "😀", "\x1c", "\x85", "Å", "a-very-long-piece-of-letters"]
    values = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(6000)]
    monkeypatch.setattr(bpe, "SLOTS", 1 << 8)  # a crowded table
    monkeypatch.setattr(bpe, "MEMO", 3000)
    enc = bpe.FragmentEncoder(bpe.vocabulary_path())
    want, got = [e.ids for e in enc.tokenizer.encode_batch(values, add_special_tokens=False)], []
    for _, _, data, offsets in common.text_chunks(pa.RecordBatch.from_arrays([pa.array(values)], ["text"]), limit=5000):
        ids, where = enc.encode(data, offsets)
        got += [ids[x:y].tolist() for x, y in zip(where, where[1:])]
    assert got == want


def test_encoding_odd(odd, none):
    tokenizer = bpe.encoder(bpe.vocabulary_path()).tokenizer
    got = bpe.encode_decode(odd.select("doc_id", "text", "n")).collect()
    assert len(got) == odd.count()
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert r.ids == [] and r.decoded == ""
        else:
            assert r.decoded == tokenizer.decode(r.ids, skip_special_tokens=False)
    assert bpe.encode_decode(none).count() == 0


# ---- 7 fingerprints


def test_fingerprints(spark, sf, texts):
    rows = {r.doc_id: r for r in queries.QUERIES["op7_simhash"](spark, sf).collect()}
    order = sorted(texts, reverse=True)
    differ = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    for i, k in enumerate(order):
        t, following = texts[k], order[(i + 1) % len(order)]
        m = len(t) // 3
        edited = t[: len(t) - m] + texts[following][:m]
        r = rows[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert math.isclose(r.near_next, 1 - differ(r.fingerprint, rows[following].fingerprint) / 64)
        assert math.isclose(r.near_edited, 1 - differ(r.fingerprint, r.edited_fingerprint) / 64)
        if k % 50 == 0:
            assert r.n_within == sum(differ(r.fingerprint, x.fingerprint) <= simhash.RADIUS for x in rows.values())
    assert sum(r.near_edited > r.near_next for r in rows.values()) > 0.9 * len(rows)


def test_block_tables_find_all(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(60)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for v in values]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    d = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    for radius, blocks in ((0, 1), (3, 5), (4, 6)):
        got = {(r.query, r.match, r.distance) for r in simhash.within_radius(d, d, radius, blocks).collect()}
        assert got == {(a, b, (x ^ y).bit_count()) for a, x in zip(signed, values) for b, y in zip(signed, values) if (x ^ y).bit_count() <= radius}


def test_fingerprint_votes(spark):
    t = "alpha beta gamma delta beta " * 900  # more than one piece of words
    d = simhash.with_fingerprint(spark.createDataFrame([(t,)], "text string"), F.col("text"), "fp")
    words = d.select(F.explode(simhash.words_of(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).select(F.xxhash64("w").alias("h"), (F.col("n") * simhash.weight(F.col("w"))).alias("v")).collect()
    want = sum(1 << b for b in range(64) if 2 * sum(r.v for r in words if (r.h >> b) & 1) > sum(r.v for r in words))
    assert d.first().fp % (1 << 64) == want


def test_fingerprints_odd(odd, none):
    got = simhash.fingerprints(odd)
    assert got.count() == odd.count()
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == 0 and by[4].fingerprint == by[5].fingerprint and by[1].n_chars == 0
    assert simhash.fingerprints(none).count() == 0


def test_next_documents_without_ids(spark, monkeypatch):
    """Many rows without an id, in ranges of few rows: each row's next is that of the whole order."""
    monkeypatch.setattr(simhash, "BUCKET_CHARS", 60)
    rows = [(i if i % 3 else None, f"text {i} of some words") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text): r.next_text for r in simhash.edited_and_next(d).collect()}
    order = [(r.doc_id, r.text) for r in d.orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text")).collect()]
    assert got == {x: order[(i + 1) % len(order)][1] for i, x in enumerate(order)}


# ---- 8 mixing


def test_mixing_equals_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted((r[0], r[5]) for r in c.sql(queries.ORACLE["op8_poisson_mix"]).fetchall())
    assert sorted((r.doc_id, r.mix_copy) for r in queries.QUERIES["op8_poisson_mix"](spark, sf).collect()) == want


def test_copies_are_poisson(spark):
    d = spark.range(40_000).selectExpr("id doc_id", "if(id % 4 = 0, 'small', 'big') source", "'' text")
    got = mixing.replicate(d, {"small": 3.0, "big": 1.0}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert abs(n["small"] - 30_000) < 700 and abs(n["big"] - 10_000) < 400
    k = mixing.replicate(d, {"small": 3.0, "big": 1.0}).filter("source = 'small'").groupBy("doc_id").count().groupBy("count").count().collect()
    k = {r[0]: r[1] for r in k}
    assert all(abs(k[i] / 10_000 - math.exp(-3) * 3**i / math.factorial(i)) < 0.02 for i in range(1, 7))


def test_copies_of_large_rates_are_poisson(spark):
    d = spark.range(401).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, "a").when(F.col("id") < 400, "b").otherwise("c").alias("source"))
    weights = {"a": 200 * 760.0, "b": 200 * 6000.0, "c": 1_500_000.0}
    rows = mixing.replicate(d, weights, size=sum(weights.values())).groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.max("mix_copy").alias("last")).collect()
    assert all(r.last == r.n - 1 for r in rows)
    for source, rate in (("a", 760), ("b", 6000)):
        n = np.array([r.n for r in rows if r.source == source])
        assert len(n) == 200 and abs(n.mean() - rate) < 5 * math.sqrt(rate / 200) and 0.6 < n.var() / rate < 1.5
    assert [abs(r.n - 1_500_000) < 5 * math.sqrt(1_500_000) for r in rows if r.source == "c"] == [True]


def test_mixing_odd(odd, none):
    once = odd.drop("source").withColumn("source", F.when(F.col("doc_id") < 5, "a"))
    got = mixing.replicate(once, size=40.0)
    assert got.filter("source IS NULL").count() > 5 and set(got.columns) == set(once.columns) | set(mixing.ADDED)
    assert mixing.replicate(none).count() == 0 and mixing.replicate(odd, {"nowhere": 1.0}).count() == 0


# ---- 9 grades


def test_grades_of_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = {r.doc_id: ordinal.GRADES[r.quality, r.toxic] for r in labels.filter("doc_id % 4 = 0").collect()}
    got = [r for r in ordinal.grade(docs, labels.filter("doc_id % 4 <> 0")).collect() if r.doc_id in held]
    poor, best = [r for r in got if held[r.doc_id] == 0], [r for r in got if held[r.doc_id] == 2]
    assert sum(r.kept for r in best) > 0.95 * len(best) and sum(r.kept for r in poor) < 0.1 * len(poor)
    assert all(0 <= r.p_2 <= r.p_1 <= 1 and math.isclose(r.expected_grade, r.p_1 + r.p_2) for r in got)


def plain_features(text):
    """{feature: value} of a text, word by word in Python's whole numbers."""
    full, low = (1 << 64) - 1, lambda b: b + 32 if 65 <= b <= 90 else b

    def spread(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & full
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & full
        return h ^ h >> 31

    table = [spread((i + 1) * 0x9E3779B97F4A7C15 & full) | 1 for i in range(256)]
    base = 0x9E3779B97F4A7C15 | 1
    word_hash = lambda w: spread((sum(table[low(b)] * pow(base, i, 1 << 64) for i, b in enumerate(w)) + len(w)) & full)
    data = (text or "").encode()
    words = [(m.start(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    mask, keys, distinct = (1 << ordinal.BITS) - 1, set(), set()
    for start, w in words:
        inner = w
        for _ in range(ordinal.MARKS):
            if len(inner) > 1 and ordinal.MARK[inner[-1]]:
                inner = inner[:-1]
        h = word_hash(inner)
        distinct.add(h >> 24)
        end = start + len(w)
        before = b"\0\0" + data
        tail = before[end + 1] | before[end] << 8 | before[end - 1] << 16
        keys |= {spread(h) & mask, spread((tail + (1 << 40)) & full) & mask, spread((word_hash(inner[: ordinal.PREFIX]) + (1 << 41)) & full) & mask}
    chars, n = max(len(data), 1), len(words)
    shares = [sum(65 <= b <= 90 for b in data) / chars, sum(b in b"#*$%&|<>!{}=_~^" for b in data) / chars, len(distinct) / max(n, 1), min(math.log2(n + 1) / 16, 1), data.count(10) * 8 / chars, min(chars / max(n, 1) / 24, 1)]
    out = {k: 1 / math.sqrt(max(len(keys), 1)) for k in keys}
    for i, x in enumerate(shares):
        out[(1 << ordinal.BITS) + ordinal.BINS * i + min(int(math.sqrt(min(max(x, 0), 1)) * ordinal.BINS), ordinal.BINS - 1)] = 0.5
    return out


def test_grades_equal_a_plain_version(spark, sf, docs, texts):
    """The whole query against features and chances that are computed word by word, with the same weights."""
    model = ordinal.fit_labels(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: (r.expected_grade, r.p_1, r.p_2, r.kept) for r in queries.QUERIES["op9_ordinal"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    weights = model.w.astype(np.float32)
    for k, t in texts.items():
        if len(t or "") < 3000:
            z = sum(float(weights[f]) * v for f, v in plain_features(t).items())
            p = [1 / (1 + math.exp(-(z - float(x)))) for x in model.theta]
            assert got[k][:3] == pytest.approx((sum(p), *p), abs=1e-5) and got[k][3] == (got[k][2] >= 0.5)


def test_long_texts_are_learnt_from(spark):
    """A labelled text of millions of characters is in the fit as others are."""
    d = spark.createDataFrame([(i, ("good " if i % 2 else "bad ") * (400_000 if i < 2 else 30)) for i in range(60)], "doc_id long, text string")
    y = d.selectExpr("doc_id", "int(doc_id % 2) AS quality", "0 AS toxic")
    got = {r.doc_id: r.expected_grade for r in ordinal.grade(d, y).collect()}
    assert min(got[i] for i in got if i % 2) > max(got[i] for i in got if i % 2 == 0)


def plain_tails(model, index, value, begin):
    """P(grade >= j) of each row, from the definition."""
    z = [sum(model.w[i] * v for i, v in zip(index[a:b], value[a:b], strict=True)) for a, b in zip(begin, begin[1:], strict=False)]
    return np.array([[1 / (1 + math.exp(t - x)) for t in model.theta] for x in z])


def test_cumulative_link_against_plain_likelihood():
    """Gradients are those of the likelihood, the fit raises it, and tails are what the definition gives."""
    rng = np.random.default_rng(6)
    n, wide = 60, 8
    begin, index = np.arange(n + 1) * wide, np.sort(rng.integers(0, 40, (n, wide)), 1).reshape(-1)
    value, grades = rng.random(n * wide), rng.integers(0, 3, n)
    model = ordinal.CumulativeLink()
    model.w[:40], model.theta = rng.standard_normal(40), np.array([-0.4, 0.9])

    def loss(m):
        p = plain_tails(m, index, value, begin)
        full = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1)
        return -sum(math.log(full[i, g] - full[i, g + 1]) for i, g in enumerate(grades)) / n

    assert np.allclose(model.tails(index, value, begin), plain_tails(model, index, value, begin))
    g, dt = model.gradient(index, value, np.repeat(np.arange(n), wide), grades, np.full(n, 1 / n))
    for x, d in ((model.w, g), (model.theta, dt)):
        for at in (0, 1, 17 % len(x)):
            old = x[at]
            x[at] = old + 1e-5
            up = loss(model)
            x[at] = old - 1e-5
            down = loss(model)
            x[at] = old
            assert abs(d[at] - (up - down) / 2e-5) < 1e-6
    begun = loss(ordinal.CumulativeLink())
    assert loss(ordinal.CumulativeLink().fit(index, value, begin, grades)) < 0.9 * begun


def test_grades_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, 0, 1), (99, 1, 1), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    assert ordinal.grade(odd, labels).count() == odd.count()
    assert ordinal.grade(odd, labels.filter("false")).count() == odd.count() and ordinal.grade(none, labels).count() == 0


# ---- 10 chat


def test_escapes_are_reversible():
    rng = random.Random(2)
    parts = ["<", "|", "im_end", "|>", "<|im_end|>", "</s>", "[INST]", "\\", "<s", "[/INST", "]", "s>", "/", "\n", "x", "<<SYS>>", "/SYS>>"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROLS) and chat.unescape_name(chat.escape_name(t)) == t


def test_templates():
    render = lambda t, **c: chat.compile_template(t)(c)
    assert render("{% for x in xs %}{{ loop.index }}{{ x.a|upper }}{% if not loop.last %}, {% endif %}{% endfor %}", xs=[{"a": "p"}, {"a": "q"}]) == ("1P, 2Q", [])
    assert render("{% set y = 1 + 2 %}{{ y }}{{ 'a' ~ 1 == 'a1' and 2 or 3 }}{# no #}") == ("32", [])
    assert render("a{% generation %}b{{ x }}{% endgeneration %}c", x="dé") == ("abdéc", [(1, 4)])
    assert render("{% if x == 1 %}A{% elif x %}B{% else %}C{% endif %}", x=0) == ("C", [])
    assert render("{{ x.missing }}|{{ x['k'][0] }}", x={"k": [5]}) == ("|5", [])
    assert chat.fold(chat.parse("{% if 1 == 1 %}{{ 'x' ~ 2 }}{% else %}{{ y }}{% endif %}!")) == chat.Node("block", (chat.Node("text", ("x2!",)),))
    for bad in ("{% for x %}{% endfor %}", "{{ }}", "{% if x %}", "{{ x|nope }}", "{{ f(x) }}", "{% what %}", "{{ 1 + }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    with pytest.raises(chat.TemplateError):
        render("{{ x.__class__ }}", x=3)


def test_conversations(spark, sf):
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text))
    turns[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    rows = queries.QUERIES["op10_chat"](spark, sf).collect()
    assert len(rows) == len(turns)
    for r in rows:
        told, loss = "".join(f"{a}\n{b}\n" for a, b in turns[r.conv_id]), "".join(b for a, b in turns[r.conv_id] if a == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns[r.conv_id]), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_conversations_odd(spark):
    rows = [(1, 0, None, None), (1, 0, "user\nx\\", "<|im_end|>\n"), (1, None, "assistant", "b" * 200_000), (None, 1, "assistant", ""), (2, 1, "user", "a"), (2, 1, "user", "a")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("turns", F.lit(2))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(d)).collect()}
    want = "assistant\n" + "b" * 200_000 + "\n\n\nuser\nx\\\n<|im_end|>\n\n"
    assert got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[1].loss_chars == 200_000 and got[2].n_turns == 2 and got[None].n_turns == 1
    assert chat.format_conversations(d.filter("false")).count() == 0
