"""Phrase collocation mining: hashed counts one length ahead (PCY, DHP) with Apriori pruning, then exact counts.

Pass s reads all texts once and does two things. It counts phrases of s words exactly, but only occurrences that can be
frequent: both phrases of s - 1 words inside are in the bitmap of frequent ones (Apriori), and the phrase's own bucket,
counted in the pass before, holds `least` occurrences or more (PCY). And it counts buckets of phrases of s + 1 words whose
two parts have survived, for the next pass (DHP). Buckets are hashed over a fixed number (BUCKETS), so bitmaps that go to
all tasks have a fixed size of BUCKETS / 8 bytes; a bucket never holds fewer occurrences than any of its phrases, so
pruning loses none, and what collides is counted exactly and then left out. With more text buckets fill up and prune less;
the exact counts stay whole. A task adds up buckets in BUCKETS bytes (counts end at `least`, as more do not matter) and
hands on those in use, in segments that Spark deals out and adds up.

Exact counts are keyed by language and the phrase itself. Inside a task, up to PENDING phrases are first
put together by 64-bit hashes. Long texts are cut between pieces, where no phrase goes across.

A null language is `und`, a null text is empty. Empty texts, an empty table and languages without frequent phrases give no
rows. Rows that repeat count each; ids are not read. Ties in the report go by count, then by the bytes of the phrase.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, LOWER, discard, materialise, mix, text_chunks, word_hashes

#: Words in the longest phrase, least occurrences of a candidate, the share (percent) of a longer one that drops it, rows of the report for each language.
LONGEST, LEAST, COVER, TOP = 3, 10, 50, 2000
#: Buckets (a power of two), and the buckets of a segment.
BUCKETS, SEGMENT = 1 << 24, 1 << 14
#: Groups of phrases that are ranked on their own first, so that no task sorts a whole language.
SALTS = 64
#: Distinct phrases that a task holds before it hands them on.
PENDING = 1_000_000

#: What parts pieces, and what parts words in them.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
KIND = np.zeros(256, np.uint8)
KIND[[*BLANKS]], KIND[[*BREAKS]] = 1, 2
_STEP = np.uint64(0xD1342543DE82EF95)


def text_parts(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of rows) of a batch; texts beyond the limit come in several parts, cut where a piece ends."""
    for i, j, data, offsets in text_chunks(batch, limit=limit):
        a = 0
        while j - i == 1 and len(data) - a > limit:
            b, found = a + limit, np.zeros(0, np.int64)
            while b < len(data) and not len(found):
                found = np.flatnonzero(KIND[data[b : b + limit]] == 2)
                b += int(found[0]) + 1 if len(found) else limit
            b = min(b, len(data))
            yield i, data[a:b], np.array([0, b - a])
            a = b
        if a < len(data) or not a:
            yield i, data[a:], offsets if not a else np.array([0, len(data) - a])


class Words:
    """The words of a part: where they are, their rows, their hashes, and whether the next word is in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray):
        kind = KIND[data]
        inside, edge = kind == 0, np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        first, last = edge[:-1].copy(), edge[1:].copy()
        first[1:] |= ~inside[:-1]
        last[:-1] |= ~inside[1:]
        self.data, self.starts, self.ends = data, np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        self.h = word_hashes(data, self.starts, self.ends)
        breaks = np.cumsum(kind == 2)[self.starts] if len(data) else np.zeros(0, np.int64)
        self.near = (breaks[1:] == breaks[:-1]) & (self.row[1:] == self.row[:-1])
        self.seed = seeds[self.row]

    def grams(self, size: int) -> list[np.ndarray]:
        """For 1 to `size` words, the hash of the phrase that begins at each word (also where it runs over a piece's end)."""
        out = [mix(self.h ^ self.seed)]
        for k in range(1, size):
            out.append(mix(out[-1][:-1] * _STEP + self.h[k:]))
        return out

    def whole(self, size: int) -> np.ndarray:
        """Whether a phrase of so many words begins at each word."""
        ok = np.ones(max(len(self.h) - size + 1, 0), bool)
        for k in range(size - 1):
            ok &= self.near[k : k + len(ok)]
        return ok

    def texts(self, at: np.ndarray, size: int) -> pa.Array:
        """The phrases that begin at these words, lower-cased and joined by one space."""
        word = (at[:, None] + np.arange(size)).reshape(-1)
        long = self.ends[word] - self.starts[word]
        to = np.cumsum(long + 1) - (long + 1)
        total = int((long + 1).sum())
        out = np.full(total, 32, np.uint8)
        step = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
        out[np.repeat(to, long) + step] = LOWER[self.data[np.repeat(self.starts[word], long) + step]]
        keep = np.ones(total, bool)
        keep[(to + long)[size - 1 :: size]] = False  # the space after each phrase
        offsets = np.concatenate([[0], np.cumsum((long + 1).reshape(-1, size).sum(1) - 1)])
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[keep])]).cast(pa.string())


class Buckets:
    """Counts by hashed bucket, ending at `least`."""

    def __init__(self, n: int, least: int):
        self.n, self.least, self.counts = n, least, np.zeros(n, np.uint8 if least < 256 else np.int32)

    def add(self, hashes: np.ndarray) -> None:
        at, c = np.unique(hashes & np.uint64(self.n - 1), return_counts=True)
        at = at.astype(np.int64)
        self.counts[at] = np.minimum(self.counts[at].astype(np.int64) + c, self.least)

    def segments(self) -> Iterator[tuple[int, bytes]]:
        """(segment, its buckets in use): places and counts, or all counts where that is shorter."""
        used, wide = np.flatnonzero(self.counts), self.counts.itemsize
        ids, begin = np.unique(used // SEGMENT, return_index=True)
        for s, a, b in zip(ids.tolist(), begin.tolist(), [*begin[1:].tolist(), len(used)]):
            if (b - a) * (2 + wide) < min(SEGMENT, self.n) * wide:
                yield s, b"\0" + (used[a:b] % SEGMENT).astype("<u2").tobytes() + self.counts[used[a:b]].tobytes()
            else:
                yield s, b"\1" + self.counts[s * SEGMENT : (s + 1) * SEGMENT].tobytes()


def _sums(least: int, what=lambda counts, least: np.packbits(counts >= least)):
    """Adds up segments of tasks and keeps `what` of the sums: by default one bit a bucket, whether it holds `least` occurrences."""
    kind = np.dtype(np.uint8 if least < 256 else np.int32)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, raw in zip(batch.column("segment").to_pylist(), batch.column("counts")):
                raw = raw.as_buffer()
                body, now = memoryview(raw)[1:], total.setdefault(s, np.zeros(SEGMENT, np.int64))
                if memoryview(raw)[0]:
                    c = np.frombuffer(body, kind)
                    now[: len(c)] += c
                else:
                    n = len(body) // (2 + kind.itemsize)
                    now[np.frombuffer(body, "<u2", n)] += np.frombuffer(body, kind, offset=2 * n)
                np.minimum(now, least, out=now)
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([what(c, least).tobytes() for c in total.values()], pa.binary())], ["segment", "counts"])

    return run


def bitmap(segments: DataFrame, least: int, buckets: int = BUCKETS) -> np.ndarray:
    """The bits (packed) of buckets with `least` occurrences or more, of rows of segment and counts."""
    out = np.zeros((max(buckets // SEGMENT, 1), SEGMENT // 8), np.uint8)
    for r in segments.filter("segment IS NOT NULL").select("segment", "counts").repartition("segment").mapInArrow(_sums(least), "segment int, counts binary").collect():  # BUCKETS bits
        out[r["segment"]] = np.frombuffer(r["counts"], np.uint8)
    return out.reshape(-1)


def levels(segments: DataFrame, buckets: int = BUCKETS, most: int = (1 << 31) - 1) -> np.ndarray:
    """For each bucket the binary logarithm of its count, rounded up, plus one (0: not in use), of rows of segment and counts."""
    log = lambda counts, _: np.where(counts > 0, np.ceil(np.log2(np.maximum(counts, 1))) + 1, 0).astype(np.uint8)
    out = np.zeros((max(buckets // SEGMENT, 1), SEGMENT), np.uint8)
    for r in segments.filter("segment IS NOT NULL").select("segment", "counts").repartition("segment").mapInArrow(_sums(most, log), "segment int, counts binary").collect():  # a byte a bucket
        out[r["segment"]] = np.frombuffer(r["counts"], np.uint8)
    return out.reshape(-1)


def has(bits: np.ndarray, hashes: np.ndarray, buckets: int) -> np.ndarray:
    at = (hashes & np.uint64(buckets - 1)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _seeds(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    named = np.array([zlib.crc32(x.encode()) for x in coded.dictionary.to_pylist()], np.uint64)
    return mix(named + np.uint64(1))[coded.indices.to_numpy(zero_copy_only=False)]


_SCHEMA = "lang string, phrase string, n long, segment int, counts binary"


def bucket_rows(counted: Buckets) -> Iterator[pa.RecordBatch]:
    """Rows of segment and counts, of one task's buckets."""
    found = [*counted.segments()]
    for i in range(0, len(found), 64):
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found[i : i + 64]], pa.int32()), pa.array([c for _, c in found[i : i + 64]], pa.binary())], ["segment", "counts"])


class Found:
    """Phrases of several parts, put together by hash before they are handed on; PENDING of them at most."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, h: np.ndarray, n: np.ndarray, langs: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        self.parts.append((h, n, langs, texts))
        self.rows += len(h)
        if self.rows >= PENDING:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            _, one, of = np.unique(np.concatenate([p[0] for p in self.parts]), return_index=True, return_inverse=True)
            n = np.bincount(of, np.concatenate([p[1] for p in self.parts])).astype(np.int64)
            langs, texts = (pa.concat_arrays([p[k] for p in self.parts]) for k in (2, 3))
            self.parts, self.rows = [], 0
            for a in range(0, len(one), 1 << 16):
                at = pa.array(one[a : a + (1 << 16)])
                none = pa.nulls(len(at))
                yield pa.RecordBatch.from_arrays([langs.take(at), texts.take(at), pa.array(n[a : a + (1 << 16)]), none.cast(pa.int32()), none.cast(pa.binary())], ["lang", "phrase", "n", "segment", "counts"])


def _tail(counted: Buckets | None) -> Iterator[pa.RecordBatch]:
    found = [*counted.segments()] if counted else []
    for i in range(0, len(found), 64):
        some, none = found[i : i + 64], pa.nulls(len(found[i : i + 64]))
        yield pa.RecordBatch.from_arrays([none.cast(pa.string()), none.cast(pa.string()), none.cast(pa.int64()), pa.array([s for s, _ in some], pa.int32()), pa.array([c for _, c in some], pa.binary())], ["lang", "phrase", "n", "segment", "counts"])


def counting_pass(texts: DataFrame, size: int, least: int, *, last: bool, frequent=None, ahead=None, buckets: int = BUCKETS) -> DataFrame:
    """Of lang and text: partial counts of phrases of `size` words, and unless it is the last pass buckets of the next size.

    frequent: broadcast bits of frequent phrases of size - 1 words; ahead: broadcast bits of this size's buckets.
    """

    def run(batches):
        counted, found = None if last else Buckets(buckets, least), Found()
        for batch in batches:
            langs = batch.column("lang")
            seeds = _seeds(langs)
            for i, data, offsets in text_parts(batch):
                w = Words(data, offsets, seeds[i : i + len(offsets) - 1])
                grams, alive = w.grams(size if last else size + 1), w.whole(size)
                if frequent is not None:
                    inner = has(frequent.value, grams[size - 2], buckets)
                    alive &= inner[: len(alive)] & inner[1 : len(alive) + 1] & has(ahead.value, grams[size - 1], buckets)
                at = np.flatnonzero(alive)
                h, one, n = np.unique(grams[size - 1][at], return_index=True, return_counts=True)
                at = at[one]
                yield from found.add(h, n, langs.take(pa.array(i + w.row[at])), w.texts(at, size))
                if counted:
                    counted.add(grams[size][w.whole(size + 1) & alive[:-1] & alive[1:]] if len(alive) > 1 else grams[size][:0])
        yield from found.rest()
        yield from _tail(counted)

    return texts.mapInArrow(run, _SCHEMA)


def phrase_bits(phrases: DataFrame, size: int, buckets: int = BUCKETS) -> np.ndarray:
    """Bits of the buckets of phrases (lang, phrase) of `size` words."""

    def run(batches):
        counted = Buckets(buckets, 1)
        for batch in batches:
            seeds = _seeds(batch.column("lang"))
            for i, _, data, offsets in text_chunks(batch, "phrase"):
                w = Words(data, offsets, seeds[i : i + len(offsets) - 1])
                counted.add(w.grams(size)[size - 1][::size])
        yield from _tail(counted)

    return bitmap(phrases.select("lang", "phrase").mapInArrow(run, _SCHEMA), 1, buckets)


def frequent_phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, buckets: int = BUCKETS) -> tuple[list[DataFrame], DataFrame]:
    """A table (lang, phrase, f) of frequent phrases for each number of words from 1, and (lang, n) of all words."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    tables, totals, ahead, frequent = [], None, None, None
    for size in range(1, longest + 1):
        part = materialise(counting_pass(texts, size, least, last=size == longest, frequent=frequent, ahead=ahead, buckets=buckets), "phrases", "zstd")
        found = part.filter("phrase IS NOT NULL")
        if size == 1:
            totals = materialise(found.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        tables.append(materialise(found.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least), "frequent"))
        if size < longest:
            ahead, frequent = sc.broadcast(bitmap(part, least, buckets)), sc.broadcast(phrase_bits(tables[-1], size, buckets))
        discard(part)
    return tables, totals


def _words(a: Column | str, first, n) -> Column:
    return F.array_join(F.slice(a, first, n), " ")


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole decimals."""
    d = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * {d(a)} * {d(a)}) div ({d(left)} * {d(right)})")


def uncovered(tables: list[DataFrame], cover: int = COVER) -> DataFrame:
    """lang, phrase, a, size of candidates (two words or more) that no longer candidate holds in `cover` percent of their occurrences."""
    out = None
    for size, table in enumerate(tables[1:], 2):
        mine = table.select("lang", "phrase", F.col("f").alias("a"), F.lit(size).alias("size"))
        inside = None
        for longer, t in enumerate(tables[size:], size + 1):
            w = t.select("lang", "f", F.split("phrase", " ").alias("w"))
            parts = w.select("lang", "f", F.explode(F.array(*[_words("w", F.lit(i), F.lit(size)) for i in range(1, longer - size + 2)])).alias("phrase"))
            inside = parts if inside is None else inside.unionByName(parts)
        if inside is not None:
            most = inside.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
            mine = mine.join(most, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("a"))).drop("most")
        out = mine if out is None else out.unionByName(mine)
    return out


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, cover: int = COVER, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, a, l, r, score of all candidates that stay, and (lang, n) of all words."""
    tables, totals = frequent_phrases(docs, text_col=text_col, lang_col=lang_col, longest=longest, least=least, buckets=buckets)
    parts = tables[0]
    for t in tables[1:-1]:
        parts = parts.unionByName(t)
    cut = F.sequence(F.lit(1), F.col("size") - 1)
    cuts = uncovered(tables, cover).withColumn("w", F.split("phrase", " ")).select("lang", "phrase", "a", "size", "w", F.explode(cut).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _words("w", F.lit(1), F.col("k")).alias("left"), _words("w", F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    side = lambda name, f: parts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    scored = both.withColumn("score", score("a", "l", "r"))
    least_cut = F.min(F.struct("score", "k", "l", "r")).alias("c")
    return scored.groupBy("lang", "phrase", "a").agg(least_cut).select("lang", "phrase", "a", "c.l", "c.r", "c.score"), totals


def best(scored: DataFrame, top: int = TOP) -> DataFrame:
    """rank (from 1) by score, count and phrase, and only the first `top` of each language: first in groups, then among their best."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top).drop("salt")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of each language of all documents."""
    scored, totals = collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return best(scored).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP13_SQL = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f1 AS MATERIALIZED (SELECT lang, phrase, count(*) AS f FROM (SELECT lang, unnest(w) AS phrase FROM w) GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, phrase, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM w) GROUP BY ALL),
f3 AS MATERIALIZED (SELECT lang, phrase, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM w) GROUP BY ALL HAVING count(*) >= {LEAST}),
s3 AS (SELECT lang, phrase, f, string_split(phrase, ' ') AS w FROM f3),
parts AS (SELECT lang, p, max(f) AS most FROM (SELECT lang, w[1] || ' ' || w[2] AS p, f FROM s3 UNION ALL SELECT lang, w[2] || ' ' || w[3], f FROM s3) GROUP BY ALL),
c2 AS (SELECT c.lang, c.phrase, c.f AS a, string_split(c.phrase, ' ') AS w FROM f2 AS c LEFT JOIN parts AS p ON p.lang = c.lang AND p.p = c.phrase WHERE c.f >= {LEAST} AND (p.most IS NULL OR 100 * p.most < {COVER} * c.f)),
cuts AS (SELECT lang, phrase, a, 1 AS k, w[1] AS x, w[2] AS y FROM c2 UNION ALL SELECT lang, phrase, f, 1, w[1], w[2] || ' ' || w[3] FROM s3 UNION ALL SELECT lang, phrase, f, 2, w[1] || ' ' || w[2], w[3] FROM s3),
f AS (FROM f1 UNION ALL FROM f2),
scored AS (SELECT u.lang, u.phrase, a, k, l.f AS l, r.f AS r, ((1000000 * a::HUGEINT * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts AS u JOIN f AS l ON l.lang = u.lang AND l.phrase = x JOIN f AS r ON r.lang = u.lang AND r.phrase = y),
one AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM one QUALIFY rank <= {TOP}),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang)
"""
