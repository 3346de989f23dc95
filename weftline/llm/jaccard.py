"""N-gram Jaccard self-join by universe partition and the pigeonhole principle, with exact verification.

Shingles are hashed to 64 bits; a hash range is a segment. Sets are grouped in bands of size (powers of two); a band
has a number of segments m. Two sets that are similar enough differ in at most H shingles, so of m > H segments at
least m - H are equal. A set therefore need not be indexed by all its segments: it may leave out its m - H - 1 dearest
ones, if all sets order segment contents alike (by how often the content occurs in the corpus, then by size), for then
the cheapest segment that two sets share is left out by neither. Empty segments are the dearest of all. Bands of very
small sets may instead use fewer segments with one-deletion neighbourhoods, each of which stands for two segments; a
cost model chooses. A set is also indexed in the band below its own where a partner can lie there.

Each set is indexed by some spare segments more than it must. Once the entries' true sizes
are known, a set may leave that many of its most crowded entries, by the same argument; so passages that many documents
share make no crowded entries. An entry of at most FEW sets gives their pairs. In a larger one, each set is paired with
the entry's most central set, which is the one whose own entries are the most crowded.

Where entries then still hold several components, their sets are indexed again, by single shingles. Two sets of a and b
shingles must share ceil(75 (a + b) / 175); so the rarest shingle that they share is among the first a + 1 less that
many of the one's shingles by rarity, and among the other's as well. Sets are put to classes of size (CLASS), and a set
is indexed by the shingles at its front, as many as a partner in that class can ask for. A passage that is not enough to
make two texts similar is therefore not at their fronts, however many documents hold it, and where it is enough they are
linked already. Only the fronts of sets outside their entry's largest component, and what meets these, make entries, so
what is moved grows with sets. Small groups give their pairs; in larger ones, sets outside the largest component are
taken as centres in turn, each joining what it can, as long as that joins a good part of them (STARS times at most).

What is left after that, groups in which many sets of different components share rare shingles, is compared by sketches,
block against block, each pair of blocks as a group of its own, which gives only as many pairs as join what may belong
together. Once these are verified, groups that still hold several components are compared again: now the sets of all
pairs that the sketches leave open are verified inside the group, which gives only links that join two components it has
not joined yet. So no link between components is lost, and what is put out grows with sets, not with pairs.

Pairs are first compared by parity sketches (each shingle flips one bit, so sketches never differ in more bits than the
sets in shingles), then verified exactly on whole texts. Sets that are equal are joined at the start, and only one of
each class goes on.

Null or wordless texts have empty sets and no links. Null ids: the row is returned with a null component. Rows that
repeat an id count as one document (its texts' links are pooled). Equal texts are one class; of ids that tie, the
least names it. Other columns, whatever their names, are not read. An empty table gives an empty result. A text of any
length is taken whole: a task then holds that text's shingles, and blocks hold fewer sets the larger the sets are.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, forget_caches, materialise, mix, most_frequent, text_chunks, word_hashes, word_spans
from .graph import components
from .phrases import Buckets, bitmap, bucket_rows, has, levels

WORDS, PERCENT = 5, 75
#: Contents whose counts the cost order knows (the most frequent ones; others count as rare), and the least count that a worker reports.
HOT_CONTENTS, HOT_LEAST = 65_536, 4
#: Up to so many sets of an entry are paired directly.
FEW = 8
#: An index entry with more sets than this is split over several tasks.
SPLIT_ROWS = 100_000
#: Sets of a block, and shingles in it, when the sets of an entry are compared block against block.
BLOCK_SETS, BLOCK_SHINGLES = 2048, 1 << 21
#: Sizes of a class differ by less than this factor; buckets of shingles' counts and of entries; rounds of centres in large groups.
CLASS, SHINGLE_BUCKETS, STARS = 1.1, 1 << 22, 8
_SALT = np.uint64(0x5851F42D4C957F2D)
_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(64)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a row with fewer words has its whole sequence as one."""
    starts, ends, before = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    n = max(0, len(h) - words + 1)
    s = np.full(n, words, np.uint64)
    for j in range(words):
        s += h[j : j + n] * _STEP[j]
    s = mix(s)
    out = []
    for i, j in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if j - i >= words:
            x = np.sort(s[i : j - words + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif j > i:
            total = sum((int(h[i + q]) * int(_STEP[q]) for q in range(j - i)), j - i) & 0xFFFFFFFFFFFFFFFF
            out.append(mix(np.array([total], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def most_different(a, b, percent: int):
    """The most shingles in which sets of a and b shingles may differ."""
    return ((a + b) * (100 - percent)) // (100 + percent)


def spare(band: int) -> int:
    """The segments that a set is indexed by beyond what it must: many where one passage can be most of a text."""
    return (1 << band) // (3 if band < 8 else 6)


@functools.cache
def band_plan(band: int, percent: int) -> tuple[int, bool]:
    """(segments, whether each has its one-deletion neighbourhood) of the sets of 2**band to 2**(band + 1) - 1 shingles.

    The estimated cost is the entries of a set, and a fine for sets that have too few segments that aren't empty.
    """
    low, high = 1 << band, (2 << band) - 1
    need = lambda n: most_different(n, n * 100 // percent, percent) + 1 + spare(band)

    def cost(m: int, n: int) -> float:
        p = (1 - 1 / m) ** n if m > 1 else 0.0
        mean, sd = m * (1 - p), math.sqrt(max(1e-9, m * p * (1 - p)))
        return need(n) + 20 * n * 0.5 * math.erfc((mean - need(n) + 0.5) / sd / math.sqrt(2))

    plans = [(max(cost(m, low), cost(m, high)), m, False) for m in {max(need(high), math.ceil(need(high) * x / 8)) for x in range(8, 33)}]
    m = -(-(need(high) - spare(band)) // 2)
    plans.append((m + 2 * high, m, True))  # twice: none of these entries can be left when it proves crowded
    return min(plans)[1:]


def named(sig: np.ndarray, band: int) -> np.ndarray:
    """Entries of contents: 40 bits of a hash, then six bits for the band. Contents that collide only make more candidates."""
    return ((sig >> np.uint64(18)) & ~np.uint64(63)) | np.uint64(band)


class Index:
    """Makes index entries of sets. hot: sorted contents and their counts."""

    def __init__(self, percent: int, hot: tuple[np.ndarray, np.ndarray] | None = None):
        self.percent, self.hot = percent, hot

    def counts(self, sig: np.ndarray) -> np.ndarray:
        if self.hot is None or not len(self.hot[0]):
            return np.zeros(len(sig), np.int64)
        at = np.minimum(np.searchsorted(self.hot[0], sig), len(self.hot[0]) - 1)
        return np.where(self.hot[0][at] == sig, self.hot[1][at], 0)

    def entries(self, sets: list[np.ndarray], all_segments: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(position of the set, entry) for all sets, in their own bands and in those below where needed."""
        sizes = np.array([len(x) for x in sets], np.int64)
        own = np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)
        below = (sizes > 1) & (-(-sizes * self.percent // 100) < (1 << own))
        outs, bands = [], []
        for which, band, partner in ((sizes > 0, own, sizes * 100 // self.percent), (below, own - 1, (1 << own) - 1)):
            for b in np.unique(band[which]).tolist():
                some = np.flatnonzero(which & (band == b))
                need = most_different(sizes[some], partner[some], self.percent) + 1 + spare(b)
                rows, sig = self._band([sets[i] for i in some], need, b, all_segments)
                outs.append((some[rows], sig))
                bands.append(b)
        if not outs:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate([r for r, _ in outs]), np.concatenate([named(s, b) for (_, s), b in zip(outs, bands, strict=True)])

    def _band(self, sets: list[np.ndarray], need: np.ndarray, band: int, all_segments: bool) -> tuple[np.ndarray, np.ndarray]:
        m, deletions = band_plan(band, self.percent)
        name = lambda seg: mix(np.asarray(seg, np.uint64) * np.uint64(64) + np.uint64(band))
        sizes = np.array([len(x) for x in sets])
        h, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        seg = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (seg[1:] != seg[:-1])
        at = np.flatnonzero(new)
        part = mix(h ^ _SALT)
        content = np.add.reduceat(part, at)
        row_of, seg_of, size = row[at], seg[at], np.diff(np.append(at, len(h)))
        if deletions:
            each = np.cumsum(new) - 1
            rest = mix((content[each] - part) + name(seg) + _SALT)
            rows, sigs = [row_of, row], [mix(content + name(seg_of) + _SALT), rest]
            full = np.zeros((len(sets), m), bool)
            full[row_of, seg_of.astype(np.int64)] = True
            r, s = np.nonzero(~full)
            return np.concatenate([*rows, r]), np.concatenate([*sigs, mix(name(s) + _SALT)])
        sig = mix(content + name(seg_of))
        if all_segments:
            return row_of, sig
        known = self.counts(named(sig, band))
        hot = np.minimum(np.ceil(np.log2(known + 1)), 255).astype(np.uint64)
        cost = (hot << np.uint64(56)) | ((np.uint64(255) - np.minimum(size, 255).astype(np.uint64)) << np.uint64(48)) | (sig >> np.uint64(16))
        keep = np.ones(len(sig), bool)
        bounds = np.searchsorted(row_of, np.arange(len(sets) + 1)).tolist()
        more_rows, more = [], []
        for r, (i, j, k) in enumerate(zip(bounds, bounds[1:], need.tolist(), strict=False)):
            if j - i > k:
                c = cost[i:j]
                keep[i:j] = c <= np.partition(c, k - 1)[k - 1]
            elif j - i < k:  # too few: the first of its empty segments too
                empty = np.setdiff1d(np.arange(m), seg_of[i:j].astype(np.int64))[: k - (j - i)]
                more_rows.append(np.full(len(empty), r))
                more.append(mix(name(empty)))
        return np.concatenate([row_of[keep], *more_rows]), np.concatenate([sig[keep], *more])


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x)


def _rows(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names)


def sketch(h: np.ndarray) -> bytes:
    """Parities of the shingles in each of at least twice as many bits (a power of two, 64 at least)."""
    size = 1 << max(6, int(2 * len(h) - 1).bit_length() if len(h) else 6)
    return np.packbits(np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def sketches_differ(a: bytes, b: bytes) -> int:
    """A lower bound of the shingles in which two sets differ."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, min(len(x), len(y))), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _described(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """kind 0: id, set size, 128-bit set hash and sketch of each row; kind 1: contents that a worker saw often (n times)."""

    def run(batches):
        forget_caches()
        index, seen, held = Index(percent), [], 0

        def report():
            sig, n = np.unique(np.concatenate(seen), return_counts=True)
            sig, n = sig[n >= HOT_LEAST], n[n >= HOT_LEAST]
            return _rows([pa.array([1] * len(n), pa.int32()), pa.nulls(len(n), pa.int64()), pa.array(n, pa.int64()), _long(sig), pa.array([0] * len(n), pa.int64()), pa.nulls(len(n), pa.binary())], ["kind", "id", "n", "h1", "h2", "sketch"])

        for batch in batches:
            for i, j, data, offsets in text_chunks(batch):
                sets = shingle_sets(data, offsets, words)
                n = np.array([len(x) for x in sets], np.int64)
                h1 = np.array([np.add.reduce(x) if len(x) else 0 for x in sets], np.uint64)
                h2 = np.array([np.add.reduce(mix(x)) if len(x) else 0 for x in sets], np.uint64)
                yield _rows([pa.array([0] * len(n), pa.int32()), batch.column("id").slice(i, j - i), pa.array(n), _long(h1), _long(h2), pa.array([sketch(x) for x in sets], pa.binary())], ["kind", "id", "n", "h1", "h2", "sketch"])
                seen.append(index.entries(sets, all_segments=True)[1])
                held += len(seen[-1])
                if held > 1_000_000:
                    yield report()
                    seen, held = [], 0
        if held:
            yield report()

    return docs.mapInArrow(run, "kind int, id long, n long, h1 long, h2 long, sketch binary")


def _entries(docs: DataFrame, words: int, percent: int, hot) -> DataFrame:
    """(sig, salt, id) index entries; a very frequent content is split by salt."""

    def run(batches):
        forget_caches()
        index = Index(percent, hot)
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for i, j, data, offsets in text_chunks(batch):
                row, sig = index.entries(shingle_sets(data, offsets, words))
                own = ids[i:j][row].astype(np.int64)
                parts = index.counts(sig) // SPLIT_ROWS
                salt = np.where(parts > 0, 1 + (mix(own.view(np.uint64)) % (parts + 1).astype(np.uint64)).astype(np.int64), 0)
                yield _rows([_long(sig), pa.array(salt.astype(np.int32)), pa.array(own)], ["sig", "salt", "id"])

    return docs.mapInArrow(run, "sig long, salt int, id long")


def _grouped(entries: DataFrame, few: int) -> DataFrame:
    """What entries give, by kind: 0 a pair (a, b) of one with at most `few` sets, 1 a set (a) and its larger entry (b)."""

    def run(batches):
        held: list[np.ndarray] = []
        n_held = 0

        def flush():
            rows = np.unique(np.concatenate(held), axis=0)
            return _rows([pa.array(rows[:, 0].astype(np.int32)), pa.array(rows[:, 1]), pa.array(rows[:, 2])], ["kind", "a", "b"])

        def keep(kind, a, b):
            nonlocal n_held
            held.append(np.stack([np.broadcast_to(np.int64(kind), np.shape(a)), a, np.broadcast_to(np.int64(b), np.shape(a)) if np.ndim(b) == 0 else b], 1))
            n_held += len(a)

        def small(sig, ids):
            """Runs that are complete: those with at most `few` ids, and the others."""
            new = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            size = np.diff(np.append(new, len(sig)))
            each = np.repeat(size, size)
            large = each > few
            if large.any():
                keep(1, ids[large], sig[large])
            for n in range(2, few + 1):
                at = new[size == n]
                for i in range(n if len(at) else 0):
                    for j in range(i + 1, n):
                        a, b = np.maximum(ids[at + i], ids[at + j]), np.minimum(ids[at + i], ids[at + j])
                        keep(0, a[a != b], b[a != b])

        rest_sig, rest_ids, long_run = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, salt, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "salt", "id"))
            if (salt > 0).any():  # split entries are large, whatever their parts hold
                keep(1, ids[salt > 0], sig[salt > 0])
                sig, ids = sig[salt == 0], ids[salt == 0]
            if long_run is not None:  # a run that is large already goes on
                k = int((sig != long_run).argmax()) if (sig != long_run).any() else len(sig)
                keep(1, ids[:k], long_run)
                sig, ids = sig[k:], ids[k:]
                if len(sig):
                    long_run = None
            if len(sig):
                sig, ids = np.concatenate([rest_sig, sig]), np.concatenate([rest_ids, ids])
                k = int(np.flatnonzero(sig == sig[-1])[0])
                small(sig[:k], ids[:k])
                rest_sig, rest_ids = sig[k:], ids[k:]
                if len(rest_sig) > few:
                    keep(1, rest_ids, rest_sig[0])
                    long_run, rest_sig, rest_ids = rest_sig[0], rest_sig[:0], rest_ids[:0]
            if n_held > 250_000:
                yield flush()
                held, n_held = [], 0
        if len(rest_sig):
            small(rest_sig, rest_ids)
        if n_held:
            yield flush()

    return entries.repartition("sig", "salt").sortWithinPartitions("sig", "salt", "id").mapInArrow(run, "kind int, a long, b long")


def _stars(entries: DataFrame) -> DataFrame:
    """(x, r): each set of an entry with the entry's most central one. entries: sig, salt, id, weight (how central)."""
    pivots = entries.groupBy("sig").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("pivot"), F.max("parts").alias("parts"))
    pivots = materialise(pivots, "pivots")
    if pivots.count() <= BROADCAST_ROWS:
        both = entries.join(F.broadcast(pivots.select("sig", "pivot")), "sig")
    else:  # a split entry's pivot goes to all of its parts
        both = entries.join(pivots.select("sig", "pivot", F.explode(F.sequence(F.lit(0), F.col("parts"))).alias("salt")), ["sig", "salt"])
    return both.filter("id <> pivot").select(F.greatest("id", "pivot").alias("x"), F.least("id", "pivot").alias("r")).distinct()


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets of sorted distinct shingles are similar enough."""
    a, b = (a, b) if len(a) < len(b) else (b, a)
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    same = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


def open_pairs(component: np.ndarray, n: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int):
    """For each position in `left`: it, and positions in `right` of other components that may be similar by sizes and sketches, nearest first.

    component may be changed between steps, when components are joined.
    """
    for i in left.tolist():
        j = right[(component[right] != component[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
        apart = np.bitwise_count(bits[j] ^ bits[i]).sum(1)
        near = apart <= most_different(n[j], n[i], percent)
        if near.any():
            yield i, j[near][np.argsort(apart[near], kind="stable")]


def spanning_links(component: np.ndarray, n: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, similar) -> list[tuple[int, int]]:
    """Open pairs that are similar (by a function of two positions) and join components not joined before."""
    root, out = component.copy(), []
    for i, j in open_pairs(root, n, bits, left, right, percent):
        while len(j):
            first, j = int(j[0]), j[1:]
            if similar(i, first):
                out.append((i, first))
                root[root == root[first]] = root[i]
                j = j[root[j] != root[i]]
    return out


_PLACED = "sig long, i int, j int, id long, component long, outer int, inner int, n long, sketch binary"


def _placed(entries: DataFrame, sketched: DataFrame) -> DataFrame:
    """_PLACED: the sets of entries with several components, in each group (sig, i, j) that they belong to.

    entries: sig, id, component. A set outside an entry's largest component has a block among such sets (`outer`, else
    -1), every set has one among all (`inner`); each pair of blocks is a group.
    """
    band = F.col("sig").bitwiseAND(F.lit(63))
    sizes = entries.groupBy("sig", "component").agg(F.count("*").alias("n")).groupBy("sig").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("n"))
    of = lambda n: F.ceil(n / F.greatest(F.lit(16), F.least(F.lit(BLOCK_SETS), F.lit(BLOCK_SHINGLES) / F.pow(F.lit(2.0), band)))).cast("int")
    sizes = materialise(sizes.filter("n > most").select("sig", "largest", of(F.col("n") - F.col("most")).alias("outers"), of(F.col("n")).alias("inners")), "blocks")
    placed = entries.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, "sig")
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    placed = placed.withColumns({"outer": F.when(F.col("component") != F.col("largest"), block("outers", 1)).otherwise(-1), "inner": block("inners", 2)})
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    as_inner = F.transform(F.sequence(F.lit(0), F.col("outers") - 1), lambda i: pair(i, F.col("inner")))
    as_outer = F.when(F.col("outer") >= 0, F.transform(F.sequence(F.lit(0), F.col("inners") - 1), lambda j: pair(F.col("outer"), j))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    placed = placed.select("sig", "id", "component", "outer", "inner", F.explode(F.array_union(as_inner, as_outer)).alias("at"))
    return placed.select("sig", "at.i", "at.j", "id", "component", "outer", "inner").join(sketched, "id").select(*[c.split()[0] for c in _PLACED.split(", ")])


def _by_group(placed: DataFrame, compare, schema: str) -> DataFrame:
    """What compare(sig, i, j, rows of the group) gives, a group at a time; placed: sig, i, j, id, component, outer, inner, and more."""
    columns = placed.columns

    def run(batches):
        at, rows = None, []
        for batch in batches:
            for *key, rest in zip(*[batch.column(c).to_pylist() for c in columns[:3]], zip(*[batch.column(c).to_pylist() for c in columns[3:]], strict=True), strict=True):
                if key != at:
                    if len(rows) > 1:
                        yield from compare(*at, rows)
                    at, rows = key, []
                rows.append(rest)
        if len(rows) > 1:
            yield from compare(*at, rows)

    return placed.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(run, schema)


def _group(i: int, j: int, rows: list, percent: int) -> tuple:
    """Arrays of a group's rows (id, component, outer, inner, n, sketch): ids, and the arguments of open_pairs."""
    ids, component, outer, inner, n = (np.array([r[c] for r in rows], np.int64) for c in range(5))
    words = min(len(r[5]) for r in rows) // 8
    bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(r[5], np.uint64).reshape(-1, words), axis=0) for r in rows])
    return ids, component, n, bits, np.flatnonzero(outer == i), np.flatnonzero(inner == j), percent


def _forest(placed: DataFrame, percent: int) -> DataFrame:
    """(sig, x, r): pairs that are open by their sketches, as many as join the components they belong to."""

    def compare(sig, i, j, rows):
        ids, *group = _group(i, j, rows, percent)
        if found := spanning_links(*group, lambda a, b: True):
            a, b = (ids[list(c)] for c in zip(*found, strict=True))
            yield _rows([pa.array(np.full(len(a), sig)), pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["sig", "x", "r"])

    return _by_group(placed, compare, "sig long, x long, r long")


def _across(placed: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(x, r): links between sets of a group in different components, as many as join those that are linked.

    Only sets of pairs that the sketches leave open are read: first which they are, then what they hold.
    """

    def involved(sig, i, j, rows):
        _, *group = _group(i, j, rows, percent)
        some = np.zeros(len(rows), bool)
        for k, near in open_pairs(*group):
            some[k] = some[near] = True
        if some.any():
            kept = [rows[k] for k in np.flatnonzero(some).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(kept), t) for x, t in ((sig, pa.int64()), (i, pa.int32()), (j, pa.int32()))] + [pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), fields, strict=True)], names=["sig", "i", "j", *[f.name for f in fields]])

    fields = [pa.field("id", pa.int64()), pa.field("component", pa.int64()), pa.field("outer", pa.int32()), pa.field("inner", pa.int32()), pa.field("n", pa.int64()), pa.field("sketch", pa.binary())]

    def shingled(batches):
        forget_caches()
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch):
                yield _rows([batch.column("id").slice(i, j - i), pa.array([x.tobytes() for x in shingle_sets(data, offsets, words)], pa.binary())], ["id", "shingles"])

    def compare(sig, i, j, rows):
        ids, *group = _group(i, j, rows, percent)
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        if found := spanning_links(*group, lambda a, b: _similar(sets[a], sets[b], percent)):
            a, b = (ids[list(c)] for c in zip(*found, strict=True))
            yield _rows([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["x", "r"])

    rows = materialise(_by_group(placed, involved, _PLACED), "involved")
    ids = materialise(rows.select("id").distinct(), "open")
    sets = _only(docs, ids, ids.count()).mapInArrow(shingled, "id long, shingles binary").distinct()
    return _by_group(rows.join(sets, "id").select(*rows.columns, "shingles"), compare, "x long, r long").distinct()


@functools.cache
def class_sizes() -> np.ndarray:
    """The least size of each class of sets."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * CLASS)))
    return np.array(out)


def fronts(sets: list[np.ndarray], level: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the set, entry): the rarest shingles of each set, by classes of its partners' sizes.

    level: how frequent the shingles of each bucket are. A set stands in its own class, for partners of its class or above,
    and in those below in which a partner can lie; there its front has n + 1 less the shingles that it must share with the
    smallest partner there. The last six bits of an entry are a band of size, as those of other entries.
    """
    low, rows, keys = class_sizes(), [], []
    for i, h in enumerate(sets):
        n = len(h)
        if not n:
            continue
        rare = h[np.lexsort((h, level[(h & np.uint64(SHINGLE_BUCKETS - 1)).astype(np.int64)]))]
        least = -(-n * percent // 100)
        for c in range(int(np.searchsorted(low, least, "right")) - 1, int(np.searchsorted(low, n, "right"))):
            partner = max(int(low[c]), least)
            shared = -(-percent * (n + partner) // (100 + percent))
            front = rare[: n - shared + 1]
            rows.append(np.full(len(front), i))
            keys.append(named(mix(front + np.uint64(c * int(_STEP[0]) % (1 << 64))), int(low[c]).bit_length() - 1))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(keys)


def _involved(left: DataFrame, reach: DataFrame) -> DataFrame:
    """id, outside, of the sets of entries (sig, id) that hold several components; outside: not in the largest one of some entry."""
    d = left.select("sig", "id").join(reach.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = d.groupBy("sig", "component").agg(F.count("*").alias("n")).groupBy("sig").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("parts"))
    sizes = materialise(sizes.filter("parts > 1").select("sig", "largest"), "mixed")
    d = d.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, "sig")
    return d.groupBy("id").agg(F.bool_or(F.col("component") != F.col("largest")).alias("outside"))


def _front_entries(docs: DataFrame, involved: DataFrame, words: int, percent: int) -> DataFrame:
    """(sig, salt, id) entries of the fronts of involved sets that are outside, and of those of the others that meet one of these."""
    spark = docs.sparkSession
    some = docs.join(F.broadcast(involved) if involved.count() <= BROADCAST_ROWS else involved, "id").select("id", "text", "outside")

    def counted(batches):
        forget_caches()
        seen = Buckets(SHINGLE_BUCKETS, (1 << 31) - 1)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch):
                seen.add(np.concatenate(shingle_sets(data, offsets, words)))
        yield from bucket_rows(seen)

    def entries(level, keys):
        def run(batches):
            forget_caches()
            for batch in batches:
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                for i, j, data, offsets in text_chunks(batch):
                    row, sig = fronts(shingle_sets(data, offsets, words), level.value, percent)
                    if keys is not None:
                        meets = has(keys.value, mix(sig), SHINGLE_BUCKETS)
                        row, sig = row[meets], sig[meets]
                    yield _rows([_long(sig), pa.array(np.zeros(len(sig), np.int32)), pa.array(ids[i:j][row].astype(np.int64))], ["sig", "salt", "id"])

        return run

    def keyed(batches):
        seen = Buckets(SHINGLE_BUCKETS, 1)
        for batch in batches:
            seen.add(mix(batch.column("sig").to_numpy().view(np.uint64)))
        yield from bucket_rows(seen)

    schema, segments = "sig long, salt int, id long", "segment int, counts binary"
    level = spark.sparkContext.broadcast(levels(some.select("text").mapInArrow(counted, segments), SHINGLE_BUCKETS))
    outside = materialise(some.filter("outside").mapInArrow(entries(level, None), schema), "fronts")
    keys = spark.sparkContext.broadcast(bitmap(outside.select("sig").mapInArrow(keyed, segments), 1, SHINGLE_BUCKETS))
    out = materialise(outside.unionByName(some.filter("NOT outside").mapInArrow(entries(level, keys), schema)), "front_entries")
    discard(outside)
    return out


def _centres(groups: DataFrame, reach: DataFrame, round_: int) -> DataFrame:
    """(x, r): sets of groups (sig, id) that hold several components with one of those outside the largest one, another each round."""
    d = groups.join(reach.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = d.groupBy("sig", "component").agg(F.count("*").alias("n"), F.min_by("id", F.xxhash64("id", F.lit(round_))).alias("one"))
    largest = parts.groupBy("sig").agg(F.max(F.struct("n", "component")).alias("m"), F.count("*").alias("parts")).filter("parts > 1")
    second = parts.join(largest, "sig").filter(F.struct("n", "component") < F.col("m")).groupBy("sig").agg(F.max(F.struct("n", "component", "one")).alias("c"))
    centre = materialise(second.select("sig", F.col("c.one").alias("centre"), F.col("c.component").alias("own")), "centres")
    both = d.join(F.broadcast(centre) if centre.count() <= BROADCAST_ROWS else centre, "sig").filter("component <> own")
    return both.select(F.greatest("id", "centre").alias("x"), F.least("id", "centre").alias("r")).distinct()


def _only(docs: DataFrame, ids: DataFrame, n: int, how: str = "left_semi") -> DataFrame:
    """docs whose id is (or is not) in ids, of which there are n: by broadcast if they are few."""
    return docs.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, "id", how)


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, r) whose sizes and sketches leave it open that they are similar. Only the sketches of sets in pairs are moved."""
    pairs = materialise(pairs, "open_pairs")
    ids = materialise(pairs.select(F.explode(F.array("x", "r")).alias("id")).distinct(), "in_pairs")
    sets = _only(sets, ids, ids.count())
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(side("x"), "x").join(side("r"), "r").filter(f"100 * least(nx, nr) >= {percent} * greatest(nx, nr)")

    def run(batches):
        for batch in batches:
            d = [sketches_differ(a, b) for a, b in zip(batch.column("sx").to_pylist(), batch.column("sr").to_pylist(), strict=True)]
            most = most_different(batch.column("nx").to_numpy(), batch.column("nr").to_numpy(), percent)
            ok = pa.array(np.array(d, np.int64) <= most)
            yield _rows([batch.column("x").filter(ok), batch.column("r").filter(ok)], ["x", "r"])

    return both.select("x", "r", "nx", "nr", "sx", "sr").mapInArrow(run, "x long, r long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (x, r) whose whole texts are similar enough."""
    pairs = materialise(_alike(pairs, sets, percent), "alike")
    ids = pairs.select(F.explode(F.array("x", "r")).alias("id")).distinct()
    some = _only(docs, ids, ids.count())
    both = pairs.join(some.select(F.col("id").alias("x"), F.col("text").alias("tx")), "x").join(some.select(F.col("id").alias("r"), F.col("text").alias("tr")), "r")

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = []
                for c in ("tx", "tr"):
                    sets.append([s for _, _, data, offsets in text_chunks(_rows([part.column(c)], ["text"])) for s in shingle_sets(data, offsets, words)])
                ok = [_similar(a, b, percent) for a, b in zip(*sets, strict=True)]
                ok = pa.array(ok, pa.bool_())
                yield _rows([part.column("x").filter(ok), part.column("r").filter(ok)], ["x", "r"])

    return both.select("x", "r", "tx", "tr").mapInArrow(run, "x long, r long")


def near_duplicates(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: id_column, n_shingles, class_id (least id with an equal set), component_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    found = materialise(_described(docs, words, percent), "sets")
    sets = found.filter("kind = 0").select("id", "n", "h1", "h2")
    sketched = found.filter("kind = 0 AND n > 0").select("id", "n", "sketch")
    hot = most_frequent(found.filter("kind = 1").groupBy("h1").agg(F.sum("n").alias("n")), "n", HOT_CONTENTS).collect()
    sigs = np.array([r["h1"] for r in hot], np.int64).view(np.uint64)
    order = np.argsort(sigs)
    hot = (sigs[order], np.array([r["n"] for r in hot], np.int64)[order])

    classes = sets.filter("n > 0 AND id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("id").alias("class_id"), F.max("id").alias("top")).filter("top > class_id").drop("top")
    member = materialise(sets.join(classes, ["h1", "h2", "n"], "left").select("id", "n", F.coalesce("class_id", "id").alias("class_id")), "classes")
    # An id whose rows have different texts stays in the index, linked with the classes of all its texts.
    own = member.filter("id IS NOT NULL").groupBy("id").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high"))
    copies = own.filter("low = high AND low <> id").select("id")
    pooled = member.join(own.filter("low < high").select("id"), "id", "left_semi").select(F.col("id").alias("x"), F.col("class_id").alias("r"))
    firsts = _only(docs.filter("id IS NOT NULL"), copies, copies.count(), "left_anti")

    grouped = materialise(_grouped(_entries(firsts, words, percent, hot), FEW), "grouped")
    direct = grouped.filter("kind = 0").select(F.col("a").alias("x"), F.col("b").alias("r")).distinct()
    # Each set leaves as many of its most crowded entries as its band has spare ones.
    crowded = grouped.filter("kind = 1").select(F.col("a").alias("id"), F.col("b").alias("sig"))
    crowd = materialise(crowded.groupBy("sig").agg(F.count("*").alias("crowd")), "crowds")
    few = crowd.count() <= BROADCAST_ROWS  # so that the sets of one crowded entry need not meet
    band = F.col("sig").bitwiseAND(F.lit(63))
    allowed = F.array(*[F.lit(0 if band_plan(b, percent)[1] else spare(b)) for b in range(40)])
    own = Window.partitionBy("id", band)
    ranked = crowded.join(F.broadcast(crowd) if few else crowd, "sig").withColumns({"rank": F.row_number().over(own.orderBy(F.desc("crowd"), "sig")), "weight": F.sum("crowd").over(own)})
    left = ranked.filter(F.col("rank") > F.get(allowed, band.cast("int")))
    parts = F.floor(F.col("crowd") / SPLIT_ROWS).cast("int")
    salt = F.when(parts > 0, F.pmod(F.xxhash64("id"), parts + 1)).otherwise(0).cast("int")
    left = materialise(left.select("sig", salt.alias("salt"), parts.alias("parts"), "id", "weight"), "crowded")
    star_pairs = materialise(_stars(left), "pairs")
    links = _verified(direct.unionByName(star_pairs).distinct(), docs, sketched, words, percent)
    links = materialise(links.unionByName(pooled), "near")
    discard(grouped)

    reach = materialise(components(links, "x", "r"), "components")
    of = lambda c, n: reach.select(F.col("node").alias(c), F.col("component").alias(n))
    apart = star_pairs.join(of("x", "cx"), "x", "left").join(of("r", "cr"), "r", "left").filter(F.coalesce("cx", "x") != F.coalesce("cr", "r"))
    def joined(more: DataFrame) -> bool:  # the components so far stand for their links
        nonlocal reach
        if new := not more.isEmpty():
            reach = materialise(components(of("x", "r").unionByName(more), "x", "r"), "components")
        return new

    mixed, unread = None, []
    if not apart.isEmpty():
        involved = materialise(_involved(left, reach), "involved")
        n_outside = involved.filter("outside").count()
        fronted = _front_entries(firsts, involved, words, percent)
        again = materialise(_grouped(fronted, FEW), "grouped")
        discard(fronted, involved)
        unread.append(again)
        pairs = again.filter("kind = 0").select(F.col("a").alias("x"), F.col("b").alias("r")).distinct()
        pairs = pairs.join(of("x", "cx"), "x", "left").join(of("r", "cr"), "r", "left").filter(F.coalesce("cx", "x") != F.coalesce("cr", "r")).select("x", "r")
        joined(materialise(_verified(pairs, docs, sketched, words, percent), "near"))
        mixed = again.filter("kind = 1").select(F.col("b").alias("sig"), F.col("a").alias("id"))
        for k in range(STARS):
            more = materialise(_verified(_centres(mixed, reach, k), docs, sketched, words, percent), "near")
            if not joined(more) or more.count() < n_outside / 16:
                break
    groups = mixed
    for last in (False, True):
        if mixed is None:
            break
        labelled = mixed.join(of("id", "component"), "id", "left").select("sig", "id", F.coalesce("component", "id").alias("component"))
        labelled = materialise(labelled, "labelled")
        placed = _placed(labelled, sketched)
        if last:
            more = materialise(_across(placed, docs, words, percent), "near")
        else:
            forest = materialise(_forest(placed, percent), "forest")
            more = materialise(_verified(forest.select("x", "r").distinct().join(star_pairs, ["x", "r"], "left_anti"), docs, sketched, words, percent), "near")
            sigs = forest.select("sig").distinct()  # in other groups, nothing is open
            mixed = None if forest.isEmpty() else groups.join(sigs, "sig", "left_semi")
            unread.append(forest)
        joined(more)
        discard(labelled)
    discard(found, left, star_pairs, links, *unread)
    out = member.join(of("class_id", "component"), "class_id", "left")
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their sets' sizes and components."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
