"""Document fingerprints: SimHash over weighted words, and a search by permuted block tables.

Each word's 64-bit hash votes on 64 signed bits with the word's weight (longer words weigh more, as they are rarer);
a bit of the fingerprint is set where the weight for it is over half. Votes are counted inside a row, four 16-bit
counters to a long, in pieces of 2,048 words so that no counter overflows; nothing is shuffled for it. All of it is
DataFrame functions.

To find all fingerprints within a Hamming radius r, the 64 bits are cut in b > r blocks. Two fingerprints within r agree
in at least b - r blocks whole, so a table for each choice of b - r blocks, keyed by them, holds every such pair.

A null or empty text (or one of white space) has the fingerprint 0. Rows that repeat an id, or have none, stay; of equal
ids the order is that of their texts' hashes. A bit whose votes tie is 0. A text of any length is read whole, in one row's
memory. An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

PIECE = 2048
RADIUS, BLOCKS = 3, 5
_FIELDS, _HALVES = 0x0001000100010001, 0x0000FFFF0000FFFF
_COARSE = 512
#: Characters of text in a range of ids, and the most ranges (their first rows are sent to all tasks).
BUCKET_CHARS, MOST_BUCKETS = 4_000_000, 100_000


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text in lower case."""
    inner = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def weight(word: Column) -> Column:
    """1 to 15, by the square of the length."""
    n = F.least(F.length(word), F.lit(11))
    return F.greatest(F.lit(1), F.shiftright(n * n, 3)).cast("long")


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """df with a long column `name`: the SimHash of a text."""
    w = f"_{name}_words"
    df = df.withColumn(w, words_of(text))
    hashed = F.transform(w, lambda x: F.struct(F.xxhash64(x).alias("h"), weight(x).alias("w")))
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{j}") for j in range(16)], F.lit(0).cast("long").alias("w"))
    vote = lambda a, x: F.struct(*[(a[f"c{j}"] + F.shiftrightunsigned(x["h"], j).bitwiseAND(F.lit(_FIELDS)) * x["w"]).alias(f"c{j}") for j in range(16)], (a["w"] + x["w"]).alias("w"))
    last = F.greatest(F.ceil(F.size(w) / PIECE) - 1, F.lit(0)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.aggregate(F.slice(f"_{name}_hashed", i * PIECE + 1, PIECE), zero, vote))
    df = df.withColumn(f"_{name}_hashed", hashed).withColumn(f"_{name}_votes", pieces)
    # The pieces of a text together, in counters of 32 bits: a text of 2^31 bytes has less weight than they hold.
    half = lambda c, k: (F.shiftrightunsigned(c, 16) if k else c).bitwiseAND(F.lit(_HALVES))
    names = [(j, k) for j in range(16) for k in (0, 1)]
    none = F.struct(*[F.lit(0).cast("long").alias(f"c{j}_{k}") for j, k in names], F.lit(0).cast("long").alias("w"))
    joined = F.aggregate(f"_{name}_votes", none, lambda a, p: F.struct(*[(a[f"c{j}_{k}"] + half(p[f"c{j}"], k)).alias(f"c{j}_{k}") for j, k in names], (a["w"] + p["w"]).alias("w")))
    df = df.withColumn(f"_{name}_total", joined)
    total = F.col(f"_{name}_total")
    bits = F.lit(0).cast("long")
    for b in range(64):
        field = b // 16  # of the long for b % 16; its counters are 0, 1, 2, 3 from the lowest bits
        votes = F.shiftrightunsigned(total[f"c{b % 16}_{field % 2}"], 32 * (field // 2)).bitwiseAND(F.lit(0xFFFFFFFF))
        bits = bits.bitwiseOR(F.when(2 * votes > total["w"], F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return df.withColumn(name, bits).drop(w, f"_{name}_hashed", f"_{name}_votes", f"_{name}_total")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits, 0 to 1."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def block_tables(fingerprint: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """An array of {table, key}: for each choice of blocks - radius blocks their bits, permuted to one key."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("0 <= radius < blocks <= 64")
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for t, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (bounds[i + 1] - bounds[i])) - 1) << bounds[i] for i in chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(t).alias("table"), fingerprint.bitwiseAND(F.lit(mask).cast("long")).alias("key")))
    return F.array(*out)


def within_radius(queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, name: str = "fingerprint") -> DataFrame:
    """(query, match, distance, n_rows): each distinct query's matches among all fingerprints; n_rows have the match.

    Equal fingerprints count as one entry, so copies make no hot keys; keys of tables are joined by shuffling.
    """
    q = queries.select(F.col(name).alias("query")).filter("query IS NOT NULL").distinct()
    all_rows = fingerprints.groupBy(F.col(name).alias("match")).agg(F.count("*").alias("n_rows")).filter("match IS NOT NULL")
    left = q.select("query", F.explode(block_tables(F.col("query"), radius, blocks)).alias("b")).select("query", "b.*")
    right = all_rows.select("match", "n_rows", F.explode(block_tables(F.col("match"), radius, blocks)).alias("b")).select("match", "n_rows", "b.*")
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("match")))
    return left.join(right, ["table", "key"]).select("query", "match", distance.alias("distance"), "n_rows").filter(F.col("distance") <= radius).distinct()


def _range_buckets(docs: DataFrame, tie: Column) -> tuple[Column, int]:
    """A bucket of doc_id, and how many there are: quantiles of all ids, each cut evenly if more buckets are wanted. Null ids come after all others (below 0), by ranges of the tie's bits.

    There are as many buckets as the texts need at BUCKET_CHARS each, up to MOST_BUCKETS.
    """
    chars, rows = docs.agg(F.sum(F.length("text")), F.count("*")).first()
    count = min(MOST_BUCKETS, 1 + ((chars or 0) + 16 * rows) // BUCKET_CHARS)
    nulls = -1 - F.shiftright((F.shiftright(tie, 44) + (1 << 19)) * count, 20)
    coarse = min(count, _COARSE)
    bounds = docs.agg(F.percentile_approx("doc_id", [i / coarse for i in range(coarse + 1)], 20 * coarse)).first()[0]
    if not bounds:
        return nulls.cast("long"), count
    bounds = sorted(set(bounds))
    fine = -(-count // coarse)
    known = F.array(*[F.lit(b).cast("long") for b in bounds])
    at = F.size(F.filter(known, lambda b: b <= F.col("doc_id")))
    low, high = F.coalesce(F.get(known, at - 1), F.col("doc_id")), F.coalesce(F.get(known, at), F.col("doc_id") + 1)
    inside = F.least(F.floor((F.col("doc_id") - low) * fine / (high - low)), F.lit(fine - 1)) if fine > 1 else F.lit(0)
    return F.when(F.col("doc_id").isNull(), nulls).otherwise(at * fine + inside).cast("long"), count


def edited_and_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with fingerprint, and the text and fingerprint of the next document.

    The next document is that of the next smaller id (equal ids: by the text's hash), after the last the first one.
    Rows are dealt by ranges of ids; each range also gets the first row of the range after it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    bucket, count = _range_buckets(docs, tie)
    placed = docs.withColumn("bucket", bucket)
    tops = placed.groupBy("bucket").agg(F.max("doc_id").alias("top"))  # one row for each bucket
    order = Window.orderBy(F.desc("bucket"))
    follow = tops.select("bucket", "top", F.lead("bucket").over(order).alias("next"), F.max("bucket").over(order).alias("first"))
    follow = follow.select(F.col("bucket").alias("to"), F.coalesce("next", "first").alias("from"))
    heads = placed.join(F.broadcast(tops.withColumnRenamed("bucket", "from")), (F.col("bucket") == F.col("from")) & F.col("doc_id").eqNullSafe(F.col("top"))).select("from", "doc_id", "text")
    heads = heads.groupBy("from").agg(F.min_by("doc_id", tie).alias("doc_id"), F.min_by("text", tie).alias("text"))
    heads = heads.join(follow, "from").select("doc_id", "text", F.col("to").alias("bucket"), F.lit(True).alias("guest"))
    both = with_fingerprint(placed.withColumn("guest", F.lit(False)).unionByName(heads), F.col("text"), "fingerprint")
    both = both.repartition(max(2 * count, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "bucket")  # tasks of the ranges' size
    w = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), tie)
    led = both.select("*", F.lead("text").over(w).alias("next_text"), F.lead("fingerprint").over(w).alias("next_fingerprint"))
    return led.filter("NOT guest").drop("guest", "bucket")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike they and the next document's are."""
    n, k = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    d = edited_and_next(docs).withColumn("edited", F.concat(F.left("text", n - k), F.left("next_text", k)))
    d = with_fingerprint(d.select("doc_id", n.cast("long").alias("n_chars"), "edited", "fingerprint", "next_fingerprint"), F.col("edited"), "edited_fingerprint")
    return d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' fingerprints; n_within: for ids divisible by 50, the rows within the radius (itself included)."""
    d = materialise(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")), "fingerprints")
    found = within_radius(d.filter("doc_id % 50 = 0"), d).groupBy("query").agg(F.sum("n_rows").alias("n_within"))
    d = d.join(found, (F.col("fingerprint") == F.col("query")) & (F.col("doc_id") % 50 == 0), "left").drop("query")
    as_hex = lambda c: F.lower(F.lpad(F.hex(c), 16, "0")).alias(c)
    return d.select("doc_id", "n_chars", "edited_sha256", as_hex("fingerprint"), as_hex("edited_fingerprint"), "near_edited", "near_next", "n_within")
