"""Mixing sources to target weights by Poisson replication.

A source's target repetition rate is its wanted share of the mixture over its share of the corpus. Each document's
number of copies is drawn by inverting the Poisson distribution of that mean at a uniform number that a hash of the
seed and the document's id gives, so it is the same on every run and needs no state. A rate over MOST is split into
equal parts, each drawn at a uniform number of its own, and the draws are added: the sum is Poisson too. Copies are exploded and shuffled
globally: dealt to partitions by a hash and put in the order of another one.

Nulls and ties: a null source is a source of its own; a null id hashes as the text "null", and rows that repeat an id
draw alike. Extra columns are carried along; those named mix_copy or mix_key are replaced. Texts are never read, so their
length does not matter. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = "mix-1"
#: The columns that this operator adds.
ADDED = ("mix_copy", "mix_key")
#: The largest mean that is drawn at once (exp(-MOST) must be far from the least float).
MOST = 500


def uniform(column: Column, seed: str, part: Column | None = None) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the seed and the column's text (SQL engines agree on it)."""
    head = F.lit(f"{seed}:") if part is None else F.concat(F.lit(f"{seed}/"), part.cast("string"), F.lit(":"))
    text = F.concat(head, F.coalesce(column.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_table(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... copies at a mean `rate` up to MOST, far enough for any 52-bit uniform number."""
    size = F.ceil(rate + 10 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))
    step = lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), F.array_append(acc["cdf"], F.element_at(acc["cdf"], -1) + acc["p"] * rate / k).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), size), start, step)["cdf"]


def drawn(cdf: Column, parts: Column, column: Column, seed: str) -> Column:
    """The sum of `parts` draws from the distribution whose table is cdf."""
    below = lambda u: F.size(F.filter(cdf, lambda c: c <= u)).cast("long")
    more = F.transform(F.sequence(F.lit(1).cast("long"), parts - 1), lambda i: uniform(column, seed, i))
    first = below(F.col("_mix_u"))
    return F.when(parts > 1, first + F.aggregate(more, F.lit(0).cast("long"), lambda n, u: n + below(u))).otherwise(first)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, size: float | None = None, source: str = "source") -> DataFrame:
    """Each source's documents and target rate: weight / sum of weights * size / documents (size: that of the corpus).

    weights: by source, those not named count 0; None: all sources alike.
    """
    counts = docs.groupBy(source).agg(F.count("*").alias("n_docs"))
    if weights is None:
        weighed = counts.withColumn("weight", F.lit(1.0))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        weighed = counts.withColumn("weight", F.coalesce(F.try_element_at(given, F.col(source)), F.lit(0.0)))
    all_weight, all_docs = weighed.agg(F.sum("weight"), F.sum("n_docs")).first()
    want = float(size if size is not None else all_docs or 0)
    share = F.col("weight") / F.lit(float(all_weight)) if all_weight else F.lit(0.0)
    return weighed.select(source, "n_docs", (share * want / F.col("n_docs")).alias("rate"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, *, size: float | None = None, seed: str = SEED, source: str = "source", id_column: str = "doc_id") -> DataFrame:
    """docs with each row repeated as drawn, in a global random order; adds mix_copy (from 0) and mix_key (the order).

    A source of any size is replicated where its rows are: the rates (one row a source) are joined by broadcast if
    their number is known to be small, else by Spark's own choice of join.
    """
    if clash := [c for c in ADDED if c in docs.columns]:
        docs = docs.drop(*clash)
    parts = F.greatest(F.ceil(F.col("rate") / MOST), F.lit(1)).cast("long")
    rates = source_rates(docs, weights, size, source).select(F.col(source).alias("_mix_source"), parts.alias("_mix_parts"), poisson_table(F.col("rate") / parts).alias("_mix_cdf"))
    few = docs.select(source).distinct().limit(10_001).count() <= 10_000
    joined = docs.join(F.broadcast(rates) if few else rates, F.col(source).eqNullSafe(F.col("_mix_source")))
    u = uniform(F.col(id_column), seed)
    copies = drawn(F.col("_mix_cdf"), F.col("_mix_parts"), F.col(id_column), seed).cast("int")
    exploded = joined.withColumn("_mix_u", u).withColumn("_mix_n", copies).filter("_mix_n > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("_mix_n") - 1)))
    keyed = exploded.withColumn("mix_key", F.xxhash64(F.lit(seed), id_column, "mix_copy"))
    return keyed.select(*docs.columns, *ADDED).repartition("mix_key").sortWithinPartitions("mix_key", id_column)


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed so that every source has the same expected number of documents."""
    return replicate(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("mix_key")


OP8_SQL = f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, (1.0 / (SELECT count(*) FROM counts)) * (SELECT count(*) FROM documents) / n AS rate FROM counts),
terms AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rates, range(0, 400) t(k)),
cdf AS (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
tables AS (SELECT source, list(c) AS cs FROM cdf GROUP BY source),
drawn AS (SELECT d.*, len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('{SEED}:' || doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0)) AS copies
          FROM documents d JOIN tables USING (source))
SELECT doc_id, text, lang, source, n_chars, unnest(range(copies))::INTEGER AS mix_copy FROM drawn WHERE copies > 0
"""
