"""A pipeline from raw documents to token ids: STAGES, and run() which applies them.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents. It has no ORACLE_SQL, as SQL cannot express
the near-duplicate classes' closure or byte-pair encoding; tests/llm holds it against a brute-force version.

In all stages, columns beyond those of documents are carried along (the last returns its own), whatever their names; an
empty table gives an empty table; texts of any length are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, jaccard, mixing, pii, quality
from weftline.llm.common import BROADCAST_ROWS, materialise


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and very short texts among them. Rows that repeat fare alike."""
    return quality.judged(docs).filter("kept").select(*docs.columns)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the least id stays; of ties, rows that repeat this id stay too.

    Rows without an id or without words stay.
    """
    gone = materialise(jaccard.near_duplicates(docs).filter("component_id <> doc_id").select("doc_id").distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows the text. A null text stays null; equal rows stay equal."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources have equal expected shares, in a global random order.

    A null source is a source; rows that repeat an id draw alike, and ties in the order are broken by the id.
    """
    return mixing.replicate(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the SHA-256 of what the ids decode to: no ids for a null or empty text, one row for each row."""
    return bpe.encode_decode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", keep_good),
    ("near_duplicates", keep_first),
    ("personal_data", hide_personal),
    ("mixing", mix_sources),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
