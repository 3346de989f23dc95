"""Token ids in a compact binary format: a static range asymmetric numeral system with shared frequency tables.

One table of symbol frequencies, counted over all documents, serves every block. A block holds whole documents and is
independent of the others. Its symbols are dealt to interleaved lanes (symbol i to lane i mod L) that are coded
together, one vector operation for a row of lanes. Lane states are kept at checkpoints, so that a block can be decoded
from any of them, in parallel if wished; checksums cover the ids and the stored bytes. Blocks are written as binary
records of Parquet files by Spark's own committer, so a lost executor leaves no half-written file behind.

Nulls: a null text counts as empty (its document is the end id alone); null ids come first in the order of documents.
Documents with the same id keep their rows, ordered by their ids; equal rows give equal ids, one document each. Memory is
bounded by a block and the longest text, which is one block whole. An empty table gives files without documents. Other
columns, whatever their names, are not read. Ids have 16 bits: a vocabulary of more than 65,536 raises.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encode_column, vocabulary_path
from .common import materialise, shared_dir, written

SCALE = 20
LOW = np.uint64(1 << 31)
BLOCK_IDS = 1 << 20
LANES = 2048
CHECKPOINT_ROWS = 128
_HEAD = struct.Struct("<4sIIIIIII")
_MAGIC = b"WRA1"


class Table:
    """Frequencies scaled to 2**SCALE, each symbol that occurs at least 1."""

    def __init__(self, frequencies: np.ndarray):
        self.frequencies = frequencies.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.frequencies)[:-1]]).astype(np.uint64)
        self.check = zlib.crc32(frequencies.astype("<u4").tobytes())
        self._symbols = None

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        total, seen = int(counts.sum()), counts > 0
        if not total:
            raise ValueError("no symbols to count")
        if seen.sum() > 1 << SCALE:
            raise ValueError("more symbols than the scale has room for")
        f = np.where(seen, np.maximum(1, counts.astype(np.float64) * (1 << SCALE) / total).astype(np.int64), 0)
        over = int(f.sum()) - (1 << SCALE)
        while over:  # what rounding has left goes to the most frequent symbols, or comes from them
            i = int(f.argmax())
            step = -over if over < 0 else min(over, int(f[i]) // 2)
            f[i] += step if over < 0 else -step
            over = int(f.sum()) - (1 << SCALE)
        return cls(f)

    @property
    def symbols(self) -> np.ndarray:
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.frequencies)), self.frequencies.astype(np.int64)).astype(np.uint16)
        return self._symbols


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """A block of 16-bit ids as bytes."""
    n = len(ids)
    lanes = min(LANES, 1 << max(0, (max(n, 1) // 64).bit_length()))
    rows = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    words, marks, written = [], [], 0
    freq, start = table.frequencies, table.starts
    if n and not freq[ids].all():
        raise ValueError("an id is not in the frequency table")
    for r in range(rows - 1, -1, -1):
        s = ids[r * lanes : (r + 1) * lanes]
        f, y = freq[s], x[: len(s)]
        full = y >= (f << np.uint64(63 - SCALE))
        if full.any():
            w = y[full].astype(np.uint32)
            words.append(w)
            written += len(w)
            y[full] >>= np.uint64(32)
        q = y // f
        y[:] = (q << np.uint64(SCALE)) + (y - q * f) + start[s]
        if r % CHECKPOINT_ROWS == 0:
            marks.append((written, x.copy()))
    marks = marks[::-1]
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    body = b"".join([np.array([written - m for m, _ in marks], "<u4").tobytes(), *(y.astype("<u8").tobytes() for _, y in marks), stream.astype("<u4").tobytes()])
    head = _HEAD.pack(_MAGIC, n, lanes, len(marks), len(stream), table.check, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body))
    return head + body


def decode_block(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a block, or those from checkpoint `first` up to checkpoint `last`."""
    magic, n, lanes, marks, size, check, ids_crc, body_crc = _HEAD.unpack_from(block)
    if magic != _MAGIC or check != table.check:
        raise ValueError("not a block of this table")
    if zlib.crc32(memoryview(block)[_HEAD.size :]) != body_crc:
        raise ValueError("the stored bytes of a block are damaged")
    at = _HEAD.size
    offsets = np.frombuffer(block, "<u4", marks, at)
    states = np.frombuffer(block, "<u8", marks * lanes, at + 4 * marks).reshape(marks, lanes)
    stream = np.frombuffer(block, "<u4", size, at + 4 * marks + 8 * marks * lanes).astype(np.uint64)
    rows = -(-n // lanes)
    last = marks if last is None else last
    begin, end = first * CHECKPOINT_ROWS, min(rows, last * CHECKPOINT_ROWS)
    out = np.empty(max(0, min(n, end * lanes) - begin * lanes), np.uint16)
    if not len(out):
        return out
    x, k = states[first].copy(), int(offsets[first])
    symbols, freq, start, mask = table.symbols, table.frequencies, table.starts, np.uint64((1 << SCALE) - 1)
    for r in range(begin, end):
        y = x[: min(lanes, n - r * lanes)]
        slot = y & mask
        s = symbols[slot]
        y[:] = freq[s] * (y >> np.uint64(SCALE)) + slot - start[s]
        low = np.flatnonzero(y < LOW)
        if len(low):
            y[low] = (y[low] << np.uint64(32)) | stream[k : k + len(low)]
            k += len(low)
        out[(r - begin) * lanes : (r - begin) * lanes + len(s)] = s
    if first == 0 and last == marks and zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("the ids of a block don't match their checksum")
    return out


_BLOCKS = "shard int, block int, doc_ids array<long>, counts array<long>, n_ids long, payload binary"


def write_ids(docs: DataFrame, out: str, *, path: str | None = None, end_id: int | None = 2, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode all texts, append end_id to each, and write blocks in ascending order of ids under `out` (blocks, table)."""
    path = path or vocabulary_path()
    end = b"" if end_id is None else struct.pack("<H", end_id)

    def tokenize(batches):
        for batch, i, j, flat, where in encode_column(batches, path, text_column):
            raw, cuts = flat.tobytes(), (2 * where).tolist()
            ids = pa.array([raw[x:y] + end for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(id_column).slice(i, j - i).cast(pa.int64()), ids], ["doc_id", "ids"])

    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column("ids"):
                total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=1 << 16)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["id", "n"])

    spark = docs.sparkSession
    tokens = materialise(docs.select(id_column, text_column).mapInArrow(tokenize, "doc_id long, ids binary"), "ids")
    rows = tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most 65,536 rows: the ids' width bounds it
    counts = np.zeros(1 << 16, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    table = Table.of_counts(counts) if rows else Table(np.zeros(1 << 16, np.int64))
    spark.createDataFrame([(table.frequencies.astype("<u4").tobytes(),)], "frequencies binary").coalesce(1).write.parquet(f"{out}/table")

    def encode(batches):
        shard, block, ids, names, counts, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush():
            flat = np.frombuffer(b"".join(ids), "<u2")
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([names], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([len(flat)], pa.int64()), pa.array([encode_block(flat, table)], pa.binary())],
                ["shard", "block", "doc_ids", "counts", "n_ids", "payload"],
            )

        for batch in batches:
            for name, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                x = x.as_py()
                ids.append(x)
                names.append(name)
                counts.append(len(x) // 2)
                held += len(x) // 2
                if held >= BLOCK_IDS:
                    yield flush()
                    block, ids, names, counts, held = block + 1, [], [], [], 0
        if names:
            yield flush()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(encode, _BLOCKS).write.option("compression", "none").parquet(f"{out}/blocks")


def read_table(spark: SparkSession, out: str) -> Table:
    """The frequency table of what write_ids has written (a quarter of a megabyte)."""
    return Table(np.frombuffer(spark.read.parquet(f"{out}/table").first()["frequencies"], "<u4"))


def read_ids(spark: SparkSession, out: str, digest: bool = False) -> DataFrame:
    """Documents read back from the blocks: doc_id, start (ids of all documents before it), n_tokens, and ids array<int>, or ids_crc32 if digest."""
    table = read_table(spark, out)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{out}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(batch.num_rows):
                names, counts = batch.column("doc_ids")[k].values, np.array(batch.column("counts")[k].as_py(), np.int64)
                flat = decode_block(batch.column("payload")[k].as_py(), table).astype("<u4")
                ends = np.cumsum(counts)
                if digest:
                    what = pa.array([zlib.crc32(flat[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], pa.int64())
                else:
                    what = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, pa.int32()))
                m = len(counts)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("shard")[k].as_py()] * m, pa.int32()), pa.array([batch.column("block")[k].as_py()] * m, pa.int32()), names, pa.array(ends - counts), pa.array(counts), what], ["shard", "block", "doc_id", "inside", "n_tokens", "what"])

    docs = blocks.select("shard", "block", "doc_ids", "counts", "payload").mapInArrow(decode, f"shard int, block int, doc_id long, inside long, n_tokens long, what {'long' if digest else 'array<int>'}")
    # Starts: sums within a shard, then over the shards (one row for each shard).
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(upto(Window.orderBy("shard"))), F.lit(0))).drop("n")
    before = blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(upto(Window.partitionBy("shard").orderBy("block"))), F.lit(0)).alias("held")).join(shards, "shard")
    return docs.join(before, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("held") + F.col("inside")).alias("start"), "n_tokens", F.col("what").alias("ids_crc32" if digest else "ids"))


def op2_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as blocks, and read back."""
    out = f"{shared_dir(spark).rstrip('/')}/weftline/rans-{uuid.uuid4().hex}"
    written(spark, out)  # the result reads these files, so they go at the end of the driver
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), out)
    return read_ids(spark, out, digest=True)
