"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged, so a text may be cut between its two bytes
wherever the pre-tokenizer ends a piece there as well. The fragments between such cuts are encoded on their own (each
distinct fragment of a worker's stream once, by the tokenizers library) and the ids are concatenated.

A null or empty text has no ids. Rows that repeat or tie give the same ids, one result each. A text of any length is
encoded whole, in one row's memory. An empty table gives an empty result. Other columns, whatever their names, are not
read. Ids have 16 bits: a vocabulary of more than 65,536 tokens raises.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import CACHES, SPACE, mix, text_chunks

#: Places for short fragments, and the fragments after which a worker starts afresh (these affect speed alone).
SLOTS, MEMO = 1 << 20, 2_000_000


#: Words of plain letters that are encoded as one text (this affects speed alone).
JOINED = 1000

#: Words of Latin letters that are whole in Unicode's composed form.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file on this machine (the package is installed on every node)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The published rule of byte-level BPE: printable bytes stand for themselves, others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def cut_table(tokens: list[str], suffix: str, specials: list[str]) -> np.ndarray:
    """256 x 256 booleans: True where a text is certain to be cut between two bytes.

    The pair must occur inside no token (in either case of letters) nor in a special token, and must be one at which
    the pre-tokenizer ends a piece: white space on either side, two digits, or two ASCII characters of different
    kinds (letter, digit, other). An apostrophe before a letter may begin a contraction and is never cut.
    """
    alphabet, joined = byte_alphabet(), np.zeros((256, 256), bool)
    for token in tokens:
        b = [alphabet[c] for c in token.removesuffix(suffix) if c in alphabet]
        for x, y in zip(b, b[1:], strict=False):
            for x2 in {x, ord(chr(x).upper()) if x < 128 else x}:
                for y2 in {y, ord(chr(y).upper()) if y < 128 else y}:
                    joined[x2, y2] = True
    for s in specials:
        b = s.encode()
        for x, y in zip(b, b[1:], strict=False):
            joined[x, y] = True
    kind = np.full(256, 9)
    kind[:128] = 2
    for c in range(128):
        if chr(c).isalpha():
            kind[c] = 0
        elif chr(c).isdigit():
            kind[c] = 1
        elif c in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D):
            kind[c] = 3
    a, b = kind[:, None], kind[None, :]
    ends = (a == 3) | (b == 3) | ((a < 3) & (b < 3) & ((a != b) | (a == 1)))
    ends[ord("'"), kind == 0] = False
    return ends & ~joined


class FragmentEncoder:
    """Encodes texts fragment by fragment with a tokenizers file; the ids of fragments are remembered.

    Short fragments (to 16 bytes) are remembered in a table of fixed size, looked up for all fragments of a chunk at
    once: two places for each, by a hash, with the whole fragment kept for comparison. Longer ones are in a dict.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.tokens = [t for t, _ in sorted(vocab.items(), key=lambda x: x[1])]
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        self.model = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.last = np.array([t.endswith("</w>") for t in self.tokens])
        self.shown = {b: c for c, b in byte_alphabet().items()}
        self.cut = cut_table([*vocab], "</w>", specials).reshape(-1)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros((3, SLOTS), np.uint64)  # first and last 8 bytes, length
        self.value = np.zeros(SLOTS, np.int64)
        self.long: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 0
        self.at, self.size, self.values = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def fragments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the fragments of a chunk that hold no white space."""
        edge = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            edge[1:-1] = self.cut[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        edge[offsets] = True
        bounds = np.flatnonzero(edge)
        full = ~SPACE[data[bounds[:-1]]] if len(data) else np.zeros(len(bounds) - 1, bool)
        return bounds[:-1][full], bounds[1:][full]

    def fresh(self, fragments: list[bytes]) -> list[list[int]]:
        """The ids of fragments not seen before. One of plain letters is a single piece that lower-casing alone changes."""
        texts = [f.decode() for f in fragments]
        plain = [*map(_PLAIN, texts)]
        letters = [t.lower().encode().decode("latin-1").translate(self.shown) for t, p in zip(texts, plain, strict=True) if p]
        quick = iter(self.of_letters(letters))
        whole = iter(self.tokenizer.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [next(quick) if p else next(whole).ids for p in plain]

    def of_letters(self, words: list[str]) -> list[list[int]]:
        """The ids of words of plain letters, many as one text: each ends with its only token that ends a word."""
        out, groups = [], [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        for group, e in zip(groups, self.model.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = e.ids
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) == len(group):
                out += [ids[i:j] for i, j in zip([0, *ends], ends, strict=False)]
            else:  # a vocabulary that lacks the end of some word
                out += [x.ids for x in self.model.encode_batch_fast(group, add_special_tokens=False)]
        return out

    def remember(self, fragments: list[bytes]) -> np.ndarray:
        """The numbers under which the ids of new fragments are kept."""
        ids = self.fresh(fragments)
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.array([y for x in ids for y in x], np.uint16)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.values + len(ids) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.pool[self.used : self.used + len(flat)] = flat
        new = np.arange(self.values, self.values + len(ids))
        self.at[new], self.size[new] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.values = self.used + len(flat), self.values + len(ids)
        return new

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The 16-bit ids of a chunk, and for each row the number of ids before it."""
        if self.values > MEMO:
            self.forget()
        starts, ends = self.fragments(data, offsets)
        length = ends - starts
        found = np.full(len(starts), -1)
        short = np.flatnonzero(length <= 16)
        n, s = length[short], starts[short]
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        k = np.zeros((3, len(short)), np.uint64)
        k[2] = n
        for i in range(16):
            some = slice(None) if not i else np.flatnonzero(n > i)
            k[i // 8, some] |= padded[s[some] + i].astype(np.uint64) << np.uint64(8 * (i % 8))
        h = mix(k[0] ^ mix(k[1] + k[2]))
        one, two = (h & np.uint64(SLOTS - 1)).astype(np.int64), (h >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)
        hit = (self.keys[0][one] == k[0]) & (self.keys[1][one] == k[1]) & (self.keys[2][one] == k[2])
        found[short[hit]] = self.value[one[hit]]
        rest = np.flatnonzero(~hit)
        place = two[rest]
        hit = (self.keys[0][place] == k[0][rest]) & (self.keys[1][place] == k[1][rest]) & (self.keys[2][place] == k[2][rest])
        found[short[rest[hit]]] = self.value[place[hit]]
        rest = rest[~hit]
        if len(rest):
            order = rest[np.lexsort((k[2][rest], k[1][rest], k[0][rest]))]
            first = np.ones(len(order), bool)
            first[1:] = (k[:, order[1:]] != k[:, order[:-1]]).any(0)
            raw, which = data.tobytes(), order[first]
            value = self.remember([raw[x:y] for x, y in zip(starts[short[which]].tolist(), ends[short[which]].tolist(), strict=True)])
            found[short[order]] = value[np.cumsum(first) - 1]
            to = np.where(self.keys[2][one[which]] == 0, one[which], np.where(self.keys[2][two[which]] == 0, two[which], one[which]))
            self.keys[:, to], self.value[to] = 0, 0
            last = np.full(SLOTS, -1, np.int32) if len(to) > 1 << 14 else None  # of fragments that want one place, the last gets it
            if last is None:
                owner = {p: q for q, p in enumerate(to.tolist())}
                mine = np.fromiter(owner.values(), np.int64, len(owner))
            else:
                last[to] = np.arange(len(to))
                mine = last[last >= 0].astype(np.int64)
            self.keys[:, to[mine]], self.value[to[mine]] = k[:, which[mine]], value[mine]
        long = np.flatnonzero(length > 16)
        if len(long):
            raw = data.tobytes()
            pieces = [raw[x:y] for x, y in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
            if new := [*{*pieces}.difference(self.long)]:
                self.long |= zip(new, self.remember(new).tolist(), strict=True)
            found[long] = [*map(self.long.__getitem__, pieces)]
        size = self.size[found]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.pool[np.repeat(self.at[found] - total[:-1], size) + np.arange(total[-1])]
        return flat, total[np.searchsorted(starts, offsets)]


_ENCODERS: dict[str, FragmentEncoder] = {}
CACHES.append(_ENCODERS)


def encoder(path: str) -> FragmentEncoder:
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = FragmentEncoder(path)
    return _ENCODERS[path]


def encode_column(batches: Iterator[pa.RecordBatch], path: str, column: str = "text") -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """Pieces of batches with the 16-bit ids of their texts: batch, first row, last row, ids, ids before each row."""
    enc = encoder(path)
    for batch in batches:
        for i, j, data, offsets in text_chunks(batch, column):
            yield batch, i, j, *enc.encode(data, offsets)


def encode_decode(docs: DataFrame, path: str | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids of every whole text, and what decoding them gives: id, ids array<int>, decoded string.

    A null or empty text has no ids and decodes to an empty string; rows with a null or repeated id are kept, one
    result each. Other columns are not read. Memory is bounded by a batch and the longest text.
    """
    path = path or vocabulary_path()

    def run(batches):
        tokens = encoder(path).tokens
        for batch, i, j, flat, where in encode_column(batches, path, text_column):
            ids = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(flat, pa.int32()))
            decoded = [" ".join([tokens[t] for t in flat[x:y].tolist()]) for x, y in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_column).slice(i, j - i), ids, pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(id_column, text_column).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_column)


def encode_digests(docs: DataFrame, path: str | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """As encode_decode, with digests instead of the arrays: id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or vocabulary_path()

    def run(batches):
        tokens = encoder(path).tokens
        numbers = [str(i) for i in range(len(tokens))]
        for batch, i, j, flat, where in encode_column(batches, path, text_column):
            ids, decoded = [], []
            for x, y in zip(where[:-1].tolist(), where[1:].tolist(), strict=True):
                own = flat[x:y].tolist()
                ids.append(hashlib.sha256(" ".join(map(numbers.__getitem__, own)).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join(map(tokens.__getitem__, own)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(id_column).slice(i, j - i), pa.array(np.diff(where)), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(id_column, text_column).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_column)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
