"""The pipeline against a brute-force version, and over odd rows."""

import hashlib
import math
import re

from pyspark.sql import functions as F
from test_llm_operators import base_spans, brute_components

import corpus_pipeline
from weftline.llm import bpe, mixing, quality
from weftline.llm.common import materialise


SECRET = re.compile(r"""(?:token|secret|password|passwd|api_key|apikey|access_key)["']?\x20{0,2}[=:]\x20{0,2}["']([^\s"']{16,})""", re.IGNORECASE)


def hide(t):
    secrets = [(*m.span(1), "secret") for m in SECRET.finditer(t)]
    spans, out, at = sorted([(int(a), int(b), k) for k, a, b in (s.split(":") for s in base_spans(t))] + secrets), "", 0
    for a, b, k in spans:
        if a >= at:
            out += t[at:a] + f"[{k.upper()}]"
        at = max(at, b)
    return out + t[at:]


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality.judged(docs, keep=["doc_id"]).filter("kept").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in kept}
    parts = brute_components({k: r.text for k, r in rows.items()})
    rows = {k: r for k, r in rows.items() if parts[k][1] == k}
    by_source = {}
    for r in rows.values():
        by_source[r.source] = by_source.get(r.source, 0) + 1
    tokenizer, want = bpe.encoder(bpe.vocabulary_path()).tokenizer, []
    for k, r in rows.items():
        rate = len(rows) / len(by_source) / by_source[r.source]
        u, p, total, n = int(hashlib.md5(f"{mixing.SEED}:{k}".encode()).hexdigest()[:13], 16) / 2**52, math.exp(-rate), 0.0, 0
        while (total := total + p) <= u:
            n += 1
            p *= rate / n
        ids = tokenizer.encode(hide(r.text), add_special_tokens=False).ids
        want += [(k, len(ids), ids, hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())] * n
    got = sorted((r.doc_id, r.n_tokens, list(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == sorted(want)


def test_stages_keep_columns_of_odd_rows(spark):
    good = " ".join(f"word{i} stands here." for i in range(80))
    rows = [(1, None), (2, ""), (3, good), (3, good), (4, good + " more"), (None, good.upper()), (5, "spam " * 3000), (6, good.replace("word1 ", "me@ex.org "))]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), "kept": F.lit(1)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, d, ""), name)
        assert out.columns == d.columns
        assert stage(spark, d.filter("false"), "").count() == 0
        d = out
    assert corpus_pipeline.STAGES[-1][1](spark, d, "").columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
