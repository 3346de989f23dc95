"""Texts that ended an executor, or took minutes: long runs that the patterns of personal data repeat a group over."""

import time

import pytest
from pyspark.sql import functions as F

from weftline.llm import pii

LONG = {
    "numbers": ("see " + "1 2 3 4 5 " * 4000 + "end", "see " + "1 2 3 4 5 " * 4000 + "end"),
    "digits": ("see " + "1" * 20000 + " end", "see " + "1" * 20000 + " end"),
    "dashes": ("see " + "1-" * 20000 + "1 end", "see " + "1-" * 20000 + "1 end"),
    "labels": ("see a@b" + ".c" * 20000 + " end", "see [EMAIL] end"),
}


@pytest.mark.parametrize("name", LONG)
def test_long_runs_end_no_task(spark, name):
    text, want = LONG[name]
    began = time.time()
    d = spark.createDataFrame([(1, text), (2, "or bob@mail.com")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redacted(d).collect()} == {1: want, 2: "or [EMAIL]"}
    assert pii.mentions(pii.seeds(d).withColumn("_key", F.col("doc_id"))).filter("_key = 1").count() == 1
    assert time.time() - began < 100


def test_check_digits(spark):
    def plain(n):
        d = [int(c) for c in n[::-1]]
        return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0

    numbers = [str(7**k * 10**12 % 10**n).zfill(n) for n in range(13, 20) for k in range(5, 25)]
    got = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", pii._luhn(F.col("n")).alias("ok")).collect()
    assert [r.ok for r in got] == [plain(r.n) for r in got] and {r.ok for r in got} == {True, False}
