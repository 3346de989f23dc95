"""Weak supervision for document quality: rules vote or abstain, EM estimates how they err, a posterior decides.

Each rule looks at counts of a whole text and votes bad (-1), good (1) or abstains (0). Rules are not all required to
pass: expectation-maximisation over the counted vote patterns estimates, for the good and the bad class, how often
each rule casts each vote, and a document's posterior probability of being good follows from its votes. All counting is
done with DataFrame functions; the driver sees only the table of vote patterns, at most 3 to the number of rules.

A null or empty text has no words and fails the base rule; null or repeated ids are kept as rows of their own. Rows that
repeat or tie get the same verdict. A very long text is counted whole, in one row's memory. An empty table gives an empty
result (the beliefs stand). Columns of the input are carried along except those named like an output of this operator,
which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

BLANK = " \t\n\x0b\x0c\r"
#: Up to so many repeated windows their places are found by looking each window up in their list; beyond it, by sorting.
FEW_REPEATS = 64
ITERATIONS = 60
PSEUDO_DOCS = 20.0
#: Beliefs before any vote is seen: chances of votes (bad, none, good) on bad and on good documents, and the share of good ones.
BELIEF, GOOD = ((0.35, 0.35, 0.30), (0.02, 0.18, 0.80)), 0.85


def _when(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _share(a: str, b: str = "n_words") -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: Rules by name, over the counts of `counted`: each has a range in which it votes against, one in which it votes for, and abstains between.
RULES = {
    "symbols": lambda: _when(_share("n_symbols", "word_chars") > 0.05, _share("n_symbols", "word_chars") <= 0.01),
    "wordless": lambda: _when(_share("n_bare_words") > 0.1, _share("n_bare_words") <= 0.01),
    "lengths": lambda: _when((_share("word_chars") < 3.5) | (_share("word_chars") > 7), _share("word_chars").between(4.3, 6)),
    "sentences": lambda: _when(_share("n_ends") < 0.025, _share("n_ends").between(0.05, 0.2)),
    "commas": lambda: _when(_share("n_commas") < 0.01, _share("n_commas").between(0.03, 0.15)),
    "repeats": lambda: _when(_share("n_repeat_words") > 0.1, _share("n_repeat_words") <= 0.01),
    "lines": lambda: _when(_share("n_dup_lines", "n_lines") > 0.1, F.col("n_dup_lines") == 0),
    "shouting": lambda: _when(_share("n_upper_words") > 0.1, _share("n_upper_words") <= 0.02),
    "variety": lambda: _when(_share("n_distinct_words") < F.when(F.col("n_words") < 1000, 0.55).otherwise(0.2), _share("n_distinct_words") >= F.when(F.col("n_words") < 1000, 0.65).otherwise(0.3)),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_distinct_words", "n_bare_words", "n_ends", "n_commas")


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with COUNTS (long) of each whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    inner = F.btrim(t, F.lit(BLANK))
    n = F.size("_q_w")
    d = docs.drop(*COUNTS)
    d = d.withColumn("_q_w", F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+")))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    d = d.withColumns({"_q_lines": lines, "_q_h": F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_q_w", i), F.get("_q_w", i + 1), F.get("_q_w", i + 2)))).otherwise(F.array().cast("array<bigint>"))})
    d = d.withColumn("_q_s", F.sort_array("_q_h"))
    d = d.withColumn("_q_again", F.array_distinct(F.filter("_q_s", lambda x, i: (i > 0) & (x == F.get("_q_s", i - 1)))))
    looked_up = F.filter(F.sequence(F.lit(0), n - 3), lambda i: F.array_contains("_q_again", F.get("_q_h", i)))
    placed = F.sort_array(F.transform("_q_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    near = lambda a, x, k: F.get(a, k)["h"] == x["h"]
    doubled = lambda a: F.sort_array(F.transform(F.filter(a, lambda x, k: ((k > 0) & near(a, x, k - 1)) | F.coalesce(near(a, x, k + 1), F.lit(False))), lambda x: x["i"]))
    sorted_out = F.get(F.transform(F.array(placed), doubled), 0)
    d = d.withColumn("_q_at", F.when(F.size("_q_again") == 0, F.array().cast("array<int>")).when(F.size("_q_again") <= FEW_REPEATS, looked_up).otherwise(sorted_out))
    covered = F.aggregate("_q_at", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p + 3 - a["end"])).alias("n"), (p + 3).alias("end")))["n"]
    total = lambda f: F.aggregate("_q_w", F.lit(0), lambda a, x: a + f(x))
    made = {
        "n_words": n,
        "word_chars": total(F.length),
        "n_symbols": F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", "")),
        "n_dup_lines": F.size("_q_lines") - F.size(F.array_distinct("_q_lines")),
        "n_repeat_words": covered,
        "n_lines": F.size("_q_lines"),
        "n_upper_words": total(lambda x: F.when((F.length(x) > 1) & (x == F.upper(x)) & (x != F.lower(x)), 1).otherwise(0)),
        "n_distinct_words": F.size(F.array_distinct("_q_w")),
        "n_bare_words": total(lambda x: F.when(F.length(x) <= 2, F.when(x.rlike(r"^[^\p{L}\p{N}]+$"), 1).otherwise(0)).otherwise(0)),
        "n_ends": total(lambda x: F.when(F.right(x, F.lit(1)).isin(".", "!", "?"), 1).otherwise(0)),
        "n_commas": total(lambda x: F.when(F.right(x, F.lit(1)) == ",", 1).otherwise(0)),
    }
    d = d.withColumns({k: c.cast("long") for k, c in made.items()})
    return d.drop("_q_w", "_q_lines", "_q_h", "_q_s", "_q_again", "_q_at")


def fit(patterns: Sequence[tuple[tuple[int, ...], int]]) -> tuple[float, list[list[list[float]]]]:
    """EM over (votes, documents) patterns: (share of good documents, chances[class][rule][vote + 1]), class 1 is good.

    It starts from BELIEF, and PSEUDO_DOCS documents of that belief stay in; nothing else binds the estimates, so a rule
    whose votes the others contradict loses its weight.
    """
    rules = len(patterns[0][0]) if patterns else len(RULES)
    chances = [[list(BELIEF[c]) for _ in range(rules)] for c in (0, 1)]
    prior = GOOD
    for _ in range(ITERATIONS):
        sums = [[[PSEUDO_DOCS * p for p in BELIEF[c]] for _ in range(rules)] for c in (0, 1)]
        good, all_docs = GOOD * PSEUDO_DOCS, PSEUDO_DOCS
        for votes, n in patterns:
            p = posterior(votes, prior, chances)
            good, all_docs = good + n * p, all_docs + n
            for r, v in enumerate(votes):
                sums[1][r][v + 1] += n * p
                sums[0][r][v + 1] += n * (1 - p)
        prior = min(0.999, max(0.001, good / all_docs))
        chances = [[[x / sum(row) for x in row] for row in c] for c in sums]
    return prior, chances


def posterior(votes: Sequence[int], prior: float, chances: list[list[list[float]]]) -> float:
    """The probability that a document with these votes is good."""
    z = math.log(prior / (1 - prior)) + sum(math.log(chances[1][r][v + 1] / chances[0][r][v + 1]) for r, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def judged(docs: DataFrame, *, least_words: int = 50, threshold: float = 0.5, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """docs (or the columns in keep) with COUNTS, base_failed, p_good and kept."""
    votes = {f"vote_{k}": rule() for k, rule in RULES.items()}
    made = [*COUNTS, *votes, "base_failed", "p_good", "kept"]
    carried = [c for c in (docs.columns if keep is None else keep) if c not in made]
    d = counted(docs, text).withColumns(votes).select(*carried, *COUNTS, *votes)
    d = materialise(d, "votes")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = d.filter(~failed).groupBy(*votes).count().collect()  # at most 3 ** len(RULES) rows
    prior, chances = fit([(tuple(r[v] for v in votes), r["count"]) for r in rows])
    z = F.lit(math.log(prior / (1 - prior)))
    for r, v in enumerate(votes):
        weight = [math.log(chances[1][r][k] / chances[0][r][k]) for k in range(3)]
        z = z + F.when(F.col(v) == -1, weight[0]).when(F.col(v) == 1, weight[2]).otherwise(weight[1])
    d = d.withColumns({"base_failed": failed, "p_good": 1 / (1 + F.exp(-z))})
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)).drop(*votes)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged."""
    d = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
