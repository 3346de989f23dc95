"""Rows from text: row heads, totals, key lines, headings, running headers, HTML, written pieces."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prose import plain

#: Fixed value: the head of a printed row: Row 3 (RS):, Rows 2-26:, R 2 - R 26:, 1st row:, 7.
HEAD = r"(?i)^\s*(?:(?:rows?|r|rnds?|rounds?)\s*([0-9]{1,4})(?:\s*(?:-|–|to|&|and)\s*(?:r\s*)?([0-9]{1,4}))?|([0-9]{1,4})(?:st|nd|rd|th)\s+row|([0-9]{1,4})\.)\s*(?:\((rs|ws)\))?\s*:?"
WIDEST_RANGE = 300


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_no (from 0), line of each text."""
    return df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))


def row_heads(found: DataFrame, line: str = "line") -> DataFrame:
    """Lines that begin with a row head, with first, last, side and body."""
    g = lambda i: F.nullif(F.regexp_extract(line, HEAD, i), F.lit("")).try_cast("int")
    first = F.coalesce(g(1), g(3), g(4))
    d = found.withColumns({"first": first, "last": F.coalesce(g(2), first), "side": F.upper(F.regexp_extract(line, HEAD, 5)), "body": F.trim(F.regexp_replace(line, HEAD, ""))})
    return d.filter((F.col("first") >= 1) & (F.col("last") >= F.col("first")) & (F.col("last") - F.col("first") <= WIDEST_RANGE))


def expand_rows(heads: DataFrame) -> DataFrame:
    """One row for each row number that a head covers."""
    return heads.withColumn("row", F.explode(F.sequence("first", "last")))


def printed_total(body: Column) -> Column:
    """The total in trailing brackets, such as (14 boxes) or [20 sts]."""
    return F.nullif(F.regexp_extract(body, r"[\[(]\s*([0-9]{1,5})(?:\s+[A-Za-z]+)?\s*[\])]\.?\s*$", 1), F.lit("")).try_cast("int")


def body_runs(body: Column) -> Column:
    """array<struct<code, count>> of a body such as 2G, 3R or 12 C; neighbours of one code are not merged."""
    rx = F.lit(r"(?<![A-Za-z0-9])([0-9]{1,4})\s*([A-Z]{1,3})(?![A-Za-z0-9])")
    return F.zip_with(F.regexp_extract_all(body, rx, F.lit(2)), F.regexp_extract_all(body, rx, F.lit(1)), lambda c, n: F.struct(c.alias("code"), n.cast("int").alias("count")))


def key_line(line: Column) -> Column:
    """struct<code, name> of a key line such as BL = Black."""
    rx = r"^\s*([A-Za-z]{1,3})\s*=\s*([A-Za-z][A-Za-z ]*?)\s*$"
    return F.when(line.rlike(rx), F.struct(F.upper(F.regexp_extract(line, rx, 1)).alias("code"), F.regexp_extract(line, rx, 2).alias("name")))


def is_heading(line: Column) -> Column:
    """One to four capitalised words."""
    return line.rlike(r"^\s*\p{Lu}\p{L}*(?: \p{Lu}\p{L}*){0,3}\s*$")


def without_running(found: DataFrame, page: str, line: str = "line") -> DataFrame:
    """Lines that stand on one page only (running heads and feet go); counted with partial sums, not in a window."""
    pages = found.groupBy(line).agg(F.count_distinct(page).alias("_n")).filter("_n > 1").select(line)
    return found.join(pages, line, "left_anti")


def html_to_text(html: Column) -> Column:
    """Text of HTML: scripts, styles and comments go, tags of blocks become line ends, entities of markup are read."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*>|<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|aside|title|head|body|html)\b[^>]*+>", "\n")
    t = F.regexp_replace(t, r"<[^>]*+>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r"[ \t\r]+", " "), r"(?: ?\n ?)+", "\n"), F.lit(" \n"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th."""
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def code_name(i: Column) -> Column:
    """A, B, ..., Z, AA, AB, ... of 0, 1, ... (to three letters)."""
    letter = lambda x: F.chr(F.lit(65) + x)
    two, three = i - 26, i - 702
    return F.when(i < 26, letter(i)).when(i < 702, F.concat(letter(F.floor(two / 26)), letter(two % 26))).otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))


#: Words of a row that are no colours.
NOT_COLOURS = ("sc", "dc", "hdc", "tr", "ch", "st", "sts", "sl", "row", "rows", "turn", "box", "boxes")


#: Words that stand beside a count and are no colours, and marks of a row's side.
PLAIN_WORDS = (
    *NOT_COLOURS, "dtr", "fsc", "fdc", "chs", "chain", "chains", "stitch", "stitches", "inc", "dec", "tog", "sp", "sps", "space", "spaces", "block", "blocks", "tile", "tiles", "square", "squares", "round", "rounds",
    "rnd", "rnds", "time", "times", "x", "more", "rep", "repeats", "loop", "loops", "yo", "yoh", "in", "of", "and", "to", "from", "cm", "mm", "inch", "inches", "th", "nd", "rd", "first", "last", "next", "nxt", "each",
    "every", "all", "same", "into", "over", "hook", "ss",
)
SIDES = ("rs", "ws", "lr", "rl")


def names_colour(body: Column) -> Column:
    """Whether a row's body names a colour: a count beside a word, on either side, or a name in brackets, that is no plain word.

    The body is scanned to numbers, words and marks; opening brackets and an x between word and count are passed over.
    """
    tokens = F.regexp_extract_all(F.lower(F.coalesce(body, F.lit(""))), F.lit("[0-9]+|[a-z]+|[,;.)]"), F.lit(0))
    told = F.filter(tokens, lambda t: t != "x")
    number, word = (lambda t: t.rlike("^[0-9]")), (lambda t: t.rlike("^[a-z]") & ~t.isin(*PLAIN_WORDS))
    pairs = F.zip_with(told, F.slice(told, 2, 1 << 30), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    beside = F.exists(pairs, lambda p: F.coalesce((number(p["a"]) & word(p["b"])) | (word(p["a"]) & number(p["b"])), F.lit(False)))
    names = F.regexp_extract_all(F.lower(F.coalesce(body, F.lit(""))), F.lit(r"\(([a-z][a-z ]*)\)"), F.lit(1))
    named = F.exists(names, lambda n: F.forall(F.split(F.trim(n), " +"), lambda w: ~w.isin(*PLAIN_WORDS, *SIDES)))
    return beside | named


def shaping_sentence(start: Column, end: Column) -> Column:
    """What a pass does at its edges (of sequence.shaping): increases and decreases at its start and end; null if nothing."""
    def one(delta, where):
        n = F.abs(delta)
        many = F.concat(n.cast("string"), F.when(n == 1, " stitch").otherwise(" stitches"))
        return F.when(delta > 0, F.concat(F.lit("add "), many, F.lit(f" at the {where}"))).when(delta < 0, F.concat(F.lit("leave "), many, F.lit(f" at the {where}")))

    return F.nullif(F.concat_ws(", ", one(start, "start"), one(end, "end")), F.lit(""))


def look_ahead_sentence(row: Column, joins: Column, leaves: Column, simpler: Column) -> Column:
    """What changes at the next stretch (of islands.look_ahead); null where nothing is said."""
    parts = F.concat_ws(", ", F.concat(joins, F.lit(" joins")), F.concat(leaves, F.lit(" leaves")), F.when(simpler, "plain rows"))
    return F.when(row.isNotNull() & (parts != ""), F.concat(F.lit("From row "), row.cast("string"), F.lit(": "), parts))


def normalized(body: Column) -> Column:
    """A row's body in plain counts: see `prose.plain`. Repeats are expanded by `prose.expanded_runs`."""

    @F.pandas_udf("string")
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: None if b is None else plain(b))

    return run(body)


def clean_runs(runs: DataFrame, key: list[str], order: str, names: DataFrame, doc: str, own: str | None = None) -> DataFrame:
    """key, run_no, code, n of read runs: those of known colours alone, by the document's codes, neighbours of one code merged.

    runs: key (with doc), order, code (as read), n; names: doc, name, code (codes are names of themselves). Runs without
    cells, of words that are no colours, or of names that the document does not have are left out; but where `own` names a
    column with the row's own text, a code that stands in it as a word of its own is kept, in the row's first spelling.
    """
    known = names.select(doc, F.lower("name").alias("_name"), F.col("code").alias("_code")).groupBy(doc, "_name").agg(F.min("_code").alias("_code"))
    d = runs.withColumn("_name", F.lower(F.trim("code"))).filter((F.col("n") > 0) & ~F.col("_name").isin(*NOT_COLOURS))
    if own is None:
        d = d.join(known, [doc, "_name"])
    else:
        words = F.split(F.col(own), r"[^\p{L}]+")
        first = F.get(F.filter(words, lambda w: F.lower(w) == F.col("_name")), 0)
        d = d.join(known, [doc, "_name"], "left").withColumn("_code", F.coalesce("_code", first)).filter("_code IS NOT NULL")
    w = Window.partitionBy(*key).orderBy(order)
    d = d.withColumn("_new", F.when(F.lag("_code").over(w).eqNullSafe(F.col("_code")), 0).otherwise(1)).withColumn("run_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return d.groupBy(*key, "run_no").agg(F.first("_code").alias("code"), F.sum("n").cast("long").alias("n"))
