"""Written rows to runs: a scanner and a recursive parser of items, groups and counts, for one row at a time.

A row is a list of items: counts with a colour in any of the usual spellings, groups with a count, starred groups, and words
that say nothing of colours (chains, turns, a total in brackets at the end), which are passed over. Colours are looked up in
the document's own key, the longest name first; without a key, words of one to three letters are codes.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The most repetitions of a group, depth of nested groups, and runs of a row; a body beyond them is refused, never cut.
MOST_TIMES, MOST_NESTED, MOST_RUNS = 500, 20, 5000
#: Words for stitches, words before a colour, words for a colour that has a number.
STITCHES = frozenset("sc dc hdc tr dtr fsc fdc st sts stitch stitches sl box boxes square squares tog".split())
BEFORE = frozenset("in with of".split())
NUMBERED = frozenset("colour color".split())
#: Other words of a row that are no codes, though short.
PLAIN = frozenset("ch row rows rnd r rs ws x inc dec and to the rep twice turn join end last from next more".split())
_SCAN = re.compile(r"[0-9]+|[^\W\d_]+|\S")


class Refused(ValueError):
    """A body beyond the limits."""


class Token(NamedTuple):
    text: str  # lower case
    glued: bool  # nothing between it and the token before
    raw: str


def scan(body: str) -> list[Token]:
    """Numbers, words and single marks."""
    out, end = [], -1
    for m in _SCAN.finditer(body):
        out.append(Token(m[0].lower(), m.start() == end, m[0]))
        end = m.end()
    return out


class _Fill(NamedTuple):
    """A group that is repeated until the row is full."""

    runs: list


class Row:
    """A parser of one body. key: (name, code) of the document's colours in order; a code is also its own name."""

    def __init__(self, body: str, key: list[tuple[str, str]] = ()):
        self.tokens, self.at, self.force, self.depth = scan(body), 0, "", 0
        self.codes = list(dict.fromkeys(code for _, code in key))
        self.names = {tuple(t.text for t in scan(code)): code for _, code in key} | {tuple(t.text for t in scan(name)): code for name, code in key if name}
        self.longest = max(map(len, self.names), default=0)

    def text(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i].text if i < len(self.tokens) else ""

    def glued(self, ahead: int = 0) -> bool:
        return self.at + ahead < len(self.tokens) and self.tokens[self.at + ahead].glued

    def word(self, *words: str) -> bool:
        """Take the next words if they are these."""
        if all(self.text(k) == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def number(self) -> int | None:
        if self.text().isdecimal():
            self.at += 1
            return int(self.tokens[self.at - 1].text)
        return None

    def stands_alone(self, size: int) -> bool:
        """Whether the next tokens are a whole item: marks or the ends of the body around them."""
        before = self.tokens[self.at - 1].text if self.at else ""
        return before in ("", ",", ";", ":", ".", "(", "[", "*") and self.text(size) in ("", ",", ";", ".", ")", "]")

    def colour(self, after_word: bool = False) -> str | None:
        """Take a colour: by number, by the longest of the key's names, or without a key by a short code."""
        t, follows = self.text(), self.text(1)
        if follows.isdecimal() and self.codes and (t in NUMBERED or (after_word and t == "c" and self.glued(1) and ("c", follows) not in self.names)):
            k = int(follows)
            if 1 <= k <= len(self.codes):
                self.at += 2
                return self.codes[k - 1]
        for size in range(min(self.longest, len(self.tokens) - self.at), 0, -1):
            words = tuple(self.text(k) for k in range(size))
            if words in self.names:
                self.at += size
                return self.names[words]
        if not self.names and t.isalpha() and len(t) <= 3 and t not in STITCHES and t not in PLAIN and t not in BEFORE:
            self.at += 1
            return t.upper()
        return None

    def run(self, code: str, n: int) -> list[tuple[str, int]]:
        self.force = code
        return [(code, n)]

    def count_after(self) -> int | None:
        """x 3, 3 times, 3 x, twice."""
        if self.word("twice"):
            return 2
        at = self.at
        if self.word("x") and (n := self.number()) is not None:
            return n
        self.at = at
        if (n := self.number()) is not None and (self.word("times") or self.word("x")):
            return n
        self.at = at
        return None

    def repeated(self, runs: list, times: int) -> list:
        if times > MOST_TIMES or len(runs) * times > MOST_RUNS:
            raise Refused
        return runs * times

    def counted(self, n: int) -> list:
        """What a count is of."""
        if self.word("inc"):
            return [(self.force, 2 * n)]
        if self.word("dec"):
            return [(self.force, n)]
        stitch = self.text() in STITCHES and (self.text(),) not in self.names
        self.at += stitch
        at = self.at
        joined = self.text() in BEFORE
        self.at += joined
        code = self.colour(after_word=joined)
        if code is not None:
            return self.run(code, n)
        self.at = at
        return [(self.force, n)] if stitch else []

    def bracketed(self) -> list:
        """A colour in brackets with its count, a group with a count, or at the body's end a total."""
        close = {"(": ")", "[": "]"}[self.text()]
        self.at += 1
        at = self.at
        code = self.colour()
        if code is not None and self.word(close):
            after, stitch = self.at, self.text() in STITCHES
            self.at += stitch
            if stitch and (n := self.number()) is not None:
                return self.run(code, n)
            self.at = after
            return self.run(code, self.count_after() or 1)
        self.at = at
        if self.text().isdecimal():
            size = 2 if self.text(1).isalpha() else 1
            if self.text(size) == close and self.text(size + 1) in ("", ".") and self.text(size + 2) == "":
                self.at += size + 1
                return []
        runs = self.items(close)
        self.word(close)
        times = self.count_after()
        return runs if times is None else self.repeated(runs, times)

    def starred(self) -> list:
        """*..; repeat from * so many times, or until the row is full."""
        self.at += 1
        runs = self.items("*")
        if not self.word("*"):
            return runs
        n = self.number()
        if n is not None:
            more = self.word("more")
            self.word("times")
            return self.repeated(runs, n + more)
        if self.word("to"):
            if self.word("last"):
                while self.text() not in ("", ",", ".", ";"):
                    self.at += 1
            else:
                self.word("the")
                self.word("end")
        else:
            self.word("across")
        return [_Fill(runs)]

    def item(self) -> list:
        t = self.text()
        if t in ("(", "["):
            return self.bracketed()
        if t == "*":
            return self.starred()
        if (n := self.number()) is not None:
            return self.counted(n)
        if t == "ch" and self.text(1).isdecimal() and not self.glued(1):  # a chain
            self.at += 2
            return []
        if t in STITCHES and (t,) not in self.names:
            self.at += 1
            at, n = self.at, self.number()
            if n is not None and self.text() in BEFORE:
                self.at += 1
                if (code := self.colour(after_word=True)) is not None:
                    return self.run(code, n)
            self.at = at
            return []
        at, code = self.at, self.colour()
        if code is None:
            self.at += 1
            return []
        size, self.at = self.at - at, at
        follows, glued = self.text(size), self.glued(size)
        if follows.isdecimal() and glued:
            self.at += size + 1
            return self.run(code, int(follows))
        if follows == "x" and self.text(size + 1).isdecimal():
            self.at += size + 2
            return self.run(code, int(self.text(-1)))
        if follows == "(" and self.text(size + 1).isdecimal() and self.text(size + 2) == ")":
            self.at += size + 3
            return self.run(code, int(self.text(-2)))
        if follows.isdecimal() and self.stands_alone(size + 1):
            self.at += size + 1
            return self.run(code, int(follows))
        alone = self.stands_alone(size)
        self.at += size
        return self.run(code, 1) if alone else []

    def items(self, stop: str = "") -> list:
        """Items up to a closing bracket, or for a starred group up to "repeat from"."""
        self.depth += 1
        if self.depth > MOST_NESTED:
            raise Refused
        out: list = []
        while self.at < len(self.tokens):
            if stop == "*" and self.text() in ("repeat", "rep"):
                self.at += 1
                self.word(".")
                self.word("from")
                break
            if stop != "*" and stop and self.text() == stop:
                break
            out += self.item()
            if len(out) > MOST_RUNS:
                raise Refused
        self.depth -= 1
        return out


def expand(body: str, width: int | None = None, key: list[tuple[str, str]] = ()) -> list[tuple[str, int]] | None:
    """Merged runs of a body; None if it is refused. A count without a colour has the one before it, or "".

    A group that is to fill the row does so if it fills the width (that of the row before, where the row has none of its
    own) exactly; else it stands once.
    """
    row = Row(body, key)
    try:
        runs = row.items()
        cells = lambda some: sum(n for _, n in some if isinstance(n, int))
        fixed = cells(r for r in runs if not isinstance(r, _Fill))
        out: list[tuple[str, int]] = []
        for r in runs:
            one = [x for x in r.runs if not isinstance(x, _Fill)] if isinstance(r, _Fill) else [r]
            if isinstance(r, _Fill):
                unit, rest = cells(one), (width or 0) - fixed
                one = row.repeated(one, rest // unit if unit and rest > 0 and rest % unit == 0 else 1)
            for code, n in one:
                if out and out[-1][0] == code:
                    out[-1] = (code, out[-1][1] + n)
                else:
                    out.append((code, n))
        return out if len(out) <= MOST_RUNS else None
    except Refused:
        return None


def row_width(rows: DataFrame, key: list[str], row: str, total: str) -> DataFrame:
    """rows with width: the printed total of the nearest row before that has one (for "across")."""
    w = Window.partitionBy(*key).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("width", F.last(total, ignorenulls=True).over(w))


def expanded_runs(body: Column, width: Column, key: Column | None = None) -> Column:
    """array<struct<code, n>> of bodies, null for one that is refused; width may be null.

    key: array<struct<name, code>> of the document's colours in order. Built-ins cannot multiply text by a number found in it.
    """

    @F.pandas_udf("array<struct<code:string,n:int>>")
    def run(bodies: pd.Series, widths: pd.Series, keys: pd.Series) -> pd.Series:
        found = (expand(b or "", None if pd.isna(w) else int(w), [(k["name"] or "", k["code"]) for k in ks] if ks is not None else ()) for b, w, ks in zip(bodies, widths, keys, strict=True))
        return pd.Series([None if x is None else [{"code": c, "n": n} for c, n in x] for x in found], dtype=object)

    return run(body, width, F.lit(None).cast("array<struct<name:string,code:string>>") if key is None else key)


def _classes(tokens: list[Token]) -> str:
    """One letter a token: n number, s stitch, j word before a colour, i increase, d decrease, c chain, t turn, w other word; marks are themselves."""
    named = {"inc": "i", "dec": "d", "ch": "c", "turn": "t"}
    return "".join("n" if t.text.isdecimal() else "s" if t.text in STITCHES else "j" if t.text in BEFORE else named.get(t.text) or ("w" if t.text[0].isalpha() else t.text[0]) for t in tokens)


#: An item by its classes: where its count is, where its colour's words begin, how many marks and words stand after them.
_ITEMS = ((re.compile(r"nsjw+"), 0, 3, 0), (re.compile(r"snjw+"), 1, 3, 0), (re.compile(r"\(w+\)sn"), -1, 1, 3))


def plain(body: str) -> str:
    """A body's items as a count and a colour where they say that in other words; chains, turns and a total at the end go.

    Increases and decreases become the stitches they make, and neighbouring counts of stitches without a colour are added.
    Other items stay as they are written. Repeats are for `expand`.
    """
    out: list[tuple[int | None, str]] = []
    for item in re.split(r"\s*,\s*", body.strip()):
        tokens = scan(item)
        kinds = _classes(tokens)
        total = re.search(r"[(\[]n[sw]?[)\]]\.?$", kinds)
        if total:
            tokens = tokens[: total.start()]
        dot = "." if kinds.endswith(".") and not total else ""
        tokens = tokens[: len(tokens) - len(dot)]
        kinds = _classes(tokens)
        if kinds in ("", "cn", "t", "cnt"):
            continue
        if kinds in ("ni", "nd") or (kinds == "ns" and tokens[1].text == "sc"):
            out.append((int(tokens[0].text) * (2 if kinds == "ni" else 1), dot))
            continue
        told = " ".join(t.raw for t in tokens) if total else item
        for shape, count, first, after in _ITEMS:
            if shape.fullmatch(kinds):
                told = f"{int(tokens[count].text)} {' '.join(t.raw for t in tokens[first : len(tokens) - after])}{dot}"
        if kinds == "wn" and tokens[1].glued and len(tokens[0].text) <= 3 and tokens[0].text not in PLAIN:
            told = f"{int(tokens[1].text)} {tokens[0].raw}{dot}"
        out.append((None, told))
    told, sum_ = [], 0
    for i, (n, text) in enumerate(out):
        sum_ += n or 0
        if n is None:
            told.append(text)
        elif i + 1 == len(out) or out[i + 1][0] is None:
            told.append(f"{sum_} sc{text}")
            sum_ = 0
    return ", ".join(told)
