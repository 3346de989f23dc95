"""Personal data by bootstrapped contextual extraction.

Patterns of four kinds (email, ip, card, phone) give the seed entities, and assignments of long quoted values to names
such as token or password give seeds of a fifth, secret. Words that look like identifiers (they hold a digit or an @;
numeric words that follow one another are one, and so are words joined by a written "at" and "dot") are mentions. Each
mention induces lexical patterns. Contexts are the words before it (the last, the last two, each of the last three),
the label that it is assigned to (text before a colon or an equals sign), the word after it, both sides together, and its
shape with the word on either side; words stand in lower case, without marks, their digits as one class. Forms are its own:
its shape (character classes with the lengths of digit runs), the same without lengths, its kind of characters with its
length, and the same with its first character.

Patterns and mentions form a graph, which Spark scores in rounds: a pattern's confidence for a kind is the smoothed
share of its mentions that are known to be of that kind, and a pattern counts only with enough distinct seed entities
and high confidence; a mention's belief is one minus the product of its patterns' doubts, and a mention that is believed
is known in the next round. Forms support a mention but do not carry it alone: without a context that is confident of the
kind, only what passes that kind's own test is believed, however alike it looks. What a kind's own test rejects (a number of a card's length without its check
digit, an address with a part over 255, too many or too few digits after a plus sign) counts against that kind's patterns
and is never found as that kind. Rounds end when none finds a new mention. All of it is DataFrame functions; what is
grouped by pattern is aggregated partially first, so a frequent word or shape is no hot key.

Offsets are code points, ends exclusive. A null or empty text has no spans; rows that repeat an id, or have none, stay.
Where texts of one id are equal, they get the same spans. Of kinds with equal beliefs the later name is taken. A text of
any length is searched whole, in one row's memory. An empty table gives an empty result. Other columns, whatever their
names, are carried by `redacted`, not by `found`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, materialise

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: A pattern needs so many distinct seed entities, and so high a confidence, before it discovers anything.
LEAST_SEEDS, CONFIDENT = 5, 0.8

# The patterns match what the plain ones of the contract match, without their rescans and recursion on long texts:
# a match begins where a run begins (or where the match before ended), and runs are possessive. Java calls itself once for
# each repeat of a group of varying length that isn't; some thousands of them end the executor, not only the task.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?=(?:[0-9][\x20-]?){12}[0-9])[0-9][0-9\x20-]*"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SECRET = r"(?i)(?<=(?:token|secret|password|passwd|api_key|apikey|access_key)[\"']?\x20{0,2}[=:]\x20{0,2}[\"'])[^\s\"']{16,}+"
_NUMERIC = r"[0-9()./+-]*+"
# A written address: name at place dot com.
_WRITTEN = r"[^\s@]++\s++(?:at|\(at\)|\[at\])\s++[^\s@]++(?:\s++(?:dot|\(dot\)|\[dot\])\s++[\p{L}0-9-]++)++"
_MENTION = rf"(?<!\S)(?:{_WRITTEN}|[+(]?+[0-9]{_NUMERIC}(?:\x20(?=[(+]?[0-9]){_NUMERIC}(?!\S))++(?!\S)|[^\s0-9@]*+[0-9@]\S*+)"

_SPANS = "array<struct<start:int,end:int,what:string>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def _placed(matches: Column, gaps: Column) -> Column:
    """Spans of matches between gaps (one gap more than matches)."""
    start = F.struct(F.lit(0).alias("at"), _none().alias("out"))

    def step(a, i):
        s = a["at"] + F.length(F.get(gaps, i))
        e = s + F.length(F.get(matches, i))
        return F.struct(e.alias("at"), F.array_append(a["out"], F.struct(s.alias("start"), e.alias("end"), F.get(matches, i).alias("what"))).alias("out"))

    return F.when(F.size(matches) == 0, _none()).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(matches) - 1, F.lit(0))), start, step)["out"])


def _matches(df: DataFrame, name: str, pattern: str, likely: Column) -> DataFrame:
    """df with `name`: the spans of a pattern in column t, looked for only where `likely`."""
    df = df.withColumn("_m", F.when(likely, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.split("t", pattern, -1)))
    return df.withColumn(name, _placed(F.col("_m"), F.col("_g"))).drop("_m", "_g")


def _digits(what: Column) -> Column:
    return F.regexp_replace(what, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check digit's test, for up to 19 digits; more are cut, since Spark may test what another condition has ruled out."""
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.reverse(F.split(F.left(digits, F.lit(20)), "")), lambda c, i: F.when(i % 2 == 1, twice(F.ascii(c) - 48)).otherwise(F.ascii(c) - 48))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _cards(runs: Column) -> Column:
    """Spans inside runs of digits and separators: parts between two or more separators, if they pass."""
    cut = r"[\x20-]{2,}"

    def inside(run):
        parts, seps = F.split(run["what"], cut, -1), F.regexp_extract_all(run["what"], F.lit(cut), F.lit(0))
        placed = _placed(parts, F.concat(F.array(F.lit("")), seps))
        trimmed = F.transform(placed, lambda p: F.struct((p["start"] + run["start"]).alias("start"), (p["start"] + run["start"] + F.length(F.regexp_replace(p["what"], r"[\x20-]+$", ""))).alias("end"), F.regexp_replace(p["what"], r"[\x20-]+$", "").alias("what")))
        return F.filter(trimmed, lambda p: F.length(_digits(p["what"])).between(13, 19) & _luhn(_digits(p["what"])))

    return F.flatten(F.transform(runs, inside))


def seeds(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with columns email, ip, card, phone, secret and mention: arrays of {start, end, what}, mentions with the words around."""
    digit = F.col("t").rlike("[0-9]")
    d = docs.withColumn("t", F.coalesce(F.col(text), F.lit("")))
    d = _matches(d, "email", _EMAIL, F.col("t").contains("@"))
    d = _matches(d, "ip", _IP, digit)
    d = _matches(d, "card", _CARD, digit)
    d = _matches(d, "phone", _PHONE, F.col("t").contains("+"))
    d = _matches(d, "secret", _SECRET, F.col("t").rlike("(?i)token|secret|passw|api_?key|access_key"))
    # A mention's context: the pieces of text before and after it.
    written = F.col("t").rlike(r"\s[(\[]?at[)\]]?\s") & F.col("t").rlike(r"\s[(\[]?dot[)\]]?\s")
    d = d.withColumn("_m", F.when(digit | F.col("t").contains("@") | written, F.regexp_extract_all("t", F.lit(_MENTION), F.lit(0))).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("_g", F.when(F.size("_m") > 0, F.split("t", _MENTION, -1)))
    d = d.withColumn("_p", _placed(F.col("_m"), F.col("_g")))
    around = F.transform("_g", lambda g: F.struct(F.reverse(g).alias("back"), g.alias("on")))
    d = d.withColumn("_a", around)
    plain = lambda w: F.regexp_replace(F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), "[0-9]+", "9")
    back = lambda i, n: plain(F.reverse(F.regexp_extract(F.get("_a", i)["back"], r"^\s+(\S+)(?:\s+(\S+))?(?:\s+(\S+))?", n)))
    label = lambda i: F.lower(F.trim(F.reverse(F.regexp_extract(F.get("_a", i)["back"], r"^[\"'(\x20]*+[:=]\x20*+([\p{L}_-]{1,30})", 1))))
    made = lambda p, i: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["what"].alias("what"), back(i, 1).alias("one"), back(i, 2).alias("two"), back(i, 3).alias("three"), label(i).alias("label"), plain(F.regexp_extract(F.get("_a", i + 1)["on"], r"^\s+(\S+)", 1)).alias("after"))
    d = d.withColumn("mention", F.transform("_p", made))
    part = lambda x: F.forall(F.split(x["what"], r"\."), lambda y: F.coalesce(y.try_cast("decimal(38,0)") <= 255, F.lit(False)))
    return d.withColumns({
        "ip": F.filter("ip", part),
        "card": _cards(F.col("card")),
        "phone": F.filter("phone", lambda x: F.length(_digits(x["what"])).between(9, 15)),
    }).drop("t", "_m", "_g", "_p", "_a")


def _patterns(core: Column, m: Column) -> Column:
    """The lexical patterns that a mention induces, contexts marked by a @; core: the mention without what surrounds it, m: its struct."""
    shape = core
    for these, by in (("[0-9]", "9"), (r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"\p{L}+", "a")):
        shape = F.regexp_replace(shape, these, by)
    of = F.when(core.rlike("^[0-9]+$"), "number").when(core.rlike("(?i)^[0-9a-f]+$"), "hex").when(core.rlike(r"^[\p{L}\p{N}_-]+$"), "name").otherwise("mixed")
    classed = F.concat_ws(" ", of, F.length(core))
    one, two, three, after, label = (m[c] for c in ("one", "two", "three", "after", "label"))
    said = lambda name, *parts: F.concat(F.lit(f"{name} "), *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    left, right = one != "", after != ""
    every = [
        F.when(left, said("@left", one)), F.when(two != "", said("@left2", two, " ", one)), F.when(right, said("@right", after)), F.when(left & right, said("@both", one, " _ ", after)), F.when(label != "", said("@label", label)),
        *[F.when(w != "", said("@near", w)) for w in (one, two, three)], F.when(left, said("@left+shape", one, " ", shape)), F.when(right, said("@shape+right", shape, " ", after)),
        said("shape", shape), said("form", F.regexp_replace(shape, "9+", "9")), said("class", classed), said("first", F.left(core, F.lit(1)), " ", classed),
    ]
    return F.array_distinct(F.array_compact(F.array(*every)))


def _tested(core: Column) -> tuple[Column, Column]:
    """The kind whose pattern a mention has and whose test it passes, and the one whose test it fails."""
    n = F.length(_digits(core))
    part = F.forall(F.split(core, r"\."), lambda y: F.coalesce(y.try_cast("decimal(38,0)") <= 255, F.lit(False)))
    is_card = core.rlike(r"^[0-9](?:[\x20-]?+[0-9])++$") & n.between(13, 19)
    is_ip, is_phone = core.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), core.rlike(r"^\+[0-9][\x20().0-9-]+[0-9]$")
    is_email = core.rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$")
    passes = F.when(is_card & _luhn(_digits(core)), "card").when(is_ip & part, "ip").when(is_phone & n.between(9, 15), "phone").when(is_email, "email")
    return passes, F.when(is_card & ~_luhn(_digits(core)), "card").when(is_ip & ~part, "ip").when(is_phone & ~n.between(9, 15), "phone")


def mentions(found: DataFrame) -> DataFrame:
    """_key, start, end (without what surrounds the mention), what, kind (null: not a seed), passes and rejected (kinds by whose tests it passes or fails), patterns. found: _key, kinds' spans, mention."""
    known = F.flatten(F.array(*[_tagged(k) for k in ALL_KINDS]))
    m = found.filter(F.size("mention") > 0).select("_key", known.alias("known"), F.explode("mention").alias("m"))
    over = F.filter("known", lambda k: (k["start"] < F.col("m.end")) & (k["end"] > F.col("m.start")))
    m = m.select("_key", "m.*", over.alias("over"))
    first = F.get("over", 0)
    # A mention inside an entity that began before it is a part of it, not a mention of its own.
    m = m.filter((F.size("over") == 0) | (first["start"] >= F.col("start")))
    lead = F.length(F.regexp_extract("what", r"^(?:(?!\([0-9]+\))[^\p{L}\p{N}+])*+", 0))
    tail = F.length(F.regexp_extract(F.reverse("what"), r"^[^\p{L}\p{N}]*+", 0))
    core = F.substring(F.col("what"), lead + 1, F.greatest(F.length("what") - lead - tail, F.lit(0)))
    around = F.struct("one", "two", "three", "after", "label").alias("around")
    m = m.select("_key", (F.col("start") + lead).alias("start"), (F.col("end") - tail).alias("end"), core.alias("core"), first["what"].alias("seed"), first["kind"].alias("kind"), around).filter("start < end")
    passes, rejected = _tested(F.col("core"))
    return m.select("_key", "start", "end", F.coalesce("seed", "core").alias("what"), "kind", passes.alias("passes"), rejected.alias("rejected"), _patterns(F.col("core"), F.col("around")).alias("patterns")).distinct()


def discovered(m: DataFrame) -> DataFrame:
    """_key, kind, start, end of mentions that patterns discover (m: of `mentions`)."""
    state = materialise(m.withColumn("seed", F.col("kind").isNotNull()), "mentions")
    if state.filter("kind IS NULL").isEmpty() or state.filter("kind IS NOT NULL").isEmpty():
        return state.filter("false").select("_key", "kind", "start", "end")
    while True:
        edges = state.select("what", "kind", "seed", F.explode("patterns").alias("pattern"))
        counts = edges.groupBy("pattern", "kind").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("seed"), F.col("what"))).alias("n_seeds"))
        totals = F.sum("n").over(Window.partitionBy("pattern"))  # one row for each kind, six at most
        scored = counts.withColumn("confidence", F.col("n") / (totals + 1)).filter(F.col("kind").isNotNull() & (F.col("n_seeds") >= LEAST_SEEDS) & (F.col("confidence") >= CONFIDENT))
        scored = materialise(scored.select("pattern", F.col("kind").alias("found"), "confidence"), "patterns")
        few = scored.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        open_rows = state.filter("kind IS NULL").select("_key", "start", "end", "passes", "rejected", F.explode("patterns").alias("pattern"))
        # Independent patterns: one minus the product of their doubts; one of them must be a context, or the kind's own test passed.
        met = open_rows.join(F.broadcast(scored) if few else scored, "pattern").filter("rejected IS NULL OR rejected <> found")
        won = met.groupBy("_key", "start", "end", "found").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence") * 0.999)))).alias("p"), F.bool_or(F.col("pattern").startswith("@") | F.coalesce(F.col("passes") == F.col("found"), F.lit(False))).alias("carried")).filter("carried")
        won = materialise(won.groupBy("_key", "start", "end").agg(F.max_by("found", F.struct("p", "found")).alias("found")), "believed")
        discard(scored)
        if won.isEmpty():
            return state.filter("kind IS NOT NULL AND NOT seed").select("_key", "kind", "start", "end")
        before, state = state, materialise(state.join(won, ["_key", "start", "end"], "left").withColumn("kind", F.coalesce("kind", "found")).drop("found"), "mentions")
        discard(before, won)


def _tagged(kind: str) -> Column:
    return F.transform(kind, lambda x: F.named_struct(F.lit("kind"), F.lit(kind), F.lit("start"), x["start"], F.lit("end"), x["end"], F.lit("what"), x["what"]))


def _with_added(found: DataFrame) -> DataFrame:
    """found with `added`: an array of {kind, start, end}."""
    added = discovered(mentions(found)).groupBy("_key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    few = added.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = found.join(F.broadcast(added) if few else added, "_key", "left")
    return out.withColumn("added", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")))


def find(docs: DataFrame, carried: list[str], text: str = "text") -> DataFrame:
    """doc (a struct of the columns `carried`), email, ip, card, phone, secret (base spans) and added (what patterns discover)."""
    own = {f"_c{i}": c for i, c in enumerate(carried)}
    d = docs.select(*[F.col(c).alias(k) for k, c in own.items()], F.col("doc_id").alias("_id"), F.coalesce(text, F.lit("")).alias("_text"))
    d = seeds(d, "_text").withColumn("_key", F.xxhash64("_id", "_text")).select(*own, "_key", *ALL_KINDS, "mention")
    d = _with_added(materialise(d, "seeds"))
    return d.select(F.struct(*[F.col(k).alias(c) for k, c in own.items()]).alias("doc"), *ALL_KINDS, "added")


def _listed(kind: str, with_added: bool) -> Column:
    """kind:start:end of a kind's spans by start."""
    spans = F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    if with_added:
        more = F.transform(F.filter("added", lambda x: x["kind"] == kind), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
        spans = F.array_sort(F.array_distinct(F.concat(spans, more)))
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of personal data in the text replaced by its kind in brackets; overlapping spans are one."""
    d = find(docs, docs.columns, text)
    d = d.withColumn("spans", F.array_sort(F.flatten(F.array(*[_named(k) for k in (*ALL_KINDS, "added")]))))
    t = F.col(f"doc.{text}")

    def step(a, x):
        new = x["start"] >= a["at"]
        told = F.concat(F.substring(t, a["at"] + 1, F.greatest(x["start"] - a["at"], F.lit(0))), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(new, F.concat(a["out"], told)).otherwise(a["out"]).alias("out"))

    some = F.size("spans") > 0
    d = d.withColumn("done", F.when(some, F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)))
    whole = F.when(some, F.concat(F.col("done.out"), F.substring(t, F.col("done.at") + 1, F.length(t)))).otherwise(t)
    return d.select(*[whole.alias(c) if c == text else F.col(f"doc.{c}").alias(c) for c in docs.columns])


def _named(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), (x["kind"] if kind == "added" else F.lit(kind)).alias("kind")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' personal data."""
    d = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    every = lambda added: F.array_join(F.flatten(F.array(*[_listed(k, added) for k in KINDS])), ",")
    return d.select("doc.doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(every(False), 256).alias("base_sha256"), every(True).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size("secret").cast("long").alias("n_secret"))
