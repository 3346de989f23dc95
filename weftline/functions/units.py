"""Units, numbers and names as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stitch names by abbreviation, in US and UK terms.
US = {
    "ch": "chain", "sl st": "slip stitch", "sc": "single crochet", "hdc": "half double crochet", "dc": "double crochet", "tr": "treble crochet",
    "dtr": "double treble crochet", "trtr": "triple treble crochet", "sc2tog": "single crochet 2 together", "dc2tog": "double crochet 2 together",
    "hdc2tog": "half double crochet 2 together", "fsc": "foundation single crochet", "fdc": "foundation double crochet",
}
UK = {
    "ch": "chain", "ss": "slip stitch", "sl st": "slip stitch", "dc": "double crochet", "htr": "half treble", "tr": "treble", "dtr": "double treble",
    "trtr": "triple treble", "qtr": "quadruple treble", "dc2tog": "double crochet 2 together", "tr2tog": "treble 2 together",
}
CM_PER_INCH = 2.54


def stitch_name(code: Column, terms: Column, given: Column | None = None) -> Column:
    """The table's name of a stitch in terms US or UK; else the document's own."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    key = F.lower(F.trim(code))
    name = F.when(F.lower(terms) == "uk", F.try_element_at(table(UK), key)).otherwise(F.try_element_at(table(US), key))
    return F.coalesce(name, given) if given is not None else name


def cells_per_inch(count: Column, over: Column, unit: Column) -> Column:
    """Cells an inch of `count` cells over a length in in or cm; null for another unit or no length."""
    inches = F.when(unit == "in", over).when(unit == "cm", over / CM_PER_INCH)
    return F.try_divide(count.cast("double"), F.nullif(inches, F.lit(0.0)))


def finished_size(cells: Column, per_inch: Column, unit: Column) -> Column:
    """A length of cells in in or cm, to one place, half-even."""
    inches = F.try_divide(cells.cast("double"), per_inch)
    return F.bround(F.when(unit == "cm", inches * CM_PER_INCH).otherwise(inches), 1)


def plain_number(x: Column) -> Column:
    """14.0 as 14, others as they are."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def title_case(text: Column) -> Column:
    """Words with a capital first letter."""
    return F.initcap(text)


def thousands(n: Column) -> Column:
    """1234567 as 1,234,567."""
    return F.regexp_replace(n.cast("long").cast("string"), r"(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")


def from_iso(text: Column) -> Column:
    """The timestamp of ISO text with Z or an offset; null if it is none."""
    return F.try_to_timestamp(text)


def to_iso(t: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ssZ of a timestamp."""
    return F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
