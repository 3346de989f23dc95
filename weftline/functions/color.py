"""Colours as columns: hex, RGB, CIE Lab (D65), distances and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of colours by RGB. Of names that are equally near, the first is taken.
COLOR_NAMES = {
    "white": (255, 255, 255),
    "cream": (245, 235, 210),
    "black": (0, 0, 0),
    "charcoal": (50, 50, 55),
    "grey": (140, 140, 140),
    "silver": (200, 200, 200),
    "red": (200, 30, 30),
    "orange": (240, 130, 30),
    "yellow": (240, 210, 40),
    "gold": (215, 165, 30),
    "green": (40, 140, 60),
    "dark green": (25, 80, 50),
    "teal": (30, 140, 140),
    "blue": (40, 90, 200),
    "navy": (25, 40, 90),
    "purple": (110, 50, 140),
    "pink": (240, 170, 200),
    "brown": (120, 80, 50),
    "tan": (200, 170, 130),
    "sage": (120, 160, 140),
    "olive": (110, 120, 50),
    "mint": (170, 230, 200),
    "aqua": (160, 220, 225),
    "sky": (140, 190, 240),
    "lavender": (190, 170, 220),
    "maroon": (110, 30, 40),
    "beige": (225, 210, 180),
}


def rgb(hex_: Column) -> Column:
    """struct<r, g, b> (0 to 255) of #RRGGBB."""
    part = lambda i: F.conv(F.substring(hex_, i, 2), 16, 10).cast("int")
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(x.cast("long")), 2, "0") for x in (r, g, b)]))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def lab(r: Column, g: Column, b: Column) -> Column:
    """struct<l, a, b> of sRGB values from 0 to 255."""
    # The sRGB transfer function, its matrix, and the D65 white.
    linear = lambda c: F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4)))
    f = lambda t: F.when(t > 216.0 / 24389, F.cbrt(t)).otherwise((t * 24389.0 / 27 + 16) / 116)

    def xyz(c):
        x = (c["r"] * 0.4124564 + c["g"] * 0.3575761 + c["b"] * 0.1804375) / 0.95047
        y = c["r"] * 0.2126729 + c["g"] * 0.7151522 + c["b"] * 0.0721750
        z = (c["r"] * 0.0193339 + c["g"] * 0.1191920 + c["b"] * 0.9503041) / 1.08883
        return _let(F.struct(x.alias("x"), y.alias("y"), z.alias("z")), lambda p: F.struct(*[f(p[k]).alias(k) for k in "xyz"]))

    scaled = lambda q: F.struct((q["y"] * 116 - 16).alias("l"), ((q["x"] - q["y"]) * 500).alias("a"), ((q["y"] - q["z"]) * 200).alias("b"))
    given = F.struct(*[linear(c).alias(k) for c, k in ((r, "r"), (g, "g"), (b, "b"))])
    return _let(_let(given, xyz), scaled)


def delta_e(p: Column, q: Column) -> Column:
    """The 1976 distance of two Lab structs."""
    return _let(F.struct(p.alias("p"), q.alias("q")), lambda s: F.sqrt(sum((s["p"][c] - s["q"][c]) * (s["p"][c] - s["q"][c]) for c in ("l", "a", "b"))))


def color_name(hex_: Column) -> Column:
    """The name of COLOR_NAMES that is nearest in Lab."""
    named = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), lab(*[F.lit(x) for x in color]).alias("lab")) for i, (name, color) in enumerate(COLOR_NAMES.items())])
    own = _let(rgb(hex_), lambda c: lab(c["r"], c["g"], c["b"]))
    return _let(own, lambda p: F.array_min(F.transform(named, lambda n: F.struct(delta_e(p, n["lab"]).alias("d"), n["i"].alias("i"), n["name"].alias("name"))))["name"])
