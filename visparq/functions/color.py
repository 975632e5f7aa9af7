"""Colour maths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLEND_RESIDUAL = 3.0


def clamp255(n: Column) -> Column:
    """Nearest integer (halves up) in 0..255; null, NaN and infinities give 0."""
    d = n.cast("double")
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(F.when(finite, d).otherwise(0.0) + 0.5).cast("double")))).otherwise(0.0).cast("int")


def round2(x: Column) -> Column:
    """Two decimals, halves up: the floor form gives one result in every engine."""
    return F.floor(x * 100 + 0.5) / 100


def linear(channel: Column) -> Column:
    c = channel / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast(l1: Column, l2: Column) -> Column:
    """Ratio of two luminances: symmetric, at least 1."""
    return (F.greatest(l1, l2) + 0.05) / (F.least(l1, l2) + 0.05)


def wcag(ratio: Column, large: Column) -> dict[str, Column]:
    """AA and AAA with the thresholds that text size asks for."""
    aa, aaa = F.when(large, 3.0).otherwise(4.5), F.when(large, 4.5).otherwise(7.0)
    return {"required_aa": aa, "required_aaa": aaa, "aa": ratio + 1e-9 >= aa, "aaa": ratio + 1e-9 >= aaa}


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *(F.lpad(F.hex(clamp255(c).cast("long")), 2, "0") for c in (r, g, b))))


def pack(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def unpack(key: Column) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(key, s).bitwiseAND(F.lit(255)) for s in (16, 8, 0))


def quantise(r: Column, g: Column, b: Column, bits: int = 3) -> Column:
    return pack(*(F.shiftright(c, bits) for c in (r, g, b)))


def distance2(a: tuple, b: tuple) -> Column:
    """Squared RGB distance: integers compare exactly."""
    d = [x - y for x, y in zip(a, b, strict=True)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def is_blend(x: tuple, y: tuple, bg: tuple, low: float = 0.25, high: float = 0.98) -> Column:
    """Whether ``x`` lies on the line from ``bg`` to ``y``, strictly inside the window."""
    span = [q - g for q, g in zip(y, bg, strict=True)]
    part = [F.when(s != 0, (p - g) / s) for p, g, s in zip(x, bg, span, strict=True)]
    count = sum((F.when(s != 0, 1).otherwise(0) for s in span[1:]), F.when(span[0] != 0, 1).otherwise(0))
    t = sum((F.coalesce(p, F.lit(0.0)) for p in part[1:]), F.coalesce(part[0], F.lit(0.0))) / F.when(count > 0, count)
    off = [p - (g + t * s) for p, g, s in zip(x, bg, span, strict=True)]
    residual = F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2])
    return F.coalesce((t > low) & (t < high) & (residual < BLEND_RESIDUAL), F.lit(False))


def parse_color(text: Column) -> dict[str, Column]:
    """r, g, b, a of a CSS colour: names, 3/4/6/8-digit hex, rgb()/rgba(); all null for anything else."""
    s = F.lower(F.trim(text))
    short = F.regexp_extract(s, "^#([0-9a-f]{3,4})$", 1)
    doubled = F.regexp_replace(short, "([0-9a-f])", "$1$1")
    digits = F.when(short != "", doubled).otherwise(F.regexp_extract(s, "^#([0-9a-f]{6}|[0-9a-f]{8})$", 1))
    hexed = digits != ""
    inside = F.regexp_extract(s, r"^rgba?\(([^)]+)\)$", 1)
    parts = F.filter(F.split(inside, r"[,/\s]+"), lambda p: p != "")
    number = lambda k: F.regexp_extract(F.get(parts, F.lit(k)), r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+))", 1).try_cast("double")
    called = (inside != "") & (F.size(parts) >= 3) & number(0).isNotNull() & number(1).isNotNull() & number(2).isNotNull()
    named = {"white": 255, "black": 0}
    out: dict[str, Column] = {}
    for k, c in enumerate("rgb"):
        own = F.when(hexed, F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10).cast("int")).when(called, clamp255(number(k)))
        for name, v in named.items():
            own = F.when(s == name, v).otherwise(own)
        out[c] = own
    alpha = F.when(F.length(digits) == 8, F.conv(F.substring(digits, 7, 2), 16, 10).cast("double") / 255.0).when(out["r"].isNotNull(), F.when(called, F.coalesce(number(3), F.lit(1.0))).otherwise(1.0))
    return out | {"a": alpha}


def annotation_rgb(text: Column) -> tuple[Column, Column, Column]:
    """Three or six hex digits, with or without ``#``; anything else is red."""
    h = F.regexp_extract(F.coalesce(text, F.lit("")), "^#?([0-9a-fA-F]{6}|[0-9a-fA-F]{3})$", 1)
    d = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    return tuple(F.when(d == "", 255 if k == 0 else 0).otherwise(F.conv(F.substring(d, 2 * k + 1, 2), 16, 10).cast("int")) for k in range(3))
