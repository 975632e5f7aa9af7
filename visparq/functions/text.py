"""Text normalisation, matching, escaping, truncation and classification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\n…[truncated]"
#: What a JavaScript trim removes.
SPACE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
#: What marks a question that pixels can answer. Word edges are ASCII (the JVM's own boundary is not).
QUANTITATIVE = [
    ("contrast", r"contrast"),
    ("wcag", r"wcag|accessibilit?y ratio"),
    ("how_many", r"how many"),
    ("count", r"(?<![0-9A-Za-z_])count(?![0-9A-Za-z_])"),
    ("ratio", r"ratio"),
    ("to_one", r"(?<![0-9A-Za-z_])[0-9]+(\.[0-9]+)?[ \t\r\n]*:[ \t\r\n]*1(?![0-9A-Za-z_])"),
    ("pixel", r"pixel"),
    ("size", r"(?<![0-9A-Za-z_])size(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])dimension"),
    ("align", r"(?<![0-9A-Za-z_])align(ed|ment)?(?![0-9A-Za-z_])"),
    ("extent", r"(?<![0-9A-Za-z_])width(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])height(?![0-9A-Za-z_])"),
    ("spacing", r"spacing|gap|margin|padding"),
    ("hex", r"(?<![0-9A-Za-z_])hex(?![0-9A-Za-z_])|#[0-9a-f]{6}"),
    ("colour", r"colour|color (code|value)"),
]


def quantitative(prompt: Column) -> Column:
    """The labels of the patterns that a prompt meets; an empty array for none."""
    met = F.array(*(F.when(F.lower(prompt).rlike(p), F.lit(n)) for n, p in QUANTITATIVE))
    return F.when(F.coalesce(F.trim(prompt), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_compact(met))


def normalize(text: Column) -> Column:
    """Lower case, a-z and 0-9 alone."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def match(a: Column, b: Column) -> Column:
    """'exact' or 'partial' of two normalised texts, or null: containment counts when both have four characters."""
    both = (F.length(a) >= 4) & (F.length(b) >= 4)
    return F.when((a == "") | (b == ""), None).when(a == b, "exact").when(both & (F.contains(a, b) | F.contains(b, a)), "partial")


def grams(s: Column, n: int) -> Column:
    """The distinct strings of ``n`` characters in a text; none in a shorter one."""
    return F.when(F.length(s) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def escape_xml(s: Column) -> Column:
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(c), F.lit(e))
    return s


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` characters, then a mark."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(MARK))).otherwise(text)


def fragment(text: Column) -> Column:
    """A trimmed DOM or CSS fragment; under three characters: empty."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    return F.when(F.length(t) < 3, "").otherwise(t)


def image_sources(value: Column) -> Column:
    """A JSON array of strings as an array; null for anything else."""
    t = F.trim(value)
    return F.when(t.startswith("[") & t.endswith("]"), F.from_json(t, "array<string>"))
