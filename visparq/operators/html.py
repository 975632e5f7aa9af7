"""Structured extraction from raw HTML by pattern, one projection of the page row: no parser, no Python, no shuffle.

Tags are matched by prefix (``<p`` also opens on ``<pre>``): that is the defined behaviour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visparq.functions.text import SPACE

#: The patterns that define what is extracted, all without regard to case.
DESCRIPTION = r"""(?i)<meta[^>]*name=["']description["'][^>]*content=["']([^"']*)["']"""
HEADING = r"(?i)(<h[1-6][^>]*>[\s\S]*?)</h[1-6]>"
LINK = r"""(?i)<a[^>]+href=["']([^"']+)["'][^>]*>([\s\S]*?)</a>"""
SECTION = r"(?i)<(main|article|section)([^>]*)>([\s\S]*?)</\1>"
LIST = r"(?i)<(ul|ol)([^>]*)>([\s\S]*?)</\1>"
IMAGE = r"""(?i)<img[^>]+src=["']([^"']+)["'][^>]*alt=["']([^"']*)["'][^>]*>"""
TAG, ANY_TAG = r"(?i)<{0}[^>]*>([\s\S]*?)</{0}>", "<[^>]+>"


def trim(s: Column) -> Column:
    return F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")


def strip(s: Column) -> Column:
    """Tags deleted, then trimmed."""
    return trim(F.regexp_replace(s, ANY_TAG, ""))


def first(html: Column, tag: str) -> Column:
    """The inside of the first ``tag``, or null if there is none. The page is searched once, its match again."""
    pattern = TAG.format(tag)
    return F.regexp_extract(F.regexp_substr(html, F.lit(pattern)), pattern, 1)


def inner(html: Column, tag: str) -> Column:
    return F.regexp_extract_all(html, F.lit(TAG.format(tag)), F.lit(1))


def count(html: Column, pattern: str) -> Column:
    return F.regexp_count(html, F.lit(f"(?i){pattern}")).cast("long")


def long_enough(texts: Column, least: int) -> Column:
    return F.filter(texts, lambda t: F.length(t) >= least)


def title(html: Column) -> Column:
    return F.coalesce(trim(first(html, "title")), F.lit(""))


def description(html: Column) -> Column:
    return F.regexp_extract(F.regexp_substr(html, F.lit(DESCRIPTION)), DESCRIPTION, 1)


def headings(html: Column, least: int) -> Column:
    """Array of (level, text); the closing level need not be the opening one."""
    found = F.regexp_extract_all(html, F.lit(HEADING), F.lit(1))
    own = F.transform(found, lambda m: F.struct(F.substring(m, 3, 1).cast("int").alias("level"), strip(F.regexp_replace(m, "^<[^>]*>", "")).alias("text")))
    return F.filter(own, lambda h: F.length(h["text"]) >= least)


def nav_links(html: Column, nav: Column | None = None) -> Column:
    """Array of (href, text) of the first nav (``nav``, where that is known)."""
    whole = F.regexp_extract_all(F.coalesce(first(html, "nav") if nav is None else nav, F.lit("")), F.lit(LINK), F.lit(0))
    return F.transform(whole, lambda m: F.struct(F.regexp_extract(m, LINK, 1).alias("href"), strip(F.regexp_extract(m, LINK, 2)).alias("text")))


def sections(html: Column, least: int) -> Column:
    """Array of (tag, attrs, preview, body) of main, article and section, each to the first close of its own kind."""
    own = F.transform(F.regexp_extract_all(html, F.lit(SECTION), F.lit(0)), lambda m: F.struct(F.lower(F.regexp_extract(m, SECTION, 1)).alias("tag"), F.regexp_extract(m, SECTION, 2).alias("attrs"), F.regexp_extract(m, SECTION, 3).alias("body")))
    named = F.transform(own, lambda s: F.struct(s["tag"].alias("tag"), s["attrs"].alias("attrs"), strip(s["body"]).alias("text"), s["body"].alias("body")))
    return F.filter(named, lambda s: (F.length(s["text"]) >= least) | (s["tag"] == "main"))


def paragraphs(html: Column, least: int) -> Column:
    return long_enough(F.transform(inner(html, "p"), strip), least)


def main_content(html: Column, least: int, found: Column | None = None) -> Column:
    """Array of (type, preview, paragraphs): main sections first, then all paragraphs. ``found``: the sections, if known."""
    mains = F.transform(F.filter(sections(html, least) if found is None else found, lambda s: s["tag"] == "main"), lambda s: F.struct(F.lit("main").alias("type"), F.substring(s["text"], 1, 500).alias("preview"), count(s["body"], "<p[^>]*>").alias("paragraphs")))
    rest = F.transform(paragraphs(html, least), lambda t: F.struct(F.lit("paragraph").alias("type"), F.substring(t, 1, 200).alias("preview"), F.lit(None).cast("long").alias("paragraphs")))
    return F.concat(mains, rest)


def lists(html: Column, least: int) -> Column:
    """Array of (type, item_count, items): items cut to 100 characters, 20 of them shown; lists without items dropped."""
    own = F.transform(F.regexp_extract_all(html, F.lit(LIST), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, LIST, 1).alias("type"), F.transform(long_enough(F.transform(inner(F.regexp_extract(m, LIST, 3), "li"), strip), least), lambda t: F.substring(t, 1, 100)).alias("items")))
    kept = F.filter(own, lambda s: F.size(s["items"]) > 0)
    return F.transform(kept, lambda s: F.struct(s["type"].alias("type"), F.size(s["items"]).cast("long").alias("item_count"), F.slice(s["items"], 1, 20).alias("items")))


def forms(html: Column) -> Column:
    return F.transform(inner(html, "form"), lambda m: F.struct(count(m, "<input[^>]*>").alias("inputs"), count(m, "<textarea[^>]*>").alias("textareas"), count(m, "<select[^>]*>").alias("selects"), F.substring(strip(m), 1, 200).alias("preview")))


def tables(html: Column) -> Column:
    return F.transform(inner(html, "table"), lambda m: F.struct(count(m, "<tr[^>]*>").alias("rows"), count(m, "<th[^>]*>").alias("headers"), count(m, "<td[^>]*>").alias("cells")))


def footer(html: Column) -> Column:
    return F.substring(strip(first(html, "footer")), 1, 300)


def images(html: Column) -> Column:
    """Array of (src, alt): both are needed, in that order."""
    return F.transform(F.regexp_extract_all(html, F.lit(IMAGE), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, IMAGE, 1).alias("src"), F.regexp_extract(m, IMAGE, 2).alias("alt")))


def raw_stats(html: Column) -> dict[str, Column]:
    """Counts over the whole page; characters in UTF-16 units."""
    astral = F.regexp_count(html, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return {"total_tags": count(html, ANY_TAG), "total_links": count(html, "<a[^>]*>"), "total_images": count(html, "<img[^>]*>"), "char_count": (F.length(html) + astral).cast("long")}


def extract(pages: DataFrame, least: int = 10, raw: bool = False) -> DataFrame:
    """page_id and the whole control map; a ``least`` of 0 means 10."""
    least = least or 10
    h = F.coalesce(F.col("html"), F.lit(""))
    # What several columns are made of is found once.
    pages = pages.select("page_id", "html", sections(h, least).alias("_sections"), first(h, "nav").alias("_nav"))
    nav, found = F.col("_nav"), F.col("_sections")
    own = {
        "title": title(h),
        "description": description(h),
        "headings": headings(h, least),
        "nav_raw": trim(nav),
        "nav_links": nav_links(h, nav),
        "sections": F.transform(found, lambda s: F.struct(s["tag"].alias("tag"), s["attrs"].alias("attrs"), F.substring(s["text"], 1, 200).alias("preview"))),
        "main_content": main_content(h, least, found),
        "lists": lists(h, least),
        "forms": forms(h),
        "tables": tables(h),
        "footer": footer(h),
        "media": images(h),
    }
    stats = F.struct(*(c.alias(n) for n, c in raw_stats(h).items()))
    return pages.select("page_id", *(c.alias(n) for n, c in own.items()), (stats if raw else F.lit(None).cast("struct<total_tags:long,total_links:long,total_images:long,char_count:long>")).alias("raw_stats"))
