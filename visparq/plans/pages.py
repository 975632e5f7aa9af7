"""Queries over HTML and JSON, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from visparq.operators import html, jsonx
from visparq.plans.scalars import table

#: Appended to every page, so that branches which the pages never take are taken.
EXTRA = '<meta name="description" content="about {0}"><FORM a><input x><textarea></textarea><select><input></select> send it now </FORM><table><thead><tr><th>h</th></tr></thead><tr><td>1</td><td>2</td></tr></table><img src="i{0}.png" class="c" alt="picture {0}"><img alt="x" src="y"><ol><li>one item of the list</li><li>two</li><li><b>three items</b> in all</li></ol><main id="m"><p>a main paragraph that is long</p><pre>not closed</main>'


def pages(spark, sf):
    e = F.replace(F.lit(EXTRA), F.lit("{0}"), F.col("page_id").cast("string"))
    return table(spark, sf, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), e).alias("html"))


PAGES = f"SELECT page_id, coalesce(html, '') || replace('{EXTRA}', '{{0}}', page_id::VARCHAR) AS html FROM pages"
TRIM = "regexp_replace(regexp_replace({0}, '^[\\s\\x0b]+', ''), '[\\s\\x0b]+$', '')"
STRIP = TRIM.format("regexp_replace({0}, '<[^>]+>', '', 'g')")


def strip(x):
    return STRIP.replace("{0}", x)


def inner(tag, x="html"):
    return f"regexp_extract_all({x}, '(?i)<{tag}[^>]*>([\\s\\S]*?)</{tag}>', 1)"


def _explode(spark, sf, column, fields):
    h = F.col("html")
    return pages(spark, sf).select("page_id", F.posexplode(column(h)).alias("k", "v")).select("page_id", F.col("k").cast("long").alias("k"), *(F.col(f"v.{f}").alias(f) for f in fields))


def html_title(spark, sf):
    return pages(spark, sf).select("page_id", html.title(F.col("html")).alias("title"), html.description(F.col("html")).alias("description"))


def html_headings(spark, sf):
    return _explode(spark, sf, lambda h: F.transform(html.headings(h, 10), lambda x: F.struct(x["level"].cast("long").alias("level"), x["text"].alias("text"))), ("level", "text"))


def html_nav_links(spark, sf):
    return _explode(spark, sf, html.nav_links, ("href", "text"))


def html_sections(spark, sf):
    return _explode(spark, sf, lambda h: F.transform(html.sections(h, 10), lambda s: F.struct(s["tag"].alias("tag"), F.substring(s["text"], 1, 200).alias("preview"))), ("tag", "preview"))


def html_paragraphs(spark, sf):
    return _explode(spark, sf, lambda h: F.transform(html.paragraphs(h, 10), lambda t: F.struct(F.substring(t, 1, 200).alias("preview"))), ("preview",))


def html_main_content(spark, sf):
    return _explode(spark, sf, lambda h: html.main_content(h, 10), ("type", "preview", "paragraphs"))


def html_lists(spark, sf):
    return _explode(spark, sf, lambda h: F.transform(html.lists(h, 3), lambda s: F.struct(s["type"].alias("type"), s["item_count"].alias("item_count"), F.array_join(s["items"], "|").alias("items"))), ("type", "item_count", "items"))


def html_forms(spark, sf):
    return _explode(spark, sf, html.forms, ("inputs", "textareas", "selects", "preview"))


def html_tables(spark, sf):
    return _explode(spark, sf, html.tables, ("rows", "headers", "cells"))


def html_footer(spark, sf):
    return pages(spark, sf).select("page_id", html.footer(F.col("html")).alias("footer"))


def html_images(spark, sf):
    return _explode(spark, sf, html.images, ("src", "alt"))


def html_raw_stats(spark, sf):
    return pages(spark, sf).select("page_id", *(c.alias(n) for n, c in html.raw_stats(F.col("html")).items()))


def html_extract(spark, sf):
    """The whole control map in one projection, as counts."""
    own = html.extract(pages(spark, sf), 10, True)
    return own.select("page_id", "title", *(F.size(c).cast("long").alias(f"n_{c}") for c in ("headings", "nav_links", "sections", "main_content", "lists", "forms", "tables", "media")), F.col("raw_stats.total_links").alias("total_links"))


_ALL_SECTIONS = "regexp_extract_all(html, '(?i)<main[^>]*>[\\s\\S]*?</main>|<article[^>]*>[\\s\\S]*?</article>|<section[^>]*>[\\s\\S]*?</section>')"
_SEC = f"""s AS (SELECT page_id, m, lower(regexp_extract(m, '^<([a-zA-Z]+)', 1)) AS tag0, {strip("regexp_replace(regexp_replace(m, '^<[^>]*>', ''), '</[^>]*>$', '')")} AS t, k FROM (SELECT page_id, unnest({_ALL_SECTIONS}) AS m, unnest(range(len({_ALL_SECTIONS}))) AS k FROM p)),
sec AS (SELECT page_id, m, t, k, CASE WHEN tag0 LIKE 'main%' THEN 'main' WHEN tag0 LIKE 'article%' THEN 'article' ELSE 'section' END AS tag FROM s WHERE length(t) >= 10 OR tag0 LIKE 'main%')"""
_LISTS = "regexp_extract_all(html, '(?i)<ul[^>]*>[\\s\\S]*?</ul>|<ol[^>]*>[\\s\\S]*?</ol>')"
_LI = f"""l AS (SELECT page_id, k, lower(m[2:3]) AS type, list_filter(list_transform({inner('li', "regexp_replace(m, '^<[^>]*>', '')")}, lambda x: {strip('x')}), lambda x: length(x) >= 3) AS items FROM (SELECT page_id, unnest({_LISTS}) AS m, unnest(range(len({_LISTS}))) AS k FROM p))"""


def _listed(expr, fields, where=""):
    """Positions after filtering, as the operator's own."""
    return f"SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k0) - 1 AS k, {fields} FROM (SELECT page_id, unnest({expr}) AS m, unnest(range(len({expr}))) AS k0 FROM p) {where}"


_H = "regexp_extract_all(html, '(?i)(<h[1-6][^>]*>[\\s\\S]*?)</h[1-6]>', 1)"
_NAV = "regexp_extract(html, '(?i)<nav[^>]*>([\\s\\S]*?)</nav>', 1)"
_A = "(?i)<a[^>]+href=[\"'']([^\"'']+)[\"''][^>]*>([\\s\\S]*?)</a>"
_IMG = "(?i)<img[^>]+src=[\"'']([^\"'']+)[\"''][^>]*alt=[\"'']([^\"'']*)[\"''][^>]*>"


def n_of(pattern, x="html"):
    return f"len(regexp_extract_all({x}, '(?i){pattern}'))::BIGINT"


_LEN10 = lambda x: f"len(list_filter({x}, lambda t: length(t) >= 10))::BIGINT"
_MAP = lambda x, body: f"list_transform({x}, lambda m: {body})"
EXTRACT_SQL = f"""WITH p AS ({PAGES}), {_SEC}, {_LI.replace("length(x) >= 3", "length(x) >= 10")}, ns AS (SELECT page_id, count(*) AS n, count(*) FILTER (tag = 'main') AS m FROM sec GROUP BY page_id), nl AS (SELECT page_id, count(*) FILTER (len(items) > 0) AS n FROM l GROUP BY page_id)
SELECT p.page_id, {TRIM.format("regexp_extract(html, '(?i)<title[^>]*>([\\s\\S]*?)</title>', 1)")} AS title, {_LEN10(_MAP(_H, strip("regexp_replace(m, '^<[^>]*>', '')")))} AS n_headings, len(regexp_extract_all({_NAV}, '{_A}'))::BIGINT AS n_nav_links, coalesce(ns.n, 0) AS n_sections,
 coalesce(ns.m, 0) + {_LEN10(_MAP(inner("p"), strip("m")))} AS n_main_content, coalesce(nl.n, 0) AS n_lists, len({inner("form")})::BIGINT AS n_forms, len({inner("table")})::BIGINT AS n_tables, len(regexp_extract_all(html, '{_IMG}'))::BIGINT AS n_media, {n_of('<a[^>]*>')} AS total_links FROM p LEFT JOIN ns USING (page_id) LEFT JOIN nl USING (page_id)"""


# -- JSON -------------------------------------------------------------------------------------------------------------
def replies(spark, sf):
    k, j = F.col("event_id"), F.col("props")
    said = F.when(k % 5 == 0, j).when(k % 5 == 1, F.concat(F.lit("<think>maybe {x}</think> "), j)).when(k % 5 == 2, F.concat(F.lit("Sure: "), j, F.lit(" done"))).when(k % 5 == 3, F.concat(F.lit("List: ["), j, F.lit("] {")))
    return table(spark, sf, "events").select("event_id", F.coalesce(said, F.lit("nothing here")).alias("reply"))


REPLIES = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '<think>maybe {x}</think> ' || props WHEN 2 THEN 'Sure: ' || props || ' done' WHEN 3 THEN 'List: [' || props || '] {' ELSE 'nothing here' END AS reply FROM events"
_TRY = {"direct": "trim(reply)", "think": "trim(regexp_replace(reply, '(?is)<think>.*?</think>', '', 'g'))", "braces": "regexp_extract(reply, '(?s)(\\{.*\\})', 1)", "brackets": "regexp_extract(reply, '(?s)(\\[.*\\])', 1)"}


def json_salvage(spark, sf):
    own = replies(spark, sf)
    s = jsonx.salvage(F.col("reply"))
    return own.select("event_id", s["strategy"].alias("strategy"), s["document"].alias("document"))


def claim_parse(spark, sf):
    k = F.col("event_id")
    doc = F.when(k % 4 == 0, F.concat(F.lit('{"claims": [{"claim": "c'), k, F.lit('", "confidence": 0.5, "box": {"left": 1}}], "counts": {"a": '), k % 7, F.lit('}, "unreadable": ["x", "y"]}'))).when(k % 4 == 1, '{"summary": "s", "text_items": [{"text": "t"}]}').when(k % 4 == 2, "{}")
    c = jsonx.claims(doc)
    own = table(spark, sf, "events").select("event_id", c.alias("c"))
    return own.select("event_id", F.col("c.parsed").alias("parsed"), F.col("c.summary").alias("summary"), *(F.size(f"c.{n}").cast("long").alias(f"n_{n}") for n in ("claims", "text_items", "unreadable")), F.get("c.claims", F.lit(0))["claim"].alias("first_claim"), F.element_at("c.counts", F.lit("a")).alias("count_a"))


def detection_boxes(spark, sf):
    k = F.col("event_id")
    reply = F.concat(F.lit('Found: [{"type": "button", "x": '), k % 90, F.lit(', "y": 3, "width": '), k % 30, F.lit('}, {"type": "icon", "x": 1}, {"x": 1, "y": 2}, {"type": "link", "x": 4, "y": 5, "height": 30, "label": "L"}] ok'))
    own = table(spark, sf, "events").select("event_id", F.posexplode(jsonx.detections(reply)).alias("k", "d"))
    return own.select("event_id", F.col("k").cast("long").alias("k"), "d.*")


DETECT_SQL = """SELECT event_id, k::BIGINT AS k, type, x, y, width, height, label FROM (SELECT event_id, 0 AS k, 'button' AS type, (event_id % 90)::DOUBLE AS x, 3.0::DOUBLE AS y, greatest(10, CASE WHEN event_id % 30 = 0 THEN 50 ELSE event_id % 30 END)::DOUBLE AS width, 20.0::DOUBLE AS height, NULL AS label FROM events
UNION ALL SELECT event_id, 1, 'link', 4.0, 5.0, 50.0, 30.0, 'L' FROM events)"""


def json_truncate(spark, sf):
    """Size-bounded JSON of documents: every result parses and keeps to its cap."""
    own = table(spark, sf, "documents").select("doc_id", F.to_json(F.struct(F.lit(True).alias("success"), "text", F.split("text", "\n").alias("lines"))).alias("j"))
    cut = own.select("doc_id", jsonx.truncate_json(3000)("j").alias("cut"))
    return cut.select("doc_id", F.length("cut").cast("long").alias("n"), (F.length("cut") <= 3000).alias("within"), F.try_parse_json("cut").isNotNull().alias("valid"))


QUERIES = {
    "html_title": (html_title, f"""WITH p AS ({PAGES}) SELECT page_id, {TRIM.format("regexp_extract(html, '(?i)<title[^>]*>([\\s\\S]*?)</title>', 1)")} AS title, regexp_extract(html, '(?i)<meta[^>]*name=["'']description["''][^>]*content=["'']([^"'']*)["'']', 1) AS description FROM p"""),
    "html_headings": (html_headings, f"WITH p AS ({PAGES}) " + _listed(_H, f"substr(m, 3, 1)::BIGINT AS level, {strip("regexp_replace(m, '^<[^>]*>', '')")} AS text", f"WHERE length({strip("regexp_replace(m, '^<[^>]*>', '')")}) >= 10")),
    "html_nav_links": (html_nav_links, f"WITH n AS ({PAGES}), p AS (SELECT page_id, {_NAV} AS html FROM n) " + _listed(f"regexp_extract_all(html, '{_A}')", f"regexp_extract(m, '{_A}', 1) AS href, {strip(f"regexp_extract(m, '{_A}', 2)")} AS text")),
    "html_sections": (html_sections, f"WITH p AS ({PAGES}), {_SEC} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS k, tag, left(t, 200) AS preview FROM sec"),
    "html_paragraphs": (html_paragraphs, f"WITH p AS ({PAGES}) " + _listed(inner("p"), f"left({strip('m')}, 200) AS preview", f"WHERE length({strip('m')}) >= 10")),
    "html_main_content": (html_main_content, f"WITH p AS ({PAGES}), {_SEC}, mains AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS k, 'main' AS type, left(t, 500) AS preview, {n_of('<p[^>]*>', 'm')} AS paragraphs FROM sec WHERE tag = 'main'), n AS (SELECT page_id, count(*) AS n FROM mains GROUP BY page_id), paras AS (" + _listed(inner("p"), f"left({strip('m')}, 200) AS preview", f"WHERE length({strip('m')}) >= 10") + ") SELECT * FROM mains UNION ALL SELECT page_id, k + coalesce(n, 0), 'paragraph', preview, NULL FROM paras LEFT JOIN n USING (page_id)"),
    "html_lists": (html_lists, f"WITH p AS ({PAGES}), {_LI} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS k, type, len(items)::BIGINT AS item_count, array_to_string(list_transform(items[1:20], lambda x: left(x, 100)), '|') AS items FROM l WHERE len(items) > 0"),
    "html_forms": (html_forms, f"WITH p AS ({PAGES}) " + _listed(inner("form"), f"{n_of('<input[^>]*>', 'm')} AS inputs, {n_of('<textarea[^>]*>', 'm')} AS textareas, {n_of('<select[^>]*>', 'm')} AS selects, left({strip('m')}, 200) AS preview")),
    "html_tables": (html_tables, f"WITH p AS ({PAGES}) " + _listed(inner("table"), f"{n_of('<tr[^>]*>', 'm')} AS rows, {n_of('<th[^>]*>', 'm')} AS headers, {n_of('<td[^>]*>', 'm')} AS cells")),
    "html_footer": (html_footer, f"WITH p AS ({PAGES}) SELECT page_id, left({strip("nullif(regexp_extract(html, '(?i)<footer[^>]*>([\\s\\S]*?)</footer>', 1), '')")}, 300) AS footer FROM p"),
    "html_images": (html_images, f"WITH p AS ({PAGES}) " + _listed(f"regexp_extract_all(html, '{_IMG}')", f"regexp_extract(m, '{_IMG}', 1) AS src, regexp_extract(m, '{_IMG}', 2) AS alt")),
    "html_raw_stats": (html_raw_stats, f"WITH p AS ({PAGES}) SELECT page_id, {n_of('<[^>]+>')} AS total_tags, {n_of('<a[^>]*>')} AS total_links, {n_of('<img[^>]*>')} AS total_images, (length(html) + len(regexp_extract_all(html, '[\\x{{10000}}-\\x{{10FFFF}}]')))::BIGINT AS char_count FROM p"),
    "html_extract": (html_extract, EXTRACT_SQL),
    "json_salvage": (json_salvage, f"WITH r AS ({REPLIES}) SELECT event_id, CASE {' '.join(f"WHEN {e} <> '' AND json_valid({e}) THEN '{n}'" for n, e in _TRY.items())} END AS strategy, CASE {' '.join(f"WHEN {e} <> '' AND json_valid({e}) THEN {e}" for e in _TRY.values())} END AS document FROM r"),
    "claim_parse": (claim_parse, "SELECT event_id, event_id % 4 < 3 AS parsed, CASE WHEN event_id % 4 = 1 THEN 's' END AS summary, (event_id % 4 = 0)::BIGINT AS n_claims, (event_id % 4 = 1)::BIGINT AS n_text_items, (CASE WHEN event_id % 4 = 0 THEN 2 ELSE 0 END)::BIGINT AS n_unreadable, CASE WHEN event_id % 4 = 0 THEN 'c' || event_id END AS first_claim, CASE WHEN event_id % 4 = 0 THEN (event_id % 7)::DOUBLE END AS count_a FROM events"),
    "detection_boxes": (detection_boxes, DETECT_SQL),
    "json_truncate": (json_truncate, None),
}
