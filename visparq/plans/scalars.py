"""Queries over scalar functions, each with the same query in SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from visparq.functions import color, geometry, guards, text
from visparq.operators import annotate


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _colours(spark, sf):
    k = F.col("p_partkey")
    mod = lambda m, a=0: ((k * m + a) % 256).cast("int")
    return table(spark, sf, "part").select(k.alias("id"), mod(7).alias("r"), mod(13).alias("g"), mod(29).alias("b"), mod(3, 40).alias("r2"), mod(5, 90).alias("g2"), mod(11, 200).alias("b2"), (k % 2 == 0).alias("large"), F.col("p_size"), F.col("p_type"), F.col("p_name"), F.col("p_retailprice"))


COLOURS = "SELECT p_partkey AS id, (p_partkey * 7 % 256)::INT AS r, (p_partkey * 13 % 256)::INT AS g, (p_partkey * 29 % 256)::INT AS b, ((p_partkey * 3 + 40) % 256)::INT AS r2, ((p_partkey * 5 + 90) % 256)::INT AS g2, ((p_partkey * 11 + 200) % 256)::INT AS b2, p_partkey % 2 = 0 AS large, p_size, p_type, p_name, p_retailprice FROM part"
LIN = "CASE WHEN {0} / 255.0::DOUBLE <= 0.04045 THEN {0} / 255.0::DOUBLE / 12.92 ELSE pow(({0} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"


def lum(r="r", g="g", b="b"):
    return f"(0.2126 * ({LIN.format(r)}) + 0.7152 * ({LIN.format(g)}) + 0.0722 * ({LIN.format(b)}))"


RGB, RGB2 = ("r", "g", "b"), ("r2", "g2", "b2")
cols = lambda names: tuple(F.col(c) for c in names)


def r6(c):
    return F.floor(c * 1e6 + 0.5) / 1e6


def colour_scalars(spark, sf):
    return _colours(spark, sf).select("id", color.to_hex(*cols(RGB)).alias("hex"), color.pack(*cols(RGB)).cast("long").alias("key"), color.quantise(*cols(RGB)).cast("long").alias("quant"), r6(color.luminance(*cols(RGB))).alias("luminance"), color.distance2(cols(RGB), cols(RGB2)).cast("long").alias("d2"), color.clamp255(F.col("p_retailprice") - 900.5).cast("long").alias("clamped"))


def contrast_ratio(spark, sf):
    ratio = color.contrast(color.luminance(*cols(RGB)), color.luminance(*cols(RGB2)))
    return _colours(spark, sf).select("id", color.round2(ratio).alias("ratio"))


def wcag_compliance(spark, sf):
    own = _colours(spark, sf).withColumn("ratio", color.round2(color.contrast(color.luminance(*cols(RGB)), color.luminance(*cols(RGB2)))))
    return own.select("id", "ratio", *(c.alias(n) for n, c in color.wcag(F.col("ratio"), F.col("large")).items()))


def parse_color(spark, sf):
    k = F.col("id") % 8
    hexed = color.to_hex(*cols(RGB))
    rgb = F.concat_ws(", ", *(F.col(c).cast("string") for c in RGB))
    said = F.when(k == 0, hexed).when(k == 1, F.upper(hexed)).when(k == 2, F.concat(F.lit(" rgb("), rgb, F.lit(") "))).when(k == 3, F.concat(F.lit("rgba("), F.replace(rgb, F.lit(","), F.lit("")), F.lit(" / 0.5)"))).when(k == 4, F.concat(F.substring(hexed, 1, 4))).when(k == 5, F.concat(hexed, F.lit("80"))).when(k == 6, "White").otherwise("no colour")
    own = _colours(spark, sf).withColumn("said", said)
    p = color.parse_color(F.col("said"))
    return own.select("id", "said", *(p[c].cast("long").alias(f"c{c}") for c in "rgb"), r6(p["a"]).alias("alpha"))


def aa_blend(spark, sf):
    bg = tuple(F.lit(v) for v in (26, 24, 20))
    # Colours near the line from the background to the second colour, at a share that the id sets.
    t = (F.col("id") % 10) / 10.0
    x = tuple(F.floor(g + t * (F.col(c) - g) + (F.col("id") % 3) + 0.5) for c, g in zip(RGB2, (26, 24, 20), strict=True))
    own = _colours(spark, sf).select("id", *cols(RGB2), *(c.alias(f"x{n}") for c, n in zip(x, "rgb", strict=True)))
    return own.select("id", color.is_blend(cols(("xr", "xg", "xb")), cols(RGB2), bg).alias("blend"))


_T = "CASE WHEN {c} - {g} <> 0 THEN (x{n} - {g})::DOUBLE / ({c} - {g}) ELSE 0 END"
_CH = [("r2", 26, "r"), ("g2", 24, "g"), ("b2", 20, "b")]
AA_SQL = f"""WITH c AS ({COLOURS}), x AS (SELECT id, r2, g2, b2, {', '.join(f"floor({g} + (id % 10) / 10.0::DOUBLE * ({c} - {g}) + (id % 3) + 0.5)::BIGINT AS x{n}" for c, g, n in _CH)} FROM c),
t AS (SELECT *, ({' + '.join(_T.format(c=c, g=g, n=n) for c, g, n in _CH)}) / nullif({' + '.join(f'(CASE WHEN {c} <> {g} THEN 1 ELSE 0 END)' for c, g, _ in _CH)}, 0) AS t FROM x)
SELECT id, coalesce(t > 0.25 AND t < 0.98 AND sqrt({' + '.join(f'pow(x{n} - ({g} + t * ({c} - {g})), 2)' for c, g, n in _CH)}) < 3, false) AS blend FROM t"""


def _frames(spark, sf):
    q, p = F.col("l_quantity").cast("int"), (F.col("l_partkey") % 97).cast("int")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), q.alias("q"), p.alias("p"), (q * 12 + 1).alias("w"), (p * 9 + 1).alias("h"))


FRAMES = "SELECT l_orderkey AS o, l_linenumber AS n, l_quantity::INT AS q, (l_partkey % 97)::INT AS p, l_quantity::INT * 12 + 1 AS w, (l_partkey % 97)::INT * 9 + 1 AS h FROM lineitem"


def clamp_region(spark, sf):
    own = geometry.clamp_region(F.col("q") * 7.5 - 60, F.col("p") * 3.5 - 40, F.col("q") * 4.25, F.when(F.col("p") % 5 > 0, F.col("p") * 2.75), F.col("w"), F.col("h"))
    return _frames(spark, sf).select("o", "n", *(c.cast("long").alias(k) for k, c in own.items()))


def box_in_crop(spark, sf):
    crop, box = (F.lit(100), F.lit(80), F.lit(220), F.lit(200)), (F.col("q") * 6, F.col("p") * 3, F.col("q") * 2 + 1, F.col("p"))
    return _frames(spark, sf).select("o", "n", r6(geometry.overlap_share(crop, box)).alias("share"), geometry.inside_crop(crop, box).alias("inside"))


def legibility(spark, sf):
    return _frames(spark, sf).select("o", "n", *(c.cast("long").alias(k) if k != "legible" else c.alias(k) for k, c in geometry.legibility(F.col("w"), F.col("h")).items()))


def tile_grid(spark, sf):
    own = _frames(spark, sf).select("o", "n", F.explode(geometry.tiles(F.col("w"), F.col("h"))).alias("t"))
    return own.select("o", "n", *(F.col(f"t.{c}").cast("long").alias(c) for c in ("row", "col", "left", "top", "width", "height")))


TILE_SQL = f"""WITH f AS (SELECT o, n, w, h, ceil(w / 2.0)::BIGINT AS tw, ceil(h / 2.0)::BIGINT AS th FROM ({FRAMES})), p AS (SELECT *, floor(tw * 0.1::DOUBLE + 0.5)::BIGINT AS px, floor(th * 0.1::DOUBLE + 0.5)::BIGINT AS py FROM f),
t AS (SELECT o, n, "row", col, greatest(0, col * tw - px) AS "left", greatest(0, "row" * th - py) AS top, * EXCLUDE (o, n) FROM p, (VALUES (0), (1)) r("row"), (VALUES (0), (1)) c(col))
SELECT o, n, "row"::BIGINT AS "row", col::BIGINT AS col, "left"::BIGINT AS "left", top::BIGINT AS top, least(w - "left", tw + px * 2)::BIGINT AS width, least(h - top, th + py * 2)::BIGINT AS height FROM t WHERE least(w - "left", tw + px * 2) > 0 AND least(h - top, th + py * 2) > 0"""


def offset_box(spark, sf):
    own = geometry.offset_box(cols(("q", "p", "w", "h")), F.lit(13), F.lit(-7))
    return _frames(spark, sf).select("o", "n", *(c.cast("long").alias(k) for c, k in zip(own, ("left", "top", "width", "height"), strict=True)))


def diff_target_size(spark, sf):
    own = geometry.diff_size(F.col("w"), F.col("h"), F.col("w") + F.col("p"), F.col("h") + F.col("q") % 3)
    return _frames(spark, sf).select("o", "n", *(c.cast("long").alias(k) for k, c in own.items()))


def crop_validation(spark, sf):
    return _frames(spark, sf).select("o", "n", geometry.crop_error(F.col("q") - 3, F.col("p") - 2, F.col("q") * 11 - 20, F.col("p") * 9, F.col("w"), F.col("h")).alias("error"))


def vision_resize(spark, sf):
    own = geometry.fit_inside(F.col("w"), F.col("h"), 300)
    return _frames(spark, sf).select("o", "n", own["width"].cast("long").alias("width"), own["height"].cast("long").alias("height"), r6(own["scale"]).alias("scale"), own["downscaled"].alias("downscaled"))


PROMPTS = {"0": "What is the contrast of ", "1": "How many ", "2": "Describe the operation of ", "3": "Is it 4.5:1 for ", "4": "count the ", "5": "account of ", "6": "the width of ", "7": "tell me about "}


def quantitative_question(spark, sf):
    k = (F.col("id") % 8).cast("string")
    lead = F.lit("")
    for n, p in PROMPTS.items():
        lead = F.when(k == n, p).otherwise(lead)
    own = _colours(spark, sf).withColumn("prompt", F.concat(lead, F.col("p_type"), F.lit(" "), F.col("p_name"))).withColumn("met", text.quantitative(F.col("prompt")))
    return own.select("id", (F.size("met") > 0).alias("quantitative"), F.array_join("met", ",").alias("matched"))


EDGE = chr(92) + "b"  # RE2 has no look-around; its own edge is ASCII
QUANT_SQL = f"""WITH c AS ({COLOURS}), p AS (SELECT id, lower(CASE id % 8 {' '.join(f"WHEN {n} THEN '{p}'" for n, p in PROMPTS.items())} END || p_type || ' ' || p_name) AS s FROM c)
SELECT id, matched <> '' AS quantitative, matched FROM (SELECT id, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(s, '{p.replace("(?<![0-9A-Za-z_])", EDGE).replace("(?![0-9A-Za-z_])", EDGE)}') THEN '{n}' END" for n, p in text.QUANTITATIVE)}], lambda x: x IS NOT NULL), ',') AS matched FROM p)"""


def blocked_ip(spark, sf):
    k = F.col("c_custkey")
    octet = lambda m, a=0: ((k * m + a) % 260).cast("string")
    firsts = F.when(k % 4 == 0, F.get(F.array(*(F.lit(s) for s in ("10", "127", "172", "192", "169", "100", "0", "8"))), (F.floor(k / 4) % 8).cast("int"))).otherwise(octet(17))
    second = F.when(k % 8 == 0, F.get(F.array(*(F.lit(s) for s in ("16", "168", "254", "64", "31", "32"))), (F.floor(k / 8) % 6).cast("int"))).otherwise(octet(5, 3))
    ip = F.concat_ws(".", firsts, second, octet(3), octet(7))
    own = table(spark, sf, "customer").select(k.alias("id"), F.when(k % 11 == 0, "::1").when(k % 11 == 1, F.concat(F.lit("::ffff:"), ip)).when(k % 11 == 2, "2001:db8::7").when(k % 11 == 3, "fe80::1").when(k % 11 == 4, "not an address").otherwise(ip).alias("ip"))
    return own.select("id", "ip", guards.blocked_ip(F.col("ip")).alias("blocked"))


BLOCKED_SQL = """WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN ['10', '127', '172', '192', '169', '100', '0', '8'][((c_custkey // 4) % 8 + 1)::INT] ELSE (c_custkey * 17 % 260)::VARCHAR END || '.' || CASE WHEN c_custkey % 8 = 0 THEN ['16', '168', '254', '64', '31', '32'][((c_custkey // 8) % 6 + 1)::INT] ELSE ((c_custkey * 5 + 3) % 260)::VARCHAR END || '.' || (c_custkey * 3 % 260) || '.' || (c_custkey * 7 % 260) AS v4 FROM customer),
i AS (SELECT id, CASE id % 11 WHEN 0 THEN '::1' WHEN 1 THEN '::ffff:' || v4 WHEN 2 THEN '2001:db8::7' WHEN 3 THEN 'fe80::1' WHEN 4 THEN 'not an address' ELSE v4 END AS ip, string_split(v4, '.')::INT[] AS o FROM c)
SELECT id, ip, CASE WHEN id % 11 IN (0, 3, 4) THEN true WHEN id % 11 = 2 THEN false ELSE list_max(o) > 255 OR o[1] IN (0, 10, 127) OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168) OR (o[1] = 169 AND o[2] = 254) OR (o[1] = 100 AND o[2] BETWEEN 64 AND 127) END AS blocked FROM i"""


def path_containment(spark, sf):
    k = F.col("s_suppkey")
    path = F.when(k % 5 == 0, F.concat(F.lit("a/../b/"), k)).when(k % 5 == 1, F.concat(F.lit("../data"), k)).when(k % 5 == 2, F.concat(F.lit("/srv/data/x"), k)).when(k % 5 == 3, F.concat(F.lit("/srv/database/"), k)).otherwise(F.concat(F.lit("./a//../../data/"), k))
    own = table(spark, sf, "supplier").select(k.alias("id"), path.alias("path"))
    return own.select("id", "path", guards.within(F.lit("/srv/data"), F.col("path")).alias("inside"))


def magic_mime(spark, sf):
    k = F.col("s_suppkey")
    heads = ["89504E470D0A", "FFD8FFE0", "474946383961", "52494646AAAA", "424D0000", "00000000"]
    content = F.unhex(F.concat(F.get(F.array(*(F.lit(h) for h in heads)), (k % 6).cast("int")), F.lpad(F.hex(k), 8, "0")))
    declared = F.when(k % 7 == 0, "IMAGE/PNG").when(k % 7 == 1, "text/html")
    own = table(spark, sf, "supplier").select(k.alias("id"), content.alias("content"), declared.alias("declared"))
    return own.select("id", guards.sniff(F.col("content"), F.col("declared")).alias("mime"), guards.supported(F.col("content")).alias("supported"))


def source_scheme(spark, sf):
    k = F.col("s_suppkey")
    made = F.when(k % 9 == 0, "data:image/png;base64,AAAA").when(k % 9 == 1, "file:///tmp/a.png").when(k % 9 == 2, "~/a.png").when(k % 9 == 3, "HTTPS://example.org/a").when(k % 9 == 4, "upload://a").when(k % 9 == 5, "download://b").when(k % 9 == 6, "./pics/a.png").when(k % 9 == 7, F.repeat(F.lit("QUJD"), 20)).otherwise("QUJD")
    own = table(spark, sf, "supplier").select(k.alias("id"), made.alias("source"))
    return own.select("id", guards.scheme(F.col("source")).alias("scheme"))


def clean_base64(spark, sf):
    k = F.col("s_suppkey")
    made = F.when(k % 4 == 0, " QUJD%2BREVG ").when(k % 4 == 1, "QUJD REVG\n").when(k % 4 == 2, "QU+JD%3D").otherwise("QUJD%zz")
    return table(spark, sf, "supplier").select(k.alias("id"), guards.clean_base64(made).alias("cleaned"))


def public_url(spark, sf):
    own = table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, "ftp://a.org/x").when(F.col("page_id") % 5 == 1, "http://localhost:80/").when(F.col("page_id") % 5 == 2, "http://10.1.2.3/a").otherwise(F.col("url")).alias("u"))
    return own.select("page_id", guards.public_url(F.col("u")).alias("refused"))


def escape_xml(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.escape_xml(F.col("html")).alias("escaped"))


def text_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncate(F.col("text"), 300).alias("shown"))


def dom_fragment(spark, sf):
    own = table(spark, sf, "documents").select("doc_id", text.fragment(F.concat(F.lit(" \n"), F.col("text"), F.lit("\t"))).alias("fragment"))
    return own


def image_sources(spark, sf):
    k = F.col("s_suppkey")
    made = F.when(k % 3 == 0, F.concat(F.lit('["a'), k, F.lit('.png", "b.png"]'))).when(k % 3 == 1, F.concat(F.lit("a"), k, F.lit(".png"))).otherwise('"[\\"a\\"]"')
    return table(spark, sf, "supplier").select(k.alias("id"), F.array_join(text.image_sources(made), "|").alias("sources"))


def annotation_svg(spark, sf):
    k = F.col("id")
    own = _colours(spark, sf).select(F.floor(k / 8).alias("image_id"), (k % 8).alias("ord"), F.lit(800).alias("image_width"), F.lit(600).alias("image_height"), F.get(F.array(*(F.lit(s) for s in ("label", "BOX", "circle", "arrow"))), (k % 4).cast("int")).alias("type"), F.col("p_type").alias("text"), F.col("r").alias("x"), F.col("g").alias("y"), F.col("b").alias("width"), F.col("r2").alias("height"), F.when(k % 3 == 0, 0).otherwise(F.col("r") + 30).alias("target_x"), (F.col("g") + 40).alias("target_y"), F.when(k % 5 == 0, F.lit(None)).otherwise(color.to_hex(*cols(RGB2))).alias("color"), (k % 90).alias("font_size"))
    return annotate.overlay(own)


def provenance_footer(spark, sf):
    k = F.col("id")
    return _colours(spark, sf).select("id", annotate.footer(F.col("p_type"), F.when(k % 3 > 0, k), F.when(k % 4 > 0, k * 2), F.col("r"), F.when(k % 5 > 0, F.col("g")), k % 2 == 0).alias("footer"))


def prompts(spark, sf):
    return _colours(spark, sf).select("id", annotate.prompt("describe", F.col("p_name"), F.when(F.col("id") % 2 == 0, F.col("p_type"))).alias("prompt"))


def timeout_diagnosis(spark, sf):
    k = F.col("id")
    loaded = F.when(k % 3 == 0, F.array(F.struct(F.lit("m1").alias("name"), (k * 1e8).alias("size_vram")))).when(k % 3 == 1, F.array(F.struct(F.lit("m2").alias("name"), (k * 1e8).alias("size_vram")))).otherwise(F.expr("CAST(array() AS array<struct<name:string,size_vram:double>>)"))
    return _colours(spark, sf).select("id", annotate.timeout_diagnosis(F.lit("m1"), loaded, F.when(k % 2 == 0, k * 100), 20_000).alias("diagnosis"))



def _n(x: str) -> str:
    return f"(CASE WHEN abs({x} - floor({x})) < 1e-9 THEN floor({x})::BIGINT::VARCHAR ELSE regexp_replace(printf('%.6f', {x}), '0+$', '') END)"


def _svg(template: str) -> str:
    """SQL of a template: ``{name}`` a number, ``{:name}`` a string column."""
    parts = re.split(r"\{(:?\w+)\}", template)
    return " || ".join("'" + p + "'" if k % 2 == 0 else p[1:] if p[0] == ":" else _n(p) for k, p in enumerate(parts))


SVG_SQL = f"""WITH c AS ({COLOURS}), a AS (SELECT id // 8 AS image_id, id % 8 AS ord, id % 4 AS kind, r::DOUBLE AS x, g::DOUBLE AS y, greatest(10, least(72, CASE WHEN id % 90 = 0 THEN 16 ELSE id % 90 END))::DOUBLE AS size, greatest(1, CASE WHEN b = 0 THEN 50 ELSE b END)::DOUBLE AS w, greatest(1, CASE WHEN r2 = 0 THEN 50 ELSE r2 END)::DOUBLE AS h, greatest(1, CASE WHEN b = 0 THEN 25 ELSE b END)::DOUBLE AS rad,
 CASE WHEN id % 5 = 0 THEN '#FF0000' ELSE '#' || printf('%02x%02x%02x', r2, g2, b2) END AS paint, CASE WHEN id % 5 = 0 THEN '255,0,0' ELSE r2 || ',' || g2 || ',' || b2 END AS rgb, p_type AS said, CASE WHEN id % 3 = 0 THEN r + 50 ELSE r + 30 END::DOUBLE AS ex, (g + 40)::DOUBLE AS ey FROM c),
l AS (SELECT *, sqrt((ex - x) * (ex - x) + (ey - y) * (ey - y)) AS len FROM a), u AS (SELECT *, (ex - x) / greatest(len, 1) AS ux, (ey - y) / greatest(len, 1) AS uy FROM l), b AS (SELECT *, ex - ux * 12 AS bx, ey - uy * 12 AS by_ FROM u),
p AS (SELECT *, y - size + 2 AS ty, greatest(1, floor(length(said) * size * 0.6::DOUBLE + 10 + 0.5)) AS tw, size + 4 AS th, x + 5 AS lx, bx - uy * 7.2::DOUBLE AS p1x, by_ + ux * 7.2::DOUBLE AS p1y, bx + uy * 7.2::DOUBLE AS p2x, by_ - ux * 7.2::DOUBLE AS p2y FROM b),
s AS (SELECT image_id, ord, CASE kind WHEN 0 THEN {_svg('<rect x="{x}" y="{ty}" width="{tw}" height="{th}" fill="rgba({:rgb},0.85)" rx="3"/><text x="{lx}" y="{y}" font-family="DejaVu Sans, sans-serif" font-size="{size}" fill="white">{:said}</text>')}
 WHEN 1 THEN {_svg('<rect x="{x}" y="{y}" width="{w}" height="{h}" fill="none" stroke="{:paint}" stroke-width="3" rx="2"/>')} WHEN 2 THEN {_svg('<circle cx="{x}" cy="{y}" r="{rad}" fill="none" stroke="{:paint}" stroke-width="3"/>')}
 ELSE {_svg('<line x1="{x}" y1="{y}" x2="{bx}" y2="{by_}" stroke="{:paint}" stroke-width="3" stroke-linecap="round"/><polygon points="{ex},{ey} {p1x},{p1y} {p2x},{p2y}" fill="{:paint}" stroke="none"/>')} END AS shape FROM p WHERE kind < 3 OR len >= 1)
SELECT image_id, '<svg width="800" height="600" xmlns="http://www.w3.org/2000/svg">' || string_agg(shape, '' ORDER BY ord) || '</svg>' AS svg FROM s GROUP BY image_id"""

_BOX_SHARE = 'greatest(0, least(320, q * 6 + q * 2 + 1) - greatest(100, q * 6)) * greatest(0, least(280, p * 3 + p) - greatest(80, p * 3))'
def download_check(spark, sf):
    k = F.col("s_suppkey")
    content = F.when(k % 7 == 0, F.unhex(F.lit(""))).when(k % 3 == 0, F.unhex(F.lit("FFD8FFE0"))).otherwise(F.unhex(F.lit("3C68746D")))
    kind = F.when(k % 5 == 0, "text/html; charset=utf-8").when(k % 5 == 1, "image/jpeg")
    own = guards.download_error(F.when(k % 11 == 0, 404).otherwise(200), kind, F.when(k % 13 == 0, 30_000_000), content)
    return table(spark, sf, "supplier").select(k.alias("id"), own.alias("refused"))


def reference_lookup(spark, sf):
    """Upload references to stored files: an equi-join on the file's name; unknown references give null."""
    k = F.col("c_custkey")
    refs = table(spark, sf, "customer").select(k.alias("id"), F.concat(F.lit("upload://f"), k % 300, F.lit(".png")).alias("ref"))
    files = table(spark, sf, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey"), F.lit(".png")).alias("name"), F.col("s_suppkey").alias("size"))
    named = refs.where(guards.scheme(F.col("ref")) == "upload").withColumn("name", F.regexp_replace("ref", "^upload://", ""))
    return named.join(files, "name", "left").select("id", "name", "size")


QUERIES = {
    "download_check": (download_check, "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 11 = 0 THEN 'http' WHEN s_suppkey % 5 = 0 THEN 'content_type' WHEN s_suppkey % 13 = 0 THEN 'declared_size' WHEN s_suppkey % 7 = 0 THEN 'empty' WHEN s_suppkey % 3 > 0 THEN 'signature' END AS refused FROM supplier"),
    "reference_lookup": (reference_lookup, "SELECT c_custkey AS id, 'f' || (c_custkey % 300) || '.png' AS name, s_suppkey AS size FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 300"),
    "colour_scalars": (colour_scalars, f"""WITH c AS ({COLOURS}) SELECT id, '#' || lower(printf('%02x%02x%02x', r, g, b)) AS hex, (r * 65536 + g * 256 + b)::BIGINT AS key, ((r // 8) * 65536 + (g // 8) * 256 + b // 8)::BIGINT AS quant,
        floor({lum()} * 1e6 + 0.5) / 1e6 AS luminance, ((r - r2) * (r - r2) + (g - g2) * (g - g2) + (b - b2) * (b - b2))::BIGINT AS d2, greatest(0, least(255, floor(p_retailprice - 900.5 + 0.5)))::BIGINT AS clamped FROM c"""),
    "contrast_ratio": (contrast_ratio, f"WITH c AS ({COLOURS}), l AS (SELECT id, {lum()} AS a, {lum('r2', 'g2', 'b2')} AS z FROM c) SELECT id, floor((greatest(a, z) + 0.05) / (least(a, z) + 0.05) * 100 + 0.5) / 100 AS ratio FROM l"),
    "wcag_compliance": (wcag_compliance, f"""WITH c AS ({COLOURS}), l AS (SELECT id, large, {lum()} AS a, {lum('r2', 'g2', 'b2')} AS z FROM c), q AS (SELECT id, large, floor((greatest(a, z) + 0.05) / (least(a, z) + 0.05) * 100 + 0.5) / 100 AS ratio FROM l)
        SELECT id, ratio, (CASE WHEN large THEN 3.0 ELSE 4.5 END)::DOUBLE AS required_aa, (CASE WHEN large THEN 4.5 ELSE 7.0 END)::DOUBLE AS required_aaa, ratio + 1e-9 >= CASE WHEN large THEN 3.0 ELSE 4.5 END AS aa, ratio + 1e-9 >= CASE WHEN large THEN 4.5 ELSE 7.0 END AS aaa FROM q"""),
    "parse_color": (parse_color, f"""WITH c AS ({COLOURS}), s AS (SELECT *, '#' || printf('%02x%02x%02x', r, g, b) AS hex FROM c)
        SELECT id, CASE id % 8 WHEN 0 THEN hex WHEN 1 THEN upper(hex) WHEN 2 THEN ' rgb(' || r || ', ' || g || ', ' || b || ') ' WHEN 3 THEN 'rgba(' || r || ' ' || g || ' ' || b || ' / 0.5)' WHEN 4 THEN hex[1:4] WHEN 5 THEN hex || '80' WHEN 6 THEN 'White' ELSE 'no colour' END AS said,
        (CASE id % 8 WHEN 4 THEN (r // 16) * 17 WHEN 6 THEN 255 WHEN 7 THEN NULL ELSE r END)::BIGINT AS cr, (CASE id % 8 WHEN 4 THEN (r % 16) * 17 WHEN 6 THEN 255 WHEN 7 THEN NULL ELSE g END)::BIGINT AS cg, (CASE id % 8 WHEN 4 THEN (g // 16) * 17 WHEN 6 THEN 255 WHEN 7 THEN NULL ELSE b END)::BIGINT AS cb,
        CASE id % 8 WHEN 3 THEN 0.5 WHEN 5 THEN floor(128 / 255.0::DOUBLE * 1e6 + 0.5) / 1e6 WHEN 7 THEN NULL ELSE 1.0 END::DOUBLE AS alpha FROM s"""),
    "aa_blend": (aa_blend, AA_SQL),
    "clamp_region": (clamp_region, f"""WITH f AS ({FRAMES}), a AS (SELECT *, greatest(0, least(w - 1, floor(q * 7.5 - 60)))::BIGINT AS x, greatest(0, least(h - 1, floor(p * 3.5 - 40)))::BIGINT AS y FROM f)
        SELECT o, n, x AS "left", y AS top, greatest(1, least(w - x, floor(q * 4.25)))::BIGINT AS width, greatest(1, least(h - y, floor(CASE WHEN p % 5 > 0 THEN p * 2.75 ELSE h END)))::BIGINT AS height FROM a"""),
    "box_in_crop": (box_in_crop, f"WITH f AS ({FRAMES}), s AS (SELECT o, n, ({_BOX_SHARE})::DOUBLE / greatest(1, (q * 2 + 1) * p) AS v FROM f) SELECT o, n, floor(v * 1e6 + 0.5) / 1e6 AS share, v >= 0.5 AS inside FROM s"),
    "legibility": (legibility, f"SELECT o, n, least(w, h)::BIGINT AS short_side, (w * h)::BIGINT AS total_pixels, least(w, h) >= 256 AND w * h >= 65536 AS legible, ((least(w, h) < 256)::INT + (w * h < 65536)::INT)::BIGINT AS n_warnings FROM ({FRAMES})"),
    "tile_grid": (tile_grid, TILE_SQL),
    "offset_box": (offset_box, f'SELECT o, n, (q + 13)::BIGINT AS "left", (p - 7)::BIGINT AS top, w::BIGINT AS width, h::BIGINT AS height FROM ({FRAMES})'),
    "diff_target_size": (diff_target_size, f"""WITH f AS (SELECT *, w + p AS w2, h + q % 3 AS h2 FROM ({FRAMES})), a AS (SELECT *, w::DOUBLE / h AS a1, w2::DOUBLE / h2 AS a2 FROM f), s AS (SELECT o, n, CASE WHEN abs(a1 - a2) < 0.1 THEN least(w, w2) ELSE least(w, w2, 400) END AS width, CASE WHEN abs(a1 - a2) < 0.1 THEN a1 ELSE (a1 + a2) / 2 END AS aspect FROM a)
        SELECT o, n, width::BIGINT AS width, floor(width / aspect + 0.5)::BIGINT AS height FROM s"""),
    "crop_validation": (crop_validation, f"WITH f AS (SELECT o, n, q - 3 AS l, p - 2 AS t, q * 11 - 20 AS cw, p * 9 AS ch, w, h FROM ({FRAMES})) SELECT o, n, CASE WHEN cw <= 0 OR ch <= 0 THEN 'size' WHEN l < 0 OR t < 0 THEN 'origin' WHEN l + cw > w OR t + ch > h THEN 'bounds' END AS error FROM f"),
    "vision_resize": (vision_resize, f"WITH f AS (SELECT *, least(1.0::DOUBLE, 300::DOUBLE / greatest(w, h)) AS s FROM ({FRAMES})) SELECT o, n, greatest(1, floor(w * s + 0.5))::BIGINT AS width, greatest(1, floor(h * s + 0.5))::BIGINT AS height, floor(s * 1e6 + 0.5) / 1e6 AS scale, s < 1.0 AS downscaled FROM f"),
    "quantitative_question": (quantitative_question, QUANT_SQL),
    "blocked_ip": (blocked_ip, BLOCKED_SQL),
    "path_containment": (path_containment, "SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'a/../b/' || s_suppkey WHEN 1 THEN '../data' || s_suppkey WHEN 2 THEN '/srv/data/x' || s_suppkey WHEN 3 THEN '/srv/database/' || s_suppkey ELSE './a//../../data/' || s_suppkey END AS path, s_suppkey % 5 IN (0, 2, 4) AS inside FROM supplier"),
    "magic_mime": (magic_mime, """SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' WHEN 4 THEN 'image/bmp' ELSE CASE WHEN s_suppkey % 7 = 0 THEN 'image/png' END END AS mime, s_suppkey % 6 < 5 AS supported FROM supplier"""),
    "source_scheme": (source_scheme, "SELECT s_suppkey AS id, ['data', 'file', 'home', 'http', 'upload', 'download', 'path', 'base64', 'unknown'][(s_suppkey % 9 + 1)::INT] AS scheme FROM supplier"),
    "clean_base64": (clean_base64, "SELECT s_suppkey AS id, ['QUJD+REVG', 'QUJD+REVG', 'QU+JD=', 'QUJD%zz'][(s_suppkey % 4 + 1)::INT] AS cleaned FROM supplier"),
    "public_url": (public_url, "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'scheme' WHEN 1 THEN 'localhost' WHEN 2 THEN 'address' END AS refused FROM pages"),
    "escape_xml": (escape_xml, "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM pages"),
    "text_truncate": (text_truncate, "SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || chr(10) || '…[truncated]' ELSE text END AS shown FROM documents"),
    "dom_fragment": (dom_fragment, "SELECT doc_id, CASE WHEN length(t) < 3 THEN '' ELSE t END AS fragment FROM (SELECT doc_id, regexp_replace(text, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g') AS t FROM documents)"),
    "image_sources": (image_sources, "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'a' || s_suppkey || '.png|b.png' END AS sources FROM supplier"),
    "annotation_svg": (annotation_svg, SVG_SQL),
    "provenance_footer": (provenance_footer, f"WITH c AS ({COLOURS}) SELECT id, concat_ws(' | ', 'model: ' || p_type, 'ttft: ' || CASE WHEN id % 3 > 0 THEN id END || 'ms', 'total: ' || CASE WHEN id % 4 > 0 THEN id * 2 END || 'ms', 'image: ' || r || 'x' || CASE WHEN id % 5 > 0 THEN g END || CASE WHEN id % 2 = 0 THEN ' (downscaled)' ELSE '' END) AS footer FROM c"),
    "prompts": (prompts, f"WITH c AS ({COLOURS}) SELECT id, concat_ws('', 'Report only what is visible in the image. If something cannot be determined, say so instead of guessing.' || chr(10) || 'Describe: ', p_name, CASE WHEN id % 2 = 0 THEN chr(10) || 'Focus: ' || p_type END) AS prompt FROM c"),
    "timeout_diagnosis": (timeout_diagnosis, f"WITH c AS ({COLOURS}) SELECT id, CASE id % 3 WHEN 0 THEN 'inference:' || CASE WHEN id % 2 = 0 AND id * 100 <= 20000 THEN 'quick' ELSE 'slow' END WHEN 1 THEN 'contention:m2 ' || printf('%.1f', (id * 1e8) / 1e9) || 'GB' ELSE 'cold' END AS diagnosis FROM c"),
}
