"""Queries over ink components, each with the same query in SQL (recursive for labels and for the ordered fold)."""

from __future__ import annotations

from pyspark.sql import functions as F

from visparq import schema as S
from visparq.operators import contrast, inks
from visparq.plans.pixels import GRAY, images, upscale
from visparq.plans.scalars import lum, table
from visparq.sources import rasters

#: Three-colour rasters: 8 x 8 pixels whose channels follow the level, so that components hold several colours.
_PX = "SELECT vec_id AS image_id, i % 8 AS x, i // 8 AS y, l, (l * 60)::INT AS r, (l * 50 + (i % 3) * 3)::INT AS g, (l * 40)::INT AS b FROM (SELECT vec_id, i, greatest(0, least(4, floor((embedding[i + 1]::DOUBLE + 0.5) * 4)))::INT AS l FROM embeddings, (SELECT unnest(range(64)) AS i))"


def pixels(spark, sf):
    g = rasters.embedding_gray(table(spark, sf, "embeddings"))
    q, i = F.greatest(F.lit(0), F.least(F.lit(4), F.col("q"))), F.col("y") * 8 + F.col("x")
    return g.select("image_id", "x", "y", (q * 60).cast("int").alias("r"), (q * 50 + i % 3 * 3).cast("int").alias("g"), (q * 40).cast("int").alias("b"))


def frames(spark, sf):
    """The pixels as image rows: an image's 64 pixels are gathered, which its size bounds."""
    hexed = F.concat(*(F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in "rgb"))
    rows = pixels(spark, sf).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct((F.col("y") * 8 + F.col("x")).alias("i"), hexed.alias("h")))).alias("p"))
    return rows.select("image_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(F.array_join(F.transform("p", lambda p: p["h"]), "")).alias("data"))


def found(spark, sf, threshold=60):
    return inks.labelled(frames(spark, sf), threshold)


#: Wider ceilings than the defaults, so that these small rasters meet every channel.
NOISE, REGION = 2.5, 3.5
D2 = "({a} // 65536 - {b} // 65536) * ({a} // 65536 - {b} // 65536) + ({a} // 256 % 256 - {b} // 256 % 256) * ({a} // 256 % 256 - {b} // 256 % 256) + ({a} % 256 - {b} % 256) * ({a} % 256 - {b} % 256)"
INK = f"""RECURSIVE px AS (SELECT *, r * 65536 + g * 256 + b AS key, y * 8 + x AS i FROM ({_PX})),
bgs AS (SELECT image_id, key AS bg FROM (SELECT image_id, key, count(*) AS n, min(i) AS f FROM px GROUP BY image_id, key) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, f) = 1),
mask AS (SELECT px.image_id, x, y, i, key, bg FROM px JOIN bgs USING (image_id) WHERE {D2.format(a='key', b='bg')} > 3600),
reach AS (SELECT image_id, i, x, y, i AS root FROM mask UNION SELECT m.image_id, m.i, m.x, m.y, r.root FROM reach r JOIN mask m ON m.image_id = r.image_id AND abs(m.x - r.x) + abs(m.y - r.y) = 1),
lab AS (SELECT image_id, i, min(root) AS label FROM reach GROUP BY image_id, i), ink AS (SELECT m.*, label FROM mask m JOIN lab USING (image_id, i)),
cnt AS (SELECT image_id, label, key, any_value(bg) AS bg, count(*) AS n, min(i) AS f, {D2.format(a='key', b='any_value(bg)')} AS d2 FROM ink GROUP BY image_id, label, key),
led AS (SELECT image_id, label, any_value(bg) AS bg, coalesce(arg_max(key, d2 * 100 - f) FILTER (n >= 2), arg_max(key, n * 100 - f)) AS key, sum(n)::BIGINT AS area FROM cnt GROUP BY image_id, label),
bx AS (SELECT image_id, label, min(x) AS "left", min(y) AS top, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM ink GROUP BY image_id, label),
comps AS (SELECT image_id, label, bg, key, area, "left", top, width, height, floor(area::DOUBLE / (width * height) * 10000 + 0.5) / 10000 AS fill FROM led JOIN bx USING (image_id, label) WHERE area >= {S.MIN_INK_AREA})"""
GRP = INK + f", grp AS (SELECT image_id, key, bg, sum(area)::BIGINT AS pixels, count(*) AS pieces, sum(fill) AS fill_sum, any_value({D2.format(a='key', b='bg')}) AS d2 FROM comps GROUP BY image_id, key, bg)"
RAW = "((greatest({l1}, {l2}) + 0.05) / (least({l1}, {l2}) + 0.05))".format(l1=lum("key // 65536", "(key // 256 % 256)", "(key % 256)"), l2=lum("bg // 65536", "(bg // 256 % 256)", "(bg % 256)"))
CHAN = GRP.replace("> 3600", "> 16") + f""", raw AS (SELECT *, {RAW} AS raw, pixels::DOUBLE / pieces AS mean FROM grp),
chan AS (SELECT image_id, key::BIGINT AS key, CASE WHEN pixels < {S.COLOUR_FLOOR} THEN 'skipped' WHEN raw < {NOISE} AND NOT (pieces >= 3 AND mean >= 100) THEN 'suspected_noise' WHEN raw < {REGION} AND (mean / 64 > {S.REGION_SHARE} OR (pixels / 64.0 > {S.REGION_SHARE} AND fill_sum / pieces >= {S.REGION_FILL})) THEN 'background_region' ELSE 'evaluated' END AS channel, floor(raw * 100 + 0.5) / 100 AS ratio, raw FROM raw)"""


def ink_components(spark, sf):
    own = inks.components(found(spark, sf))
    return own.select("image_id", "label", *(F.col(c).cast("long").alias(c) for c in ("key", "area", "left", "top", "width", "height")), "fill")


def component_colours(spark, sf):
    return inks.colour_counts(found(spark, sf)).select("image_id", "label", F.col("key").cast("long").alias("key"), "n")


def second_ink(spark, sf):
    return inks.second_inks(found(spark, sf), 8, 2).select("image_id", "label", *(F.col(c).cast("long").alias(c) for c in ("key", "n", "total", "met")))


_CHN = [("// 65536", "r"), ("// 256 % 256", "g"), ("% 256", "b")]


def _blend(x, y):
    t = " + ".join(f"CASE WHEN {y} {c} <> bg {c} THEN ({x} {c} - bg {c})::DOUBLE / ({y} {c} - bg {c}) ELSE 0 END" for c, _ in _CHN)
    n = " + ".join(f"(CASE WHEN {y} {c} <> bg {c} THEN 1 ELSE 0 END)" for c, _ in _CHN)
    t = f"(({t}) / nullif({n}, 0))"
    off = " + ".join(f"pow(({x} {c}) - ((bg {c}) + {t} * (({y} {c}) - (bg {c}))), 2)" for c, _ in _CHN)
    return f"coalesce({t} > 0 AND {t} < 1 AND sqrt({off}) < 3, false)"


SECOND = f"""WITH {INK}, o AS (SELECT c.image_id, c.label, c.key, c.n, c.bg, m.key AS lead FROM cnt c JOIN comps m ON c.image_id = m.image_id AND c.label = m.label AND c.key <> m.key), bl AS (SELECT *, {_blend('key', 'lead')} OR {_blend('lead', 'key')} AS blend FROM o),
t AS (SELECT *, sum(n) OVER w AS total, count(*) OVER w AS met, sum(CASE WHEN blend THEN n ELSE 0 END) OVER w AS blended FROM bl WINDOW w AS (PARTITION BY image_id, key))
SELECT image_id, label, key::BIGINT AS key, n, total::BIGINT AS total, met FROM t WHERE total >= 8 AND (blended = 0 OR blended >= 500) AND total >= 2 * met"""


def colour_groups(spark, sf):
    own = inks.groups(found(spark, sf))
    return own.select("image_id", *(F.col(c).cast("long").alias(c) for c in ("key", "bg", "pixels", "pieces", "d2")), (F.floor(F.col("fill_sum") * 1e4 + 0.5) / 1e4).alias("fill_sum"))


def colour_clusters(spark, sf):
    return inks.clusters(inks.groups(found(spark, sf)), 8)


CLUSTERS = f"""WITH {GRP}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY pixels DESC, key) AS rk FROM grp),
f AS (SELECT image_id, rk, [{{'key': key, 'd2': d2, 'pixels': pixels, 'pieces': pieces}}] AS st FROM o WHERE rk = 1
UNION ALL SELECT o.image_id, o.rk, CASE WHEN len(list_filter(f.st, lambda c: {D2.format(a='c.key', b='o.key')} <= 64)) = 0 THEN list_append(f.st, {{'key': o.key, 'd2': o.d2, 'pixels': o.pixels, 'pieces': o.pieces}})
 ELSE list_transform(f.st, lambda c, k: CASE WHEN k = list_position(list_transform(f.st, lambda e: {D2.format(a='e.key', b='o.key')} <= 64), true) THEN {{'key': CASE WHEN o.d2 > c.d2 THEN o.key ELSE c.key END, 'd2': greatest(c.d2, o.d2), 'pixels': c.pixels + o.pixels, 'pieces': c.pieces + o.pieces}} ELSE c END) END FROM f JOIN o ON o.image_id = f.image_id AND o.rk = f.rk + 1),
l AS (SELECT image_id, st FROM f QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY rk DESC) = 1)
SELECT image_id, k - 1 AS k, st[k].key::BIGINT AS key, st[k].pixels::BIGINT AS pixels, st[k].pieces::BIGINT AS pieces FROM (SELECT image_id, st, unnest(range(1, len(st) + 1)) AS k FROM l)"""


def _routed(spark, sf, local=True):
    f = found(spark, sf, S.INK_THRESHOLD)
    return inks.channels(inks.groups(f), f.select("image_id").distinct().withColumn("area", F.lit(64)), local, noise=NOISE, region=REGION)


def channels(spark, sf):
    return _routed(spark, sf).drop("raw")


def noise_partition(spark, sf):
    return _routed(spark, sf).where("channel = 'suspected_noise'").drop("raw")


def region_backstop(spark, sf):
    return _routed(spark, sf, False).where("channel = 'background_region'").drop("raw")


def ink_verdicts(spark, sf):
    return inks.verdicts(_routed(spark, sf))


def _measured(spark, sf, **kw):
    return contrast.measure(upscale(images(spark, sf), 12), contrast.Options(**kw))


def region_contrast(spark, sf):
    """Each raster's left and right half, measured by themselves."""
    half = F.explode(F.array(F.lit(0), F.lit(48))).alias("r_left")
    halves = upscale(images(spark, sf), 12).select("*", half).withColumns({"r_top": F.lit(0), "r_width": F.lit(48), "r_height": F.lit(96)})
    return contrast.measure(halves, regions=True).select("image_id", "left", "width", "verdict", "background", "evaluated_count", "failing_count")


def plateaus(spark, sf):
    return _measured(spark, sf).select("image_id", F.posexplode("plateaus").alias("k", "p")).select("image_id", F.col("k").cast("long").alias("k"), "p.*")


def aa_fold(spark, sf):
    return contrast.colours(_measured(spark, sf)).where("channel = 'merged'")


def mask_reconciliation(spark, sf):
    return _measured(spark, sf).select("image_id", F.explode("reconciliation").alias("r")).select("image_id", "r.*")


def model_arbitration(spark, sf):
    return _measured(spark, sf).where("disagreement IS NOT NULL").select("image_id", "verdict", "all_meet_aa", "disagreement.local_all_meet_aa", "disagreement.local_failing_count")


PLATEAUS = f"""WITH RECURSIVE g AS (SELECT *, y * 8 + x AS i FROM ({GRAY})),
reach AS (SELECT image_id, i, x, y, v, i AS root FROM g UNION SELECT m.image_id, m.i, m.x, m.y, m.v, r.root FROM reach r JOIN g m ON m.image_id = r.image_id AND m.v = r.v AND abs(m.x - r.x) + abs(m.y - r.y) = 1),
lab AS (SELECT image_id, v, i, x, y, min(root) AS label FROM reach GROUP BY image_id, v, i, x, y),
comps AS (SELECT image_id, v, label, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, (max(x) - min(x) + 1) * (max(y) - min(y) + 1) AS box, min(x) = 0 OR min(y) = 0 OR max(x) = 7 OR max(y) = 7 AS border FROM lab GROUP BY image_id, v, label),
best AS (SELECT * FROM comps QUALIFY row_number() OVER (PARTITION BY image_id, v ORDER BY area DESC, label) = 1),
gap AS (SELECT b.image_id, b.v AS own, g.i, g.x, g.y, g.x IN (b.x0, b.x1) OR g.y IN (b.y0, b.y1) AS edge FROM best b JOIN g ON g.image_id = b.image_id AND g.x BETWEEN b.x0 AND b.x1 AND g.y BETWEEN b.y0 AND b.y1 AND g.v <> b.v WHERE NOT b.border),
walk AS (SELECT image_id, own, i, x, y, i AS root FROM gap UNION SELECT w.image_id, w.own, p.i, p.x, p.y, w.root FROM walk w JOIN gap p ON p.image_id = w.image_id AND p.own = w.own AND abs(p.x - w.x) + abs(p.y - w.y) = 1),
grp AS (SELECT image_id, own, i, min(root) AS root FROM walk GROUP BY image_id, own, i),
hole AS (SELECT image_id, own, max(n) AS n FROM (SELECT r.image_id, r.own, r.root, count(*) AS n, bool_or(p.edge) AS edge FROM grp r JOIN gap p ON p.image_id = r.image_id AND p.own = r.own AND p.i = r.i GROUP BY r.image_id, r.own, r.root) WHERE NOT edge GROUP BY image_id, own),
stat AS (SELECT image_id, v, min(label) AS first, sum(area) AS total, count(*) FILTER (area::DOUBLE / box >= {S.SOLID_FILL}) AS n, sum(area) FILTER (area::DOUBLE / box >= {S.SOLID_FILL}) AS s, sum(area * area) FILTER (area::DOUBLE / box >= {S.SOLID_FILL}) AS q FROM comps GROUP BY image_id, v),
acc AS (SELECT t.image_id, t.v, t.first, t.total, b.area, b.area / 64.0 >= {S.PLATEAU_SHARE} AND b.area::DOUBLE / t.total >= {S.PLATEAU_DOMINANCE} AND (b.border OR coalesce(h.n, 0)::DOUBLE / b.box < {S.RING_HOLE}) AS blob, t.n >= 2 AND t.s / 64.0 >= {S.PLATEAU_SHARE} AND t.n * t.q - t.s * t.s <= {S.SIZE_VARIATION**2} * t.s * t.s AS tiled FROM stat t JOIN best b ON b.image_id = t.image_id AND b.v = t.v LEFT JOIN hole h ON h.image_id = t.image_id AND h.own = t.v WHERE t.total / 64.0 >= {S.PLATEAU_SHARE})
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, first) - 1 AS k, '#' || repeat(printf('%02x', v), 3) AS hex, floor(total / 64.0::DOUBLE * 10000 + 0.5) / 10000 AS share, CASE WHEN blob THEN 'dominant-blob' ELSE 'tiled' END AS detection, floor(area / 64.0::DOUBLE * 10000 + 0.5) / 10000 AS largest_component_share FROM acc WHERE blob OR tiled"""

QUERIES = {
    "ink_components": (ink_components, f"WITH {INK} SELECT image_id, label::BIGINT AS label, key::BIGINT AS key, area, \"left\"::BIGINT AS \"left\", top::BIGINT AS top, width::BIGINT AS width, height::BIGINT AS height, fill FROM comps"),
    "component_colours": (component_colours, f"WITH {INK} SELECT image_id, label::BIGINT AS label, key::BIGINT AS key, n FROM cnt"),
    "second_ink": (second_ink, SECOND),
    "colour_groups": (colour_groups, f"WITH {GRP} SELECT image_id, key::BIGINT AS key, bg::BIGINT AS bg, pixels, pieces, d2::BIGINT AS d2, floor(fill_sum * 1e4 + 0.5) / 1e4 AS fill_sum FROM grp"),
    "colour_clusters": (colour_clusters, CLUSTERS),
    "channels": (channels, f"WITH {CHAN} SELECT * EXCLUDE (raw) FROM chan"),
    "noise_partition": (noise_partition, f"WITH {CHAN} SELECT * EXCLUDE (raw) FROM chan WHERE channel = 'suspected_noise'"),
    "region_backstop": (region_backstop, f"WITH {CHAN.replace(f'raw < {NOISE} AND NOT', 'false AND NOT')} SELECT * EXCLUDE (raw) FROM chan WHERE channel = 'background_region'"),
    "ink_verdicts": (ink_verdicts, f"WITH {CHAN}, v AS (SELECT image_id, min(ratio) FILTER (channel = 'evaluated') AS worst, max(ratio) FILTER (channel = 'evaluated') AS best, count(*) FILTER (channel = 'evaluated' AND raw < 4.5 - 1e-9) AS failing, count(*) FILTER (channel = 'evaluated' AND raw >= 4.5 - 1e-9) AS passing, bool_and(raw >= 4.5 - 1e-9) FILTER (channel = 'evaluated') AS all_meet_aa FROM chan GROUP BY image_id) SELECT *, CASE WHEN all_meet_aa IS NULL THEN 'unverified' WHEN all_meet_aa THEN 'clean' ELSE 'failing' END AS verdict FROM v"),
    "plateaus": (plateaus, PLATEAUS),
    "region_contrast": (region_contrast, None),
    "aa_fold": (aa_fold, None),
    "mask_reconciliation": (mask_reconciliation, None),
    "model_arbitration": (model_arbitration, None),
}
