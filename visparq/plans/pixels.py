"""Queries over rasters made of embeddings, each with the same query in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from visparq import workers
from visparq.functions import color
from visparq.operators import components as comp
from visparq.operators import contrast, histogram
from visparq.plans.scalars import lum, table
from visparq.sources import rasters

TARGET, NEAR = (120, 120, 120), 10


def rgb(spark, sf):
    return rasters.embedding_rgb(table(spark, sf, "embeddings"))


def images(spark, sf):
    return rasters.embedding_images(table(spark, sf, "embeddings"))


LEVEL = "floor((embedding[{0}]::DOUBLE + 0.5) * 4)"
_CH = "(greatest(0, least(3, floor((embedding[3 * i + {0}]::DOUBLE + 0.5) * 4))) * 85)::INT"
RGB = f"SELECT vec_id AS image_id, i % 7 AS x, i // 7 AS y, {_CH.format(1)} AS r, {_CH.format(2)} AS g, {_CH.format(3)} AS b FROM embeddings, (SELECT unnest(range(21)) AS i)"
GRAY = "SELECT vec_id AS image_id, i % 8 AS x, i // 8 AS y, (greatest(0, least(4, floor((embedding[i + 1]::DOUBLE + 0.5) * 4))) * 60)::INT AS v FROM embeddings, (SELECT unnest(range(64)) AS i)"
HIST = f"p AS ({RGB}), hist AS (SELECT image_id, r * 65536 + g * 256 + b AS key, any_value(r) AS r, any_value(g) AS g, any_value(b) AS b, count(*) AS n, min(y * 7 + x) AS first FROM p GROUP BY image_id, r * 65536 + g * 256 + b), mode AS (SELECT image_id, key, r, g, b FROM hist QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, first) = 1)"
D2 = "((h.r - m.r) * (h.r - m.r) + (h.g - m.g) * (h.g - m.g) + (h.b - m.b) * (h.b - m.b))"


def hist(spark, sf):
    return histogram.histogram(rgb(spark, sf))


def colour_histogram(spark, sf):
    return hist(spark, sf).select("image_id", F.col("key").cast("long").alias("key"), "n", (F.col("first_y") * 7 + F.col("first_x")).cast("long").alias("first_at"))


def dominant_colors(spark, sf):
    return histogram.dominant(hist(spark, sf)).select("image_id", F.col("rank").cast("long").alias("rank"), "hex", "n", "share")


def modal_background(spark, sf):
    return histogram.background(hist(spark, sf)).select("image_id", F.col("key").cast("long").alias("key"))


def background_fit(spark, sf):
    return histogram.background_fit(hist(spark, sf), 90)


def non_background_ratio(spark, sf):
    return histogram.non_background(hist(spark, sf), 90)


def nearest_background(spark, sf):
    h = hist(spark, sf)
    top = h.where("n >= 2").select("image_id", (F.col("first_y") * 7 + F.col("first_x")).alias("ord"), F.col("key").alias("other"))
    return histogram.nearest(h, top).select("image_id", *(F.col(c).cast("long").alias(c) for c in ("key", "nearest", "d2")))


def ink_mask_global(spark, sf):
    p = rgb(spark, sf)
    own = histogram.ink_mask(p, histogram.background(histogram.histogram(p)))
    return own.groupBy("image_id").agg(F.count("*").alias("n_ink"), F.sum(F.col("y") * 7 + F.col("x")).alias("at"))


def color_mask(spark, sf):
    own = histogram.color_mask(rgb(spark, sf), (85, 85, 85), 90)
    return own.select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


def visual_diff(spark, sf):
    p = rgb(spark, sf)
    return histogram.diff(p, p.withColumn("image_id", F.col("image_id") - 1), 15)


def tile_background(spark, sf):
    own = histogram.tile_background(_gray_pixels(spark, sf), 4)
    return own.select("image_id", *(F.col(c).cast("long").alias(c) for c in ("tx", "ty", "mr")), (F.floor(F.col("sigma") * 1e4 + 0.5) / 1e4).alias("sigma"))


def _gray_pixels(spark, sf):
    g = rasters.embedding_gray(table(spark, sf, "embeddings"))
    v = (F.greatest(F.lit(0), F.least(F.lit(4), F.col("q"))) * 60).cast("int")
    return g.select("image_id", "x", "y", v.alias("r"), v.alias("g"), v.alias("b"))


def tile_interpolation(spark, sf):
    p = _gray_pixels(spark, sf)
    own = histogram.tile_interpolation(p, histogram.tile_background(p, 4), 4)
    return own.select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), (F.floor(F.col("br") * 1e4 + 0.5) / 1e4).alias("background"), (F.floor(F.col("sigma") * 1e4 + 0.5) / 1e4).alias("sigma"))


def ink_mask_local(spark, sf):
    p = _gray_pixels(spark, sf)
    own = histogram.ink_mask_local(histogram.tile_interpolation(p, histogram.tile_background(p, 4), 4), 4, 0.5)
    return own.groupBy("image_id").agg(F.count("*").alias("n_ink"))


TILES = f"""g AS ({GRAY}), t AS (SELECT *, x // 4 AS tx, y // 4 AS ty FROM g), med AS (SELECT image_id, tx, ty, list_sort(list(v))[count(*) // 2 + 1] AS m FROM t GROUP BY image_id, tx, ty),
far AS (SELECT t.image_id, t.tx, t.ty, m, sqrt(3.0::DOUBLE * (v - m) * (v - m)) AS d FROM t JOIN med USING (image_id, tx, ty)), mid AS (SELECT image_id, tx, ty, list_sort(list(d))[count(*) // 2 + 1] AS md FROM far GROUP BY image_id, tx, ty),
tiles AS (SELECT far.image_id, far.tx, far.ty, m, list_sort(list(abs(d - md)))[count(*) // 2 + 1] * 1.4826 AS sigma FROM far JOIN mid USING (image_id, tx, ty) GROUP BY far.image_id, far.tx, far.ty, m)"""
INTER = TILES + """, f AS (SELECT *, x / 4.0::DOUBLE - 0.5 AS fx, y / 4.0::DOUBLE - 0.5 AS fy FROM g), c AS (SELECT *, fx - floor(fx) AS wx, fy - floor(fy) AS wy, greatest(0, least(1, floor(fx)))::INT AS xa, greatest(0, least(1, floor(fx) + 1))::INT AS xb, greatest(0, least(1, floor(fy)))::INT AS ya, greatest(0, least(1, floor(fy) + 1))::INT AS yb FROM f),
i AS (SELECT c.image_id, x, y, v, (p.m * (1 - wx) + q.m * wx) * (1 - wy) + (s.m * (1 - wx) + u.m * wx) * wy AS background, greatest(p.sigma, q.sigma, s.sigma, u.sigma) AS sigma FROM c
 JOIN tiles p ON p.image_id = c.image_id AND p.tx = xa AND p.ty = ya JOIN tiles q ON q.image_id = c.image_id AND q.tx = xb AND q.ty = ya JOIN tiles s ON s.image_id = c.image_id AND s.tx = xa AND s.ty = yb JOIN tiles u ON u.image_id = c.image_id AND u.tx = xb AND u.ty = yb)"""


def components(spark, sf):
    return comp.components(images(spark, sf), TARGET, NEAR, 1).drop("truncated", "hole")


def color_boxes(spark, sf):
    return comp.boxes(comp.components(images(spark, sf), TARGET, NEAR, 2), 2, 2)


def enclosed_hole(spark, sf):
    return comp.components(images(spark, sf), TARGET, NEAR, 4).select("image_id", "label", "hole").where("hole > 0")


def point_in_box(spark, sf):
    boxes = comp.components(images(spark, sf), TARGET, NEAR, 3).select("image_id", F.col("label").alias("ord"), "left", "top", "width", "height")
    cells = rasters.embedding_gray(table(spark, sf, "embeddings")).where("x % 3 = 0 AND y % 3 = 0").select("image_id", (F.col("y") * 8 + F.col("x")).alias("point_id"), "x", "y")
    return comp.owner(cells, boxes).select("image_id", F.col("point_id").cast("long").alias("point_id"), "owner")


COMP = f"""RECURSIVE g AS ({GRAY}), mask AS (SELECT image_id, x, y, y * 8 + x AS i FROM g WHERE 3 * (v - 120) * (v - 120) <= 100),
reach AS (SELECT image_id, i, x, y, i AS root FROM mask UNION SELECT m.image_id, m.i, m.x, m.y, r.root FROM reach r JOIN mask m ON m.image_id = r.image_id AND abs(m.x - r.x) + abs(m.y - r.y) = 1),
lab AS (SELECT image_id, i, x, y, min(root) AS label FROM reach GROUP BY image_id, i, x, y),
comps AS (SELECT image_id, label::BIGINT AS label, count(*)::BIGINT AS area, min(x)::BIGINT AS "left", min(y)::BIGINT AS top, (max(x) - min(x) + 1)::BIGINT AS width, (max(y) - min(y) + 1)::BIGINT AS height, floor(sum(x)::DOUBLE / count(*) + 0.5)::BIGINT AS cx, floor(sum(y)::DOUBLE / count(*) + 0.5)::BIGINT AS cy FROM lab GROUP BY image_id, label)"""
HOLE = f"""WITH {COMP}, cell AS (SELECT c.image_id, c.label, g.x, g.y, l.label IS NOT DISTINCT FROM c.label AS solid, c."left", c.top, c.width, c.height FROM comps c JOIN g ON g.image_id = c.image_id AND g.x BETWEEN c."left" AND c."left" + c.width - 1 AND g.y BETWEEN c.top AND c.top + c.height - 1 LEFT JOIN lab l ON l.image_id = g.image_id AND l.x = g.x AND l.y = g.y WHERE c.area >= 4),
gap AS (SELECT *, y * 8 + x AS i, x = "left" OR x = "left" + width - 1 OR y = top OR y = top + height - 1 AS edge FROM cell WHERE NOT solid),
walk AS (SELECT image_id, label, i, x, y, i AS root, edge FROM gap UNION SELECT w.image_id, w.label, p.i, p.x, p.y, w.root, p.edge FROM walk w JOIN gap p ON p.image_id = w.image_id AND p.label = w.label AND abs(p.x - w.x) + abs(p.y - w.y) = 1),
grp AS (SELECT image_id, label, i, min(root) AS root FROM walk GROUP BY image_id, label, i), agg AS (SELECT r.image_id, r.label, r.root, count(*) AS n, bool_or(g.edge) AS edge FROM grp r JOIN gap g ON g.image_id = r.image_id AND g.label = r.label AND g.i = r.i GROUP BY r.image_id, r.label, r.root)
SELECT image_id, label, max(n)::BIGINT AS hole FROM agg WHERE NOT edge GROUP BY image_id, label"""


def contrast_verdict(spark, sf):
    """The flagship: the whole contrast measurement of every raster."""
    big = rasters.embedding_images(table(spark, sf, "embeddings"))
    return contrast.measure(upscale(big, 12)).select("image_id", "measurable", "verdict", "all_meet_aa", "evaluated_count", "failing_count", "passing_count", F.col("worst.hex").alias("worst_hex"), F.col("worst.contrast_ratio").alias("worst_ratio"), F.col("best.contrast_ratio").alias("best_ratio"))


def upscale(frames, k: int):
    """Each pixel as a k x k square: rasters large enough for glyph-sized regions. Made and sent a few MB at a time."""
    workers.bounded(frames.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in rasters.parts(batches, k * k):
            rows = b.to_pylist()
            data = [np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3).repeat(k, 0).repeat(k, 1).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("image_id"), pa.array([r["width"] * k for r in rows], pa.int32()), pa.array([r["height"] * k for r in rows], pa.int32()), pa.array(data, pa.binary())], names=["image_id", "width", "height", "data"])

    return frames.mapInArrow(run, frames.schema)


def contrast_colours(spark, sf):
    return contrast.colours(contrast.measure(upscale(images(spark, sf), 12)))


def contrast_in_region(spark, sf):
    """Worst pair of a region: modal colour against every other colour of it, native."""
    h = hist(spark, sf)
    joined = h.join(histogram.background(h).withColumnRenamed("key", "mode"), "image_id").where("key <> mode")
    l1, l2 = color.luminance(*color.unpack(F.col("key"))), color.luminance(*color.unpack(F.col("mode")))
    own = joined.select("image_id", color.contrast(l1, l2).alias("raw"))
    ok = F.col("raw") >= 4.5 - 1e-9  # judged before rounding
    return own.groupBy("image_id").agg(color.round2(F.min("raw")).alias("worst"), color.round2(F.max("raw")).alias("best"), F.count_if(~ok).alias("failing"), F.count("*").alias("evaluated"), F.bool_and(ok).alias("all_meet_aa"))


def region_histogram(spark, sf):
    own = histogram.histogram(histogram.in_region(rgb(spark, sf), 1, 0, 4, 2))
    return own.select("image_id", F.col("key").cast("long").alias("key"), "n")


def _frequent(spark, sf):
    """Colours that occur twice or more stand for plateaus, in scan order."""
    return hist(spark, sf).where("n >= 2").select("image_id", (F.col("first_y") * 7 + F.col("first_x")).alias("ord"), F.col("key").alias("other"))


def multi_plateau_mask(spark, sf):
    own = histogram.ink_mask_plateaus(rgb(spark, sf), _frequent(spark, sf), 90)
    return own.select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


def first_plateau(spark, sf):
    own = histogram.first_near(hist(spark, sf), _frequent(spark, sf), 90)
    return own.select("image_id", F.col("key").cast("long").alias("key"), F.col("plateau").cast("long").alias("plateau"))


def ink_thresholds(spark, sf):
    p = _gray_pixels(spark, sf)
    own = histogram.ink_thresholds(histogram.tile_interpolation(p, histogram.tile_background(p, 4), 4), 4, 0.5)
    return own.select("image_id", *((F.floor(F.col(c) * 1e4 + 0.5) / 1e4).alias(c) for c in ("effective", "median")))


def masked_shades(spark, sf):
    h = hist(spark, sf)
    failing = h.where("n = 1").join(histogram.background(h).withColumnRenamed("key", "bg"), "image_id").select("image_id", "key", "bg", ((F.col("first_y") * 7 + F.col("first_x")) * 7.0).alias("mean"))
    own = histogram.shade_bands(failing, _frequent(spark, sf))
    return own.select("image_id", F.col("key").cast("long").alias("key"), "band")


def _blend_sql(x, y, bg):
    t = " + ".join(f"CASE WHEN {y}.{c} <> {bg}.{c} THEN ({x}.{c} - {bg}.{c})::DOUBLE / ({y}.{c} - {bg}.{c}) ELSE 0 END" for c in "rgb")
    n = " + ".join(f"({y}.{c} <> {bg}.{c})::INT" for c in "rgb")
    t = f"(({t}) / nullif({n}, 0))"
    off = " + ".join(f"pow({x}.{c} - ({bg}.{c} + {t} * ({y}.{c} - {bg}.{c})), 2)" for c in "rgb")
    return f"coalesce({t} > 0 AND {t} < 1 AND sqrt({off}) < 3, false)"


QUERIES = {
    "region_histogram": (region_histogram, f"SELECT image_id, (r * 65536 + g * 256 + b)::BIGINT AS key, count(*) AS n FROM ({RGB}) WHERE x BETWEEN 1 AND 4 AND y < 2 GROUP BY ALL"),
    "multi_plateau_mask": (multi_plateau_mask, f"WITH {HIST} SELECT image_id, x::BIGINT AS x, y::BIGINT AS y FROM p h WHERE NOT EXISTS (SELECT 1 FROM hist m WHERE m.image_id = h.image_id AND m.n >= 2 AND {D2} <= 8100)"),
    "first_plateau": (first_plateau, f"WITH {HIST} SELECT h.image_id, h.key::BIGINT AS key, arg_min(m.key, m.first) FILTER ({D2} <= 8100)::BIGINT AS plateau FROM hist h JOIN (SELECT * FROM hist WHERE n >= 2) m ON h.image_id = m.image_id GROUP BY h.image_id, h.key"),
    "ink_thresholds": (ink_thresholds, f"WITH {INTER}, th AS (SELECT image_id, greatest(4.0, 0.5 * sigma) AS t FROM i QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY y, x) <= 4096) SELECT image_id, floor(max(t) * 1e4 + 0.5) / 1e4 AS effective, floor(list_sort(list(t))[count(*) // 2 + 1] * 1e4 + 0.5) / 1e4 AS median FROM th GROUP BY image_id"),
    "masked_shades": (masked_shades, f"WITH {HIST} SELECT h.image_id, h.key::BIGINT AS key, CASE WHEN coalesce(bool_or({_blend_sql('h', 'q', 'm')}), false) THEN CASE WHEN any_value(h.first) * 7.0 < 25 THEN 'shade' WHEN any_value(h.first) * 7.0 >= 100 THEN 'text' ELSE 'ambiguous' END END AS band FROM hist h JOIN mode m ON h.image_id = m.image_id LEFT JOIN (SELECT * FROM hist WHERE n >= 2) q ON q.image_id = h.image_id WHERE h.n = 1 GROUP BY h.image_id, h.key"),
    "colour_histogram": (colour_histogram, f"WITH {HIST} SELECT image_id, key::BIGINT AS key, n, first::BIGINT AS first_at FROM hist"),
    "dominant_colors": (dominant_colors, f"WITH {HIST} SELECT image_id, rank, '#' || printf('%02x%02x%02x', r, g, b) AS hex, n, floor(n * 100.0::DOUBLE / total * 100 + 0.5) / 100 AS share FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, first) AS rank, sum(n) OVER (PARTITION BY image_id) AS total FROM hist) WHERE rank <= 8"),
    "modal_background": (modal_background, f"WITH {HIST} SELECT image_id, key::BIGINT AS key FROM mode"),
    "background_fit": (background_fit, f"WITH {HIST}, f AS (SELECT image_id, sum(CASE WHEN {D2} <= 8100 THEN n ELSE 0 END)::DOUBLE / sum(n) AS s FROM hist h JOIN mode m USING (image_id) GROUP BY image_id) SELECT image_id, floor(s * 1000 + 0.5) / 1000 AS fraction, s >= 0.5 AS adequate, s >= 0.5 AND floor(s * 1000 + 0.5) / 1000 < 0.8 AS marginal FROM f"),
    "non_background_ratio": (non_background_ratio, f"WITH {HIST} SELECT image_id, floor(sum(CASE WHEN {D2} > 8100 THEN n ELSE 0 END) * 100.0::DOUBLE / sum(n) * 100 + 0.5) / 100 AS ratio FROM hist h JOIN mode m USING (image_id) GROUP BY image_id"),
    "nearest_background": (nearest_background, f"WITH {HIST} SELECT h.image_id, h.key::BIGINT AS key, arg_min(m.key, {D2} * 1000 + m.first)::BIGINT AS nearest, min({D2})::BIGINT AS d2 FROM hist h JOIN (SELECT * FROM hist WHERE n >= 2) m ON h.image_id = m.image_id GROUP BY h.image_id, h.key"),
    "ink_mask_global": (ink_mask_global, f"WITH {HIST} SELECT image_id, count(*) AS n_ink, sum(y * 7 + x)::BIGINT AS at FROM p h JOIN mode m USING (image_id) WHERE {D2} > 16 GROUP BY image_id"),
    "color_mask": (color_mask, f"SELECT image_id, x::BIGINT AS x, y::BIGINT AS y FROM ({RGB}) WHERE (r - 85) * (r - 85) + (g - 85) * (g - 85) + (b - 85) * (b - 85) <= 8100"),
    "visual_diff": (visual_diff, f"WITH p AS ({RGB}) SELECT a.image_id, count(*) FILTER (abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b) > 45) AS changed, count(*) AS total, printf('%.2f%%', floor(count(*) FILTER (abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b) > 45) * 100.0::DOUBLE / count(*) * 100 + 0.5) / 100) AS ratio FROM p a JOIN p b ON b.image_id - 1 = a.image_id AND a.x = b.x AND a.y = b.y GROUP BY a.image_id"),
    "tile_background": (tile_background, f"WITH {TILES} SELECT image_id, tx::BIGINT AS tx, ty::BIGINT AS ty, m::BIGINT AS mr, floor(sigma * 1e4 + 0.5) / 1e4 AS sigma FROM tiles"),
    "tile_interpolation": (tile_interpolation, f"WITH {INTER} SELECT image_id, x::BIGINT AS x, y::BIGINT AS y, floor(background * 1e4 + 0.5) / 1e4 AS background, floor(sigma * 1e4 + 0.5) / 1e4 AS sigma FROM i"),
    "ink_mask_local": (ink_mask_local, f"WITH {INTER} SELECT image_id, count(*) AS n_ink FROM i WHERE sqrt(3.0::DOUBLE * (v - background) * (v - background)) > greatest(4.0, 0.5 * sigma) GROUP BY image_id"),
    "components": (components, f"WITH {COMP} SELECT * FROM comps"),
    "color_boxes": (color_boxes, f"WITH {COMP} SELECT image_id, 'box_' || row_number() OVER (PARTITION BY image_id ORDER BY top, \"left\", label) AS box_id, \"left\", top, width, height, area FROM comps WHERE area >= 2 AND width >= 2 AND height >= 2"),
    "enclosed_hole": (enclosed_hole, HOLE),
    "point_in_box": (point_in_box, f"WITH {COMP} SELECT p.image_id, (p.y * 8 + p.x)::BIGINT AS point_id, min(c.label)::BIGINT AS owner FROM g p LEFT JOIN (SELECT * FROM comps WHERE area >= 3) c ON c.image_id = p.image_id AND p.x >= c.\"left\" AND p.x < c.\"left\" + c.width AND p.y >= c.top AND p.y < c.top + c.height WHERE p.x % 3 = 0 AND p.y % 3 = 0 GROUP BY p.image_id, p.x, p.y"),
    "contrast_in_region": (contrast_in_region, f"WITH {HIST}, c AS (SELECT h.image_id, {lum('h.r', 'h.g', 'h.b')} AS a, {lum('m.r', 'm.g', 'm.b')} AS z FROM hist h JOIN mode m ON h.image_id = m.image_id AND h.key <> m.key), q AS (SELECT image_id, (greatest(a, z) + 0.05) / (least(a, z) + 0.05) AS raw FROM c) SELECT image_id, floor(min(raw) * 100 + 0.5) / 100 AS worst, floor(max(raw) * 100 + 0.5) / 100 AS best, count(*) FILTER (raw < 4.5 - 1e-9) AS failing, count(*) AS evaluated, bool_and(raw >= 4.5 - 1e-9) AS all_meet_aa FROM q GROUP BY image_id"),
    "contrast_verdict": (contrast_verdict, None),
    "contrast_colours": (contrast_colours, None),
}
