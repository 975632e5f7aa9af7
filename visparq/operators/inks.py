"""Ink components reduced relationally: labels come from a kernel on the image row, everything after them is native.

``labelled``: image_id, label, y, x, key of every ink pixel, and ``bg``, the image's modal colour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visparq import schema as S
from visparq.functions import color
from visparq.operators import kernels
from visparq.operators.histogram import near2


def labelled(images: DataFrame, threshold: int = S.INK_THRESHOLD) -> DataFrame:
    """Pixels further than the threshold from the modal colour, labelled by their 4-connected region's least index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                if not r["data"]:
                    continue
                img = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)
                keys = kernels.pack_rgb(img)
                bg = kernels.modal(keys.ravel())
                away = sum((img[..., k].astype(np.int32) - (bg >> s & 255)) ** 2 for k, s in enumerate((16, 8, 0)))
                labels = kernels.label4((mask := away > threshold**2).astype(np.int8), mask)
                y, x = np.nonzero(mask)
                n = len(y)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["image_id"])), pa.array(labels[y, x]), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(keys[y, x]), pa.array(np.full(n, bg, np.int32))], names=["image_id", "label", "y", "x", "key", "bg"])

    return images.select("image_id", "width", "height", "data").mapInArrow(run, "image_id long, label long, y int, x int, key int, bg int")


def colour_counts(found: DataFrame) -> DataFrame:
    """image_id, label, key, bg, n, first_y, first_x: the colours of each component."""
    return found.groupBy("image_id", "label", "key", "bg").agg(F.count("*").alias("n"), F.min(F.struct("y", "x")).alias("at")).select("image_id", "label", "key", "bg", "n", F.col("at.y").alias("first_y"), F.col("at.x").alias("first_x"))


def components(found: DataFrame, least: int = S.MIN_INK_AREA) -> DataFrame:
    """One row a component: its colour (the most distant one with two pixels, else the modal one), area, box, fill and form."""
    counts = colour_counts(found)
    order = F.struct("n", (-F.col("first_y")).alias("y"), (-F.col("first_x")).alias("x"))
    far = F.struct(near2(F.col("key"), F.col("bg")).alias("d2"), (-F.col("first_y")).alias("y"), (-F.col("first_x")).alias("x"))
    lead = counts.groupBy("image_id", "label", "bg").agg(F.coalesce(F.max_by(F.when(F.col("n") >= 2, F.col("key")), F.when(F.col("n") >= 2, far)), F.max_by("key", order)).alias("key"), F.sum("n").alias("area"))
    box = found.groupBy("image_id", "label").agg(F.min("x").alias("left"), F.min("y").alias("top"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"))
    own = lead.where(F.col("area") >= least).join(box, ["image_id", "label"])
    return own.withColumn("fill", F.floor(F.col("area") / (F.col("width") * F.col("height")) * 10000 + 0.5) / 10000).withColumns(shape_flags())


def shape_flags() -> dict[str, Column]:
    w, h, fill, n = (F.col(c) for c in ("width", "height", "fill", "area"))
    hollow = (w >= 60) & (h >= 60) & (fill < 0.25)
    line = ((w >= 60) & (h <= S.THIN_SIDE)) | ((h >= 60) & (w <= S.THIN_SIDE))
    return {"panel": (w >= 60) & (h >= 60) & (fill >= 0.5) & (n >= 2000), "structural": hollow | line}


def second_inks(found: DataFrame, floor: int = S.COLOUR_FLOOR, mean: int = S.SECOND_INK_MEAN) -> DataFrame:
    """Further colours of components that add up, over the whole image, to real inks: image_id, label, key, n, total, met.

    Totals come from one window over the small (component, colour) table: one shuffle, two phases.
    """
    counts, lead = colour_counts(found), components(found).select("image_id", "label", F.col("key").alias("lead"), "width", "height")
    area = found.groupBy("image_id").agg(((F.max("x") + 1) * (F.max("y") + 1)).alias("scan"))
    other = counts.join(lead, ["image_id", "label"]).where("key <> lead").join(area, "image_id")
    bg, own, first = (color.unpack(F.col(c)) for c in ("bg", "key", "lead"))
    blend = color.is_blend(own, first, bg, 0.0, 1.0) | color.is_blend(first, own, bg, 0.0, 1.0)
    w = Window.partitionBy("image_id", "key")
    marked = other.withColumn("blend", blend).withColumns({"total": F.sum("n").over(w), "met": F.count("*").over(w), "blended": F.sum(F.when(F.col("blend"), F.col("n")).otherwise(0)).over(w)})
    real = (F.col("total") >= floor) & ((F.col("blended") == 0) | (F.col("blended") >= S.BLEND_PIXELS)) & (F.col("total") >= mean * F.col("met"))
    return marked.where(real).select("image_id", "label", "key", "n", "total", "met")


def groups(found: DataFrame) -> DataFrame:
    """Components by colour: image_id, key, bg, pixels, pieces, structural, panels, fill_sum, d2."""
    own = components(found)
    return own.groupBy("image_id", "key", "bg").agg(F.sum("area").alias("pixels"), F.count("*").alias("pieces"), F.count_if("structural").alias("structural"), F.count_if("panel").alias("panels"), F.sum("fill").alias("fill_sum")).withColumn("d2", near2(F.col("key"), F.col("bg")))


def clusters(grouped: DataFrame, tolerance: int = S.CLUSTER_TOLERANCE) -> DataFrame:
    """Ordered fold of an image's colours: the larger first, each to the first cluster whose lead is within the tolerance;
    the more distant colour leads. Native: an aggregate over the sorted array of the image's colours."""
    state = "array<struct<key:int,d2:int,pixels:long,pieces:long>>"
    rows = grouped.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("pixels")).alias("o"), F.col("key").cast("int").alias("key"), F.col("d2").cast("int").alias("d2"), "pixels", "pieces"))).alias("g"))

    def step(acc: Column, g: Column) -> Column:
        near = F.array_position(F.transform(acc, lambda c: near2(c["key"], g["key"]) <= tolerance * tolerance), F.lit(True)).cast("int")
        alone = F.array_append(acc, F.struct(g["key"].alias("key"), g["d2"].alias("d2"), g["pixels"].alias("pixels"), g["pieces"].alias("pieces")))
        lead = lambda c, f: F.when(g["d2"] > c["d2"], g[f]).otherwise(c[f])
        joined = F.transform(acc, lambda c, k: F.when(k == near - 1, F.struct(lead(c, "key").alias("key"), F.greatest(c["d2"], g["d2"]).alias("d2"), (c["pixels"] + g["pixels"]).alias("pixels"), (c["pieces"] + g["pieces"]).alias("pieces"))).otherwise(c))
        return F.when(near > 0, joined).otherwise(alone)

    folded = rows.select("image_id", F.posexplode(F.aggregate("g", F.expr(f"CAST(array() AS {state})"), step)).alias("k", "c"))
    return folded.select("image_id", F.col("k").cast("long").alias("k"), F.col("c.key").cast("long").alias("key"), F.col("c.pixels").alias("pixels"), F.col("c.pieces").alias("pieces"))


def channels(grouped: DataFrame, areas: DataFrame, local: bool = False, floor: int = S.COLOUR_FLOOR, noise: float = S.NOISE_CEILING, region: float = S.REGION_CONTRAST) -> DataFrame:
    """image_id, key, channel, ratio, raw (the ratio unrounded): each colour in one channel, by the first rule that takes it."""
    ratio = color.contrast(color.luminance(*color.unpack(F.col("key"))), color.luminance(*color.unpack(F.col("bg"))))
    own = grouped.join(areas, "image_id").withColumns({"raw": ratio, "mean": F.col("pixels") / F.col("pieces")})
    independent = (F.col("pieces") >= S.TEXT_COMPONENTS) & (F.col("mean") >= S.TEXT_MEAN)
    wide = (F.col("raw") < region) & ((F.col("mean") / F.col("area") > S.REGION_SHARE) | ((F.col("pixels") / F.col("area") > S.REGION_SHARE) & (F.col("fill_sum") / F.col("pieces") >= S.REGION_FILL)))
    channel = F.when(F.col("structural") == F.col("pieces"), "excluded").when(F.col("pixels") < floor, "skipped").when(F.lit(local) & (F.col("raw") < noise) & ~independent, "suspected_noise").when(wide, "background_region").otherwise("evaluated")
    return own.select("image_id", F.col("key").cast("long").alias("key"), channel.alias("channel"), color.round2(F.col("raw")).alias("ratio"), "raw")


def verdicts(routed: DataFrame, required: float = 4.5) -> DataFrame:
    """Per image: worst, best, failing, passing, all_meet_aa (null without colours) and the verdict; judged before rounding."""
    taken, meets = F.col("channel") == "evaluated", F.col("raw") >= required - 1e-9
    own = routed.groupBy("image_id").agg(F.min(F.when(taken, F.col("ratio"))).alias("worst"), F.max(F.when(taken, F.col("ratio"))).alias("best"), F.count_if(taken & ~meets).alias("failing"), F.count_if(taken & meets).alias("passing"), F.bool_and(F.when(taken, meets)).alias("all_meet_aa"))
    return own.withColumn("verdict", F.when(F.col("all_meet_aa").isNull(), "unverified").when(F.col("all_meet_aa"), "clean").otherwise("failing"))
