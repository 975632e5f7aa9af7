"""Colour histograms and what follows from them. Input: pixels (image_id, x, y, r, g, b)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visparq import schema as S
from visparq import workers
from visparq.functions import color
from visparq.operators import kernels


def histogram(pixels: DataFrame) -> DataFrame:
    """image_id, key, n, first_y, first_x (the first appearance in scan order breaks ties)."""
    keyed = pixels.select("image_id", color.pack(F.col("r"), F.col("g"), F.col("b")).alias("key"), F.struct("y", "x").alias("at"))
    return keyed.groupBy("image_id", "key").agg(F.count("*").alias("n"), F.min("at").alias("at")).select("image_id", "key", "n", F.col("at.y").alias("first_y"), F.col("at.x").alias("first_x"))


def of_images(images: DataFrame) -> DataFrame:
    """The histogram of whole images, counted where an image's row lies: only distinct colours leave it, no pixel is a row."""
    workers.bounded(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                if r["data"] and r["width"]:
                    key, first, n = kernels.counted(kernels.pack_rgb(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)).ravel())
                    yield pa.RecordBatch.from_arrays([pa.array([r["image_id"]] * len(key), pa.int64()), pa.array(key, pa.int32()), pa.array(n, pa.int64()), pa.array(first // r["width"], pa.int32()), pa.array(first % r["width"], pa.int32())], names=["image_id", "key", "n", "y", "x"])

    own = images.select("image_id", "width", "height", "data").mapInArrow(run, "image_id long, key int, n long, y int, x int")
    merged = own.groupBy("image_id", "key").agg(F.sum("n").alias("n"), F.min(F.struct("y", "x")).alias("at"))
    return merged.select("image_id", "key", "n", F.col("at.y").alias("first_y"), F.col("at.x").alias("first_x"))


def dominant(hist: DataFrame, k: int = 8) -> DataFrame:
    """The k most frequent colours of each image with rank and share in percent (two decimals)."""
    w = Window.partitionBy("image_id").orderBy(F.desc("n"), "first_y", "first_x")
    whole = Window.partitionBy("image_id")
    ranked = hist.withColumns({"rank": F.row_number().over(w), "total": F.sum("n").over(whole)}).where(F.col("rank") <= k)
    r, g, b = color.unpack(F.col("key"))
    return ranked.select("image_id", "rank", color.to_hex(r, g, b).alias("hex"), "n", color.round2(F.col("n") * 100.0 / F.col("total")).alias("share"))


def most_frequent(image: np.ndarray, k: int = 8) -> list[dict]:
    """key and n of the k most frequent colours of one raster; ties go to the one seen first."""
    key, first, n = kernels.counted(kernels.pack_rgb(image).ravel())
    top = np.lexsort((first, -n))[:k]
    return [{"key": c, "n": m} for c, m in zip(key[top].tolist(), n[top].tolist(), strict=True)]


def background(hist: DataFrame) -> DataFrame:
    """image_id, key: the modal colour."""
    return hist.groupBy("image_id").agg(F.max_by("key", F.struct("n", (-F.col("first_y")).alias("y"), (-F.col("first_x")).alias("x"))).alias("key"))


def near2(key: Column, other: Column) -> Column:
    return color.distance2(color.unpack(key), color.unpack(other))


def background_fit(hist: DataFrame, tolerance: int = S.FIT_TOLERANCE) -> DataFrame:
    """Share of pixels within the tolerance of the modal colour; adequate from half on (unrounded), marginal under 0.8."""
    # The right side is one row an image: its size follows the images, so the join is left to the planner.
    joined = hist.join(background(hist).withColumnRenamed("key", "mode"), "image_id")
    own = joined.groupBy("image_id", "mode").agg(F.sum(F.when(near2(F.col("key"), F.col("mode")) <= tolerance**2, F.col("n")).otherwise(0)).alias("near"), F.sum("n").alias("total"))
    share = F.col("near") / F.col("total")
    rounded = F.floor(share * 1000 + 0.5) / 1000
    return own.select("image_id", rounded.alias("fraction"), (share >= S.ADEQUATE_FIT).alias("adequate"), ((share >= S.ADEQUATE_FIT) & (rounded < S.GOOD_FIT)).alias("marginal"))


def non_background(hist: DataFrame, tolerance: int = S.BOX_TOLERANCE) -> DataFrame:
    """Percentage of pixels further than the tolerance from the modal colour."""
    joined = hist.join(background(hist).withColumnRenamed("key", "mode"), "image_id")
    own = joined.groupBy("image_id").agg(F.sum(F.when(near2(F.col("key"), F.col("mode")) > tolerance**2, F.col("n")).otherwise(0)).alias("off"), F.sum("n").alias("total"))
    return own.select("image_id", color.round2(F.col("off") * 100.0 / F.col("total")).alias("ratio"))


def nearest(hist: DataFrame, palette: DataFrame) -> DataFrame:
    """Each colour's nearest palette entry of its image (first by ``ord`` on ties). ``palette``: image_id, ord, other."""
    listed = palette.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("ord", "other"))).alias("palette"))
    best = F.array_min(F.transform("palette", lambda p: F.struct(near2(F.col("key"), p["other"]).alias("d2"), p["ord"].alias("ord"), p["other"].alias("other"))))
    return hist.join(listed, "image_id").select("image_id", "key", best.alias("best")).select("image_id", "key", F.col("best.other").alias("nearest"), F.col("best.d2").alias("d2"))


def ink_mask(pixels: DataFrame, modes: DataFrame, threshold: int = S.INK_THRESHOLD) -> DataFrame:
    """Pixels further than the threshold from the image's single background."""
    key = color.pack(F.col("r"), F.col("g"), F.col("b"))
    return pixels.join(modes.withColumnRenamed("key", "mode"), "image_id").where(near2(key, F.col("mode")) > threshold**2).drop("mode")


def color_mask(pixels: DataFrame, target: tuple[int, int, int], tolerance: int = S.BOX_TOLERANCE) -> DataFrame:
    """Pixels within the tolerance of a colour."""
    return pixels.where(color.distance2((F.col("r"), F.col("g"), F.col("b")), tuple(F.lit(c) for c in target)) <= tolerance**2)


def diff(before: DataFrame, after: DataFrame, threshold: int = 15) -> DataFrame:
    """image_id, changed, total, ratio ('1.23%'): pixels whose channels differ by more than three thresholds in sum."""
    delta = sum((F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in "gb"), F.abs(F.col("a.r") - F.col("b.r")))
    both = before.alias("a").join(after.alias("b"), ["image_id", "x", "y"])
    own = both.groupBy("image_id").agg(F.count_if(delta > 3 * (threshold or 15)).alias("changed"), F.count("*").alias("total"))
    return own.select("image_id", "changed", "total", F.format_string("%.2f%%", color.round2(F.col("changed") * 100.0 / F.col("total"))).alias("ratio"))


def tile_background(pixels: DataFrame, tile: int) -> DataFrame:
    """image_id, tx, ty, mr, mg, mb (upper medians) and sigma: the median absolute deviation, about their own median, of the
    pixels' distances to them, scaled to a standard deviation (upper medians too).

    A tile is at most tile * tile pixels, so its list is bounded; everything after it is array functions, nothing is joined.
    """
    placed = pixels.select("image_id", F.expr(f"x div {tile}").alias("tx"), F.expr(f"y div {tile}").alias("ty"), F.struct("r", "g", "b").alias("p"))
    tiles = placed.groupBy("image_id", "tx", "ty").agg(F.collect_list("p").alias("px"))
    upper = lambda a: F.get(F.sort_array(a), F.expr("CAST(size(px) div 2 AS INT)"))
    middle = tiles.select("*", *(upper(F.col(f"px.{c}")).alias(f"m{c}") for c in "rgb"))
    away = middle.withColumn("d", F.transform("px", lambda p: F.sqrt(color.distance2(tuple(p[c] for c in "rgb"), tuple(F.col(f"m{c}") for c in "rgb")).cast("double"))))
    centred = away.withColumn("md", upper(F.col("d")))
    return centred.select("image_id", "tx", "ty", "mr", "mg", "mb", (upper(F.transform("d", lambda v: F.abs(v - F.col("md")))) * S.MAD_SCALE).alias("sigma"))


def tile_interpolation(pixels: DataFrame, tiles: DataFrame, tile: int) -> DataFrame:
    """Each pixel's background: bilinear between the four nearest tile centres, and the largest of their sigmas.

    The tiles travel as one array an image (tiles are few), so pixels are not joined four times.
    """
    grid = tiles.groupBy("image_id").agg(F.max("tx").alias("nx"), F.max("ty").alias("ny"), F.map_from_entries(F.collect_list(F.struct(F.struct("tx", "ty"), F.struct("mr", "mg", "mb", "sigma")))).alias("grid"))
    fx, fy = F.col("x") / tile - 0.5, F.col("y") / tile - 0.5
    x0, y0 = F.floor(fx), F.floor(fy)
    clip = lambda v, n: F.greatest(F.lit(0), F.least(F.col(n), v)).cast("int")
    tx = fx - x0
    ty = fy - y0
    joined = pixels.join(grid, "image_id").withColumns({"wx": tx, "wy": ty, "xa": clip(x0, "nx"), "xb": clip(x0 + 1, "nx"), "ya": clip(y0, "ny"), "yb": clip(y0 + 1, "ny")})
    got = lambda a, b: F.element_at("grid", F.struct(F.col(a).cast("int").alias("tx"), F.col(b).cast("int").alias("ty")))
    corner = joined.withColumns({"p": got("xa", "ya"), "q": got("xb", "ya"), "s": got("xa", "yb"), "t": got("xb", "yb")})
    mix = lambda c: (F.col(f"p.{c}") * (1 - F.col("wx")) + F.col(f"q.{c}") * F.col("wx")) * (1 - F.col("wy")) + (F.col(f"s.{c}") * (1 - F.col("wx")) + F.col(f"t.{c}") * F.col("wx")) * F.col("wy")
    return corner.select("image_id", "x", "y", "r", "g", "b", *(mix(f"m{c}").alias(f"b{c}") for c in "rgb"), F.greatest("p.sigma", "q.sigma", "s.sigma", "t.sigma").alias("sigma"))


def ink_mask_local(interpolated: DataFrame, threshold: int = S.INK_THRESHOLD, k: float = S.NOISE_K) -> DataFrame:
    """Pixels further from their local background than the threshold and k sigmas."""
    d = F.sqrt(color.distance2((F.col("r"), F.col("g"), F.col("b")), (F.col("br"), F.col("bg"), F.col("bb"))))
    return interpolated.where(d > F.greatest(F.lit(float(threshold)), k * F.col("sigma"))).select("image_id", "x", "y", "r", "g", "b")


def in_region(pixels: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    """Pixels of a region; coordinates stay those of the image."""
    return pixels.where((F.col("x") >= left) & (F.col("x") < left + width) & (F.col("y") >= top) & (F.col("y") < top + height))


def palette_of(palette: DataFrame) -> DataFrame:
    """image_id, palette: the entries (image_id, ord, other) of an image as one ordered array."""
    return palette.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("ord", "other"))).alias("palette"))


def ink_mask_plateaus(pixels: DataFrame, palette: DataFrame, threshold: int = S.INK_THRESHOLD) -> DataFrame:
    """Pixels that are within the threshold of none of their image's plateaus."""
    key = color.pack(F.col("r"), F.col("g"), F.col("b"))
    joined = pixels.withColumn("key", key).join(palette_of(palette), "image_id", "left")
    return joined.where(~F.coalesce(F.exists("palette", lambda p: near2(F.col("key"), p["other"]) <= threshold**2), F.lit(False))).drop("palette", "key")


def first_near(hist: DataFrame, palette: DataFrame, reach: int = S.PLATEAU_MERGE) -> DataFrame:
    """image_id, key and the first palette entry within reach, null if none."""
    joined = hist.join(palette_of(palette), "image_id")
    met = F.filter("palette", lambda p: near2(F.col("key"), p["other"]) <= reach * reach)
    return joined.select("image_id", "key", F.get(met, F.lit(0))["other"].alias("plateau"))


def ink_thresholds(interpolated: DataFrame, threshold: int = S.INK_THRESHOLD, k: float = S.NOISE_K, first: int = 4096) -> DataFrame:
    """image_id, effective (largest) and median (upper) ink threshold of an image's first pixels in scan order."""
    w = Window.partitionBy("image_id").orderBy("y", "x")
    own = interpolated.select("image_id", F.greatest(F.lit(float(threshold)), k * F.col("sigma")).alias("t"), F.row_number().over(w).alias("n")).where(F.col("n") <= first)
    return own.groupBy("image_id").agg(F.max("t").alias("effective"), F.sort_array(F.collect_list("t"))[F.expr("CAST(count(*) div 2 AS INT)")].alias("median"))


def shade_bands(failing: DataFrame, masked: DataFrame) -> DataFrame:
    """Failing colours (image_id, key, bg, mean) on the line from the background to a masked colour (image_id, ord, other):
    'shade' under 25 pixels a piece, 'text' from 100 on, 'ambiguous' between; null for colours on no such line."""
    joined = failing.join(palette_of(masked), "image_id", "left")
    on = F.coalesce(F.exists("palette", lambda m: color.is_blend(color.unpack(F.col("key")), color.unpack(m["other"]), color.unpack(F.col("bg")), 0.0, 1.0)), F.lit(False))
    band = F.when(F.col("mean") < S.TEXT_MEAN / 4, "shade").when(F.col("mean") >= S.TEXT_MEAN, "text").otherwise("ambiguous")
    return joined.select("image_id", "key", F.when(on, band).alias("band"))
