"""Rasters: decoding, the exploded pixel view, embeddings as small rasters, and font-free fixtures.

An image is one row (``visparq.schema.IMAGES``). Operators that only count explode it to pixels, where Catalyst prunes and
pushes down; operators that need neighbours stay on the image row, so no pixel is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visparq import schema as S
from visparq import workers


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """PNG, JPEG, GIF or BMP files as images (alpha dropped, RGB order). Undecodable files give null dimensions."""
    raw = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")

    def to_rgb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            data, ok = [], []
            for r in rows:
                ok.append(r["height"] > 0)
                bgr = np.frombuffer(r["data"] or b"", np.uint8).reshape(max(r["height"], 0), -1, max(r["nChannels"], 1)) if ok[-1] else None
                data.append(None if bgr is None else (bgr[..., 2::-1] if bgr.shape[2] >= 3 else np.repeat(bgr[..., :1], 3, 2)).tobytes())
            pick = lambda n: [r[n] if k else None for r, k in zip(rows, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r["origin"] for r in rows]), pa.array(pick("width"), pa.int32()), pa.array(pick("height"), pa.int32()), pa.array(data, pa.binary())], names=["path", "width", "height", "data"])

    return raw.mapInArrow(to_rgb, "path string, width int, height int, data binary").withColumn("image_id", F.xxhash64("path"))


def parts(batches: Iterator[pa.RecordBatch], factor: int = 1, most: int = workers.BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of images cut so that ``factor`` times their data stays within ``most`` bytes, an image at least."""
    for b in batches:
        size = pa.compute.fill_null(pa.compute.binary_length(b.column("data")), 0).to_numpy(zero_copy_only=False).astype(np.int64) * factor
        end, at = np.cumsum(size), 0
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + most, side="right")))
            yield b.slice(at, upto - at)
            at = upto


def byte_at(data: Column, offset: Column) -> Column:
    """The unsigned byte at a 0-based offset."""
    return F.conv(F.hex(F.substring(data, offset + 1, F.lit(1))), 16, 10).cast("int")


def explode_pixels(images: DataFrame) -> DataFrame:
    """image_id, x, y, r, g, b: one row a pixel, in scan order within an image."""
    cells = images.select("image_id", "width", "data", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))
    at = lambda c: F.conv(F.hex(F.substr("data", F.col("i") * 3 + c + 1, F.lit(1))), 16, 10).cast("int")
    return cells.select("image_id", (F.col("i") % F.col("width")).cast("int").alias("x"), F.expr("CAST(i div width AS INT)").alias("y"), at(0).alias("r"), at(1).alias("g"), at(2).alias("b"))


def level(v: Column, steps: int) -> Column:
    """A float around -0.5..0.5 as an integer level."""
    return F.floor((v.cast("double") + 0.5) * steps).cast("int")


def embedding_gray(embeddings: DataFrame) -> DataFrame:
    """64 values as an 8 x 8 raster of levels: image_id, x, y, q."""
    cells = embeddings.select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v"))
    return cells.select("image_id", (F.col("i") % 8).cast("int").alias("x"), F.expr("CAST(i div 8 AS INT)").alias("y"), level(F.col("v"), 4).alias("q"))


def embedding_rgb(embeddings: DataFrame) -> DataFrame:
    """63 values as a 7 x 3 raster of coarse colours: image_id, x, y, r, g, b."""
    channel = lambda v: F.greatest(F.lit(0), F.least(F.lit(3), level(v, 4))) * 85
    cell = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(i.alias("i"), *(channel(F.get("embedding", i * 3 + k)).cast("int").alias(c) for k, c in enumerate("rgb"))))
    return embeddings.select(F.col("vec_id").alias("image_id"), F.explode(cell).alias("p")).select("image_id", (F.col("p.i") % 7).cast("int").alias("x"), F.expr("CAST(p.i div 7 AS INT)").alias("y"), "p.r", "p.g", "p.b")


def embedding_images(embeddings: DataFrame) -> DataFrame:
    """The gray rasters as image rows: each channel is 60 times the level."""
    gray = F.transform("embedding", lambda v: F.lpad(F.hex((F.greatest(F.lit(0), F.least(F.lit(4), level(v, 4))) * 60).cast("long")), 2, "0"))
    data = F.unhex(F.array_join(F.transform(gray, lambda h: F.concat(h, h, h)), ""))
    return embeddings.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.expr("CAST(size(embedding) div 8 AS INT)").alias("height"), data.alias("data"))


def paint(width: int, height: int, page: str, rects: list[tuple[int, int, int, int, str]]) -> np.ndarray:
    """A raster from rectangles (x, y, w, h, colour), later ones over earlier ones, clipped to the frame."""
    rgb = lambda s: [int(s[k : k + 2], 16) for k in (1, 3, 5)]
    out = np.empty((height, width, 3), np.uint8)
    out[:] = rgb(page)
    for x, y, w, h, c in rects:
        out[max(0, y) : y + h, max(0, x) : x + w] = rgb(c)
    return out


def images_of(spark: SparkSession, rasters: list[np.ndarray]) -> DataFrame:
    return spark.createDataFrame([(k, r.shape[1], r.shape[0], r.tobytes()) for k, r in enumerate(rasters)], S.IMAGES)
