"""Connected components and boxes. One image is one row, labelled where it lies: nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visparq import schema as S
from visparq import workers
from visparq.operators import kernels

FIELDS = ("label", "area", "left", "top", "width", "height", "cx", "cy", "hole")
ROW = "image_id long, " + ", ".join(f"{f} long" for f in FIELDS) + ", truncated boolean"


def components(images: DataFrame, target: tuple[int, int, int], tolerance: int = S.BOX_TOLERANCE, least: int = S.MASK_AREA, most: int = S.MASK_COMPONENTS) -> DataFrame:
    """Regions of the pixels within the tolerance of a colour: label (least index y * width + x), area, box, centroid, hole.

    The cap counts regions in scan order, as they are met, and is disclosed in ``truncated``.
    """
    workers.bounded(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("image_id", *FIELDS, "truncated")}
            for r in b.to_pylist():
                if not r["data"]:
                    continue
                own, cut = regions(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3), target, tolerance, least, most)
                for region in own:
                    for c, v in zip(("image_id", *FIELDS, "truncated"), (r["image_id"], *region, cut), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.bool_() if k == "truncated" else pa.int64()) for k, v in out.items()], names=list(out))

    return images.select("image_id", "width", "height", "data").mapInArrow(run, ROW)


def regions(image: np.ndarray, target: tuple[int, int, int], tolerance: int, least: int, most: int) -> tuple[list[tuple], bool]:
    """FIELDS of one image's regions, and whether there are more than ``most``."""
    mask = ((image.astype(np.int64) - np.array(target)) ** 2).sum(-1) <= tolerance**2
    labels = kernels.label4(mask.astype(np.int8), mask)
    box = kernels.boxes_of(labels)
    keep, out = np.flatnonzero(box["area"] >= least), []
    for k in keep[:most]:
        x, y, w, h = (int(box[c][k]) for c in ("left", "top", "width", "height"))
        hole = kernels.enclosed_hole(labels[y : y + h, x : x + w] == box["label"][k])
        n = int(box["area"][k])
        out.append((int(box["label"][k]), n, x, y, w, h, int(np.floor(box["sum_x"][k] / n + 0.5)), int(np.floor(box["sum_y"][k] / n + 0.5)), hole))
    return out, len(keep) > most


def boxes(found: DataFrame, width: int = S.BOX_WIDTH, height: int = S.BOX_HEIGHT) -> DataFrame:
    """Components of a size, in reading order, named box_1, box_2, ..."""
    w = Window.partitionBy("image_id").orderBy("top", "left", "label")
    named = found.where((F.col("width") >= width) & (F.col("height") >= height)).withColumn("k", F.row_number().over(w))
    return named.select("image_id", F.concat(F.lit("box_"), F.col("k").cast("string")).alias("box_id"), "left", "top", "width", "height", "area")


def owner(points: DataFrame, rects: DataFrame) -> DataFrame:
    """point_id and the first rectangle (by ``ord``) of its image that holds it, or null; an equi-join on the image first."""
    inside = (F.col("p.x") >= F.col("r.left")) & (F.col("p.x") < F.col("r.left") + F.col("r.width")) & (F.col("p.y") >= F.col("r.top")) & (F.col("p.y") < F.col("r.top") + F.col("r.height"))
    met = points.alias("p").join(rects.alias("r"), (F.col("p.image_id") == F.col("r.image_id")) & inside, "left")
    return met.groupBy("p.image_id", "p.point_id").agg(F.min("r.ord").alias("owner"))
