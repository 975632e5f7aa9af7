"""Boxes, regions, legibility and sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visparq import schema as S


def clamp_region(left: Column, top: Column, width: Column, height: Column, w: Column, h: Column) -> dict[str, Column]:
    """Floored and clamped into the frame, one pixel at least; missing parts mean the whole frame."""
    x = F.greatest(F.lit(0), F.least(w - 1, F.floor(F.coalesce(left, F.lit(0)))))
    y = F.greatest(F.lit(0), F.least(h - 1, F.floor(F.coalesce(top, F.lit(0)))))
    return {"left": x, "top": y, "width": F.greatest(F.lit(1), F.least(w - x, F.floor(F.coalesce(width, w)))), "height": F.greatest(F.lit(1), F.least(h - y, F.floor(F.coalesce(height, h))))}


def overlap_share(crop: tuple, box: tuple) -> Column:
    """Share of the box within the crop; (left, top, width, height) each, missing parts 0, area 1 at least."""
    c, b = (tuple(F.coalesce(v, F.lit(0)) for v in t) for t in (crop, box))
    side = lambda k: F.greatest(F.lit(0), F.least(c[k] + c[k + 2], b[k] + b[k + 2]) - F.greatest(c[k], b[k]))
    return side(0) * side(1) / F.greatest(F.lit(1), b[2] * b[3])


def inside_crop(crop: tuple, box: tuple, least: float = 0.5) -> Column:
    return overlap_share(crop, box) >= least


def legibility(width: Column, height: Column) -> dict[str, Column]:
    short, total = F.least(width, height), width * height
    low, few = short < S.LEGIBLE_SIDE, total < S.LEGIBLE_PIXELS
    return {"short_side": short, "total_pixels": total, "legible": ~low & ~few, "n_warnings": low.cast("int") + few.cast("int")}


def offset_box(box: tuple, dx: Column, dy: Column) -> tuple:
    return box[0] + dx, box[1] + dy, box[2], box[3]


def tiles(width: Column, height: Column, cols: int = 2, rows: int = 2, overlap: float = 0.1) -> Column:
    """Array of (row, col, left, top, width, height) tiles with overlap, clipped to the frame."""
    overlap = max(0.0, min(0.5, overlap))
    tw, th = F.ceil(width / cols), F.ceil(height / rows)
    px, py = F.floor(tw * overlap + 0.5), F.floor(th * overlap + 0.5)
    cells = []
    for row in range(rows):
        for col in range(cols):
            left, top = F.greatest(F.lit(0), col * tw - px), F.greatest(F.lit(0), row * th - py)
            cells.append(F.struct(F.lit(row).alias("row"), F.lit(col).alias("col"), left.alias("left"), top.alias("top"), F.least(width - left, tw + px * 2).alias("width"), F.least(height - top, th + py * 2).alias("height")))
    return F.filter(F.array(*cells), lambda t: (t["width"] > 0) & (t["height"] > 0))


def diff_size(w1: Column, h1: Column, w2: Column, h2: Column) -> dict[str, Column]:
    """Common size of two images: like aspects keep the smaller width, others the mean aspect at most 400 wide."""
    a1, a2 = w1 / h1, w2 / h2
    like = F.abs(a1 - a2) < 0.1
    width = F.when(like, F.least(w1, w2)).otherwise(F.least(w1, w2, F.lit(400)))
    aspect = F.when(like, a1).otherwise((a1 + a2) / 2)
    return {"width": width, "height": F.floor(width / aspect + 0.5)}


def fit_inside(width: Column, height: Column, limit: int) -> dict[str, Column]:
    """Metadata of a downscale to ``limit`` on the long side: never enlarged."""
    scale = F.least(F.lit(1.0), limit / F.greatest(width, height))
    return {"width": F.greatest(F.lit(1), F.floor(width * scale + 0.5)), "height": F.greatest(F.lit(1), F.floor(height * scale + 0.5)), "scale": scale, "downscaled": scale < 1.0}


def crop_error(left: Column, top: Column, width: Column, height: Column, w: Column, h: Column) -> Column:
    """Why an exact crop is refused, or null: it must lie within the frame (unlike ``clamp_region``)."""
    return F.when((width <= 0) | (height <= 0), "size").when((left < 0) | (top < 0), "origin").when((left + width > w) | (top + height > h), "bounds")
