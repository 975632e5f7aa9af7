"""SVG overlays from annotations, prompts, footers and diagnoses: strings built per row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visparq.functions import color
from visparq.functions.text import escape_xml

#: The SVG of each kind of annotation; ``{name}`` is a number, ``{:name}`` a text.
SHAPES = {
    "label": '<rect x="{x}" y="{ty}" width="{tw}" height="{th}" fill="rgba({:rgb},0.85)" rx="3"/><text x="{lx}" y="{y}" font-family="DejaVu Sans, sans-serif" font-size="{size}" fill="white">{:said}</text>',
    "box": '<rect x="{x}" y="{y}" width="{w}" height="{h}" fill="none" stroke="{:paint}" stroke-width="3" rx="2"/>',
    "circle": '<circle cx="{x}" cy="{y}" r="{r}" fill="none" stroke="{:paint}" stroke-width="3"/>',
    "arrow": '<line x1="{x}" y1="{y}" x2="{bx}" y2="{by}" stroke="{:paint}" stroke-width="3" stroke-linecap="round"/><polygon points="{ex},{ey} {p1x},{p1y} {p2x},{p2y}" fill="{:paint}" stroke="none"/>',
}


def number(x: Column) -> Column:
    """A double as short as it goes: whole numbers without a point, others with six decimals at most."""
    whole = F.abs(x - F.floor(x)) < 1e-9
    return F.when(whole, F.floor(x).cast("string")).otherwise(F.regexp_replace(F.format_string("%.6f", x), r"0+$", ""))


def shapes(annotations: DataFrame) -> DataFrame:
    """Adds ``shape``, the SVG of one annotation, null where nothing is drawn. Zero and missing numbers take their defaults.

    Numbers are settled in a first projection and directions in a second, so that the strings only refer to columns.
    """
    num = lambda c, default: F.when((F.col(c) == 0) | F.col(c).isNull(), float(default)).otherwise(F.col(c).cast("double"))
    r, g, b = color.annotation_rgb(F.col("color"))
    own = annotations.withColumns(
        {"_k": F.lower("type"), "_x": num("x", 0), "_y": num("y", 0), "_size": F.greatest(F.lit(10.0), F.least(F.lit(72.0), num("font_size", 16))), "_w": F.greatest(F.lit(1.0), num("width", 50)), "_h": F.greatest(F.lit(1.0), num("height", 50)), "_r": F.greatest(F.lit(1.0), num("width", 25)), "_paint": F.coalesce("color", F.lit("#FF0000")), "_rgb": F.concat_ws(",", r.cast("string"), g.cast("string"), b.cast("string")), "_said": escape_xml(F.col("text")), "_tx": num("target_x", 0), "_ty": num("target_y", 0)}
    )
    own = own.withColumns({"_ex": F.when(F.col("_tx") == 0, F.col("_x") + 50).otherwise(F.col("_tx")), "_ey": F.when(F.col("_ty") == 0, F.col("_y") + 50).otherwise(F.col("_ty"))})
    own = own.withColumn("_len", F.sqrt((F.col("_ex") - F.col("_x")) * (F.col("_ex") - F.col("_x")) + (F.col("_ey") - F.col("_y")) * (F.col("_ey") - F.col("_y"))))
    own = own.withColumns({"_ux": (F.col("_ex") - F.col("_x")) / F.greatest("_len", F.lit(1.0)), "_uy": (F.col("_ey") - F.col("_y")) / F.greatest("_len", F.lit(1.0))})
    own = own.withColumns({"_bx": F.col("_ex") - F.col("_ux") * 12, "_by": F.col("_ey") - F.col("_uy") * 12})
    c = {k: F.col(f"_{k}") for k in ("x", "y", "size", "w", "h", "r", "ex", "ey", "bx", "by", "ux", "uy")}
    # Every number as text, by one function over one array: little code is generated, however many numbers there are.
    values = {"x": c["x"], "y": c["y"], "size": c["size"], "w": c["w"], "h": c["h"], "r": c["r"], "ex": c["ex"], "ey": c["ey"], "bx": c["bx"], "by": c["by"], "ty": c["y"] - c["size"] + 2, "tw": F.greatest(F.lit(1.0), F.floor(F.length("_said") * c["size"] * 0.6 + 10 + 0.5).cast("double")), "th": c["size"] + 4, "lx": c["x"] + 5, "p1x": c["bx"] - c["uy"] * 7.2, "p1y": c["by"] + c["ux"] * 7.2, "p2x": c["bx"] + c["uy"] * 7.2, "p2y": c["by"] - c["ux"] * 7.2}
    place = {k: n for n, k in enumerate(values)}
    own = own.select(*annotations.columns, "_k", "_len", "_paint", "_rgb", "_said", F.transform(F.array(*values.values()), number).alias("_s"))

    def svg(template: str) -> Column:
        """Text with ``{name}`` for a number and ``{:name}`` for a string column."""
        parts = re.split(r"\{(:?\w+)\}", template)
        return F.concat(*(F.lit(p) if k % 2 == 0 else F.col(f"_{p[1:]}") if p[0] == ":" else F.get("_s", F.lit(place[p])) for k, p in enumerate(parts)))

    label, box, circle, arrow = (svg(SHAPES[n]) for n in ("label", "box", "circle", "arrow"))
    k = F.col("_k")
    drawn = F.when((k == "label") & (F.trim("text") != ""), label).when(k.isin("box", "rectangle"), box).when(k == "circle", circle).when((k == "arrow") & (F.col("_len") >= 1), arrow)
    return own.select(*annotations.columns, drawn.alias("shape"))


def overlay(annotations: DataFrame) -> DataFrame:
    """image_id, svg: annotations (image_id, ord, image_width, image_height, type, ...) in order; images without a shape dropped."""
    # Shapes that draw nothing are dropped by the aggregate: a filter on them would be pushed down, and the strings built twice.
    drawn = F.collect_list(F.when(F.col("shape").isNotNull(), F.struct("ord", "shape")))
    rows = shapes(annotations).groupBy("image_id", "image_width", "image_height").agg(F.sort_array(drawn).alias("drawn")).where(F.size("drawn") > 0)
    rows = rows.withColumn("body", F.array_join(F.transform("drawn", lambda s: s["shape"]), ""))
    return rows.select("image_id", F.concat(F.lit('<svg width="'), "image_width", F.lit('" height="'), "image_height", F.lit('" xmlns="http://www.w3.org/2000/svg">'), "body", F.lit("</svg>")).alias("svg"))


def footer(model: Column, ttft_ms: Column, total_ms: Column, width: Column, height: Column, downscaled: Column) -> Column:
    """A provenance line; parts that are null are left out."""
    return F.concat_ws(" | ", F.concat(F.lit("model: "), model), F.concat(F.lit("ttft: "), ttft_ms.cast("string"), F.lit("ms")), F.concat(F.lit("total: "), total_ms.cast("string"), F.lit("ms")), F.concat(F.lit("image: "), width.cast("string"), F.lit("x"), height.cast("string"), F.when(F.coalesce(downscaled, F.lit(False)), " (downscaled)").otherwise("")))


def prompt(task: str, subject: Column, detail: Column | None = None) -> Column:
    """A task prompt under the common preamble: report only what is visible, abstain rather than guess."""
    preamble = "Report only what is visible in the image. If something cannot be determined, say so instead of guessing.\n"
    tasks = {"describe": "Describe: ", "transcribe": "Transcribe exactly, without correcting: ", "detect": "List as JSON, each with a box: ", "compare": "Compare, differences only: ", "screenshot": "Analyse this screen: "}
    return F.concat_ws("", F.lit(preamble + tasks[task]), subject, *([F.concat(F.lit("\nFocus: "), detail)] if detail is not None else []))


def timeout_diagnosis(model: Column, loaded: Column, first_token_ms: Column, window_ms: int) -> Column:
    """'inference' if the model was resident, 'contention' if others were, else 'cold'; with the speed of the first token."""
    resident = F.exists(loaded, lambda m: m["name"] == model)
    slow = F.when(first_token_ms.isNull() | (first_token_ms > window_ms), "slow").otherwise("quick")
    return F.when(resident, F.concat(F.lit("inference:"), slow)).when(F.size(loaded) > 0, F.concat(F.lit("contention:"), F.array_join(F.transform(loaded, lambda m: F.concat(m["name"], F.format_string(" %.1fGB", m["size_vram"] / 1e9))), ", "))).otherwise("cold")
