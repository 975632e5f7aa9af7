"""The two composite questions: measure an image, and answer a prompt from measurement or from a checked model reply."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from visparq import schema as S
from visparq import workers
from visparq.functions import color, geometry, text
from visparq.operators import components, contrast, evidence, histogram, jsonx
from visparq.sources import rasters

MODES = ("contrast", "colors", "boxes", "layout", "all")
MODEL_FREE = "computed by pixel maths; no model was involved"
#: So much of the images' data is looked at before its results are sent: they follow the colours, so the pixels, not the rows.
PART_BYTES = 64 << 10


def measure_image(images: DataFrame, mode: str = "all", box_color: tuple[int, int, int] | None = None, options: contrast.Options = contrast.Options(), enlarge: int = 1) -> DataFrame:
    """image_id, dimensions, contrast, colors, boxes, layout, abstained, provenance. Only what the mode asks for is planned.
    Images are measured with each pixel as a square of ``enlarge`` pixels to a side."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    want = lambda m: mode in (m, "all")
    out = _measured(images, options if want("contrast") else None, want("colors"), box_color if want("boxes") else None, enlarge)
    out = out.withColumn("dimensions", F.struct("width", "height"))
    kept, abstained = ["image_id", "dimensions"], []
    if want("contrast"):
        kept.append("contrast")
        abstained.append(F.when(~F.col("contrast.measurable"), F.element_at("contrast.abstained", 1)))
    if want("colors"):
        kept.append("colors")
        share = lambda c: color.round2(c["n"] * 100.0 / F.col("total"))
        out = out.withColumn("colors", F.transform("top", lambda c, k: F.struct((k + 1).alias("rank"), color.to_hex(*color.unpack(c["key"])).alias("hex"), c["n"].alias("n"), share(c).alias("share"))))
    if want("boxes") and box_color:
        kept.append("boxes")
    elif want("boxes"):
        abstained.append(F.lit("box count: no border colour was given"))
    if want("layout"):
        kept.append("layout")
        legible = geometry.legibility(F.col("width"), F.col("height"))
        out = out.withColumn("layout", F.struct(F.col("width"), F.col("height"), color.round2(F.col("width") / F.col("height")).alias("aspect_ratio"), legible["legible"].alias("legible"), legible["n_warnings"].alias("n_warnings")))
    noted = F.array_compact(F.array(*abstained)) if abstained else F.expr("CAST(array() AS array<string>)")
    return out.select(*kept, noted.alias("abstained"), F.lit(MODEL_FREE).alias("provenance"))


def _measured(images: DataFrame, options: contrast.Options | None, colors: bool, box_color: tuple[int, int, int] | None, enlarge: int) -> DataFrame:
    """image_id, width, height and what is asked for of ``contrast``, ``top`` and ``total`` (the most frequent colours, all
    pixels) and ``boxes``, in one pass over the images: each is enlarged, looked at and dropped where its row lies, so no
    raster is sent twice and nothing is joined. Results leave a part of a batch at a time, so a worker does not hold those of
    thousands of images. Null where an image has no data or no boxes."""
    size = [(F.col(c) * enlarge).cast("int").alias(c) for c in ("width", "height")]
    kinds = {"contrast": f"struct<{contrast.ROW.removeprefix('image_id long, ').replace(' ', ':').replace(',:', ',')}>"} if options else {}
    kinds |= {"top": "array<struct<key:int,n:long>>", "total": "long"} if colors else {}
    kinds |= {"boxes": "array<struct<top:long,left:long,width:long,height:long,area:long>>"} if box_color else {}
    if not kinds:
        return images.select("image_id", *size)
    workers.bounded(images.sparkSession)
    kind = "image_id long, width int, height int, " + ", ".join(f"{k} {t}" for k, t in kinds.items())
    types = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(kind)}

    def look(width: int, height: int, data: bytes) -> dict:
        image, own = np.frombuffer(data, np.uint8).reshape(height, width, 3).repeat(enlarge, 0).repeat(enlarge, 1), {}
        if options:
            own["contrast"] = contrast.measure_region(image, None, options)
        if colors and image.size:
            own["top"], own["total"] = histogram.most_frequent(image), width * height * enlarge**2
        if box_color and image.size:
            found, _ = components.regions(image, box_color, S.BOX_TOLERANCE, S.BOX_AREA, S.MASK_COMPONENTS)
            named = [dict(zip(components.FIELDS, r, strict=True)) for r in found]
            wide = [r for r in named if r["width"] >= S.BOX_WIDTH and r["height"] >= S.BOX_HEIGHT]
            own["boxes"] = sorted(wide, key=lambda r: [r[c] for c in ("top", "left", "width", "height", "area")]) or None
        return own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rasters.parts(batches, most=PART_BYTES):
            rows = [look(r["width"], r["height"], r["data"]) if r["data"] is not None else {} for r in b.select(["width", "height", "data"]).to_pylist()]
            sides = [pa.compute.multiply(b.column(c), pa.scalar(enlarge, pa.int32())) for c in ("width", "height")]
            yield pa.RecordBatch.from_arrays([b.column("image_id"), *sides, *(pa.array([r.get(k) for r in rows], types[k]) for k in kinds)], names=list(types))

    return images.select("image_id", "width", "height", "data").mapInArrow(run, kind)


def answer(requests: DataFrame, images: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """One row per request (doc_id, image_id, prompt, reply): quantitative prompts by measurement, the rest by the reply's
    claims against OCR words. The split comes first, so a measured prompt never meets the reply. Without ``words`` a request
    has them on its own row (array ``words``)."""
    asked = requests.withColumn("matched", text.quantitative(F.col("prompt")))
    counted, told = asked.where(F.size("matched") > 0), asked.where(F.size("matched") == 0)
    measured = contrast.measure(images.join(counted.select("image_id").distinct(), "image_id", "left_semi"))
    left = counted.join(measured.select("image_id", "verdict", "evaluated_count", "failing_count"), "image_id", "left").select("doc_id", F.lit("measurement").alias("answered_by"), F.lit(False).alias("model_consulted"), "verdict", "evaluated_count", "failing_count", F.lit(None).cast("double").alias("agreement_rate"), F.lit(None).cast("long").alias("n_items"))
    claimed = F.transform(jsonx.claims(jsonx.salvage(F.col("reply"))["document"])["text_items"], lambda i, k: F.struct(k.cast("long").alias("ord"), i["text"].alias("text"), i["confidence"].alias("confidence"), i["legible"].alias("legible"), i["box"].alias("box")))
    if words is None:
        listed = told.select("doc_id", claimed.alias("items"), "words")
        docs = listed.withColumn("items", F.coalesce("items", F.array().cast(listed.schema["items"].dataType)))
    else:
        docs = evidence.together(told.select("doc_id", F.inline(claimed)), words.join(told.select("doc_id").distinct(), "doc_id", "left_semi"))
    rate = evidence.agreement(evidence.reconcile_of(docs))
    right = told.select("doc_id").join(rate, "doc_id", "left").select("doc_id", F.lit("model").alias("answered_by"), F.lit(True).alias("model_consulted"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("long").alias("evaluated_count"), F.lit(None).cast("long").alias("failing_count"), "agreement_rate", "n_items")
    return left.unionByName(right)
