"""Model catalogues and residency from JSON replies of a model server."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAGS = "models array<struct<name:string,capabilities:array<string>,size:long,details:struct<parameter_size:string,quantization_level:string>>>"
RESIDENT = "models array<struct<name:string,size_vram:long,size:long,expires_at:string>>"


def installed(replies: DataFrame) -> DataFrame:
    """host, name, capabilities, size, parameter_size, quantization of ``replies`` (host, body); absent lists are empty."""
    m = replies.select("host", F.explode(F.from_json("body", TAGS)["models"]).alias("m"))
    return m.select("host", "m.name", F.coalesce("m.capabilities", F.expr("CAST(array() AS array<string>)")).alias("capabilities"), "m.size", "m.details.parameter_size", F.col("m.details.quantization_level").alias("quantization"))


def vision(models: DataFrame) -> DataFrame:
    return models.where(F.array_contains("capabilities", "vision"))


def resident(body: Column) -> Column:
    """Array of (name, size_vram, expires_at); an unreadable reply has none."""
    models = F.coalesce(F.from_json(body, RESIDENT)["models"], F.from_json(F.lit('{"models": []}'), RESIDENT)["models"])
    return F.transform(models, lambda m: F.struct(m["name"].alias("name"), F.coalesce(m["size_vram"], m["size"], F.lit(0)).alias("size_vram"), m["expires_at"].alias("expires_at")))
