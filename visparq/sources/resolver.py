"""Image references resolved to bytes: inline ones are decoded where they stand, stored ones are joined by reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visparq.functions import guards


def resolve(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """request_id, scheme, content, error of each request (request_id, source).

    ``stored`` (ref, content; one row a reference) holds uploads, downloads and files, e.g. a ``binaryFile`` source's path and
    content. Errors: not_found, bad_base64, needs_fetch (http: there is no fetching here) and unknown_source.
    """
    named = requests.select("request_id", "source", guards.scheme(F.col("source")).alias("scheme"))
    body = F.when(F.col("scheme") == "data", F.regexp_extract("source", r"(?is)^data:[^,]*,(.*)$", 1)).when(F.col("scheme") == "base64", F.col("source"))
    inline = F.try_to_binary(guards.clean_base64(body), F.lit("base64"))
    ref = F.when(F.col("scheme").isin("file", "home", "upload", "download", "path"), F.col("source"))
    found = named.withColumns({"inline": F.when(F.length(inline) > 0, inline), "ref": ref}).join(stored.select("ref", F.col("content").alias("kept")), "ref", "left")
    content = F.coalesce("inline", "kept")
    error = F.when(F.col("scheme") == "http", "needs_fetch").when(F.col("scheme") == "unknown", "unknown_source").when(content.isNull(), F.when(F.col("scheme").isin("data", "base64"), "bad_base64").otherwise("not_found"))
    return found.select("request_id", "scheme", content.alias("content"), error.alias("error"))
