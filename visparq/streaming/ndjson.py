"""Model replies that arrive as lines of JSON, in pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visparq import schema as S


def lines(chunks: DataFrame) -> DataFrame:
    """request_id, k, recv_ms, line, trailing: pieces (request_id, seq, recv_ms, piece) joined and cut at newlines.

    A line belongs to the piece that ends it; what follows the last newline is trailing. One request's reply is the group.
    """
    rows = chunks.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("seq", "recv_ms", "piece"))).alias("p"))
    body = F.array_join(F.transform("p", lambda p: p["piece"]), "")
    split = rows.select("request_id", "p", F.posexplode(F.split(body, "\n")).alias("k", "line"), F.size(F.split(body, "\n")).alias("n"))
    newlines = F.transform("p", lambda p: F.length(p["piece"]) - F.length(F.replace(p["piece"], F.lit("\n"), F.lit(""))))
    upto = F.transform(F.sequence(F.lit(1), F.size("p")), lambda j: F.aggregate(F.slice(newlines, 1, j), F.lit(0), lambda a, x: a + x))
    at = F.array_position(F.transform(upto, lambda u: u > F.col("k")), F.lit(True)).cast("int")
    return split.select("request_id", "k", F.when(at > 0, F.get("p", at - 1)["recv_ms"]).otherwise(F.element_at("p", -1)["recv_ms"]).alias("recv_ms"), "line", (F.col("k") == F.col("n") - 1).alias("trailing"))


def reassemble(found: DataFrame) -> DataFrame:
    """request_id, reply, n_parts, first_token_ms, done, failed, eval_count. Malformed and blank lines are skipped; an error
    line fails the request unless it trails; a trailing line sets no first token."""
    parsed = found.where(F.trim("line") != "").withColumn("j", F.from_json("line", S.CHUNK))
    good = parsed.where("j IS NOT NULL AND (j.response IS NOT NULL OR j.done IS NOT NULL OR j.error IS NOT NULL)")
    said = F.coalesce(F.col("j.response"), F.lit("")) != ""
    rows = good.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.when(said, F.struct("k", F.col("j.response").alias("t"))))).alias("parts"),
        F.min(F.when(said & ~F.col("trailing"), F.col("recv_ms"))).alias("first_token_ms"),
        F.coalesce(F.max("j.done"), F.lit(False)).alias("done"),
        F.coalesce(F.max(F.col("j.error").isNotNull() & ~F.col("trailing")), F.lit(False)).alias("failed"),
        F.max_by("j.eval_count", F.when(F.col("j.done"), F.col("k"))).alias("eval_count"),
    )
    return rows.select("request_id", F.array_join(F.transform("parts", lambda p: p["t"]), "").alias("reply"), F.size("parts").cast("long").alias("n_parts"), "first_token_ms", "done", "failed", "eval_count")


def phase(first_token_ms: Column, timeout_ms: Column) -> Column:
    """'load' if the first token took longer than 20 s or a quarter of the timeout, or never came; else 'infer'."""
    window = F.least(F.lit(S.LOAD_WINDOW_MS), F.floor(timeout_ms * 0.25))
    return F.when(first_token_ms.isNull() | (first_token_ms > window), "load").otherwise("infer")


def ms(ns: Column) -> Column:
    return F.floor(ns / 1e6 + 0.5).cast("long")
