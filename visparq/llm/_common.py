"""Helpers that the training-data operators share: durable cuts of the lineage, worker paths, Arrow columns."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visparq.workers import bounded, can_import

#: Rows of one key that a join may leave in one task.
PART = 256
#: The folders that ``durable`` wrote and nobody released yet.
MADE: dict[str, SparkSession] = {}
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def workers_can_import(spark: SparkSession) -> None:
    """Put this checkout on the workers' import path (a cluster that ships the package another way is unaffected), and
    bound what the session sends them at once."""
    bounded(spark)
    can_import(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own only where driver and executors are one
    process (tests). On a cluster that names none, nothing could be shared: an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/visparq-checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def durable(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends there, and lost executors cost nothing.

    Shuffle files of the job that made it are released as soon as it is written. The files go with ``release``, or else when
    the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)
    fs, at = _file(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    MADE[path] = spark
    return out


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def release(*tables: DataFrame | str) -> None:
    """Delete what ``durable`` wrote for these (or to these paths); nothing that is still to be evaluated may read them."""
    for t in tables:
        path = t if isinstance(t, str) else t.durable_path
        if path in MADE:
            fs, at = _file(MADE.pop(path), path)
            fs.delete(at, True)


def spread_join(left: DataFrame, right: DataFrame, key: str, spread_by: Column, how: str = "inner") -> DataFrame:
    """``left`` joined by ``key`` to ``right``, which has one row a key; a key that holds many of ``left``'s rows is spread over
    tasks: its rows are dealt by ``spread_by``, and its right row is repeated as often. No nulls in the key.

    A heavy key has over PART rows and over a ten-thousandth of all, so there are at most 10,000 heavy keys to broadcast.
    """
    counts = left.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    least = max(PART, (total or 0) // 10_000)
    if (most or 0) <= least:
        return left.join(right.hint("merge"), key, how)
    heavy = durable(counts.where(F.col("n") > least).select("_key", F.ceil(F.col("n") / least).cast("int").alias("_parts")), "heavy")
    dealt = left.join(F.broadcast(heavy), F.col(key) == F.col("_key"), "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread_by), F.col("_parts"))).cast("int")).drop("_key", "_parts")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
    copies = right.join(F.broadcast(heavy), F.col(key) == F.col("_key"), "left").select(*right.columns, parts.alias("_part"))
    return dealt.join(copies.hint("merge"), [key, "_part"], how).drop("_part")


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` alone, a null text as an empty one: extra columns, whatever their names, never reach an operator."""
    workers_can_import(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def struct_to_batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def let(value, body):
    """``body`` of ``value`` with the value computed once, inside one expression (so that a CASE can skip it)."""
    return F.transform(F.array(value), body)[0]


def words_of(text):
    """The text's words, ``[^\\x20\\x09-\\x0D]+``, as an array; no regular expression runs."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def wrapped(docs: DataFrame) -> DataFrame:
    """``doc``, a struct of all columns: whatever they are called, they cannot clash with an operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))


def unwrapped(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col("doc").getField(c).alias(c) for c in columns))
