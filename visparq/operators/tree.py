"""Trees of paths: nodes, edges, extension counts and DOT text. Input: paths (graph_id, path, size), files only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPED = ("node_modules",)


def nodes(paths: DataFrame, max_depth: int = 5, include_modules: bool = False) -> DataFrame:
    """graph_id, id, type, name, extension, size, parent. Every prefix of a path is a directory; depth counts from 0 and a
    directory at ``max_depth`` is still read. Hidden parts (but .git) and, unless asked for, module folders are skipped."""
    depth = max(1, min(20, max_depth or 5))
    parts = paths.select("graph_id", "size", F.filter(F.split("path", "/"), lambda p: p != "").alias("parts"))
    bad = F.exists("parts", lambda p: (p.startswith(".") & (p != ".git")) | (F.lit(not include_modules) & p.isin(*SKIPPED)))
    level = F.posexplode(F.slice("parts", 1, depth + 1)).alias("k", "name")
    each = parts.where(~bad).select("graph_id", "size", "parts", level)
    own = each.select("graph_id", F.array_join(F.slice("parts", 1, F.col("k") + 1), "/").alias("id"), F.when(F.col("k") == F.size("parts") - 1, "file").otherwise("directory").alias("type"), "name", F.when(F.col("k") > 0, F.array_join(F.expr("slice(parts, 1, k)"), "/")).alias("parent"), "size")
    dot = F.lower(F.regexp_extract("name", r"^.+(\.[^.]*)$", 1))
    named = own.withColumns({"extension": F.when(F.col("type") == "file", dot).otherwise(""), "size": F.when(F.col("type") == "file", F.col("size")).otherwise(0)})
    return named.groupBy("graph_id", "id", "type", "name", "extension", "parent").agg(F.max("size").alias("size"))


def edges(found: DataFrame) -> DataFrame:
    """graph_id, source, target: children of the root have none."""
    return found.where("parent IS NOT NULL").select("graph_id", F.col("parent").alias("source"), F.col("id").alias("target"))


def extensions(found: DataFrame) -> DataFrame:
    files = found.where("type = 'file'")
    return files.groupBy("graph_id", F.when(F.col("extension") == "", "no_ext").otherwise(F.col("extension")).alias("extension")).agg(F.count("*").alias("n_files"))


def dot(found: DataFrame) -> DataFrame:
    """graph_id, dot: Graphviz text; directories are folders, files boxes. One string a graph is the format."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = F.concat(F.lit("  "), quote(F.col("id")), F.lit(" [label="), quote(F.col("name")), F.when(F.col("type") == "directory", ", shape=folder];").otherwise(", shape=box];"))
    points = found.select("graph_id", F.lit(0).alias("k"), F.col("id").alias("at"), line.alias("line"))
    arcs = edges(found).select("graph_id", F.lit(1).alias("k"), F.col("target").alias("at"), F.concat(F.lit("  "), quote(F.col("source")), F.lit(" -> "), quote(F.col("target")), F.lit(";")).alias("line"))
    rows = points.unionByName(arcs).groupBy("graph_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "at", "line"))), lambda r: r["line"]), "\n").alias("body"))
    return rows.select("graph_id", F.concat(F.lit("digraph G {\n  rankdir=LR;\n"), "body", F.lit("\n}")).alias("dot"))


def scan(spark, root: str, graph_id: int = 0) -> DataFrame:
    """Files below a folder as paths relative to it; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    base = root.split("://", 1)[-1].rstrip("/")
    return files.select(F.lit(graph_id).cast("long").alias("graph_id"), F.substring_index("path", base + "/", -1).alias("path"), F.col("length").alias("size"))
