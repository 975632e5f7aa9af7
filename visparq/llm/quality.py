"""Quality rules: base statistics of whole texts, and robust multivariate outliers per language and source.

Everything is DataFrame functions; no Python runs on the executors. Statistics are computed once and written. The vectors
that pass the base rules are counted by *cells* (each statistic rounded to 1/GRID) per group, map-side, so everything after
that follows the cells, not the documents, and a group that holds a third of all rows is never gathered.

Minimum covariance determinant, for every group (language and source; language; all documents) from three deterministic
starts: medians and median deviations; the covariance of spatial signs; mean and covariance of the half nearest to the
median. Concentration steps (mean and covariance of the ``KEEP`` share with the least distances, cut at a bin of the
distances' histogram) run from each start until its determinant no longer falls; the least determinant wins. ``FLOORS`` on
the diagonal keep constant statistics invertible (a regularised determinant). Distances are scaled so that their median is
that of a chi-square, mean and covariance are taken again of all within its 97.5 % quantile (reweighting), and every group,
large or small, is shrunk towards its parent as if ``PRIOR`` documents of it were the parent's: language and source towards
the language, the language towards all.

Defined cases: a null text has no words and fails the base rules; null languages or sources are groups of their own; null
ids are kept; repeated rows are judged alike; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visparq.llm._common import durable, let, release, spread_join, words_of

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
KEEP, GRID, BINS, PRIOR = 0.75, 64, 64, 50
#: Squared distance beyond which a vector is rejected: 1e-6 of a normal population lies beyond it (chi-square, four
#: degrees of freedom).
CUTOFF = 33.4
CHI2_MEDIAN, CHI2_INNER = 3.357, 11.143  # of four degrees of freedom: the median and the 97.5 % quantile
#: The statistics, and for each a standard deviation below which differences mean nothing. From a group without any, a
#: document alone passes the cutoff with over 29 % duplicate lines, or with over 22 % repeated words (the base rule: 30 %).
STATS, FLOORS = ("z_length", "z_symbols", "z_lines", "z_repeats"), (0.08, 0.5, 0.23, 0.2)
FALL = 1e-6  # of a determinant's logarithm: a smaller fall ends a start's steps
BOUND = 200_000  # groups whose parameters (200 bytes each) may be broadcast; more are joined by shuffle, heavy ones spread
PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]


def _repeat_words(words: Column) -> Column:
    """Words in windows of 8 that are found twice or more. Hashes of windows (of two, four, eight words, each of two halves)
    tell which may repeat; only those are compared as strings."""

    def doubled(h: Column, step: int) -> Column:
        return F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))

    def exact(s: Column) -> Column:
        """``s``: windows (hash, i) in order; those beside an equal hash, as strings in order, beside an equal string."""
        beside = lambda s, f: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)[f] == x[f], F.lit(False)) | F.coalesce(F.get(s, k + 1)[f] == x[f], F.lit(False)))
        strings = F.sort_array(F.transform(beside(s, "h"), lambda x: F.struct(F.array_join(F.slice(words, x["i"] + 1, WINDOW), " ").alias("w"), x["i"].alias("i"))))
        places = let(strings, lambda t: F.array_sort(F.transform(beside(t, "w"), lambda x: x["i"])))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
        step = lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["total"] + F.least(F.lit(WINDOW), p + WINDOW - acc["end"])).alias("total"))
        return F.aggregate(places, zero, step, lambda acc: acc["total"])

    def repeated(h: Column) -> Column:
        windows = lambda: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(windows(), exact)).otherwise(0)

    single = F.transform(words, lambda w: F.xxhash64(w))
    eights = let(single, lambda a: let(doubled(a, 1), lambda b: let(doubled(b, 2), lambda c: F.slice(doubled(c, 4), 1, F.size(c) - WINDOW + 1))))
    return F.when(F.size(words) < WINDOW, 0).otherwise(let(eights, repeated)).cast("long")


def base_statistics(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` under ``doc``, and of each text: the base counts, base_failed and the transformed vector."""
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    split = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")).select("doc", text.alias("text"), words_of(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    counted = split.select(
        "doc",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda s: F.struct(F.size(s).alias("n"), (F.size(s) - F.size(F.array_distinct(s))).alias("dup"))).alias("lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    )
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return counted.select(
        "doc",
        "n_words",
        "word_chars",
        "n_symbols",
        F.col("lines.dup").cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        F.log(chars / words).alias("z_length"),
        F.log(F.col("n_symbols") / chars + 0.02).alias("z_symbols"),
        F.log(F.col("lines.dup") / F.greatest(F.col("lines.n"), F.lit(1)) + 0.1).alias("z_lines"),
        F.log(F.col("n_repeat_words") / words + 0.1).alias("z_repeats"),
    )


def _keys() -> Column:
    """The groups that a document counts in, from its own to all: language and source, language, everything."""
    return F.array(_own_key(), F.concat(F.lit("1"), F.to_json(F.struct("lang"))), F.lit("0"))


def _own_key() -> Column:
    return F.concat(F.lit("2"), F.to_json(F.struct("lang", "source")))


def _small(df: DataFrame, few: bool) -> DataFrame:
    """Marked for broadcast only where there are few groups (BOUND at most)."""
    return F.broadcast(df) if few else df


M, ROOT, COV = [f"m{i}" for i in range(4)], [f"r{i}{j}" for i, j in PAIRS], [f"c{i}{j}" for i, j in PAIRS]


def _with_distance(df: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance: forward substitution with the covariance's Cholesky root, a column a
    coordinate. (SQL strings here and below: a tenth of the driver's calls that column objects take.)"""
    lines = ["(" + " - ".join([f"{z} - m{i}", *(f"r{i}{j} * _s{j}" for j in range(i))]) + f") / r{i}{i} AS _s{i}" for i, z in enumerate(STATS)]
    return df.selectExpr("*", *lines, " + ".join(f"_s{i} * _s{i}" for i in range(4)) + " AS d2").drop(*(f"_s{i}" for i in range(4)))


def _with_roots(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, centers, the Cholesky root of the covariance c00.. with floors on its diagonal, the determinant's logarithm."""
    lines = []
    for i, j in sorted(PAIRS):
        rest = " - ".join([f"c{i}{j}" + (f" + {FLOORS[i] ** 2!r}D" if i == j else ""), *(f"r{i}{k} * r{j}{k}" for k in range(j))])
        lines.append(f"sqrt(greatest({rest}, 1e-9D)) AS r{i}{i}" if i == j else f"({rest}) / r{j}{j} AS r{i}{j}")
    det = "2 * (" + " + ".join(f"ln(r{i}{i})" for i in range(4)) + ") AS det"
    return df.selectExpr("*", *lines).selectExpr(*keep, *M, *ROOT, det)


def _quantile(binned: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Per group, the least bin that the share of its documents does not exceed."""
    counts = binned.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys)
    ranked = counts.select(*keys, "bin", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("total"))
    return ranked.where(F.col("upto") >= F.ceil(F.col("total") * share)).groupBy(*keys).agg(F.min("bin").alias("bin"))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, docs, m0.., c00..: count, mean and covariance of weighted rows, sums taken about the centers at hand."""
    off = [f"({z} - m{i})" for i, z in enumerate(STATS)]
    sums = rows.groupBy(*keys, *M).agg(F.sum("n").alias("docs"), *(F.expr(f"sum(n * {off[i]}) AS s{i}") for i in range(4)), *(F.expr(f"sum(n * {off[i]} * {off[j]}) AS q{i}{j}") for i, j in PAIRS))
    return sums.selectExpr(*keys, "docs", *(f"m{i} + s{i} / docs AS m{i}" for i in range(4)), *(f"q{i}{j} / docs - s{i} / docs * (s{j} / docs) AS c{i}{j}" for i, j in PAIRS))


def cells_of(stats: DataFrame) -> DataFrame:
    """group, the statistics rounded to 1/GRID, n: how many documents of each group have them."""
    own = stats.groupBy("lang", "source", *((F.round(F.col(z) * GRID) / GRID).alias(z) for z in STATS)).agg(F.count("*").alias("n"))
    return own.select(F.explode(_keys()).alias("group"), *STATS, "n").groupBy("group", *STATS).agg(F.sum("n").alias("n"))


def _bin(distance: Column) -> Column:
    return F.floor(F.sqrt(distance) * BINS).alias("bin")


def starts(cells: DataFrame, few: bool) -> DataFrame:
    """group, start, m0.., r00.., det: three estimates to begin with."""
    line = cells.select("group", "n", F.posexplode(F.array(*(F.round(F.col(z) * GRID).cast("long") for z in STATS))).alias("stat", "bin"))
    median = durable(_quantile(line, ["group", "stat"], 0.5), "medians")
    near = line.join(_small(median.select("group", "stat", F.col("bin").alias("mid")), few), ["group", "stat"]).select("group", "stat", "n", F.abs(F.col("bin") - F.col("mid")).alias("bin"))
    both = median.join(_quantile(near, ["group", "stat"], 0.5).select("group", "stat", (F.col("bin") / GRID * 1.4826).alias("mad")), ["group", "stat"])
    middle = durable(both.groupBy("group").agg(*(F.expr(f"max(CASE WHEN stat = {i} THEN bin / {GRID} END) AS m{i}") for i in range(4)), *(F.expr(f"greatest(max(CASE WHEN stat = {i} THEN mad END), {FLOORS[i]!r}D) AS d{i}") for i in range(4))), "middles")
    plain = middle.selectExpr("group", "0 AS start", *M, *(f"d{i} * d{i} AS c{i}{j}" if i == j else f"0D AS c{i}{j}" for i, j in PAIRS))
    y = [f"(({z} - m{i}) / d{i})" for i, z in enumerate(STATS)]
    placed = cells.join(_small(middle, few), "group").selectExpr("*", " + ".join(f"{v} * {v}" for v in y) + " AS norm")
    signs = placed.groupBy("group", *M, *(f"d{i}" for i in range(4))).agg(*(F.expr(f"4 * sum(CASE WHEN norm > 0 THEN n * {y[i]} * {y[j]} / norm ELSE 0 END) / sum(n) AS u{i}{j}") for i, j in PAIRS))
    sign = signs.selectExpr("group", "1 AS start", *M, *(f"u{i}{j} * d{i} * d{j} AS c{i}{j}" for i, j in PAIRS))
    binned = placed.withColumn("bin", _bin(F.col("norm")))
    edge = _quantile(binned, ["group"], 0.5).withColumnRenamed("bin", "edge")
    half = _moments(binned.join(_small(edge, few), "group").where("bin <= edge"), ["group"]).selectExpr("group", "2 AS start", *M, *COV)
    return _with_roots(plain.unionByName(sign).unionByName(half), ["group", "start"])


def concentrate(cells: DataFrame, now: DataFrame, few: bool) -> DataFrame:
    """One step from each estimate: group, start, m0.., r00.., det of the KEEP share nearest to it."""
    placed = _with_distance(cells.join(_small(now, few), "group")).withColumn("bin", _bin(F.col("d2")))
    edge = _quantile(placed, ["group", "start"], KEEP).withColumnRenamed("bin", "edge")
    inner = placed.join(_small(edge, few), ["group", "start"]).where("bin <= edge")
    return _with_roots(_moments(inner, ["group", "start"]), ["group", "start"])


def _scaled(cells: DataFrame, estimate: DataFrame, few: bool) -> DataFrame:
    """``estimate`` with ``scale``: what the squared distances' median is over that of a chi-square, 1 at least."""
    middle = _quantile(_with_distance(cells.join(_small(estimate, few), "group")).select("group", "n", _bin(F.col("d2"))), ["group"], 0.5)
    return estimate.join(middle.select("group", F.greatest(F.pow((F.col("bin") + 0.5) / BINS, F.lit(2)) / CHI2_MEDIAN, F.lit(1.0)).alias("scale")), "group")


def fit(stats: DataFrame) -> DataFrame:
    """group (language and source), m0.., r00.., scale: the shrunk estimates of every group.

    ``stats``: lang, source and the vector of the documents that passed the base rules.
    """
    cells = durable(cells_of(stats), "cells")
    few = cells.agg(F.count_distinct("group")).first()[0] <= BOUND
    now = durable(starts(cells, few), "starts")
    done = []
    while True:  # a determinant falls by FALL at least in each step and has the floors' as its least
        after = durable(concentrate(cells, now, few).join(now.select("group", "start", F.col("det").alias("was")), ["group", "start"]), "steps")
        falling = after.where(F.col("det") < F.col("was") - FALL).drop("was")
        done.append(now.join(falling.select("group", "start"), ["group", "start"], "left_anti"))
        if falling.isEmpty():
            break
        now = falling
    every = reduce(lambda a, b: a.unionByName(b), done)
    raw = durable(every.groupBy("group").agg(F.min_by(F.struct(*(c for c in every.columns if c != "group")), F.struct("det", "start")).alias("e")).select("group", "e.*"), "least")
    placed = _with_distance(cells.join(_small(durable(_scaled(cells, raw, few), "scaled"), few), "group"))
    weighted = _moments(placed.where(F.col("d2") <= CHI2_INNER * F.col("scale")), ["group"])
    own = durable(weighted.withColumn("level", F.substring("group", 1, 1).cast("int")), "reweighted")
    names, parent = ["docs", *M, *COV], own.where("level = 0")
    for level, lang in ((1, "concat(substring(group, 1, 0), '0')"), (2, "concat('1', to_json(named_struct('lang', get_json_object(substring(group, 2), '$.lang'))))")):
        above = parent.selectExpr("group AS above", *(f"{c} AS p_{c}" for c in names))
        mixed = (f"(docs * {c} + {PRIOR} * p_{c}) / (docs + {PRIOR}) AS {c}" for c in names[1:])
        parent = own.where(f"level = {level}").selectExpr("*", f"{lang} AS above").join(above, "above").selectExpr("group", "docs", *mixed)
    out = durable(_scaled(cells, _with_roots(parent, ["group"]), few), "estimates")
    release(cells, raw, own)
    return out


def judge(stats: DataFrame, estimates: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, distance and kept: each document by its own group."""
    keyed = stats.withColumn("group", _own_key())
    joined = keyed.join(F.broadcast(estimates), "group", "left") if estimates.count() <= BOUND else spread_join(keyed, estimates, "group", F.struct(*STATS), "left")
    distance = F.coalesce(F.col("d2") / F.col("scale"), F.lit(0.0))
    return _with_distance(joined).select(*keep, distance.alias("distance"), F.when(F.col("base_failed"), False).otherwise(distance <= CUTOFF).alias("kept"))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, distance, kept of every document."""
    stats = durable(base_statistics(docs).select(F.col("doc.doc_id").cast("long").alias("doc_id"), *_leaf(), *COUNTS, *STATS), "statistics")
    return judge(stats, fit(stats.where("NOT base_failed")), ["doc_id", *COUNTS])


def _leaf() -> list[Column]:
    return [F.col(f"doc.{c}").cast("string").alias(c) for c in ("lang", "source")]


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, all columns as they were. Texts are written once beside their statistics, not shuffled and
    not judged twice."""
    stats = durable(base_statistics(docs).select("doc", *_leaf(), "base_failed", *STATS), "statistics")
    return judge(stats, fit(stats.where("NOT base_failed")), ["doc"]).where("kept").select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
