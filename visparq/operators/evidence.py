"""Reconciliation of what a model read with what OCR read.

Inputs: ``items`` (doc_id, ord, text, confidence, legible, box) and ``words`` (doc_id, ord, text, confidence, box). Each
distinct text of a document is normalised and met once. What contains a text holds the text's first characters somewhere, so
the two meet on those and only such pairs are compared.

A document's items and words meet on one row (``together``: doc_id, arrays ``items`` and ``words``); who has them on a row
already passes that row, and nothing is shuffled. ``met`` is the same meeting as equi-joins, for claims that are few.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visparq import workers
from visparq.functions import color, geometry, text

#: Fixed value: general excuses, without regard to case.
EXCUSES = r"(?i)too small|unreadable|can ?not read|cannot read|blurry|illegible|not legible|hard to read|difficult to read"


def flatten_words(ocr: DataFrame) -> DataFrame:
    """doc_id, ord, text, confidence, line, box of nested OCR output; words without text or box dropped, null levels skipped."""
    words = F.flatten(F.flatten(F.transform("ocr.blocks", lambda b: F.flatten(F.transform(F.coalesce(b["paragraphs"], F.array()), lambda p: F.transform(F.coalesce(p["lines"], F.array()), lambda n: F.transform(F.coalesce(n["words"], F.array()), lambda w: F.struct(F.trim(F.regexp_replace(F.coalesce(n["text"], F.lit("")), r"\s+", " ")).alias("line"), w.alias("w")))))))))
    own = ocr.select("doc_id", F.posexplode(words).alias("ord", "x")).select("doc_id", "ord", F.trim("x.w.text").alias("text"), "x.w.confidence", "x.line", "x.w.bbox")
    kept = own.where("text <> '' AND bbox IS NOT NULL")
    return kept.select("doc_id", "ord", "text", "confidence", "line", F.struct(F.col("bbox.x0").alias("left"), F.col("bbox.y0").alias("top"), (F.col("bbox.x1") - F.col("bbox.x0")).alias("width"), (F.col("bbox.y1") - F.col("bbox.y0")).alias("height")).alias("box"))


def met(claims: DataFrame, norms: DataFrame, least: int) -> DataFrame:
    """doc_id, claim, norm: distinct texts of a document that are equal, or both of ``least`` characters and one in the other.

    ``claims``: doc_id, claim; ``norms``: doc_id, norm; both distinct and not empty."""
    same = claims.withColumn("norm", F.col("claim")).join(norms, ["doc_id", "norm"], "left_semi").select("doc_id", "claim", "norm")
    long = lambda c: F.length(c) >= least
    head = lambda c: F.substring(c, 1, least).alias("gram")
    inside = claims.where(long("claim")).select("doc_id", "claim", head("claim")).join(norms.select("doc_id", "norm", F.explode(text.grams(F.col("norm"), least)).alias("gram")), ["doc_id", "gram"]).where(F.contains("norm", "claim"))
    around = claims.select("doc_id", "claim", F.explode(text.grams(F.col("claim"), least)).alias("gram")).join(norms.where(long("norm")).select("doc_id", "norm", head("norm")), ["doc_id", "gram"]).where(F.contains("claim", "norm"))
    other = inside.unionByName(around).where("claim <> norm").select("doc_id", "claim", "norm")
    return same.unionByName(other)


def _claims(items: DataFrame) -> DataFrame:
    return items.select("doc_id", text.normalize(F.col("text")).alias("claim")).where("claim <> ''").distinct()


def meet(claims: list[str], norms: list[str], least: int = 4) -> tuple[list[int | None], list[bool], list[bool]]:
    """Of one document's normalised texts: for each claim the first norm that is equal, or holds it or lies in it (both of
    ``least`` characters); whether it stands in all norms joined; and for each norm whether any claim meets it."""
    first: dict[str, int] = {}
    for j, n in enumerate(norms):
        if n and n not in first:
            first[n] = j
    own, full, seen = dict.fromkeys(c for c in claims if c), "".join(norms), set()
    heads: tuple[dict[str, list[str]], dict[str, list[str]]] = ({}, {})
    for known, of in zip(heads, (first, own), strict=True):
        for t in of:
            if len(t) >= least:
                known.setdefault(t[:least], []).append(t)
    best = {c: first[c] for c in own if c in first}
    seen.update(best)
    for c in own:
        for k in range(len(c) - least + 1):
            for n in heads[0].get(c[k : k + least], ()):
                if c.startswith(n, k):
                    seen.add(n)
                    best[c] = min(best.get(c, first[n]), first[n])
    for n, j in first.items():
        for k in range(len(n) - least + 1):
            for c in heads[1].get(n[k : k + least], ()):
                if n.startswith(c, k):
                    seen.add(n)
                    best[c] = min(best.get(c, j), j)
    whole = {c: len(c) >= least and c in full for c in own}
    return [best.get(c) for c in claims], [whole.get(c, False) for c in claims], [n in seen for n in norms]


def _met(claims: pa.Array, norms: pa.Array) -> pa.Array:
    own = [meet(c, n) for c, n in zip(claims.to_pylist(), norms.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in own], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.bool_(), pa.bool_()))], names=["at", "whole", "seen"])


def together(items: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, items, words: one row a document, each list in its order."""
    listed = lambda df, name: df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "text", *(c for c in df.columns if c not in ("doc_id", "ord", "text"))))).alias(name))
    both = listed(items, "items").join(listed(words, "words"), "doc_id", "full_outer")
    return both.select("doc_id", *(F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c) for c in ("items", "words")))


def _judged(docs: DataFrame) -> DataFrame:
    """doc_id, found, left: items with ``at`` (the first word that matches) and ``whole``; words that no item matches."""
    # What is made here is exploded with explode_outer: for explode the planner infers a filter on the list's size and pushes it
    # down into the lists' own making, where each element makes them all again.
    workers.can_import(docs.sparkSession)
    workers.bounded(docs.sparkSession)
    norms = lambda c: F.transform(c, lambda x: text.normalize(x["text"]))
    own = docs.withColumn("norms", norms("words")).withColumn("met", F.arrow_udf(_met, "struct<at:array<int>,whole:array<boolean>,seen:array<boolean>>")(norms("items"), F.col("norms")))
    found = F.transform("items", lambda x, i: F.struct(x.alias("item"), F.get("words", F.get("met.at", i))["text"].alias("word"), F.get("norms", F.get("met.at", i)).alias("norm"), F.get("met.whole", i).alias("whole")))
    left = F.filter("words", lambda w, j: ~F.get("met.seen", j) & (F.length(F.get("norms", j)) >= 3))
    return own.select("doc_id", found.alias("found"), left.alias("left"))


def _match(x: Column) -> Column:
    return F.when(x["norm"].isNotNull(), F.when(x["norm"] == text.normalize(x["item"]["text"]), "exact").otherwise("partial"))


def support(items: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, ord, match, word: the first OCR word, in OCR order, that matches an item exactly or by containment."""
    return support_of(together(items, words))


def support_of(docs: DataFrame) -> DataFrame:
    x = F.col("x")
    own = _judged(docs).select("doc_id", F.explode_outer("found").alias("x")).where("x.norm IS NOT NULL")
    return own.select("doc_id", x["item"]["ord"].alias("ord"), _match(x).alias("match"), x["word"].alias("word"))


def whole_text(items: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, ord of items whose normalised text (4 characters at least) stands in the document's joined OCR text."""
    return whole_text_of(together(items, words))


def whole_text_of(docs: DataFrame) -> DataFrame:
    return _judged(docs).select("doc_id", F.explode_outer("found").alias("x")).where("x.whole").select("doc_id", "x.item.ord")


def score(supported: Column, plausible: Column, confidence: Column, legible: Column, outside: Column) -> dict[str, Column]:
    """source, confidence, verified and flags of an item."""
    c = F.coalesce(confidence, F.lit(0.5))
    source = F.when(supported, "vl+ocr").when(plausible, "vl").otherwise("unverified")
    value = F.when(supported, F.least(F.lit(1.0), F.greatest(c, F.lit(0.5)) + 0.25)).when(plausible, F.greatest(F.lit(0.1), c * 0.5)).otherwise(F.greatest(F.lit(0.05), c * 0.25))
    flags = F.array_compact(
        F.array(
            F.when(outside, "outside_crop"),
            F.when(~supported & plausible, "single_source_unverified"),
            F.when(~supported & ~plausible, "no_ocr_support"),
            F.when(~supported & ~plausible, "no_plausible_box"),
            F.when(~F.coalesce(legible, F.lit(True)), "model_marked_illegible"),
        )
    )
    return {"source": source, "confidence": color.round2(value), "verified": supported, "flags": flags}


def ocr_only(items: DataFrame, words: DataFrame) -> DataFrame:
    """Words (normalised length 3 at least) that no item matches. Decided once for each distinct text of a document."""
    return ocr_only_of(together(items, words))


def ocr_only_of(docs: DataFrame) -> DataFrame:
    return _judged(docs).select("doc_id", F.explode_outer("left").alias("w")).where("w IS NOT NULL").select("doc_id", "w.*")


def reconcile(items: DataFrame, words: DataFrame, crop: tuple | None = None) -> DataFrame:
    """doc_id, ord, text, source, confidence, verified, match, word, in_crop, flags: items, then OCR-only words (ord null)."""
    return reconcile_of(together(items, words), crop)


def reconcile_of(docs: DataFrame, crop: tuple | None = None) -> DataFrame:
    """The same of documents on one row each (doc_id, items, words)."""
    own = _judged(docs.withColumn("items", F.filter("items", lambda x: F.trim(x["text"]) != "")))
    kind = docs.schema["items"].dataType.elementType["box"].dataType
    said = F.transform("found", lambda x: F.struct(F.lit(False).alias("ocr"), x["item"]["ord"].cast("long").alias("ord"), x["item"]["text"].alias("text"), x["item"]["confidence"].cast("double").alias("score"), x["item"]["legible"].alias("legible"), x["item"]["box"].alias("box"), _match(x).alias("match"), x["word"].alias("word"), x["whole"].alias("by_text")))
    rest = F.transform("left", lambda w: F.struct(F.lit(True).alias("ocr"), F.lit(None).cast("long").alias("ord"), w["text"].alias("text"), w["confidence"].cast("double").alias("score"), F.lit(None).cast("boolean").alias("legible"), F.lit(None).cast(kind).alias("box"), F.lit("exact").alias("match"), w["text"].alias("word"), F.lit(False).alias("by_text")))
    rows = own.select("doc_id", F.inline_outer(F.concat(said, rest))).where("ocr IS NOT NULL")
    box = tuple(F.col(f"box.{k}") for k in ("left", "top", "width", "height"))
    has_box = F.col("box").isNotNull()
    placed = rows.withColumn("in_crop", F.when(has_box, geometry.inside_crop(tuple(F.lit(c) for c in crop), box)) if crop else F.lit(None).cast("boolean"))
    supported = F.col("match").isNotNull() | F.coalesce("by_text", F.lit(False))
    plausible = F.coalesce(has_box & (F.col("box.width") > 0) & (F.col("box.height") > 0), F.lit(False)) & F.coalesce("in_crop", F.lit(True))
    scored = score(supported, plausible, F.col("score"), F.col("legible"), F.coalesce(~F.col("in_crop"), F.lit(False)))
    of = lambda word, item: F.when(F.col("ocr"), word).otherwise(item)
    return placed.select(
        "doc_id",
        "ord",
        of(F.col("text"), F.trim("text")).alias("text"),
        of(F.lit("ocr"), scored["source"]).alias("source"),
        of(color.round2(F.col("score") / 100), scored["confidence"]).alias("confidence"),
        of(F.lit(True), scored["verified"]).alias("verified"),
        F.coalesce("match", F.when(F.col("by_text"), "full_text")).alias("match"),
        "word",
        "in_crop",
        of(F.array(F.lit("ocr_only_not_reported_by_model")), scored["flags"]).alias("flags"),
    )


def agreement(reconciled: DataFrame) -> DataFrame:
    """Per document: agreement_rate over the model's items (null if none), and counts by source."""
    model = F.col("source") != "ocr"
    return reconciled.groupBy("doc_id").agg(
        color.round2(F.count_if(model & F.col("verified")) / F.when(F.count_if(model) > 0, F.count_if(model))).alias("agreement_rate"),
        F.count_if(model).alias("n_items"),
        F.count_if(F.col("source") == "unverified").alias("n_unverified"),
        F.count_if(~model).alias("n_ocr_only"),
        # The sources are these four: counts are summed in place, where a collected set would sort the rows of many documents.
        F.concat_ws(",", *(F.when(F.count_if(F.col("source") == s) > 0, s) for s in ("ocr", "unverified", "vl", "vl+ocr"))).alias("sources"),
    )


def contested(claims: DataFrame, words: DataFrame, blanket: int = 12) -> DataFrame:
    """doc_id, ord, contest_type, by: unreadable claims against OCR words: those that the claim names (three characters at
    least), all of them in OCR order; without any, the first words for a general excuse."""
    own = words.select("doc_id", F.col("ord").alias("at"), F.col("text").alias("word"), text.normalize(F.col("text")).alias("norm"))
    named = met(_claims(claims).where("length(claim) >= 3"), own.where("length(norm) >= 3").select("doc_id", "norm").distinct(), 3)
    listed = lambda: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), ",")
    precise = named.join(own, ["doc_id", "norm"]).groupBy("doc_id", "claim").agg(listed().alias("precise"))
    first = own.where(F.col("at") < blanket).groupBy("doc_id").agg(listed().alias("blanket"))
    said = claims.select("doc_id", "ord", "text", text.normalize(F.col("text")).alias("claim")).join(precise, ["doc_id", "claim"], "left").join(first, "doc_id", "left")
    kind = F.when(F.col("precise").isNotNull(), "precise").when(F.col("blanket").isNotNull() & F.col("text").rlike(EXCUSES), "blanket")
    return said.withColumn("contest_type", kind).where("contest_type IS NOT NULL").select("doc_id", "ord", "contest_type", F.coalesce("precise", "blanket").alias("by"))
