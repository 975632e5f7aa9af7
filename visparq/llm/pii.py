"""Personal data: exact base patterns, and terms of their surroundings that disclose them, by corpus co-occurrence.

A protected entity is a base match's value. A term (a word of two letters or more, lower-cased) within ``REACH`` terms of an
entity co-occurs with it. The corpus says how strongly it discloses the entity: ``p``, the share of the documents with the
term in which the two co-occur, and the information that the term gives about the entity, ``log2(p / P(entity))`` bits. From
``GENERALISE`` and ``BITS`` on a term is generalised, from ``REMOVE`` on removed, in every document where it co-occurs with that
entity and at every place there, in however few documents: most entities occur in one. All documents count.

Co-occurrence is near the entity, not anywhere in its document: that bounds the pairs by the entities' number, and in a
corpus where most entities occur once every rare word of a long document would otherwise count as disclosing.

Base patterns are matched in linear time: each stands for the leftmost, non-overlapping matches of its expression.

Defined cases: a null text is empty; null ids are kept; repeated rows get the same spans and count as documents; an empty
table gives an empty result; extra columns are not read (``sanitise`` returns them untouched).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visparq.llm._common import durable, spread_join, struct_to_batch, workers_can_import, wrapped

KINDS = ("email", "ip", "card", "phone", "term", "drop")
REACH, GENERALISE, REMOVE, BITS = 4, 0.5, 0.9, 4.0
FLUSH, SLICE = 400_000, 1024

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{2,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Only a run of local characters that ends at an @ can begin a match, so each @ is looked at once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    own = [int(d) for d in reversed(digits)]
    return (sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as its number, end) of every base match that passes its check, in order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _key(value: str) -> int:
    import xxhash

    n = xxhash.xxh64_intdigest(value.encode())
    return n - (1 << 64) if n >> 63 else n


def surroundings(text: str, base: list[tuple[int, int, int]]) -> tuple[list[dict], list[dict]]:
    """The text's pairs (term, entity), each once, and all places of their terms outside all entities."""
    free, k = [], 0
    covered = sorted((a, b) for a, _, b in base)
    for m in _TERM.finditer(text):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if k == len(covered) or covered[k][0] >= m.end():
            free.append((m.start(), m.end(), m[0].lower()))
    starts = [a for a, _, _ in free]
    pairs: dict[tuple[str, int], None] = {}
    for a, kind, b in base:
        entity, left, right = _key(f"{kind}:{text[a:b]}"), bisect_left(starts, a), bisect_left(starts, b)
        pairs.update(dict.fromkeys((t, entity) for _, _, t in free[max(0, left - REACH) : left] + free[right : right + REACH]))
    terms = {t: _key(t) for t, _ in pairs}
    return [{"term": terms[t], "entity": e} for t, e in pairs], [{"term": terms[t], "start": a, "end": e} for a, e, t in free if t in terms]


SPAN = "struct<kind:int,start:long,end:long>"
PAIR, PLACE = "struct<term:long,entity:long>", "struct<term:long,start:long,end:long>"


def _scan(docs: DataFrame) -> DataFrame:
    """One reading of all texts: a row per document, and rows of term counts (documents with the term, by task)."""
    workers_can_import(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    pair = pa.list_(pa.struct([("term", pa.int64()), ("entity", pa.int64())]))
    place = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()

        def rows(n: int, **columns: tuple) -> pa.RecordBatch:
            kinds = {"doc_id": pa.int64(), "text_key": pa.int64(), "base": span, "pairs": pair, "places": place, "entities": pa.list_(pa.int64()), "term": pa.int64(), "n_docs": pa.int64()}
            return struct_to_batch({k: (columns.get(k, [None] * n), t) for k, t in kinds.items()})

        def counts() -> Iterator[pa.RecordBatch]:
            whole = list(count)
            for names in (whole[k : k + 20_000] for k in range(0, len(whole), 20_000)):
                yield rows(len(names), term=[_key(t) for t in names], n_docs=[count[t] for t in names])

        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            base, about, entities = [], [], []
            for text in b.column("text").to_pylist():
                count.update({t.lower() for t in set(_TERM.findall(text))})
                own = find_base(text)
                base.append([{"kind": k, "start": a, "end": e} for a, k, e in own])
                about.append(surroundings(text, own) if own else ([], []))
                entities.append(list({_key(f"{k}:{text[a:e]}") for a, k, e in own}))
            yield rows(b.num_rows, doc_id=b.column("doc_id").to_pylist(), text_key=b.column("text_key").to_pylist(), base=base, pairs=[x for x, _ in about], places=[x for _, x in about], entities=entities)
            if len(count) > FLUSH:
                yield from counts()
                count.clear()
        yield from counts()

    return own.mapInArrow(run, f"doc_id long, text_key long, base array<{SPAN}>, pairs array<{PAIR}>, places array<{PLACE}>, entities array<long>, term long, n_docs long")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), base and terms (arrays of kind, start, end) of every document."""
    scan = durable(_scan(docs).withColumn("row", F.monotonically_increasing_id()), "scan")
    own = scan.where("term IS NULL").select("row", "doc_id", "text_key", "base", "pairs", "places", "entities")
    total = own.count()
    about = own.where("size(pairs) > 0").select("row", F.explode("pairs").alias("pair"))
    pairs = durable(about.groupBy("pair").agg(F.count("*").alias("together")), "pairs").select("pair", "pair.*", "together")
    often = scan.where("term IS NOT NULL").groupBy("term").agg(F.sum("n_docs").alias("with_term"))
    known = own.where("size(entities) > 0").select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("with_entity"))
    posterior = F.col("together") / F.col("with_term")
    told = pairs.join(often, "term").join(known, "entity").withColumn("posterior", posterior).where((F.col("posterior") >= GENERALISE) & (F.log2(F.col("posterior") * total / F.col("with_entity")) >= BITS))
    told = durable(told.select("pair", F.when(F.col("posterior") >= REMOVE, 5).otherwise(4).alias("kind")), "disclosing")
    found = spread_join(about, told, "pair", F.col("row")).groupBy("row", "pair.term").agg(F.max("kind").alias("kind"))
    kinds = found.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("kinds"))
    joined = own.join(kinds.hint("merge"), "row", "left")
    spans = F.expr("transform(filter(places, p -> map_contains_key(kinds, p.term)), p -> struct(kinds[p.term] AS kind, p.start AS start, p.end AS end))")
    return joined.select("doc_id", "text_key", "base", F.coalesce(spans, F.expr(f"CAST(array() AS array<{SPAN}>)")).alias("terms"))


def of_kind(spans, kind: int):
    return F.filter(spans, lambda s: s["kind"] == kind)


def span_string(spans):
    """``kind:start:end`` by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def rewrite(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Entities and generalised terms give way to their kind; removed terms to nothing. Overlaps: the earlier, longer one."""
    out, at = [], 0
    for a, k, b in sorted(spans, key=lambda s: (s[0], -s[2], s[1])):
        if a >= at:
            out += (text[at:a], "" if KINDS[k] == "drop" else f"[{KINDS[k].upper()}]")
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with rewritten texts, all other columns as they were.

    A text with neither a digit nor an @ holds no entity and passes unshuffled; the others meet their terms' spans by id.
    """
    found = detect(docs).where("size(terms) > 0").groupBy("doc_id", "text_key").agg(F.first("terms").alias("terms"))
    whole, columns = wrapped(docs), docs.columns
    may = F.coalesce(F.col("doc.text").rlike("[0-9@]"), F.lit(False))
    held = whole.where(may).withColumn("id", F.col("doc.doc_id").cast("long")).withColumn("key", F.xxhash64("doc.text"))
    held = held.join(found.hint("merge"), (held.key == found.text_key) & held.id.eqNullSafe(found.doc_id), "left")
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [b.column(k) for k in range(len(columns))]
            texts = [rewrite(t, find_base(t) + [(s["start"], s["kind"], s["end"]) for s in more or []]) for t, more in zip(own[at].to_pylist(), b.column(len(columns)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(own)], names=columns)

    flat = held.select(*(F.col("doc").getField(c).alias(f"c{k}") for k, c in enumerate(columns)), "terms")
    return docs.where(~F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))).unionByName(flat.mapInArrow(run, docs.schema))
