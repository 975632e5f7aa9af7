"""JSON out of prose, declared claim documents, detections, and size-bounded documents."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from visparq import schema as S

THINK = r"(?is)<think>.*?</think>"


def salvage(reply: Column) -> dict[str, Column]:
    """document (JSON text) and strategy of the first reading that parses: whole, without thoughts, braces, brackets."""
    plain = F.trim(reply)
    tries = [("direct", plain), ("think", F.trim(F.regexp_replace(reply, THINK, ""))), ("braces", F.regexp_extract(reply, r"(?s)(\{.*\})", 1)), ("brackets", F.regexp_extract(reply, r"(?s)(\[.*\])", 1))]
    good = [(n, F.when(t != "", t), F.try_parse_json(F.when(t != "", t)).isNotNull()) for n, t in tries]
    document, strategy = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, t, ok in reversed(good):
        document, strategy = F.when(ok, t).otherwise(document), F.when(ok, F.lit(n)).otherwise(strategy)
    return {"document": document, "strategy": strategy}


def claims(document: Column) -> Column:
    """The declared claim document; absent arrays are empty, an unparsed reply has none."""
    parsed = F.from_json(F.coalesce(document, F.lit("{}")), S.CLAIMS, {"mode": "PERMISSIVE"})
    empty = lambda c: F.coalesce(parsed[c], F.from_json(F.lit("[]"), F.lit({"claims": "array<struct<claim:string,kind:string,box:" + S.BOX + ",confidence:double,evidence:string>>", "text_items": "array<struct<text:string,box:" + S.BOX + ",confidence:double,legible:boolean>>"}.get(c, "array<string>"))))
    return F.struct(document.isNotNull().alias("parsed"), parsed["summary"].alias("summary"), empty("claims").alias("claims"), empty("text_items").alias("text_items"), empty("observations").alias("observations"), empty("unreadable").alias("unreadable"), parsed["counts"].alias("counts"))


def detections(reply: Column) -> Column:
    """Array of (type, x, y, width, height, label) from the widest bracketed part: a type and numeric x, y are needed."""
    kind = "array<struct<type:string,x:double,y:double,width:double,height:double,label:string>>"
    found = F.from_json(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), kind)
    good = F.filter(F.coalesce(found, F.from_json(F.lit("[]"), kind)), lambda d: d["type"].isNotNull() & d["x"].isNotNull() & d["y"].isNotNull())
    size = lambda v, least, default: F.greatest(F.lit(float(least)), F.when((v == 0) | v.isNull(), float(default)).otherwise(v))
    return F.transform(good, lambda d: F.struct(d["type"].alias("type"), d["x"].alias("x"), d["y"].alias("y"), size(d["width"], 10, 50).alias("width"), size(d["height"], 10, 20).alias("height"), d["label"].alias("label")))


# -- size-bounded JSON ------------------------------------------------------------------------------------------------
#: Room kept for the record of what was cut, the least budget, what counts as a long text, rounds of cutting,
#: and what stands for a cut text.
RESERVE, LEAST_BUDGET, LONG_TEXT, ROUNDS = 800, 1024, 256, 64
CUT_TEXT = "…[truncated {0} chars to keep this response valid JSON]"


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) + sum(c > "￿" for c in text)


def dump(value, pretty: bool) -> str:
    def number(v):
        if isinstance(v, float) and v.is_integer() and abs(v) < 1e21:
            return int(v)
        if isinstance(v, dict):
            return {k: number(x) for k, x in v.items()}
        return [number(x) for x in v] if isinstance(v, list) else v

    return json.dumps(number(value), ensure_ascii=False, indent=2 if pretty else None, separators=(",", ": " if pretty else ":"))


def _places(node, at: tuple = ()) -> Iterator[tuple[tuple, object]]:
    """(path, value) of a document's parts, parents first."""
    yield at, node
    inner = enumerate(node) if isinstance(node, list) else node.items() if isinstance(node, dict) else ()
    for k, child in inner:
        yield from _places(child, (*at, k))


def _named(path: tuple) -> str:
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else f".{k}" for k in path)


def _cut(node, edits: dict[tuple, int | str], at: tuple = ()):
    """The document with edits by path: a number keeps that many items of a list, a text stands for a text."""
    edit = edits.get(at)
    if isinstance(edit, str):
        return edit
    if isinstance(node, list):
        return [_cut(child, edits, (*at, k)) for k, child in enumerate(node[:edit])]
    return {k: _cut(child, edits, (*at, k)) for k, child in node.items()} if isinstance(node, dict) else node


def _least(low: int, high: int, good: Callable[[int], bool]) -> int:
    """The least number in low..high that is good, if those above a good one are too; ``high`` if none is."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if good(middle) else (middle + 1, high)
    return low


def _trimmed(value, budget: int) -> tuple[object, list[dict]]:
    """As few long texts shortened, longest first, and then as few items of the longest lists left out as fit the budget."""
    edits: dict[tuple, int | str] = {}
    fits = lambda more: units(dump(_cut(value, edits | more), True)) <= budget
    texts = sorted(((p, units(t)) for p, t in _places(value) if p and isinstance(t, str) and units(t) > LONG_TEXT), key=lambda x: -x[1])
    short = [(p, CUT_TEXT.format(n)) for p, n in texts]
    many = _least(0, len(short), lambda k: fits(dict(short[:k])))
    edits |= dict(short[:many])
    actions = [{"action": "shortened_string", "path": _named(p), "original_chars": n} for p, n in texts[:many]]
    for _ in range(ROUNDS):
        lists = [(p, len(x)) for p, x in _places(_cut(value, edits)) if isinstance(x, list) and len(x) > 1]
        if not lists or fits({}):
            break
        path, was = max(lists, key=lambda x: x[1])
        gone = _least(1, was - 1, lambda k: fits({path: was - k}))  # noqa: B023
        edits[path] = was - gone
        actions.append({"action": "dropped_array_items", "path": _named(path), "dropped": gone, "remaining": was - gone, "was": was})
    return _cut(value, edits), actions


def _contrast(value: dict) -> dict | None:
    return (value.get("measurements") or {}).get("contrast") if isinstance(value, dict) else None


#: The verdict's scalars, what a skeleton keeps besides, and the lists it empties.
VERDICT = ("verdict", "all_meet_aa", "wcag_aa", "measurable", "failing_count", "passing_count", "evaluated_count", "worst", "best", "cluster_tolerance")
DISCLOSED, EMPTIED, OUTER = ("background_mode", "notes", "model_disagreement", "background_fit"), ("colours", "excluded", "skipped", "suspected_noise", "background_regions", "panel_fills"), ("notes", "abstained", "disclaimer")


def _reduced(value, whole: bool) -> dict:
    """The verdict with its disclosures (``whole``), or its scalars alone."""
    out = {"success": isinstance(value, dict) and value.get("success") is True}
    c = _contrast(value)
    if whole:
        out["truncated_to"] = "verdict_skeleton"
        out |= {k: value[k] for k in ("mode", "region", "dimensions") if k in value}
    elif c:
        out["truncated_to"] = "verdict"
    if c:
        own = {k: c[k] for k in VERDICT + (DISCLOSED if whole else ()) if k in c}
        if whole:
            own |= {k: [] for k in EMPTIED}
        else:
            for k in ("worst", "best"):
                own[k] = {n: c[k][n] for n in ("foreground", "contrast_ratio") if n in c[k]} if c.get(k) else None
        out["measurements"] = {"contrast": own}
    if whole:
        out |= {k: value[k] for k in OUTER if k in value}
    return out


def bound_json(value, most: int = S.RESPONSE_CHARS) -> str:
    """Valid JSON of at most ``most`` characters where any form fits: pretty, compact, long texts shortened, long arrays cut,
    verdict with disclosures, verdict alone, and last an envelope that admits failure."""
    for pretty in (True, False):
        if units(text := dump(value, pretty)) <= most:
            return text
    value, actions = _trimmed(value, max(LEAST_BUDGET, most - RESERVE))
    cut = {"truncated": True, "max_chars": most, "actions": actions}
    forms = [(value, "Texts were shortened or lists trimmed so that this stays valid JSON; trimmed lists are incomplete."), (_reduced(value, True), "Reduced to the verdict and its disclosures; lists of colours were dropped."), (_reduced(value, False), None)]
    for k, (form, note) in enumerate(forms):
        if isinstance(form, dict):
            record = cut | {"note": note} if note else {"truncated": True, "max_chars": most, "dropped": f"{len(actions)} size reductions"}
            if units(text := dump(form | {"_truncation": record}, k == 0)) <= most:
                return text
    return dump({"success": False, "_truncation": cut | {"note": "Too large even as a verdict; nothing was returned."}}, False)


def truncate_json(most: int = S.RESPONSE_CHARS):
    """An Arrow scalar UDF of ``bound_json`` over JSON texts: recursive mutation has no relational form."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else bound_json(json.loads(t), most))

    return cut
