"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its assistant texts are laid over
the sorted token spans by binary search. The template's markers are special tokens of the tokenizer, so no token reaches
across a span's edge. Control strings inside texts are broken by a backslash, and backslashes doubled: ``unescape``
restores every text.

Defined cases: null text or role: empty; turns are ordered by (turn, role, text), nulls first; repeated rows are turns of
their own; conversations without a conv_id form one conversation with a null id; an empty table gives an empty result;
extra columns are not read. One output row holds one whole conversation: that is the format, and its only bound.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visparq.llm._common import struct_to_batch, workers_can_import

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that steer this or other public chat templates.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_PAIR = re.compile(r"\\(.)", re.DOTALL)
_TURNS = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)
ROW = "conv_id long, n_turns long, formatted string, input_ids array<int>, loss_mask binary, loss_spans array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _PAIR.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's string and the sorted spans of its assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back from the string."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURNS.finditer(formatted)]


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for each token that lies within a span; both sides sorted, two binary searches a span."""
    mask = np.zeros(len(starts), np.uint8)
    if spans:
        edge = np.array(spans)
        for lo, hi in zip(np.searchsorted(starts, edge[:, 0], "left"), np.searchsorted(ends, edge[:, 1], "right"), strict=True):
            mask[lo:hi] = 1
    return mask


def masked_spans(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The character spans under the mask, one for each run of masked tokens."""
    edge = np.diff(np.concatenate(([0], mask, [0])).astype(np.int8))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _tokenizer(vocabulary: str):
    from tokenizers import AddedToken, Tokenizer

    tok = Tokenizer.from_file(vocabulary)
    tok.no_truncation()
    tok.no_padding()
    tok.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in (TURN, TEXT, END)])
    return tok


def format_conversations(rows: DataFrame, vocabulary: str) -> DataFrame:
    """One row per conversation: formatted, input_ids, loss_mask (a byte a token), loss_spans (code points)."""
    workers_can_import(rows.sparkSession)
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns")).select("conv_id", F.expr("transform(turns, t -> struct(t.role AS role, t.text AS text))").alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                out = {n: [] for n in ("conv_id", "n_turns", "formatted", "input_ids", "loss_mask", "loss_spans")}
                for conv, turns in zip(part.column("conv_id").to_pylist(), part.column("turns").to_pylist(), strict=True):
                    formatted, spans = render([(t["role"], t["text"]) for t in turns])
                    enc = tok.encode(formatted, add_special_tokens=False)
                    offsets = np.array(enc.offsets, np.int64).reshape(-1, 2)
                    mask = mask_tokens(offsets[:, 0], offsets[:, 1], spans)
                    for k, v in zip(out, (conv, len(turns), formatted, enc.ids, mask.tobytes(), [{"start": a, "end": b} for a, b in masked_spans(mask, offsets[:, 0], offsets[:, 1])]), strict=True):
                        out[k].append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield struct_to_batch({k: (v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    return whole.mapInArrow(run, ROW)


def digests(formatted: DataFrame) -> DataFrame:
    """What stands in the formatted conversations, read back from them: turns and the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns, loss, chars = [], [], []
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist(), strict=True):
                turns.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in parse(text)).encode()).hexdigest())
                own = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                loss.append(hashlib.sha256(own.encode()).hexdigest())
                chars.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("n_turns"), pa.array(turns, pa.string()), pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array([len(t) for t in b.column("formatted").to_pylist()], pa.int64())],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.select("conv_id", "n_turns", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
