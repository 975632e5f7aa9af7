"""Exact token counts at every prefix.

``count_tokens`` runs the dynamic programme of ``wordbpe`` over every whole text and keeps the exact count at every prefix, as
the step that each code point adds, packed. The text's count is the last entry. ``count_prefix`` and ``longest_within``
answer truncation and budget questions from what is stored: nothing is encoded again, the text itself is not read.

Defined cases: a null text counts as empty (0 tokens); a null id is kept; repeated rows give repeated rows; an empty
table gives an empty result; columns besides the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visparq.llm._common import texts_of
from visparq.llm.wordbpe import WordBpe

SLICE = 256


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, steps (zstd of little-endian int16, one a code point) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        bpe, squeeze = WordBpe.at(vocabulary), zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                part = whole.slice(at, SLICE)
                own = [bpe.prefix_deltas(t) for t in part.column("text").to_pylist()]
                sizes = pa.compute.cast(pa.compute.binary_length(part.column("text")), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, pa.array([n for _, n in own], pa.int64()), pa.array([squeeze.compress(d) for d, _ in own], pa.binary())], names=["doc_id", "n_bytes", "n_tokens", "steps"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, steps binary")


def prefix_counts(steps: bytes) -> np.ndarray:
    """Entry j: the exact count of the text's first j code points."""
    import zstandard

    return np.concatenate(([0], np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(steps), "<i2"), dtype=np.int64)))


def count_prefix(steps: bytes, length: int) -> int:
    """Exact count of the text's first ``length`` code points (a longer length: of all)."""
    counts = prefix_counts(steps)
    return int(counts[min(length, len(counts) - 1)])


def longest_within(steps: bytes, budget: int) -> int:
    """How many code points the longest prefix has that counts ``budget`` tokens or fewer (a longer one may count fewer)."""
    return int(np.flatnonzero(prefix_counts(steps) <= budget)[-1])


def fits(docs: DataFrame, vocabulary: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    return count_tokens(docs, vocabulary).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
