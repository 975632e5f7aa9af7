"""Best-fit packing by a plan over the histogram of lengths.

1. Every whole text becomes ids plus an end id; only a text longer than the capacity is cut, into full pieces and a rest.
2. Lengths are counted per (length, part), a part being what one task cut: at most ``capacity * PARTS`` counts. More parts than
   PARTS are counted by ``SALTS`` salts instead, by a piece's place in its part.
3. The driver packs *counts* best-fit, longest first. Its plan is a list of slot ranges (ranks of one length -> consecutive
   sequences, one offset), whose number depends on the capacity alone.
4. A piece takes the slot of its rank within its length: the part's base plus the rank within (length, part), which the task
   that cut it counted; so nothing is shuffled. By salts, the rank within (length, salt) comes from a window, and a length
   that holds most pieces is still ranked by many tasks.

Defined cases: a null text is empty and still holds its end id; a null id is kept; repeated rows are packed once each;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visparq.llm._common import durable, struct_to_batch, texts_of
from visparq.llm.wordbpe import WordBpe

SALTS, PARTS = 256, 1024
SLICE = 2048


def cut(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part (the task's number), turn (the piece's number in it), rank (among those of
    its length in the part, from 1) and, if asked for, the ids (little-endian uint32)."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, width, number, turn = WordBpe.at(vocabulary), 4 * capacity, TaskContext.get().partitionId(), 0
        met = [0] * (capacity + 1)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                part = whole.slice(at, SLICE)
                ids, piece, start, length, crc, rank, kept = [], [], [], [], [], [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    raw = bpe.ids(text) + end
                    for k, s in enumerate(range(0, len(raw), width)):
                        own = raw[s : s + width]
                        ids.append(doc)
                        piece.append(k)
                        start.append(s // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        met[len(own) // 4] += 1
                        rank.append(met[len(own) // 4])
                        if keep_ids:
                            kept.append(own)
                out = {"doc_id": (ids, pa.int64()), "piece": (piece, pa.int32()), "start": (start, pa.int64()), "length": (length, pa.int64()), "ids_crc32": (crc, pa.int64()), "part": ([number] * len(ids), pa.int32()), "turn": (range(turn, turn + len(ids)), pa.int64()), "rank": (rank, pa.int64())}
                turn += len(ids)
                yield struct_to_batch(out | ({"ids": (kept, pa.binary())} if keep_ids else {}))

    return texts_of(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, turn long, rank long" + ", ids binary" * keep_ids)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts, longest first: (length, first rank, how many, first sequence, offset) ranges."""
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by what is left: (first sequence, how many)
    ranges, made = [], 0
    for length in sorted(counts, reverse=True):
        rank, left, room = 0, counts[length], length
        while left and room <= capacity:
            if not free[room]:
                room += 1
                continue
            first, many = free[room].pop()
            take = min(left, many)
            if many > take:
                free[room].append((first + take, many - take))
            ranges.append((length, rank, take, first, capacity - room))
            free[room - length].append((first, take))
            rank, left = rank + take, left - take
            if room - length >= length:
                room -= length  # what was just made fits more tightly
        each = capacity // length
        for per, many in ((each, left // each), (left % each, 1)):
            if per and many:
                for k in range(per):
                    ranges.append((length, rank, many, made, k * length))
                    rank += many
                free[capacity - per * length].append((made, many))
                made += many
    return ranges


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset: one row per piece, each placed in a sequence."""
    pieces = durable(cut(docs, vocabulary, capacity, end_id, keep_ids), "pieces")
    keep = [c for c in pieces.columns if c not in ("part", "turn", "rank")]
    parts = 1 + (pieces.agg(F.max("part")).first()[0] or 0)
    ranked = pieces
    if parts > PARTS:
        salted = pieces.withColumn("part", F.pmod(F.xxhash64("part", "turn"), F.lit(SALTS)).cast("int"))
        order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
        ranked, parts = salted.withColumn("rank", F.row_number().over(order).cast("long")), SALTS
        counts = salted.groupBy("length", "part").count()
    else:
        counts = pieces.groupBy("length", "part").agg(F.max("rank").alias("count"))
    # At most capacity * PARTS rows (2,097,152 with the defaults) reach the driver, as arrays.
    rows = counts.toArrow()
    per = np.zeros((capacity + 1, parts), np.int64)
    per[rows.column("length").to_numpy(), rows.column("part").to_numpy()] = rows.column("count").to_numpy()
    base = np.cumsum(per, axis=1) - per
    totals = {int(n): int(c) for n, c in enumerate(per.sum(axis=1)) if c}
    ranges = sorted(plan(totals, capacity))
    table = np.array(ranges, np.int64).reshape(-1, 5)
    # Positions on one line: lengths one after the other, each as long as its count.
    line = np.zeros(capacity + 2, np.int64)
    line[1:] = np.cumsum(per.sum(axis=1))
    shared = docs.sparkSession.sparkContext.broadcast((base, line, line[table[:, 0]] + table[:, 1], table[:, 3], table[:, 4]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, line, starts, sequence, offset = shared.value
        for b in batches:
            if b.num_rows:
                length, part, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "part", "rank"))
                at = line[length] + base[length, part] + rank - 1
                k = np.searchsorted(starts, at, "right") - 1
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sequence[k] + at - starts[k]), pa.array(offset[k])], names=[*keep, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in keep)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")
