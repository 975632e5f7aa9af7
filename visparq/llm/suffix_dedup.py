"""Removal of byte strings that repeat across documents: suffixes sorted one bucket at a time, long ties by cover ranks.

A byte goes if a ``LENGTH``-byte string over it also starts in a document with a smaller id.

* Texts are packed once into compressed blocks in the shared folder; both passes read those, so a lost executor costs a
  task's work and nothing else.
* **Dealing.** A suffix is dealt by its *anchor*, the least-hashed ``ANCHOR``-byte string within its first LENGTH bytes.
  Equal LENGTH-byte strings have equal anchors, and neighbours mostly share one: a run of suffixes with one anchor is one
  string (about 70 bytes for 20 suffixes). First only the anchors' hashes are exchanged, a few bytes each; then the strings
  over anchors that some other string shares. Strings that repeat within a block travel once, with their least id.
* **One bucket at a time.** A bucket sorts the suffixes of its strings on bytes, at most ``CHUNK`` suffixes at once: first by ``PREFIX`` bytes, then, where these tie, by ranks of a
  **difference-cover sample**. The sample holds the suffixes at places ``p`` with ``p mod PERIOD`` in ``COVER``; the cover has
  every difference modulo its period, so any two tied suffixes have a common shift at which both are sampled, and the
  precomputed ranks of these two (at the depth that is left) decide. Ties are partitioned around pivots, all at once.
* A bucket answers with one bit a suffix: it starts in a document with a smaller id. Blocks join their answers.

Nothing rests on hashes: they only deal. Equality is equality of bytes, or of ranks of strings sorted by their bytes.

Defined cases: a null text is empty; a null id sorts before all others; rows with one id never remove from each other;
texts shorter than LENGTH lose nothing; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visparq.llm._common import durable, struct_to_batch, texts_of

LENGTH, PERIOD, COVER, PREFIX, ANCHOR = 50, 31, (0, 1, 3, 8, 12, 18), 32, 16
BLOCK_BYTES, BUCKET_BYTES, BUCKET_ANCHORS, CHUNK = 4 << 20, 12 << 20, 3_000_000, 1_500_000
HASH_BITS = 64  # of anchors at most; any number gives the same result
PAD = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


# -- packing ----------------------------------------------------------------------------------------------------------
def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit values as byte planes of their differences, low planes first."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    first, gaps[0] = int(values[0]), 0
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return first.to_bytes(8, "little") + bytes([width]) + np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    width = raw[8]
    planes = np.frombuffer(raw, np.uint8, offset=9).reshape(width, -1)
    full = np.zeros((planes.shape[1], 8), np.uint8)
    full[:, :width] = planes.T
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64) + np.uint64(int.from_bytes(raw[:8], "little"))


def pack_ids(ids: np.ndarray) -> bytes:
    """Signed 64-bit ids as their distance from the least, in as few bytes each as that needs."""
    if not len(ids):
        return b""
    least = int(ids.min())
    gaps = ids.astype(np.uint64) - np.uint64(least & (2**64 - 1))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return least.to_bytes(8, "little", signed=True) + bytes([width]) + np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack_ids(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    width = raw[8]
    planes = np.frombuffer(raw, np.uint8, offset=9).reshape(width, -1)
    full = np.zeros((planes.shape[1], 8), np.uint8)
    full[:, :width] = planes.T
    return (full.view("<u8").ravel() + np.uint64(int.from_bytes(raw[:8], "little", signed=True) & (2**64 - 1))).astype(np.int64)


def ranks_of(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Dense ranks of ids; unknown ones (``known`` false) are equal and come first."""
    order = np.lexsort((np.where(known, ids, 0), known))
    new = np.concatenate(([False], (ids[order][1:] != ids[order][:-1]) & known[order][1:] | (known[order][1:] != known[order][:-1])))
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(new[: len(ids)])
    return out


def _ramps(sizes: np.ndarray) -> np.ndarray:
    """0..n-1 for each n in turn."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


# -- blocks -----------------------------------------------------------------------------------------------------------
def to_blocks(docs: DataFrame) -> DataFrame:
    """block_id, n_bytes, doc_ids, known, lengths, text: whole documents together, BLOCK_BYTES or a little more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze, part, made = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0
        ids, raws, size = [], [], 0

        def row() -> pa.RecordBatch:
            own, known = np.array([d or 0 for d in ids], "<i8"), np.array([d is not None for d in ids])
            lengths = np.array([len(r) for r in raws], "<i8")
            return struct_to_batch({"block_id": ([(part << 32) | made], pa.int64()), "n_bytes": ([size], pa.int64()), "doc_ids": ([own.tobytes()], pa.binary()), "known": ([known.tobytes()], pa.binary()), "lengths": ([lengths.tobytes()], pa.binary()), "text": ([squeeze.compress(b"".join(raws))], pa.binary())})

        for b in batches:
            for doc, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes()
                ids.append(doc.as_py())
                raws.append(raw)
                size += len(raw)
                if size >= BLOCK_BYTES:
                    yield row()
                    ids, raws, size, made = [], [], 0, made + 1
        if ids:
            yield row()

    return texts_of(docs).mapInArrow(run, "block_id long, n_bytes long, doc_ids binary, known binary, lengths binary, text binary")


def _least_anchors(padded: bytes, first: int, count: int) -> np.ndarray:
    """For ``count`` places from ``first`` on: the least hash of an ANCHOR-byte string in the place's LENGTH bytes."""
    size, wide = 1, LENGTH - ANCHOR + 1
    low, high = (np.ndarray((count + wide - 1,), "<u8", padded, first + off, (1,)) for off in (0, 8))
    h = low * _MIX
    h ^= h >> np.uint64(32)
    h += high
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _MIX
    while 2 * size <= wide:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (wide - size)], h[wide - size :]) if wide > size else h


class Block:
    """A block's bytes and its strings: runs of suffixes with one anchor."""

    def __init__(self, row: dict, bits: int):
        import zstandard

        self.ids, self.known, self.lengths = (np.frombuffer(row[c], t) for c, t in (("doc_ids", "<i8"), ("known", bool), ("lengths", "<i8")))
        self.raw = zstandard.ZstdDecompressor().decompress(row["text"]) if self.lengths.sum() else b""
        self.n = len(self.raw)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.start, self.count, anchor = self._runs()
        anchor *= _MIX
        anchor ^= anchor >> np.uint64(31)
        anchor *= _MIX
        anchor >>= np.uint64(64 - bits)
        self.anchors, self.kind = np.unique(anchor, return_inverse=True)

    def choose(self, answers: list[dict] | None, buckets: int, bits: int) -> None:
        """Keep the runs over anchors that another run here or another block has; equal runs become one string."""
        shared = np.bincount(self.kind, minlength=len(self.anchors)) > 1
        said = {a["bucket"]: a["bits"] for a in answers or []}
        for bucket, part in _dealt(self.anchors, buckets, bits):
            if bucket in said:
                shared[part] |= _unpacked(said[bucket], part.stop - part.start)
        own = np.flatnonzero(shared[self.kind])
        self.start, self.count, anchor = self.start[own], self.count[own], self.anchors[self.kind[own]]
        seen: dict[bytes, int] = {}
        self.which = np.array([seen.setdefault(self.raw[a:b], len(seen)) for a, b in zip(self.start.tolist(), (self.start + self.count + LENGTH - 1).tolist(), strict=True)], np.int64)
        self.strings = list(seen)
        self.sizes = np.zeros(len(seen), np.int64)
        self.sizes[self.which] = self.count
        self.anchor = np.zeros(len(seen), np.uint64)
        self.anchor[self.which] = anchor
        rank = ranks_of(self.ids, self.known)
        self.rank = rank[np.searchsorted(self.starts, self.start, "right") - 1]
        self.least = np.full(len(seen), len(rank), np.int64)
        np.minimum.at(self.least, self.which, self.rank)
        by_rank = np.zeros(len(rank), np.int64)
        by_rank[rank] = np.arange(len(rank))
        self.owner = by_rank[self.least]  # a document with the string's least id

    def _runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each run starts, how many suffixes it has, and its anchor's hash. Found stripe by stripe of long blocks."""
        padded, step = self.raw + bytes(PAD), 1 << 22
        long = self.lengths >= LENGTH
        edge = np.zeros(self.n + 1, np.int8)
        edge[self.starts[long]] += 1
        edge[(self.starts + self.lengths - LENGTH + 1)[long]] -= 1
        starts, anchors, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        valid, before, last = 0, False, np.uint64(0)
        for a in range(0, max(0, self.n - LENGTH + 1), step):
            m = min(step, self.n - LENGTH + 1 - a)
            inside = np.cumsum(edge[a : a + m], dtype=np.int8) + np.int8(valid)
            ok, hashes = inside > 0, _least_anchors(padded, a, m)
            prior = np.concatenate(([before], ok[:-1]))
            other = np.concatenate(([last], hashes[:-1])) != hashes
            at = np.flatnonzero(ok & (~prior | other))
            starts.append(at + a)
            anchors.append(hashes[at])
            ends.append(np.flatnonzero(prior & (~ok | other)) + a)
            valid, before, last = int(inside[-1]), bool(ok[-1]), hashes[-1]
        start, end = np.concatenate(starts), np.concatenate(ends)
        if len(end) < len(start):
            end = np.append(end, self.n - LENGTH + 1)
        return start, end - start, np.concatenate(anchors)

    def dealt(self, buckets: int, bits: int) -> Iterator[tuple[int, np.ndarray]]:
        """The strings of each bucket, in the order of their anchors."""
        order = np.argsort(self.anchor, kind="stable")
        for bucket, part in _dealt(self.anchor[order], buckets, bits):
            yield bucket, order[part]

    def removed(self, answers: list[dict] | None, buckets: int, bits: int) -> np.ndarray:
        """True for each byte that goes."""
        hits = np.zeros(int(self.sizes.sum()), bool)
        first = np.cumsum(self.sizes) - self.sizes
        said = {a["bucket"]: a["bits"] for a in answers or []}
        for bucket, own in self.dealt(buckets, bits) if said else ():
            if bucket in said:
                n = int(self.sizes[own].sum())
                hits[np.repeat(first[own], self.sizes[own]) + _ramps(self.sizes[own])] = _unpacked(said[bucket], n)
        total = np.concatenate(([0], np.cumsum(hits)))
        later = self.rank > self.least[self.which]
        some = np.flatnonzero(later | (total[first + self.sizes] > total[first])[self.which])
        ramp = _ramps(self.count[some])
        gone = np.repeat(later[some], self.count[some]) | hits[np.repeat(first[self.which[some]], self.count[some]) + ramp]
        at = (np.repeat(self.start[some], self.count[some]) + ramp)[gone]
        edge = np.zeros(self.n + 1, np.int32)
        edge[at] += 1  # each place once
        edge[at + LENGTH] -= 1
        return np.cumsum(edge[:-1]) > 0


def _dealt(anchors: np.ndarray, buckets: int, bits: int) -> Iterator[tuple[int, slice]]:
    """The buckets' shares, by ranges, of sorted anchors."""
    bounds = [((k << bits) + buckets - 1) // buckets for k in range(1, buckets)]
    cut = [0, *np.searchsorted(anchors, np.array(bounds, np.uint64)).tolist(), len(anchors)]
    yield from ((k, slice(a, b)) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a)


def _packed(bits: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes())


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    import zstandard

    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8), count=n).astype(bool)


# -- sorting ----------------------------------------------------------------------------------------------------------
@cache
def _shifts() -> np.ndarray:
    """[a, b]: the least shift at which places congruent to a and b are both in the cover."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    a, b, k = np.ogrid[:PERIOD, :PERIOD, :PERIOD]
    return np.argmax(inside[a + k] & inside[b + k], axis=2)


def _words(padded: bytes, places: np.ndarray, width: int) -> list[np.ndarray]:
    """The ``width`` bytes from each place as big-endian numbers, most significant first."""
    n = len(padded) - PAD
    out = [np.ndarray((n,), ">u8", padded, off, (1,))[places].astype(np.uint64) for off in range(0, width - 7, 8)]
    if width % 8:
        out.append(np.ndarray((n,), ">u8", padded, width // 8 * 8, (1,))[places].astype(np.uint64) >> np.uint64(8 * (8 - width % 8)))
    return out


class CoverRanks:
    """Ranks of the cover sample around given places, at every depth that a shift can leave."""

    def __init__(self, padded: bytes, places: np.ndarray):
        n = len(padded) - PAD
        edge = np.zeros(n + PERIOD + 1, np.int32)
        edge[places] += 1  # each place once
        edge[places + PERIOD] -= 1
        cover = np.tile(np.isin(np.arange(PERIOD), COVER), -(-n // PERIOD))[:n]
        sample = np.flatnonzero((np.cumsum(edge)[:n] > 0) & cover)
        words = _words(padded, sample, LENGTH)
        order = np.lexsort(words[::-1])
        self.at = np.zeros(n + 1, np.int32)
        self.at[sample[order]] = np.arange(len(sample))
        # Common bytes with the one before, in sorted order: where a shorter comparison also tells the two apart.
        rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(padded, np.uint8), LENGTH)
        common = np.zeros(len(sample), np.uint8)
        for a in range(1, len(sample), 1 << 17):
            differ = rows[sample[order[a : a + (1 << 17)]]] != rows[sample[order[a - 1 : a - 1 + len(order[a : a + (1 << 17)])]]]
            common[a : a + (1 << 17)] = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
        self.ranks = [np.cumsum(common < LENGTH - k, dtype=np.int32) for k in range(PERIOD)]

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: the order of the LENGTH-byte strings at a and b, which agree on their first PREFIX bytes."""
        shift = _shifts()[a % PERIOD, b % PERIOD]
        left, right, out = self.at[a + shift], self.at[b + shift], np.zeros(len(a), np.int8)
        for k in np.unique(shift):
            own = np.flatnonzero(shift == k)
            out[own] = np.sign(self.ranks[k][left[own]] - self.ranks[k][right[own]])
        return out


def classes(padded: bytes, places: np.ndarray) -> np.ndarray:
    """A number for each place; equal numbers for equal LENGTH-byte strings. Bytes first, long ties by cover ranks."""
    words = _words(padded, places, PREFIX)
    order = np.lexsort(words[::-1])
    new = np.ones(len(places), bool)
    if len(places) > 1:
        new[1:] = np.logical_or.reduce([w[order][1:] != w[order][:-1] for w in words])
    del words
    group = np.cumsum(new) - 1
    out = np.empty(len(places), np.int64)
    out[order] = group
    made = int(group[-1]) + 1 if len(group) else 0
    tied = (np.bincount(group, minlength=made) > 1)[group] if made else np.zeros(0, bool)
    todo, group = order[tied], group[tied]
    if not len(todo):
        return out
    ranks = CoverRanks(padded, places[todo])
    while len(todo):
        first = np.concatenate(([True], group[1:] != group[:-1]))
        number = np.cumsum(first) - 1
        pivot = todo[np.flatnonzero(first)][number]
        sign = ranks.compare(places[todo], places[pivot])
        out[todo] = made + 3 * number + sign + 1
        made += 3 * (int(number[-1]) + 1)
        rest = np.flatnonzero(sign != 0)
        group = out[todo[rest]]
        by = np.argsort(group, kind="stable")
        todo, group = todo[rest][by], group[by]
        if len(todo):
            start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            many = np.repeat(np.diff(np.append(start, len(group))) > 1, np.diff(np.append(start, len(group))))
            todo, group = todo[many], group[many]
    return out


def earlier(text: bytes, lengths: np.ndarray, anchor: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of strings laid end to end, for each suffix with LENGTH bytes: does the same start in a string of a smaller rank?"""
    counts = lengths - LENGTH + 1
    start, first = np.cumsum(lengths) - lengths, np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), bool)
    order = np.argsort(anchor, kind="stable")
    ranked = anchor[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    order = order[~(new & np.append(new[1:], True))]  # an anchor that one string has alone tells it from all others
    if not len(order):
        return out
    seen: dict[bytes, int] = {}
    which = np.array([seen.setdefault(text[a:b], len(seen)) for a, b in zip(start[order].tolist(), (start + lengths)[order].tolist(), strict=True)], np.int64)
    least = np.full(len(seen), np.iinfo(np.int64).max)
    np.minimum.at(least, which, rank[order])
    own = np.array([len(s) for s in seen], np.int64)
    label = np.empty(len(seen), anchor.dtype)
    label[which] = anchor[order]
    low = _least_ranks(b"".join(seen) + bytes(PAD), own, label, least)
    at, n = np.cumsum(own - LENGTH + 1) - (own - LENGTH + 1), counts[order]
    ramp = _ramps(n)
    out[np.repeat(first[order], n) + ramp] = low[np.repeat(at[which], n) + ramp] < np.repeat(rank[order], n)
    return out


def _least_ranks(padded: bytes, lengths: np.ndarray, anchor: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of unlike strings in the order of their anchors: for each suffix, the least rank of a string that has it too."""
    counts = lengths - LENGTH + 1
    start, upto = np.cumsum(lengths) - lengths, np.cumsum(counts)
    number = np.cumsum(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    low, at = np.empty(int(upto[-1]), np.int64), 0
    while at < len(lengths):
        # Whole anchors together, as many as make a chunk; one that alone is longer is split by its suffixes' first bytes.
        done = int(upto[at - 1]) if at else 0
        end = int(np.searchsorted(upto, done + CHUNK, "right"))
        end = int(np.searchsorted(number, number[end], "left")) if end < len(lengths) else end
        end = end if end > at else int(np.searchsorted(number, number[at], "right"))
        n = counts[at:end]
        places, owner = np.repeat(start[at:end], n) + _ramps(n), np.repeat(rank[at:end], n)
        slices = max(1, -(-len(places) // (2 * CHUNK)))
        slot = (_words(padded, places, 8)[0] * _MIX >> np.uint64(33)) % np.uint64(slices)
        for k in range(slices):
            chosen = np.flatnonzero(slot == k)
            if len(chosen):
                same = classes(padded, places[chosen])
                by = np.argsort(same, kind="stable")
                edge = np.flatnonzero(np.concatenate(([True], same[by][1:] != same[by][:-1])))
                low[done + chosen[by]] = np.repeat(np.minimum.reduceat(owner[chosen[by]], edge), np.diff(np.append(edge, len(by))))
        at = end
    return low


# -- the job ----------------------------------------------------------------------------------------------------------
ASK_ANCHORS, ASK = "bucket int, block_id long, anchors binary", "bucket int, block_id long, lengths binary, texts binary, anchors binary, owners binary"
ANSWER = "block_id long, bucket int, hits long, bits binary"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def _asked(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    arrow = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _answered(table: pa.Table, sizes: list[int], hits: np.ndarray) -> pa.Table:
    """One row for each block with a hit."""
    out, at = [], 0
    for block, bucket, n in zip(table.column("block_id").to_pylist(), table.column("bucket").to_pylist(), sizes, strict=True):
        own = hits[at : (at := at + n)]
        if own.any():
            out.append((block, bucket, int(own.sum()), _packed(own)))
    return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["block_id", "bucket", "hits", "bits"])


def _meet_anchors(table: pa.Table) -> pa.Table:
    """Of the anchors that blocks (each anchor once a block) dealt to a bucket: does another block have it?"""
    parts = [unpack_sorted(x) for x in table.column("anchors").to_pylist()]
    every = np.concatenate(parts)
    order = np.argsort(every)
    same = every[order][1:] == every[order][:-1]
    hits = np.empty(len(every), bool)
    hits[order] = np.append(same, False) | np.concatenate(([False], same))
    return _answered(table, [len(p) for p in parts], hits)


def _sort_bucket(table: pa.Table) -> pa.Table:
    """Of the suffixes that blocks dealt to a bucket: does the same start in a document with a smaller id?"""
    import zstandard

    plain = zstandard.ZstdDecompressor().decompress
    column = {c: table.column(c).to_pylist() for c in ("lengths", "texts", "anchors", "owners")}
    lengths = [np.frombuffer(plain(x), "<i4").astype(np.int64) for x in column["lengths"]]
    # Owners: a byte for each string whether its id is known, and the ids.
    owners = [(np.frombuffer(raw, bool, len(n)), unpack_ids(raw[len(n) :])) for raw, n in zip(map(plain, column["owners"]), lengths, strict=True)]
    rank = ranks_of(np.concatenate([i for _, i in owners]), np.concatenate([k for k, _ in owners]))
    anchor = np.concatenate([unpack_sorted(x) for x in column["anchors"]])
    hits = earlier(b"".join(map(plain, column["texts"])), np.concatenate(lengths), anchor, rank)
    return _answered(table, [int((n - LENGTH + 1).sum()) for n in lengths], hits)


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs), kept (the remaining bytes) of every document."""
    blocks = durable(to_blocks(docs), "blocks")
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(HASH_BITS, 64, 8 * -(-(total.bit_length() + 10) // 8))
    few = max(1, -(-total // (16 * BUCKET_ANCHORS)))  # an anchor serves twenty suffixes

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            anchors = Block(r, bits).anchors
            if len(anchors):
                yield _asked([(k, r["block_id"], pack_sorted(anchors[s])) for k, s in _dealt(anchors, few, bits)], ASK_ANCHORS)

    met = durable(blocks.mapInArrow(ask_anchors, ASK_ANCHORS).groupBy("bucket").applyInArrow(_meet_anchors, ANSWER), "met")
    buckets = max(1, -(-(met.agg(F.sum("hits")).first()[0] or 0) * (LENGTH + 20) // BUCKET_BYTES))
    by_block = lambda answers, name: answers.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))
    known = blocks.join(by_block(met, "met"), "block_id", "left")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for r in _rows(batches):
            block = Block(r, bits)
            block.choose(r["met"], few, bits)
            rows = []
            for bucket, own in block.dealt(buckets, bits):
                lengths, owner = (block.sizes[own] + LENGTH - 1).astype("<i4"), block.owner[own]
                rows.append((bucket, r["block_id"], squeeze(lengths.tobytes()), squeeze(b"".join([block.strings[k] for k in own.tolist()])), pack_sorted(block.anchor[own]), squeeze(block.known[owner].tobytes() + pack_ids(block.ids[owner]))))
            if rows:
                yield _asked(rows, ASK)

    answers = durable(known.mapInArrow(ask, ASK).groupBy("bucket").applyInArrow(_sort_bucket, ANSWER), "answers")
    heard = known.join(by_block(answers, "answers"), "block_id", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            block = Block(r, bits)
            block.choose(r["met"], few, bits)
            yield from _results(block, block.removed(r["answers"], buckets, bits))

    return heard.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def _results(block: Block, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The documents of a block, a few hundred at a time."""
    count = np.concatenate(([0], np.cumsum(gone)))
    raw = np.frombuffer(block.raw, np.uint8)
    for low in range(0, len(block.ids), 256):
        out = {n: [] for n in ("doc_id", "n_bytes", "n_removed", "spans", "kept")}
        for k in range(low, min(low + 256, len(block.ids))):
            a, n = int(block.starts[k]), int(block.lengths[k])
            removed, spans, kept = int(count[a + n] - count[a]), [], block.raw[a : a + n]
            if removed:
                own = gone[a : a + n]
                edge = np.diff(np.concatenate(([0], own.view(np.int8), [0])))
                spans = [{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
                kept = raw[a : a + n][~own].tobytes()
            for c, v in zip(out, (int(block.ids[k]) if block.known[k] else None, n, removed, spans, kept), strict=True):
                out[c].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        yield struct_to_batch({k: (v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})
