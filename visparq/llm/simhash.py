"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, and verified Hamming distances.

``near_duplicates`` links fingerprints of 64 bits that differ in at most ``distance`` bits. Documents with one fingerprint are
one node, so exact copies cost one node. With ``m`` blocks of a fingerprint, two that differ in at most ``distance`` bits agree
on ``m - distance`` whole blocks: each choice of that many blocks is a table, and only fingerprints that meet in a table are
compared. Runs of one key are compared in place, in arrays; a run answers with a spanning forest of its verified links, never
with its pairs. A key met by more than ``HOT`` fingerprints is set aside and its members meet again in finer tables, which lose
no link either; a key of the finest tables leaves 16 bits, so at most 65,536 fingerprints meet under it.

``keep_first`` is for corpora: it links documents whose sets of ``WORDS``-word shingles have a Jaccard similarity of ``SIMILAR``
or more. At that similarity 15 % of a fingerprint's bits differ, too many for whole blocks of 64 bits; so its fingerprints
have ``WIDE`` bits and a table's key is one block, with as many tables (blocks of the fingerprint, then of seeded permutations
of it) as a pair of similarity SIMILAR needs to share a key with probability ``RECALL``; more similar pairs nearly always do.
Pairs are judged by Hamming distance: up to ``SURE`` they are links, up to ``REACH`` their shingles are compared exactly. A run
of any size keeps a forest of its sure links and its members that have a doubtful pair, never its pairs. Those members bring
their texts to the run once more; there all doubtful pairs that still lie between two components are compared, in place, and
a forest of those that hold is the answer, so no pair is a row. A pair counts in the first table in which it shares a key.

Components come from minimum labels with pointer jumping, each round written to the shared folder. Forests are chains, so no
node is a hub; joins by label or fingerprint spread heavy keys.

Defined cases: a null text has no words and fingerprint zero, which links like any other; a null id never names a component
of ``near_duplicates`` unless no other is there; ``keep_first`` keeps the least id of a component, null ids last, then the
first row; repeated rows are copies; an empty table gives an empty result; extra columns are not read, or returned untouched.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visparq.llm._common import durable, release, spread_join, texts_of, workers_can_import

SHINGLE, SEED, DISTANCE, BITS = 4, 42, 4, 64
HOT, PAIRWISE, SLICE = 4096, 48, 1024
FINER = (10, 16)  # blocks of the tables in which members of hot keys meet again
WORDS, SIMILAR, WIDE, RECALL = 5, 0.8, 256, 0.99
#: The share of equal bits at similarity SIMILAR, and for SURE and REACH three standard deviations to either side of it.
SAME = 1 - math.acos(2 * SIMILAR / (1 + SIMILAR)) / math.pi
SURE, REACH = (int(WIDE * (1 - SAME) + k * 3 * math.sqrt(WIDE * SAME * (1 - SAME))) for k in (-1, 1))
SPOOL = 8 << 20  # bytes of a run's sets of shingles that are held at once, or twice that


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half of the XXH64 hashes of the text's shingles, repeats included."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    step = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - step + 1].tolist(), ends[step - 1 :].tolist(), strict=True)], "<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            own = np.array([fingerprint(t) for t in b.column("text").to_pylist()], "<u8")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(own.view("<i8"))], names=["doc_id", "fingerprint"])

    return texts_of(docs).mapInArrow(run, "doc_id long, fingerprint long")


def table_masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """A mask for each table: the bits of ``blocks - distance`` blocks."""
    edge = [BITS * k // blocks for k in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(edge, edge[1:], strict=False)]
    return [sum(c) for c in combinations(own, blocks - distance)]


def blocks_for(rows: int) -> int:
    """So many blocks that a table's key has at least as many bits as numbering the fingerprints takes."""
    return next((m for m in range(6, 13) if BITS * (m - DISTANCE) // m >= rows.bit_length()), 12)


class Runs:
    """Sorted rows regrouped so that no run of equal (table, key) is cut; what is held back is joined only when a run ends."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches, self.held = batches, []
        self.table = self.key = np.zeros(0, np.int64)  # of the rows that were given last

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Prints, and where runs start and how long they are."""
        for b in self.batches:
            if not b.num_rows:
                continue
            table, key = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("table", "key"))
            kind = b.column("print").type
            prints = b.column("print").to_numpy(zero_copy_only=False)
            prints = np.frombuffer(b"".join(prints.tolist()), np.uint8).reshape(b.num_rows, -1).view(np.uint64) if pa.types.is_binary(kind) else prints.view(np.uint64).reshape(-1, 1)
            new = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
            same = self.held and self.held[-1][0][-1] == table[-1] and self.held[-1][1][-1] == key[-1]
            if not len(new) and (same or not self.held):
                self.held.append((table, key, prints))
                continue
            cut = int(new[-1]) if len(new) else 0
            yield from self._done([*self.held, (table[:cut], key[:cut], prints[:cut])])
            self.held = [(table[cut:], key[cut:], prints[cut:])]
        if self.held:
            yield from self._done(self.held)

    def _done(self, parts: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        table, key, prints = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(table):
            self.table, self.key = table, key
            first = np.flatnonzero(np.concatenate(([True], (table[1:] != table[:-1]) | (key[1:] != key[:-1]))))
            yield prints, first, np.diff(np.append(first, len(table)))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which rows of 64-bit words differ."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _ramps(sizes: np.ndarray) -> np.ndarray:
    """0..n-1 for each n in turn."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _small_runs(prints: np.ndarray, first: np.ndarray, size: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers a, b and distance of near pairs, of all runs of PAIRWISE rows or fewer at once."""
    small = (size > 1) & (size <= PAIRWISE)
    at = np.repeat(first[small], size[small]) + _ramps(size[small])
    left = np.repeat(size[small], size[small]) - _ramps(size[small])
    for d in range(1, int(size[small].max(initial=1))):
        own = at[left > d]
        apart = _apart(prints[own], prints[own + d])
        near = apart <= reach
        yield own[near], own[near] + d, apart[near]


def forest(prints: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """A run's rows chained within its local components: each to the one before it. Memory follows the run, not its pairs."""
    label = np.arange(len(prints))
    for k in range(len(prints) - 1):
        near = np.flatnonzero(_apart(prints[k + 1 :], prints[k]) <= distance) + k + 1
        met = np.unique(label[near])
        met = met[met != label[k]]
        if len(met):
            met = np.append(met, label[k])
            label[np.isin(label, met)] = met.min()
    order = np.argsort(label, kind="stable")
    chained = np.flatnonzero(label[order][1:] == label[order][:-1])
    return order[chained + 1], order[chained]


def _links(prints: DataFrame, masks: list[int], set_aside: bool) -> DataFrame:
    """a, b: verified links; with ``set_aside``, rows with a null b are the members of keys met by over HOT of them."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select("fingerprint", F.explode(F.array(*(F.struct(F.lit(k).cast("short").alias("table"), F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(signed)))).alias("t"))
    dealt = keyed.select("t.table", "t.key", F.col("fingerprint").alias("print")).repartition("table", "key").sortWithinPartitions("table", "key", "print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64).ravel()), pa.array(b.view(np.int64).ravel()) if b is not None else pa.nulls(len(a), pa.int64())], names=["a", "b"])

        for prints, first, size in Runs(batches):
            for a, b, _ in _small_runs(prints, first, size, DISTANCE):
                if len(a):
                    yield out(prints[a], prints[b])
            for f, n in zip(first[size > PAIRWISE], size[size > PAIRWISE], strict=True):
                own = prints[f : f + n]
                if set_aside and n > HOT:
                    yield out(own, None)
                else:
                    a, b = forest(own)
                    if len(a):
                        yield out(own[a], own[b])

    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node it reaches): minimum of the neighbours' labels, then the label's own label, to the end."""
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    now = durable(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        near = both.join(now.withColumnRenamed("node", "b").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = durable(now.join(near.hint("merge"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("low")), "lower")
        # Only labels that have a lower label themselves are jumped over; in the end there are none.
        jump = durable(low.where("node <> low").select(F.col("node").alias("low"), F.col("low").alias("far")).join(low.select("low").distinct().hint("merge"), "low"), "jumps")
        jumped = low.select("node", "was", F.col("low").alias("label")) if jump.isEmpty() else spread_join(low, jump, "low", F.col("node"), "left").select("node", "was", F.coalesce("far", "low").alias("label"))
        new = durable(jumped, "labels")
        release(now, low, jump)
        if new.where("label <> was").isEmpty():
            release(both)
            out = new.select("node", "label")
            out.durable_path = new.durable_path
            return out
        now = new


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (long), component_id: the least doc_id among all documents that links reach."""
    if distance != DISTANCE:
        raise ValueError(f"tables are laid out for {DISTANCE} bits")
    own = durable(fingerprints(docs), "fingerprints")
    nodes = durable(own.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "nodes")
    prints, levels, parts = nodes.select("fingerprint"), [blocks_for(nodes.count()), *FINER], []
    for k, blocks in enumerate(levels):
        found = durable(_links(prints, table_masks(blocks), k < len(levels) - 1), "links")
        parts.append(found.where("b IS NOT NULL"))
        prints = durable(found.where("b IS NULL").select(F.col("a").alias("fingerprint")).distinct(), "hot")
        if prints.isEmpty():
            break
    label = components(reduce(DataFrame.union, parts))
    joined = durable(nodes.join(label.withColumnRenamed("node", "fingerprint").hint("merge"), "fingerprint", "left").select("fingerprint", "least", F.coalesce("label", "fingerprint").alias("label")), "joined")
    best = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    named = durable(spread_join(joined, best, "label", F.col("fingerprint")).select("fingerprint", "component_id"), "components")
    release(nodes, joined)
    return spread_join(own, named, "fingerprint", F.col("doc_id")).select("doc_id", "fingerprint", "component_id")


# -- similarity of shingles -------------------------------------------------------------------------------------------
def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's WORDS-word shingles (fewer words: the whole sequence; none: none)."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    step = min(WORDS, len(words))
    h = own[: len(own) - step + 1].copy()
    for j in range(1, step):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + own[j : len(own) - step + 1 + j]
    return np.unique(h)


def wide_print(found: np.ndarray) -> bytes:
    """WIDE bits of the distinct shingles: each bit the majority's. None: all zero."""
    counts = np.zeros(WIDE, np.int64)
    for at in range(0, len(found), 1 << 14):
        h = found[at : at + (1 << 14), None] + np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        counts += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(found), bitorder="little").tobytes()


def wide_tables(rows: int) -> list[np.ndarray]:
    """The bits of each table's key: so many that some sixteen unrelated documents share one; blocks of seeded permutations."""
    width = max(12, rows.bit_length() - 4)
    many = math.ceil(math.log(1 - RECALL) / math.log(1 - SAME**width))
    rng, out = np.random.default_rng(SEED), []
    order = np.arange(WIDE)
    while len(out) < many:
        out += [order[k : k + width] for k in range(0, WIDE - width + 1, width)]
        order = rng.permutation(WIDE)
    return out[:many]


def _masks(tables: list[np.ndarray]) -> np.ndarray:
    """Each table's key bits as words of a fingerprint."""
    out = np.zeros((len(tables), WIDE), np.uint8)
    for k, own in enumerate(tables):
        out[k, own] = 1
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def _first_met(differ: np.ndarray, table: np.ndarray | int, masks: np.ndarray) -> np.ndarray:
    """Whether pairs with these differing bits share no key in a table before theirs: each pair counts once."""
    out = np.ones(len(differ), bool)
    for k in range(int(np.max(table, initial=0))):
        out &= (table <= k) | (differ & masks[k]).any(axis=1)
    return out


def _doubtful(prints: np.ndarray, label: np.ndarray, table: int, masks: np.ndarray, leaders: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A row, later rows of other labels beyond SURE and within REACH of it, and their distances; all such pairs that count in
    this table. With ``leaders`` only of rows whose label no leader has met, with any rows, one pair for each label met."""
    todo = np.ones(len(prints), bool)
    for k in range(len(prints)):
        if not todo[k]:
            continue
        at = 0 if leaders else k + 1
        apart = _apart(prints[at:], prints[k])
        near = np.flatnonzero((apart > SURE) & (apart <= REACH) & (label[at:] != label[k]))
        if len(near):
            near = near[_first_met(prints[at + near] ^ prints[k], table, masks)]
        if leaders:
            near = near[np.argsort(apart[near], kind="stable")]
            met, first = np.unique(label[near], return_index=True)
            near = near[first]
            todo[np.isin(label, np.append(met, label[k]))] = False
        if len(near):
            yield k, at + near, apart[near]


def _run_links(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of a run of any size: a forest of the sure ones, and all doubtful pairs between its trees."""
    a, b, label = _sure(prints)
    found = [(a, b, _apart(prints[a], prints[b]))]
    found += [(np.full(len(j), k), j, d) for k, j, d in _doubtful(prints, label, 0, np.zeros((0, 1), np.uint64))]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _sure(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A forest of a run's pairs within SURE, and each row's tree."""
    label, left, out = np.arange(len(prints)), np.ones(len(prints), bool), []
    for start in range(len(prints)):
        todo = [start] if left[start] else []
        left[start] = False
        while todo:
            k = todo.pop()
            found = np.flatnonzero(left)
            found = found[_apart(prints[found], prints[k]) <= SURE]
            left[found], label[found] = False, start
            out += [(k, j) for j in found.tolist()]
            todo += found.tolist()
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1], label


def _binary(rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows).view(np.uint8)
    return pa.array([bytes(r) for r in raw], pa.binary())


def _wide_links(prints: DataFrame, rows: int) -> DataFrame:
    """a, b: sure links, a forest of each run's; with a null b: table, key and a member that has a doubtful pair there."""
    tables = wide_tables(rows)
    masks = _masks(tables)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if n:
                bits = np.unpackbits(np.frombuffer(b"".join(b.column("print").to_pylist()), np.uint8).reshape(n, -1), axis=1, bitorder="little").astype(np.int64)
                for k, own in enumerate(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int16)), pa.array(bits[:, own] @ (1 << np.arange(len(own)))), b.column("print")], names=["table", "key", "print"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(batches)

        def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            none = pa.nulls(len(a), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(runs.table[a].astype(np.int16)), pa.array(runs.key[a]), _binary(prints[a]), none if b is None else _binary(prints[b])], names=["table", "key", "a", "b"])

        for prints, first, size in runs:
            member, root, sure = np.zeros(len(prints), bool), {}, []
            for a, b, d in _small_runs(prints, first, size, REACH):
                met = _first_met(prints[a] ^ prints[b], runs.table[a], masks)
                for x, y in zip(a[met & (d <= SURE)].tolist(), b[met & (d <= SURE)].tolist(), strict=True):
                    p, q = x, y
                    while p in root:
                        p = root[p]
                    while q in root:
                        q = root[q]
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        sure.append((x, y))
                member[a[met & (d > SURE)]] = member[b[met & (d > SURE)]] = True
            pairs = [np.array(sure, np.int64).reshape(-1, 2)]
            for f, n in zip(first[size > PAIRWISE].tolist(), size[size > PAIRWISE].tolist(), strict=True):
                own = prints[f : f + n]
                a, b, label = _sure(own)
                pairs.append(f + np.stack([a, b], axis=1))
                for k, j, _ in _doubtful(own, label, int(runs.table[f]), masks):
                    member[f + k] = member[f + j] = True
            pairs = np.concatenate(pairs)
            if len(pairs):
                yield out(pairs[:, 0], pairs[:, 1])
            if member.any():
                yield out(np.flatnonzero(member), None)

    keyed = prints.mapInArrow(keys, "table short, key long, print binary")
    dealt = keyed.repartition("table", "key").sortWithinPartitions("table", "key", "print")
    return dealt.mapInArrow(run, "table short, key long, a binary, b binary")


def _crossing(members: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """table, key, print, label_ of the members that have a doubtful pair with another label in their run."""
    masks = _masks(wide_tables(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, wide = Runs(batches), WIDE // 64
        for both, first, size in runs:
            prints, names = np.ascontiguousarray(both[:, :wide]), np.ascontiguousarray(both[:, wide:])
            label, member = np.unique(names, axis=0, return_inverse=True)[1].ravel(), np.zeros(len(both), bool)
            for f, n in zip(first.tolist(), size.tolist(), strict=True):
                if n > 1 and label[f : f + n].min() < label[f : f + n].max():
                    for k, j, _ in _doubtful(prints[f : f + n], label[f : f + n], int(runs.table[f]), masks):
                        member[f + k] = member[f + j] = True
            at = np.flatnonzero(member)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(runs.table[at].astype(np.int16)), pa.array(runs.key[at]), _binary(prints[at]), _binary(names[at])], names=["table", "key", "print", "label_"])

    named = members.join(labels.select(F.col("node").alias("print"), "label_").hint("merge"), "print").select("table", "key", F.concat("print", "label_").alias("print"))
    return named.repartition("table", "key").sortWithinPartitions("table", "key", "print").mapInArrow(run, "table short, key long, print binary, label_ binary")


class Held:
    """The members of one run: fingerprints and labels as words, sets of shingles. Sets beyond SPOOL bytes go to a file without
    a name, which lasts as long as this object, and are read a block of rows at a time."""

    def __init__(self, table: int):
        self.table, self.prints, self.names, self.size = table, [], [], []
        self.sets, self.bytes, self.file = [], 0, None

    def add(self, prints: list[bytes], names: list[bytes], texts: list[str]) -> None:
        self.prints += prints
        self.names += names
        for t in texts:
            self.sets.append(shingles(t))
            self.size.append(len(self.sets[-1]))
            self.bytes += self.sets[-1].nbytes
            if self.bytes > SPOOL:
                self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for own in self.sets:
            self.file.write(own.tobytes())
        self.sets, self.bytes = [], 0

    def blocks(self) -> list[tuple[int, int]]:
        """Bounds of stretches of rows whose sets take up to SPOOL bytes, a row at least."""
        end, out = np.cumsum(self.size) * 8, [0]
        while out[-1] < len(end):
            out.append(max(out[-1] + 1, int(np.searchsorted(end, (end[out[-1] - 1] if out[-1] else 0) + SPOOL, side="right"))))
        return list(zip(out, out[1:], strict=False))

    def read(self, block: tuple[int, int]) -> np.ndarray:
        """The sets of a block's rows, one after the other."""
        if not self.file:
            return np.concatenate(self.sets[slice(*block)])
        if self.sets:
            self._spill()
        self.file.seek(8 * sum(self.size[: block[0]]))
        return np.frombuffer(self.file.read(8 * sum(self.size[slice(*block)])), np.uint64)


def _verified(held: Held, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows a, b of a run whose sets have a similarity of SIMILAR or more, a forest over its labels; every doubtful pair that
    counts in this table is compared unless its labels are one by then. Memory follows the run, not its pairs."""
    words = lambda raw: np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), -1)
    prints, names = words(held.prints), words(held.names)
    label, size, out = np.unique(names, axis=0, return_inverse=True)[1].ravel(), np.array(held.size), []
    blocks = held.blocks()
    for p, left in enumerate(blocks):
        for right in blocks[p:]:
            at = 0 if left == right else left[1] - left[0]  # of the right block's first row among the rows of both
            rows = np.arange(*left) if left == right else np.concatenate((np.arange(*left), np.arange(*right)))
            sets, start = None, np.cumsum(size[rows]) - size[rows]
            for k in range(left[1] - left[0]):
                own = rows[max(at, k + 1) :]
                apart = _apart(prints[own], prints[rows[k]])
                near = np.flatnonzero((apart > SURE) & (apart <= REACH) & (label[own] != label[rows[k]]))
                near = near[_first_met(prints[own[near]] ^ prints[rows[k]], held.table, masks)] if len(near) else near
                if not len(near):
                    continue
                if sets is None:
                    values, sets = np.unique(np.concatenate([held.read(x) for x in dict.fromkeys((left, right))]), return_inverse=True)
                    mark = np.zeros(len(values), bool)
                near += max(at, k + 1)
                mine = sets[start[k] : start[k] + size[rows[k]]]
                mark[mine] = True
                many = size[rows[near]]
                met = np.append(0, np.cumsum(mark[sets[np.repeat(start[near], many) + _ramps(many)]]))[np.append(0, np.cumsum(many))]
                met = np.diff(met)
                mark[mine] = False
                whole = many + len(mine) - met
                good = rows[near[(whole == 0) | (met / np.maximum(whole, 1) >= SIMILAR)]]
                if len(good):
                    others, first = np.unique(label[good], return_index=True)
                    out += [(rows[k], j) for j in good[first].tolist()]
                    label[np.isin(label, others)] = label[rows[k]]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return names, pairs[:, 0], pairs[:, 1]


def _similar(crossing: DataFrame, texts: DataFrame, rows: int) -> DataFrame:
    """a, b: labels that a verified pair joins, for each run a forest. A member brings its text to each run in which it has a
    doubtful pair, so rows follow the members and no pair is a row."""
    masks = _masks(wide_tables(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: Held) -> Iterator[pa.RecordBatch]:
            names, a, b = _verified(held, masks)
            if len(a):
                yield pa.RecordBatch.from_arrays([_binary(names[a]), _binary(names[b])], names=["a", "b"])

        held, of = None, None
        for b in batches:
            table, key = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("table", "key"))
            cut = [0, *(np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1).tolist(), b.num_rows]
            for x, y in zip(cut, cut[1:], strict=False):
                if x < y:
                    if of != (table[x], key[x]):
                        if held:
                            yield from out(held)
                        held, of = Held(int(table[x])), (table[x], key[x])
                    held.add(*(b.column(c).slice(x, y - x).to_pylist() for c in ("print", "label_", "text")))
        if held:
            yield from out(held)

    told = crossing.join(texts.hint("merge"), "print").select("table", "key", "print", "label_", "text")
    return told.repartition("table", "key").sortWithinPartitions("table", "key", "print").mapInArrow(run, "a binary, b binary")


def _renamed(rows: DataFrame, names: DataFrame, columns: tuple[str, ...], spread_by: Column) -> DataFrame:
    """``rows`` with what ``names`` (node, label) has another label for replaced in ``columns``; written."""
    made: list[DataFrame] = []
    for c in columns:
        joined = spread_join(made[-1] if made else rows, names.select(F.col("node").alias(c), "label"), c, spread_by, "left")
        made.append(durable(joined.withColumn(c, F.coalesce("label", c)).drop("label"), "renamed"))
    release(*made[:-1])
    return made[-1]


def similar_labels(found: DataFrame, texts: DataFrame, rows: int) -> DataFrame:
    """node, label of all nodes with a link or a doubtful pair: components of the sure links and of those that are verified."""
    links, members = found.where("b IS NOT NULL").select("a", "b"), found.where("b IS NULL").select("table", "key", F.col("a").alias("print"))
    sure = components(links)
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).union(members.select("print")).distinct()
    labels = _renamed(ends.select("node", F.col("node").alias("label_")), sure, ("label_",), F.col("node"))
    release(sure)
    crossing = durable(_crossing(members, labels, rows), "crossing")
    good = durable(_similar(crossing, texts, rows), "similar")
    release(crossing)
    if not good.isEmpty():
        merged = components(good)
        old, labels = labels, _renamed(labels, merged, ("label_",), F.col("node"))
        release(old, merged)
    release(good)
    out = labels.select("node", F.col("label_").alias("label"))
    out.durable_path = labels.durable_path
    return out


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group of similar ones, all columns: the least id's (null ids last), the first row of that id."""
    workers_can_import(docs.sparkSession)
    columns = docs.columns
    flat = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("words"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [wide_print(shingles(t)) for t in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), pa.array(own, pa.binary()), b.column("words"), *(b.column(f"c{k}") for k in range(len(columns)))], names=["row", "id", "print", "words", *(f"c{k}" for k in range(len(columns)))])

    kinds = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema))
    table = durable(flat.mapInArrow(run, f"row long, id long, print binary, words string, {kinds}"), "prints")
    first: Column = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    nodes = durable(table.groupBy("print").agg(first), "nodes")
    many = nodes.count()
    found = durable(_wide_links(nodes.select("print"), many), "links")
    ends = found.where("b IS NULL").select(F.col("a").alias("print")).distinct()
    rows = nodes.join(ends.hint("merge"), "print", "left_semi").select("print", F.col("first.row").alias("row"))
    texts = durable(table.select("row", F.col("words").alias("text")).join(rows.hint("merge"), "row").select("print", "text"), "texts")
    labels = similar_labels(found, texts, many)
    release(found, texts)
    joined = nodes.join(labels.withColumnRenamed("node", "print").hint("merge"), "print", "left")
    kept = durable(joined.groupBy(F.coalesce("label", "print").alias("label")).agg(F.min("first").alias("first")).select("first.row"), "first")
    release(nodes, labels)
    # The survivors grow with the corpus: never a broadcast, at any size.
    return table.join(kept.hint("merge"), "row", "left_semi").select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(columns)))
