"""Suffix dedup, mixing, SimHash, quality and the pipeline against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SF
from tests.llm.conftest import hard_rows
from tests.llm.test_texts import plain_base as plain_spans
from tests.llm.test_texts import plain_terms
from visparq.llm import mixing, pii, quality, queries, simhash, suffix_dedup


# -- suffix dedup -----------------------------------------------------------------------------------------------------
def plain_dedup(rows, n=50):
    low = {}
    key = lambda d: (d is not None, d or 0)
    for d, t in rows:
        raw = (t or "").encode()
        for s in range(len(raw) - n + 1):
            w = raw[s : s + n]
            low[w] = min(low.get(w, key(d)), key(d))
    out = Counter()
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - n + 1):
            if low[raw[s : s + n]] < key(d):
                gone[s : s + n] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out[d, len(raw), int(gone.sum()), int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(raw) else 0, hashlib.sha256(kept).hexdigest()] += 1
    return out


def shape(out):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in out)


@pytest.mark.parametrize(("block", "bits"), [(700, 64), (4 << 20, 3)])
def test_suffix_dedup(spark, hard, empty, documents, monkeypatch, block, bits):
    """Whatever the blocks and however poor the hashes, which deal and no more."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 5_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_ANCHORS", 100)
    monkeypatch.setattr(suffix_dedup, "HASH_BITS", bits)
    assert shape(suffix_dedup.deduplicate(hard.repartition(3)).collect()) == plain_dedup([(d, t) for d, t, *_ in hard_rows()])
    some = documents.where("doc_id < 60")
    assert shape(suffix_dedup.deduplicate(some).collect()) == plain_dedup([(r["doc_id"], r["text"]) for r in some.collect()])
    assert suffix_dedup.deduplicate(empty).count() == 0


def test_cover_meets_every_shift():
    cover = set(suffix_dedup.COVER)
    assert {(a - b) % suffix_dedup.PERIOD for a in cover for b in cover} == set(range(suffix_dedup.PERIOD))
    for a in range(31):
        for b in range(31):
            k = suffix_dedup._shifts()[a, b]
            assert {(a + k) % 31, (b + k) % 31} <= cover


def test_classes_are_those_of_the_bytes():
    """Strings with long common prefixes, so that most ties are settled by cover ranks."""
    rng = random.Random(3)
    heads = [bytes(rng.choice(b"ab") for _ in range(34)) for _ in range(3)]
    text = b"".join(rng.choice(heads) + bytes(rng.choice(b"ab") for _ in range(rng.randrange(6))) for _ in range(400)) + b"c" * 200 + b"ab" * 100
    places = np.array(rng.sample(range(len(text) - 50), 6000))
    got = suffix_dedup.classes(text + bytes(suffix_dedup.PAD), places)
    own = [text[p : p + 50] for p in places]
    assert len(set(zip(got.tolist(), own, strict=True))) == len(set(own)) == len(set(got.tolist()))


@pytest.mark.parametrize("chunk", [40, 10**6])
def test_earlier_by_chunks(monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rng = random.Random(4)
    base = bytes(rng.choice(b"abcd") for _ in range(300))
    strings = [base[a : a + rng.randrange(50, 120)] for a in rng.choices(range(180), k=80)] + [base[:90]] * 5
    rank = np.array([rng.randrange(40) for _ in strings])
    anchor = np.array([rng.randrange(1) for _ in strings], "<u4")  # all in one class
    low: dict[bytes, int] = {}
    for s, r in zip(strings, rank.tolist(), strict=True):
        for k in range(len(s) - 49):
            low[s[k : k + 50]] = min(low.get(s[k : k + 50], r), r)
    want = [low[s[k : k + 50]] < r for s, r in zip(strings, rank.tolist(), strict=True) for k in range(len(s) - 49)]
    assert suffix_dedup.earlier(b"".join(strings), np.array([len(s) for s in strings]), anchor, rank).tolist() == want


def test_ids_round_trip_and_rank():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1000):
        v = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (suffix_dedup.unpack_sorted(suffix_dedup.pack_sorted(v)) == v).all()
        i = rng.integers(-(2**63), 2**63 - 1, n)
        assert (suffix_dedup.unpack_ids(suffix_dedup.pack_ids(i)) == i).all()
    assert suffix_dedup.ranks_of(np.array([5, 0, -(2**63), 5, 7]), np.array([True, False, True, True, False])).tolist() == [2, 0, 1, 2, 0]


# -- SimHash ----------------------------------------------------------------------------------------------------------
def plain_print(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c.lower() if c.isascii() else c for c in text).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    parent = list(range(len(prints)))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, d in enumerate(ids):
        least[find(k)].append(d)
    return [min((d for d in least[find(k)] if d is not None), default=None) for k in range(len(ids))]


def test_simhash(hard, documents, empty):
    for docs in (hard, documents):
        rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        prints = [plain_print(t) for _, t in rows]
        want = Counter(zip([d for d, _ in rows], prints, plain_components(prints, [d for d, _ in rows]), strict=True))
        got = Counter((r["doc_id"], r["fingerprint"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
        assert got == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("hot", [4096, 60])
def test_links_of_clustered_prints(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(2)
    prints = set()
    for _ in range(6):
        center = rng.getrandbits(64)
        for _ in range(300):
            prints.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    found = simhash._links(df, simhash.table_masks(6), True)
    members = found.where("b IS NULL").selectExpr("a AS fingerprint").distinct()
    assert members.isEmpty() == (hot == 4096)
    links = found.where("b IS NOT NULL").union(simhash._links(members, simhash.table_masks(10), False))
    degree = Counter(r[c] for r in links.distinct().collect() for c in "ab")
    assert max(degree.values()) < 2 * 48 * 6  # chains, no hubs
    label = {r["node"]: r["label"] for r in simhash.components(links).collect()}
    want = plain_components(prints, signed)
    assert [label.get(p, p) for p in signed] == want


def plain_shingles(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c.lower() if c.isascii() else c for c in text).split(" ") if w]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def plain_survivors(rows):
    """The least id of each component of documents with a shingle similarity of 0.8 or more."""
    sets = [plain_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), (True, 0)), (d is None, d or 0))
    return Counter(None if none else d for none, d in least.values())


def edited():
    """Families of documents whose words were changed here and there, and loners."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    rows = []
    for family in range(25):
        base = [word() for _ in range(rng.randrange(80, 400))]
        for copy in range(rng.randrange(1, 8)):
            own = list(base)
            for _ in range(rng.randrange(0, len(base) // 40 + 1)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows) + 10 * family, " ".join(own)))
        rows.append((10_000 + family, " ".join(base[: len(base) // 2] + [word() for _ in base])))
    rng.shuffle(rows)
    return rows


def test_keep_first_keeps_one_of_similar_documents(spark, hard, documents, empty):
    for rows in (edited(), [(r["doc_id"], r["text"] or "") for r in documents.collect()]):
        got = Counter(r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == plain_survivors(rows)
    kept = simhash.keep_first(hard)
    assert kept.columns == hard.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == plain_survivors([(d, t or "") for d, t, *_ in hard_rows()])
    assert simhash.keep_first(empty).count() == 0


def test_rows_that_share_an_id_are_judged_by_themselves(spark):
    texts = ["one two three four five six", "seven eight nine ten eleven twelve"]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[0]), (None, "a null id alone"), (2, texts[1])]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([(1, texts[0]), (1, texts[1]), (None, "a null id alone")])


def test_big_runs_stay_connected(monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 50)
    rng = np.random.default_rng(7)
    prints = rng.integers(0, 2**64, (3, 4), dtype=np.uint64)[rng.integers(0, 3, 400)]
    for row in prints:
        for bit in rng.integers(0, 256, rng.integers(0, 9)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    a, b, d = simhash._run_links(prints)
    assert (simhash._apart(prints[a], prints[b]) == d).all() and (d <= simhash.REACH).all()
    label = list(range(400))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        old, new = label[x], label[y]
        label = [new if v == old else v for v in label]
    near = simhash._apart(prints[:, None], prints[None]) <= 40
    assert all((label[x] == label[y]) == bool(near[x, y]) for x in range(400) for y in range(400))


def test_big_runs_keep_every_doubtful_link(monkeypatch):
    """Farther pairs stay beside nearer ones that may fail, in runs of any size; found by rounds, none is left out."""
    monkeypatch.setattr(simhash, "HOT", 50)
    rng = np.random.default_rng(8)
    prints = np.repeat(rng.integers(0, 2**64, (2, 4), dtype=np.uint64), 60, axis=0)
    for row in prints:
        for bit in rng.choice(256, rng.integers(8, 26), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    apart = simhash._apart(prints[:, None], prints[None])
    a, b, _ = simhash._run_links(prints)
    tree = simhash._sure(prints)[2]
    want = {(x, y) for x in range(120) for y in range(x) if simhash.SURE < apart[x, y] <= simhash.REACH and tree[x] != tree[y]}
    got = {(max(p), min(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert want and want <= got and all(apart[p] <= simhash.REACH for p in got)
    # Each pair counts in one table, and a leader's round leaves no label with a partner out.
    masks = simhash._masks(simhash.wide_tables(5000))
    differ = prints[:60, None] ^ prints[None, :60]
    shared = (differ[:, :, None] & masks).any(-1) == False  # noqa: E712
    counted = np.stack([shared[:, :, k] & simhash._first_met(differ.reshape(-1, 4), k, masks).reshape(60, 60) for k in range(len(masks))], axis=-1)
    assert (counted.sum(-1) == shared.any(-1)).all()
    none = np.zeros((0, 4), np.uint64)
    every = {(k, int(j)) for k, js, _ in simhash._doubtful(prints, tree, 0, none) for j in js}
    led = {int(tree[k]) for k, js, _ in simhash._doubtful(prints, tree, 0, none, True) for k in (k, *js)}
    assert every and led


def test_doubtful_pairs_are_verified_in_their_run(spark, monkeypatch):
    """Many near copies, most of which fail: the answer holds no pair but a forest, whatever fits in memory at once."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    base, texts = [word() for _ in range(120)], []
    for _ in range(150):
        own = list(base)
        for _ in range(rng.randrange(1, 5)):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own))
    texts += ["", "one", "one two"]
    sets = [simhash.shingles(t) for t in texts]
    prints = [simhash.wide_print(x) for x in sets]
    words = np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)
    apart = simhash._apart(words[:, None], words[None])
    alike = np.array([[len(np.intersect1d(x, y)) / max(1, len(np.union1d(x, y))) >= simhash.SIMILAR for x in sets] for y in sets])
    doubtful = (apart > simhash.SURE) & (apart <= simhash.REACH)
    none = np.zeros((0, simhash.WIDE // 64), np.uint64)

    def trees(pairs):
        label = list(range(len(texts)))
        for x, y in pairs:
            old, new = label[x], label[y]
            label = [new if v == old else v for v in label]
        return label

    want = trees(np.argwhere(doubtful & alike).tolist())
    assert (doubtful & ~alike).sum() > 1000 and len(set(want)) < len(texts)
    for spool in (simhash.SPOOL, 20_000, 1):
        monkeypatch.setattr(simhash, "SPOOL", spool)
        held = simhash.Held(0)
        held.add(prints, prints, texts)
        assert (held.file is not None) == (spool < simhash.shingles(texts[0]).nbytes * 150)
        names, a, b = simhash._verified(held, none)
        got = trees(list(zip(a.tolist(), b.tolist(), strict=True)))
        assert (names == words).all() and len(a) == len(texts) - len(set(want)) and (doubtful & alike)[a, b].all()
        assert all((got[x] == got[y]) == (want[x] == want[y]) for x in range(len(texts)) for y in range(x))
    # The operators between: rows follow the members in their runs, and links are one fewer than the labels they join.
    found = simhash._wide_links(spark.createDataFrame([(p,) for p in sorted(set(prints))], "print binary"), 5000)
    members = found.where("b IS NULL").select("table", "key", F.col("a").alias("print")).localCheckpoint()
    crossing = simhash._crossing(members, members.select(F.col("print").alias("node"), F.col("print").alias("label_")).distinct(), 5000)
    assert 0 < crossing.count() <= members.count()
    links = simhash._similar(crossing, spark.createDataFrame(list(dict(zip(prints, texts, strict=True)).items()), "print binary, text string"), 5000)
    assert links.count() <= crossing.count() - crossing.select("table", "key").distinct().count()


# -- quality ----------------------------------------------------------------------------------------------------------
def plain_base(text):
    blank = " \t\n\x0b\x0c\r"
    words = [w for w in "".join(" " if c in blank else c for c in text).split(" ") if w]
    lines = [s for s in text.split("\n") if s.strip(blank)]
    grams = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    inside = {k + j for k in range(len(words) - 7) if grams[tuple(words[k : k + 8])] > 1 for j in range(8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_quality(hard, documents, empty):
    for docs in (hard, documents):
        rows = quality.quality(docs).collect()
        assert Counter((r["doc_id"], *tuple(r)[1:7]) for r in rows) == Counter((r["doc_id"], *plain_base(r["text"] or "")) for r in docs.collect())
        assert all(not r["kept"] for r in rows if r["base_failed"])
        assert sum(r["kept"] for r in rows) >= 0.8 * sum(not r["base_failed"] for r in rows)
    kept = quality.keep_good(hard)
    assert kept.columns == hard.columns and kept.count() == sum(r["kept"] for r in quality.quality(hard).collect())
    assert quality.quality(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_outliers_found_and_masking_resisted(spark):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    good = [" ".join(word(int(rng.integers(3, 9))) for _ in range(120)) for _ in range(300)]
    bad = [" ".join(word(30) + "###" for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame([(k, t, "en", "src0") for k, t in enumerate(good + bad)], "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r["kept"] for r in quality.quality(docs).collect()}
    assert all(out[k] for k in range(300)) and not any(out[k] for k in range(300, 340))


def test_an_outlier_in_each_statistic(spark):
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    words = lambda n: [word(int(rng.integers(3, 9))) for _ in range(n)]
    passage = words(15)
    made = {
        "good": [" ".join(words(120)) for _ in range(300)],
        "length": [" ".join(word(30) for _ in range(120)) for _ in range(5)],
        "symbols": [" ".join(word(2) + "####" for _ in range(120)) for _ in range(5)],
        "lines": ["\n".join(f"{' '.join(words(6))}\nmenu" for _ in range(20)) for _ in range(5)],
        "repeats": [" ".join([*words(40), *passage, *words(50), *passage]) for _ in range(5)],
    }
    kinds = [(kind, t) for kind, texts in made.items() for t in texts]
    docs = spark.createDataFrame([(k, t, "en", "src0") for k, (_, t) in enumerate(kinds)], "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    assert not any(r["base_failed"] for r in out.values())
    assert {kind: {out[k]["kept"] for k, (own, _) in enumerate(kinds) if own == kind} for kind in made} == {kind: {kind == "good"} for kind in made}


def plain_mcd(x):
    """Raw estimate of a group's rounded vectors: three starts, concentration to the end, the least determinant."""
    floors = np.diag(np.square(quality.FLOORS))
    low = lambda v, q: np.sort(v, axis=0)[int(np.ceil(len(v) * q)) - 1]
    m = low(x, 0.5)
    spread = np.maximum(low(np.abs(x - m), 0.5) * 1.4826, quality.FLOORS)
    y = (x - m) / spread
    norm = (y**2).sum(1)
    sign = np.divide(y, np.sqrt(norm)[:, None], out=np.zeros_like(y), where=norm[:, None] > 0)
    nearest = lambda d2, q: x[(b := np.floor(np.sqrt(d2) * quality.BINS)) <= low(b, q)]
    cov = lambda v: np.cov(v.T, bias=True)
    half = nearest(norm, 0.5)
    best = None
    for center, c in ((m, np.diag(spread**2)), (m, 4 * sign.T @ sign / len(x) * np.outer(spread, spread)), (half.mean(0), cov(half))):
        c = c + floors
        while True:
            own = nearest(distance(x, center, c), quality.KEEP)
            new = cov(own) + floors
            if not np.linalg.slogdet(new)[1] < np.linalg.slogdet(c)[1] - quality.FALL:
                break
            center, c = own.mean(0), new
        if best is None or np.linalg.slogdet(c)[1] < np.linalg.slogdet(best[1])[1] - 1e-12:
            best = (center, c)
    return best


def distance(x, center, c):
    return np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(c), x - center)


def plain_scale(x, center, c):
    d = np.sort(np.floor(np.sqrt(distance(x, center, c)) * quality.BINS))[int(np.ceil(len(x) / 2)) - 1]
    return max(1.0, ((d + 0.5) / quality.BINS) ** 2 / 3.357)


def plain_kept(rows):
    """The whole verdict on (lang, source, text) rows; and the least distance of any vector to the cutoff."""
    vectors = []
    for _, _, t in rows:
        n, chars, symbols, dup, repeat, failed = plain_base(t)
        lines = [s for s in t.split("\n") if s.strip(" \t\n\x0b\x0c\r")]
        vectors.append(None if failed else np.log([max(1, chars) / max(1, n) if n else 1, symbols / max(1, chars) + 0.02, dup / max(1, len(lines)) + 0.1, repeat / max(1, n) + 0.1]))
    cells = {}
    for (lang, source, _), v in zip(rows, vectors, strict=True):
        for key in ((), (lang,), (lang, source)) if v is not None else ():
            cells.setdefault(key, []).append(np.floor(v * 64 + 0.5) / 64)
    floors, fits = np.diag(np.square(quality.FLOORS)), {}
    for key in sorted(cells, key=len):
        x = np.array(cells[key])
        center, c = plain_mcd(x)
        inner = x[distance(x, center, c) <= 11.143 * plain_scale(x, center, c)]
        n, m, c = len(inner), inner.mean(0), np.cov(inner.T, bias=True) if len(inner) > 1 else np.zeros((4, 4))
        if key:
            pm, pc = fits[key[:-1]]
            m, c = (n * m + 50 * pm) / (n + 50), (n * c + 50 * pc) / (n + 50)
        fits[key] = (m, c)
    out, margin = [], np.inf
    for (lang, source, _), v in zip(rows, vectors, strict=True):
        if v is None:
            out.append(False)
            continue
        m, c = fits[lang, source]
        d = distance(v[None], m, c + floors)[0] / plain_scale(np.array(cells[lang, source]), m, c + floors)
        margin = min(margin, abs(d - quality.CUTOFF))
        out.append(bool(d <= quality.CUTOFF))
    return out, margin


def test_verdicts_are_those_of_a_plain_estimator(spark, hard, documents):
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    made = [(k, "\n".join(" ".join(word(int(rng.integers(2, 6 + k % 3))) + "#" * int(rng.random() < 0.02 * (k % 7)) for _ in range(12)) + ("\nmenu" if rng.random() < 0.02 * (k % 5) else "") for _ in range(5)), ["en", "de"][k % 2], f"s{min(k % 13, 4)}") for k in range(700)]
    made = spark.createDataFrame(made, "doc_id long, text string, lang string, source string").cache()
    seen = set()
    for docs in (documents, hard, made):
        rows = docs.select("lang", "source", "text", "doc_id").collect()
        want, margin = plain_kept([(r["lang"], r["source"], r["text"] or "") for r in rows])
        assert margin > 1e-6
        got = Counter((r["doc_id"], r["kept"]) for r in quality.quality(docs).collect())
        assert got == Counter(zip([r["doc_id"] for r in rows], want, strict=True))
        seen |= set(want)
    assert seen == {True, False}


# -- mixing -----------------------------------------------------------------------------------------------------------
def test_shortage_goes_to_siblings_first(spark):
    rows = [("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "de", "c", 1000), ("d1", "en", "e", 2000)]
    leaves = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, domain string, lang string, source string, n_tokens long")
    given = {r["source"]: r["given"] for r in mixing.budgets(leaves, {}, 10, 1).collect()}  # 401 tokens, 200 a domain
    assert given == {"a": 10, "b": 90, "c": 100, "e": 200}
    full = {r["source"]: r["given"] for r in mixing.budgets(leaves, {"domain": {"d1": 0 + 9}}, 90, 1).collect()}
    assert full["e"] == 2000 and sum(full.values()) >= 4010 * 90 // 100 - 3


def test_mix_matches_sql(spark):
    want = duckdb.connect()
    want.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rows = want.execute(queries.ORACLES["op4_source_mixing"]).fetchall()
    got = queries.op4(spark, SF).collect()
    assert Counter(map(tuple, got)) == Counter(rows)
    assert {r[5] for r in rows} >= {0, 1}


def test_mix_edges(spark, hard, documents, empty):
    out = mixing.mix(hard, queries.domain_of(), queries.WEIGHTS, percent=50)
    assert out.count() == hard.count()
    for docs in (hard, documents):
        taken = Counter()
        for r in mixing.mix(docs, queries.domain_of(), queries.WEIGHTS, percent=50).collect():
            taken[r["doc_id"], r["lang"], r["source"], r["n_tokens"]] += r["n_copies"]
        mixed = mixing.apply_mix(docs, queries.domain_of(), queries.WEIGHTS, percent=50)
        assert mixed.columns == docs.columns
        assert Counter((r["doc_id"], r["lang"] or "", r["source"] or "", len([w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in r["text"] or "").split(" ") if w])) for r in mixed.collect()) == +taken
    assert mixing.mix(empty, queries.domain_of(), {}).count() == 0 and mixing.apply_mix(empty, queries.domain_of(), {}).count() == 0


def test_rows_without_ids_are_taken_by_themselves(spark):
    rows = [(None, "w " * (k + 1), "en", "a") for k in range(40)] + [(None, "w w w", "en", "a")] * 3
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), queries.domain_of(), {}, percent=50).collect()
    copies = {r["n_tokens"]: set() for r in out}
    for r in out:
        copies[r["n_tokens"]].add(r["n_copies"])
    assert {len(v) for v in copies.values()} == {1} and {c for v in copies.values() for c in v} == {0, 1}
    total = sum(r["n_tokens"] for r in out)
    assert sum(r["n_tokens"] * r["n_copies"] for r in out) <= total // 2


# -- pipeline ---------------------------------------------------------------------------------------------------------
def test_pipeline_stages(spark, hard, empty):
    docs, before = hard, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), hard.schema)
        assert docs.columns == hard.columns, name
        before = docs
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == before.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_is_its_stages_in_plain_form(spark, documents):
    """Up to the texts, plainly: the kept, one of similar ones, rewritten; then each as often as its budget takes it, packed."""
    docs = documents.select("doc_id", "lang", "source", "text").collect()
    good, _ = plain_kept([(r["lang"], r["source"], r["text"]) for r in docs])
    left = [r for r, ok in zip(docs, good, strict=True) if ok]
    first = plain_survivors([(r["doc_id"], r["text"]) for r in left])
    left = [r for r in left if r["doc_id"] in first]
    terms = plain_terms([(r["doc_id"], r["text"]) for r in left])
    texts = {r["doc_id"]: pii.rewrite(r["text"], plain_spans(r["text"]) + [(a, k, e) for (a, e), k in terms.get(r["doc_id"], {}).items()]) for r in left}
    clean = spark.createDataFrame([(r["doc_id"], texts[r["doc_id"]], r["lang"], r["source"]) for r in left], "doc_id long, text string, lang string, source string")
    copies = {r["doc_id"]: r["n_copies"] for r in mixing.mix(clean, queries.domain_of(), queries.WEIGHTS, queries.PERCENT, queries.EPOCHS, queries.SEED).collect()}
    library, want = Tokenizer.from_file(queries.vocabulary()), Counter()
    for d, t in texts.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), queries.CAPACITY)):
            want[d, k, s, ids[s : s + queries.CAPACITY].tobytes()] += copies[d]
    assert Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect()) == +want
