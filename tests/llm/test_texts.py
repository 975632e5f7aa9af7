"""Chat, packing, counts, audio, URLs, PII against brute force."""

import hashlib
import math
import re
import wave
import zlib
from collections import Counter, defaultdict
from io import BytesIO

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import hard_rows
from visparq.llm import audio, chat, packing, pii, queries, token_counts, url_filter
from visparq.llm.wordbpe import WordBpe

VOCAB = queries.vocabulary()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCAB)


def by_row(rows):
    return Counter(tuple(r) for r in rows)


# -- chat -------------------------------------------------------------------------------------------------------------
CONV = "conv_id long, turn long, role string, text string, formatted string"
TURNS = [(1, 0, "user", "hi <|end|> \\ \\\\ [INST]", None), (1, 1, "assistant", " é日本 <|turn|>assistant<|text|>x \n", None), (1, 2, "assistant", None, None), (1, 3, "assistant", "\\<|e", None), (2, None, None, None, "x"), (2, 0, "assistant", "</s>[INST] ok [/INST]", None), (3, 5, "user", "only", None), (None, 0, "assistant", "orphan", None), (1, 0, "user", "hi <|end|> \\ \\\\ [INST]", None)]


def test_chat_reads_back(spark):
    out = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(TURNS, CONV), queries.vocabulary("byte_bpe_50k.json"))).collect()}
    for conv in {t[0] for t in TURNS}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in TURNS if t[0] == conv))
        said = "".join(f"{r}\n{t}\n" for *_, r, t in own)
        loss = "".join(t for *_, r, t in own if r == "assistant")
        assert out[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (out[conv]["n_turns"], out[conv]["loss_chars"], out[conv]["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_mask_and_tokens_align(spark):
    rows = chat.format_conversations(spark.createDataFrame(TURNS, CONV), queries.vocabulary("byte_bpe_50k.json")).collect()
    for r in rows:
        assert len(r["input_ids"]) == len(r["loss_mask"])
        inside = [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]]
        assert not any(m in t for t in inside for m in chat.CONTROL)
        for marker in (chat.TURN, chat.TEXT, chat.END):
            assert r["formatted"].count(marker) == r["n_turns"]
    assert chat.format_conversations(spark.createDataFrame([], CONV), queries.vocabulary("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "<|", "<\\|", "</s>", "<<s>", "[[INST]", "\\<|\\", "<|end|><|end|>"])
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_long_conversations_are_masked_whole():
    texts = ["<|end|> [INST] \\ é日本 " * 20_000, "", "x" * 300_000, " \n\t", "</s>" * 1000]
    tok = chat._tokenizer(queries.vocabulary("byte_bpe_50k.json"))
    formatted, spans = chat.render([(role, t) for t in texts for role in ("user", "assistant")])
    offsets = np.array(tok.encode(formatted, add_special_tokens=False).offsets).reshape(-1, 2)
    mask = chat.mask_tokens(offsets[:, 0], offsets[:, 1], spans)
    own = [formatted[a:b] for a, b in chat.masked_spans(mask, offsets[:, 0], offsets[:, 1])]
    assert [chat.unescape(t) for t in own] == [t for t in texts if t] and [t for _, t in chat.parse(formatted)] == [t for t in texts for _ in "ua"]


# -- counts -----------------------------------------------------------------------------------------------------------
def test_counts_are_the_librarys(hard, documents, empty, library):
    for docs in (hard, documents):
        got = by_row(token_counts.fits(docs, VOCAB, 2048).collect())
        want = by_row((r["doc_id"], len((t := r["text"] or "").encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 2048) for r in docs.collect())
        assert got == want
    assert token_counts.count_tokens(empty, VOCAB).count() == 0


AWKWARD = [" lead", "trail ", "a  b", "\u00a0x", "it's they're 'tis o'reilly '' 's's 'r 're 'rex 'lx 'll'v!'s 5's", "e\u0301e\u0301 a\u030a\u0323x \u1100\u1161\u11a8 \u0b47\u0b3e", "x<|endoftext|>y<|endoftex <|<|startoftext|>|>", "\u0130\u03a3 \u03a3\u0391\u03a3\u00df\u01c5", "\u3000a\u2003b\x85c\x1cd", "1234567,8.9", "--------------------!!!!?", "\U0001f600\u200d\U0001f468 \u65e5\u672c\u8a9e\u30c6\u30ad\u30b9\u30c8", "'", "''", "'R'E", "<|endoftext|>"]


def test_every_prefix(library):
    bpe = WordBpe.at(VOCAB)
    rng = np.random.default_rng(9)
    texts = [t[:120] for _, t, *_ in hard_rows()[:12] if t] + AWKWARD
    texts += ["".join(rng.choice(list("aRe'lvs!5 <|\u0301\u00c9\u03a3\u65e5\u00a0\u0bc6\u0bbe"), 25)) for _ in range(300)]
    for text in texts:
        want = [len(library.encode(text[:j], add_special_tokens=False).ids) for j in range(len(text) + 1)]
        assert bpe.prefix_counts(text).tolist() == want, text


def test_long_texts_at_every_prefix(library):
    bpe = WordBpe.at(VOCAB)
    rng = np.random.default_rng(2)
    for text in ("z" * 30000, "".join(rng.choice(list("abcXYZ019+/"), 30000)), "e\u0301" * 5000, "\u65e5\u672c" * 5000, "'re" * 5000):
        counts = bpe.prefix_counts(text)
        for j in [*rng.integers(0, len(text), 12).tolist(), len(text)]:
            assert counts[j] == len(library.encode(text[:j], add_special_tokens=False).ids)


def test_questions_are_answered_from_what_is_stored(hard, library):
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(hard, VOCAB).collect()}
    for doc, text, *_ in hard_rows()[:20]:
        counts = token_counts.prefix_counts(rows[doc]["steps"])
        assert counts[-1] == rows[doc]["n_tokens"] and len(counts) == len(text) + 1
        for j in range(0, len(text) + 1, 37):
            assert token_counts.count_prefix(rows[doc]["steps"], j) == len(library.encode(text[:j], add_special_tokens=False).ids)
        k = token_counts.longest_within(rows[doc]["steps"], 10)
        assert counts[k] <= 10 and (counts[k + 1 :] > 10).all()


# -- packing ----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("parts", [1, 1024])
def test_packing_is_whole_and_gapless(hard, documents, empty, library, monkeypatch, parts):
    monkeypatch.setattr(packing, "PARTS", parts)
    for docs, capacity in ((hard.repartition(3), 64), (documents, 2048)):
        out = packing.pack(docs, VOCAB, capacity, 0, keep_ids=True).collect()
        want = Counter()
        for r in docs.collect():
            ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
            for k, s in enumerate(range(0, len(ids), capacity)):
                own = ids[s : s + capacity].tobytes()
                want[r["doc_id"], k, s, len(own) // 4, zlib.crc32(own), own] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in out) == want
        rows = defaultdict(list)
        for r in out:
            rows[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in rows.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        lengths = [r["length"] for r in out]
        assert len(rows) <= best_fit(lengths, capacity)
    assert packing.pack(empty, VOCAB).count() == 0


def best_fit(lengths, capacity):
    """Best fit, longest first, one piece at a time."""
    bins = []
    for n in sorted(lengths, reverse=True):
        room = min((b for b in bins if b >= n), default=None)
        if room is not None:
            bins.remove(room)
        bins.append((capacity if room is None else room) - n)
    return len(bins)


# -- audio ------------------------------------------------------------------------------------------------------------
def plain_features(payload):
    """Direct sums: convolution, transform, triangles and the gate, frame by frame."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    k = np.arange(32) - 15.5
    h = np.sinc(k / 2) * np.hamming(32)
    h /= h.sum()
    line = np.concatenate([np.zeros(16), x, np.zeros(64)])
    y = np.array([line[2 * n : 2 * n + 32] @ h for n in range(-(-len(x) // 2))])
    n = 1 + max(0, len(y) - 200) // 80
    y = np.concatenate([y, np.zeros(200)])
    turn = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(200)) / 256)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (v / 2595) - 1) for v in np.linspace(0, mel(4000), 26)]
    freq = np.arange(129) * 8000 / 256
    bank = np.array([[max(0, min((f - a) / (b - a), (c - f) / (c - b))) for a, b, c in zip(edges, edges[1:], edges[2:], strict=False)] for f in freq])
    logs = np.log10(np.array([np.abs(turn @ (y[80 * i : 80 * i + 200] * np.hanning(200))) ** 2 @ bank for i in range(n)]) + 1e-6)
    slot = [i * 8 // n for i in range(n)]
    tensor = np.array([logs[[i for i in range(n) if slot[i] == s]].mean(0) if s in slot else np.zeros(24) for s in range(8)])
    return n, tensor, plain_segments(np.round(10 * logs.astype(np.float32).mean(1), 3))


def plain_segments(energy):
    on, out = False, []
    for i, e in enumerate(energy):
        was, on = on, e >= min(energy) + 9 or on and e >= min(energy) + 6
        if on and not was:
            out.append([i * 80 / 8000, None])
        if was and not on:
            out[-1][1] = (i * 80 + 120) / 8000
    if on:
        out[-1][1] = (len(energy) * 80 + 120) / 8000
    return [tuple(s) for s in out]


def test_audio_round_trip(hard, empty):
    out = audio.audio_columns(hard).collect()
    for r, (doc, text) in zip(sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"])), sorted(((d, t or "") for d, t, *_ in hard_rows()), key=lambda r: (r[0] is None, r[0] or 0, len(r[1].encode()))), strict=True):
        raw = text.encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        with wave.open(BytesIO(r["media"])) as w:
            assert w.readframes(w.getnframes()) == payload
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        n, tensor, segments = plain_features(payload)
        assert r["n_frames"] == n and audio.tensor_of(bytes(r["tensor"])).shape == (audio.SLICES, audio.MELS)
        assert np.allclose(audio.tensor_of(bytes(r["tensor"])), tensor, atol=0.011)
        assert [(s["start_s"], s["end_s"]) for s in r["segments"]] == segments
    assert audio.audio_columns(empty).count() == 0


@pytest.mark.parametrize("size", [1, 399, 1001])
def test_resampling_matches_direct_convolution(size):
    raw = np.random.default_rng(1).integers(0, 256, size).astype(np.uint8)
    h = audio._filter()
    padded = np.concatenate([np.zeros(audio.TAPS // 2), (raw.astype(float) - 128) / 128, np.zeros(audio.TAPS + 2)])
    want = [padded[2 * n : 2 * n + audio.TAPS] @ h for n in range(-(-size // 2))]
    assert np.allclose(audio.resample(raw.tobytes(), 0, len(want)), want, atol=1e-4)
    assert np.allclose(audio.resample(raw.tobytes(), len(want) // 3, len(want) // 2), want[len(want) // 3 : len(want) // 3 + len(want) // 2], atol=1e-4)


def test_blocks_of_frames_are_seamless(monkeypatch):
    raw = np.random.default_rng(1).integers(0, 256, 40_000).astype(np.uint8).tobytes()
    whole = np.concatenate(list(audio.log_mel(raw)))
    monkeypatch.setattr(audio, "BLOCK", 7)
    assert np.allclose(np.concatenate(list(audio.log_mel(raw))), whole, atol=1e-4)


def test_hysteresis_segments():
    e = np.array([0, 10, 7, 7, 5, 7, 10, 0.0])
    assert audio.hysteresis(e) == [(0.01, 0.055), (0.06, 0.085)] == plain_segments(e)
    assert audio.hysteresis(np.array([0.0])) == [] and audio.hysteresis(np.array([9, 0, 9.0])) == [(0.0, 0.025), (0.02, 0.045)]
    rng = np.random.default_rng(4)
    for _ in range(200):
        e = rng.integers(0, 14, rng.integers(1, 30)).astype(float)
        assert audio.hysteresis(e) == plain_segments(e)


def test_audio_query(spark, documents):
    from tests.conftest import SF

    made = {r["doc_id"]: r for r in audio.audio_columns(documents).collect()}
    for r in queries.op6(spark, SF).collect():
        own = made[r["doc_id"]]
        assert r["media_sha256"] == hashlib.sha256(own["media"]).hexdigest() and r["media_bytes"] == len(own["media"])
        assert r["feature"].startswith(f"frames={own['n_frames']};segments={len(own['segments'])};") and r["feature"].endswith(f"mel={zlib.crc32(own['tensor']):x}")


# -- URLs -------------------------------------------------------------------------------------------------------------
def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?q", "x://example.org/en/12", "x://b.example.org/de/", "x://org", "x://notorg/a", "x://m.com/fr/1", "x://m.com/de/1#f", "a://b://c/d", "x://Éa.com?x/y", "x://com/fr/"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:5] for r in url_filter.judge(pages, url_filter.Trees(), queries.RULES).collect()}
    for k, u in enumerate(urls):
        rest = (u or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(h + p, v) for v, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
        assert got[k] == (host, path, *best), u


def plain_probability(trees, url):
    """The trees walked one by one, from features stated here anew."""
    after = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", after)[0]
    path, query = re.match(r"([^?#]*)(?:\?([^#]*))?", after[len(host) :]).groups()
    if "?" not in after.split("#")[0]:
        query = ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    n = max(1, len(url))
    shares = [url.count(c) / n for c in set(url)]
    x = [len(url), len(host), path.count("/"), sum(c.isdigit() for c in url) / n, -sum(q * math.log2(q) for q in shares), sum(bool(p) for p in (query or "").split("&")), url.count("-"), host.count(".") + 1, max(len(p) for p in path.split("/")), sum(c.isdigit() for c in path.split("/")[-1])]
    for name in ("." + host.split(".")[-1], "/" + path.split("/")[1] if path.count("/") > 1 else "/"):
        rate, seen = trees.rates.get(name, (trees.prior, 0))
        x += [rate, math.log(1 + seen)]
    score = trees.start
    for tree in trees.trees:
        at = 0
        while tree[at][0] >= 0:
            feature, cut, left, _ = tree[at]
            at = left + (x[feature] > cut)
        score += tree[at][3]
    return 1 / (1 + math.exp(-score))


def made_urls():
    rng = np.random.default_rng(3)
    bad = [f"http://ads{rng.integers(9999)}.example.biz/{'/'.join(map(str, rng.integers(0, 99999, 4)))}?a={rng.integers(99)}&b=2" for _ in range(600)]
    good = [f"https://blog.example.org/{''.join(rng.choice(list('abcdefgh'), 8))}" for _ in range(600)]
    return bad, good


def test_trees_learn_held_out():
    bad, good = made_urls()
    trees = url_filter.Trees.fit(bad[:400] + good[:400], [1] * 400 + [0] * 400)
    assert (trees.probability(bad[400:]) > 0.5).mean() > 0.95 and (trees.probability(good[400:]) < 0.5).mean() > 0.95
    area, precision, recall = url_filter.held_out(bad + good, [1] * 600 + [0] * 600)
    assert min(area, precision, recall) > 0.95


def test_no_label_reaches_its_own_features():
    """Labels that nothing in a URL tells: a rate that had seen its own row would."""
    rng = np.random.default_rng(5)
    urls = [f"http://a.example.t{k}/p{k}/x" for k in range(1500)]
    y = rng.integers(0, 2, 1500).tolist()
    trees = url_filter.Trees.fit(urls, y)
    assert 0.4 < url_filter.held_out(urls, y)[0] < 0.6
    assert ((trees.probability(urls) > 0.5) == np.array(y)).mean() < 0.75


def test_verdicts_are_the_trees(spark):
    bad, good = made_urls()
    trees = url_filter.Trees.fit(bad[:300] + good[:300], [1] * 300 + [0] * 300)
    urls = [*bad[300:330], *good[300:330], None, "", "http://\u0130\u0130\u0130.example.biz/1/2", "x://" + "a" * 100_000 + "/" + "1/" * 50_000, "x://h?q=1&&r#s?t", "a://b://c/d", "x://H.Biz#f", "no scheme"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.judge(pages, trees, []).collect():
        want = plain_probability(trees, urls[r["page_id"]] or "")
        assert math.isclose(r["block_probability"], want, abs_tol=1e-9) and r["verdict"] == ("block" if want >= 0.5 else "allow")
    assert url_filter.lexical("http://\u0130\u0130\u0130.example.org/a/b", {}, 0.0)[2] == 2


# -- PII --------------------------------------------------------------------------------------------------------------
PATTERNS = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
            if kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split(".")) or kind == 2 and 12 <= len(digits) <= 19 and luhn or kind == 3 and 9 <= len(digits) <= 15:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_patterns(documents):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("a1@.-+ 0(_é5)9"), 60)) for _ in range(3000)] + [r["text"] for r in documents.collect()]
    texts += ["a@b.cx_y@z.w", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.4", "4539 1488 0343 6467", "+49 (0)30 1234567", "@a.b", "x@a", "x@a..b"]
    for t in texts:
        assert pii.find_base(t) == plain_base(t), t


def test_base_is_linear_on_long_runs():
    for t in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "@" * 200_000, "+1" + " " * 200_000, "a@" * 100_000):
        pii.find_base(t)


def test_disclosing_terms_and_rewriting(hard, empty):
    out = {(r["doc_id"], r["text_key"]): r for r in pii.detect(hard).collect()}
    texts = {d: t for d, t, *_ in hard_rows()}
    for (doc, _), r in out.items():
        if doc is not None:
            assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == plain_base(texts[doc] or "")
    for k in range(500, 505):
        own = next(r for (d, _), r in out.items() if d == k)
        assert {texts[k][s["start"] : s["end"]] for s in own["terms"]} >= {"zweibrueckenhaus"}
    clean = pii.sanitise(hard)
    assert clean.columns == hard.columns and clean.count() == hard.count()
    for r in clean.where("doc_id >= 500").collect():
        assert "[EMAIL]" in r["text"] and "zweibruecken" not in r["text"] and "smithson" not in r["text"]
    untouched = {r["doc_id"]: r["text"] for r in clean.where("doc_id < 60").collect()}
    assert all(untouched[k] == texts[k] for k in range(60))
    assert pii.detect(empty).count() == 0 and pii.sanitise(empty).count() == 0


def plain_terms(rows):
    """Term spans of each document by the definition, over all (doc_id, text)."""
    held, beside, entities, places = defaultdict(set), defaultdict(set), defaultdict(set), {}
    for d, t in rows:
        base = plain_base(t)
        for m in re.finditer(r"[^\W\d_]{2,}", t):
            held[m[0].lower()].add(d)
        free = places[d] = [m for m in re.finditer(r"[^\W\d_]{2,}", t) if not any(a < m.end() and m.start() < e for a, _, e in base)]
        for a, k, e in base:
            entities[k, t[a:e]].add(d)
            for m in [m for m in free if m.start() < a][-4:] + [m for m in free if m.start() >= e][:4]:
                beside[m[0].lower(), k, t[a:e]].add(d)
    out = defaultdict(dict)
    for (term, *entity), docs in beside.items():
        share = len(docs) / len(held[term])
        if share >= 0.5 and math.log2(share * len(rows) / len(entities[tuple(entity)])) >= 4:
            for d in docs:
                for m in places[d]:
                    if m[0].lower() == term:
                        own = out[d]
                        own[m.start(), m.end()] = max(own.get((m.start(), m.end()), 4), 5 if share >= 0.9 else 4)
    return out


def test_unique_entities_disclose_terms(spark, documents):
    made = [(k, f"plain common words stand here number {k}") for k in range(40)] + [(40, "common words then zweibrueckenhaus ask ann.smithson@mail.example.org now")]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert "zweibrueckenhaus" not in clean[40] and "common words" in clean[40] and all(clean[k] == t for k, t in made[:40])
    short = made[:40] + [(40, "common words then Bo Xi writes bo.xi@mail.example.org words and Xi again")]
    assert " Xi" not in {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(short, "doc_id long, text string")).collect()}[40]
    want = plain_terms([(r["doc_id"], r["text"] or "") for r in documents.collect()])
    got = {r["doc_id"]: {(s["start"], s["end"]): s["kind"] for s in r["terms"]} for r in pii.detect(documents).collect() if r["terms"]}
    assert got == dict(want) and sum(map(len, got.values())) > 50


def test_pii_query(spark, documents):
    from tests.conftest import SF

    names = ["email", "ip", "card", "phone"]
    got = {r["doc_id"]: r for r in queries.op10(spark, SF).collect()}
    for r in documents.collect():
        base = plain_base(r["text"])
        own = ",".join(f"{names[k]}:{a}:{e}" for a, k, e in base)
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(own.encode()).hexdigest()
        assert [got[r["doc_id"]][f"n_{n}"] for n in names] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert set(own.split(",")) <= {*got[r["doc_id"]]["spans"].split(","), ""}


def test_url_query_trains_and_judges_all(spark):
    from tests.conftest import SF

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = queries.op7(spark, SF).collect()
    assert Counter(r["page_id"] for r in rows) == Counter(r["page_id"] for r in pages.collect())
    assert {r["verdict"] for r in rows} <= {"allow", "block"}
    labels = spark.createDataFrame([], "page_id long, blocked int")
    trees = url_filter.train(pages, labels)
    assert trees.trees == [] and url_filter.judge(pages.limit(0), trees, queries.RULES).count() == 0


def test_counts_along_known_beginnings_are_the_librarys():
    """Words met after others that share their beginnings, of one or more bytes a letter, and after the kept ones were cleared."""
    from public_tokenizers import path
    from visparq.llm import wordbpe

    bpe = wordbpe.WordBpe(path("word_bpe_49k.json"))
    words = ["thonre", "tho", "thonrest", "thon", "éaneux", "éan", "éaß", "a", "", "thé", "thénards", "x" * 40 + "y", "x" * 40 + "z"]
    for _ in range(2):
        for word in words:
            assert bpe.word_prefix_counts(word) == [len(bpe.library.encode(word[:k], add_special_tokens=False).ids) for k in range(len(word) + 1)]
        bpe._words.clear()
    steps = [0]
    known = bpe._back.get
    bpe._back = type("Counted", (dict,), {"get": lambda self, key: (steps.__setitem__(0, steps[0] + 1), known(key))[1]})()
    bpe.word_prefix_counts("zqj" * 30)
    assert steps[0] < 4 * 90  # places looked at follow the vocabulary's endings, not its longest token
