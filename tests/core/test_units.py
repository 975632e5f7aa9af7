"""Streams, bounded JSON, images, and small functions."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from visparq import session
from visparq.functions import color, guards, text
from visparq.operators import annotate, html, jsonx, tree
from visparq.sources import rasters
from visparq.streaming import limiter


def plain_limit(events, window, limit):
    kept, out = {}, {}
    for k, e, ms in sorted(events, key=lambda r: (r[0], r[2], r[1])):
        own = [t for t in kept.get(k, []) if ms - t < window]
        out[e] = len(own) < limit
        kept[k] = own + [ms] * out[e]
    return out


@pytest.fixture(scope="module")
def events():
    rng = random.Random(0)
    return [(rng.randrange(4), k, rng.randrange(100_000)) for k in range(300)]


def test_limiter_batch(spark, events):
    df = spark.createDataFrame(events, "key long, event_id long, ms long")
    assert {r["event_id"]: r["accepted"] for r in limiter.limit_batch(df, 20_000, 3).collect()} == plain_limit(events, 20_000, 3)


def test_limiter_stream(spark, events, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ordered = sorted(events, key=lambda r: r[2])
    for k in range(3):  # three files in the order of time are three micro-batches
        spark.createDataFrame(ordered[100 * k : 100 * k + 100], "key long, event_id long, ms long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, event_id long, ms long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = limiter.limit_stream(stream, 20_000, 3).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert {r["event_id"]: r["accepted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == plain_limit(events, 20_000, 3)


JSON = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text(max_size=400), lambda c: st.lists(c, max_size=30) | st.dictionaries(st.text(max_size=6), c, max_size=6), max_leaves=60)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text(max_size=6), JSON, max_size=6), st.integers(1200, 4000))
def test_bounded_json_is_valid(value, most):
    out = jsonx.bound_json(value, most)
    parsed = json.loads(out)
    assert jsonx.units(out) <= most or parsed["success"] is False
    if len(jsonx.dump(value, True)) <= most:
        assert parsed == value


def test_bounded_json_keeps_the_verdict():
    contrast = {"verdict": "failing", "all_meet_aa": False, "worst": {"foreground": "#484f58", "contrast_ratio": 2.14, "x": "y" * 200}, "colours": [{"hex": "#000000", "n": k, "pad": "p" * 90} for k in range(400)], "notes": ["n" * 200] * 3}
    value = {"success": True, "measurements": {"contrast": contrast}}
    for most, tier in ((12_000, None), (2_200, None), (600, "verdict")):
        out = json.loads(jsonx.bound_json(value, most))
        assert out["success"] is True and out["measurements"]["contrast"]["verdict"] == "failing" and out["_truncation"]["truncated"]
        assert tier is None or out.get("truncated_to") == tier
    assert json.loads(jsonx.bound_json(value, 120))["success"] is False


def test_images_round_trip(spark):
    rng = np.random.default_rng(0)
    frames = [rng.integers(0, 256, (3, 5, 3), dtype=np.uint8)]
    px = rasters.explode_pixels(rasters.images_of(spark, frames)).collect()
    assert all((r["r"], r["g"], r["b"]) == tuple(int(v) for v in frames[0][r["y"], r["x"]]) for r in px) and len(px) == 15


def bmp(frame):
    h, w, _ = frame.shape
    pad = b"\0" * (-w * 3 % 4)
    body = b"".join(frame[y, :, ::-1].tobytes() + pad for y in range(h - 1, -1, -1))
    u = lambda v, n: v.to_bytes(n, "little")
    return b"BM" + u(54 + len(body), 4) + u(0, 4) + u(54, 4) + u(40, 4) + u(w, 4) + u(h, 4) + u(1, 2) + u(24, 2) + bytes(24) + body


def test_image_files_decode(spark, tmp_path):
    frame = np.random.default_rng(1).integers(0, 256, (4, 6, 3), dtype=np.uint8)
    (tmp_path / "a.bmp").write_bytes(bmp(frame))
    (tmp_path / "b.png").write_bytes(b"not an image")
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in rasters.read_images(spark, str(tmp_path)).collect()}
    assert bytes(rows["a.bmp"]["data"]) == frame.tobytes() and (rows["a.bmp"]["width"], rows["a.bmp"]["height"]) == (6, 4)
    assert rows["b.png"]["width"] is None


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_small_functions(spark):
    r = one(
        spark,
        clamp=F.array(*(color.clamp255(F.lit(v)) for v in (-3.0, 0.5, 254.5, 300.0, float("nan"), float("inf")))),
        rounded=color.round2(F.lit(1.005)),
        scheme=guards.scheme(F.lit("https://a/b.png")),
        traversal=guards.within(F.lit("/srv"), F.lit("../srvx")),
        partial=text.match(F.lit("abcd"), F.lit("abcdef")),
        short=text.match(F.lit("abc"), F.lit("abcdef")),
        title=html.title(F.lit("<TITLE a='b'> x </title>")),
        asked=F.array_join(text.quantitative(F.lit("What is the resize of it?")), ","),
        footer=annotate.footer(F.lit("m"), F.lit(None), F.lit(5), F.lit(3), F.lit(4), F.lit(False)),
    )
    assert list(r["clamp"]) == [0, 1, 255, 255, 0, 0] and r["rounded"] == 1.0 and r["scheme"] == "http" and r["traversal"] is False
    assert (r["partial"], r["short"], r["title"], r["asked"]) == ("partial", None, "x", "") and r["footer"] == "model: m | total: 5ms | image: 3x4"


def test_salvage_strategies(spark):
    cases = {'{"a": 1}': "direct", '<think>x</think>{"a": 1}': "think", 'so {"a": 1} ok': "braces", "so [1, 2] ok": "brackets", "```json\n{\"a\": 1}\n```": "braces", "none": None}
    df = spark.createDataFrame([(k,) for k in cases], "reply string")
    s = jsonx.salvage(F.col("reply"))
    assert {r["reply"]: r["s"] for r in df.select("reply", s["strategy"].alias("s")).collect()} == cases


def test_tree_depth_and_hidden(spark):
    df = spark.createDataFrame([(1, "a/b/c/d/e.txt", 5), (1, ".x/y", 1), (1, ".git/HEAD", 2), (1, "node_modules/z.js", 3), (1, "top.MD", 4)], "graph_id long, path string, size long")
    assert {r["id"] for r in tree.nodes(df, 1).collect()} == {"a", "a/b", ".git", ".git/HEAD", "top.MD"}
    assert {r["source"] for r in tree.edges(tree.nodes(df, 1)).collect()} == {"a", ".git"}


def test_env_lines():
    assert session.load_env('A=1\n# c\nB="x y"\nC=\'z\'\nbad\nA=2', {"C": "kept"}) == {"A": "1", "B": "x y", "C": "kept"}


def test_deadlines(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    from visparq.streaming.deadlines import Progress, with_deadline

    said = []
    listener = Progress(lambda event, rows: said.append(event))
    spark.streams.addListener(listener)
    rows = [(1, False), (1, True), (2, False), (1, True)]
    spark.createDataFrame(rows, "key long, done boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, done boolean").parquet(str(tmp_path / "in"))
    q = with_deadline(stream, 1).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(processingTime="1 second").start()
    import time

    for _ in range(60):
        time.sleep(1)
        if (tmp_path / "out").exists() and len(got := spark.read.schema("key long, outcome string, chunks long").parquet(str(tmp_path / "out")).collect()) == 2:
            break
    q.stop()
    spark.streams.removeListener(listener)
    assert {(r["key"], r["outcome"]) for r in got} == {(1, "done"), (2, "timeout")} and "progress" in said


def test_tree_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("hello")
    (tmp_path / "top.md").write_text("hi")
    got = {(r["path"], r["size"]) for r in tree.scan(spark, str(tmp_path)).collect()}
    assert got == {("a/x.txt", 5), ("top.md", 2)}


# -- files ------------------------------------------------------------------------------------------------------------
@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.lists(st.integers(0, 4), min_size=9, max_size=9), st.sampled_from([1, 2, 3, 4]))
def test_png_filters(w, h, kinds, n):
    import struct
    import zlib

    from visparq.operators import files

    rng = np.random.default_rng(w * 10 + h)
    px = rng.integers(0, 256, (h, w, n)).astype(int)
    raw = b""
    for y in range(h):
        line = [kinds[y]]
        for x in range(w):
            for c in range(n):
                a, b, d = px[y, x - 1, c] if x else 0, px[y - 1, x, c] if y else 0, px[y - 1, x - 1, c] if x and y else 0
                p = a + b - d
                paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - d) else b if abs(p - b) <= abs(p - d) else d
                line.append((px[y, x, c] - (0, a, b, (a + b) // 2, paeth)[kinds[y]]) % 256)
        raw += bytes(int(v) for v in line)
    parts = ((b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)), (b"IDAT", zlib.compress(raw)), (b"IEND", b""))
    made = files.PNG + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)
    got, error = files.decode(made)
    assert error is None and (got == (px[..., :3] if n >= 3 else np.repeat(px[..., :1], 3, 2))).all()
    assert files.decode(made[:-5])[1] == "truncated"


def test_png_files_are_read_by_others(spark, tmp_path):
    from visparq.operators import files

    frame = np.random.default_rng(1).integers(0, 256, (4, 6, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(files.encode_png(frame))
    row = rasters.read_images(spark, str(tmp_path)).collect()[0]
    assert bytes(row["data"]) == frame.tobytes()
    assert (files.decode(files.encode_png(frame))[0] == frame).all() and (files.decode(bmp(frame))[0] == frame).all()
    assert [files.decode(c)[1] for c in (None, b"", b"GIF89a", b"hello", b"BM")] == ["empty", "empty", "unsupported", "not_an_image", "truncated"]


# -- noise ------------------------------------------------------------------------------------------------------------
def plain_noise(tile):
    px = tile.reshape(-1, 3).astype(float)
    mid = np.array([sorted(c)[len(c) // 2] for c in px.T])
    d = sorted(np.sqrt(((px - mid) ** 2).sum(1)))
    return mid, 1.4826 * sorted(abs(v - d[len(d) // 2]) for v in d)[len(d) // 2]


def test_one_noise_model(spark):
    from visparq.operators import histogram, kernels

    rng = np.random.default_rng(2)
    frame = np.clip(rng.normal(128, 6, (100, 110, 3)), 0, 255).astype(np.uint8)
    middle, noise = kernels.tile_noise(frame, 48, 1.4826)
    assert middle.shape == (3, 3, 3)
    native = {(r["ty"], r["tx"]): r for r in histogram.tile_background(rasters.explode_pixels(rasters.images_of(spark, [frame])), 48).collect()}
    for ty in range(3):
        for tx in range(3):
            mid, sigma = plain_noise(frame[ty * 48 : ty * 48 + 48, tx * 48 : tx * 48 + 48])
            assert (middle[ty, tx] == mid).all() and noise[ty, tx] == pytest.approx(sigma)
            own = native[ty, tx]
            assert (own["mr"], own["mg"], own["mb"]) == tuple(mid) and own["sigma"] == pytest.approx(sigma)
    assert 3 < noise[0, 0] < 6  # of noise of 6 a channel


def test_plateaus_without_text_are_disclosed():
    from visparq.operators import contrast

    glyphs = [(60 + 30 * (i % 6), 60 + 40 * (i // 6), 8, 20, "#e8dfd0") for i in range(30)]
    frame = rasters.paint(600, 400, "#1a1814", [(300, 0, 300, 400, "#464646"), *glyphs])
    out = contrast.measure_region(frame)
    assert out["background_model"] == "multi-plateau" and [p["hex"] for p in out["plateaus_without_text"]] == ["#464646"]
    assert any("not a claim" in n for n in out["notes"])
    both = rasters.paint(600, 400, "#1a1814", [(300, 0, 300, 400, "#464646"), *glyphs, *((360 + 30 * (i % 6), 60 + 40 * (i // 6), 8, 20, "#b0ffb0") for i in range(30))])
    assert contrast.measure_region(both)["plateaus_without_text"] == []


# -- bounded JSON ------------------------------------------------------------------------------------------------------
def test_bounded_json_cuts_as_little_as_fits():
    texts = {"a": "x" * 3000, "b": "y" * 900, "c": "z" * 100}
    out = json.loads(jsonx.bound_json(texts, 2200))
    assert out["a"].startswith("…[truncated 3000") and out["b"] == "y" * 900
    assert [a["path"] for a in out["_truncation"]["actions"]] == ["$.a"]
    lists = {"n": list(range(3000)), "m": [{"k": [1, 2, 3]}] * 5}
    out = json.loads(jsonx.bound_json(lists, 3000))
    act = out["_truncation"]["actions"]
    assert [a["path"] for a in act] == ["$.n"] and act[0]["was"] == 3000 and act[0]["remaining"] == len(out["n"]) and out["m"] == lists["m"]
    one = {**lists, "n": list(range(act[0]["remaining"] + 1))}
    assert jsonx.units(jsonx.dump(one, True)) > 3000 - jsonx.RESERVE >= jsonx.units(jsonx.dump({**lists, "n": out["n"]}, True))


def test_evidence_containment_matches_brute_force(spark):
    from visparq.operators import evidence

    rng = random.Random(1)
    made = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(0, 9)))
    claims, norms = ({(d, made()) for d in (1, 2) for _ in range(60)} - {(1, ""), (2, "")} for _ in range(2))
    got = {tuple(r) for r in evidence.met(spark.createDataFrame(sorted(claims), "doc_id long, claim string"), spark.createDataFrame(sorted(norms), "doc_id long, norm string"), 4).collect()}
    assert got == {(d, c, n) for d, c in claims for e, n in norms if d == e and (c == n or len(c) >= 4 and len(n) >= 4 and (c in n or n in c))}


def test_large_images_travel_in_small_batches(spark):
    """What an enlargement makes of one batch is sent in parts; colours are counted on an image's row, as pixels count them."""
    import pyarrow as pa

    from visparq.operators import histogram
    from visparq.plans import pixels

    whole = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([bytes(192)] * 49 + [None], pa.binary())], names=["image_id", "data"])
    cut = list(rasters.parts([whole], 144, 100_000))
    assert [r for b in cut for r in b.column("image_id").to_pylist()] == list(range(50))
    assert len(cut) > 1 and all(144 * sum(map(len, b.column("data").drop_null().to_pylist())) <= 100_000 for b in cut)
    assert [b.num_rows for b in rasters.parts([whole], 1_000_000, 100)][:3] == [1, 1, 1]
    frames = pixels.upscale(pixels.images(spark, "/root/testdata/sf0.001").where("image_id < 40"), 3)
    assert sorted(histogram.of_images(frames).collect()) == sorted(histogram.histogram(rasters.explode_pixels(frames)).collect())
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000


def test_items_and_words_meet_on_a_row(spark):
    """Per document as the joins have it; the queries over documents shuffle no word."""
    from visparq.operators import evidence
    from visparq.plans import evidence as plans

    rng = random.Random(3)
    for _ in range(300):
        claims, norms = ([("".join(rng.choice("ab") for _ in range(rng.randrange(0, 8)))) for _ in range(rng.randrange(0, 9))] for _ in range(2))
        fits = lambda c, n: bool(c and n) and (c == n or min(len(c), len(n)) >= 4 and (c in n or n in c))
        at, whole, seen = evidence.meet(claims, norms)
        assert at == [next((j for j, n in enumerate(norms) if fits(c, n)), None) for c in claims]
        assert whole == [len(c) >= 4 and c in "".join(norms) for c in claims] and seen == [any(fits(c, n) for c in claims) for n in norms]
    sf = "/root/testdata/sf0.001"
    for query, flat in ((plans.ocr_support, evidence.support), (plans.ocr_full_text, evidence.whole_text)):
        own = query(spark, sf)
        assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
        assert sorted(own.collect()) == sorted(flat(plans.items(spark, sf), plans.words(spark, sf)).collect())
    for query in (plans.ocr_only, plans.reconcile_items):
        assert "Exchange" not in query(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_answers_need_no_join_with_words_on_the_row(spark):
    """Words on the request's row give what a table of words gives."""
    from visparq.operators import measure
    from visparq.plans import evidence as plans
    from visparq.plans import pixels

    sf = "/root/testdata/sf0.001"
    reply = F.to_json(F.struct(F.transform("items", lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"))).alias("text_items")))
    asked = plans.together(spark, sf).where("doc_id < 20").select("doc_id", F.lit(1).cast("long").alias("image_id"), F.lit("Describe it").alias("prompt"), reply.alias("reply"), "words")
    frames = pixels.images(spark, sf).where("image_id = 1")
    own = sorted(map(str, measure.answer(asked, frames).collect()))
    assert own and own == sorted(map(str, measure.answer(asked.drop("words"), frames, plans.words(spark, sf)).collect()))


def test_an_image_is_measured_in_one_pass(spark):
    """Whatever is asked for, rasters go to Python once and nothing is joined; each part is what its own operator finds."""
    from visparq.operators import components, contrast, histogram, measure
    from visparq.plans import pixels

    small, grey = pixels.images(spark, "/root/testdata/sf0.001").where("image_id < 30"), (120, 120, 120)
    frames = pixels.upscale(small, 12)
    own = measure.measure_image(small, "all", grey, enlarge=12)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and not any(x in plan for x in ("MapInPandas", "Join", "Exchange"))
    rows = {r["image_id"]: r.asDict(True) for r in own.collect()}
    assert rows == {r["image_id"]: r.asDict(True) for r in measure.measure_image(frames, "all", grey).collect()} and len(rows) == small.count()
    for r in contrast.measure(frames).collect():
        assert rows[r["image_id"]]["contrast"] == {k: v for k, v in r.asDict(True).items() if k != "image_id"}
    top, boxes = {}, {}
    for r in histogram.dominant(histogram.of_images(frames)).orderBy("image_id", "rank").collect():
        top.setdefault(r["image_id"], []).append({k: v for k, v in r.asDict().items() if k != "image_id"})
    for r in components.boxes(components.components(frames, grey, least=200)).orderBy("image_id", "top", "left").collect():
        boxes.setdefault(r["image_id"], []).append({k: r[k] for k in ("top", "left", "width", "height", "area")})
    assert {k: r["colors"] for k, r in rows.items()} == top and {k: r["boxes"] for k, r in rows.items() if r["boxes"]} == boxes and boxes
    # Rows that share an id are measured by themselves; one without data has its dimensions alone.
    odd = spark.createDataFrame([(1, 2, 1, bytes(6)), (1, 2, 1, bytes([255] * 6)), (2, 4, 2, None)], "image_id long, width int, height int, data binary")
    got = sorted((r["image_id"], r["dimensions"]["width"], r["colors"] and r["colors"][0]["hex"], r["contrast"] is None) for r in measure.measure_image(odd).collect())
    assert got[:2] == [(1, 2, "#000000", False), (1, 2, "#ffffff", False)] and got[2:] == [(2, 4, None, True)]


def test_a_worker_does_not_hold_the_results_of_a_whole_batch(spark):
    """Results are sent a part of a batch at a time, in order and whole; an image larger than a part is one by itself."""
    import pyarrow as pa

    from visparq.operators import contrast, measure

    class Frame:
        sparkSession = spark

        def select(self, *columns):
            return self

        def mapInArrow(self, run, kind):
            return run

    sides = [8] * 700 + [160, 8, 0]
    data = [bytes([k % 251, 9, 200]) * n * n for k, n in enumerate(sides)] + [None]
    sides.append(8)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sides)), pa.int64()), pa.array(sides, pa.int32()), pa.array(sides, pa.int32()), pa.array(data, pa.binary())], names=["image_id", "width", "height", "data"])
    run = measure._measured(Frame(), None, True, None, 2)
    sent = list(run(iter([batch])))
    assert [k for b in sent for k in b.column("image_id").to_pylist()] == list(range(len(sides)))
    for b in sent:
        held = sum(len(data[k] or b"") for k in b.column("image_id").to_pylist())
        assert held <= measure.PART_BYTES or b.num_rows == 1 and held == 160 * 160 * 3
    rows = [r for b in sent for r in b.to_pylist()]
    assert [r["total"] for r in rows] == [4 * n * n or None for n in sides[:-1]] + [None] and rows[700]["top"] == [{"key": 700 % 251 << 16 | 9 << 8 | 200, "n": 4 * 160 * 160}]
    # The verdicts come out the same way.
    first = next(measure._measured(Frame(), contrast.Options(), False, None, 1)(iter([batch])))
    assert 0 < first.num_rows < 700 and first.column("contrast")[0].as_py()["verdict"] == "unverified"
