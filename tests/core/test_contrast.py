"""Golden rasters, metamorphic relations and channel completeness of the contrast verdict."""

import math

import numpy as np
import pytest

from visparq.operators import contrast, kernels
from visparq.sources.rasters import images_of, paint

PAGE = "#1a1814"


def measured(raster, region=None, **kw):
    return contrast.measure_region(raster, region, contrast.Options(**kw))


@pytest.mark.parametrize(("colour", "ratio"), [("#e8dfd0", 13.42), ("#a09588", 6.03), ("#7daa7a", 6.67), ("#484f58", 2.14), ("#1e1c18", 1.04), ("#464646", 1.88), ("#2e2a24", 1.24)])
def test_golden_ratios(colour, ratio):
    rgb = lambda h: tuple(int(h[k : k + 2], 16) for k in (1, 3, 5))
    assert contrast.two(contrast.ratio(rgb(colour), rgb(PAGE))) == ratio


def test_blend_goldens():
    rgb = lambda h: tuple(int(h[k : k + 2], 16) for k in (1, 3, 5))
    cases = [("#787065", "#a09588", True), ("#1e1c18", "#484f58", False), ("#4a433c", "#484f58", False)]
    assert [contrast.on_line(rgb(x), rgb(y), rgb(PAGE), contrast.WINDOW_FOLD) for x, y, _ in cases] == [w for *_, w in cases]


def test_dropped_panel():
    out = measured(paint(1000, 700, PAGE, [(60, 40, 420, 620, "#464646"), (520, 40, 420, 620, "#464646")]))
    found = [r for r in out["reconciliation"] if r["contrast_ratio"] == 1.88]  # the panels are the modal colour here
    assert out["all_meet_aa"] is not True and found and found[0]["mean_component_area"] >= 0.02 * 700_000


def test_panel_and_fragments():
    out = measured(paint(1000, 700, PAGE, [(100, 100, 200, 80, "#464646")] + [(80 + 90 * i, 420, 24, 14, "#464646") for i in range(10)]))
    assert not out["measurable"] and [(r["hex"], r["detected_plateau"]) for r in out["reconciliation"]] == [("#464646", True)]


def test_residual_solid_tiles():
    rects = [(60 + 180 * i, 80, 52, 60, "#464646") for i in range(5)] + [(40 + 95 * (i % 10), 420 + 40 * (i // 10), 14, 10, "#464646") for i in range(20)]
    out = measured(paint(1000, 700, PAGE, rects))
    assert not out["measurable"] and "#464646" in {r["hex"] for r in out["reconciliation"]}


def test_fragmentation():
    counts = []
    for n in (4, 6):
        rects = [(40, 40, 920, 620, "#1c1a17")] + [(60 + i * 900 // n, 60 + 560 * i // n, 60, max(8, round(round(70000 / n) / 60)), "#464646") for i in range(n)]
        out = measured(paint(1000, 700, "#12100e", rects))
        shown = [r for r in out["reconciliation"] if r["hex"] == "#464646"] + [e for e in out["entries"] if e["hex"] == "#464646" and e["channel"] == "evaluated"]
        assert shown
        counts.append(shown[0]["component_count"])
    assert counts[0] < counts[1]


@pytest.mark.parametrize("n", [1, 4, 8, 16])
def test_count_invariance(n):
    side = round(math.sqrt(2000 / n))
    out = measured(paint(1000, 700, PAGE, [(40 + 110 * (i % 8), 40 + 110 * (i // 8), side, side, "#312f2c") for i in range(n)]))
    assert "#312f2c" in {e["hex"] for e in out["entries"] if e["channel"] == "evaluated" and not e["meets_aa"]}
    assert out["verdict"] == "failing"


def test_flat_is_unmeasurable():
    out = measured(paint(900, 420, "#141414", []))
    assert not out["measurable"] and out["all_meet_aa"] is None and out["verdict"] == "unverified"


def test_hollow_ring_is_decoration():
    ring = [(100, 100, 200, 150, "#3a3733"), (103, 103, 194, 144, PAGE)]
    out = measured(paint(1000, 700, PAGE, ring))
    assert out["failing_count"] == 0 and {e["channel"] for e in out["entries"]} == {"excluded"}


def test_gradient_abstains():
    ramp = np.linspace(0x10, 0x60, 420).round().astype(np.uint8)
    out = measured(np.repeat(np.repeat(ramp[:, None, None], 900, 1), 3, 2))
    assert not out["measurable"] and out["all_meet_aa"] is None and out["failing_count"] == 0


def test_photographic_noise_is_unverified():
    rng = np.random.default_rng(5)
    ramp = np.linspace(60, 140, 360)[:, None, None] + rng.normal(0, 8, (360, 700, 1))
    image = np.clip(np.repeat(ramp, 3, 2).round(), 0, 255).astype(np.uint8)
    assert measured(image)["verdict"] == "unverified"
    assert measured(image, local=True)["evaluated_count"] == 0


def glyphs(colour, n=12, page=PAGE):
    return paint(600, 300, page, [(30 + 40 * (i % 12), 60, 8, 20, colour) for i in range(n)])


def test_clean_and_failing_text():
    assert measured(glyphs("#e8dfd0"))["verdict"] == "clean"
    assert measured(glyphs("#484f58"))["verdict"] == "failing"


def test_local_agrees_with_global_on_flat():
    for c in ("#e8dfd0", "#484f58"):
        a, b = measured(glyphs(c)), measured(glyphs(c), local=True)
        assert [(e["hex"], e["contrast_ratio"]) for e in a["entries"]] == [(e["hex"], e["contrast_ratio"]) for e in b["entries"]]


def test_translation_of_the_region():
    big = paint(900, 600, PAGE, [])
    big[200:500, 100:700] = glyphs("#484f58")
    a, b = measured(glyphs("#484f58")), measured(big, (100, 200, 600, 300))
    assert (a["worst"], a["verdict"], a["failing_count"]) == (b["worst"], b["verdict"], b["failing_count"])


def test_every_pixel_colour_has_one_channel():
    rng = np.random.default_rng(1)
    palette = ["#e8dfd0", "#484f58", "#7daa7a", "#312f2c"]
    image = paint(600, 400, PAGE, [(int(rng.integers(0, 560)), int(rng.integers(0, 360)), int(rng.integers(6, 40)), int(rng.integers(6, 40)), palette[i % 4]) for i in range(60)])
    entries = measured(image)["entries"]
    assert len({e["hex"] for e in entries}) == len(entries)


@pytest.mark.parametrize(("name", "value"), [("REGION_SHARE", 0.0), ("MIN_INK_AREA", 100_000), ("COLOUR_FLOOR", 10**9)])
def test_constants_matter(monkeypatch, name, value):
    before = measured(glyphs("#312f2c"), floor=8)
    monkeypatch.setattr(contrast.S, name, value)
    after = measured(glyphs("#312f2c"), **({"floor": value} if name == "COLOUR_FLOOR" else {}))
    assert (before["verdict"], before["evaluated_count"]) != (after["verdict"], after["evaluated_count"])


def test_labels_match_a_plain_flood_fill():
    rng = np.random.default_rng(0)
    for _ in range(20):
        keys = rng.integers(0, 3, (9, 11))
        valid = rng.random((9, 11)) < 0.8
        want = np.full(keys.shape, -1)
        for start in range(keys.size):
            y, x = divmod(start, 11)
            if valid[y, x] and want[y, x] < 0:
                stack = [(y, x)]
                while stack:
                    a, b = stack.pop()
                    if 0 <= a < 9 and 0 <= b < 11 and valid[a, b] and want[a, b] < 0 and keys[a, b] == keys[y, x]:
                        want[a, b] = start
                        stack += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
        assert (kernels.label4(keys, valid) == want).all()


def test_over_spark(spark):
    rows = contrast.measure(images_of(spark, [glyphs("#e8dfd0"), glyphs("#484f58"), paint(50, 50, PAGE, [])])).orderBy("image_id").collect()
    assert [r["verdict"] for r in rows] == ["clean", "failing", "unverified"]


def test_more_failing_ink_never_silences_a_disclosure():
    panels = [(60, 40, 420, 620, "#464646"), (520, 40, 420, 620, "#464646")]
    plain = {(r["hex"], r["contrast_ratio"]) for r in measured(paint(1000, 700, PAGE, panels))["reconciliation"]}
    more = measured(paint(1000, 700, PAGE, panels + [(500, 60 + 30 * i, 8, 20, "#2e2a24") for i in range(12)]))
    shown = {(r["hex"], r["contrast_ratio"]) for r in more["reconciliation"]} | {(e["hex"], e["contrast_ratio"]) for e in more["entries"]}
    assert plain <= shown and more["all_meet_aa"] is not True


@pytest.mark.parametrize("tolerance", [8, 12, 16, 24, 32])
def test_verdicts_are_stable_over_tolerances(tolerance):
    assert measured(glyphs("#e8dfd0"), tolerance=tolerance)["verdict"] == "clean"
    assert measured(glyphs("#484f58"), tolerance=tolerance)["verdict"] == "failing"


def test_acceptance_layout():
    from visparq.operators.contrast import ratio
    from visparq.sources import fixtures

    rgb = lambda h: tuple(int(h[k : k + 2], 16) for k in (1, 3, 5))
    for colour, *_, declared in fixtures.TEXTS:
        assert contrast.two(ratio(rgb(colour), rgb(fixtures.PAGE))) == declared
    out = measured(fixtures.layout(), (0, 0, 1200, 360))
    assert out["verdict"] == "failing" and out["worst"] == {"hex": "#1e1c18", "contrast_ratio": 1.04} and out["best"]["contrast_ratio"] == 13.42
    assert (out["evaluated_count"], out["failing_count"]) == (4, 2)
    assert fixtures.owner_of(325, 390) == "ECHO" and fixtures.owner_of(310, 390) is None


def test_regions_over_spark(spark):
    from pyspark.sql import functions as F

    image = glyphs("#e8dfd0", 6)
    image[:, 300:] = glyphs("#484f58")[:, 300:]
    parts = F.explode(F.array(F.lit(0), F.lit(300))).alias("r_left")
    rows = contrast.measure(images_of(spark, [image]).select("*", parts).withColumns({"r_top": F.lit(-5), "r_width": F.lit(300), "r_height": F.lit(900)}), regions=True).orderBy("left").collect()
    assert [(r["left"], r["top"], r["width"], r["height"], r["verdict"]) for r in rows] == [(0, 0, 300, 300, "clean"), (300, 0, 300, 300, "failing")]
