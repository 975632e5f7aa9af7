"""The contrast verdict of an image region: clean, failing or unverified, with everything that was left out.

One image is one row and one call: detection, folding and arbitration are order-dependent within an image and independent
across images, so nothing is shuffled, whatever the number of images. Each colour ends in exactly one channel: evaluated,
excluded, skipped, suspected_noise, background_region, panel_fill or merged. Ties go to what comes first in scan order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visparq import schema as S
from visparq import workers
from visparq.operators import kernels

WINDOW_FOLD, WINDOW_INK = (0.25, 0.98), (0.0, 1.0)
ENTRY = "struct<channel:string,hex:string,pixel_count:long,component_count:long,contrast_ratio:double,meets_aa:boolean,measured_against:string,into:string>"
COLOUR = "struct<hex:string,contrast_ratio:double>"
PLATEAU = "struct<hex:string,share:double,detection:string,largest_component_share:double>"
BARE = "struct<hex:string,share:double>"
FOUND = "struct<hex:string,contrast_ratio:double,pixel_count:long,component_count:long,mean_component_area:long,detected_plateau:boolean,plateau_share:double>"
DISAGREEMENT = "struct<global_all_meet_aa:boolean,local_all_meet_aa:boolean,local_failing_count:long,local_failing:array<string>>"
FIT = "struct<applicable:boolean,fraction:double,adequate:boolean>"
ROW = (
    f"image_id long, left int, top int, width int, height int, background string, background_model string, measurable boolean, verdict string, all_meet_aa boolean, evaluated_count long, failing_count long, passing_count long, "
    f"worst {COLOUR}, best {COLOUR}, entries array<{ENTRY}>, plateaus array<{PLATEAU}>, plateaus_without_text array<{BARE}>, fit {FIT}, reconciliation array<{FOUND}>, disagreement {DISAGREEMENT}, truncated boolean, notes array<string>, abstained array<string>"
)


@dataclass(frozen=True)
class Options:
    """``background``: an (r, g, b) to measure against; ``decorative``: hexes to leave out; ``local``: the tiled model."""

    background: tuple[int, int, int] | None = None
    local: bool = False
    large: bool = False
    tolerance: float = S.CLUSTER_TOLERANCE
    decorative: frozenset[str] = frozenset()
    include_decorative: bool = False
    floor: int = S.COLOUR_FLOOR
    plateaus: bool = True


Rgb = tuple[int, int, int]


def unpack(key: int) -> Rgb:
    return key >> 16 & 255, key >> 8 & 255, key & 255


def hexed(c: Rgb) -> str:
    return "#%02x%02x%02x" % tuple(c)


def d2(a: Rgb, b: Rgb) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def luminance(c: Rgb) -> float:
    v = [x / 255 for x in c]
    lin = [x / 12.92 if x <= 0.04045 else ((x + 0.055) / 1.055) ** 2.4 for x in v]
    return 0.2126 * lin[0] + 0.7152 * lin[1] + 0.0722 * lin[2]


def ratio(a: Rgb, b: Rgb) -> float:
    high, low = sorted((luminance(a), luminance(b)), reverse=True)
    return (high + 0.05) / (low + 0.05)


def two(x: float) -> float:
    return float(np.floor(x * 100 + 0.5) / 100)


def four(x: float) -> float:
    return float(np.floor(x * 10000 + 0.5) / 10000)


def on_line(x: Rgb, y: Rgb, bg: Rgb, window: tuple[float, float]) -> bool:
    """Whether x blends y into bg."""
    span = np.subtract(y, bg).astype(float)
    moved = span != 0
    if not moved.any():
        return False
    off = np.subtract(x, bg)
    t = float((off[moved] / span[moved]).mean())
    return window[0] < t < window[1] and float(np.sqrt(((off - t * span) ** 2).sum())) < 3


@dataclass
class Group:
    """Pieces of one colour: what is summed over them, and the member that stands for them."""

    rgb: Rgb
    against: Rgb
    distance: float
    pixels: int
    pieces: int = 1
    fill: float = 0.0
    structural: int = 0
    panels: int = 0
    boxes: int = 1
    merged: list = field(default_factory=list)

    def take(self, o: Group, lead: bool) -> None:
        """Add another group; with ``lead``, the more distant of the two stands for both."""
        self.pixels, self.pieces, self.boxes = self.pixels + o.pixels, self.pieces + o.pieces, self.boxes + o.boxes
        self.structural += o.structural
        if lead:
            self.fill, self.panels = self.fill + o.fill, self.panels + o.panels
            if o.distance > self.distance:
                self.rgb, self.against, self.distance = o.rgb, o.against, o.distance

    @property
    def all_structural(self) -> bool:
        return self.boxes > 0 and self.structural == self.boxes

    @property
    def mean(self) -> float:
        return self.pixels / self.pieces if self.pieces else 0.0


class Frame:
    """An image and the region that is measured."""

    def __init__(self, image: np.ndarray, region: tuple[float, float, float, float] | None = None):
        h, w = image.shape[:2]
        left, top, width, height = region or (0, 0, w, h)
        self.left, self.top = int(max(0, min(w - 1, np.floor(left)))), int(max(0, min(h - 1, np.floor(top))))
        self.width, self.height = int(max(1, min(w - self.left, np.floor(width)))), int(max(1, min(h - self.top, np.floor(height))))
        self.image = image
        self.part = image[self.top : self.top + self.height, self.left : self.left + self.width].astype(np.int32)
        self.keys = kernels.pack_rgb(self.part)
        self.area = self.width * self.height

    def within(self, c: Rgb, reach: float) -> np.ndarray:
        r, g, b = (self.part[..., k] - c[k] for k in range(3))
        return r * r + g * g + b * b <= reach * reach


# -- background -------------------------------------------------------------------------------------------------------
@dataclass
class Plateau:
    rgb: Rgb
    share: float
    detection: str
    largest: float
    size: int


def find_plateaus(f: Frame) -> list[Plateau]:
    """Flat fills: one dominant blob that is no ring, or several solid tiles of like size. Largest blob first, near colours once."""
    coarse = kernels.pack_rgb(f.part // S.PLATEAU_QUANT)
    labels = kernels.label4(coarse)
    box = kernels.boxes_of(labels)
    bucket = coarse.ravel()[box["label"]]
    out = []
    for b in dict.fromkeys(bucket.tolist()):
        own = np.flatnonzero(bucket == b)
        area, total = box["area"][own], int(box["area"][own].sum())
        if total / f.area < S.PLATEAU_SHARE:
            continue
        k = own[int(area.argmax())]
        x, y, w, h = (int(box[c][k]) for c in ("left", "top", "width", "height"))
        blob = labels == box["label"][k]
        key = kernels.modal(f.keys[blob])
        if (f.keys[blob] == key).sum() / area.max() < S.PLATEAU_FLATNESS:
            continue
        border = x == 0 or y == 0 or x + w == f.width or y + h == f.height
        hole = 0 if border else kernels.enclosed_hole(f.keys[y : y + h, x : x + w] == key)
        share = float(area.max()) / f.area
        blobby = share >= S.PLATEAU_SHARE and area.max() / total >= S.PLATEAU_DOMINANCE and (border or hole / (w * h) < S.RING_HOLE)
        fill = area / (box["width"][own] * box["height"][own])
        solid = area[(area / f.area >= S.PLATEAU_BLOB) & (fill >= S.SOLID_FILL)]
        # Variation of sizes (population deviation over mean) in whole numbers, so that the limit itself is met exactly.
        even = len(solid) * int((solid**2).sum()) - int(solid.sum()) ** 2 <= S.SIZE_VARIATION**2 * int(solid.sum()) ** 2
        tiled = len(solid) >= 2 and solid.sum() / f.area >= S.PLATEAU_SHARE and even
        if blobby or tiled:
            out.append(Plateau(unpack(key), 0.0, "dominant-blob" if blobby else "tiled", four(share), int(area.max())))
    kept: list[Plateau] = []
    for p in sorted(out, key=lambda p: -p.size):
        if all(d2(p.rgb, q.rgb) > S.PLATEAU_MERGE**2 for q in kept):
            kept.append(replace(p, share=four(float(f.within(p.rgb, S.PLATEAU_MERGE).mean()))))
    return kept


def tile_field(f: Frame) -> tuple[np.ndarray, np.ndarray]:
    """For each pixel of the region: the interpolated background and the noise, from tiles of the whole image."""
    t = S.TILE
    middle, noise = kernels.tile_noise(f.image, t, S.MAD_SCALE)
    ny, nx = noise.shape
    axis = lambda at, n: (lambda g: (np.clip(np.floor(g), 0, n - 1).astype(int), np.clip(np.floor(g) + 1, 0, n - 1).astype(int), g - np.floor(g)))(at / t - 0.5)
    xa, xb, wx = axis(np.arange(f.left, f.left + f.width), nx)
    ya, yb, wy = axis(np.arange(f.top, f.top + f.height), ny)
    at = lambda v, y, x: v[np.ix_(y, x)]
    wx3, wy3 = wx[None, :, None], wy[:, None, None]
    bg = (at(middle, ya, xa) * (1 - wx3) + at(middle, ya, xb) * wx3) * (1 - wy3) + (at(middle, yb, xa) * (1 - wx3) + at(middle, yb, xb) * wx3) * wy3
    return bg, np.maximum.reduce([at(noise, y, x) for y in (ya, yb) for x in (xa, xb)])


def fit_of(f: Frame, bg: Rgb) -> tuple[float, bool]:
    share = float(f.within(bg, S.FIT_TOLERANCE).mean())
    return float(np.floor(share * 1000 + 0.5) / 1000), share >= S.ADEQUATE_FIT


# -- inks -------------------------------------------------------------------------------------------------------------
def ink(f: Frame, bg: Rgb, plateaus: list[Plateau], local: bool) -> np.ndarray:
    if len(plateaus) >= 2:
        return ~np.logical_or.reduce([f.within(p.rgb, S.INK_THRESHOLD) for p in plateaus])
    if local:
        back, noise = tile_field(f)
        return np.sqrt(((f.part - back) ** 2).sum(-1)) > np.maximum(S.INK_THRESHOLD, S.NOISE_K * noise)
    return ~f.within(bg, S.INK_THRESHOLD)


@dataclass
class Piece:
    rgb: Rgb
    against: Rgb
    distance: float
    pixels: int
    fill: float
    structural: bool
    panel: bool


def pieces_of(f: Frame, bg: Rgb, plateaus: list[Plateau], o: Options) -> tuple[list[Piece], bool]:
    """Connected inks, each with its most distant colour; further inks within one become pieces of their own."""
    mask = ink(f, bg, plateaus, o.local)
    labels = kernels.label4(mask.astype(np.int8), mask)
    box = kernels.boxes_of(labels)
    big = np.flatnonzero(box["area"] >= S.MIN_INK_AREA)
    truncated = len(big) > S.MAX_COMPONENTS
    big = big[: S.MAX_COMPONENTS]
    flat = labels.ravel()
    kind, first, count = kernels.counted(np.where(flat >= 0, flat << 24 | f.keys.ravel(), -1))
    edge, stop = np.searchsorted(kind, box["label"][big] << 24), np.searchsorted(kind, (box["label"][big] + 1) << 24)
    multi = [p.rgb for p in plateaus] if len(plateaus) >= 2 else []
    pieces: list[Piece] = []
    waiting: list[tuple[Piece, list[tuple[int, int, float]]]] = []
    totals: dict[int, list[int]] = {}
    for k, a, z in zip(big, edge, stop, strict=True):
        order = a + np.argsort(first[a:z])
        colours = [(int(kind[j] & 0xFFFFFF), int(count[j])) for j in order]
        modal = max(colours, key=lambda c: c[1])[0]
        x, y, w, h, n = (int(box[c][k]) for c in ("left", "top", "width", "height", "area"))
        ref = _surround(f, mask, x, y, w, h, multi, unpack(modal)) if multi else bg
        often = [c for c, m in colours if m >= 2]
        key = max(often, key=lambda c: d2(unpack(c), ref)) if often else modal
        fill = n / (w * h)
        hollow, line = w >= 60 and h >= 60 and fill < 0.25, (w >= 60 and h <= S.THIN_SIDE) or (h >= 60 and w <= S.THIN_SIDE)
        piece = Piece(unpack(key), ref, d2(unpack(key), ref) ** 0.5, n, two(fill * 100) / 100, hollow or line, w >= 60 and h >= 60 and fill >= 0.5 and n >= 2000)
        pieces.append(piece)
        more = []
        for c, m in colours:
            rgb = unpack(c)
            if c == key or any(d2(rgb, p) <= S.PLATEAU_MERGE**2 for p in multi) or (m / f.area > S.REGION_SHARE and ratio(rgb, ref) < S.REGION_CONTRAST):
                continue
            blend = on_line(rgb, piece.rgb, ref, WINDOW_INK) or on_line(piece.rgb, rgb, ref, WINDOW_INK)
            t = totals.setdefault(c, [0, 0, 0])
            t[0], t[1], t[2] = t[0] + m, t[1] + 1, t[2] + m * blend
            more.append((c, m, d2(rgb, ref) ** 0.5))
        if more and w * h <= S.PARENT_BOX_SHARE * f.area:
            waiting.append((piece, more))
    for parent, more in waiting:
        for c, m, distance in more:
            total, met, blended = totals[c]
            if total >= o.floor and not 0 < blended < S.BLEND_PIXELS and total / met >= S.SECOND_INK_MEAN:
                pieces.append(Piece(unpack(c), parent.against, distance, m, parent.fill, parent.structural, False))
                parent.pixels = max(0, parent.pixels - m)
    return pieces, truncated


def _surround(f: Frame, mask: np.ndarray, x: int, y: int, w: int, h: int, plateaus: list[Rgb], own: Rgb) -> Rgb:
    """The modal colour around a component, without inks; if all around is ink, the plateau nearest to its own colour."""
    area = np.s_[max(0, y - 3) : y + h + 3, max(0, x - 3) : x + w + 3]
    quiet = f.keys[area][~mask[area]]
    return unpack(kernels.modal(quiet)) if len(quiet) else min(plateaus, key=lambda p: d2(p, own))


def clusters_of(pieces: list[Piece], tolerance: float) -> list[Group]:
    """Pieces by colour, then colours by nearness: the larger first, each to the first cluster whose lead is near."""
    groups: dict[Rgb, Group] = {}
    for p in pieces:
        g = Group(p.rgb, p.against, p.distance, p.pixels, 1, p.fill, int(p.structural), int(p.panel))
        groups[p.rgb].take(g, True) if p.rgb in groups else groups.update({p.rgb: g})
    out: list[Group] = []
    for g in sorted(groups.values(), key=lambda g: -g.pixels):
        near = next((c for c in out if d2(c.rgb, g.rgb) <= tolerance * tolerance), None)
        near.take(g, True) if near else out.append(g)
    return out


def independent(g: Group, parent: Group | None = None) -> bool:
    """Many pieces of real size: text of its own rather than the edges of other text."""
    return g.pieces >= S.TEXT_COMPONENTS and g.mean >= S.TEXT_MEAN and (parent is None or g.mean >= S.TEXT_PARENT_SHARE * parent.mean)


def fold(groups: list[Group], bg: Rgb) -> tuple[list[Group], list[tuple[Group, Group]]]:
    """Blends join the first larger, more distant colour on whose line to the background they lie."""
    kept: list[tuple[Group, bool]] = []
    joined = []
    for g in sorted(groups, key=lambda g: -(d2(g.rgb, bg) ** 0.5)):
        hollow = g.all_structural
        parent = None if hollow else next((k for k, other in kept if not other and g.pixels < k.pixels and not independent(g, k) and on_line(g.rgb, k.rgb, bg, WINDOW_FOLD)), None)
        if parent:
            joined.append((replace(g), parent))
            parent.take(g, False)
        else:
            kept.append((g, hollow))
    return [g for g, _ in kept], joined


# -- verdict ----------------------------------------------------------------------------------------------------------
def measure_region(image: np.ndarray, region: tuple | None = None, o: Options = Options()) -> dict:
    """One region's verdict and disclosures, as a row without image_id."""
    f = Frame(image, region)
    bg = o.background or unpack(kernels.modal(f.keys.ravel()))
    plateaus = find_plateaus(f) if o.plateaus else []
    multi = len(plateaus) >= 2
    pieces, truncated = pieces_of(f, bg, plateaus, o)
    clusters = clusters_of(pieces, o.tolerance)
    panels = [g for g in clusters if multi and g.panels and any(d2(p.rgb, g.rgb) <= S.PLATEAU_MERGE**2 for p in plateaus)]
    groups, joined = fold([g for g in clusters if not any(g is p for p in panels)], bg)
    required = 3.0 if o.large else 4.5
    entries, evaluated, notes = [], [], []

    def entry(g: Group, channel: str, into: Rgb | None = None) -> dict:
        raw = ratio(g.rgb, g.against)
        return {"channel": channel, "hex": hexed(g.rgb), "pixel_count": g.pixels, "component_count": g.pieces, "contrast_ratio": two(raw), "meets_aa": raw + 1e-9 >= required, "measured_against": hexed(g.against), "into": hexed(into) if into else None}

    for g in panels:
        entries.append(entry(g, "panel_fill"))
    for g, into in joined:
        entries.append(entry(g, "merged", into.rgb))
    for g in groups:
        if (hexed(g.rgb) in o.decorative or g.all_structural) and not o.include_decorative:
            entries.append(entry(g, "excluded"))
        elif g.pixels < o.floor:
            entries.append(entry(g, "skipped"))
        else:
            evaluated.append(g)
    evaluated.sort(key=lambda g: ratio(g.rgb, g.against))
    left = []
    for g in evaluated:
        raw, total = ratio(g.rgb, g.against), g.pixels / f.area
        wide = raw < S.REGION_CONTRAST and (g.mean / f.area > S.REGION_SHARE or (total > S.REGION_SHARE and g.fill / max(1, g.pieces) >= S.REGION_FILL))
        channel = "suspected_noise" if o.local and raw < S.NOISE_CEILING and not independent(g) else "background_region" if wide else "evaluated"
        entries.append(entry(g, channel))
        if channel == "evaluated":
            left.append(g)
    evaluated = left
    fraction, adequate = fit_of(f, bg)
    fit = {"applicable": not o.local and not multi, "fraction": None if multi else fraction, "adequate": None if multi else adequate}
    own = [e for e in entries if e["channel"] == "evaluated"]
    failing = [e for e in own if not e["meets_aa"]]
    # A plateau that no evaluated colour was measured against: nothing is claimed about text on it.
    met = {g.against for g in evaluated}
    bare = [p for p in plateaus if multi and not any(d2(p.rgb, c) <= S.PLATEAU_MERGE**2 for c in met)]
    if bare:
        notes.append("no assessed text on plateaus: " + ", ".join(f"{hexed(p.rgb)} {100 * p.share:.1f}%" for p in bare) + "; that is not a claim that such text passes")
    out = {
        "left": f.left, "top": f.top, "width": f.width, "height": f.height, "background": hexed(bg), "background_model": "multi-plateau" if multi else "local" if o.local else "global", "measurable": bool(own), "verdict": "unverified", "all_meet_aa": None, "evaluated_count": len(own), "failing_count": len(failing), "passing_count": len(own) - len(failing), "worst": None, "best": None, "entries": entries,
        "plateaus": [{"hex": hexed(p.rgb), "share": p.share, "detection": p.detection, "largest_component_share": p.largest} for p in plateaus], "plateaus_without_text": [{"hex": hexed(p.rgb), "share": float(np.floor(p.share * 1000 + 0.5) / 1000)} for p in bare], "fit": fit, "reconciliation": [], "disagreement": None, "truncated": truncated, "notes": notes, "abstained": [],
    }
    if o.plateaus and (panels or multi):
        out["reconciliation"] = _unmasked(image, region, o, own, plateaus)
        if out["reconciliation"]:
            notes.append("masking a background also removed colours that measure as failing: " + ", ".join(f"{r['hex']} at {r['contrast_ratio']}" for r in out["reconciliation"]))
    if not own:
        only = {e["channel"] for e in entries}
        why = "only decorative geometry" if "excluded" in only and "skipped" not in only else "only suspected noise" if "suspected_noise" in only and not only & {"excluded", "skipped"} else "no assessable colour"
        return out | {"abstained": [f"contrast of text: {why}"]}
    end = lambda e: {"hex": e["hex"], "contrast_ratio": e["contrast_ratio"]}
    clean = not failing
    out |= {"worst": end(own[0]), "best": end(own[-1]), "all_meet_aa": clean, "verdict": "clean" if clean else "failing"}
    if failing:
        notes.append(f"{len(failing)} of {len(own)} colours fail: " + ", ".join(e["hex"] for e in failing))
    if o.local or multi or o.background:
        return out
    return _arbitrate(image, region, o, out, clean, adequate)


def _unmasked(image: np.ndarray, region: tuple | None, o: Options, own: list[dict], plateaus: list[Plateau]) -> list[dict]:
    """Failing colours of a pass without plateaus that the masked pass does not show, with the evidence on each."""
    plain = measure_region(image, region, replace(o, plateaus=False, background=None, local=False))
    shown, out = {e["hex"] for e in own}, []
    for e in plain["entries"]:
        if e["channel"] == "evaluated" and not e["meets_aa"] and e["hex"] not in shown:
            rgb = tuple(int(e["hex"][k : k + 2], 16) for k in (1, 3, 5))
            p = next((p for p in plateaus if d2(p.rgb, rgb) <= S.PLATEAU_MERGE**2), None)
            out.append({"hex": e["hex"], "contrast_ratio": e["contrast_ratio"], "pixel_count": e["pixel_count"], "component_count": e["component_count"], "mean_component_area": int(np.floor(e["pixel_count"] / max(1, e["component_count"]) + 0.5)), "detected_plateau": p is not None, "plateau_share": p.share if p else None})
    return out


def _arbitrate(image: np.ndarray, region: tuple | None, o: Options, out: dict, clean: bool, adequate: bool) -> dict:
    """A clean verdict must hold under the tiled model; one on an ill-fitting background must find text there at all."""
    if not clean and adequate:
        return out
    tiled = measure_region(image, region, replace(o, local=True, background=None))
    failing = [e for e in tiled["entries"] if e["channel"] == "evaluated" and not e["meets_aa"]]
    if clean and tiled["measurable"]:
        rgb = lambda h: tuple(int(h[k : k + 2], 16) for k in (1, 3, 5))
        away = [(e, d2(rgb(e["hex"]), rgb(e["measured_against"]))) for e in failing]
        decisive = [e for e, d in away if d > 0]
        if decisive:
            named = [e for e, d in away if d > S.PLATEAU_MERGE**2] or decisive
            out |= {"verdict": "unverified", "all_meet_aa": None, "disagreement": {"global_all_meet_aa": True, "local_all_meet_aa": tiled["all_meet_aa"], "local_failing_count": len(named), "local_failing": [e["hex"] for e in named]}}
            out["notes"].append("the tiled background model finds failing colours: " + ", ".join(e["hex"] for e in named))
        elif failing:
            out["notes"].append("the tiled background model could not tell the failing colours from their background")
    if out["all_meet_aa"] is not True and not adequate:
        if not tiled["measurable"]:
            for e in out["entries"]:  # what stood for text is the background's own ramp
                e["channel"] = "background_region" if e["channel"] == "evaluated" else e["channel"]
            return out | {"measurable": False, "verdict": "unverified", "all_meet_aa": None, "evaluated_count": 0, "failing_count": 0, "passing_count": 0, "worst": None, "best": None, "disagreement": None, "abstained": ["contrast of text: one background does not explain the region, and the tiled model finds no text"]}
        out["disagreement"] = {"global_all_meet_aa": False, "local_all_meet_aa": tiled["all_meet_aa"], "local_failing_count": len(failing), "local_failing": [e["hex"] for e in failing]}
        out["notes"].append("one background does not explain the region: prefer the tiled model")
    return out


def measure(images: DataFrame, options: Options = Options(), regions: bool = False) -> DataFrame:
    """One row per image; with ``regions``, one per row of ``images``, whose r_left, r_top, r_width and r_height name a part.

    The part that was measured comes back, clamped, as left, top, width and height.
    """
    workers.bounded(images.sparkSession)
    columns = ["image_id", "width", "height", "data", *(["r_left", "r_top", "r_width", "r_height"] if regions else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)
                region = (r.r_left, r.r_top, r.r_width, r.r_height) if regions else None
                rows.append({"image_id": r.image_id} | measure_region(image, region, options))
            if rows:
                yield pd.DataFrame(rows)

    return images.select(*columns).where("data IS NOT NULL").mapInPandas(run, ROW)


def colours(measured: DataFrame) -> DataFrame:
    """One row per colour and channel."""
    return measured.select("image_id", F.explode("entries").alias("e")).select("image_id", "e.*")
