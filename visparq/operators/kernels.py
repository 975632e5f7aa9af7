"""Neighbourhood kernels on one raster: what relational operators cannot say without a join per step of a path."""

from __future__ import annotations

import numpy as np


def label4(keys: np.ndarray, valid: np.ndarray | None = None) -> np.ndarray:
    """4-connected regions of equal keys; each pixel gets the least linear index of its region, -1 where not valid.

    Runs along rows are joined to the runs under them; only distinct run pairs are walked one by one.
    """
    h, w = keys.shape
    cut = np.ones((h, w), bool)
    cut[:, 1:] = keys[:, 1:] != keys[:, :-1]
    if valid is not None:
        cut[:, 1:] |= valid[:, 1:] != valid[:, :-1]
    first = np.flatnonzero(cut)
    length = np.diff(np.append(first, h * w))
    run = np.repeat(np.arange(len(first)), length).reshape(h, w)
    # Two runs meet where either begins: looking at beginnings alone sees every pair.
    begins = cut[1:] | cut[:-1]
    y, x = np.nonzero(begins)
    above, below = run[y, x], run[y + 1, x]
    same = keys.ravel()[first[above]] == keys.ravel()[first[below]]
    if valid is not None:
        ok = valid.ravel()[first]
        same &= ok[above] & ok[below]
    parent = list(range(len(first)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    pairs = np.unique(above[same] * np.int64(len(first)) + below[same])
    for a, b in zip((pairs // len(first)).tolist(), (pairs % len(first)).tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    label = first[np.array([root(k) for k in range(len(parent))], np.int64)]
    if valid is not None:
        label = np.where(ok, label, -1)
    return np.repeat(label, length).reshape(h, w)


def runs(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of equal values."""
    start = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(flat)))


def counted(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, the place of each one's first appearance, and their counts; stretches are counted at once."""
    start, length = runs(flat)
    value, first, which = np.unique(flat[start], return_index=True, return_inverse=True)
    return value, start[first], np.bincount(which, length, len(value)).astype(np.int64)


def pack_rgb(image: np.ndarray) -> np.ndarray:
    c = image.astype(np.int32)
    return c[..., 0] << 16 | c[..., 1] << 8 | c[..., 2]


def modal(keys: np.ndarray) -> int:
    """The most frequent key; ties go to the one seen first."""
    value, first, count = counted(keys)
    return int(value[np.lexsort((first, -count))[0]])


def boxes_of(labels: np.ndarray) -> dict[str, np.ndarray]:
    """label, area, left, top, width, height and coordinate sums of each region, in order of label; counted by row runs."""
    h, w = labels.shape
    cut = np.ones((h, w), bool)
    cut[:, 1:] = labels[:, 1:] != labels[:, :-1]
    first = np.flatnonzero(cut)
    length = np.diff(np.append(first, h * w))
    own = labels.ravel()[first]
    first, length, own = first[own >= 0], length[own >= 0], own[own >= 0]
    if not len(own):
        return {k: np.zeros(0, np.int64) for k in ("label", "area", "left", "top", "width", "height", "sum_x", "sum_y")}
    y, x = first // w, first % w
    order = np.argsort(own, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], own[order][1:] != own[order][:-1])))
    over = lambda f, v: f.reduceat(v[order], edge)
    left, top = over(np.minimum, x), over(np.minimum, y)
    return {"label": own[order][edge], "area": over(np.add, length), "left": left, "top": top, "width": over(np.maximum, x + length) - left, "height": over(np.maximum, y) - top + 1, "sum_x": over(np.add, length * (2 * x + length - 1) // 2), "sum_y": over(np.add, length * y)}


def enclosed_hole(solid: np.ndarray) -> int:
    """Area of the largest gap that does not reach the border."""
    labels = label4(solid.astype(np.int8), ~solid)
    edge = np.concatenate([labels[0], labels[-1], labels[:, 0], labels[:, -1]])
    value, count = np.unique(labels[labels >= 0], return_counts=True)
    inner = count[~np.isin(value, edge)]
    return int(inner.max()) if len(inner) else 0


def upper_median(a: np.ndarray) -> np.ndarray:
    """The upper median along the last axis but one of (.., n, channels)."""
    return np.partition(a, a.shape[-2] // 2, axis=-2)[..., a.shape[-2] // 2, :]


def tile_noise(image: np.ndarray, tile: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Each tile's median colour (upper medians by channel) and noise: the median absolute deviation, about their own median,
    of the pixels' distances to that colour, scaled. All whole tiles are taken at once, then the edges'."""
    h, w = image.shape[:2]
    ny, nx = -(-h // tile), -(-w // tile)
    middle, noise = np.zeros((ny, nx, 3)), np.zeros((ny, nx))
    for ys, y0 in ((tile, 0), (h % tile, h // tile)):
        for xs, x0 in ((tile, 0), (w % tile, w // tile)):
            my, mx = (h // tile if ys == tile and not y0 else int(ys > 0)), (w // tile if xs == tile and not x0 else int(xs > 0))
            if not my or not mx:
                continue
            part = image[y0 * tile : y0 * tile + my * ys, x0 * tile : x0 * tile + mx * xs].astype(np.float64)
            px = part.reshape(my, ys, mx, xs, 3).swapaxes(1, 2).reshape(my, mx, ys * xs, 3)
            mid = upper_median(px)
            d = np.sqrt(((px - mid[:, :, None]) ** 2).sum(-1))[..., None]
            own = np.s_[y0 : y0 + my, x0 : x0 + mx]
            middle[own], noise[own] = mid, upper_median(np.abs(d - upper_median(d)[:, :, None]))[..., 0] * scale
    return middle, noise
