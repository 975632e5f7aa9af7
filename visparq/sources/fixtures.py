"""The acceptance layout without its glyphs: page, boxes and one marker, with the truth that measurements must find."""

from __future__ import annotations

import numpy as np

from visparq.sources.rasters import paint

#: Fixed values of the layout: canvas, colours, boxes (label, x, y, width, height) and text bars (colour, x, baseline, size, letters).
CANVAS, PAGE, BORDER, MARKER = (1200, 760), "#1a1814", "#7fb3d5", "#ff7a00"
BOXES = [("DELTA", 40, 380, 250, 320), ("ECHO", 320, 380, 250, 320), ("FOXTROT", 600, 380, 250, 320), ("GOLF", 880, 380, 250, 320)]
WITH_MARKER = "ECHO"
TEXTS = [("#e8dfd0", 40, 90, 44, 9, 13.42), ("#484f58", 40, 170, 44, 9, 2.14), ("#a09588", 40, 245, 22, 19, 6.03), ("#1e1c18", 40, 320, 44, 20, 1.04)]


def layout(texts: bool = True, stroke: int = 3) -> np.ndarray:
    """Boxes as hollow borders; each letter stands as a bar of its size (fonts are not rasterised here)."""
    rects = []
    for _, x, y, w, h in BOXES:
        rects += [(x, y, w, stroke, BORDER), (x, y + h - stroke, w, stroke, BORDER), (x, y, stroke, h, BORDER), (x + w - stroke, y, stroke, h, BORDER)]
    x, y = next((x + w // 2, y + h // 2) for n, x, y, w, h in BOXES if n == WITH_MARKER)
    rects += [(x - 20, y - 4, 40, 8, MARKER), (x - 4, y - 20, 8, 40, MARKER)]
    if texts:
        for colour, left, base, size, letters, _ in TEXTS:
            rects += [(left + round(k * size * 0.62), base - size + size // 4, size // 4, size * 3 // 4, colour) for k in range(letters)]
    return paint(*CANVAS, PAGE, rects)


def owner_of(x: int, y: int) -> str | None:
    """The first box that holds a point."""
    return next((n for n, bx, by, w, h in BOXES if bx <= x < bx + w and by <= y < by + h), None)
