"""Images as files: encoded and decoded rows, feedback files, crops, and the picture of a difference."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


PNG = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # by colour type; alpha is dropped, gray repeated


def encode_png(image: np.ndarray) -> bytes:
    """An 8-bit RGB picture, rows unfiltered."""
    h, w, _ = image.shape
    rows = np.zeros((h, 1 + 3 * w), np.uint8)
    rows[:, 1:] = image.reshape(h, -1)
    parts = ((b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)), (b"IDAT", zlib.compress(rows.tobytes(), 6)), (b"IEND", b""))
    return PNG + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


def _unfiltered(raw: bytes, h: int, width: int, step: int) -> np.ndarray:
    """The rows of a PNG, each undone by its filter: left, up, their mean, or the nearest of left, up and corner."""
    rows, above = np.frombuffer(raw, np.uint8).reshape(h, 1 + width), np.zeros(width, np.int32)
    out = np.empty((h, width), np.uint8)
    for y, row in enumerate(rows):
        kind, line = int(row[0]), row[1:].astype(np.int32)
        if kind == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0).ravel() & 255
        elif kind == 2:
            line = line + above & 255
        elif kind in (3, 4):
            done = [0] * step + line.tolist()
            up, corner = above.tolist(), [0] * step + above.tolist()
            for i in range(width):
                a, b, c = done[i], up[i], corner[i]
                near = (a + b) // 2 if kind == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                done[i + step] = done[i + step] + near & 255
            line = np.array(done[step:], np.int32)
        out[y], above = line, line
    return out


def decode(content: bytes | None) -> tuple[np.ndarray | None, str | None]:
    """The picture, or why there is none: empty, not_an_image, unsupported (a format or kind that other readers decode) or
    truncated. 8-bit PNG without interlacing and 24-bit BMP are decoded here; ``rasters.read_images`` reads more kinds."""
    if not content:
        return None, "empty"
    try:
        if content.startswith(PNG):
            at, data, head = 8, b"", None
            while at < len(content):
                size, kind = struct.unpack(">I4s", content[at : at + 8])
                body = content[at + 8 : at + 8 + size]
                if len(body) < size or zlib.crc32(kind + body) != struct.unpack(">I", content[at + 8 + size : at + 12 + size])[0]:
                    return None, "truncated"
                head, data, at = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head, data + body if kind == b"IDAT" else data, at + 12 + size
                if kind == b"IEND":
                    break
            else:
                return None, "truncated"
            w, h, depth, colour, _, _, interlaced = head
            if depth != 8 or interlaced or colour not in CHANNELS:
                return None, "unsupported"
            n = CHANNELS[colour]
            px = _unfiltered(zlib.decompress(data), h, w * n, n).reshape(h, w, n)
            return (px[..., :3] if n >= 3 else np.repeat(px[..., :1], 3, 2)), None
        if content.startswith(b"BM"):
            first, w, h, depth = struct.unpack("<I", content[10:14])[0], *struct.unpack("<ii", content[18:26]), struct.unpack("<H", content[28:30])[0]
            if depth != 24:
                return None, "unsupported"
            line = (3 * w + 3) // 4 * 4
            px = np.frombuffer(content, np.uint8, abs(h) * line, first).reshape(abs(h), line)[:, : 3 * w].reshape(abs(h), w, 3)[..., ::-1]
            return (px[::-1] if h > 0 else px), None
    except (struct.error, ValueError, zlib.error, TypeError):
        return None, "truncated"
    known = content.startswith((b"\xff\xd8\xff", b"GIF8")) or content.startswith(b"RIFF") and content[8:12] == b"WEBP"
    return None, "unsupported" if known else "not_an_image"


def decode_images(rows: DataFrame) -> DataFrame:
    """image_id, width, height, data, error of encoded images (image_id, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [decode(c) for c in b.column("content").to_pylist()]
            size = lambda k: pa.array([None if p is None else p.shape[k] for p, _ in own], pa.int32())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([b.column("image_id"), size(1), size(0), pa.array([None if p is None else p.tobytes() for p, _ in own], pa.binary()), pa.array([e for _, e in own], pa.string())], names=["image_id", "width", "height", "data", "error"])

    return rows.select("image_id", "content").mapInArrow(run, "image_id long, width int, height int, data binary, error string")


def crop(images: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    """The part of each image under a box, clamped to the image, one pixel at least; images without pixels stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["data"] is None or not r["width"] or not r["height"]:
                    out.append((r["width"], r["height"], r["data"]))
                    continue
                x, y = min(max(0, left), r["width"] - 1), min(max(0, top), r["height"] - 1)
                part = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)[y : max(y + 1, top + height), x : max(x + 1, left + width)]
                out.append((part.shape[1], part.shape[0], part.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("image_id"), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary())))], names=["image_id", "width", "height", "data"])

    return images.select("image_id", "width", "height", "data").mapInArrow(run, "image_id long, width int, height int, data binary")


def feedback(images: DataFrame, now_ms: int, suffix: str = "") -> DataFrame:
    """image_id, name, content: one file a row, named by time and a number of its own; write it with any binary sink."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = [encode_png(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("image_id"), pa.array(content, pa.binary())], names=["image_id", "content"])

    made = images.select("image_id", "width", "height", "data").mapInArrow(run, "image_id long, content binary")
    name = F.concat(F.lit(f"{now_ms}-"), F.substring(F.sha2("content", 256), 1, 32), F.lit(f"-{suffix}" if suffix else ""), F.lit(".png"))
    return made.select("image_id", name.alias("name"), "content")


def difference(pairs: DataFrame, threshold: int = 15) -> DataFrame:
    """image_id, width, height, data, changed: equal-sized pairs (data, other); changed pixels red, the rest dimmed."""
    most = 3 * (threshold or 15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, changed = [], []
            for r in b.to_pylist():
                one, two = (np.frombuffer(r[c], np.uint8).reshape(-1, 3).astype(np.int16) for c in ("data", "other"))
                hit = np.abs(one - two).sum(1) > most
                out = (one // 3).astype(np.uint8)
                out[hit] = (255, 0, 0)
                data.append(out.tobytes())
                changed.append(int(hit.sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("image_id", "width", "height")), pa.array(data, pa.binary()), pa.array(changed, pa.int64())], names=["image_id", "width", "height", "data", "changed"])

    same = pairs.where(F.length("data") == F.length("other"))
    return same.select("image_id", "width", "height", "data", "other").mapInArrow(run, "image_id long, width int, height int, data binary, changed long")
