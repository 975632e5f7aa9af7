"""Media columns: texts as 8-bit mono audio, and fixed-shape audio features with time spans.

The payload (UTF-8 bytes, padded with 255 to a positive multiple of 576) is stored losslessly as unsigned 8-bit PCM in a
WAV container, read back from the stored bytes, resampled by a polyphase filter (16 kHz to 8 kHz), framed with overlap,
turned into log-mel energies, pooled to a ``SLICES x MELS`` tensor, and cut into active segments by an energy gate with
hysteresis. The tensor is stored as an Arrow tensor message of that fixed shape (``tensor_of`` reads it), the segments as
time spans. Frames are made in blocks from the bytes they need: beside the recording's bytes and one energy a frame, memory
follows the block.

Defined cases: a null text is empty (one padded block); ids may be null or repeat; equal texts give equal values, since
nothing depends on a row's neighbours; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from visparq.llm._common import struct_to_batch, texts_of

UNIT, RATE, DOWN, TAPS = 576, 16_000, 2, 32
FRAME, HOP, FFT, MELS, SLICES, BLOCK = 200, 80, 256, 24, 8, 4096
#: Decibels over the quietest frame at which a segment opens and closes.
OPEN_DB, CLOSE_DB = 9.0, 6.0
ROW = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, n_frames long, tensor binary, segments array<struct<start_s:double,end_s:double>>"


def payload_of(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % UNIT or (UNIT if not raw else 0))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


@cache
def _filter() -> np.ndarray:
    """A windowed-sinc low pass at the lower rate's Nyquist frequency, of unit gain."""
    n = np.arange(TAPS) - (TAPS - 1) / 2
    h = np.sinc(n / DOWN) * np.hamming(TAPS)
    return (h / h.sum()).astype(np.float32)


def resample(payload: bytes, first: int, count: int) -> np.ndarray:
    """Samples ``first`` to ``first + count`` at the lower rate, by polyphase decimation: only these are computed, phase by phase
    of the filter, from the bytes under it; silence (128) lies beyond both ends."""
    low, size = DOWN * first - TAPS // 2, TAPS + DOWN * count
    line = np.full(size, 128, np.uint8)
    a, b = max(0, low), min(len(payload), low + size)
    if b > a:
        line[a - low : b - low] = np.frombuffer(payload, np.uint8, b - a, a)
    x = (line.astype(np.float32) - 128) / 128
    out = np.zeros(count, np.float32)
    for phase in range(DOWN):
        out += np.convolve(x[phase::DOWN], _filter()[phase::DOWN][::-1], "valid")[:count]
    return out


@cache
def _mel_bank() -> np.ndarray:
    """Triangles, evenly spaced in mel from 0 to the Nyquist frequency, over the bins of the transform."""
    top = 2595 * np.log10(1 + RATE / DOWN / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    freq = np.fft.rfftfreq(FFT, DOWN / RATE)[:, None]
    up, down = (freq - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - freq) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def frame_count(n_bytes: int) -> int:
    """Frames of a recording; one that is shorter than a frame is padded to one."""
    return 1 + max(0, -(-n_bytes // DOWN) - FRAME) // HOP


def log_mel(payload: bytes) -> Iterator[np.ndarray]:
    """Blocks of (frames, MELS) log energies."""
    n, length = frame_count(len(payload)), -(-len(payload) // DOWN)
    window = np.hanning(FRAME).astype(np.float32)
    for at in range(0, n, BLOCK):
        many = min(BLOCK, n - at)
        x = np.zeros((many - 1) * HOP + FRAME, np.float32)
        have = min(len(x), length - at * HOP)
        x[:have] = resample(payload, at * HOP, have)
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(frames * window, FFT)).astype(np.float32) ** 2
        yield np.log10(power @ _mel_bank() + 1e-6)


def features(payload: bytes) -> tuple[int, np.ndarray, list[tuple[float, float]]]:
    """Frames, the pooled tensor, and the active segments in seconds."""
    n, at = frame_count(len(payload)), 0
    sums, energy = np.zeros((SLICES, MELS)), np.empty(n)
    for block in log_mel(payload):
        np.add.at(sums, np.arange(at, at + len(block)) * SLICES // n, block)
        energy[at : at + len(block)] = 10 * block.mean(axis=1)
        at += len(block)
    tensor = sums / np.maximum(np.bincount(np.arange(n) * SLICES // n, minlength=SLICES), 1)[:, None]
    return n, np.round(tensor, 2).astype(np.float32), hysteresis(np.round(energy, 3))


def tensor_message(tensor: np.ndarray) -> bytes:
    """An Arrow tensor message: type, shape and values."""
    out = pa.BufferOutputStream()
    pa.ipc.write_tensor(pa.Tensor.from_numpy(np.ascontiguousarray(tensor)), out)
    return out.getvalue().to_pybytes()


def tensor_of(message: bytes) -> np.ndarray:
    return pa.ipc.read_tensor(pa.py_buffer(message)).to_numpy()


def hysteresis(energy: np.ndarray) -> list[tuple[float, float]]:
    """Segments that open at OPEN_DB over the quietest frame and close below CLOSE_DB, as (start, end) seconds."""
    floor = energy.min()
    state = np.where(energy >= floor + OPEN_DB, 1, np.where(energy < floor + CLOSE_DB, 0, -1))
    known = np.where(state >= 0, np.arange(len(state)), -1)
    last = np.maximum.accumulate(known)  # between the two thresholds the gate stays as it was
    on = np.where(last >= 0, state[last], 0)
    edge = np.diff(np.concatenate(([0], on, [0])))
    step, rate = HOP, RATE / DOWN
    return [(float(a * step / rate), float((b * step + FRAME - HOP) / rate)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def audio_columns(docs: DataFrame) -> DataFrame:
    """Every whole text as stored audio with features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                out = {n: [] for n in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "n_frames", "tensor", "segments")}
                for text in part.column("text").to_pylist():
                    raw = text.encode()
                    media = to_wav(payload_of(raw))
                    back = from_wav(media)
                    n, tensor, segments = features(back)
                    for k, v in zip(out, (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), media, n, tensor_message(tensor), [{"start_s": a, "end_s": b} for a, b in segments]), strict=True):
                        out[k].append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])))
                yield struct_to_batch({"doc_id": (part.column("doc_id").to_pylist(), pa.int64())} | {k: (v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    return texts_of(docs).mapInArrow(run, ROW)
