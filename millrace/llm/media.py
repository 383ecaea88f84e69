"""Media columns: texts' bytes as WAV audio, and acoustic fingerprints of it.

A payload is stored as unsigned 8-bit mono samples through the wave module and read back through it. A
short-time Fourier transform gives a spectrum for each frame; in each frequency band of a frame the
strongest bin is a peak if it stands out from the frame; peaks are paired with later ones nearby. A pair is
the code (bin, later bin, distance in frames) at the time of its first peak, so a fingerprint is a list of
time-coded numbers. All of it is a function of the bytes: equal texts have equal rows.

Nulls count as empty texts, whose payload is 64 zero bytes. The samples' mean over the whole text is taken off before the transform.
Long texts are transformed in blocks of frames, so the memory for one text is a small multiple of its size.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import as_bytes, map_batches

RATE = 8000
FRAME, HOP = 128, 64
#: Bins at which a band of a frame's spectrum starts; the last one ends the last band.
BANDS = (1, 6, 13, 24, 40, 64)
#: A peak's magnitude is at least so many times the mean magnitude of its frame.
STANDS_OUT = 2.0
#: A peak pairs with the peaks of so many frames after its own.
REACH = 3
BLOCK_FRAMES = 4096

_window = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def padded(text: bytes, unit: int = 64) -> bytes:
    """text with zero bytes up to a positive multiple of unit."""
    return text.ljust(max(unit, -(-len(text) // unit) * unit), b"\0")


def peaks(samples: bytes) -> np.ndarray:
    """Strongest bin of each band for each frame, -1 where none stands out."""
    x = np.frombuffer(samples, np.uint8)
    frames = max(1, -(-len(x) // HOP))
    mean = x.mean(dtype=np.float64) if len(x) else 0.0
    found = np.empty((frames, len(BANDS) - 1), np.int32)
    for first in range(0, frames, BLOCK_FRAMES):
        count = min(BLOCK_FRAMES, frames - first)
        part = x[first * HOP : first * HOP + (count - 1) * HOP + FRAME]
        line = np.zeros((count - 1) * HOP + FRAME, np.float32)
        line[: len(part)] = part
        line[: len(part)] -= mean
        grid = np.lib.stride_tricks.sliding_window_view(line, FRAME)[::HOP]
        spectrum = np.abs(np.fft.rfft(grid * _window, axis=1))
        least = STANDS_OUT * spectrum[:, BANDS[0] : BANDS[-1]].mean(axis=1)
        for k, (low, high) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
            at = spectrum[:, low:high].argmax(axis=1)
            top = spectrum[np.arange(count), low + at]
            found[first : first + count, k] = np.where((top >= least) & (top > 0), low + at, -1)
    return found


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame and code of each pair of peaks, by frame, then code."""
    found = peaks(samples)
    times, codes = [], []
    for d in range(1, REACH + 1):
        if len(found) <= d:
            break
        a, b = found[:-d, :, None], found[d:, None, :]
        frame, i, j = np.nonzero((a >= 0) & (b >= 0))
        times.append(frame)
        codes.append((a[frame, i, 0].astype(np.int64) << 16) | (b[frame, 0, j].astype(np.int64) << 8) | d)
    if not times:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int64), c[order]


def time_coded(prints: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Fingerprints as one list of (frame, code) for each text."""
    ends = np.cumsum([0, *(len(codes) for _, codes in prints)])
    parts = [np.concatenate([p[k] for p in prints]) if prints else np.zeros(0, np.int64) for k in (0, 1)]
    rows = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in parts], ["frame", "code"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


PRINTS = "fingerprint array<struct<frame: int, code: int>>"


def with_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of df: the stored media, the payload read back, and its fingerprint as array<struct<frame, code>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [to_wav(padded(x)) for x in b.column(1).to_pylist()]
            payload = [from_wav(x) for x in media]
            prints = time_coded([fingerprint(x) for x in payload])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary()), pa.array(payload, pa.binary()), prints], names=[id_col, "media", "payload", "fingerprint"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, as_bytes(text_col)), run, f"{id_col} {kind}, media binary, payload binary, {PRINTS}")


def summary(text: bytes) -> tuple:
    """The digests of one text's media, and its fingerprint. feature: pairs, distinct codes, and a digest of frames and codes."""
    media = to_wav(padded(text))
    payload = from_wav(media)
    frames, codes = fingerprint(payload)
    marks = hashlib.sha256(np.concatenate([frames, codes]).astype("<i8").tobytes()).hexdigest()[:32]
    feature = f"{len(codes)}:{len(np.unique(codes))}:{marks}"
    return (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, (frames, codes))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of digests, and the fingerprint, for each row of df; media are dropped as soon as they are digested."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = list(zip(*map(summary, b.column(1).to_pylist()), strict=True)) or [()] * (len(names) + 1)
            columns = [pa.array(x, k) for x, k in zip(made[:-1], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, time_coded(list(made[-1]))], names=[id_col, *names, "fingerprint"])

    schema = ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds, strict=True))
    return map_batches(df.select(id_col, as_bytes(text_col)), run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, {schema}, {PRINTS}")
