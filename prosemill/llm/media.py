"""Media columns: payloads as 8-bit WAV, read by the wave module, and audio fingerprints of them.

The fingerprint is made of pairs of spectral peaks: the short-time Fourier transform of the samples
gives at most one peak in each band of a frame, and each peak is paired with the next few. A pair is
one integer: the time of its first peak, then both frequencies and the distance in time.
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

from prosemill.llm.common import parts_of, pick, texts_in

UNIT = 64
RATE = 8000
FRAME, HOP = 256, 128
#: A frame has one peak at most in each of these bands of Fourier bins.
BANDS = ((1, 8), (8, 24), (24, 64), (64, 129))
FAN, FARTHEST = 5, 31
#: Frames that are transformed at once.
BLOCK = 2048
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload(text: str) -> bytes:
    """UTF-8, filled with zero bytes up to a positive multiple of UNIT."""
    data = text.encode()
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored)) as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("expected one channel of 8-bit samples")
        return w.readframes(w.getnframes())


def spectral_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame and frequency bin of each peak: the strongest bin of its band that is no weaker than
    the same bin one frame before and after. Frames are transformed in blocks, so memory doesn't
    grow with the length."""
    x = np.frombuffer(samples, np.uint8)
    if len(x) < FRAME:
        x = np.concatenate((x, np.full(FRAME - len(x), 128, np.uint8)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    at, when, where = 0, [], []
    while at < len(frames):
        to = min(at + BLOCK, len(frames))
        low, high = max(0, at - 1), min(len(frames), to + 1)
        power = np.abs(np.fft.rfft((frames[low:high].astype(np.float32) - 128) * _WINDOW, axis=1))
        rows = np.arange(at - low, to - low)
        for a, b in BANDS:
            best = power[at - low : to - low, a:b].argmax(axis=1) + a
            own = power[rows, best]
            peak = own > 1e-3
            peak &= own >= power[np.maximum(rows - 1, 0), best]
            peak &= own >= power[np.minimum(rows + 1, len(power) - 1), best]
            when.append(rows[peak] + low)
            where.append(best[peak])
        at = to
    t, f = np.concatenate(when), np.concatenate(where)
    order = np.lexsort((f, t))
    return t[order], f[order]


def fingerprint(samples: bytes) -> np.ndarray:
    """Time-coded pairs, ascending: time << 24 | first bin << 16 | second bin << 8 | distance."""
    t, f = spectral_peaks(samples)
    out = []
    for k in range(1, FAN + 1):
        apart = t[k:] - t[:-k]
        ok = (apart > 0) & (apart <= FARTHEST)
        out.append((t[:-k][ok] << 24) | (f[:-k][ok] << 16) | (f[k:][ok] << 8) | apart[ok])
    return np.sort(np.concatenate(out)).astype(np.int64)


_DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def _row(text: str) -> tuple[tuple, bytes, np.ndarray]:
    sent = payload(text)
    stored = to_wav(sent)
    read = from_wav(stored)
    marks = fingerprint(read)
    row = (
        len(text.encode()), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(),
    )
    return row, stored, marks


def media_columns(docs: DataFrame, full: bool = True) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, payload_bytes long, payload_sha256
    string, tail_crc32, media_bytes long, media_sha256, feature string; with ``full`` also media
    binary (the WAV file) and fingerprint array<long>.

    The payload is the text in UTF-8, filled with zero bytes to a positive multiple of 64; digests
    and features are of the bytes that wave reads back. feature is "frames:pairs:" and SHA-256 of
    the fingerprint's little-endian 64-bit integers. Null is empty: 64 zero bytes, no peaks. Equal
    texts give equal values. Texts of any length are taken whole; null and repeated doc_ids keep
    their rows; other columns are left behind; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, "text", 4 << 20):
            rows, stored, marks = zip(*[_row(t) for t in texts_in(batch, "text")], strict=True)
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            frames = [max(0, r[1] - FRAME) // HOP + 1 for r in rows]
            feature = [f"{n}:{len(m)}:{hashlib.sha256(m.astype('<i8').tobytes()).hexdigest()}" for n, m in zip(frames, marks, strict=True)]
            names = ["doc_id", *[c.split()[0] for c in _DIGEST.split(", ")], "feature"]
            columns = [batch.column(0), *columns, pa.array(feature)]
            if full:
                columns += [pa.array(stored, pa.binary()), pa.array(marks, pa.list_(pa.int64()))]
                names += ["media", "fingerprint"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id long, {_DIGEST}, feature string" + ", media binary, fingerprint array<long>" * full
    return pick(docs, doc_id="long", text="string").mapInArrow(run, schema)
