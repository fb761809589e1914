import hashlib
import zlib

import numpy as np

from prosemill.llm import media


def test_round_trip_and_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in media.media_columns(docs).collect():
        data = texts[r.doc_id].encode()
        fill = data + b"\0" * (64 - len(data) if len(data) < 64 else -len(data) % 64)
        assert media.from_wav(bytes(r.media)) == fill
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(data), len(fill), len(fill) + 44)
        assert r.payload_sha256 == hashlib.sha256(fill).hexdigest() and r.tail_crc32 == zlib.crc32(fill[-64:])
        assert r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert r.feature.split(":")[2] == hashlib.sha256(np.array(r.fingerprint, "<i8").tobytes()).hexdigest()


def test_tone_gives_its_bin():
    n = np.arange(8000)
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * n / media.RATE)).astype(np.uint8).tobytes()
    t, f = media.spectral_peaks(tone)
    assert np.bincount(f).argmax() == round(1000 * media.FRAME / media.RATE)


def test_blocks_do_not_matter():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, 64 * 9000, dtype=np.uint8).tobytes()
    whole = media.fingerprint(x)
    old, media.BLOCK = media.BLOCK, 100
    try:
        assert np.array_equal(media.fingerprint(x), whole)
    finally:
        media.BLOCK = old


def test_edges(spark):
    rows = [(None, ""), (1, None), (1, "é" * 32), (2, "x" * 65), (3, "y" * 300_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, Text int")
    got = sorted((r.n_bytes, r.payload_bytes, r.feature) for r in media.media_columns(df, full=False).collect())
    assert [g[:2] for g in got] == [(0, 64), (0, 64), (64, 64), (65, 128), (300_000, 300_032)]
    assert got[0] == got[1]
    assert media.media_columns(df.where("false")).count() == 0


def test_fingerprint_as_its_definition():
    """Brute force: a Fourier sum for every bin, peaks and pairs one by one."""
    rng = np.random.default_rng(7)
    n = np.arange(3000)
    tones = sum(40 * np.sin(2 * np.pi * f * n / media.RATE) for f in (300, 1200, 2500))
    x = np.clip(128 + tones + rng.normal(0, 8, len(n)), 0, 255).astype(np.uint8)
    k = np.arange(media.FRAME)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * k / (media.FRAME - 1))
    power = []
    for start in range(0, len(x) - media.FRAME + 1, media.HOP):
        frame = (x[start : start + media.FRAME].astype(float) - 128) * window
        power.append([abs((frame * np.exp(-2j * np.pi * b * k / media.FRAME)).sum()) for b in range(media.FRAME // 2 + 1)])
    peaks = []
    for t, own in enumerate(power):
        for a, b in media.BANDS:
            f = max(range(a, b), key=lambda i: own[i])
            around = [power[i][f] for i in (t - 1, t + 1) if 0 <= i < len(power)]
            if own[f] > 1e-3 and all(own[f] >= v for v in around):
                peaks.append((t, f))
    assert list(zip(*(v.tolist() for v in media.spectral_peaks(x.tobytes())))) == sorted(peaks)
    pairs = []
    for i, (t, f) in enumerate(sorted(peaks)):
        for u, g in sorted(peaks)[i + 1 : i + 1 + media.FAN]:
            if 0 < u - t <= media.FARTHEST:
                pairs.append(t << 24 | f << 16 | g << 8 | u - t)
    assert media.fingerprint(x.tobytes()).tolist() == sorted(pairs) and len(pairs) > 20
