import hashlib
import tracemalloc
import zlib

import numpy as np
import oracle

from seriesloom.llm import media as m


def payload_of(text):
    raw = text.encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))


def as_samples(x):
    return np.clip(np.round(x * 127) + 128, 0, 255).astype(np.uint8)


def test_wav_round_trip():
    for text in ("", "abc", "é" * 400, "x" * 5760):
        n, media = m.stored(text)
        payload = payload_of(text)
        assert n == len(text.encode()) and media == m.to_wav(payload) and len(media) == 44 + len(payload)
        rate, samples = m.from_wav(media)
        assert rate == m.RATE and bytes(samples) == payload


def test_resample_keeps_a_tone_and_drops_what_the_target_cannot_hold():
    t = np.arange(24_000) / m.RATE
    tone = as_samples(np.sin(2 * np.pi * 1000 * t))
    y = m.resample(tone, 0, 16_000)
    want = np.sin(2 * np.pi * 1000 * np.arange(16_000) / m.TARGET) * 127 / 128
    assert np.abs(y - want)[200:-200].max() < 0.02
    high = m.resample(as_samples(np.sin(2 * np.pi * 11_000 * t)), 0, 16_000)
    assert np.abs(high)[200:-200].max() < 0.03
    assert m.resampled_length(1) == 1 and len(m.resample(np.ones(1, np.uint8), 0, 1)) == 1
    parts = [m.resample(tone, a, min(a + 777, 16_000)) for a in range(0, 16_000, 777)]
    assert (np.concatenate(parts) == y).all()  # to the last bit, however it is cut


def test_log_mel_peaks_at_the_tone():
    y = np.sin(2 * np.pi * 2000 * np.arange(8000) / m.TARGET)
    mels, energy = m.log_mel(y)
    assert mels.shape == (1 + (8000 - m.FRAME) // m.HOP, m.MELS) and len(energy) == len(mels)
    centre = (m._BANK * (np.arange(257) * m.TARGET / m.FFT)[:, None]).sum(0) / m._BANK.sum(0)
    assert abs(centre[mels[10].argmax()] - 2000) < 250


def test_hysteresis():
    e = np.array([0.0] * 10 + [10, 5, 5, 10, 5, 0, 5, 5] + [0] * 10)
    on = m.active(e, 0.3, 0.9)
    assert on and all(a < b for a, b in on) and all(e[a] > np.quantile(e, 0.9) for a, _ in on)
    assert m.active(np.ones(5)) == []


def test_tensors_are_arrow_tensors_of_one_shape_with_spans():
    tensors, n, spans = m.features(m.stored("some words " * 9000)[1])
    table = m.tensor_table(tensors)
    kind = table.schema.field("tensor").type
    assert len(table) == n and kind.shape == [16, 32] and kind.value_type == "halffloat"
    start, end = (table.column(c).to_numpy() for c in ("start_ms", "end_ms"))
    assert start[0] == 0 and np.allclose(np.diff(start), 160) and np.allclose(end - start, 175) and all(x < y for x, y in spans)
    assert table.column("tensor").combine_chunks().to_numpy_ndarray().shape == (n, 16, 32)


def direct(payload):
    """(log-mel frames, active spans) by the definitions: stuffed zeros and one convolution, sums of cosines, triangles, a loop of states."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    t = np.arange(-18, 19) / 3
    h = np.sinc(t) * np.hanning(39)[1:-1]
    h *= 2 / h.sum()
    up = np.zeros(2 * len(x))
    up[::2] = x
    y = np.convolve(up, h)[18 : 18 + 2 * len(x)][::3]
    if len(y) < 400:
        y = np.concatenate([y, np.zeros(400 - len(y))])
    frames = np.stack([y[i : i + 400] for i in range(0, len(y) - 399, 160)])
    frames = (frames - frames.mean(1, keepdims=True)) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 400))
    angle = 2 * np.pi * np.outer(np.arange(400), np.arange(257)) / 512
    power = (frames @ np.cos(angle)) ** 2 + (frames @ np.sin(angle)) ** 2
    mel = np.linspace(2595 * np.log10(1 + 40 / 700), 2595 * np.log10(1 + 8000 / 700), 34)
    edges = 700 * (10 ** (mel / 2595) - 1)
    bins = np.arange(257) * 16_000 / 512
    bank = np.stack([np.interp(bins, edges[k : k + 3], [0, 1, 0], left=0, right=0) for k in range(32)], 1)
    energy = 10 * np.log10((frames**2).mean(1) + 1e-9)
    lo, hi = np.quantile(energy, [0.4, 0.6])
    on, spans = False, []
    for i, e in enumerate([*energy, -np.inf]):
        if not on and e > hi:
            on = True
            spans.append([i * 10.0, None])
        elif on and (e < lo or i == len(energy)):
            on = False
            spans[-1][1] = (i - 1) * 10.0 + 25
    return np.log(power @ bank + 1e-6), spans


def test_whole_table_against_brute_force(spark):
    got = {r["doc_id"]: r for r in m.op3(spark, oracle.SF).collect()}
    full = {r["doc_id"]: r for r in m.media_columns(spark.read.parquet(f"{oracle.SF}/documents.parquet")).collect()}
    _, rows = oracle.duck("SELECT doc_id, text FROM documents")
    assert len(got) == len(full) == len(rows)
    by_text, same_spans = {}, 0
    for d, t in rows:
        payload, r, f = payload_of(t or ""), got[d], full[d]
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len((t or "").encode()), len(payload), len(payload) + 44)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media_sha256"] == hashlib.sha256(m.to_wav(payload)).hexdigest() == hashlib.sha256(f["media"]).hexdigest()
        text = ",".join(f"{s['start_ms']}-{s['end_ms']}" for s in f["spans"])
        assert r["feature"] == f"{f['n_tensors']}:{hashlib.sha256(f['tensors']).hexdigest()}:{hashlib.sha256(text.encode()).hexdigest()}"
        mels, spans = direct(payload)
        tensors = m.tensor_table(bytes(f["tensors"])).column("tensor").combine_chunks().to_numpy_ndarray().reshape(-1, 32)
        assert len(tensors) == -(-len(mels) // 16) * 16 and np.abs(tensors[: len(mels)] - mels).max() < 0.02
        assert (tensors[len(mels) :] == np.float16(np.log(1e-6))).all()
        same_spans += np.allclose([[s["start_ms"], s["end_ms"]] for s in f["spans"]], spans) if len(f["spans"]) == len(spans) else 0
        assert by_text.setdefault(t, r["feature"]) == r["feature"]
    assert same_spans >= 0.99 * len(rows)  # a frame at a quantile may fall on either side by rounding
    assert len(set(by_text.values())) > 0.99 * len(by_text)


def test_long_texts_take_little_more_than_their_stored_form():
    media = m.stored("some words of a long text " * 300_000)[1]
    tracemalloc.start()
    m.features(media)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * len(media) + (64 << 20), (peak, len(media))


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "é" * 300_000, 3)], "doc_id bigint, text string, media int")
    got = m.media_columns(docs).collect()
    assert sorted(r["n_bytes"] for r in got) == [0, 0, 0, 600_000] and len({bytes(r["tensors"]) for r in got}) == 2
    assert m.media_columns(docs.limit(0)).count() == 0
