"""Audio features of stored media.

Bytes are stored as 8-bit mono PCM in a RIFF/WAVE container, losslessly. The stored form is read back, resampled by a
polyphase filter, cut into overlapping frames and turned into log-mel energies. These are stored as Arrow tensors of one fixed shape,
(FRAMES, MELS) of float16, each with its time span: an Arrow stream of rows (start_ms, end_ms, tensor), whose schema names the shape, so
any Arrow reader gets tensors back (``tensor_table``). A hysteresis over frame energies (on above the high, off below the low
threshold, which are quantiles of the clip) gives the active spans.

Each clip is computed alone, with the same steps whatever its batch, so equal payloads have equal features. A clip goes through resampling
and the filterbank in pieces of ``CHUNK`` frames, so beside its stored form and its tensors (a quarter of that) a long one needs no
more than a short one. A task holds at most ``BATCH_BYTES`` of finished clips, or one.

Defined results: a null payload is empty; an empty one is padded to one block of 576 bytes 255; a clip shorter than a frame is one frame; the
last tensor of a clip is filled up with silence; in a clip of even energy nothing is active, as it never rises above its own quantile; repeated
rows and ties get equal values; texts of any length are stored whole; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.common import text_of, trim

BLOCK = 576
HEADER = 44
RATE, TARGET = 24_000, 16_000
UP, DOWN = 2, 3
FRAME, HOP, FFT = 400, 160, 512
FRAMES, MELS = 16, 32
CHUNK = 4096
BATCH_BYTES, BATCH_ROWS = 1 << 23, 256
SCHEMA = "doc_id bigint, n_bytes bigint, media binary, tensors binary, n_tensors int, spans array<struct<start_ms: double, end_ms: double>>"


def header(n: int) -> bytes:
    """The first 44 bytes of the stored form of ``n`` 8-bit samples (an even number)."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def to_wav(payload: bytes) -> bytes:
    """The stored form: a 44-byte header and the bytes as 8-bit samples."""
    return header(len(payload)) + payload


def from_wav(media: bytes) -> tuple[int, memoryview]:
    """(rate, samples) of a stored form, whatever chunks stand before its data."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at < len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        if kind == b"data":
            return rate, memoryview(media)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def stored(text: str) -> tuple[int, bytes]:
    """(bytes of the text, its stored form): the payload is filled up with 255 to whole blocks, one at least."""
    raw = text.encode("utf-8", "surrogatepass")
    whole = max(1, -(-len(raw) // BLOCK)) * BLOCK
    return len(raw), b"".join([header(whole), raw, b"\xff" * (whole - len(raw))])


def _phases(zeros: int = 6) -> list[np.ndarray]:
    """The low-pass filter (windowed sinc at the lower Nyquist rate), dealt to the UP phases."""
    half = zeros * DOWN
    t = np.arange(-half, half + 1) / DOWN
    h = np.sinc(t) * np.hanning(2 * half + 3)[1:-1]
    h *= UP / h.sum()
    return [h[p::UP] for p in range(UP)]


_PHASES = _phases()


HALF = (sum(map(len, _PHASES)) - 1) // 2


def resampled_length(n: int) -> int:
    return -(-n * UP // DOWN)


def resample(samples: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Outputs [lo, hi) at TARGET of 8-bit samples at RATE: output m is the filter's phase (m * DOWN) % UP over the inputs around m * DOWN / UP."""
    out = np.zeros(hi - lo)
    for shift in range(UP):
        m = np.arange(lo + shift, hi, UP)
        if not len(m):
            continue
        position = int(m[0]) * DOWN + HALF  # in the filter's own time
        phase, base = _PHASES[position % UP], position // UP
        first, end = base - len(phase) + 1, base + DOWN * (len(m) - 1) + 1
        held = np.zeros(end - first)  # silence before and after the clip
        a, b = max(first, 0), min(end, len(samples))
        if a < b:
            held[a - first : b - first] = (samples[a:b].astype(np.float64) - 128) / 128
        acc = np.zeros(len(m))
        for k, c in enumerate(phase):
            at = base - k - first
            acc += c * held[at : at + DOWN * (len(m) - 1) + 1 : DOWN]
        out[shift::UP] = acc
    return out


def _filterbank() -> np.ndarray:
    """Triangles, evenly spaced in mel, over the bins of the transform."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40), mel(TARGET / 2), MELS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * TARGET / FFT
    rise = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


_BANK = _filterbank()
_WINDOW = np.hanning(FRAME + 1)[:-1]


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel energies of each frame, its energy in dB) of a stretch of whole frames."""
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    frames = (frames - frames.mean(axis=1, keepdims=True)) * _WINDOW
    power = np.abs(np.fft.rfft(frames, FFT)) ** 2
    return np.log(power @ _BANK + 1e-6), 10 * np.log10((frames**2).mean(axis=1) + 1e-9)


def active(energy: np.ndarray, low: float = 0.4, high: float = 0.6) -> list[tuple[int, int]]:
    """Spans of frames [start, end) that begin above the high quantile and last until one falls below the low one."""
    lo, hi = np.quantile(energy, [low, high])
    mark = np.where(energy > hi, 1, np.where(energy < lo, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[np.maximum(last, 0)], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


TENSOR = pa.fixed_shape_tensor(pa.float16(), [FRAMES, MELS])
TENSORS = pa.schema([("start_ms", pa.float64()), ("end_ms", pa.float64()), ("tensor", TENSOR)])
MS = 1000 / TARGET


def features(media: bytes) -> tuple[bytes, int, list[tuple[float, float]]]:
    """(Arrow stream of tensors with their spans, their number, active spans in ms) of a stored form."""
    rate, data = from_wav(media)
    if rate != RATE:
        raise ValueError(f"made for {RATE} Hz")
    samples = np.frombuffer(data, np.uint8)
    length = resampled_length(len(samples))
    frames = max(0, length - FRAME) // HOP + 1
    energy, sink, n = [], pa.BufferOutputStream(), 0
    with pa.ipc.new_stream(sink, TENSORS) as stream:
        for lo in range(0, frames, CHUNK):
            hi = min(frames, lo + CHUNK)
            end = (hi - 1) * HOP + FRAME
            y = resample(samples, lo * HOP, min(end, length))
            mels, e = log_mel(np.concatenate([y, np.zeros(end - lo * HOP - len(y))]))
            energy.append(e)
            k = -(-len(mels) // FRAMES)
            block = np.full((k * FRAMES, MELS), np.log(1e-6), "<f2")
            block[: len(mels)] = mels
            at = np.arange(n, n + k) * FRAMES * HOP * MS
            tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(block.reshape(k, FRAMES, MELS))
            stream.write_batch(pa.RecordBatch.from_arrays([pa.array(at), pa.array(at + ((FRAMES - 1) * HOP + FRAME) * MS), tensors], schema=TENSORS))
            n += k
    spans = [(a * HOP * MS, ((b - 1) * HOP + FRAME) * MS) for a, b in active(np.concatenate(energy))]
    return sink.getvalue().to_pybytes(), n, spans


def tensor_table(tensors: bytes) -> pa.Table:
    """(start_ms, end_ms, tensor) of a clip, the tensors as Arrow's fixed-shape tensors."""
    return pa.ipc.open_stream(tensors).read_all()


def media_columns(docs: DataFrame) -> DataFrame:
    """Stored forms of all texts with their tensors (see ``tensor_table``) and active spans."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))]
    schema = pa.schema(list(zip(["doc_id", "n_bytes", "media", "tensors", "n_tensors", "spans"], kinds, strict=True)))

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                n, media = stored(batch.column(1)[i].as_py())
                tensors, k, spans = features(media)
                rows.append((batch.column(0)[i].as_py(), n, media, tensors, k, [{"start_ms": a, "end_ms": b} for a, b in spans]))
                held += len(media) + len(tensors)
                if held > BATCH_BYTES or len(rows) == BATCH_ROWS:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)
        trim()

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, SCHEMA)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's stored form, read back, and of its features."""
    rows = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    payload = F.substring(F.col("media"), F.lit(HEADER + 1), F.octet_length("media"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start_ms"].cast("string"), s["end_ms"].cast("string"))), ",")
    return rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring("media", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.col("n_tensors").cast("string"), F.sha2("tensors", 256), F.sha2(spans, 256)).alias("feature"),
    )
