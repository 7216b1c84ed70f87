"""Media columns: texts stored as WAV, read by the wave module, with spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, table

BLOCK = 64
RATE = 8000
FRAME, HOP = 128, 64
#: A peak is not below any cell so many frames and bins around it.
FRAMES, BINS = 4, 8
#: A cell below this magnitude, or this share of the loudest of its frame, is no peak.
QUIET, FAINT = 1e-3, 0.1
#: Peaks that each peak is paired with, and frames that lie between them at most.
FAN, REACH = 3, 63
CHUNK = 4096


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """One channel of 8-bit samples, each the byte itself."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("expected one channel of 8-bit samples")
        return w.readframes(w.getnframes())


def stft(samples: np.ndarray, frame: int = FRAME, hop: int = HOP, beside: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """Magnitudes of Hann-windowed frames, in blocks of CHUNK frames and ``beside`` more on either side where there are any;
    the first frame of each block goes along. The tail is padded with silence."""
    signal = (samples.astype(np.float32) - 128) / 128
    frames = max(1, -(-(len(signal) - frame) // hop) + 1)
    signal = np.pad(signal, (0, (frames - 1) * hop + frame - len(signal)))
    cut = np.lib.stride_tricks.sliding_window_view(signal, frame)[::hop]
    window = np.hanning(frame).astype(np.float32)
    for i in range(0, frames, CHUNK):
        first = max(0, i - beside)
        yield first, np.abs(np.fft.rfft(cut[first : i + CHUNK + beside] * window, axis=1))


def _greatest_around(x: np.ndarray, reach: int) -> np.ndarray:
    """The greatest value at most ``reach`` rows away, for each cell."""
    out = x.copy()
    for k in range(1, reach + 1):
        np.maximum(out[k:], x[:-k], out=out[k:])
        np.maximum(out[:-k], x[k:], out=out[:-k])
    return out


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the spectral peaks, in the order of time, then bin: cells that are not faint and not below any near one."""
    found = []
    for n, (first, block) in enumerate(stft(samples, beside=FRAMES)):
        block[:, 0] = 0
        most = _greatest_around(np.ascontiguousarray(_greatest_around(block, FRAMES).T), BINS).T
        t, f = np.nonzero((block > np.maximum(QUIET, FAINT * block.max(axis=1, keepdims=True))) & (block >= most))
        t = t + first
        own = (t >= n * CHUNK) & (t < (n + 1) * CHUNK)
        found.append((t[own], f[own]))
    t, f = (np.concatenate(c) for c in zip(*found))
    return t, f


def fingerprints(samples: np.ndarray) -> np.ndarray:
    """Peaks and pairs of near peaks by time: frame << 22 | bin << 14 | other bin << 6 | frames between (0: the peak itself)."""
    t, f = peaks(samples)
    found = [t << 22 | f << 14 | f << 6]
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        ok = (gap > 0) & (gap <= REACH)
        found.append((t[:-k] << 22 | f[:-k] << 14 | f[k:] << 6 | gap)[ok])
    return np.sort(np.concatenate(found))


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: the text's UTF-8, filled with bytes 0 to a positive multiple of 64, as WAV.

    Null text counts as empty (64 bytes 0). Rows stay as they are, repeated ones too; other columns are
    ignored. One row's text and media are in a worker at a time, besides one Arrow batch.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            media = [to_wav(x.ljust(max(BLOCK, -(-len(x) // BLOCK) * BLOCK), b"\0")) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(store, "doc_id long, n_bytes long, media binary")


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("fingerprints", pa.list_(pa.int64()))])


def media_features(media: DataFrame) -> DataFrame:
    """Read the media column of ``store_media``: digests of payload and media, and fingerprints.

    Silence has no peaks and so an empty array of fingerprints.
    """
    bounded_batches(media.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, n, stored in zip(*(c.to_pylist() for c in b.columns)):
                payload = from_wav(stored)
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), fingerprints(np.frombuffer(payload, np.uint8))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(MEDIA), MEDIA)], schema=MEDIA)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprints array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and the fingerprints themselves; feature is their number and digest."""
    found = media_features(store_media(table(spark, sf_dir, "documents")))
    feature = F.concat(F.size("fingerprints"), F.lit(":"), F.sha2(F.array_join("fingerprints", ","), 256))
    return found.select(*[c for c in found.columns if c != "fingerprints"], feature.alias("feature"), "fingerprints")


ORACLE_SQL = None
