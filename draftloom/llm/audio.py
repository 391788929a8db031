"""Telephony audio: companded and ADPCM bytes to resampled 16-bit PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, text_bytes

BLOCK = 64  # bytes of an ADPCM block: predictor (2), step index (1), reserved (1), then two samples a byte
MU_LAW, A_LAW, IMA_ADPCM = 7, 6, 17  # WAVE format tags


@cache
def mu_law_table() -> np.ndarray:
    """PCM of each mu-law code, by the segment rule of ITU-T G.711."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)
    return np.where(code & 0x80, 0x84 - size, size - 0x84).astype(np.int16)


@cache
def a_law_table() -> np.ndarray:
    """PCM of each A-law code, by the segment rule of ITU-T G.711."""
    code = np.arange(256) ^ 0x55
    segment, low = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


# The step sizes and index changes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130,
    143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282,
    1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
    10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


@cache
def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Change of the predictor and next step index, by step index * 16 + code."""
    code, step = np.arange(16, dtype=np.int32), STEPS[:, None]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    after = np.clip(np.arange(len(STEPS), dtype=np.int32)[:, None] + INDEX_CHANGE[code & 7], 0, len(STEPS) - 1)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), (after * 16).astype(np.int32).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, BLOCK) bytes to (n, 2 * BLOCK - 7) samples, one step over all blocks at a time. Index bytes over 88 count as 88."""
    change, after = _adpcm_tables()
    out = np.empty((2 * BLOCK - 7, len(blocks)), np.int16)
    predicted = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    at = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    out[0] = predicted
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for k, byte in enumerate(data):
        for half, code in enumerate((byte & 15, byte >> 4)):
            at += code
            predicted += change[at]
            np.clip(predicted, -32768, 32767, out=predicted)
            at = after[at]
            out[1 + 2 * k + half] = predicted
    return out.T


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """8 kHz to 16 kHz: each sample, then the mean (rounded down) of it and the next; the last stands twice."""
    out = np.empty(2 * len(pcm), "<i2")
    out[0::2] = pcm
    if len(pcm):
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        out[-1] = pcm[-1]
    return out


def wav_bytes(payload: bytes, tag: int = MU_LAW, rate: int = 8000) -> bytes:
    """A mono WAVE file whose data chunk is the payload, untouched."""
    align, bits, extra = (BLOCK, 4, struct.pack("<H", 2 * BLOCK - 7)) if tag == IMA_ADPCM else (1, 8, b"")
    per_block = 2 * BLOCK - 7 if tag == IMA_ADPCM else 1
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate * align // per_block, align, bits, len(extra)) + extra
    fact = struct.pack("<I", len(payload) // align * per_block)
    body = b"".join(name + struct.pack("<I", len(chunk)) + chunk + b"\0" * (len(chunk) & 1) for name, chunk in ((b"fmt ", fmt), (b"fact", fact), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def read_wav(stored: bytes) -> tuple[int, int, bytes]:
    """(format tag, rate, data) of a WAVE file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", stored, at + 8)
        elif name == b"data":
            return tag, rate, stored[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def decode(tag: int, data: bytes) -> np.ndarray:
    """8 kHz samples of a data chunk."""
    raw = np.frombuffer(data, np.uint8)
    if tag == MU_LAW:
        return mu_law_table()[raw]
    if tag == A_LAW:
        return a_law_table()[raw]
    if tag == IMA_ADPCM:
        return decode_adpcm(raw[: len(raw) // BLOCK * BLOCK].reshape(-1, BLOCK)).ravel()
    raise ValueError(f"format {tag}")


def decode_media(df: DataFrame, media_col: str = "media", out_col: str = "pcm") -> DataFrame:
    """Replace or add ``out_col``: 16 kHz little-endian 16-bit PCM of the 8 kHz mono WAVE files in ``media_col``.

    Null media gives null; what is not a WAVE file, or has another codec, gives null as well. Repeated rows stay.
    """

    def convert(batches: Iterator) -> Iterator:
        for media in batches:
            yield media.map(_to_pcm)

    @F.pandas_udf("binary")
    def to_pcm(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from convert(batches)

    return df.withColumn(out_col, to_pcm(media_col))


def _to_pcm(stored: bytes | None) -> bytes | None:
    if stored is None:
        return None
    try:
        tag, _, data = read_wav(bytes(stored))
        return resample_double(decode(tag, data)).tobytes()
    except (ValueError, struct.error):
        return None


def padded(data: bytes) -> bytes:
    """Bytes 0 are appended up to a positive multiple of BLOCK."""
    return data + b"\0" * (-len(data) % BLOCK if data else BLOCK)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


#: Bytes of text that are stored and decoded at a time, or one longer text.
CHUNK_BYTES = 1_000_000
MEDIA = "doc_id long, n_bytes long, media binary, pcm binary"


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, pcm: each text's bytes, padded, as mu-law samples of a WAVE file, and the resampled PCM that
    :func:`decode_media` makes of it. Row-wise; null texts are empty; repeated rows stay."""
    return small_batches(docs).select(F.col("doc_id").cast("long"), text_bytes().alias("data")).mapInArrow(_stored, MEDIA)


def text_audio_features(docs: DataFrame) -> DataFrame:
    """What :func:`text_media` stores, described. The two run in one worker, so that PCM, four times the text, is not moved.

    Row-wise: one row per document, also for repeated ids; null and empty texts give 64 bytes 0; very long texts are one
    file each; ``doc_id`` may be null; an empty table gives an empty result. feature: root mean square of the samples as mu-law
    and as A-law, and CRC-32 of the resampled PCM of the file and of the same bytes read as ADPCM. Other columns of
    ``docs`` are dropped.
    """
    return small_batches(docs).select(F.col("doc_id").cast("long"), text_bytes().alias("data")).mapInArrow(lambda batches: _features(_stored(batches)), FEATURES)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start, sizes = 0, pc.binary_length(batch.column(1)).to_pylist()
        while start < batch.num_rows:
            stop, size = start, 0
            while stop < batch.num_rows and (stop == start or size < CHUNK_BYTES):
                size += sizes[stop] + BLOCK
                stop += 1
            files = [wav_bytes(padded(t)) for t in batch.column(1).slice(start, stop - start).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(sizes[start:stop], pa.int64()), pa.array(files, pa.binary()), pa.array(map(_to_pcm, files), pa.binary())], ["doc_id", "n_bytes", "media", "pcm"])
            start = stop


def _features(stored: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FEATURES.split(", ")]
    for batch in stored:
        rows = _describe(*[c.to_pylist() for c in batch.columns])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], names)


_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def _rms(table: np.ndarray, counts: np.ndarray) -> int:
    """Of samples that are counted by code: no row of samples is held."""
    return int(np.sqrt((np.square(table.astype(np.int64)) * counts).sum() / counts.sum()))


def _describe(ids: list, sizes: list[int], files: list[bytes], pcm: list[bytes]) -> list[tuple]:
    payloads = [read_wav(f)[2] for f in files]
    blocks = decode_adpcm(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK))
    ends = np.cumsum([len(p) // BLOCK for p in payloads])
    rows = []
    for doc_id, size, file, payload, wide, end in zip(ids, sizes, files, payloads, pcm, ends, strict=True):
        counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
        adpcm = zlib.crc32(resample_double(blocks[end - len(payload) // BLOCK : end].ravel()))
        feature = f"mu_rms={_rms(mu_law_table(), counts)};a_rms={_rms(a_law_table(), counts)};mu_pcm16k={zlib.crc32(wide):08x};adpcm_pcm16k={adpcm:08x}"
        rows.append((doc_id, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(file), hashlib.sha256(file).hexdigest(), feature))
    return rows
