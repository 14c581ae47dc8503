"""Telephony audio: mu-law, A-law and IMA ADPCM in WAVE files, expanded to resampled PCM.

mu-law and A-law expand through 256-entry lookup tables built from the G.711 rule. ADPCM is
decoded step by step within a block, but in numpy across all blocks of a batch at once. The
resampler doubles or otherwise changes the rate by linear interpolation.

`store` wraps coded samples in a RIFF/WAVE file, losslessly; `read_back` takes them out of
the file's chunks again.

Defined cases: a null text counts as empty and is padded to one unit; equal texts give equal
files and features; rows with a null or repeated id are rows like others; columns of the input
named like an output are replaced; a long text is a file of its own slice, whole; an empty
table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from visitframe.llm.common import text_slices

RATE = 8000
#: Fixed values of the WAVE format: the tags of the three codings.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
#: Data bytes of an ADPCM block; four header bytes come on top.
BLOCK_DATA = 32
#: Payloads are padded to a multiple of this many bytes.
UNIT = 576

#: Fixed values of IMA ADPCM: index changes by nibble.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int64)
#: Fixed values of IMA ADPCM: the 89 quantiser steps.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
     107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
     876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871,
     5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623,
     27086, 29794, 32767],
    np.int64,
)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    low, exponent = (code & 15) << 4, code >> 4 & 7
    size = np.where(exponent == 0, low + 8, low + 0x108 << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of mono IMA blocks (n x (4 + data) bytes): n x (1 + 2 data) samples. One pass over
    the samples of a block, each step for all blocks at once."""
    value = blocks[:, 0:2].copy().view("<i2").ravel().astype(np.int64)
    index = np.clip(blocks[:, 2].astype(np.int64), 0, len(STEPS) - 1)
    data = blocks[:, 4:]
    out = np.empty((len(blocks), 1 + 2 * data.shape[1]), np.int16)
    out[:, 0] = value
    for k in range(2 * data.shape[1]):
        nibble = (data[:, k // 2] >> (4 * (k % 2)) & 15).astype(np.int64)
        step = STEPS[index]
        size = step >> 3
        size = size + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
        value = np.clip(np.where(nibble & 8, value - size, value + size), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[nibble], 0, len(STEPS) - 1)
        out[:, k + 1] = value
    return out


def store(payload: bytes, coding: str) -> bytes:
    """A mono WAVE file that holds payload byte for byte as coded samples."""
    data, align = payload, 1
    if coding == "adpcm":
        if len(payload) % BLOCK_DATA:
            raise ValueError(f"ADPCM payloads come in multiples of {BLOCK_DATA} bytes")
        blocks = np.zeros((len(payload) // BLOCK_DATA, 4 + BLOCK_DATA), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK_DATA)
        data, align = blocks.tobytes(), 4 + BLOCK_DATA
    per_block = 1 + 2 * BLOCK_DATA
    rate = RATE * align // per_block if coding == "adpcm" else RATE
    extra = struct.pack("<HH", 2, per_block) if coding == "adpcm" else struct.pack("<H", 0)
    head = struct.pack("<HHIIHH", TAGS[coding], 1, RATE, rate, align, 4 if coding == "adpcm" else 8) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data
    body += b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunks(media: bytes) -> dict[bytes, bytes]:
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    out, at = {}, 12
    while at + 8 <= len(media):
        (size,) = struct.unpack_from("<I", media, at + 4)
        out[media[at : at + 4]] = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return out


def read_back(media: bytes) -> tuple[str, np.ndarray]:
    """The coding and the coded bytes of a WAVE file; ADPCM as blocks with their headers."""
    parts = _chunks(media)
    tag, _, _, _, align, _ = struct.unpack_from("<HHIIHH", parts[b"fmt "])
    coding = {v: k for k, v in TAGS.items()}[tag]
    data = np.frombuffer(parts[b"data"], np.uint8)
    return coding, data.reshape(-1, align) if coding == "adpcm" else data


def payload_of(coding: str, data: np.ndarray) -> bytes:
    return data[:, 4:].tobytes() if coding == "adpcm" else data.tobytes()


def expand(coding: str, data: np.ndarray) -> np.ndarray:
    """16-bit PCM of coded bytes."""
    if coding == "adpcm":
        return decode_adpcm(data).ravel()
    return (MULAW if coding == "mulaw" else ALAW)[data]


def resample(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation from one rate to another, rounded down; the ends are held."""
    if rate == target or not len(pcm):
        return pcm
    wide = pcm.astype(np.int32)
    if target == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[::2] = pcm
        out[1:-1:2] = wide[:-1] + wide[1:] >> 1
        out[-1] = pcm[-1]
        return out
    at = np.arange(len(pcm) * target // rate) * (rate / target)
    return np.floor(np.interp(at, np.arange(len(pcm)), wide)).astype(np.int16)


def pcm_wave(pcm: np.ndarray, rate: int) -> bytes:
    data = pcm.astype("<i2").tobytes()
    head = struct.pack("<HHIIHH", 1, 1, rate, 2 * rate, 2, 16)
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def features(pcm: np.ndarray) -> str:
    """Samples, peak, mean square, zero crossings and checksum of PCM; integers throughout."""
    wide = pcm.astype(np.int64)
    sign = pcm < 0
    return (
        f"n={len(pcm)};peak={int(np.abs(wide).max())};ms={int((wide * wide).sum()) // len(pcm)};"
        f"zc={int(np.count_nonzero(sign[1:] != sign[:-1]))};crc={zlib.crc32(pcm.astype('<i2').tobytes())}"
    )


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    return raw + b"\xff" * (max(1, -(-len(raw) // unit)) * unit - len(raw))


def to_media(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, coding, media): each text as a WAVE file. The coding follows the
    text's checksum, so that equal texts get equal files."""
    picked = docs.select(id_col, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 1):
                raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
                coding = [("mulaw", "alaw", "adpcm")[zlib.crc32(r) % 3] for r in raw]
                media = [store(pad(r), c) for r, c in zip(raw, coding, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(r) for r in raw]), pa.array(coding), pa.array(media, pa.binary())],
                    names=[id_col, "n_bytes", "coding", "media"],
                )

    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, coding string, media binary")


def decode_media(media: DataFrame, target_rate: int = 2 * RATE, keep_pcm: bool = True, column: str = "media") -> DataFrame:
    """media plus `payload` (the coded bytes read back), `feature` and, if kept, `pcm`: the
    expanded audio, resampled to target_rate, as a 16-bit WAVE file."""
    others = [f for f in media.schema.fields if f.name not in ("payload", "feature", "pcm")]
    at = [f.name for f in others].index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, at):
                coded = [read_back(m) for m in batch.column(at).to_pylist()]
                # the ADPCM blocks of all files go through the decoder together
                blocks = [d for c, d in coded if c == "adpcm"]
                ends = np.cumsum([len(d) for d in blocks])
                decoded = iter(np.split(decode_adpcm(np.concatenate(blocks)), ends[:-1]) if blocks else [])
                heard = [
                    resample(next(decoded).ravel() if c == "adpcm" else expand(c, d), RATE, target_rate) for c, d in coded
                ]
                arrays = [
                    *batch.columns,
                    pa.array([payload_of(c, d) for c, d in coded], pa.binary()),
                    pa.array([features(p) for p in heard]),
                ]
                if keep_pcm:
                    arrays.append(pa.array([pcm_wave(p, target_rate) for p in heard], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [f.name for f in others] + ["payload", "feature"] + (["pcm"] if keep_pcm else [])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return media.select(*[f"`{f.name}`" for f in others]).mapInArrow(
        run, f"{kinds}, payload binary, feature string" + (", pcm binary" if keep_pcm else "")
    )
