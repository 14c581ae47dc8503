"""Telephony audio: tables, blocks against single steps, round trips."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from visitframe.llm import telephony
from visitframe.llm.registry import op8_telephony


def test_companding_tables():
    # end points and zero crossings of G.711
    assert [telephony.MULAW[c] for c in (0x00, 0x7F, 0x80, 0xFF)] == [-32124, 0, 32124, 0]
    assert [telephony.ALAW[c] for c in (0x2A, 0xAA, 0x55, 0xD5)] == [-32256, 32256, -8, 8]
    for table in (telephony.MULAW, telephony.ALAW):
        assert sorted(-table.astype(int)) == sorted(table.astype(int))


def one_block(block: bytes) -> list[int]:
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            size = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
            value = max(-32768, min(32767, value - size if nibble & 8 else value + size))
            index = max(0, min(88, index + int(telephony.INDEX_CHANGE[nibble])))
            out.append(value)
    return out


def test_adpcm_blocks_against_single_steps():
    blocks = np.random.default_rng(1).integers(0, 256, (50, 36), dtype=np.uint8)
    assert telephony.decode_adpcm(blocks).tolist() == [one_block(b.tobytes()) for b in blocks]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000), st.sampled_from(sorted(telephony.TAGS)))
def test_storing_is_lossless(raw, coding):
    payload = telephony.pad(raw)
    assert len(payload) % telephony.UNIT == 0 and len(payload) > 0
    found, data = telephony.read_back(telephony.store(payload, coding))
    assert found == coding and telephony.payload_of(coding, data) == payload


def test_resampling():
    pcm = np.array([0, 10, -10, 5], np.int16)
    assert telephony.resample(pcm, 8000, 16000).tolist() == [0, 5, 10, 0, -10, -3, 5, 5]
    assert telephony.resample(pcm, 8000, 4000).tolist() == [0, -10]
    assert telephony.resample(pcm, 8000, 8000) is pcm


def riff(tag: int, rate: int, byte_rate: int, align: int, bits: int, extra: bytes, data: bytes) -> bytes:
    head = struct.pack("<HHIIHH", tag, 1, rate, byte_rate, align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def one_sample(coding: str, code: int) -> int:
    if coding == "mulaw":
        code ^= 0xFF
        size = (((code & 15) * 2 + 33) << (code >> 4 & 7)) * 4 - 132
        return -size if code & 0x80 else size
    code ^= 0x55
    exponent, mantissa = code >> 4 & 7, code & 15
    size = mantissa * 16 + 8 if not exponent else (mantissa * 16 + 264) << (exponent - 1)
    return size if code & 0x80 else -size


def plainly(raw: bytes, payload: bytes) -> tuple[bytes, bytes, str]:
    """The stored file, the resampled PCM file and the feature, sample by sample."""
    coding = ("mulaw", "alaw", "adpcm")[zlib.crc32(raw) % 3]
    if coding == "adpcm":
        blocks = [bytes(4) + payload[k : k + 32] for k in range(0, len(payload), 32)]
        media = riff(17, 8000, 8000 * 36 // 65, 36, 4, struct.pack("<HH", 2, 65), b"".join(blocks))
        heard = [x for b in blocks for x in one_block(b)]
    else:
        media = riff({"mulaw": 7, "alaw": 6}[coding], 8000, 8000, 1, 8, struct.pack("<H", 0), payload)
        heard = [one_sample(coding, c) for c in payload]
    wide = []
    for here, after in zip(heard, [*heard[1:], heard[-1]], strict=True):
        wide += [here, (here + after) // 2]
    data = struct.pack(f"<{len(wide)}h", *wide)
    crossings = sum((a < 0) != (b < 0) for a, b in zip(wide, wide[1:], strict=False))
    square = sum(x * x for x in wide) // len(wide)
    feature = f"n={len(wide)};peak={max(map(abs, wide))};ms={square};zc={crossings};crc={zlib.crc32(data)}"
    return media, riff(1, 16000, 32000, 2, 16, b"", data), feature


def test_query_against_plain_python(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op8_telephony(spark, "/root/testdata/sf0.001").collect():
        raw = (rows[r["doc_id"]] or "").encode()
        payload = telephony.pad(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        media, pcm, feature = plainly(raw, payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert (r["pcm_bytes"], r["pcm_sha256"]) == (len(pcm), hashlib.sha256(pcm).hexdigest())
        assert r["feature"] == feature


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash")).withColumn("payload", F.lit(1))
    got = telephony.decode_media(telephony.to_media(docs)).collect()
    assert len(got) == 4 and len({r["feature"] for r in got}) == 2
    assert all(bytes(r["pcm"][:4]) == b"RIFF" for r in got)
    assert telephony.decode_media(telephony.to_media(docs.limit(0))).count() == 0
