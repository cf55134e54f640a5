"""Telephony audio columns: G.711 mu-law and A-law by lookup tables, IMA ADPCM by blocks, resampled PCM.

Media are RIFF/WAVE files with the samples as they were coded.  Decoding looks G.711 bytes up in a table of
256 values; ADPCM blocks are decoded side by side, one numpy step for the n-th sample of all blocks of a
batch.  The decoded 8 kHz signal becomes 16 kHz PCM by a half-band interpolator in whole numbers, so the result is
the same everywhere; ``store_pcm`` writes it as a table.

Encoding and decoding are jobs of their own with the written media between them: no stage holds two Python
workers, and what is decoded are bytes that were read back from storage.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import common

#: Format tags of RIFF/WAVE.
ALAW, MULAW, IMA = 6, 7, 17
NAMES = {ALAW: "alaw", MULAW: "mulaw", IMA: "ima"}
#: Bytes of an ADPCM block: 4 of header, then two samples a byte.
BLOCK = 36
UNIT = 576
RATE, TARGET = 8000, 16000
#: The step sizes of IMA ADPCM.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
        157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
        1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
        12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    dtype=np.int32,
)
#: How a code moves the step index.
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """The linear value of each mu-law byte: inverted bits, 4-bit mantissa with bias 132, 3-bit exponent."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The linear value of each A-law byte: even bits inverted, linear below the first segment."""
    code = np.arange(256) ^ 0x55
    mantissa, segment = (code & 15) << 4, code >> 4 & 7
    size = np.where(segment == 0, mantissa + 8, (mantissa + 264) << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode_blocks(data: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM: (blocks, BLOCK) bytes to (blocks, samples) PCM; all blocks advance together."""
    value = data[:, :2].copy().view("<i2").astype(np.int32).ravel()
    index = np.minimum(data[:, 2].astype(np.int32), 88)
    out = np.empty((2 * (data.shape[1] - 4) + 1, len(data)), np.int16)
    out[0] = value
    for j in range(4, data.shape[1]):
        for half, shift in enumerate((0, 4)):
            code = (data[:, j] >> shift & 15).astype(np.int32)
            step = STEPS[index]
            move = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
            value = np.clip(value + np.where(code & 8, -move, move), -32768, 32767)
            index = np.clip(index + MOVES[code], 0, 88)
            out[2 * (j - 4) + half + 1] = value
    return out.T


def wav(tag: int, payload: bytes) -> bytes:
    """A mono 8 kHz RIFF/WAVE file of coded samples."""
    if tag == IMA:
        samples = 2 * (BLOCK - 4) + 1
        form = struct.pack("<HHIIHHHH", tag, 1, RATE, RATE * BLOCK // samples, BLOCK, 4, 2, samples)
        length = len(payload) // BLOCK * samples
    else:
        form, length = struct.pack("<HHIIHHH", tag, 1, RATE, RATE, 1, 8, 0), len(payload)
    pad = b"\0" * (len(payload) % 2)
    chunks = b"".join((b"fmt ", struct.pack("<I", len(form)), form, b"fact", struct.pack("<II", 4, length), b"data", struct.pack("<I", len(payload)), payload, pad))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def unwav(media: bytes | None) -> tuple[int, bytes] | None:
    """(format tag, coded samples); None for what is no complete RIFF/WAVE file."""
    if not media or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, tag = 12, None
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and n >= 2:
            tag = struct.unpack_from("<H", media, at + 8)[0]
        if name == b"data":
            return (tag, media[at + 8 : at + 8 + n]) if tag is not None and at + 8 + n <= len(media) else None
        at += 8 + n + n % 2
    return None


def upsample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: the samples, and between two the four-tap half-band value (-1, 9, 9, -1) / 16."""
    if not len(pcm):
        return pcm.astype("<i2")
    x = np.concatenate([pcm[:1], pcm, pcm[-1:], pcm[-1:]]).astype(np.int32)
    out = np.empty(2 * len(pcm), "<i2")
    out[::2] = pcm
    out[1::2] = np.clip((9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4, -32768, 32767)
    return out


def decode_all(media: list[bytes | None]) -> list[tuple[str, bytes, np.ndarray] | None]:
    """(codec, stored samples, 8 kHz PCM) of each file; None for null, damaged or unknown media."""
    parts: list = [unwav(m) for m in media]
    ima = [i for i, p in enumerate(parts) if p and p[0] == IMA]
    flat = np.frombuffer(b"".join(parts[i][1][: len(parts[i][1]) // BLOCK * BLOCK] for i in ima), np.uint8).reshape(-1, BLOCK)
    pcm, at = decode_blocks(flat), 0
    for i, p in enumerate(parts):
        if p is None or p[0] not in NAMES:
            parts[i] = None
        elif p[0] == IMA:
            n = len(p[1]) // BLOCK
            parts[i] = (NAMES[IMA], p[1], pcm[at : at + n].ravel())
            at += n
        else:
            parts[i] = (NAMES[p[0]], p[1], TABLES[p[0]][np.frombuffer(p[1], np.uint8)])
    return parts


def features(codec: str, pcm: np.ndarray, stored: bytes) -> str:
    """Codec, number of samples, peak, mean absolute value and sign changes of the 8 kHz signal, and the CRC-32 of
    the 16 kHz PCM: all whole numbers."""
    x = pcm.astype(np.int64)
    loud = np.abs(x)
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"{codec}:{len(x)}:{int(loud.max(initial=0))}:{int(loud.sum()) // max(1, len(x))}:{turns}:{zlib.crc32(stored)}"


def decode_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, media, payload, pcm, feature) of a column of WAVE files; pcm is 16 kHz, 16 bits, little-endian.

    Null, damaged or unknown media give null payload, pcm and feature.  A last partial ADPCM block is not
    decoded.  Repeated rows are decoded each; an empty table gives no rows.  Other columns of ``df`` are not read.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = decode_all(batch.column(1).to_pylist())
        pcm = [f and upsample(f[2]).tobytes() for f in found]
        return pa.record_batch(
            [
                batch.column(0), batch.column(1), pa.array([f and f[1] for f in found], pa.binary()), pa.array(pcm, pa.binary()),
                pa.array([f and features(f[0], f[2], p) for f, p in zip(found, pcm, strict=True)], pa.string()),
            ],
            names=["doc_id", "media", "payload", "pcm", "feature"],
        )

    given = df.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    return common.map_text(given, kernel, common.keyed(given, "media binary, payload binary, pcm binary, feature string"))


def store_pcm(df: DataFrame, path: str, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Write (doc_id, pcm, feature) of a column of WAVE files as Parquet and read it back.

    The rows are those of ``decode_media``, with null pcm for what cannot be decoded.  PCM takes four bytes for a
    G.711 byte and about seven for an ADPCM byte.
    """
    decode_media(df, id_col, media_col).select("doc_id", "pcm", "feature").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def describe_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """The other columns of ``df``, then payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The digests of what ``decode_media`` gives, made beside the samples, so that no payload or PCM goes back to the
    JVM.  Null, damaged or unknown media give nulls, but for the length and digest of damaged media themselves.  A
    column of ``df`` with the name of a digest is replaced.
    """
    made = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [n.split()[0] for n in made.split(", ")]
    kept = [f for f in df.schema if f.name not in (media_col, *names)]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        media = batch.column(1).to_pylist()
        found = decode_all(media)
        sha = lambda b: None if b is None else hashlib.sha256(b).hexdigest()
        columns = [
            pa.array([f and len(f[1]) for f in found], pa.int64()), pa.array([f and sha(f[1]) for f in found], pa.string()),
            pa.array([f and zlib.crc32(f[1][-32:]) for f in found], pa.int64()), pa.array([None if m is None else len(m) for m in media], pa.int64()),
            pa.array([sha(m) for m in media], pa.string()), pa.array([f and features(f[0], f[2], upsample(f[2]).tobytes()) for f in found], pa.string()),
        ]
        return pa.record_batch([batch.column(0), *columns], names=["kept", *names])

    given = df.select(F.struct(F.lit(0).alias("__at"), *(F.col(f"`{f.name}`") for f in kept)).alias("kept"), F.col(media_col).alias("media"))
    out = common.map_text(given, kernel, common.keyed(given, made, "kept"))
    return out.select("kept.*", *names).drop("__at")


def text_as_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 as coded samples of a WAVE file, padded with bytes 255.

    The payload's length is a positive multiple of UNIT, which is whole samples of G.711 and whole ADPCM
    blocks.  The CRC-32 of the payload picks one of the three codecs, so equal texts give equal files.  Null
    counts as empty.  Repeated rows give a file each; an empty table gives no rows.  Other columns are not read.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = common.utf8(batch.column(1))
        padded = [t + b"\xff" * (UNIT - len(t) % UNIT if len(t) % UNIT or not t else 0) for t in texts]
        files = [wav((MULAW, ALAW, IMA)[zlib.crc32(p) % 3], p) for p in padded]
        return pa.record_batch([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    given = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_text(given, kernel, common.keyed(given, "n_bytes long, media binary"))


def op5(spark, sf_dir: str) -> DataFrame:
    media = common.written(text_as_media(common.read(spark, sf_dir, "documents")), "media")
    return describe_media(media)
