"""Telephony audio columns: 8-bit mu-law and A-law, and IMA ADPCM, in WAV; expansion, resampling, features.

mu-law and A-law bytes are expanded by 256-entry lookup tables built from their formulas. ADPCM is decoded block by
block, of the size that the file's header states: each block starts from its own header, so one numpy step decodes the
same nibble of all equally long blocks of a batch. PCM is resampled to twice the file's rate by linear interpolation and
stored as a WAV column.

Defined cases: null audio stays null; an empty payload is a WAV without samples; the last ADPCM block may be shorter (a
header that isn't whole gives no sample); a step index above 88 in a header counts as 88; 16-bit PCM is only resampled;
channels of mu-law, A-law and PCM are averaged, rounded down; bytes that aren't such a WAV (another container or codec,
several channels of ADPCM, too large for a 32-bit size when expanded) give a null ``pcm`` and a ``feature`` that says
``error=`` and why; repeated rows give repeated results; an empty table gives no rows; further columns pass through,
but for those called ``pcm`` or ``feature``, whose place the results take.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from titerlake.llm.scratch import Scratch
from titerlake.llm.text import filled, pick, slices

#: Rate and ADPCM block size of the files that ``store_texts`` writes.
RATE, BLOCK = 8000, 144
#: Bytes of stored audio that are decoded at a time (one longer file is decoded alone).
MEDIA_BYTES = 1 << 20
#: Bytes of PCM that a WAV file's 32-bit sizes allow.
MOST_BYTES = (1 << 32) - 64
#: WAV format numbers (fixed values).
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
NAMES = {ALAW: "alaw", MULAW: "mulaw", IMA: "ima"}

#: IMA ADPCM index changes by nibble, and its step sizes (fixed values of the format).
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8], np.int32)
STEP = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173,
    190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
    2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818,
    18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    low, part = ((code & 15) << 4) + 8, (code >> 4) & 7
    size = np.where(part == 0, low, (low + 256) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def ima_decode(blocks: np.ndarray) -> np.ndarray:
    """Samples of equally long blocks, ``uint8[blocks, bytes]`` to ``int16[blocks, samples]``."""
    n, width = blocks.shape
    if width < 4:
        return np.zeros((n, 0), np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * len(body) + 1, n), np.int16)
    out[0] = value
    for k, column in enumerate(body):
        for half in (0, 1):
            nibble = (column >> 4 if half else column & 15).astype(np.int32)
            step = STEP[index]
            change = step >> 3
            change += np.where(nibble & 4, step, 0)
            change += np.where(nibble & 2, step >> 1, 0)
            change += np.where(nibble & 1, step >> 2, 0)
            value = np.clip(np.where(nibble & 8, value - change, value + change), -32768, 32767)
            index = np.clip(index + INDEX_STEP[nibble], 0, 88)
            out[2 * k + half + 1] = value
    return out.T


def to_wav(payload: bytes, codec: int, rate: int = RATE) -> bytes:
    """A mono WAV file that holds the bytes as they are."""
    if codec == IMA:
        form = struct.pack("<HHIIHHHH", IMA, 1, rate, rate * BLOCK // (2 * (BLOCK - 4) + 1), BLOCK, 4, 2, 2 * (BLOCK - 4) + 1)
    else:
        width = 2 if codec == PCM else 1
        form = struct.pack("<HHIIHH", codec, 1, rate, rate * width, width, 8 * width)
    pad = b"\0" * (len(payload) % 2)
    size = 4 + 8 + len(form) + 8 + len(payload) + len(pad)
    return b"".join((b"RIFF", struct.pack("<I", size), b"WAVEfmt ", struct.pack("<I", len(form)), form, b"data", struct.pack("<I", len(payload)), payload, pad))


class Wave(NamedTuple):
    """What a WAV file's header says, and its stored bytes."""

    codec: int
    channels: int
    rate: int
    block: int
    bits: int
    payload: bytes


def from_wav(media: bytes) -> Wave:
    """Unknown chunks are skipped; ValueError where the bytes aren't a WAV file that can be expanded."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt " and size >= 16 and at + 24 <= len(media):
            codec, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            form = codec, channels, rate, block, bits
        elif name == b"data":
            if form is None:
                raise ValueError("no format")
            wave = Wave(*form, media[at + 8 : at + 8 + size])
            if not wave.channels or not wave.rate:
                raise ValueError("no channel or rate")
            if (wave.codec, wave.bits) not in ((PCM, 16), (ALAW, 8), (MULAW, 8), (IMA, 4)):
                raise ValueError(f"codec {wave.codec} of {wave.bits} bits")
            if wave.codec == IMA and (wave.channels > 1 or wave.block < 5):
                raise ValueError("ADPCM of several channels or without blocks")
            if len(wave.payload) * {PCM: 2, IMA: 8}.get(wave.codec, 4) > MOST_BYTES:
                raise ValueError("too long")
            return wave
        at += 8 + size + size % 2
    raise ValueError("no data")


def decode_many(stored: list[Wave]) -> list[np.ndarray]:
    """PCM of many files; all whole ADPCM blocks of one size are decoded together."""
    out: list[np.ndarray | None] = [None] * len(stored)
    sizes: dict[int, list[int]] = {}
    for i, wave in enumerate(stored):
        if wave.codec == IMA:
            sizes.setdefault(wave.block, []).append(i)
            continue
        if wave.codec == PCM:
            pcm = np.frombuffer(wave.payload[: len(wave.payload) // 2 * 2], "<i2")
        else:
            pcm = TABLES[wave.codec][np.frombuffer(wave.payload, np.uint8)]
        n = wave.channels
        out[i] = pcm if n == 1 else (pcm[: len(pcm) // n * n].reshape(-1, n).astype(np.int64).sum(1) // n).astype(np.int16)
    for block, ima in sizes.items():
        whole = [len(stored[i].payload) // block for i in ima]
        samples = ima_decode(np.frombuffer(b"".join(stored[i].payload[: k * block] for i, k in zip(ima, whole, strict=True)), np.uint8).reshape(-1, block))
        at = 0
        for i, k in zip(ima, whole, strict=True):
            rest = np.frombuffer(stored[i].payload[k * block :], np.uint8)
            mine = samples[at : at + k].ravel()
            out[i] = np.concatenate([mine, ima_decode(rest[None, :]).ravel()]) if len(rest) else mine
            at += k
    return out


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the mean (rounded down) of it and the next; the last one is held."""
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    if len(pcm):
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        out[-1] = pcm[-1]
    return out


def features(pcm: np.ndarray, codec: int, rate: int) -> str:
    """Codec, seconds at ``rate``, root mean square, peak, zero crossings and mean, as text."""
    if not len(pcm):
        return f"codec={NAMES.get(codec, codec)};seconds=0.000;rms=0.00;peak=0;crossings=0;mean=0.00"
    wide = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return (
        f"codec={NAMES.get(codec, codec)};seconds={len(pcm) / rate:.3f};rms={float(np.sqrt((wide * wide).sum() / len(pcm))):.2f};"
        f"peak={int(np.abs(wide).max())};crossings={crossings};mean={wide.sum() / len(pcm):.2f}"
    )


def expand_batches(batches: Iterator[pa.RecordBatch], media_col: str = "media") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Small batches of rows, each with (``Wave``, PCM as a WAV file, feature) of every row; None twice for bad audio, None for null."""
    for whole in batches:
        for batch in slices(whole, media_col, MEDIA_BYTES):
            found: list = []
            for media in batch.column(media_col).to_pylist():
                try:
                    found.append(media if media is None else from_wav(media))
                except ValueError as error:
                    found.append((None, None, f"error={error}"))
            waves = [w for w in found if isinstance(w, Wave)]
            sound = iter(decode_many(waves))
            for i, w in enumerate(found):
                if isinstance(w, Wave):
                    pcm = resample(next(sound))
                    found[i] = w, to_wav(pcm.tobytes(), PCM, 2 * w.rate), features(pcm, w.codec, 2 * w.rate)
            yield batch, found


def expand_telephony(media: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns of ``media``, plus ``pcm`` (16-bit WAV of twice the rate, binary) and ``feature`` of the WAV column ``media_col``."""
    if media_col in ("pcm", "feature"):
        raise ValueError("the audio's column would be replaced")
    media = media.select(*[F.col(f"`{c}`") for c in media.columns if c == media_col or c not in ("pcm", "feature")])
    schema = StructType([*media.schema.fields, StructField("pcm", BinaryType()), StructField("feature", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in expand_batches(batches, media_col):
            more = [pa.array([x and x[1] for x in found], pa.binary()), pa.array([x and x[2] for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "pcm", "feature"])

    return media.mapInArrow(run, schema)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text's bytes as telephony samples, the codec chosen by the payload's crc32."""
    rows = docs.select(*pick((id_col, "doc_id"), (text_col, "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sizes, media = [], []
                for raw in filled(batch.column("text")).cast(pa.large_binary()).to_pylist():
                    payload = raw.ljust(-(-max(len(raw), 1) // 576) * 576, b"\xff")
                    sizes.append(len(raw))
                    media.append(to_wav(payload, (MULAW, ALAW, IMA)[zlib.crc32(payload) % 3]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the stored audio reads back as."""
    for whole in batches:
        for batch in slices(whole, "pcm", 4 * MEDIA_BYTES):
            media, pcm = (batch.column(c).to_pylist() for c in ("media", "pcm"))
            stored = [from_wav(x).payload for x in media]
            values = {
                "payload_bytes": pa.array([len(raw) for raw in stored], pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(raw).hexdigest() for raw in stored], pa.string()),
                "tail_crc32": pa.array([zlib.crc32(raw[-32:]) for raw in stored], pa.int64()),
                "media_bytes": pa.array(map(len, media), pa.int64()),
                "media_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in media], pa.string()),
                "feature": batch.column("feature"),
                "pcm_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in pcm], pa.string()),
                "pcm": batch.column("pcm"),
            }
            yield pa.RecordBatch.from_arrays([pc.cast(batch.column("doc_id"), pa.int64()), batch.column("n_bytes"), *values.values()], names=["doc_id", "n_bytes", *values])


def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored audio is a written table that is read back; its PCM is stored with the result, as its last column."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = Scratch(spark, "telephony").save(store_texts(docs), "media")
    shape = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_sha256 string, pcm binary"
    return expand_telephony(stored).mapInArrow(_digest, shape)
