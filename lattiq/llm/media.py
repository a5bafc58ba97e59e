"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers.

mu-law and A-law samples expand through 256-entry lookup tables built from their
defining formulas.  IMA ADPCM is sequential inside a block, so decoding steps
through the nibbles of a block once while numpy advances all blocks together.
``transcode`` gives the samples resampled as 16-bit PCM, which the query stores
and reads back at twice the rate.  That is several times the text, so the query
goes through the files in rounds and removes a round's PCM once it is digested.

Defined results: a null or empty payload becomes one padded unit; a malformed
container raises ValueError; equal payloads give equal files and features.
Batches are bounded, and a single long text is decoded in spans of blocks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, slices

UNIT = 576
PAD = 255
RATE = 8000
BLOCK = 36  # bytes of an ADPCM block: 4 of header, 32 of nibbles
TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}
STORED_RATE = (2, 1)  # of RATE: 16-bit PCM at 16 kHz
ROUNDS = 4  # in which the PCM is stored, read back and removed
NAMED = 8  # ``feature`` ends in a checksum of every eighth stored sample; pcm_crc32 is that of all
CODECS = ("mulaw", "alaw", "ima_adpcm")
# Fixed values of the IMA ADPCM standard: changes of the step index by the low three bits of a nibble.
INDEX_CHANGE = (-1, -1, -1, -1, 2, 4, 6, 8)
# Fixed values of the IMA ADPCM standard: step sizes by step index.
STEP = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """Expansion of each code to 16-bit PCM, by G.711's rules."""
    code = np.arange(256)
    u = ~code & 0xFF
    size = ((((u & 15) << 3) + 132) << ((u >> 4) & 7)) - 132
    mulaw = np.where(u & 0x80, -size, size)
    a = code ^ 0x55
    exponent, mantissa = (a >> 4) & 7, a & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 264) << np.maximum(exponent - 1, 0))
    return {"mulaw": mulaw.astype(np.int16), "alaw": np.where(a & 0x80, size, -size).astype(np.int16)}


def decode_adpcm(data: bytes) -> np.ndarray:
    """PCM of IMA ADPCM blocks of BLOCK bytes; all blocks advance together.

    A block gives its header's sample and one for each nibble, low nibble first.
    A step index beyond the table counts as the table's last.
    """
    blocks = np.frombuffer(data, np.uint8).reshape(-1, BLOCK)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEP) - 1).astype(np.int32)
    step, change = np.array(STEP, np.int32), np.array(INDEX_CHANGE, np.int32)
    out = np.empty((2 * (BLOCK - 4) + 1, len(blocks)), np.int16)
    out[0] = value
    nibbles = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * (BLOCK - 4)):
        nibble = (nibbles[k // 2] >> (4 * (k % 2))) & 15
        size = nibble & 7
        s = step[index]
        diff = (s >> 3) + np.where(size & 4, s, 0) + np.where(size & 2, s >> 1, 0) + np.where(size & 1, s >> 2, 0)
        value = np.clip(np.where(nibble & 8, value - diff, value + diff), -32768, 32767)
        index = np.clip(index + change[size], 0, len(STEP) - 1)
        out[k + 1] = value
    return out.T.ravel()


def pack(payload: bytes, codec: str) -> bytes:
    """A mono WAV file whose data chunk is the payload, byte for byte."""
    if codec == "ima_adpcm":
        per = 2 * (BLOCK - 4) + 1
        fmt = struct.pack("<HHIIHHHH", TAGS[codec], 1, RATE, RATE * BLOCK // per, BLOCK, 4, 2, per)
    else:
        fmt = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, RATE, 1, 8, 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unpack(media: bytes) -> tuple[str, bytes]:
    """Codec and payload of a stored file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, data = 12, None, None
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            codec = next((k for k, v in TAGS.items() if v == struct.unpack_from("<H", media, at + 8)[0]), None)
        elif name == b"data":
            data = media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    if codec is None or data is None:
        raise ValueError("no known codec or no data chunk")
    return codec, data


def decode(codec: str, payload: bytes) -> np.ndarray:
    return decode_adpcm(payload) if codec == "ima_adpcm" else tables()[codec][np.frombuffer(payload, np.uint8)]


def resample(pcm: np.ndarray, up: int = 2, down: int = 1) -> np.ndarray:
    """Linear interpolation in whole numbers to up/down times the rate; the last sample holds."""
    n = len(pcm) * up // down
    if up == 2 and down == 1:
        wide = np.append(pcm, pcm[-1:]).astype(np.int32)
        out = np.empty(n, np.int16)
        out[0::2], out[1::2] = pcm, (wide[:-1] + wide[1:]) >> 1
        return out
    at = np.arange(n, dtype=np.int64) * down
    i, r = at // up, at % up
    wide = np.append(pcm, pcm[-1:]).astype(np.int64)
    return ((wide[i] * (up - r) + wide[i + 1] * r) // up).astype(np.int16)


def features(pcm: np.ndarray, rate_ratio: tuple[int, int] = (2, 1)) -> tuple[str, bytes]:
    """Whole-number features of the samples, and the PCM resampled to rate_ratio times the rate."""
    wide = pcm.astype(np.int64)
    stored = resample(pcm, *rate_ratio).astype("<i2").tobytes()
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    energy = int(np.dot(wide, wide)) // max(len(pcm), 1)
    text = f"n={len(pcm)};peak={int(np.abs(wide).max(initial=0))};mean={int(wide.sum()) // max(len(pcm), 1)};power={energy};zc={crossings}"
    return text, stored


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    want = max(1, -(-len(raw) // UNIT)) * UNIT
    return len(raw), raw + bytes([PAD]) * (want - len(raw))


def encode(docs: DataFrame, codecs: tuple[str, ...] = CODECS) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as a WAV file, its codec chosen by a checksum of the payload."""
    def run(batches):
        for batch in slices(batches, 1024):
            size, media = [], []
            for text in batch.column("text").to_pylist():
                n, payload = payload_of(text)
                size.append(n)
                media.append(pack(payload, codecs[zlib.crc32(payload) % len(codecs)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def transcode(stored: DataFrame, rate_ratio: tuple[int, int] = (2, 1)) -> DataFrame:
    """Append codec, payload, feature and pcm, the resampled 16-bit samples, to a frame with media."""
    names = [c for c in stored.columns if c != "media"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields if f.name != "media")

    def run(batches):
        for batch in slices(batches, 1024, 2 << 20):  # PCM is up to 7.3 times as long
            cols: list[list] = [[], [], [], []]
            for media in batch.column("media").to_pylist():
                codec, payload = unpack(media)
                feature, pcm = features(decode(codec, payload), rate_ratio)
                for c, v in zip(cols, (codec, payload, f"codec={codec};{feature}", pcm)):
                    c.append(v)
            kinds_out = (pa.string(), pa.binary(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), batch.column("media"), *(pa.array(c, k) for c, k in zip(cols, kinds_out))], names=[*names, "media", "codec", "payload", "feature", "pcm"])

    return stored.mapInArrow(run, f"{kinds}, media binary, codec string, payload binary, feature string, pcm binary")


def digest(pcm: DataFrame) -> DataFrame:
    """In the place of pcm: pcm_samples and pcm_crc32 of all of it, and feature lengthened by count and checksum of every NAMED-th sample."""
    names = [c for c in pcm.columns if c not in ("feature", "pcm")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pcm.schema.fields if f.name in names)

    def run(batches):
        for batch in slices(batches, 1024):
            feature, count, crc = [], [], []
            for text, v in zip(batch.column("feature").to_pylist(), batch.column("pcm")):
                data = v.as_buffer()
                samples = np.frombuffer(data, "<i2")
                n = len(samples) // NAMED
                feature.append(f"{text};pcm={n},{zlib.crc32(samples[::NAMED][:n].tobytes()):x}")
                count.append(len(samples))
                crc.append(zlib.crc32(data))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(feature, pa.string()), pa.array(count, pa.int64()), pa.array(crc, pa.int64())], names=[*names, "feature", "pcm_samples", "pcm_crc32"])

    return pcm.mapInArrow(run, f"{kinds}, feature string, pcm_samples long, pcm_crc32 long")


@contextmanager
def _wide_rows(spark: SparkSession):
    """Few rows at once from Parquet, for what runs inside: a row of PCM may be very long."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    spark.conf.set(key, "256")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def media_of_documents(docs: DataFrame) -> DataFrame:
    """The contract's rows, and pcm_samples and pcm_crc32.

    The files are written to the shared folder and read back, and so is the PCM of
    every one, in ROUNDS rounds over the parts in which the files lie.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "media")
    stored = space.write(encode(docs), "files")
    parts = sorted(f"{space.paths['files']}/{p.rsplit('/', 1)[1]}" for p in stored.inputFiles())
    rounds = min(ROUNDS, len(parts))
    kept = []
    for k in range(rounds):
        files = spark.read.schema(stored.schema).parquet(*parts[k::rounds])
        out = transcode(files, STORED_RATE).select(
            "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "pcm"
        )
        with _wide_rows(spark):
            kept.append(space.write(digest(space.write(out, f"pcm-{k}")), f"rows-{k}"))
        space.drop(f"pcm-{k}")
    space.drop("files")
    return spark.read.schema(kept[0].schema).parquet(*(space.paths[f"rows-{k}"] for k in range(rounds)))
