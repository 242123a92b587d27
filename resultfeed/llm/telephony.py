"""Telephony audio columns (operator 7): mu-law, A-law and IMA ADPCM in WAV bytes, decoded with numpy.

``encode`` puts a payload of 8-bit codes (mu-law, A-law) or of 64-byte ADPCM blocks into a WAV file
without touching it.  ``decode`` reads such bytes back: mu-law and A-law codes expand through lookup
tables of 256 samples; ADPCM blocks decode step by step over all blocks of a piece at once, so that
the loop runs over the 60 bytes of a block, not over samples.  The 8 kHz samples are resampled to 16 kHz by
integer interpolation and stored as 16-bit PCM.

Defined cases: a null or empty text is 64 zero bytes; bytes that are no such WAV file decode to null;
equal payloads have equal codecs, bytes and features.  Other columns pass through untouched; results take a free
name where the input has one of theirs.  ``digest`` decodes a payload ``DECODED`` bytes at a time, so that a very long
text costs its own bytes and little more.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import appended, frugal, pieces, row_sums, utf8
from .common import free_name, process_cache, read_table

#: WAV format tags.
MU_LAW, A_LAW, IMA_ADPCM = 7, 6, 0x11
NAMES = {MU_LAW: "mulaw", A_LAW: "alaw", IMA_ADPCM: "adpcm"}
CODECS = (MU_LAW, A_LAW, IMA_ADPCM)
BLOCK, RATE, STORED_RATE = 64, 8000, 16000
BLOCK_SAMPLES = 1 + 2 * (BLOCK - 4)
#: Bytes of a payload that are decoded and measured at once; a multiple of the block.
DECODED = 1 << 18

#: Fixed values of IMA ADPCM: how a 4-bit code moves the step index.
INDEX_STEPS = (-1, -1, -1, -1, 2, 4, 6, 8)
#: Fixed values of IMA ADPCM: quantiser steps.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279,
    307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871,
    5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)


def mu_law_table() -> np.ndarray:
    """G.711 mu-law: 256 codes to 16-bit samples."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """G.711 A-law: 256 codes to 16-bit samples."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, size = (code >> 4) & 7, ((code & 0x0F) << 4) + 8
    size = np.where(exponent > 0, (size + 0x100) << np.maximum(exponent - 1, 0), size)
    return np.where(code & 0x80, size, -size).astype(np.int16)


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """(n, 64) bytes of mono IMA ADPCM blocks to (n, 121) samples; an index above 88 counts as 88."""
    steps, moves = np.array(STEPS, np.int32), np.array(INDEX_STEPS * 2, np.int32)
    code = np.arange(16)
    # the difference is the sum of its truncated parts, so it's tabulated per step and code
    parts = (steps[:, None] >> 3) + np.where(code & 4, steps[:, None], 0) + np.where(code & 2, steps[:, None] >> 1, 0) + np.where(code & 1, steps[:, None] >> 2, 0)
    change = np.where(code & 8, -parts, parts).astype(np.int32).ravel()
    onward = np.clip(np.arange(len(steps))[:, None] + moves[None, :], 0, len(steps) - 1).astype(np.int32).ravel()
    out = np.empty((BLOCK_SAMPLES, len(blocks)), np.int16)
    sample = (blocks[:, 0].astype(np.uint16) | (blocks[:, 1].astype(np.uint16) << 8)).view(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], len(steps) - 1).astype(np.int32)
    out[0] = sample
    by_place = np.ascontiguousarray(blocks[:, 4:].T)
    for k, codes in enumerate(by_place):
        for half, nibble in enumerate((codes & 15, codes >> 4)):
            at = index * 16 + nibble
            sample = np.clip(sample + change[at], -32768, 32767)
            index = onward[at]
            out[1 + 2 * k + half] = sample
    return np.ascontiguousarray(out.T)


def resample(samples: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the rate by linear interpolation (floor), row by row; a row's last sample is held."""
    out = np.empty(2 * len(samples), np.int16)
    out[::2] = samples
    follow = np.empty(len(samples), np.int32)
    if len(samples):
        follow[:-1], follow[-1] = samples[1:], samples[-1]
        ends = bounds[1:][bounds[1:] > bounds[:-1]] - 1
        follow[ends] = samples[ends]
    out[1::2] = (samples.astype(np.int32) + follow) >> 1
    return out, bounds * 2


def header(codec: int, n_bytes: int) -> bytes:
    """RIFF, fmt (with its extension) and fact chunks, up to the data."""
    if codec == IMA_ADPCM:
        form = struct.pack("<HHIIHHHH", codec, 1, RATE, RATE * BLOCK // BLOCK_SAMPLES, BLOCK, 4, 2, BLOCK_SAMPLES)
        samples = n_bytes // BLOCK * BLOCK_SAMPLES
    else:
        form, samples = struct.pack("<HHIIHHH", codec, 1, RATE, RATE, 1, 8, 0), n_bytes
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", n_bytes)
    return b"RIFF" + struct.pack("<I", len(body) + n_bytes) + body


def parse(media: bytes) -> tuple[int, int, int] | None:
    """Codec, and where the payload of a WAV file begins and ends; None if it's none of ours."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, codec = 12, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt " and size >= 16:
            codec, channels, _, _, block = struct.unpack_from("<HHIIH", media, at + 8)
            if codec not in CODECS or channels != 1 or (codec == IMA_ADPCM and block != BLOCK):
                return None
        if kind == b"data":
            whole = codec is not None and at + 8 + size <= len(media) and not (codec == IMA_ADPCM and size % BLOCK)
            return (codec, at + 8, at + 8 + size) if whole else None
        at += 8 + size + size % 2
    return None


def padded(data: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
    """Payloads: zero bytes appended up to a positive multiple of 64, one at a time."""
    return ((x := data[a:b].tobytes()) + bytes(max(BLOCK, -(-len(x) // BLOCK) * BLOCK) - len(x)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))


def codec_of(payload: bytes) -> int:
    """Mu-law, A-law or ADPCM by the payload's CRC, so that a table has all three."""
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def store(payload: bytes, codec: int) -> bytes:
    return header(codec, len(payload)) + payload


def pcm(media: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int] | None]]:
    """Samples at the stored rate, their bounds by row, and what ``parse`` found (None: no samples)."""
    found = [parse(m) if m is not None else None for m in media]
    tables = process_cache("law_tables", lambda: {MU_LAW: mu_law_table(), A_LAW: a_law_table()})
    rows: list[np.ndarray] = [np.zeros(0, np.int16)] * len(media)
    for codec in CODECS:
        at = [i for i, f in enumerate(found) if f and f[0] == codec]
        if not at:
            continue
        data = np.frombuffer(b"".join(media[i][found[i][1] : found[i][2]] for i in at), np.uint8)
        size = np.array([found[i][2] - found[i][1] for i in at])
        samples = adpcm_blocks(data.reshape(-1, BLOCK)).ravel() if codec == IMA_ADPCM else tables[codec][data]
        size = size // BLOCK * BLOCK_SAMPLES if codec == IMA_ADPCM else size
        for i, x in zip(at, np.split(samples, np.cumsum(size)[:-1]), strict=True):
            rows[i] = x
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in rows], dtype=np.int64)])
    return *resample(np.concatenate(rows) if rows else np.zeros(0, np.int16), bounds), found


def features(samples: np.ndarray, bounds: np.ndarray) -> list[Measures]:
    """Per row: samples, peak, sum of squares, zero crossings, CRC."""
    x = samples.astype(np.int64)
    energy = row_sums(x * x, bounds)
    sign = x < 0
    crossing = np.zeros(len(x), np.int64)
    crossing[1:] = sign[1:] != sign[:-1]
    starts = bounds[:-1][bounds[1:] > bounds[:-1]]
    crossing[starts] = 0
    crossings, peak = row_sums(crossing, bounds), np.zeros(len(bounds) - 1, np.int64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        peak[full] = np.maximum.reduceat(np.abs(x), bounds[:-1][full])
    crc = [zlib.crc32(samples[a:b].astype("<i2").tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return [Measures(int(n), int(p), int(e), int(z), c) for n, p, e, z, c in zip(np.diff(bounds), peak, energy, crossings, crc, strict=True)]


@dataclass
class Measures:
    """Samples, peak, sum of squares, zero crossings and CRC of a stream of samples at the stored rate."""

    n: int = 0
    peak: int = 0
    energy: int = 0
    crossings: int = 0
    crc: int = 0
    below: bool | None = None  # whether the last sample was below zero

    def add(self, samples: np.ndarray) -> None:
        if not len(samples):
            return
        sign = samples < 0
        self.n += len(samples)
        self.peak = max(self.peak, abs(int(samples.min())), abs(int(samples.max())))
        self.energy += sum(int(np.dot(x, x)) for x in (samples[i : i + DECODED].astype(np.int64) for i in range(0, len(samples), DECODED)))
        self.crossings += int(np.count_nonzero(sign[1:] != sign[:-1])) + (self.below is not None and bool(sign[0]) != self.below)
        self.below = bool(sign[-1])
        self.crc = zlib.crc32(samples.astype("<i2").tobytes(), self.crc)


def measured(payload: np.ndarray, codec: int, tables: dict[int, np.ndarray]) -> Measures:
    """A payload's samples, decoded and resampled part by part.  The last sample of a part waits for the one behind it,
    between which the resampler interpolates."""
    out, held = Measures(), np.zeros(0, np.int16)
    for at in range(0, len(payload), DECODED):
        part = payload[at : at + DECODED]
        samples = adpcm_blocks(part.reshape(-1, BLOCK)).ravel() if codec == IMA_ADPCM else tables[codec][part]
        samples = np.concatenate([held, samples])
        last = at + DECODED >= len(payload)
        twice, _ = resample(samples, np.array([0, len(samples)]))
        out.add(twice if last else twice[:-2])
        held = samples[-1:]
    return out


def encode(df: DataFrame, text: str = "text", codec: int | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with ``media`` (WAV bytes) and ``n_bytes``; ``codec`` None: by ``codec_of``.  And the names these got."""
    names = {c: free_name(df.columns, c) for c in ("n_bytes", "media")}

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text):
                data, bounds = utf8(piece.column(text))
                media = [store(p, codec_of(p) if codec is None else codec) for p in padded(data, bounds)]
                yield appended(piece, {names["n_bytes"]: pa.array(np.diff(bounds)), names["media"]: pa.array(media, pa.binary())})

    return df.mapInArrow(frugal(run), T.StructType([*df.schema.fields, T.StructField(names["n_bytes"], T.LongType()), T.StructField(names["media"], T.BinaryType())])), names


def decode(df: DataFrame, media: str = "media") -> tuple[DataFrame, dict[str, str]]:
    """``df`` with ``codec``, ``sample_rate`` and ``pcm`` (16-bit little-endian), null where the bytes are none of ours."""
    names = {c: free_name(df.columns, c) for c in ("codec", "sample_rate", "pcm")}

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, media):
                samples, bounds, found = pcm(piece.column(media).to_pylist())
                cut = [samples[a:b].astype("<i2").tobytes() if f else None for a, b, f in zip(bounds[:-1], bounds[1:], found, strict=True)]
                yield appended(piece, {
                    names["codec"]: pa.array([f and NAMES[f[0]] for f in found], pa.string()),
                    names["sample_rate"]: pa.array([f and STORED_RATE for f in found], pa.int32()),
                    names["pcm"]: pa.array(cut, pa.binary()),
                })

    fields = [T.StructField(names["codec"], T.StringType()), T.StructField(names["sample_rate"], T.IntegerType()), T.StructField(names["pcm"], T.BinaryType())]
    return df.mapInArrow(frugal(run), T.StructType([*df.schema.fields, *fields])), names


DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest_row(media: bytes, x: Measures) -> tuple:
    codec, start, end = parse(media)
    payload = memoryview(media)[start:end]
    told = f"{NAMES[codec]} {STORED_RATE} Hz n={x.n} peak={x.peak} energy={x.energy} zc={x.crossings} pcm={x.crc:08x}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), told


def _digest_rows(media: Iterator[bytes]) -> Iterator[tuple]:
    """Short rows are decoded together, across their blocks; a long one by itself, part by part."""
    tables = process_cache("law_tables", lambda: {MU_LAW: mu_law_table(), A_LAW: a_law_table()})
    held, size = [], 0

    def together():
        samples, bounds, _ = pcm(held)
        yield from map(_digest_row, held, features(samples, bounds))

    for m in media:
        if size + len(m) > DECODED and held:
            yield from together()
            held, size = [], 0
        if len(m) > DECODED:
            codec, start, end = parse(m)
            yield _digest_row(m, measured(np.frombuffer(memoryview(m)[start:end], np.uint8), codec, tables))
        else:
            held.append(m)
            size += len(m)
    if held:
        yield from together()


def digest(df: DataFrame, text: str = "text", codec: int | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Each text stored as WAV bytes, read back, decoded and measured; the bytes leave the worker only as
    digests.  ``df``'s columns (without ``text``), n_bytes and the columns of ``DIGEST``; and the names these got."""
    made, names = T._parse_datatype_string("n_bytes long, " + DIGEST), {}
    keep = [f for f in df.schema.fields if f.name != text]
    for c in made.names:
        names[c] = free_name([*df.columns, *names.values()], c)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text):
                data, bounds = utf8(piece.column(text))
                rows = list(_digest_rows(store(p, codec_of(p) if codec is None else codec) for p in padded(data, bounds)))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array(np.diff(bounds)), *[pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)]]
                yield appended(piece.select([f.name for f in keep]), dict(zip(names.values(), columns, strict=True)))

    schema = T.StructType([*keep, *[T.StructField(names[f.name], f.dataType) for f in made.fields]])
    return df.select(*[F.col(f"`{f.name}`") for f in keep], text).mapInArrow(frugal(run), schema), names


def op7(spark, sf_dir: str) -> DataFrame:
    return digest(read_table(spark, sf_dir, "documents").select("doc_id", "text"))[0]
