"""Telephony audio as a media column.

Stored form: a RIFF/WAVE file in a binary column, 8 kHz mono, in one of three
codings: mu-law (format 7), A-law (format 6) or IMA ADPCM (format 17, blocks of
192 bytes). Reading expands the companded codings by a 256-entry table and
decodes ADPCM one nibble step at a time across all blocks at hand. The decoded
samples are resampled to 16 kHz by a two-phase integer filter and kept as a PCM
WAVE file. ``encode_media`` makes the files to store, ``describe_media`` works on
stored files; both go through a file in segments, so beside a file and its PCM a
worker holds a few megabytes whatever the length.

Defined results: null or empty text is 192 spaces; ids are integers (null ids stay
null); rows repeat as they come; a text over some 250 MB has more PCM than a cell
holds (2 GB, 8 bytes a byte) and is described without ``pcm``; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkit import blocks, map_blocks, texts
from tessera.sources.scratch import Scratch

UNIT = 192
RATE = 8000
#: Stored bytes decoded at once, and most bytes of a cell.
SEGMENT, CELL = UNIT * 4096, (1 << 31) - (1 << 16)
CODECS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
_NAMES = {v: k for k, v in CODECS.items()}
_STEPS_PER_BLOCK = 2 * (UNIT - 4)

# The IMA ADPCM step sizes and index moves.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
    11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, segment = code & 15, code >> 4 & 7
    size = np.where(segment == 0, (part << 4) + 8, (part << 4) + 264 << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": _mulaw_table(), "alaw": _alaw_table()}
#: Half-sample interpolation taps in units of 1/256 (windowed sinc); the other phase is the sample itself.
HALF = np.array([-3, 13, -40, 158, 158, -40, 13, -3], np.int32)


def expand(codes: np.ndarray, codec: str) -> np.ndarray:
    """Linear 16-bit samples of mu-law or A-law bytes."""
    return TABLES[codec][codes]


def decode_adpcm(data: np.ndarray) -> np.ndarray:
    """Samples of whole 192-byte ADPCM blocks, one row of 377 a block; the loop is over steps, numpy runs across blocks."""
    block = data.reshape(-1, UNIT)
    out = np.empty((len(block), _STEPS_PER_BLOCK + 1), np.int16)
    value = block[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(block[:, 2], 88).astype(np.int32)
    out[:, 0] = value
    for k in range(_STEPS_PER_BLOCK):
        nibble = (block[:, 4 + k // 2] >> 4 * (k & 1) & 15).astype(np.int32)
        step = STEPS[index]
        move = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
        value = np.clip(np.where(nibble & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + MOVES[nibble & 7], 0, 88)
        out[:, k + 1] = value
    return out


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the interpolated half step after it (edges repeat the end samples)."""
    n = len(pcm)
    out = np.empty(2 * n, np.int16)
    if n:
        wide = np.pad(pcm.astype(np.int32), (3, 4), "edge")
        half = sum(int(c) * wide[k : k + n] for k, c in enumerate(HALF))
        out[::2], out[1::2] = pcm, np.clip(half + 128 >> 8, -32768, 32767)
    return out


def write_wav(data: bytes, codec: str | None, rate: int = RATE) -> bytes:
    """A WAVE file of coded bytes, or of little-endian PCM where ``codec`` is None."""
    if codec == "adpcm":
        fmt = struct.pack("<HHIIHHHH", 17, 1, rate, rate * UNIT // (_STEPS_PER_BLOCK + 1), UNIT, 4, 2, _STEPS_PER_BLOCK + 1)
    elif codec:
        fmt = struct.pack("<HHIIHHH", CODECS[codec], 1, rate, rate, 1, 8, 0)
    else:
        fmt = struct.pack("<HHIIHH", 1, 1, rate, 2 * rate, 2, 16)
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def read_wav(media: bytes) -> tuple[str | None, int, memoryview]:
    """Codec (None: PCM), rate and data chunk of a WAVE file; other chunks are passed over."""
    if bytes(media[:4]) != b"RIFF" or bytes(media[8:12]) != b"WAVE":
        raise ValueError("not a WAVE file")
    media = memoryview(media)
    at, kind, rate = 12, 1, 0
    while at + 8 <= len(media):
        name, size = bytes(media[at : at + 4]), struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            return _NAMES.get(kind), rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def payload_of(text: bytes) -> bytes:
    """The text, with spaces up to a positive multiple of the unit."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" ")


def pick_codec(payload: bytes) -> str:
    """A coding by content, so that equal texts share it."""
    return list(CODECS)[zlib.crc32(payload) % len(CODECS)]


def decoded(codec: str | None, data: memoryview) -> Iterator[np.ndarray]:
    """Samples of a data chunk, SEGMENT bytes of it at a time."""
    for lo in range(0, len(data), SEGMENT):
        part = np.frombuffer(data[lo : lo + SEGMENT], np.uint8)
        yield decode_adpcm(part).reshape(-1) if codec == "adpcm" else part.view("<i2") if codec is None else expand(part, codec)


def resampled(parts: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """``resample`` of a sequence that comes in parts, in parts."""
    if isinstance(parts, list) and len(parts) == 1:
        yield resample(parts[0])
        return
    held, lead = np.zeros(0, np.int16), 0  # samples not yet given out, behind ``lead`` that were
    for part in parts:
        held = np.concatenate([held, part])
        ready = len(held) - 4  # these have all their neighbours
        if ready > lead:
            yield resample(held)[2 * lead : 2 * ready]
            keep = max(0, ready - 3)
            held, lead = held[keep:], ready - keep
    if len(held) > lead:
        yield resample(held)[2 * lead :]


class Features:
    """Integer features, so equal media give equal strings on any machine."""

    def __init__(self) -> None:
        self.n = self.peak = self.power = self.sum = self.crossings = 0
        self.last: bool | None = None

    def add(self, pcm: np.ndarray) -> np.ndarray:
        x = pcm.astype(np.int64)
        up = x >= 0
        self.crossings += int((up[1:] != up[:-1]).sum()) + (self.last is not None and bool(up[0]) != self.last)
        self.n, self.peak, self.power, self.sum, self.last = self.n + len(x), max(self.peak, int(np.abs(x).max())), self.power + int((x * x).sum()), self.sum + int(x.sum()), bool(up[-1])
        return pcm

    def text(self, codec: str, crc: int) -> str:
        return f"{codec};n={self.n};peak={self.peak};power={self.power // self.n};mean={self.sum // self.n};crossings={self.crossings};pcm16k={crc:08x}"


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and ``media``, the telephony WAVE file of every text, to be stored."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = texts(batch.column("text"))
        stored = [write_wav(p, pick_codec(p)) for p in map(payload_of, raw)]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(t) for t in raw], pa.int64()), "media": pa.array(stored, pa.binary())})

    return map_blocks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "text", run, "doc_id long, n_bytes long, media binary")


def decoded_together(files: list[tuple[str | None, int, memoryview]]) -> list[Iterable[np.ndarray]]:
    """Samples of each of several small files; the ADPCM blocks of all are decoded at once."""
    blocks_of = [data for codec, _, data in files if codec == "adpcm"]
    samples = decode_adpcm(np.frombuffer(b"".join(blocks_of), np.uint8)) if blocks_of else None
    out: list[Iterable[np.ndarray]] = []
    at = 0
    for codec, _, data in files:
        if codec == "adpcm":
            n = len(data) // UNIT
            out.append([samples[at : at + n].reshape(-1)])
            at += n
        else:
            out.append(decoded(codec, data))
    return out


def described(media: bytes, samples: Iterable[np.ndarray] | None = None) -> dict[str, object]:
    """What is read back from one stored file: payload digests, features, and the 16 kHz PCM file; ``samples`` where they are decoded already."""
    codec, _, data = read_wav(media)
    samples = decoded(codec, data) if samples is None else samples
    features, crc, digest = Features(), 0, hashlib.sha256()
    wide = 2 * (len(data) // UNIT * (_STEPS_PER_BLOCK + 1) if codec == "adpcm" else len(data))  # samples at twice the rate
    pcm = bytearray(write_wav(b"", None, 2 * RATE))
    head = len(pcm)
    struct.pack_into("<I", pcm, 4, head - 8 + 2 * wide)
    struct.pack_into("<I", pcm, head - 4, 2 * wide)
    digest.update(pcm)
    fits = head + 2 * wide < CELL
    for part in resampled([features.add(samples[0])] if isinstance(samples, list) else (features.add(x) for x in samples)):
        piece = part.astype("<i2", copy=False).tobytes()
        crc = zlib.crc32(piece, crc)
        digest.update(piece)
        if fits:
            pcm += piece
    return {
        "payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "tail_crc32": zlib.crc32(data[-16:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": features.text(codec or "pcm", crc), "pcm_bytes": head + 2 * wide, "pcm_sha256": digest.hexdigest(), "pcm": pcm if fits else None,
    }


def describe_media(stored: DataFrame, keep_pcm: bool = True) -> DataFrame:
    """Read stored files (doc_id, n_bytes, media): digests of payload and file, features, and the resampled PCM file with its length and digest."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string" + ", pcm binary" * keep_pcm
    names = [x.split(" ")[0] for x in schema.split(", ")][2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "media"):
            files = [b.column("media")[i].as_buffer() for i in range(b.num_rows)]
            rows = [described(files[0])] if len(files) == 1 else [described(f, x) for f, x in zip(files, decoded_together([read_wav(f) for f in files]), strict=True)]
            kinds = {"payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "pcm_bytes": pa.int64(), "pcm": pa.binary()}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_bytes": b.column("n_bytes")} | {c: pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names})

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def telephony_media(docs: DataFrame, keep_pcm: bool = True) -> DataFrame:
    """Store every text as a telephony WAVE file in the shared folder, then read the stored files back and describe them."""
    stored = Scratch(docs.sparkSession, "media").table(encode_media(docs), "stored")
    return describe_media(stored, keep_pcm)
