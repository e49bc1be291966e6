"""Telephony audio columns: G.711 and IMA ADPCM recordings, decoded to resampled PCM.

Companded samples are expanded by lookup tables of 256 entries. ADPCM is sequential within a
block but not between blocks, so numpy decodes one step of every block of a batch at once. The
stored form is a RIFF file whose data chunk is the payload itself, so nothing is lost in storing;
decoding works on the bytes read back from that file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import raw_texts, short_batches

RATE, TARGET_RATE = 8000, 16000
BLOCK = 192
FORMATS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
CODECS = {v: k for k, v in FORMATS.items()}


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    low, exponent = (code & 0x0F) << 4, (code & 0x70) >> 4
    size = np.where(exponent == 0, low + 8, (low + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {"mulaw": _mulaw_table(), "alaw": _alaw_table()}
_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: Signed difference of a step index and a nibble, and the next index: one lookup each.
_NIBBLE = np.arange(16)
_DIFF = (
    (_STEPS[:, None] >> 3)
    + np.where(_NIBBLE & 4, _STEPS[:, None], 0)
    + np.where(_NIBBLE & 2, _STEPS[:, None] >> 1, 0)
    + np.where(_NIBBLE & 1, _STEPS[:, None] >> 2, 0)
) * np.where(_NIBBLE & 8, -1, 1)
_NEXT = np.clip(np.arange(89)[:, None] + _MOVES, 0, 88)
_DIFF, _NEXT = _DIFF.astype(np.int32).reshape(-1), (_NEXT * 16).astype(np.int32).reshape(-1)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(blocks, samples) int16 of mono IMA ADPCM blocks, (blocks, bytes) uint8. A block's first
    four bytes are its predictor and its step index (read as at most 88); each further byte is two
    nibbles, low first. All blocks take each step together."""
    n, width = blocks.shape
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2").reshape(-1).astype(np.int32)
    state = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    out = np.empty((2 * (width - 4) + 1, n), np.int16)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(width - 4):
        for half, nibble in enumerate((codes[k] & 15, codes[k] >> 4)):
            at = state + nibble
            value = np.clip(value + _DIFF[at], -32768, 32767)
            state = _NEXT[at]
            out[2 * k + half + 1] = value
    return np.ascontiguousarray(out.T)


def encode_adpcm(pcm: np.ndarray, block: int = BLOCK) -> bytes:
    """ADPCM blocks of 16-bit samples; the last block repeats the last sample."""
    per = 2 * (block - 4) + 1
    pcm = np.asarray(pcm, np.int32)
    rows = max(1, -(-len(pcm) // per))
    pcm = np.append(pcm, np.full(rows * per - len(pcm), pcm[-1] if len(pcm) else 0)).reshape(rows, per)
    out = np.zeros((rows, block), np.uint8)
    out[:, :2] = pcm[:, 0].astype("<i2").view(np.uint8).reshape(-1, 2)
    value, index = pcm[:, 0].copy(), np.zeros(rows, np.int32)
    for k in range(1, per):
        step, diff = _STEPS[index], pcm[:, k] - value
        code, left = np.where(diff < 0, 8, 0), np.abs(diff)
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            hit = left >= part
            code, left = code | np.where(hit, bit, 0), left - np.where(hit, part, 0)
        value = np.clip(value + _DIFF[index * 16 + code], -32768, 32767)
        index = _NEXT[index * 16 + code] // 16
        out[:, 4 + (k - 1) // 2] |= (code << (4 * ((k - 1) % 2))).astype(np.uint8)
    return out.tobytes()


def store(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A mono RIFF recording whose data chunk is ``payload`` as it is."""
    if codec == "adpcm":
        per = 2 * (BLOCK - 4) + 1
        fmt = struct.pack("<HHIIHHHH", FORMATS[codec], 1, rate, rate * BLOCK // per, BLOCK, 4, 2, per)
        samples = len(payload) // BLOCK * per
    else:
        fmt, samples = struct.pack("<HHIIHHH", FORMATS[codec], 1, rate, rate, 1, 8, 0), len(payload)
    body = b"WAVE" + b"".join(_chunk(k, v) for k, v in ((b"fmt ", fmt), (b"fact", struct.pack("<I", samples)), (b"data", payload)))
    return _chunk(b"RIFF", body)


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def load(media: bytes) -> tuple[str, int, int, bytes]:
    """(codec, rate, block bytes, payload) read back from a stored recording."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF recording")
    at, found = 12, {}
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        found.setdefault(name, media[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    kind, _, rate, _, block = struct.unpack("<HHIIH", found[b"fmt "][:14])
    return CODECS[kind], rate, block, found[b"data"]


def expand(payloads: list[bytes], codec: str, block: int = BLOCK) -> list[np.ndarray]:
    """16-bit samples of each payload of one codec; ADPCM blocks of all payloads together."""
    if codec != "adpcm":
        return [TABLES[codec][np.frombuffer(p, np.uint8)] for p in payloads]
    many = [len(p) // block for p in payloads]
    out, wave, at = [], None, 0
    joined = np.frombuffer(b"".join(p[: n * block] for p, n in zip(payloads, many)), np.uint8).reshape(-1, block)
    wave = decode_adpcm(joined)
    for n in many:
        out.append(wave[at : at + n].reshape(-1))
        at += n
    return out


def resample(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation in whole numbers, so that it gives the same samples on any machine."""
    if rate == target or not len(pcm):
        return pcm
    n = max(1, len(pcm) * target // rate)
    at = np.arange(n, dtype=np.int64) * rate
    left = np.minimum(at // target, len(pcm) - 1)
    right = np.minimum(left + 1, len(pcm) - 1)
    part = at - left * target
    wide = pcm.astype(np.int64)
    return ((wide[left] * (target - part) + wide[right] * part) // target).astype(np.int16)


def pad(raw: bytes, unit: int = BLOCK) -> bytes:
    """``raw`` with spaces appended up to a positive multiple of ``unit``."""
    return raw + b" " * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def codec_of(payload: bytes) -> str:
    """The codec that a payload is taken to be recorded in: by its digest, so equal ones agree."""
    return ("mulaw", "alaw", "adpcm")[zlib.crc32(payload) % 3]


def describe(pcm: np.ndarray, codec: str, rate: int) -> str:
    """Codec, rate, samples, peak, root mean square, zero crossings and a digest of the samples."""
    wide = pcm.astype(np.int64)
    rms = int(np.sqrt(float((wide * wide).mean()))) if len(pcm) else 0
    peak = int(np.abs(wide).max(initial=0))
    crossings = int(((wide[1:] >= 0) != (wide[:-1] >= 0)).sum())
    return f"{codec}:{rate}:{len(pcm)}:{peak}:{rms}:{crossings}:{zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


#: Payload bytes decoded together at most (or one recording, if it is longer).
_TOGETHER = 4 << 20
_FIELDS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("pcm", pa.binary()), ("codec", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
_SQL = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}


def _recorder(codec, target_rate, names):
    schema = pa.schema([f for f in _FIELDS if f[0] in names])

    def rows(ids, raws):
        media = [store(p := pad(r), codec or codec_of(p)) for r in raws]
        back = [load(m) for m in media]
        waves: list = [None] * len(back)
        for kind in FORMATS:
            chosen = [k for k, b in enumerate(back) if b[0] == kind]
            if chosen:
                for k, pcm in zip(chosen, expand([back[k][3] for k in chosen], kind)):
                    waves[k] = resample(pcm, back[k][1], target_rate)
        made = {
            "doc_id": lambda k: ids[k],
            "n_bytes": lambda k: len(raws[k]),
            "media": lambda k: media[k],
            "pcm": lambda k: waves[k].astype("<i2").tobytes(),
            "codec": lambda k: back[k][0],
            "payload_bytes": lambda k: len(back[k][3]),
            "payload_sha256": lambda k: hashlib.sha256(back[k][3]).hexdigest(),
            "tail_crc32": lambda k: zlib.crc32(back[k][3][-16:]),
            "media_bytes": lambda k: len(media[k]),
            "media_sha256": lambda k: hashlib.sha256(media[k]).hexdigest(),
            "feature": lambda k: describe(waves[k], back[k][0], target_rate),
        }
        return pa.RecordBatch.from_arrays([pa.array([made[n](k) for k in range(len(ids))], schema.field(n).type) for n in schema.names], schema=schema)

    def run(batches):
        for batch in batches:
            ids, raws, held = [], [], 0
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                raws.append(raw.as_py())
                held += len(raws[-1])
                if held >= _TOGETHER:
                    yield rows(ids, raws)
                    ids, raws, held = [], [], 0
            if ids:
                yield rows(ids, raws)

    return run


def telephony_columns(docs: DataFrame, codec: str | None = None, target_rate: int = TARGET_RATE, id_col: str = "doc_id", text_col: str = "text", columns=("doc_id", "n_bytes", "codec", "media", "pcm", "feature")) -> DataFrame:
    """Recordings of every row: the stored file, its PCM at ``target_rate`` and features.

    Each whole text's UTF-8 (null: empty), padded with spaces to a positive multiple of a block, is
    the recording's payload, in ``codec`` or, without one, in the codec its digest picks. Features
    come from the bytes read back. Repeated rows and null identifiers are kept; equal texts give
    equal values.
    """
    short_batches(docs.sparkSession)
    names = [n for n, _ in _FIELDS if n in columns]
    schema = ", ".join(f"{n} {_SQL[t]}" for n, t in _FIELDS if n in names)
    return raw_texts(docs, id_col, text_col).mapInArrow(_recorder(codec, target_rate, names), schema)


def telephony_digests(docs: DataFrame, codec: str | None = None, target_rate: int = TARGET_RATE) -> DataFrame:
    """Digests instead of the recordings themselves."""
    return telephony_columns(docs, codec, target_rate, columns=[n for n, _ in _FIELDS if n not in ("media", "pcm")])


def decode_recordings(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", target_rate: int = TARGET_RATE) -> DataFrame:
    """(id, codec, rate, pcm binary) of stored recordings, PCM little-endian 16-bit at
    ``target_rate``. A null or unreadable recording has null codec, rate and pcm."""

    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for v in batch.column(1):
                try:
                    codec, rate, block, payload = load(v.as_py() or b"")
                    pcm = resample(expand([payload], codec, block)[0], rate, target_rate)
                    found = (codec, target_rate, pcm.astype("<i2").tobytes())
                except (ValueError, KeyError, struct.error):
                    found = (None, None, None)
                for c, x in zip(out, found):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], [id_col, "codec", "rate", "pcm"])

    short_batches(media.sparkSession)
    chosen = media.select(F.col(id_col), F.col(media_col).cast("binary").alias("media"))
    return chosen.mapInArrow(run, f"`{id_col}` {chosen.schema[0].dataType.simpleString()}, codec string, rate int, pcm binary")
