"""Image watermarks in the low-frequency band: Haar wavelet, then 4x4 cosine blocks.

A block's largest coefficient but the first is moved to a quarter (bit 0) or three quarters (bit 1)
of its quantisation step; blocks carry the payload's bits in turn, and reading takes each bit's
majority. Plain numpy; all blocks of an image at once."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

SCALES = (0.0, 36.0, 36.0)
BLOCK = 4
MIN_PIXELS = 65_536
_YUV = np.array([[0.114, 0.587, 0.299], [0.436, -0.289, -0.147], [-0.1, -0.515, 0.615]])
_K = np.arange(BLOCK)
_DCT = np.sqrt(2 / BLOCK) * np.cos(np.pi * (2 * _K[None, :] + 1) * _K[:, None] / (2 * BLOCK))
_DCT[0] /= np.sqrt(2)


def too_small(rows: int, columns: int) -> bool:
    return rows * columns < MIN_PIXELS


def _haar(x):
    a, b, c, d = x[::2, ::2], x[::2, 1::2], x[1::2, ::2], x[1::2, 1::2]
    return (a + b + c + d) / 2, (a - b + c - d) / 2, (a + b - c - d) / 2, (a - b - c + d) / 2


def _unhaar(ll, lh, hl, hh):
    out = np.empty((2 * ll.shape[0], 2 * ll.shape[1]))
    out[::2, ::2], out[::2, 1::2] = (ll + lh + hl + hh) / 2, (ll - lh + hl - hh) / 2
    out[1::2, ::2], out[1::2, 1::2] = (ll + lh - hl - hh) / 2, (ll - lh - hl + hh) / 2
    return out


def _blocks(band):
    r, c = band.shape[0] // BLOCK, band.shape[1] // BLOCK
    x = band[: r * BLOCK, : c * BLOCK].reshape(r, BLOCK, c, BLOCK).swapaxes(1, 2).reshape(-1, BLOCK, BLOCK)
    return _DCT @ x @ _DCT.T, (r, c)


def _peak(blocks):
    flat = blocks.reshape(len(blocks), -1)
    at = np.argmax(np.abs(flat[:, 1:]), axis=1) + 1
    return flat, at, flat[np.arange(len(flat)), at]


def _split(image):
    rows, columns = image.shape[0] // 4 * 4, image.shape[1] // 4 * 4
    return image[:rows, :columns].astype(float) @ _YUV.T, rows, columns


def encode(image: np.ndarray, payload: bytes) -> np.ndarray:
    """``image`` (rows, columns, blue-green-red) with ``payload`` in it."""
    if too_small(*image.shape[:2]):
        raise ValueError(f"an image needs {MIN_PIXELS} pixels to carry a payload")
    bits = np.unpackbits(np.frombuffer(payload, np.uint8))
    yuv, rows, columns = _split(image)
    for channel, scale in enumerate(SCALES):
        if not scale:
            continue
        ll, *rest = _haar(yuv[:, :, channel])
        blocks, (r, c) = _blocks(ll)
        flat, at, value = _peak(blocks)
        bit = bits[np.arange(len(flat)) % len(bits)]
        moved = (np.abs(value) // scale + 0.25 + 0.5 * bit) * scale
        flat[np.arange(len(flat)), at] = np.where(value >= 0, moved, -moved)
        back = _DCT.T @ flat.reshape(-1, BLOCK, BLOCK) @ _DCT
        ll[: r * BLOCK, : c * BLOCK] = back.reshape(r, c, BLOCK, BLOCK).swapaxes(1, 2).reshape(r * BLOCK, c * BLOCK)
        yuv[:, :, channel] = _unhaar(ll, *rest)
    out = image.copy()
    out[:rows, :columns] = np.clip(np.rint(yuv @ np.linalg.inv(_YUV).T), 0, 255).astype(np.uint8)
    return out


def decode(image: np.ndarray, n_bytes: int) -> bytes:
    """The payload of ``n_bytes`` bytes by majority; a bit without blocks is 0."""
    n = 8 * n_bytes
    yuv, *_ = _split(image)
    votes, seen = np.zeros(n), np.zeros(n)
    for channel, scale in enumerate(SCALES):
        if not scale:
            continue
        blocks, _ = _blocks(_haar(yuv[:, :, channel])[0])
        _, _, value = _peak(blocks)
        at = np.arange(len(value)) % n
        votes += np.bincount(at, np.abs(value) % scale > 0.5 * scale, n)
        seen += np.bincount(at, minlength=n)
    mean = np.divide(votes, seen, out=np.zeros(n), where=seen > 0)
    return np.packbits(mean * 255 > 127).tobytes()


_PNG = b"\x89PNG\r\n\x1a\n"
#: Channels of PNG colour types that have 8-bit samples of their own.
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def read_png(data: bytes) -> np.ndarray:
    """(rows, columns, 3) pixels of a PNG with 8-bit samples that isn't interlaced; grey is spread over
    three channels, transparency is left out."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG")
    at, parts, head = 8, [], None
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            raise ValueError("a chunk of the PNG is damaged")
        if kind == b"IHDR":
            head = (int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), *body[8:13])
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("only PNGs with 8-bit samples, without palette or interlacing")
    columns, rows, wide = head[0], head[1], _CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(rows, 1 + columns * wide)
    out, above = np.zeros((rows, columns, wide), np.uint8), np.zeros((columns, wide), np.uint8)
    for k in range(rows):
        out[k] = above = _unfilter(raw[k, 0], raw[k, 1:].reshape(columns, wide), above)
    return np.repeat(out[:, :, :1], 3, axis=2) if wide < 3 else out[:, :, :3].copy()


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """One row of samples from its filtered form."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, axis=0, dtype=np.uint64).astype(np.uint8)
    if kind == 2:
        return line + above
    out, left, corner = np.empty_like(line), np.zeros(line.shape[1], np.int64), np.zeros(line.shape[1], np.int64)
    for x in range(len(line)):
        up = above[x].astype(np.int64)
        if kind == 3:
            guess = (left + up) // 2
        else:
            near = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
            guess = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
        out[x] = (line[x] + guess) & 255
        left, corner = out[x].astype(np.int64), up
    return out


def decode_images(images: DataFrame, n_bytes: int) -> DataFrame:
    """(path, payload, status) of raw images (path, content, rows, columns); small ones can't say."""

    @F.pandas_udf("binary")
    def run(content: pd.Series, rows: pd.Series, columns: pd.Series) -> pd.Series:
        return pd.Series([None if too_small(r, c) else decode(np.frombuffer(b, np.uint8).reshape(r, c, 3), n_bytes) for b, r, c in zip(content, rows, columns)])

    p = images.select("path", run("content", "rows", "columns").alias("payload"))
    return p.select("path", "payload", F.when(F.col("payload").isNull(), "INCONCLUSIVE").otherwise("PRESENT").alias("status"))
