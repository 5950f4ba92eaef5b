"""Image tiles: 8-bit PNG without interlacing, in and out, as arrays of (height, width, 4)."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type: grey, RGB, grey with alpha, RGBA. Fixed values.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(pixels: np.ndarray) -> bytes:
    """An RGBA tile."""
    h, w, _ = pixels.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.astype(np.uint8).reshape(h, w * 4)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode(raw: bytes) -> np.ndarray:
    """Pixels as RGBA; grey counts for all three colours, and what has no alpha is opaque."""
    if raw[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, head = 8, b"", b""
    while at + 8 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        head, data = (body, data) if kind == b"IHDR" else (head, data + body) if kind == b"IDAT" else (head, data)
        at += 12 + size
    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if depth != 8 or interlaced or colour not in CHANNELS:
        raise ValueError("an 8-bit image without palette and interlacing is needed")
    n = CHANNELS[colour]
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * n)
    out, above = np.zeros((h, w, n), np.uint8), np.zeros((w, n), np.uint8)
    for y in range(h):
        above = out[y] = _unfiltered(int(rows[y, 0]), rows[y, 1:].reshape(w, n), above)
    colours = out[..., :3] if n > 2 else np.repeat(out[..., :1], 3, axis=2)
    alpha = out[..., -1:] if n in (2, 4) else np.full((h, w, 1), 255, np.uint8)
    return np.concatenate([colours, alpha], axis=2)


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, axis=0, dtype=np.uint64).astype(np.uint8)
    if kind == 2:
        return line + above
    left, corner, out = [0] * line.shape[1], [0] * line.shape[1], []
    for own, up in zip(line.tolist(), above.tolist(), strict=True):
        if kind == 3:
            left = [(x + (a + b) // 2) & 255 for x, a, b in zip(own, left, up, strict=True)]
        else:
            left = [(x + _nearest(a, b, c)) & 255 for x, a, b, c in zip(own, left, up, corner, strict=True)]
        corner = up
        out.append(left)
    return np.array(out, np.uint8)


def _nearest(a: int, b: int, c: int) -> int:
    """Of left, above and above left the one nearest to left + above - above left."""
    p = a + b - c
    return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
