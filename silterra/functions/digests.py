"""MD5 of many short pieces of one buffer at once."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Pieces that are hashed at a time, and the bytes that fit in a single block of MD5; longer pieces are hashed one by one.
LANES, SHORT = 1 << 14, 55
_TURN = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINE = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Of a word of which -1 (none, and the end came before) to 4 bytes belong to the piece: the bytes to keep, and the bit that ends the piece.
_KEEP = np.array([0, 0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_END = np.array([0, 0x80, 0x8000, 0x800000, 0x80000000, 0], np.uint32)


def _block(m: list[np.ndarray | None], n: int, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the digests of n single blocks, given by words (None: zeros); the second is only right if ``both``."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _BEGIN)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    # The first word is complete three rounds before the end.
    for i in range(64 if both else 61):
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            k = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += np.uint32(_SINE[i])
        if m[k] is not None:
            f += m[k]
        np.left_shift(f, np.uint32(_TURN[i]), out=t)
        np.right_shift(f, np.uint32(32 - _TURN[i]), out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    first, second = (a, b) if both else (b, a)
    return first + np.uint32(_BEGIN[0]), second + np.uint32(_BEGIN[1])


def md5_words(raw: memoryview, start: np.ndarray, end: np.ndarray, both: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The first and, if ``both``, the second four bytes of the MD5 of each ``raw[start:end]``, as little-endian numbers."""
    size = end - start
    first, second = np.empty(len(size), np.uint32), np.empty(len(size), np.uint32)
    for k in np.flatnonzero(size > SHORT).tolist():
        first[k], second[k] = np.frombuffer(hashlib.md5(raw[start[k] : end[k]]).digest()[:8], "<u4")
    short = np.flatnonzero(size <= SHORT)
    # By length, so that most blocks have few words.
    short = short[np.argsort(size[short].astype(np.uint8), kind="stable")]
    padded = bytes(raw) + bytes(SHORT + 9)
    word = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,)).copy()
    for i in range(0, len(short), LANES):
        at = short[i : i + LANES]
        n, low = size[at].astype(np.int32), start[at]
        m: list[np.ndarray | None] = [None] * 16
        for j in range(int(n[-1]) // 4 + 1):
            m[j] = word[low + 4 * j]
            if 4 * j + 4 > n[0]:
                some = np.clip(n - 4 * j, -1, 4) + 1
                m[j] = m[j] & _KEEP[some] | _END[some]
        m[14] = (n * 8).astype(np.uint32)
        first[at], second[at] = _block(m, len(at), both)
    return first, second
