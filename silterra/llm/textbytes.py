"""Arrow string columns as NumPy arrays: bytes, words, word hashes and folded characters of many texts at once.

A word is a run of ASCII letters and digits and of non-ASCII characters, with the letters of ASCII and Latin-1 folded to lower case; a
character of three or more bytes from U+3000 on is a word of its own, so that unspaced scripts have words too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
#: A piece holds fewer texts than this power of two, so that a text's number in it fits beside a hash.
GROUP_BITS = 16
U64 = np.uint64
_PRIME = 0x9E3779B97F4A7C15

FOLD = np.zeros(256, np.uint8)
for _b in range(256):
    if _b >= 0x80 or chr(_b).isalnum():
        FOLD[_b] = ord(chr(_b).lower()) if _b < 0x80 else _b


#: The same words in DuckDB, of a column ``text``.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
WORDS_SQL = f"regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[\\x{{3000}}-\\x{{10FFFF}}][0-9a-z\\x{{80}}-\\x{{2FFF}}]*|[0-9a-z\\x{{80}}-\\x{{2FFF}}]+')"


def fold(buf: np.ndarray) -> np.ndarray:
    """Each byte of a word in lower case, 0 for all others."""
    c = FOLD[buf]
    latin = np.flatnonzero(buf[:-1] == 0xC3) + 1
    upper = (c[latin] >= 0x80) & (c[latin] <= 0x9E) & (c[latin] != 0x97)
    c[latin[upper]] += 0x20
    return c


def text_chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, rows, bytes, offsets)`` for pieces of about ``most`` bytes; a longer text is a piece by itself.

    A null has no bytes, as an empty text; callers that tell them apart look at the column's validity.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        j = min(j, n, i + (1 << GROUP_BITS))
        yield i, j - i, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


_INVERSE = pow(_PRIME, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        m = max(n, CHUNK + 1)
        for k, base in enumerate((_PRIME, _INVERSE)):
            factors = np.full(m, base, U64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, hash, first)`` of all words: byte bounds, 64-bit hashes, and the first word of each text."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    c = fold(buf)
    inside = c != 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start |= c >= 0xE3
    edge = offsets[:-1][np.diff(offsets) > 0]
    start[edge] = inside[edge]
    stop = np.flatnonzero(start | ~inside)
    is_start = start[stop]
    s = stop[is_start]
    e = np.append(stop[1:], n)[is_start]
    up, down = powers(n)
    total = np.zeros(n + 1, U64)
    np.cumsum((c.astype(U64) + U64(1)) * up, out=total[1:])
    h = mix((total[e] - total[s]) * down[s] + (e - s).astype(U64))
    return s, e, h, np.searchsorted(s, offsets)


def _folded() -> np.ndarray:
    import unicodedata

    out = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LNM":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_letters: list[np.ndarray] = []


def characters(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, each run of other characters as one 0, and each text's offsets in them.

    Every text begins and ends with a 0, so that n-grams see where words and texts end.
    """
    if not _letters:
        _letters.append(_folded())
    sep = np.zeros(len(buf) + len(offsets), np.uint8) + 32
    keep = np.ones(len(sep), bool)
    keep[offsets + np.arange(len(offsets))] = False
    sep[keep] = buf
    cp = np.frombuffer(sep.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(sep) + 1, np.int64)
    np.cumsum((sep & 0xC0) != 0x80, out=lead[1:])
    mark = lead[offsets + np.arange(len(offsets))]
    c = np.where(cp < 0x10000, _letters[0][np.minimum(cp, 0xFFFF)], cp)
    kept = c != 0
    kept[1:] |= c[:-1] != 0
    kept[mark] = True
    place = np.zeros(len(c) + 1, np.int64)
    np.cumsum(kept, out=place[1:])
    return c[kept].astype(U64), place[mark]


def occurrences(groups: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(group, key, count)``: groups are a piece's text numbers, of a key's 64 bits the upper 48 count."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    packed = np.sort((groups.astype(U64) << U64(64 - GROUP_BITS)) | (keys >> U64(GROUP_BITS)))
    new = np.flatnonzero(np.append(True, packed[1:] != packed[:-1]))
    counts = np.diff(np.append(new, len(packed)))
    found = packed[new]
    return (found >> U64(64 - GROUP_BITS)).astype(np.int64), mix(found << U64(GROUP_BITS)), counts


def shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(text, hash)`` of every run of n words; a shorter text has one shingle of all its words, if only of none."""
    count = np.diff(first)
    runs = np.maximum(count - n + 1, 1)
    text = np.repeat(np.arange(len(count)), runs)
    start = np.repeat(first[:-1] - np.append(0, np.cumsum(runs)[:-1]), runs) + np.arange(len(text))
    last = np.repeat(first[1:], runs)
    padded = np.append(h, np.zeros(n, U64))
    out = np.zeros(len(text), U64)
    for k in range(n):
        word = np.where(start + k < last, padded[np.minimum(start + k, len(padded) - 1)], U64(k + 1))
        out = mix(out * U64(0x9E3779B97F4A7C15) + word)
    return text, out
