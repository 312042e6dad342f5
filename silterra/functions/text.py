"""Cleaning, tokens, shingles and portable hashes of text columns.

The expressions are Spark's own and stay in the JVM; each has a DuckDB twin in ``plans.oracles``. A null text gives null all through.
"""

from __future__ import annotations

import functools
import os
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: A prime below 2**31: a product of two residues fits in a bigint.
PRIME = (1 << 31) - 1
SEPARATOR = "\x1f"
WORD = r"[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]"
#: Characters of which cleaned text has the same cuts by ``WORD`` and by UAX 29: Latin, Greek and Cyrillic letters, ASCII digits, spaces, and
#: signs that stand alone by both. Texts with any other (unspaced scripts, marks, quotes within words, emoji) are cut by UAX 29 itself.
PLAIN = r"\u0020-\u0021\u0023-\u0026\u0028-\u002b\u002d\u002f-\u0039\u003c-\u005e\u0060-\u007e\u00a1-\u00ac\u00ae-\u00b1\u00b4-\u00b6\u00ba-\u00bb\u00bf-\u024f\u0386\u0388-\u038a\u038c\u038e-\u03a1\u03a3-\u03ce\u0400-\u045f\u0490-\u04e9\u2010-\u2017\u201a-\u2023\u2025-\u2026\u2030-\u203e\u2041-\u2043\u2045-\u2053\u2055-\u205e\u20a0-\u20bf\u2190-\u21ff"


def clean(text: Column) -> Column:
    """Lower case without ASCII punctuation; runs of white space, Unicode's as well, are one space and none at the ends."""
    bare = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def words(cleaned: Column) -> Column:
    """Runs of letters, digits and marks, and each other character by itself, spaces included: Unicode's words if all characters are ``PLAIN``."""
    return F.regexp_extract_all(cleaned, F.lit(WORD), F.lit(0))


def boundary_cut(text: str | None) -> list[str] | None:
    """The pieces between Unicode's word boundaries (UAX 29)."""
    import regex

    return None if text is None else [x for x in regex.split(r"(?V1w)\b", text) if x]


@F.arrow_udf(returnType=ArrayType(StringType()))
def _boundary_cuts(text: pa.Array) -> pa.Array:
    return pa.array([boundary_cut(t) for t in text.to_pylist()], pa.list_(pa.string()))


def segments(text: Column) -> Column:
    """The cleaned text's pieces between Unicode's word boundaries; only texts that ``words`` may cut otherwise leave the JVM."""
    odd = let(clean(text), lambda c: F.when(F.regexp_like(c, F.lit(f"[^{PLAIN}]")), c))
    return F.coalesce(_boundary_cuts(odd), words(clean(text)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once: what a lambda captures is evaluated for each element else."""
    return F.element_at(F.transform(F.array(value), use), 1)


def utf8_bytes(cleaned: Column) -> Column:
    """The numbers of the UTF-8 bytes."""
    pairs = F.regexp_extract_all(F.hex(F.encode(cleaned, "utf-8")), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def shingles(tokens: Column, n: int, distinct: bool = True) -> Column:
    """Every run of n tokens; fewer tokens, if only none, are one shingle. n below 1 is as 1."""
    n = max(1, n)

    def of(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t) - (n - 1))), lambda i: F.array_join(F.slice(t, i, n), SEPARATOR))
        return F.array_distinct(runs) if distinct else runs

    return let(tokens, of)


def hash31(text: Column) -> Column:
    """A hash below ``PRIME`` that other engines have too: the first 32 bits of the MD5."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(PRIME))


#: The vocabulary file of each byte-pair tokenizer, and the pattern it splits text by (None: that of the folder's module).
BYTE_PAIRS: dict[str, tuple[str, str | None]] = {
    "bpe": ("byte_bpe_50k.tiktoken", None),
    "p50k": ("p50k_base.tiktoken", r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""),
    "cl100k": ("cl100k_base.tiktoken", r"""(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"""),
}


def _vocabulary(tokenizer: str, folder: str | None) -> tuple[str, str, str | None]:
    """``(folder, file, pattern)`` of a byte-pair tokenizer; an error if its vocabulary isn't in the folder."""
    file, pattern = BYTE_PAIRS[tokenizer]
    if folder is None or not os.path.isfile(f"{folder}/{file}"):
        raise ValueError(f"tokenizer {tokenizer} needs the vocabulary {file}; the folder given by the setting vocabulary ({folder}) hasn't got it")
    return folder, file, pattern


def cutter(tokenizer: str, vocabulary: str | None = None) -> Callable[[str], list[str]] | None:
    """What makes byte pairs, as numbers, of a cleaned text; None for other tokenizers."""
    if tokenizer not in BYTE_PAIRS:
        return None
    where = _vocabulary(tokenizer, vocabulary)
    return lambda text: [str(x) for x in bpe_encoding(*where).encode_ordinary(text)]


def byte_pairs(text: Column, tokenizer: str, folder: str | None) -> Column:
    """Byte-pair ids of the cleaned text as strings."""
    cut = cutter(tokenizer, folder)
    assert cut is not None

    @F.arrow_udf(returnType=ArrayType(StringType()))
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else cut(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return ids(clean(text))


def tokens(text: Column, tokenizer: str, vocabulary: str | None = None) -> Column:
    """Tokens of a raw text. ``uniseg`` gives Unicode's words, names in ``BYTE_PAIRS`` byte pairs by the folder ``vocabulary``, any other name the bytes.

    A name that is none of these and not ``bytes`` is warned about.
    """
    if tokenizer not in ("uniseg", "bytes", *BYTE_PAIRS):
        warnings.warn(f"no tokenizer is named {tokenizer}: bytes are taken", stacklevel=2)
    if tokenizer in BYTE_PAIRS:
        return byte_pairs(text, tokenizer, vocabulary)
    return segments(text) if tokenizer == "uniseg" else F.transform(utf8_bytes(clean(text)), lambda b: b.cast("string"))


def with_tokens(docs: DataFrame, column: str, tokenizer: str, vocabulary: str | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(keys, tokens, whole)`` for ``token_bounds``: tokens where the JVM makes them, else the text."""
    if tokenizer == "uniseg":
        return docs.select(*keys, F.lit(None).cast("array<string>").alias("tokens"), F.col(column).alias("whole"))
    if tokenizer in BYTE_PAIRS:
        return docs.select(*keys, F.lit(None).cast("array<string>").alias("tokens"), clean(F.col(column)).alias("whole"))
    return docs.select(*keys, tokens(F.col(column), tokenizer, vocabulary).alias("tokens"), F.lit(None).cast("string").alias("whole"))


#: Bytes whose texts are cut at a time in a task.
PIECE = 1 << 18
_PUNCTUATION, _WHITE, _WORD, _OTHER, _IS_PLAIN = 0, 1, 2, 3, 4


@functools.cache
def _classes() -> np.ndarray:
    """Of each code point what ``clean`` and ``words`` take it for, and whether it is ``PLAIN``."""
    import regex

    out = np.full(0x110000, _OTHER, np.uint8)
    for what, pattern in ((_WORD, r"[\p{L}\p{N}\p{M}]"), (_WHITE, r"\p{White_Space}"), (_PUNCTUATION, r"[!-/:-@\[-`{-~]")):
        some = regex.compile(pattern)
        for low in range(0, 0x110000, 0x10000):
            block = "".join(map(chr, range(low, low + 0x10000)))
            out[[low + m.start() for m in some.finditer(block)]] = what
    plain = regex.compile(f"[{PLAIN}]")
    out[[m.start() for m in plain.finditer("".join(map(chr, range(0x10000))))]] |= _IS_PLAIN
    return out


def _cut(texts: list[str]) -> tuple[memoryview, np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes, start, end, first)`` of the tokens of ``segments`` of all texts: bounds in bytes, and the first token of each text."""
    low = [t.lower() for t in texts]
    c = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    begin = np.append(0, np.cumsum([len(t) for t in low]))
    kind = _classes()[c]
    what = kind & 3
    c, kind, what, begin = _keep(what != _PUNCTUATION, begin, c, kind, what)
    # Of a run of white space within a text the first is kept, at its ends none.
    white = what == _WHITE
    again = np.append(False, white[:-1])
    again[begin[:-1][begin[:-1] < len(c)]] = True
    c, kind, what, begin = _keep(~(white & again), begin, c, kind, what)
    last = begin[1:][begin[1:] > begin[:-1]] - 1
    last = last[what[last] == _WHITE]
    if len(last):
        good = np.ones(len(c), bool)
        good[last] = False
        c, kind, what, begin = _keep(good, begin, c, kind, what)
    white = what == _WHITE
    c = np.where(white, np.uint32(32), c)
    word = what == _WORD
    start = np.ones(len(c), bool)
    start[1:] = ~(word[1:] & word[:-1])
    start[begin[:-1][begin[:-1] < len(c)]] = True
    odd = np.flatnonzero((kind < _IS_PLAIN) & ~white)
    for k in np.unique(np.searchsorted(begin, odd, "right") - 1):
        cut = boundary_cut(c[begin[k] : begin[k + 1]].tobytes().decode("utf-32-le"))
        start[begin[k] : begin[k + 1]] = False
        start[begin[k] + np.append(0, np.cumsum([len(x) for x in cut])[:-1])] = True
    at = np.flatnonzero(start)
    first = at + np.arange(len(at))
    ends = np.append(first[1:], len(c) + len(at)) - 1 if len(at) else first
    out = np.full(len(c) + len(at), ord(SEPARATOR), np.uint32)
    text = np.ones(len(out), bool)
    text[ends] = False
    out[text] = c
    first_of = np.searchsorted(at, begin)
    if not len(out) or out.max() < 0x80:
        return memoryview(out.astype(np.uint8).tobytes()), first, ends, first_of
    size = (out >= 0x80).astype(np.uint8) + (out >= 0x800) + (out >= 0x10000) + np.uint8(1)
    byte = np.append(0, np.cumsum(size, dtype=np.int64))
    return memoryview(out.tobytes().decode("utf-32-le").encode()), byte[first], byte[ends], first_of


def _keep(good: np.ndarray, begin: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The good places of columns, and of each text where it begins then."""
    if good.all():
        return *columns, begin
    gone = np.flatnonzero(~good)
    return *(x[good] for x in columns), begin - np.searchsorted(gone, begin)


def _list_bounds(column: pa.ListArray) -> tuple[memoryview, np.ndarray, np.ndarray, np.ndarray]:
    """As ``_cut`` gives it, of lists of tokens."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = pa.concat_arrays([column.flatten()])
    _, where, data = flat.buffers()
    o = np.frombuffer(where, np.int32)[: len(flat) + 1].astype(np.int64) if len(flat) else np.zeros(1, np.int64)
    size = np.diff(o)
    out = np.full(int(size.sum()) + len(flat), ord(SEPARATOR), np.uint8)
    if len(out):
        out[np.arange(int(size.sum())) + np.repeat(np.arange(len(flat)), size)] = np.frombuffer(data, np.uint8)[: o[-1]] if data is not None else 0
    start = np.cumsum(size) - size + np.arange(len(flat))
    return memoryview(out), start, start + size, np.append(0, np.cumsum(n))


def token_bounds(b: pa.RecordBatch, cut: Callable[[str], list[str]] | None) -> Iterator[tuple[pa.RecordBatch, memoryview, np.ndarray, np.ndarray, np.ndarray]]:
    """``(keys, bytes, start, end, first)`` of a batch of ``with_tokens``, by pieces of texts: the tokens' bounds in bytes, which has a separator after each
    token, and each text's first token. cut is what makes tokens of the text; without it they are Unicode's words of the cleaned text."""
    keys, n = b.select(list(range(b.num_columns - 2))), b.num_columns
    text = b.column(n - 1)
    if text.null_count == len(b):
        for i in range(0, len(b), 256):
            yield keys.slice(i, 256), *_list_bounds(b.column(n - 2).slice(i, 256))
        return
    for i, texts in pieces(text):
        part = [t or "" for t in texts]
        yield keys.slice(i, len(part)), *(_cut(part) if cut is None else _list_bounds(pa.array([cut(t) for t in part], pa.list_(pa.string()))))


def pieces(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Where neighbouring texts of ``PIECE`` bytes, or a longer one, begin, and these: a batch has as many as its rows are, whatever they hold."""
    size = np.append(0, np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(size, size[i] + PIECE, "right")) - 1)
        yield i, texts.slice(i, j - i).to_pylist()
        i = j


def joined_tokens(df: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_tokens, tokens)``: the number of ``segments`` and these with ``SEPARATOR`` between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, raw, start, end, first in token_bounds(whole, None):
                none = b.column(1).to_numpy(zero_copy_only=False)
                texts = [None if gone else bytes(raw[start[a] : end[z - 1]]) if z > a else b"" for gone, a, z in zip(none, first[:-1].tolist(), first[1:].tolist(), strict=True)]
                columns = [pa.array(np.diff(first), pa.int64(), mask=none), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], [key, "n_tokens", "tokens"])

    kind = df.schema[key].dataType.simpleString()
    rows = with_tokens(df.select(key, column, F.col(column).isNull().alias("none")), column, "uniseg", keys=(key, "none"))
    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens long, tokens string")


def uniseg_tokens(df: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, tokens)`` by Unicode's word boundaries (UAX 29), with scripts that ``words`` cuts otherwise. White space makes tokens too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, texts in pieces(b.column(1)):
                cut = [boundary_cut(t) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(cut)), pa.array(cut, pa.list_(pa.string()))], [key, "tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, clean(F.col(column)).alias("t")).mapInArrow(run, f"`{key}` {kind}, tokens array<string>")


def bpe_tokens(df: DataFrame, folder: str, file: str = "byte_bpe_50k.tiktoken", column: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, tokens)``: byte-pair ids of the cleaned text, by the vocabulary file in ``folder``, whose pattern its module ``public_tokenizers`` has.

    Strings of special tokens are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe_encoding(folder, file)
        for b in batches:
            for i, texts in pieces(b.column(1)):
                ids = [None if t is None else coder.encode_ordinary(t) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(ids)), pa.array(ids, pa.list_(pa.int32()))], [key, "tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, clean(F.col(column)).alias("t")).mapInArrow(run, f"`{key}` {kind}, tokens array<int>")


@functools.cache
def bpe_encoding(folder: str, file: str, pattern: str | None = None):
    import base64
    import sys

    import tiktoken

    if pattern is None:
        if folder not in sys.path:
            sys.path.append(folder)
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(f"{folder}/{file}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
