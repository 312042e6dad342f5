"""MinHash vectors, band signatures, groups of equal bands and their components."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silterra.config import MinHashConfig
from silterra.functions import text as T
from silterra.functions.digests import md5_words
from silterra.operators.components import connected_components
from silterra.operators.skew import group_join
from silterra.session import Scratch, prepare

#: Residues that are permuted at a time.
PIECE = 1 << 15


def permutations(config: MinHashConfig) -> list[tuple[int, int]]:
    """The pairs (a, b) of ``x -> (a * x + b) mod PRIME``."""
    rng = random.Random(config.hash_seed)
    return [(rng.randrange(1, T.PRIME), rng.randrange(T.PRIME)) for _ in range(config.num_bands * config.band_size)]


def residues(starts: np.ndarray, ends: np.ndarray, raw: memoryview, portable: bool) -> np.ndarray:
    """A hash below ``PRIME`` of each piece of raw: the first 32 bits of its MD5, which other engines have too, or of a cheaper hash."""
    if portable:
        x = md5_words(raw, starts, ends)[0].byteswap().astype(np.uint64)
    else:
        import xxhash

        x = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    return x % np.uint64(T.PRIME)


def shingle_bounds(start: np.ndarray, end: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first shingle of each text, start, end)`` of every run of n tokens, from the bounds of ``token_bounds``; see ``functions.text.shingles``."""
    tokens = np.diff(at)
    runs = np.maximum(1, tokens - (n - 1))
    first = np.append(0, np.cumsum(runs))
    low = np.repeat(at[:-1] - first[:-1], runs) + np.arange(first[-1])
    high = np.minimum(low + n, np.repeat(at[1:], runs)) - 1
    # A text without tokens has one shingle, of nothing.
    some = np.repeat(tokens > 0, runs)
    low, high = np.where(some, low, len(start)), np.where(some, high, len(start))
    return first, np.append(start, 0)[low], np.append(end, 0)[high]


def least_permuted(x: np.ndarray, starts: np.ndarray, ab: list[tuple[int, int]], out: np.ndarray) -> None:
    """Into out, for each run of x and each (a, b), the least of ``(a * x + b) mod PRIME``.

    The residue is that share of ``PRIME`` which the fraction of ``(a * x + b) / PRIME`` is, and 64 bits after the point tell residues apart: they lie
    2**33 from each other and the rounding of a / PRIME moves a product by 2**30 at most. Half a step is added so that none falls below its residue;
    the first bit is turned, as comparisons are of signed numbers.
    """
    v, x = np.empty(len(x), np.int64), x.astype(np.int64)
    least = np.empty((len(ab), len(starts)), np.int64)
    for k, (a, b) in enumerate(ab):
        factor, shift = (((y << 65) // T.PRIME + 1) >> 1 for y in (a, b))
        np.multiply(x, _signed(factor), out=v)
        v += _signed(shift + (1 << 32) + (1 << 63))
        np.minimum.reduceat(v, starts, out=least[k])
    w = least.view(np.uint64) ^ np.uint64(1 << 63)
    out[:] = ((w - (w >> np.uint64(31))) >> np.uint64(33)).T


def _signed(x: int) -> np.int64:
    return np.int64((x + (1 << 63)) % (1 << 64) - (1 << 63))


def _with_vectors(docs: DataFrame, config: MinHashConfig, use: Callable[[pa.Array, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``use`` makes of ids and vectors: the least permuted hash of each document's shingles, for each permutation. A document without text
    (null) has none.

    Texts are cut many at once; tokens and shingles exist only as bounds in their bytes.
    """
    ab = permutations(config)
    n, cut = max(1, config.ngram_size), T.cutter(config.tokenizer, config.vocabulary)
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, raw, *bounds in T.token_bounds(whole, cut):
                first, low, high = shingle_bounds(*bounds, n)
                x = residues(low, high, raw, config.portable)
                out = np.empty((len(b), len(ab)), np.int64)
                i = 0
                while i < len(b):
                    j = max(i + 1, int(np.searchsorted(first, first[i] + PIECE, "right")) - 1)
                    least_permuted(x[first[i] : first[j]], first[i:j] - first[i], ab, out[i:j])
                    i = j
                yield use(b.column(0), out)

    text = docs.where(F.col(config.content_key).isNotNull())
    return T.with_tokens(text, config.content_key, config.tokenizer, config.vocabulary).mapInArrow(run, schema)


def minhash_vectors(docs: DataFrame, config: MinHashConfig) -> DataFrame:
    """``(doc_id, h)``, see ``_with_vectors``."""

    def lists(ids: pa.Array, out: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], ["doc_id", "h"])

    return _with_vectors(docs, config, lists, "doc_id long, h array<long>")


def band_keys(docs: DataFrame, config: MinHashConfig) -> DataFrame:
    """``(doc_id, band, sig)`` as ``band_signatures`` has them, with 16 bytes that are equal where its MD5s are: half as long, and made where vectors are."""

    def keys(ids: pa.Array, out: np.ndarray) -> pa.RecordBatch:
        import xxhash

        n, step = len(out), 8 * config.band_size
        raw = memoryview(out[:, : config.num_bands * config.band_size].tobytes())
        sig = b"".join([xxhash.xxh3_128_digest(raw[i : i + step]) for i in range(0, len(raw), step)]) if step else bytes(16 * n * config.num_bands)
        sigs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n * config.num_bands, [None, pa.py_buffer(sig)]).cast(pa.binary())
        band = pa.array(np.tile(np.arange(config.num_bands, dtype=np.int32), n))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(n), config.num_bands))), band, sigs], ["doc_id", "band", "sig"])

    return _with_vectors(docs, config, keys, "doc_id long, band int, sig binary")


def shingle_digests(docs: DataFrame, config: MinHashConfig) -> DataFrame:
    """``(doc_id, n_shingles, digest)``: of the distinct shingles in the order of their first places the number and an MD5. A null text has no row."""
    n, cut = max(1, config.ngram_size), T.cutter(config.tokenizer, config.vocabulary)
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, raw, *bounds in T.token_bounds(whole, cut):
                first, low, high = shingle_bounds(*bounds, n)
                data, low, high = bytes(raw), low.tolist(), high.tolist()
                sets = (dict.fromkeys([data[x:y] for x, y in zip(low[a:z], high[a:z], strict=True)]) for a, z in zip(first[:-1], first[1:], strict=True))
                found = [(len(s), hashlib.md5(b"\x1e".join(s)).hexdigest()) for s in sets]
                columns = [pa.array([k for k, _ in found], pa.int64()), pa.array([d for _, d in found], pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_shingles", "digest"])

    text = docs.where(F.col(config.content_key).isNotNull())
    return T.with_tokens(text, config.content_key, config.tokenizer, config.vocabulary).mapInArrow(run, "doc_id long, n_shingles long, digest string")


def band_signatures(vectors: DataFrame, config: MinHashConfig) -> DataFrame:
    """``(doc_id, band, sig)``: an MD5 of each band's rows."""
    rows = config.band_size
    sig = F.transform(F.sequence(F.lit(0), F.lit(config.num_bands - 1)), lambda k: F.md5(F.array_join(F.transform(F.slice("h", k * rows + 1, rows), lambda h: h.cast("string")), ",")))
    return vectors.select("doc_id", F.posexplode(sig).alias("band", "sig"))


def star_edges(signatures: DataFrame) -> DataFrame:
    """``(u, v)``: each member of a group with equal band and signature, and the group's least member. Groups are counted before anything is shuffled."""
    rows = Scratch(signatures.sparkSession).write(signatures.select("doc_id", "band", "sig"), "signatures")
    groups = rows.groupBy("band", "sig").agg(F.min("doc_id").alias("v"), F.count("*").alias("n")).where("n > 1")
    groups = Scratch(signatures.sparkSession).write(groups, "groups")
    return group_join(rows, groups, ["band", "sig"], rows.count()).where("doc_id <> v").select(F.col("doc_id").alias("u"), "v").distinct()


def fuzzy_components(docs: DataFrame, config: MinHashConfig) -> DataFrame:
    """``(doc_id, cc_id)`` of every document in a group of two or more; in ``exact`` mode groups have the same raw text."""
    if config.mode == "exact":
        from silterra.operators.exact import text_groups

        found = text_groups(docs, config.content_key).where("cc_size > 1")
        return found.groupBy("doc_id").agg(F.min("cc_id").alias("cc_id"))
    return connected_components(star_edges(band_keys(docs, config)))
