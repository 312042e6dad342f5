"""Near duplicates by DartMinHash signatures of weighted word shingles, joined by bands.

Each document is the bag of its shingles of ``SHINGLE`` words, weighted by how often they occur. An element's weight
axis is cut into the regions [0, 1), [1, 2), [2, 4), [4, 8) and on. A hash of element and region throws darts into a
region: the darts' ranks are the arrivals of a Poisson process whose rate is the region's width, and each dart has a
place on the weight axis and a coordinate out of ``COORDINATES``. A document sees the darts below its elements' weights
and, of these, keeps the earliest at each coordinate. The same dart is earliest for two documents with the probability
of their weighted Jaccard similarity, and about k ln k darts are thrown whatever the number of elements.

Documents with one signature are copies; only the smallest id of each such class goes on. Candidates share all darts of a band. Every
candidate pair is compared on the whole signature, or is already known to be in one group: first each bucket's members with
its smallest id, then, in buckets that still hold several groups, all pairs across these, in pairs of blocks of ``SIDE`` members, which
travel with their signatures. Of a pair of blocks only edges that join its groups leave the task. Groups are the components of pairs at or
above the threshold, so nothing is capped and a bucket of thousands of near copies costs one comparison each. Buckets and
classes are counted before they are shuffled, and heavy ones are joined where their rows lie.

Defined results: a document without text (null) or id is in no group. Texts without words, empty ones among them, are
copies of each other. Rows that repeat a ``doc_id`` are one document, like all that any of its texts is like. The smallest id names a group and
is the document that stays. Other columns are not touched. An empty table has no groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silterra.llm.textbytes import U64, mix, occurrences, shingles, text_chunks, words
from silterra.operators.components import connected_components, union_find
from silterra.operators.skew import free_name, group_join
from silterra.session import Scratch, prepare

SHINGLE = 3
COORDINATES = 128
ROWS = 4
THRESHOLD = 0.5
#: Members of a bucket that are compared with as many others at a time.
SIDE = 512
_PAIRS = 1 << 14


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _throw(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, theta: np.ndarray, k: int, best: np.ndarray) -> None:
    """Put into ``best`` the earliest dart of each document's coordinates: rank above, fingerprint below."""
    region = np.zeros(len(doc), np.int64)
    deep = [(doc, key, weight, region)]
    v = 1
    while (more := weight > 2.0 ** (v - 1)).any():
        deep.append((doc[more], key[more], weight[more], np.full(more.sum(), v)))
        v += 1
    doc, key, weight, region = (np.concatenate(x) for x in zip(*deep, strict=True))
    width = np.where(region == 0, 1.0, 2.0 ** (region - 1.0))
    low = np.where(region == 0, 0.0, width)
    seed = mix(key + U64(0x632BE59BD9B4E019) * (region + 1).astype(U64))
    limit, rank = theta[doc], np.zeros(len(doc))
    arrival = 0
    while len(doc):
        arrival += 1
        h = mix(seed + U64(arrival * 0xD1342543DE82EF95 % (1 << 64)))
        rank = rank - np.log(_uniform(h)) / width
        on = rank <= limit
        if not on.all():
            doc, weight, width, low, seed, limit, rank, h = (x[on] for x in (doc, weight, width, low, seed, limit, rank, h))
        dart = mix(h ^ U64(0xA0761D6478BD642F))
        seen = low + width * _uniform(dart) < weight
        d = mix(dart[seen] + U64(0xE7037ED1A0B428DB))
        spot = doc[seen] * k + ((d >> U64(40)) % U64(k)).astype(np.int64)
        value = (rank[seen].astype(np.float32).view(np.uint32).astype(U64) << U64(32)) | (d & U64(0xFFFFFFFF))
        np.minimum.at(best, spot, value)


def dart_minhash(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """The k 32-bit fingerprints of each of n weighted sets, given as rows ``(set, element hash, weight)``."""
    total = np.bincount(doc, weight, n)
    theta = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    none = U64(0xFFFFFFFFFFFFFFFF)
    best = np.full(n * k, none, U64)
    _throw(doc, key, weight.astype(np.float64), theta, k, best)
    while True:  # a coordinate that no dart has hit: look at later darts of those sets
        table = best.reshape(n, k)
        short = (table == none).any(1) & (total > 0)
        if not short.any():
            return (table & U64(0xFFFFFFFF)).astype(np.uint32)
        theta[short] *= 2
        rows = short[doc]
        _throw(doc[rows], key[rows], weight[rows].astype(np.float64), theta, k, best)


def sketch(column: pa.Array, shingle: int = SHINGLE, k: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    """``(fingerprints, shingles)`` of each text."""
    out, size = np.zeros((len(column), k), np.uint32), np.zeros(len(column), np.int64)
    for i, n, buf, offsets in text_chunks(column):
        _, _, h, first = words(buf, offsets)
        doc, key, count = occurrences(*shingles(h, first, shingle))
        out[i : i + n] = dart_minhash(doc, key, count, n, k)
        size[i : i + n] = np.bincount(doc, count, n)
    return out, size


def _fixed(rows: np.ndarray) -> pa.Array:
    at = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def signatures(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, whole, signature, bands)``: signature has 16 bits of each coordinate, bands a hash of each band's darts."""
    prepare(docs.sparkSession)
    schema = "doc_id long, size long, whole long, signature binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, size = sketch(b.column(1))
            bands = COORDINATES // ROWS
            h = np.zeros((len(f), bands), U64) + np.arange(1, bands + 1, dtype=U64)
            for r in range(ROWS):
                h = mix(h * U64(0x9E3779B97F4A7C15) + f[:, r::ROWS].astype(U64))
            whole = np.zeros(len(f), U64)
            for c in range(bands):
                whole = mix(whole * U64(0x9E3779B97F4A7C15) + h[:, c])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * bands), pa.array(h.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(whole.view(np.int64)), _fixed(f.astype(np.uint16)), lists], ["doc_id", "size", "whole", "signature", "bands"])

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    _, where, data = column.buffers()
    wide = pa.types.is_large_binary(column.type)
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.uint16).reshape(len(column), -1)


def similar(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(u, v)`` whose signatures agree at ``threshold`` of the coordinates or more."""
    a = sigs.select(F.col("doc_id").alias("u"), F.col("signature").alias("a"))
    b = sigs.select(F.col("doc_id").alias("v"), F.col("signature").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if len(x):
                same = (_matrix(x.column(2)) == _matrix(x.column(3))).mean(1)
                yield x.select([0, 1]).filter(pa.array(same >= threshold))

    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _forest(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    ids, roots = union_find(u, v) if len(u) else (u, v)
    far = ids != roots
    return pa.RecordBatch.from_arrays([pa.array(ids[far], pa.int64()), pa.array(roots[far], pa.int64())], ["u", "v"])


def compared(t: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Edges of the similar pairs across parts within each run of equal ``(key, low, high)``: of two blocks, pairs across these as well."""
    key, low, high, block, part, ids = (t[c].to_numpy() for c in ("key", "low", "high", "block", "part", "doc_id"))
    sig = _matrix(t["signature"].combine_chunks())
    new = np.append(True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(key)))
    # The first of a pair is before the second in its run, so a row has as many pairs as there are rows after it.
    after = np.repeat(start + size, size) - np.arange(len(key)) - 1
    total = np.append(0, np.cumsum(after))
    us, vs = [], []
    for at in range(0, int(total[-1]), _PAIRS):
        pair = np.arange(at, min(at + _PAIRS, total[-1]))
        a = np.searchsorted(total, pair, "right") - 1
        b = a + 1 + pair - total[a]
        good = (part[a] != part[b]) & ((low[a] == high[a]) | (block[a] != block[b]))
        a, b = a[good], b[good]
        same = (sig[a] == sig[b]).mean(1) >= threshold if len(a) else np.zeros(0, bool)
        us.append(ids[a[same]])
        vs.append(ids[b[same]])
    if us:
        yield _forest(np.concatenate(us), np.concatenate(vs))


def across(open_: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Edges ``(u, v)`` that join the parts of ``(key, doc_id, part, n)`` as all similar pairs across parts of a bucket of n do."""
    blocks = F.ceil(F.col("n") / F.lit(SIDE)).cast("int")
    rows = open_.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc_id", "key"), F.col("blocks")).cast("int"))
    rows = rows.join(sigs.select("doc_id", "signature"), "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "part", "doc_id", "signature")
    run_ = ["key", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if not len(t):
                continue
            same = np.logical_and.reduce([t[c].to_numpy() == t[c][-1].as_py() for c in run_])
            last = len(t) - int(same[::-1].argmin()) if not same.all() else 0
            if last:
                yield from compared(t.slice(0, last), threshold)
            held = t.slice(last)
        if held is not None and len(held):
            yield from compared(held, threshold)

    return rows.repartition(*run_).sortWithinPartitions(*run_).mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, group_id)`` of every document that has a near duplicate; ``group_id`` is the group's smallest id."""
    scratch = Scratch(docs.sparkSession)
    all_ = scratch.write(signatures(docs), "signatures")
    total = all_.count()
    classes = all_.groupBy("size", "whole").agg(F.min("doc_id").alias("v"), F.count("*").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    classes = scratch.write(classes, "classes")
    alike = classes.where("n > 1").select("size", "whole", "v", "n")
    copies = group_join(all_.select("doc_id", "size", "whole"), alike, ["size", "whole"], total).where("doc_id <> v")
    copies = scratch.write(copies.select(F.col("doc_id").alias("u"), "v"), "copies")
    scratch.drop("signatures")
    sigs = classes.select(F.col("v").alias("doc_id"), "signature", "bands")
    banded = sigs.select("doc_id", F.explode("bands").alias("key"))
    keys = scratch.write(banded.groupBy("key").agg(F.min("doc_id").alias("v"), F.count("*").alias("n")).where("n > 1"), "keys")
    buckets = scratch.write(group_join(banded, keys, ["key"], total * (COORDINATES // ROWS)), "buckets")
    tried = scratch.write(buckets.where("doc_id <> v").select(F.col("doc_id").alias("u"), "v").distinct(), "tried")
    found = scratch.write(similar(tried, sigs, threshold), "found")
    part = connected_components(found)
    placed = scratch.write(buckets.join(part, "doc_id", "left").select("key", "doc_id", F.coalesce("cc_id", "doc_id").alias("part")), "placed")
    mixed = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
    open_ = group_join(placed, scratch.write(mixed, "mixed"), ["key"], placed.count())
    rest = scratch.write(across(open_, sigs, threshold), "rest")
    return connected_components(found.union(rest).union(copies)).select("doc_id", F.col("cc_id").alias("group_id"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without those of a group that aren't its smallest id's, with all their columns.

    The ids are shuffled to the documents at every size, as they grow with them; only ids are held in hash tables, and no text is sorted.
    """
    name = f"{free_name(docs)}gone"
    gone = near_duplicates(docs, threshold).where("doc_id <> group_id").select(F.col("doc_id").alias(name)).hint("shuffle_hash")
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")
