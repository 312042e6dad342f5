"""What is done with components: prune, annotate, subsample, compare; and documents made of several rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silterra.config import MinHashConfig
from silterra.functions import text as T
from silterra.functions.digests import md5_words
from silterra.operators.minhash import shingle_bounds
from silterra.operators.skew import by_runs, free_name, group_join, ranked
from silterra.session import Scratch, prepare

#: Classes, or bytes of their shingles' hashes, of a block that meets others; and distinct shingles that are counted at a time.
BLOCK, BLOCK_BYTES, WIDE = 64, 4 << 20, 1 << 13


def kill_list(components: DataFrame) -> DataFrame:
    """``(doc_id)`` of all but the least member of each component."""
    return components.where("doc_id <> cc_id").select("doc_id")


def prune(docs: DataFrame, components: DataFrame) -> DataFrame:
    """docs without those that ``kill_list`` names; rows that repeat an id stay or go together."""
    gone = kill_list(components).select(F.col("doc_id").alias(f"{free_name(docs)}doc"))
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone[gone.columns[0]], "left_anti")


def positions(components: DataFrame) -> DataFrame:
    """``(doc_id, cc_id, cc_size, cc_idx)`` of each member; rows that repeat a member count once. A component may hold any share of all rows."""
    rows = Scratch(components.sparkSession).write(components.select("doc_id", F.col("cc_id").alias("key")).distinct(), "members")
    return ranked(rows, "key").select("doc_id", F.col("key").alias("cc_id"), "cc_size", "cc_idx")


def annotate(docs: DataFrame, components: DataFrame, name: str = "minhash") -> DataFrame:
    """docs with a struct of component id, size and position; one in no component is its own, of size 1. Rows that repeat an id have the same."""
    free = free_name(docs)
    found = positions(components).select(F.col("doc_id").alias(f"{free}doc"), F.struct("cc_id", "cc_size", "cc_idx").alias(f"{free}found"))
    alone = F.struct(docs["doc_id"].alias("cc_id"), F.lit(1).cast("long").alias("cc_size"), F.lit(0).cast("long").alias("cc_idx"))
    joined = docs.join(found.hint("shuffle_hash"), docs["doc_id"] == found[f"{free}doc"], "left")
    return joined.select(*[docs[c] for c in docs.columns if c != name], F.coalesce(f"{free}found", alone).alias(name))


def shingle_sets(docs: DataFrame, config: MinHashConfig) -> DataFrame:
    """``(cc_id, doc_id, size, digest, hashes)`` of documents with ``cc_id``: the sorted 64-bit hashes of the distinct shingles."""
    n, cut = max(1, config.ngram_size), T.cutter(config.tokenizer, config.vocabulary)
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for b, raw, *bounds in T.token_bounds(whole, cut):
                first, low, high = shingle_bounds(*bounds, n)
                left, right = md5_words(raw, low, high, both=True)
                h = left.astype(np.uint64) << np.uint64(32) | right
                sets = [np.unique(h[a:z]) for a, z in zip(first[:-1], first[1:], strict=True)]
                columns = [pa.array([len(x) for x in sets], pa.int64()), pa.array([xxhash.xxh3_128_hexdigest(x) for x in sets]), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*b.columns, *columns], ["cc_id", "doc_id", "size", "digest", "hashes"])

    text = docs.where(F.col(config.content_key).isNotNull())
    return T.with_tokens(text, config.content_key, config.tokenizer, config.vocabulary, ("cc_id", "doc_id")).mapInArrow(run, "cc_id long, doc_id long, size long, digest string, hashes binary")


def _overlaps(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``(cc_id, doc_a, doc_b, n_inter, n_union)`` of the pairs within each run; of a pair of blocks, across these."""
    cc, ids, size, block, low, high = (t[c].to_numpy() for c in ("cc_id", "doc_id", "size", "block", "low", "high"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["hashes"]]
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    for a, z in zip(starts, np.append(starts[1:], len(t)), strict=True):
        _, number = np.unique(np.concatenate(sets[a:z]), return_inverse=True)
        owner = np.repeat(np.arange(z - a), size[a:z])
        both = np.zeros((z - a, z - a))
        order = np.argsort(number, kind="stable")
        number, owner = number[order], owner[order]
        cuts = np.searchsorted(number, np.arange(0, number[-1] + WIDE, WIDE)) if len(number) else [0]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            m = np.zeros((z - a, WIDE), np.float32)
            m[owner[i:j], number[i:j] % WIDE] = 1
            both += m @ m.T
        x, y = np.triu_indices(z - a, 1)
        if low[a] != high[a]:
            across = block[a + x] != block[a + y]
            x, y = x[across], y[across]
        n = both[x, y].astype(np.int64)
        for k, v in enumerate((np.full(len(x), cc[a]), np.minimum(ids[a + x], ids[a + y]), np.maximum(ids[a + x], ids[a + y]), n, size[a + x] + size[a + y] - n)):
            out[k].append(v)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], ["cc_id", "doc_a", "doc_b", "n_inter", "n_union"])


def true_jaccard(docs: DataFrame, components: DataFrame, config: MinHashConfig) -> DataFrame:
    """``(cc_id, doc_a, doc_b, n_inter, n_union, jaccard)`` within components, over distinct shingles.

    Documents with the same shingles are a class: its least id is paired with that of every other class, and with each other member of its own.
    Sets are made once; a component's classes meet in pairs of blocks of about ``BLOCK`` of them or ``BLOCK_BYTES``. Rows that repeat an id have
    its least set. A null text has no set.
    """
    scratch = Scratch(docs.sparkSession)
    member = components.select("doc_id", "cc_id").distinct().hint("shuffle_hash")
    sets = scratch.write(shingle_sets(docs.select("doc_id", config.content_key).join(member, "doc_id"), config), "sets")
    of_id = sets.groupBy("cc_id", "doc_id").agg(F.min(F.struct("digest", "size")).alias("s")).select("cc_id", "doc_id", "s.*")
    of_id = scratch.write(of_id, "ids")
    classes = scratch.write(of_id.groupBy("cc_id", "digest").agg(F.min("doc_id").alias("doc_a"), F.min("size").alias("size"), F.count("*").alias("n")), "classes")
    copies = group_join(of_id.select("cc_id", "digest", F.col("doc_id").alias("doc_b")), classes.where("n > 1"), ["cc_id", "digest"], of_id.count()).where("doc_a <> doc_b")
    shape = classes.groupBy("cc_id").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(8 * F.sum("size") / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    placed = group_join(classes.select("cc_id", F.col("doc_a").alias("doc_id"), "digest"), scratch.write(shape, "shape"), ["cc_id"], classes.count())
    of_class = sets.groupBy("cc_id", "doc_id", "digest").agg(F.first("size").alias("size"), F.first("hashes").alias("hashes"))
    rows = of_class.join(placed.hint("shuffle_hash"), ["cc_id", "doc_id", "digest"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cc_id", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc_id", "size", "hashes")
    pairs = by_runs(rows, ["cc_id", "low", "high"], _overlaps, "cc_id long, doc_a long, doc_b long, n_inter long, n_union long")
    pairs = pairs.union(copies.select("cc_id", "doc_a", "doc_b", F.col("size").alias("n_inter"), F.col("size").alias("n_union")))
    return pairs.withColumn("jaccard", F.round(F.col("n_inter") / F.col("n_union"), 6))


def surviving_groups(sizes: DataFrame, rate: float, max_size: int | None = None, seed: int = 0) -> DataFrame:
    """``(cc_id)`` of the groups that a sample of whole groups keeps: none above ``max_size``, the others by a hash of seed and id below rate."""
    kept = sizes if max_size is None else sizes.where(F.col("cc_size") <= F.lit(max_size))
    return kept.where(drawn(F.col("cc_id"), rate, seed)).select("cc_id")


def drawn(group: Column, rate: float, seed: int) -> Column:
    """Whether a sample has the group if it isn't too large."""
    return T.hash31(F.concat(F.lit(f"{seed}:"), group.cast("string"))) < F.lit(rate * T.PRIME)


def dup_aware_subsample(annotated: DataFrame, field: str, rate: float, max_size: int | None = None, seed: int = 0) -> DataFrame:
    """The rows of annotated whose group is kept: a group's rows stay or go together. Sizes are counted anew."""
    tagged = annotated.withColumn("__cc", F.col(field)["cc_id"])
    sizes = tagged.groupBy(F.col("__cc").alias("cc_id")).agg(F.count("*").alias("cc_size"))
    kept = surviving_groups(sizes, rate, max_size, seed)
    return tagged.join(kept, tagged["__cc"] == kept["cc_id"], "left_semi").drop("__cc")


def concat_ids(rows: DataFrame, keys: list[Column], path: str = "path_id", line: str = "line_num") -> DataFrame:
    """rows with ``group_line``: the first line of the run of neighbouring rows of a file that have the same keys."""
    file = Window.partitionBy(path).orderBy(line)
    same = F.lit(True)
    for k in keys:
        same = same & k.eqNullSafe(F.lag(k).over(file))
    first = (F.row_number().over(file) == 1) | ~same
    return rows.withColumn("group_line", F.max(F.when(first, F.col(line))).over(file.rowsBetween(Window.unboundedPreceding, 0)))


def concat_groups(rows: DataFrame, keys: list[Column], text: str = "text", path: str = "path_id", line: str = "line_num") -> DataFrame:
    """``(path, group_line, text)``: the texts of each run, in the order of lines, with line breaks between; null texts are skipped."""
    runs = concat_ids(rows, keys, path, line).groupBy(path, "group_line").agg(F.sort_array(F.collect_list(F.struct(line, text))).alias("__rows"))
    return runs.select(path, "group_line", F.array_join(F.col("__rows")[text], "\n").alias("text"))


def concat_prune(rows: DataFrame, killed: DataFrame, keys: list[Column], path: str = "path_id", line: str = "line_num") -> DataFrame:
    """rows without the killed lines ``(path, line)`` and without the later rows of a file that have a killed line's keys."""
    dead = killed.select(F.col(path).alias("__path"), F.col(line).alias("__line")).distinct()
    marked = rows.join(dead, (rows[path] == dead["__path"]) & (rows[line] == dead["__line"]), "left")
    seen = Window.partitionBy(path, *keys).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("__dead", F.max(F.col("__line").isNotNull()).over(seen)).where("not __dead").drop("__dead", "__path", "__line")
