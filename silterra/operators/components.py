"""Connected components of an edge table, each named by its smallest member."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silterra.operators.skew import group_join
from silterra.session import Scratch, prepare

#: Edges that a task solves at a time.
PIECE = 1 << 18


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members and smallest member of each component, by label propagation with pointer jumping."""
    ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            return ids, ids[root]


def _forest(edges: DataFrame, piece: int) -> DataFrame:
    """Stars of the same components, in pieces of each partition: a forest has fewer edges than nodes."""
    prepare(edges.sparkSession)

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        ids, roots = union_find(t["u"].to_numpy(), t["v"].to_numpy())
        far = ids != roots
        return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(roots[far])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for i in range(0, len(b), piece):
                held.append(b.slice(i, piece))
                n += len(held[-1])
                if n >= piece:
                    yield solve(held)
                    held, n = [], 0
        if n:
            yield solve(held)

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _least(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(u, v, m)`` of each edge: m is the least of u and its neighbours."""
    least = scratch.write(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), name)
    return group_join(edges, least, ["u"], edges.count())


def _large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both, scratch, name).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    rows = _least(edges, scratch, name)
    return rows.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a node without other edges to its component's smallest member."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))
    nodes = edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("down"))
    return not nodes.where("up > 1 or (up = 1 and down = 0)").head(1)


def connected_components(edges: DataFrame, piece: int = PIECE) -> DataFrame:
    """``(doc_id, cc_id)`` for every id that an edge ``(u, v)`` names; ``cc_id`` is the smallest id of the component.

    Each partition's edges become a forest, then rounds of large-star and small-star join the partitions' forests until every edge leads
    to its component's smallest member; a single partition is such a state at once. The plan is the same at every size.

    Edges with a null end and loops are ignored, so a node that has only these is absent from the result; repeated and reversed edges
    count once; an empty edge table gives an empty result.
    """
    scratch = Scratch(edges.sparkSession)
    clean = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null and u <> v")
    now = scratch.write(_forest(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), piece), "edges-0")
    turn = 0
    while not _settled(now):
        turn += 1
        large = scratch.write(_large_star(now, scratch, f"large-{turn}"), f"between-{turn}")
        now = scratch.write(_forest(_small_star(large, scratch, f"small-{turn}"), piece), f"edges-{turn}")
        for done in (f"edges-{turn - 1}", f"large-{turn}", f"between-{turn}", f"small-{turn}"):
            scratch.drop(done)
    return now.select(F.col("u").alias("doc_id"), F.col("v").alias("cc_id")).union(now.select(F.col("v").alias("doc_id"), F.col("v").alias("cc_id")).distinct())
