"""Exact top-k neighbours of a query set among all vectors by a dual-tree search of cover trees.

Vectors are scaled to length one, so the largest cosine similarity is the smallest distance. Pivots cut the space into cells of about
``cell_size`` vectors, each with vectors near its pivot. A cell is a cover tree: the children of a node are chosen by
farthest-first traversal, so they are at least as far apart as the radius within which they cover the node; every node knows its centre
and the radius that its vectors really need.

Each cell first searches the queries that lie in it, which gives every query a bound: its k-th distance so far. Then queries are searched in
blocks of ``BLOCK_BYTES``, each one a cover tree that is broadcast to a scan of all cells: a pair of a query node and a data node is dropped
when the distance of their centres less both radii is more than the worst k-th distance among the node's queries, level by level, with
the bounds of that moment. Pairs of leaves that remain are compared by matrix products. A block meets every data cell where that lies, so
vectors are shuffled twice whatever the number of queries, and a task sends the k best of each query that are within its bound.

On vectors without any structure in many dimensions hardly a pair can be dropped, and an exact search compares all pairs, by any method.

Defined results: a vector that is null, empty, of length zero, or that has a null or not finite component is neither a query nor a
neighbour. Shorter vectors have zeros at their end. Rows that repeat a ``vec_id`` are one vector, the least of theirs; rows with a null
id are left out. A vector isn't its own neighbour, copies of it are. Similarities are rounded to 9 digits, and of equal ones the
smaller ids are taken. There are fewer than k neighbours if there are fewer vectors. Other columns are not touched.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silterra.session import Scratch, prepare

K = 10
LEAF = 64
FAN = 16
CELL = 4096
CELL_BYTES = 8 << 20
#: Bytes of pivots that are broadcast; with more cells than these allow, cells are larger.
PIVOT_BYTES = 32 << 20
#: Bytes of the queries of a block, which is broadcast: its vectors and the k best of each.
BLOCK_BYTES = 32 << 20
DIGITS = 9
_SLACK = 1e-7
#: Similarities are compared as rounded, so a bound is lower by more than rounding changes.
_ROUNDED = 1e-9


def _unit_rows(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.maximum(np.abs(x).max(1, initial=0), 1e-300)[:, None]
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]


def _distance(similarity: np.ndarray) -> np.ndarray:
    """The distance of unit vectors with this rounded similarity, at most; infinite for a similarity of minus infinity."""
    known = np.isfinite(similarity)
    return np.where(known, np.sqrt(np.maximum(0.0, 2 - 2 * np.where(known, similarity, 0) + 2 * _ROUNDED)), np.inf)


class CoverTree:
    """Unit vectors of raw ones in the order of the tree: each node is a range of them, and its children come after it."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, leaf: int = LEAF):
        x = _unit_rows(raw)
        order = np.arange(len(x))
        begin, end, centre, radius, child = [0], [len(x)], [x[0]], [0.0], [(0, 0)]
        todo = [0]
        while todo:
            node = todo.pop()
            a, z = begin[node], end[node]
            rows = order[a:z].copy()
            d = self._far(x[rows], centre[node])
            radius[node] = float(d.max())
            if z - a <= leaf or radius[node] <= _SLACK:
                continue
            picks, near, owner = [int(d.argmin())], self._far(x[rows], x[rows[d.argmin()]]), np.zeros(z - a, np.int64)
            while len(picks) < FAN and near.max() > radius[node] / 2:
                picks.append(int(near.argmax()))
                new = self._far(x[rows], x[rows[picks[-1]]])
                closer = new < near
                owner[closer], near = len(picks) - 1, np.minimum(near, new)
            if len(picks) == 1:
                continue
            by = np.argsort(owner, kind="stable")
            order[a:z] = rows[by]
            cuts = np.searchsorted(owner[by], np.arange(len(picks) + 1))
            child[node] = (len(begin), len(begin) + len(picks))
            for k, p in enumerate(picks):
                todo.append(len(begin))
                begin.append(a + int(cuts[k]))
                end.append(a + int(cuts[k + 1]))
                centre.append(x[rows[p]])
                radius.append(0.0)
                child.append((0, 0))
        self.order, self.ids, self.raw, self.x = order, ids[order], raw[order], x[order]
        self.begin, self.end, self.child = np.array(begin), np.array(end), np.array(child)
        self.centre, self.radius = np.array(centre), np.array(radius)

    def __getstate__(self) -> dict:
        """Only raw vectors are sent; ``order`` is the builder's."""
        return {k: v for k, v in self.__dict__.items() if k not in ("x", "order")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.x = _unit_rows(self.raw)

    @staticmethod
    def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, ((x - c) ** 2).sum(1)))


class Search:
    """The k best so far of each vector of one query tree, in the tree's order; ``floor`` is what a k-th similarity is at least known to be."""

    def __init__(self, tree: CoverTree, k: int, floor: np.ndarray | None = None):
        self.tree, self.k = tree, k
        self.floor = np.full(len(tree.ids), -np.inf) if floor is None else floor
        self.near = np.full((len(tree.ids), k), -np.inf)
        self.who = np.full((len(tree.ids), k), np.iinfo(np.int64).max)

    def kth(self, rows: slice) -> np.ndarray:
        return np.maximum(self.near[rows, -1], self.floor[rows])

    def worst(self) -> np.ndarray:
        """For each node the worst k-th distance of its vectors, infinite while one has fewer than k neighbours."""
        far = _distance(self.kth(slice(None)))
        nodes, out = self.tree, np.empty(len(self.tree.begin))
        leaves = nodes.child[:, 1] == 0
        starts = np.flatnonzero(leaves)[np.argsort(nodes.begin[leaves], kind="stable")]
        out[starts] = np.maximum.reduceat(far, nodes.begin[starts])
        for node in np.flatnonzero(~leaves)[::-1]:
            out[node] = out[nodes.child[node, 0] : nodes.child[node, 1]].max()
        return out

    def against(self, data: CoverTree) -> None:
        q, r = self.tree, data
        worst = self.worst()
        a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(a):
            apart = np.sqrt(np.maximum(0.0, ((q.centre[a] - r.centre[b]) ** 2).sum(1)))
            low = apart - q.radius[a] - r.radius[b]
            kept = low <= worst[a] + _SLACK
            a, b, low = a[kept], b[kept], low[kept]
            qa, rb = q.child[a, 1] == 0, r.child[b, 1] == 0
            both = qa & rb
            done.append((a[both], b[both], low[both]))
            a, b, qa, rb = a[~both], b[~both], qa[~both], rb[~both]
            # Of a pair that isn't two leaves, each inner node is replaced by its children.
            na, nb = np.where(qa, 1, q.child[a, 1] - q.child[a, 0]), np.where(rb, 1, r.child[b, 1] - r.child[b, 0])
            n = na * nb
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(nb, n)
            a, b = np.where(np.repeat(qa, n), np.repeat(a, n), np.repeat(q.child[a, 0], n) + at // wide), np.where(np.repeat(rb, n), np.repeat(b, n), np.repeat(r.child[b, 0], n) + at % wide)
        a, b, low = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.lexsort((low, a))
        a, b, low = a[order], b[order], low[order]
        for node in np.unique(a):
            mine = slice(*np.searchsorted(a, [node, node + 1]))
            leaves, bounds = b[mine], low[mine]
            at = 0
            while at < len(leaves):
                upto = max(at + 4, len(leaves) // 4) if at == 0 else len(leaves)
                part = leaves[at:upto]
                if at:
                    far = _distance(self.kth(slice(q.begin[node], q.end[node]))).max()
                    part = part[bounds[at:upto] <= far + _SLACK]
                at = upto
                if len(part):
                    self._compare(int(node), np.concatenate([np.arange(r.begin[x], r.end[x]) for x in part]), data)

    def _compare(self, node: int, rows: np.ndarray, data: CoverTree) -> None:
        mine = slice(self.tree.begin[node], self.tree.end[node])
        s = np.round(self.tree.x[mine] @ data.x[rows].T, DIGITS)
        s[self.tree.ids[mine][:, None] == data.ids[rows][None, :]] = -np.inf
        if s.shape[1] > self.k:
            floor = np.maximum(self.kth(mine), np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k])
        else:
            floor = self.kth(mine)
        row, col = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
        if not len(row):
            return
        n = mine.stop - mine.start
        who = np.concatenate([self.who[mine].ravel(), data.ids[rows[col]]])
        near = np.concatenate([self.near[mine].ravel(), s[row, col]])
        owner = np.concatenate([np.repeat(np.arange(n), self.k), row])
        order = np.lexsort((who, -near, owner))
        owner = owner[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        top = order[rank < self.k]
        self.near[mine], self.who[mine] = near[top].reshape(n, self.k), who[top].reshape(n, self.k)


def _arrays(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column, as wide as the widest, and which rows have a direction."""
    n = np.array(column.value_lengths().fill_null(0))
    flat = column.flatten()
    flat = flat if pa.types.is_float32(flat.type) else flat.cast(pa.float64())
    kind = flat.type.to_pandas_dtype()
    values = np.where(np.asarray(flat.is_valid()), flat.fill_null(0.0).to_numpy(zero_copy_only=False), np.nan).astype(kind)
    x = np.zeros((len(column), width), kind)
    row = np.repeat(np.arange(len(column)), n)
    x[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = values
    good = np.isfinite(x).all(1)
    x[~good] = 0
    return x, good & (x != 0).any(1)


def _packed(x: np.ndarray) -> pa.Array:
    at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize))
    return pa.Array.from_buffers(pa.binary(), len(x), [None, at.buffers()[1], pa.py_buffer(np.ascontiguousarray(x).tobytes())])


class Pivots:
    """Unit vectors, in groups around some of them: a vector's pivot is the nearest one of its nearest group."""

    def __init__(self, x: np.ndarray):
        # Neighbouring numbers for neighbouring pivots, as their order makes the blocks of queries.
        self.x = x[np.argsort(x @ np.linalg.svd(x - x.mean(0), full_matrices=False)[2][0], kind="stable")]
        step = max(1, int(len(x) ** 0.5))
        self.heads = self.x[::step]
        owner = (self.x @ self.heads.T).argmax(1)
        self.members = [np.flatnonzero(owner == h) for h in range(len(self.heads))]
        for h, m in enumerate(self.members):  # of equal heads the first has the members
            if not len(m):
                self.members[h] = np.array([min(h * step, len(x) - 1)])

    def nearest(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for i in range(0, len(x), 1024):
            part = x[i : i + 1024]
            head = (part @ self.heads.T).argmax(1)
            for h in np.unique(head):
                rows = np.flatnonzero(head == h)
                out[i + rows] = self.members[h][(part[rows] @ self.x[self.members[h]].T).argmax(1)]
        return out


def neighbours(vectors: DataFrame, k: int = K, queries: Column | None = None, cell_size: int = CELL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(query_id, rank, neighbour_id, similarity)``: the k vectors of the largest cosine similarity to each query.

    ``queries`` is a condition on ``vec_id``; without one every vector is a query.
    """
    spark = prepare(vectors.sparkSession)
    scratch = Scratch(spark)
    schema = "query_id long, rank int, neighbour_id long, similarity double"
    given = vectors.where("vec_id is not null and size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    n, width = given.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return spark.createDataFrame([], schema)
    cell_size = max(64, min(cell_size, CELL_BYTES // (8 * width)))
    pivots = min(-(-n // cell_size), max(1, PIVOT_BYTES // (8 * width)))
    chosen = given.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("embedding").toArrow()
    raw, good = _arrays(chosen["embedding"].combine_chunks(), width)
    centres = Pivots(_unit_rows(raw[good]) if good.any() else np.eye(1, width))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, good = _arrays(b.column(1), width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.nearest(_unit_rows(x))), _packed(x)], ["vec_id", "pivot", "x"]).filter(pa.array(good))

    rows = given.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = scratch.write(rows.mapInArrow(assign, "vec_id long, pivot long, x binary"), "assigned")
    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    rows = rows.withColumn("asked", asked)
    # As many rows as there are pivots.
    sizes = rows.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(2 * cell_size)).alias("parts"), F.count_if("asked").alias("n")).toArrow().sort_by("pivot")
    total = sum(sizes["n"].to_pylist())
    if not total:
        return spark.createDataFrame([], schema)
    blocks = -(-total * (8 * width + 24 * k) // block_bytes)
    before = np.cumsum(sizes["n"].to_numpy()) - sizes["n"].to_numpy()
    places = spark.createDataFrame(sizes.append_column("before", pa.array(before)), "pivot long, parts long, n long, before long")
    rows = rows.join(F.broadcast(places), "pivot").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts"))
    block = F.floor((F.col("before") + F.col("n") * F.col("part") / F.col("parts")) * F.lit(blocks) / F.lit(total))
    rows = rows.withColumn("block", F.least(block, F.lit(blocks - 1))).select("vec_id", "x", "asked", "pivot", "part", "block")
    item = 4 if dict(given.dtypes)["embedding"] == "array<float>" else 8

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        raw = np.frombuffer(b"".join(t["x"].to_pylist()), f"f{item}").reshape(len(t), width)
        ids, mine = t["vec_id"].to_numpy(), np.asarray(t["asked"])
        tree = CoverTree(ids, raw)
        kinds, blobs = [1], [pickle.dumps(tree, 5)]
        if mine.any():
            own = Search(CoverTree(ids[mine], raw[mine]), k)
            own.against(tree)
            kinds, blobs = [1, 0], [*blobs, pickle.dumps((own.tree.ids, own.tree.raw, own.near[:, -1]), 5)]
        return pa.table({"kind": pa.array(kinds, pa.int32()), "block": pa.array(t["block"].to_pylist()[:1] * len(kinds), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    cells = scratch.write(rows.groupBy("pivot", "part").applyInArrow(build, "kind int, block long, blob binary"), "cells")
    scratch.drop("assigned")
    found = "query_id long, neighbour_id long, similarity double"
    for now in range(blocks):
        blobs = [pickle.loads(x) for x in cells.where((F.col("kind") == 0) & (F.col("block") == now)).select("blob").toArrow()["blob"].to_pylist()]
        if not blobs:
            continue
        ids, raw, floor = (np.concatenate(x) for x in zip(*blobs, strict=True))
        tree = CoverTree(ids, raw)
        block_ = spark.sparkContext.broadcast((tree, floor[tree.order]))

        def search(batches: Iterator[pa.RecordBatch], block_=block_) -> Iterator[pa.RecordBatch]:
            s = Search(block_.value[0], k, block_.value[1])
            for batch in batches:
                for blob in batch.column(0):
                    s.against(pickle.loads(blob.as_buffer()))
            hit = s.who.ravel() != np.iinfo(np.int64).max
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(s.tree.ids, k)[hit]), pa.array(s.who.ravel()[hit]), pa.array(s.near.ravel()[hit])], ["query_id", "neighbour_id", "similarity"])

        scratch.append(cells.where("kind = 1").select("blob").mapInArrow(search, found), "found")
        block_.unpersist()
    if "found" not in scratch.paths:
        return spark.createDataFrame([], schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")
    return scratch.read("found", found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "similarity")


#: The rows of the query's query set.
ASKED = "vec_id % 100 = 0"

ORACLE = """
WITH v AS (SELECT vec_id, list_transform(min(embedding), lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, round(list_cosine_similarity(a.e, b.e), 9) AS similarity FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, row_number() OVER w AS rank, neighbour_id, round(similarity, 6) AS similarity FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY similarity DESC, neighbour_id) QUALIFY row_number() OVER w <= 10
"""
