"""Groups of any size: joins and ranks that no key, however many rows it has, can put into one task.

A key with more than one in so many of all rows is heavy. At most so many keys are, so what is kept of each of them can be broadcast whatever the
size of the table; all other groups are small beside a task's share of a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Heavy keys of a join, at most.
SHARE = 4096
#: Heavy keys of a ranking, at most, and ranges of ids that each of their groups is ranked in.
RANKED, RANGES = 256, 256


def group_join(rows: DataFrame, groups: DataFrame, key: list[str], total: int, size: str = "n") -> DataFrame:
    """rows with the columns of their group; ``groups`` has one row for each key and, as ``size``, how many of ``total`` rows it has.

    Rows of heavy keys are joined where they lie, all others by a shuffle. Rows whose key has no group are left out, and so are null keys.
    """
    bar = F.lit(total / SHARE)
    heavy = F.broadcast(groups.where(F.col(size) > bar))
    light = rows.join(heavy.select(*key), key, "left_anti").join(groups.where(F.col(size) <= bar), key)
    return rows.join(heavy, key).unionByName(light)


def _range(value: Column, splits: list[int]) -> Column:
    """How many of the sorted splits are at most value, by halving."""

    def of(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(splits[middle]), of(low, middle)).otherwise(of(middle + 1, high))

    return of(0, len(splits))


def ranked(rows: DataFrame, key: str, id_: str = "doc_id") -> DataFrame:
    """``(id, cc_id, cc_size, cc_idx)`` and key of each row: its group's least id and size, and its place by id, from 0.

    rows are a written table of ``(id, key)`` without repeats, as it is read several times. A heavy group is ranked by ranges of its ids.
    """
    total, splits = rows.agg(F.count("*"), F.percentile_approx(id_, [k / RANGES for k in range(1, RANGES)])).first()
    heavy = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > F.lit(total / RANKED)).select(key, F.lit(True).alias("heavy"))
    cut = rows.join(F.broadcast(heavy), key, "left").withColumn("range", F.when(F.col("heavy"), _range(F.col(id_), sorted(set(splits or [])))).otherwise(F.lit(0)))
    parts = cut.where("heavy").groupBy(key, "range").agg(F.count("*").alias("n"), F.min(id_).alias("least"))
    whole = Window.partitionBy(key)
    before = F.sum("n").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(key, "range", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(whole).alias("size"), F.min("least").over(whole).alias("first"))
    part = Window.partitionBy(key, "range")
    placed = cut.select(id_, key, "range", F.min(id_).over(part).alias("least"), F.count("*").over(part).alias("n"), F.row_number().over(part.orderBy(id_)).alias("place"))
    placed = placed.join(F.broadcast(parts), [key, "range"], "left")
    index = F.col("place") - 1 + F.coalesce("before", F.lit(0))
    return placed.select(id_, key, F.coalesce("first", "least").alias("cc_id"), F.coalesce("size", "n").alias("cc_size"), index.cast("long").alias("cc_idx"))


def by_runs(rows: DataFrame, keys: list[str], use: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``use`` makes of the rows of equal keys: it gets a table of whole groups, each in one run, and where the runs start.

    A group is held in memory as a whole, so the keys have to bound it; small groups come many at a time.
    """

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        new[:1] = True
        for k in keys:
            v = t[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            t = pa.Table.from_batches(held)
            at = starts(t)
            if len(at) > 1:
                yield from use(t.slice(0, at[-1]).combine_chunks(), at[:-1])
                held = t.slice(at[-1]).combine_chunks().to_batches()
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from use(t, starts(t))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def free_name(docs: DataFrame) -> str:
    """The beginning of names that no column of docs has."""
    free = "__"
    while any(c.startswith(free) for c in docs.columns):
        free += "_"
    return free
