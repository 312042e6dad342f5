"""Exact duplicates: documents with the same raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silterra.operators.skew import free_name, ranked
from silterra.session import Scratch


def _digest(column: str) -> Column:
    """Of a row's text; a row without text or id is like no other."""
    none = F.concat(F.lit("none "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.when(F.col("doc_id").isNull(), F.encode(none, "utf-8")).otherwise(F.coalesce(F.unhex(F.sha2(F.col(column), 256)), F.encode(none, "utf-8")))


def _ranked(docs: DataFrame, column: str) -> DataFrame:
    rows = docs.where("doc_id is not null").select("doc_id", _digest(column).alias("digest")).distinct()
    return ranked(Scratch(docs.sparkSession).write(rows, "digests"), "digest")


def text_groups(docs: DataFrame, column: str = "text") -> DataFrame:
    """``(doc_id, cc_id, cc_size, cc_idx)`` of every document with a text; a group is named by its least id.

    Only ids and SHA-256 digests are shuffled, and a group may hold any share of all rows. A null text is no text and its document a group by
    itself. Rows that repeat an id and its text are one document; an id with several texts is a document with each. Rows with a null id are in no group.
    """
    return _ranked(docs, column).select("doc_id", "cc_id", "cc_size", "cc_idx")


def exact_annotate(docs: DataFrame, column: str = "text", name: str = "exact_dedup") -> DataFrame:
    """docs with a struct of group id, size and position; one with a null id is alone."""
    free = free_name(docs)
    groups = _ranked(docs, column).select(F.col("doc_id").alias(f"{free}doc"), F.col("digest").alias(f"{free}key"), F.struct("cc_id", "cc_size", "cc_idx").alias(f"{free}found"))
    alone = F.struct(docs["doc_id"].alias("cc_id"), F.lit(1).cast("long").alias("cc_size"), F.lit(0).cast("long").alias("cc_idx"))
    same = (docs["doc_id"] == F.col(f"{free}doc")) & (_digest(column) == F.col(f"{free}key"))
    joined = docs.join(groups.hint("shuffle_hash"), same, "left")
    return joined.select(*[docs[c] for c in docs.columns if c != name], F.coalesce(f"{free}found", alone).alias(name))


def exact_prune(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs without those whose text a smaller id has. Rows that repeat an id and its text stay or go together."""
    free = free_name(docs)
    gone = _ranked(docs, column).where("cc_idx > 0").select(F.col("doc_id").alias(f"{free}doc"), F.col("digest").alias(f"{free}key"))
    return docs.join(gone.hint("shuffle_hash"), (docs["doc_id"] == F.col(f"{free}doc")) & (_digest(column) == F.col(f"{free}key")), "left_anti")


def size_index(groups: DataFrame) -> DataFrame:
    """``(cc_id, cc_size)`` of each group."""
    return groups.groupBy("cc_id").agg(F.count("*").alias("cc_size"))


def size_histogram(groups: DataFrame) -> DataFrame:
    """``(cc_size, n_groups)``."""
    return size_index(groups).groupBy("cc_size").agg(F.count("*").alias("n_groups"))


def metrics(groups: DataFrame) -> DataFrame:
    """``(docs, groups, removed, removal_rate)``; of no documents a rate of 0."""
    sized = size_index(groups).agg(F.coalesce(F.sum("cc_size"), F.lit(0)).alias("docs"), F.count("*").alias("groups"))
    removed = F.col("docs") - F.col("groups")
    return sized.select("docs", "groups", removed.alias("removed"), F.round(F.when(F.col("docs") == 0, 0.0).otherwise(removed / F.col("docs")), 6).alias("removal_rate"))
