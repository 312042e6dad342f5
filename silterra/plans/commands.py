"""The commands: fuzzy and exact deduplication, subsampling of whole groups, comparison within groups; each over folders of JSON lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silterra.config import ExactConfig, MinHashConfig, SubsampleConfig
from silterra.operators import apply, exact, minhash
from silterra.operators.components import connected_components
from silterra.session import Scratch
from silterra.sources import files


def load(spark: SparkSession, path: str, key: str, splits: DataFrame | None = None) -> DataFrame:
    """``(doc_id, path_id, path, line_num, raw, <key>)`` of a folder of JSON lines. Lines are read again where they are used, and counted for each call, so
    they are never written but as results; the text is parsed where it is used."""
    rows = files.with_doc_ids(files.read_lines(spark, path, splits=splits))
    return rows.withColumn(key, files.content(F.col("raw"), key))


def documents(rows: DataFrame, config: MinHashConfig) -> DataFrame:
    """What is compared: each line, or with a concat key each run of lines, which has its first line's id."""
    if not config.concat_key:
        return rows
    keys = [files.nested(F.col("raw"), k) for k in config.concat_key]
    groups = apply.concat_groups(rows, keys, config.content_key)
    return groups.select(files.pack(F.col("path_id"), F.col("group_line")).alias("doc_id"), F.col("text").alias(config.content_key))


def hash_only(spark: SparkSession, config: MinHashConfig, path: str, output: str, chunk: int = 0, chunks: int = 1) -> None:
    """Band signatures of one chunk of the files; of the others no line is parsed. Lines are read again where a run needs them, and not written."""
    lines = files.with_doc_ids(files.path_chunk(files.read_lines(spark, path), chunk, chunks))
    # Bound to the chunk, or a test for null goes below the join that numbers files and parses all lines.
    own = F.when(F.pmod("path_id", F.lit(chunks)) == chunk, files.content(F.col("raw"), config.content_key))
    rows = lines.withColumn(config.content_key, own)
    found = minhash.band_signatures(minhash.minhash_vectors(documents(rows, config), config), config)
    found.write.mode("overwrite").partitionBy("band").parquet(output)


def gather_edges(spark: SparkSession, signatures: str, output: str) -> None:
    minhash.star_edges(spark.read.parquet(signatures)).write.mode("overwrite").parquet(output)


def build_components(spark: SparkSession, edges: str, output: str) -> None:
    connected_components(spark.read.parquet(edges)).write.mode("overwrite").parquet(output)


def write_tagged(rows: DataFrame, components: DataFrame, config: MinHashConfig, output: str, source: str, names: DataFrame | None = None) -> None:
    """The lines with ``minhash``; with a concat key all lines of a run have the run's."""
    if not config.concat_key:
        marks = apply.positions(components).select("doc_id", F.struct("cc_id", "cc_size", "cc_idx").alias("mark"))
    else:
        keys = [files.nested(F.col("raw"), k) for k in config.concat_key]
        grouped = apply.concat_ids(rows.select("doc_id", "path_id", "line_num", "raw"), keys)
        grouped = grouped.select(F.col("doc_id").alias("line_id"), files.pack(F.col("path_id"), F.col("group_line")).alias("doc_id"))
        marks = apply.annotate(grouped, components, "mark").select(F.col("line_id").alias("doc_id"), "mark")
    files.write_lines(rows, output, source, marks, _with_struct("minhash"), names)


def write_pruned(rows: DataFrame, components: DataFrame, config: MinHashConfig, output: str, source: str, names: DataFrame | None = None) -> None:
    if not config.concat_key:
        return files.write_lines(rows, output, source, _marked(apply.kill_list(components)), _unmarked, names)
    path, line = files.unpack(F.col("doc_id"))
    killed = apply.kill_list(components).select(path.alias("path_id"), line.alias("line_num"))
    keyed = rows.select("path", "path_id", "line_num", "raw")
    for i, k in enumerate(config.concat_key):
        keyed = keyed.withColumn(f"__key{i}", files.nested(F.col("raw"), k))
    added = [f"__key{i}" for i in range(len(config.concat_key))]
    files.write_lines(apply.concat_prune(keyed, killed, [F.col(n) for n in added]), output, source, names=names)


def _marked(ids: DataFrame) -> DataFrame:
    return ids.select("doc_id", F.lit(True).alias("mark"))


def _unmarked(raw: Column, doc_id: Column, mark: Column) -> Column:
    return F.when(mark.isNull(), raw)


def _with_struct(name: str) -> files.Make:
    """Each raw line with a further object: its mark, or that of a line alone."""

    def make(raw: Column, doc_id: Column, mark: Column) -> Column:
        # An object that isn't empty has a quote. Only lines with white space at the end need the slower way.
        short = F.substring(raw.cast("binary"), F.lit(1), F.octet_length(raw) - 1).cast("string")
        body = F.when(F.endswith(raw, F.lit("}")), short).otherwise(F.regexp_replace(raw, r"\}\s*$", ""))
        alone = F.struct(doc_id.alias("cc_id"), F.lit(1).cast("long").alias("cc_size"), F.lit(0).cast("long").alias("cc_idx"))
        return F.concat(body, F.when(F.contains(raw, F.lit('"')), ",").otherwise(""), F.lit(f'"{name}":'), F.to_json(F.coalesce(mark, alone)), F.lit("}"))

    return make


def min_hash(spark: SparkSession, config: MinHashConfig, path: str, output: str) -> DataFrame:
    """Deduplicate or annotate a folder; returns the metrics."""
    components = Scratch(spark).write(minhash.fuzzy_components(documents(load(spark, path, config.content_key), config), config), "components")
    splits = files.count_lines(spark, path)
    rows = load(spark, path, config.content_key, splits)
    (write_tagged if config.annotate_only else write_pruned)(rows, components, config, output, path, splits)
    whole = documents(rows, config).select("doc_id").join(components, "doc_id", "left").select(F.coalesce("cc_id", "doc_id").alias("cc_id"))
    return exact.metrics(whole)


def exact_dedup(spark: SparkSession, config: ExactConfig, path: str, output: str) -> DataFrame:
    groups = Scratch(spark).write(exact.text_groups(load(spark, path, config.text_field), config.text_field), "groups")
    splits = files.count_lines(spark, path)
    rows = files.read_lines(spark, path, splits=splits)
    if config.annotate_only:
        marks = groups.where("cc_size > 1").select("doc_id", F.struct("cc_id", "cc_size", "cc_idx").alias("mark"))
        files.write_lines(rows, output, path, marks, _with_struct("exact_dedup"), splits)
    else:
        files.write_lines(rows, output, path, _marked(groups.where("cc_idx > 0")), _unmarked, splits)
    return exact.metrics(groups)


def subsample(spark: SparkSession, config: SubsampleConfig, path: str, output: str) -> None:
    """Sample a folder of annotated lines by whole groups; ids may be unsigned 64-bit numbers. Lines of groups that aren't drawn move nowhere."""
    cc = F.variant_get(F.parse_json("raw"), f"$.{config.cc_field}.cc_id", "decimal(20,0)").alias("cc_id")
    ids = Scratch(spark).write(files.with_doc_ids(files.read_lines(spark, path)).select("doc_id", cc), "ids")
    drawn = apply.drawn(F.col("cc_id"), config.subsample_rate, config.seed)
    marks = _marked(apply.dup_aware_subsample(ids.select("doc_id", F.struct("cc_id").alias("group")), "group", config.subsample_rate, config.max_cc_size, config.seed))
    splits = files.count_lines(spark, path)
    rows = files.read_lines(spark, path, splits=splits).select("*", cc).where(drawn)
    files.write_lines(rows, output, path, marks, lambda raw, _, mark: F.when(mark, raw), splits)


def true_jaccard(spark: SparkSession, config: MinHashConfig, path: str, components: str, output: str) -> None:
    rows = documents(load(spark, path, config.content_key), config)
    files.write_jsonl(apply.true_jaccard(rows, spark.read.parquet(components), config), output, "gzip")


def build_file_map(spark: SparkSession, path: str, output: str) -> None:
    files.write_jsonl(files.read_lines(spark, path).select("path", "path_id").distinct(), output)


def load_file_map(spark: SparkSession, path: str) -> DataFrame:
    """``(path, path_id)`` as ``build_file_map`` wrote it."""
    return files.read_jsonl(spark, path, "path string, path_id long")


COMMANDS: dict[str, Callable] = {
    "min-hash": min_hash,
    "build-file-map": build_file_map,
    "hash-only": hash_only,
    "gather-edges": gather_edges,
    "build-uf": build_components,
    "true-jacc": true_jaccard,
    "exact-dedup": exact_dedup,
    "dup-aware-subsample": subsample,
}
