"""Queries of the deduplication operators, by name, and their DuckDB SQL. Each runs over its whole table."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silterra.config import ExactConfig, MinHashConfig, SubsampleConfig
from silterra.functions import text as T
from silterra.operators import apply, exact, minhash
from silterra.plans import commands, oracles
from silterra.session import Scratch, table
from silterra.sources import files

FUZZY = MinHashConfig()
CHUNKS = 4
RATE, MAX_SIZE, SEED = 0.5, 4, 7
#: Conversations are taken as the lines of so many files.
FILES = 64
#: The folder of vocabularies that ``tokenize_bpe`` uses.
TOKENIZERS = os.environ.get("SILTERRA_TOKENIZERS", "/opt/tokenizers")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir)


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines of files: the source is the file, ids give the order."""
    rows = files.with_path_ids(_docs(spark, sf_dir).select("doc_id", "source"), "source")
    line = F.row_number().over(Window.partitionBy("path_id").orderBy("doc_id")) - 1
    return rows.withColumn("line_num", line.cast("long"))


def path_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.with_path_ids(_docs(spark, sf_dir).select("doc_id", "source"), "source")
    parts = [files.path_chunk(rows, k, CHUNKS).withColumn("chunk", F.lit(k).cast("long")) for k in range(CHUNKS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("doc_id", "path_id", "chunk")


def path_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).groupBy("path_id").agg((F.max("line_num") + 1).alias("lines"))


def docid_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbered(spark, sf_dir).withColumn("packed", files.pack(F.col("path_id"), F.col("line_num")))
    path, line = files.unpack(F.col("packed"))
    return rows.select("doc_id", "packed", path.alias("path_id"), line.alias("line_num"))


def exact_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_annotate(_docs(spark, sf_dir)).select("doc_id", "exact_dedup.*")


def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.text_groups(_docs(spark, sf_dir)).where("cc_size > 1").select("doc_id", "cc_id", "cc_size")


def exact_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_prune(_docs(spark, sf_dir))


def cc_size_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.size_index(exact.text_groups(_docs(spark, sf_dir)))


def cc_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.size_histogram(exact.text_groups(_docs(spark, sf_dir)))


def dedup_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.metrics(exact.text_groups(_docs(spark, sf_dir)))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.clean(F.col("text")).alias("cleaned"))


def tokenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.joined_tokens(_docs(spark, sf_dir))


def tokenize_uniseg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.uniseg_tokens(_docs(spark, sf_dir)).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", T.SEPARATOR).alias("tokens"))


def tokenize_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = T.tokens(F.col("text"), "bytes")
    return _docs(spark, sf_dir).select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, ",")).alias("tokens"))


def tokenize_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bpe_tokens(_docs(spark, sf_dir), TOKENIZERS).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",").alias("tokens"))


def shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.shingle_digests(_docs(spark, sf_dir), FUZZY)


def minhash_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_vectors(_docs(spark, sf_dir), FUZZY).select("doc_id", F.array_join(F.transform("h", lambda h: h.cast("string")), ",").alias("h"))


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.band_signatures(minhash.minhash_vectors(_docs(spark, sf_dir), FUZZY), FUZZY)


def band_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signatures(spark, sf_dir).select("doc_id", F.col("band").cast("long").alias("band"), "sig")


def lsh_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.star_edges(_signatures(spark, sf_dir))


def minhash_exact_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fuzzy_components(_docs(spark, sf_dir), MinHashConfig(mode="exact"))


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fuzzy_components(_docs(spark, sf_dir), FUZZY)


def kill_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.kill_list(connected_components(spark, sf_dir))


def fuzzy_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.prune(_docs(spark, sf_dir), connected_components(spark, sf_dir))


def fuzzy_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.annotate(_docs(spark, sf_dir), connected_components(spark, sf_dir)).select("doc_id", "minhash.*")


def fuzzy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.metrics(fuzzy_annotate(spark, sf_dir))


def true_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.true_jaccard(_docs(spark, sf_dir), Scratch(spark).write(connected_components(spark, sf_dir), "components"), FUZZY)


def dup_aware_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    annotated = exact.exact_annotate(_docs(spark, sf_dir))
    return apply.dup_aware_subsample(annotated, "exact_dedup", RATE, MAX_SIZE, SEED).select("doc_id", F.col("exact_dedup.cc_id").alias("cc_id"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("path_id", F.pmod("conv_id", F.lit(FILES)))
    order = Window.partitionBy("path_id").orderBy("conv_id", "turn", "role", "text")
    return rows.withColumn("line_num", (F.row_number().over(order) - 1).cast("long"))


def concat_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.concat_groups(_turns(spark, sf_dir), [F.col("conv_id")])


def concat_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one role whose text an earlier run has are killed; so are all later rows of their conversations."""
    rows = _turns(spark, sf_dir)
    runs = apply.concat_groups(rows, [F.col("role")])
    named = runs.withColumn("doc_id", files.pack(F.col("path_id"), F.col("group_line")))
    path, line = files.unpack(F.col("doc_id"))
    killed = exact.text_groups(named).where("cc_idx > 0").select(path.alias("path_id"), line.alias("line_num"))
    return apply.concat_prune(rows, killed, [F.col("conv_id")]).select("path_id", "line_num", "conv_id", "turn")


def _lines(spark: SparkSession, sf_dir: str) -> str:
    """The folder of JSON lines that documents are written to, ``FILES`` files by id, in order of ids."""
    rows = _docs(spark, sf_dir).withColumn("file", F.pmod("doc_id", F.lit(FILES)))
    value = F.to_json(F.struct("doc_id", "text", "lang", "source", "n_chars"), {"ignoreNullFields": "false"}).alias("value")
    scratch = Scratch(spark)
    rows.repartition(FILES, "file").sortWithinPartitions("file", "doc_id").select("file", value).write.partitionBy("file").text(f"{scratch.root}/lines")
    return f"{scratch.root}/lines"


def _command(spark: SparkSession, run: Callable[[str], object], fields: str) -> DataFrame:
    """What a command makes of a folder, read again."""
    output = f"{Scratch(spark).root}/output"
    run(output)
    return files.read_jsonl(spark, output, fields)


def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_jsonl(spark, _lines(spark, sf_dir), _docs(spark, sf_dir).schema)


def jsonl_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.with_doc_ids(files.read_lines(spark, _lines(spark, sf_dir)))
    return rows.select("path_id", "line_num", F.col("doc_id").alias("packed"), files.nested(F.col("raw"), "doc_id").cast("long").alias("doc_id"), F.md5(files.content(F.col("raw"), "text")).alias("digest"))


def command_exact_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _lines(spark, sf_dir)
    return _command(spark, lambda out: commands.exact_dedup(spark, ExactConfig(), source, out), "doc_id long, lang string")


def command_exact_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _lines(spark, sf_dir)
    found = _command(spark, lambda out: commands.exact_dedup(spark, ExactConfig(annotate_only=True), source, out), "doc_id long, exact_dedup struct<cc_id: long, cc_size: long, cc_idx: long>")
    return found.select("doc_id", "exact_dedup.*")


def command_min_hash_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _lines(spark, sf_dir)
    return _command(spark, lambda out: commands.min_hash(spark, FUZZY, source, out), "doc_id long, lang string")


def command_min_hash_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, config = _lines(spark, sf_dir), dataclasses.replace(FUZZY, annotate_only=True)
    found = _command(spark, lambda out: commands.min_hash(spark, config, source, out), "doc_id long, minhash struct<cc_id: long, cc_size: long, cc_idx: long>")
    return found.select("doc_id", "minhash.*")


def command_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash-only in two chunks, gather-edges, build-uf: ``(doc_id, cc_id)`` with packed ids."""
    source, root = _lines(spark, sf_dir), Scratch(spark).root
    for chunk in range(2):
        commands.hash_only(spark, FUZZY, source, f"{root}/signatures/{chunk}", chunk, 2)
    both = spark.read.parquet(f"{root}/signatures/0").union(spark.read.parquet(f"{root}/signatures/1"))
    both.write.parquet(f"{root}/all")
    commands.gather_edges(spark, f"{root}/all", f"{root}/edges")
    commands.build_components(spark, f"{root}/edges", f"{root}/components")
    return spark.read.parquet(f"{root}/components")


def command_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, tagged = _lines(spark, sf_dir), f"{Scratch(spark).root}/tagged"
    commands.exact_dedup(spark, ExactConfig(annotate_only=True), source, tagged)
    config = SubsampleConfig(subsample_rate=RATE, max_cc_size=MAX_SIZE, seed=SEED)
    return _command(spark, lambda out: commands.subsample(spark, config, tagged, out), "doc_id long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        scan_documents, path_chunk, path_line_counts, docid_pack, exact_annotate, exact_groups, exact_prune, cc_size_index, cc_size_histogram, dedup_metrics,
        clean_text, tokenize_words, tokenize_uniseg, tokenize_bytes, tokenize_bpe, shingles, minhash_vector, band_signatures, lsh_groups, minhash_exact_mode,
        connected_components, kill_list, fuzzy_prune, fuzzy_annotate, fuzzy_metrics, true_jaccard, dup_aware_subsample, concat_group, concat_prune,
        jsonl_scan, jsonl_line_numbers, command_exact_prune, command_exact_annotate, command_min_hash_prune, command_min_hash_annotate, command_stages, command_subsample,
    )
}
ORACLES: dict[str, str] = oracles.build(FUZZY, CHUNKS, RATE, MAX_SIZE, SEED, FILES)
