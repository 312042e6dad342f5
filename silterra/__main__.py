"""python -m silterra COMMAND ...: see --help."""

from __future__ import annotations

import argparse
import os
from pathlib import Path

from pyspark.sql import SparkSession

from silterra import config as C
from silterra.plans import commands
from silterra.session import local_session, prepare


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="silterra")
    out.add_argument("--threads", type=int, default=os.cpu_count(), help="of a session on this machine; spark-submit has its own settings")
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("min-hash", "exact-dedup", "dup-aware-subsample", "build-file-map", "hash-only", "gather-edges", "build-uf", "uf-size-prune", "annotate", "true-jacc"):
        p = sub.add_parser(name)
        if name not in ("build-file-map", "gather-edges", "build-uf"):
            p.add_argument("--config", help="flat YAML file")
        p.add_argument("--input-dir-override", "--input", dest="input")
        p.add_argument("--output-dir-override", "--output", dest="output")
        if name in ("uf-size-prune", "annotate", "true-jacc"):
            p.add_argument("--components", required=True, help="folder that build-uf wrote")
        if name == "hash-only":
            p.add_argument("--path-chunk", type=int, default=0)
            p.add_argument("--num-path-chunks", type=int, default=1)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    given = C.parse_flat_yaml(Path(a.config).read_text()) if getattr(a, "config", None) else {}
    source, output = a.input or given.get("local_input"), a.output or given.get("output_dir")
    if not source or not output:
        raise SystemExit("an input and an output folder are needed, by the settings or the command line")
    spark = prepare(spark or (local_session(a.threads) if "SPARK_ENV_LOADED" not in os.environ else SparkSession.builder.getOrCreate()))
    if a.command == "min-hash":
        commands.min_hash(spark, C.minhash_config(given), source, output).show()
    elif a.command == "exact-dedup":
        commands.exact_dedup(spark, C.exact_config(given), source, output).show()
    elif a.command == "dup-aware-subsample":
        commands.subsample(spark, C.subsample_config(given), source, output)
    elif a.command == "hash-only":
        commands.hash_only(spark, C.minhash_config(given), source, output, a.path_chunk, a.num_path_chunks)
    elif a.command in ("uf-size-prune", "annotate"):
        c = C.minhash_config(given)
        rows, found = commands.load(spark, source, c.content_key), spark.read.parquet(a.components)
        (commands.write_tagged if a.command == "annotate" else commands.write_pruned)(rows, found, c, output, source)
    elif a.command == "true-jacc":
        commands.true_jaccard(spark, C.minhash_config(given), source, a.components, output)
    else:
        commands.COMMANDS[a.command](spark, source, output)


if __name__ == "__main__":
    main()
