import gzip
import json

import pytest
from pyspark.sql import functions as F

from silterra.__main__ import main
from silterra.plans import commands
from silterra.sources import files

LINES = ["alpha beta", "alpha beta", "one", "one", "one", "one", " one", "one", "one", "last text"]


def write(folder, name, rows, opener=open):
    folder.mkdir(parents=True, exist_ok=True)
    with opener(folder / name, "wt") as f:
        f.write("\n".join(json.dumps(r) for r in rows))


@pytest.fixture
def folder(tmp_path):
    write(tmp_path / "in", "a.jsonl", [{"text": t, "n": i} for i, t in enumerate(LINES)])
    write(tmp_path / "in" / "deep", "b.jsonl.gz", [{"text": "last text", "meta": {"k": 1}}, {"text": "other", "meta": {"k": "1"}}], gzip.open)
    return tmp_path


def read(folder):
    return [json.loads(x) for p in sorted(folder.rglob("*")) if p.is_file() and p.name[0] not in "._" for x in p.read_text().splitlines()]


def test_lines_are_numbered(spark, folder):
    rows = files.with_doc_ids(files.read_lines(spark, str(folder / "in"))).withColumn("text", files.content(F.col("raw"), "text"))
    got = sorted((r.path_id, r.line_num, r.text) for r in rows.collect())
    assert [t for p, _, t in got if p == 0] == LINES and [n for p, n, _ in got if p == 0] == list(range(10)) and len(got) == 12
    path, line = files.unpack(F.col("doc_id"))
    assert rows.where((path != F.col("path_id")) | (line != F.col("line_num"))).count() == 0
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        split = files.with_doc_ids(files.read_lines(spark, str(folder / "in"))).withColumn("text", files.content(F.col("raw"), "text"))
        assert sorted((r.path_id, r.line_num, r.text) for r in split.collect()) == got
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert files.path_chunk(rows, 1, 2).count() == 2
    keys = {r.k for r in rows.where("path_id = 1").select(files.nested(F.col("raw"), "meta.k").alias("k")).collect()}
    assert keys == {"1", '"1"'}


def test_malformed_and_missing(spark, tmp_path):
    write(tmp_path / "bad", "x.jsonl", [{"text": 3}])
    with pytest.raises(Exception, match="no string under text"):
        files.read_lines(spark, str(tmp_path / "bad")).select(files.content(F.col("raw"), "text")).collect()
    (tmp_path / "bad" / "y.jsonl").write_text("{not json\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "bad"), "text string").collect()


def test_commands(spark, folder):
    source, out = str(folder / "in"), folder / "out"
    settings = folder / "c.yaml"
    settings.write_text("name: x\nnum_bands: 14\nband_size: 8\nngram_size: 5\ntokenizer_str: uniseg\ncontent_key: text\ntext_field: text\ncc_field: exact_dedup\nsubsample_rate: 1.0\nmax_cc_size: 2\n")
    run = lambda *a: main(list(a), spark)
    run("exact-dedup", "--config", str(settings), "--input", source, "--output", str(out / "exact"))
    assert sorted(r["text"] for r in read(out / "exact")) == sorted([*set(LINES), "other"])
    assert [json.loads(x)["n"] for x in (out / "exact" / "a.jsonl").read_text().splitlines()] == [0, 2, 6, 9]
    assert [json.loads(x)["text"] for x in (out / "exact" / "deep" / "b.jsonl").read_text().splitlines()] == ["other"]
    assert {p.name for p in (out / "exact").rglob("*") if p.is_file() and p.name[0] != "."} == {"a.jsonl", "b.jsonl"}
    run("min-hash", "--config", str(settings), "--input", source, "--output", str(out / "same"))
    assert sorted(r["text"] for r in read(out / "same")) == sorted([*set(LINES), "other"])
    settings.write_text(settings.read_text() + "exact_override: true\nannotate_only: true\n")
    run("min-hash", "--config", str(settings), "--input", source, "--output", str(out / "tagged"))
    tagged = read(out / "tagged")
    assert sorted(r["minhash"]["cc_size"] for r in tagged) == [1] + [2] * 4 + [7] * 7 and all(r["text"] for r in tagged)
    run("exact-dedup", "--config", str(settings), "--input", source, "--output", str(out / "exact-tagged"))
    run("dup-aware-subsample", "--config", str(settings), "--input", str(out / "exact-tagged"), "--output", str(out / "sample"))
    assert sorted(r["text"] for r in read(out / "sample")) == sorted([" one", "other", "alpha beta", "alpha beta", "last text", "last text"])
    run("hash-only", "--config", str(settings), "--input", source, "--output", str(out / "sigs"))
    run("gather-edges", "--input", str(out / "sigs"), "--output", str(out / "edges"))
    run("build-uf", "--input", str(out / "edges"), "--output", str(out / "ccs"))
    run("uf-size-prune", "--config", str(settings), "--input", source, "--output", str(out / "pruned"), "--components", str(out / "ccs"))
    assert len(read(out / "pruned")) == 4
    run("annotate", "--config", str(settings), "--input", source, "--output", str(out / "annotated"), "--components", str(out / "ccs"))
    assert sorted(map(json.dumps, read(out / "annotated"))) == sorted(map(json.dumps, tagged))
    run("true-jacc", "--config", str(settings), "--input", source, "--output", str(out / "jaccard"), "--components", str(out / "ccs"))
    pairs = spark.read.json(str(out / "jaccard")).collect()
    assert len(pairs) == 6 + 1 + 1 and {r.jaccard for r in pairs} == {1.0}
    run("build-file-map", "--input", source, "--output", str(out / "map"))
    assert sorted(r["path_id"] for r in read(out / "map")) == [0, 1]
    assert commands.load_file_map(spark, str(out / "map")).count() == 2
    assert files.read_lines(spark, source, "*.gz").count() == 2


def test_runs_as_documents(spark, tmp_path):
    rows = [{"id": k, "text": t} for k, t in (("a", "p"), ("a", "q"), ("b", "p"), ("b", "q"), ("c", "r"), ("b", "s"))]
    write(tmp_path / "in", "x.jsonl", rows)
    (tmp_path / "c.yaml").write_text("tokenizer_str: uniseg\nconcat_key: [id]\n")
    main(["min-hash", "--config", str(tmp_path / "c.yaml"), "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out")], spark)
    assert [(r["id"], r["text"]) for r in read(tmp_path / "out")] == [("a", "p"), ("a", "q"), ("c", "r")]
    (tmp_path / "c.yaml").write_text("tokenizer_str: uniseg\nconcat_key: [id]\nannotate_only: true\n")
    main(["min-hash", "--config", str(tmp_path / "c.yaml"), "--input", str(tmp_path / "in"), "--output", str(tmp_path / "tagged")], spark)
    assert [r["minhash"]["cc_size"] for r in sorted(read(tmp_path / "tagged"), key=lambda r: (r["id"], r["text"]))] == [2, 2, 2, 2, 1, 1]
