import json

from silterra.config import MinHashConfig
from silterra.plans import commands


def test_a_chunk_parses_its_own_files_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, texts in (("a", ["one two", "three"]), ("b", [3]), ("c", ["four"])):
        (tmp_path / "in" / f"{name}.jsonl").write_text("".join(json.dumps({"text": t}) + "\n" for t in texts))
    commands.hash_only(spark, MinHashConfig(), str(tmp_path / "in"), str(tmp_path / "out"), 0, 2)
    ids = {r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id").distinct().collect()}
    assert ids == {0, 1, 2 << 32}
