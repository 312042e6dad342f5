import base64
import json
import random

from silterra.config import ExactConfig, MinHashConfig, SubsampleConfig
from silterra.operators import minhash
from silterra.plans import commands

KEEP = {"subsample_rate": 1.0, "seed": 3}


def shuffled(spark, run, name):
    """Bytes that run shuffles."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(name) for s in sc.statusTracker().getJobInfo(j).stageIds}
    store = sc._jsc.sc().statusStore()
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)


def corpus(folder):
    """Lines that don't compress, in 4 files; every fifth is as the one before."""
    rng, text, size = random.Random(1), "", 0
    folder.mkdir()
    for f in range(4):
        with open(folder / f"{f}.jsonl", "w") as out:
            for k in range(60):
                text = text if k % 5 == 4 else " ".join(base64.b64encode(rng.randbytes(9)).decode() for _ in range(500))
                line = json.dumps({"n": 60 * f + k, "text": text}) + "\n"
                size += len(line)
                out.write(line)
    return size


def numbers(folder):
    return {p.name: [json.loads(x)["n"] for x in p.read_text().splitlines()] for p in folder.iterdir() if p.name[0] not in "._"}


def test_subsample_moves_lines_once(spark, tmp_path):
    size = corpus(tmp_path / "in")
    source, tagged, out = (str(tmp_path / x) for x in ("in", "tagged", "out"))
    assert shuffled(spark, lambda: commands.exact_dedup(spark, ExactConfig(annotate_only=True), source, tagged), "tag") < 1.4 * size
    assert shuffled(spark, lambda: commands.subsample(spark, SubsampleConfig(max_cc_size=1, **KEEP), tagged, out), "sample") < 1.4 * size
    assert numbers(tmp_path / "tagged") == {f"{f}.jsonl": [*range(60 * f, 60 * f + 60)] for f in range(4)}
    assert numbers(tmp_path / "out") == {f"{f}.jsonl": [n for n in range(60 * f, 60 * f + 60) if n % 5 < 3] for f in range(4)}
    assert shuffled(spark, lambda: commands.subsample(spark, SubsampleConfig(subsample_rate=0.0), tagged, out), "none") < 0.1 * size


def test_long_files_are_folders_of_parts_in_order(spark, tmp_path, monkeypatch):
    corpus(tmp_path / "in")
    monkeypatch.setattr(commands.files, "SLOT", 16)
    commands.exact_dedup(spark, ExactConfig(), str(tmp_path / "in"), str(tmp_path / "out"))
    for f in range(4):
        parts = sorted((tmp_path / "out" / f"{f}.jsonl").glob("part-*"))
        assert len(parts) == 4 and [json.loads(x)["n"] for p in parts for x in p.read_text().splitlines()] == [n for n in range(60 * f, 60 * f + 60) if n % 5 < 4]


def test_min_hash_annotate_moves_lines_once(spark, tmp_path):
    size = corpus(tmp_path / "in")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert shuffled(spark, lambda: commands.min_hash(spark, MinHashConfig(annotate_only=True), source, out), "annotate") < 1.4 * size
    assert numbers(tmp_path / "out") == {f"{f}.jsonl": [*range(60 * f, 60 * f + 60)] for f in range(4)}


def test_short_keys_of_bands_are_equal_where_signatures_are(spark):
    texts = ["a b c d e f g h", "a b c d e f g h", "a b c d e f g i", "", "", "x y z", None, *(f"{'w ' * k}q r s t u" for k in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    config = MinHashConfig(num_bands=20, band_size=2)
    groups = []
    for rows in (minhash.band_keys(docs, config), minhash.band_signatures(minhash.minhash_vectors(docs, config), config)):
        found = {}
        for r in rows.collect():
            found.setdefault((r.band, bytes(r.sig) if isinstance(r.sig, bytearray) else r.sig), []).append(r.doc_id)
        groups.append(sorted((b, sorted(ids)) for (b, _), ids in found.items()))
    assert groups[0] == groups[1] and any(len(ids) > 2 for _, ids in groups[0])
