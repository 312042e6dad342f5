import re

import numpy as np
import pytest

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = [f"w{i}" for i in range(4000)]


def words(rng, n):
    return " ".join(rng.choice(PROSE, n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A corpus with one planted case of each kind, and what the stages must do with them."""
    rng, folder = np.random.default_rng(0), tmp_path_factory.mktemp("sf")
    test, passage = words(rng, 40), words(rng, 70)
    docs = {i: words(rng, int(rng.integers(80, 200))) for i in range(300)}
    toxic = set(range(0, 300, 5))
    for i in toxic:
        w = docs[i].split()
        w[len(w) // 2] = "blorghead"
        docs[i] = " ".join(w)
    docs[1001] = docs[1].upper() + "!"  # a copy
    docs[1002] = " ".join("x" if k == 9 else x for k, x in enumerate(docs[2].split()))  # a near copy
    for i in (11, 12, 13):
        docs[i] += " " + passage
    docs[14] += " " + ", ".join(test.split()[5:30]).upper()
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs.items()] + [(2000, None, None, None, None), (2001, "", None, "s1", 0), (None, words(rng, 90), None, None, 5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, test), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, toxic, test, passage


def test_stages_do_what_brute_force_says(spark, corpus):
    folder, docs, toxic, test, passage = corpus
    frame, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in cp.STAGES:
        out = stage(spark, frame, folder)
        assert out.columns == frame.columns and [f.dataType for f in out.schema] == [f.dataType for f in frame.schema], name
        out.write.parquet(f"{folder}/{name}")
        frame = spark.read.parquet(f"{folder}/{name}")
        seen.append({r.doc_id: r for r in frame.collect()})
    clean = ({*docs} - toxic) | {2000, 2001, None}
    assert {*seen[0]} == clean
    assert {*seen[1]} == clean - {1001, 1002}
    assert {*seen[2]} == {*seen[1]}
    assert [passage in seen[2][i].text for i in (11, 12, 13)] == [True, False, False]
    for i, r in seen[2].items():
        assert i in (12, 13) or r.text == seen[1][i].text
        assert i in (None, 2000) or r.n_chars == len(r.text)
    assert {*seen[3]} == {*seen[2]} - {14}
    n = [sum(len((r.text or "").split()) for r in s.values()) for s in seen]
    assert {*seen[4]} <= {*seen[3]} and abs(n[4] / n[3] - 0.8) < 0.03
    assert not any(re.search("blorghead", r.text or "") for r in seen[4].values())
    whole = {r.doc_id for r in cp.run(spark, folder).collect()}
    assert whole == {*seen[4]}


def test_extra_columns_with_clashing_names(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["group_id", "cc_id", "u", "v", "spans", "cuts", "__gone", "__id", "__cuts", "__drawn", "item_id", "toxic", "weight", "pi", "state", "hash"]
    wide = docs.selectExpr("*", *[f"'mine' as `{n}`" for n in names])
    for name, stage in cp.STAGES:
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns, name
        plain = stage(spark, docs, folder)
        assert out.count() == plain.count() > 200 and out.where("pi <> 'mine' or hash is null").count() == 0


def test_empty_and_repeated_rows(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
        twice = stage(spark, docs.union(docs), folder).groupBy("doc_id").count()
        assert twice.where("count % 2 = 1").count() == 0
