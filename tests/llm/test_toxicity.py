import numpy as np
import pyarrow as pa
from pyspark.sql import Row

from silterra.llm import toxicity as tox
from silterra.llm.textbytes import characters

WORDS = "the quiet river runs under stone bridges while birds watch green fields from tall trees near town".split()


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    out, y = [], []
    for i in range(n):
        w = list(rng.choice(WORDS, rng.integers(5, 200)))
        if i % 2:
            w[rng.integers(len(w))] = "blorghead"
        out.append(" ".join(w))
        y.append(i % 2 == 1)
    return pa.array(out), np.array(y)


def brute(text, model):
    """The same score, one n-gram at a time."""
    raw = np.frombuffer(text.encode(), np.uint8)
    c, at = characters(raw, np.array([0, len(raw)]))
    c = c[: at[1] + 1]
    gaps = [p for p in range(len(c) - 1) if c[p] == 0]
    starts = gaps[:: tox.SEGMENT]
    sums = np.zeros(len(starts))
    for n in tox.SIZES:
        for p in range(len(c) - n + 1):
            h = c[p : p + 1] * np.uint64(0x9E3779B97F4A7C15)
            for k in range(1, n):
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c[p + k]
            f = int((h[0] * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - tox.BITS))
            sums[np.searchsorted(starts, p, "right") - 1] += model.weights[f]
    return max(sums) + model.bias


def test_held_out_accuracy_and_one_word_in_a_long_text():
    model = tox.fit(*texts(400))
    held, y = texts(300, seed=1)
    assert ((tox.worst(held, model) > model.threshold) == y).mean() > 0.98
    rng = np.random.default_rng(2)
    long = " ".join(rng.choice(WORDS, 30_000))
    s = tox.worst(pa.array([long, long + " blorghead", "blorghead " + long]), model)
    assert (s > model.threshold).tolist() == [False, True, True]


def test_scores_equal_brute_force():
    model = tox.fit(*texts(200))
    sample = [*texts(20, seed=3)[0].to_pylist(), "", "a", "ab", "  ", "été blorghead, 日本 x"]
    assert np.allclose(tox.worst(pa.array(sample), model), [brute(t, model) for t in sample])


def test_awkward_rows(spark):
    x, y = texts(120)
    docs = [Row(doc_id=i, text=t, is_toxic="mine", toxic_score=None) for i, t in enumerate(x.to_pylist())]
    docs += [Row(doc_id=900, text=None, is_toxic=None, toxic_score=None), Row(doc_id=901, text="", is_toxic=None, toxic_score=None), Row(doc_id=None, text="blorghead", is_toxic=None, toxic_score=None), docs[1]]
    docs = spark.createDataFrame(docs, "doc_id long, text string, is_toxic string, toxic_score double")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(None, 1), (5, None), (1, 0), (77777, 1)], "doc_id long, toxic int")
    model = tox.train(docs, labels)
    got = tox.score_toxicity(docs, model).collect()
    assert len(got) == 124
    flags = {r.doc_id: r.is_toxic for r in got}
    assert flags[900] is False and flags[901] is False and flags[None] is True and flags[1] is True
    assert sum(r.doc_id == 1 for r in got) == 2
    kept = tox.drop_toxic(docs, model)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {i for i in range(120) if not y[i]} | {900, 901}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(1, 0)]):
        model = tox.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [(r.toxic_score, r.is_toxic) for r in tox.score_toxicity(docs, model).collect()] == [(0.0, False)]
        assert tox.score_toxicity(docs.limit(0), model).count() == 0
