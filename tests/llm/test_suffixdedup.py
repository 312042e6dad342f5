from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Row

from silterra.llm import suffixdedup as sd


def brute(docs, length):
    """Spans and cuts by a dictionary of all windows."""
    places = defaultdict(list)
    for i in sorted(docs):
        w = docs[i].lower().split()
        for p in range(len(w) - length + 1):
            places[tuple(w[p : p + length])].append((i, p))
    spans, cuts = defaultdict(set), defaultdict(set)
    for where in places.values():
        if len(where) > 1:
            for i, p in where:
                spans[i].add(p)
            for i, p in where[1:]:
                cuts[i].add(p)

    def runs(ps):
        out = []
        for p in sorted(ps):
            if out and p <= out[-1][1]:
                out[-1][1] = p + length
            else:
                out.append([p, p + length])
        return out

    return {i: (runs(spans[i]), runs(cuts[i])) for i in spans}


def corpus(seed):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    shared = [" ".join(rng.choice(vocab, n)) for n in (32, 40, 41, 50, 90, 200)]
    docs = {}
    for i in range(70):
        parts = [" ".join(rng.choice(vocab, rng.integers(0, 120)))]
        for _ in range(rng.integers(0, 3)):
            parts += [shared[rng.integers(len(shared))], " ".join(rng.choice(vocab, rng.integers(0, 60)))]
        docs[i] = " ".join(parts)
    docs[70] = docs[71] = max((docs[i] for i in range(70)), key=len)
    docs[72] = "again " * 130
    docs[73] = docs[72] + "and again " * 40
    return docs


@pytest.mark.parametrize("length", [40, 50])
def test_equal_to_brute_force(spark, length):
    docs = corpus(length)
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.cuts) for r in sd.repeated(rows, length).collect()}
    assert got == brute(docs, length)


def test_a_common_passage_and_a_hot_first_digit(spark):
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(400)]
    passage, start = " ".join(rng.choice(vocab, 70)), " ".join(rng.choice(vocab, 20))
    rare = [" ".join(rng.choice(vocab, 60)) for _ in range(9)]
    docs = {i: " ".join([*rng.choice(vocab, 30), start, rare[i % 9] if i % 2 else passage, *rng.choice(vocab, 30)]) for i in range(240)}
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.cuts) for r in sd.repeated(rows).collect()}
    assert got == brute(docs, sd.LENGTH)


def test_cutting_leaves_one_of_each(spark):
    docs = corpus(5)
    rows = spark.createDataFrame([(i, t, "x", len(t)) for i, t in docs.items()], "doc_id long, text string, __x string, n_chars int")
    out = sd.drop_repeated(rows)
    assert out.schema == rows.schema
    left = {r.doc_id: r for r in out.collect()}
    for i, (_, cuts) in brute(docs, 50).items():
        w = docs[i].split()
        gone = {k for a, z in cuts for k in range(a, z)}
        want = [x for k, x in enumerate(w) if k not in gone]
        assert (left[i].text.split() if i in left else []) == want
    assert all(r.n_chars == len(r.text) for r in left.values())
    assert 70 not in left and 71 not in left


def test_awkward_rows(spark):
    p = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"q{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, p), (4, "short"), (5, p.upper().replace(" ", ", ")), (6, long), (None, p), (7, "once " + " ".join(f"r{i}" for i in range(70))), (7, "once " + " ".join(f"r{i}" for i in range(70))), (8, long + " " + p)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, spans="mine", n_chars="mine") for i, t in rows], "doc_id long, text string, spans string, n_chars string")
    got = sorted(map(tuple, sd.repeated_spans(docs).collect()))
    assert got == [(3, 0, 60, 0), (5, 0, 60, 60), (6, 0, 60_000, 0), (8, 0, 60_060, 60_060)]
    left = sd.drop_repeated(docs)
    assert left.schema == docs.schema
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 3, 4, 6, 7, 7]
    assert sd.repeated_spans(docs.limit(0)).count() == 0
