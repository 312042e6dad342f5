from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from silterra.llm import cubemix as cm


def test_flight_keeps_totals_and_expectations():
    rng = np.random.default_rng(0)
    tokens = rng.integers(1, 500, 300)
    pi = rng.uniform(0.1, 0.9, 300)
    seen = np.zeros(300)
    for turn in range(300):
        s = cm.fly(tokens, pi, rng.random(300))
        assert ((s > 0) & (s < 1)).sum() <= 2
        assert abs(s.sum() - pi.sum()) < 1e-6 and abs((s * tokens).sum() - (pi * tokens).sum()) < 1e-3
        seen += s
    assert abs(seen / 300 - pi).max() < 0.15


def test_landing_keeps_probabilities():
    rng = np.random.default_rng(1)
    for state, tokens in (([0.3, 0.6], [10, 30]), ([0.7, 0.9], [5, 5]), ([0.2], [7])):
        got = np.mean([cm.land(np.array(tokens), np.array(state), rng.random(len(state))) for _ in range(4000)], 0)
        assert abs(got - state).max() < 0.04


def table(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for source, n in (("hot", 3000), ("mid", 500), ("small", 80), (None, 60), ("one", 1)):
        for _ in range(n):
            rows.append((i, " ".join(["w"] * int(rng.geometric(0.02))), source))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


@pytest.mark.parametrize("block", [64, 8192])
def test_shares_meet_targets(spark, block):
    docs, rows = table(spark)
    got = cm.mix_sources(docs, block=block).collect()
    total, have, number = Counter(), Counter(), Counter()
    longest = max(len(t.split()) for _, t, _ in rows)
    for _, t, s in rows:
        total[s] += len(t.split())
        number[s] += 1
    assert len({r.doc_id for r in got}) == len(got)
    # The shares by another way: halving the rate until the budget is met.
    low, high = 0.0, 1e9
    w = {s: total[s] ** cm.TEMPERATURE for s in total}
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(total[s], mid * w[s]) for s in w) < cm.BUDGET * sum(total.values()) else (low, mid)
    for r in got:
        have[r.source] += r.n_tokens
        assert abs(r.pi - min(1, low * w[r.source] / total[r.source])) < 1e-9
    drawn = Counter(r.source for r in got)
    for s in total:
        pi = min(1, low * w[s] / total[s])
        assert abs(have[s] - pi * total[s]) <= 2 * longest and abs(drawn[s] - pi * number[s]) <= 2
    assert abs(sum(have.values()) - cm.BUDGET * sum(total.values())) <= 2 * longest
    again = cm.mix_sources(docs.repartition(7), block=block).collect()
    assert {r.doc_id for r in again} == {r.doc_id for r in got}
    kept = cm.draw(docs, block=block)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got}


def test_given_weights(spark):
    docs, _ = table(spark)
    weights = spark.createDataFrame([("hot", 1.0), ("mid", 1.0), ("small", None), ("unknown", 3.0)], "source string, weight double")
    got = cm.mix_sources(docs, weights, budget=0.2)
    sums = {r.source: r.t for r in got.groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "t").collect()}
    assert set(sums) == {"hot", "mid"} and abs(sums["hot"] - sums["mid"]) < 1500


def test_awkward_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x " * 60_000, "a"), (3, "x y", "a"), (None, "x", "a"), (4, "x y z", None), (5, "x y z", "b"), (6, "x y z", "b"), (7, "", "empty"), (8, None, "empty")]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, source=s, pi="mine", state=None, documents=1) for i, t, s in rows], "doc_id long, text string, source string, pi string, state string, documents int")
    got = cm.mix_sources(docs, budget=1.0).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert {r.doc_id: r.n_tokens for r in got}[3] == 60_002
    assert cm.mix_sources(docs, budget=0.0).count() == 0
    assert cm.draw(docs).columns == docs.columns
    assert cm.mix_sources(docs.limit(0)).count() == 0
