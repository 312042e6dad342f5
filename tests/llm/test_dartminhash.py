import numpy as np
from pyspark.sql import Row

from silterra.llm import dartminhash as dm
from silterra.llm.textbytes import mix


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def test_agreement_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    for n, change in ((30, 0.1), (400, 0.3), (3000, 0.6)):
        a = {int(k): int(w) for k, w in zip(rng.integers(1, 1 << 40, n), rng.geometric(0.4, n))}
        b = {k: (int(rng.geometric(0.4)) if rng.random() < change else w) for k, w in a.items() if rng.random() > change / 2}
        doc = np.repeat([0, 1], [len(a), len(b)])
        key = mix(np.array([*a, *b], np.uint64))
        f = dm.dart_minhash(doc, key, np.array([*a.values(), *b.values()]), 2, k=4096)
        assert abs((f[0] == f[1]).mean() - jaccard(a, b)) < 0.035


def test_a_set_alone_and_among_others_has_the_same_signature():
    import pyarrow as pa

    t = ["one two three four five", "", "x", "a b a b a b a b", "one two three four six"]
    whole = dm.sketch(pa.array(t))[0]
    for i, x in enumerate(t):
        assert (dm.sketch(pa.array([x]))[0][0] == whole[i]).all()


def corpus(seed=1):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(3000)]
    docs, truth = {}, {}
    i = 0
    for base in range(60):
        words = list(rng.choice(vocab, rng.integers(60, 300)))
        for _ in range(rng.integers(1, 6)):
            copy = [w if rng.random() > 0.03 else str(rng.choice(vocab)) for w in words]
            docs[i], truth[i] = " ".join(copy), base
            i += 1
    return docs, truth


def bags(text, n=dm.SHINGLE):
    w = text.lower().split()
    out = {}
    for k in range(max(1, len(w) - n + 1)):
        out[tuple(w[k : k + n])] = out.get(tuple(w[k : k + n]), 0) + 1
    return out


def test_groups_equal_brute_force(spark):
    docs, truth = corpus()
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in dm.near_duplicates(rows).collect()}
    b = {i: bags(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in docs:
        for j in docs:
            if i < j and jaccard(b[i], b[j]) >= dm.THRESHOLD:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = {i: find(i) for i in docs}
    sizes = {r: sum(v == r for v in want.values()) for r in set(want.values())}
    want = {i: r for i, r in want.items() if sizes[r] > 1}
    assert got == want
    kept = {r.doc_id for r in dm.drop_near_duplicates(rows).collect()}
    assert kept == {i for i in docs if got.get(i, i) == i}


def test_awkward_rows(spark):
    long = " ".join(f"v{i % 5000}" for i in range(60_000))
    rows = [Row(doc_id=i, text=t, group_id="x", u=None) for i, t in [(1, None), (2, ""), (3, "  "), (4, None), (5, "same few words here"), (6, "Same, few words: here!"), (7, long), (8, long + " more"), (9, "alone"), (9, "alone"), (None, "same few words here")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group_id string, u int")
    got = {r.doc_id: r.group_id for r in dm.near_duplicates(docs).collect()}
    assert got == {2: 2, 3: 2, 5: 5, 6: 5, 7: 7, 8: 7}
    kept = dm.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: -1 if x is None else x) == [None, 1, 2, 4, 5, 7, 9, 9]
    assert dm.near_duplicates(docs.limit(0)).count() == 0


def test_blocks_find_all_pairs_across_parts(spark, monkeypatch):
    monkeypatch.setattr(dm, "SIDE", 4)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, (6, 128)).astype(np.uint16)
    sig = base[rng.integers(6, size=70)].copy()
    for r in sig:
        r[rng.integers(0, 128, rng.integers(0, 70))] = 7
    ids, key = np.arange(70) * 5, np.where(np.arange(70) < 50, 1, np.arange(70) % 3 + 2)
    sigs = spark.createDataFrame([(int(i), r.tobytes()) for i, r in zip(ids, sig)], "doc_id long, signature binary")
    sizes = {k: int((key == k).sum()) for k in set(key.tolist())}
    rows = spark.createDataFrame([(int(k), int(i), int(i) // 10, sizes[int(k)]) for k, i in zip(key, ids)], "key long, doc_id long, part long, n long")
    got = [(r.u, r.v) for r in dm.across(rows, sigs, 0.5).collect()]
    want = [(int(ids[i]), int(ids[j])) for i in range(70) for j in range(i) if key[i] == key[j] and ids[i] // 10 != ids[j] // 10 and (sig[i] == sig[j]).mean() >= 0.5]
    edges = lambda e: spark.createDataFrame(e, "u long, v long")
    parts = lambda e: {r.doc_id: r.cc_id for r in dm.connected_components(edges(e)).collect()}
    assert len(want) > 50 and parts(got) == parts(want)


def test_every_text_of_a_repeated_id_counts(spark):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    docs = spark.createDataFrame([(5, a), (5, b), (7, a + " more"), (9, b + " more"), (11, "else")], "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in dm.near_duplicates(docs).collect()} == {5: 5, 7: 5, 9: 5}
