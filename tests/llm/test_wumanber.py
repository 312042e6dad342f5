import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Row

from silterra.llm import wumanber as wm


def brute(docs, items, window=wm.WINDOW, least=wm.LEAST):
    out = {}
    for d, text in docs:
        w = re.findall(r"\w+", text.lower())
        for item, test in items:
            t = re.findall(r"\w+", test.lower())
            if len(t) < least and len(" ".join(t).encode()) < wm.SHORT:
                if w == t:
                    out[d, item] = (0, 1)
                continue
            n = min(window, len(t))
            tests = {tuple(t[k : k + n]) for k in range(len(t) - n + 1)}
            at = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in tests]
            if at:
                out[d, item] = (at[0], len(at))
    return out


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    vocab = ["a", "b", "ab", "été", "ñandú", *(f"w{i}" for i in range(40))]
    items = [(i, " ".join(rng.choice(vocab, n))) for i, n in enumerate([3, 7, 8, 10, 13, 14, 20, 60])]
    docs = []
    for d in range(80):
        t = [" ".join(rng.choice(vocab, rng.integers(0, 400)))]
        if d % 2 == 0:
            test = items[d // 2 % len(items)][1].split()
            cut = rng.integers(0, max(1, len(test) - 12))
            t += [", ".join(test[cut:]).upper(), " ".join(rng.choice(vocab, 5))]
        docs.append((d, " ".join(t)))
    items += [(20, "phenomenological extraordinarily uncharacteristic"), (21, "the end")]
    docs += [(80, "a b " + items[-2][1].upper() + ". c"), (81, "The end!"), (82, "this is the end"), (83, items[0][1]), (84, items[1][1] + ".")]
    return docs, items


def test_equal_to_brute_force(spark):
    docs, items = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 10 and {(80, 20), (81, 21), (83, 0), (84, 1)} <= want.keys() and (82, 21) not in want
    for part_bytes in (wm.PART_BYTES, 100):
        got = {(r.doc_id, r.item_id): (r.first_word, r.windows) for r in wm.contaminations(frame, tests, part_bytes).collect()}
        assert got == want
    left = {r.doc_id for r in wm.drop_contaminated(frame, tests, 100).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}


def test_every_occurrence_at_any_offset():
    rng = np.random.default_rng(1)
    strings = [(i, " ".join(rng.choice(list("abc"), 9))) for i in range(30)]
    automaton = wm.Automaton(strings)
    text = " ".join(rng.choice(list("abc"), 40_000))
    w = text.split()
    tests = {}
    for i, s in strings:
        tests.setdefault(tuple(s.split()), set()).add(i)
    want = {(k, i) for k in range(len(w) - 8) for i in tests.get(tuple(w[k : k + 9]), ())}
    got = {(int(k), i) for _, _, _, s, word in wm.matches(pa.array([text]), automaton) for x, k in zip(s, word, strict=True) for i in automaton.items[x]}
    assert got == want and len(want) > 10


def test_awkward_rows(spark):
    p = " ".join(f"p{i}" for i in range(20))
    long = " ".join(f"q{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, p), (3, p), (None, p), (4, long + " " + p), (5, long), (6, "p0 p1 p2"), (7, p[: len(p) // 2]), (8, "日本" * 20)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, item_id="mine", windows=None) for i, t in rows], "doc_id long, text string, item_id string, windows int")
    tests = spark.createDataFrame([(1, p, "x"), (1, p, "x"), (2, None, "x"), (None, p, "x"), (3, "", "x"), (4, "p0 p1 p2", "x"), (5, "日本" * 10, "x")], "item_id long, text string, doc_id string")
    got = sorted(map(tuple, wm.contaminations(docs, tests).collect()))
    assert got == [(3, 1, 0, 16), (4, 1, 60_000, 8), (6, 4, 0, 1), (8, 5, 0, 28)]
    left = wm.drop_contaminated(docs, tests)
    assert left.schema == docs.schema
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 5, 7]
    assert wm.contaminations(docs, tests.limit(0)).count() == 0 and wm.drop_contaminated(docs, tests.limit(0)).count() == 10
    assert wm.contaminations(docs.limit(0), tests).count() == 0


def test_sql_has_the_same_short_items(spark):
    import duckdb

    docs, items = corpus(3)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert {(d, i): (f, n) for d, i, f, n in con.sql(wm.ORACLE).fetchall()} == brute(docs, items)
