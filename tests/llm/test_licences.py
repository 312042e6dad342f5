import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Row

from silterra.llm import licences as li

PROSE = "the quiet river of stone runs under a bridge and this bird may file by any person".split()


def w(text):
    return re.findall(r"[a-z0-9]+", text.lower())


def brute(texts):
    """The same result with dictionaries: name -> (license, cosine, share)."""
    templates = [(n, w(t)) for n, ts in sorted(li.TEMPLATES.items()) for t in ts]
    terms = {x for _, t in templates for x in t}
    lines = [line for t in texts.values() if t is not None for line in t.split("\n")]
    df = Counter(x for line in lines for x in set(w(line)) & terms)
    idf = {x: math.log((len(lines) + 2) / (df[x] + 1)) for x in terms}
    other = max(idf.values())
    vector = lambda ws: {x: n * idf.get(x, other) for x, n in Counter(ws).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    for name, text in texts.items():
        runs, open_ = [], None
        for line in (text or "").split("\n"):
            ws = w(line)
            if not ws:
                continue
            mass = sum(idf.get(x, other) for x in ws)
            if sum(idf[x] for x in ws if x in terms) >= 0.5 * mass:
                if open_ is None:
                    runs.append(open_ := [])
                open_ += ws
            else:
                open_ = None
        best = None
        for ws in runs:
            v = vector(ws)
            scores = []
            for n, t in templates:
                u = vector(t)
                scores.append(round(sum(v.get(x, 0) * u[x] for x in u) / norm(v) / norm(u), 9))
            c = max(scores)
            if c >= li.THRESHOLD and (best is None or c >= best[1]):
                best = (templates[scores.index(c)][0], c, len(ws) / len(w(text)))
        if best:
            out[name] = best
    return out


def corpus():
    rng = np.random.default_rng(0)
    notices = [t for ts in li.TEMPLATES.values() for t in ts]
    texts = {}
    for i in range(120):
        body = [" ".join(rng.choice(PROSE + [f"w{k}" for k in range(60)], rng.integers(1, 14))) for _ in range(rng.integers(0, 8))]
        if i % 3 == 0:
            body.insert(rng.integers(len(body) + 1), str(rng.choice(notices)))
        if i % 7 == 0:
            body.append("Copyright 2020 somebody. " + str(rng.choice(notices)) + "\n\nAll rights of the License.")
        texts[i] = "\n".join(body)
    return texts


def test_equal_to_brute_force():
    texts = corpus()
    m = li.Matcher()
    column = pa.array(list(texts.values()))
    m.weigh(*m.frequencies(column))
    template, cosine, share = m.best(column)
    got = {i: (m.names[template[k]], round(cosine[k], 6), round(share[k], 6)) for k, i in enumerate(texts) if template[k] >= 0}
    want = {i: (n, round(c, 6), round(s, 6)) for i, (n, c, s) in brute(texts).items()}
    assert got == want and len(want) > 40


def test_lines_of_the_test_tables():
    m = li.Matcher()
    lines = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."]
    m.weigh(*m.frequencies(pa.array(["the of a\n" * 500 + x for x in lines])))
    template, cosine, _ = m.best(pa.array([f"Text of many words here.\n{x}\nMore words follow then." for x in lines] + ["the version of the work is under the file"]))
    assert [m.names[t] if t >= 0 else None for t in template] == ["Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0", None]


def test_inheritance_and_awkward_rows(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    prose = "\n".join(" ".join(f"x{i}{j}" for j in range(9)) for i in range(30))
    rows = [(1, "a/LICENSE", mit), (2, "a/b/COPYING", gpl), (3, "a/b/c/d.py", prose), (4, "a/x.py", prose), (5, "a/bb/x.py", prose), (6, "z/x.py", prose), (7, "a/b/y.py", mit + "\n" + prose), (8, "z/h.py", prose + "\n" + mit),
            (9, "a/b/none", None), (10, "a/empty", ""), (11, None, prose), (12, None, mit), (13, "z/long.py", ("word " * 100 + "\n") * 600 + mit), (4, "a/x.py", prose), (None, "a/q", prose)]
    files = spark.createDataFrame([Row(doc_id=i, path=p, text=t, license="mine", dir=None, of=1) for i, p, t in rows], "doc_id long, path string, text string, license string, dir string, of int")
    got = sorted(((r.doc_id or 0), r.license, r.how) for r in li.scan(files).collect())
    want = [(0, "MIT", "inherited"), (1, "MIT", "file"), (2, "GPL-3.0", "file"), (3, "GPL-3.0", "inherited"), (4, "MIT", "inherited"), (4, "MIT", "inherited"), (5, "MIT", "inherited"), (7, "MIT", "header"), (8, "MIT", "header"), (9, "GPL-3.0", "inherited"), (10, "MIT", "inherited"), (12, "MIT", "file"), (13, "MIT", "header")]
    assert got == want
    assert li.scan(files.limit(0)).count() == 0
    root = files.select("doc_id", "path", "text").union(spark.createDataFrame([(99, "LICENSE", mit)], "doc_id long, path string, text string"))
    assert (6, "MIT", "inherited") in [(r.doc_id, r.license, r.how) for r in li.scan(root).collect()]


def test_whole_licence_texts_are_files(spark):
    whole = {n: t[0] for n, t in li.licence_texts().items()}
    assert {"MIT", "Apache-2.0", "MPL-1.1", "MPL-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "BSD-2-Clause", "BSD-3-Clause"} <= set(whole)
    prose = "\n".join(" ".join(f"x{i}{j}" for j in range(9)) for i in range(1500))
    rows, want = [], {}
    for k, (name, text) in enumerate(sorted(whole.items())):
        unwrapped = "Copyright (c) 2019 Jane Doe, John Roe and contributors\n\n" + " ".join(text.split())
        for j, (path, body, how) in enumerate([("LICENSE", text, "file"), ("one/COPYING", unwrapped, "file"), ("src/a.py", prose, "inherited"), ("src/b.py", text + "\n" + prose, "header")]):
            rows.append((4 * k + j, f"{name}/{path}", body))
            want[4 * k + j] = (name, how)
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    assert {r.doc_id: (r.license, r.how) for r in li.scan(files).collect()} == want


def test_notices_inside_long_lines(spark):
    before, after = "some prose about a garden and a river that runs on every day of the week", "and more prose about winter"
    notices = [("Licensed under the Apache License, Version 2.0", "Apache-2.0"), ("Released under the MIT License", "MIT"), ("This work is licensed under the GNU General Public License, version 3", "GPL-3.0"), ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0")]
    rows, want = [], {}
    for notice, name in notices:
        for text in (f"{before}. {notice}. A{after[1:]}.", f"{before} {notice} {after.replace('and ', '')}", f"/*! page v3.1 | (c) Jane Doe | {notice} */!function(e,t){{return e.x=t}}(this,9);var winter=1;", f"{before}. " * 50 + notice):
            want[len(rows)] = (name, "header")
            rows.append((len(rows), f"a/{len(rows)}", text))
    rows += [(1000 + i, f"b/{i}", f"{x} {before}") for i, x in enumerate(["the license of the software is under the work of any person,", "the park is licensed under the license of the city,", "under the terms of this file"])]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    assert {r.doc_id: (r.license, r.how) for r in li.scan(files).collect()} == want
