import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from silterra.llm import langid as li

SCHEMA = "kind string, id long, text string, is_html boolean, declared string, host string, lang string, p string"


def words(rng, alphabet, n):
    return " ".join("".join(rng.choice(list(alphabet), rng.integers(2, 8))) for _ in range(n))


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "aeiouéèç"}
    train = [(words(rng, a, 60), k) for k, a in alphabets.items() for _ in range(20)]
    rows = []
    for i in range(150):
        k = "aa" if i % 5 == 0 else "bb" if i % 5 < 3 else "cc"
        text = words(rng, alphabets[k], int(rng.integers(0, 30)))
        host = None if i % 11 == 0 else f"h{i % 4}.{k}{i % 2}.example.{k}" if i % 3 else f"mixed{i % 2}.example.com"
        rows.append(("x", i, text, False, k.upper() if i % 4 else None, host, "mine", "mine"))
    return train, rows


def brute(model, rows):
    """The same posterior, one text at a time."""
    table, n = model.table, len(model.languages)
    score, post = {}, {}
    for _, i, text, _, _, _, _, _ in rows:
        raw = (text or "").encode()
        c = [int(li._LETTER[x]) for x in raw]
        grams = [((c[j] << 16 | c[j + 1] << 8 | c[j + 2]) * 0x9E3779B1 % (1 << 32)) >> (32 - li.BITS) for j in range(len(c) - 2) if sum(x != 0 for x in c[j : j + 3]) >= 2]
        score[i] = [min(len(grams), li.EVIDENCE) * float(np.mean(table[k][grams], dtype=np.float64)) if grams else 0.0 for k in range(n)]
        e = [math.exp(s - max(score[i])) for s in score[i]]
        post[i] = [x / sum(e) for x in e]
    prior = [(sum(p[k] for p in post.values()) + 1) / (len(rows) + n) for k in range(n)]
    said = defaultdict(lambda: defaultdict(list))
    info = {}
    for _, i, _, _, d, h, _, _ in rows:
        host = h and h.lower()
        info[i] = {"declared": d and d.lower(), "host": host, "domain": host and ".".join(host.split(".")[-2:]), "suffix": host.split(".")[-1] if host and "." in host else None}
        for key, value in info[i].items():
            if value is not None:
                said[key][value].append(i)
    out = {}
    for i in post:
        s = []
        for k in range(n):
            x = score[i][k]
            for key in ("declared", "suffix"):
                value = info[i][key]
                if value is not None:
                    every = [j for v in said[key].values() for j in v]
                    mine = said[key][value]
                    x += math.log((sum(post[j][k] for j in mine) + len(mine) / len(every)) / (sum(post[j][k] for j in every) + 1))
            p = prior[k]
            if info[i]["host"]:
                for key in ("domain", "host"):
                    mine = [j for j in said[key][info[i][key]] if j != i]
                    p = (sum(post[j][k] for j in mine) + li.SMOOTH * p) / (len(mine) + li.SMOOTH)
            s.append(x + math.log(p))
        best = max(range(n), key=lambda k: (s[k], -k))
        out[i] = (model.languages[best], 1 / sum(math.exp(x - s[best]) for x in s))
    return out


def test_equal_to_brute_force(spark):
    train, rows = corpus()
    model = li.fit([t for t, _ in train], [k for _, k in train])
    got = {r.id: (r.lang, r.confidence) for r in li.identify(spark.createDataFrame(rows, SCHEMA), model).collect()}
    want = brute(model, rows)
    assert {i: k for i, (k, _) in got.items()} == {i: k for i, (k, _) in want.items()}
    assert max(abs(got[i][1] - want[i][1]) for i in want) < 1e-5


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = li.train(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1")
    got = li.identify(li.document_texts(held), model).join(held.select(F.col("doc_id").alias("id"), F.col("lang").alias("truth")), "id")
    right = got.agg(F.avg((F.col("lang") == F.col("truth")).cast("int"))).first()[0]
    assert right >= 0.97
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = li.identify(li.page_texts(pages), model).join(pages.select(F.col("page_id").alias("id"), F.regexp_extract("url", "://[^/]+/([a-z]+)/", 1).alias("truth")), "id")
    assert got.count() == pages.count() and got.where("lang = truth").count() >= 0.97 * pages.count()


def test_awkward_rows(spark):
    train, _ = corpus()
    model = li.fit([t for t, _ in train], [k for _, k in train])
    long = "abcd " * 60_000
    rows = [("d", 1, None, False, None, None), ("d", 2, "", None, "bb", None), ("d", 3, "123 !!", False, None, "only"), ("d", 4, long, False, None, "h.bb"), ("d", 4, long, False, None, "h.bb"), ("d", None, "éèç éè çç", False, None, "h.bb"), ("d", 6, "<b>éèç</b><script>abcd abcd</script> éèçé", True, None, "")]
    texts = spark.createDataFrame([(*r, "mine", "mine") for r in rows], SCHEMA)
    got = [(r.id, r.lang) for r in li.identify(texts, model).collect()]
    found = dict(got)
    assert len(got) == 7 and all(k for _, k in got)
    assert found[4] == "aa" and found[None] == "cc" and found[6] == "cc" and found[2] == found[1] == found[3]
    assert li.identify(texts.limit(0), model).count() == 0
    none = li.train(spark.createDataFrame([], "doc_id long, lang string, text string"))
    assert {r.lang for r in li.identify(texts, none).collect()} == {None}
    assert li.likelihoods(pa.array([None, "", "a"]), model)[1].tolist() == [0, 0, 0]


def test_the_sample_is_bounded(spark):
    rows = [(i, "aa" if i % 3 else "bb", f"text number {i}") for i in range(900)] + [(901, None, "x"), (None, "aa", "x"), (902, "cc", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    sizes = []
    kept = li.fit
    try:
        li.fit = lambda texts, langs: sizes.append({k: langs.count(k) for k in set(langs)}) or kept(texts, langs)
        li.train(docs, 50)
    finally:
        li.fit = kept
    assert sizes == [{"aa": 50, "bb": 50}]


def test_declared_language_of_odd_tags(spark):
    cases = ["<HTML lang='fr'>", "<html xml:lang=en lang=\"de-AT\">", "<html>lang=es", None, "", "<html " * 1000, "<p>no</p>", "<htmlx lang=de>", "<html\n class='x'\nLANG = es >"]
    frame = spark.createDataFrame([(i, "http://x.org/", h) for i, h in enumerate(cases)], "page_id long, url string, html string")
    got = {r.id: r.declared for r in li.page_texts(frame).collect()}
    assert [got[i] for i in range(len(cases))] == ["fr", "de", None, None, None, None, None, None, "es"]
