import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from silterra.config import MinHashConfig, exact_config, minhash_config, parse_flat_yaml, subsample_config
from silterra.functions import text as T
from silterra.operators import apply, exact, minhash
from silterra.operators.components import connected_components

DOCS = "doc_id long, text string"


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_components_equal_union_find(spark, piece):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 4), (7, None)]
    got = {r.doc_id: r.cc_id for r in connected_components(spark.createDataFrame(edges, "u long, v long"), piece).collect()}
    want = union_find([(u, v) for u, v in edges if u is not None and v is not None and u != v])
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long"), piece).count() == 0


def test_exact_groups_are_raw_texts(spark):
    rows = [(1, "a"), (2, " a"), (3, "a"), (4, None), (5, None), (6, ""), (7, ""), (8, "A")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.cc_id, r.cc_size, r.cc_idx) for r in exact.text_groups(docs).collect()}
    assert got == {1: (1, 2, 0), 2: (2, 1, 0), 3: (1, 2, 1), 4: (4, 1, 0), 5: (5, 1, 0), 6: (6, 2, 0), 7: (6, 2, 1), 8: (8, 1, 0)}
    kept = exact.exact_prune(docs)
    assert {r.doc_id for r in kept.collect()} == {1, 2, 4, 5, 6, 8}
    assert exact.exact_prune(kept).count() == 6
    m = exact.metrics(exact.text_groups(docs)).first()
    assert (m.docs, m.groups, m.removed, m.removal_rate) == (8, 6, 2, 0.25)
    assert exact.metrics(exact.text_groups(docs.limit(0))).first().removal_rate == 0
    tagged = {r.doc_id: r.exact_dedup.cc_size for r in exact.exact_annotate(docs).collect()}
    assert tagged == {i: n for i, (_, n, _) in got.items()}


def test_repeated_ids_neither_vanish_nor_multiply(spark):
    rows = [(1, "a", "x"), (1, "a", "y"), (2, "b", "x"), (3, "a", "x"), (3, "c", "x"), (None, "a", "x"), (None, "a", "x"), (4, None, "x"), (4, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __doc string")
    plain = lambda df: sorted(((r.doc_id, r.text, r["__doc"]) for r in df.collect()), key=str)
    assert plain(exact.exact_prune(docs)) == sorted([r for r in rows if r != (3, "a", "x")], key=str)
    tagged = exact.exact_annotate(docs)
    assert plain(tagged) == sorted(rows, key=str)
    got = {(r.doc_id, r.text): tuple(r.exact_dedup) for r in tagged.collect()}
    assert got == {(1, "a"): (1, 2, 0), (3, "a"): (1, 2, 1), (2, "b"): (2, 1, 0), (3, "c"): (3, 1, 0), (None, "a"): (None, 1, 0), (4, None): (4, 1, 0)}
    found = spark.createDataFrame([(1, 1), (3, 1), (3, 1)], "doc_id long, cc_id long")
    assert plain(apply.annotate(docs, found)) == sorted(rows, key=str)
    assert plain(apply.prune(docs, found)) == sorted([r for r in rows if r[0] != 3], key=str)
    assert {r.doc_id: tuple(r.minhash) for r in apply.annotate(docs, found).collect()}[3] == (1, 2, 1)


def test_a_million_equal_texts(spark):
    docs = spark.range(1_000_000).select((F.col("id") * 7 % 1_000_003).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("the same").alias("text"))
    got = exact.text_groups(docs).agg(F.count("*").alias("n"), F.max("cc_size").alias("most"), F.countDistinct("cc_id").alias("groups"), F.max("cc_idx").alias("last"), F.sum(F.when(F.col("cc_size") > 1, F.col("cc_idx"))).alias("sum")).first()
    same = 1_000_000 - 333_334
    assert tuple(got) == (1_000_000, same, 333_335, same - 1, same * (same - 1) // 2)
    first = docs.where("text = 'the same'").orderBy("doc_id").limit(1).first().doc_id
    assert exact.text_groups(docs).where("cc_idx = 12345 and cc_size > 1").first().cc_id == first


def test_group_join_with_heavy_keys(spark):
    from silterra.operators.skew import group_join

    rows = spark.createDataFrame([(i, i % 2 if i < 900 else i) for i in range(1000)] + [(-1, None)], "i long, k long")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("least"))
    got = {r.i: (r.n, r.least) for r in group_join(rows, groups, ["k"], 1001).collect()}
    assert got == {i: (450, i % 2) if i < 900 else (1, i) for i in range(1000)}


def brute_vector(text, config):
    import regex

    low = "".join(c for c in text.lower() if not (c.isascii() and not c.isalnum() and not c.isspace()))
    tokens = regex.findall(T.WORD, " ".join(low.split()))
    n = config.ngram_size
    grams = {T.SEPARATOR.join(tokens)} if len(tokens) < n else {T.SEPARATOR.join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)}
    xs = [int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % T.PRIME for g in grams]
    return [min((a * x + b) % T.PRIME for x in xs) for a, b in minhash.permutations(config)]


def test_vectors_equal_brute_force(spark, sf):
    config = MinHashConfig(num_bands=4, band_size=3)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 1500").select("doc_id", "text").limit(60)
    docs = docs.union(spark.createDataFrame([(-1, ""), (-2, "x"), (-3, None)], DOCS))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: list(r.h) for r in minhash.minhash_vectors(docs, config).collect()}
    assert got == {i: brute_vector(t, config) for i, t in texts.items() if t is not None}


def test_permuted_residues():
    x = np.array([0, 1, T.PRIME - 1, T.PRIME - 2, 12345], np.uint64)
    ab = [(1, 0), (T.PRIME - 1, T.PRIME - 1), (1 << 30, 7)]
    out = np.empty((5, 3), np.int64)
    minhash.least_permuted(x, np.arange(5), ab, out)
    assert out.tolist() == [[(a * int(v) + b) % T.PRIME for a, b in ab] for v in x]


def test_fuzzy_groups(spark):
    rng = random.Random(0)
    vocab = [f"w{i}" for i in range(500)]
    base = [" ".join(rng.choice(vocab) for _ in range(120)) for _ in range(12)]
    rows = [(i * 10 + k, t if k == 0 else t.upper() + "!" if k == 1 else t + " more") for i, t in enumerate(base) for k in range(3)]
    rows += [(900, ""), (901, "..."), (902, None), (903, None)]
    docs = spark.createDataFrame(rows, DOCS)
    for config in (MinHashConfig(), MinHashConfig(portable=False)):
        got = {r.doc_id: r.cc_id for r in minhash.fuzzy_components(docs, config).collect()}
        assert got == {i * 10 + k: i * 10 for i in range(12) for k in range(3)} | {900: 900, 901: 900}
    components = minhash.fuzzy_components(docs, MinHashConfig())
    kept = apply.prune(docs, components)
    assert {r.doc_id for r in kept.collect()} == {i * 10 for i in range(12)} | {900, 902, 903}
    assert minhash.fuzzy_components(kept, MinHashConfig()).count() == 0
    tagged = {r.doc_id: tuple(r.minhash) for r in apply.annotate(docs, components).collect()}
    assert tagged[11] == (10, 3, 1) and tagged[902] == (902, 1, 0)
    exact_mode = minhash.fuzzy_components(docs, MinHashConfig(mode="exact"))
    assert exact_mode.count() == 0
    pairs = {(r.doc_a, r.doc_b): r.jaccard for r in apply.true_jaccard(docs, components, MinHashConfig()).collect()}
    assert len(pairs) == 12 * 2 + 1 and pairs[0, 1] == 1.0 and pairs[900, 901] == 1.0 and 0.9 < pairs[0, 2] < 1


def test_recall_of_bands(spark):
    """Pairs are found as often as the curve of bands and rows says."""
    config, rng = MinHashConfig(num_bands=14, band_size=8), random.Random(5)
    rows, n = [], 150
    for i in range(n):
        w = [f"w{rng.randrange(10_000)}" for _ in range(200)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(x if rng.random() > 0.03 else "new" for x in w))]
    docs = spark.createDataFrame(rows, DOCS)
    everything = spark.createDataFrame([(r, 2 * (r // 2)) for r in range(2 * n)], "doc_id long, cc_id long")
    jaccard = [r.jaccard for r in apply.true_jaccard(docs, everything, config).collect()]
    want = sum(1 - (1 - s**8) ** 14 for s in jaccard)
    got = minhash.star_edges(minhash.band_signatures(minhash.minhash_vectors(docs, config), config)).count()
    assert abs(got - want) < 4 * (n * 0.25) ** 0.5


def test_subsample(spark):
    docs = spark.createDataFrame([(i, f"t{i // 3}") for i in range(300)] + [(1000 + i, "big") for i in range(9)], DOCS)
    tagged = exact.exact_annotate(docs)
    assert apply.dup_aware_subsample(tagged, "exact_dedup", 0.0).count() == 0
    assert apply.dup_aware_subsample(tagged, "exact_dedup", 1.0).count() == 309
    assert apply.dup_aware_subsample(tagged, "exact_dedup", 1.0, 9).count() == 309
    assert apply.dup_aware_subsample(tagged, "exact_dedup", 1.0, 8).count() == 300
    half = apply.dup_aware_subsample(tagged, "exact_dedup", 0.5, None, 1)
    sizes = [r["count"] for r in half.groupBy(F.col("exact_dedup.cc_id")).count().collect()]
    assert set(sizes) <= {3, 9} and 30 < len(sizes) < 70 and half.columns == tagged.columns


def test_runs_of_equal_keys(spark):
    rows = [(0, i, k, f"{k}{i}") for i, k in enumerate("aabba")] + [(1, 0, "a", None), (1, 1, "a", "x"), (1, 2, None, "y"), (1, 3, None, "z")]
    lines = spark.createDataFrame(rows, "path_id long, line_num long, k string, text string")
    got = {(r.path_id, r.group_line): r.text for r in apply.concat_groups(lines, [F.col("k")]).collect()}
    assert got == {(0, 0): "a0\na1", (0, 2): "b2\nb3", (0, 4): "a4", (1, 0): "x", (1, 2): "y\nz"}


def test_a_killed_line_kills_later_rows_of_its_key(spark):
    lines = spark.createDataFrame([(0, i, k) for i, k in enumerate("ababa", 1)] + [(1, 1, "a")], "path_id long, line_num long, k string")
    killed = spark.createDataFrame([(0, 3), (0, 3)], "path_id long, line_num long")
    left = apply.concat_prune(lines, killed, [F.col("k")])
    assert sorted((r.path_id, r.line_num) for r in left.collect()) == [(0, 1), (0, 2), (0, 4), (1, 1)] and left.columns == lines.columns


def test_settings():
    source = "name: simple\nnum_bands: 14  # comment\nband_size: 8\nngram_size: 5\ntokenizer_str: 'uniseg'\nannotate_only: true\nsubsample_rate: 0.25\nconcat_key:\n- a.b\n- c\nmax_cc_size: null\nmax_lines_per_path: 100\n"
    given = parse_flat_yaml(source)
    assert given["subsample_rate"] == 0.25 and given["concat_key"] == ["a.b", "c"]
    c = minhash_config(given)
    assert (c.mode, c.num_bands, c.concat_key, c.annotate_only, c.tokenizer) == ("exact", 14, ("a.b", "c"), True, "uniseg")
    assert minhash_config(given | {"exact_override": True}).mode == "fuzzy"
    assert subsample_config(given).max_cc_size is None and exact_config({}).text_field == "text"
    with pytest.raises(ValueError):
        parse_flat_yaml("a:\n  b: 1\n  c\n")


def test_clashing_columns(spark):
    rows = [Row(doc_id=1, text="a", cc_id="mine", digest=None, v=3), Row(doc_id=2, text="a", cc_id="mine", digest=None, v=3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cc_id string, digest string, v int")
    assert exact.exact_prune(docs).count() == 1 and exact.exact_annotate(docs).count() == 2
    components = minhash.fuzzy_components(docs, MinHashConfig())
    assert apply.prune(docs, components).count() == 1 and apply.annotate(docs, components).columns == [*docs.columns, "minhash"]


def test_near_copies_in_unspaced_scripts(spark):
    """Sentences of Han and of kana without spaces, with one character in 100 changed, are near copies."""
    rng = random.Random(2)
    rows = []
    for i, (low, high) in enumerate([(0x4E00, 0x9FA0)] * 10 + [(0x3041, 0x3094)] * 10):
        text = [chr(rng.randrange(low, high)) for _ in range(300)]
        other = [*text]
        for k in (50, 150, 250):
            other[k] = chr(low)
        rows += [(2 * i, "".join(text)), (2 * i + 1, "".join(other))]
    docs = spark.createDataFrame(rows, DOCS)
    config = MinHashConfig(num_bands=20, band_size=4)
    assert {r.doc_id: r.cc_id for r in minhash.fuzzy_components(docs, config).collect()} == {i: i - i % 2 for i in range(40)}
    pairs = apply.true_jaccard(docs, spark.createDataFrame([(i, i - i % 2) for i in range(40)], "doc_id long, cc_id long"), config).collect()
    assert len(pairs) == 20 and all(0.85 < r.jaccard < 0.95 for r in pairs)


def test_byte_pair_settings(spark):
    config = minhash_config({"tokenizer_str": "bpe", "vocabulary": "/opt/tokenizers", "exact_override": True, "ngram_size": 2})
    texts = ["The quiet river runs under a bridge", "The quiet river runs under a tower", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    coder = T.bpe_encoding("/opt/tokenizers", "byte_bpe_50k.tiktoken")
    ids = [[str(x) for x in coder.encode_ordinary(t.lower())] for t in texts[:3]]
    grams = [{T.SEPARATOR.join(t[i : i + 2]) for i in range(max(1, len(t) - 1))} for t in ids]
    want = {i: {int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % T.PRIME for g in s} for i, s in enumerate(grams)}
    vectors = {i: [min((a * x + b) % T.PRIME for x in s) for a, b in minhash.permutations(config)] for i, s in want.items()}
    assert {r.doc_id: r.h for r in minhash.minhash_vectors(docs, config).collect()} == vectors
    pair = apply.true_jaccard(docs, spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, cc_id long"), config).first()
    assert (pair.n_inter, pair.n_union) == (len(grams[0] & grams[1]), len(grams[0] | grams[1]))
    for missing in ({"tokenizer_str": "bpe"}, {"tokenizer_str": "p50k", "vocabulary": "/opt/tokenizers"}, {"tokenizer_str": "cl100k"}):
        with pytest.raises(ValueError, match="vocabulary"):
            minhash.minhash_vectors(docs, minhash_config(missing | {"exact_override": True}))
    with pytest.warns(UserWarning, match="no tokenizer"):
        T.tokens(F.col("text"), "cl200k")


def test_cheap_hashes_find_the_same_groups(spark):
    texts = [" ".join(f"w{(i // 3) * 100 + k}" for k in range(60)) + f" {i % 3}" for i in range(60)] + ["", "—", "ไทย ลาว"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    for portable in (True, False):
        config = MinHashConfig(num_bands=20, band_size=4, portable=portable)
        assert {r.doc_id: r.cc_id for r in minhash.fuzzy_components(docs, config).collect()} == {i: i - i % 3 for i in range(60)}


def test_jaccard_in_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(apply, "BLOCK", 3)
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 40))) for _ in range(50)]
    texts[20] = texts[3] = texts[7]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(50, None), (49, texts[49])], DOCS)
    cc = {i: 0 if i < 30 else i // 4 * 4 for i in range(51)}
    config = MinHashConfig(ngram_size=3)
    sets = {i: {T.SEPARATOR.join(w[k : k + 3]) for k in range(max(1, len(w) - 2))} for i, t in enumerate(texts) for w in [T.boundary_cut(t)]}
    first = {i: min(j for j in sets if cc[j] == cc[i] and sets[j] == sets[i]) for i in sets}
    want = {(cc[i], i, j, len(sets[i] & sets[j]), len(sets[i] | sets[j])) for i in sets for j in sets if i < j and cc[i] == cc[j] and (first[i] == i and first[j] == j or first[j] == i)}
    got = apply.true_jaccard(docs, spark.createDataFrame(list(cc.items()), "doc_id long, cc_id long"), config).collect()
    assert len(got) == len(want) and {tuple(r)[:5] for r in got} == want
