import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silterra.functions import text as T

PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [("foo-bar, Baz!", "foobar baz"), (PUNCTUATION, ""), ("a\u00a0b\u0085c\u2003d\n\te", "a b c d e"), ("  x  ", "x"), ("ÉTÉ «ok»", "été «ok»"), ("", ""), (None, None), ("\n \t", "")],
)
def test_clean(spark, raw, want):
    assert one(spark, raw, T.clean) == want


def test_words_and_bytes(spark):
    assert one(spark, "ab  c9, été", lambda c: T.tokens(c, "uniseg")) == ["ab", " ", "c9", " ", "été"]
    assert one(spark, "aé€", lambda c: T.tokens(c, "other")) == [str(b) for b in "aé€".encode()]
    assert one(spark, "", lambda c: T.tokens(c, "other")) == [] and one(spark, "", lambda c: T.tokens(c, "uniseg")) == []


@pytest.mark.parametrize(("k", "count"), [(0, 1), (4, 1), (5, 1), (6, 2), (9, 5)])
def test_shingle_counts(spark, k, count):
    text = " ".join("abcdefghi"[:k])  # k letters and k - 1 spaces
    tokens = lambda c: F.filter(T.tokens(c, "uniseg"), lambda x: x != " ")
    got = one(spark, text, lambda c: T.shingles(tokens(c), 5))
    assert len(got) == count and all(len(s.split(T.SEPARATOR)) <= 5 for s in got)


def test_shingles_of_one_token_and_repeats(spark):
    assert one(spark, "a a b", lambda c: T.shingles(T.tokens(c, "uniseg"), 0)) == ["a", " ", "b"]
    assert len(one(spark, "a a a a", lambda c: T.shingles(T.tokens(c, "uniseg"), 2))) == 2


def test_unicode_boundaries(spark):
    docs = spark.createDataFrame([(1, "can't stop 3.5 été"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in T.uniseg_tokens(docs).collect()}
    assert got[1] == ["cant", " ", "stop", " ", "35", " ", "été"] and got[2] is None and got[3] == []


def test_bpe_round_trip(spark, sf):
    coder = T.bpe_encoding("/opt/tokenizers", "byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50).union(spark.createDataFrame([(-1, "<|endoftext|> x", None, None, None), (-2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    cleaned = {r.doc_id: r.c for r in docs.select("doc_id", T.clean(F.col("text")).alias("c")).collect()}
    got = {r.doc_id: r.tokens for r in T.bpe_tokens(docs, "/opt/tokenizers").collect()}
    assert all((coder.decode(t) if t is not None else None) == cleaned[i] for i, t in got.items()) and got[-2] is None


def test_byte_pairs_equal_merging_by_rank(spark, sf):
    """Brute force: of neighbouring pieces the pair of the least rank is merged until no pair has one."""
    import base64
    import sys

    import regex

    sys.path.append("/opt/tokenizers")
    import public_tokenizers

    with open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}

    def encode(text):
        out = []
        for word in regex.findall(public_tokenizers.PATTERN, text):
            parts = [bytes([b]) for b in word.encode()]
            while len(parts) > 1:
                rank, k = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
                if rank == 1 << 40:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            out += [ranks[p] for p in parts]
        return out

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cleaned = {r.doc_id: r.c for r in docs.select("doc_id", T.clean(F.col("text")).alias("c")).collect()}
    got = {r.doc_id: r.tokens for r in T.bpe_tokens(docs, "/opt/tokenizers").collect()}
    assert len(got) == 200 and got == {i: encode(c) for i, c in cleaned.items()}


def test_hashes(spark):
    import hashlib

    assert one(spark, "x", T.hash31) == int(hashlib.md5(b"x").hexdigest()[:8], 16) % T.PRIME


def test_words_are_unicodes_where_the_regex_is_used(spark):
    import itertools
    import random

    import regex

    plain = [chr(c) for c in range(0x20, 0x10000) if regex.match(f"[{T.PLAIN}]", chr(c))]
    rng = random.Random(1)
    texts = [f"a{c}b {c} 1{c}2 {c}{c}" for c in plain] + ["".join(x) for x in itertools.product("aé1— ж", repeat=5)] + ["".join(rng.choice(plain) for _ in range(400)) for _ in range(300)]
    texts = [" ".join(t.split()) for t in texts]
    assert all(regex.findall(T.WORD, t) == T.boundary_cut(t) for t in texts) and len(plain) > 700
    rows = [(i, t) for i, t in enumerate([*texts, "这是一个测试", "ひらがなカタカナ漢字", "l’été d’or", "e\u0301 \u0301x", "m² ½", "ไทย ลาว", "👩‍👩‍👧 🇩🇪🇫🇷", None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    both = T.uniseg_tokens(docs).withColumnRenamed("tokens", "want").join(docs.select("doc_id", T.tokens(F.col("text"), "uniseg").alias("got")), "doc_id")
    assert both.where("not (want <=> got)").count() == 0 and both.count() == len(rows)
    odd = ["", " ", "...", "a", " \u2003Ab, c--d\u0085 \x1c e! ", "ΟΔΟΣ Σ ΣΑΣ.", "İX ǅ", "l’été d’or", "e\u0301 \u0301x", "这是 一个。", "x" * 70_000, "👩‍👩‍👧 🇩🇪🇫🇷", "a\U0001d400b"]
    rows = list(enumerate([*texts[::29], *odd, *[" ".join(rng.choice([*plain, "\t", "ß", "\u00a0", "\u3000", "字", "."]) for _ in range(60)) for _ in range(200)]]))
    want = {r.doc_id: r.t for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", T.tokens(F.col("text"), "uniseg").alias("t")).collect()}
    batch = pa.record_batch([pa.array([i for i, _ in rows]), pa.nulls(len(rows), pa.list_(pa.string())), pa.array([t for _, t in rows])], ["doc_id", "tokens", "text"])
    got = {}
    for keys, raw, start, end, first in T.token_bounds(batch, None):
        for k, i in enumerate(keys.column(0).to_pylist()):
            got[i] = [bytes(raw[a:z]).decode() for a, z in zip(start[first[k] : first[k + 1]], end[first[k] : first[k + 1]])]
    assert got == want
