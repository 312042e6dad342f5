import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silterra.config import MinHashConfig
from silterra.functions import text as T
from silterra.operators import minhash

TEXTS = ["Can't stop, won't\nstop 3.5 été", None, "", "...", "a b a b a b a b", "这是 一个。", "x" * 3000 + " y"]


def test_pieces_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(T, "PIECE", 10)
    texts = pa.array(["abcd", "éé", None, "ab", "c" * 50, "", "d"])
    assert list(T.pieces(texts)) == [(0, ["abcd", "éé", None, "ab"]), (4, ["c" * 50]), (5, ["", "d"])]
    assert list(T.pieces(texts.slice(1, 3))) == [(0, ["éé", None, "ab"])] and list(T.pieces(texts.slice(0, 0))) == []


def held(frame, monkeypatch, batch):
    """The rows of the batches that the Arrow function of frame makes of one."""
    taken = []
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.mapInArrow", lambda self, run, schema: taken.append(run))
    frame()
    return [len(b) for b in taken[0](iter([batch]))]


@pytest.mark.parametrize("make", [lambda d: T.uniseg_tokens(d), lambda d: T.bpe_tokens(d, "/opt/tokenizers")], ids=["uniseg", "bpe"])
def test_tokens_of_a_batch_are_held_by_pieces(spark, monkeypatch, make):
    docs = spark.createDataFrame([], "doc_id long, text string")
    batch = pa.record_batch([pa.array(range(100)), pa.array(["word " * 1000] * 100)], ["doc_id", "t"])
    rows = held(lambda: make(docs), monkeypatch, batch)
    assert sum(rows) == 100 and max(rows) * 5000 <= T.PIECE


def test_joined_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    tokens = T.tokens(F.col("text"), "uniseg")
    want = docs.select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.array_join(tokens, T.SEPARATOR).alias("tokens")).collect()
    got = T.joined_tokens(docs)
    assert sorted(got.collect()) == sorted(want) and got.columns == ["doc_id", "n_tokens", "tokens"]
    assert T.joined_tokens(docs.where("text is null")).collect() == [(1, None, None)]


def test_shingle_digests(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.digest) for r in minhash.shingle_digests(docs, MinHashConfig(ngram_size=3)).collect()}
    sets = {r.doc_id: r.s for r in docs.where("text is not null").select("doc_id", T.shingles(T.tokens(F.col("text"), "uniseg"), 3).alias("s")).collect()}
    assert got == {i: (len(s), hashlib.md5("\x1e".join(s).encode()).hexdigest()) for i, s in sets.items()} and len(got) == 6
