import hashlib
import random

import numpy as np

from silterra.functions import text as T
from silterra.functions.digests import md5_words
from silterra.operators import minhash


def test_words_of_md5():
    rng = random.Random(4)
    raw = rng.randbytes(70_000)
    size = [*range(70), 119, 120, 5000] * 3 + [rng.randrange(56) for _ in range(40_000)]
    start = np.array([rng.randrange(len(raw) - n + 1) for n in size])
    start[:70] = len(raw) - np.arange(70)
    end = start + np.array(size)
    first, second = md5_words(memoryview(raw), start, end, both=True)
    want = [hashlib.md5(raw[a:z]).digest()[:8] for a, z in zip(start, end, strict=True)]
    assert [x.tobytes() for x in np.stack([first, second], 1).astype("<u4")] == want
    assert (md5_words(memoryview(raw), start, end)[0] == first).all()
    assert len(md5_words(memoryview(b""), np.zeros(0, np.int64), np.zeros(0, np.int64))[0]) == 0


def test_residues_permuted_by_fractions():
    """Every factor, shift and residue at the ends of their ranges, where rounding could move one over a step."""
    p, rng = T.PRIME, random.Random(9)
    ends = [0, 1, 2, 3, p // 2, p // 2 + 1, p - 3, p - 2, p - 1]
    x = np.array(ends + [rng.randrange(p) for _ in range(3000)], np.uint64)
    ab = [(a, b) for a in ends[1:] for b in ends] + [(rng.randrange(1, p), rng.randrange(p)) for _ in range(50)]
    ab += [(a, -a * int(v) % p) for a, v in zip((rng.randrange(1, p) for _ in range(50)), x[9:], strict=False)]  # a residue of 0
    out = np.empty((len(x), len(ab)), np.int64)
    minhash.least_permuted(x, np.arange(len(x)), ab, out)
    assert out.tolist() == [[(a * int(v) + b) % p for a, b in ab] for v in x]
    few = np.empty((2, len(ab)), np.int64)
    minhash.least_permuted(x, np.array([0, 5]), ab, few)
    assert (few == [out[:5].min(0), out[5:].min(0)]).all()


def test_line_breaks_are_no_reason_to_cut_by_unicodes_rules(monkeypatch):
    def never(text):
        raise AssertionError(text)

    monkeypatch.setattr(T, "boundary_cut", never)
    raw, start, end, first = T._cut(["One line,\r\n\tand another\n", "", " \n.", "été"])
    got = [[bytes(raw[a:z]).decode() for a, z in zip(start[i:j], end[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert got == [["one", " ", "line", " ", "and", " ", "another"], [], [], ["été"]]


def test_sets_of_shingles_are_hashed_at_once(spark):
    from silterra.config import MinHashConfig
    from silterra.operators.apply import shingle_sets

    docs = spark.createDataFrame([(7, 1, "b a b a"), (7, 2, ""), (7, 3, None)], "cc_id long, doc_id long, text string")
    got = {r.doc_id: (r.size, bytes(r.hashes)) for r in shingle_sets(docs, MinHashConfig(ngram_size=2)).collect()}
    halves = lambda s: np.frombuffer(hashlib.md5(s.encode()).digest()[:8], "<u4").tolist()
    number = lambda s: halves(s)[0] << 32 | halves(s)[1]
    sets = {1: ["b\x1f ", " \x1fa", "a\x1f ", " \x1fb"], 2: [""]}
    assert got == {i: (len(s), np.array(sorted(map(number, s)), np.uint64).tobytes()) for i, s in sets.items()}
