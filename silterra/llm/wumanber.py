"""Benchmark decontamination by Wu-Manber search for many test strings at once.

A test string is a window of ``WINDOW`` words of a benchmark item, or a whole item of fewer words. An item of fewer than ``LEAST`` words and than
``SHORT`` bytes is a phrase that clean texts have as well: it is searched too, but only a text that is nothing else contains it. Texts and strings are compared as words in one form (see
``textbytes``), each between two spaces, so a match begins and ends with a word and case and punctuation don't matter.

With ``m`` the length of the shortest string, a table tells for each block of ``BLOCK`` bytes how far its last
occurrence in any string's first ``m`` bytes is from their end. A cursor looks at the block before it and skips by that
much; at a distance of none, the block's bucket names the strings that end so, and these are compared byte by byte. Many cursors
move at once, one for each ``SEGMENT`` bytes of text, so each step is an array operation.

The automaton is broadcast. A benchmark of more than ``PART_BYTES`` is cut into parts by a hash of its item ids, and
documents are searched once for each part, so what is broadcast is bounded and nothing is left out.

Defined results: items with a null id or text or without words, and documents with a null text have no windows; documents with a null id
aren't listed by ``contaminations``, but ``drop_contaminated`` drops them all the same if they contain a test string. Rows that
repeat an ``item_id`` are one item with the windows of all its rows. Rows that repeat a ``doc_id`` are listed as one document,
with the positions of all its rows counted. Of equal windows in several items each item is named. An empty benchmark contaminates nothing.
Other columns are not touched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silterra.llm.textbytes import WORDS_SQL, fold, text_chunks, words
from silterra.session import prepare

WINDOW = 13
LEAST = 8
SHORT = 32
BLOCK = 8
SEGMENT = 256
PART_BYTES = 4 << 20
_SPACE = 32


def normalised(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes, place of each word, first word of each text)``: each text is a zero, a space, and its words with a space after each."""
    start, end, _, first = words(buf, offsets)
    size = end - start
    before = np.arange(len(start)) - first[0] + 1
    text = np.repeat(np.arange(1, len(first)), np.diff(first))
    place = np.cumsum(size) - size + before + 2 * text - 1
    out = np.full(int(size.sum()) + len(start) + 2 * (len(offsets) - 1) + 1, _SPACE, np.uint8)
    at = np.arange(int(size.sum())) + np.repeat(place - (np.cumsum(size) - size), size)
    out[at] = fold(buf)[np.arange(len(at)) + np.repeat(start - (np.cumsum(size) - size), size)]
    ends = np.append(place, len(out))[np.minimum(first[:-1], len(place))] - 2
    if len(start):
        out[ends[np.diff(first) > 0]] = 0
    return out, place, first


def _blocks(rows: np.ndarray) -> np.ndarray:
    """Each row of ``BLOCK`` bytes as one number."""
    return np.ascontiguousarray(rows).view(np.uint64).ravel()


class Automaton:
    """Shift table, buckets and strings; ``items`` of a string are those that contain it. ``whole`` has the numbers of strings that are whole texts, after all others."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, least: int = LEAST):
        owners: dict[bytes, set[int]] = defaultdict(set)
        alone: dict[bytes, set[int]] = defaultdict(set)
        for item, text in items:
            raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            s, e, _, _ = words(raw, np.array([0, len(raw)]))
            low = fold(raw)
            w = [low[a:b].tobytes() for a, b in zip(s, e, strict=True)]
            if len(w) < least and sum(map(len, w)) + len(w) - 1 < SHORT:
                if w:
                    alone[b" ".join(w)].add(item)
                continue
            for k in range(max(1, len(w) - window + 1)):
                owners[b" " + b" ".join(w[k : k + window]) + b" "].add(item)
        self.strings = sorted(owners)
        self.whole = {s: len(owners) + k for k, s in enumerate(sorted(alone))}
        self.items = [sorted(owners[s]) for s in self.strings] + [sorted(alone[s]) for s in self.whole]
        self.shortest = m = min(map(len, self.strings), default=0)
        if not self.strings:
            return
        self.bits = int(np.clip(np.ceil(np.log2(len(self.strings) * m)) + 3, 12, 24))
        heads = np.frombuffer(b"".join(s[:m] for s in self.strings), np.uint8).reshape(-1, m)
        self.shift = np.full(1 << self.bits, m - BLOCK + 1, np.int32)
        for j in range(BLOCK - 1, m):
            np.minimum.at(self.shift, self._hash(_blocks(heads[:, j - BLOCK + 1 : j + 1])), m - 1 - j)
        last = self._hash(_blocks(heads[:, m - BLOCK : m]))
        self.bucket = np.argsort(last, kind="stable")
        self.suffix = last[self.bucket]
        self.head = _blocks(heads[:, :BLOCK])

    def _hash(self, block: np.ndarray) -> np.ndarray:
        return (block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def find(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(string, place)`` of every occurrence in buf."""
        m = self.shortest
        if not m or len(buf) < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = np.arange(m - 1, len(buf), SEGMENT)
        high = np.minimum(low + SEGMENT, len(buf))
        hits = []
        at = low
        blocks = np.ndarray((len(buf) - BLOCK + 1,), np.uint64, buf, strides=(1,))  # the block that begins at each byte
        while len(at):
            h = self._hash(blocks[at - (BLOCK - 1)])
            step = self.shift[h]
            zero = step == 0
            if zero.any():
                hits.append((at[zero], h[zero]))
            at = at + np.maximum(step, 1)
            on = at < high
            at, high = at[on], high[on]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end, h = (np.concatenate(x) for x in zip(*hits, strict=True))
        a, z = np.searchsorted(self.suffix, h), np.searchsorted(self.suffix, h, "right")
        n = z - a
        string = self.bucket[np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)]
        place = np.repeat(end - m + 1, n)
        same = np.flatnonzero(blocks[place] == self.head[string])
        raw = memoryview(buf)
        good = [i for i in same if raw[place[i] : place[i] + len(self.strings[string[i]])] == self.strings[string[i]]]
        return string[good], place[good]


def matches(column: pa.Array, automaton: Automaton) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first row, rows, row, string, first word)`` of the occurrences in each piece of a text column."""
    for i, n, buf, offsets in text_chunks(column):
        out, place, first = normalised(buf, offsets)
        string, at = automaton.find(out)
        word = np.searchsorted(place, at + 1)
        row = np.searchsorted(first, word, "right") - 1
        word = word - first[row]
        if automaton.whole:
            # Texts of as few words, up to the space after the last one.
            few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < LEAST))
            for r in few[place[first[few + 1] - 1] - place[first[few]] < SHORT]:
                a, z = place[first[r]], place[first[r + 1] - 1]
                end = z + out[z : z + SHORT].tobytes().find(b" ")
                if (k := automaton.whole.get(out[a:end].tobytes())) is not None:
                    string, row, word = np.append(string, k), np.append(row, r), np.append(word, 0)
        yield i, n, row, string, word


def automata(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> Iterator[Automaton]:
    """The benchmark's parts, one after the other."""
    tests = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    for k in range(parts):
        rows = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).toArrow()
        yield Automaton(list(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist(), strict=True)))


def contaminations(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(doc_id, item_id, first_word, windows)``: at how many places a document has test strings of an item, and the first."""
    spark = prepare(docs.sparkSession)
    schema = "doc_id long, item_id long, first_word long, windows long"
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for automaton in automata(docs, benchmark, part_bytes):
        shared = spark.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                seen: dict[tuple[int, int], list[int]] = {}
                for i, _, row, string, word in matches(b.column(1), shared.value):
                    places = sorted({(i + int(r), item, int(w)) for r, s, w in zip(row, string, word, strict=True) for item in shared.value.items[s]})
                    for r, item, w in places:
                        x = seen.setdefault((r, item), [w, 0])
                        x[1] += 1
                if seen:
                    keys = list(seen)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[[r for r, _ in keys]], pa.int64()), pa.array([x for _, x in keys], pa.int64()), pa.array([seen[k][0] for k in keys], pa.int64()), pa.array([seen[k][1] for k in keys], pa.int64())],
                        ["doc_id", "item_id", "first_word", "windows"],
                    )

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found.groupBy("doc_id", "item_id").agg(F.min("first_word").alias("first_word"), F.sum("windows").alias("windows"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of docs without those that contain a test string, with all their columns."""
    spark = prepare(docs.sparkSession)
    where = docs.columns.index("text")
    for automaton in automata(docs, benchmark, part_bytes):
        shared = spark.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(len(b), bool)
                for i, _, row, _, _ in matches(b.column(where), shared.value):
                    clean[i + row] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


ORACLE = f"""
WITH w AS (
  SELECT 1 AS kind, doc_id AS id, {WORDS_SQL} AS ws FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 2, item_id, {WORDS_SQL} FROM benchmark WHERE text IS NOT NULL
), tests AS (
  SELECT DISTINCT id AS item_id, least({WINDOW}, len(ws)) AS n, array_to_string(ws[k:k + {WINDOW - 1}], ' ') AS s, len(ws) < {LEAST} AND strlen(array_to_string(ws, ' ')) < {SHORT} AS alone
  FROM (SELECT id, ws, unnest(range(1, greatest(1, len(ws) - {WINDOW - 1}) + 1)) AS k FROM w WHERE kind = 2 AND len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM tests),
places AS (
  SELECT id AS doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS s, len(ws) = n AS all_
  FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM w, sizes WHERE kind = 1 AND len(ws) >= n)
)
SELECT doc_id, item_id, min(k) - 1 AS first_word, count(DISTINCT k) AS windows FROM places JOIN tests USING (n, s) WHERE all_ OR NOT alone GROUP BY doc_id, item_id
"""
