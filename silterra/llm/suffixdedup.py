"""Repeated passages by a depth-limited radix sort of suffixes.

Every word position starts a suffix. Suffixes are ordered only through their first ``LENGTH`` words, by passes over
digits of ``DIGIT`` words from the most significant one on; a suffix whose digits so far are unlike all others leaves
after each pass, and the groups left after the last are exactly the windows of ``LENGTH`` words that occur repeatedly.
All passes share one shuffle, on the first digit. Suffixes whose anchor is common (see ``COMMON``) are instead
counted by all their digits before anything is shuffled, and each is told of its group where it lies if that is heavy, so a passage that
a third of all texts have is in no one task.

Most suffixes never reach the first pass. Each window has an anchor, the least hash of its runs of ``DIGIT`` words. Equal windows
have equal anchors, so a window whose anchor occurs once in the corpus isn't repeated; anchors are one in eighteen of
the positions and travel alone. Documents that are word for word copies of one with a smaller id are repeated as a
whole and sort no suffixes of their own.

Words are compared with ASCII letters folded and punctuation ignored (see ``textbytes``). Of equal windows that with
the smallest ``(doc_id, position)`` is the first; words that another window covers are cut.

Defined results: documents with a null id or text and those shorter than ``LENGTH`` words have no windows and stay as they
are. Rows that repeat a ``doc_id`` are one document and never each other's copies. A passage that repeats within one
document counts. A document that loses all its words goes. Other columns keep their values, except ``n_chars``,
which is counted anew where words were cut. An empty table has no windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silterra.llm.textbytes import U64, WORDS_SQL, mix, text_chunks, words
from silterra.operators.skew import free_name, group_join
from silterra.session import Scratch, prepare

LENGTH = 50
DIGIT = 16
#: At most so many anchors are common: those that more than ``FEW`` texts and this share of all anchors of all texts have.
COMMON = 1 << 16
FEW = 32


def digits(h: np.ndarray) -> np.ndarray:
    """A hash of each run of ``DIGIT`` words."""
    step = 1
    while step < DIGIT and len(h) > step:
        h = mix(h[:-step] * U64(0x9E3779B97F4A7C15) + h[step:])
        step *= 2
    return h if step == DIGIT else h[:0]


def _slide(x: np.ndarray, n: int, least: np.ufunc) -> np.ndarray:
    """The least (or most) of every n neighbours."""
    if len(x) < n:
        return x[:0]
    step = 1
    while 2 * step <= n:
        x = least(x[:-step], x[step:])
        step *= 2
    return least(x[: len(x) - (n - step)], x[n - step :]) if n > step else x


def windows(h: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(start, text, anchor, g)`` of each window within one text; g is the hash of each run of words."""
    g = digits(h)
    anchor = _slide(g, length - DIGIT + 1, np.minimum)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    text = text[: len(anchor)]
    start = np.flatnonzero(first[1:][text] - np.arange(len(anchor)) >= length)
    return start, text[start], anchor[start], g


def _scan(docs: DataFrame, length: int) -> DataFrame:
    """``(doc_id, n, hi, lo, anchors, twice)`` of each text with a window: twice tells which of its anchors it has at two places or more."""
    width = length - DIGIT + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, n, buf, offsets in text_chunks(b.column(1)):
                _, _, h, first = words(buf, offsets)
                start, text, anchor, g = windows(h, first, length)
                if not len(start):
                    continue
                # A place is an anchor's if some window over it has its hash for the least.
                least = np.zeros(len(g) + width, U64)
                least[start + width] = anchor
                place = np.flatnonzero((_slide(least, width, np.maximum)[1 : len(g) + 1] == g) & (g > 0))
                owner = np.searchsorted(first, place, "right") - 1
                order = np.lexsort((g[place], owner))
                owner, value = owner[order], g[place][order]
                new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])))
                twice = np.diff(np.append(new, len(owner))) > 1
                owner, value = owner[new], value[new]
                has, begin = np.unique(owner, return_index=True)
                at = pa.array(np.append(begin, len(owner)).astype(np.int32))
                k = np.diff(first)
                scale = mix(np.arange(len(h), dtype=U64) - np.repeat(first[:-1], k).astype(U64))
                sums = []
                for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
                    total = np.append(U64(0), np.cumsum(mix(h * U64(salt) + scale)))
                    sums.append((total[first[1:]] - total[first[:-1]])[has].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, n).take(pa.array(has)), pa.array(k[has]), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(at, pa.array(value.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(twice))],
                    ["doc_id", "n", "hi", "lo", "anchors", "twice"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, hi long, lo long, anchors array<long>, twice array<boolean>")


def _suffixes(docs: DataFrame, length: int) -> DataFrame:
    """``(d1, rest, doc_id, pos, common)`` of each window whose anchor is among its document's ``anchors``, or its ``common`` ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            often = np.unique(b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U64))
            for i, n, buf, offsets in text_chunks(b.column(1)):
                _, _, h, first = words(buf, offsets)
                start, text, anchor, g = windows(h, first, length)
                known = np.unique(lists.slice(i, n).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U64))
                if not len(start) or not len(known):
                    continue
                kept = known[np.minimum(np.searchsorted(known, anchor), len(known) - 1)] == anchor
                start, text, anchor = start[kept], text[kept], anchor[kept]
                common = np.isin(anchor, often)
                ids = b.column(0).slice(i, n).to_numpy(zero_copy_only=False)
                steps = [*range(DIGIT, length - DIGIT, DIGIT), length - DIGIT]
                second, third = g[start + steps[0]], np.zeros(len(start), U64)
                for s in steps[1:]:
                    third = mix(third * U64(0x9E3779B97F4A7C15) + g[start + s])
                rest = (second & U64(0xFFFFFFFF00000000)) | (third >> U64(32))
                for j in range(0, len(start), 1 << 16):
                    part = slice(j, j + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(g[start[part]].view(np.int64)), pa.array(rest[part].view(np.int64)), pa.array(ids[text[part]]), pa.array((start - first[text])[part].astype(np.int32)), pa.array(common[part])], ["d1", "rest", "doc_id", "pos", "common"])

    return docs.mapInArrow(run, "d1 long, rest long, doc_id long, pos int, common boolean")


def _merge(grouped: DataFrame, length: int) -> DataFrame:
    """Runs of overlapping or touching windows: of all as ``spans``, of those that aren't first as ``cuts``."""

    def runs(pos: np.ndarray) -> list[list[int]]:
        if not len(pos):
            return []
        new = np.flatnonzero(np.append(True, pos[1:] > pos[:-1] + length))
        last = np.append(new[1:], len(pos)) - 1
        return np.stack([pos[new], pos[last] + length], 1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, cuts = [], []
            for x in b.column(1):
                code = np.unique(np.asarray(x.values))
                spans.append(runs(np.unique(code >> 1)))
                cuts.append(runs(code[code & 1 == 1] >> 1))
            kind = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind), pa.array(cuts, kind)], ["doc_id", "spans", "cuts"])

    return grouped.mapInArrow(run, "doc_id long, spans array<array<int>>, cuts array<array<int>>")


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, spans, cuts)`` of every document with a repeated window; spans are ``[first word, end)``, in order."""
    if length < 2 * DIGIT:
        raise ValueError(f"length is {2 * DIGIT} words at least")
    scratch = Scratch(prepare(docs.sparkSession))
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scan = scratch.write(_scan(docs, length), "scan")
    same = scan.groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("original"), F.max("doc_id").alias("last"), F.count("*").alias("rows")).where("original <> last").drop("last")
    alike = group_join(scan.select("doc_id", "n", "hi", "lo"), scratch.write(same, "same"), ["n", "hi", "lo"], scan.count(), "rows")
    alike = scratch.write(alike.select("doc_id", "n", "original").distinct(), "alike")
    copies = alike.where("doc_id <> original").select("doc_id").hint("shuffle_hash")
    anchors = scan.join(copies, "doc_id", "left_anti").select("doc_id", F.explode(F.arrays_zip("anchors", "twice")).alias("a")).select("doc_id", F.col("a.anchors").alias("anchor"), F.col("a.twice").alias("twice"))
    anchors = scratch.write(anchors, "anchors")
    total = anchors.count()
    values = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("twice").alias("twice"), F.count("*").alias("n")).where("lo <> hi or twice")
    values = scratch.write(values.select("anchor", "n", (F.col("n") > F.lit(FEW + total / COMMON)).alias("common")), "values")
    wanted = group_join(anchors.select("doc_id", "anchor"), values, ["anchor"], total).groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("common"), F.col("anchor"))).alias("often"))
    all_ = scratch.write(_suffixes(docs.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "anchors", "often"), length), "suffixes")
    place = F.struct("doc_id", "pos")
    rows = all_.where("not common")
    keys: list = ["d1"]
    for key in (None, F.shiftright("rest", 32), F.col("rest").bitwiseAND(F.lit(0xFFFFFFFF))):
        if key is not None:
            name = f"d{len(keys) + 1}"
            rows, keys = rows.withColumn(name, key), [*keys, name]
        group = Window.partitionBy(*keys)
        rows = rows.withColumns({"least": F.min(place).over(group), "most": F.max(place).over(group)}).where("least <> most")
    often = all_.where("common").select("d1", "rest", "doc_id", "pos")
    groups = often.groupBy("d1", "rest").agg(F.min(place).alias("least"), F.max(place).alias("most"), F.count("*").alias("n")).where("least <> most").drop("most")
    often = group_join(often, scratch.write(groups, "groups"), ["d1", "rest"], often.count())
    rows = rows.select("doc_id", "pos", "least").union(often.select("doc_id", "pos", "least"))
    code = F.shiftleft(F.col("pos").cast("long"), 1) + (place != F.col("least")).cast("long")
    found = _merge(rows.select("doc_id", code.alias("code")).groupBy("doc_id").agg(F.collect_list("code").alias("codes")), length)
    found = scratch.write(found, "found")
    whole = F.array(F.array(F.lit(0), F.col("n").cast("int")))
    none = F.array().cast("array<array<int>>")
    copied = alike.groupBy("doc_id").agg(F.max("n").alias("n"), F.max((F.col("doc_id") != F.col("original")).cast("int")).alias("copy")).select("doc_id", whole.alias("all"), F.when(F.col("copy") == 1, whole).otherwise(none).alias("gone"))
    return found.join(copied, "doc_id", "full").select("doc_id", F.coalesce("all", "spans").alias("spans"), F.coalesce(F.when(F.size("gone") > 0, F.col("gone")), F.col("cuts"), none).alias("cuts"))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, start_word, end_word, cut_words)``: a row for each maximal run of repeated windows.

    ``cut_words`` of its words lie in windows that are not the first of their kind.
    """
    cut = F.aggregate("cuts", F.lit(0), lambda n, c: n + F.greatest(F.lit(0), F.least(c[1], F.col("span")[1]) - F.greatest(c[0], F.col("span")[0])))
    return repeated(docs, length).select("doc_id", "cuts", F.explode("spans").alias("span")).select("doc_id", F.col("span")[0].alias("start_word"), F.col("span")[1].alias("end_word"), cut.alias("cut_words"))


def cut_text(raw: bytes, cuts: list[list[int]]) -> str:
    """The text without the given runs of words and what follows each of them up to the next word."""
    buf = np.frombuffer(raw, np.uint8)
    start, _, _, _ = words(buf, np.array([0, len(buf)]))
    bounds = np.append(start, len(raw))
    kept, at = [], 0
    for a, z in cuts:
        kept.append(raw[at : bounds[a]])
        at = int(bounds[min(z, len(start))])
    kept.append(raw[at:])
    return b"".join(kept).decode("utf-8", "replace")


def drop_repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with later occurrences of repeated passages cut from ``text``; same columns.

    What is cut is shuffled to the documents at every size, as it grows with them; no text is sorted.
    """
    free = free_name(docs)
    gone = repeated(docs, length).where("size(cuts) > 0").select(F.col("doc_id").alias(f"{free}id"), F.col("cuts").alias(f"{free}cuts")).hint("shuffle_hash")
    joined = docs.join(gone, docs["doc_id"] == gone[f"{free}id"], "left").drop(f"{free}id")
    where, names = docs.columns.index("text"), docs.columns
    count = names.index("n_chars") if "n_chars" in names and docs.schema["n_chars"].dataType.typeName() in ("long", "integer") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts, columns = b.column(len(names)), [b.column(k) for k in range(len(names))]
            hit = np.flatnonzero(np.asarray(cuts.is_valid()))
            if len(hit):
                new = {int(i): cut_text(columns[where][int(i)].as_py().encode(), cuts[int(i)].as_py()) for i in hit}
                text, keep = columns[where].to_pylist(), np.ones(len(b), bool)
                for i, t in new.items():
                    text[i], keep[i] = t, any(ch.isalnum() for ch in t)
                columns[where] = pa.array(text, columns[where].type)
                if count is not None:
                    chars = columns[count].to_pylist()
                    for i, t in new.items():
                        chars[i] = len(t)
                    columns[count] = pa.array(chars, columns[count].type)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in columns], names)
            else:
                yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, docs.schema)


ORACLE = f"""
WITH w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT doc_id, p, md5(array_to_string(ws[p + 1:p + {LENGTH}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {LENGTH - 1})) AS p FROM w WHERE len(ws) >= {LENGTH})),
rep AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1 AS cut FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1),
marked AS (SELECT doc_id, p, kind, CASE WHEN p > lag(p) OVER (PARTITION BY kind, doc_id ORDER BY p) + {LENGTH} THEN 1 ELSE 0 END AS new FROM (SELECT doc_id, p, 0 AS kind FROM rep UNION ALL SELECT doc_id, p, 1 FROM rep WHERE cut)),
runs AS (SELECT kind, doc_id, min(p) AS a, max(p) + {LENGTH} AS z FROM (SELECT *, sum(new) OVER (PARTITION BY kind, doc_id ORDER BY p) AS g FROM marked) GROUP BY kind, doc_id, g)
SELECT s.doc_id, s.a AS start_word, s.z AS end_word, coalesce(sum(c.z - c.a), 0)::BIGINT AS cut_words
FROM runs s LEFT JOIN runs c ON c.kind = 1 AND c.doc_id = s.doc_id AND c.a >= s.a AND c.z <= s.z WHERE s.kind = 0 GROUP BY s.doc_id, s.a, s.z
"""
