"""HTML extraction by deduction of a host's template from equivalence classes of tokens.

A page is a sequence of tokens: tags with their class and id, the words of text nodes of up to ``SHORT`` words (labels, prices), and
longer text nodes as one token each (notices). A token's occurrence vector tells how often each page of the host has it. Tokens that share
a vector are one equivalence class; those of two tokens or more that lie on enough pages are likely the template's. Enough are ``PAGES``, however
many pages the host has, for a class with a tag in it, so each page type of a large host keeps its own layout; a class of words alone is
a name or phrase of the content as well, and needs a share of ``SUPPORT`` of the host's pages besides.
Vectors aren't gathered: a token's page numbers and counts are summed as two 31-bit hashes, so equal sums are equal vectors and
each page's part is added where it is read.

The class whose tokens are once on each of its pages, and that has the most tokens, is the root. Its order is that of the mean places of its
tokens. On each page the longest run of root tokens in that order is taken; a root token that fails to be in it on more than ``TOLERANCE`` of its
pages isn't valid. The other classes are nested: valid if on every page all their tokens lie in one and the same gap of the root and each
turn of the class has its tokens in one order (no token comes twice before the others have come once). The template is the valid
classes; what is left between its tokens are the slots. ``main_slot`` is the gap of the root with the most characters on the page.

Defined results: scripts, styles, comments and doctypes are no tokens. Hosts of fewer than ``PAGES`` pages, and pages without a host (null or odd url),
have no template: all of their visible text is one slot, 0. A null or empty page has no slots and an empty text. Rows that repeat a ``page_id`` count as
pages each and have a result each. Other columns are not touched. An empty table gives an empty result.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silterra.llm.markup import pieces
from silterra.session import Scratch, prepare

PAGES = 4
#: Classes of words without a tag are on this share of the host's pages at least.
SUPPORT = 0.2
SHORT = 8
TOLERANCE = 0.1
#: Tokens of all templates together that are broadcast; with more, pages are joined with them by host.
BROADCAST_TOKENS = 200_000
FLUSH = 200_000

_NAMED = re.compile(r"\b(class|id)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_INLINE = {"a", "abbr", "b", "code", "em", "i", "small", "span", "strong", "sub", "sup", "u"}
_LOW = (1 << 31) - 1


#: Tags and tokens that a worker has seen lately; both are forgotten when there are too many.
_tags: dict[str, str] = {}
_keys: dict[str, int] = {}
_SEEN = 100_000


def _tag(raw: str, name: str, attributes: str) -> str:
    name = name.lower()
    if "class" in attributes or "id" in attributes or "CLASS" in attributes or "ID" in attributes:
        name += "".join(sorted(f" {k.lower()}={v.strip(chr(34) + chr(39))}" for k, v in _NAMED.findall(attributes)))
    if len(_tags) > _SEEN:
        _tags.clear()
    _tags[raw] = f"<{name}>"
    return _tags[raw]


def tokens(page: str) -> list[tuple[str, str | None]]:
    """``(token, text)``: the text of a text token is what it shows, that of a tag None."""
    out: list[tuple[str, str | None]] = []
    for m in pieces(page):
        raw = m[0]
        if m.lastindex == 4:
            words = (markup.unescape(raw) if "&" in raw else raw).split()
            if len(words) <= SHORT:
                out += [(w, w) for w in words]
            else:
                text = " ".join(words)
                out.append((text, text))
        elif m.lastindex == 3:
            out.append((_tags.get(raw) or _tag(raw, m[2], m[3]), None))
    return out


def key(token: str) -> int:
    found = _keys.get(token)
    if found is None:
        h = xxhash.xxh64_intdigest(token)
        found = h - (1 << 64) if h >> 63 else h
        if len(_keys) > _SEEN:
            _keys.clear()
        if len(token) < 64:
            _keys[token] = found
    return found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(host, token, pages, once, a, b, place, tag)`` sums, by as many pages as fit; token null counts the host's pages, tag those where it is one."""
    found: dict[tuple[str, int | None], list[float]] = {}

    def flush() -> pa.RecordBatch:
        keys, values = list(found), list(found.values())
        found.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *[pa.array([v[j] for v in values], pa.int64()) for j in range(4)], pa.array([v[4] for v in values], pa.float64()), pa.array([v[5] for v in values], pa.int64())],
            ["host", "token", "pages", "once", "a", "b", "place", "tag"],
        )

    for batch in batches:
        for host, ident, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            parsed = tokens(page or "")
            sequence = [key(t) for t, _ in parsed]
            tags = {k for k, (_, text) in zip(sequence, parsed, strict=True) if text is None}
            name = xxhash.xxh64_intdigest(f"{ident} {xxhash.xxh64_intdigest(page or '')}")
            place: dict[int, int] = {}
            for i, t in enumerate(sequence):
                place.setdefault(t, i)
            parts: dict[int, int] = {}
            for t, n in Counter(sequence).items():
                h = parts.get(n)
                if h is None:
                    h = parts[n] = xxhash.xxh64_intdigest(f"{name} {n}")
                v = found.get((host, t))
                if v is None:
                    v = found[host, t] = [0, 0, 0, 0, 0.0, 0]
                v[0] += 1
                v[1] += n == 1
                v[2] += h & _LOW
                v[3] += (h >> 32) & _LOW
                v[4] += place[t] / len(sequence)
                v[5] += t in tags
            found.setdefault((host, None), [0, 0, 0, 0, 0.0, 0])[0] += 1
            if len(found) > FLUSH:
                yield flush()
    yield flush()


def longest(order: list[int]) -> list[int]:
    """Indices of a longest increasing run (not of neighbours) of different numbers."""
    from bisect import bisect_left

    ends: list[int] = []
    at: list[int] = []
    back = [-1] * len(order)
    for i, x in enumerate(order):
        j = bisect_left(ends, x)
        if j == len(ends):
            ends.append(x)
            at.append(i)
        else:
            ends[j], at[j] = x, i
        back[i] = at[j - 1] if j else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


class Template:
    """Of one host: the root's tokens with their numbers in order, and the class of each nested token."""

    def __init__(self, token: list[int], kind: list[int], rank: list[int]):
        self.root = {t: r for t, k, r in zip(token, kind, rank, strict=True) if k == 0}
        self.nested = {t: k for t, k in zip(token, kind, strict=True) if k}
        self.sizes = Counter(self.nested.values())

    def gaps(self, sequence: list[int]) -> tuple[list[int], set[int]]:
        """The gap of the root that each token is in, and the places of the root's tokens that are in order."""
        places = [i for i, t in enumerate(sequence) if t in self.root]
        seen = Counter(sequence[i] for i in places)
        places = [i for i in places if seen[sequence[i]] == 1]
        held = {places[j] for j in longest([self.root[sequence[i]] for i in places])}
        gap, out = -1, []
        for i, t in enumerate(sequence):
            if i in held:
                gap = self.root[t]
            out.append(gap)
        return out, held


def _evidence(template: Template, sequence: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """``(token, 1, failed, least gap, greatest gap)`` of each token of the template on one page."""
    gap, held = template.gaps(sequence)
    turn: dict[int, set[int]] = {}
    where: dict[int, list[int]] = {}
    failed: set[int] = set()
    for i, t in enumerate(sequence):
        k = template.nested.get(t)
        if k is not None:
            w = where.setdefault(t, [gap[i], gap[i]])
            w[0], w[1] = min(w[0], gap[i]), max(w[1], gap[i])
            open_ = turn.setdefault(k, set())
            if t in open_:
                failed.add(t)
            open_.add(t)
            if len(open_) == template.sizes[k]:
                open_.clear()
    inside = {sequence[i] for i in held}
    for t in set(sequence):
        if t in template.root:
            yield t, 1, int(t not in inside), 0, 0
        elif t in where:
            yield t, 1, int(t in failed), where[t][0], where[t][1]


def _templates(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[int, int, Template | None, str]]:
    for b in batches:
        lists = [b.column(at + j).to_pylist() for j in range(3)]
        for i, page in enumerate(b.column(2).to_pylist()):
            yield b.column(1)[i].as_py(), i, Template(lists[0][i], lists[1][i], lists[2][i]) if lists[0][i] else None, page or ""


def _with(pages: DataFrame, template: DataFrame) -> DataFrame:
    """pages with their host's arrays ``(token, kind, rank)``."""
    per_host = template.groupBy("host").agg(F.collect_list(F.struct("token", "kind", "rank")).alias("t")).select("host", F.col("t.token").alias("token"), F.col("t.kind").alias("kind"), F.col("t.rank").alias("rank"))
    small = template.count() <= BROADCAST_TOKENS
    return pages.join(F.broadcast(per_host) if small else per_host, "host", "left").select("host", "page_id", "html", "token", "kind", "rank")


def deduce(pages: DataFrame) -> DataFrame:
    """``(host, token, kind, rank)`` of every template token of ``(host, page_id, html)``; kind 0 is the root, rank its order."""
    scratch = Scratch(prepare(pages.sparkSession))
    known = pages.where("host is not null").select("host", "page_id", "html")
    counted = known.mapInArrow(_counts, "host string, token long, pages long, once long, a long, b long, place double, tag long")
    counted = scratch.write(counted.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "once", "a", "b", "place", "tag")]), "counts")
    hosts = counted.where("token is null").where(F.col("pages") >= PAGES).select("host", F.col("pages").alias("all"))
    frequent = counted.where("token is not null").join(hosts, "host").where(F.col("pages") >= PAGES)
    frequent = scratch.write(frequent, "frequent")
    vector = ["host", "pages", "a", "b"]
    classes = frequent.groupBy(*vector, "all").agg(F.count("*").alias("size"), F.min((F.col("once") == F.col("pages")).cast("int")).alias("flat"), F.max("tag").alias("tag"))
    classes = classes.where("size >= 2").where((F.col("tag") > 0) | (F.col("pages") >= SUPPORT * F.col("all")))
    root = classes.where("flat = 1").groupBy("host").agg(F.max_by(F.struct("pages", "a", "b"), F.struct(F.col("size") * F.col("pages"), "a", "b")).alias("r")).select("host", F.col("r.pages").alias("rp"), F.col("r.a").alias("ra"), F.col("r.b").alias("rb"))
    tokens_ = frequent.join(classes.select(*vector), vector).join(root, "host")
    is_root = (F.col("pages") == F.col("rp")) & (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb"))
    from pyspark.sql import Window

    order = Window.partitionBy("host", "kind").orderBy(F.col("place") / F.col("pages"), "token")
    draft = tokens_.withColumn("kind", F.when(is_root, F.lit(0)).otherwise(F.greatest(F.lit(1), F.xxhash64("pages", "a", "b").bitwiseAND(F.lit(0x7FFFFFFF)))))
    draft = scratch.write(draft.select("host", "token", "kind", (F.row_number().over(order) - 1).cast("long").alias("rank"), "pages"), "draft")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[int]] = {}

        def flush() -> pa.RecordBatch:
            keys, values = list(found), list(found.values())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *[pa.array([v[j] for v in values], pa.int64()) for j in range(4)]], ["host", "token", "n", "bad", "low", "high"])

        for b in batches:
            hosts_ = b.column(0).to_pylist()
            for _, i, template, page in _templates(iter([b]), 3):
                for t, n, bad, low, high in _evidence(template, [key(x) for x, _ in tokens(page)]) if template else ():
                    v = found.setdefault((hosts_[i], t), [0, 0, low, high])
                    v[0], v[1], v[2], v[3] = v[0] + n, v[1] + bad, min(v[2], low), max(v[3], high)
                if len(found) > FLUSH:
                    yield flush()
        yield flush()

    seen = _with(known, draft).where("token is not null").mapInArrow(check, "host string, token long, n long, bad long, low long, high long")
    seen = scratch.write(seen.groupBy("host", "token").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.min("low").alias("low"), F.max("high").alias("high")), "seen")
    judged = draft.join(seen, ["host", "token"])
    good_root = judged.where((F.col("kind") == 0) & (F.col("bad") <= TOLERANCE * F.col("n")))
    nested = judged.where("kind <> 0").groupBy("host", "kind").agg(F.max((F.col("bad") > 0).cast("int")).alias("bad"), F.min("low").alias("low"), F.max("high").alias("high")).where("bad = 0 and low = high")
    good = good_root.select("host", "token", "kind", "rank").union(judged.join(nested.select("host", "kind"), ["host", "kind"]).select("host", "token", "kind", "rank"))
    return scratch.write(good, "template")


def slots(template: Template | None, page: str) -> list[tuple[int, str]]:
    """``(gap of the root, text)`` of each run of text between template tokens, in order."""
    parts = tokens(page)
    sequence = [key(t) for t, _ in parts]
    if template is None:
        gap, fixed = [0] * len(parts), set()
    else:
        gap, fixed = template.gaps(sequence)
        fixed = fixed | {i for i, t in enumerate(sequence) if t in template.nested}
    out: list[tuple[int, list[str]]] = []
    fresh = True
    for i, (token, text) in enumerate(parts):
        if i in fixed:
            fresh = True
        elif text is None:
            if token.strip("</>").split(" ")[0] not in _INLINE and out and not fresh:
                out[-1][1].append("\n")
        else:
            if fresh:
                out.append((gap[i], []))
                fresh = False
            out[-1][1].append(text)
    joined = [(g, re.sub(r" ?\n[ \n]*", "\n", " ".join(x)).strip()) for g, x in out]
    return [(g, x) for g, x in joined if x]


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, templated, slots, main_slot, text)`` of every row of ``(page_id, url, html)``.

    ``slots`` is ``array<struct<slot, text>>``, ``text`` that of the main slot.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.when(host != "", host).alias("host"), F.col("page_id").cast("long").alias("page_id"), "html")
    joined = _with(rows, deduce(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("slot", pa.int64()), ("text", pa.string())]))
        for b in batches:
            out = []
            for ident, _, template, page in _templates(iter([b]), 3):
                found = slots(template, page)
                size: Counter[int] = Counter()
                for g, x in found:
                    size[g] += len(x)
                main = min(size, key=lambda g: (-size[g], g)) if size else None
                out.append((ident, template is not None, [{"slot": g, "text": x} for g, x in found], main, "\n".join(x for g, x in found if g == main)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], kind), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.string())], ["page_id", "templated", "slots", "main_slot", "text"])

    return joined.mapInArrow(run, "page_id long, templated boolean, slots array<struct<slot: long, text: string>>, main_slot long, text string")
