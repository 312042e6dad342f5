"""Language identification by Bayesian fusion of text, markup, address and host evidence.

The text's likelihood under each language is that of its letter trigrams (bytes; ASCII letters folded), learned from labelled
texts. Trigrams of one text depend on each other, so a long text counts as ``EVIDENCE`` trigrams with its mean log-likelihood. The
language that the markup declares and the suffix of the address (the host's last label) each have a likelihood under each language, and a
host has a prior over languages. All three are counted over all texts by grouped aggregation of the text's posterior: a host's prior is
smoothed by that of its domain, this by the prior of all texts; a text's own part is taken out of its host's and domain's counts.
The posterior is the product of all four, scaled.

Defined results: a null or empty text, or one without letters, has no likelihood and gets what markup, address and host say, at last the
prior of all texts. Declarations and suffixes that are missing say nothing; a text without a host has the prior of all texts. Rows are judged one by
one, so rows that repeat an id or have none each have a result. Equal posteriors go to the first language in the alphabet. Without labelled texts the
language is null. Other columns are not touched. An empty table gives an empty result.
"""

from __future__ import annotations

import html as markup
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silterra.llm.markup import pieces
from silterra.llm.textbytes import text_chunks
from silterra.session import Scratch, prepare

BITS = 17
EVIDENCE = 60
#: Labelled texts of each language that the likelihoods are learned from, at most; which ones, a hash of their ids decides.
SAMPLE = 400
#: Texts that a domain's prior is worth beside a host's own texts, and that of all texts beside a domain's.
SMOOTH = 10.0

_LETTER = np.zeros(256, np.uint32)
for _b in range(256):
    if _b >= 0x80 or chr(_b).isalpha():
        _LETTER[_b] = ord(chr(_b).lower()) if _b < 0x80 else _b


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray


def trigrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place, hash)`` of every run of three bytes of one text with two letters or more."""
    if len(buf) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = _LETTER[buf]
    inside = (c != 0).view(np.uint8)
    good = inside[:-2] + inside[1:-1] + inside[2:] >= 2
    for k in (1, 2):
        late = offsets[1:] - k
        good[late[(late >= 0) & (late < len(good))]] = False
    at = np.flatnonzero(good)
    h = ((c[:-2] << np.uint32(16) | c[1:-1] << np.uint32(8) | c[2:])[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return at, h.astype(np.int64)


def fit(texts: list[str], languages: list[str]) -> LanguageModel:
    names = sorted(set(languages))
    count = np.zeros((len(names), 1 << BITS))
    for k, name in enumerate(names):
        for _, _, buf, offsets in text_chunks(pa.array([t for t, x in zip(texts, languages, strict=True) if x == name], pa.string())):
            count[k] += np.bincount(trigrams(buf, offsets)[1], minlength=1 << BITS)
    total = count.sum(1, keepdims=True)
    return LanguageModel(names, np.log((count + 0.1) / (total + 0.1 * (1 << BITS))).astype(np.float32))


def likelihoods(column: pa.Array, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each text under each language, and its trigrams' number."""
    out, n = np.zeros((len(column), len(model.languages))), np.zeros(len(column), np.int64)
    for i, m, buf, offsets in text_chunks(column):
        at, h = trigrams(buf, offsets)
        first = np.searchsorted(at, offsets)
        n[i : i + m] = np.diff(first)
        if not len(h):
            continue
        some = np.flatnonzero(np.diff(first) > 0)
        for k in range(len(model.languages)):
            out[i + some, k] = np.add.reduceat(model.table[k][h], first[some], dtype=np.float64)
    return out * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None], n


def visible(html: str) -> str:
    """What a page shows: its text, with a space for each other piece."""
    return markup.unescape("".join(m[0] if m.lastindex == 4 else " " for m in pieces(html, ("script", "style"))))


def train(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Learn from at most ``sample`` texts of each ``lang``. Only their texts reach the driver."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text")
    sizes = docs.where("lang is not null and doc_id is not null").groupBy("lang").count().collect()
    if not sizes:
        return LanguageModel([], np.zeros((0, 1 << BITS), np.float32))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    limit = F.lit(0)
    for r in sizes:  # about a quarter more than are needed, cut below
        limit = F.when(F.col("lang") == r["lang"], F.lit(min(1 << 40, int((1 << 40) * (1.25 * sample + 20) / r["count"])))).otherwise(limit)
    rows = known.where(place < limit).select("lang", place.alias("place"), "text").toArrow().sort_by([("place", "ascending"), ("text", "ascending")])
    kept, taken = [], dict.fromkeys((r["lang"] for r in sizes), 0)
    for k, name in enumerate(rows["lang"].to_pylist()):
        taken[name] += 1
        if taken[name] <= sample:
            kept.append(k)
    rows = rows.take(kept)
    return fit(rows["text"].to_pylist(), rows["lang"].to_pylist())


def _posterior(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def identify(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """``(kind, id, lang, confidence)`` for each row of ``(kind, id, text, is_html, declared, host)``."""
    scratch, names = Scratch(prepare(texts.sparkSession)), model.languages
    kinds = "kind string, id long, lang string, confidence double"
    base = texts.select(F.col("kind").cast("string").alias("kind"), F.col("id").cast("long").alias("id"), "text", F.coalesce("is_html", F.lit(False)).alias("is_html"), F.lower("declared").alias("declared"), F.lower("host").alias("host"))
    if not names:
        return base.select("kind", "id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"))
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, is_html = b.column(2), b.column(3).to_numpy(zero_copy_only=False)
            if is_html.any():
                text = pa.array([visible(t) if h and t is not None else t for t, h in zip(text.to_pylist(), is_html, strict=True)], pa.string())
            score, _ = likelihoods(text, shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), b.column(5), _lists(score), _lists(_posterior(score))], ["kind", "id", "declared", "host", "score", "p"])

    rows = scratch.write(base.mapInArrow(run, "kind string, id long, declared string, host string, score array<double>, p array<double>"), "text")
    rows = rows.withColumns({"domain": F.substring_index("host", ".", -2), "suffix": F.when(F.col("host").contains("."), F.substring_index("host", ".", -1))})
    sums = [F.sum(F.col("p")[k]) for k in range(len(names))]

    def counts(key: str, kept: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
        return kept.groupBy(key, *extra).agg(F.array(*sums).alias(f"{key}_p"), F.count("*").alias(f"{key}_n"))

    hosts = counts("host", rows.where("host is not null"), ("domain",))
    hosts = scratch.write(hosts, "hosts")
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(F.col("host_p")[k]) for k in range(len(names))]).alias("domain_p"), F.sum("host_n").alias("domain_n"))
    hosts = scratch.write(hosts.join(domains, "domain").select("host", "host_p", "host_n", "domain_p", "domain_n"), "priors")
    all_ = rows.agg(F.array(*sums).alias("p"), F.count("*").alias("n")).first()
    prior = (np.array([x or 0.0 for x in all_["p"]]) + 1) / (all_["n"] + len(names))
    tables = {}
    for key in ("declared", "suffix"):
        # Of each language's texts that say anything, how many say this: smoothed by how often it is said at all.
        said = scratch.write(counts(key, rows.where(f"{key} is not null")), key)
        whole = said.agg(F.array(*[F.sum(F.col(f"{key}_p")[k]) for k in range(len(names))]).alias("p"), F.sum(f"{key}_n").alias("n")).first()
        if whole["n"]:
            share = F.col(f"{key}_n") / F.lit(float(whole["n"]))
            fused = F.array(*[F.log((F.col(f"{key}_p")[k] + share) / F.lit(whole["p"][k] + 1.0)) for k in range(len(names))])
            tables[key] = said.select(key, fused.alias(f"{key}_score"))
    out = rows.join(hosts, "host", "left")
    for key, table in tables.items():
        out = out.join(table, key, "left")
    for key in ("declared", "suffix"):
        if key not in tables:
            out = out.withColumn(f"{key}_score", F.lit(None).cast("array<double>"))

    def smoothed(k: int) -> Column:
        own = F.col("p")[k]
        domain = (F.greatest(F.lit(0.0), F.col("domain_p")[k] - own) + F.lit(SMOOTH * float(prior[k]))) / (F.col("domain_n") - 1 + SMOOTH)
        return F.coalesce((F.greatest(F.lit(0.0), F.col("host_p")[k] - own) + SMOOTH * domain) / (F.col("host_n") - 1 + SMOOTH), F.lit(float(prior[k])))

    score = F.array(*[F.col("score")[k] + F.coalesce(F.col("declared_score")[k], F.lit(0.0)) + F.coalesce(F.col("suffix_score")[k], F.lit(0.0)) + F.log(smoothed(k)) for k in range(len(names))])
    out = out.select("kind", "id", score.alias("s")).withColumn("top", F.array_max("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    found = F.element_at(F.array(*map(F.lit, names)), F.array_position("s", F.col("top")).cast("int"))
    return out.select("kind", "id", found.alias("lang"), F.round(1 / total, 6).alias("confidence")).to(texts.sparkSession.createDataFrame([], kinds).schema)


def _declared(html: str) -> Column:
    """The ``lang`` of the first html tag; each step is linear in the page's length, also where the tag isn't closed."""
    at = F.expr(f"locate('<html', lower({html}))")
    tag = F.when(at > 0, F.substring_index(F.substring(F.col(html), at + 5, F.length(html)), ">", 1))
    return F.regexp_extract(tag, r"(?is)^\W(?:.*\W)?lang\s*=\s*[\"']?([a-z]{2,3})", 1)


def page_texts(pages: DataFrame) -> DataFrame:
    """What ``identify`` takes, of ``(page_id, url, html)``."""
    said, host = _declared("html"), F.regexp_extract("url", r"^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+)", 1)
    return pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"), F.lit(True).alias("is_html"), F.when(said != "", said).alias("declared"), F.when(host != "", host).alias("host"))


def document_texts(docs: DataFrame) -> DataFrame:
    """What ``identify`` takes, of ``(doc_id, text, source)``: the source is the host; ``lang`` is what it is tested against, no evidence."""
    return docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text", F.lit(False).alias("is_html"), F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"))
