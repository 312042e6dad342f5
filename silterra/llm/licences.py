"""License scans: sparse TF-IDF cosine of headers and licence files to templates, inherited from the nearest directory.

The terms are the words of the templates (see ``textbytes`` for words), and a term's inverse document frequency is counted over all
lines of all texts; any other word weighs as much as the rarest term. A line is licence-like if terms make at least half of its weight.
Runs of licence-like lines are headers, each compared with every template by the cosine of the TF-IDF vectors; terms that a template
doesn't have count in the run's length, so a common word or two don't make a header. A text has the licence of its most similar header if
the cosine is at least ``THRESHOLD``. A text whose words are mostly (``WHOLE``) in that header is a licence file and holds for its directory.

Licences have their whole texts as well (``licence_texts``, one for each version), with terms and weights of their own. A text whose words
altogether have a cosine of ``WHOLE`` or more to one, and are its words in that share, is that licence's file, whatever its lines are like. A header as similar as that, if
more than to any notice, has that licence, so a whole licence text above other text isn't named by a notice of another version.

Texts without such a header are searched within their lines: sentences are taken as lines, then single words, so that a header is a run of
words that are all terms. As ordinary words make such runs too, these need a cosine of ``INSIDE``.

A text without a header inherits the licence of the licence file in the nearest directory above it: paths are joined with licence
files by each of their directories, and the longest one wins. Of several licence files in one directory that with the most similar
header counts, then the smaller license name.

Defined results: a null or empty text has no header and can inherit; a null path has no directory and is inherited from and by
nothing. Rows are judged one by one, so repeated rows repeat their result and rows with a null id are kept. Of equal cosines the first template's name wins.
A text without any licence, its own or inherited, has no row. Other columns are not touched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silterra.llm.textbytes import U64, WORDS_SQL, text_chunks, words
from silterra.session import Scratch, prepare

THRESHOLD = 0.6
WHOLE = 0.8
INSIDE = 0.9

#: Notices as they stand in headers, and the first lines of licence files, by SPDX name.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "LGPL-3.0": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}
_NEWLINE = 10
#: Signs that end a sentence before white space or another of them.
_STOPS = np.frombuffer(b".!?;:|*/()", np.uint8)


def licence_texts() -> dict[str, list[str]]:
    """The whole texts of licences, by name."""
    files = resources.files("silterra.llm").joinpath("licence_texts").iterdir()
    return {f.name.removesuffix(".txt"): [f.read_text(encoding="utf-8")] for f in files if f.name.endswith(".txt")}


def _lines(buf: np.ndarray, offsets: np.ndarray, cut: str = "lines") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(word hash, line of each word, text of each line, first line of each text)``; lines are numbered through all texts. ``cut`` can be sentences or words instead."""
    start, _, h, first = words(buf, offsets)
    if cut == "words":
        return h, np.arange(len(h)), np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first
    ends = buf == _NEWLINE
    if cut == "sentences":
        ends[:-1] |= np.isin(buf[:-1], _STOPS) & ((buf[1:] <= 32) | np.isin(buf[1:], _STOPS))
    breaks = np.flatnonzero(ends)
    text_breaks = np.searchsorted(breaks, offsets)
    # A text has one line more than line breaks.
    first = text_breaks + np.arange(len(offsets))
    owner = np.searchsorted(offsets, start, "right") - 1
    line = np.searchsorted(breaks, start) + owner
    return h, line, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first


class Matcher:
    """Terms, their weights and the templates' vectors."""

    def __init__(self, templates: dict[str, list[str]] | None = None):
        self.names, vectors = [], []
        for name, texts in sorted((templates or TEMPLATES).items()):
            for text in texts:
                raw = np.frombuffer(text.encode(), np.uint8)
                self.names.append(name)
                vectors.append(words(raw, np.array([0, len(raw)]))[2])
        self.terms = np.unique(np.concatenate(vectors))
        self.counts = np.zeros((len(vectors), len(self.terms)))
        for k, h in enumerate(vectors):
            np.add.at(self.counts[k], np.searchsorted(self.terms, h), 1)
        self.idf = np.ones(len(self.terms))
        self.other = 1.0
        self.weigh(np.zeros(len(self.terms)), 0)

    def weigh(self, lines_with: np.ndarray, lines: int) -> None:
        """Set the inverse document frequencies from how many of all lines have each term."""
        self.idf = np.log((lines + 2) / (lines_with + 1))
        self.other = float(self.idf.max()) if len(self.idf) else 1.0
        v = self.counts * self.idf
        self.unit = v / np.maximum(np.sqrt((v * v).sum(1)), 1e-300)[:, None]

    def term(self, h: np.ndarray) -> np.ndarray:
        """The number of each word's term, -1 for other words."""
        if not len(self.terms):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def frequencies(self, column: pa.Array) -> tuple[np.ndarray, int]:
        """How many lines have each term, and how many lines there are."""
        out, total = np.zeros(len(self.terms), np.int64), 0
        for _, _, buf, offsets in text_chunks(column):
            h, line, owner, _ = _lines(buf, offsets)
            t = self.term(h)
            pair = np.unique(line[t >= 0] * len(self.terms) + t[t >= 0])
            out += np.bincount(pair % len(self.terms), minlength=len(self.terms))
            total += len(owner)
        return out, total

    def cosines(self, r: np.ndarray, h: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
        """The cosine to each template of each of n runs of words; r is the run of each word, t its term."""
        key = np.where(t >= 0, t.astype(U64), h | U64(1 << 63))
        order = np.lexsort((key, r))
        a, k = r[order], key[order]
        fresh = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (k[1:] != k[:-1]))[: len(a)])
        count = np.diff(np.append(fresh, len(a)))
        a, k = a[fresh], k[fresh]
        is_term = k < U64(len(self.terms))
        value = count * np.where(is_term, self.idf[np.where(is_term, k, U64(0)).astype(np.int64)], self.other)
        norm = np.sqrt(np.bincount(a, value * value, n))
        score = np.zeros((n, len(self.names)))
        ta, tk, tv = a[is_term], k[is_term].astype(np.int64), value[is_term]
        for c in range(len(self.names)):
            score[:, c] = np.bincount(ta, tv * self.unit[c, tk], n)
        return np.round(score / np.maximum(norm, 1e-300)[:, None], 9)

    def whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(template, cosine, share of words)`` of each text's most similar template by all of its words; the share is of those the template has."""
        template, cosine, share = np.full(len(column), -1), np.zeros(len(column)), np.zeros(len(column))
        for i, m, buf, offsets in text_chunks(column):
            _, _, h, first = words(buf, offsets)
            text, t = np.repeat(np.arange(m), np.diff(first)), self.term(h)
            score = self.cosines(text, h, t, m)
            top = score.argmax(1)
            template[i : i + m], cosine[i : i + m] = top, score.max(1)
            has = (t >= 0) & (self.counts[top[text], t] > 0)
            share[i : i + m] = np.bincount(text[has], minlength=m) / np.maximum(np.diff(first), 1)
        return template, cosine, share

    def best(self, column: pa.Array, least: float = THRESHOLD, cut: str = "lines") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(template, cosine, share of words)`` of each text's most similar header; template -1 where there is none."""
        n = len(column)
        template, cosine, share = np.full(n, -1), np.zeros(n), np.zeros(n)
        for i, m, buf, offsets in text_chunks(column):
            h, line, owner, _ = _lines(buf, offsets, cut)
            t = self.term(h)
            weight = np.where(t >= 0, self.idf[np.maximum(t, 0)], self.other)
            mass = np.bincount(line, weight, len(owner))
            ours = np.bincount(line[t >= 0], weight[t >= 0], len(owner))
            like = (ours >= 0.5 * mass) & (mass > 0)
            # Lines without words neither end a run nor begin one.
            full = np.flatnonzero(mass > 0)
            like_, text = like[full], owner[full]
            new = np.append(True, (like_[1:] != like_[:-1]) | (text[1:] != text[:-1])) if len(full) else np.zeros(0, bool)
            number = np.cumsum(new) - 1
            run = np.full(len(owner), -1)
            run[full] = np.where(like_, number, -1)
            where = run[line] if len(line) else line
            inside = where >= 0
            if not inside.any():
                continue
            runs, r = np.unique(where[inside], return_inverse=True)
            holder = np.zeros(len(runs), np.int64)
            holder[r] = owner[line[inside]]
            score = self.cosines(r, h[inside], t[inside], len(runs))
            top = score.argmax(1)
            cos = score[np.arange(len(runs)), top]
            number_of = np.bincount(r, minlength=len(runs))
            of_text = np.bincount(owner[line], minlength=m)
            found = np.flatnonzero(cos >= least)
            for j in found[np.lexsort((found, cos[found]))]:  # the last is the best, of equal ones the later run
                x = i + holder[j]
                if cos[j] >= cosine[x]:
                    template[x], cosine[x], share[x] = top[j], cos[j], number_of[j] / of_text[holder[j]]
        return template, cosine, share


def judge(notices: Matcher, texts: Matcher, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(license, cosine, share of words)`` of each text by notices and whole licence texts; license None where there is none."""
    template, cosine, share = notices.best(column)
    none = np.flatnonzero(template < 0)
    for cut in ("sentences", "words"):
        found = notices.best(column.take(pa.array(none)), INSIDE, cut)
        better = found[1] > cosine[none]
        for own, new in zip((template, cosine, share), found, strict=True):
            own[none[better]] = new[better]
    names, whole = (np.array([*m.names, None], object) for m in (notices, texts))
    license_ = names[template]
    other, cos, part = texts.best(column, WHOLE)
    better = (other >= 0) & (cos >= cosine)
    license_, cosine, share = np.where(better, whole[other], license_), np.where(better, cos, cosine), np.where(better, part, share)
    other, cos, part = texts.whole(column)
    file = (cos >= WHOLE) & (part >= WHOLE)
    return np.where(file, whole[other], license_), np.where(file, cos, cosine), np.where(file, part, share)


def learn(texts: DataFrame, matcher: Matcher) -> Matcher:
    """Count the terms over all lines of ``text``."""
    shared = prepare(texts.sparkSession).sparkContext.broadcast(matcher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, lines = np.zeros(len(shared.value.terms), np.int64), 0
        for b in batches:
            t, n = shared.value.frequencies(b.column(0))
            total, lines = total + t, lines + n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total)), pa.int64()), pa.array(np.append(lines, total), pa.int64())], ["term", "lines"])

    rows = texts.where("text is not null").select("text").mapInArrow(run, "term long, lines long").groupBy("term").agg(F.sum("lines").alias("lines")).toArrow()
    found = dict(zip(rows["term"].to_pylist(), rows["lines"].to_pylist(), strict=True))
    matcher.weigh(np.array([found.get(k, 0) for k in range(len(matcher.terms))], float), found.get(-1, 0))
    return matcher


def scan(files: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """``(doc_id, license, cosine, how)`` of every row of ``(doc_id, path, text)`` with a licence; how is file, header or inherited.

    ``path`` has its directories between slashes; its last part is the name.
    """
    scratch = Scratch(prepare(files.sparkSession))
    matchers = learn(files, Matcher(templates)), learn(files, Matcher(licence_texts()))
    shared = files.sparkSession.sparkContext.broadcast(matchers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            license_, cosine, share = judge(*shared.value, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(license_.tolist(), pa.string()), pa.array(np.round(cosine, 6)), pa.array(share)], ["doc_id", "path", "license", "cosine", "share"])

    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), "text").mapInArrow(run, "doc_id long, path string, license string, cosine double, share double")
    rows = scratch.write(rows, "scanned")
    own = rows.where("license is not null")
    holders = own.where(F.col("share") >= WHOLE).where("path is not null")
    best = F.struct((-F.col("cosine")).alias("far"), "license", "cosine")
    holders = holders.groupBy(_directory(F.col("path")).alias("dir")).agg(F.min(best).alias("best")).select("dir", F.col("best.license").alias("license"), F.col("best.cosine").alias("cosine"))
    holders = scratch.write(holders, "holders")
    parts = F.split(F.col("path"), "/", -1)
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    # One row for each distinct directory, not for each text.
    dirs = rows.where("license is null and path is not null").select(_directory(F.col("path")).alias("of"), "path").groupBy("of").agg(F.min("path").alias("path"))
    near = dirs.select("of", F.explode(above).alias("dir")).join(holders, "dir").groupBy("of").agg(F.max_by(F.struct("license", "cosine"), F.length("dir")).alias("best"))
    inherited = rows.where("license is null and path is not null").select("doc_id", _directory(F.col("path")).alias("of")).join(near, "of")
    how = F.when((F.col("share") >= WHOLE), "file").otherwise("header")
    return own.select("doc_id", "license", "cosine", how.alias("how")).union(inherited.select("doc_id", "best.license", "best.cosine", F.lit("inherited")))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def oracle() -> str:
    """DuckDB SQL of ``scan`` over documents with paths of source and id."""
    listed = ", ".join(f"({k}, '{n}', '" + t.replace("'", "''") + "')" for k, (n, t) in enumerate((n, t) for n, ts in sorted(TEMPLATES.items()) for t in ts))
    return f"""
WITH templates(k, license, text) AS (VALUES {listed}),
tw AS (SELECT k, term, count(*) AS c FROM (SELECT k, unnest({WORDS_SQL}) AS term FROM templates) GROUP BY k, term),
lines AS (SELECT doc_id, line_no, {WORDS_SQL} AS ws FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL)),
lw AS (SELECT doc_id, line_no, term, count(*) AS c FROM (SELECT doc_id, line_no, unnest(ws) AS term FROM lines) GROUP BY doc_id, line_no, term),
idf AS (SELECT term, ln(((SELECT count(*) FROM lines) + 2) / (count(lw.term) + 1)) AS w FROM (SELECT DISTINCT term FROM tw) t LEFT JOIN lw USING (term) GROUP BY term),
weighed AS (SELECT lw.*, coalesce(w, (SELECT max(w) FROM idf)) AS w, w IS NOT NULL AS known FROM lw LEFT JOIN idf USING (term)),
marked AS (SELECT doc_id, line_no, sum(c) AS n, coalesce(sum(c * w) FILTER (known), 0) >= 0.5 * sum(c * w) AS alike FROM weighed GROUP BY doc_id, line_no),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM (SELECT *, CASE WHEN alike IS DISTINCT FROM lag(alike) OVER (PARTITION BY doc_id ORDER BY line_no) THEN 1 ELSE 0 END AS new FROM marked)),
runs AS (SELECT doc_id, run, term, sum(c) * any_value(w) AS v FROM weighed JOIN (SELECT * FROM numbered WHERE alike) USING (doc_id, line_no) GROUP BY doc_id, run, term),
norms AS (SELECT doc_id, run, sqrt(sum(v * v)) AS norm FROM runs GROUP BY doc_id, run),
units AS (SELECT k, term, c * w / sqrt(sum(c * w * c * w) OVER (PARTITION BY k)) AS u FROM tw JOIN idf USING (term)),
scores AS (SELECT doc_id, run, k, round(sum(v * u) / any_value(norm), 9) AS cosine FROM runs JOIN units USING (term) JOIN norms USING (doc_id, run) GROUP BY doc_id, run, k),
best AS (SELECT doc_id, run, k, cosine FROM scores WHERE cosine >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, run DESC, k) = 1),
sizes AS (SELECT doc_id, run, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY doc_id) AS whole FROM numbered GROUP BY doc_id, run),
own AS (SELECT doc_id, license, cosine, n / whole >= {WHOLE} AS is_file FROM best JOIN sizes USING (doc_id, run) JOIN templates USING (k)),
holders AS (SELECT source, license, cosine FROM own JOIN documents USING (doc_id) WHERE is_file QUALIFY row_number() OVER (PARTITION BY source ORDER BY cosine DESC, license) = 1)
SELECT doc_id, license, round(cosine, 6) AS cosine, CASE WHEN is_file THEN 'file' ELSE 'header' END AS how FROM own
UNION ALL SELECT doc_id, license, round(cosine, 6), 'inherited' FROM documents JOIN holders USING (source) WHERE doc_id NOT IN (SELECT doc_id FROM own)
"""
