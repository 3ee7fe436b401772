"""License scans by an exact set-similarity join of text blocks with license templates (operator 10).

A template is the set of its words.  A *block* is a run of consecutive words of
a document, at most ``ceil(SPREAD * size)`` long for a template of that many
words.  A block matches when it holds at least ``THRESHOLD`` of the template's
words.  The join is exact:

* prefix filter: words are ordered by their frequency in the whole corpus, the
  rarest first.  With ``need = ceil(THRESHOLD * size)``, a matching block holds
  one of the template's first ``size - need + 1`` words, so only blocks around
  those words are looked at;
* positional filter: a block whose rarest word stands at place ``i`` of that order
  has missed ``i`` words already, so it holds another one of the next
  ``size - need + 1 - i`` too (if more than one is needed), and it does so within a
  block's length of the first.  Where no such word stands near, the place is skipped;
* length filter: a block of fewer than ``need`` words is out.

Templates travel with the task (a table of them is collected: it must be a table of
templates, not of texts), and an index from prefix words to templates makes this a
join; the corpus is read twice (frequencies, then the join) and only the counts of
the templates' words are gathered.

Results for odd input: a null or empty text has no words, no labels and score
0; very long texts are taken whole; repeated rows, and rows without a doc_id, get
results like any other; a template without words matches nothing; an empty table
gives an empty table; other columns are ignored.  The score is the largest part of a
template held by a matching block, 1 for a base phrase.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table
from ._text import ALNUM, LOWER, chunks, prefix_hash, span_hash, words

#: Base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Public license notices, by label.
TEMPLATES = (
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
)
#: Part of a template's words that a block must hold.
THRESHOLD = 0.9
#: Longest block, in template sizes.
SPREAD = 1.5


def _hash(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(span_hash(prefix_hash(b), np.array([0]), np.array([len(b)]))[0])


def vocabulary(templates=TEMPLATES, phrases=PHRASES) -> list[str]:
    """All words of templates and phrases, sorted."""
    return sorted({w for _, t in templates for w in t.split()} | {w for p in phrases for w in p.split()})


def templates_of(df: DataFrame) -> tuple[tuple[str, str], ...]:
    """Templates from a table of ``label`` and ``text``, their words as texts' words are taken."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return tuple(sorted((r["label"], " ".join(split(r["text"]))) for r in df.select("label", "text").collect() if r["label"] is not None))


def _coded(chunk, hashes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary number (or -1) and document of every word."""
    data = LOWER[chunk.data]
    s, e, doc = words(data, chunk.offsets, ALNUM)
    h = span_hash(prefix_hash(data), s, e)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return np.where(hashes[at] == h, codes[at], -1), doc


def _tables(vocab: list[str]) -> tuple[np.ndarray, np.ndarray]:
    h = np.array([_hash(w) for w in vocab], np.uint64)
    order = np.argsort(h)
    return h[order], order


def frequencies(docs: DataFrame, vocab: list[str]) -> list[int]:
    """How often each word of a small vocabulary stands in all texts."""
    hashes, codes = _tables(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocab), np.int64)
        for chunk in chunks(batches):
            c, _ = _coded(chunk, hashes, codes)
            total += np.bincount(c[c >= 0], minlength=len(vocab))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(vocab)), pa.int32()), pa.array(total)], ["word", "n"])

    got = docs.select("doc_id", "text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = [0] * len(vocab)
    for row in got:
        out[row["word"]] = row["n"]
    return out


class Plan:
    """Templates in frequency order with their prefixes; ``looked`` and ``skipped`` count places and those that the positional filter spares."""

    def __init__(self, vocab: list[str], counts: list[int], templates=TEMPLATES, threshold: float = THRESHOLD, spread: float = SPREAD):
        number = {w: i for i, w in enumerate(vocab)}
        self.templates, by_word = [], {}
        self.looked = self.skipped = 0
        for label, text in templates:
            order = sorted({number[w] for w in text.split()}, key=lambda c: (counts[c], c))
            if not order:
                continue
            need = max(1, math.ceil(threshold * len(order) - 1e-9))
            k = len(self.templates)
            self.templates.append((label, frozenset(order), need, math.ceil(spread * len(order)), {c: i for i, c in enumerate(order[: len(order) - need + 2])}))
            for c in order[: len(order) - need + 1]:
                by_word.setdefault(c, []).append(k)
        self.by_word = by_word
        self.rare = np.zeros(len(vocab) + 1, bool)  # the last is for words outside
        self.rare[list(by_word)] = True

    def blocks(self, codes: np.ndarray, lo: int, hi: int, at: int) -> Iterator[tuple[str, float]]:
        """Labels and parts of the templates that a block whose rarest prefix word is that at ``at`` may match; the document is ``codes[lo:hi]``."""
        word = int(codes[at])
        for k in self.by_word[word]:
            label, members, need, width, place = self.templates[k]
            a, b = max(lo, at - width + 1), min(hi, at + width)
            self.looked += 1
            if b - a < need:
                continue
            near = [(i, c) for i, c in enumerate(codes[a:b].tolist()) if c in members]
            mine = place[word]
            if need > 1 and not any(place.get(c, -1) > mine for _, c in near):
                self.skipped += 1
                continue
            if len({c for _, c in near}) < need:
                continue
            best = 0
            for x, (i, _) in enumerate(near):
                best = max(best, len({c for j, c in near[x:] if j - i < width}))
            if best >= need:
                yield label, best / len(members)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Words, base places and labels of every document; ``templates`` are pairs or a table of ``label`` and ``text``."""
    if isinstance(templates, DataFrame):
        templates = templates_of(templates)
    vocab = vocabulary(templates, phrases)
    plan = Plan(vocab, frequencies(docs, vocab), templates, threshold)
    hashes, numbers = _tables(vocab)
    index = {w: i for i, w in enumerate(vocab)}
    wanted = [([index[w] for w in p.split()], label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            n = len(chunk)
            codes, doc = _coded(chunk, hashes, numbers)
            first = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n))))
            n_base, lo, hi = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base, more, score = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
            for phrase, label in wanted:
                k = len(phrase)
                if len(codes) < k:
                    continue
                ok = doc[: len(doc) - k + 1] == doc[k - 1 :]
                for j, c in enumerate(phrase):
                    ok &= codes[j : len(codes) - k + 1 + j] == c
                at = np.flatnonzero(ok)
                d = doc[at]
                np.add.at(n_base, d, 1)
                np.minimum.at(lo, d, at - first[d])
                np.maximum.at(hi, d, at - first[d])
                for i in set(d.tolist()):
                    base[i].add(label)
            for at in np.flatnonzero(plan.rare[codes]).tolist():
                i = int(doc[at])
                for label, part in plan.blocks(codes, int(first[i]), int(first[i + 1]), at):
                    more[i].add(label)
                    score[i] = max(score[i], part)
            score[n_base > 0] = 1.0
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.ids,
                    pa.array(np.diff(first)),
                    pa.array(n_base),
                    pa.array(lo, mask=none),
                    pa.array(hi, mask=none),
                    pa.array([",".join(sorted(x)) for x in base], pa.string()),
                    pa.array([",".join(sorted(x | y)) for x, y in zip(base, more, strict=True)], pa.string()),
                    pa.array(score),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say too: the columns of the base phrases, from the operator."""
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def _base_sql() -> str:
    places, labels = [], []
    for p, label in PHRASES.items():
        w = p.split()
        test = " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(w))
        places.append(f"list_transform(list_filter(range(1, len(w) - {len(w) - 2}), lambda i: {test}), lambda i: i - 1)")
        labels.append(f"case when len(p{len(labels)}) > 0 then '{label}' end")
    n = len(places)
    return f"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
x as (select doc_id, w, {', '.join(f'{q} p{i}' for i, q in enumerate(places))} from d),
y as (select *, list_concat({', '.join(f'p{i}' for i in range(n))}) a from x)
select doc_id, len(w)::bigint n_words, len(a)::bigint n_base, list_min(a)::bigint first_word, list_max(a)::bigint last_word,
  array_to_string(list_sort(list_filter([{', '.join(labels)}], lambda v: v is not null)), ',') base_labels from y"""


#: SQL of :func:`license_base`.
BASE_SQL = _base_sql()
