"""License scans: a positional index of rare words.

The IDF of all template words is counted over all documents. The rarest word of each mandatory phrase is its anchor, and the index holds for each
anchor word the phrases (template, phrase, place in the phrase) that it stands in. A file's anchor words, which are its licence words of highest IDF,
are looked up in it: a word at place p proposes that the phrase begins at p less the word's place, for all templates at once. What is proposed is
verified by the phrase's other words at their relative places, rarest first. What is left are the places where the phrase stands in full, and no others,
for a phrase that stands has its anchor there; plain phrases end so, and are found at every place.

A template with all its mandatory phrases gives its label. Its score is the share of its IDF that agrees: each of its words is
held against the file at the distance of the nearest phrase, so words put in or dropped between two phrases cost only themselves.

Cases: null and empty texts have no words and no labels; places overlap freely; equal rows give equal rows; the templates are
a bounded table of constants, shipped to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .leaks import GAP
from .words import hash_words, texts_of


class Template(NamedTuple):
    label: str
    text: str
    #: Phrases of the text that must stand in a file in full.
    phrases: tuple[str, ...]


#: Phrases and the labels that they give.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public licence notices as they are written, lower-cased and without punctuation.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    Template("no-warranty", "the software is provided as is without warranty of any kind express or implied", ("without warranty of any kind",)),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms",),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify and or distribute this software for any purpose", "with or without fee is hereby granted"),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        ("without any express or implied warranty", "in no event will the authors be held liable"),
    ),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template(
        "gpl-notice",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("under the terms of the gnu general public license", "published by the free software foundation"),
    ),
    Template("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("gnu affero general public license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def _words(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return hash_words([x.lower() for x in blobs], GAP)


def _phrase(x: str) -> np.ndarray:
    return _words([x.encode()])[0]


class Index:
    """Templates with their words and weights, and the postings of anchor words: for each word, in order, the phrases that it is the rarest of."""

    def __init__(self, templates: tuple[Template, ...], base: dict[str, str], vocabulary: np.ndarray, idf: np.ndarray):
        self.vocabulary, self.idf = vocabulary, idf
        self.items, anchors = [], []
        for plain, t in [(True, Template(label, phrase, (phrase,))) for phrase, label in base.items()] + [(False, Template(*t)) for t in templates]:
            word = np.searchsorted(vocabulary, _phrase(t.text))
            spans = []
            for p in t.phrases:
                p = np.searchsorted(vocabulary, _phrase(p))
                at = next(i for i in range(len(word) - len(p) + 1) if (word[i : i + len(p)] == p).all())
                spans.append((at, len(p)))
            near = np.abs(np.arange(len(word))[:, None] - np.array([a + (n - 1) / 2 for a, n in spans])).argmin(axis=1)
            for j, (at, n) in enumerate(spans):
                rare = int(idf[word[at : at + n]].argmax())
                anchors.append((int(word[at + rare]), len(self.items), j, rare))
            self.items.append((t.label, plain, word, spans, near))
        self.anchors = sorted(anchors)
        self.anchor_word, self.anchor_place = (np.array([x[i] for x in self.anchors], np.int64) for i in (0, 3))

    def _phrases(self, h: np.ndarray, owner: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """(template, phrase) -> the places where the phrase begins, for those that stand anywhere."""
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        place = np.flatnonzero(self.vocabulary[at] == h)
        first = np.searchsorted(self.anchor_word, at[place])
        count = np.searchsorted(self.anchor_word, at[place], side="right") - first
        posting = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(place, count) - self.anchor_place[posting]
        order = np.argsort(posting, kind="stable")
        posting, start = posting[order], start[order]
        found = {}
        for k, begin in zip(*np.unique(posting, return_index=True), strict=True):
            _, item, j, _ = self.anchors[k]
            _, _, word, spans, _ = self.items[item]
            word = word[spans[j][0] :][: spans[j][1]]
            x = start[begin : np.searchsorted(posting, k, side="right")]
            x = x[(x >= 0) & (x + len(word) <= len(h))]
            for i in np.argsort(-self.idf[word], kind="stable").tolist():
                x = x[h[x + i] == self.vocabulary[word[i]]]
            x = x[owner[x] == owner[x + len(word) - 1]]
            if len(x):
                found[item, j] = x
        return found

    def scan(self, h: np.ndarray, owner: np.ndarray, n: int) -> list[tuple]:
        """For each of n texts: places, first and last of the plain phrases, their labels, all labels, score."""
        begin = np.searchsorted(owner, np.arange(n + 1))
        starts = [[] for _ in range(n)]
        base: list[set] = [set() for _ in range(n)]
        labels: list[set] = [set() for _ in range(n)]
        score = np.zeros(n)
        phrases = self._phrases(h, owner)
        for item in sorted({i for i, _ in phrases}):
            label, plain, word, spans, near = self.items[item]
            if any((item, j) not in phrases for j in range(len(spans))):
                continue
            found = [phrases[item, j] for j in range(len(spans))]
            wanted = np.ones(n, bool)
            for x in found:
                wanted &= np.bincount(owner[x], minlength=n) > 0
            lead = found[0][wanted[owner[found[0]]]]
            if not len(lead):
                continue
            row = owner[lead]
            gaps = np.empty((len(lead), len(spans)), np.int64)  # distance of file and template at each phrase
            for j, (x, (a, _)) in enumerate(zip(found, spans, strict=True)):
                x = x[wanted[owner[x]]]
                hope = np.clip(lead - spans[0][0] + a, begin[row], begin[row + 1] - 1)
                right = np.minimum(np.searchsorted(x, hope), len(x) - 1)
                left = np.maximum(right - 1, 0)
                far = [np.where(owner[x[s]] == row, np.abs(x[s] - hope), len(h)) for s in (left, right)]
                gaps[:, j] = np.where(far[0] < far[1], x[left], x[right]) - a
            where = np.arange(len(word)) + gaps[:, near]
            inside = (where >= 0) & (where < len(h))
            where = np.where(inside, where, 0)
            agree = inside & (h[where] == self.vocabulary[word]) & (owner[where] == row[:, None])
            share = (agree * self.idf[word]).sum(axis=1) / self.idf[word].sum()
            for p, r, s in zip(lead.tolist(), row.tolist(), share.tolist(), strict=True):
                labels[r].add(label)
                score[r] = max(score[r], min(s, 1.0))
                if plain:
                    base[r].add(label)
                    starts[r].append(p - int(begin[r]))
        lists = lambda x: ",".join(sorted(x))
        return [(int(begin[i + 1] - begin[i]), len(s), min(s, default=None), max(s, default=None), lists(base[i]), lists(labels[i]), float(score[i])) for i, s in enumerate(starts)]


def word_idf(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """log((N + 1) / (documents with the word + 1)) of the vocabulary's words, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        total, rows = np.zeros(len(v), np.int64), 0
        for batch in it:
            rows += batch.num_rows
            for _, blobs in texts_of(batch):
                h, owner = _words(blobs)
                at = np.searchsorted(v, h)
                at[at == len(v)] = 0
                hit = v[at] == h
                total += np.bincount(np.unique(owner[hit] * len(v) + at[hit]) % len(v), minlength=len(v))
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(v)), -1], pa.int64()), pa.array([*total.tolist(), rows], pa.int64())], ["w", "n"])

    counts = {w: n for w, n in docs.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n")).collect()}  # one row a template word
    return np.array([np.log((counts.get(-1, 0) + 1) / (counts.get(i, 0) + 1)) + 1e-9 for i in range(len(vocabulary))])


def scan_licences(docs: DataFrame, templates=TEMPLATES, base=None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
    base = BASE if base is None else base
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    vocabulary = np.unique(np.concatenate([_phrase(x) for x in [*base, *(t[1] for t in templates)]]))
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates, base, vocabulary, word_idf(rows.select("_text"), vocabulary)))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for s, blobs in texts_of(batch):
                found = shared.value.scan(*_words(blobs), len(blobs))
                columns = [pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.start, len(blobs)), *columns], ["doc_id", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op10_licences(spark, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
