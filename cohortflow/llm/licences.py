"""License notices in documents: an exact set-similarity join of text blocks with templates.

A block is a line, or a paragraph of several lines (up to a line without words); its tokens are its distinct words, of
which only those of some template can matter. A block matches a template if it holds at least ``threshold`` of the
template's distinct words. The join is exact and never compares all blocks with all templates:

* tokens are ordered by how many blocks of the whole corpus hold them, rarest first;
* prefix filter: of n tokens, o of which must be shared, one of the first n - o + 1 is shared, on either side;
* length filter: a block of fewer than o tokens cannot match;
* positional filter: what can still be shared behind (and before) the places of a shared token must reach o;
* what is left is verified by intersection.

The templates are few by nature (a few hundred words), so Spark broadcasts them by its own size check, and no document is
shuffled by token: a word that stands in a third of all lines is no hot key. Phrases that name a license outright are
found beside, as words that stand side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.text import FOLDED, NOT_BARE, U64, chunks, prefix_hash, row_of, rows_with, span_hash, words
from cohortflow.session import settle

# Phrases that stand for a license wherever their words follow each other
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices of common licenses, as their publishers word them
NOTICES = (
    ("mit", "Released under the MIT License."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
THRESHOLD = 0.8

DOC = "doc_id long, row long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, blocks array<struct<first_line:long,last_line:long,tokens:array<int>>>"


def bare_words(text: str) -> list[str]:
    """Words of a phrase or template: ASCII letters and digits, A-Z lower-cased, and whatever lies beyond ASCII."""
    buf = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = words(buf, np.array([0, len(buf)]), NOT_BARE)
    folded = text.encode().lower()
    return [folded[a:b].decode() for a, b in zip(start, end, strict=True)]


def _hashes(names: Sequence[str]) -> np.ndarray:
    """Hash of each word as it is found in a text."""
    raw = [n.encode() for n in names]
    off = np.cumsum([0, *map(len, raw)])
    return span_hash(prefix_hash(np.frombuffer(b"".join(raw), np.uint8), FOLDED), off[:-1], off[1:])


@dataclass
class Templates:
    """Notices as sets of numbered words; ``need[k]`` of them must be shared."""

    labels: list[str]
    tokens: list[list[int]]
    need: list[int]
    vocabulary: list[str]
    phrases: list[tuple[list[str], str]]

    @classmethod
    def of(cls, notices: Sequence[tuple[str, str]] = NOTICES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES) -> Templates:
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must be above 0 and at most 1")
        sets = [set(bare_words(text)) for _, text in notices]
        if not all(sets):
            raise ValueError("a template without words matches everything")
        vocabulary = sorted(set().union(*sets))
        number = {w: k for k, w in enumerate(vocabulary)}
        return cls(
            [label for label, _ in notices], [sorted(number[w] for w in s) for s in sets],
            # a little slack, so that 0.8 of 5 words are 4
            [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in sets], vocabulary, [(bare_words(p), label) for p, label in phrases.items()],
        )


def _places(h: np.ndarray, row: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Words at which the words of a phrase begin to follow each other inside a row."""
    n = len(phrase)
    if len(h) < n:
        return np.zeros(0, int)
    at = np.flatnonzero(h[: len(h) - n + 1] == phrase[0])
    for k in range(1, n):
        at = at[(h[at + k] == phrase[k]) & (row[at + k] == row[at])]
    return at


class Scanner:
    """Words, named phrases and blocks of the texts of a chunk."""

    def __init__(self, templates: Templates):
        self.least = min(templates.need, default=1)
        h = _hashes(templates.vocabulary)
        self.order = np.argsort(h).astype(np.int32)
        self.known = h[self.order]
        self.phrases = [(_hashes(w), label) for w, label in templates.phrases]

    def scan(self, buf: np.ndarray, off: np.ndarray) -> list[tuple]:
        """``(words, places, first, last, labels, blocks)`` per row; a block is (first line, last line, tokens)."""
        n = len(off) - 1
        start, end, begin = words(buf, off, NOT_BARE)
        count = np.diff(begin)
        row = row_of(count)
        h = span_hash(prefix_hash(buf, FOLDED), start, end) if len(start) else np.zeros(0, U64)
        found: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        for phrase, label in self.phrases:
            at = _places(h, row, phrase)
            for r, w in zip(row[at].tolist(), (at - begin[row[at]]).tolist(), strict=True):
                found[r].append((w, label))
        blocks = self._blocks(buf, off, start, row, h, n)
        out = []
        for r in range(n):
            at = [w for w, _ in found[r]]
            out.append((int(count[r]), len(at), min(at, default=None), max(at, default=None), sorted({x for _, x in found[r]}), blocks[r]))
        return out

    def _blocks(self, buf, off, start, row, h, n) -> list[list[tuple[int, int, list[int]]]]:
        out: list[list[tuple[int, int, list[int]]]] = [[] for _ in range(n)]
        if not len(start) or not len(self.known):
            return out
        breaks = np.concatenate([[0], np.cumsum(buf == 10)])
        line = breaks[start] - breaks[off[:-1]][row]
        # a paragraph begins with a row, or behind a line without words
        new = np.ones(len(start), bool)
        new[1:] = (row[1:] != row[:-1]) | (line[1:] - line[:-1] > 1)
        part = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        place = np.searchsorted(self.known, h)
        place[place == len(self.known)] = 0
        hit = np.flatnonzero(self.known[place] == h)
        token = self.order[place[hit]]
        several = line[last] > line[first]
        inside = several[part[hit]]
        width = len(self.known)
        # lines are numbered apart in all rows of the chunk: a row begins a line
        base = line + (np.cumsum(np.concatenate([[0], np.diff(breaks[off])]))[row] + row)
        for at, keys, one in ((hit, base[hit], True), (hit[inside], part[hit[inside]], False)):
            if not len(at):
                continue
            pair, where = np.unique(keys * width + (token if one else token[inside]), return_index=True)
            group = pair // width
            cuts = np.flatnonzero(np.diff(group)) + 1
            for members, here in zip(np.split(pair % width, cuts), np.split(where, cuts), strict=True):
                if len(members) >= self.least:
                    w = at[here[0]]
                    ends = (line[w], line[w]) if one else (line[first[part[w]]], line[last[part[w]]])
                    out[row[w]].append((int(ends[0]), int(ends[1]), members.tolist()))
        return out


def scanned(docs: DataFrame, templates: Templates, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole texts read once: counts, named phrases, and blocks with enough words of the templates to match the smallest.

    ``row`` tells rows with the same id, or none, apart.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "blocks")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), BLOCKS)
        for batch in batches:
            for part, buf, off in chunks(batch):
                columns = zip(*scanner.scan(buf, off), strict=True)
                made = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *made], names=["doc_id", "row", *names])

    rows = rows_with(docs, key, text, F.monotonically_increasing_id().alias("row"))
    return settle(rows.mapInArrow(run, DOC))


BLOCKS = pa.list_(pa.struct([("first_line", pa.int64()), ("last_line", pa.int64()), ("tokens", pa.list_(pa.int32()))]))


def _matches(found: DataFrame, templates: Templates) -> DataFrame:
    """``(row, first_line, last_line, template, overlap, containment)``: every block and template that match."""
    spark = found.sparkSession
    blocks = found.select("row", F.inline("blocks"))
    counted = blocks.select(F.explode("tokens").alias("token")).groupBy("token").count()
    # one number per word of the templates
    frequency = {r["token"]: r["count"] for r in counted.collect()}
    order = sorted(range(len(templates.vocabulary)), key=lambda t: (frequency.get(t, 0), t))
    rank = {t: k for k, t in enumerate(order)}
    ordered = [sorted(rank[t] for t in tokens) for tokens in templates.tokens]
    rows = [
        (k, token, place, len(tokens), need, tokens)
        for k, (tokens, need) in enumerate(zip(ordered, templates.need, strict=True))
        for place, token in enumerate(tokens[: len(tokens) - need + 1])
    ]
    prefixes = spark.createDataFrame(rows, "template int, token int, i int, n int, need int, words array<int>")
    ranks = F.array(*[F.lit(rank[t]) for t in range(len(rank))])
    blocks = blocks.select(
        "row", "first_line", "last_line", F.array_sort(F.transform("tokens", lambda t: F.element_at(ranks, t + 1))).alias("own")
    ).withColumn("m", F.size("own"))
    begin = F.slice("own", F.lit(1), F.col("m") - min(templates.need) + 1)
    rare = F.array(*[F.lit(t) for t in sorted({r[1] for r in rows})])
    tokens = blocks.withColumn("begin", begin).where(F.arrays_overlap("begin", rare)).select("row", "first_line", "last_line", "own", "m", F.posexplode("begin").alias("j", "token"))
    after = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    possible = (F.col("m") >= F.col("need")) & (F.col("j") <= F.col("m") - F.col("need")) & (F.least("i", "j") + after >= F.col("need"))
    pairs = tokens.join(prefixes, "token").where(possible)
    pairs = pairs.withColumn("overlap", F.size(F.array_intersect("own", "words"))).where(F.col("overlap") >= F.col("need"))
    return pairs.groupBy("row", "first_line", "last_line", "template").agg(
        F.first("overlap").alias("overlap"), F.first(F.col("overlap") / F.col("n")).alias("containment")
    )


def _labels(templates: Templates):
    return F.element_at(F.array(*[F.lit(x) for x in templates.labels]), F.col("template") + 1)


def matches(docs: DataFrame, templates: Templates | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, row, first_line, last_line, template, label, overlap, containment)`` of every matching block, lines from 0.

    ``row`` tells rows with the same id apart. Empty or null texts have no blocks.
    """
    templates = templates or Templates.of()
    found = scanned(docs, templates, key, text)
    pairs = _matches(found, templates).withColumn("label", _labels(templates))
    return pairs.join(found.select("doc_id", "row"), "row").select(
        "doc_id", "row", "first_line", "last_line", "template", "label", "overlap", "containment"
    )


def scan(docs: DataFrame, templates: Templates | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, places of named phrases (``n_base``, ``first_word``, ``last_word``), ``base_labels``,
    all ``labels`` (comma-joined, sorted), and ``score``.

    A block gives the labels of the templates it holds most of, among those of which it shares most words, so that one
    of several licenses that are worded alike stands for itself. The score is 1 where a phrase names a license, else
    the largest containment of a matching block, 0 if there is none. Null text is empty and has no words; rows with the
    same id or none are each judged on their own; other columns are not read; an empty table gives no rows. Words are
    compared by a 64-bit hash.
    """
    templates = templates or Templates.of()
    found = scanned(docs, templates, key, text)
    pairs = _matches(found, templates).withColumn("label", _labels(templates))
    strength = F.struct("containment", "overlap")
    # at most one entry per template
    blocks = pairs.groupBy("row", "first_line", "last_line").agg(F.max(strength).alias("best"), F.collect_list(F.struct(strength.alias("s"), "label")).alias("all"))
    best = F.transform(F.filter("all", lambda p: p["s"] == F.col("best")), lambda p: p["label"])
    # at most one entry per label
    told = blocks.select("row", "best.containment", F.explode(best).alias("label")).groupBy("row").agg(
        F.max("containment").alias("most"), F.collect_set("label").alias("more")
    )
    joined = found.drop("blocks").join(told, "row", "left")
    every = F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0)))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"), score.alias("score"),
    )
