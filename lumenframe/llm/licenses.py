"""Operator 1: licence scan by a positional rare-token index.

Templates are licence notices with mandatory key phrases. Every template word's document frequency is counted over all
documents, and the index holds its positions in the templates. For each template whose words it holds to a sufficient
part, key phrases' words included, a file looks up its own ANCHORS rarest licence words (highest inverse document
frequency); postings, adjusted by the words' places in the file, are intersected: places where two different anchors or
more (all, if there are fewer) put the template's beginning within DRIFT words of each other are candidates. A candidate
is accepted if its key phrases stand, word for word, inside the candidate's stretch and at least COVERAGE of the
template's words stand at their relative position, give or take DRIFT.

Base labels come from fixed phrases, found by the same index with the phrase as a template that must match exactly.

Null and empty texts have no words: no labels, score 0, null first and last word. Words that tie in frequency are ordered
by the alphabet. Repeated rows give repeated rows; null ids are allowed. An empty table gives no rows. A very long text
is a block of its own, read whole. Other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import map_texts, read, words_of

ANCHORS = 4
DRIFT = 3
COVERAGE = 0.6
#: Score of a document that only holds a base phrase.
PHRASE_SCORE = 0.5

#: Phrases and labels, fixed.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: (label, mandatory key phrases, text) of public licence notices, fixed.
TEMPLATES = (
    ("mit", ("mit license",), "Released under the MIT License."),
    ("mit", ("permission is hereby granted free of charge",), "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", ("apache license", "version 2"), "Licensed under the Apache License, Version 2.0."),
    ("apache", ("apache license",), "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", ("general public license",), "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", ("gnu general public license",), "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", ("lesser general public license",), "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", ("redistribution and use in source and binary forms",), "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", ("mozilla public license",), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", ("permission to use copy modify and",), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", ("unencumbered software released into the public domain",), "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc", ("cc by nc",), "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", ("cc by sa",), "Licensed under CC BY-SA 4.0."),
    ("cc-by", ("creative commons attribution",), "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("agpl", ("affero general public license",), "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-3-clause", ("neither the name of",), "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("zlib", ("the origin of this software must not be misrepresented",), "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("bsl", ("boost software license",), "Distributed under the Boost Software License, Version 1.0."),
    ("epl", ("eclipse public license",), "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("artistic", ("artistic license",), "This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("cc0", ("cc0 1 0",), "To the extent possible under law, the author has dedicated all copyright to this work to the public domain under CC0 1.0 Universal."),
    ("all-rights-reserved", ("all rights reserved",), "All rights reserved."),
)


class Template:
    def __init__(self, label: str, keys: tuple[str, ...], text: str, base: bool = False):
        self.label, self.base = label, base
        self.words = words_of(text)
        self.keys = [words_of(k) for k in keys]
        self.held, self.mandatory = set(self.words), {w for k in self.keys for w in k}


def all_templates(templates=TEMPLATES, base=BASE) -> list[Template]:
    return [Template(label, (phrase,), phrase, True) for phrase, label in base] + [Template(*t) for t in templates]


class Index:
    """Every template word with its inverse document frequency and its postings (template, position)."""

    def __init__(self, templates: list[Template], frequency: dict[str, int], documents: int):
        self.templates = templates
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) for t in templates for w in t.words}
        self.postings: dict[str, dict[int, list[int]]] = {}
        for k, t in enumerate(templates):
            for place, w in enumerate(t.words):
                self.postings.setdefault(w, {}).setdefault(k, []).append(place)

    def scan(self, text: str | None) -> tuple:
        """n_words, places of base phrases, their first and last start, base labels, all labels, score."""
        words = words_of(text)
        own = self.idf.keys() & set(words)
        # without its key phrases' words, or with too few of its words, a template can't be accepted
        asked = [k for k, t in enumerate(self.templates) if t.mandatory <= own and sum(w in own for w in t.words) >= COVERAGE * len(t.words)]
        if not asked:
            return len(words), 0, None, None, "", "", 0.0
        wanted = set().union(*(self.templates[k].held for k in asked))
        where: dict[str, list[int]] = {}
        for at, w in enumerate(words):
            if w in wanted:
                where.setdefault(w, []).append(at)
        starts, base, labels, score = [], set(), set(), 0.0
        for k in asked:
            t = self.templates[k]
            # the file's rarest words of the template
            rare = sorted(t.held & own, key=lambda w: (-self.idf[w], w))[: 1 if t.base else ANCHORS]
            if t.base:
                n = len(t.words)
                found = sorted({at - place for at in where[rare[0]] for place in self.postings[rare[0]][k] if at >= place and words[at - place : at - place + n] == t.words})
                if found:
                    starts += found
                    base.add(t.label)
                continue
            for begin in self._candidates([(at - place, w) for w in rare for place in self.postings[w][k] for at in where[w]], min(2, len(rare))):
                covered = self._covered(t, begin, where)
                if covered >= COVERAGE and self._verified(t, begin, words):
                    labels.add(t.label)
                    score = max(score, covered)
        labels |= base
        if base:
            score = max(score, PHRASE_SCORE)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score

    @staticmethod
    def _candidates(offsets: list[tuple[int, str]], need: int) -> list[int]:
        """Beginnings that at least ``need`` different anchors agree on, give or take DRIFT; near ones once."""
        order = sorted(offsets)
        out: list[int] = []
        held: Counter[str] = Counter()
        end = 0
        for a, w in order:
            while end < len(order) and order[end][0] <= a + DRIFT:
                held[order[end][1]] += 1
                end += 1
            if len(held) >= need and (not out or a > out[-1] + DRIFT):
                out.append(a)
            held[w] -= 1
            if not held[w]:
                del held[w]
        return out

    @staticmethod
    def _covered(t: Template, begin: int, where: dict[str, list[int]]) -> float:
        hits = 0
        for place, w in enumerate(t.words):
            at = where.get(w)
            if at and bisect_left(at, begin + place - DRIFT) < bisect_right(at, begin + place + 2 * DRIFT):
                hits += 1
        return hits / len(t.words)

    @staticmethod
    def _verified(t: Template, begin: int, words: list[str]) -> bool:
        low, high = max(0, begin - DRIFT), begin + len(t.words) + 2 * DRIFT
        return all(any(words[i : i + len(k)] == k for i in range(low, min(high, len(words)) - len(k) + 1)) for k in t.keys)


def document_frequency(df: DataFrame, vocabulary: set[str], text: str) -> tuple[dict[str, int], int]:
    """In how many documents each word of the (fixed) vocabulary stands, and the number of documents."""
    order = sorted(vocabulary)
    place = {w: i for i, w in enumerate(order)}

    def block(texts):
        total = [0] * (len(order) + 1)
        for t in texts:
            total[-1] += 1
            for w in vocabulary.intersection(words_of(t)):
                total[place[w]] += 1
        # one row of the block has its sums
        return {"sums": [total] + [None] * (len(texts) - 1)}

    sums = map_texts(df, text, block, "sums array<bigint>", []).where("sums IS NOT NULL")
    total = sums.select(F.posexplode("sums").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
    count = {r["i"]: r["n"] for r in total}
    return {w: count.get(i, 0) for i, w in enumerate(order)}, count.get(len(order), 0)


def scan_licenses(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", templates=TEMPLATES, base=BASE) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    own = all_templates(templates, base)
    frequency, n = document_frequency(df, {w for t in own for w in t.words}, text)
    index = Index(own, frequency, n)
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

    def block(texts):
        return dict(zip(names, zip(*map(index.scan, texts))))

    return map_texts(df, text, block, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", [id_col])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))
