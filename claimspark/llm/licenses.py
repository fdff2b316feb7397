"""Licence scans: a trained paragraph classifier, with an unknown class, confirmed by template comparison.

A multinomial logistic regression on sparse word n-grams (one to three words) tells licence families apart. It is trained
here on notices of each family, cut and thinned at random, and on paragraphs of the corpus and shuffled notices as the
unknown class. Its probabilities are calibrated by one temperature, from the scores of notices (with all their variants)
and of background paragraphs that models without them give. A prediction is confirmed when enough of a template's
five-word shingles are in the paragraph; a template of fewer words is one shingle.

Paragraphs are lines, and runs of lines between blank ones, marks of comments left out and lines joined: a wrapped notice
is one paragraph. A run of several lines counts only where its template confirms it, for it also holds other words.
Features that the unknown class has often are left out, so that a text without any licence word needs no scoring: it has
the probability that no features give, which no other text goes below.

Defined results: null text is empty; a document without a licence has family null and the highest probability any of its
paragraphs gives to one; confirmed paragraphs go before others, then the likelier one, then the earlier one, then the
family first in order; paragraph numbers count lines, and spans count characters from the first line of the paragraph to
the last; repeated rows get one row each; an empty table gives an empty result. The unknown class is learned from at most
``bound`` paragraphs of the corpus, the first line without a licence word of each of so many texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm.common import bounded_sample

UNKNOWN = "unknown"
#: Notices by which licences are declared.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "LGPL": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": (
        "This work is dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ),
    "Zlib": (
        "Licensed under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software',
    ),
    "EPL-2.0": (
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Proprietary": (
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ),
}


def words_of(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def grams(words: list[str], most: int = 3) -> Iterator[str]:
    for n in range(1, most + 1):
        for i in range(len(words) - n + 1):
            yield " ".join(words[i : i + n])


SHINGLE = 5


def shingles(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the last one is UNKNOWN
    index: dict[str, int]  # n-gram: row of weights
    keys: frozenset[str]  # the first words of n-grams in the index
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: dict[str, tuple[tuple[str, frozenset], ...]]
    parts: frozenset[tuple[str, ...]]  # all shingles of templates
    sizes: tuple[int, ...]  # the lengths of these
    accept: float
    similar: float

    def probabilities(self, words: list[str]) -> np.ndarray:
        at = sorted({self.index[g] for g in grams(words) if g in self.index})
        z = (self.bias + self.weights[at].sum(axis=0) / max(1.0, np.sqrt(len(at)))) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def judge(self, words: list[str]) -> tuple[str, float, float, bool]:
        """(family, probability, similarity of the family's best template, confirmed) of one paragraph."""
        p = self.probabilities(words)
        family = self.families[int(p.argmax())]
        if family == UNKNOWN or p.max() < self.accept:
            return UNKNOWN, float(1 - p[-1]), 0.0, False
        mine = {n: shingles(words, n) for n in self.sizes}
        best = max(len(mine[len(next(iter(t)))] & t) / len(t) for _, t in self.templates[family])
        return family, float(p.max()), best, best >= self.similar


def _thinned(words: list[str], draw: np.random.Generator) -> list[str]:
    """The words with some lost, and other words before and after, as paragraphs have them."""
    kept = [w for w in words if draw.random() > 0.08] or words
    cut = kept[: max(4, int(len(kept) * draw.uniform(0.6, 1.0)))]
    return cut


def _fit(x: np.ndarray, y: np.ndarray, families: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of a multinomial logistic regression in which each family weighs the same."""
    w, b = np.zeros((x.shape[1], families), np.float32), np.zeros(families, np.float32)
    target = np.eye(families, dtype=np.float32)[y]
    each = (1 / target.sum(axis=0).clip(1))[y][:, None] * len(y) / families
    for _ in range(rounds):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - target) * each / len(y)
        w -= 20 * (x.T @ error + 2e-5 * w)
        b -= 2 * error.sum(axis=0)
    return w, b


def train(background: list[str], notices: dict[str, tuple[str, ...]] = NOTICES, copies: int = 24, accept: float = 0.7, similar: float = 0.8, seed: int = 5, rounds: int = 300, folds: int = 3) -> Model:
    """A model from ``copies`` variants of each notice against the background paragraphs and shuffled notices.

    The temperature comes from ``folds`` models, each without a part of the notices and of the background.
    """
    draw = np.random.default_rng(seed)
    families = (*notices, UNKNOWN)
    plain = [words_of(x) for x in background]
    # (words, family, fold): all variants of a notice are in one fold, and a family's notices in different ones
    rows: list[tuple[list[str], int, int]] = [(w, len(notices), i % folds) for i, w in enumerate(plain)]
    for k, texts in enumerate(notices.values()):
        for i, text in enumerate(texts):
            words = words_of(text)
            rows += [(words, k, i % folds)] * (copies // 3)
            for _ in range(copies):
                around = plain[draw.integers(len(plain))] if plain else []
                rows.append((_thinned(words, draw) + around[: int(draw.integers(0, 12))], k, i % folds))
                if len(words) > 3:
                    rows.append(([words[i] for i in draw.permutation(len(words))][: max(2, len(words) // 2)], len(notices), i % folds))
    common = Counter(g for w in plain for g in set(grams(w)))
    often = max(2, 0.002 * len(plain))
    vocabulary = sorted({g for t in notices.values() for x in t for g in grams(words_of(x))})
    index = {g: i for i, g in enumerate(g for g in vocabulary if common[g] < often)}
    x = np.zeros((len(rows), len(index)), np.float32)
    y, fold = np.array([k for _, k, _ in rows]), np.array([f for _, _, f in rows])
    for i, (words, _, _) in enumerate(rows):
        at = sorted({index[g] for g in grams(words) if g in index})
        x[i, at] = 1 / max(1.0, np.sqrt(len(at)))
    z = np.zeros((len(rows), len(families)))
    for f in range(folds):
        held = fold == f
        wf, bf = _fit(x[~held], y[~held], len(families), rounds)
        z[held] = x[held] @ wf + bf
    w, b = _fit(x, y, len(families), rounds)

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s - np.log(np.exp(s).sum(axis=1, keepdims=True)))[np.arange(len(s)), y].mean())

    temperature = min(np.geomspace(0.25, 4, 33).tolist(), key=loss)
    templates = {f: tuple((t, frozenset(shingles(words_of(t)))) for t in texts) for f, texts in notices.items()}
    parts = frozenset(x for t in templates.values() for _, part in t for x in part)
    keys, sizes = frozenset(g.split(" ", 1)[0] for g in index), tuple(sorted({len(x) for x in parts}))
    return Model(families, index, keys, w.astype(float), b.astype(float), temperature, templates, parts, sizes, accept, similar)


def background_paragraphs(docs: DataFrame, text_col: str = "text", bound: int = 3000) -> list[str]:
    """At most ``bound`` paragraphs of documents, those first by hash, that name no licence or rights."""
    line = F.try_element_at(F.filter(F.split("text", "\n"), lambda x: (F.trim(x) != "") & ~x.rlike("(?i)licen[sc]|copyright|rights reserved|public domain|creative commons|\\bCC\\b")), F.lit(1))
    rows = bounded_sample(docs.filter(F.trim(F.col(text_col)) != "").select(F.col(text_col).alias("text")), F.col("text"), bound)
    return sorted(r["p"] for r in rows.select(line.alias("p")).filter("p is not null").collect())


def paragraphs(lines: list[list[str]], model: Model) -> Iterator[tuple[int, int, list[str]]]:
    """(first line, last line, words) of each line with a word of the model's, and of each run of several lines with a part of a template.

    ``lines`` are their words, which marks of comments aren't; a run ends at a line without words.
    """
    first = 0
    for k in range(len(lines) + 1):
        if k < len(lines) and not model.keys.isdisjoint(lines[k]):
            yield k, k, lines[k]
        if k == len(lines) or not lines[k]:
            if k - first > 1:
                joined = [w for x in lines[first:k] for w in x]
                if any(not model.parts.isdisjoint(zip(*(joined[i:] for i in range(n)), strict=False)) for n in model.sizes):
                    yield first, k - 1, joined
            first = k + 1


FOUND = "family string, probability double, paragraph int, paragraph_start long, paragraph_end long, similarity double, confirmed boolean, families array<string>, n_paragraphs long"


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and FOUND for each row: its likeliest licence paragraph (span in characters), and all families its paragraphs name."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL(FOUND).fields])

    floor = float(1 - model.probabilities([])[-1])

    def judge(text: str) -> tuple:
        parts = text.split("\n")
        lines = list(map(words_of, parts))
        if all(map(model.keys.isdisjoint, lines)):
            return None, floor, None, None, None, 0.0, False, [], len(lines)
        at = [0, *accumulate(len(x) + 1 for x in parts)]
        best, named = (False, False, floor), set()
        found = None, floor, None, None, None, 0.0, False
        for first, last, words in paragraphs(lines, model):
            family, p, similarity, confirmed = model.judge(words)
            if family == UNKNOWN:
                family, confirmed = None, False
            elif last > first and not confirmed:
                continue
            else:
                named.add(family)
            rank = confirmed, family is not None, p
            if rank > best:
                where = (None, None, None) if family is None else (first, at[first], at[last + 1] - 1)
                best, found = rank, (family, p, *where, similarity, confirmed)
        return *found, sorted(named), len(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.list_(pa.string()), pa.int64()]
        for batch in batches:
            found = list(zip(*map(judge, batch.column("text").to_pylist()), strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)
