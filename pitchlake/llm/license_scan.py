"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Every line of every text is a paragraph, and so is every block of lines without an empty line between them, as notices
are wrapped. A logistic regression over the word 1- to 3-grams that templates contain (a sparse vector: which of them the
paragraph has) gives each licence family, and an unknown class, a probability. It is trained on variants of the
templates (words left out, foreign words around them) and on paragraphs of a bounded sample of documents. A part of both
is held out: it sets the bias of the unknown class so that of held-out paragraphs without a licence at most one in a
thousand is taken for one, and then, with that bias, the temperature that calibrates the probabilities. A predicted
family counts as confirmed if the paragraph has enough of the word pairs of one of its templates.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import ROLLING, chunks, mix, read_table, text_bytes

UNKNOWN = "unknown"
#: So many sampled paragraphs, of so many bytes each, are fitted on at most.
SAMPLE_PARAGRAPHS, SAMPLE_BYTES = 4_096, 1 << 16
WHITE = " \t\n\x0b\x0c\r"
#: Usual notices of each licence family, and paragraphs of the licences themselves.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software under the terms of the GNU Affero General Public License"
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.", "You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0"
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0"
    ),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights"),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program."
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC"
    ),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"),
    "mit": (
        "Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "SPDX-License-Identifier: MIT",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": ("All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense"
    ),
}
ORDERS = (1, 2, 3)
#: Of held-out paragraphs without a licence, the share that may be taken for one.
MOST_FALSE = 0.001


def line_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word (runs of letters, digits and bytes from 128 on, A-Z as a-z), its line, the line each text begins
    with (n + 1), and for each line the first line of its block (no line of which is without words)."""
    n = len(raw)
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    solid = np.zeros(n + 2, bool)
    solid[1 : n + 1] = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    new = edge[:n].copy()
    new[1:] |= raw[:-1] == 10
    starts = np.flatnonzero(solid[1 : n + 1] & (~solid[:n] | edge[:n]))
    ends = np.flatnonzero(solid[1 : n + 1] & (~solid[2:] | edge[1:])) + 1
    number = np.concatenate([[0], np.cumsum(new)])
    line, first = number[starts + 1] - 1 if n else starts, number[offsets]
    lines = int(number[-1])
    full = np.bincount(line, minlength=lines) > 0
    opens = np.ones(lines, bool)
    opens[1:] = ~full[1:] | ~full[:-1]
    opens[first[:-1][first[:-1] < lines]] = True
    block = np.maximum.accumulate(np.where(opens, np.arange(lines), 0)) if lines else np.zeros(0, np.int64)
    return ROLLING.between(ROLLING.sums(low), starts, ends), line, first, block


def grams(words: np.ndarray, paragraph: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the hash of each n-gram and its paragraph."""
    h = np.zeros(len(words), np.uint64)
    for n in ORDERS:
        if len(words) < n:
            return
        h = h[: len(words) - n + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[n - 1 :]
        inside = paragraph[: len(h)] == paragraph[n - 1 :]
        yield mix(h[inside] + np.uint64(n)), paragraph[: len(h)][inside]


def _encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = [t.replace("\n", " ").encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def _gram_list(text: str) -> list[np.ndarray]:
    words, paragraph, _, _ = line_words(*_encode([text]))
    return [h for h, _ in grams(words, paragraph)]


@dataclass
class Model:
    families: list[str]  # the last is UNKNOWN
    vocabulary: np.ndarray  # hashes, rising
    weights: np.ndarray  # vocabulary x families
    bias: np.ndarray
    temperature: float
    templates: list[tuple[int, np.ndarray]] = field(default_factory=list)  # family, its features that are word pairs (or single words, if it has one word)
    held: dict[str, float] = field(default_factory=dict)  # held-out shares of false and of missed ones, and the log loss

    def features(self, words: np.ndarray, paragraph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(paragraph, feature) pairs, distinct and in order."""
        found = []
        for h, p in grams(words, paragraph):
            i = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            hit = self.vocabulary[i] == h
            found.append(p[hit] * len(self.vocabulary) + i[hit])
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return both // len(self.vocabulary), both % len(self.vocabulary)

    def classify(self, words: np.ndarray, paragraph: np.ndarray) -> list[tuple[int, str, float, float]]:
        """(paragraph, family, probability, similarity) of the paragraphs that aren't unknown, in order."""
        p, feature = self.features(words, paragraph)
        found, prob = self.probabilities(p, feature)
        best = prob.argmax(axis=1) if len(found) else np.zeros(0, np.int64)
        out = []
        for k in np.flatnonzero(best != len(self.families) - 1).tolist():
            has = np.zeros(len(self.vocabulary), bool)
            has[feature[np.searchsorted(p, found[k], "left") : np.searchsorted(p, found[k], "right")]] = True
            similarity = max(float(has[own].mean()) for f, own in self.templates if f == best[k])
            out.append((int(found[k]), self.families[best[k]], float(prob[k, best[k]]), similarity))
        return out

    def probabilities(self, paragraph: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The paragraphs that have a feature, and their probabilities; all others are unknown."""
        if not len(paragraph):
            return paragraph, np.zeros((0, len(self.families)))
        head = np.flatnonzero(np.append(True, paragraph[1:] != paragraph[:-1]))
        x = (np.add.reduceat(self.weights[feature], head, axis=0) + self.bias) / self.temperature
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return paragraph[head], e / e.sum(axis=1, keepdims=True)


class Sparse:
    """Rows of zeros and ones, as (row, column) of the ones in row order."""

    def __init__(self, model: Model, texts: list[str]) -> None:
        words, line, _, _ = line_words(*_encode(texts))
        row, column = model.features(words, line)
        both = np.unique(row.astype(np.int64) * len(model.vocabulary) + column)
        self.row, self.column = np.divmod(both, len(model.vocabulary))
        self.shape = len(texts), len(model.vocabulary)

    def rows(self, keep: np.ndarray) -> Sparse:
        """The rows of a mask, numbered anew."""
        out = copy.copy(self)
        some = keep[self.row]
        out.row, out.column = (np.cumsum(keep) - 1)[self.row[some]], self.column[some]
        out.shape = int(keep.sum()), self.shape[1]
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return _summed(self.row, w[self.column], self.shape[0])

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        order = np.argsort(self.column, kind="stable")
        return _summed(self.column[order], g[self.row[order]], self.shape[1])


def _summed(key: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of `values` by `key`, which is in rising order."""
    out = np.zeros((n, values.shape[1]))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    if len(first):
        out[key[first]] = np.add.reduceat(values, first, axis=0)
    return out


def fit(plain: list[str], variants: int = 40, steps: int = 400, seed: int = 7) -> Model:
    """Train on variants of TEMPLATES and on `plain` paragraphs; of these, what shares half of a template's word pairs is left out."""
    rng = np.random.default_rng(seed)
    families = [*sorted(TEMPLATES), UNKNOWN]
    lists = {(f, t): _gram_list(t) for f in families[:-1] for t in TEMPLATES[f]}
    vocabulary = np.unique(np.concatenate([h for x in lists.values() for h in x]))
    pairs = [(families.index(f), np.searchsorted(vocabulary, np.unique(x[1] if len(x) > 1 else x[0]))) for (f, _), x in lists.items()]
    model = Model(families, vocabulary, np.zeros((len(vocabulary), len(families))), np.zeros(len(families)), 1.0, pairs)
    clean = np.ones(len(plain), bool)
    if plain:
        sample = Sparse(model, plain)
        for _, own in pairs:
            clean &= np.bincount(sample.row[np.isin(sample.column, own)], minlength=len(plain)) < 0.5 * len(own)
    plain = [t for t, c in zip(plain, clean, strict=True) if c]
    pool = [w for t in plain for w in t.split()[:50]] or ["word"]
    texts, labels = [], []
    for family, template in lists:
        words = template.split()
        for k in range(variants):
            some = [w for w in words if len(words) < 4 or k < 2 or rng.random() > 0.1]
            around = [[pool[i] for i in rng.integers(0, len(pool), rng.integers(0, 12))] if k >= 2 else [] for _ in range(2)]
            texts.append(" ".join([*around[0], *some, *around[1]]))
            labels.append(families.index(family))
    # what the templates are made of, but too little of it, is unknown
    for family, template in lists:
        words = template.split()
        for _ in range(variants // 4):
            k = max(1, len(words) // 4)
            i = int(rng.integers(0, len(words) - k + 1))
            if k < len(words):
                texts.append(" ".join([pool[j] for j in rng.integers(0, len(pool), 6)] + words[i : i + k]))
                labels.append(len(families) - 1)
    texts += plain
    labels += [len(families) - 1] * len(plain)
    x, y = Sparse(model, texts), np.eye(len(families))[labels]
    held = rng.random(len(texts)) < 0.25
    weight = (len(texts) / len(families) / y.sum(axis=0).clip(1))[np.array(labels)]
    weight = weight / weight[~held].mean()
    w, b = model.weights, model.bias
    seen, apart = x.rows(~held), x.rows(held)
    for _ in range(steps):
        z = seen.times(w) + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = (e / e.sum(axis=1, keepdims=True) - y[~held]) * weight[~held, None] / (~held).sum()
        w -= 4.0 * (seen.transposed_times(g) + 1e-4 * w)
        b -= 4.0 * g.sum(axis=0)
    z, truth = apart.times(w) + b, y[held]
    negative = z[truth[:, -1] == 1]
    if len(negative):
        over = negative[:, :-1].max(axis=1) - negative[:, -1]
        shift = max(0.0, float(np.quantile(over, 1 - MOST_FALSE, method="higher")) + 1e-6)
        model.bias[-1] += shift
        z[:, -1] += shift

    def loss(t: float) -> float:
        m = z / t
        return float((np.log(np.exp(m - m.max(axis=1, keepdims=True)).sum(axis=1)) + m.max(axis=1) - (m * truth).sum(axis=1)).mean()) if len(z) else 0.0

    model.temperature = min((float(t) for t in np.geomspace(0.25, 4, 33)), key=loss)
    if len(z):
        known, right = truth[:, -1] == 0, z.argmax(axis=1) == truth.argmax(axis=1)
        model.held = {
            "false": float(1 - right[~known].mean()) if (~known).any() else 0.0, "missed": float(1 - right[known].mean()) if known.any() else 0.0,
            "loss": loss(model.temperature)
        }
    return model


def sample_paragraphs(docs: DataFrame, text_col: str, sample_docs: int, most: int = SAMPLE_PARAGRAPHS, most_bytes: int = SAMPLE_BYTES) -> list[str]:
    """Lines and blocks of the `sample_docs` different texts that have the least hashes: `most` of them, by hash, of at most
    `most_bytes` each, so that what the driver fits on is bounded however long the texts are."""
    h = F.xxhash64(text_col)
    some = docs.where(F.col(text_col).isNotNull()).select(h.alias("h")).distinct().orderBy("h").limit(sample_docs)
    texts = docs.where(F.col(text_col).isNotNull()).select(h.alias("h"), F.col(text_col).alias("text")).join(F.broadcast(some), "h").groupBy("h").agg(
        F.min("text").alias("text")
    )
    lines = texts.select("h", F.lit(0).alias("kind"), F.posexplode(F.split("text", "\n")).alias("place", "p"))
    blocks = texts.select("h", F.lit(1).alias("kind"), F.posexplode(F.split("text", "\n\n")).alias("place", "p")).where(F.trim("p", F.lit(WHITE)).contains("\n"))
    found = lines.union(blocks).where((F.trim("p", F.lit(WHITE)) != "") & (F.octet_length("p") <= most_bytes))
    rows = found.orderBy(F.xxhash64("p"), "h", "kind", "place").limit(most).collect()
    return [r["p"].replace("\n", " ") for r in sorted(rows, key=lambda r: (r["kind"], r["h"], r["place"]))]


def scan(docs: DataFrame, sample_docs: int = 48, confirm: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each paragraph with a licence: id, paragraph (number of its first line in the text, from 0), lines,
    family, probability, similarity (greatest share of a template's word pairs, among the family's templates) and
    confirmed (is it at least `confirm`?).

    A block of lines comes out only if it is confirmed and none of its lines is for the same family. Null and empty texts
    have no licence. Repeated rows come out repeated, null ids as they are; ties go to the family first by name. An empty
    table gives no rows. Extra columns are not read. The model is fitted on at most SAMPLE_PARAGRAPHS
    paragraphs of at most `sample_docs` documents; all paragraphs of all documents are classified, whole, in chunks of a few
    MB (a longer text is a chunk of its own)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(sample_paragraphs(docs, "text", sample_docs)))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets, 1 << 20):
                words, line, first, block = line_words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                size = np.bincount(block, minlength=len(block))
                rows = [(x, 1, f, p, s) for x, f, p, s in m.classify(words, line)]
                known = {(int(block[x]), f) for x, _, f, _, s in rows if s >= confirm}
                wide = size[block[line]] > 1 if len(line) else np.zeros(0, bool)
                rows += [(x, int(size[x]), f, p, s) for x, f, p, s in m.classify(words[wide], block[line[wide]]) if s >= confirm and (x, f) not in known]
                rows.sort()
                if rows:
                    doc = np.searchsorted(first, [x for x, *_ in rows], "right") - 1
                    place, lines, family, probability, similarity = (list(c) for c in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(a + doc)), pa.array(np.array(place) - first[doc]), pa.array(lines), pa.array(family),
                            pa.array(probability), pa.array(similarity), pa.array([s >= confirm for s in similarity])
                        ],
                        names=["id", "paragraph", "lines", "family", "probability", "similarity", "confirmed"]
                    )

    return docs.mapInArrow(
        run, f"id {kind}, paragraph long, lines long, family string, probability double, similarity double, confirmed boolean"
    ).withColumnRenamed("id", id_col)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
