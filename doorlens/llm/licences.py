"""Licence scan: a trained paragraph classifier, its unknown class calibrated, each finding confirmed by a template.

Paragraphs are runs of lines with words. Each line is judged, and around each line break inside a paragraph the
words before and after it, so a notice may be wrapped anywhere; marks of comments are no words. Features are the word 1- to 3-grams that occur in licence notices, so a
paragraph is a sparse vector and one without such a gram is unknown without further work. The
classifier is a multinomial logistic regression over the licence families and `unknown`, trained here on
notices made from the templates below and, as unknown, on other sentences and on a bounded sample of the
corpus's own paragraphs. A temperature is fitted on held-out notices, so probabilities mean what
they say. A prediction counts once the paragraph also holds enough of one of the family's templates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"

# Short notices by which works name their licence, by family.
TEMPLATES = {
    "agpl": ("licensed under the GNU Affero General Public License, version 3",
             "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
             "SPDX-License-Identifier: AGPL-3.0-only"),
    "all-rights-reserved": ("All rights reserved",
                            "no part of this publication may be reproduced without prior written permission"),
    "apache": ("licensed under the Apache License, Version 2.0", "released under the Apache License 2.0",
               "you may not use this file except in compliance with the License",
               "SPDX-License-Identifier: Apache-2.0"),
    "bsd": ("licensed under the BSD 3-Clause License", "released under the BSD license", "BSD-2-Clause licensed",
            "redistribution and use in source and binary forms, with or without modification, are permitted",
            "SPDX-License-Identifier: BSD-3-Clause"),
    "cc-by": ("licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-nc": ("licensed under CC BY-NC 4.0", "licensed under CC BY-NC-SA 4.0",
                 "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-sa": ("licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc0": ("dedicated to the public domain under CC0 1.0", "released into the public domain",
            "to the extent possible under law, the author has waived all copyright and related rights to this work"),
    "epl": ("licensed under the Eclipse Public License 2.0", "made available under the terms of the Eclipse Public License",
            "SPDX-License-Identifier: EPL-2.0"),
    "gpl": ("GPL version 2 only", "licensed under the GNU General Public License, version 3", "released under the GNU GPL v2 or later",
            "under the terms of the GNU General Public License as published by the Free Software Foundation",
            "SPDX-License-Identifier: GPL-3.0-only"),
    "isc": ("licensed under the ISC License", "SPDX-License-Identifier: ISC",
            "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "lgpl": ("licensed under the GNU Lesser General Public License, version 2.1",
             "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "mit": ("released under the MIT License", "licensed under the MIT License",
            "permission is hereby granted, free of charge, to any person obtaining a copy of this software",
            "SPDX-License-Identifier: MIT"),
    "mpl": ("subject to the terms of the Mozilla Public License, version 2.0", "licensed under the Mozilla Public License 2.0"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"),
    "zlib": ("permission is granted to anyone to use this software for any purpose, including commercial applications",
             "released under the zlib license", "SPDX-License-Identifier: Zlib"),
}
# What stands around a notice, and sentences that use its words without naming a licence.
BEFORE = ("", "This work is", "This software is", "This file is", "Copyright 2020 The Authors,", "Code in this folder is",
          "Unless noted otherwise, content is")
AFTER = ("", "See the LICENSE file for details.", "Contributions are welcome.", "Copyright (c) 2019 Example Ltd.")
OTHER = (
    "the driver must hold a valid license to use the public road", "a general meeting of the public was held under version two of the terms",
    "you may copy the work for your own use", "software is released every month", "the source of the river is in the northern hills",
    "all people have rights and duties under law", "the license of the shop was reserved for later", "permission to enter was granted free of charge",
    "a work of the public library in the common hall", "the domain of a function", "the foundation published a free report",
    "the authors thank the creative team for attribution of the pictures", "version 2.0 of the program fixes several bugs",
    "commercial use of the hall needs permission", "the tickets are reserved", "this file is too large to open",
)
_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
GRAMS = 3
#: Corpus paragraphs used as examples of `unknown`: a bound, whatever the corpus.
CORPUS_SAMPLE = 2000
MIN_PROBABILITY = 0.5
MIN_TEMPLATE = 0.8
#: Words on either side of a line break that a notice across it may reach: twice the longest template.
ACROSS = 2 * max(len(_WORD.findall(t.lower())) for ts in TEMPLATES.values() for t in ts)


def paragraph_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(words: list[str], most: int = GRAMS) -> set[str]:
    return {" ".join(words[i:i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)}


@dataclass
class Model:
    """Weights per gram and family; `temperature` divides the scores."""

    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: dict[str, list[list[str]]]

    def rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        return [np.array(sorted(self.vocabulary[g] for g in grams(w) if g in self.vocabulary), np.int64) for w in texts]

    def probabilities(self, texts: list[list[str]]) -> np.ndarray:
        scores = np.stack([self.bias + self.weights[r].sum(0) / max(1, len(r)) ** 0.5 for r in self.rows(texts)]) / self.temperature
        return _softmax(scores)

    def finding(self, words: list[str]) -> tuple[str, float, str, float] | None:
        """(family, probability, template, likeness) of a confirmed licence paragraph."""
        p = self.probabilities([words])[0]
        best = int(np.argmax(p))
        if self.families[best] == UNKNOWN or p[best] < MIN_PROBABILITY:
            return None
        likeness, template = max((coverage(t, words), " ".join(t)) for t in self.templates[self.families[best]])
        return (self.families[best], float(p[best]), template, likeness) if likeness >= MIN_TEMPLATE else None


def coverage(template: list[str], words: list[str]) -> float:
    """The largest part of the template found in order within some stretch of words twice its length."""
    step = len(template)
    return max(_in_order(template, words[at:at + 2 * step]) for at in range(0, max(1, len(words) - step + 1), step))


def _in_order(template: list[str], words: list[str]) -> float:
    """Longest common subsequence as a part of the template."""
    row = [0] * (len(template) + 1)
    for word in words:
        diagonal = 0
        for i, expected in enumerate(template, 1):
            diagonal, row[i] = row[i], diagonal + 1 if word == expected else max(row[i], row[i - 1])
    return row[-1] / len(template)


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def labelled_notices() -> list[tuple[str, str]]:
    """(text, family): every template in every setting, and the other sentences."""
    made = [(f"{b} {t}. {a}".strip(), f) for f, ts in TEMPLATES.items() for t in ts for b in BEFORE for a in AFTER]
    return made + [(f"{a} {o} {b}", UNKNOWN) for o in OTHER for a in ("", *OTHER[:6]) for b in ("", *OTHER[6:10])]


def train(corpus: list[str], rounds: int = 300, rate: float = 2.0, decay: float = 1e-4) -> Model:
    """Fits the classifier; every fourth example is held out for the temperature."""
    all_templates = [paragraph_words(t) for ts in TEMPLATES.values() for t in ts]
    clean = [w for w in map(paragraph_words, corpus) if not _holds_any(all_templates, w)]
    examples = [(paragraph_words(t), f) for t, f in labelled_notices()] + [(w, UNKNOWN) for w in clean]
    families = [UNKNOWN, *sorted(TEMPLATES)]
    seen = sorted({g for t, _ in labelled_notices() for g in grams(paragraph_words(t))})
    model = Model(families, {g: i for i, g in enumerate(seen)}, np.zeros((len(seen), len(families))), np.zeros(len(families)), 1.0,
                  {f: [paragraph_words(t) for t in ts] for f, ts in TEMPLATES.items()})
    rows = model.rows([w for w, _ in examples])
    target = np.array([families.index(f) for _, f in examples])
    held = np.arange(len(examples)) % 4 == 3
    # Few examples and few grams: a dense matrix is small, whatever the corpus.
    values = np.zeros((len(rows), len(seen)), np.float32)
    for i, r in enumerate(rows):
        values[i, r] = 1 / max(1, len(r)) ** 0.5
    fit = np.flatnonzero(~held)
    # Families weigh alike, however many notices each has.
    weight = 1 / np.bincount(target[fit], minlength=len(families))[target] / len(families)
    weight[held] = 0
    one_hot = np.eye(len(families))[target]
    speed_w, speed_b = np.zeros_like(model.weights), np.zeros_like(model.bias)
    for _ in range(rounds):
        off = (_softmax(values @ model.weights + model.bias) - one_hot) * weight[:, None]
        speed_w = 0.9 * speed_w - rate * (values.T @ off + decay * model.weights)
        speed_b = 0.9 * speed_b - rate * off.sum(0)
        model.weights += speed_w
        model.bias += speed_b
    scores = values @ model.weights + model.bias
    loss = {t: -np.log(_softmax(scores[held] / t)[np.arange(held.sum()), target[held]] + 1e-12).mean() for t in np.geomspace(0.1, 4, 25)}
    model.temperature = float(min(loss, key=loss.get))
    return model


def _needed(templates: list[list[str]]) -> list[tuple[list[str], set[str], float]]:
    """Each template, its words, and how many of them a paragraph that covers it has to hold."""
    return [(t, set(t), len(set(t)) - (1 - MIN_TEMPLATE) * len(t)) for t in templates]


def _holds_any(templates: list[list[str]], words: list[str]) -> bool:
    held = set(words)
    return any(len(t & held) >= least and coverage(template, words) >= MIN_TEMPLATE for template, t, least in _needed(templates))


def _start(template: list[str], words: list[str], likeness: float) -> int:
    """The last word from which on the template is still covered as well."""
    at = 0
    while at + 1 < len(words) and _covers(template, words[at + 1:], likeness):
        at += 1
    return at


def _covers(template: list[str], words: list[str], likeness: float) -> bool:
    return len(set(template) & set(words)) >= likeness * len(set(template)) - 1e-9 and coverage(template, words) >= likeness - 1e-9


def findings(model: Model, text: str) -> list[tuple[int, str, float, str, float]]:
    """(line, family, probability, template, likeness) of every notice: the line it begins on, from 0."""
    needed = _needed([t for ts in model.templates.values() for t in ts])
    lines = [paragraph_words(line) for line in text.split("\n")]
    found: dict[tuple[int, str], tuple] = {}
    wrapped: list[tuple[int, int, str]] = []

    def may_hold(words: list[str]) -> bool:
        held = set(words)
        return any(len(t & held) >= least for _, t, least in needed)

    for number, words in enumerate(lines):
        if may_hold(words) and (hit := model.finding(words)):
            found[number, hit[0]] = (number, *hit)
    for number in range(1, len(lines)):
        if not lines[number] or not lines[number - 1]:
            continue
        before: list[tuple[str, int]] = []
        at = number - 1
        while at >= 0 and lines[at] and len(before) < ACROSS:
            before = [(w, at) for w in lines[at][-ACROSS:]] + before
            at -= 1
        after: list[tuple[str, int]] = []
        at = number
        while at < len(lines) and lines[at] and len(after) < ACROSS:
            after += [(w, at) for w in lines[at][:ACROSS]]
            at += 1
        near = before[-ACROSS:] + after[:ACROSS]
        words = [w for w, _ in near]
        if not may_hold(words) or not (hit := model.finding(words)):
            continue
        template = hit[2].split(" ")
        start = _start(template, words, hit[3])
        first = near[start][1]
        if (first, hit[0]) not in found:
            found[first, hit[0]] = (first, *hit)
            end = next(e for e in range(start + 1, len(words) + 1) if _covers(template, words[start:e], hit[3]))
            wrapped.append((first, near[end - 1][1], hit[2]))
    # A notice that is part of a longer one's words, on its lines, is that one.
    return [hit for key, hit in sorted(found.items()) if not any(
        a <= key[0] <= b and hit[3] != whole and f" {hit[3]} " in f" {whole} " for a, b, whole in wrapped)]


def corpus_sample(docs: DataFrame, text: str, bound: int = CORPUS_SAMPLE) -> list[str]:
    """At most `bound` whole lines, one (chosen by hash) of each of the documents that come first by a hash of their text.

    Rows well beyond the bound are passed over by their hash, so each task hands on few.
    """
    share = min(1.0, 2.0 * bound / max(1, docs.count()))
    drawn = docs.select(F.xxhash64(F.col(text)).alias("h"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines")).filter(
        F.shiftrightunsigned("h", 1) / float(1 << 63) < share)
    drawn = drawn.select("h", F.get("lines", F.pmod(F.xxhash64("h"), F.size("lines")).cast("int")).alias("line"))
    rows = drawn.orderBy("h", "line").limit(bound).collect()
    return [r["line"] for r in rows]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = CORPUS_SAMPLE) -> DataFrame:
    """One row per licence notice: doc_id, paragraph (number of the line it begins on, from 0), family, probability, template, likeness.

    Documents without one have no row. Every line of every whole text is judged, and every line break inside a paragraph. Null and empty
    texts have none; repeated rows give repeated findings; null doc_ids are kept; an empty table
    gives no rows (the classifier is then trained on the notices alone).
    """
    model = train(corpus_sample(docs, text, sample))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the templates
    narrow = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            rows, out = [], []
            for i in range(batch.num_rows):
                for found in findings(model, batch.column(1)[i].as_py() or ""):
                    rows.append(i)
                    out.append(found)
            if out:
                kinds = (pa.int32(), pa.string(), pa.float64(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]],
                    names=["doc_id", "paragraph", "family", "probability", "template", "likeness"])

    return narrow.mapInArrow(work, f"doc_id {kind}, paragraph int, family string, probability double, template string, likeness double")
