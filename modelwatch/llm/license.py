"""Licence scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a line that isn't blank, or several neighbouring ones without a blank
line between them that only together hold a notice, as one that is hard-wrapped: where
the template pairs of a stretch of words run over several lines, these lines are
joined by a blank and judged as one, and count as one paragraph when that is a
licence or unknown. A line that is a licence by itself is never joined to another
family. A multinomial logistic regression over sparse
word uni- and bigrams tells the licence families and "none" apart. It is trained
on the templates below, each in variants that lack words or stand amid words of
the corpus, and on paragraphs of the corpus as "none". Probabilities are
calibrated on variants and paragraphs kept out of the training: a temperature
that makes them fit, and a least confidence that next to no plain paragraph
reaches. What looks like a licence but shares too little with every template of
its family, or a little more while below that confidence, is "unknown".

Texts are scanned whole. Null and empty texts have no paragraph. Rows that repeat
are scanned each. With an empty table the templates alone train the classifier.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.llm.common import map_rows, runs_on_workers

runs_on_workers(__name__)

#: Notices and key sentences by family.
TEMPLATES: dict[str, list[str]] = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "This project is released under the Apache 2.0 license.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "This code is licensed under the 2-clause BSD license.",
    ],
    "cc0": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GPL v2 or later.",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute this library under the terms of the GNU Lesser General Public License.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "This project is licensed under the terms of the MIT license.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced without written permission.",
        "Copyright, all rights reserved.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "This work is in the public domain.",
    ],
}
NONE, UNKNOWN = "none", "unknown"
#: Documents whose paragraphs train the class "none", at most, and variants of each template.
SAMPLE_DOCUMENTS = 1500
VARIANTS = 30
#: The share of a template's bigrams that a confirmed paragraph holds.
CONFIRMED = 0.6
#: The share that confirms a prediction below the least confidence.
CERTAIN = 0.9
#: Below this share a paragraph is none, whatever the prediction.
SLIGHT = 0.25
#: The share of plain paragraphs kept out of training that may pass for a licence.
FALSE_ALARMS = 0.001

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def tokens(paragraph: str) -> list[bytes]:
    """Lower-cased words of letters and digits."""
    return paragraph.encode("utf-8", "surrogatepass").translate(_KEEP).split()


class Vocabulary:
    """Uni- and bigrams of the templates; all others are no features."""

    def __init__(self, templates: dict[str, list[str]]):
        self.words: dict[bytes, int] = {}
        self.grams: dict[tuple[int, int], int] = {}
        self.templates: dict[str, list[frozenset]] = {}
        n = 0
        for texts in templates.values():
            for w in sorted({w for t in texts for w in tokens(t)}):
                self.words.setdefault(w, len(self.words) + 1)
        n = len(self.words)
        for family, texts in templates.items():
            self.templates[family] = [frozenset(self._pairs(self.ids(t))) for t in texts]
            for pair in sorted(set().union(*self.templates[family])):
                self.grams.setdefault(pair, n + len(self.grams))
        self.size = n + len(self.grams)
        #: per template with pairs: family, number of pairs, words; and the templates of each pair
        self.whole: list[tuple[str, int, int]] = []
        self.held: dict[tuple[int, int], list[int]] = {}
        for family, texts in templates.items():
            for text, pairs in zip(texts, self.templates[family], strict=True):
                if pairs:
                    for pair in pairs:
                        self.held.setdefault(pair, []).append(len(self.whole))
                    self.whole.append((family, len(pairs), len(tokens(text))))

    def ids(self, paragraph: str) -> list[int]:
        get = self.words.get
        return [get(w, 0) for w in tokens(paragraph)]

    @staticmethod
    def _pairs(ids: list[int]) -> set[tuple[int, int]]:
        return {p for p in zip(ids, ids[1:], strict=False) if p[0] and p[1]}

    def features(self, ids: list[int]) -> list[int]:
        """Features that are there, sorted."""
        pairs = [self.grams[p] for p in self._pairs(ids) if p in self.grams]
        return sorted({i - 1 for i in ids if i} | set(pairs))

    def resemblance(self, ids: list[int], family: str) -> float:
        """The largest share of a template's bigrams that the paragraph holds."""
        pairs = self._pairs(ids)
        return max((len(pairs & t) / len(t) for t in self.templates[family] if t), default=0.0)


def _variants(templates: dict[str, list[str]], around: list[str], rng: np.random.Generator) -> list[tuple[str, str]]:
    """(family, text): every template whole, without some words, amid others."""
    out = []
    for family, texts in templates.items():
        for text in texts:
            words = text.split()
            out.append((family, text))
            for _ in range(VARIANTS):
                kept = [w for w in words if rng.random() > 0.08] or words
                lead, tail = (" ".join(rng.choice(around, rng.integers(0, 12))) if around else "" for _ in range(2))
                out.append((family, f"{lead} {' '.join(kept)} {tail}"))
    return out


def sample_paragraphs(docs: DataFrame, vocabulary: Vocabulary, documents: int = SAMPLE_DOCUMENTS) -> list[str]:
    """Distinct paragraphs of up to ``documents`` documents (by a hash of the id)
    that resemble no template; up to 20 a document."""
    chosen = docs.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents).distinct()
    lines = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    lines = lines.select(F.explode(F.slice(F.split("text", "\n"), 1, 20)).alias("line"))
    rows = lines.filter(F.length("line").between(1, 2000)).distinct().orderBy("line").limit(20 * documents)
    found = [r["line"] for r in rows.collect()]
    plain = []
    for line in found:
        ids = vocabulary.ids(line)
        if ids and max(vocabulary.resemblance(ids, f) for f in vocabulary.templates) < 0.3:
            plain.append(line)
    return plain


def train(spark: SparkSession, docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> dict:
    """The classifier: vocabulary, weights, temperature and least confidence."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    vocabulary, rng = Vocabulary(templates), np.random.default_rng(6)
    plain = sample_paragraphs(docs, vocabulary)
    around = [w for line in plain[:200] for w in line.split()]
    labels = [NONE, *templates]
    examples = [(NONE, "")] + [(NONE, p) for p in plain] + _variants(templates, around, rng)
    rows = [(labels.index(f), vocabulary.features(vocabulary.ids(t))) for f, t in examples]
    held = rng.random(len(rows)) < 0.25
    held[0] = False

    def vector(at: list[int]) -> object:
        return Vectors.sparse(vocabulary.size, at, [1.0] * len(at))

    fitted = [(float(y), vector(x)) for (y, x), h in zip(rows, held, strict=True) if not h]
    fitted += [(float(y), vector(x)) for y, x in rows if y and not any(f[0] == y for f in fitted)]
    frame = spark.createDataFrame(fitted, ["label", "features"])
    model = LogisticRegression(family="multinomial", maxIter=60, regParam=1e-4, standardization=False).fit(frame)
    weights, offset = model.coefficientMatrix.toArray(), np.array(model.interceptVector.toArray())

    scores = np.array([offset + weights[:, x].sum(axis=1) for (y, x), h in zip(rows, held, strict=True) if h]).reshape(-1, len(labels))
    truth = np.array([y for (y, x), h in zip(rows, held, strict=True) if h], int)

    def probabilities(t: float) -> np.ndarray:
        z = scores / t
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    losses = {t: -np.log(probabilities(t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 5.0)} if len(truth) else {1.0: 0.0}
    temperature = min(losses, key=losses.get)
    passing = probabilities(temperature)[truth == 0][:, 1:].max(axis=1) if (truth == 0).any() else np.zeros(0)
    least = max(0.5, float(np.quantile(passing, 1 - FALSE_ALARMS))) if len(passing) else 0.5
    right = float((scores.argmax(axis=1) == truth).mean()) if len(truth) else 1.0
    return {
        "vocabulary": vocabulary, "labels": labels, "weights": weights / temperature, "offset": offset / temperature,
        "least": min(least, 0.99), "held_out_accuracy": right,
    }


def classifier(model: dict) -> Callable[[str], str]:
    """The function from paragraph to family, "unknown" or "none"."""
    judge, ids = _judge(model), model["vocabulary"].ids
    return lambda paragraph: judge(ids(paragraph))


def _judge(model: dict) -> Callable[[list[int]], str]:
    vocabulary, labels, weights, offset, least = (model[k] for k in ("vocabulary", "labels", "weights", "offset", "least"))

    def judge(ids: list[int]) -> str:
        if sum(map(bool, ids)) < 2:
            return NONE
        z = offset + weights[:, vocabulary.features(ids)].sum(axis=1)
        p = np.exp(z - z.max())
        p /= p.sum()
        if p[0] >= 0.5:
            return NONE
        best = 1 + int(p[1:].argmax())
        alike = vocabulary.resemblance(ids, labels[best])
        if alike < SLIGHT:
            return NONE
        return labels[best] if alike >= (CONFIRMED if p[best] >= least else CERTAIN) else UNKNOWN

    return judge


def stretches(vocabulary: Vocabulary, lines: list[list[int]]) -> list[tuple[int, int]]:
    """First and last line of the stretches of words that hold SLIGHT or more of a
    template's pairs, those with most pairs first, then the shortest.

    A stretch is at most twice as long as its template, so the work grows with the
    words, however long the lines and however many."""
    ids = [i for line in lines for i in line]
    met: dict[int, list[tuple[int, tuple[int, int]]]] = {}
    for at, pair in enumerate(zip(ids, ids[1:], strict=False)):
        for t in vocabulary.held.get(pair, ()):
            met.setdefault(t, []).append((at, pair))
    met = {t: hits for t, hits in met.items() if len(hits) >= SLIGHT * vocabulary.whole[t][1]}
    if not met:
        return []
    line_of = [n for n, line in enumerate(lines) for _ in line]
    out = set()
    for t, hits in met.items():
        _, size, words = vocabulary.whole[t]
        for k, (start, _) in enumerate(hits):
            seen, last = set(), start
            for at, pair in hits[k:]:
                if at >= start + 2 * words:
                    break
                if pair not in seen:
                    seen.add(pair)
                    last = at
            if len(seen) >= SLIGHT * size:
                out.add((-len(seen), last - start, line_of[start], line_of[last + 1]))
    return list(dict.fromkeys((first, last) for _, _, first, last in sorted(out)))


def scanner(model: dict) -> Callable[[str | None], tuple[int, list[str], int]]:
    """The function from text to its number of paragraphs, the families of the
    confirmed ones and the number of unknown ones."""
    judge, vocabulary = _judge(model), model["vocabulary"]
    known: dict[str, tuple[list[int], str]] = {}

    def of_line(line: str) -> tuple[list[int], str]:
        found = known.get(line)
        if found is None:
            ids = vocabulary.ids(line)
            found = ids, judge(ids)
            if len(known) < 50_000 and len(line) < 200:
                known[line] = found
        return found

    def of_block(lines: list[str]) -> list[str]:
        judged = [of_line(line) for line in lines]
        if len(lines) < 2:
            return [family for _, family in judged]
        taken = [False] * len(lines)
        out, wide = [], []
        for first, last in stretches(vocabulary, [ids for ids, _ in judged]):
            if last == first:
                wide.append((first, last, judged[first][1]))
            else:
                wide.append((first, last, judge([i for ids, _ in judged[first : last + 1] for i in ids])))
        # confirmed ones before unknown ones
        for first, last, family in sorted(wide, key=lambda w: w[2] == UNKNOWN):
            if family == NONE or any(taken[first : last + 1]):
                continue
            if any(f not in (NONE, UNKNOWN, family) for _, f in judged[first : last + 1]):
                continue
            taken[first : last + 1] = [True] * (last + 1 - first)
            out.append(family)
        return out + [family for (_, family), done in zip(judged, taken, strict=True) if not done]

    def scan(text: str | None) -> tuple[int, list[str], int]:
        families: list[str] = []
        block: list[str] = []
        for line in (text or "").split("\n"):
            if line.strip(" \t\x0b\f\r"):
                block.append(line)
            elif block:
                families += of_block(block)
                block = []
        if block:
            families += of_block(block)
        return len(families), [f for f in families if f not in (NONE, UNKNOWN)], families.count(UNKNOWN)

    return scan


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_licences (confirmed paragraphs), n_unknown and
    families (confirmed ones, sorted, comma between) of every row of ``docs``
    (doc_id, text; other columns are left out)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(docs.sparkSession, rows)

    def start() -> Callable[..., tuple]:
        scan = scanner(model)

        def run(doc_id: int | None, text: str | None) -> tuple:
            n, found, unknown = scan(text)
            return doc_id, n, len(found), unknown, ",".join(sorted(set(found)))

        return run

    return map_rows(rows, start, "doc_id long, n_paragraphs long, n_licences long, n_unknown long, families string")
