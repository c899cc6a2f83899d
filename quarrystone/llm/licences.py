"""Licence notices by a trained paragraph classifier.

Sparse multinomial logistic regression over word 1- to 3-grams tells licence families and an unknown class
apart; its temperature is fitted on held-out paragraphs so that probabilities mean what they say. A
prediction is confirmed by comparing the paragraph with the family's templates. Paragraphs are lines, and
passages over several lines, which are looked for where a template's word bigrams lie close together. An SPDX
expression of several identifiers is judged as one line for each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm import text as T

BITS = 20
GRAMS = (1, 2, 3)
UNKNOWN = "unknown"
#: A template's bigrams in a wrapped notice lie within this many times the words of the template.
REACH = 4

#: Short notices and opening words of public licences, by family.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Released under the BSD 3-Clause License.",
        "Released under the BSD 2-Clause License.",
        "License: BSD",
        "SPDX-License-Identifier: BSD-2-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GNU General Public License v2.0.",
        "Licensed under GPLv2.",
        "Licensed under GPLv3.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}
#: Words of which a family's notices hold one at least, and words that none of them holds.
MARKS = {
    "Apache-2.0": (("apache",), ()),
    "BSD": (("bsd", "redistribution", "redistributions"), ()),
    "CC-BY": (("cc", "creative"), ("nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives", "noderivs")),
    "CC-BY-NC": (("nc", "noncommercial"), ("sa", "nd", "sharealike", "noderivatives", "noderivs")),
    "CC-BY-SA": (("sa", "sharealike"), ("nc", "nd", "noncommercial", "noderivatives", "noderivs")),
    "CC0": (("cc0", "waived"), ()),
    "GPL": (("gnu", "gpl", "gplv2", "gplv3"), ("lesser", "lgpl", "affero", "agpl", "documentation")),
    "LGPL": (("lesser", "lgpl"), ()),
    "MIT": (("mit", "permission"), ("isc", "fee")),
    "MPL-2.0": (("mozilla", "mpl"), ()),
}
#: Notices of other licences, which are of the unknown class.
NEAR_MISSES = (
    "Licensed under the Eclipse Public License, version 2.0.",
    "Licensed under the Artistic License, Version 2.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Licensed under CC BY-ND 4.0.",
    "Licensed under CC BY-NC-ND 4.0.",
    "Licensed under CC BY-NC-SA 4.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "This work is licensed under the GNU Affero General Public License, version 3.",
    "This manual is licensed under the GNU Free Documentation License, version 1.3.",
    "Released under the ISC License.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Released under the zlib License.",
    "SPDX-License-Identifier: ISC",
    "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: AGPL-3.0-only",
)
#: Sentences that speak of licences without granting one.
DISTRACTORS = (
    "All rights reserved.",
    "The driver had no license and the version of the story changed.",
    "A public license hearing was held under the new general rules.",
    "The software is free of charge for every person in the school.",
    "He got a copy of the newspaper at the public library.",
    "She works under a license from the city and the work is done.",
    "Copyright law is the subject of this course.",
    "The university released the first version of its report.",
    "This work is based on a common idea and international attribution.",
    "The foundation published the terms and conditions of use.",
)
#: A licence that is denied is not granted.
DENIED = re.compile(r"\b(?:not|never|no longer|isn.?t|aren.?t|wasn.?t)\s+(?:\w+\s+)?(?:licensed|released|available|distributed|covered|provided)\b", re.I)
#: An SPDX line's expression, and its operators.
EXPRESSION = re.compile(r"(SPDX-License-Identifier:)\s*(\S.*?(?:\s(?:AND|OR|WITH)\s.*?)+)\s*(?:\*/|-->)?\s*$")
OPERATOR = re.compile(r"\s+(?:AND|OR)\s+|[()]")


def expression_lines(line: str) -> list[str]:
    """A line for each licence of an SPDX expression of several; none of other lines. Exceptions (WITH) are left out."""
    found = EXPRESSION.search(line)
    names = [x.split()[0] for x in OPERATOR.split(found[2]) if x.split()] if found else []
    return list(dict.fromkeys(f"{found[1]} {x}" for x in names)) if len(names) > 1 else []


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of paragraphs, text of each): a paragraph ends at a line end or its text's."""
    cuts = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets]))
    of = np.searchsorted(offsets, cuts[:-1], "right") - 1
    return cuts, of


def _features(data: np.ndarray, paragraphs: np.ndarray) -> tuple[np.ndarray, np.ndarray, T.Words]:
    """(paragraph, feature) of each n-gram."""
    w = T.Words(data, paragraphs, between=T.PUNCTUATION)
    of = np.repeat(np.arange(len(paragraphs) - 1), np.diff(w.first))
    last = np.repeat(w.first[1:], np.diff(w.first))
    rows, cols = [], []
    total = np.zeros(len(of), np.uint64)
    padded = np.concatenate([w.hash, np.zeros(len(GRAMS), np.uint64)])
    for n in GRAMS:
        total = total + padded[n - 1 : n - 1 + len(of)] * T._PLACES[n - 1]
        at = np.flatnonzero(np.arange(len(of)) + n <= last)
        rows.append(of[at])
        cols.append((T.mix(total[at] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(cols), w


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of adjacent words."""
    return T.mix(h[:-1] * T._PLACES[0] + h[1:] * T._PLACES[1])


def _unique(row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique((row << BITS) | col)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _chunk(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [x.replace("\n", " ").encode() for x in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def _examples(batches):
    """The paragraphs of a table's texts that are not near a template, nor lines of a wrapped notice: those have too little of a template to be near it, but are no examples of the unknown class."""
    near = Templates()
    for batch in batches:
        for _, data, offsets in T.chunks(batch):
            cuts, of = _lines(data, offsets)
            wrapped = {i for a, b in near.passages(T.Words(data, cuts, between=T.PUNCTUATION), of) for i in range(a, b + 1)}
            lines = (data[cuts[i] : cuts[i + 1]].tobytes().decode("utf-8", "replace").rstrip("\n") for i in range(len(cuts) - 1) if i not in wrapped)
            own = [p for p in lines if p.strip() and not any(near.similarity(p, f) >= 0.5 for f in TEMPLATES)]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string())], ["paragraph"])


@dataclass
class LicenceModel:
    """Weights (features by classes), biases, temperature; `families` name the classes, the unknown one first."""

    families: list[str]
    features: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    @staticmethod
    def fit(docs: DataFrame, max_paragraphs: int = 4000, max_docs: int = 2000, copies: int = 40, epochs: int = 60, seed: int = 11) -> LicenceModel:
        """Trains on changed copies of the templates against paragraphs of the corpus.

        Of `docs` (doc_id, text), about `max_docs` documents are drawn by a hash of doc_id and text (those without a doc_id by that of their text), and of their paragraphs
        `max_paragraphs` at most, by a hash of them, as examples of the unknown class; those that are near a template are left out. Only these paragraphs go to the driver.
        """
        usable = docs.where("text is not null").select("doc_id", "text")
        share = min(1.0, max_docs / max(1, docs.count()))
        drawn = usable.where(F.xxhash64("doc_id", "text").cast("double") < (2 * share - 1) * float(1 << 63)).select("text")
        own = drawn.mapInArrow(T.trimmed(_examples), "paragraph string").distinct().orderBy(F.xxhash64("paragraph"), "paragraph").limit(max_paragraphs)
        own = [r.paragraph for r in own.collect()]
        rng = np.random.default_rng(seed)
        families = [UNKNOWN, *TEMPLATES]
        texts, y = [], []
        for c, family in enumerate(families[1:], 1):
            for template in TEMPLATES[family]:
                for i in range(copies):
                    words = template.split()
                    if i:
                        words = [w for w in words if rng.random() > 0.04] or words
                        if rng.random() < 0.3:
                            words = [w.upper() for w in words] if rng.random() < 0.3 else [w.lower() for w in words]
                    texts.append(" ".join(words))
                    y.append(c)
        for p in [*own, *list(DISTRACTORS + NEAR_MISSES) * copies]:
            texts.append(p)
            y.append(0)
        # The unknown class must also know the templates' words out of place.
        bag = " ".join(t for ts in TEMPLATES.values() for t in ts).split()
        for _ in range(30 * copies):
            texts.append(" ".join(rng.choice(bag, rng.integers(3, 15))))
            y.append(0)
        return LicenceModel._train(texts, np.array(y), families, epochs, rng)

    @staticmethod
    def _train(texts: list[str], y: np.ndarray, families: list[str], epochs: int, rng) -> LicenceModel:
        order = rng.permutation(len(texts))
        y = y[order]
        row, col, _ = _features(*_chunk([texts[i] for i in order]))
        size = np.maximum(np.bincount(row, minlength=len(y)), 1)
        row, col = _unique(row, col)
        known, col = np.unique(col, return_inverse=True)
        n, c = len(y), len(families)
        held = np.arange(n) % 5 == 0
        value = 1 / np.sqrt(size[row])
        w, b = np.zeros((len(known), c)), np.zeros(c)
        g2, b2 = np.full((len(known), c), 1e-8), np.full(c, 1e-8)
        weight = np.where(held, 0.0, 1.0) / (~held).sum()
        target = np.eye(c)[y]

        def logits():
            return np.stack([np.bincount(row, w[col, k] * value, n) for k in range(c)], 1) + b

        for _ in range(epochs):
            d = (_softmax(logits()) - target) * weight[:, None]
            g = np.stack([np.bincount(col, d[row, k] * value, len(known)) for k in range(c)], 1)
            g2 += g * g
            step = 0.5 / np.sqrt(g2)
            w = w - step * g
            w = np.sign(w) * np.maximum(np.abs(w) - step * 1e-6, 0)
            gb = d.sum(0)
            b2 += gb * gb
            b = b - 0.5 / np.sqrt(b2) * gb
        z = logits()[held]
        loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), y[held]], 1e-12)).mean()
        temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
        on = np.flatnonzero(np.abs(w).sum(1))
        return LicenceModel(families, known[on], w[on], b, float(temperature))

    def scan(self, docs: DataFrame, least_probability: float = 0.6, least_similarity: float = 0.6) -> DataFrame:
        """doc_id, paragraph (from 0), start, end (characters), family, probability, similarity, confirmed: a row per paragraph of `docs` (doc_id, text) that is predicted to be of a family.

        confirmed tells whether the best template of the family has `least_similarity` of its word bigrams in
        the paragraph, which must also hold one of the family's MARKS and none of the words that others have, and not deny the licence. An SPDX expression of several licences
        gives a row for each that is of a family. A paragraph is a line, or a run of lines with a wrapped notice: its number is its first line's, its span that of
        its lines, and probability and similarity are those of the words from the notice's first to its last. Runs count only if
        confirmed; of overlapping notices that are of one family or rest on the same words, the one most like its template
        counts, or else that of fewer lines. Null, blank and clean texts give no rows; repeated rows repeat theirs.
        """
        families, features, weights, bias, temperature = self.families, self.features, self.weights, self.bias, self.temperature

        def run(batches):
            number = np.full(1 << BITS, -1, np.int32)
            number[features] = np.arange(len(features))
            lead = weights[:, 1:].max(1) - weights[:, 0]
            templates = Templates()
            names = ["doc_id", "paragraph", "start", "end", "family", "probability", "similarity", "confirmed"]

            def judged(data, cuts):
                """((paragraph, class, probability) of those predicted to be of a family, words)."""
                row, col, w = _features(data, cuts)
                n = len(cuts) - 1
                size = np.maximum(np.bincount(row, minlength=n), 1)
                hit = np.flatnonzero(number[col] >= 0)
                r, k = _unique(row[hit], col[hit])
                # A family passes only if its logit beats the unknown class's: a bound on the gap tells most lines apart.
                gap = np.bincount(r, lead[number[k]], n) / np.sqrt(size) + (bias[1:].max() - bias[0])
                likely = np.flatnonzero(gap > 0)
                place = np.full(n, -1)
                place[likely] = np.arange(len(likely))
                use = place[r] >= 0
                r, k = r[use], k[use]
                value = 1 / np.sqrt(size[r])
                z = np.stack([np.bincount(place[r], weights[number[k], c] * value, len(likely)) for c in range(len(families))], 1) + bias
                p = _softmax(z / temperature)
                best = p[:, 1:].argmax(1) + 1
                sure = p[np.arange(len(p)), best]
                return [(int(likely[i]), int(best[i]), float(sure[i])) for i in np.flatnonzero(sure >= least_probability).tolist()], w

            for batch in batches:
                for rows, data, offsets in T.chunks(batch):
                    if not len(data):
                        continue
                    cuts, of = _lines(data, offsets)
                    text = lambda a, b: data[a:b].tobytes().decode("utf-8", "replace")
                    found, w = judged(data, cuts)
                    notices = [Notice(i, i, families[c], p, *templates.best(text(cuts[i], cuts[i + 1]), families[c])) for i, c, p in found]
                    # An expression's identifiers are judged one by one.
                    marked = np.unique(np.searchsorted(cuts, [m.start() for m in re.finditer(rb"SPDX-License-Identifier:", data.tobytes())], "right") - 1).tolist()
                    several = [(i, line) for i in marked for line in expression_lines(text(cuts[i], cuts[i + 1]))]
                    if several:
                        apart = {i for i, _ in several}
                        notices = [x for x in notices if x.first not in apart]
                        for i, c, p in judged(*_chunk([line for _, line in several]))[0]:
                            at, line = several[i]
                            notices.append(Notice(at, at, families[c], p, *templates.best(line, families[c])))
                        notices.sort(key=lambda x: x.first)
                    wrapped = []
                    for part in _parts(templates.passages(w, of), w):
                        at = [(w.start[a], w.end[b]) for _, _, a, b in part]
                        ends = np.concatenate([[0], np.cumsum([b - a for a, b in at])])
                        for i, c, p in judged(np.concatenate([data[a:b] for a, b in at]), ends)[0]:
                            wrapped.append(Notice(*part[i][:2], families[c], p, *templates.best(text(*at[i]), families[c])))
                    out = []
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    for x in _settled(notices, [x for x in wrapped if x.alike >= least_similarity], least_similarity):
                        d = int(of[x.first])
                        own = text(cuts[x.first], cuts[x.last + 1]).rstrip("\n")
                        start = int(chars[cuts[x.first]] - chars[offsets[d]])
                        out.append((d, x.first - int(np.searchsorted(cuts, offsets[d])), start, start + len(own), x.family, x.sure, x.alike, x.alike >= least_similarity))
                    if out:
                        cols = list(zip(*out, strict=True))
                        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(cols[0])), *[pa.array(x, t) for x, t in zip(cols[1:], (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]], names)

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(T.trimmed(run), "doc_id long, paragraph int, start int, end int, family string, probability double, similarity double, confirmed boolean")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
    return e / e.sum(1, keepdims=True) if len(z) else z


@dataclass
class Notice:
    """Lines `first` to `last` of a chunk as a notice of a family, and the bigrams that they have of its best template."""

    first: int
    last: int
    family: str
    sure: float
    alike: float
    grams: set[tuple[str, ...]]


def _parts(passages: dict[tuple[int, int], list[tuple[int, int]]], w: T.Words):
    """Lists of (first line, last line, first word, last word), of about CHUNK bytes each at most."""
    part, size = [], 0
    for (first, last), words in passages.items():
        for a, b in words:
            part.append((first, last, a, b))
            size += int(w.end[b] - w.start[a])
            if size >= T.CHUNK:
                yield part
                part, size = [], 0
    if part:
        yield part


def _settled(lines: list[Notice], wrapped: list[Notice], least_similarity: float) -> list[Notice]:
    """Notices in order of place, of which no two that are confirmed overlap and are of one family or one of which rests on words of the other."""
    if not wrapped:
        return lines
    kept = [x for x in lines if x.alike < least_similarity]
    taken: dict[int, list[Notice]] = {}
    for x in sorted([x for x in lines if x.alike >= least_similarity] + wrapped, key=lambda x: (-x.alike, x.last - x.first, -x.sure, x.first)):
        over = [y for i in range(x.first, x.last + 1) for y in taken.get(i, ())]
        if any(x.family == y.family or x.grams <= y.grams for y in over):
            continue
        kept.append(x)
        for i in range(x.first, x.last + 1):
            taken.setdefault(i, []).append(x)
    return sorted(kept, key=lambda x: (x.first, x.last))


class Templates:
    """Word bigrams of the templates."""

    def __init__(self):
        self.grams = {f: [self._grams(t) for t in ts] for f, ts in TEMPLATES.items()}
        self.keys = [np.unique(_pairs(T.Words(*_chunk([t]), between=T.PUNCTUATION).hash)) for ts in TEMPLATES.values() for t in ts]
        self.filter = np.zeros(1 << BITS, bool)
        self.filter[(np.concatenate(self.keys) >> np.uint64(64 - BITS)).astype(np.int64)] = True

    @staticmethod
    def _words(text: str) -> list[str]:
        return "".join(c if c.isalnum() else " " for c in text.lower()).split()

    @staticmethod
    def _grams(text: str) -> set[tuple[str, ...]]:
        words = Templates._words(text)
        return set(zip(words, words[1:], strict=False)) or {tuple(words)}

    def similarity(self, text: str, family: str) -> float:
        """The largest share of a template's bigrams that the text holds."""
        return self.best(text, family)[0]

    def best(self, text: str, family: str) -> tuple[float, set[tuple[str, ...]]]:
        """That share, and the bigrams."""
        own, words = self._grams(text), set(self._words(text))
        some, none = MARKS[family]
        if words.isdisjoint(some) or not words.isdisjoint(none) or DENIED.search(text):
            return 0.0, set()
        most = max(self.grams[family], key=lambda g: len(g & own) / len(g))
        return len(most & own) / len(most), most & own

    def passages(self, w: T.Words, of: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """{(first line, last line): [(first word, last word)]} of passages over lines of one text that hold half of a template's bigrams or more.

        w: words by line; of: text of each line. Of the passages over the same lines, those with most of a template are given, by template.
        """
        line = np.repeat(np.arange(len(of)), np.diff(w.first))
        key = _pairs(w.hash)
        near = np.flatnonzero(self.filter[(key >> np.uint64(64 - BITS)).astype(np.int64)])
        near = near[of[line[near]] == of[line[near + 1]]]
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for keys in self.keys:
            at = near[np.isin(key[near], keys)]
            need, reach = -(-len(keys) // 2), REACH * (len(keys) + 1)
            starts = np.flatnonzero(at[need - 1 :] - at[: max(0, len(at) - need + 1)] <= reach)
            have, own, low, high, text = key[at].tolist(), at.tolist(), line[at].tolist(), line[at + 1].tolist(), of[line[at]].tolist()
            best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
            for i in starts.tolist():
                seen = set()
                for j in range(i, len(own)):
                    if own[j] - own[i] > reach or text[j] != text[i]:
                        break
                    if have[j] in seen:
                        continue
                    seen.add(have[j])
                    if len(seen) >= need and high[j] > low[i]:
                        lines = low[i], high[j]
                        best[lines] = max(best.get(lines, (0, 0, 0, 0)), (len(seen), own[i] - own[j], own[i], own[j] + 1))
            for lines, x in best.items():
                out.setdefault(lines, []).append(x[2:])
        return out
