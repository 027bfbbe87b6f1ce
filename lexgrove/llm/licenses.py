"""Licence scans: a trained classifier of paragraphs names licence families; templates confirm what it names."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
# The public names of licences, and the usual sentences that grant them.
NAMES = {
    "apache": ["the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "the Apache Software License"],
    "mit": ["the MIT License", "MIT License", "the MIT licence", "the Expat (MIT) license"],
    "bsd": ["the BSD 3-Clause License", "the BSD 2-Clause License", "a BSD-style license", "the New BSD License"],
    "gpl": ["the GNU General Public License, version 3", "the GNU General Public License, version 2", "GNU GPL v3", "GPL-3.0-or-later", "the GNU GPL version 2"],
    "lgpl": ["the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-2.1"],
    "agpl": ["the GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"],
    "mpl": ["the Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0", "the Creative Commons Attribution 4.0 International License", "a Creative Commons Attribution license"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0": ["CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication", "the public domain", "the Unlicense"],
}
GRANTS = [
    "Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This file is distributed under the terms of {}.",
    "Distributed under {}; see the file LICENSE.", "You may redistribute it and/or modify it under the terms of {}.", "This content is made available under {}.",
    "SPDX-License-Identifier: {}", "Use of this source code is governed by {} that can be found in the LICENSE file.", "Code in this repository is provided under {}.",
    "The text is available under {}; additional terms may apply.", "Published under {}.",
]
WHOLE = {
    "all-rights-reserved": ["All rights reserved.", "Copyright. All rights reserved.", "Copyright 2021 Example Corporation. All rights reserved.", "(c) 2019 The Authors, all rights reserved."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "apache": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights; this work is dedicated to the public domain.", "This is free and unencumbered software released into the public domain."],
}
# The public names of licences of other families, whose notices belong to the unknown class. Each second one is only calibrated on.
OTHERS = [
    "the Eclipse Public License 2.0", "the Boost Software License 1.0", "the ISC License", "the zlib License", "the Artistic License 2.0", "the European Union Public Licence, version 1.2",
    "the Common Development and Distribution License, version 1.1", "the Python Software Foundation License, version 2", "the SIL Open Font License, version 1.1", "the Microsoft Public License",
    "the Academic Free License 3.0", "the PostgreSQL License", "the Open Software License, version 3.0", "the Q Public License 1.0", "the Common Public License 1.0", "the IBM Public License, version 1.0",
    "the PHP License, version 3.01", "the Ruby License", "the Vim License", "the University of Illinois Open Source License", "the Open Data Commons Database License 1.0", "the Reciprocal Public License 1.5",
    "a commercial license", "a proprietary license", "the terms of the agreement", "the site licence", "the Unicode License, version 3", "the OpenSSL License",
]
# The sentences that grant some of these, which share much with those of other families. They belong to the unknown class.
OTHER_GRANTS = [
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted.",
]
#: Words of names that say nothing of a family, besides those of frames, of other licences and of common text.
VAGUE = "international universal new style clause later version attribution dedication unported text texts".split()
#: Words that other text has as well, for paragraphs of the unknown class.
COMMON = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has"
    " when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me"
    " even most made after also did many off before must well back through years where much your way down should because long each just state those people too right public"
    " free general version terms use copy permission license licence granted work made available rights reserved source code file software under released driver plate marriage"
).split()

#: Words of a run of lines that is looked at as one notice, as a multiple of the longest template's.
WRAP_TIMES = 1.5
#: Templates of so many n-grams are grants written out.
GRANT_GRAMS = 50

_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Training:
    """copies: noisy copies of each template sentence. share: unknown paragraphs for each licence paragraph. false: share of
    unknown paragraphs that the calibrated threshold may let through. least: similarity to a template that confirms. held: frames and names
    of this many at the end of each list are kept for the calibration, after which the model learns from all."""

    copies: int = 4
    share: float = 3.0
    epochs: int = 120
    rate: float = 4.0
    l2: float = 1e-5
    false: float = 0.0005
    least: float = 0.5
    held: int = 3
    seed: int = 5


def templates() -> dict[str, list[str]]:
    out = {f: [g.format(n) for n in names for g in GRANTS] for f, names in NAMES.items()}
    for f, texts in WHOLE.items():
        out.setdefault(f, []).extend(texts * (8 if f == "all-rights-reserved" else 3))
    return out


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _grams(words: list[str]) -> list[str]:
    return [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)), *(f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:], strict=False))]


class Model:
    """Softmax regression over the word 1- to 3-grams of templates; other grams have no weight but count in the length."""

    def __init__(self, how: Training = Training()):
        self.how = how
        self.families = [*sorted(templates()), UNKNOWN]
        known = {w for ts in templates().values() for t in ts for w in _grams(_words(t))} | {w for n in [*OTHERS, *OTHER_GRANTS] for w in _grams(_words(n))}
        self.vocabulary = {g: k for k, g in enumerate(sorted(known))}
        self._code()
        frames = len(GRANTS) - how.held
        learned = {f: [g.format(n) for n in names[: max(2, len(names) - 1)] for g in GRANTS[:frames]] for f, names in NAMES.items()}
        unseen = {f: [g.format(n) for k, n in enumerate(names) for g in (GRANTS if k >= max(2, len(names) - 1) else GRANTS[frames:])] for f, names in NAMES.items()}
        whole = {f: learned.get(f, []) + WHOLE.get(f, []) * (8 if f == "all-rights-reserved" else 3) for f in self.families[:-1]}
        self.weights = self._fit(self._samples(whole, [g.format(n) for n in OTHERS[::2] for g in GRANTS[:frames]] + OTHER_GRANTS * 3, how.seed))
        self._calibrate(self._samples(unseen, [g.format(n) for n in OTHERS[1::2] for g in GRANTS], how.seed + 1))
        self.weights = self._fit(self._samples(templates(), [g.format(n) for n in OTHERS for g in GRANTS] + OTHER_GRANTS * 3, how.seed + 2))
        ids = lambda t: np.array(sorted({self.vocabulary[g] for g in _grams(_words(t))}))
        self.width = np.zeros(len(self.vocabulary), np.int64)
        for g, k in self.vocabulary.items():
            self.width[k] = g.count(" ") + 1
        self.shapes = {f: _Sets([ids(t) for t in sorted(set(ts))], len(self.vocabulary)) for f, ts in templates().items()}
        self.whole = {f: _Sets([ids(t) for t in ts], len(self.vocabulary)) for f, ts in WHOLE.items()}
        self.grants = {f: _Sets([x for t in ts if len(x := ids(t)) >= GRANT_GRAMS], len(self.vocabulary)) for f, ts in WHOLE.items()}
        vague = {w for t in [*GRANTS, *OTHERS] for w in _words(t)} | set(COMMON) | set(VAGUE)
        telling = lambda n: " ".join(x for x in _words(n) if x not in vague and not x.isdigit())
        self.names = {f: _Sets([ids(n) for n in names], len(self.vocabulary)) for f, names in NAMES.items()}
        self.own = {f: _Sets([np.array([self.vocabulary[w] for w in telling(n).split()], np.int64) for n in names], len(self.vocabulary)) for f, names in NAMES.items()}
        self.shortest = min(x.sizes.min() for x in self.shapes.values())
        self.longest = int(WRAP_TIMES * max(len(_words(t)) for ts in templates().values() for t in ts))
        # features that a name has to itself; features of grants with a word that common text lacks, and the least of these that half a grant has
        self.tells = np.zeros(len(self.vocabulary), bool)
        for x in self.own.values():
            self.tells |= x.rows.any(axis=0)
        rare = np.zeros(len(self.vocabulary), bool)
        for g, k in self.vocabulary.items():
            rare[k] = any(w not in COMMON for w in g.split())
        rows = np.concatenate([x.rows for x in self.grants.values() if len(x.sizes)])
        self.granting = rows.any(axis=0) & rare
        self.least_granting = max(1, int((np.ceil(how.least * rows.sum(axis=1)) - (rows & ~rare).sum(axis=1)).min()))

    def _samples(self, known: dict[str, list[str]], others: list[str], seed: int) -> list[tuple[list[str], int]]:
        """Noisy copies of licence sentences, and paragraphs of the unknown class: notices of other licences, common words, nonsense, a template's words in another order."""
        how, rnd, unknown = self.how, random.Random(seed), len(self.families) - 1
        nonsense = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9)))
        pool = [w for ts in templates().values() for t in ts for w in _words(t)]
        samples: list[tuple[list[str], int]] = []
        for k, texts in [*((self.families.index(f), ts) for f, ts in known.items()), (unknown, others)]:
            for t in texts:
                for _ in range(how.copies):
                    w = _words(t)
                    if len(w) > 6 and rnd.random() < 0.3:
                        del w[rnd.randrange(len(w))]
                    noise = [nonsense() if rnd.random() < 0.7 else rnd.choice(COMMON) for _ in range(rnd.choice([0, 0, 0, 1, 2, 4, 8]))]
                    cut = rnd.randint(0, len(noise))
                    samples.append((noise[:cut] + w + noise[cut:], k))
        for _ in range(int(how.share * len(samples))):
            kind, n = rnd.random(), rnd.choice([1, 2, 3, 5, 8, 12, 20, 40])
            if kind < 0.1:
                w = [rnd.choice(COMMON)] * n
            elif kind < 0.4:
                w = [rnd.choice(COMMON) for _ in range(n)]
            elif kind < 0.7:
                w = [nonsense() if rnd.random() < 0.6 else rnd.choice(COMMON) for _ in range(n)]
            else:  # a template's words, but not its sentence
                w = [rnd.choice(pool) if rnd.random() < 0.3 else rnd.choice(COMMON) for _ in range(n)]
            samples.append((w, unknown))
        rnd.shuffle(samples)
        return samples

    def confirms(self, family: str, seen: np.ndarray) -> tuple[float, bool]:
        """(similarity, whether it confirms) of a paragraph's features to the family's templates: a whole sentence of it, or a frame and the family's own name.

        A name must be there by its own words (those that frames, common text and other licences lack), all of them, and by most of its grams, and no
        other family's name may be there more fully.
        """
        similarity = self.shapes[family].share(seen).max()
        if family in self.whole and (self.whole[family].share(seen) >= self.how.least).any():
            return float(similarity), bool(similarity >= self.how.least)

        def named(f: str) -> tuple[float, int]:
            full = np.where((self.own[f].sizes > 0) & (self.own[f].share(seen) == 1), self.names[f].share(seen), 0.0)
            return max(zip(full.tolist(), self.names[f].sizes.tolist(), strict=True))

        mine = named(family) if family in self.names else (0.0, 0)
        return float(similarity), bool(similarity >= self.how.least and mine[0] >= 0.6 and mine >= max(map(named, self.names)))

    def _code(self) -> None:
        """Words by number, and 2- and 3-grams by the numbers of their words."""
        self.word = {}
        for g in self.vocabulary:
            for w in g.split():
                self.word.setdefault(w, len(self.word))
        base = np.int64(len(self.word) + 1)
        codes = {}
        for g, k in self.vocabulary.items():
            code = 0
            for w in g.split():
                code = code * int(base) + self.word[w] + 1
            codes[code] = k
        self.base, self.codes = base, np.array(sorted(codes), np.int64)
        self.at = np.array([codes[c] for c in self.codes.tolist()], np.int64)

    def features(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words (0: not in a template) -> (features, places of their first words) of all known grams."""
        n = numbers
        once = n > 0  # a word said again and again counts once
        once[1:] &= n[1:] != n[:-1]
        places, codes = [np.flatnonzero(once)], [n[once]]
        two = np.flatnonzero((n[:-1] > 0) & (n[1:] > 0))
        code = n[two] * self.base + n[two + 1]
        places.append(two)
        codes.append(code)
        three = two[:-1][np.diff(two) == 1] if len(two) else two
        places.append(three)
        codes.append((n[three] * self.base + n[three + 1]) * self.base + n[three + 2])
        place, code = np.concatenate(places), np.concatenate(codes)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        ok = self.codes[at] == code
        return self.at[at[ok]], place[ok]

    def numbers(self, words: list[str]) -> np.ndarray:
        get = self.word.get
        return np.array([get(w, -1) for w in words], np.int64) + 1

    def _matrix(self, samples) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(samples), len(self.vocabulary)), np.float32)
        for r, (w, _) in enumerate(samples):
            f, _ = self.features(self.numbers(w))
            np.add.at(x[r], f, 1 / np.sqrt(len(w)))
        return x, np.array([k for _, k in samples])

    def _fit(self, samples) -> np.ndarray:
        x, y = self._matrix(samples)
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        target = np.eye(len(self.families), dtype=np.float32)[y]
        w, speed, how = np.zeros((x.shape[1], len(self.families)), np.float32), 0.0, self.how
        for _ in range(how.epochs):
            z = x @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            speed = 0.9 * speed - how.rate * (x.T @ (p - target) / len(x) + how.l2 * w)
            w = w + speed
        return w.astype(np.float64)

    def _calibrate(self, held) -> None:
        """A temperature by likelihood on held-out samples, then the least probability that keeps the unknown ones out."""
        x, y = self._matrix(held)
        z = x.astype(np.float64) @ self.weights[:-1] + self.weights[-1]
        loss = {t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)}
        self.temperature = min(loss, key=loss.get)
        p = _softmax(z / self.temperature)
        wrong = np.sort(p[y == len(self.families) - 1, :-1].max(axis=1))
        self.threshold = max(0.5, float(wrong[min(len(wrong) - 1, int((1 - self.how.false) * len(wrong)))]))

    def paragraphs(self, text: str | None) -> tuple[int, list[tuple[int, str, float, float, bool]]]:
        """Paragraphs of a text (lines with a word), and (number, family, probability, similarity, confirmed) of those named.

        A notice that is wrapped over lines, none of which confirms it, is named at its first line if a template confirms the lines together.
        """
        words, ends, lines, block, blocks = [], [0], 0, 0, []
        for line in (text or "").split("\n"):
            found = _words(line)
            if found:
                words += found
                ends.append(len(words))
                lines += 1
                blocks.append(block)
            else:
                block += 1
        if not words:
            return 0, []
        ends = np.array(ends)
        feature, place = self.features(self.numbers(words))
        order = np.argsort(place, kind="stable")
        feature, place = feature[order], place[order]
        total = np.concatenate([np.zeros((1, len(self.families))), np.cumsum(self.weights[feature], axis=0)])
        cut = np.searchsorted(place, ends)

        def seen(a: int, e: int) -> np.ndarray:
            """Features of lines a to e - 1."""
            own, at = feature[cut[a] : cut[e]], place[cut[a] : cut[e]]
            return np.unique(own[at + self.width[own] <= ends[e]])

        z = (total[cut[1:]] - total[cut[:-1]]) / np.sqrt(np.diff(ends))[:, None] + self.weights[-1]
        p = _softmax(z / self.temperature)
        best = p.argmax(axis=1)
        named = np.flatnonzero((best < len(self.families) - 1) & (p.max(axis=1) >= self.threshold))
        out = []
        for k in named.tolist():
            family = self.families[best[k]]
            out.append((k, family, float(p[k, best[k]]), *self.confirms(family, seen(k, k + 1))))
        tells, granting = (np.concatenate([[0], np.cumsum(x[feature])]) for x in (self.tells, self.granting))
        if not tells[-1] and granting[-1] < self.least_granting:
            return lines, out
        return lines, sorted(out + self._wrapped(ends, total, cut, np.array(blocks), seen, tells[cut], granting[cut], {(k, f) for k, f, *_, ok in out if ok}))

    def _wrapped(self, ends, total, cut, blocks, seen, tells, granting, confirmed) -> list[tuple[int, str, float, float, bool]]:
        """What templates confirm of runs of lines without an empty one between them, up to 1.5 times the longest template in words, if the model is sure of their family; no two runs of a family share a line.

        A whole grant in one line is looked at here as well.
        """
        found, n = [], 0
        while n < len(blocks):
            n += 1
            short = ends[n:] - ends[:-n] <= self.longest
            if n > 1 and not short.any():
                break
            # a word of a name and enough known grams for the shortest template, or enough of a grant
            whole = granting[n:] - granting[:-n] >= self.least_granting
            some = whole | (n > 1) & (tells[n:] > tells[:-n]) & (cut[n:] - cut[:-n] >= self.how.least * self.shortest)
            at = np.flatnonzero((short | (n == 1)) & (blocks[n - 1 :] == blocks[: len(blocks) - n + 1]) & some)
            if not len(at):
                continue
            z = (total[cut[at + n]] - total[cut[at]]) / np.sqrt(ends[at + n] - ends[at])[:, None] + self.weights[-1]
            p = _softmax(z / self.temperature)
            best = p.argmax(axis=1)
            for k in np.flatnonzero((best < len(self.families) - 1) & (p.max(axis=1) >= self.threshold)).tolist():
                family, first = self.families[best[k]], int(at[k])
                if any((i, family) in confirmed for i in range(first, first + n)):
                    continue
                own = seen(first, first + n)
                similarity = self.grants[family].share(own).max(initial=0.0) if family in self.grants else 0.0
                ok = similarity >= self.how.least
                if not ok and n > 1:
                    similarity, ok = self.confirms(family, own)
                if ok:
                    found.append((-float(similarity), n, first, family, float(p[k, best[k]])))
        out, taken = [], set()
        for similarity, n, first, family, probability in sorted(found):
            own = {(i, family) for i in range(first, first + n)}
            if not own & taken:
                taken |= own
                out.append((first, family, probability, -similarity, True))
        return out


class _Sets:
    """Sets of features: rows has one for each, sizes how many it has."""

    def __init__(self, sets: list[np.ndarray], width: int):
        self.rows = np.zeros((len(sets), width), bool)
        for row, x in zip(self.rows, sets, strict=True):
            row[x] = True
        self.sizes = self.rows.sum(axis=1)

    def share(self, seen: np.ndarray) -> np.ndarray:
        """Of each set the share that is seen."""
        return self.rows[:, seen].sum(axis=1) / np.maximum(self.sizes, 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@cache
def model(how: Training = Training()) -> Model:
    return Model(how)


_OUT = "doc_id long, n_paragraphs long, licences array<struct<paragraph:int,family:string,probability:double,similarity:double,confirmed:boolean>>"


def _scan(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    m = sent.value
    kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]))
    names = ["paragraph", "family", "probability", "similarity", "confirmed"]
    for b in batches:
        found = [m.paragraphs(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([[dict(zip(names, r, strict=True)) for r in rows] for _, rows in found], kind)], ["doc_id", "n_paragraphs", "licences"])


def scan(docs: DataFrame, how: Training = Training()) -> DataFrame:
    """documents -> (doc_id, n_paragraphs, licences), a row for each row; licences: the paragraphs that are named, in order.

    The model is trained on templates alone, so its size is fixed, and it is broadcast. A paragraph is a line with a word. A
    prediction below the calibrated probability is unknown and not named. A template of the family of which the paragraph has at least half of the
    word n-grams confirms it if it has the family's own name as well, or if the template is a sentence of the licence. Lines without an empty one between them are matched together as well. Null and empty texts: no paragraphs.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model(how))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _scan(it, sent), _OUT)
