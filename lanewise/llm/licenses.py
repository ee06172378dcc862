"""Licence scans by a trained paragraph classifier, confirmed against templates.

A sparse multinomial logistic regression over word n-grams (1 and 2 words) names the licence
family of a paragraph or says it is unknown.  It is trained here, on paragraphs made from the
notices below by dropping, repeating and surrounding words, and on unknown paragraphs: shuffled
notice words, everyday sentences that use licence words, and texts without them.  A temperature fitted
on paragraphs kept apart from the training calibrates the probabilities, and the unknown class
takes every paragraph whose best family falls below ``SURE``.  A prediction counts if a template of
that family is found in the paragraph: at least ``CONFIRM`` of the template's word bigrams.

Paragraphs end at blank lines, so the lines of a wrapped notice are judged together.  Only paragraphs that hold one of
``cue_words`` are scored; without any of them no template can be confirmed.

Defined cases: null or empty text has no licence; a paragraph may be of any length; repeated rows are
scanned alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 15
SURE = 0.5
CONFIRM = 0.6
UNKNOWN = "unknown"
SEED = 11

#: Short notices of licence families, as authors write them (fixed values).
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses license 2.0",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    ],
    "gpl-3.0": [
        "licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
    ],
    "gpl-2.0": [
        "licensed under the gnu general public license version 2",
        "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    ],
    "lgpl": ["licensed under the gnu lesser general public license", "redistribute it and or modify it under the terms of the gnu lesser general public license"],
    "agpl-3.0": ["licensed under the gnu affero general public license version 3", "under the terms of the gnu affero general public license"],
    "bsd": [
        "released under the bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0"],
    "cc-by-4.0": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa-4.0": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc-by-nc-4.0": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc0-1.0": ["licensed under cc0 1.0", "to the extent possible under law the author has waived all copyright and related rights to this work"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "isc": ["released under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "proprietary": ["all rights reserved", "no part of this publication may be reproduced without the prior written permission of the publisher"],
}

#: Everyday sentences that use licence words without granting one (fixed values).
ORDINARY = [
    "the driver lost the license last year and had to walk",
    "a fishing license is required in this state",
    "the general public was free to use the software library",
    "the table is reserved for all guests",
    "human rights are reserved for nobody and belong to all",
    "the source of the river is open to the public",
    "version 3 of the report was released under great pressure",
    "apache helicopters were seen near the border",
    "she studied at mit and released a paper",
    "no permission was granted to enter the building",
    "copyright law differs between countries",
    "the conditions are met with or without help",
]

#: Words of the templates that prose is full of, and names that it hardly has: the screen takes the latter first (fixed values).
FREQUENT = frozenset("the of to and or this under is with it in you may not use by for any that no part work source all free are at as an has can a be on v".split())
NAMES = frozenset("apache mit gnu bsd isc mozilla cc cc0 affero lesser license licensed copyright permission hereby unencumbered waived redistribute redistribution".split())

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _hash(token: str) -> int:
    import zlib

    return zlib.crc32(token.encode()) & ((1 << BITS) - 1)


def features(words: list[str]) -> np.ndarray:
    return np.unique([_hash(w) for w in words] + [_hash(a + " " + b) for a, b in zip(words, words[1:], strict=False)]).astype(np.int64)


def _paragraphs(rng) -> tuple[list[list[str]], list[str]]:
    """Training paragraphs and their families."""
    plain = sorted({w for s in ORDINARY for w in words_of(s)})
    legal = sorted({w for ts in TEMPLATES.values() for t in ts for w in words_of(t)})
    out, names = [], []

    def around(words):
        n, m = rng.integers(0, 8, 2)
        pool = plain if rng.random() < 0.7 else ["".join(rng.choice(list("aeinorst"), rng.integers(2, 9))) for _ in range(8)]
        return [*rng.choice(pool, n), *words, *rng.choice(pool, m)]

    for family, templates in TEMPLATES.items():
        for t in templates:
            words = words_of(t)
            for _ in range(40):
                kept = [w for w in words if rng.random() > (0.08 if len(words) > 6 else 0.0)]
                lead = list(rng.choice(["this", "work", "is", "the", "project", "code", "copyright", "2020"], rng.integers(0, 4)))
                out.append(around(lead + kept))
                names.append(family)
    for _ in range(1200):
        kind = rng.random()
        if kind < 0.3:
            words = list(rng.choice(legal, rng.integers(1, 25)))
        elif kind < 0.6:
            words = words_of(ORDINARY[rng.integers(len(ORDINARY))])
        else:
            words = list(rng.choice(plain, rng.integers(1, 30)))
        out.append(around(words))
        names.append(UNKNOWN)
    return out, names


class Model:
    """Weights per family over hashed n-grams, and the calibration temperature."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        texts, names = _paragraphs(rng)
        self.families = [*TEMPLATES, UNKNOWN]
        y = np.array([self.families.index(n) for n in names])
        feats = [features(w) for w in texts]
        apart = rng.random(len(y)) < 0.2
        rows = [f for f, a in zip(feats, apart, strict=True) if not a]
        self.weights, self.bias = self._fit(rows, y[~apart])
        self.temperature = 1.0
        held = [f for f, a in zip(feats, apart, strict=True) if a]
        logits = np.array([self._logits(f) for f in held])
        grid = np.geomspace(0.2, 5, 40)
        loss = [-np.log(self._softmax(logits / t)[np.arange(len(held)), y[apart]] + 1e-12).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        self.bigrams = {f: [set(zip(words_of(t), words_of(t)[1:], strict=False)) for t in ts] for f, ts in TEMPLATES.items()}
        self.often = {f: [Counter(zip(words_of(t), words_of(t)[1:], strict=False)) for t in ts] for f, ts in TEMPLATES.items()}
        self.holders: dict[tuple[str, str], list[tuple[str, int]]] = {}
        for family, sets in self.bigrams.items():
            for k, pairs in enumerate(sets):
                for pair in pairs:
                    self.holders.setdefault(pair, []).append((family, k))

    @staticmethod
    def _softmax(z):
        e = np.exp(z - z.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    def _fit(self, rows, y, steps: int = 200, l2: float = 1e-4):
        n, k = len(rows), len(self.families)
        row = np.repeat(np.arange(n), [len(r) for r in rows])
        names, col = np.unique(np.concatenate(rows), return_inverse=True)
        w, b = np.zeros((len(names), k)), np.zeros(k)
        m = [np.zeros_like(w), np.zeros_like(b)]
        v = [np.zeros_like(w), np.zeros_like(b)]
        target = np.eye(k)[y]
        scale = 1 / np.sqrt(np.bincount(row, minlength=n))
        for t in range(1, steps + 1):
            z = np.zeros((n, k))
            np.add.at(z, row, w[col])
            g = (self._softmax(z * scale[:, None] + b) - target) / n
            gw = np.zeros_like(w)
            np.add.at(gw, col, (g * scale[:, None])[row])
            for i, (x, grad) in enumerate(((w, gw + l2 * w), (b, g.sum(0)))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad**2
                x -= 0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        full = np.zeros((1 << BITS, k))
        full[names] = w
        return full, b

    def _logits(self, feats: np.ndarray) -> np.ndarray:
        return self.weights[feats].sum(0) / np.sqrt(max(len(feats), 1)) + self.bias

    def _occurrences(self, words: list[str]) -> list[tuple[str, int, list[int]]]:
        """(family, template, places of its word bigrams) of every confirmed template: CONFIRM of it within 40 words."""
        places: dict[tuple[str, int], list[tuple[int, tuple[str, str]]]] = {}
        for at, pair in enumerate(zip(words, words[1:], strict=False)):
            for key in self.holders.get(pair, ()):
                places.setdefault(key, []).append((at, pair))
        out = []
        for (family, k), hits in places.items():
            often, least = self.often[family][k], CONFIRM * len(self.bigrams[family][k])
            open_: list[tuple[int, tuple[str, str]]] = []
            for hit in [*hits, None]:
                seen = [pair for _, pair in open_]
                full = len(set(seen)) >= least
                again = hit is not None and seen.count(hit[1]) >= often[hit[1]]
                if full and (hit is None or again or hit[0] - open_[0][0] >= 39):
                    out.append((family, k, [at for at, _ in open_]))
                    open_ = []
                elif again:  # the later one may belong to a notice
                    open_.pop(seen.index(hit[1]))
                if hit is not None:
                    open_ = [x for x in open_ if hit[0] - x[0] < 39] + [hit]
        return out

    @staticmethod
    def _run(group: list[int]) -> set[int]:
        """The words of the longest run of neighbouring bigrams."""
        runs: list[list[int]] = []
        for at in group:
            if runs and runs[-1][-1] == at - 1:
                runs[-1].append(at)
            else:
                runs.append([at])
        best = max(runs, key=len)
        return {*best, best[-1] + 1}

    def notices(self, paragraph: str) -> list[tuple[str, float]]:
        """(family, its probability) of every confirmed notice.

        Notices stand anywhere in a long paragraph, so each is scored in a window of 40 words about it, without the
        words of notices beside it.  Where the longest runs of two notices lie in each other's words, their
        families compete, and the surest stays.  Different templates of a family side by side count once.
        """
        words = words_of(paragraph)
        sure = [(f, k, g, self._run(g), {*g, *(at + 1 for at in g)}) for f, k, g in self._occurrences(words)]
        sure.sort(key=lambda x: x[2][0])
        compete = lambda a, b: a[3] & b[4] and b[3] & a[4]
        scored = []
        for n, one in enumerate(sure):
            # an occurrence spans 40 words at most, so those further off do not reach the window
            near = [x for x in sure[bisect_left(sure, one[2][0] - 80, key=lambda x: x[2][0]) : bisect_right(sure, one[2][-1] + 40, key=lambda x: x[2][0])] if x is not one]
            begin = max(min((one[2][0] + one[2][-1] + 2) // 2 - 20, len(words) - 40), 0)
            others = set().union(*[x[3] for x in near if not compete(x, one)]) - one[3]
            window = [words[at] for at in range(begin, min(begin + 40, len(words))) if at not in others]
            p = self._softmax(self._logits(features(window)) / self.temperature)
            if self.families[int(p.argmax())] == one[0] and p.max() >= SURE:
                scored.append((float(p.max()), n, [x for x in near if x[0] != one[0] and compete(x, one)]))
        kept: dict[int, float] = {}
        lost: set[int] = set()
        for p, n, rivals in sorted(scored, key=lambda x: (-x[0], x[1])):
            if id(sure[n]) not in lost:
                kept[n] = p
                lost.update(map(id, rivals))
        out: dict[str, list[tuple[int, set[int], float]]] = {}
        for n in sorted(kept):
            family, k, group, *_ = sure[n]
            ends = out.setdefault(family, [])
            last, seen, best = ends[-1] if ends else (-1, set(), 0.0)
            if ends and k not in seen and group[0] <= last + 20:
                ends[-1] = (max(last, group[-1] + 1), seen | {k}, max(best, kept[n]))
            else:
                ends.append((group[-1] + 1, {k}, kept[n]))
        return [(family, p) for family, ends in out.items() for _, _, p in ends]

    def classify(self, paragraph: str) -> tuple[str, float, bool]:
        """(family, its probability, whether a template of the family confirms it) of the surest notice."""
        best = max(self.notices(paragraph), key=lambda x: x[1], default=None)
        return (UNKNOWN, 1.0, False) if best is None else (*best, True)


def cue_words() -> set[str]:
    """Words of which every paragraph holds one that can confirm a template.

    Of each template so many words are taken that the bigrams without them are fewer than ``CONFIRM`` of it: a notice may lose
    some of these words and not all.
    """
    out: set[str] = set()
    for ts in TEMPLATES.values():
        for t in ts:
            words = words_of(t)
            left = set(zip(words, words[1:], strict=False))
            least = CONFIRM * len(left)
            left = {pair for pair in left if not out & set(pair)}
            while len(left) >= least:
                count = Counter(w for pair in left for w in set(pair))
                # rare words in prose are long; "k" also comes from a sign that lower() maps to it, and so is left out
                fit = {w: c for w, c in count.items() if w not in FREQUENT and w.isalnum() and not w.isdigit() and "k" not in w}
                word = max(fit, key=lambda w: (w in NAMES, fit[w], len(w), w))
                out.add(word)
                left = {pair for pair in left if word not in pair}
    return out


def cues() -> str:
    """A pattern that finds one of ``cue_words``; words are told apart as in ``words_of``."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(cue_words()):
        by_first.setdefault(w[0], []).append(w[1:])
    return "(?i)(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + ")(?![a-z0-9])"


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, families (sorted), n_notices, confidence (least of the notices'): one row per input row."""
    model = docs.sparkSession.sparkContext.broadcast(Model())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            families, count, least = [], [], []
            for parts in batch.column("paragraphs").to_pylist():
                found = [f for p in parts or () for f in model.value.notices(p)]
                families.append(sorted({f[0] for f in found}))
                count.append(len(found))
                least.append(min((f[1] for f in found), default=None))
            arrays = [pa.array(families, pa.list_(pa.string())), pa.array(count, pa.int64()), pa.array(least, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "families", "n_notices", "confidence"])

    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"\n[ \t\r]*\n"), lambda p: p.rlike(cues()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").rlike(cues()), parts).alias("paragraphs"))
    return rows.mapInArrow(run, "doc_id long, families array<string>, n_notices long, confidence double")
