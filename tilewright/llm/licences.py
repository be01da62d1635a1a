"""Licence scan: a trained paragraph classifier on word n-grams, an unknown class, and templates that confirm what it says.

A paragraph ends at a blank line or the text's end.  It is read in overlapping windows of words across its line ends, so a statement
may be wrapped, stand in the middle of a long paragraph or next to another one.  The words of a window (punctuation left out, A-Z
lower-cased), word pairs and triples are hashed into a fixed number of columns; a logistic regression with one class for
each family and one for unknown scores it.  The odds of a family against unknown that count are set on held-out windows.  A family
counts only if one of its templates is contained in the window to a fixed share, so a chance likeness of single words is not
enough; what the template matches is the statement.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tilewright.llm.stages import over_batches
from tilewright.llm.words import chunks, mix, word_hashes, word_spans

COLUMNS = 1 << 12
BACKGROUND = 4000     # paragraphs of the corpus taken as examples of none, those of least hash
FALSE_ALARMS = 0.001  # share of held-out background that may pass
CONTAINED = 0.6       # share of a template's word n-grams that the window has to hold
WIDTHS = (4, 8, 16, 32)  # words of the windows, each a quarter of its width after the one before: a statement fills a good part of one
EXAMPLE = 16          # words of an example taken from the corpus
_STRIP = np.arange(256, dtype=np.uint8)
_STRIP[list(b".,;:()[]{}\"'!?*#<>|_`")] = 0x20
_STRIP[[0x0A, 0x0D]] = [0x20, 0x20]

#: Family and phrasing of licence statements; {v} is a version, {y} a year, {w} a holder.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"), ("apache", "you may not use this file except in compliance with the Apache License"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"), ("apache", "Released under the Apache 2.0 license"), ("apache", "Distributed under the Apache License"),
    ("mit", "Released under the MIT License"), ("mit", "Licensed under the MIT license"), ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), ("mit", "This project is available under the MIT License"),
    ("gpl", "This work is licensed under the GNU General Public License, version {v}"), ("gpl", "SPDX-License-Identifier: GPL-{v}.0-or-later"),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation"), ("gpl", "Released under the GPL version {v}"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version {v}"), ("lgpl", "SPDX-License-Identifier: LGPL-{v}.1-only"),
    ("agpl", "Licensed under the GNU Affero General Public License, version {v}"), ("agpl", "SPDX-License-Identifier: AGPL-{v}.0"),
    ("bsd", "Released under the BSD {v}-Clause License"), ("bsd", "SPDX-License-Identifier: BSD-{v}-Clause"), ("bsd", "Use of this source code is governed by a BSD-style license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"), ("mpl", "Licensed under the Mozilla Public License, version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC {v}.0"), ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial {v}.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA {v}.0"), ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike {v}.0 International License"),
    ("cc-by", "Licensed under CC BY {v}.0"), ("cc-by", "This work is licensed under a Creative Commons Attribution {v}.0 International License"),
    ("cc0", "Released under CC0 1.0 Universal"), ("cc0", "To the extent possible under law the author has waived all copyright and related rights to this work"),
    ("cc0", "This work is dedicated to the public domain"),
    ("reserved", "All rights reserved"), ("reserved", "Copyright {y} {w}. All rights reserved."), ("reserved", "No part of this publication may be reproduced without written permission"),
)
#: Sentences that share words with licences and are none.
OTHERS = (
    "the driver lost the license after the third accident", "the public library is open to all readers", "a general who fought in the war returned home",
    "the university released a new version of the report", "students may use the software in the computer room", "all rooms are reserved until the end of the year",
    "the rights of children are protected by law", "he was permitted to use a copy of the book", "a license to fish is needed in this river", "free software is a matter of taste here",
    "the terms of the contract were published by the foundation", "creative people work in common rooms", "the helicopter apache flew over the valley", "the institute in massachusetts is known as mit",
    "the version under review was not the first", "work is the source of wealth", "permission to land was granted to the pilot", "the source of the river lies in the mountains",
)
FAMILIES = tuple(dict.fromkeys(f for f, _ in TEMPLATES))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, pairs and triples of each text, end to end, and n + 1 offsets."""
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return _grams(_STRIP[np.frombuffer(b"".join(raw), np.uint8)], at)


def _grams(data, at):
    starts, ends, first = word_spans(data, at)
    h = word_hashes(data, starts, ends)
    own = np.searchsorted(first, np.arange(len(h)), "right") - 1
    parts, who = [h], [own]
    for k, m in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > k:
            ok = own[k:] == own[:-k]
            x = parts[-1][:len(h) - k] if k == 1 else pairs[:len(h) - k]
            y = mix(x * np.uint64(m) + h[k:])
            if k == 1:
                pairs = y
            parts.append(y[ok])
            who.append(own[k:][ok])
    own = np.concatenate(who)
    order = np.argsort(own, kind="stable")
    return np.concatenate(parts)[order], np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(at) - 1))]).astype(np.int64)


def _examples(seed: int) -> tuple[list[str], list[int]]:
    """Statements made from the templates: filled in, embedded in other words, cut at the end, and in other letter cases."""
    rng = np.random.default_rng(seed)
    texts, kinds = [], []
    filler = " ".join(OTHERS).split()
    for family, template in TEMPLATES:
        for k in range(12):
            t = template.replace("{v}", str(rng.integers(1, 5))).replace("{y}", str(rng.integers(1980, 2030))).replace("{w}", str(rng.choice(filler)))
            words = t.split()
            if k % 3 == 1:
                words = [*rng.choice(filler, rng.integers(1, 6)), *words, *rng.choice(filler, rng.integers(0, 8))]
            t = " ".join(words)
            texts.append(t.upper() if k % 6 == 5 else t)
            kinds.append(FAMILIES.index(family) + 1)
    for other in OTHERS:
        for _ in range(8):
            words = other.split()
            texts.append(" ".join([*words, *rng.choice(filler, rng.integers(0, 12))]))
            kinds.append(0)
    return texts, kinds


def trained(background: list[str], rounds: int = 150, seed: int = 11) -> dict:
    """Weights and, for each family, the probability it needs, from templates and background paragraphs."""
    near = _template_share([t for t in background], None).max(axis=1) >= CONTAINED if background else np.zeros(0, bool)
    others = [t for t, n in zip(background, near) if not n]
    texts, kinds = _examples(seed)
    texts, kinds = texts + others, np.array(kinds + [0] * len(others))
    h, cut = grams(texts)
    column = (h % np.uint64(COLUMNS)).astype(np.int64)
    n = np.maximum(np.diff(cut), 1)
    who = np.repeat(np.arange(len(texts)), np.diff(cut))
    share = (1 / np.sqrt(n))[who].astype(np.float32)
    test = np.arange(len(texts)) % 4 == 3
    weights = np.zeros((COLUMNS, len(FAMILIES) + 1), np.float32)
    some = np.diff(cut) > 0
    target = np.eye(len(FAMILIES) + 1, dtype=np.float32)[kinds]
    balance = (1 / np.maximum(np.bincount(kinds[~test], minlength=len(FAMILIES) + 1), 1) ** 0.5)[kinds] * ~test * some
    balance = (balance / balance.sum()).astype(np.float32)
    square = np.zeros_like(weights)

    def probabilities():
        z = np.zeros((len(texts), weights.shape[1]), np.float32)
        z[some] = np.add.reduceat(weights[column] * share[:, None], cut[:-1][some], axis=0)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    order = np.argsort(column, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], np.diff(column[order]) > 0]))
    for _ in range(rounds):
        error = (probabilities() - target) * balance[:, None]
        g = np.zeros_like(weights)
        g[column[order][heads]] = np.add.reduceat((error[who] * share[:, None])[order], heads, axis=0)
        g += 1e-6 * weights
        square += g * g
        weights -= 0.5 * g / (np.sqrt(square) + 1e-6)
    p = probabilities()
    none = p[test & (kinds == 0)]
    odds = none[:, 1:] / (none[:, 1:] + none[:, :1])
    needs = np.maximum(0.5, np.quantile(odds, 1 - FALSE_ALARMS, axis=0)) if len(none) else np.full(len(FAMILIES), 0.5)
    return {"weights": weights, "needs": needs.astype(np.float32)}


def _template_pairs():
    texts = [re.sub(r"\{[vyw]\}", " ", t) for _, t in TEMPLATES]
    h, cut = grams(texts)
    return [np.unique(h[a:b]) for a, b in zip(cut, cut[1:])]


_PAIRS = _template_pairs()
_LENGTHS = [len(re.sub(r"\{[vyw]\}", " ", t).split()) for _, t in TEMPLATES]


def _template_share(texts: list[str], families) -> np.ndarray:
    """For each text and template, the share of the template's n-grams that the text holds; of one family if given."""
    h, cut = grams(texts)
    out = np.zeros((len(texts), len(TEMPLATES)))
    for i in range(len(texts)):
        own = np.unique(h[cut[i]:cut[i + 1]])
        for j, (family, _) in enumerate(TEMPLATES):
            if families is None or families[i] == family:
                out[i, j] = np.isin(_PAIRS[j], own, assume_unique=True).mean()
    return out


def _telling():
    """Sorted n-grams by which a window that could hold a template shows itself.

    Of the n-grams of a template of t words, t are words, so a share of CONTAINED takes two pairs or triples of it where t is 4 or more, one
    pair where t is 3, and a word where t is 2 or less.
    """
    long, short, words = [], [], []
    for (_, template), length in zip(TEMPLATES, _LENGTHS):
        h, _ = grams([re.sub(r"\{[vyw]\}", " ", template)])
        n = (len(h) + 3) // 3 if len(h) > 1 else 1  # n words give 3 n - 3 n-grams
        (long if n >= 4 else short if n == 3 else words).append(h[n:] if n >= 3 else h[:n])
    return [np.unique(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in (long, short, words)]


def _among(h: np.ndarray, names: np.ndarray) -> np.ndarray:
    return names[np.minimum(np.searchsorted(names, h), len(names) - 1)] == h if len(names) else np.zeros(len(h), bool)


_LONG, _SHORT, _SINGLE = _telling()


class _Words:
    """Words of a chunk with the n-grams that begin at each of them inside its paragraph."""

    def __init__(self, data, at):
        self.starts, self.ends, self.first = word_spans(_STRIP[data], at)
        n = len(self.starts)
        h = word_hashes(_STRIP[data], self.starts, self.ends)
        self.owner = np.searchsorted(self.first, np.arange(n), "right") - 1
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        self.line = lines[self.starts] - lines[at[self.owner]]
        fresh = np.ones(n, bool)
        fresh[1:] = (self.owner[1:] != self.owner[:-1]) | (np.diff(self.line) > 1)
        heads = np.flatnonzero(fresh)
        self.head = heads[np.cumsum(fresh) - 1]
        self.tail = np.append(heads[1:], n)[np.cumsum(fresh) - 1]
        pairs, triples = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        pairs[:-1] = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
        triples[:-2] = mix(pairs[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:])
        self.grams = [h, pairs, triples]

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and end of the windows of all paragraphs; one begins only where the one before leaves words over."""
        at, step = np.arange(len(self.starts)), width // 4
        place, left = at - self.head, self.tail - at
        lo = at[(place % step == 0) & ((place == 0) | (left > width - step))]
        return lo, np.minimum(lo + width, self.tail[lo])

    def hopeful(self) -> np.ndarray:
        """Running sums of telling n-grams: a window needs two of them to hold a template."""
        word, pair, triple = self.grams
        n = 2 * (_among(word, _SINGLE).astype(np.int32) + _among(pair, _SHORT) + _among(triple, _SHORT)) + _among(pair, _LONG) + _among(triple, _LONG)
        return np.concatenate([[0], np.cumsum(n)])

    def logits(self, lo, hi, weights) -> np.ndarray:
        """Sums of the columns' weights over each window's n-grams, divided by the root of their number; only words of windows are summed."""
        n = len(self.starts)
        cover = np.cumsum(np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1))[:n] > 0
        start, total, count = (np.cumsum(cover) - 1)[lo], 0.0, 0
        for k, h in enumerate(self.grams):
            column = (h[cover] & np.uint64(len(weights) - 1)).astype(np.int64)
            sums = np.concatenate([np.zeros((1, weights.shape[1])), np.cumsum(weights[column], axis=0, dtype=np.float64)])
            size = np.maximum(hi - lo - k, 0)
            total, count = total + sums[start + size] - sums[start], count + size
        return total / np.sqrt(count)[:, None]

    def statement(self, lo: int, hi: int, family: str) -> tuple[float, int, int]:
        """Greatest share of a template of the family whose n-grams the window holds, and the words that it matches there."""
        inside = [h[lo:max(hi - k, lo)] for k, h in enumerate(self.grams)]
        own, best = np.unique(np.concatenate(inside)), (0.0, lo, lo)
        for j, (kind, _) in enumerate(TEMPLATES):
            if kind != family or (share := np.isin(_PAIRS[j], own, assume_unique=True).mean()) <= best[0]:
                continue
            hits = sum(np.pad(np.isin(h, _PAIRS[j]).astype(int), (0, hi - lo - len(h))) for h in inside)
            runs = np.convolve(hits, np.ones(_LENGTHS[j], int))[_LENGTHS[j] - 1:]  # matches in so many words from each on
            start = int(np.argmax(runs * (hits > 0)))
            last = int(np.flatnonzero(hits[start:start + _LENGTHS[j]])[-1])
            best = (float(share), lo + start, lo + start + last + 1)
        return best


def _apart(found: list[tuple]) -> list[tuple]:
    """Statements (first word, end, share, odds, family) of one chunk without those that overlap a better one by half of the shorter."""
    kept: list[tuple] = []
    for s in sorted(found, key=lambda s: (-s[2], -s[3], s[0], s[4])):
        if not any(min(s[1], t[1]) - max(s[0], t[0]) > 0.5 * min(s[1] - s[0], t[1] - t[0]) for t in kept if t[0] < s[1] and s[0] < t[1]):
            kept.append(s)
    return sorted(kept)


def _by_place(found: list[tuple]) -> list[list[tuple]]:
    """Statements in groups of which none overlaps one of another group."""
    groups, end = [], -1
    for s in sorted(found):
        if s[0] >= end:
            groups.append([])
        groups[-1].append(s)
        end = max(end, s[1])
    return groups


def _background(docs: DataFrame, wanted: int) -> list[str]:
    """At most EXAMPLE words of each of the `wanted` lines of least hash.

    The number of lines gives a hash that about four times as many stay below, so a task sends only lines that can be among them, however
    many tasks there are.  If fewer than `wanted` stay below it, it rises; the lines found are the same for every such hash.
    """
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "").select("line", F.xxhash64("line").alias("h"))
    words = F.split(F.trim("line"), "\\s+")
    window = F.array_join(F.slice(words, (F.pmod(F.col("h"), F.greatest(F.size(words) - EXAMPLE, F.lit(0)) + 1) + 1).cast("int"), EXAMPLE), " ")
    share = 4 * wanted / max(lines.count(), 1)
    while True:
        low = lines.where(F.col("h") < -(1 << 63) + int(share * (1 << 64))) if share < 1 else lines
        found = low.orderBy("h", "line").limit(wanted).select(window.alias("line")).collect()
        if len(found) == wanted or share >= 1:
            return [r.line for r in found]
        share *= 8


def scanned(docs: DataFrame, background: int = BACKGROUND) -> DataFrame:
    """(doc_id, line, family, probability, contained, text) of every licence statement in `docs` (doc_id, text).

    line, from 0, is the one where the statement begins; probability is the classifier's odds of the family against unknown,
    contained the share of the best template's word n-grams in the window, text the matched words as they stand.  A paragraph may name any
    number of families; of statements that share most of their words the best contained one counts.  Null and empty texts and
    documents without statements have no rows; texts are read whole whatever their length.  Repeated rows give repeated
    results; a null id stays null.  An empty table gives an empty one.
    The classifier learns from the templates and from at most `background` lines of the corpus, those of least hash, of each at most
    EXAMPLE words (the bounds of the sample), without those that hold a template.
    """
    model = trained(_background(docs, background))

    def work(batches):
        for batch in batches:
            for rows, data, at in chunks(batch, "text"):
                words = _Words(data, at)
                if not len(words.starts):
                    continue
                telling, found = words.hopeful(), []
                lo, hi = (np.concatenate(x) for x in zip(*map(words.windows, WIDTHS)))
                some = telling[hi] - telling[lo] >= 2  # others cannot hold a template, whatever their odds
                lo, hi = lo[some], hi[some]
                if not len(lo):
                    continue
                z = words.logits(lo, hi, model["weights"])
                odds = 1 / (1 + np.exp(np.clip(z[:, :1] - z[:, 1:], -60, 60)))
                for w, f in np.argwhere(odds >= model["needs"]).tolist():
                    share, first, end = words.statement(int(lo[w]), int(hi[w]), FAMILIES[f])
                    if share >= CONTAINED:
                        found.append((first, end, share, float(odds[w, f]), FAMILIES[f]))
                told = [s for group in _by_place(found) for s in _apart(group)]
                if told:
                    first = np.array([s[0] for s in told])
                    texts = [data[words.starts[s[0]]:words.ends[s[1] - 1]].tobytes().decode() for s in told]
                    yield [rows.column("doc_id").take(pa.array(words.owner[first])), words.line[first], [s[4] for s in told], [s[3] for s in told], [s[2] for s in told], texts]

    return over_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                        "doc_id long, line int, family string, probability double, contained double, text string", work)
