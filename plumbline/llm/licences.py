"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Word one- to three-grams of a passage are the sparse features of a softmax regression over
licence families and ``unknown``. It is trained on labelled notices and on passages of the corpus
itself as ``unknown``; a temperature fitted on notices and passages that were held back makes its
chances honest. A family counts only if a template of it is found in the passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import text_slices, word_bounds, word_hashes, words_of

UNKNOWN = "unknown"
#: words of a passage, and by how many the next one of a long paragraph starts later
PASSAGE, STEP = 64, 32
#: documents whose passages train ``unknown``, and notices read
MOST_BACKGROUND, MOST_NOTICES = 200, 5_000

# Common wordings of licence notices, by family.
NOTICES = {
    "apache-2.0": (
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
        "this project is released under the apache 2.0 license",
        "spdx-license-identifier apache-2.0",
    ),
    "mit": (
        "released under the mit license",
        "this software is licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "spdx-license-identifier mit",
    ),
    "gpl-3.0": (
        "licensed under the gnu general public license version 3",
        "this work is licensed under the gnu general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license either version 3 of the license or any later version",
        "spdx-license-identifier gpl-3.0-or-later",
    ),
    "gpl-2.0": (
        "licensed under the gnu general public license version 2",
        "you can redistribute it and or modify it under the terms of the gnu general public license either version 2 of the license",
        "spdx-license-identifier gpl-2.0-only",
    ),
    "lgpl": (
        "licensed under the gnu lesser general public license",
        "under the terms of the gnu lesser general public license as published by the free software foundation",
    ),
    "bsd": (
        "released under the bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "spdx-license-identifier bsd-3-clause",
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "licensed under the mozilla public license version 2.0",
    ),
    "cc-by": (
        "licensed under cc by 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
    ),
    "cc-by-sa": (
        "licensed under cc by-sa 4.0",
        "this work is licensed under a creative commons attribution-sharealike 4.0 international license",
    ),
    "cc-by-nc": (
        "licensed under cc by-nc 4.0",
        "this work is licensed under a creative commons attribution-noncommercial 4.0 international license",
    ),
    "cc0": (
        "dedicated to the public domain under cc0 1.0",
        "to the extent possible under law the author has waived all copyright and related rights to this work",
    ),
}

_EDGE_SIGNS = ".,;:!?\"'()[]<>*#/"


def notices_table(spark: SparkSession) -> DataFrame:
    """``text, family`` of the fixed notices."""
    rows = [(text, family) for family, texts in NOTICES.items() for text in texts]
    return spark.createDataFrame(rows, "text string, family string")


def plain_words(text: str) -> list[str]:
    """Lower-case words without the signs at their edges."""
    return [w for w in (w.strip(_EDGE_SIGNS) for w in re.split(r"[\x20\x09-\x0D]+", text.lower())) if w]


def _gram_set(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[k : k + 2]) for k in range(len(words) - 1)} or {tuple(words)}


def template_match(words: list[str], templates: list[set[tuple[str, ...]]]) -> float:
    """Largest share of a template's word pairs that the passage holds."""
    own = _gram_set(words)
    return max((len(t & own) / len(t) for t in templates), default=0.0)


def _grams(hashes: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all one- to three-grams inside passages, and the passage of each."""
    keys, owner = [hashes], [passage]
    with np.errstate(over="ignore"):
        for n in (2, 3):
            if len(hashes) < n:
                break
            key = np.full(len(hashes) - n + 1, n, np.uint64)
            for k in range(n):
                key = key * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k]
            same = passage[: len(key)] == passage[n - 1 :]
            keys.append(key[same])
            owner.append(passage[: len(key)][same])
    return np.concatenate(keys), np.concatenate(owner)


def passages(starts: np.ndarray, ends: np.ndarray, data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word (exclusive) of every passage of joined texts.

    Passages are the lines of a text, and its paragraphs, which also end at a line break after
    ``. ! ? :`` and at a blank line. What is longer is cut into overlapping passages.
    """
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    breaks = np.concatenate(([0], np.cumsum(data == 0x0A)))
    lines = breaks[starts[1:]] - breaks[ends[:-1]]
    closes = np.isin(data[ends[:-1] - 1], np.frombuffer(b".!?:", np.uint8))
    other = owner[1:] != owner[:-1]
    bounds = []
    for cut in (other | (lines > 0), other | (lines > 1) | ((lines == 1) & closes)):
        first = np.concatenate(([0], np.flatnonzero(cut) + 1))
        last = np.concatenate((first[1:], [len(starts)]))
        size = last - first
        pieces = np.where(size <= PASSAGE, 1, -(-(size - PASSAGE) // STEP) + 1)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(first, pieces) + nth * STEP
        bounds.append(np.stack([begin, np.minimum(begin + PASSAGE, np.repeat(last, pieces))]))
    return tuple(np.unique(np.concatenate(bounds, axis=1), axis=1))


class LicenceModel:
    """Softmax regression over hashed n-grams, its temperature and the templates."""

    def __init__(self, families: list[str], templates: dict[str, list[set[tuple[str, ...]]]]):
        self.families, self.templates = families, templates  # the first family is unknown
        self.keys = np.empty(0, np.uint64)
        self.weights = np.zeros((0, len(families)))
        self.shift = np.zeros(len(families))
        self.temperature = 1.0
        self.marks = np.zeros(1 << 16, bool)

    def logits(self, keys: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
        """Scores of ``count`` passages from their n-grams; length does not count."""
        total = np.zeros((count, len(self.families)))
        if len(self.keys):
            near = np.flatnonzero(self.marks[(keys & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, keys[near]), len(self.keys) - 1)
            hit = self.keys[at] == keys[near]
            np.add.at(total, owner[near[hit]], self.weights[at[hit]])
        grams = np.maximum(np.bincount(owner, minlength=count), 1)
        return (total / np.sqrt(grams)[:, None] + self.shift) / self.temperature

    def fit(self, texts: list[str], families: list[str], rounds: int = 80, rate: float = 0.5) -> "LicenceModel":
        label = np.array([self.families.index(f) for f in families])
        keys, owner = [], []
        for k, t in enumerate(texts):
            h = _hashes(plain_words(t))
            own, _ = _grams(h, np.zeros(len(h), np.int64))
            keys.append(own)
            owner.append(np.full(len(own), k))
        keys, owner = np.concatenate(keys), np.concatenate(owner)
        length = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        found, at, often = np.unique(keys, return_inverse=True, return_counts=True)
        kept = (often > 2) & (often < len(keys))
        self.keys, place = found[kept], np.cumsum(kept) - 1
        at, owner = place[at[kept[at]]], owner[kept[at]]
        self.marks[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        value = 1.0 / np.sqrt(length)[owner]
        truth = np.eye(len(self.families))[label]
        share = 1.0 / np.bincount(label, minlength=len(self.families)).clip(1)
        each = share[label] / share[label].sum()
        held = np.arange(len(texts)) % 5 == 4
        for keep_back in (True, False):  # the temperature first, then all rows
            own = np.where(held & keep_back, 0.0, each)
            self.weights = np.zeros((len(self.keys), len(self.families)))
            self.shift = np.zeros(len(self.families))
            speed, speed_s = np.full_like(self.weights, 1e-8), np.full_like(self.shift, 1e-8)
            for _ in range(rounds):
                z = np.zeros_like(truth)
                np.add.at(z, owner, self.weights[at] * value[:, None])
                gap = (truth - _softmax(z + self.shift)) * own[:, None]
                slope = np.zeros_like(self.weights)
                np.add.at(slope, at, gap[owner] * value[:, None])
                slope -= 1e-5 * self.weights
                speed += slope**2
                self.weights += rate * slope / np.sqrt(speed)
                speed_s += gap.sum(axis=0) ** 2
                self.shift += rate * gap.sum(axis=0) / np.sqrt(speed_s)
            if keep_back and held.any():
                z = np.zeros_like(truth)
                np.add.at(z, owner, self.weights[at] * value[:, None])
                z = (z + self.shift)[held]
                loss = {
                    t: -(np.log(_softmax(z / t)[np.arange(held.sum()), label[held]] + 1e-12) * each[held]).sum()
                    for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0)
                }
                best = min(loss, key=loss.get)
        self.temperature = best if held.any() else 1.0
        return self


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return word_hashes(data, *word_bounds(data))


_EDGE_BYTES = np.zeros(256, bool)
_EDGE_BYTES[[*_EDGE_SIGNS.encode()]] = True


def _stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds without the signs at the edges of words; words of signs alone become empty."""
    starts, ends = starts.copy(), ends.copy()
    while True:
        move = (starts < ends) & _EDGE_BYTES[data[np.minimum(starts, len(data) - 1)]]
        if not move.any():
            break
        starts[move] += 1
    while True:
        move = (starts < ends) & _EDGE_BYTES[data[ends - 1]]
        if not move.any():
            return starts, ends
        ends[move] -= 1


def train(notices: DataFrame, docs: DataFrame, most_background: int = MOST_BACKGROUND) -> LicenceModel:
    """Trains on ``notices(text, family)`` and on passages of at most ``most_background`` documents.

    The documents are those first in the order of a hash of their id. Passages that match a
    template are no examples of ``unknown``. Rows with nulls are left out.
    """
    rows = notices.where("text IS NOT NULL AND family IS NOT NULL").limit(MOST_NOTICES).collect()
    families = [UNKNOWN, *sorted({r.family for r in rows} - {UNKNOWN})]
    templates = {f: [_gram_set(plain_words(r.text)) for r in rows if r.family == f] for f in families[1:]}
    every = [t for ts in templates.values() for t in ts]
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id")).limit(most_background)
    sample = docs.join(F.broadcast(ids.distinct()), "doc_id").select("doc_id", "text").collect()
    background = []
    for r in sorted(sample, key=lambda r: (r.doc_id, r.text or "")):
        words = (r.text or "").split()
        for k in range(0, min(len(words), 6 * PASSAGE), PASSAGE // 2):
            own = plain_words(" ".join(words[k : k + PASSAGE // 2]))
            if own and template_match(own, every) < 0.3:
                background.append(" ".join(own))
    fillers = [b.split()[:10] for b in background] or [[]]
    texts, labels = [*background], [UNKNOWN] * len(background)
    for k, r in enumerate(rows):  # alone, and amid words of the corpus
        for filler in ([], fillers[k % len(fillers)], fillers[(7 * k + 3) % len(fillers)]):
            texts.append(" ".join([*filler[:5], r.text, *filler[5:]]))
            labels.append(r.family)
    order = np.random.default_rng(11).permutation(len(texts))
    model = LicenceModel(families, templates)
    return model.fit([texts[i] for i in order], [labels[i] for i in order]) if len(rows) else model


def scan(docs: DataFrame, model: LicenceModel, least: float = 0.5, match: float = 0.75) -> DataFrame:
    """Per row: ``doc_id, n_passages, families, notices``.

    ``notices`` lists ``family:start:end`` of each confirmed notice, in code points and in order;
    ``families`` are their families, each once, in order of name. A passage counts if its most
    likely family is not unknown, its chance is at least ``least``, and at least ``match`` of the
    word pairs of a template of that family stand in it. Of overlapping passages of one family the
    shortest is the notice.

    Null and empty texts have no passages; a null ``doc_id`` is kept; repeated rows are all
    returned; other columns are ignored; long texts are read whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.num_rows
            passes, found = np.zeros(count, np.int64), [[] for _ in range(count)]
            for at, _, data, offsets in text_slices(batch.column(1)):
                starts, ends, owner = words_of(data, offsets)
                if not len(starts):
                    continue
                begin, end = passages(starts, ends, data, owner)
                passes[at : at + len(offsets) - 1] += np.bincount(owner[begin], minlength=len(offsets) - 1)
                bare = _stripped(data, starts, ends)
                whole = bare[0] < bare[1]
                index = np.concatenate(([0], np.cumsum(whole)))
                hashes = _bare_hashes(data, bare[0][whole], bare[1][whole])
                first, size = index[begin], index[end] - index[begin]
                of = np.repeat(np.arange(len(begin)), size)
                place = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                keys, own = _grams(hashes[place], of)
                z = model.logits(keys, own, len(begin))
                chance = _softmax(z)
                best = z.argmax(axis=1)
                likely = np.flatnonzero((best > 0) & (chance.max(axis=1) >= least))
                for k in likely[np.argsort(end[likely] - begin[likely], kind="stable")]:
                    doc, family = int(owner[begin[k]]), model.families[best[k]]
                    a, b, base = int(starts[begin[k]]), int(ends[end[k] - 1]), int(offsets[doc])
                    start = int(((data[base:a] & 0xC0) != 0x80).sum())
                    stop = start + int(((data[a:b] & 0xC0) != 0x80).sum())
                    notes = found[at + doc]
                    if any(f == family and start < y and x < stop for f, x, y in notes):
                        continue
                    words = plain_words(data[a:b].tobytes().decode("utf-8", "replace"))
                    if template_match(words, model.templates[family]) >= match:
                        notes.append((family, start, stop))
            for notes in found:
                notes.sort(key=lambda n: (n[1], n[2], n[0]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(passes),
                    pa.array([",".join(sorted({n[0] for n in notes})) for notes in found]),
                    pa.array([",".join(f"{f}:{a}:{b}" for f, a, b in notes) for notes in found]),
                ],
                names=["doc_id", "n_passages", "families", "notices"],
            )

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "CAST(text AS string) AS text").mapInArrow(
        run, "doc_id long, n_passages long, families string, notices string"
    )


def _bare_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words whose bounds leave out signs: other bytes become blanks."""
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    clean = np.where(np.cumsum(inside[:-1]) > 0, data, np.uint8(0x20))
    return word_hashes(clean, starts, ends)
