"""License scans: Dice coefficient over word bigrams between normalised text and licence templates.

Units of a text are its lines, its paragraphs (runs of lines without a blank one) and the whole. A unit that shares no
bigram with any template is passed over; a template whose number of bigrams can't reach the least coefficient with the
unit's is passed over; the rest are compared exactly, as multisets. For notices within longer units, windows of each
template's size are compared where they begin at one of its bigrams and hold enough of them, the most alike first.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._licence_texts import TEXTS

#: Least Dice coefficient of a find.
LEAST = 0.75
#: Identifier and notice, as such lines are commonly written.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This file is licensed under the Apache License, Version 2.0 (the License)."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated this work to the public domain."),
)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _normal(data: np.ndarray) -> np.ndarray:
    """Marks as blanks, letters folded; line ends stay."""
    return np.where(_WORD[data], _text.LOWER[data], np.where(data == 10, 10, 32)).astype(np.uint8)


def _bigrams(hashes: np.ndarray) -> np.ndarray:
    return _text.mix(hashes[:-1] * _text.U(0x9E3779B97F4A7C15) + hashes[1:]) if len(hashes) > 1 else hashes


class Index:
    """Bigrams of the templates; a template of one word counts as that word."""

    def __init__(self, templates=(*TEMPLATES, *TEXTS), least: float = LEAST):
        self.least = least
        self.names = [n for n, _ in templates]
        self.grams = []
        for _, text in templates:
            data = _normal(np.frombuffer(text.encode(), np.uint8))
            self.grams.append(Counter(_bigrams(_text.words(data, np.array([0, len(data)]))[3]).tolist()))
        self.sizes = np.array([sum(g.values()) for g in self.grams])
        self.every = np.unique(np.array([x for g in self.grams for x in g], np.uint64))
        #: Templates that for the most part are within one of another licence that is twice as long, or longer.
        self.parts = {(i, j) for i, a in enumerate(self.grams) for j, b in enumerate(self.grams) if self.names[i] != self.names[j] and self.sizes[j] >= 2 * self.sizes[i] and sum((a & b).values()) >= least * self.sizes[i]}
        self.bodies = {j for _, j in self.parts}
        #: For each bigram and template whether it is one of its.
        self.member = np.array([np.isin(self.every, np.array(list(g), np.uint64)) for g in self.grams]).T.reshape(len(self.every), len(self.grams))

    def best(self, grams: Counter, size: int) -> tuple[float, int] | None:
        """The most alike template, the first of those as alike."""
        found = None
        for i in np.flatnonzero(2 * np.minimum(self.sizes, size) >= self.least * (self.sizes + size)):
            both = sum((grams & self.grams[i]).values())
            dice = 2 * both / (size + int(self.sizes[i]))
            if dice >= self.least and (found is None or dice > found[0]):
                found = dice, int(i)
        return found

    def windows(self, grams: np.ndarray, rows: np.ndarray, hit: np.ndarray) -> list[tuple[float, int, int, int]]:
        """(dice, template, first bigram, end) of windows alike enough that don't overlap a more alike one.

        A window of a template's size that begins at no bigram of it has no more of them than one that begins at its next."""
        at = np.flatnonzero(hit)
        of = self.member[np.searchsorted(self.every, grams[at])]
        ends = np.searchsorted(rows, rows[at], "right") - 1  # of the row's bigrams
        heap = []
        for t, g in enumerate(self.sizes.tolist()):
            own = np.flatnonzero(of[:, t])
            if not g or not len(own):
                continue
            x = at[own]
            stop = np.minimum(x + g, ends[own])
            bound = 2 * (np.searchsorted(x, stop, "left") - np.arange(len(x))) / (stop - x + g)
            ok = np.flatnonzero(bound >= self.least)
            heap += [(-d, t, a, z, False) for d, a, z in zip(np.minimum(bound[ok], 1).tolist(), x[ok].tolist(), stop[ok].tolist(), strict=True)]
        heapq.heapify(heap)
        taken, out = np.zeros(len(grams), bool), []
        while heap:
            d, t, a, z, exact = heapq.heappop(heap)
            if taken[a:z].any():
                continue
            if exact:
                taken[a:z] = True
                out.append((-d, t, a, z))
                continue
            dice = 2 * sum((Counter(grams[a:z].tolist()) & self.grams[t]).values()) / (z - a + int(self.sizes[t]))
            if dice >= self.least:
                heapq.heappush(heap, (-dice, t, a, z, True))
        return out

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, str, int, float]]:
        """(row, unit kind, licence, first line, dice) of every unit that is alike enough."""
        if not len(data) or not len(self.every):
            return []
        data = _normal(data)
        starts, _, rows, hashes = _text.words(data, offsets)
        if len(hashes) < 2:
            return []
        grams = _bigrams(hashes)
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, starts, "right")
        blank = np.cumsum(np.append(0, np.diff(line) > 1))  # paragraphs of words; a blank line adds two breaks
        hit = np.isin(grams, self.every) & (rows[:-1] == rows[1:])
        out, done, found_at = [], set(), []
        for i in np.flatnonzero(hit).tolist():
            r = int(rows[i])
            base = int(np.searchsorted(breaks, offsets[r], "left"))
            for kind, unit in (("line", line), ("paragraph", blank), ("text", None)):
                key = (r, kind, int(unit[i]) if unit is not None else 0)
                if key in done or unit is not None and unit[i] != unit[i + 1]:
                    continue
                done.add(key)
                lo, hi = np.searchsorted(rows, [r, r + 1])
                if unit is not None:
                    a, b = np.searchsorted(unit[lo:hi], [unit[i], unit[i] + 1])
                    lo, hi = lo + a, lo + b
                size = int(hi - lo - 1)
                if not (2 * np.minimum(self.sizes, size) >= self.least * (self.sizes + size)).any():
                    continue
                if found := self.best(Counter(grams[lo : hi - 1].tolist()), size):
                    out.append((r, kind, self.names[found[1]], int(line[lo]) - base, round(found[0], 6)))
                    found_at.append((lo, hi - 1, *found))
        spans = np.array([x[:2] for x in found_at], np.int64).reshape(-1, 2)
        for dice, t, a, z in sorted(self.windows(grams, rows, hit), key=lambda w: w[2]):
            near = [found_at[i] for i in np.flatnonzero((spans[:, 0] < z) & (spans[:, 1] > a))]
            # the unit around it, or most of it, is the same find
            if any(self.names[u] == self.names[t] or d >= dice and 2 * (min(y, z) - max(x, a)) > z - a and 2 * (z - a) > y - x for x, y, d, u in near):
                continue
            r = int(rows[a])
            out.append((r, "window", self.names[t], int(line[a]) - int(np.searchsorted(breaks, offsets[r], "left")), round(dice, 6)))
            found_at.append((a, z, dice, t))
        # a sentence of a body that another licence has as its notice
        bodies = [x for x in found_at if x[3] in self.bodies]
        gone = {i for i, (a, z, _, t) in enumerate(found_at) for x, y, _, u in bodies if x < z and y > a and (t, u) in self.parts and 2 * (min(y, z) - max(x, a)) > z - a}
        out = [x for i, x in enumerate(out) if i not in gone]
        return out


def scan(docs: DataFrame, templates=(*TEMPLATES, *TEXTS), least: float = LEAST) -> DataFrame:
    """doc_id, license, unit (line, paragraph, text or window), line (its first, from 0), dice: every unit of ``docs`` like a template.

    A window is a run of words within a unit, or across units, that are not such a find themselves. A unit has its most alike template; where a paragraph or text is a single line, only the line is given. Null and empty
    texts have none; repeated rows come out as often; a null doc_id is kept; extra columns are ignored."""
    index = Index(templates, least)

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for lo, _, data, offsets in _text.chunks(batch.column(1)):
                lines: set = set()
                for r, kind, name, line, dice in index.scan(data, offsets):
                    if kind == "line":
                        lines.add((r, line, dice))
                    elif kind != "window" and (r, line, dice) in lines:
                        continue
                    out.append((ids[lo + r], name, kind, line, dice))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "license", "unit", "line", "dice"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, unit string, line int, dice double")
