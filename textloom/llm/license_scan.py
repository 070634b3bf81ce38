"""Licence scan: lines, texts and word windows against licence texts and notices by Dice coefficient over word bigrams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm._bytes import ALNUM, Words, mix, slices

#: Short notices by which texts name their licence, written from the licences' own recommended wording.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

_HEADER = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
#: The notices that the licences want at the head of a file.
HEADERS: dict[str, list[str]] = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "GPL-2.0": [_HEADER.format("program", "General Public License", "2")],
    "GPL-3.0": [_HEADER.format("program", "General Public License", "3")],
    "LGPL-2.1": [_HEADER.format("library", "Lesser General Public License", "2.1")],
    "LGPL-3.0": [_HEADER.format("library", "Lesser General Public License", "3")],
    "AGPL-3.0": [_HEADER.format("program", "Affero General Public License", "3")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}


def templates_of_all() -> dict[str, list[str]]:
    """The notices, file headers and full texts (licenses/, read by the driver) of each licence."""
    out = {name: list(texts) for name, texts in TEMPLATES.items()}
    for name, texts in HEADERS.items():
        out.setdefault(name, []).extend(texts)
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        out.setdefault(path.stem, []).append(path.read_text(encoding="utf-8"))
    return out


_NEWLINE = np.ones(256, dtype=bool)
_NEWLINE[0x0A] = False


def _bigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, unit) of each pair of words of a unit; a unit of one word has that word alone."""
    h, unit = words.hashes(), words.document()
    same = unit[:-1] == unit[1:] if len(h) else np.zeros(0, bool)
    pair, of = mix(h[:-1] * np.uint64(3) + h[1:])[same] if len(h) else h, unit[:-1][same] if len(h) else unit
    single = np.flatnonzero(words.counts == 1)
    return np.concatenate([pair, h[words.bounds[:-1][single]]]), np.concatenate([of, single])


class Templates:
    """Bags of word bigrams of the templates, with an index from bigram to template.

    A text and a template with n and m bigrams, c of them shared, have the coefficient
    2c / (n + m); c is min(n, m) at most, which bounds n for each template and threshold.
    """

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold = threshold
        self.names, bags = [], []
        for name, texts in templates.items():
            for t in texts:
                b = t.encode()
                pairs, _ = _bigrams(Words(np.frombuffer(b, np.uint8), np.array([0, len(b)]), ALNUM))
                self.names.append(name)
                bags.append(Counter(pairs.tolist()))
        self.bags, self.sizes = bags, [sum(x.values()) for x in bags]
        self.low = [m * threshold / (2 - threshold) - 1e-9 for m in self.sizes]
        self.high = [m * (2 - threshold) / threshold + 1e-9 for m in self.sizes]
        self.known = np.array(sorted({h for x in bags for h in x}), dtype=np.uint64)
        self.index: dict[int, list[int]] = {}
        for i, x in enumerate(bags):
            for h in x:
                self.index.setdefault(h, []).append(i)
        # For each known bigram: its templates and how often each has it, in one array after another.
        entries = [(i, bags[i][h]) for h in self.known.tolist() for i in self.index[h]]
        self.first = np.concatenate([[0], np.cumsum([len(self.index[h]) for h in self.known.tolist()])]).astype(np.int64)
        self.template, self.times = (np.array([e[k] for e in entries], np.int64) for k in (0, 1))

    def best(self, bag: Counter, n: int) -> tuple[float, str] | None:
        """The largest coefficient at or over the threshold and its licence; ties go to the first name."""
        found = None
        for i in {i for h in bag for i in self.index.get(h, ())}:
            if self.low[i] <= n <= self.high[i]:
                shared = sum(min(c, self.bags[i].get(h, 0)) for h, c in bag.items())
                score = 2 * shared / (n + self.sizes[i])
                if score >= self.threshold and (found is None or (-score, self.names[i]) < (-found[0], found[1])):
                    found = (score, self.names[i])
        return found

    def windows(self, words: Words) -> list[tuple[int, int, int, float, str]]:
        """(document, first word, last word, score, licence) of windows that reach the threshold, words counted in the slice.

        A window that starts or ends with a bigram that the template lacks scores more without
        it, so that windows between a template's own bigrams are all there is to score: each
        start has its best end. Of windows that overlap, that with the most shared bigrams
        times score stays.
        """
        h, doc = words.hashes(), words.document()
        if len(h) < 2:
            return []
        pairs = mix(h[:-1] * np.uint64(3) + h[1:])
        at = np.minimum(np.searchsorted(self.known, pairs), len(self.known) - 1)
        place = np.flatnonzero((self.known[at] == pairs) & (doc[:-1] == doc[1:]))
        if not len(place):
            return []
        at = at[place]
        # Documents are put so far apart that no window can reach from one into the next.
        place = place + doc[place] * (int(max(self.high)) + 2)
        n = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        which, times, gram, place = self.template[entry], self.times[entry], np.repeat(at, n), np.repeat(place, n)
        order = np.argsort(which, kind="stable")
        edges = np.searchsorted(which[order], np.arange(len(self.bags) + 1))
        found = []
        for i, m in enumerate(self.sizes):
            own = order[edges[i] : edges[i + 1]]
            if len(own) < self.low[i]:
                continue
            p, g, k, half = place[own], gram[own], times[own], self.threshold / 2
            # At least half * (n + m) hits are needed among n bigrams: starts from which no end has them go.
            gain = np.arange(len(p)) - half * p
            starts = np.flatnonzero(np.maximum.accumulate(gain[::-1])[::-1] - gain + 1 - half >= half * m - 1e-6)
            if not len(starts):
                continue
            # A bigram counts unless as many as the template has stand before it in the window: `past` is the latest start without it.
            by = np.argsort(g, kind="stable")
            sorted_g, source = g[by], np.arange(len(g)) - k[by]
            there = (source >= 0) & (sorted_g[np.maximum(source, 0)] == sorted_g)
            past = np.full(len(g), -1, np.int64)
            past[by[there]] = by[source[there]]
            ends = np.searchsorted(p, p[starts] + int(self.high[i]), side="left")
            for a, e in zip(starts.tolist(), ends.tolist(), strict=True):
                shared = np.cumsum(past[a:e] < a)
                score = 2 * shared / (p[a:e] - p[a] + 1 + m)
                b = int(score.argmax())
                if score[b] >= self.threshold:
                    found.append((-float(shared[b] * score[b]), int(p[a]), self.names[i], int(p[a + b]), float(score[b])))
        out, taken = [], set()
        for _, a, name, b, score in sorted(found):
            d = int(np.searchsorted(words.bounds + np.arange(len(words.bounds)) * (int(max(self.high)) + 2), a, side="right")) - 1
            a, b = (x - d * (int(max(self.high)) + 2) for x in (a, b + 1))
            if taken.isdisjoint(range(a, b + 1)):
                taken.update(range(a, b + 1))
                out.append((d, a, b, score, name))
        return sorted(out)

    def scan(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, float, str]]:
        """(unit, score, licence) of the units between the offsets that reach the threshold."""
        words = Words(data, offs, ALNUM)
        pairs, unit = _bigrams(words)
        at = np.minimum(np.searchsorted(self.known, pairs), len(self.known) - 1)
        hit = self.known[at] == pairs
        sizes = np.maximum(words.counts - 1, np.minimum(words.counts, 1))
        shared = np.bincount(unit[hit], minlength=len(words.counts))
        # No template can reach the threshold unless this many of its bigrams occur.
        worth = np.flatnonzero((shared > 0) & (2 * shared >= self.threshold * sizes) & (sizes <= max(self.high)))
        if not len(worth):
            return []
        chosen = np.isin(unit, worth) & hit
        bags: dict[int, Counter] = {u: Counter() for u in worth.tolist()}
        for h, u in zip(pairs[chosen].tolist(), unit[chosen].tolist(), strict=True):
            bags[u][h] += 1
        out = []
        for u, bag in bags.items():
            if best := self.best(bag, int(sizes[u])):
                out.append((u, *best))
        return out


_MATCH = pa.list_(pa.struct([("line", pa.int32()), ("license", pa.string()), ("score", pa.float64()), ("last", pa.int32())]))
_TYPE = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("matches", _MATCH)])
_SPARK = "doc_id long, n_lines long, matches array<struct<line:int,license:string,score:double,last:int>>"


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = 0.8, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines and the licence matches of each document row.

    Units are the lines of the text, from 0, the whole text as line -1, and windows of words
    from line `line` to line `last`. Words are runs of letters, digits and non-ASCII
    characters, lower-cased. Null and empty texts have no lines and no match. Each unit
    reports its best template only. Windows do not overlap; one within a line or text that
    is reported with the same licence is not told again.
    """
    templates = templates or templates_of_all()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Templates(templates, threshold)
        for batch in batches:
            for first, end, data, offs in slices(batch.column(1)):
                lines = Words(data, offs, _NEWLINE)  # the lines that are not empty
                found: list[list[dict]] = [[] for _ in range(end - first)]
                edges = np.unique(np.concatenate([lines.starts, lines.ends, [0, len(data)]]))
                of = np.searchsorted(offs, edges[:-1], side="right") - 1
                breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
                told: set[tuple[int, int, str]] = set()
                for u, score, name in index.scan(data, edges):
                    d = int(of[u])
                    line = int(breaks[edges[u]] - breaks[offs[d]])
                    found[d].append({"line": line, "license": name, "score": score, "last": line})
                    told.add((d, line, name))
                for d, score, name in index.scan(data, offs):
                    found[d].insert(0, {"line": -1, "license": name, "score": score, "last": -1})
                    told.add((d, -1, name))
                words = Words(data, offs, ALNUM)
                for d, a, b, score, name in index.windows(words):
                    line, last = (int(breaks[words.starts[x]] - breaks[offs[d]]) for x in (a, b))
                    if (d, -1, name) not in told and (line != last or (d, line, name) not in told):
                        found[d].append({"line": line, "license": name, "score": score, "last": last})
                n = np.where(np.diff(offs) > 0, breaks[offs[1:]] - breaks[offs[:-1]] + 1, 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(found, _MATCH)], schema=_TYPE)

    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _SPARK)
