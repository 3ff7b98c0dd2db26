"""Operator 4, licence scans.

Every run of words as long as a template is a window, cut off where the text begins or ends, so that a text that
holds only a part of a notice is seen too. MinHash signatures of all windows come from sliding minima (a few vector operations
a hash function, whatever the window's length); bands of them are compared with the templates' bands, and
each hit is checked by exact containment of the template's shingles. Where windows of several licences
overlap, the one with the best containment stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .shingles import WordHashes, joined, permutations

_SOFTWARE_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: Public licence texts and notices, by SPDX name; those of MIT and ISC are whole.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"),
    ("GPL-2.0", "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("GPL-3.0", "it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"),
    ("LGPL-2.0", "it under the terms of the GNU Library General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _SOFTWARE_AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_AS_IS),
)
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class LicenseScan:
    """Parameters. At containment ``least`` c a window as long as the template has Jaccard c / (2 - c); bands of
    ``rows`` then meet with probability 1 - (1 - J**rows)**bands: 0.999 at the defaults, 1 for a verbatim notice."""

    templates: tuple[tuple[str, str], ...] = TEMPLATES
    words: int = 5
    least: float = 0.8
    bands: int = 12
    rows: int = 2
    seed: int = 11


class _Scanner:
    def __init__(self, p: LicenseScan):
        self.p, self.hashes = p, WordHashes()
        self.sets = [joined(self.tokens(t)[0], p.words) for _, t in p.templates]
        if any(len(s) == 0 for s in self.sets):
            raise ValueError(f"a template has at least {p.words} words")
        self.exact = [set(s.tolist()) for s in self.sets]
        self.xor, self.mul = permutations(p.bands * p.rows, p.seed)
        self.overhang = int(np.ceil((1 - p.least) * max(len(x) for x in self.sets))) + p.words
        self.by_width: dict[int, list[int]] = {}
        self.sig = []
        for k, s in enumerate(self.sets):
            low = (s >> np.uint64(32)).astype(np.uint32)
            self.sig.append([((low ^ x) * m).min() for x, m in zip(self.xor, self.mul, strict=True)])
            self.by_width.setdefault(len(s), []).append(k)

    def tokens(self, text: str) -> tuple[np.ndarray, int]:
        words = _WORD.findall(text.lower())
        return np.fromiter(map(self.hashes.__getitem__, words), dtype=np.uint64, count=len(words)), len(words)

    def scan(self, texts: list[str]) -> list[tuple[int, int, float, int]]:
        """(text, template, best containment, first word of the best window) over texts one after another, with room between them for windows that stand out of a text."""
        p, room = self.p, np.zeros(self.overhang, dtype=np.uint64)
        tokens = [self.tokens(t)[0] for t in texts]
        begins = np.cumsum([self.overhang, *(len(t) + self.overhang for t in tokens)])[:-1]
        sh = joined(np.concatenate([room, *(x for t in tokens for x in (t, room))]), p.words)
        last = np.array([b + len(t) - p.words + 1 for b, t in zip(begins.tolist(), tokens, strict=True)])  # behind a text's last shingle
        outside = np.ones(len(sh), dtype=bool)
        for b, e in zip(begins.tolist(), last.tolist(), strict=True):
            outside[b : max(b, e)] = False
        low = (sh >> np.uint64(32)).astype(np.uint32)
        hits: set[tuple[int, int]] = set()
        widths = [w for w in self.by_width if w <= len(sh)]
        for band in range(p.bands):
            rows = range(band * p.rows, (band + 1) * p.rows)
            values = [(low ^ self.xor[i]) * self.mul[i] for i in rows]
            for h in values:
                h[outside] = 0xFFFFFFFF
            for w, first in self._minima(values[0], widths).items():
                for k in self.by_width[w]:
                    at = np.flatnonzero(first == self.sig[k][rows[0]])
                    for i, h in zip(rows[1:], values[1:], strict=True):
                        if len(at):  # few windows are left, or else all minima are taken
                            least = np.lib.stride_tricks.sliding_window_view(h, w)[at].min(axis=1) if w * len(at) < len(h) else self._minima(h, [w])[w][at]
                            at = at[least == self.sig[k][i]]
                    hits.update((x, k) for x in at.tolist())
        passed: dict[int, list[tuple[float, int, int, int, int]]] = {}
        for i, k in sorted(hits):
            n = len(self.sets[k])
            text = max(0, int(np.searchsorted(begins, i + n // 2, side="right")) - 1)  # where the window's middle lies
            s, e = max(i, int(begins[text])), min(i + n, int(last[text]))
            if s >= e:
                continue
            share = len(self.exact[k].intersection(sh[s:e].tolist())) / len(self.exact[k])
            if share >= p.least:
                passed.setdefault(text, []).append((-share, -n, k, s, e + p.words - 1))
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for text, windows in passed.items():
            for k, share, i in self._undisputed(sorted(windows)):
                best.setdefault((text, k), (share, i - int(begins[text])))
        return [(text, k, share, at) for (text, k), (share, at) in best.items()]

    def _undisputed(self, windows: list[tuple[float, int, int, int, int]]) -> Iterator[tuple[int, float, int]]:
        """The windows, the best first, but those that share over half of the shorter one's words with a better one of another licence."""
        cell = max(len(x) for x in self.sets) + self.p.words - 1
        taken: dict[int, list[tuple[str, int, int]]] = {}  # by the cells of words that a window touches, two at most
        for minus, _, k, i, end in windows:
            name = self.p.templates[k][0]
            touched = {i // cell, (end - 1) // cell}
            if not any(name != o and 2 * (min(end, e) - max(i, s)) > min(end - i, e - s) for c in touched for o, s, e in taken.get(c, ())):
                for c in touched:
                    taken.setdefault(c, []).append((name, i, end))
                yield k, -minus, i

    @staticmethod
    def _minima(h: np.ndarray, widths: list[int]) -> dict[int, np.ndarray]:
        """For each width, the minimum of every window, from windows of powers of two."""
        out, size, wanted = {}, 1, sorted(widths)
        while wanted:
            while wanted and wanted[0] < 2 * size:
                w = wanted.pop(0)
                out[w] = np.minimum(h[: len(h) - (w - size)], h[w - size :]) if w > size else h
            if wanted:
                h, size = np.minimum(h[:-size], h[size:]), 2 * size
        return out


def templates_of(rows: DataFrame, most: int = 10_000) -> tuple[tuple[str, str], ...]:
    """Templates from a table ``license, text`` of at most ``most`` rows (else ValueError), whole texts in the order of their names."""
    got = rows.select("license", "text").where("license is not null and text is not null").distinct().limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} templates")
    return tuple(sorted((r["license"], r["text"]) for r in got))


_scanners: dict[LicenseScan, _Scanner] = {}


def scan_licenses(docs: DataFrame, params: LicenseScan = LicenseScan()) -> DataFrame:
    """One row per document and licence found: ``doc_id, license, template, containment, at_word``.

    Words are runs of letters, digits and _, lower-cased. ``containment`` is the largest share of a template's
    shingles that one window holds (at least ``least``); a window that shares over half of the shorter one's words with
    a better one of another licence doesn't count (ties: the longer template, then the first). ``at_word`` is where
    the first such window begins, and
    ``template`` the number of the template it belongs to (ties: the first). Null and empty texts and texts
    shorter than ``words`` words have no rows; repeated rows give repeated results; other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanners[params] if params in _scanners else _scanners.setdefault(params, _Scanner(params))
        for whole in batches:
            for at in range(0, len(whole), 200):
                b = whole.slice(at, 200)
                found = scanner.scan(b["text"].to_pylist())
                best: dict[tuple[int, str], tuple] = {}
                for text, k, share, word in sorted(found, key=lambda x: (x[0], -x[2], x[1])):
                    best.setdefault((text, params.templates[k][0]), (k, share, word))
                rows = [(text, name, k, share, word) for (text, name), (k, share, word) in best.items()]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.int64())],
                    ["doc_id", "license", "template", "containment", "at_word"],
                )

    return text_of(docs, "doc_id", "text").where(F.length("text") > 0).mapInArrow(run, f"doc_id {kind}, license string, template int, containment double, at_word long")
