"""License scans by patience alignment of texts with templates.

Words are runs of letters and digits in lower case. Each signal word of a template that
a text holds proposes where the template would begin; around it, template and text are
aligned by patience: words that stand once in both, the longest increasing sequence of
their places, and then each gap in the same way. The share of a template's words that
are aligned is its coverage; a place counts from COVERAGE on. Of overlapping places the
one with most aligned words stays (then the higher coverage, then the template's name).

A template has one signal word more than words may be missing, so none that counts can be
without a proposal. Templates are few and fixed or given; documents don't move.

Defined results: null and empty texts hold nothing; a template that stands several times
is a row for each place; a license in other words than a template's isn't found; a notice
may have other words between its own, but a word of it is looked for no further from where
it would stand without them than INSERTED times the template's length (and two words);
rows of one doc_id are scanned each for itself; a null doc_id stays null; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import NOT_ALNUM, lower, row_of, slices, word_hashes
from veritrail.llm.lines import aligned

COVERAGE = 0.8
#: Words that may stand between those of a notice, as a share of its words.
INSERTED = 1.0
SCHEMA = "doc_id long, license string, coverage double, matched int, first_word int, last_word int"

#: The customary notices of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "BSD-licensed": "Licensed under the BSD 3-Clause License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain worldwide under CC0 1.0 Universal.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-text": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "MIT-disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "all-rights-reserved-line": "All rights reserved.",
    "all-rights-reserved": "Copyright. All rights reserved. No part of this work may be reproduced without permission.",
}
#: Function words, which propose nothing while enough others do.
FUNCTION_WORDS = "a all and any are as at be by can do either following for free from has in including is it no not of on or other part person so terms that the this to use under with without you".split()


def _hashed(text: str) -> list[int]:
    return word_hashes(lower(pa.array([text])), NOT_ALNUM)[0].tolist()


class Templates:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.names = sorted(templates)
        self.words = [_hashed(templates[n]) for n in self.names]
        weak = set(_hashed(" ".join(FUNCTION_WORDS)))
        self.places: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            may_miss = int(len(words) - len(words) * coverage + 1e-9)
            lengths = [len(w) for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", templates[self.names[t]].lower()) if w]
            # Long words propose first: they stand in fewer texts.
            for i in sorted(range(len(words)), key=lambda i: (words[i] in weak, -lengths[i], i))[: may_miss + 1]:  # noqa: B023
                self.places.setdefault(words[i], []).append((t, i))
        self.signal = np.sort(np.array(list(self.places), np.uint64))

    def found(self, words: np.ndarray, signals: list[int]) -> list[tuple]:
        """Name, coverage, matched words, first and last word of each place; signals: indexes of signal words."""
        begins = {(t, at - i) for at in signals for t, i in self.places[int(words[at])]}
        places = []
        for t, begin in begins:
            template = self.words[t]
            n = len(template)
            least = n * self.coverage - 1e-9
            # Narrow windows first: in a wide one, words of the next notice may stand beside a notice's own.
            for slack in (0, n // 4 + 2, int(n * INSERTED) + 2):
                a = max(0, begin - slack)
                window = words[a : max(0, begin + n + slack)].tolist()
                if len(set(window).intersection(template)) < least - (n - len(set(template))):
                    continue
                pairs = aligned(template, window)
                if len(pairs) >= least:
                    places.append((-len(pairs), -len(pairs) / n, self.names[t], a + pairs[0][1], a + pairs[-1][1]))
                    break
        kept: list[tuple[int, int, tuple]] = []  # by place, none over another
        for p in sorted(set(places)):
            i = bisect_left(kept, (p[3],))
            if (i == 0 or kept[i - 1][1] < p[3]) and (i == len(kept) or kept[i][0] > p[4]):
                kept.insert(i, (p[3], p[4], (p[2], -p[1], -p[0], p[3], p[4])))
        return [p for _, _, p in kept]


def _scan(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates: Templates = held.value
        for batch in slices(batches):
            words, rows = word_hashes(lower(batch["text"]), NOT_ALNUM)
            at = np.minimum(np.searchsorted(templates.signal, words), len(templates.signal) - 1)
            hits = np.flatnonzero(templates.signal[at] == words)
            owner, begins = np.unique(row_of(rows)[hits], return_index=True)
            docs, out = batch["doc_id"].to_pylist(), []
            for doc, lo, hi in zip(owner.tolist(), begins.tolist(), np.append(begins, len(hits))[1:].tolist(), strict=True):
                a, b = int(rows[doc]), int(rows[doc + 1])
                out += [(docs[doc], *p) for p in templates.found(words[a:b], (hits[lo:hi] - a).tolist())]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            names = ["doc_id", "license", "coverage", "matched", "first_word", "last_word"]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], names=names)

    return run


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per place of a template in a text: license, coverage, aligned words, first and last word."""
    held = docs.sparkSession.sparkContext.broadcast(Templates(templates or TEMPLATES, coverage))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(held), SCHEMA)
