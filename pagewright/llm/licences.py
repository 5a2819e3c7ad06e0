"""Scan of texts for licence notices, by Dice coefficient over word bigrams.

A text and the templates are normalised to words of letters and digits in lower case; dots within numbers stay. Windows
of the text as long as a template are compared with it: Dice = 2 * common / (bigrams of both), with bigrams counted as
often as they stand. Two bounds prune: a window of m words can reach the threshold with a template of n words only if
their numbers of bigrams differ by no more than the threshold allows (so only a few window lengths are tried), and a
template is tried only where enough of its bigrams stand close together.

The templates are notices, headers and titles of versions of the common licences. In full there are BSD-2 and BSD-3 only;
of MIT and ISC there is the grant without the disclaimer, of Unlicense, zlib and BSL the beginning. Long licences are
known by title or header, not compared word by word. Versions differ in few words, so a text is near to several templates: a match wins where no overlapping match
holds more bigrams of its template, or as many at a better Dice.

Defined results: null and empty texts match nothing; of overlapping matches of one template the best and then the first
counts; ties between templates go to the first place, then to the first by name; repeated rows are scanned each for itself; empty tables give no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.llm.common import boxed, column_of, named, with_columns

_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(kind: str, version: str, thing: str = "program", sep: str = ";") -> str:
    colon = ":" if sep == "," else ";"
    return (
        f"This {thing} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind} "
        f"as published by the Free Software Foundation{sep} either version {version} of the License, or (at your option) any later version."
    )


#: Notices by which texts name their licence, headers, titles, and texts of short licences.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": _gnu("Affero General Public License", "3", sep=","),
    "AGPL-3.0-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "All-rights-reserved": "All rights reserved.",
    "Apache-2.0-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "Artistic-2.0-title": "The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation.",
    "BSD-2-Clause-text": _BSD_2 + _BSD_END,
    "BSD-3-Clause-text": _BSD_2 + _BSD_3 + _BSD_END,
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "BSL-1.0-text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        'this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, '
        "and to permit third-parties to whom the Software is furnished to do so"
    ),
    "CC-BY-3.0": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-NC-4.0-header": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0-header": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0-header": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-3.0-header": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "CC-BY-SA-4.0-header": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": _gnu("General Public License", "2"),
    "GPL-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.0-header": _gnu("Library General Public License", "2", "library"),
    "LGPL-2.1": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-header": _gnu("Lesser General Public License", "2.1", "library"),
    "LGPL-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0-header": _gnu("Lesser General Public License", "3", sep=","),
    "LGPL-3.0-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-1.1-header": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.',
    "MPL-2.0-title": "Mozilla Public License Version 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved. No part of this publication may be reproduced without permission.",
}
THRESHOLD = 0.8
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def normalised(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Spans:
    """Spans that do not overlap, in order of place."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """Takes the span unless it overlaps one that is there."""
        k = bisect_right(self.starts, start)
        if (k and self.ends[k - 1] > start) or (k < len(self.starts) and self.starts[k] < end):
            return False
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        return True


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        #: The threshold without the rounding of a float: bounds cut at it exactly.
        self.exact = Fraction(str(threshold))
        self.names = sorted(templates)
        self.words = [normalised(templates[n]) for n in self.names]
        self.grams = [Counter(zip(w, w[1:])) for w in self.words]
        self.holders: dict[tuple[str, str], list[int]] = {}
        for k, grams in enumerate(self.grams):
            for g in grams:
                self.holders.setdefault(g, []).append(k)
        # A gram's first word is looked up before the gram.
        self.firsts = frozenset(g[0] for g in self.holders)

    def lengths(self, n: int) -> range:
        """Window sizes in bigrams that can reach the threshold with n bigrams: 2 min / (m + n) >= threshold."""
        t = self.exact
        return range(max(1, ceil(n * t / (2 - t))), floor(n * (2 - t) / t) + 1)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """name, dice, first word and number of words of each match, in order of place and name."""
        words = normalised(text)
        hits: dict[int, list[int]] = {}
        firsts, holders = self.firsts, self.holders
        for i in [i for i, w in enumerate(words) if w in firsts]:
            if i + 1 < len(words):
                for k in holders.get((words[i], words[i + 1]), ()):
                    hits.setdefault(k, []).append(i)
        found = []
        for k, at in hits.items():
            grams = self.grams[k]
            n = grams.total()
            sizes = self.lengths(n)
            need = max(1, ceil(self.exact * (n + sizes[0]) / 2))
            best: list[tuple[float, int, int]] = []
            # A match holds at least `need` of the template's bigrams within the longest window.
            for a in range(len(at) - need + 1):
                if at[a + need - 1] - at[a] >= sizes[-1]:
                    continue
                start = at[a]
                # The window grows by one bigram at a time.
                seen: dict[tuple[str, str], int] = {}
                common = 0
                for m in range(1, min(sizes[-1], len(words) - 1 - start) + 1):
                    g = (words[start + m - 1], words[start + m])
                    if g in grams:
                        seen[g] = seen.get(g, 0) + 1
                        common += seen[g] <= grams[g]
                    if m >= sizes[0] and (d := 2 * common / (m + n)) >= self.threshold:
                        best.append((d, start, m + 1))
            taken = Spans()
            for d, start, size in sorted(best, key=lambda x: (-x[0], x[1], x[2])):
                if taken.add(start, start + size):
                    found.append((self.names[k], d, start, size))
        return sorted(found, key=lambda x: (x[2], x[0]))


    def winners(self, found: list[tuple[str, float, int, int]]) -> list[bool]:
        """Which matches win: those that no better match overlaps which wins itself."""
        size = {name: grams.total() for name, grams in zip(self.names, self.grams)}
        common = [round(d * (size[name] + words - 1) / 2) for name, d, _, words in found]
        wins = [False] * len(found)
        taken = Spans()
        for i in sorted(range(len(found)), key=lambda i: (-common[i], -found[i][1], found[i][2], found[i][0])):
            wins[i] = taken.add(found[i][2], found[i][2] + found[i][3])
        return wins


MATCHES_DDL = "matches array<struct<licence:string,dice:double,start:int,words:int,wins:boolean>>"
_MATCHES = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("words", pa.int32()), ("wins", pa.bool_())]))


def _scanner(templates: dict[str, str], threshold: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for part in parts:
            found = [scanner.scan(t) for t in column_of(part, "text")]
            rows = [[dict(zip(("licence", "dice", "start", "words", "wins"), (*m, w))) for m, w in zip(f, scanner.winners(f))] for f in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, _MATCHES)], names=["box", "matches"])

    return run


def licences(docs: DataFrame, keep: list[str], text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The columns in keep of every document, and matches: array of (licence, dice, start, words, wins)."""
    boxes = boxed(docs, keep, text=named(text_col))
    return boxes.mapInArrow(_scanner(templates or TEMPLATES, threshold), with_columns(boxes, MATCHES_DDL)).select("box.*", "matches")
