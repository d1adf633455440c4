"""License scans: MinHash bands over text windows retrieve templates, exact containment verifies them.

Words are runs of ASCII letters and digits, lower-cased; shingles have five
words.  A document's shingles are cut into windows of ``WINDOW`` shingles that
start every ``STEP``, so every stretch of up to ``WINDOW - STEP + 1`` shingles
lies in one window.  A window's ``BANDS`` minwise values, one to a band, look up
template windows; a template of a single shingle lies in a window with a
similarity of at least 1 / WINDOW and collides in some band with probability
``1 - (1 - 1 / WINDOW)^BANDS``, above 0.99999, and longer ones more often
(``bands_for`` gives the bands that a similarity and a probability ask for).

A retrieved template is verified exactly: a stretch of the document no longer
than ``SPREAD`` times the template must contain at least ``threshold`` of the
template's distinct shingles, and all shingles of the words in ``NEEDS``.  Bands of all windows of whole texts are
looked up, and nothing else picks the templates to verify; texts go through in groups, as a
window costs ``BANDS`` products.

Results for odd input: a null or empty text, or one of fewer than five words,
has no match; repeated rows each give their matches; an empty table gives an
empty result; other columns are ignored.  Several places of one template in a
document are several rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

#: Well-known licence notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

_GNU = (
    "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} "
    "as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
)

#: Standard headers of the GNU licences: the work's word, the licence's name, the version.
_GNU_HEADERS = {
    "GPL-2.0-or-later-header": ("program", "General Public License", "2"),
    "GPL-3.0-or-later-header": ("program", "General Public License", "3"),
    "LGPL-2.0-or-later-header": ("library", "Library General Public License", "2"),
    "LGPL-2.1-or-later-header": ("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0-or-later-header": ("program", "Lesser General Public License", "3"),
    "AGPL-3.0-or-later-header": ("program", "Affero General Public License", "3"),
}
TEMPLATES |= {key: _GNU.format(what=what, name=name, version=version) for key, (what, name, version) in _GNU_HEADERS.items()}

#: Words that a match must hold whole: they alone keep these headers apart.
NEEDS: dict[str, list[str]] = {
    key: [f"of the GNU {name}", f"either version {version} of the License"] for key, (_, name, version) in _GNU_HEADERS.items()
}
TEMPLATES["GPL-1.0-or-later-header"] = TEMPLATES["GPL-2.0-or-later-header"].replace("version 2 of the License,", "version 1,")
NEEDS["GPL-1.0-or-later-header"] = ["of the GNU General Public License", "Foundation; either version 1, or"]
NEEDS["GPL-2.0-title"] = NEEDS["GPL-3.0-title"] = ["GNU GENERAL PUBLIC LICENSE Version"]

#: Titles stand at the head of the licences' full texts, the other notices in their files and pages.
TEMPLATES |= {
    "AGPL-3.0-notice": "GNU Affero General Public License version 3",
    "AGPL-3.0-notice-v": "GNU Affero General Public License v3.0",
    "AGPL-3.0-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-2.0-header-grant": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "Apache-2.0-notice": "Licensed under the Apache License 2.0",
    "Apache-2.0-notice-released": "Released under the Apache License 2.0",
    "Apache-2.0-notice-released-version": "Released under the Apache License, Version 2.0",
    "Apache-2.0-title": "Apache License Version 2.0, January 2004",
    "Artistic-1.0": "The intent of this document is to state the conditions under which a Package may be copied",
    "Artistic-2.0-title": "The Artistic License 2.0 Copyright",
    "BSD-2-Clause-notice": "licensed under the BSD 2-Clause License",
    "BSD-3-Clause-notice": "licensed under the BSD 3-Clause License",
    "BSD-notice-style": "governed by a BSD-style license that can be found in the LICENSE file",
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license"
    ),
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0",
    "BSL-1.0-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "CC-BY-3.0": "licensed under a Creative Commons Attribution 3.0",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0",
    "CC-BY-NC-ND-4.0": "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "CC-BY-NC-ND-4.0-notice": "Licensed under CC BY-NC-ND 4.0",
    "CC-BY-NC-SA-4.0": "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-NC-4.0-long": "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-ND-4.0": "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0",
    "CC-BY-SA-3.0": "licensed under a Creative Commons Attribution-ShareAlike 3.0",
    "CC-BY-SA-4.0-long": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "waived all copyright and related or neighboring rights to",
    "CC0-1.0-purpose": "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights",
    "CC0-1.0-title": "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication",
    "EPL-1.0": "made available under the terms of the Eclipse Public License v1.0",
    "EPL-2.0": "made available under the terms of the Eclipse Public License 2.0",
    "GFDL": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",
    "GPL-1.0-title": "GNU GENERAL PUBLIC LICENSE Version 1, February 1989",
    "GPL-2.0-notice": "GNU General Public License version 2",
    "GPL-2.0-notice-v": "GNU General Public License v2.0",
    "GPL-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0-notice": "GNU General Public License version 3",
    "GPL-3.0-notice-v": "GNU General Public License v3.0",
    "GPL-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "ISC-notice": "Licensed under the ISC License",
    "ISC-notice-released": "Released under the ISC License",
    "LGPL-2.0-title": "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
    "LGPL-2.1-notice": "GNU Lesser General Public License version 2.1",
    "LGPL-2.1-notice-v": "GNU Lesser General Public License v2.1",
    "LGPL-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0-notice": "GNU Lesser General Public License version 3",
    "LGPL-3.0-notice-v": "GNU Lesser General Public License v3.0",
    "LGPL-3.0-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "MIT-notice": "Licensed under the MIT License",
    "MIT-notice-distributed": "Distributed under the MIT License",
    "MIT-notice-available": "available under the MIT License",
    "MIT-notice-terms": "under the terms of the MIT License",
    "MPL-1.1-title": "Mozilla Public License Version 1.1",
    "MPL-2.0-title": "Mozilla Public License Version 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}

SHINGLE = 5
WINDOW = 8
STEP = 4
BANDS = 96
SPREAD = 1.5

_WORD = re.compile(r"[A-Za-z0-9]+")
_OUT = "doc_id long, license string, start long, end long, containment double"


def bands_for(similarity: float, probability: float) -> int:
    """One-value bands with which windows of that similarity collide at least so probably."""
    return math.ceil(math.log(1 - probability) / math.log(1 - similarity))


def _shingles(words: list[str]) -> np.ndarray:
    if len(words) < SHINGLE:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    return _combined(h)


def _combined(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - SHINGLE + 1 + i]
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xBF58476D1CE4E5B9)


_MULTIPLIERS = np.random.default_rng(3).integers(0, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


NONE = np.uint64(np.iinfo(np.uint64).max)
#: Shingles of texts that are scanned together, and a slice of them for which all bands are computed at once.
TOGETHER = 1 << 17
SLICE = 1 << 13
#: Bytes of words whose hashes a task remembers.
WORD_BYTES = 32 << 20


def _minima(padded: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Per band and window its minwise value; windows are two neighbouring rows of ``STEP`` shingles, and places that are not real hold none."""
    low = np.empty((BANDS, len(padded)), np.uint64)
    for b, multiplier in enumerate(_MULTIPLIERS):
        low[b] = np.where(real, padded * multiplier, NONE).min(1)
    return np.minimum(low[:, :-1], low[:, 1:])


def _rows(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in rows of ``STEP`` with an empty row after them, and which places are real."""
    rows = -(-len(s) // STEP) + 1
    out = np.zeros(rows * STEP, np.uint64)
    out[: len(s)] = s
    return out.reshape(rows, STEP), (np.arange(rows * STEP) < len(s)).reshape(rows, STEP)


class Scanner:
    """Templates, the table of their windows' bands, and the scan of texts."""

    def __init__(self, templates: Mapping[str, str], threshold: float):
        self.threshold = threshold
        self.needs = {
            name: np.unique(np.concatenate([_shingles(_WORD.findall(need.lower())) for need in NEEDS[name]]))
            for name, text in templates.items()
            if text == TEMPLATES.get(name) and name in NEEDS
        }
        self.templates = {name: np.unique(_shingles(_WORD.findall(text.lower()))) for name, text in templates.items()}
        self.lengths = {name: max(1, len(_WORD.findall(text)) - SHINGLE + 1) for name, text in templates.items()}
        self.table: dict[tuple[int, int], set[str]] = {}
        for name, text in templates.items():
            s = _shingles(_WORD.findall(text.lower()))
            if len(s):
                for band, values in enumerate(_minima(*_rows(s)).tolist()):
                    for value in values:
                        self.table.setdefault((band, value), set()).add(name)
        #: Per band, which last 16 bits its values end with: a first look before the table's.
        self.ends = np.zeros((BANDS, 1 << 16), bool)
        for band, value in self.table:
            self.ends[band, value & 0xFFFF] = True
        self.hashes: dict[str, int] = {}
        self.size = 0

    def retrieve(self, texts: list[np.ndarray]) -> list[set[str]]:
        """Of each text's shingles, the templates of which some window shares some band."""
        found: list[set[str]] = [set() for _ in texts]
        parts = [_rows(s) for s in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p[0]) for p in parts])
        padded, real = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        bands = np.arange(BANDS)[:, None]
        for at in range(0, len(padded) - 1, SLICE):
            low = _minima(padded[at : at + SLICE + 1], real[at : at + SLICE + 1])
            band, window = np.nonzero(self.ends[bands, (low & np.uint64(0xFFFF)).astype(np.int64)])
            for b, value, w in zip(band.tolist(), low[band, window].tolist(), window.tolist(), strict=True):
                if names := self.table.get((b, value)):
                    found[owner[at + w]] |= names
        return found

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        return self.scan_all([text])[0]

    def scan_all(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
        low = [t.lower() for t in texts]
        for i, (t, x) in enumerate(zip(texts, low, strict=True)):
            if len(x) != len(t):  # a letter that grows in lower case would move offsets
                low[i] = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
        shingles = []
        for x in low:
            words = _WORD.findall(x)
            shingles.append(_combined(np.array([self._hash(w) for w in words], np.uint64)) if len(words) >= SHINGLE else np.zeros(0, np.uint64))
        return [self._verified(x, s, names) if names else [] for x, s, names in zip(low, shingles, self.retrieve(shingles), strict=True)]

    def _verified(self, low: str, s: np.ndarray, names: set[str]) -> list[tuple[str, int, int, float]]:
        spans: list[tuple[int, int]] | None = None
        out = []
        for name in sorted(names):
            own, wide = self.templates[name], int(self.lengths[name] * SPREAD) + 1
            at = np.flatnonzero(np.isin(s, own))
            i = 0
            while i < len(at):
                stretch = at[i : np.searchsorted(at, at[i] + wide)]
                share = len(np.unique(s[stretch])) / len(own)
                if share < self.threshold or name in self.needs and not np.isin(self.needs[name], s[stretch]).all():
                    i += 1
                    continue
                # The first places that hold all of these shingles, without repeats before or after.
                stop = int(np.unique(s[stretch], return_index=True)[1].max()) + 1
                go = stop - 1 - int(np.unique(s[stretch[:stop]][::-1], return_index=True)[1].max())
                if spans is None:
                    spans = [m.span() for m in _WORD.finditer(low)]
                out.append((name, spans[stretch[go]][0], spans[stretch[stop - 1] + SHINGLE - 1][1], share))
                i += stop
        return out

    def _hash(self, word: str) -> int:
        found = self.hashes.get(word)
        if found is None:
            if self.size > WORD_BYTES:
                self.hashes.clear()
                self.size = 0
            self.size += len(word) + 150
            found = self.hashes[word] = xxhash.xxh64_intdigest(word)
        return found


def _together(texts: Iterator[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Texts in groups of about ``TOGETHER`` shingles."""
    held: list[tuple[int, str]] = []
    size = 0
    for doc, text in texts:
        held.append((doc, text))
        size += len(text) // 6 + STEP
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """One row per match: ``doc_id, license, start, end`` (code points), ``containment``."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        every = ((i, t.as_py()) for batch in batches for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for group in _together(every):
            found = scanner.scan_all([text for _, text in group])
            rows = [(doc, *m) for (doc, _), own in zip(group, found, strict=True) for m in own]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)],
                    names=["doc_id", "license", "start", "end", "containment"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, _OUT)
