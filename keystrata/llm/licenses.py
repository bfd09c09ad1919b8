"""License scan by conditional compression.

Text that repeats a license's wording compresses far better when that wording is given as a raw zstandard
dictionary. Blocks of words around a hint are aligned with every template whose words they can hold; each place
with few enough differences is compressed with and without its template, and of places that overlap the one that
agrees in the most words stays, by the larger reduction where these are equal.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

# Identifiers and usual short notices of public licenses.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "BSD-2-Clause": ["Licensed under the 2-Clause BSD License."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license.", "Licensed under the 3-Clause BSD License."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "This work is dedicated to the public domain."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "LicenseRef-reserved": ["All rights reserved."],
}
#: Share of a template's words that may differ.
MOST = 0.2
WORD = re.compile(r"\w+(?:[.\-]\w+)*")


def _packer(dictionary: bytes | None) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    return zstandard.ZstdCompressor(level=9, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def allowed(wanted: list[str], most: float = MOST) -> int:
    """Differences that a notice of a template of these words may have."""
    return int(most * len(wanted) + 1e-9)


def hint_words(templates: dict[str, list[str]], most: float = MOST) -> set[str]:
    """Words of which every notice holds one: of each template the longest, one more than may be missing."""
    out = set()
    for text in (t for texts in templates.values() for t in texts):
        wanted = [w.lower() for w in WORD.findall(text)]
        counts, taken = Counter(wanted), 0
        for word in sorted(counts, key=lambda w: (-len(w), w)):
            if taken > allowed(wanted, most):
                break
            out.add(word)
            taken += counts[word]
    return out


def folded(text: str) -> str:
    return " ".join(text.split())


class Scanner:
    """find(text): (start, end, license, reduction, differences, exact) of the notices in a text, by characters."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, most_differences: float = MOST):
        self.plain, self.codes, self.templates = _packer(None), {}, []
        for name, text in ((name, t) for name, texts in templates.items() for t in texts):
            wanted = [w.lower() for w in WORD.findall(text)]
            if wanted:
                codes = [self.codes.setdefault(w, len(self.codes) + 1) for w in wanted]
                least = Counter(codes)
                self.templates.append((name, folded(text).rstrip("."), codes, least, allowed(wanted, most_differences), _packer(folded(text).lower().encode())))
        self.hints = np.zeros(len(self.codes) + 1, bool)
        self.hints[[self.codes[w] for w in hint_words(templates, most_differences)]] = True
        #: Words of the longest notice: no word of a notice is further from its hint.
        self.reach = max((len(codes) + most for _, _, codes, _, most, _ in self.templates), default=0)

    def blocks(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of words, line breaks or not, within reach of a hint; those that overlap are one."""
        low = high = -1
        for at in np.flatnonzero(self.hints[codes]).tolist():
            begin, end = max(0, at - self.reach), min(len(codes), at + self.reach + 1)
            if begin < high:
                high = end
            else:
                if high >= 0:
                    yield low, high
                low, high = begin, end
        if high >= 0:
            yield low, high

    @staticmethod
    def places(wanted: list[int], most: int, block: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first word, word after the last, differences) of the places of a block that differ least from the template.

        Differences are words of the template that the place lacks and words of the place that the template lacks.
        """
        n = len(block)
        unit = n + 1
        steps = np.arange(n + 1) * unit
        best = n - np.arange(n + 1)  # differences * unit + n - start: the least differences, then the last start
        for code in wanted:
            row = best + unit
            row[1:] = np.minimum(row[1:], np.where(block == code, best[:-1], row[1:]))
            best = np.minimum.accumulate(row - steps) + steps
        found = best // unit
        near = found <= most
        near[1:] &= found[1:] <= found[:-1]
        near[:-1] &= found[:-1] <= found[1:]
        for end in np.flatnonzero(near).tolist():
            start = n - int(best[end] % unit)
            if start < end:
                yield start, end, int(found[end])

    def notices(self, codes: np.ndarray, span_text: Callable) -> list[tuple]:
        """All notices of a block that don't overlap: (first word, word after the last, template, reduction, differences)."""
        out, waiting = [], [(0, len(codes))]
        while waiting:
            low, high = waiting.pop()
            block = codes[low:high]
            there = Counter(block[block > 0].tolist())
            found = []
            for k, (_, _, wanted, least, most, pack) in enumerate(self.templates):
                if sum(min(n, there[c]) for c, n in least.items()) < len(wanted) - most:
                    continue
                for start, end, n in self.places(wanted, most, block):
                    data = folded(span_text(low + start, low + end)).lower().encode()
                    gain = len(self.plain.compress(data)) - len(pack.compress(data))
                    same = (end - start + len(wanted) - n) // 2
                    found.append((n - same, n, -gain, k, low + start, low + end))
            chosen: list[tuple] = []
            taken = np.zeros(high - low, bool)
            for _, n, loss, k, start, end in sorted(found):
                if not taken[start - low : end - low].any():
                    taken[start - low : end - low] = True
                    chosen.append((start, end, k, -loss, n))
            if chosen:  # a place that overlapped a better one may hold a notice without the common words
                edges = [low, *(e for c in sorted(chosen) for e in c[:2]), high]
                waiting += [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]
            out += chosen
        return sorted(out)

    def find(self, text: str) -> Iterator[tuple]:
        codes, starts = array("i"), array("q")
        for match in WORD.finditer(text):
            codes.append(self.codes.get(match.group().lower(), 0))
            starts.append(match.start())
        if not codes:
            return
        codes = np.frombuffer(codes, np.int32)

        def span(first: int, after: int) -> tuple[int, int]:
            return starts[first], WORD.match(text, starts[after - 1]).end()

        for low, high in self.blocks(codes):
            for first, after, k, gain, n in self.notices(codes[low:high], lambda a, b, low=low: text[slice(*span(low + a, low + b))]):
                name, wording = self.templates[k][:2]
                begin, end = span(low + first, low + after)
                yield begin, end, name, gain, n, n == 0 and folded(text[begin:end]) == wording


def license_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """doc_id, start, end (characters), license, reduction (bytes), differences (words) and exact, for each notice.

    At most a fifth of a template's words may differ; line breaks and other white space don't count. Notices of a
    text don't overlap; of places that agree equally the larger reduction counts, then the earlier template. Other
    columns are not read. Null and empty texts have no notice; rows with null ids and repeated rows are scanned like
    any; an empty table or no templates give no rows. Texts of any length are scanned whole, block by block. No
    shuffle: texts without a hint, a word of the templates of which each notice must hold one, are dropped by a
    filter first.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("reduction", pa.int64()), ("differences", pa.int64()), ("exact", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        rows = ((doc_id, *found) for batch in batches for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for found in scanner.find(text.as_py()))
        return in_batches(rows, schema)

    hints = "|".join(re.escape(w) for w in sorted(hint_words(templates)))
    hinted = docs.where(F.col(text_col).rlike(f"(?iu){hints}") if hints else F.lit(False)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return hinted.mapInArrow(scan, "doc_id long, start long, end long, license string, reduction long, differences long, exact boolean")
