"""License scans: an index of templates' rarest words, then banded alignment.

Texts and templates are taken as lower-case words of letters and digits. A match has at least LEAST_COVERAGE of a template's
words, so of any places that are more than may be missing, one is matched: the words at the rarest such places of
each template (rarest over all templates) are its index entries, and no passage that the alignment would accept escapes them.
Where words name the license (KEYS, ids of SPDX lines) all must be matched, or half of their places in a whole text, and the
rarest of a notice is its entry. Candidates of one template that would begin within the band of each other are one. Those with enough words in
common are aligned with the template inside the band, and the longest common subsequence gives the matched share of the
template and the matched span of the text.

Templates are notices, opening passages, SPDX lines and the whole texts in license_texts. Whole texts of AGPL-3.0, CC-BY-4.0
and the other CC 4.0 licenses weren't at hand: theirs are made of the nearest text with the name put in.

What a task needs of the templates is fixed by their list, not by the corpus. NULL and empty texts have no match.
Rows are independent, so repeated rows and NULL ids are handled like others; of overlapping matches the one with
more matched words stays, ties go to the name first in order (of SPDX lines only the ids count as overlapping). An empty table gives an empty result; only doc_id and text
are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from importlib.resources import files
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from holdfast.llm.hashing import RangeHashes, mixed
from holdfast.llm.tables import map_batches, text_slices

LEAST_COVERAGE = 0.75
WORD = re.compile(r"[a-z0-9]+")
# Usual notices, and opening passages of the licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
     "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
     "merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
     "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
     "conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    *((f"Apache-{v}", f"Licensed under the Apache License, Version {v}.") for v in ("1.0", "1.1")),
    *((name, form.format(title, version)) for name, title, version in (
        ("GPL-1.0", "General", "1"), ("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.0", "Library General", "2"),
        ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3"),
    ) for form in (
        "This work is licensed under the GNU {} Public License, version {}.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License "
        "as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License "
        "version {} as published by the Free Software Foundation.",
    )),
    *((f"CC-{kind}-{v}", f"Licensed under CC {kind} {v}.") for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")
      for v in ("1.0", "2.0", "2.5", "3.0", "4.0")),
    *((f"CC-{kind}-{v}", f"This work is licensed under a Creative Commons {title} {v} International License.") for kind, title in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for v in ("3.0", "4.0")),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file "
     "except in compliance with the License."),
    *((f"EPL-{v}", f"This program and the accompanying materials are made available under the terms of the Eclipse Public License {form}{v}")
      for v in ("1.0", "2.0") for form in ("", "v")),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD", "Released under the BSD License."),
    ("ISC", "Released under the ISC License."),
)
SPDX = "SPDX-License-Identifier: "
SPDX_IDS = (
    "MIT ISC Unlicense CC0-1.0 BSD-2-Clause BSD-3-Clause Apache-1.0 Apache-1.1 Apache-2.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 GPL-1.0 GPL-2.0 "
    "GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-3.0".split()
) + sorted({name for name, _ in TEMPLATES if name.startswith("CC-BY")})
# Words that name a license where its templates have them.
KEYS = {
    "Apache-1.0": "apache 1 0", "Apache-1.1": "apache 1", "Apache-2.0": "apache 2", "MIT": "mit", "ISC": "isc", "BSD": "bsd", "MPL-1.1": "mozilla 1", "MPL-2.0": "mozilla 2",
    "EPL-1.0": "eclipse 1 v1", "EPL-2.0": "eclipse 2 v2", "CC0-1.0": "cc0", "GPL-1.0": "gnu general 1", "GPL-2.0": "gnu general 2", "GPL-3.0": "gnu general 3",
    "LGPL-2.0": "gnu library 2", "LGPL-2.1": "gnu lesser 2", "LGPL-3.0": "gnu lesser 3", "AGPL-3.0": "gnu affero 3", "Unlicense": "unencumbered",
} | {name: "cc by nc sa nd attribution sharealike noncommercial noderivatives " + " ".join(WORD.findall(name.lower())[-2:]) for name in SPDX_IDS if name.startswith("CC-BY")}
WHOLE_KEYS = {
    "AGPL-3.0": "affero", "LGPL-2.0": "library", "LGPL-2.1": "lesser", "LGPL-3.0": "lesser", "CC-BY-SA-4.0": "sharealike", "CC-BY-ND-4.0": "noderivatives",
    "CC-BY-NC-4.0": "noncommercial", "CC-BY-NC-SA-4.0": "noncommercial sharealike", "CC-BY-NC-ND-4.0": "noncommercial noderivatives",
}
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(97, 123)]] = True


@dataclass
class Words:
    """Word hashes of joined texts, with each word's place in bytes and the text it belongs to."""

    hashes: np.ndarray
    first: np.ndarray
    last: np.ndarray
    owner: np.ndarray


def words_of(texts: list[str | None]) -> Words:
    parts = [(t or "").encode().lower() for t in texts]
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    word = _PLAIN[data]
    first = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]]))
    last = np.flatnonzero(word & np.concatenate([~word[1:], [True]])) + 1
    ends = np.cumsum([len(p) + 1 for p in parts])
    owner = np.searchsorted(ends, first, side="right")
    base = np.concatenate([[0], ends])[owner]
    return Words(RangeHashes(data).of(first, last) ^ mixed((last - first).astype(np.uint64)), first - base, last - base, owner)


def whole_texts() -> list[tuple[str, str]]:
    folder = files("holdfast.llm") / "license_texts"  # on workers inside the shipped archive
    texts = {p.name.removesuffix(".txt"): p.read_text(encoding="utf-8") for p in sorted(folder.iterdir(), key=lambda p: p.name)}
    found = list(texts.items())
    found.append(("AGPL-3.0", re.sub(r"(?i)GNU\s+General", "GNU Affero General", texts["GPL-3.0"])))
    for kind, title in (("", ""), ("-ND", "NoDerivatives"), ("-NC", "NonCommercial"), ("-NC-SA", "NonCommercial-ShareAlike"), ("-NC-ND", "NonCommercial-NoDerivatives")):
        found.append((f"CC-BY{kind}-4.0", texts["CC-BY-SA-4.0"].replace("ShareAlike", title)))
    return found


@dataclass
class Template:
    name: str
    hashes: np.ndarray
    keys: list[np.ndarray]  # places of each word that names the license
    key_share: float
    own: int  # first word that counts in overlaps
    entries: np.ndarray  # places of the words in the index
    kinds: np.ndarray  # distinct words, and how often each occurs
    counts: np.ndarray


@lru_cache
def known() -> tuple[list[Template], np.ndarray, np.ndarray]:
    """Templates; sorted hashes of their index entries and, beside them, (template, place)."""
    rows = [(name, text, KEYS.get(name, "").split(), 1.0, 0) for name, text in TEMPLATES]
    for name in SPDX_IDS:
        lasts = ("", "-only", "-or-later") if "GPL" in name else ("",)
        rows += [(name, SPDX + name + last, WORD.findall((name + last).lower()), 1.0, 3) for last in lasts]
    rows += [(name, text, WHOLE_KEYS.get(name, "").split(), 0.5, 0) for name, text in whole_texts()]
    words = [WORD.findall(text.lower()) for _, text, *_ in rows]
    often: dict[str, int] = {}
    for template in words:
        for word in set(template):
            often[word] = often.get(word, 0) + template.count(word)
    templates, hashes, places = [], [], []
    for number, ((name, text, keys, share, own), names) in enumerate(zip(rows, words)):
        made = words_of([text]).hashes
        at = [np.array([k for k, w in enumerate(names) if w == key and k >= own]) for key in dict.fromkeys(keys)]
        at = [x for x in at if len(x)]
        alone = [int(x[0]) for x in at if len(x) == 1] if share == 1 else []
        if alone:
            entries = np.array([min(alone, key=lambda k: (often[names[k]], k))])
        else:
            free = len(names) - ceil(LEAST_COVERAGE * len(names))
            entries = np.array(sorted(range(len(names)), key=lambda k: (often[names[k]], k))[: free + 1])
        templates.append(Template(name, made, at, share, own, entries, *np.unique(made, return_counts=True)))
        hashes.append(made[entries])
        places.append(np.column_stack([np.full(len(entries), number), entries]))
    hashes, places = np.concatenate(hashes), np.concatenate(places)
    order = np.argsort(hashes, kind="stable")
    return templates, hashes[order], places[order]


def index() -> tuple[list[tuple[str, np.ndarray]], np.ndarray, np.ndarray]:
    """Notices and opening passages (name, word hashes); the index of all templates."""
    templates, hashes, places = known()
    return [(t.name, t.hashes) for t in templates[: len(TEMPLATES)]], hashes, places


def band_of(length: int) -> int:
    return max(2, length // 8)


def _aligned(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Matched places in template and text: longest common subsequence near the diagonal `shift`."""
    width = 2 * band + 1
    best = np.zeros((len(template) + 1, width + 2), np.int32)
    padded = np.zeros(len(template) + width, np.uint64)  # text from place shift - band on
    inside = np.zeros(len(padded), bool)
    low, high = max(0, shift - band), min(len(text), shift - band + len(padded))
    if low < high:
        padded[low - shift + band : high - shift + band] = text[low:high]
        inside[low - shift + band : high - shift + band] = True
    for i in range(len(template)):
        equal = (padded[i : i + width] == template[i]) & inside[i : i + width]
        row = np.maximum(best[i, 2:], best[i, 1:-1] + equal)
        best[i + 1, 1:-1] = np.maximum.accumulate(row)
    i, c, found = len(template), width, []
    while i > 0 and c > 0 and best[i, c]:
        left, above = best[i, c - 1], best[i - 1, c + 1]
        place = i + c - 2
        if inside[place] and padded[place] == template[i - 1] and best[i - 1, c] + 1 > max(left, above):
            found.append((i - 1, place + shift - band))
            i -= 1
        elif left >= above:
            c -= 1
        else:
            i, c = i - 1, c + 1
    places = np.array(found[::-1], np.int64).reshape(-1, 2)
    return places[:, 0], places[:, 1]


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Matched words, first and last matched place in text."""
    places = _aligned(template, text, shift, band)[1]
    return (len(places), int(places[0]), int(places[-1])) if len(places) else (0, -1, -1)


def matches(hashes: np.ndarray, kept: np.ndarray, at: np.ndarray) -> list[tuple[str, int, int, int, float]]:
    """(license, first word, last word, matched words, coverage) of one text, from its words that are in the index."""
    templates, entries, places = known()
    left, right = np.searchsorted(entries, kept, side="left"), np.searchsorted(entries, kept, side="right")
    reach = right - left
    hit = np.repeat(left - np.cumsum(reach) + reach, reach) + np.arange(reach.sum())
    shifts = np.repeat(at, reach) - places[hit, 1]
    order = np.lexsort((shifts, places[hit, 0]))
    numbers, shifts = places[hit, 0][order], shifts[order]
    found = []
    for number in np.unique(numbers).tolist():
        t = templates[number]
        length, need = len(t.hashes), LEAST_COVERAGE * len(t.hashes)
        if len(hashes) < need:
            continue
        band, last = band_of(length), None
        kind = np.minimum(np.searchsorted(t.kinds, hashes), len(t.kinds) - 1)
        kind = np.where(t.kinds[kind] == hashes, kind, len(t.kinds))
        for shift in np.unique(shifts[numbers == number]).tolist():
            if last is not None and shift - last <= band:
                continue
            last = shift
            base, end = max(0, shift - 2 * band), shift + length + 4 * band
            common = np.bincount(kind[base:end], minlength=len(t.kinds) + 1)[:-1]
            if np.minimum(common, t.counts).sum() < need:
                continue
            own, there = _aligned(t.hashes, hashes[base:end], shift - base, 3 * band)
            if len(own) < need or any(np.isin(key, own).sum() < t.key_share * len(key) for key in t.keys):
                continue
            first = int(there[np.searchsorted(own, t.own)])
            found.append((t.name, base + int(there[0]), base + int(there[-1]), len(own), len(own) / length, base + first))
    chosen: list[tuple] = []
    for match in sorted(found, key=lambda m: (-m[3], m[0], m[1])):
        if all(match[2] < c[5] or match[5] > c[2] for c in chosen):
            chosen.append(match)
    return [m[:5] for m in sorted(chosen, key=lambda m: (m[1], m[5]))]


def scan(docs: DataFrame) -> DataFrame:
    """One row per match: doc_id, license, span in code points (end exclusive), matched words and coverage."""

    def run(batch: pa.RecordBatch):
        _, entries, _ = known()
        entries = np.unique(entries)
        for part in text_slices(batch, 1 << 20):
            texts, ids = part.column("text").to_pylist(), part.column("doc_id").to_pylist()
            words = words_of(texts)
            at = np.flatnonzero(np.isin(words.hashes, entries))
            kept = words.hashes[at]
            owner = words.owner[at]
            bounds = np.searchsorted(words.owner, np.arange(len(texts) + 1))
            rows = []
            for k in np.unique(owner).tolist():
                begin, end = bounds[k], bounds[k + 1]
                mine = slice(*np.searchsorted(owner, [k, k + 1]))
                for name, first, last, n, coverage in matches(words.hashes[begin:end], kept[mine], at[mine] - begin):
                    data = texts[k].encode()
                    span = (words.first[begin + first], words.last[begin + last])
                    low, high = (len(data[: int(s)].decode()) for s in span)
                    rows.append((ids[k], name, low, high, n, round(coverage, 6)))
            if rows:
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "license", "span_start", "span_end", "matched_words", "coverage"]
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_batches(rows, run, "doc_id bigint, license string, span_start bigint, span_end bigint, matched_words bigint, coverage double")
