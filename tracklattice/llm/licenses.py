"""License scans: exact set-similarity join of text blocks (lines) and passages with license templates.

Tokens are ordered by their frequency in the whole corpus, rarest first. A block holds a template T if it has at least
o = ceil(threshold * |T|) of T's distinct tokens. Then it has one of T's first |T| - o + 1 tokens in that order (prefix
filter), at least o words (length filter), and after its first token of T's prefix enough of T is left to reach o
(positional filter). What passes is counted exactly, so every block that meets the threshold is found and no other.
Templates are few and fixed; they are the broadcast side, and documents are only scanned: nothing is shuffled but one
count for each template token.

Notices are mostly wrapped, so that no line holds a whole one. Beside the blocks, passages are found wherever lines end:
a passage of T is where every run of ceil(|T's words| / threshold) consecutive words has at least o of T's distinct
tokens, so as many words may stand between T's as T may lack. All runs are counted, by differences over the words' places, in texts
that have a word of T's prefix (a run without one can't reach o).

Fixed phrases are found beside the templates: places where their words stand consecutively.

Defined cases: null and empty texts have no words and no matches; an empty table gives an empty result; repeated rows
each get their matches; a text's lines may be of any length; passages don't cross from one text to the next.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklattice.llm import textkernel as tk

# Phrases and their labels.
PHRASES: dict[str, str] = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Public license notices and their labels.
TEMPLATES: list[tuple[str, str]] = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", 'you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("apache", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
THRESHOLD = 0.9
MATCHES = "doc_id long, n_words long, places array<struct<label:string,start:long>>, blocks array<struct<label:string,start:long,end:long,containment:double>>, passages array<struct<label:string,start:long,end:long,containment:double>>"
_PLACE = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
_BLOCK = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))
_MATCHES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", _PLACE), ("blocks", _BLOCK), ("passages", _BLOCK)])
_INSIDE = np.zeros(256, bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True


def tokens(text: str) -> list[str]:
    """Words of a text: letters A-Z lowered; runs of digits, letters and everything beyond ASCII."""
    data = np.frombuffer(text.encode(), np.uint8)
    low = tk.LOWER[data]
    starts, ends = tk.runs(_INSIDE[low], np.array([0, len(data)]))
    raw = low.tobytes()
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Vocabulary:
    """Numbers of the words that templates and phrases have."""

    def __init__(self, texts: list[str]):
        self.words = sorted({w for t in texts for w in tokens(t)}, key=lambda w: w.encode())
        raw = [w.encode() for w in self.words]
        self.lengths = np.array([len(w) for w in raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        hashes = tk.hash_ranges(self.data, self.starts, self.starts + self.lengths)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.number = {w: i for i, w in enumerate(self.words)}

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for other words: found by its hash, taken if its bytes are the same."""
        out = np.full(len(starts), -1)
        if not len(self.hashes) or not len(starts):
            return out
        hashes = tk.hash_ranges(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        number = self.order[at]
        hit = np.flatnonzero((self.hashes[at] == hashes) & (self.lengths[number] == ends - starts))
        hit = hit[tk.same_ranges(np.concatenate([data, self.data]), starts[hit], len(data) + self.starts[number[hit]], self.lengths[number[hit]])]
        out[hit] = number[hit]
        return out


def _scan(batch: pa.RecordBatch, vocabulary: Vocabulary):
    """(first row, end row, vocabulary number of each word, first word of each text, block of each word) by chunk."""
    for a, b, data, offsets in tk.chunks(batch, "text"):
        low = tk.LOWER[data]
        starts, ends = tk.runs(_INSIDE[low], offsets)
        first = np.searchsorted(starts, offsets)
        numbers = vocabulary.find(low, starts, ends)
        text = np.repeat(np.arange(b - a), np.diff(first))
        block = np.cumsum(low == 0x0A)[starts] + text if len(low) else starts
        yield a, b, numbers, first, block


def frequencies(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often each word of the vocabulary occurs in all of ``docs``' texts."""
    schema = pa.schema([("number", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.words) + 1, np.int64)
        for batch in batches:
            for _, _, numbers, _, _ in _scan(batch, vocabulary):
                total += np.bincount(numbers + 1, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary.words))), pa.array(total[1:])], schema=schema)

    out = np.zeros(len(vocabulary.words), np.int64)
    for r in docs.mapInArrow(tk.released(run), "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).collect():
        out[r["number"]] = r["n"]
    return out


class Templates:
    """Templates as token sets in the corpus' order of frequency, with their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], vocabulary: Vocabulary, counts: np.ndarray, threshold: float):
        self.labels = [label for label, _ in templates]
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
        self.sets = [sorted({vocabulary.number[w] for w in tokens(t)}, key=lambda i: rank[i]) for _, t in templates]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.prefix = np.zeros((len(templates), len(counts) + 1), bool)
        for t, (s, o) in enumerate(zip(self.sets, self.need, strict=True)):
            self.prefix[t, s[: len(s) - o + 1]] = True
        self.any_prefix = self.prefix.any(axis=0)
        self.span = [math.ceil(len(tokens(t)) / threshold - 1e-9) for _, t in templates]
        self.member = np.zeros_like(self.prefix)
        for t, s in enumerate(self.sets):
            self.member[t, s] = True
        self.position = [{w: i for i, w in enumerate(s)} for s in self.sets]

    def matches(self, numbers: np.ndarray, block: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, first word, end word, containment) of every block that holds a template."""
        found = []
        hits = np.flatnonzero(self.any_prefix[numbers])
        for of in np.unique(block[hits]).tolist():
            a, b = np.searchsorted(block, [of, of + 1]).tolist()
            have = set(numbers[a:b].tolist()) - {-1}
            for t, (s, need) in enumerate(zip(self.sets, self.need, strict=True)):
                if b - a < need:
                    continue
                first = min((self.position[t][w] for w in have if self.prefix[t, w]), default=None)
                if first is None or len(s) - first < need:
                    continue
                both = len(have.intersection(s))
                if both >= need:
                    found.append((t, a, b, both / len(s)))
        return found

    def passages(self, numbers: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, first word, end word, best containment) of every passage of a text that holds a template."""
        found = []
        hits = np.flatnonzero(self.any_prefix[numbers])
        for t, (s, need, span) in enumerate(zip(self.sets, self.need, self.span, strict=True)):
            texts = np.unique(np.searchsorted(first, hits[self.prefix[t, numbers[hits]]], "right") - 1)
            for a, b in zip(first[texts].tolist(), first[texts + 1].tolist(), strict=True):
                at = np.flatnonzero(self.member[t, numbers[a:b]])
                if len(at) < need:
                    continue
                # A word counts once in a run: where it stands first, for the runs that begin after it stood last.
                word = numbers[a + at]
                order = np.argsort(word, kind="stable")
                since = np.zeros(len(at), np.int64)
                same = np.flatnonzero(word[order][1:] == word[order][:-1])
                since[order[same + 1]] = at[order[same]] + 1
                change = np.zeros(b - a + 1, np.int64)
                np.add.at(change, np.maximum(since, at - span + 1), 1)
                np.add.at(change, at + 1, -1)
                held = np.cumsum(change)
                begins, ends = tk.runs(held >= need, np.array([0, len(held)]))
                for x, y in zip(begins.tolist(), ends.tolist(), strict=True):
                    inside = at[np.searchsorted(at, x) : np.searchsorted(at, y - 1 + span)]
                    found.append((t, a + int(inside[0]), a + int(inside[-1]) + 1, int(held[x:y].max()) / len(s)))
        return found


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, places, blocks, passages) of every row: phrases' places by their first word, lines and passages that hold a template."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    vocabulary = Vocabulary([t for _, t in templates] + list(phrases))
    ready = Templates(templates, vocabulary, frequencies(rows.select("text"), vocabulary), threshold)
    wanted = [([vocabulary.number[w] for w in tokens(p)], label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, numbers, first, block in _scan(batch, vocabulary):
                places: list[list] = [[] for _ in range(b - a)]
                blocks: list[list] = [[] for _ in range(b - a)]
                passages: list[list] = [[] for _ in range(b - a)]
                for ids, label in wanted:
                    n = len(numbers) - len(ids) + 1
                    if n <= 0:
                        continue
                    at = np.flatnonzero(np.logical_and.reduce([numbers[j : j + n] == w for j, w in enumerate(ids)]))
                    of = np.searchsorted(first, at, "right") - 1
                    for i, x in zip(of.tolist(), at.tolist(), strict=True):
                        if x + len(ids) <= first[i + 1]:
                            places[i].append({"label": label, "start": x - int(first[i])})
                for out, matches in ((blocks, ready.matches(numbers, block)), (passages, ready.passages(numbers, first))):
                    for t, x, y, containment in matches:
                        i = int(np.searchsorted(first, x, "right")) - 1
                        out[i].append({"label": ready.labels[t], "start": x - int(first[i]), "end": y - int(first[i]), "containment": containment})
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(first)), pa.array(places, _PLACE), pa.array(blocks, _BLOCK), pa.array(passages, _BLOCK)], schema=_MATCHES)

    return rows.mapInArrow(tk.released(run), MATCHES)


def digest(found: DataFrame) -> DataFrame:
    """Counts, first and last place, labels and score. The score is 1 with any phrase, else the best containment."""
    base, held = F.col("places.label"), F.concat("blocks", "passages")
    starts = F.col("places.start")
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    best = F.coalesce(F.array_max(held["containment"]), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.concat(base, held["label"])).alias("labels"), F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"))
