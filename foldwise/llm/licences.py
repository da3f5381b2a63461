"""Licence notices in files, found through a positional index of rare template words."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foldwise.llm.columns import id_type, pair

# Phrases that name a licence, and the openings of well-known notices as their publishers word them.
PHRASES = {
    "mit": "mit license",
    "apache": "apache license",
    "gpl": "general public license",
}
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction"
    ),
    "mit-release": "Released under the MIT License.",
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: What a place must hold, word for word, before a template counts.
KEY_PHRASES = {
    "apache-2.0": ["apache license version 2 0"],
    "apache-2.0-header": ["apache license version 2 0", "in compliance with the license"],
    "bsd": ["redistribution and use in source and binary forms"],
    "cc-by-nc-4.0": ["cc by nc 4 0"],
    "gpl-3.0": ["gnu general public license version 3"],
    "gpl-notice": ["gnu general public license", "free software foundation"],
    "isc": ["permission to use copy modify and or distribute this software"],
    "mit-notice": ["permission is hereby granted free of charge"],
    "mit-release": ["under the mit license"],
    "mpl-2.0": ["mozilla public license v 2 0"],
    "unlicense": ["free and unencumbered software"],
}

#: A-Z becomes a-z; other ASCII bytes that are neither letter nor digit become spaces.
WORDS = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


def places(words: list[bytes], phrase: list[bytes], starts: list[int]) -> list[int]:
    """Of the given places of the phrase's first word, those where the whole phrase stands."""
    return [p for p in starts if words[p : p + len(phrase)] == phrase]


class LicenceIndex:
    """Positional postings of every template word, with key phrases and their places in the templates.

    ``rarity`` weighs a word. A scan looks up, for each template, the ``lookups`` rarest of its words that the file holds, and
    intersects their postings by relative position: each occurrence votes for the place where the template would start.
    """

    def __init__(
        self, templates: dict[str, str], key_phrases: dict[str, list[str]], phrases: dict[str, str],
        rarity: dict[bytes, float] | None = None, lookups: int = 8, slack: int = 3, least: float = 0.5,
    ):
        self.names = sorted(templates)
        self.runs = [words_of(templates[n].encode()) for n in self.names]
        self.keys = []
        for n, run in zip(self.names, self.runs):
            keys = [words_of(k.encode()) for k in key_phrases.get(n, [])]
            places_of = [next((p for p in range(len(run)) if run[p : p + len(k)] == k), None) for k in keys]
            if None in places_of:
                raise ValueError(f"template {n} lacks one of its key phrases")
            self.keys.append(list(zip(keys, places_of)))
        self.phrases = sorted((label, words_of(p.encode())) for label, p in phrases.items())
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, run in enumerate(self.runs):
            for at, w in enumerate(run):
                self.postings[w].append((t, at))
        self.wanted = set(self.postings) | {w for _, p in self.phrases for w in p}
        self.rarity = {w: (rarity or {}).get(w, math.inf) for w in self.wanted}
        self.lookups, self.slack, self.least = lookups, slack, least

    def scan(self, words: list[bytes]) -> tuple[list[int], list[str], list[str], float]:
        """Phrase places, phrase labels, labels of verified templates, and the best share of a verified template's words that
        stand at their relative position (1 for a phrase alone)."""
        where: dict[bytes, list[int]] = defaultdict(list)
        wanted = self.wanted
        for at, w in enumerate(words):
            if w in wanted:
                where[w].append(at)
        if not where:
            return [], [], [], 0.0
        starts, labels = [], []
        for label, phrase in self.phrases:
            found = places(words, phrase, where.get(phrase[0], []))
            starts += found
            labels += [label] if found else []
        votes: dict[tuple[int, int], int] = defaultdict(int)
        known = sorted((w for w in where if w in self.postings), key=lambda w: (-self.rarity[w], w))
        used: dict[int, set[bytes]] = defaultdict(set)
        for w in known:
            for t, at in self.postings[w]:
                if w in used[t] or len(used[t]) < self.lookups:
                    used[t].add(w)
                    for p in where[w]:
                        votes[t, p - at] += 1
        best: dict[int, float] = {}
        for (t, begin), n in votes.items():
            if n < min(2, len(self.runs[t])):
                continue
            if all(self._stands(words, key, begin + at) for key, at in self.keys[t]):
                share = self._share(words, self.runs[t], begin)
                if share >= self.least:
                    best[t] = max(best.get(t, 0.0), share)
        score = max(best.values(), default=1.0 if starts else 0.0)
        return starts, labels, [self.names[t] for t in best], score

    def _stands(self, words: list[bytes], key: list[bytes], at: int) -> bool:
        return any(words[p : p + len(key)] == key for p in range(max(0, at - self.slack), at + self.slack + 1))

    def _share(self, words: list[bytes], run: list[bytes], begin: int) -> float:
        low = max(0, -begin)
        here = words[begin + low : begin + len(run)]
        return sum(a == b for a, b in zip(run[low:], here)) / len(run)


def licence_word_rarity(records: DataFrame, words: set[bytes], id: str = "entry_id", body: str = "body") -> dict[bytes, float]:
    """Inverse document frequency, over all records, of the words of the templates: counts are added up in tasks, and one
    number per template word reaches the driver."""
    source = pair(records, id, body).select(F.col("body").cast("binary").alias("body"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = 0, defaultdict(int)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += 1
                for w in words.intersection(words_of(text)):
                    held[w] += 1
        rows = [(b"", total), *held.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"]
        )

    counts = source.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r["word"]): r["n"] for r in counts}
    total = found.pop(b"", 0)
    return {w: math.log((1 + total) / (1 + found.get(w, 0))) for w in words}


def scan_licences(
    records: DataFrame,
    id: str = "entry_id",
    body: str = "body",
    templates: dict[str, str] | None = None,
    key_phrases: dict[str, list[str]] | None = None,
    phrases: dict[str, str] | None = None,
    lookups: int = 8,
) -> DataFrame:
    """``(entry_id, n_words, places array, phrase_labels array, template_labels array, score)``, one row per record.

    ``records`` are script files or parsed writeup entries: any rows with an id and a text. ``places`` are the word positions
    of the phrases; ``template_labels`` the templates found by the rarest licence words of the file (rarity over all
    records), their postings intersected by relative position, and their key phrases verified. ``score`` is the best share
    of such a template's words found in place, 1 for a bare phrase, 0 without either. NULL and empty texts have no words;
    repeated rows and NULL ids each keep their row.
    """
    templates = TEMPLATES if templates is None else templates
    key_phrases = KEY_PHRASES if key_phrases is None else key_phrases
    phrases = PHRASES if phrases is None else phrases
    words = set(LicenceIndex(templates, key_phrases, phrases).postings)
    rarity = licence_word_rarity(records, words, id, body)
    source = pair(records, id, body).withColumn("body", F.col("body").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LicenceIndex(templates, key_phrases, phrases, rarity, lookups)
        texts = pa.list_(pa.string())
        for batch in batches:
            sizes, found = [], []
            for text in batch.column(1).to_pylist():
                split = words_of(text)
                sizes.append(len(split))
                found.append(index.scan(split))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()),
                    pa.array([sorted(f[0]) for f in found], pa.list_(pa.int64())),
                    pa.array([f[1] for f in found], texts), pa.array([sorted(f[2]) for f in found], texts),
                    pa.array([f[3] for f in found], pa.float64()),
                ],
                ["entry_id", "n_words", "places", "phrase_labels", "template_labels", "score"],
            )

    schema = (
        f"entry_id {id_type(source)}, n_words bigint, places array<bigint>, phrase_labels array<string>, "
        "template_labels array<string>, score double"
    )
    return source.mapInArrow(run, schema)
