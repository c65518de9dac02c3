"""Licence scans with a positional index of rare words.

Templates are clauses of licences as words. A template is found where at least four fifths of its words stand at their
places relative to one start, the words of its key phrases all among them. The index holds, of each template, the
rarest words (highest inverse document frequency over all texts): one more than may be missing, so every place has one
of them. A text's words that the index holds are looked up, postings that agree in the start are one candidate, and
candidates are compared word by word. Short fixed phrases are found as they are.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

#: Phrases and their labels (fixed by the contract).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Clauses of public licences, the label of each, and the phrases of it that have to stand in full (fixed values).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license"]),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["distributed on an as is basis"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["redistribute it and or modify it", "gnu general public license"]),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", ["received a copy of the gnu general public license"]),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["subject to the terms of the mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["licensed under a creative commons attribution"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
]
#: Least share of a template's words, in percent.
LEAST_PERCENT = 80
PLACE = "struct<start: bigint, label: string, share: double, base: boolean>"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    #: Places of the words of key phrases.
    keys: tuple[int, ...]
    least: int


def templates(clauses: list[tuple[str, str, list[str]]] = TEMPLATES, percent: int = LEAST_PERCENT) -> list[Template]:
    out = []
    for label, clause, phrases in clauses:
        words = clause.split()
        keys: set[int] = set()
        for phrase in map(str.split, phrases):
            at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
            keys |= set(range(at, at + len(phrase)))
        out.append(Template(label, tuple(w.encode() for w in words), tuple(sorted(keys)), -(-percent * len(words) // 100)))
    return out


def document_frequencies(docs: DataFrame, vocabulary: list[bytes], text: str = "text") -> np.ndarray:
    """In how many texts each word of a vocabulary occurs."""
    known = {w: i for i, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for value in batch.column(0):
                total[[known[w] for w in known.keys() & set(common.plain_words(value.as_py()))]] += 1
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    return common.summed_vectors(docs.select(text).mapInArrow(run, "counts binary"), len(known))


def positional_index(known: list[Template], idf: dict[bytes, float]) -> dict[bytes, list[tuple[int, int]]]:
    """word -> (template, place): of each template its rarest places, one more than a place of it may lack."""
    postings = defaultdict(list)
    for t, template in enumerate(known):
        by_rarity = sorted(range(len(template.words)), key=lambda p: (-idf[template.words[p]], p))
        for place in by_rarity[: len(template.words) - template.least + 1]:
            postings[template.words[place]].append((t, place))
    return dict(postings)


class Scanner:
    """Finds phrases and templates in a text's words."""

    def __init__(self, known: list[Template], postings: dict[bytes, list[tuple[int, int]]], idf: dict[bytes, float]):
        self.templates, self.postings, self.idf = known, postings, idf
        self.phrases = defaultdict(list)
        for phrase, label in PHRASES.items():
            words = [w.encode() for w in phrase.split()]
            self.phrases[words[0]].append((words, label))
        self.watched = postings.keys() | self.phrases.keys()

    def places(self, words: list[bytes]) -> list[tuple[int, str, float, bool]]:
        """(first word, label, share of the template's words, whether it is a phrase) by first word, phrases first."""
        if self.watched.isdisjoint(words):
            return []
        spots = defaultdict(list)
        for i, word in enumerate(words):
            if word in self.watched:
                spots[word].append(i)
        found = [(i, label, 1.0, True) for first, entries in self.phrases.items() for phrase, label in entries for i in spots.get(first, ()) if words[i : i + len(phrase)] == phrase]
        seen = set()
        for word in sorted(spots.keys() & self.postings.keys(), key=lambda w: (-self.idf[w], w)):
            for i in spots[word]:
                for t, place in self.postings[word]:
                    start = i - place
                    if (t, start) not in seen:
                        seen.add((t, start))
                        share = self.share(words, start, self.templates[t])
                        if share:
                            found.append((start, self.templates[t].label, share, False))
        return sorted(found, key=lambda f: (f[0], not f[3], f[1]))

    @staticmethod
    def share(words: list[bytes], start: int, template: Template) -> float:
        """Of a template's words, those at their places from a start on; 0 if too few, or a word of a key phrase lacks."""
        n, wanted = len(words), template.words
        if any(not 0 <= start + k < n or words[start + k] != wanted[k] for k in template.keys):
            return 0.0
        same = sum(words[start + k] == wanted[k] for k in range(max(0, -start), min(len(wanted), n - start)))
        return same / len(wanted) if same >= template.least else 0.0


def find_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Where licences are named or quoted in every whole text.

    Returns a row a row of ``docs``: the key (with underscores after its name where that is taken), n_words and places:
    start (the first word's number, from 0; below 0 where a quoted clause has lost its head), label, share (of the
    clause's words; 1 for phrases) and base (whether it is a phrase), by start, phrases first. All texts are counted for
    the words' rarity. Null and empty texts have no words and no places; repeated rows and null keys give a row each; an
    empty table gives no rows; other columns are not read. The index, which is broadcast, hangs on the templates only.
    """
    name = common.free_name(key, ("n_words", "places"))
    kind = docs.schema[key].dataType
    known = templates()
    vocabulary = sorted({w for t in known for w in t.words})
    counts, total = document_frequencies(docs, vocabulary, text), docs.count()
    idf = {w: math.log((total + 1) / (c + 1)) for w, c in zip(vocabulary, counts.tolist())}
    sent = docs.sparkSession.sparkContext.broadcast((known, positional_index(known, idf), idf))
    place_type = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string()), ("share", pa.float64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*sent.value)
        for batch in common.in_slices(batches, 200):
            lengths, found = [], []
            for value in batch.column(1):
                words = common.plain_words(value.as_py())
                lengths.append(len(words))
                found.append([dict(zip(("start", "label", "share", "base"), p)) for p in scanner.places(words)])
            columns = [batch.column(0).cast(to_arrow_type(kind)), pa.array(lengths, pa.int64()), pa.array(found, place_type)]
            yield pa.RecordBatch.from_arrays(columns, [name, "n_words", "places"])

    return docs.select(key, text).mapInArrow(run, f"`{name}` {kind.simpleString()}, n_words long, places array<{PLACE}>")


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_base (places of phrases), first_word and last_word (their least and greatest start, else null),
    base_labels, labels (distinct, sorted, joined by commas), score (the greatest share; 0 without a place)."""
    base = F.filter("places", lambda p: p["base"])
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return found.withColumn("base", base).select(
        key,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        joined("base").alias("base_labels"),
        joined("places").alias("labels"),
        F.coalesce(F.array_max("places.share"), F.lit(0.0)).alias("score"),
    )
