"""Licence scan with a positional rare-token index.

The index holds, for every word of the licence templates, where it stands in them. How rare a word is
comes from the corpus: one pass counts the documents that hold each template word (a few hundred words,
whatever the corpus). The rarest words of a template are its anchors. In a document, every place of an
anchor votes for the place where the template would start; places on which the anchors agree by relative
position are compared with the template word by word, and the template's mandatory phrases must stand
there in full.

Words are runs of letters, digits and non-ASCII characters of the text with A-Z lower-cased. Nulls: a null
text is empty and has no words and no labels. Repeated rows get a row each; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logvigil.llm.common import texts

# Phrases whose places are counted, with their labels.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

# Opening words of public licences, by label, and the phrases that must stand in full.
TEMPLATES = {
    "agpl": ("gnu affero general public license", ["affero general public license"]),
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license"]),
    "boost": ("boost software license version 1 0", ["boost software license"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
            ["redistribution and use in source and binary forms"]),
    "cc-by-sa": ("creative commons attribution sharealike", ["attribution sharealike"]),
    "cc0": ("cc0 1 0 universal", ["cc0 1 0"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
            ["permission to use copy modify", "with or without fee is hereby granted"]),
    "lgpl": ("gnu lesser general public license", ["lesser general public license"]),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
            ["permission is hereby granted free of charge"]),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
}

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def spread(text: str) -> bytes:
    """A text's words with one space around each."""
    words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split()
    return b" " + b" ".join(words) + b" " if words else b""


def _padded(phrase: str) -> bytes:
    return b" " + phrase.encode() + b" "


class Index:
    """Templates by anchor. ``counts``: documents that hold each template word, and of how many."""

    def __init__(self, counts: dict[str, int], total: int, anchors: int = 3, share: float = 0.8, templates: dict = TEMPLATES, base: dict = BASE):
        self.share = share
        self.items = [(label, phrase.split(), [phrase], True) for label, phrase in base.items()]
        self.items += [(label, phrase.split(), must, False) for label, (phrase, must) in templates.items()]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.needed = []
        idf = lambda w: np.log1p(total / (1 + counts.get(w, 0)))
        for number, (_, words, _, _) in enumerate(self.items):
            rare = sorted(set(words), key=lambda w: (-idf(w), w))[: 1 if number < len(base) else anchors]
            self.needed.append(min(2, len(rare)))
            for word in rare:
                for at, other in enumerate(words):
                    if other == word:
                        self.postings.setdefault(_padded(word), []).append((number, at))
        #: The file's highest-IDF words are looked up first.
        self.order = sorted(self.postings, key=lambda w: (-idf(w.strip().decode()), w))

    def scan(self, text: str) -> tuple:
        """n_words, n_base, first, last, base labels, labels, score of a text."""
        data = spread(text)
        n_words = data.count(b" ") - 1 if data else 0
        votes: dict[tuple[int, int], int] = {}
        for word in self.order:
            at = data.find(word)
            where, counted = 0, 0
            while at >= 0:
                where += data.count(b" ", counted, at)
                counted = at
                for number, offset in self.postings[word]:
                    if where >= offset:
                        votes[number, where - offset] = votes.get((number, where - offset), 0) + 1
                at = data.find(word, at + len(word) - 1)
        base, labels, places, score = set(), set(), [], 0.0
        words = data.split() if votes else []
        for (number, start), n in votes.items():
            label, template, must, is_base = self.items[number]
            if n < self.needed[number] or start >= n_words:
                continue
            there = words[start : start + len(template)]
            same = sum(a == b.encode() for a, b in zip(there, template)) / len(template)
            if same < (1.0 if is_base else self.share):
                continue
            span = b" " + b" ".join(there) + b" "
            if not all(_padded(m) in span for m in must):
                continue
            labels.add(label)
            score = max(score, same)
            if is_base:
                base.add(label)
                places.append(start)
        return (n_words, len(places), min(places, default=None), max(places, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), float(score))


def word_counts(docs: DataFrame, words: list[str]) -> tuple[dict[str, int], int]:
    """Documents that hold each of the words, and all documents: one row per word reaches the driver."""
    needles = [(w, _padded(w)) for w in words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros(len(needles), np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                data = spread(text)
                found += np.fromiter((n in data for _, n in needles), bool, len(needles))
                total += 1
        yield pa.RecordBatch.from_pydict({"word": [*words, ""], "n": [*found.tolist(), total]})

    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = dict(map(tuple, rows))
    return counts, counts.pop("", 0)


def scan_licences(docs: DataFrame, id: str = "doc_id", text: str = "text", anchors: int = 3, share: float = 0.8) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per document."""
    rows = texts(docs, id, text)
    phrases = [*BASE.values(), *(phrase for phrase, _ in TEMPLATES.values())]
    words = sorted({w for phrase in phrases for w in phrase.split()})
    counts, total = word_counts(rows, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(counts, total, anchors, share)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            found = list(zip(*map(index.scan, batch.column(1).to_pylist()))) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(found, types)]], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
