"""Licence statements: fixed phrases, and text blocks that contain most of a licence template.

Phrases are words that stand one after another. Beside them, blocks of words are joined with
templates by exact set similarity: a block matches if it holds at least ``threshold`` of a
template's distinct words. Words of templates are ordered by their frequency in all documents,
rarest first. Of a template with n words that needs m of them, one of its n - m + 1 rarest must be
among the block's rarest (prefix filter); a block with fewer than m template words is dropped
(length filter); and a pair is dropped if what follows the first shared word in both cannot make
up the rest (positional filter). Pairs that pass are counted, so every match is found and no other.

Blocks are ``block`` words long and begin at every half block, so each run of up to half a block
lies in one. Words outside all templates cannot match and do not enter a block's set.

Defined results: a null or empty text has no words, no place and no label, and score 0. A score is
1 where a phrase stands, else the best containment of a template that met the threshold, else 0.
Rows are judged one by one, so ties, repeated rows, null ids and other columns change nothing.
Words are told apart by 64-bit hashes. An empty table is fine.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import id_type, small_batches
from ._text import ALPHANUMERIC, Words, chunks, find_words, word_hashes

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Sentences of public licences and notices, and their labels.
TEMPLATES = [
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this work is licensed under a creative commons attribution international license", "cc-by"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
]
#: Type of the column ``blocks``.
MATCHES = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("containment", pa.float64())]))


class Vocabulary:
    """Numbers of the words of phrases and templates, by hash."""

    def __init__(self, texts: list[str]):
        self.words = sorted({w for text in texts for w in text.split()})
        hashes = word_hashes(find_words(pa.array([" ".join(self.words)]), ALPHANUMERIC))
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def number(self, text: str) -> list[int]:
        return [self.words.index(w) for w in text.split()]

    def numbers(self, words: Words) -> np.ndarray:
        """The number of each word, -1 for others."""
        hashes = word_hashes(words)
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, self.order[at], -1)


def frequencies(docs: DataFrame, vocabulary: Vocabulary, text_col: str) -> np.ndarray:
    """How often each word of the vocabulary stands in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.words), np.int64)
        for table in chunks(batches, "text"):
            numbers = vocabulary.numbers(find_words(table["text"], ALPHANUMERIC, lower=True))
            total += np.bincount(numbers[numbers >= 0], minlength=len(total))
        yield pa.RecordBatch.from_pydict({"word": np.flatnonzero(total), "n": total[total > 0]})

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word bigint, n bigint")
    out = np.zeros(len(vocabulary.words), np.int64)
    for word, n in counted.groupBy("word").agg(F.sum("n")).collect():
        out[word] = n
    return out


class Templates:
    """Templates as sets of ranks, rarest first, with an index of the words of their prefixes."""

    def __init__(self, templates: list[tuple[list[int], str]], counts: np.ndarray, threshold: float):
        self.rank = np.empty(len(counts), np.int64)
        self.rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
        self.sets = [sorted({int(self.rank[w]) for w in words}) for words, _ in templates]
        self.labels = [label for _, label in templates]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        for t, (ranks, need) in enumerate(zip(self.sets, self.need)):
            for place, rank in enumerate(ranks[: len(ranks) - need + 1]):
                self.prefixes.setdefault(rank, []).append((t, place))
        self.rare = np.zeros(len(counts), bool)
        self.rare[list(self.prefixes)] = True

    def matches(self, block: list[int]) -> list[tuple[int, float]]:
        """(template, containment) of all templates a block's sorted ranks hold enough of."""
        out, seen = [], set()
        for place, rank in enumerate(block):
            for t, other in self.prefixes.get(rank, ()):
                need, ranks = self.need[t], self.sets[t]
                if t in seen or len(block) < need or place > len(block) - need:
                    continue
                seen.add(t)  # the first word the two prefixes share
                if 1 + min(len(block) - place - 1, len(ranks) - other - 1) < need:
                    continue
                both = len(set(block).intersection(ranks))
                if both >= need:
                    out.append((t, both / len(ranks)))
        return out


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] | None = None,
    templates: list[tuple[str, str]] | None = None,
    threshold: float = 0.8,
    block: int = 64,
) -> DataFrame:
    """``id_col``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``,
    ``score`` and ``blocks``: (label, first word of the block, containment) of every match.
    """
    small_batches(docs.sparkSession)
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    vocabulary = Vocabulary([*phrases, *(text for text, _ in templates)])
    counts = frequencies(docs, vocabulary, text_col)
    known = Templates([(vocabulary.number(text), label) for text, label in templates], counts, threshold)
    listed = [(np.array(vocabulary.number(text)), label) for text, label in phrases.items()]
    step = max(1, block // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "text"):
            words = find_words(table["text"], ALPHANUMERIC, lower=True)
            numbers, first = vocabulary.numbers(words), words.first
            n = table.num_rows
            total = np.zeros(n, np.int64)
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base: list[set[str]] = [set() for _ in range(n)]
            for phrase, label in listed:
                at = np.flatnonzero(numbers == phrase[0])
                at = at[at + len(phrase) <= len(numbers)]
                for k in range(1, len(phrase)):
                    at = at[numbers[at + k] == phrase[k]]
                text = np.searchsorted(first, at, "right") - 1
                good = at + len(phrase) <= first[text + 1]
                at, text = at[good] - first[text[good]], text[good]
                np.add.at(total, text, 1)
                np.minimum.at(low, text, at)
                np.maximum.at(high, text, at)
                for t in np.unique(text).tolist():
                    base[t].add(label)
            found: list[list[dict]] = [[] for _ in range(n)]
            places = np.flatnonzero(numbers >= 0)
            ranks = known.rank[numbers[places]]
            rare = places[known.rare[ranks]]
            text = np.searchsorted(first, rare, "right") - 1
            half = (rare - first[text]) // step
            several = np.concatenate([np.stack([text, half - k], axis=1) for k in range(-(-block // step))])
            for t, b in np.unique(several[several[:, 1] >= 0], axis=0).tolist():
                begin = first[t] + b * step
                a, z = np.searchsorted(places, [begin, min(begin + block, first[t + 1])])
                for template, held in known.matches(np.unique(ranks[a:z]).tolist()):
                    found[t].append({"label": known.labels[template], "first": b * step, "containment": held})
            some = high >= 0
            joined = [",".join(sorted(own)) for own in base]
            every = [",".join(sorted(own | {m["label"] for m in more})) for own, more in zip(base, found)]
            score = [1.0 if own else max((m["containment"] for m in more), default=0.0) for own, more in zip(base, found)]
            yield pa.RecordBatch.from_arrays(
                [
                    table["id"].combine_chunks(),
                    pa.array(words.counts()),
                    pa.array(total),
                    pa.array(low, mask=~some),
                    pa.array(high, mask=~some),
                    pa.array(joined, pa.string()),
                    pa.array(every, pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(found, MATCHES),
                ],
                ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"],
            )

    kind = (
        f"id {id_type(docs, id_col)}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, blocks array<struct<label: string, first: bigint, containment: double>>"
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, kind).withColumnRenamed("id", id_col)
