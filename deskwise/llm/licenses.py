"""License scans: phrases by place, and templates by an exact containment join of token sets.

A text block matches a template when it holds at least ``threshold`` of the template's distinct tokens. Blocks are the
lines, and, as notices are wrapped, all runs of half as many words again as the template has, over the ends of lines.
Tokens are ordered by their frequency over all documents, rare ones first. A block that meets the threshold must share
one of a template's first ``size - needed + 1`` tokens (prefix), must have ``needed`` tokens at all (length), and from
its first shared token on enough tokens must be left (position); only blocks that pass are compared.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Customary wordings of license notices.
TEMPLATES = {
    "all-rights-reserved": ["copyright all rights reserved", "all rights reserved"],
    "apache-2.0": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by-nc": ["licensed under cc by-nc 4.0"],
    "cc-by-sa": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike license"],
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license version 2.0"],
}
#: ASCII letters in lower case, digits and all bytes of other characters stay; newline is kept apart, the rest is a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_LINES = bytes(10 if c == 10 else w for c, w in enumerate(_WORDS))


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def places(text: bytes, phrases: dict[bytes, str]) -> list[tuple[int, str]]:
    """(word number, label) of every place of a phrase in words joined by single spaces, with a space at both ends."""
    found = []
    for phrase, label in phrases.items():
        at, upto, spaces = text.find(phrase), 0, 0
        while at >= 0:
            spaces += text.count(b" ", upto, at + 1)
            found.append((spaces - 1, label))
            upto, at = at + 1, text.find(phrase, at + 1)
    return found


def token_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each token of the vocabulary, which the templates bound, stands."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for cell in batch["text"]:
                if text := cell.as_py():
                    total.update(vocabulary.intersection(tokens(text)))
        yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["token", "n"])

    rows = docs.select("text").mapInArrow(counted, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"].encode(): r["n"] for r in rows}


class Index:
    """Templates by the tokens of their prefixes."""

    def __init__(self, templates: dict[str, list[str]], counts: dict[bytes, int], threshold: float):
        self.sets = [(label, frozenset(tokens(t))) for label, several in sorted(templates.items()) for t in several]
        self.widths = [3 * len(tokens(t)) // 2 for _, several in sorted(templates.items()) for t in several]
        vocabulary = sorted(set().union(*(s for _, s in self.sets)), key=lambda t: (counts.get(t, 0), t))
        self.rank = {t: i for i, t in enumerate(vocabulary)}
        self.needed = [math.ceil(threshold * len(s) - 1e-9) for _, s in self.sets]
        self.by_token: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, s) in enumerate(self.sets):
            for place, t in enumerate(sorted(s, key=self.rank.get)[: len(s) - self.needed[k] + 1]):
                self.by_token.setdefault(t, []).append((k, place))

    def matches(self, block: list[bytes]) -> Iterator[tuple[str, float]]:
        """Label and containment of every template that the block holds."""
        own = set(block)
        if not (probes := own & self.by_token.keys()):
            return
        tried = set()
        for t in sorted(probes, key=self.rank.get):
            for k, place in self.by_token[t]:
                label, words = self.sets[k]
                # Until its first shared token a template has none in common with the block.
                if k not in tried and len(own) >= self.needed[k] <= len(words) - place:
                    if (n := len(own & words)) >= self.needed[k]:
                        yield label, n / len(words)
                tried.add(k)

    def runs(self, words: list[bytes]) -> Iterator[tuple[str, float]]:
        """Label and largest containment of every template that a run of its width in the words holds."""
        near: dict[int, list[list[int]]] = {}
        for at, t in enumerate(words):
            for k, _ in self.by_token.get(t, ()):
                # Runs that hold this token of the prefix; those of its neighbours that they meet are one span.
                spans, low, high = near.setdefault(k, []), max(0, at - self.widths[k] + 1), at + self.widths[k]
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = high
                else:
                    spans.append([low, high])
        for k, spans in near.items():
            label, own = self.sets[k]
            most = max(self._densest(k, words, low, high) for low, high in spans)
            if most >= self.needed[k]:
                yield label, most / len(own)

    def _densest(self, k: int, words: list[bytes], low: int, high: int) -> int:
        """The most distinct tokens of a template in a run of its width, or 0 if the whole span has too few."""
        own = self.sets[k][1]
        if len(own.intersection(words[low:high])) < self.needed[k]:
            return 0
        most, left, held = 0, 0, Counter()
        hits = [(at, t) for at, t in enumerate(words[low:high]) if t in own]
        for at, t in hits:
            held[t] += 1
            while hits[left][0] <= at - self.widths[k]:
                held[hits[left][1]] -= 1
                left += 1
            most = max(most, sum(n > 0 for n in held.values()))
        return most


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = 0.9) -> DataFrame:
    """Adds ``n_words, n_base, first_word, last_word, base_labels, labels, score`` to ``doc_id`` of each document.

    ``score`` is the largest containment of a matching template, 1 where a phrase stands, else 0. A null text is empty;
    an empty table has no rows. The templates, whose index every task gets, are a parameter and bounded by it.
    """
    index = Index(templates, token_counts(docs, set().union(*(tokens(t) for several in templates.values() for t in several))), threshold)
    spaced = {f" {p} ".encode(): label for p, label in phrases.items()}
    quick = tuple({max(p.split(), key=len) for p in spaced})

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell in batch["text"]:
                raw = (cell.as_py() or "").encode("utf-8", "surrogatepass").translate(_LINES)
                words = raw.split()
                base = places(b" " + b" ".join(words) + b" ", spaced) if any(q in raw for q in quick) else []
                labels, score = {label for _, label in base}, 1.0 if base else 0.0
                held = sorted(labels)
                if not index.by_token.keys().isdisjoint(words):
                    for line in raw.split(b"\n"):
                        for label, share in index.matches(line.split()):
                            labels.add(label)
                            score = max(score, share)
                    for label, share in index.runs(words):
                        labels.add(label)
                        score = max(score, share)
                at = [a for a, _ in base]
                out.append((len(words), len(base), min(at, default=None), max(at, default=None), ",".join(held), ",".join(sorted(labels)), score))
            kinds = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(),)
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select("doc_id", "text").mapInArrow(scanned, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
