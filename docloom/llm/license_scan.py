"""Licence scans with a generalised suffix automaton.

All templates (the base phrases, usual statements and openings of licences, whole licence texts) go into one suffix
automaton, as words. A document's words stream through it and leave, at every word, the longest match that ends there
(matching statistics). Base phrases are read off the automaton: a phrase ends here when its state lies on the
suffix-link path of the current state. Matches of at least ``min_match`` words are chained, template by template: a
chain runs forward in text and template, with at most ``max_gap`` foreign words between two matches, and the chain
that covers most of the template's words is found by dynamic programming. Chains that cover at least ``min_cover`` of
their template are spans, the best covered first, and those of one template do not overlap; a span gives its label.

Null texts have no words and no labels. Texts are streamed whole, in time linear in their words.
"""

from __future__ import annotations

import bisect
from functools import lru_cache
from importlib import resources

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import utf8, words_of

# The base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Openings and usual statements of public licences, as words. Whole licence texts stand in ``licenses``.
NOTICES = (
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit-text"),
    ("licensed under the apache license version 2 0", "apache-2.0-notice"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0-text"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0-notice"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-text"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0-notice"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0-notice"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0-text"),
    ("this is free and unencumbered software released into the public domain", "unlicense-text"),
)


@lru_cache(maxsize=1)
def default_templates() -> tuple[tuple[str, str], ...]:
    """The notices, and the licence texts that the package carries, each labelled by its file's name with ``-text``."""
    files = sorted((f for f in resources.files(__package__).joinpath("licenses").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return (*NOTICES, *((f.read_text("utf-8"), f.name.removesuffix(".txt").lower() + "-text") for f in files))


class Automaton:
    """Generalised suffix automaton over word sequences; places are kept for states of at least ``least`` words."""

    def __init__(self, sequences: list[list[bytes]], least: int = 1):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (sequence, words up to the end) of each state's occurrences
        for k, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].add((k, i + 1))
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            if self.length[self.link[v]] >= least:
                self.ends[self.link[v]] |= self.ends[v]

    def _new(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """The state for the part of q that p + w reaches."""
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, w: bytes) -> int:
        q = self.next[p].get(w)
        if q is not None:  # another template has been here
            return q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        new = self._new(self.length[p] + 1, {}, 0)
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def state_of(self, words: list[bytes]) -> int:
        v = 0
        for w in words:
            v = self.next[v][w]
        return v


class Scanner:
    def __init__(self, base=BASE, templates=None, min_match: int = 4, min_cover: float = 0.6, max_gap: int = 32):
        templates = default_templates() if templates is None else templates
        self.min_match, self.min_cover, self.max_gap = min_match, min_cover, max_gap
        base = [(words_of(p.encode()), label) for p, label in base]
        self.templates = [(words_of(p.encode()), label) for p, label in templates]
        self.auto = Automaton([w for w, _ in base] + [w for w, _ in self.templates], min_match)
        self.first = len(base)  # sequences before this one are base phrases
        self.vocabulary = {w for words, _ in base + self.templates for w in words}
        at: dict[int, list[tuple[int, str]]] = {}
        for words, label in base:
            at.setdefault(self.auto.state_of(words), []).append((len(words), label))
        self.phrases: list[list[tuple[int, str]]] = [[]]
        for v in range(1, len(self.auto.next)):
            found, u = [], v
            while u > 0:
                found += at.get(u, [])
                u = self.auto.link[u]
            self.phrases.append(found)

    def scan(self, text: bytes | None) -> dict:
        words = words_of(text)
        nxt, link, length, vocabulary = self.auto.next, self.auto.link, self.auto.length, self.vocabulary
        places, labels, matches = [], set(), []
        v = n = 0
        previous = -2
        for i in [i for i, w in enumerate(words) if w in vocabulary]:
            if i != previous + 1:
                if n >= self.min_match:
                    matches.append((previous + 1, n, v))
                v = n = 0
            w, before, at = words[i], n, v
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            v = nxt[v].get(w, 0)
            n = n + 1 if v else 0
            if before >= self.min_match and n <= before:
                matches.append((i, before, at))
            for size, label in self.phrases[v]:
                if size <= n:
                    places.append(i + 1 - size)
                    labels.add(label)
            previous = i
        if n >= self.min_match:
            matches.append((previous + 1, n, v))
        spans = self.chain(matches)
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(places, default=None),
            "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(labels)),
            "labels": ",".join(sorted(labels | {s["label"] for s in spans})),
            "score": 1.0 if places else max((s["cover"] for s in spans), default=0.0),
            "spans": spans,
        }

    def chain(self, matches: list[tuple[int, int, int]]) -> list[dict]:
        """Spans of matches (end, words, state), which come by ascending end."""
        nodes: dict[int, list[tuple[int, int, int]]] = {}  # template -> (end, words, end in the template)
        for end, n, v in matches:
            for k, stop in sorted(self.auto.ends[v]):
                if k >= self.first:
                    nodes.setdefault(k, []).append((end, n, stop))
        out = []
        for k, here in nodes.items():
            label, whole = self.templates[k - self.first][1], len(self.templates[k - self.first][0])
            ends = [e for e, _, _ in here]
            covered, begun = [], []
            for i, (end, n, stop) in enumerate(here):
                best, start = n, end - n
                for j in range(bisect.bisect_left(ends, end - n - self.max_gap), i):
                    e, _, s = here[j]
                    if e < end and s < stop:
                        more = covered[j] + min(n, stop - s, end - e)
                        if more > best:
                            best, start = more, begun[j]
                covered.append(best)
                begun.append(start)
            starts, stops = [], []  # of the spans taken, in order; they do not overlap
            for i in sorted(range(len(here)), key=lambda i: (-covered[i], begun[i], ends[i])):
                if covered[i] < self.min_cover * whole:
                    break
                at = bisect.bisect_left(stops, begun[i] + 1)
                if at == len(starts) or starts[at] >= ends[i]:
                    starts.insert(at, begun[i])
                    stops.insert(at, ends[i])
                    out.append({"label": label, "start": begun[i], "end": ends[i], "cover": min(1.0, covered[i] / whole)})
        return sorted(out, key=lambda s: (s["start"], s["end"], s["label"]))


@lru_cache(maxsize=4)
def scanner(base: tuple, templates: tuple | None, min_match: int, min_cover: float) -> Scanner:
    return Scanner(base, templates, min_match, min_cover)


RESULT = (
    "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,"
    "spans:array<struct<label:string,start:bigint,end:bigint,cover:double>>>"
)
_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())])
_TYPE = pa.struct(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))]
)


def license_scan(text: Column, base: tuple = BASE, templates: tuple | None = None, min_match: int = 4, min_cover: float = 0.6) -> Column:
    """Struct of counts, labels, score and template spans (words from 0, end exclusive) of each whole text."""

    @F.arrow_udf(RESULT)
    def scan(texts: pa.Array) -> pa.Array:
        s = scanner(base, templates, min_match, min_cover)
        return pa.array([s.scan(t.as_py()) for t in texts], _TYPE)

    return scan(utf8(text))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id and the fields of ``license_scan``; other columns are left out.

    Null and empty texts: no words, no labels (empty strings), null places, score 0. Repeated rows repeat. ``templates``
    (text, label) stands for the notices and licence texts, if given.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    return rows.select("doc_id", license_scan(F.col("__text"), **options).alias("__found")).select("doc_id", "__found.*")
