"""License scans: a generalised suffix automaton of license templates.

All templates (base phrases and notices) are put into one suffix automaton over words. A
document's words are streamed through it: after every word the automaton holds the
longest end of the text so far that stands in some template (matching statistics). Where
that match can't grow, it is a maximal match; maximal matches of at least ``MIN_MATCH``
words that stand in the same order in one template, at most ``MAX_GAP`` words apart, are
chained into a covered span, whose score is the covered share of the template. A base
phrase is found where the match ends with all of it.

Words are compared as hashes, whole batches at a time; only stretches whose neighbouring
words are neighbours in some template are streamed, as no longer match can lie elsewhere.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import read
from tessera.llm.kernels import ALNUM_WORDS, hash_words, tidied, word_chunks

#: The base phrases and their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Wording of public license notices and grants.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation "
            "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in "
                 "compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("gpl", "licensed under the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("bsd", "licensed under the bsd license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
)
MIN_MATCH, MAX_GAP, MIN_COVERED = 3, 3, 0.7

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (sequence, words before the end) where the state's strings end
        for k, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].add((k, i + 1))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state]
        self.ends[0] = set()

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A state for the strings of q that are one word longer than p's."""
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:  # an earlier sequence has it
            return known if self.length[known] == self.length[last] + 1 else self._split(last, w, known)
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return state

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: (state, words matched)."""
        state = matched = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                matched += 1
            yield state, matched


class Scanner:
    def __init__(self, base=BASE, templates=TEMPLATES) -> None:
        entries = [(label, words) for label, text in (*base, *templates) if (words := self._hashes(text))]
        self.n_base = sum(1 for _, text in base if self._hashes(text))
        self.labels = [label for label, _ in entries]
        self.vocabulary = np.unique(np.array([w for _, ws in entries for w in ws], np.uint64))
        sequences = [np.searchsorted(self.vocabulary, np.array(ws, np.uint64)).tolist() for _, ws in entries]
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(sequences)
        v = len(self.vocabulary)
        self.pairs = np.unique(np.array([a * v + b for s in sequences for a, b in zip(s, s[1:])], np.int64))
        self.least = min([MIN_MATCH, *self.sizes[: self.n_base]])
        self.phrases: dict[int, list[tuple[int, int]]] = {-1: []}  # state: base phrases that its longest string ends with
        for state in sorted(range(len(self.automaton.link)), key=lambda q: self.automaton.length[q]):
            own = [(k, end) for k, end in self.automaton.ends[state]
                   if k < self.n_base and end == self.sizes[k] == self.automaton.length[state]]
            self.phrases[state] = own + self.phrases[self.automaton.link[state]]

    @staticmethod
    def _hashes(text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return hash_words(data, np.array([0, len(data)]), ALNUM_WORDS)[0].tolist()

    def stretches(self, h: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(text, first word in it, word numbers) of the stretches that may hold a match of ``least`` words."""
        v = len(self.vocabulary)
        at = np.minimum(np.searchsorted(self.vocabulary, h), v - 1)
        known = self.vocabulary[at] == h
        owner = np.repeat(np.arange(len(counts)), counts)
        linked = known[:-1] & known[1:] & (owner[:-1] == owner[1:])
        where = np.flatnonzero(linked)
        code = at[where] * v + at[where + 1]
        spot = np.minimum(np.searchsorted(self.pairs, code), max(len(self.pairs) - 1, 0))
        linked[where[self.pairs[spot] != code] if len(self.pairs) else where] = False
        first = np.concatenate([[True], ~linked]) & known  # words that open a stretch
        begins = np.flatnonzero(first)
        breaks = np.flatnonzero(np.concatenate([~linked, [True]]))  # words after which a stretch ends
        ends = breaks[np.searchsorted(breaks, begins)] + 1
        base = np.cumsum(counts) - counts
        for b, e in zip(begins[ends - begins >= self.least].tolist(), ends[ends - begins >= self.least].tolist()):
            yield int(owner[b]), b - int(base[owner[b]]), at[b:e].tolist()

    def matches(self, start: int, words: list[int]):
        """(base finds as (phrase, first word), maximal matches as (first word, words, places in templates))."""
        found, maximal, before = [], [], (0, 0)
        steps = [*self.automaton.statistics(words), (0, 0)]
        for i, (state, matched) in enumerate(steps):
            if before[1] >= MIN_MATCH and matched <= before[1]:
                maximal.append((start + i - before[1], before[1], self.automaton.ends[before[0]]))
            before = state, matched
            for k, size in self.phrases[state]:
                if matched >= size:
                    found.append((k, start + i + 1 - size))
        return found, maximal

    def chains(self, maximal: list[tuple[int, int, set]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end word, covered share) of spans that cover enough of a template."""
        open_: dict[int, list[list[int]]] = defaultdict(list)  # template: chains [first, end, end in template, covered]
        done = []
        for first, size, places in maximal:
            for k, end in places:
                best = None
                for chain in open_[k]:
                    skip = max(0, chain[1] - first, chain[2] - (end - size))
                    if first - chain[1] <= MAX_GAP and skip < size and first + size > chain[1] and end > chain[2]:
                        if best is None or chain[3] + size - skip > best[3]:
                            best = [chain[0], first + size, end, chain[3] + size - skip]
                open_[k].append([first, first + size, end, size])
                if best:
                    open_[k].append(best)
                open_[k] = [c for c in open_[k] if c[1] + MAX_GAP >= first]
                done += [(k, *c) for c in open_[k][-2:] if c[3] >= MIN_COVERED * self.sizes[k]]
        spans: dict[tuple[str, int], tuple] = {}
        for k, first, end, _, covered in done:
            key, share = (self.labels[k], first), min(1.0, covered / self.sizes[k])
            if key not in spans or share > spans[key][3]:
                spans[key] = (self.labels[k], first, end, share)
        return sorted(spans.values(), key=lambda s: (s[1], s[0]))


NEW = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
       "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.string()}


def _rows(base, templates, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(base, templates)
    for batch in batches:
        n = np.zeros(batch.num_rows, np.int64)
        finds: dict[int, list] = defaultdict(list)
        runs: dict[int, list] = defaultdict(list)
        for lo, hi, h, counts in word_chunks(batch.column(0), ALNUM_WORDS):
            n[lo:hi] = counts
            if len(h):
                for text, start, words in scanner.stretches(h, counts):
                    found, maximal = scanner.matches(start, words)
                    finds[lo + text] += found
                    runs[lo + text] += maximal
        out: dict[str, list] = {c: [] for c in NEW}
        for i in range(batch.num_rows):
            found, spans = finds.get(i, []), scanner.chains(runs[i]) if i in runs else []
            own = {scanner.labels[k] for k, _ in found}
            out["n_words"].append(int(n[i]))
            out["n_base"].append(len(found))
            out["first_word"].append(min((s for _, s in found), default=None))
            out["last_word"].append(max((s for _, s in found), default=None))
            out["base_labels"].append(",".join(sorted(own)))
            out["labels"].append(",".join(sorted(own | {s[0] for s in spans})))
            out["score"].append(1.0 if found else max((s[3] for s in spans), default=0.0))
            out["spans"].append(",".join(f"{label}:{a}:{b}" for label, a, b, _ in spans))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(out[c], t) for c, t in NEW.items())],
                                         [*batch.schema.names[1:], *NEW])


def scan_licenses(docs: DataFrame, text_col: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """``docs`` without the text, plus n_words, base finds, labels, score and covered spans (in words).

    Null and empty texts have no words and no finds. Columns of ``docs`` with the new
    columns' names are replaced; the others pass through.
    """
    wide = docs.select(F.col(text_col).cast("string").alias("_text"), *[c for c in docs.columns if c != text_col and c not in NEW])
    schema = wide.drop("_text").schema
    for c, kind in NEW.items():
        schema = schema.add(c, {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}[kind])
    return wide.mapInArrow(lambda it: tidied(_rows(base, templates, it)), schema)


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
