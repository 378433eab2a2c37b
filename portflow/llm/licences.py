"""Licence scan: a generalised suffix automaton of licence tokens, matching statistics, chained matches.

Templates (licence notices) and base phrases become token sequences; one suffix automaton holds all their substrings.
A file is streamed through it: at every token the automaton has the longest match that ends there. Maximal matches of
at least ``MIN_MATCH`` tokens are chained in the order of the file and of the template, and the share of a template's
tokens that its best chain covers is its coverage. A template covered to at least ``COVERED``, with all tokens that it
requires (a version, "lesser") among them, is a span; of spans that cover the same words only the one with the most
tokens stays, and the spans that stay give the labels. A base
phrase stands wherever the automaton's state has it as a suffix, so all its places are found, overlapping ones too.

Words are runs of digits, ASCII letters (lower-cased) and bytes beyond ASCII. Only runs of tokens whose every pair of
neighbours stands in some template can hold a match of two tokens or more; these runs are found by numpy over whole
batches, and only they are streamed through the automaton. Words are compared by 64-bit hashes.

Edge cases: null and empty texts have no words, no places, empty labels and score 0; rows that repeat a doc_id are
scanned each; an empty table gives no rows; other columns are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix, text_slices, word_hashes, tidy

MIN_MATCH = 4
COVERED = 0.75
GAP = 40  # tokens of the file that may stand between chained matches

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Licence notices as their licensors word them (a label may have several).
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

# Tokens that a span of a label's template must match wherever the template has them.
REQUIRED = {"gpl-2": {"2"}, "gpl-3": {"3"}, "lgpl": {"lesser"}, "apache-2": {"2"}, "mpl-2": {"2"}, "cc-by-nc": {"nc", "noncommercial"}, "cc-by-sa": {"sharealike"}}

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def tokens(text: str) -> list[int]:
    data = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]), WORD_BYTES)[0].tolist()


@dataclass
class Automaton:
    """Generalised suffix automaton of token sequences. ``places[s]``: (sequence, end) of all places of state s's strings."""

    sequences: list[list[int]]
    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    step: list[dict] = field(default_factory=lambda: [{}])
    places: list[set] = field(default_factory=lambda: [set()])

    def __post_init__(self):
        for k, seq in enumerate(self.sequences):
            last = 0
            for i, t in enumerate(seq):
                last = self._extend(last, t)
                self.places[last].add((k, i + 1))
        order = sorted(range(1, len(self.length)), key=lambda s: -self.length[s])
        for s in order:  # a state's strings end wherever those of the states below it in the suffix tree end
            if self.link[s] > 0:
                self.places[self.link[s]] |= self.places[s]

    def _new(self, length: int, link: int, step: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        self.places.append(set())
        return len(self.length) - 1

    def _extend(self, last: int, t: int) -> int:
        if t in self.step[last]:
            q = self.step[last][t]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, t)
        new = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and t not in self.step[p]:
            self.step[p][t] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][t]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, t)
        return new

    def _clone(self, p: int, q: int, t: int) -> int:
        c = self._new(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = c
        while p >= 0 and self.step[p].get(t) == q:
            self.step[p][t] = c
            p = self.link[p]
        return c

    def stream(self, seq: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: for every token, (state, length) of the longest match that ends with it."""
        s, n = 0, 0
        step, link, length = self.step, self.link, self.length
        for t in seq:
            while s and t not in step[s]:
                s = link[s]
                n = length[s]
            if t in step[s]:
                s, n = step[s][t], n + 1
            else:
                n = 0
            yield s, n

    def state(self, seq: list[int]) -> int:
        s = 0
        for t in seq:
            s = self.step[s][t]
        return s


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, notices: list[tuple[str, str]] = NOTICES, min_match: int = MIN_MATCH, covered: float = COVERED, gap: int = GAP):
        self.min_match, self.covered, self.gap = min_match, covered, gap
        self.phrases = [(tokens(p), label) for p, label in base.items()]
        self.templates = [(label, tokens(t)) for label, t in notices]
        self.required = [{i for i, w in enumerate(t.split()) if w in REQUIRED.get(label, ())} for label, t in notices]
        self.automaton = Automaton([p for p, _ in self.phrases] + [t for _, t in self.templates])
        pairs = {(a, b) for s in self.automaton.sequences for a, b in zip(s, s[1:])}
        self.pairs = np.unique(self._pair(np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.uint64)))
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self.pairs >> np.uint64(48)] = True
        self.suffix: list[list[tuple[int, int]]] = [[] for _ in self.automaton.length]  # phrases that end a state's strings
        at = {self.automaton.state(p): k for k, (p, _) in enumerate(self.phrases)}
        for s in sorted(range(len(self.suffix)), key=lambda s: self.automaton.length[s]):
            if s:
                self.suffix[s] = self.suffix[self.automaton.link[s]] + ([(at[s], len(self.phrases[at[s]][0]))] if s in at else [])

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)

    def runs(self, words: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, first word, end) of runs of three or more tokens all of whose neighbours are neighbours in a template."""
        if len(words) < 3:
            return
        h = self._pair(words[:-1], words[1:])
        near = self.seen[h >> np.uint64(48)]
        k = np.flatnonzero(near)
        near[k] = self.pairs[np.minimum(np.searchsorted(self.pairs, h[k]), len(self.pairs) - 1)] == h[k]
        cut = rows[1:-1]
        cut = cut[(cut > 0) & (cut < len(words))]
        near[cut - 1] = False
        edge = np.diff(np.concatenate([[0], near.astype(np.int8), [0]]))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        for x, y in zip(a[b - a > 2].tolist(), b[b - a > 2].tolist()):
            yield int(np.searchsorted(rows, x, "right")) - 1, x, y

    def scan(self, column: pa.Array) -> Iterator[tuple]:
        """Per row: (n_words, n_base, first_word, last_word, base_labels, labels, score, spans)."""
        for _, data, off in text_slices(column):
            words, rows = word_hashes(data, off, WORD_BYTES)
            found: dict[int, tuple[list, list]] = {}
            for row, a, b in self.runs(words, rows):
                bases, matches = found.setdefault(row, ([], []))
                first = a - int(rows[row])
                last = (0, 0)
                for i, (s, n) in enumerate(self.automaton.stream(words[a:b].tolist()), first + 1):
                    bases += [(i - m, k) for k, m in self.suffix[s] if n >= m]
                    if n <= last[1] and last[1] >= self.min_match:
                        matches.append((i - 1, *last))
                    last = s, n
                if last[1] >= self.min_match:
                    matches.append((b - int(rows[row]), *last))
            for r in range(len(off) - 1):
                n = int(rows[r + 1] - rows[r])
                if r not in found:
                    yield n, 0, None, None, "", "", 0.0, []
                    continue
                bases, matches = found[r]
                cover, spans = self.chain(matches)
                own = {self.phrases[k][1] for _, k in bases}
                labels = own | {x["label"] for x in spans}
                starts = [x for x, _ in bases]
                yield n, len(bases), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), 1.0 if own else min(1.0, cover), spans

    def chain(self, matches: list[tuple[int, int, int]]) -> tuple[float, list[dict]]:
        """(coverage of the best template, spans). A match (end in the file, state, tokens) may follow another if it comes
        later in the file, at most ``gap`` tokens on, and later in the template; of overlaps only the new part counts."""
        parts: dict[int, list[tuple[int, int, int]]] = {}
        for end, s, n in matches:
            for k, e in self.automaton.places[s]:
                if k >= len(self.phrases):
                    parts.setdefault(k - len(self.phrases), []).append((end, e, n))
        cover, found = 0.0, []
        for k, own in parts.items():
            todo = [sorted(own)]
            while todo:  # the best chain, then those before and after it
                own = todo.pop()
                tokens, steps = self._best(own, len(self.templates[k][1]), self.required[k])
                cover = max(cover, tokens / len(self.templates[k][1]))
                if tokens < self.covered * len(self.templates[k][1]):
                    continue
                words = {end - i for end, _, new in steps for i in range(1, new + 1)}
                first, last = min(words), max(words) + 1
                if self.required[k] <= {e - i for _, e, new in steps for i in range(1, new + 1)}:
                    found.append((tokens, tokens / len(self.templates[k][1]), k, first, last, words))
                todo += [x for x in ([p for p in own if p[0] <= first], [p for p in own if p[0] - p[2] >= last]) if x]
        found.sort(key=lambda x: (-x[0], -x[1], x[2], x[3]))
        taken: set[int] = set()
        spans = []
        for tokens, share, k, first, last, words in found:
            if 2 * len(words & taken) <= len(words):
                taken |= words
                spans.append({"template": k, "label": self.templates[k][0], "first_word": first, "end_word": last, "coverage": min(1.0, share)})
        return cover, sorted(spans, key=lambda x: (x["first_word"], x["template"]))

    def _best(self, parts: list[tuple[int, int, int]], length: int, required: set[int]) -> tuple[int, list[tuple[int, int, int]]]:
        """(tokens, steps (end in the file, end in the template, new tokens)) of the chain that covers most; of equal ones
        one with all that is required."""
        best: list[int] = []
        back: list[tuple[int, int]] = []  # (part before, new tokens)
        low = 0
        for i, (end, e, n) in enumerate(parts):
            while parts[low][0] < end - length - self.gap:  # none that far back is near enough
                low += 1
            most, via = n, (-1, n)
            for j in range(low, i):
                end2, e2, _ = parts[j]
                new = min(n, e - e2, end - end2)
                if new > 0 and end2 >= end - n - self.gap and best[j] + new > most:
                    most, via = best[j] + new, (j, new)
            best.append(most)
            back.append(via)
        steps: list[tuple[int, int, int]] = []
        top = max(best)
        for i in sorted((i for i, x in enumerate(best) if x == top), key=lambda i: abs(2 * i - len(best))):  # from the middle: halves what is left
            steps = []
            while i >= 0:
                steps.append((*parts[i][:2], back[i][1]))
                i = back[i][0]
            if required <= {e - x for _, e, new in steps for x in range(1, new + 1)}:
                break
        return top, steps


_scanner: list[Scanner] = []
_SPANS = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("coverage", pa.float64())]))


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and
    spans: template (its place in ``NOTICES``), label, first_word, end_word, coverage of each notice found."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner())
        for b in batches:
            cols = list(zip(*_scanner[0].scan(b.column(1)))) or [[]] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPANS]))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(tidy(read), "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<template: int, label: string, first_word: bigint, end_word: bigint, coverage: double>>")
