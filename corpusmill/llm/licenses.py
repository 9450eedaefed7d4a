"""License scans: templates with optional and replaceable regions, compiled into automata over words.

A template is its words; `[ ... ]` is a region that may be missing and may hold other regions; `{name:k}` is a
region that stands for up to k words of any kind. Every other word is mandatory and must stand there as it is.
Texts are lowered (A to Z) and cut into words, so punctuation and layout don't count.

A compiled template is a nondeterministic automaton whose states are places in the template. Scans try it at
every word pair with which some template can begin; sets of states are made deterministic as texts need them.

Edge cases: null and empty texts have no words and no matches; matches may overlap; at one word each template gives its
longest match; repeated rows are scanned one by one; other columns are untouched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.llm.common import array_udf
from corpusmill.llm.words import blocks

#: Phrases that always count, whatever stands around them, with their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Mandatory wording of public licenses and of the notices that name them.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [the software] to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software"),
    ("mit", "licensed under [the terms of] [the] mit license"),
    ("mit", "spdx license identifier mit"),
    ("isc", "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "licensed under [the terms of] [the] isc license"),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [3] neither the name of {holder:12} nor the names of [its] {contributors:6} may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2", "licensed under [the terms of] the apache license [version] 2 0"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("gpl-2", "gnu general public license [as published by the free software foundation] [either] [v] [version] 2"),
    ("gpl-3", "gnu general public license [as published by the free software foundation] [either] [v] [version] 3"),
    ("gpl-3", "gnu gpl v3"),
    ("lgpl", "gnu [library or] lesser general public license"),
    ("agpl-3", "gnu affero general public license"),
    ("mpl-2", "mozilla public license [v] [version] 2 0"),
    ("cc-by", "creative commons attribution [{version:2}] [international] [unported] [public] license"),
    ("cc-by", "cc by 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nc", "creative commons attribution non commercial"),
    ("cc0", "cc0 1 0 [universal]"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "released into the public domain"),
    ("all-rights-reserved", "[copyright [c] {holder:12}] all rights reserved"),
)

_PIECE = re.compile(r"\[|\]|\{\w+:(\d+)\}|[^\s\[\]{}]+")
#: Deterministic states that a worker keeps before it starts anew.
MOST_STATES = 50_000


def parsed(markup: str) -> list:
    """A template as a list: words, counts of free words, and lists for optional regions."""
    stack: list[list] = [[]]
    for m in _PIECE.finditer(markup):
        if m[0] == "[":
            stack.append([])
        elif m[0] == "]":
            inner = stack.pop()
            stack[-1].append(inner)
        else:
            stack[-1].append(int(m[1]) if m[1] else m[0])
    if len(stack) != 1:
        raise ValueError(f"brackets don't match: {markup}")
    return stack[0]


@dataclass
class Automaton:
    """States are numbers; each has a word (None: any, False: no word) that leads to the next one, and states that need no word."""

    words: list[str | bool | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    accepts: dict[int, int] = field(default_factory=dict)

    def add(self, markup: str, number: int) -> None:
        self.starts.append(len(self.words))
        self._compile(parsed(markup))
        self.accepts[self._state(None)] = number

    def _state(self, word: str | bool | None) -> int:
        self.words.append(word)
        self.free.append([])
        return len(self.words) - 1

    def _compile(self, items: list) -> None:
        for item in items:
            if isinstance(item, str):
                self._state(item)
            else:
                skipped = [len(self.words)] if isinstance(item, list) else list(range(len(self.words), len(self.words) + item))
                if isinstance(item, list):
                    # a state of its own stands before the region, as a region may begin with another one
                    self._state(False)
                    self.free[-1].append(len(self.words))
                    self._compile(item)
                else:
                    for _ in range(item):
                        self._state(None)
                for s in skipped:
                    self.free[s].append(len(self.words))

    def closure(self, states) -> frozenset[int]:
        out, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                todo += self.free[s]
        return frozenset(out)

    def step(self, states: frozenset[int], word: str) -> frozenset[int]:
        moved = [s + 1 for s in states if s not in self.accepts and (self.words[s] is None or self.words[s] == word)]
        return self.closure(moved)


class Scanner:
    """All templates in one automaton, with numbers for their words and sets of states made as they are met."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.automaton = a = Automaton()
        for number, (_, markup) in enumerate(templates):
            a.add(markup, number)
        self.names = ["", *sorted({w for w in a.words if w})]  # 0: a word of no template
        self.number = {w.encode(): i for i, w in enumerate(self.names)}
        size = len(self.names)
        self.begin = a.closure(a.starts)
        self.pairs = np.zeros((size, size), bool)  # with which two words a match can begin
        for first in range(1, size):
            after = a.step(self.begin, self.names[first])
            for s in after:
                if s in a.accepts:
                    raise ValueError("a template must have two words that can't be missing")
                if a.words[s] is None:
                    self.pairs[first, :] = True
                elif a.words[s]:
                    self.pairs[first, self.number[a.words[s].encode()]] = True
        self.moves: dict = {}

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Numbers of words given as bytes; each distinct word is looked up once."""
        if not len(words):
            return np.zeros(0, np.int32)
        coded = words.dictionary_encode()
        found = np.fromiter((self.number.get(w, 0) for w in coded.dictionary.to_pylist()), np.int32)
        return found[coded.indices.to_numpy()]

    def _move(self, states: frozenset, word: int) -> tuple[frozenset, tuple[int, ...]]:
        if len(self.moves) > MOST_STATES:
            self.moves.clear()
        a = self.automaton
        after = a.step(states, self.names[word])
        self.moves[states, word] = out = (after, tuple(a.accepts[s] for s in after if s in a.accepts))
        return out

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first word, words) of every match, by first word and template."""
        out = []
        for at in np.flatnonzero(self.pairs[words[:-1], words[1:]]).tolist():
            states, longest, i = self.begin, {}, at
            while states and i < len(words):
                word = int(words[i])
                states, done = self.moves.get((states, word)) or self._move(states, word)
                i += 1
                for number in done:
                    longest[number] = i - at
            out += [(number, at, longest[number]) for number in sorted(longest)]
        return out


def mandatory(markup: str) -> int:
    """Words of a template that can't be missing."""
    return sum(isinstance(x, str) for x in parsed(markup))


@cache
def _scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates)


_MATCH = "struct<label: string, base: boolean, first: bigint, words: bigint, mandatory: int>"


def scanned(text: Column, base: tuple = BASE, templates: tuple = TEMPLATES) -> Column:
    """Struct of n_words and matches (label, base, first, words, mandatory) of each whole text."""
    every = base + templates
    needed = [mandatory(markup) for _, markup in every]
    kind = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("words", pa.int64()), ("mandatory", pa.int32())])

    def scan(texts: pa.Array) -> pa.Array:
        scanner = _scanner(every)
        parts: list[list] = [[] for _ in range(len(texts))]
        for block in blocks(texts):
            numbers = scanner.numbers(block.strings())
            rows, begins = np.unique(block.row, return_index=True)
            for row, some in zip(rows.tolist(), np.split(numbers, begins[1:])):
                parts[row].append(some)
        counts, found = [], []
        for each in parts:
            words = np.concatenate(each) if each else np.zeros(0, np.int32)
            counts.append(len(words))
            found.append([{"label": every[n][0], "base": n < len(base), "first": at, "words": long, "mandatory": needed[n]} for n, at, long in scanner.matches(words)])
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(found, pa.list_(kind))], names=["n_words", "matches"])

    return array_udf(scan, f"struct<n_words: bigint, matches: array<{_MATCH}>>")(text)


def score(matches: Column) -> Column:
    """How sure a scan is, from 0 to 1: 1 - 1/(1+m), m the mandatory words of the longest template that matched."""
    most = F.coalesce(F.array_max(F.transform(matches, lambda x: x["mandatory"])), F.lit(0))
    return F.lit(1.0) - F.lit(1.0) / (most + 1)


def labels(matches: Column) -> Column:
    """Distinct labels, sorted, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda x: x["label"]))), ",")


def pattern(markup: str) -> str:
    """The template as a regular expression over words that each stand between two spaces; for checks by SQL."""

    def told(items: list) -> str:
        out = ""
        for item in items:
            if isinstance(item, str):
                out += f" {item} "
            elif isinstance(item, int):
                out += f"( [^ ]+ ){{0,{item}}}"
            else:
                out += f"({told(item)})?"
        return out

    return told(parsed(markup))
