"""Licence notices and texts in documents, found by matching templates with markup.

A template is the wording of a notice. ``<<beginOptional>> … <<endOptional>>`` encloses words that may be left out, ``<<var;name="…";
original="…";match="…";words="1-3">>`` stands for 1 to 3 words of any kind that each match the expression. Each template is compiled
into a token automaton: a state per position, an edge per word, empty edges past optional regions, counted loops for
replaceable ones. A place in a text is accepted when all mandatory words stand there in order and nothing else
stands between; case and punctuation don't count.

A document is cut into words once. Only those that hold a word without which no template can match (one per template) run the
automata, and only from words a template can begin with, so time is linear in the text. No row depends on another: no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrays, texts

#: Bytes below 0x80 that are no ASCII letter or digit become blanks; everything else is part of a word.
BLANKS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))

# Phrases that name a licence, and public wordings of notices and short licences.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

GRANT = ('<<beginOptional>>this <<var;name="thing";original="work";match="[a-z]+";words="1-2">> is<<endOptional>> '
         '<<var;name="verb";original="licensed";match="licensed|released|distributed|available|published";words="1-1">> '
         'under <<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>> ')

TEMPLATES = {
    "gpl-notice": GRANT + 'GNU General Public License <<beginOptional>>version '
                          '<<var;name="version";original="3";match="[0-9]+";words="1-2">><<endOptional>>',
    "gpl-or-later": """This program is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the
terms of the GNU General Public License as published by the Free Software Foundation<<beginOptional>>,<<endOptional>> either
version <<var;name="version";original="3";match="[0-9]+";words="1-2">> of the License, or (at your option) any later version.""",
    "apache-2.0-notice": GRANT + 'Apache License<<beginOptional>>, Version<<endOptional>> 2.0',
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at
<<beginOptional>><<var;name="scheme";original="http";match="https?";words="1-1">> www.apache.org/licenses/LICENSE-2.0<<endOptional>>
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "cc-by-notice": GRANT + '<<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY '
                            '<<var;name="kind";original="NC";match="nc|nd|sa";words="0-2">> '
                            '<<var;name="version";original="4.0";match="[0-9]+";words="2-2">>',
    "cc-by-long": """Creative Commons Attribution <<var;name="kind";original="";match="noncommercial|non|commercial|sharealike|share|alike|noderivatives|no|derivatives";words="0-4">>
<<var;name="version";original="4.0";match="[0-9]+";words="2-2">> <<beginOptional>>International<<endOptional>> License""",
    "mit-notice": GRANT + 'MIT License',
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
<<beginOptional>>and associated documentation files<<endOptional>> <<beginOptional>>(the "Software")<<endOptional>>, to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holder";original="the authors or copyright holders";words="1-20">> BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, <<beginOptional>>and<<endOptional>><<beginOptional>>/or<<endOptional>> distribute this
software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice
appear in all copies.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. <<beginOptional>><<beginOptional>>3.<<endOptional>> Neither the name of
<<var;name="holder";original="the copyright holder";words="1-20">> nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.<<endOptional>>""",
    "spdx-tag": 'SPDX-License-Identifier: <<var;name="id";original="MIT";words="1-1">>',
}

MARK = re.compile(r"<<(beginOptional|endOptional|var;.*?)>>", re.DOTALL)
FIELD = re.compile(r';(\w+)="(.*?)"', re.DOTALL)


def split_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text, A-Z lowered."""
    return text.lower().translate(BLANKS).split() if text else []


@dataclass(frozen=True)
class Region:
    """A replaceable region: ``least`` to ``most`` words that each match ``match`` whole."""

    least: int
    most: int
    match: str


Part = bytes | Region | list  # a word, a replaceable region, or an optional list of parts


def parse(template: str) -> list[Part]:
    """The parts of a template; a list inside is an optional region."""
    open_lists: list[list[Part]] = [[]]
    at = 0
    for mark in MARK.finditer(template):
        open_lists[-1] += split_words(template[at:mark.start()].encode())
        at = mark.end()
        if mark[1] == "beginOptional":
            open_lists.append([])
        elif mark[1] == "endOptional":
            if len(open_lists) == 1:
                raise ValueError("an optional region ends that never began")
            inner = open_lists.pop()
            if inner:
                open_lists[-1].append(inner)
        else:
            fields = dict(FIELD.findall(mark[1]))
            least, most = map(int, fields.get("words", "1-1").split("-"))
            if not 0 <= least <= most:
                raise ValueError(f"words={fields['words']!r}: need 0 <= least <= most")
            open_lists[-1].append(Region(least, most, fields.get("match", ".+")))
    if len(open_lists) > 1:
        raise ValueError("an optional region has no end")
    return open_lists[0] + split_words(template[at:].encode())


@dataclass
class Automaton:
    """States 0 to n; ``words[s]``: edges by word, ``tests[s]``: edges by expression, ``free[s]``: empty edges."""

    words: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    tests: list[list[tuple[re.Pattern, int]]] = field(default_factory=lambda: [[]])
    free: list[list[int]] = field(default_factory=lambda: [[]])

    def state(self) -> int:
        for edges, empty in ((self.words, {}), (self.tests, []), (self.free, [])):
            edges.append(empty)
        return len(self.words) - 1

    def add(self, at: int, parts: Sequence[Part]) -> int:
        """Append parts after state ``at``; returns the last state."""
        for part in parts:
            if isinstance(part, bytes):
                end = self.state()
                self.words[at][part] = end
                at = end
            elif isinstance(part, Region):
                at = self._region(at, part)
            else:
                end = self.add(self._after(at), part)
                self.free[at].append(end)
                at = end
        return at

    def _after(self, at: int) -> int:
        """A fresh state behind an empty edge, so that edges of neighbouring regions don't mix."""
        new = self.state()
        self.free[at].append(new)
        return new

    def _region(self, at: int, region: Region) -> int:
        test = re.compile(region.match.encode())
        at, leave = self._after(at), []
        for i in range(region.most):
            if i >= region.least:
                leave.append(at)
            new = self.state()
            self.tests[at].append((test, new))
            at = new
        for state in leave:
            self.free[state].append(at)
        return at

    def closure(self, states: Sequence[int]) -> set[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen


def _mandatory(parts: Sequence[Part]) -> list[bytes]:
    return [p for p in parts if isinstance(p, bytes)]


class Template:
    def __init__(self, label: str, text: str) -> None:
        parts = parse(text)
        if not _mandatory(parts):
            raise ValueError(f"{label}: a template needs a mandatory word")
        self.label = label
        self.anchor = max(_mandatory(parts), key=len)  # no match without it
        self.automaton = Automaton()
        self.end = self.automaton.add(0, parts)
        self.begin = self.automaton.closure([0])

    def begins_with(self, word: bytes) -> bool:
        a = self.automaton
        return any(word in a.words[s] or any(t.fullmatch(word) for t, _ in a.tests[s]) for s in self.begin)

    def longest(self, words: Sequence[bytes], i: int) -> int:
        """End of the longest accepted run of words from ``i`` on; ``i`` if there is none."""
        a, states, best = self.automaton, self.begin, i
        for j in range(i, len(words)):
            word = words[j]
            reached = [a.words[s][word] for s in states if word in a.words[s]]
            reached += [to for s in states for test, to in a.tests[s] if test.fullmatch(word)]
            if not reached:
                break
            states = a.closure(reached)
            if self.end in states:
                best = j + 1
        return best


class Scanner:
    """Phrases and templates, ready to scan lists of words."""

    def __init__(self, phrases: Mapping[str, str], templates: Mapping[str, str]) -> None:
        self.phrases = [(split_words(p.encode()), label) for p, label in phrases.items()]
        self.templates = [Template(label, t) for label, t in templates.items()]
        self.anchors = {t.anchor for t in self.templates} | {max(p, key=len) for p, _ in self.phrases}
        self.by_first: dict[bytes, list] = {}

    def _starting(self, word: bytes) -> list:
        """What can begin with a word; remembered for words met where it matters."""
        if len(self.by_first) > 200_000:
            self.by_first.clear()
        found = self.by_first.get(word)
        if found is None:
            found = self.by_first[word] = [p for p in self.phrases if p[0][0] == word] + [
                t for t in self.templates if t.begins_with(word)]
        return found

    def places(self, words: list[bytes]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(label, first word, last word) of all phrases, and of the templates' places: leftmost, then longest, none
        overlapping another of its template."""
        if self.anchors.isdisjoint(words):
            return [], []
        base, own = [], []
        free_from: dict[str, int] = {}
        for i, word in enumerate(words):
            for kind in self._starting(word):
                if isinstance(kind, Template):
                    if i >= free_from.get(kind.label, 0):
                        end = kind.longest(words, i)
                        if end > i:
                            own.append((kind.label, i, end - 1))
                            free_from[kind.label] = end
                elif words[i:i + len(kind[0])] == kind[0]:
                    base.append((kind[1], i, i + len(kind[0]) - 1))
        return base, own


RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, places array<struct<label: string, first: long, last: long>>, text_key long")
PLACES = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))


def largest_share(n_words: int, places: Sequence[tuple[str, int, int]]) -> float:
    """The largest part of the words that the places of one label cover."""
    covered: dict[str, int] = {}
    past: dict[str, int] = {}  # first word after the places of a label so far
    for label, first, last in sorted(places, key=lambda p: p[1:]):
        covered[label] = covered.get(label, 0) + max(0, last + 1 - max(first, past.get(label, 0)))
        past[label] = max(past.get(label, 0), last + 1)
    return max(covered.values()) / n_words if covered else 0.0


def _scan(phrases: Mapping[str, str], templates: Mapping[str, str]):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            rows = []
            for (text,) in arrays(batch, "text"):
                words = split_words(text)
                base, own = scanner.places(words)
                starts = [i for _, i, _ in base]
                names = {label for label, _, _ in base}
                rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None),
                             ",".join(sorted(names)), ",".join(sorted(names | {label for label, _, _ in own})),
                             largest_share(len(words), base + own),
                             [dict(zip(("label", "first", "last"), p, strict=True)) for p in base + own]))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), PLACES]
            cells = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            found = [pa.array(list(c), k) for c, k in zip(cells, kinds, strict=True)]
            ids, keys = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text_key"))
            yield pa.RecordBatch.from_arrays([ids, *found, keys], [c.split()[0] for c in (
                "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places", "text_key")])
    return job


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """Per document: doc_id, n_words, n_base (places of phrases), first_word and last_word (smallest and largest start of one,
    from 0; NULL without any), base_labels (of phrases), labels (of templates too), score (largest share of the words that one
    label's places cover, 0 to 1), places (label, first and last word), text_key.

    NULL and empty texts have no words, no labels and score 0. NULL ids stay NULL, rows that repeat are scanned each by
    itself, an empty table gives no rows. Only doc_id and text are read, other columns don't matter.
    """
    rows = texts(docs).withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(_scan(dict(phrases), dict(templates)), RESULT)


def expression(parts: Sequence[Part]) -> str:
    """The same as one regular expression over words written ``<word>``, for engines that have those only."""
    out = []
    for part in parts:
        if isinstance(part, bytes):
            out.append(f"<{re.escape(part.decode())}>")
        elif isinstance(part, Region):
            inner = "[^>]+" if part.match == ".+" else f"(?:{part.match})"
            out.append(f"(?:<{inner}>){{{part.least},{part.most}}}")
        else:
            out.append(f"(?:{expression(part)})?")
    return "".join(out)
