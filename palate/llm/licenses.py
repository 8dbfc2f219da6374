"""License scans by template-markup matching.

A template is license wording with two kinds of markup: ``<<beginOptional>>...<<endOptional>>`` encloses words that a
text may leave out, ``<<var;name=...;words=a-b>>`` stands for a to b words of any kind, ``<<var;name=...;match=x|y>>``
for one of a few phrases. Templates compile to one nondeterministic automaton over words; states reached together are
remembered as one, so a text costs a dictionary lookup per word after a possible first word. A text holds a license
where the mandatory wording stands in order, word for word, with only what the markup allows between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from palate.llm.common import alnum_words, in_process

#: Determinised states are forgotten beyond this number; they come back when needed.
MOST_STATES = 100_000
MARKUP = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")


@dataclass(frozen=True)
class Template:
    """``base`` templates are plain phrases whose places are counted."""

    label: str
    text: str
    base: bool = False

    def mandatory(self) -> int:
        """Words that every text of the template has."""
        count, inside = 0, 0
        for i, part in enumerate(MARKUP.split(self.text)):
            if i % 2:
                inside += {"beginOptional": 1, "endOptional": -1}.get(part, 0)
            elif not inside:
                count += len(alnum_words(part))
        return count


def strength(mandatory: int, span: int) -> float:
    """How much a match says, 0 to 1: more the more mandatory words it has, less what the markup let in between."""
    return round(mandatory / (mandatory + 2) * min(1.0, mandatory / span), 6)


#: The base phrases and their labels.
BASE = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)

_MIT = """permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "software"), to deal in the software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit
persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and
this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or
substantial portions of the software. the software is provided "as is", without warranty of any kind, express or
implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and
noninfringement. in no event shall <<var;name=holder;words=1-12>> be liable for any claim, damages or other liability,
whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use
or other dealings in the software."""

_ISC = """permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose
with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
copies. the software is provided "as is" and <<var;name=author;words=1-12>> disclaims all warranties with regard to this
software including all implied warranties of merchantability and fitness."""

_BSD = """redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: <<beginOptional>>1.<<endOptional>> redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> redistributions
in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""

_BSD_END = """this software is provided by <<var;name=holder;words=1-12>> "as is" and any express or implied warranties,
including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are
disclaimed. in no event shall <<var;name=holder;words=1-12>> be liable for any direct, indirect, incidental, special,
exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of
use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract,
strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if
advised of the possibility of such damage."""

_BSD_NAMES = """<<beginOptional>>3.<<endOptional>> neither the name of <<var;name=holder;words=1-12>> nor the names of
<<beginOptional>>its<<endOptional>> contributors may be used to endorse or promote products derived from this software
without specific prior written permission."""

_APACHE = """licensed under the apache license, version 2.0 (the "license"); you may not use this <<var;name=what;match=file|work|software>>
except in compliance with the license. you may obtain a copy of the license at <<var;name=p;match=http|https>>
www.apache.org/licenses/license-2.0 unless required by applicable law or agreed to in writing, software distributed under
the license is distributed on an "as is" basis, without warranties or conditions of any kind, either express or implied.
see the license for the specific language governing permissions and limitations under the license."""

_GNU = """this <<var;name=what;match=program|file|library|software|package>> is free software; you can redistribute it and/or
modify it under the terms of the gnu {name} general public license as published by the free software foundation, either
version {version} of the license, or (at your option) any later version. <<var;name=what;words=1-4>> is distributed in the
hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness
for a particular purpose. see the gnu {name} general public license for more details."""

_MPL = """this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not
distributed with this file, you can obtain one at <<var;name=p;match=http|https>> <<beginOptional>>www<<endOptional>>
mozilla.org/mpl/2.0"""

_ZLIB = """this software is provided as-is, without any express or implied warranty. in no event will the authors be held
liable for any damages arising from the use of this software. permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions"""

_UNLICENSE = """this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means."""

_LESSER = "<<var;name=kind;match=lesser|library>>"
#: What the parts of a Creative Commons name may be called in full.
_CC = {
    "nc": "<<var;name=nc;match=noncommercial|non commercial>>",
    "sa": "<<var;name=sa;match=sharealike|share alike>>",
    "nd": "<<var;name=nd;match=noderivatives|noderivs|no derivatives|no derivs>>",
}
_VERB = "<<var;name=verb;match=released|licensed|distributed>> under the <<beginOptional>>terms of the<<endOptional>>"
_PUBLISHED = "<<beginOptional>>as published by the free software foundation either<<endOptional>>"


def _creative_commons() -> Iterator[Template]:
    """Short names, full names and addresses of the attribution licenses."""
    port = "<<beginOptional>><<var;name=port;match=international|unported|generic>><<endOptional>>"
    for kind in ((), ("sa",), ("nc",), ("nd",), ("nc", "sa"), ("nc", "nd")):
        for version in (1, 2, 3, 4):
            label, short = "-".join(("cc-by", *kind, f"{version}.0")), " ".join(kind)
            full = " ".join(_CC[k] for k in kind)
            yield Template(label, f"cc by {short} {version}.0")
            yield Template(label, f"creative commons attribution {full} {version}.0 {port} <<beginOptional>>public<<endOptional>> license")
            yield Template(label, f"creativecommons.org/licenses/by {short} {version}.0")


#: Templates of the method's own: full texts and the notices that name a license.
OWN = (
    Template("mit", _MIT),
    Template("isc", _ISC),
    Template("bsd", _BSD),
    Template("bsd-2-clause", f"{_BSD} {_BSD_END}"),
    Template("bsd-3-clause", f"{_BSD} {_BSD_NAMES} {_BSD_END}"),
    Template("apache-2.0", _APACHE),
    Template("gpl-2.0", _GNU.format(name="", version="2")),
    Template("gpl-3.0", _GNU.format(name="", version="3")),
    Template("lgpl-2.1", _GNU.format(name=_LESSER, version="2.1")),
    Template("lgpl-3.0", _GNU.format(name=_LESSER, version="3")),
    Template("agpl-3.0", _GNU.format(name="affero", version="3")),
    Template("mpl-2.0", _MPL),
    Template("zlib", _ZLIB),
    Template("unlicense", _UNLICENSE),
    Template("mit", f"{_VERB} mit license"),
    Template("bsd", f"{_VERB} bsd license"),
    Template("apache-2.0", "licensed under the apache license <<var;name=v;match=version 2.0|2.0>>"),
    Template("gpl-3.0", f"gnu general public license {_PUBLISHED} <<var;name=v;match=version 3|v3>>"),
    Template("gpl-2.0", f"gnu general public license {_PUBLISHED} <<var;name=v;match=version 2|v2>>"),
    Template("lgpl", f"gnu {_LESSER} general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2.0", "mozilla public license <<var;name=v;match=version 2.0|v 2.0|2.0>>"),
    Template("bsl-1.0", "boost software license <<beginOptional>>version<<endOptional>> 1.0"),
    *_creative_commons(),
    Template("cc0-1.0", "cc0 1.0 <<beginOptional>>universal<<endOptional>>"),
    Template("reserved-notice", "copyright <<beginOptional>>(c)<<endOptional>> <<var;name=holder;words=1-8>> all rights reserved"),
)

ANY = b"\0any"


class Automaton:
    """Word automaton of all templates. States are numbers; ``step[s]`` maps a word to next states, with ANY for a
    word of any kind; ``free[s]`` are states entered without a word; ``ends[s]`` the template that ends there."""

    def __init__(self, templates: tuple[Template, ...]):
        self.templates = templates
        self.step: list[dict[bytes, list[int]]] = []
        self.free: list[list[int]] = []
        self.ends: dict[int, int] = {}
        starts = []
        for number, t in enumerate(templates):
            first = self._state()
            starts.append(first)
            last = self._compile(t.text, first)
            if first in self._closure([last]) or last in self._closure([first]):
                raise ValueError(f"template {t.label} has no mandatory words")
            self.ends[last] = number
        self.sets: list[frozenset[int]] = []
        self.numbers: dict[frozenset[int], int] = {}
        self.moves: list[dict[bytes, int]] = []
        self.accepts: list[tuple[int, ...]] = []
        self.start_set = frozenset(self._closure(starts))
        self.start = self._set(self.start_set)
        if any(ANY in self.step[s] for s in self.start_set):
            raise ValueError("a template must not begin with words of any kind")
        self.first = {w for s in self.start_set for w in self.step[s]}

    def _state(self) -> int:
        self.step.append({})
        self.free.append([])
        return len(self.step) - 1

    def _words(self, text: str, at: int) -> int:
        for w in alnum_words(text):
            new = self._state()
            self.step[at].setdefault(w, []).append(new)
            at = new
        return at

    def _compile(self, text: str, at: int) -> int:
        opened: list[int] = []
        parts = MARKUP.split(text)
        for i, part in enumerate(parts):
            if i % 2 == 0:
                at = self._words(part, at)
            elif part == "beginOptional":
                opened.append(at)
            elif part == "endOptional":
                skip, new = opened.pop(), self._state()
                self.free[at].append(new)
                self.free[skip].append(new)
                at = new
            else:
                fields = dict(x.split("=", 1) for x in part.split(";")[1:])
                new = self._state()
                if "match" in fields:
                    for choice in fields["match"].split("|"):
                        self.free[self._words(choice, at)].append(new)
                else:
                    least, most = map(int, fields["words"].split("-"))
                    for k in range(most + 1):
                        if k >= least:
                            self.free[at].append(new)
                        if k < most:
                            then = self._state()
                            self.step[at].setdefault(ANY, []).append(then)
                            at = then
                at = new
        if opened:
            raise ValueError("an optional region is not closed")
        return at

    def _closure(self, states) -> set[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def _set(self, states: frozenset[int]) -> int:
        if states not in self.numbers:
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            self.accepts.append(tuple(sorted(self.ends[s] for s in states if s in self.ends)))
        return self.numbers[states]

    def _move(self, number: int, word: bytes) -> int:
        to: set[int] = set()
        for s in self.sets[number]:
            to.update(self.step[s].get(word, ()))
            to.update(self.step[s].get(ANY, ()))
        return self._set(frozenset(self._closure(to))) if to else -1

    def find(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word, word after the last) of every place: for each start the longest match of each
        template, in order of the start."""
        first, found = self.first, []
        if len(self.sets) > MOST_STATES:
            self.sets, self.numbers, self.moves, self.accepts = [], {}, [], []
            self.start = self._set(self.start_set)
        for at in [i for i, w in enumerate(words) if w in first]:
            state, i, best = self.start, at, {}
            while i < len(words):
                word = words[i]
                to = self.moves[state].get(word)
                if to is None:
                    to = self._move(state, word)
                    if to >= 0 or word in first:
                        self.moves[state][word] = to
                if to < 0:
                    break
                state, i = to, i + 1
                for t in self.accepts[state]:
                    best[t] = i
            found += [(t, at, end) for t, end in sorted(best.items())]
        return found


FIELDS = [
    ("n_words", pa.int64()),
    ("n_base", pa.int64()),
    ("first_word", pa.int64()),
    ("last_word", pa.int64()),
    ("base_labels", pa.string()),
    ("labels", pa.string()),
    ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("stop", pa.int64())]))),
]


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + OWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_base (places of base phrases), first_word and last_word (their smallest
    and largest start, null without one), base_labels and labels (distinct, sorted, joined by commas), score (the
    largest ``strength`` of a match, 0 without one) and spans (label, first word, word after the last) of
    every match.

    Words are lower-cased (A-Z) runs of ASCII digits, letters and non-ASCII characters. Null and empty texts have no
    words and no labels. Repeated rows come back as often as they stand; a null id stays null; other columns are not
    read. Texts of any length are read whole. An empty table gives an empty table.
    """
    ddl = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
        " score double, spans array<struct<label: string, first: long, stop: long>>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = in_process(("licenses", templates), lambda: Automaton(templates))
        mandatory = [t.mandatory() for t in templates]
        for batch in batches:
            cols: list[list] = [[] for _ in FIELDS]
            for text in batch.column(1):
                words = alnum_words(text.as_py())
                found = automaton.find(words)
                base = [(templates[t].label, a) for t, a, _ in found if templates[t].base]
                row = (
                    len(words),
                    len(base),
                    min((a for _, a in base), default=None),
                    max((a for _, a in base), default=None),
                    ",".join(sorted({x for x, _ in base})),
                    ",".join(sorted({templates[t].label for t, _, _ in found})),
                    max((strength(mandatory[t], z - a) for t, a, z in found), default=0.0),
                    [{"label": templates[t].label, "first": a, "stop": z} for t, a, z in found],
                )
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            arrays = [pa.array(c, t) for c, (_, t) in zip(cols, FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *(n for n, _ in FIELDS)])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, ddl)
