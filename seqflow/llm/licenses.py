"""License notices by template markup.

A template is text with ``<<optional>>...<<end>>`` regions, which may be absent,
and ``<<any N>>`` places, which stand for up to N words. It compiles into an automaton over
words; a stretch of a text is accepted where all mandatory wording matches word for word. Labels that end in
``-text`` stand for whole license texts or notices, the others for references of one clause. What comes before or
after an accepted stretch doesn't count, so terms that are added behind a whole license are not seen.
Automata start only at words that can begin a template, so other texts cost one look at each word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqflow.llm.texts import alnum_words, map_texts, utf8

#: Phrases and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_BSD_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met <<optional>>1<<end>> redistributions of source code must retain the above copyright "
    "notice this list of conditions and the following disclaimer <<optional>>2<<end>> redistributions in binary form must "
    "reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or "
    "other materials provided with the distribution ")
_BSD_ADVERTISING = (
    "<<optional>>3<<end>> all advertising materials mentioning features or use of this software must display the following "
    "acknowledgement <<optional>>this product includes software developed by <<any 12>><<end>> ")
_BSD_NAMES = (
    "<<any 1>> neither the <<any 1>> of <<any 12>> nor the names of <<any 2>> contributors may be used to "
    "endorse or promote products derived from this software without specific prior written permission ")
_BSD_DISCLAIMER = (
    "this software is provided by <<any 12>> as is and any express or implied warranties including but not limited to the "
    "implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<any 12>> "
    "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to "
    "procurement of substitute goods or services loss of use data or profits or business interruption however caused and on "
    "any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any "
    "way out of the use of this software even if advised of the possibility of such damage")
_AS_IS = (
    "the <<any 3>> is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the <<any 12>> be "
    "liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of "
    "or in connection with the <<any 3>> or the use or other dealings in the software")
_GPL_NOTICE = (
    "this <<any 4>> is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation <<optional>>either<<end>> version {} of the license "
    "<<optional>>or at your option any later version<<end>> this <<any 4>> is distributed in the hope that it will be useful "
    "but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see "
    "the gnu general public license for more details you should have received a copy of the gnu general public license "
    "along with this")

#: Licenses and their labels, in template markup: references of one clause, then whole notices and whole texts.
TEMPLATES = {
    "gpl-3.0": "gnu general public license <<optional>>as published by the free software foundation<<end>> "
               "<<optional>>either<<end>> version 3",
    "gpl-2.0": "gnu general public license <<optional>>as published by the free software foundation<<end>> "
               "<<optional>>either<<end>> version 2",
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit-notice": "<<optional>>this <<any 2>> is<<end>> released under the <<optional>>terms of the<<end>> mit license",
    "cc-by-nc": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> cc by nc <<optional>>sa<<end>> <<any 2>> 0",
    "cc-by-4.0": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> cc by <<optional>>sa<<end>> 4 0",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "reserved": "copyright <<any 8>> all rights reserved",
    "gpl-3.0-text": _GPL_NOTICE.format(3),
    "gpl-2.0-text": _GPL_NOTICE.format(2),
    "apache-2.0-text":
        "licensed under the apache license version 2 0 the license you may not use this <<any 2>> except in compliance with "
        "the license you may obtain a copy of the license at <<any 12>> unless required by applicable law or agreed to in "
        "writing software distributed under the license is distributed on an as is basis without warranties or conditions of "
        "any kind either express or implied see the license for the specific language governing permissions and limitations "
        "under the license",
    "mpl-2.0-text":
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at",
    "mit-text":
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the <<any 3>> to deal in the <<any 3>> without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the <<any 3>> and to permit "
        "persons to whom the <<any 3>> is furnished to do so subject to the following conditions the above copyright notice "
        "and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or "
        "substantial portions of the <<any 3>> " + _AS_IS,
    "isc-text":
        "permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without fee "
        "is hereby granted provided that the above copyright notice and this permission notice appear in all copies the "
        "software is provided as is and <<any 6>> disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall <<any 6>> be liable for any special direct indirect or "
        "consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of "
        "contract negligence or other tortious action arising out of or in connection with the use or performance of this "
        "software",
    "bsd-2-clause-text": _BSD_CONDITIONS + _BSD_DISCLAIMER,
    "bsd-3-clause-text": _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER,
    "bsd-4-clause-text": _BSD_CONDITIONS + _BSD_ADVERTISING + _BSD_NAMES + _BSD_DISCLAIMER,
    "zlib-text":
        "this software is provided as is without any express or implied warranty in no event will the <<any 4>> be held "
        "liable for any damages arising from the use of this software permission is granted to anyone to use this software "
        "for any purpose including commercial applications and to alter it and redistribute it freely subject to the "
        "following restrictions <<optional>>1<<end>> the origin of this software must not be misrepresented you must not "
        "claim that you wrote the original software if you use this software in a product an <<any 1>> in the product "
        "documentation would be appreciated but is not required <<optional>>2<<end>> altered source versions must be plainly "
        "marked as such and must not be misrepresented as being the original software <<optional>>3<<end>> this notice may "
        "not be removed or altered from any source distribution",
    "unlicense-text":
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
        "compile sell or distribute this software either in source code form or as a compiled binary for any purpose "
        "commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of "
        "this software dedicate any and all copyright interest in the software to the public domain we make this dedication "
        "for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to "
        "be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright "
        "law " + _AS_IS,
}
_MARK = re.compile(r"<<(optional|end|any (\d+))>>")


@dataclass
class Template:
    """Automaton: ``steps[s]`` are moves on a word, ``free[s]`` moves on any word, ``skip[s]`` moves on nothing."""

    label: str
    steps: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    free: list[int | None] = field(default_factory=lambda: [None])
    skip: list[list[int]] = field(default_factory=lambda: [[]])

    def _new(self) -> int:
        self.steps.append({})
        self.free.append(None)
        self.skip.append([])
        return len(self.steps) - 1

    @classmethod
    def compile(cls, label: str, markup: str) -> Template:
        t, state, open_at, at = cls(label), 0, [], 0
        for m in [*_MARK.finditer(markup), None]:
            for w in alnum_words(markup[at:m.start() if m else len(markup)].encode()):
                new = t._new()
                t.steps[state][w] = new
                state = new
            if m is None:
                break
            at = m.end()
            if m[1] == "optional":
                open_at.append(state)
            elif m[1] == "end":
                new = t._new()
                t.skip[state].append(new)
                t.skip[open_at.pop()].append(new)
                state = new
            else:
                end = t._new()
                for _ in range(int(m[2])):
                    new = t._new()
                    t.skip[state].append(end)
                    t.free[state] = new
                    state = new
                t.skip[state].append(end)
                state = end
        if open_at:
            raise ValueError(f"template {label}: optional region without end")
        t.last = state
        if t.last in t._closure({0}):
            raise ValueError(f"template {label}: no mandatory wording")
        return t

    def _closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for n in self.skip[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    def first_words(self) -> set[bytes] | None:
        """Words that can begin a match; None if any word can."""
        start = self._closure({0})
        if any(self.free[s] is not None for s in start):
            return None
        return {w for s in start for w in self.steps[s]}

    def match(self, words: list[bytes], at: int) -> int | None:
        """End of the shortest match that begins at word ``at``."""
        states = self._closure({0})
        while self.last not in states:
            if at >= len(words):
                return None
            w = words[at]
            states = self._closure({n for s in states for n in (self.steps[s].get(w), self.free[s]) if n is not None})
            if not states:
                return None
            at += 1
        return at


def _scan(phrases: Mapping[str, str], templates: Mapping[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = [(alnum_words(p.encode()), label) for p, label in phrases.items()]
        automata = [Template.compile(label, t) for label, t in templates.items()]
        begins: dict[bytes, list] = {}
        for words, label in plain:
            begins.setdefault(words[0], []).append((words, label, None))
        for t in automata:
            first = t.first_words()
            if first is None:
                raise ValueError(f"template {t.label} begins with any word")
            for w in first:
                begins.setdefault(w, []).append((None, t.label, t))
        names = frozenset(begins)
        for b in batches:
            out: list[list] = [[], [], []]
            for text in utf8(b.column(1)):
                words = alnum_words(text)
                places, matches = [], []
                if not names.isdisjoint(words):
                    for i, w in enumerate(words):
                        for phrase, label, t in begins.get(w, ()):
                            if t is None:
                                if words[i:i + len(phrase)] == phrase:
                                    places.append({"label": label, "first": i, "last": i + len(phrase)})
                            elif (end := t.match(words, i)) is not None:
                                matches.append({"label": label, "first": i, "last": end})
                for column, value in zip(out, (len(words), places, matches)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([
                b.column(0).cast(pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], _PLACES),
                pa.array(out[2], _PLACES)], ["doc_id", "n_words", "places", "matches"])
    return run


_PLACES = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
_SQL = "array<struct<label:string,first:bigint,last:bigint>>"


def find_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, places, matches`` for every row: words from 0, end exclusive.

    ``places``: phrases; ``matches``: texts that a template accepts, the shortest from each start. Null and empty texts
    have no words. Repeated ids and rows are reported row by row; other columns, whatever their names, are left out.
    """
    for label, t in templates.items():
        Template.compile(label, t)
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_texts(source, ["doc_id", "text"], _scan(dict(phrases), dict(templates)),
                     f"doc_id bigint, n_words bigint, places {_SQL}, matches {_SQL}")


def license_report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score``: 0 without a label, else half for a phrase and the rest for the share of all labels that a template gave.
    """
    found = find_licenses(docs, **options)
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    own = F.array_distinct(F.transform("matches", lambda p: p["label"]))
    every = F.array_sort(F.array_union(base, own))
    starts = F.transform("places", lambda p: p["first"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size(every) == 0, 0.0).otherwise(0.5 + 0.5 * F.size(own) / F.size(every)).alias("score"))
