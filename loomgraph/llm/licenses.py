"""License scan: templates with optional and replaceable regions as token automata.

A template is text with three marks:

    [[ ... ]]    an optional region, may be absent as a whole; regions may nest
    {{name:n}}   a replaceable region, 0 to n words of any kind
    the rest     mandatory wording, word for word

A template compiles into a nondeterministic automaton over words. Words are what the scan
calls words, so case, punctuation, line breaks and markup do not count inside a match. A
match begins where the text or a sentence or line begins, and ends where one ends: wording
that goes on ("... Version 2.0 for schools only") is no match. Bodies are whole licenses,
with all their conditions and disclaimers; notices are sentences or headers that name one.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import ship_package

# Base phrases and their labels, and wording of public licenses.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

NOTICES = {
    "apache-2.0-notice": "[[{{what:6}} is]] licensed under the apache license [[as published at {{where:6}}]] version 2.0",
    "apache-2.0-header": """licensed under the apache license version 2.0 the license you may not use this file except in
        compliance with the license you may obtain a copy of the license at [[http]] [[https]] www.apache.org licenses
        license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is
        distributed on an as is basis without warranties or conditions of any kind either express or implied see the
        license for the specific language governing permissions and limitations under the license""",
    "cc-by-nc-4.0-notice": "[[{{what:6}} is]] licensed under [[the]] [[creative commons]] [[a]] cc by nc 4.0 [[international]] [[license]]",
    "gpl-3.0-notice": """[[{{what:6}} is]] licensed under the [[terms of the]] gnu general public license
        [[as published by the free software foundation [[either]]]] version 3 [[or [[at your option]] [[any]] later [[version]]]]""",
    "gpl-3.0-header": """[[this {{what:6}} is free software]] you can redistribute it and or modify it under the terms of the gnu
        general public license as published by the free software foundation either version 3 of the license or at your
        option any later version""",
    "mit-notice": "[[{{what:6}} is]] released under the [[{{kind:2}}]] mit license",
    "all-rights-reserved": "[[copyright [[c]] {{holder:12}}]] all rights reserved",
}

BODIES = {
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and
        associated documentation files the software to deal in the software without restriction including without
        limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
        and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all
        copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall
        {{holders:12}} be liable for any claim damages or other liability whether in an action of contract tort or
        otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
    "isc": """permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is
        hereby granted provided that the above copyright notice and this permission notice appear in all copies
        the software is provided as is and {{holders:12}} disclaims all warranties with regard to this software
        including all implied warranties of merchantability and fitness in no event shall {{holders:12}} be liable for
        any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data
        or profits whether in an action of contract negligence or other tortious action arising out of or in connection
        with the use or performance of this software""",
    "bsd": """redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met [[1]] redistributions of source code must retain the above copyright notice
        this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the
        above copyright notice this list of conditions and the following disclaimer in the documentation and or other
        materials provided with the distribution [[[[3]] neither the name of {{holder:12}} nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior
        written permission]] this software is provided by {{holders:12}} as is and any express or implied warranties
        including but not limited to the implied warranties of merchantability and fitness for a particular purpose are
        disclaimed in no event shall {{holders:12}} be liable for any direct indirect incidental special exemplary or
        consequential damages including but not limited to procurement of substitute goods or services loss of use data
        or profits or business interruption however caused and on any theory of liability whether in contract strict
        liability or tort including negligence or otherwise arising in any way out of the use of this software even if
        advised of the possibility of such damage""",
    "zlib": """this software is provided as is without any express or implied warranty in no event will {{authors:12}} be
        held liable for any damages arising from the use of this software permission is granted to anyone to use this
        software for any purpose including commercial applications and to alter it and redistribute it freely subject to
        the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that
        you wrote the original software if you use this software in a product an acknowledgment in the product
        documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as
        such and must not be misrepresented as being the original software [[3]] this notice may not be removed or
        altered from any source distribution""",
    "unlicense": """this is free and unencumbered software released into the public domain anyone is free to copy modify
        publish use compile sell or distribute this software either in source code form or as a compiled binary for any
        purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author
        or authors of this software dedicate any and all copyright interest in the software to the public domain we make
        this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend
        this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
        software under copyright law the software is provided as is without warranty of any kind express or implied
        including but not limited to the warranties of merchantability fitness for a particular purpose and
        noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an
        action of contract tort or otherwise arising from out of or in connection with the software or the use or other
        dealings in the software""",
}

#: Bytes that end a sentence or a line become line breaks, other ASCII bytes than digits and letters blanks, A-Z become a-z.
STOPS = b"\n\r.;!?"
TABLE = bytes(
    10 if c in STOPS else c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
MARKS = re.compile(rb"\[\[|\]\]|\{\{\w+:(\d+)\}\}")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def stops_of(text: bytes) -> list[int]:
    """Numbers of the words that begin a sentence or a line, and the number of words."""
    out, at = [0], 0
    for part in text.translate(TABLE).split(b"\n"):
        if n := len(part.split()):
            at += n
            out.append(at)
    return out


@dataclass
class Node:
    """A parsed region: words, gaps (an int, the most words) and optional sub-regions."""

    parts: list[bytes | int | Node] = field(default_factory=list)


def parse(template: str) -> Node:
    """The tree of a template; raises ValueError where marks do not match."""
    raw, at, stack = template.encode(), 0, [Node()]
    for mark in MARKS.finditer(raw):
        stack[-1].parts += words_of(raw[at : mark.start()])
        at = mark.end()
        if mark[0] == b"[[":
            stack.append(Node())
        elif mark[0] == b"]]":
            if len(stack) == 1:
                raise ValueError("a region ends that did not begin")
            inner = stack.pop()
            stack[-1].parts.append(inner)
        else:
            stack[-1].parts.append(int(mark[1]))
    if len(stack) > 1:
        raise ValueError("a region does not end")
    stack[-1].parts += words_of(raw[at:])
    return stack[0]


class Automaton:
    """States are numbered; each has word edges, any-word edges and empty edges."""

    def __init__(self, template: str):
        self.word: list[dict[bytes, int]] = [{}]
        self.free: list[list[int]] = [[]]
        self.skip: list[list[int]] = [[]]
        self.final = self._add(parse(template), 0)
        self.start = self._close({0})
        if self.final in self.start:
            raise ValueError("a template needs mandatory words")
        #: Words that every match has.
        self.needed = frozenset(p for p in parse(template).parts if isinstance(p, bytes))

    def _state(self) -> int:
        for edges, new in ((self.word, {}), (self.free, []), (self.skip, [])):
            edges.append(new)
        return len(self.word) - 1

    def _add(self, node: Node, at: int) -> int:
        for part in node.parts:
            if isinstance(part, Node):
                end = self._add(part, at)
                self.skip[at].append(end)
                at = end
            elif isinstance(part, int):
                end = self._state()
                self.skip[at].append(end)
                for _ in range(part):
                    new = self._state()
                    self.free[at].append(new)
                    self.skip[new].append(end)
                    at = new
                at = end
            else:
                new = self._state()
                self.word[at][part] = new
                at = new
        return at

    def _close(self, states: set[int]) -> frozenset[int]:
        todo, found = list(states), set(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return frozenset(found)

    def matches(self, words: list[bytes], at: int, ends: Container[int] | None = None) -> bool:
        """Whether some words from place `at` on are accepted that end before a place in `ends` (None: any)."""
        states = self.start
        for i in range(at, len(words)):
            word = words[i]
            moved = {t for s in states for t in self.free[s]} | {t for s in states if (t := self.word[s].get(word)) is not None}
            if not moved:
                return False
            states = self._close(moved)
            if self.final in states and (ends is None or i + 1 in ends):
                return True
        return False


class Scanner:
    """All phrases and templates at once; an automaton runs only over texts that have all its mandatory words."""

    def __init__(self, phrases: dict[str, str] | None = None, bodies: dict[str, str] | None = None, notices: dict[str, str] | None = None):
        self.phrases = [(p.encode().split(), label) for p, label in (PHRASES if phrases is None else phrases).items()]
        self.kinds = [{k: Automaton(t) for k, t in x.items()} for x in (BODIES if bodies is None else bodies, NOTICES if notices is None else notices)]
        self.begins = {p[0] for p, _ in self.phrases}

    def scan(self, text: bytes) -> dict:
        words = words_of(text)
        there = set(words)
        places: list[int] = []
        base: set[str] = set()
        if not self.begins.isdisjoint(there):
            for i, word in enumerate(words):
                if word in self.begins:
                    for phrase, label in self.phrases:
                        if word == phrase[0] and words[i : i + len(phrase)] == phrase:
                            places.append(i)
                            base.add(label)
        found: list[set[str]] = []
        stops: list[int] = []
        for automata in self.kinds:
            found.append(set())
            for label, automaton in automata.items():
                if automaton.needed <= there:
                    stops = stops or stops_of(text)
                    ends = set(stops)
                    if any(automaton.matches(words, i, ends) for i in stops[:-1]):
                        found[-1].add(label)
        bodies, notices = found
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(places, default=None),
            "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | bodies | notices)),
            "score": 1.0 if bodies else 0.75 if notices else 0.5 if base else 0.0,
            "bodies": ",".join(sorted(bodies)),
            "notices": ",".join(sorted(notices)),
        }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, bodies string, notices string"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, bodies: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """One row per row of docs: id_col, word count, base phrase places, labels and score.

    score is 1 if a body (a whole license) is accepted, 0.75 if a notice is, 0.5 if only base
    phrases occur, else 0. Null texts count as empty: no words, no labels, score 0. Repeated
    rows come back repeated; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [f.split() for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, bodies, notices)
        for batch in batches:
            found = [scanner.scan((t.as_py() or "").encode()) for t in batch.column(1)]
            arrays = [pa.array([f[name] for f in found], kinds[kind]) for name, kind in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", *(name for name, _ in fields)])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {SCHEMA}")
    return out.withColumnRenamed("id", id_col)


def oracle() -> str:
    """DuckDB SQL for the same rows over `documents`.

    SQL itself turns the wording of each template into a regular expression; the automata
    have no part in it. In the text that is matched, S stands where a sentence or line ends.
    """
    values = ", ".join(f"('{kind}', '{label}', '{' '.join(t.split())}')" for kind, group in (("body", BODIES), ("notice", NOTICES)) for label, t in group.items())
    phrase = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    return rf"""
        with template(kind, label, source) as (values {values}),
        phrase(words, label) as (values {phrase}),
        mark as (
            select kind, label, list_filter(string_split(regexp_replace(replace(replace(replace(source, '.', ' '), '[[', ' [ '), ']]', ' ] '), '\{{\{{\w+:(\d+)\}}\}}', ' #\1 ', 'g'), ' '), lambda x: x <> '') as parts
            from template
        ), pattern as (
            select kind, label, ' S' || array_to_string(list_transform(parts, lambda x: case
                when x = '[' then '(?:' when x = ']' then ')?' when starts_with(x, '#') then '(?:(?: S)? [^ S]+){{0,' || substr(x, 2) || '}}'
                else '(?: S)? ' || x end), '') || ' S' as regex
            from mark
        ), clean as (
            select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents
        ), split as (
            select row_number() over () as r, doc_id, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w,
                   regexp_replace(' S ' || regexp_replace(regexp_replace(regexp_replace(low, '[\n\r.;!?]', 'S', 'g'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]*S[\x00-\x2F\x3A-\x60\x7B-\x7F]*', ' S ', 'g'),
                                                          '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g') || ' S ', ' [ S]*S ', ' S ', 'g') as t
            from clean
        ), base as (
            select r, count(*) as n, min(i) as lo, max(i) as hi, string_agg(distinct label, ',' order by label) as names
            from (select r, label, unnest(list_filter(range(len(w)), lambda i: list_slice(w, i + 1, i + len(string_split(words, ' '))) = string_split(words, ' '))) as i
                  from split join phrase on contains(' ' || array_to_string(w, ' ') || ' ', ' ' || words || ' '))
            group by r
        ), method as (
            select r, kind, label from split join pattern on regexp_matches(t, regex)
        ), named as (
            select r, string_agg(label, ',' order by label) filter (kind = 'body') as bodies, string_agg(label, ',' order by label) filter (kind = 'notice') as notices from method group by r
        ), every as (
            select r, string_agg(distinct label, ',' order by label) as labels
            from (select r, label from method union all select r, unnest(string_split(names, ',')) from base) group by r
        )
        select doc_id, len(w) as n_words, coalesce(n, 0) as n_base, lo as first_word, hi as last_word,
               coalesce(names, '') as base_labels, coalesce(labels, '') as labels,
               case when bodies is not null then 1.0 when notices is not null then 0.75 when n > 0 then 0.5 else 0.0 end::double as score,
               coalesce(bodies, '') as bodies, coalesce(notices, '') as notices
        from split left join base using (r) left join named using (r) left join every using (r)"""
