"""License scan: templates with optional and replaceable regions, compiled into automata over words.

A template is a license's wording with markup: ``<<beginOptional>> ... <<endOptional>>`` (may nest) encloses words that may be missing, and
``<<var;min=0;max=8>>`` stands for so many words of any kind. What stands outside is mandatory and must match exactly, word by word, A-Z
lower-cased; signs between words don't count. The base phrases are templates of mandatory words only.

An automaton has one state for each number of template places passed. Its states are the bits of an integer: a word moves those whose next
place takes it, and an optional region is an edge over it. Automata are started where the words a template begins with (two at least) stand,
which numpy finds for a piece of text at a time by 64-bit hashes; the automaton compares the words themselves. From each start the first
acceptance is a match; matches may overlap.

No shuffle: each row is judged on its own, by whole text; a piece holds some megabytes of text or one longer document. Matches are the only thing
that grows with a text besides the text. Nulls: a null text has no words; rows that repeat a doc_id, or have none, are judged one by one. Extra columns are
dropped. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .tables import long_rows
from .words import LETTERS_DIGITS, LOWER, Words, pieces, words_of


@dataclass(frozen=True)
class Template:
    label: str
    markup: str
    base: bool = False


# The phrases of the contract.
BASE = (Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True))
# Wording of published licenses and of the notices that name them.
MORE = (
    Template("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software."""),
    Template("mit-notice", "released under the <<beginOptional>>terms of the<<endOptional>> MIT license"),
    Template("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution."""),
    Template("bsd-3-clause", """Neither the name of <<var;min=1;max=12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    Template("isc", """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies."""),
    Template("apache-2.0", """Licensed under the Apache License, Version 2.0"""),
    Template("apache-2.0-header", """Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License")<<endOptional>>; you may not use this file except in compliance with the License. You may obtain a copy of the License at
        <<var;min=0;max=12>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS"""),
    Template("gpl-notice", """is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License as
        published by the Free Software Foundation<<beginOptional>>;<<endOptional>> either version <<var;min=1;max=2>> of the License, or (at your option) any later version"""),
    Template("gpl-3.0", """GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3"""),
    Template("cc-by-nc-4.0", """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY-NC 4.0"""),
    Template("cc-by-4.0", """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution 4.0 International <<beginOptional>>Public<<endOptional>> License"""),
    Template("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."""),
    Template("unlicense", """This is free and unencumbered software released into the public domain."""),
    Template("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."""),
)
TEMPLATES = BASE + MORE

#: The markup and the words of a template whose A-Z are lower-cased.
_MARKUP = re.compile(r"<<(beginoptional|endoptional|var;min=(\d+);max=(\d+))>>|([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)")
_LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
#: A template begins with at least two mandatory words; so many are looked for at most before its automaton is started.
LEAST_LEAD, MOST_LEAD = 2, 3


@dataclass(frozen=True)
class Automaton:
    label: str
    base: bool
    lead: tuple[str, ...]
    takes: dict[str, int]  # of a word: the places that it fills
    anything: int  # places that any word fills
    over: tuple[tuple[int, int], ...]  # edges that pass no word, from the front to the back
    places: int
    mandatory: int

    def closed(self, states: int) -> int:
        for a, b in self.over:
            states |= (states >> a & 1) << b
        return states

    def accepts(self, words: Iterator[str]) -> int | None:
        """How many words the first acceptance takes, from where it is started."""
        states, accepted = self.closed(1), 1 << self.places
        for n, word in enumerate(words, 1):
            states = self.closed((states & (self.takes.get(word, 0) | self.anything)) << 1)
            if states & accepted:
                return n
            if not states:
                return None
        return None


def compiled(template: Template) -> Automaton:
    takes: dict[str, int] = {}
    lead: list[str] = []
    over: list[tuple[int, int]] = []
    opened: list[int] = []
    places = anything = mandatory = 0
    leading = True
    for m in _MARKUP.finditer(template.markup.translate(_LOWER)):
        if m[4]:
            takes[m[4]] = takes.get(m[4], 0) | 1 << places
            places += 1
            mandatory += not opened
            if leading:
                lead.append(m[4])
            continue
        leading = False
        if m[1] == "beginoptional":
            opened.append(places)
        elif m[1] == "endoptional":
            if not opened:
                raise ValueError(f"{template.label}: an optional region ends that was not begun")
            over.append((opened.pop(), places))
        else:
            least, most = int(m[2]), int(m[3])
            if least > most:
                raise ValueError(f"{template.label}: a region of at least {least} and at most {most} words")
            over += [(places + k, places + k + 1) for k in range(least, most)]
            anything |= ((1 << most) - 1) << places
            places += most
    if opened:
        raise ValueError(f"{template.label}: an optional region does not end")
    if len(lead) < LEAST_LEAD:
        raise ValueError(f"{template.label}: a template begins with {LEAST_LEAD} mandatory words at least")
    return Automaton(template.label, template.base, tuple(lead[:MOST_LEAD]), takes, anything, tuple(sorted(over)), places, mandatory)


@lru_cache(maxsize=8)
def _automata(templates: tuple[Template, ...]) -> list[tuple[Automaton, np.ndarray]]:
    """Each automaton with the hashes of its lead."""
    out = []
    for a in map(compiled, templates):
        out.append((a, words_of(pa.array([" ".join(a.lead)]), LETTERS_DIGITS, LOWER).hashes()))
    return out


def matches_in(words: Words, templates: tuple[Template, ...] = TEMPLATES) -> list[tuple[int, int, int, int]]:
    """(document, start, end, number of the template) of each match, by document, start and template; words count from 0 in their document."""
    automata = _automata(templates)
    hashes, doc = words.hashes(), words.doc
    firsts = np.unique(np.concatenate([h[:1] for _, h in automata]))
    starts = np.flatnonzero(np.isin(hashes, firsts))
    raw, fold = words.data, words.fold

    def text(i: int) -> str:
        return fold[raw[words.starts[i] : words.ends[i]]].tobytes().decode("utf-8", "replace")

    out = []
    for k, (a, lead) in enumerate(automata):
        at = starts[starts + len(lead) <= len(hashes)]
        for j, h in enumerate(lead):
            at = at[hashes[at + j] == h]
        for i in at.tolist():
            d = int(doc[i])
            n = a.accepts(text(x) for x in range(i, int(words.first[d + 1])))
            if n is not None:
                begin = i - int(words.first[d])
                out.append((d, begin, begin + n, k))
    return sorted(out)


_FOUND = "n_words long, matches array<struct<label:string,base:boolean,start:long,end:long>>"


def find_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``doc_id, n_words, matches`` for each row of ``docs(doc_id, text)``; a match is struct(label, base, start, end), in words, by start."""
    for t in templates:
        compiled(t)
    long_rows(docs.sparkSession)
    narrow = docs.select("doc_id", "text")
    schema = StructType([narrow.schema["doc_id"], *StructType.fromDDL(_FOUND)])
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            words = words_of(b.column("text"), LETTERS_DIGITS, LOWER)
            found: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for d, start, end, k in matches_in(words, templates):
                found[d].append({"label": templates[k].label, "base": templates[k].base, "start": start, "end": end})
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(kind.field("doc_id").type), pa.array(np.diff(words.first), pa.int64()), pa.array(found, kind.field("matches").type)], schema=kind)

    return narrow.mapInArrow(run, schema)


def labels_of(matches: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")


def score_of(n_words: Column, matches: Column, templates: tuple[Template, ...] = TEMPLATES) -> Column:
    """Mandatory words of the licenses met over the words of the document, at most 1: each base place counts, a further label once."""
    mandatory = F.create_map(*(x for t in templates for x in (F.lit(t.label), F.lit(compiled(t).mandatory))))
    base = F.filter(matches, lambda m: m["base"])
    more = F.array_distinct(F.transform(F.filter(matches, lambda m: ~m["base"]), lambda m: m["label"]))
    total = F.aggregate(F.concat(F.transform(base, lambda m: m["label"]), more), F.lit(0).cast("long"), lambda s, label: s + mandatory[label])
    return F.when(n_words > 0, F.least(F.lit(1.0), total / n_words)).otherwise(0.0)
