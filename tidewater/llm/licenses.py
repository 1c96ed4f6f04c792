"""License scans by template matching.

A template is the wording of a license or notice with markup: `<<o>> ... <</o>>` encloses optional words, `<<v:N>>`
stands for up to N words of any kind, such as names and years. Each template is compiled into an automaton over word
tokens; it accepts a passage whose mandatory words match exactly and in order. Beside it, plain phrases are counted.

Texts are lower-cased in A-Z and cut into words of letters, digits and non-ASCII characters, so punctuation, case and
line breaks don't matter. Null and empty texts have no words and no labels; a table without rows stays empty. Texts of any
length are read whole, in one pass over their words. Repeated rows are scanned alike; of matches of one template that begin
at one word the shortest counts. Rows keep all their columns; `scan` replaces a column of that name.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words

# Phrases and their labels: fixed values.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Public license wordings as templates: fixed values.
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<v:12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
    TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
    <<v:12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
    LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
    CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
    ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES = {
    "mit-notice": "<<o>>this <<v:3>> is<</o>> <<o>>released<</o>> <<o>>licensed<</o>> <<o>>distributed<</o>> under the <<o>>terms of the<</o>> MIT license",
    "apache-2.0-notice": "licensed under the Apache license <<o>>,<</o>> version 2.0",
    "gpl-3.0-notice": "licensed under the GNU General Public License <<o>>as published by the Free Software Foundation either<</o>> version 3 <<o>>of the license<</o>>",
    "gpl-2.0-notice": "licensed under the GNU General Public License <<o>>as published by the Free Software Foundation either<</o>> version 2 <<o>>of the license<</o>>",
    "cc-by-nc-4.0-notice": "licensed under <<o>>a<</o>> <<o>>the<</o>> CC BY-NC 4.0",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice <<o>>(including the next paragraph)<</o>> shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL <<v:12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and<<o>>/or<</o>> distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND <<v:8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<v:8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: <<o>>1.<</o>> Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. <<o>>2.<</o>> Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. """
    + BSD_DISCLAIMER,
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: <<o>>1.<</o>> Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. <<o>>2.<</o>> Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. <<o>>3.<</o>> Neither the name of <<v:12>> nor the names of
        its contributors may be used to endorse or promote products derived from this software without specific prior
        written permission. """
    + BSD_DISCLAIMER,
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will <<v:6>> be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions: <<o>>1.<</o>> The origin of this software must not be misrepresented; you must not claim that
        you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. <<o>>2.<</o>> Altered source versions must be plainly marked
        as such, and must not be misrepresented as being the original software. <<o>>3.<</o>> This notice may not be removed
        or altered from any source distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author
        or authors of this software dedicate any and all copyright interest in the software to the public domain. We make
        this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend
        this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
        under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
        EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
        OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at <<v:8>> Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
        OR CONDITIONS OF ANY KIND, either express or implied.""",
}
MARK = re.compile(r"<<(o|/o|v:\d+)>>")


def parsed(template: str) -> list:
    """Words as bytes, ints for replaceable stretches, lists for optional parts."""
    stack: list[list] = [[]]
    for i, part in enumerate(MARK.split(template)):
        if i % 2 == 0:
            stack[-1] += alnum_words(part)
        elif part == "o":
            stack.append([])
        elif part == "/o":
            inner = stack.pop()
            if inner:
                stack[-1].append(inner)
        else:
            stack[-1].append(int(part[2:]))
    if len(stack) != 1:
        raise ValueError("optional parts do not nest")
    return stack[0]


@dataclass
class Automaton:
    """A nondeterministic automaton: per state, moves by word, moves by any word, and moves without one."""

    words: list[dict[bytes, set[int]]] = field(default_factory=list)
    any_word: list[set[int]] = field(default_factory=list)
    free: list[set[int]] = field(default_factory=list)
    final: int = 0

    def state(self) -> int:
        self.words.append(defaultdict(set))
        self.any_word.append(set())
        self.free.append(set())
        return len(self.words) - 1

    def add(self, parts: list, at: int) -> int:
        for part in parts:
            to = self.state()
            if isinstance(part, bytes):
                self.words[at][part].add(to)
            elif isinstance(part, int):
                self.free[at].add(to)
                for _ in range(part):
                    nxt = self.state()
                    self.any_word[at].add(nxt)
                    self.free[nxt].add(to)
                    at = nxt
            else:
                self.free[at].add(to)
                self.free[self.add(part, at)].add(to)
            at = to
        return at

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()] - states:
                states.add(s)
                todo.append(s)
        return states

    def first_words(self) -> set[bytes]:
        return {w for s in self.closed({0}) for w in self.words[s]}

    def accepts(self, words: list[bytes], start: int) -> int:
        """The end of the shortest accepted passage that begins at `start`, or -1."""
        states = self.closed({0})
        for i in range(start, len(words)):
            states = self.closed({t for s in states for t in (*self.words[s].get(words[i], ()), *self.any_word[s])})
            if not states:
                return -1
            if self.final in states:
                return i + 1
        return -1


def compiled(templates: dict[str, str] = TEMPLATES) -> dict[str, Automaton]:
    out = {}
    for label, template in templates.items():
        a = Automaton()
        a.final = a.add(parsed(template), a.state())
        if a.final in a.closed({0}) or any(a.any_word[s] for s in a.closed({0})):
            raise ValueError(f"{label}: a template must begin with a mandatory or optional word")
        out[label] = a
    return out


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.automata = compiled(templates)
        self.by_word: dict[bytes, list[str]] = defaultdict(list)
        for label, a in self.automata.items():
            for w in a.first_words():
                self.by_word[w].append(label)
        self.phrases = [(alnum_words(k), v) for k, v in phrases.items()]
        # A text without these words holds neither a phrase nor a template's rarest part.
        self.needed = {p[-1] for p, _ in self.phrases} | {self.key_word(a) for a in templates.values()}
        self.starts = set(self.by_word)

    @staticmethod
    def key_word(template: str) -> bytes:
        """The longest mandatory word."""
        return max((w for w in parsed(template) if isinstance(w, bytes)), key=lambda w: (len(w), w))

    def scan(self, text: str | None) -> dict:
        words = alnum_words(text)
        base, spans = [], []
        seen = set(words)
        if not seen.isdisjoint(self.needed):
            for phrase, label in self.phrases:
                if seen.issuperset(phrase):
                    i = -1
                    while (i := find(words, phrase[0], i + 1)) >= 0:
                        if words[i : i + len(phrase)] == phrase:
                            base.append((i, label))
            here = seen & self.starts
            if here:
                for i, w in enumerate(words):
                    if w in here:
                        for label in self.by_word[w]:
                            end = self.automata[label].accepts(words, i)
                            if end >= 0:
                                spans.append({"label": label, "first": i, "past": end})
        base.sort()
        return {"n_words": len(words), "base": [{"label": x, "first": i} for i, x in base], "matches": spans}


def find(words: list[bytes], word: bytes, start: int) -> int:
    try:
        return words.index(word, start)
    except ValueError:
        return -1


SCAN = "struct<n_words:bigint,base:array<struct<label:string,first:bigint>>,matches:array<struct<label:string,first:bigint,past:bigint>>>"


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """The rows with a struct `scan`: n_words, the places of plain phrases and the passages that templates accept."""

    def run(batches):
        scanner = Scanner(templates)
        for series in batches:
            yield pd.DataFrame([scanner.scan(t) for t in series], columns=["n_words", "base", "matches"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return docs.withColumn("scan", F.pandas_udf(run, SCAN).asNondeterministic()(F.col(text).cast("string")))


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document.

    The score is 1 where a template accepts a passage, 0.5 where only a phrase occurs, else 0.
    """
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base, own = F.col("scan.base"), F.col("scan.matches")
    joined = lambda x: F.concat_ws(",", F.array_sort(F.array_distinct(x)))
    return found.select(
        "doc_id",
        F.col("scan.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["first"]).alias("first_word"),
        F.array_max(base["first"]).alias("last_word"),
        joined(base["label"]).alias("base_labels"),
        joined(F.concat(base["label"], own["label"])).alias("labels"),
        F.when(F.size(own) > 0, 1.0).when(F.size(base) > 0, 0.5).otherwise(0.0).alias("score"),
    )


def as_pattern(parts: list) -> str:
    """A template as a regular expression over words that each follow a space."""
    return "".join(f" {p.decode()}" if isinstance(p, bytes) else f"(?: [^ ]+){{0,{p}}}" if isinstance(p, int) else f"(?:{as_pattern(p)})?" for p in parts)


def sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    places = " || ".join(f"list_transform(list_filter(range(1, len(w) + 1), lambda p: array_to_string(w[p:p + {len(k.split()) - 1}], ' ') = {quoted(k)}), lambda p: p - 1)" for k in PHRASES)
    base = ", ".join(f"CASE WHEN contains(j, {quoted(' ' + k + ' ')}) THEN {quoted(v)} END" for k, v in PHRASES.items())
    own = ", ".join(f"CASE WHEN regexp_matches(j, {quoted(as_pattern(parsed(t)) + ' ')}) THEN {quoted(k)} END" for k, t in TEMPLATES.items())
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), e AS (
  SELECT doc_id, len(w) AS n, ' ' || array_to_string(w, ' ') || ' ' AS j, CASE WHEN list_contains(w, 'license') THEN {places} ELSE [] END AS p FROM d
), f AS (
  SELECT doc_id, n, p, list_filter([{base}], lambda x: x IS NOT NULL) AS b, CASE WHEN true THEN list_filter([{own}], lambda x: x IS NOT NULL) END AS o FROM e
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(p) AS BIGINT) AS first_word, CAST(list_max(p) AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(list_distinct(b)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(b || o)), ','), '') AS labels,
       CAST(CASE WHEN len(o) > 0 THEN 1.0 WHEN len(p) > 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score
FROM f
"""


SQL = sql()
