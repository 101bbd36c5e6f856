"""Licence scan: passages against templates by the Dice coefficient over word bigrams.

Only column expressions are used; a scan neither joins nor shuffles.  Passages of
a text are itself, its paragraphs, lines and sentences within a line; and, once
marks of comments at the beginning of lines are dropped and lines joined, its
paragraphs alone and in twos, and within each paragraph its sentences alone, in
twos and in threes.  So a notice is found in a comment block, wrapped over lines,
or inside a longer paragraph.  A passage is normalised to lower-case words, and
meets only the templates whose number of bigrams lies within the bounds beyond
which the coefficient cannot reach the threshold; it names the licence that it is
most like.

Before a text is cut into passages, and a passage into words, it must hold one of
a few anchor words.  They are chosen so that each template keeps too few bigrams
without one of them for a match: the test loses nothing.

Defined results: null, empty and wordless texts match nothing; a passage of one
word has no bigrams and matches nothing.  A licence that several passages match
counts once, with its best coefficient; a passage equally like several licences
names all of them.  Equal coefficients rank by name.  Rows are independent; other
columns are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Templates a scan accepts: they become part of the plan.
MOST_TEMPLATES = 500

#: Fixed texts: the usual notices of common licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD-2-Clause": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


#: Longer words that are no sign of a licence.
COMMON = {"under", "above", "found", "person", "files", "permit", "including", "without", "either", "later", "obtain", "following", "whether", "which", "their", "subject", "terms", "whom"}


@dataclass(frozen=True)
class Template:
    name: str
    bigrams: tuple[str, ...]


def words_of(text: str) -> list[str]:
    return re.sub(r"[^\w]|_", " ", text.lower()).split()


def compiled(templates: dict[str, list[str]]) -> list[Template]:
    """Templates as sorted bigram sets; those of one word are refused."""
    out = []
    for name, texts in templates.items():
        for text in texts:
            words = words_of(text)
            if len(words) < 2:
                raise ValueError(f"a template of {name} has fewer than two words")
            out.append(Template(name, tuple(sorted({f"{a} {b}" for a, b in zip(words, words[1:])}))))
    if len(out) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return out


def anchors(templates: list[Template], least: float) -> list[str]:
    """Words one of which every match holds: without them no template keeps the bigrams a match shares at least."""
    needed = [math.ceil(least * len(t.bigrams) / (2 - least) - 1e-9) for t in templates]
    bare = [{b: set(b.split()) for b in t.bigrams} for t in templates]
    chosen: list[str] = []
    while True:
        open_ = [k for k, b in enumerate(bare) if len(b) >= needed[k]]
        if not open_:  # words are looked for as substrings, so one that holds another is superfluous
            return [w for w in chosen if not any(v != w and v in w for v in chosen)]
        gain: dict[str, float] = {}
        for k in open_:
            for words in bare[k].values():
                for w in words:
                    gain[w] = gain.get(w, 0.0) + 1 / needed[k] / cost(w)
        best = max(sorted(gain), key=gain.__getitem__)
        chosen.append(best)
        bare = [{b: words for b, words in held.items() if best not in words} for held in bare]


def cost(word: str) -> int:
    """How common a word may be in other text: short and function words are dear."""
    return 500 if len(word) < 5 or word in COMMON else 4 if len(word) < 7 else 1


#: Marks of comments at the beginning of a line, and the end of a sentence; plain enough to mean the same in any dialect.
COMMENT = r"(^|\n)[ \t]*(?:#+|//+|/?[*]+/?|--+|;+|%+|<!--)[ \t]?"
PARAGRAPH, SENTENCE = r"\n[ \t\r]*\n", r"([.!?])[ \t]+"


def runs(parts: Column, most: int) -> Column:
    """Each part, and up to ``most`` neighbouring ones joined by blanks."""
    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.transform(F.filter(F.transform(parts, lambda _, i: i + 1), lambda i: i + n - 1 <= F.size(parts)), lambda i: F.array_join(F.slice(parts, i, n), " "))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def passages(text: Column) -> Column:
    """The text, its paragraphs, lines and sentences, and those of its lines joined without marks of comments."""
    lines = F.split(text, r"\n", -1)
    sentences = F.split(F.regexp_replace(text, SENTENCE, "$1\n"), r"\n", -1)
    joined = F.transform(F.split(F.regexp_replace(text, COMMENT, "$1"), PARAGRAPH, -1), lambda p: F.regexp_replace(p, r"[ \t\r\n]+", " "))
    of = lambda p: let(F.split(F.regexp_replace(p, SENTENCE, "$1\n"), r"\n", -1), lambda s: runs(s, 3))
    more = let(joined, lambda held: F.concat(runs(held, 2), F.flatten(F.transform(held, of))))
    return F.array_distinct(F.concat(F.array(text), F.split(text, PARAGRAPH, -1), lines, sentences, more))


def bigrams(passage: Column) -> Column:
    """Distinct word bigrams of a passage, normalised."""
    words = F.filter(F.split(F.regexp_replace(F.lower(passage), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def matches(text: Column, templates: dict[str, list[str]] | None = None, least: float = 0.8) -> Column:
    """array<struct<license, score>>: each licence found once, best first."""
    known = compiled(TEMPLATES if templates is None else templates)
    table = F.array(*(F.struct(F.lit(t.name).alias("license"), F.lit(len(t.bigrams)).alias("n"), F.array(*map(F.lit, t.bigrams)).alias("bigrams")) for t in known))
    ratio, empty = least / (2 - least), F.array().cast("array<struct<license:string,score:double>>")
    sizes = [len(t.bigrams) for t in known]
    low, high = math.ceil(min(sizes) * ratio - 1e-9), math.floor(max(sizes) / ratio + 1e-9)
    signs = anchors(known, least)

    def hint(part: Column) -> Column:
        lowered, out = F.lower(part), F.lit(False)
        for word in signs:
            out = out | lowered.contains(word)
        return out

    def of(grams: Column) -> Column:
        size = F.size(grams)
        near = F.filter(table, lambda t: (t["n"] >= size * ratio - 1e-9) & (t["n"] <= size / ratio + 1e-9))
        scored = F.transform(near, lambda t: F.struct(t["license"].alias("license"), (2.0 * F.size(F.array_intersect(grams, t["bigrams"])) / (size + t["n"])).alias("score")))
        return let(scored, lambda found: let(F.array_max(F.transform(found, lambda m: m["score"])), lambda best: F.filter(found, lambda m: m["score"] == best)))

    # a bigram takes at least three signs, so shorter passages need not be cut into words
    worth = F.filter(passages(text), lambda p: (F.length(p) >= 2 * low + 1) & hint(p))
    sets = F.filter(F.transform(worth, bigrams), lambda g: F.size(g).between(max(1, low), high))
    found = F.filter(F.flatten(F.transform(sets, of)), lambda m: m["score"] >= least - 1e-12)
    names = F.array_distinct(F.transform(found, lambda m: m["license"]))
    best = F.transform(names, lambda x: F.struct((-F.array_max(F.transform(F.filter(found, lambda m: m["license"] == x), lambda m: m["score"]))).alias("minus"), x.alias("license")))
    ranked = F.transform(F.array_sort(best), lambda m: F.struct(m["license"].alias("license"), (-m["minus"]).alias("score")))
    return F.when(hint(text), ranked).otherwise(empty)


def scan(docs: DataFrame, *, text: str = "text", output: str = "licenses", templates: dict[str, list[str]] | None = None, least: float = 0.8) -> DataFrame:
    """``docs`` with the licences found in each text in column ``output``."""
    empty = F.array().cast("array<struct<license:string,score:double>>")
    return docs.withColumn(output, F.coalesce(matches(F.col(text).cast("string"), templates, least), empty))
