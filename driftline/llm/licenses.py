"""License notices in texts: fixed phrases, and an exact set-similarity join of text blocks with notice templates.

Templates are sentences and whole notices of any length. Each has blocks of its own size: twice the power of two that holds the
template, one starting at every half, so that any place of that many words lies whole in a block however its lines are wrapped.
A template is joined with a block if at least CONTAINMENT of its distinct words are in the block.

The join is the filtered kind that finds every such pair: words are ordered by how often they stand in the whole corpus,
rarest first. A block that holds so many of a template's words holds one of the template's first few in this
order (prefix filter); it has enough template words at all (length filter); and what follows the first shared word in
both orders can still reach the threshold (position filter). What passes is counted exactly.

A set of words is no notice yet. A pair of the join is a match if these words also stand near each other, in a stretch of no more
than SPREAD times the template, and in its order but for as many as the threshold allows. The templates are a
parameter, not data, so their index travels with the task; the only shuffle is of counts of template words.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

CONTAINMENT, SPREAD, SMALLEST = 0.9, 1.5, 16
#: Phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Label and the words of a notice, sentences first and then whole notices.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
        "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
        "arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details "
        "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
]

# Bytes that words are made of stay, A-Z becomes a-z, all else separates.
_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))




def license_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def phrases(words: list[bytes]) -> list[tuple[int, str]]:
    """Word places and labels at which the fixed phrases stand, by place."""
    line, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in PHRASES:
        wanted, at, seen, upto = b" " + phrase.encode() + b" ", -1, 0, 0
        while (at := line.find(wanted, at + 1)) >= 0:
            seen, upto = seen + line.count(b" ", upto, at), at
            out.append((seen, label))
    return sorted(out)


def stride_of(size: int) -> int:
    """Half of the block of a template of so many words; it has to hold SPREAD times these."""
    return max(SMALLEST, 1 << (math.ceil(SPREAD * size) - 1).bit_length())


def in_order(words: list[int], spots: list[int]) -> int:
    """How many of a template's words, as numbers in a row, stand in the same order in a text's (the longest common subsequence)."""
    where: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        where.setdefault(w, []).append(i)
    best: list[int] = []  # of subsequences of each length, the least last place in the template
    for w in spots:
        for i in reversed(where.get(w, ())):
            k = bisect_left(best, i)
            best[k : k + 1] = [i]
    return len(best)


class Index:
    """Templates' distinct words in global order, and the templates that each prefix word may lead to."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], containment: float):
        rows = [license_words(t) for _, t in templates]
        vocabulary = sorted({w for r in rows for w in r}, key=lambda w: (frequency.get(w, 0), w))
        self.containment = containment
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.labels = [label for label, _ in templates]
        self.rows = [[self.rank[w] for w in r] for r in rows]
        self.sets = [sorted(set(r)) for r in self.rows]
        self.members = [frozenset(s) for s in self.sets]
        self.needed = [math.ceil(containment * len(s) - 1e-9) for s in self.sets]
        self.prefix: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, (ranks, needed) in enumerate(zip(self.sets, self.needed, strict=True)):
            own = self.prefix.setdefault(stride_of(len(self.rows[t])), {})
            for at, r in enumerate(ranks[: len(ranks) - needed + 1]):
                own.setdefault(r, []).append((t, at))
        self.leads = {w for w, r in self.rank.items() if any(r in own for own in self.prefix.values())}

    def held(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """The template words of a text: places and ranks."""
        rank = self.rank
        places = [i for i, w in enumerate(words) if w in rank]
        return places, [rank[words[i]] for i in places]

    def joined(self, places: list[int], all_ranks: list[int]) -> Iterator[tuple[int, int, int]]:
        """Template, and the first and the last one beyond of the template words in a block, of every pair that meets the threshold."""
        for stride, prefix in sorted(self.prefix.items()):
            blocks = sorted({b for i, r in zip(places, all_ranks, strict=True) if r in prefix for b in (i // stride - 1, i // stride) if b >= 0})
            for b in blocks:
                s, e = bisect_left(places, b * stride), bisect_left(places, (b + 2) * stride)
                ranks, tried = sorted(set(all_ranks[s:e])), set()
                for place, r in enumerate(ranks):
                    for t, at in prefix.get(r, ()):
                        if t in tried:
                            continue
                        tried.add(t)  # r is the first shared word, as ranks ascend
                        if len(ranks) < self.needed[t] or 1 + min(len(self.sets[t]) - at - 1, len(ranks) - place - 1) < self.needed[t]:
                            continue
                        members = self.members[t]
                        if sum(x in members for x in ranks) >= self.needed[t]:
                            yield t, s, e

    def stretches(self, t: int, places: list[int], ranks: list[int]) -> Iterator[tuple[int, int, float]]:
        """Start, end and containment of each stretch of a block that holds enough of a template's words near each other and in order."""
        members, row = self.members[t], self.rows[t]
        own = [(i, r) for i, r in zip(places, ranks, strict=True) if r in members]
        most, upto = int(SPREAD * len(row)), -1
        for k, (start, _) in enumerate(own):
            if start < upto:
                continue
            last = bisect_left(own, (start + most,))
            found = own[k:last]
            shared = len({r for _, r in found})
            if shared < self.needed[t]:
                continue
            # from the last word on which it could begin, so that a stretch holds no more before it than it must
            if k + 1 < len(own) and len({r for _, r in own[k + 1 : bisect_left(own, (own[k + 1][0] + most,))]}) > shared:
                continue
            if in_order(row, [r for _, r in found]) >= math.ceil(self.containment * len(row) - 1e-9):
                upto = found[-1][0] + 1
                yield start, upto, shared / len(self.sets[t])

    def matches(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """Label, start, end (exclusive) and containment of every match, once each."""
        places, ranks = self.held(words)
        out = {(self.labels[t], *found) for t, s, e in self.joined(places, ranks) for found in self.stretches(t, places[s:e], ranks[s:e])}
        return sorted(out, key=lambda m: (m[1], m[2], m[0]))


def frequencies(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> dict[bytes, int]:
    """How often each template word stands in all texts. As many rows as templates have words."""
    small_batches(docs.sparkSession)
    wanted = {w for _, t in templates for w in license_words(t)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                count.update([w for w in license_words(text) if w in wanted])
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}


def _each(docs: DataFrame, templates: list[tuple[str, str]], containment: float, schema: str, row) -> DataFrame:
    index = Index(templates, frequencies(docs, templates), containment)
    names = [f.split()[0] for f in schema.split(", ")]
    types = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, r) for i, t in enumerate(b.column(1).to_pylist()) for r in row(license_words(t), index)]
            columns = [pa.array([r[k] for _, r in found], types[f.split()[1]]) for k, f in enumerate(schema.split(", "))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in found], pa.int64())), *columns], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, {schema}")


def find(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, label, start, end (in words, end exclusive) and containment, a row for each fixed phrase and each match
    of a template. Texts without any give no rows; what query() says of nulls and the like holds here too."""

    def row(words: list[bytes], index: Index) -> Iterator[tuple]:
        sizes = {label: len(p.split()) for p, label in PHRASES}
        yield from ((label, at, at + sizes[label], 1.0) for at, label in phrases(words))
        yield from index.matches(words)

    return _each(docs, templates, containment, "label string, start bigint, end bigint, containment double", row)


def query(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, the
    best containment found (1 for a fixed phrase, 0 if nothing is found).

    Null and empty texts have no words and empty labels; a null doc_id is carried through; repeated rows give repeated
    rows; no rows give no rows; other columns are not looked at.
    """

    def row(words: list[bytes], index: Index) -> Iterator[tuple]:
        base, more = phrases(words), index.matches(words)
        own = {label for _, label in base}
        score = 1.0 if base else max((m[3] for m in more), default=0.0)
        ends = (base[0][0], base[-1][0]) if base else (None, None)
        yield len(words), len(base), *ends, ",".join(sorted(own)), ",".join(sorted(own | {m[0] for m in more})), score

    schema = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return _each(docs, templates, containment, schema, row)
