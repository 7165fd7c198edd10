"""Licence scan: a positional index of rare licence words, and the base phrases.

The index holds every word of the licence templates with its postings (template, position). Every licence word of a
file is looked up; each occurrence votes, with the word's IDF, for a template laid at a place (the word's place less
the posting's). A template is accepted at a place if all its mandatory key phrases stand there, give or take ``slack``
words, and enough of its weight agrees: that of the template's words found inside the place, so neither other licences
nor other words of a file play a part.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kpiloom.llm.common import table

# The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Templates (label, words, mandatory key phrases), from the public texts of the licences.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("hereby granted free of charge", "sublicense and or sell")),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ("this permission notice shall be included in all copies", "dealings in the software")),
    ("mit", "released under the mit license", ("the mit license",)),
    ("mit", "licensed under the mit license", ("the mit license",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2", "in compliance with the license")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions of source code must retain", "redistributions in binary form must reproduce")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution", ("alter it and redistribute it freely", "altered source versions must be plainly marked")),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so", ("any person or organization obtaining a copy", "prepare derivative works of the software")),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("in the hope that it will be useful", "gnu general public license")),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", ("the author disclaims all warranties with regard to this software",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("free and unencumbered software", "anyone is free to copy modify publish use compile sell or distribute this software")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    ("cc0", "licensed under the creative commons cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",)),
)

_IN_WORD = np.zeros(256, bool)
_IN_WORD[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Index:
    """Positional postings of all template words, with IDF over the templates."""

    def __init__(self, templates=TEMPLATES):
        self.labels = [label for label, _, _ in templates]
        self.words = [[w.encode() for w in text.split()] for _, text, _ in templates]
        self.keys = [[[w.encode() for w in key.split()] for key in keys] for _, _, keys in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, ws in enumerate(self.words):
            for q, w in enumerate(ws):
                self.postings[w].append((t, q))
        self.idf = {w: math.log(len(templates) / len({t for t, _ in at})) for w, at in self.postings.items()}

    def find(self, ws: list[bytes], least: float, slack: int) -> dict[str, float]:
        """label: the largest share of a template's weight inside a place that agrees on the place."""
        held = set(ws)
        # a template one of whose key phrases lacks a word can't be accepted anywhere
        live = {t for t, keys in enumerate(self.keys) if all(w in held for key in keys for w in key)}
        votes: Counter = Counter()
        for p, w in enumerate(ws if live else ()):
            for t, q in self.postings.get(w, ()):
                if t in live:
                    votes[t, p - q] += self.idf[w]
        out: dict[str, float] = {}
        for (t, place), vote in votes.items():
            span = ws[max(0, place - slack) : max(0, place + len(self.words[t]) + slack)]
            near = set(span)
            full = sum(self.idf[w] for w in self.words[t] if w in near)
            share = vote / full if full else 0.0
            if share < least or out.get(self.labels[t], 0) >= share:
                continue
            if all(any(span[i : i + len(key)] == key for i in range(len(span) - len(key) + 1)) for key in self.keys[t]):
                out[self.labels[t]] = min(1.0, share)
        return out


_PHRASES = [(re.compile(rb"(?<![0-9a-z\x80-\xff])" + rb"[^0-9a-z\x80-\xff]+".join(re.escape(w.encode()) for w in phrase.split()) + rb"(?![0-9a-z\x80-\xff])"), phrase.split()[-1].encode(), label) for phrase, label in BASE]

SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, least: float = 0.6, slack: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences of every whole text.

    Returns ``id_col`` with n_words, n_base (places of base phrases), first_word and last_word (their smallest and
    largest first word, from 0; null without any), base_labels, labels (with the index's) and score (the best share,
    1 for a base phrase, 0 without a label). Null and empty texts have no words and no labels. Repeated rows and equal
    ids are scanned each on its own; columns other than the two named play no part. A text is held whole, one at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        index = Index()
        # one word of each template's key phrases: a text without any of them holds no template
        hints = {max((w for key in keys for w in key), key=lambda w: (index.idf[w], len(w), w)) for keys in index.keys}
        rare = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(sorted(hints)) + rb")(?![0-9a-z\x80-\xff])")
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                low = (text or "").encode().lower()
                inside = _IN_WORD[np.frombuffer(low, np.uint8)]
                starts = inside.copy()
                starts[1:] &= ~inside[:-1]
                base = [(m.start(), label) for pattern, hint, label in _PHRASES if hint in low for m in pattern.finditer(low)]
                if base:
                    before = np.cumsum(starts)
                    base = [(int(before[at]) - 1, label) for at, label in base]
                found = index.find(_WORD.findall(low), least, slack) if rare.search(low) else {}
                mine = sorted({label for _, label in base})
                rows.append((
                    int(starts.sum()), len(base), min(base)[0] if base else None, max(base)[0] if base else None,
                    ",".join(mine), ",".join(sorted({*mine, *found})), 1.0 if base else max(found.values(), default=0.0),
                ))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: licences of all documents."""
    return scan(table(spark, sf_dir, "documents"))
