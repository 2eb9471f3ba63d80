"""License scans: a positional rare-token index.

Templates are licence notices; each has mandatory key phrases. A word's inverse document frequency is taken over the templates, and
each phrase is posted under its rarest word. A text's words are looked up in these postings, so its own rarest licence words alone
lead to phrases: places less the word's offset must agree with the phrase's next rarest word, then the phrase is verified byte by
byte. A template stands where all its phrases do, as far apart as in the template give or take SLACK words. The cost of a text is
that of the postings of its words, whatever the number of templates.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import ALNUM, Words, as_bytes, chunks, pieces


class Template(NamedTuple):
    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False


#: Words that a phrase may be off its place within a template.
SLACK = 12
#: The phrases asked for (base), then public notices of licences, and short forms of them, with mandatory phrases.
_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_GNU = "you can redistribute it and or modify it under the terms of the gnu {0} general public license as published by the free software foundation either version 3 of the license or at your option any later version"
TEMPLATES = (
    Template("cc-by", "cc by", ("cc by",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("reserved", "all rights reserved", ("all rights reserved",), True),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _WARRANTY, ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("under the apache license", "you may not use this file except in compliance with the license")),
    Template("gpl", "this program is free software " + _GNU.format("").replace("  ", " "), ("gnu general public license", "published by the free software foundation")),
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template("lgpl", "this library is free software " + _GNU.format("lesser"), ("lesser general public license",)),
    Template("agpl", "this program is free software " + _GNU.format("affero"), ("affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("bsd-2-clause", _BSD, ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce")),
    Template("bsd-3-clause", _BSD + " 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("redistribution and use in source and binary forms", "may be used to endorse or promote products")),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla public license",)),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("in no event will the authors be held liable", "to alter it and redistribute it freely")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee",)),
    Template("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", ("person or organization obtaining a copy of the software", "to use reproduce display distribute execute and transmit")),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software",)),
    Template("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ("changing it is allowed as long as the name is changed",)),
    Template("cc0", "dedicated to the public domain under cc0", ("public domain",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", ("creative commons attribution noderivatives",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
)


class Match(NamedTuple):
    """A template's place in a text: the word where its first key phrase starts, and the share of its words that stand in place."""

    template: int
    word: int
    share: float


def _hash(words: list[str]) -> np.ndarray:
    return Words([" ".join(words).encode()], ALNUM).hashes()


class Index:
    """Key phrases posted under their rarest words, and the templates' words and phrases."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES):
        self.templates = templates
        split = [t.text.split() for t in templates]
        frequency: dict[str, int] = {}
        for words in split:
            for word in set(words):
                frequency[word] = frequency.get(word, 0) + 1
        self.idf = {word: math.log(len(templates) / n) for word, n in frequency.items()}
        self.phrases: dict[str, int] = {}
        self.wholes, self.needs = [_hash(words) for words in split], []
        for template, words in zip(templates, split, strict=True):
            keys = [k.split() for k in template.keys]
            places = [next(p for p in range(len(words)) if words[p : p + len(k)] == k) for k in keys]
            self.needs.append([(self.phrases.setdefault(k, len(self.phrases)), p) for k, p in zip(template.keys, places, strict=True)])
        self.postings: dict[int, list[int]] = {}
        self.plans = []
        for n, phrase in enumerate(self.phrases):
            words = phrase.split()
            rare = sorted(range(len(words)), key=lambda k: (-self.idf[words[k]], -len(words[k]), k))
            hashes = _hash(words)
            self.plans.append((rare, hashes, np.frombuffer(phrase.replace(" ", "").encode(), np.uint8)))
            self.postings.setdefault(int(hashes[rare[0]]), []).append(n)
        self.posted = np.array(sorted(self.postings), np.uint64)
        self.first: dict[int, list[int]] = {}  # phrase: the templates whose first it is
        for t, need in enumerate(self.needs):
            self.first.setdefault(need[0][0], []).append(t)

    def _places(self, words: Words, hashes: np.ndarray) -> dict[int, np.ndarray]:
        """Where each phrase starts that stands in one of the texts."""
        at = np.minimum(np.searchsorted(self.posted, hashes), len(self.posted) - 1)
        seen = np.flatnonzero(self.posted[at] == hashes)
        found = {}
        for which in np.unique(at[seen]):
            here = seen[at[seen] == which]
            for n in self.postings[int(self.posted[which])]:
                rare, key, spelled = self.plans[n]
                start = here - rare[0]
                start = start[(start >= 0) & (start + len(key) <= len(hashes))]
                for k in rare[1:]:  # the next rarest first
                    start = start[hashes[start + k] == key[k]]
                doc = np.searchsorted(words.first, start, side="right")
                start = start[start + len(key) <= words.first[doc]]
                same = [p for p in start.tolist() if self._spelled(words, p, len(key), spelled)]
                if same:
                    found[n] = np.array(same)
        return found

    @staticmethod
    def _spelled(words: Words, start: int, n: int, spelled: np.ndarray) -> bool:
        parts = [words.buffer[words.starts[k] : words.ends[k]] for k in range(start, start + n)]
        return np.array_equal(np.concatenate(parts), spelled)

    def scan(self, texts: list[bytes]) -> list[list[Match]]:
        """For each text (A-Z lower-cased) the templates that stand in it, once for each place of the first key phrase."""
        found: list[list[Match]] = [[] for _ in texts]
        self.counts = np.zeros(len(texts), np.int64)
        for low, high in chunks(texts):
            words = Words(texts[low:high], ALNUM)
            hashes = words.hashes()
            self.counts[low:high] = np.diff(words.first)
            places = self._places(words, hashes)
            for n, starts in places.items():
                docs = np.searchsorted(words.first, starts, side="right") - 1
                for t in self.first.get(n, ()):
                    (_, origin), *others = self.needs[t]
                    for place, d in zip(starts.tolist(), docs.tolist(), strict=True):
                        begin, end = int(words.first[d]), int(words.first[d + 1])
                        if all(self._near(places.get(m), place - origin + p, begin, end) for m, p in others):
                            found[low + d].append(Match(t, place - begin, self._share(hashes, self.wholes[t], place - origin, begin, end)))
        return found

    @staticmethod
    def _near(places: np.ndarray | None, wanted: int, begin: int, end: int) -> bool:
        if places is None:
            return False
        k = np.searchsorted(places, max(begin, wanted - SLACK))
        return bool(k < len(places) and places[k] <= wanted + SLACK and places[k] < end)

    @staticmethod
    def _share(hashes: np.ndarray, whole: np.ndarray, start: int, begin: int, end: int) -> float:
        low, high = max(start, begin), min(start + len(whole), end)
        return float((hashes[low:high] == whole[low - start : high - start]).sum() / len(whole))


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "matches array<struct<label:string, word:long, share:double>>"
)


def _scan(batches):
    index = Index()
    for batch in pieces(batches):
        texts = [t.lower() for t in as_bytes(batch.column("text"))]  # bytes.lower() changes A-Z alone
        found = index.scan(texts)
        rows = []
        for hits in found:
            own = [(index.templates[m.template], m.word, m.share) for m in hits]
            base = [place for t, place, _ in own if t.base]
            rows.append(
                (
                    len(base),
                    min(base, default=None),
                    max(base, default=None),
                    ",".join(sorted({t.label for t, _, _ in own if t.base})),
                    ",".join(sorted({t.label for t, _, _ in own})),
                    max((share for _, _, share in own), default=0.0),
                    [{"label": t.label, "word": place, "share": share} for t, place, share in sorted(own, key=lambda x: (x[1], x[0].label, x[0].text))],
                )
            )
        n, first, last, base_labels, labels, score, matches = zip(*rows, strict=True) if rows else [()] * 7
        kind = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("share", pa.float64())]))
        arrays = [
            batch.column("doc_id"),
            pa.array(index.counts) if rows else pa.array([], pa.int64()),
            *(pa.array(x, pa.int64()) for x in (n, first, last)),
            *(pa.array(x, pa.string()) for x in (base_labels, labels)),
            pa.array(score, pa.float64()),
            pa.array(matches, kind),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])


def license_scan(documents: DataFrame) -> DataFrame:
    """One row per document: word and phrase counts, labels, a score (best share of a template in place) and all matches.

    A row is scanned alone and whole, so there is no shuffle. Null or empty text: no words, no labels, score 0. Repeated
    rows are scanned each and come out alike; of templates with one score both label the text. Other columns are not read, and no
    documents give no rows.
    """
    return documents.select("doc_id", "text").mapInArrow(_scan, SCHEMA)


#: The base columns, which SQL can express.
SQL_BASE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (
  SELECT row, i - 1 AS pos, unnest(list_filter([CASE WHEN w[i] = 'cc' AND w[i + 1] = 'by' THEN 'cc-by' END, CASE WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' END,
    CASE WHEN w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved' THEN 'reserved' END], lambda x: x IS NOT NULL)) AS label FROM p
), g AS (SELECT row, count(*) AS n, min(pos) AS a, max(pos) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word, coalesce(l, '') AS base_labels
FROM d LEFT JOIN g ON g.row = d.row
"""
