"""Licence notices by a positional index of rare words.

How many documents hold each word of the licence templates is counted over the whole corpus. The index
posts every template under each of its words that is not a common one, with its places. A file ranks the
licence words it holds by inverse document frequency and looks them up from the rarest on. A posting and a
place in the file give the start of the template; words that agree on a start add up there, so the postings
intersect by relative position. A template is looked up no further once words that are still to
come cannot reach ``MIN_COVERAGE`` at a start that none has named: this is a bound on the words left, not a
count, so no notice is lost however many a file holds. Starts that can still reach it are
compared word by word, and each mandatory key phrase must stand within ``KEY_SHIFT`` words of its place.

Base phrases are found wherever their words stand consecutively.

Defined results: null counts as empty, without words or labels, score 0; equally
good places take the first; repeated rows each keep their row; an empty table gives
an empty result; very long texts are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import chunks

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
KEY_SHIFT = 2  # words by which a key phrase may stand off its place in the template
MIN_COVERAGE = 0.7  # share of a template, weighted by rarity, that must line up

# Phrases with their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Label, notice, mandatory key phrases.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files", "permission is hereby granted"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
     "of the software", "this permission notice shall be included"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the "
     "warranties of merchantability fitness for a particular purpose and noninfringement", "the software is provided as is",
     "and noninfringement"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is "
     "distributed on an as is basis without warranties or conditions of any kind either express or implied",
     "unless required by applicable law", "on an as is basis"),
    ("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 "
     "of the license or at your option any later version", "gnu general public license", "version 3 of the license"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 "
     "of the license or at your option any later version", "gnu general public license", "version 2 of the license"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license",
     "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("lgpl", "under the terms of the gnu library general public license", "library general public license"),
    ("lgpl-2.1", "gnu lesser general public license as published by the free software foundation either version 2 1 of the "
     "license or at your option any later version", "lesser general public license", "version 2 1 of the license"),
    ("lgpl-3", "gnu lesser general public license as published by the free software foundation either version 3 of the "
     "license or at your option any later version", "lesser general public license", "version 3 of the license"),
    ("agpl-3", "under the gnu affero general public license version 3", "affero general public license"),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either "
     "version 3 of the license or at your option any later version", "affero general public license", "version 3 of the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "source and binary forms"),
    ("bsd", "redistribution and use in source or binary form with or without modification are permitted",
     "source or binary form"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following "
     "disclaimer", "redistributions of source code must retain"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
     "disclaimer in the documentation and or other materials provided with the distribution",
     "redistributions in binary form must reproduce"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission", "neither the name of",
     "used to endorse or promote products"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("mpl-2", "mozilla public license version 2 0", "mozilla public license version 2 0"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl was not distributed"),
    ("boost", "boost software license 1 0", "boost software license"),
    ("boost", "boost software license version 1 0", "boost software license version 1 0"),
    ("epl-2", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    ("epl-1", "made available under the terms of the eclipse public license v1 0", "eclipse public license v1 0"),
    ("cddl", "subject to the terms of the common development and distribution license", "common development and distribution license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("wtfpl", "do what the fuck you want to public license", "what the fuck you want to"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held "
     "liable for any damages arising from the use of this software", "without any express or implied warranty",
     "authors be held liable"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
     "altered source versions must be plainly marked"),
    ("artistic-2", "licensed under the artistic license 2 0", "artistic license 2 0"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee "
     "and without a written agreement is hereby granted", "without a written agreement"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free "
     "documentation license", "gnu free documentation license"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license",
     "creative commons attribution noncommercial"),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license",
     "creative commons attribution noderivatives"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license",
     "creative commons attribution sharealike"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license",
     "creative commons attribution 4 0"),
    ("cc0", "released under cc0 1 0 universal public domain dedication", "public domain dedication"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee",
     "distribute this software for any purpose"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
]
# Identifiers of machine-readable tags, with their labels.
SPDX = {
    "MIT": "mit", "Apache-2.0": "apache-2", "GPL-2.0": "gpl-2", "GPL-3.0": "gpl-3", "LGPL-2.1": "lgpl-2.1", "LGPL-3.0": "lgpl-3",
    "AGPL-3.0": "agpl-3", "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd-3", "MPL-2.0": "mpl-2", "BSL-1.0": "boost",
    "EPL-2.0": "epl-2", "CC0-1.0": "cc0", "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-NC-4.0": "cc-by-nc",
    "ISC": "isc", "Zlib": "zlib", "Unlicense": "unlicense", "OFL-1.1": "ofl",
}
COMMON = set(b"the of to a in is and or for this it with by you any are be as".split())

Phrase = tuple[bytes, ...]


def _words(text: str) -> Phrase:
    return tuple(WORD.findall(text.lower().encode()))


def _spdx(name: str, label: str) -> tuple[str, str, str]:
    tag = f"SPDX-License-Identifier: {name}"
    return label, tag, tag


class Template:
    """Words of a notice, and its key phrases with their places in it."""

    def __init__(self, label: str, notice: str, *keys: str) -> None:
        self.label, self.words = label, _words(notice)
        self.keys: list[tuple[int, Phrase]] = []
        for key in map(_words, keys):
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(key)] == key)
            self.keys.append((at, key))
        self.needed = frozenset(w for _, key in self.keys for w in key)

    def keys_stand(self, words: list[bytes], start: int) -> bool:
        def near(place: int, key: Phrase) -> bool:
            first = start + place
            tries = range(max(0, first - KEY_SHIFT), first + KEY_SHIFT + 1)
            return any(tuple(words[i : i + len(key)]) == key for i in tries)

        return all(near(place, key) for place, key in self.keys)


_PHRASES: list[tuple[Phrase, str]] = [(_words(p), label) for p, label in BASE_PHRASES.items()]
_TEMPLATES = [Template(*t) for t in [*TEMPLATES, *(_spdx(*s) for s in SPDX.items())]]
VOCABULARY = frozenset(w for t in _TEMPLATES for w in t.words) | frozenset(w for p, _ in _PHRASES for w in p)
LOOKED_UP = VOCABULARY - COMMON


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())  # bytes.lower() changes A-Z alone


def document_frequency(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """Documents holding each licence word (one row a word reaches the driver), and all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter({b"": batch.num_rows})
            for part in chunks(iter([batch])):
                for text in part.column(0).to_pylist():
                    counts.update(LOOKED_UP.intersection(words_of(text)) if text else ())
            words = pa.array([w.decode() for w in counts])
            yield pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    n = {r.word.encode(): r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return n, n.pop(b"", 0)


class Index:
    """Postings of the templates and the rarity of their words."""

    def __init__(self, frequency: dict[bytes, int], documents: int) -> None:
        self.rarity = {w: 1.0 + math.log((1 + documents) / (1 + frequency.get(w, 0))) for w in VOCABULARY}
        for w in COMMON & VOCABULARY:
            self.rarity[w] = 0.1
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)  # template, place in it
        self.weights: list[Counter] = []  # what all places of a word weigh in a template
        for t, template in enumerate(_TEMPLATES):
            self.weights.append(Counter())
            for place, w in enumerate(template.words):
                self.weights[t][w] += self.rarity[w]
                if w in LOOKED_UP:
                    self.postings[w].append((t, place))
        self.total = [sum(self.rarity[w] for w in template.words) for template in _TEMPLATES]

    def base(self, words: list[bytes], present: frozenset[bytes]) -> list[tuple[int, str]]:
        found = []
        for phrase, label in _PHRASES:
            if present.issuperset(phrase):
                anchor = max(range(len(phrase)), key=lambda i: self.rarity[phrase[i]])
                at = -1
                for _ in range(words.count(phrase[anchor])):
                    at = words.index(phrase[anchor], at + 1)
                    start = at - anchor
                    if start >= 0 and tuple(words[start : start + len(phrase)]) == phrase:
                        found.append((start, label))
        return found

    def starts(self, words: list[bytes], present: frozenset[bytes]) -> dict[int, list[int]]:
        """Starts of each template at which its coverage can reach the wanted share."""
        left, wanted = {}, {}  # what words that are not looked up yet can add, and what is needed
        for t, template in enumerate(_TEMPLATES):
            if template.needed <= present:
                possible = sum(v for w, v in self.weights[t].items() if w in present)
                if possible >= MIN_COVERAGE * self.total[t]:
                    left[t], wanted[t] = possible, MIN_COVERAGE * self.total[t] - 1e-9
        ranked = {w for t in left for w in self.weights[t] if w in present and w in LOOKED_UP}
        places: dict[bytes, list[int]] = {w: [] for w in ranked}
        if ranked:
            for at, w in enumerate(words):
                if w in ranked:
                    places[w].append(at)
        votes: dict[int, dict[int, float]] = {t: defaultdict(float) for t in left}
        for w in sorted(ranked, key=lambda w: (-self.rarity[w], w)):
            open_places = [(t, place) for t, place in self.postings[w] if t in left and left[t] >= wanted[t]]
            for t, place in open_places:
                for at in places[w]:
                    votes[t][at - place] += self.rarity[w]
            for t in {t for t, _ in open_places}:
                left[t] -= self.weights[t][w]
        return {t: [s for s, v in found.items() if v + left[t] >= wanted[t]] for t, found in votes.items()}

    def notices(self, words: list[bytes], present: frozenset[bytes]) -> tuple[set[str], float]:
        """Labels of the templates that line up, and the best verified coverage."""
        labels, best = set(), 0.0
        for t, starts in self.starts(words, present).items():
            template = _TEMPLATES[t]
            for start in starts:
                low = max(0, start)
                seen = words[low : start + len(template.words)]
                met = sum(self.rarity[w] for w, v in zip(template.words[low - start :], seen) if w == v)
                coverage = met / self.total[t]
                if coverage >= MIN_COVERAGE and template.keys_stand(words, start):
                    labels.add(template.label)
                    best = max(best, coverage)
        return labels, best

    def judge(self, text: str) -> tuple:
        words = words_of(text)
        present = VOCABULARY.intersection(words)
        base = self.base(words, present)
        labels, score = self.notices(words, present)
        base_labels = {label for _, label in base}
        starts = [s for s, _ in base]
        return (
            len(words), len(base), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base_labels)), ",".join(sorted(base_labels | labels)), min(1.0, 1.0 if base else score),
        )


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double"
)


def scan(docs: DataFrame) -> DataFrame:
    """Words, base places, labels and score of every document."""
    frequency, documents = document_frequency(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(frequency, documents)
        for batch in chunks(batches):
            columns = zip(*[index.judge(t or "") for t in batch.column(1).to_pylist()])
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]
            arrays = [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]]
            yield pa.RecordBatch.from_arrays(
                arrays, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
