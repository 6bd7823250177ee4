"""License scan through a positional index of rare tokens.

Every template is a run of words with a key phrase that must stand in it.  An
index holds all places of the key phrases' words.  Of the licence words that a
file holds, those of the highest inverse document frequency are looked up
first, until every template whose key words the file has is reached by two of
them.  A posting and a place in the file give a place where the template would
start; the starts of both words are intersected, so that only runs in which the
words stand at their relative positions are left.  There the key phrase is
compared, and the other words add up to a share of the template's weight.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Label, template, key phrase.  The first four are found only as a whole.
TEMPLATES = [
    ("gpl", "gnu general public license", "gnu general public license"),
    ("apache", "apache license", "apache license"),
    ("cc-by", "cc by", "cc by"),
    ("mit", "mit license", "mit license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", "mozilla public license version 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    ("cc0", "creative commons zero cc0 1 0 universal", "cc0 1 0"),
    # Whole notices.
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
        "permit persons to whom the software is furnished to do so subject to the following conditions the above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "to deal in the software without restriction",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        "for any purpose with or without fee is hereby granted",
    ),
    (
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met 1 redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the "
        "above copyright notice this list of conditions and the following disclaimer in the documentation and or "
        "other materials provided with the distribution",
        "redistributions of source code must retain the above copyright notice",
    ),
    (
        "bsd-3-clause",
        "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission",
        "endorse or promote products derived from this software without specific prior written permission",
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
        "with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless "
        "required by applicable law or agreed to in writing software distributed under the license is distributed on "
        "an as is basis without warranties or conditions of any kind either express or implied",
        "you may not use this file except in compliance with the license",
    ),
    (
        "gpl-3.0-or-later",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 3 of the license or at your "
        "option any later version",
        "either version 3 of the license or at your option any later version",
    ),
    (
        "gpl-2.0-or-later",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 2 of the license or at your "
        "option any later version",
        "either version 2 of the license or at your option any later version",
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was "
        "not distributed with this file you can obtain one at https mozilla org mpl 2 0",
        "subject to the terms of the mozilla public license v 2 0",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish "
        "use compile sell or distribute this software either in source code form or as a compiled binary for any "
        "purpose commercial or non commercial and by any means",
        "free and unencumbered software released into the public domain",
    ),
    (
        "cc-by-4.0",
        "this work is licensed under a creative commons attribution 4 0 international license",
        "creative commons attribution 4 0 international license",
    ),
]
BASE = 4
# Words of a template that are looked up and intersected.
LOOKED_UP = 2
LEAST_SHARE = 0.8

# Words: letters, digits and every byte of a character beyond ASCII; A-Z in lower case.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def vocabulary(templates=TEMPLATES) -> list[bytes]:
    return sorted({w.encode() for _, template, _ in templates for w in template.split()})


def word_weights(df: DataFrame, text_col: str = "text", templates=TEMPLATES) -> dict[bytes, float]:
    """Inverse document frequency of every template word over all rows.

    Each task counts for itself; as many numbers as template words are left.
    """
    wanted = frozenset(vocabulary(templates))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = Counter(), 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                seen.update(wanted.intersection(words_of(text)))
        found = [*seen.items(), (b"", rows)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())],
            ["word", "n"],
        )

    counted = df.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    n = {r["word"].encode(): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = n.pop(b"", 0)
    return {w: log((total + 1) / (n.get(w, 0) + 0.5)) + 1e-6 for w in wanted}


class Index:
    """Postings of the key phrases' words: word -> template -> places in the template."""

    def __init__(self, weights: dict[bytes, float], templates=TEMPLATES):
        self.templates, self.keys = [], []
        self.postings: dict[bytes, dict[int, list[int]]] = {}
        for number, (label, template, phrase) in enumerate(templates):
            words, key = [w.encode() for w in template.split()], [w.encode() for w in phrase.split()]
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            shares = [weights[w] for w in words]
            self.templates.append((label, words, shares, sum(shares), at, key, template == phrase, number < BASE))
            self.keys.append(frozenset(key))
            for place in range(at, at + len(key)):
                self.postings.setdefault(words[place], {}).setdefault(number, []).append(place)
        # Rarest first; words of equal frequency in their own order.
        self.rank = {w: i for i, w in enumerate(sorted(self.postings, key=lambda w: (-weights[w], w)))}
        self.known = frozenset(self.rank)

    def looked_up(self, held: frozenset[bytes] | set[bytes]) -> dict[int, list[bytes]]:
        """The words by which each template that may stand in a file is looked for.

        The file's licence words are taken in order of rarity until every such
        template has been met LOOKED_UP times, or by all words of its key.
        """
        open_ = {
            number: min(LOOKED_UP, len(key)) for number, key in enumerate(self.keys) if key <= held
        }
        met: dict[int, list[bytes]] = {number: [] for number in open_}
        for word in sorted(held, key=self.rank.__getitem__):
            if not open_:
                break
            for number in self.postings[word].keys() & open_.keys():
                met[number].append(word)
                if len(met[number]) == open_[number]:
                    del open_[number]
        return met

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """Found templates with their start and the share of their weight that matches."""
        met = self.looked_up(self.known.intersection(words))
        if not met:
            return []
        wanted = {word for chosen in met.values() for word in chosen}
        places: dict[bytes, list[int]] = {}
        for place, word in enumerate(words):
            if word in wanted:
                places.setdefault(word, []).append(place)
        found = []
        for number, chosen in sorted(met.items()):
            starts = None
            for word in chosen:
                mine = {p - offset for offset in self.postings[word][number] for p in places[word]}
                starts = mine if starts is None else starts & mine
            _, template, shares, total, at, key, whole, _ = self.templates[number]
            for start in sorted(starts):
                lead = start + at
                if lead < 0 or words[lead : lead + len(key)] != key:
                    continue
                share = 1.0
                if not whole:
                    share = sum(
                        s for i, (w, s) in enumerate(zip(template, shares))
                        if 0 <= start + i < len(words) and words[start + i] == w
                    ) / total
                if share >= LEAST_SHARE or whole:
                    found.append((number, start, min(1.0, share)))
        return found


RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, places array<struct<label:string,word:long>>"
)
_PLACES = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))


def scan_licenses(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES
) -> DataFrame:
    """Licence labels of every whole text, with the places of all of them.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` are about the
    four base phrases, ``labels`` also holds those of longer notices; ``score``
    is the best share of a template's weight, 0 without a match.  Null text
    counts as empty; repeated rows are scanned each.  No rows, no result.
    """
    index = Index(word_weights(df, text_col, templates), templates)
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            rows = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = words_of(text)
                found = index.scan(words)
                base = [(index.templates[k][0], at) for k, at, _ in found if index.templates[k][7]]
                starts = [at for _, at in base]
                rows.append(
                    (
                        len(words),
                        len(base),
                        min(starts, default=None),
                        max(starts, default=None),
                        ",".join(sorted({label for label, _ in base})),
                        ",".join(sorted({index.templates[k][0] for k, _, _ in found})),
                        max((share for _, _, share in found), default=0.0),
                        [{"label": index.templates[k][0], "word": at} for k, at, _ in found],
                    )
                )
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _PLACES]
            columns = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").cast(to_arrow_type(kind)), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["key", *[c.split()[0] for c in RESULT.split(", ")]],
            )

    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"key {kind.simpleString()}, {RESULT}").withColumnRenamed("key", id_col)
