"""License scan with a positional index of rare words.

Templates are names of licenses, short notices and whole texts. The rarest words of each, by inverse document
frequency over the scanned files, are indexed as word -> (template, place). A file's words are looked up from the
rarest on; their postings are intersected by relative position, text place less template place, within the slack
that a template allows. Where they meet, the template's mandatory phrases must stand word for word, and the
weight of its rare words found near their places decides. All places are looked up, in whole texts.

Only words without which a template can't reach its weight propose places, so nothing is lost; the frequencies
are counted in a pass of their own, over words of templates only, so they are few however many files there are.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words: runs of 0-9, A-Z in lower case and bytes of non-ASCII characters; anything else separates.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Phrases of the text that must be found as they stand, one or two; none stands for the whole text.
    phrases: tuple[str, ...] = ()
    #: Part of the weight of the rare words that must be found near their places.
    least: float = 1.0
    #: Words by which these places, and that of the second phrase, may be off.
    slack: int = 0
    #: Whether the words around must say that it is the license of something; for short names.
    context: bool = False


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


#: Phrases that a base label stands for.
BASE = (Template("cc-by", "cc by"), Template("gpl", "general public license"), Template("reserved", "all rights reserved"))
#: Names that licenses go by.
NAMES = (
    Template("mit", "mit license", context=True),
    Template("mit", "mit licence", context=True),
    Template("apache-2.0", "apache license version 2 0"),
    Template("apache-2.0", "apache license 2 0"),
    Template("apache-2.0", "apache 2 0 license", context=True),
    Template("apache-2.0", "apache 2 0 licence", context=True),
    Template("apache-2.0", "apache licence version 2 0"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gplv3", context=True),
    Template("gpl-2.0", "gplv2", context=True),
    Template("gpl-3.0", "gpl v3", context=True),
    Template("gpl-2.0", "gpl v2", context=True),
    Template("lgpl", "lesser general public license"),
    Template("lgpl", "lgplv3", context=True),
    Template("agpl", "affero general public license"),
    Template("agpl", "agplv3", context=True),
    Template("mpl-2.0", "mozilla public license"),
    Template("bsd", "bsd license", context=True),
    Template("bsd", "bsd licence", context=True),
    Template("isc", "isc license", context=True),
    Template("bsl-1.0", "boost software license"),
    Template("epl", "eclipse public license"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "creative commons attribution sharealike"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("cc-by", "creative commons attribution 4 0"),
    Template("cc0", "cc0 1 0"),
    Template("public-domain", "into the public domain"),
)
#: Identifiers of licenses, as words, by their label.
IDENTIFIERS = {
    "mit": ("mit",), "apache-2.0": ("apache 2 0",), "gpl-3.0": ("gpl 3 0",), "gpl-2.0": ("gpl 2 0",), "lgpl": ("lgpl 2 1", "lgpl 3 0"), "agpl": ("agpl 3 0",), "mpl-2.0": ("mpl 2 0",), "bsd": ("bsd 2 clause", "bsd 3 clause"),
    "isc": ("isc",), "bsl-1.0": ("bsl 1 0",), "epl": ("epl 2 0",), "zlib": ("zlib",), "unlicense": ("unlicense",), "cc0": ("cc0 1 0",), "cc-by": ("cc by 4 0",), "cc-by-sa": ("cc by sa 4 0",),
}
#: The line that names the license of a file.
MARKS = tuple(Template(label, f"spdx license identifier {x}") for label, xs in IDENTIFIERS.items() for x in xs)
#: Words up to NEAR words before a name that say it is a license given, words as near behind it that do, and words that deny it.
LEADS = tuple(b"under licensed licenced license licence licenses released distributed terms covered".split())
AFTER = tuple(b"copyright permission".split())
DENIED = tuple(b"no not without never non".split())
NEAR, DENIED_NEAR, HEAD = 6, 4, 3
#: Texts of licenses and the notices that go into files.
TEXTS = (
    Template(
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
        ("permission is hereby granted free of charge", "without restriction"), 0.5, 8,
    ),
    Template(
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
        ("redistribution and use in source and binary forms",), 0.5, 8,
    ),
    Template(
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        ("with or without fee is hereby granted",), 0.5, 8,
    ),
    Template(
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        ("you may not use this file except in compliance with the license",), 0.5, 8,
    ),
    Template(
        "gpl-notice",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
        ("as published by the free software foundation", "any later version"), 0.5, 8,
    ),
    Template(
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        ("this source code form is subject to the terms",), 0.5, 8,
    ),
    Template(
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.""",
        ("permission is granted to anyone to use this software for any purpose",), 0.5, 8,
    ),
    Template(
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        ("free and unencumbered software released into the public domain",), 0.5, 8,
    ),
    Template(
        "bsl-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.""",
        ("permission is hereby granted free of charge", "use reproduce display distribute execute and transmit"), 0.5, 8,
    ),
    Template(
        "cc-by",
        """This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons.""",
        ("creative commons attribution 4 0 international",), 0.4, 8,
    ),
)
NOTICES = (*NAMES, *MARKS, *TEXTS)
#: Rare words of a template that are indexed; names have fewer.
RARE = 12


def _find(words: list, phrase: list) -> int:
    return next(k for k in range(len(words)) if words[k : k + len(phrase)] == phrase)


class Index:
    """Templates with places of their phrases, and postings of their rare words under given document frequencies."""

    def __init__(self, base=BASE, notices=NOTICES, frequency: dict[bytes, int] | None = None, n_files: int = 0):
        self.n_base, df = len(base), frequency or {}
        self.templates = []
        #: word -> (template, rare word, place in the template, whether it proposes places)
        self.postings: dict[bytes, list[tuple[int, int, int, bool]]] = {}
        for i, t in enumerate((*base, *notices)):
            words = split_words(t.text)
            phrases = [split_words(x) for x in t.phrases or (t.text,)]
            order = sorted(range(len(words)), key=lambda k: (df.get(words[k], 0), hashlib.md5(words[k] + b" %d" % k).hexdigest()))[:RARE]  # noqa: B023
            weight = [1 + math.log((n_files + 1) / (df.get(words[k], 0) + 1)) for k in order]
            total, over = sum(weight), 0.0
            for r, (k, w) in enumerate(zip(order, weight)):
                # Without any of the rarest words, the weight of the rest falls short.
                self.postings.setdefault(words[k], []).append((i, r, k, over <= (1 - t.least) * total + 1e-9))
                over += w
            self.templates.append((t.label, phrases, [_find(words, p) for p in phrases], order, weight, total, t.least, t.slack, t.context))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], dict[str, float]]:
        """Base places (start, template) and the best score of each label found."""
        found, scores = [], {}
        postings = self.postings
        if postings.keys().isdisjoint(words):
            return found, scores
        # Postings by template: places of each rare word, and the relative positions that the rarest propose.
        near: dict[int, dict[int, set[int]]] = {}
        proposed: dict[int, set[int]] = {}
        for p, w in enumerate(words):
            for i, r, k, proposes in postings.get(w, ()):
                near.setdefault(i, {}).setdefault(r, set()).add(p - k)
                if proposes:
                    proposed.setdefault(i, set()).add(p - k)
        for i, starts in proposed.items():
            label, phrases, at, _, weight, total, least, slack, context = self.templates[i]
            mine = near[i]
            if sum(weight[r] for r in mine) < least * total - 1e-9:
                continue
            # The first phrase fixes the place; relative positions of rare words lie around it.
            for start in {s + d for s in starts for d in range(-slack, slack + 1)} if slack else starts:
                if not self._stands(words, start + at[0], phrases[0]):
                    continue
                if context and not self._given(words, start, len(phrases[0])):
                    continue
                if len(phrases) > 1 and not any(self._stands(words, start + at[1] + d, phrases[1]) for d in range(-slack, slack + 1)):
                    continue
                part = sum(weight[r] for r, where in mine.items() if any(start + d in where for d in range(-slack, slack + 1))) / total
                if part >= least - 1e-9:
                    scores[label] = max(scores.get(label, 0.0), min(1.0, part))
                    if i < self.n_base:
                        found.append((start, i))
        return sorted(found), scores

    @staticmethod
    def _given(words: list[bytes], at: int, n: int) -> bool:
        """Whether a name of n words is that of a license given, at the head of a text or by the words around it."""
        before = words[max(0, at - NEAR) : at]
        if not set(before[-DENIED_NEAR:]).isdisjoint(DENIED):
            return False
        return at <= HEAD or not set(before).isdisjoint(LEADS) or not set(words[at + n : at + n + NEAR]).isdisjoint(AFTER)

    @staticmethod
    def _stands(words: list[bytes], at: int, phrase: list[bytes]) -> bool:
        return at >= 0 and words[at : at + len(phrase)] == phrase


def frequencies(texts: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many rows of (text) each word of the vocabulary stands, and the number of rows. Counts are summed in each task first; one row for each word is collected."""

    def each(batches):
        counts, n = Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for x in batch.column("text"):
                counts.update(vocabulary.intersection(split_words(x.as_py() or "")))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts] + [""], pa.string()), pa.array([*counts.values(), n], pa.int64())], names=["word", "n"])

    found = {r["word"]: r["n"] for r in texts.mapInArrow(each, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n = found.pop("", 0)
    return {w.encode(): k for w, k in found.items()}, n


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row.

    n_base counts all places of base phrases, first_word and last_word are the smallest and largest of their
    starts (null if none), labels are distinct, sorted and comma-joined, score is the best match from 0 to 1.
    Null and empty texts have no words and no labels. Repeated rows and null ids are kept, and each row counts
    in the frequencies; words of equal frequency are ordered by a digest. Other columns are ignored; an empty
    table gives no rows. A text may be of any length: work is linear in its words and the places proposed.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    index = Index(base, notices, *frequencies(rows.select("text"), {w for t in (*base, *notices) for w in split_words(t.text)}))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def one(text: str) -> tuple:
        words = split_words(text)
        places, scores = index.scan(words)
        starts = [p for p, _ in places]
        base_labels = ",".join(sorted({index.templates[i][0] for _, i in places}))
        return len(words), len(places), min(starts, default=None), max(starts, default=None), base_labels, ",".join(sorted(scores)), max(scores.values(), default=0.0)

    def each(batches):
        for batch in batches:
            found = [one(x.as_py() or "") for x in batch.column("text")]
            columns = list(zip(*found)) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return rows.mapInArrow(each, schema)


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.withColumn("score", F.round("score", 6))


def _words_of(xs) -> str:
    return "[" + ", ".join(f"'{x.decode()}'" for x in xs) + "]"


def _template_rows() -> str:
    listed = _words_of
    rows = []
    for i, t in enumerate((*BASE, *NOTICES)):
        words, phrases = split_words(t.text), [split_words(x) for x in t.phrases or (t.text,)]
        off = [_find(words, p) for p in phrases] + [0]
        more = listed(phrases[1]) if len(phrases) > 1 else "CAST([] AS VARCHAR[])"
        rows.append(f"({i}, '{t.label}', {listed(words)}, {listed(phrases[0])}, {off[0]}, {more}, {off[1]}, {t.least}::DOUBLE, {t.slack}, {str(i < len(BASE)).lower()}, {str(t.context).lower()})")
    return ", ".join(rows)


#: The templates as rows; the first phrase is looked for at every word, without the index.
OP5_SQL = rf"""
WITH t(id, label, words, phrase, off, more, off2, need, slack, base, context) AS (VALUES {_template_rows()}),
d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
v AS (SELECT id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM t),
f AS (SELECT word, count(*) AS df FROM (SELECT k, unnest(list_distinct(w)) AS word FROM d) SEMI JOIN v USING (word) GROUP BY word),
r AS (SELECT id, word, pos, 1 + ln(((SELECT count(*) FROM d) + 1) / (coalesce(df, 0) + 1)) AS idf FROM v LEFT JOIN f USING (word)
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(df, 0), md5(word || ' ' || pos)) <= {RARE}),
rare AS (SELECT id, list(word ORDER BY pos) AS rw, list(pos ORDER BY pos) AS rp, list(idf ORDER BY pos) AS ri, sum(idf) AS total FROM r GROUP BY id),
p AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS p FROM d),
m AS (SELECT t.*, rw, rp, ri, total, k, w, p - off AS s FROM p JOIN t ON w[p] = phrase[1] AND list_slice(w, p, p + len(phrase) - 1) = phrase JOIN rare USING (id)),
found AS (
    SELECT k, label, base, need, s - 1 AS start,
        list_sum(list_transform(range(1, len(rw) + 1), lambda j: CASE WHEN s + rp[j] + slack >= 1 AND list_contains(list_slice(w, greatest(s + rp[j] - slack, 1), s + rp[j] + slack), rw[j]) THEN ri[j] ELSE 0 END)) / total AS part
    FROM m WHERE (len(more) = 0 OR len(list_filter(range(-slack, slack + 1), lambda x: s + off2 + x >= 1 AND list_slice(w, s + off2 + x, s + off2 + x + len(more) - 1) = more)) > 0)
        AND (NOT context OR (NOT list_has_any(CASE WHEN s > 1 THEN list_slice(w, greatest(s - {DENIED_NEAR}, 1), s - 1) ELSE [] END, {_words_of(DENIED)})
            AND (s <= {HEAD} + 1 OR list_has_any(list_slice(w, greatest(s - {NEAR}, 1), s - 1), {_words_of(LEADS)}) OR list_has_any(list_slice(w, s + len(phrase), s + len(phrase) + {NEAR} - 1), {_words_of(AFTER)}))))
),
ok AS (SELECT * FROM found WHERE part >= need - 1e-9),
g AS (
    SELECT k, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(least(part, 1)) AS score
    FROM ok GROUP BY k
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6) AS score
FROM d LEFT JOIN g USING (k)
"""
