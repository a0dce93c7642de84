"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies.

DataFrame expressions only, one narrow pass, no shuffle.  Words are runs of
letters and digits in lower case, shingles have five words.  A template of
``PIECE`` shingles or more is cut into pieces of just so many, the last of which
ends with the template, and a document into windows of two neighbouring blocks of
``PIECE``, so each piece that a document holds lies whole in a window.  A window
that holds 0.8 of a piece has a Jaccard similarity of at least 0.36 to it; with
``BANDS`` bands of one MinHash each it shares one with a probability above 0.999.
Shorter templates are looked up shingle by shingle.  A retrieved template is
reported if the document holds at least 0.8 of its distinct shingles, compared
word by word.

Signatures stand in the plan as sets of literals (16 numbers for each 32 words of
a template), which suits lists of some hundred notices.

Null and empty texts, and texts of fewer than five words, hold nothing.  Very long
texts are scanned whole.  Repeated rows are scanned one by one, further columns
are passed through by ``scan`` (one of the name that it adds is replaced), and an
empty table gives an empty result.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mesostate.llm.common import let, read

SHINGLE = 5
LEAST = 0.8
PIECE = 32
BANDS = 16

#: Short and long notices by name; a parameter of ``scan``.  Public wording, fixed values.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_UNSIGNED = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Masks of the MinHash functions: the value closest to a mask, by exclusive or, is the minimum.
MASKS = [_signed(xxhash.xxh64_intdigest(b"mask %d" % k)) for k in range(BANDS)]


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _hash(words: list[str]) -> int:
    """Spark's ``xxhash64`` of several columns: each value's hash seeds the next."""
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return _signed(h)


class Signatures:
    """Literals that the scan looks for, made from the templates on the driver."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.shingles, self.keys = [], [], []
        self.tiny: set[int] = set()
        self.bands: set[int] = set()
        for name in sorted(templates):
            words = template_words(templates[name])
            grams = [words[i : i + SHINGLE] for i in range(len(words) - SHINGLE + 1)]
            if not grams:
                continue
            hashes = [_hash(g) for g in grams]
            if len(grams) < PIECE:
                keys = set(hashes)
                self.tiny |= keys
            else:
                starts = {min(a, len(hashes) - PIECE) for a in range(0, len(hashes), PIECE)}
                keys = {min(h ^ m for h in hashes[a : a + PIECE]) for a in starts for m in MASKS}
                self.bands |= keys
            self.names.append(name)
            self.shingles.append(sorted({" ".join(g) for g in grams}))
            self.keys.append(sorted(keys))


def _longs(values) -> Column:
    return F.lit(sorted(values)).cast("array<long>") if values else F.array().cast("array<long>")


def found_keys(words: Column, known: Signatures) -> Column:
    """Signature values of the text that are some template's."""

    def windows(h: Column) -> Column:
        def block_minima(b: Column) -> Column:
            block = F.slice(h, b * PIECE + 1, F.lit(PIECE))
            return let(block, lambda part: F.transform(F.lit(MASKS).cast("array<long>"), lambda m: F.array_min(F.transform(part, lambda x: x.bitwiseXOR(m)))))

        def joined(minima: Column) -> Column:
            pair = F.transform(minima, lambda own, b: F.zip_with(own, F.coalesce(F.get(minima, b + 1), own), lambda x, y: F.least(x, y)))
            return F.filter(F.flatten(pair), lambda v: v.isin(sorted(known.bands)))

        blocks = F.sequence(F.lit(0), ((F.size(h) - 1) / PIECE).cast("int"))
        return let(F.transform(blocks, block_minima), joined)

    def both(h: Column) -> Column:
        short = F.filter(h, lambda x: x.isin(sorted(known.tiny))) if known.tiny else _longs(())
        return F.array_distinct(F.concat(short, windows(h) if known.bands else _longs(())))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, let(hashes, both)).otherwise(_longs(()))


def _matched(words: Column, known: Signatures) -> Column:
    """Names of retrieved templates that the text's shingles contain."""

    def verify(keys: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.array_join(F.slice(words, i + 1, F.lit(SHINGLE)), " "))

        def check(own: Column) -> Column:
            hits = [
                F.when(F.arrays_overlap(keys, _longs(k)) & (F.size(F.array_intersect(own, F.lit(s))) >= LEAST * len(s) - 1e-9), F.lit(n))
                for n, s, k in zip(known.names, known.shingles, known.keys, strict=True)
            ]
            return F.array_compact(F.array(*hits))

        return F.when(F.size(keys) > 0, let(grams, check)).otherwise(F.array().cast("array<string>"))

    return let(found_keys(words, known), verify)


def scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, text: str = "text", into: str = "licenses") -> DataFrame:
    """``df`` with the sorted names of the templates that each text holds."""
    known = Signatures(templates)
    if not known.names:
        return df.withColumn(into, F.array().cast("array<string>"))
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return df.withColumn(into, let(words, lambda w: _matched(w, known)))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


def _sql() -> str:
    known = Signatures(TEMPLATES)
    rows = ", ".join(f"('{n}', '{g}', {len(s)})" for n, s in zip(known.names, known.shingles, strict=True) for g in s)
    return rf"""WITH t(name, g, total) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
hit AS (SELECT rid, name FROM s JOIN t USING (g) GROUP BY rid, name, total HAVING 10 * count(*) >= 8 * total),
n AS (SELECT rid, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM hit GROUP BY rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(names, '') AS licenses FROM d LEFT JOIN n USING (rid)"""


QUERIES = {"op1_licenses": op1_licenses}
SQL = {"op1_licenses": _sql()}
