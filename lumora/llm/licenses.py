"""License scans: MinHash bands over text windows retrieve templates, exact shingle containment verifies them.

DataFrame and SQL functions only. A text's words are runs of letters and digits in lower case, so comment
signs, line breaks and punctuation do not count; shingles have five words, or all words of a shorter
template. A template of n shingles is indexed by all its windows of the largest power of two up to n; texts
are cut into windows of each such width, a quarter of it apart (at the end of a text, what is left of one).
The least hashes of all widths come from one pass: a window is two of half its width. A window is hashed by ``BANDS`` MinHash
functions, each a band of one row: windows of Jaccard similarity s meet with a chance of
1 - (1 - s) ** BANDS, above 0.99 from s = 0.44. A text that holds 0.8 of a template's shingles in one stretch
has such a window: were only 0.8 of the template's words kept, the most similar of the windows would still
share over half. Each meeting is then verified: shingles of the template in the stretch around it, as a
share of all of the template's.

Before, texts are passed over that lack every anchor of every template. A template's anchors are words that
together are in more than a fifth of its shingles, so no text with 0.8 of the shingles lacks them all.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm._shared import columns, written

SHINGLE, BANDS, CONTAINED = 5, 8, 0.8
#: Candidates up to this many rows go to every task, more are joined by shuffle.
MOST_SENT = 500_000
#: Common license notices and bodies.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("MIT", 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "All rights reserved."),
)


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_+", text.lower()) if w]


def anchors(words: list[str], k: int) -> list[str]:
    """Words, longest first, that are in more than a fifth of the ``k``-word shingles together."""
    n = max(1, len(words) - k + 1)
    hit, out = set(), []
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if len(hit) * 5 > n:
            break
        hit |= {i for i in range(n) if w in words[i : i + k]}
        out.append(w)
    return out


_WORDS = r"filter(split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' '), ' '), w -> w <> '')"


def _shingles(k: int) -> str:
    return f"case when size(words) >= {k} then transform(sequence(1, size(words) - {k - 1}), i -> xxhash64(slice(words, i, {k}))) else cast(array() as array<bigint>) end"


def _fixed(rows: DataFrame, **made: str) -> DataFrame:
    """Adds columns that are computed once a row: a generator keeps them from being copied into later lambdas."""
    packed = F.explode(F.array(F.struct(*[F.expr(e).alias(n) for n, e in made.items()]))).alias("_made")
    return rows.select("*", packed).select(*[c for c in rows.columns if c not in made], *[F.col(f"_made.{n}").alias(n) for n in made])


def _signatures(rows: DataFrame, width: int, step: int, keep: list[str]) -> DataFrame:
    """Rows (keep..., start, band, least) for windows of ``width`` shingles every ``step``, and the last."""
    starts = f"array_union(sequence(0, greatest(0, size(h) - {width}), {step}), array(greatest(0, size(h) - {width})))"
    bands = [f"transform(starts, i -> array_min(slice(b{j}, i + 1, {width})))" for j in range(BANDS)]
    rows = _fixed(rows.where("size(h) > 0").select(*keep, "h"), starts=starts, **{f"b{j}": f"transform(h, s -> xxhash64(s, {j}))" for j in range(BANDS)})
    rows = rows.select(*keep, "starts", F.array(*[F.expr(b) for b in bands]).alias("bands"))
    rows = rows.select(*keep, "starts", F.posexplode("bands").alias("band", "mins"))
    return rows.select(*keep, "band", F.explode(F.arrays_zip("starts", "mins")).alias("z")).select(*keep, "band", F.col("z.starts").alias("start"), F.col("z.mins").alias("least"))


def _halved(width: int) -> str:
    """Least hashes of windows of twice ``width``, from those of ``width`` (m): each by band, a quarter of their width apart, 1 at least."""
    if width < 4:
        return f"transform(m, b -> transform(b, (v, i) -> least(v, get(b, i + {width}))))"
    return "transform(m, b -> case when size(b) = 0 then b else transform(sequence(0, (size(b) - 1) div 2), i -> least(b[2 * i], get(b, 2 * i + 4))) end)"


def _windows(rows: DataFrame, widths: list[int], k: int) -> DataFrame:
    """Rows (rid, width, start, band, least) of texts (rid, words) for windows of all ``widths``."""
    rows = _fixed(rows, h=_shingles(k)).where("size(h) > 0").select("rid", "h")
    rows = _fixed(rows, m=f"transform(sequence(0, {BANDS - 1}), j -> transform(h, s -> xxhash64(s, j)))").select("rid", "m")
    kept, width = [], 1
    while True:
        if width in widths:
            rows = rows.withColumn(f"m{width}", F.col("m"))
            kept.append(f"named_struct('width', {width}, 'bands', m{width})")
        if width >= max(widths):
            break
        rows = _fixed(rows, m=_halved(width))
        width *= 2
    rows = rows.select("rid", F.explode(F.expr(f"array({', '.join(kept)})")).alias("w"))
    rows = rows.select("rid", "w.width", F.posexplode("w.bands").alias("band", "mins")).select("rid", "width", "band", F.posexplode("mins").alias("place", "least"))
    return rows.select("rid", "width", "band", (F.col("place") * F.greatest(F.lit(1), F.expr("width div 4"))).cast("int").alias("start"), "least")


def license_matches(documents: DataFrame, templates=TEMPLATES) -> DataFrame:
    """A row per text and license found: doc_id, license, containment, start_word, n_words.

    The best template of a license counts, and of equally good places the first; words count from 0 as
    described above. ``documents(doc_id, text)``: null and empty texts match nothing, a null doc_id stays
    null, rows equal in id and text are reported once. Texts of any length are taken whole. Other columns are
    not read. An empty table, or no templates, gives no rows.
    """
    spark = documents.sparkSession
    rows = columns(documents, "doc_id", "text").where("text is not null")
    known = [(i, name, template_words(t)) for i, (name, t) in enumerate(templates)]
    known = [(i, name, w, min(SHINGLE, len(w))) for i, name, w in known if w]
    if not known:
        return rows.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words")).limit(0)
    every = sorted({a for _, _, w, k in known for a in anchors(w, k)})
    rows = rows.where(F.lower("text").rlike("|".join(re.escape(a) for a in every)))
    rows = _fixed(rows, rid="xxhash64(doc_id, text)", words=_WORDS).select("doc_id", "rid", "words")
    rows = written(rows, "license-texts")
    words = rows.agg(F.sum(F.size("words"))).first()[0] or 0
    spread = rows.select("rid", "words").repartition(max(16, words // 100_000))
    table = spark.createDataFrame(known, "template int, license string, words array<string>, k int")
    found = None
    for k in sorted({x[3] for x in known}):
        own = table.where(F.col("k") == k).withColumn("h", F.expr(_shingles(k)))
        widths = sorted({1 << max(0, (len(w) - k + 1).bit_length() - 1) for _, _, w, kk in known if kk == k})
        index = None
        for width in widths:
            fits = own.where((F.size("h") >= width) & (F.size("h") < 2 * width))
            part = _signatures(fits, width, 1, ["template"]).select(F.lit(width).alias("width"), "template", "band", "least").distinct()
            index = part if index is None else index.unionByName(part)
        # templates are a parameter of a few rows
        met = _windows(spread, widths, k).join(F.broadcast(index), ["width", "band", "least"]).select("rid", "template", "start", "width").distinct()
        found = met if found is None else found.unionByName(met)
    found = written(found, "license-candidates")
    n = found.count()
    sent = F.broadcast(found.withColumnRenamed("rid", "r")) if n <= MOST_SENT else found.withColumnRenamed("rid", "r")
    wanted = table.select(F.col("template").alias("t"), "license", "k", F.expr("transform(sequence(1, size(words) - k + 1), i -> xxhash64(slice(words, i, k)))").alias("theirs"), F.size("words").alias("length"))
    pairs = rows.join(sent, F.col("rid") == F.col("r")).join(F.broadcast(wanted), F.col("template") == F.col("t"))
    span = pairs.withColumn("low", F.greatest(F.lit(0), F.col("start") - F.size("theirs"))).withColumn("size", F.size("theirs") * 2 + F.col("width"))
    span = _fixed(span, part="slice(words, low + 1, size + k - 1)", theirs="array_distinct(theirs)").drop("words")
    span = _fixed(span, mine="case when size(part) >= k then transform(sequence(1, size(part) - k + 1), i -> xxhash64(slice(part, i, k))) else cast(array() as array<bigint>) end")
    span = span.withColumn("containment", F.size(F.array_intersect("theirs", "mine")) / F.size("theirs")).where(F.col("containment") >= CONTAINED)
    span = _fixed(span, places="filter(transform(mine, (s, i) -> case when array_contains(theirs, s) then i end), i -> i is not null)")
    span = span.withColumn("start_word", F.col("low") + F.array_min("places")).withColumn("n_words", F.array_max("places") - F.array_min("places") + F.col("k"))
    best = F.min_by(F.struct("containment", "start_word", "n_words"), F.struct(-F.col("containment"), -F.col("length"), F.col("start_word"), F.col("n_words")))
    return span.groupBy("rid", "doc_id", "license").agg(best.alias("b")).select("doc_id", "license", F.col("b.containment").alias("containment"), F.col("b.start_word").alias("start_word"), F.col("b.n_words").alias("n_words"))
