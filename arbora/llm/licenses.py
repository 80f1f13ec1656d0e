"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies. DataFrame operations only."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Texts and notices of public licenses, as their publishers give them.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "boost": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
}
#: Full texts, a file each.
TEMPLATES |= {f"{p.stem.lower()}-text": p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
#: Words that a span must hold besides: these notices share more than most of their shingles.
MUST = {"gpl-notice": "terms of the gnu general", "lgpl-notice": "terms of the gnu lesser", "agpl-notice": "terms of the gnu affero"}
K = 5
#: One-line notices: what is said to be granted, then names by family, over words joined by one space; and SPDX identifiers.
GRANT = "(?:licen[sc]ed|released|distributed|available|published|provided|shared|covered) under (?:the |an? )?(?:terms (?:and conditions )?of )?(?:the |an? )?"
_CC = "(?:cc|creative commons) "
FAMILIES = {
    "mit": ("(?:mit|expat|x11)(?: x11)? licen[sc]e", "mit(?! 0)"),
    "apache": ("apache (?:software )?(?:licen[sc]e|2 0)", "apache 2 0"),
    "bsd": ("(?:(?:new|modified|simplified|revised) )?(?:[0234] clause )?bsd(?: [0234] clause)?(?: style)? licen[sc]e", "bsd [1234] clause"),
    "gpl": ("(?:gnu general public licen[sc]e|(?:gnu )?gpl ?v?[123]\\b|(?:gnu )?gpl\\b)", "gpl [123] 0"),
    "lgpl": ("(?:gnu (?:lesser|library) general public licen[sc]e|(?:gnu )?lgpl ?v?[23]?\\b)", "lgpl [23] [01]"),
    "agpl": ("(?:gnu affero general public licen[sc]e|(?:gnu )?agpl ?v?3?\\b)", "agpl [13] 0"),
    "mpl": ("(?:mozilla public licen[sc]e|mpl ?v?[12]\\b)", "mpl [12] [01]"),
    "isc": ("isc licen[sc]e", "isc"),
    "zlib": ("zlib(?: libpng)? licen[sc]e", "zlib"),
    "unlicense": ("unlicense", "unlicense"),
    "boost": ("boost software licen[sc]e", "bsl 1 0"),
    "epl": ("eclipse public licen[sc]e", "epl [12] 0"),
    "cc0": ("(?:cc0|creative commons (?:zero|cc0))", "cc0 1 0"),
    "cc-by": (_CC + "(?:by|attribution) (?:licen[sc]e|[1-4] [0-9]|international)", "cc by [1-4] [0-9]"),
    "cc-by-sa": (_CC + "(?:by sa|attribution share ?alike)", "cc by sa [1-4] [0-9]"),
    "cc-by-nc": (_CC + "(?:by nc|attribution non ?commercial)(?! (?:sa|nd|share|no ))", "cc by nc [1-4] [0-9]"),
    "cc-by-nd": (_CC + "(?:by nd|attribution no ?deriv)", "cc by nd [1-4] [0-9]"),
    "cc-by-nc-sa": (_CC + "(?:by nc sa|attribution non ?commercial share ?alike)", "cc by nc sa [1-4] [0-9]"),
    "cc-by-nc-nd": (_CC + "(?:by nc nd|attribution non ?commercial no ?deriv)", "cc by nc nd [1-4] [0-9]"),
}
NOTICES = {f"{k}-line": GRANT + v[0] for k, v in FAMILIES.items()} | {f"{k}-spdx": "spdx license identifier " + v[1] for k, v in FAMILIES.items()}


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def anchors(words: list[str], share: float) -> set[str]:
    """Words of which at least one stands in any `share` of the template's shingles: those left without any are fewer."""
    grams = {tuple(words[i : i + K]) for i in range(max(len(words) - K + 1, 1))}
    out, left, total = set(), set(grams), len(grams)
    rank = Counter(w for g in grams for w in set(g))
    order = (lambda w: (len(w) < 7, -rank[w], w)) if total > 256 else (lambda w: (-len(w), w))
    for w in sorted(rank, key=order):  # long words first: prose lacks them; in a full text the frequent ones of these, which are few
        if len(left) < share * total:
            break
        out.add(w)
        left = {g for g in left if w not in g}
    return out


def word_list(text: Column) -> Column:
    """Lower-case words of letters a-z and digits."""
    return F.filter(F.split(lower_ascii(text), "[^a-z0-9]+"), lambda w: F.length(w) > 0)


def shingle_list(words: Column) -> Column:
    """Hashes of the K-word shingles in order; a shorter list is one shingle, an empty one none."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), n - K + 1), lambda i: F.xxhash64(*[F.element_at(words, (i + k).cast("int")) for k in range(K)]))
    return F.when(n >= K, many).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def hashed(elements: Column, bands: int) -> Column:
    """An array per hash function: the elements under it."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda j: F.transform(elements, lambda x: F.xxhash64(x, j)))


def keys(hashes: Column, start: Column, m: Column) -> Column:
    """Bands of one row each, of the m elements from start: function and minimum hashed together."""
    return F.transform(hashes, lambda h, j: F.xxhash64(j, F.array_min(F.slice(h, start, m))))


def window(hashes: Column, m: int):
    """Of a start, (i, k): it and the bands of the m shingles from there."""
    return lambda i: F.struct(i.alias("i"), keys(hashes, i, F.lit(m)).alias("k"))


def sharing(known: Column):
    """Whether a window shares a band with `known`."""
    return lambda w: F.arrays_overlap(w["k"], known)


def numbers(values) -> Column:
    """An array literal, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def lines(words: Column, name: str, pattern: str) -> Column:
    """The spans (name, s, e) in words of a one-line notice's pattern."""
    flat, whole = F.array_join(words, " "), rf"(?<![a-z0-9])(?:{pattern})(?:[a-z0-9]*)"
    length = lambda c: F.size(F.filter(F.split(c, " "), lambda w: F.length(w) > 0))
    hits = F.regexp_extract_all(flat, F.lit(whole), F.lit(0))
    pairs = F.zip_with(hits, F.slice(F.split(flat, whole, -1), 1, F.size(hits)), lambda m, g: F.struct(length(m).alias("m"), length(g).alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<name:string,s:int,e:int>>").alias("out"))

    def step(acc, x):
        s = acc["at"] + x["g"]
        return F.struct((s + x["m"]).alias("at"), F.concat(acc["out"], F.array(F.struct(F.lit(name).alias("name"), s.alias("s"), (s + x["m"]).alias("e")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def verifier(name: str, has: Column, n: int, k: int, sh: Column, m: int, step: int, share: float, must: Column | None = None):
    """Of a window, the span (name, s, e) of the template's shingles in and a step around it; null under `share` of them."""

    def verify(w: Column) -> Column:
        a = F.greatest(w["i"] - step, F.lit(1))
        part = F.slice(sh, a, m + 2 * step)
        inside = F.filter(F.transform(part, lambda x, p: F.when(F.array_contains(has, x), a + p)), lambda p: p.isNotNull())
        span = F.struct(F.lit(name).alias("name"), (F.array_min(inside) - 1).cast("int").alias("s"), (F.array_max(inside) - 1 + k).cast("int").alias("e"))
        held = F.size(F.array_intersect(has, part)) >= share * n
        return F.when(held if must is None else held & F.arrays_overlap(must, part), span)

    return verify


def licenses(df: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: dict[str, str] | None = None, share: float = 0.8, bands: int = 16) -> DataFrame:
    """One row per row of df: doc_id, n_licenses, licenses (names by text), spans ("name:start:end" in words, end exclusive).

    A template is found where at least `share` of its five-word shingles stand within a window as long as
    the template and a half of such a step on either side. Windows have the template's number of shingles (templates
    of like size share them) and start at every quarter of it, so one of them overlaps a match by 3/4 and has a
    similarity over 0.4; with 16 bands of one row it retrieves the template with probability over 0.9997.
    Before that, a text needs one of the words without which no `share` of a template's shingles can be
    (see anchors): texts without are passed without windows, losing nothing.

    With the default templates, one-line notices and SPDX identifiers (NOTICES) are found by patterns over the words.

    Null and empty texts, and texts without such words, have no license. Repeated rows get equal results; other columns aren't read.
    """
    spark = df.sparkSession
    given = {k: template_words(v) for k, v in (TEMPLATES if templates is None else templates).items()}
    given = {k: w for k, w in given.items() if w}
    size = lambda w: max(1, 1 << max(0, len(w) - K).bit_length())  # noqa: E731  shingles of a window: a power of two that holds the template
    known = spark.createDataFrame([(k, size(w), w) for k, w in given.items()], "name string, m int, words array<string>")
    known = known.select("name", "m", F.array_distinct(shingle_list(F.col("words"))).alias("has")).withColumn("keys", keys(hashed(F.col("has"), bands), F.lit(1), F.size("has"))).collect()  # as many as templates
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    low = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    gates, gate = {}, F.lit(False)
    for m in sorted({r["m"] for r in known}):  # by size of window
        for a in sorted({a for r in known if r["m"] == m for a in anchors(given[r["name"]], share)}):
            gates[m] = gates.get(m, F.lit(False)) | F.contains(low, F.lit(a))
        gate = gate | F.col(f"gate{m}")
    notices = NOTICES if templates is None else {}
    told = F.contains(low, F.lit("spdx")) | F.rlike(low, F.lit("(?:ed|able)[^a-z0-9]+under[^a-z0-9]")) if notices else F.lit(False)
    none = F.array().cast("array<struct<name:string,s:int,e:int>>")
    sh, hits = F.col("sh"), none
    # each step is a column of its own, so that it is computed once a text
    flagged = rows.select("*", *[g.alias(f"gate{m}") for m, g in gates.items()], told.alias("told"))
    flagged = flagged.withColumn("words", F.when(gate | F.col("told"), word_list(F.col("text"))).otherwise(F.array().cast("array<string>"))).withColumn("sh", F.when(gate, shingle_list(F.col("words"))).otherwise(F.array().cast("array<bigint>"))).withColumn("hs", hashed(sh, bands))
    for m in sorted({r["m"] for r in known}):
        own = [r for r in known if r["m"] == m]
        step = max(1, m // 4)
        starts = F.sequence(F.lit(1), F.greatest(F.size(sh) - m + step, F.lit(1)), F.lit(step))
        every = numbers(sorted({x for r in own for x in r["keys"]}))
        enough = min(share * len(r["has"]) for r in own)  # a shorter text can't hold any of them
        flagged = flagged.withColumn(f"near{m}", F.when(F.col(f"gate{m}") & (F.size("sh") >= max(enough, 1)), F.filter(F.transform(starts, window(F.col("hs"), m)), sharing(every))))
        for r in own:
            has, mine = numbers(r["has"]), numbers(r["keys"])
            must = F.array(F.xxhash64(*[F.lit(w) for w in MUST[r["name"]].split()])) if templates is None and r["name"] in MUST else None
            verify = verifier(r["name"], has, len(r["has"]), min(K, len(given[r["name"]])), sh, m, step, share, must)
            hits = F.concat(hits, F.coalesce(F.filter(F.transform(F.filter(f"near{m}", sharing(mine)), verify), lambda x: x.isNotNull()), none))
    flagged = flagged.withColumn("said", F.when(F.col("told"), F.concat(*[lines(F.col("words"), k, v) for k, v in notices.items()])).otherwise(none) if notices else none)
    found = flagged.withColumn("hits", F.when(F.size("words") > 0, F.array_sort(F.concat(hits, F.col("said")))).otherwise(none))

    def merge(acc, x):  # of one template, spans that overlap are one match
        last = F.element_at(acc, -1)
        same = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["name"] == x["name"]) & (x["s"] < F.get(acc, F.size(acc) - 1)["e"])
        return F.when(same, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["name"].alias("name"), last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))).otherwise(F.concat(acc, F.array(x)))

    merged = F.when(F.size("hits") > 0, F.aggregate("hits", none, merge)).otherwise(none)
    spans = F.array_sort(F.transform("merged", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["name"].alias("name"))))
    out = found.withColumn("merged", merged).withColumn("found", spans)
    return out.select("doc_id", F.size("found").cast("long").alias("n_licenses"), F.array_join(F.array_distinct(F.transform("found", lambda x: x["name"])), ",").alias("licenses"), F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["name"], x["s"].cast("string"), x["e"].cast("string"))), ",").alias("spans"))
