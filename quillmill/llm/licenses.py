"""Operator 8: licence scans by sparse TF-IDF cosine and directory inheritance.

Every statement of a text (a line, cut at sentence ends) and every run of
``WINDOW`` statements that begins at a licence cue is compared with the headers of ``TEMPLATES``, short notices and
opening passages alike, by the cosine of sparse TF-IDF vectors, and every whole text that holds a cue
with the whole licences in ``licence_texts``. Document frequencies
come from all texts, but only of the templates' words, so they stay small. A file
that is near a whole licence, or is mostly notices, is a licence file, and files without a licence of
their own inherit that of the licence file in their nearest ancestor directory, found by joining
each path's ancestors to the directories of licence files.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.skew import join_counted
from quillmill.llm.store import materialize

# Licence names (SPDX) and their customary notices and opening passages.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See the LICENSE file for details."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal Public Domain Dedication."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("LicenseRef-proprietary", "All rights reserved. No part of this work may be reproduced without written permission."),
)
CUE = re.compile(r"licen[cs]e|permission|redistribut|free software|copyright|public domain|rights reserved|source code form|spdx", re.I)
STATEMENT = re.compile(r"\n+|(?<=[.;:!?])\s+(?=\S)")
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: Statements of the longest passage that is compared as a whole.
WINDOW = 3


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


@lru_cache
def whole_licenses() -> tuple[tuple[str, str], ...]:
    """Identifier and whole text of each licence. The Affero licence is the general one under its own name, but for a section."""
    found = {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "licence_texts").glob("*-*.txt"))}
    found |= {name: (Path(__file__).parent / "licence_texts" / f"{name}.txt").read_text(encoding="utf-8") for name in ("ISC", "MIT")}
    found["BSD-2-Clause"] = re.sub(r"3\. Neither.*?permission\.\n\n", "", found["BSD-3-Clause"], flags=re.S)
    found["AGPL-3.0"] = re.sub(r"GNU( +)(General|GENERAL)", r"GNU\1Affero General", found["GPL-3.0"])
    return tuple(sorted(found.items()))


@lru_cache
def vocabulary() -> tuple[str, ...]:
    return tuple(sorted({w for _, t in TEMPLATES + whole_licenses() for w in words(t)}))


class Matcher:
    """Cosine to the templates under the given document frequencies; words of no template weigh as the rarest."""

    def __init__(self, frequency: dict[str, int], documents: int):
        rarest = math.log((1 + documents) / 1) + 1
        self.idf = {w: math.log((1 + documents) / (1 + frequency.get(w, 0))) + 1 for w in vocabulary()}
        self.rarest = rarest
        self.headers, self.wholes = self._index(TEMPLATES), self._index(whole_licenses())

    def _index(self, templates: tuple[tuple[str, str], ...]) -> tuple[list[str], dict[str, list[tuple[int, float]]]]:
        index: dict[str, list[tuple[int, float]]] = {}
        for k, (_, text) in enumerate(templates):
            for w, x in self.vector(words(text)).items():
                index.setdefault(w, []).append((k, x))
        return [name for name, _ in templates], index

    def vector(self, tokens: list[str]) -> dict[str, float]:
        v = {w: (1 + math.log(n)) * self.idf.get(w, self.rarest) for w, n in Counter(tokens).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    def best(self, text: str, whole: bool = False) -> tuple[float, str]:
        """(cosine, licence) of the nearest header, or whole licence; ties go to the first."""
        names, index = self.wholes if whole else self.headers
        scores: dict[int, float] = {}
        for w, x in self.vector(words(text)).items():
            for k, y in index.get(w, ()):
                scores[k] = scores.get(k, 0.0) + x * y
        if not scores:
            return 0.0, ""
        k = min(scores, key=lambda k: (-round(scores[k], 9), k))
        return scores[k], names[k]

    def scan_file(self, text: str | None, least: float, whole_least: float, file_share: float) -> tuple[str | None, float, list[tuple[int, int, str, float]], bool]:
        """(licence, cosine, spans, whether it is a licence file) of a whole text; a whole licence is one span."""
        text = text or ""
        if CUE.search(text):
            score, name = self.best(text, whole=True)
            if score >= whole_least:
                return name, score, [(0, len(text), name, score)], True
        name, score, spans, covered = self.scan(text, least)
        return name, score, spans, covered >= file_share

    def scan(self, text: str | None, least: float) -> tuple[str | None, float, list[tuple[int, int, str, float]], float]:
        """(licence, cosine, spans (start, end, licence, cosine), covered share) of a whole text."""
        text = text or ""
        spans = []
        if CUE.search(text):
            edges, at = [], 0
            for m in STATEMENT.finditer(text):
                edges.append((at, m.start()))
                at = m.end()
            edges = [(a, b) for a, b in [*edges, (at, len(text))] if b > a]
            for k, (a, b) in enumerate(edges):
                near = edges[max(0, k - WINDOW + 1) : k + 1]
                if not any(CUE.search(text, x, y) for x, y in near):
                    continue
                best = (0.0, "", a, b)
                for n in range(WINDOW):
                    if k + n < len(edges):
                        score, name = self.best(text[a : edges[k + n][1]])
                        if score > best[0] + 1e-9:
                            best = (score, name, a, edges[k + n][1])
                if best[0] >= least:
                    spans.append((best[2], best[3], best[1], best[0]))
        # overlapping passages: the better one stays
        chosen: list[tuple[int, int, str, float]] = []
        for s in sorted(spans, key=lambda s: (-s[3], s[0])):
            if all(s[1] <= c[0] or c[1] <= s[0] for c in chosen):
                chosen.append(s)
        chosen.sort()
        top = max(chosen, key=lambda s: (s[3], -s[0]), default=None)
        covered = sum(len(text[a:b].strip()) for a, b, _, _ in chosen) / max(1, len(text.strip()))
        return (top[2], top[3], chosen, covered) if top else (None, 0.0, [], 0.0)


def word_frequencies(files: DataFrame, text_col: str = "text") -> tuple[dict[str, int], int]:
    """How many texts hold each template word, over all texts, and how many texts there are."""
    known = frozenset(vocabulary())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        rows = 0
        for batch in batches:
            for t in batch.column(0):
                rows += 1
                seen.update(known.intersection(words(t.as_py() or "")))
        seen[""] = rows
        yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    found = files.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {r["word"]: r["n"] for r in found.collect()}  # the templates' vocabulary at most
    return counts, counts.pop("", 0)


def scan_licenses(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", least: float = 0.6, file_share: float = 0.5, whole_least: float = 0.85) -> DataFrame:
    """One row per input row: ``doc_id, path, license, cosine, origin, n_spans, spans, license_path``.

    origin is ``own``, ``inherited`` or ``none``. spans are ``start:end:licence``
    in code points. A text whose cosine to a whole licence is ``whole_least`` or more is that licence's file. Of several licence files in one directory the best match,
    then the smallest path, speaks for it. Null text counts as empty, a null path has no ancestors, an
    empty table gives an empty result; other columns are ignored.
    """
    matcher = Matcher(*word_frequencies(files, text_col))
    sent = files.sparkSession.sparkContext.broadcast(matcher)  # as large as the templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(2):
                name, score, spans, is_file = sent.value.scan_file(t.as_py(), least, whole_least, file_share)
                rows.append((name, score, len(spans), ",".join(f"{a}:{b}:{n}" for a, b, n, _ in spans), is_file))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "path", "own", "score", "n_spans", "spans", "is_file"])

    rows = files.select(F.col(id_col).cast("long").alias("doc_id"), path.cast("string").alias("path"), F.col(text_col).alias("text"))
    rows = materialize(rows.mapInArrow(scan, "doc_id long, path string, own string, score double, n_spans long, spans string, is_file boolean"), "license-scan")

    parent = F.regexp_replace("path", r"/?[^/]*$", "")
    best = F.min(F.struct((-F.col("score")).alias("worse"), "path", "own")).alias("top")
    notices = rows.filter("is_file and own is not null and path is not null").groupBy(parent.alias("dir")).agg(best)
    notices = notices.select("dir", F.col("top.own").alias("inherited"), (-F.col("top.worse")).alias("inherited_score"), F.col("top.path").alias("license_path"))
    # ancestors of each directory, not of each file: a directory is looked up once
    heirs = rows.filter("own is null and path is not null").withColumn("home", parent)
    dirs = heirs.groupBy("home").agg(F.count("*").alias("n"))
    parts = F.split("home", "/")
    ancestors = dirs.select("home", "n", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir")).distinct()
    nearest = ancestors.join(notices, "dir").groupBy("home").agg(F.max("n").alias("n"), F.max_by(F.struct("inherited", "inherited_score", "license_path"), F.length("dir")).alias("from"))
    nearest = materialize(nearest, "license-nearest")
    out = join_counted(heirs, nearest, ["home"])  # a folder may hold a third of all files
    out = out.unionByName(rows.filter("own is not null or path is null").withColumn("home", F.lit(None).cast("string")), allowMissingColumns=True)
    return out.select(
        "doc_id",
        "path",
        F.coalesce("own", "from.inherited").alias("license"),
        F.when(F.col("own").isNotNull(), F.col("score")).otherwise(F.coalesce("from.inherited_score", F.lit(0.0))).alias("cosine"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("from").isNotNull(), "inherited").otherwise("none").alias("origin"),
        "n_spans",
        "spans",
        F.when(F.col("own").isNull(), F.col("from.license_path")).alias("license_path"),
    )
