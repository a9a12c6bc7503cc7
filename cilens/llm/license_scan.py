"""License scan: a trained paragraph classifier names the family, a template comparison confirms it.

Paragraphs are lines. A softmax regression on hashed word unigrams and bigrams tells ordinary text, licences of no
known family, and the families apart. It learns from notices that are built from names and phrasings, from excerpts of
public licence texts, and from ordinary paragraphs, a bounded sample of the corpus itself. A quarter of the examples
is set aside to fit a temperature, so that the probability of a family can be held against a threshold; below it the
licence counts as unknown. A named family is confirmed if the paragraph shares enough of its word pairs with one of
the family's templates; without that it is reported as unknown too.

Fitting runs in one task on the bounded sample; scanning is one pass over all rows without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cilens.llm.common import LOWER, STEP_BYTES, arrow_schema, blocks, cut_lineage, map_rows, mix, runs, slice_hashes, steps, table, whole_text

#: Ordinary paragraphs that teach, on average.
SAMPLE_ROWS = 3000
BITS = 16
LEAST_PROBABILITY = 0.5
LEAST_SIMILARITY = 0.6
SCALE = 8.0
#: Names of each family as notices give them; fixed values.
NAMES = {
    "apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0", "Apache 2.0"),
    "mit": ("the MIT License", "the MIT license terms", "MIT", "the Expat License"),
    "gpl": ("the GNU General Public License, version 3", "the GNU General Public License, version 2", "the GNU GPL v3", "GPL-3.0-or-later", "GPL-2.0-only"),
    "lgpl": ("the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License, version 2.1", "the GNU LGPL", "LGPL-2.1-or-later"),
    "agpl": ("the GNU Affero General Public License, version 3", "the GNU AGPL v3", "AGPL-3.0-only"),
    "bsd": ("the BSD License", "the 3-Clause BSD License", "the 2-Clause BSD License", "the New BSD License", "BSD-3-Clause", "BSD-2-Clause"),
    "mpl-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"),
    "isc": ("the ISC License", "ISC"),
    "epl": ("the Eclipse Public License 2.0", "the Eclipse Public License v1.0", "EPL-2.0"),
    "cc0": ("CC0 1.0 Universal", "the Creative Commons CC0 1.0 Universal public domain dedication", "CC0-1.0"),
    "cc-by": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "CC-BY-4.0", "CC BY 3.0"),
    "cc-by-sa": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0", "CC BY-SA 3.0"),
    "cc-by-nc": ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0"),
    "unlicense": ("the Unlicense", "Unlicense"),
}
#: Excerpts of the public texts; fixed values.
TEXTS = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "agpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
}
FRAMES = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "Distributed under the terms of {}.", "This project is licensed under {}.",
          "SPDX-License-Identifier: {}", "License: {}", "Available under {}, see the file LICENSE for details.", "This file is part of the project and is covered by {}.",
          "Published under {}.", "The content of this page is available under {} unless noted otherwise.", "{}")
#: Licences of no known family, and ordinary sentences that share words with licences.
STRANGERS = ("the Acme Community License", "the Example Source Agreement 1.2", "the Public Data Terms", "a custom license", "the vendor's license agreement", "the Foo License, version 7",
             "the Research Use License", "our terms of use", "the Software Evaluation Agreement", "a commercial license", "the Institute License 3.1", "proprietary terms")
ORDINARY = ("He lost his driving licence on the way to the station.", "Permission to enter the garden was granted by the owner.", "The public library is open and free for all visitors.",
            "The film was released under a new title in version two.", "All copies of the book were sold in the first week.", "She works at an institute of technology near the river.",
            "The general said the public should remain calm.", "Any person may join, and the terms are simple.", "The work was published in 2004 and again in 2010.",
            "This file lists the rooms that are available under the roof.", "Software is sold without restriction in this shop.", "The attribution of the painting is disputed.")
CLASSES = ("none", "unknown", *NAMES)
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)


def templates(family: str) -> list[str]:
    return [*TEXTS.get(family, ()), *(frame.format(name) for name in NAMES[family] for frame in FRAMES)]


def examples() -> list[tuple[str, int]]:
    """(paragraph, class) built from the fixed values."""
    out = [(text, CLASSES.index(family)) for family in NAMES for text in templates(family)]
    out += [(frame.format(name), 1) for name in STRANGERS for frame in FRAMES]
    return out + [(text, 0) for text in ORDINARY]


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of a buffer."""
    start, end, kind = runs(data)
    word = kind <= 2
    start, end = start[word], end[word]
    return start, slice_hashes(LOWER[data], start, end)


def _buckets(h: np.ndarray, paragraph: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of the words, first words of pairs within a paragraph, buckets of the pairs)."""
    shift = np.uint64(64 - BITS)
    at = np.flatnonzero(paragraph[1:] == paragraph[:-1])
    return (mix(h) >> shift).astype(np.int64), at, (mix(h[at] * _SALT + h[at + 1]) >> shift).astype(np.int64)


def linear(data: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each paragraph that has words, its linear scores by class); the last row of weights is the bias."""
    start, h = _words(data)
    if not len(start):
        return np.empty(0, np.int64), np.empty((0, weights.shape[1]))
    lines = np.concatenate(([0], np.flatnonzero(data == 10) + 1))
    paragraph = np.searchsorted(lines, start, side="right") - 1
    one, at, two = _buckets(h, paragraph)
    value = weights[one]
    value[at] += weights[two]
    first = np.concatenate(([0], np.flatnonzero(paragraph[1:] != paragraph[:-1]) + 1))
    size = np.diff(np.concatenate((first, [len(h)])))
    return lines[paragraph[first]], SCALE * np.add.reduceat(value, first, axis=0) / size[:, None] + weights[-1]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, int]], passes: int = 15) -> np.ndarray:
    """Weights and bias, already divided by the temperature that suits the examples set aside."""
    rows = sorted(set(rows), key=lambda r: hashlib.sha256(r[0].encode("utf-8", "surrogatepass")).digest())
    size, n = (1 << BITS) + 1, len(CLASSES)
    made = []
    for text, label in rows:
        data = np.frombuffer(text.replace("\n", " ").encode("utf-8", "surrogatepass"), np.uint8)
        _, h = _words(data)
        if len(h):
            one, _, two = _buckets(h, np.zeros(len(h), np.int64))
            bucket, count = np.unique(np.concatenate((one, two)), return_counts=True)
            made.append((np.append(bucket, size - 1), np.append(SCALE * count / len(h), 1.0), label))
    aside = made[::4]
    # templates are few and all of them are needed, so the rows set aside tune the temperature on weights learned without them first

    def learn(taught):
        w, g2 = np.zeros((size, n), np.float32), np.full((size, n), 1e-6, np.float32)
        for _ in range(passes):
            for i, x, y in taught:
                g = _softmax((x @ w[i])[None])[0]
                g[y] -= 1
                g = x[:, None] * g + 1e-4 * w[i]
                g2[i] += g * g
                w[i] -= 0.5 * g / np.sqrt(g2[i])
        return w

    part = learn([m for k, m in enumerate(made) if k % 4])
    scores, labels = np.array([x @ part[i] for i, x, _ in aside]), np.array([y for _, _, y in aside])
    loss = {t: -np.log(_softmax(scores / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)} if len(aside) else {1.0: 0.0}
    return learn(made) / np.float32(min(loss, key=loss.get))


def _pairs(text: str) -> set[tuple[bytes, bytes]]:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    start, end, kind = runs(data)
    words = [LOWER[data[s:e]].tobytes() for s, e, k in zip(start, end, kind) if k <= 2]
    return set(zip([b"", *words], [*words, b""]))


_TEMPLATE_PAIRS: dict[str, list[set]] = {}


def similarity(text: str, family: str) -> float:
    """Largest share of word pairs that a paragraph and a template of the family have in common, of the smaller one's."""
    if family not in _TEMPLATE_PAIRS:
        _TEMPLATE_PAIRS[family] = [_pairs(t) for t in templates(family)]
    own = _pairs(text)
    return max((len(own & t) / max(2, min(len(own), len(t))) for t in _TEMPLATE_PAIRS[family]), default=0.0)


def train(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights from the fixed examples and about ``rows`` distinct ordinary paragraphs of about as many documents.

    Paragraphs that already look like a template teach nothing; an empty table teaches by the fixed examples alone.
    """
    def drawn(df: DataFrame, column: str) -> DataFrame:
        share = min(1.0, rows / max(1, df.count()))
        return df.where(F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates([column])

    some = drawn(docs.select(whole_text(docs, text).alias("t")), "t")
    lines = drawn(cut_lineage(some.select(F.explode(F.split("t", "\n")).alias("line"))), "line")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [t for batch in batches for t in batch.column(0).to_pylist() if t and t.strip()]
        plain = [t for t in found if max(similarity(t, family) for family in NAMES) < 0.3]
        yield pa.RecordBatch.from_arrays([pa.array([fit([*examples(), *((t, 0) for t in plain)]).tobytes()], pa.binary())], names=["w"])

    done = lines.repartition(1).mapInArrow(learn, "w binary").first()  # no row where Spark knows that there are no lines
    return np.frombuffer(done["w"], np.float32).reshape(-1, len(CLASSES)) if done else fit(examples())


def _long(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, part) of a text cut at line ends where it is too long for one step."""
    at = 0
    for part in blocks(text):
        yield at, part
        at += len(part)


def found_in(texts: list[str], weights: np.ndarray) -> list[tuple]:
    """(row, paragraph, start, end, predicted, probability, similarity, family) of the licence paragraphs of some texts."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    out = []
    for a, b in steps(map(len, raw), STEP_BYTES // 4):
        buffers = [(a, 0, part, at) for at, part in _long(raw[a])] if b == a + 1 and len(raw[a]) > STEP_BYTES else [(a, b, b"\n".join(raw[a:b]), 0)]
        for first, last, data, offset in buffers:
            start, scores = linear(np.frombuffer(data, np.uint8), weights)
            p = _softmax(scores)
            for k in np.flatnonzero(p[:, 0] < 0.5).tolist():
                if last:
                    ends = np.cumsum([len(t) + 1 for t in raw[first:last]])
                    row = first + int(np.searchsorted(ends, start[k], side="right"))
                    at = int(start[k]) - (int(ends[row - first - 1]) if row > first else 0)
                else:
                    row, at = first, offset + int(start[k])
                end = raw[row].find(b"\n", at)
                line = raw[row][at:end if end >= 0 else len(raw[row])].decode("utf-8", "surrogatepass")
                best = 2 + int(p[k, 2:].argmax())
                sure = float(p[k, best])
                like = similarity(line, CLASSES[best])
                if max(sure, p[k, 1]) < LEAST_PROBABILITY and like < LEAST_SIMILARITY:
                    continue  # no class is likely and no template is near: too little text to tell
                family = CLASSES[best] if sure >= LEAST_PROBABILITY and like >= LEAST_SIMILARITY else "unknown"
                place = len(raw[row][:at].decode("utf-8", "surrogatepass"))
                out.append((row, raw[row].count(b"\n", 0, at), place, place + len(line), CLASSES[best], sure, like, family))
    return out


_SCHEMA = "doc_id bigint, paragraph bigint, start bigint, end bigint, predicted string, probability double, similarity double, family string"


def scan(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """A row per licence paragraph, one that is likelier than not no ordinary text: its number and place in code points, the best family with its calibrated
    probability and template similarity, and the family reported, ``unknown`` unless both reach their thresholds.

    Null and empty texts hold none. Rows are scanned one by one: repeated rows and null ids are kept, an empty table
    gives no rows, other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    names = tuple(f.name for f in arrow_schema(_SCHEMA))

    def work(cols):
        ids = cols["doc_id"].to_pylist()
        hits = found_in(cols["t"].to_pylist(), sent.value)
        return dict(zip(names, zip(*[(ids[h[0]], *h[1:]) for h in hits]))) if hits else None

    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text(docs, text).alias("t")), work, _SCHEMA)


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return scan(docs, train(docs))
