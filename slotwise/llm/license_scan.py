"""License scans: a trained paragraph classifier, then a comparison with templates. DataFrame functions only on the main path.

Training (numpy, on the driver, from the fixed texts below alone) gives sparse weights of word 1- and 2-grams for each family, for ``unknown`` (a licence
of no known family) and for ordinary text, and the probability from which a family is believed. It reads no document, so the model is the same for every table.

The scan is one Spark plan without a join: texts that hold a cue of a licence are cut into lines; lines that hold a cue, or consist of words of the
licences, are put together to paragraphs; each paragraph's n-grams are looked up in a literal table of weights, inside the row.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Parts of words, in any case, of which every licence paragraph holds one.
CUES = ["licen", "copyright", "copyleft", "redistribut", "permission", "permitted", "spdx", "rights reserved", "public domain", "creative commons", "warrant", "liab", "cc0"]
#: Share of a line's words that the fixed texts have, from which it may continue a paragraph without a cue of its own.
CONTINUES = 0.8
_BUCKETS = 256

#: Sentences of licences and of the ways to name them, by family.
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD license.",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Available under the Creative Commons Attribution license.", "Licensed under CC BY 3.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Available under the Creative Commons BY-NC license.", "Licensed under CC BY-NC 3.0."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "Licensed under CC BY-SA 3.0."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "GNU General Public License Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL license version 2.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/ under the Mozilla Public License.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Copyright 2020 the authors. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher.", "This document is confidential and may not be copied or disclosed without written permission of the copyright owner."],
    "public-domain": ["This work is in the public domain.", "This is free and unencumbered software released into the public domain.", "Released under CC0 1.0 Universal.", "The author has dedicated the work to the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software in the public domain.", "SPDX-License-Identifier: CC0-1.0"],
}
#: Sentences of licences of other families, which are told from text and from the families above, not from each other.
OTHER = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Boost Software License - Version 1.0 - August 17th, 2003",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.",
    "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission, subsequent versions of the EUPL.",
    "Licensed under the European Union Public Licence.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    "Licensed under the Eclipse Public License 2.0.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License.",
    "This package is free software and may be redistributed under the terms of the Artistic License.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "Licensed under the SIL Open Font License, Version 1.1.",
    "Made available under the Open Database License.",
    "Licensed under the ISC license.", "Released under the zlib license.", "SPDX-License-Identifier: Zlib", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
]
#: Sentences with words of licences that grant nothing.
ORDINARY = [
    "The general said the public would see the new version of the work this year.", "He got his driving license in May.", "All people have rights.", "They reserved a table for all of us.", "Permission to land was granted to the aircraft.",
    "The software is used by the public and by authors in many forms.", "The conditions of the road were not met with any charge.", "The apache helicopter was released in 1986.", "MIT is a university in Cambridge.", "This project is under way.",
    "Copyright law is a subject of the second chapter.", "The commons is free for any person.", "The terms of the sale are in the file.", "The free press published a copy of the source.", "This work is the third version.", "The following is under review.",
    "She asked for permission to leave the room.", "The pub lost its licence to sell spirits after ten.", "A fishing licence costs twenty pounds a year.", "The warranty on the washing machine ran out.", "The company is liable to pay tax in two countries.",
    "The police had a warrant to search the house.", "Musicians argue about copyright and streaming.", "The minister promised reliable trains and new permissions for farms.", "The plan would redistribute land to small farmers.", "It is most liable to break in winter.", "The court asked whether copyright covers a photograph.",
    "No smoking is permitted in the building.", "Dogs are permitted on the beach after six.", "Our licensed guides speak four languages.", "The bar is licensed until midnight.", "Permission slips must be signed by a parent.",
]


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2) for i in range(len(words) - n + 1)}


class LicenseModel:
    """Classes (families, unknown, ordinary), weights (n-grams x classes), intercepts, weight of the share of strange words, and the least probability of a believed family."""

    def __init__(self, templates: dict[str, list[str]] | None = None, rounds: int = 120, seed: int = 1) -> None:
        self.templates = TEMPLATES if templates is None else templates
        self.families = sorted(self.templates)
        rng = np.random.default_rng(seed)
        n = len(self.families)
        texts = [(words_of(t), c) for c, f in enumerate(self.families) for t in self.templates[f]] + [(words_of(t), n) for t in OTHER]
        self.words = sorted({w for words, _ in texts for w in words})
        vocabulary = sorted({g for words, _ in [*texts, *((words_of(t), n + 1) for t in ORDINARY)] for g in grams_of(words)})
        self.place = {g: i for i, g in enumerate(vocabulary)}
        rows, labels = [], []
        for words, c in texts:
            rows += [words, words]
            labels += [c, c]
            for _ in range(5):  # copies that lost an end or some words, or stand among others
                a = int(rng.integers(0, len(words) // 4 + 1))
                kept = [w for w in words[a : len(words) - int(rng.integers(0, len(words) // 4 + 1))] if rng.random() > 0.1]
                rows.append(["x"] * int(rng.integers(0, 4)) + kept)
                labels.append(c)
        for t in ORDINARY:
            for _ in range(8):
                rows.append(["x"] * int(rng.integers(0, 12)) + words_of(t))
                labels.append(n + 1)
        for _ in range(300):  # stray words of licences, mostly among strange ones, are no licence
            rows.append(["x"] * int(rng.integers(0, 12)) + list(rng.choice(self.words, rng.integers(1, 5), replace=False)))
            labels.append(n + 1)
        y = np.array(labels)
        x = np.zeros((len(rows), len(vocabulary) + 1), np.float32)
        for i, words in enumerate(rows):
            x[i, [self.place[g] for g in grams_of(words) if g in self.place]] = 1
            x[i, -1] = self.strange(words)
        self.cut = self._calibrate(x, y, n, rounds, rng)
        weights, self.bias = self._fit(x, y, n + 2, rounds)
        self.weights, self.strange_weight = weights[:-1], weights[-1]

    def _calibrate(self, x: np.ndarray, y: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> float:
        """The least probability, from one half, at which 95 % of believed families are right.

        Judged are rows of families that the model never saw as such (each family, or group that shares a name up to its first hyphen, is left out once, and
        no family is right for its rows), and rows of known families held out of the same fits.
        """
        groups: dict[str, list[int]] = {}
        for c, f in enumerate(self.families):
            groups.setdefault(f.split("-")[0], []).append(c)
        sure, right = [], []
        for own in groups.values():
            gone = np.isin(y, own)
            held = gone | ((rng.random(len(y)) < 0.2) & (y < n))
            w, b = self._fit(x[~held], y[~held], n + 2, rounds // 2)
            p = self._softmax(x[held] @ w + b)
            licence = p[:, n + 1] < 0.5
            sure.append(p[licence, :n].max(axis=1))
            right.append((p[:, :n].argmax(axis=1) == np.where(gone, -1, y)[held])[licence])
        every, good = np.concatenate(sure), np.concatenate(right)
        cuts = [t for t in np.linspace(0.5, 0.95, 10) if (every >= t).any() and good[every >= t].mean() >= 0.95]
        return round(float(cuts[0] if cuts else 0.95), 2)

    def strange(self, words: list[str]) -> float:
        return sum(w not in self.words for w in words) / max(1, len(words))

    @staticmethod
    def _softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _fit(self, x: np.ndarray, y: np.ndarray, n: int, rounds: int, l1: float = 3e-4, rate: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
        """Proximal gradient descent with momentum; an L1 penalty keeps the weights sparse. Classes weigh alike."""
        w, b, target = np.zeros((x.shape[1], n), np.float32), np.zeros(n, np.float32), np.eye(n, dtype=np.float32)[y]
        each = (1 / np.maximum(np.bincount(y, minlength=n), 1))[y].astype(np.float32)
        each /= each.sum()
        last_w, last_b = w, b
        for k in range(rounds):
            push = k / (k + 3)
            at_w, at_b = w + push * (w - last_w), b + push * (b - last_b)
            d = (self._softmax(x @ at_w + at_b) - target) * each[:, None]
            last_w, last_b = w, b
            w = at_w - rate * (x.T @ d)
            w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
            b = at_b - rate * d.sum(axis=0)
        return w, b


@lru_cache(maxsize=1)
def default_model() -> LicenseModel:
    return LicenseModel()


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _grams(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.concat(words, F.array_compact(pairs)))


def _cued(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(CUES))


def _paragraphs(lines: Column, vocabulary: list[str]) -> Column:
    """(paragraph, line number, cued) of the lines that may belong to one: with a cue, or made of licence words."""

    def mark(line: Column, i: Column) -> Column:
        words = _words(line)
        known = F.size(F.filter(words, lambda w: w.isin(vocabulary)))
        return F.struct(i.alias("at"), line.alias("line"), _cued(line).alias("cued"), ((F.size(words) > 0) & (known >= CONTINUES * F.size(words))).alias("plain"))

    return F.filter(F.transform(lines, mark), lambda m: m["cued"] | m["plain"])


def licence_paragraphs(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str]) -> DataFrame:
    """(doc_id, paragraph, text): the runs of lines of a text that follow one another, have a cue or words of licences only, and hold a cue.

    A line that ends with a full stop, exclamation or question mark ends its run; so does a blank line. ``paragraph`` is the number of the first line, from 0.
    """
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(_cued(F.col("text")))
    marked = held.select("doc_id", _paragraphs(F.split("text", "\n", -1), vocabulary).alias("m"))  # no cue has a line break, so there is one at least
    before = lambda k: F.get("m", k - 1)
    starts = F.filter(F.sequence(F.lit(0), F.size("m") - 1), lambda k: (k == 0) | (F.get("m", k)["at"] != before(k)["at"] + 1) | before(k)["line"].rlike(r"[.!?]\s*$"))
    cut = marked.select("doc_id", "m", starts.alias("s"))
    ends = F.concat(F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))), F.array(F.size("m")))
    runs = cut.select("doc_id", "m", F.explode(F.arrays_zip(F.col("s").alias("a"), ends.alias("b"))).alias("r")).select("doc_id", F.slice("m", F.col("r.a") + 1, F.col("r.b") - F.col("r.a")).alias("m"))
    return runs.filter(F.exists("m", lambda m: m["cued"])).select("doc_id", F.col("m")[0]["at"].alias("paragraph"), F.array_join(F.transform("m", lambda m: m["line"]), "\n").alias("text"))


def _literal(value: object, kind: str) -> Column:
    """A constant that Spark parses once, when it plans."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: LicenseModel | None = None, least_shared: float = 0.5) -> DataFrame:
    """One row for each licence paragraph (see ``licence_paragraphs``): doc_id, paragraph, family, probability, similarity, confirmed.

    ``family`` is ``unknown`` where the text is a licence (ordinary text has a probability under one half) but no family reaches the calibrated probability.
    ``probability`` is that of the family, or of a licence at all for ``unknown``. ``similarity`` is the largest share of a template's n-grams, of that family, that the paragraph
    holds; ``confirmed`` from ``least_shared`` on (never for ``unknown``). Ordinary paragraphs give no row; nor do null or empty texts. Repeated rows of a
    document repeat its paragraphs. Other columns are ignored. A long line of other text that ends in a licence sentence counts as other text.
    Texts are read whole, however long, paragraph by paragraph; an empty table gives an empty one.
    """
    model = model or default_model()
    n = len(model.families)
    table: list[dict[str, list[float]]] = [{} for _ in range(_BUCKETS)]
    for g, i in model.place.items():
        if np.any(model.weights[i]):
            table[zlib.crc32(g.encode()) % _BUCKETS][g] = [float(v) for v in model.weights[i]]
    weights = _literal(table, "array<map<string,array<double>>>")
    texts = _literal([[sorted(grams_of(words_of(t))) for t in model.templates[f]] for f in model.families], "array<array<array<string>>>")
    units = licence_paragraphs(docs, id_col, text_col, model.words).withColumn("words", _words(F.col("text")))
    strange = F.size(F.filter("words", lambda w: ~w.isin(model.words))) / F.size("words")
    held = units.select("doc_id", "paragraph", strange.alias("strange"), _grams(F.col("words")).alias("grams"))

    def add(sums: Column, gram: Column) -> Column:
        own = F.try_element_at(F.get(weights, (F.crc32(gram.cast("binary")) % _BUCKETS).cast("int")), gram)
        return F.coalesce(F.zip_with(sums, own, lambda a, b: a + b), sums)

    def judge(sums: Column) -> Column:
        odds = F.transform(sums, lambda v: F.exp(v - F.array_max(sums)))
        every = F.aggregate(odds, F.lit(0.0), lambda a, v: a + v)
        best = F.array_max(F.slice(odds, 1, n))
        return F.struct((1 - F.element_at(odds, -1) / every).alias("licence"), (best / every).alias("best"), F.array_position(odds, best).cast("int").alias("at"))

    start = F.array(*[F.lit(float(model.bias[c])) + F.col("strange") * float(model.strange_weight[c]) for c in range(n + 2)])
    # exploded, so that Spark doesn't score once more for each filter and column that follows
    scored = held.select("doc_id", "paragraph", "grams", F.explode(F.array(F.aggregate("grams", start, add, judge))).alias("v"))
    sure = scored.select("doc_id", "paragraph", "grams", "v.*").filter("licence > 0.5")
    named = sure.withColumn("believed", F.col("best") >= model.cut)
    share = F.array_max(F.transform(F.get(texts, F.col("at") - 1), lambda t: F.size(F.array_intersect(t, F.col("grams"))) / F.size(t)))
    out = named.withColumn("similarity", F.when(F.col("believed"), share).otherwise(0.0))
    family = F.when(F.col("believed"), F.element_at(F.array(*[F.lit(f) for f in model.families]), F.col("at"))).otherwise(UNKNOWN)
    return out.select("doc_id", "paragraph", family.alias("family"), F.when(F.col("believed"), F.col("best")).otherwise(F.col("licence")).alias("probability"), "similarity", (F.col("similarity") >= least_shared).alias("confirmed"))
