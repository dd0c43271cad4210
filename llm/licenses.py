"""License scans: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory.

Every text is scored whole, across line ends. A notice of m words, a header or a full licence text, is compared with all
windows of m and of half as many words of a text, as vectors of term counts times inverse document frequencies; so are the
sentences of the notices that belong to one licence only. A window can only reach the threshold if it holds one of the
notice's strong terms (without them the rest of its vector is too short), so only windows around these are looked at; the
result is that of looking at all.

Document frequencies of the terms of all templates are counted over the whole corpus, so the table that tasks get is as
large as the templates. Words that no template has share one weight, the root of the mean square of the templates' terms.
A file that is a licence file by its name, or of which at least half is a notice, gives its directory the licence; files
without a notice of their own inherit from the nearest directory above that has one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from llm.cluster import join_hot, saved, ship
from llm.text import Words, pieces, words

#: Notices and licence texts by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Released under CC0 1.0 Universal"),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Proprietary": ("All rights reserved", "No license is granted"),
}
#: What only reserves rights; a licence granted anywhere in the same text goes before it.
RESERVED = "Proprietary"
FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)[^/]*$"
#: Cosine from which a window is a notice; words from which half of a notice is looked for too; fewest words of a window.
COSINE, LONG, LEAST = 0.6, 12, 3


def terms(text: str) -> list[str]:
    """Lower-case runs of letters, digits and characters beyond ASCII."""
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def notices_of(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, tuple[str, ...]]]:
    """License and words of each notice, and of each sentence of five words or more that notices of one license only have."""
    whole = [(k, tuple(terms(v))) for k, vs in templates.items() for v in vs]
    parts: dict[tuple[str, ...], set[str]] = {}
    for k, vs in templates.items():
        for v in vs:
            for s in re.split(r"[.:;]\s", v):
                if len(t := tuple(terms(s))) >= 5:
                    parts.setdefault(t, set()).add(k)
    of_one = [(min(ks), t) for t, ks in parts.items() if len(ks) == 1]
    return sorted({*whole, *of_one})


def _hashed(ts: list[str]) -> np.ndarray:
    """Hashes of words, as texts have them."""
    return words(pa.array([" ".join(ts)], pa.large_string()), "plain", lower=True).hashes()


class Vocabulary:
    """The terms of all templates, by hash."""

    def __init__(self, templates: dict[str, tuple[str, ...]]):
        self.terms = sorted({t for _, ts in notices_of(templates) for t in ts})
        h = _hashed(self.terms)
        self.order = np.argsort(h)
        self.hashes = h[self.order]

    def ids(self, h: np.ndarray) -> np.ndarray:
        """The number of each word's term; of other words, the number of terms."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], len(self.terms))


def frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, dict[str, int]]:
    """The number of documents, and of those with each term of the templates, over all texts."""
    k = len(vocabulary.terms)

    def count(batches):
        total, rows = np.zeros(k + 1, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for i, j in pieces(batch.column(0)):
                w = words(batch.column(0).slice(i, j - i), "plain", lower=True)
                t = vocabulary.ids(w.hashes())
                known = t < k
                total += np.bincount(np.unique(w.text_of()[known] * (k + 1) + t[known]) % (k + 1), minlength=k + 1)
        total[k] = rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1)), pa.array(total)], ["term", "n"])

    got = {r.term: r.n for r in docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return got.pop(k, 0), {t: got.get(i, 0) for i, t in enumerate(vocabulary.terms)}


class Judge:
    """Cosines of windows of texts with notices."""

    def __init__(self, templates: dict[str, tuple[str, ...]], total: int, df: dict[str, int]):
        self.vocabulary = Vocabulary(templates)
        idf = np.array([np.log((1 + total) / (1 + df.get(t, 0))) + 1 for t in self.vocabulary.terms])
        #: by term; last, of all other words
        self.weight = np.append(idf, np.sqrt((idf**2).mean()))
        number = {t: i for i, t in enumerate(self.vocabulary.terms)}
        self.notices = []
        for name, ts in notices_of(templates):
            vector = np.zeros(len(self.weight))
            np.add.at(vector, [number[t] for t in ts], 1.0)
            vector *= self.weight
            norm = float(np.sqrt((vector**2).sum()))
            # the largest entries, until what is left is too short for the threshold
            by_size = np.argsort(-vector, kind="stable")
            left = norm**2 - np.cumsum(vector[by_size] ** 2)
            strong = np.zeros(len(vector), bool)
            strong[by_size[: int(np.argmax(left < (COSINE * norm) ** 2 * (1 - 1e-9))) + 1]] = True
            m = len(ts)
            self.notices.append((name, vector * self.weight, norm, strong, [m, (m + 1) // 2] if m >= LONG else [m], max(LEAST, (m + 1) // 2)))
        self.strong = np.any([n[3] for n in self.notices], axis=0)

    def windows(self, w: Words) -> list[tuple[int, float, str, int, int]]:
        """text, cosine, license, start and stop (in words of all texts) of the best window of each notice in each text, where
        it reaches COSINE; the first of equals."""
        h = w.hashes()
        t = self.vocabulary.ids(h)
        some = np.flatnonzero(self.strong[t])
        if not len(some):
            return []
        text, out = w.text_of(), []
        squares = np.concatenate(([0.0], np.cumsum(self.weight[t] ** 2)))
        for name, coefficient, norm, strong, sizes, least in self.notices:
            at = some[strong[t[some]]]
            if not len(at):
                continue
            run = np.concatenate(([0.0], np.cumsum(coefficient[t])))
            best: dict[int, tuple[float, int, int]] = {}
            for size in sizes:
                near = np.zeros(len(t) + 1, np.int64)
                np.add.at(near, np.maximum(at - size + 1, 0), 1)
                np.add.at(near, at + 1, -1)
                start = np.flatnonzero(np.cumsum(near)[:-1])
                stop = np.minimum(start + size, w.first[text[start] + 1])
                dot, square = run[stop] - run[start], squares[stop] - squares[start]
                # counts of a term weigh by their square, so the window is at least as long as this and the cosine at most this
                ok = (stop - start >= least) & (dot >= COSINE * (1 - 1e-9) * norm * np.sqrt(square))
                for lo in range(0, int(ok.sum()), 4096):
                    a, b, d = start[ok][lo : lo + 4096], stop[ok][lo : lo + 4096], dot[ok][lo : lo + 4096]
                    cosine = d / (norm * self._lengths(h, t, a, b))
                    for c, x, y in zip(np.round(cosine, 9).tolist(), a.tolist(), b.tolist(), strict=True):
                        if c >= COSINE and c > best.get(int(text[x]), (0.0,))[0]:
                            best[int(text[x])] = (c, x, y)
            out += [(d, c, name, x, y) for d, (c, x, y) in best.items()]
        return out

    def _lengths(self, h: np.ndarray, t: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of the vectors of windows."""
        size = int((stop - start).max())
        at = start[:, None] + np.arange(size)
        inside = at < stop[:, None]
        at = np.minimum(at, len(h) - 1)
        keys, squares = h[at], np.where(inside, self.weight[t[at]] ** 2, 0.0)
        keys = np.where(inside, keys, np.arange(size, dtype=np.uint64)[None, :])
        order = np.argsort(keys, axis=1, kind="stable")
        keys, squares = np.take_along_axis(keys, order, 1), np.take_along_axis(squares, order, 1)
        new = np.ones(keys.shape, bool)
        new[:, 1:] = keys[:, 1:] != keys[:, :-1]
        since = np.arange(size) - np.maximum.accumulate(np.where(new, np.arange(size), 0), axis=1)
        return np.sqrt((squares * (2 * since + 1)).sum(axis=1))  # 1, 4, 9.. are sums of odd numbers

    def judged(self, texts: pa.Array) -> list[tuple[str | None, float, float]]:
        """License and cosine of the best notice of each text, and which share of its words is in the best windows."""
        w = words(texts, "plain", lower=True)
        found: dict[int, list[tuple[float, str, int, int]]] = {}
        for d, *rest in self.windows(w):
            found.setdefault(d, []).append(tuple(rest))
        out: list[tuple[str | None, float, float]] = [(None, 0.0, 0.0)] * len(texts)
        for d, own in found.items():
            cosine, name = max(((c, k) for c, k, _, _ in own), key=lambda x: (x[1] != RESERVED, x))
            first, stop = int(w.first[d]), int(w.first[d + 1])
            covered = np.zeros(stop - first, bool)
            for _, _, a, b in own:
                covered[a - first : b - first] = True
            out[d] = (name, cosine, float(covered.mean()))
        return out


_OWN = "id long, path string, license string, cosine double, share double"


def notices(docs: DataFrame, judge: Judge) -> DataFrame:
    """id, path, license and cosine of the best notice of each document, and which share of its words are in notices."""

    def scan(batches):
        for batch in batches:
            for i, j in pieces(batch.column(2)):
                part = batch.slice(i, j - i)
                cols = zip(*judge.judged(part.column(2)), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.float64()), strict=True)]], [x.split()[0] for x in _OWN.split(", ")])

    return docs.select("id", "path", "text").mapInArrow(scan, _OWN)


def scan_licenses(docs: DataFrame, path: Column, *, text: str = "text", doc_id: str = "doc_id", templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """One row for each document: doc_id, path, license (of its own notice), cosine (0 without one), inherited (the licence
    of the nearest directory at or above its own that has one, where it has none itself), inherited_from.

    Where several licence files of a directory differ, the one with the best cosine counts, ties by name. Null and empty
    texts have no notice; a null path is in no directory and inherits nothing; null ids and repeated rows are documents of
    their own. Other columns are left aside. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), path.cast("string").alias("path"), F.col(f"`{text}`").alias("text"))
    total, df = frequencies(own, Vocabulary(templates))
    found = notices(own, Judge(templates, total, df))
    found = saved(found.withColumn("dir", F.regexp_extract(F.coalesce("path", F.lit("")), r"^(.*)/[^/]*$", 1)).withColumn("known", F.col("path").isNotNull()), "notices")
    given = found.where(F.col("known") & F.col("license").isNotNull() & (F.col("path").rlike(FILE) | (F.col("share") >= 0.5)))
    given = given.groupBy("dir").agg(F.max(F.struct("cosine", "license")).alias("best")).select(F.col("dir").alias("above"), F.col("best.license").alias("inherited"))
    # directories are resolved first, each once; documents then join their own directory
    dirs = saved(found.where("known").groupBy("dir").agg(F.count(F.lit(1)).alias("files")), "dirs")
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("above")))).alias("a")).select("dir", "a.depth", "a.above")
    nearest = up.join(given, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "inherited")).alias("n")).select("dir", F.col("n.above").alias("inherited_from"), F.col("n.inherited").alias("inherited"))
    resolved = dirs.join(nearest, "dir", "left")
    cols = [F.col("id").alias("doc_id"), "path", "license", "cosine", *(F.when(F.col("license").isNull(), F.col(c)).alias(c) for c in ("inherited", "inherited_from"))]
    inside = join_hot(found.where("known"), resolved, "dir", "files", max(1, total)).select(cols)
    lost = found.where("not known").select(F.col("id").alias("doc_id"), "path", "license", "cosine", F.lit(None).cast("string").alias("inherited"), F.lit(None).cast("string").alias("inherited_from"))
    return inside.unionByName(lost)
