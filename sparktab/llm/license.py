"""Licence scans: TF-IDF cosine of stretches of text to licence templates, then inheritance along directories.

Templates are notices, header blocks and short licence texts. A stretch is as many words of a file
as the template has, wherever it begins and however its lines are wrapped. Document frequencies are
those of all files, but none counts as less than one in RARE, so the table of the words that are more
frequent is bounded and can be broadcast. By sliding sums a stretch is left out if even the least
norm that its words can have keeps it below the threshold; the others are scored in full. A file
without a licence of its own gets that of the nearest directory above it that has a licence file,
by joining the distinct directories and their ancestors on the path.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import ALNUM, HashTable, Words, few, materialize, slices, without_clashes

THRESHOLD = 0.7
#: A word that fewer than one in so many files has counts as one that one in so many has.
RARE = 1_000
#: A file of whose words so great a part is one licence template is a licence file, whatever its name.
COVERAGE = 0.5
_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} General Public License for more details."
# fixed values: notices, header blocks and short texts of licences, by SPDX name
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "SPDX-License-Identifier: GPL-2.0-only", _FREE.format("", 2, "")],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0-only", _FREE.format("", 3, "")],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: LGPL-3.0-only", _FREE.format("Lesser", 3, "Lesser")],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "SPDX-License-Identifier: AGPL-3.0-only", _FREE.format("Affero", 3, "Affero")],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", f"{_CONDITIONS} {_DISCLAIMER}"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", f"{_CONDITIONS} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_DISCLAIMER}"],
    "ISC": [
        "Licensed under the ISC License.", "SPDX-License-Identifier: ISC",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ],
    "MPL-2.0": ["SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "CC0-1.0": ["Licensed under CC0 1.0.", "Creative Commons CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International", "SPDX-License-Identifier: CC-BY-NC-4.0"],
}
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([-_.].*)?$"


class TemplateSet:
    """Template vectors, and the weights of all words: those more frequent than one in RARE files by hash, one for the others."""

    def __init__(self, templates: dict[str, list[str]], files: int, frequent: np.ndarray, frequency: np.ndarray):
        self.names = [name for name, texts in sorted(templates.items()) for _ in texts]
        self.floor = max(files // RARE, 0)
        self.rare = float(np.log((1.0 + files) / (1.0 + self.floor)) + 1.0)
        self.table = HashTable(len(frequent))
        self.table.put(frequent, np.arange(len(frequent)))
        self.weights = np.append(np.log((1.0 + files) / (1.0 + frequency)) + 1.0, self.rare)
        words = Words(pa.array([t for _, texts in sorted(templates.items()) for t in texts], pa.large_string()), ALNUM)
        hashes = words.hashes()
        self.vocabulary = np.unique(hashes)
        idf = self.idf(self.vocabulary)
        ids = np.searchsorted(self.vocabulary, hashes)
        self.sizes = words.counts
        self.vectors = np.zeros((len(self.names), len(self.vocabulary) + 1))  # the last column is any other word
        for k, (a, b) in enumerate(zip(words.ptr[:-1], words.ptr[1:], strict=True)):
            v = np.bincount(ids[a:b], minlength=len(self.vocabulary)) * idf
            self.vectors[k, :-1] = v / np.sqrt((v * v).sum())

    def idf(self, hashes: np.ndarray) -> np.ndarray:
        return self.weights[self.table.get(hashes)]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary))


def word_frequencies(files: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Files, and the words that more than one in RARE of them has, with how many have them.

    That are at most RARE times as many words as a file has different ones on average.
    """

    def task(batches):
        held, size = [], 0

        def merged():
            keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(counts[order], first)

        for part in slices(batches, "text"):
            words = Words(part.column(0), ALNUM)
            hashes = words.hashes()
            if not len(hashes):
                continue
            order = np.lexsort((words.owner(), hashes))
            pairs = np.stack([hashes[order], words.owner()[order].astype(np.uint64)])
            new = np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)])
            keys = pairs[0][new]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            held.append((keys[first], np.diff(np.append(first, len(keys)))))
            size += len(first)
            if size > 1 << 21:
                held, size = [merged()], 0
        if held:
            keys, counts = merged()
            for at in range(0, len(keys), 1 << 18):
                yield pa.record_batch([pa.array(keys[at : at + (1 << 18)].view(np.int64)), pa.array(counts[at : at + (1 << 18)])], names=["word", "n"])

    files_n = files.count()
    counted = files.select("text").mapInArrow(task, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") > files_n // RARE).toArrow()
    return files_n, found.column("word").to_numpy().view(np.uint64), found.column("n").to_numpy()


def _exact(ids: np.ndarray, hashes: np.ndarray, idf: np.ndarray, template: np.ndarray) -> float:
    """Cosine of a stretch of words to a template."""
    _, first, counts = np.unique(hashes, return_index=True, return_counts=True)
    v = counts * idf[first]
    return float((v * template[ids[first]]).sum() / np.sqrt((v * v).sum()))


def best_licences(column: pa.Array, known: TemplateSet, threshold: float) -> list[tuple | None]:
    """(-cosine, name, first word, words, line) of the best stretch of each text, None if none reaches the threshold."""
    words = Words(column, ALNUM)
    hashes, best = words.hashes(), [None] * len(words.counts)
    ids = known.ids(hashes)
    other = len(known.vocabulary)
    # only stretches with template words can score
    idf = known.idf(hashes)
    squares = np.concatenate([[0.0], np.cumsum(idf * idf)])
    owner = words.owner()
    ends = words.ptr[1:][owner]
    place = np.arange(len(hashes))
    found: list[tuple[float, int, int, int]] = []
    touched = ids < other
    for k, (template, size) in enumerate(zip(known.vectors, known.sizes, strict=True)):
        if not (template[ids[touched]] > 0).any():
            continue
        dots = np.concatenate([[0.0], np.cumsum(template[ids] * idf)])
        stop = np.minimum(place + size, ends)
        # a stretch that is cut by the end of its text counts only if it is the whole text
        whole = (place + size <= ends) | (place == words.ptr[:-1][owner])
        dot = dots[stop] - dots[:-1]
        # the norm is least if every word stands once
        bound = dot / np.sqrt(np.maximum(squares[stop] - squares[:-1], 1e-12))
        at = np.flatnonzero(whole & (bound >= threshold - 1e-9))
        found += zip((-bound[at]).tolist(), [k] * len(at), at.tolist(), (stop[at] - at).tolist(), strict=True)
    for bound, k, at, size in sorted(found):
        row = int(owner[at])
        if best[row] is not None and -bound < -best[row][0] - 1e-9:
            continue
        cosine = _exact(ids[at : at + size], hashes[at : at + size], idf[at : at + size], known.vectors[k])
        if cosine >= threshold:
            line = int((words.data[words.off[row] : words.starts[at]] == 10).sum()) + 1
            one = (-round(cosine, 9), known.names[k], int(at - words.ptr[row]), size, line)
            best[row] = one if best[row] is None else min(best[row], one)
    return [None if b is None else (*b, int(words.counts[i])) for i, b in enumerate(best)]


def own_licences(files: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """files (with a column text) plus own_license, cosine, line_no (from 1) and coverage of the best stretch, null if none reaches the threshold.

    Columns of those names are replaced. coverage is the stretch's part of the file's words. Ties go to the
    template that sorts first, then the first word.
    """
    files = files.drop("own_license", "cosine", "line_no", "coverage")
    known = TemplateSet(templates or TEMPLATES, *word_frequencies(files))
    shared = files.sparkSession.sparkContext.broadcast(known)
    at = files.columns.index("text")
    names = files.columns

    def task(batches):
        known = shared.value
        for part in slices(batches, "text"):
            out = best_licences(part.column(at), known, threshold)
            cells = [pa.array([b and f(b) for b in out], t) for f, t in ((lambda b: b[1], pa.string()), (lambda b: -b[0], pa.float64()), (lambda b: b[4], pa.int64()), (lambda b: b[3] / b[5], pa.float64()))]
            yield pa.record_batch([*part.columns, *cells], names=[*names, "own_license", "cosine", "line_no", "coverage"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(task, f"{fields}, own_license string, cosine double, line_no long, coverage double")


def inherit(files: DataFrame, is_licence_file=None) -> DataFrame:
    """files (path, own_license, cosine) plus directory, license and license_dir.

    license is own_license, or that of the nearest ancestor directory with a licence file: one named so,
    or covered by a template by half. Among several licence files of a directory the highest cosine,
    then the first name. The root's directory is ''. A null path inherits nothing.
    """
    if is_licence_file is None:
        is_licence_file = F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILE) | (F.col("coverage") >= COVERAGE)
    files = files.drop("directory", "license", "license_dir").withColumn("directory", F.regexp_replace("path", r"/?[^/]*$", ""))
    licences = files.where(is_licence_file & F.col("own_license").isNotNull()).groupBy("directory").agg(F.min_by("own_license", F.struct(-F.col("cosine"), "own_license")).alias("of"))
    wanted = files.where("directory is not null").select("directory").distinct()
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    ancestors = wanted.select(F.col("directory").alias("wanted"), F.explode(F.array_distinct(above)).alias("directory"))
    nearest = ancestors.join(licences, "directory").groupBy("wanted").agg(F.max_by(F.struct("of", "directory"), F.length("directory")).alias("near"))
    nearest = nearest.select(F.col("wanted").alias("directory"), F.col("near.of").alias("inherited"), F.col("near.directory").alias("license_dir_"))
    nearest = materialize(nearest, "nearest")
    out = files.join(F.broadcast(nearest) if few(nearest, "directory") else nearest, "directory", "left")
    own = F.col("own_license").isNotNull()
    return out.withColumn("license", F.coalesce("own_license", "inherited")).withColumn("license_dir", F.when(~own, F.col("license_dir_"))).drop("inherited", "license_dir_")


def scan(files: DataFrame, id_col: str, path, text_col: str = "text", is_licence_file=None, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """id, path, own_license, cosine, line_no, coverage, license, license_dir for every row.

    path: an expression. Null and empty texts have no licence of their own. Texts are read whole.
    Repeated rows give repeated rows; an empty table gives an empty table; other columns are not read.
    """
    rows = without_clashes(files.withColumn("path_", path), id_col, "path_", text_col).toDF("id", "path", "text")
    made = materialize(own_licences(rows, templates).drop("text"), "licences")
    out = inherit(made, is_licence_file)
    return out.select(F.col("id").alias(id_col), "path", "own_license", "cosine", "line_no", "coverage", "license", "license_dir")


