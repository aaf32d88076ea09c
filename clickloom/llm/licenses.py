"""License scans: TF-IDF cosine of license statements to templates, and inheritance along directories.

What may state a license in a text is a sparse vector of words and word pairs weighted by TF-IDF, with document frequencies
over the statements of all texts: a line, a run of lines, a paragraph, a run of paragraphs, and the whole of a file that is
named as a license. It is compared with the vectors of license templates (tags, titles, notices, short full texts); the most
alike above a threshold is the file's own finding. A file without one inherits from the license file of the nearest
directory above it, by joins on paths.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.components import reliable

# How the licenses are commonly stated, and their short full texts.
_GRANT_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:")
_TERMS_MIT = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_GRANT_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    "the above copyright notice and this permission notice appear in all copies.")
_TERMS_ISC = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
    "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
    "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.")
_CLAUSE_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission.")
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_NOTICE_GNU = (
    "{what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published "
    "by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
_NOTICE_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")
_TERMS_APACHE = (
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
    "permissions and limitations under the License.")
_NOTICE_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
    "this file, You can obtain one at https://mozilla.org/MPL/2.0/.")


def _gnu(kind: str, version: str, long: str, date: str) -> list[str]:
    notices = [_NOTICE_GNU.format(what=what, kind=kind, version=version).replace("  ", " ") for what in ("This program", "This library")]
    name = f"GNU {kind} General Public License".replace("  ", " ")
    short = {"": "GPL", "Lesser": "LGPL", "Affero": "AGPL"}[kind]
    return [*notices, f"{name} Version {version}, {date}", f"This work is licensed under the {name}, version {version}.",
            f"SPDX-License-Identifier: {short}-{long}-or-later", f"SPDX-License-Identifier: {short}-{long}-only", f"SPDX-License-Identifier: {short}-{long}"]


TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0",
                   _NOTICE_APACHE, f"{_NOTICE_APACHE} {_TERMS_APACHE}"],
    "MIT": ["Released under the MIT License.", "The MIT License (MIT)", "SPDX-License-Identifier: MIT", "Licensed under the MIT License.",
            _GRANT_MIT, f"{_GRANT_MIT} {_TERMS_MIT}", f"MIT License Copyright (c) {_GRANT_MIT} {_TERMS_MIT}"],
    "ISC": ["ISC License", "SPDX-License-Identifier: ISC", _GRANT_ISC, f"{_GRANT_ISC} {_TERMS_ISC}"],
    "GPL-2.0": _gnu("", "2", "2.0", "June 1991"),
    "GPL-3.0": _gnu("", "3", "3.0", "29 June 2007"),
    "LGPL-2.1": _gnu("Lesser", "2.1", "2.1", "February 1999"),
    "LGPL-3.0": _gnu("Lesser", "3", "3.0", "29 June 2007"),
    "AGPL-3.0": _gnu("Affero", "3", "3.0", "19 November 2007"),
    "BSD-2-Clause": ["BSD 2-Clause License", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", _BSD_2, f"{_BSD_2} {_BSD_END}"],
    "BSD-3-Clause": ["BSD 3-Clause License", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", f"{_BSD_2} {_CLAUSE_3}",
                     f"{_BSD_2} {_CLAUSE_3} {_BSD_END}",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0",
                "SPDX-License-Identifier: MPL-2.0", _NOTICE_MPL],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0.", "Licensed under CC BY 4.0.",
                  "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License, CC BY-SA 4.0.", "Licensed under CC BY-SA 4.0.",
                     "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License, CC BY-NC 4.0.", "Licensed under CC BY-NC 4.0.",
                     "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal.", "CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "proprietary": ["All rights reserved."],
}
# Beginnings of words one of which is in every statement looked for.
TELLING = "licens licenc sublicens unlicens spdx copyright redistribut warrant rights cc0 unencumbered gnu gpl lgpl agpl apache mozilla".split()
LEAST_COSINE = 0.6
WORD = regex.compile(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*")
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)([._-][^/]*)?$"


def features(text: str) -> Counter:
    """Words and pairs of neighbouring words, in lower case."""
    words = [word.lower() for word in WORD.findall(text)]
    return Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


_LISTED = [(name, words, features(words)) for name in sorted(TEMPLATES) for words in TEMPLATES[name]]
VOCABULARY = sorted({feature for _, _, counts in _LISTED for feature in counts})
_PLACE = {feature: i for i, feature in enumerate(VOCABULARY)}
ANY_TELLING = r"(?i)(?:^|[^\p{L}\p{N}])(?:" + "|".join(TELLING) + ")"
"""A quick test that every text with a statement meets."""
_TELLS = regex.compile(ANY_TELLING)
_WORDED = regex.compile(r"[\p{L}\p{N}]")


def _runs(parts: list[str], telling: list[bool], glue: str) -> Iterator[str]:
    """Each telling part, and each run of two or more of them as one."""
    run: list[str] = []
    for part, tells in zip([*parts, ""], [*telling, False]):
        if tells:
            run.append(part)
            yield part
            continue
        if len(run) > 1:
            yield glue.join(run)
        run = []


def statements(text: str, whole: bool = False) -> list[str]:
    """What may state a license: telling lines, telling paragraphs, runs of either, and on demand the whole text.

    A line tells if a word in it begins like one of ``TELLING``; a paragraph, which ends at a line without a word, if one of
    its lines does. Equal statements are listed once, in the order found.
    """
    lines = text.split("\n")
    tells = [bool(_TELLS.search(line)) for line in lines]
    paragraphs: list[list[int]] = [[]]
    for i, line in enumerate(lines):
        if _WORDED.search(line):
            paragraphs[-1].append(i)
        elif paragraphs[-1]:
            paragraphs.append([])
    blocks = ["\n".join(lines[i] for i in p) for p in paragraphs]
    found = [*_runs(lines, tells, "\n"), *_runs(blocks, [any(tells[i] for i in p) for p in paragraphs], "\n")]
    if whole and any(tells):
        found.append(text)
    return list(dict.fromkeys(found))


def _candidates(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """Row and statements of those that may hold one."""
    texts = batch.column("text")
    for i in np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, ANY_TELLING), False).to_numpy(zero_copy_only=False)):
        yield i, statements(texts[int(i)].as_py(), batch.column("whole")[int(i)].as_py())


def _weights(counts: Counter, idf: np.ndarray, rest: float) -> tuple[dict[int, float], float]:
    """Weights of the templates' features and the length of the whole vector; other features weigh ``rest``."""
    known = {_PLACE[f]: (1 + math.log(n)) * idf[_PLACE[f]] for f, n in counts.items() if f in _PLACE}
    strange = sum(((1 + math.log(n)) * rest) ** 2 for f, n in counts.items() if f not in _PLACE)
    return known, math.sqrt(sum(w * w for w in known.values()) + strange)


class Templates:
    """The templates' unit vectors, listed by feature, so that a statement meets those it shares a feature with."""

    def __init__(self, idf: np.ndarray, rest: float) -> None:
        self.idf, self.rest = idf, rest
        self.lists: dict[int, list[tuple[int, float]]] = {}
        for t, (_, _, counts) in enumerate(_LISTED):
            weights, length = _weights(counts, idf, rest)
            for place, weight in weights.items():
                self.lists.setdefault(place, []).append((t, weight / length))

    def best(self, found: list[str]) -> tuple[str | None, float]:
        """The license whose template is most alike to a statement, and the cosine.

        Of equal cosines the template with more features wins, as it says more, then the first by name.
        """
        best: tuple[float, int, int] | None = None
        for statement in found:
            own, length = _weights(features(statement), self.idf, self.rest)
            dots: dict[int, float] = {}
            for place, weight in own.items():
                for t, part in self.lists[place]:
                    dots[t] = dots.get(t, 0.0) + weight * part
            for t, dot in dots.items():
                rank = (round(dot / length, 9), len(_LISTED[t][2]), -t)
                if best is None or rank > best:
                    best = rank
        return (_LISTED[-best[2]][0], min(1.0, best[0])) if best else (None, 0.0)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, float]:
    """IDF of the templates' features over the statements of all texts, and of a feature no text has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(len(VOCABULARY), dtype=np.int64), 0
        for batch in batches:
            rows += len(batch)
            for _, found in _candidates(batch):
                for feature in {feature for statement in found for feature in features(statement)}:
                    if feature in _PLACE:
                        seen[_PLACE[feature]] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(VOCABULARY)), -1], pa.int32()), pa.array([*seen.tolist(), rows])], ["feature", "n"])

    counts = {row["feature"]: row["n"] for row in
              texts.select("text", "whole").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    total = counts.get(-1) or 0
    idf = np.array([math.log((1 + total) / (1 + (counts.get(i) or 0))) + 1 for i in range(len(VOCABULARY))])
    return idf, math.log(1 + total) + 1


def own_findings(files: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``id``, ``path``, ``license`` and ``cosine`` (null below ``least``) from each file's own text."""
    whole = F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False))
    files = files.select("id", "path", "text", whole.alias("whole"))
    idf, rest = document_frequencies(files)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(idf, rest)
        for batch in batches:
            names: list[str | None] = [None] * len(batch)
            scores: list[float | None] = [None] * len(batch)
            for i, found in _candidates(batch):
                name, score = templates.best(found)
                if name is not None and score >= least:
                    names[i], scores[i] = name, score
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("path"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             ["id", "path", "license", "cosine"])

    kind = files.schema["id"].dataType.simpleString()
    return files.mapInArrow(scan, f"id {kind}, path string, license string, cosine double")


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first: ``a/b/c`` is in ``a/b``, ``a`` and the root, the empty path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def inherit(findings: DataFrame, is_license_file: Column) -> DataFrame:
    """``license_from`` (own, inherited, none) and the license of the nearest directory above for files without their own.

    A directory's license is that of its license files: the one with the highest cosine, then the first by path. Files in
    one directory ask once; directories, not files, are joined with what is above them.
    """
    placed = findings.withColumn("dirs", F.when(F.col("path").isNotNull(), ancestors(F.col("path"))).otherwise(F.array().cast("array<string>")))
    placed = placed.withColumn("dir", F.get("dirs", F.lit(0)))
    stated = placed.where(is_license_file & F.col("license").isNotNull() & F.col("dir").isNotNull())
    stated = stated.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "license")).alias("s")).select("dir", F.col("s.license").alias("above"))
    asking = placed.where(F.col("license").isNull() & F.col("dir").isNotNull()).groupBy("dir").agg(F.first("dirs").alias("dirs"))
    near = asking.select(F.col("dir").alias("of"), F.posexplode("dirs").alias("steps", "dir")).join(stated, "dir")
    near = near.groupBy("of").agg(F.min(F.struct("steps", "above")).alias("n")).select("of", F.col("n.above").alias("above"), F.col("n.steps").alias("steps"))
    out = placed.join(near, placed["dir"] == near["of"], "left")
    own = F.col("license").isNotNull()
    origin = F.when(own, F.lit("own")).when(F.col("above").isNotNull(), F.lit("inherited")).otherwise(F.lit("none"))
    return out.select("id", "path", F.coalesce("license", "above").alias("license"), "cosine", origin.alias("license_from"),
                      F.when(~own, F.col("steps")).alias("steps"))


def scan(docs: DataFrame, path_sql: str, is_license_sql: str = f"path rlike '{LICENSE_FILE}'", id_col: str = "doc_id", text_col: str = "text",
         least: float = LEAST_COSINE) -> DataFrame:
    """The license of each file: its own by its text, or that of the nearest directory above.

    Returns the id, ``path``, ``license``, ``cosine`` (of an own finding), ``license_from`` and ``steps`` (directories up).
    ``path_sql`` gives a row's path, ``is_license_sql`` whether a ``path`` (and ``id``, ``license``) makes it a license file.
    Null texts have no finding, null paths inherit nothing, repeated rows are files each with the same result, an empty
    table gives none. The whole text is searched for statements.
    """
    files = docs.select(F.col(id_col).alias("id"), F.expr(path_sql).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    # Stored: the joins below read the findings three times, the texts are scanned once.
    out = inherit(reliable(own_findings(files, least)), F.expr(is_license_sql))
    return out.withColumnRenamed("id", id_col)
