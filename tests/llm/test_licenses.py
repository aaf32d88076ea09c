import math
import re
from collections import Counter

from clickloom.llm import licenses


def is_named(path):
    return path is not None and re.search(licenses.LICENSE_FILE, path) is not None


def plain_best(text, path, files):
    """Dense vectors over all features, no short cuts. ``files`` holds (text, path)."""
    total, frequency = len(files), Counter()
    for other, place in files:
        frequency.update({f for part in licenses.statements(other or "", is_named(place)) for f in licenses.features(part)} & set(licenses.VOCABULARY))
    return plain_best_by(text, path, total, frequency)


def plain_best_by(text, path, total, frequency):
    idf = lambda f: math.log((1 + total) / (1 + frequency[f])) + 1

    def vector(part):
        return {f: (1 + math.log(n)) * idf(f) for f, n in licenses.features(part).items()}

    rows = [(name, vector(words)) for name in sorted(licenses.TEMPLATES) for words in licenses.TEMPLATES[name]]
    ranks = []
    for part in licenses.statements(text or "", is_named(path)):
        own = vector(part)
        for t, (name, other) in enumerate(rows):
            dot = sum(w * other.get(f, 0) for f, w in own.items())
            value = dot / math.sqrt(sum(w * w for w in own.values()) * sum(w * w for w in other.values()))
            ranks.append((round(value, 9), len(other), -t, name))
    best = max(ranks, default=(0.0, 0, 0, None))
    return (best[0], best[3]) if best[0] >= licenses.LEAST_COSINE else (None, None)


FILES = {
    "a/LICENSE": licenses.TEMPLATES["MIT"][0],
    "a/b/c/x.py": "code here\n# no statement",
    "a/b/y.py": "# Licensed under the Apache License, Version 2.0.\ncode",
    "a/b/c/COPYING.txt": "This work is licensed under the\nGNU General Public License, version 3.",
    "d/z.py": "We licensed a horse under the old apache version of things that matter to no one",
    "d/empty": "",
    "top.py": None,
    "LICENSES/x": "All Rights Reserved.",
}


def test_cosines_equal_dense_vectors_and_licenses_are_inherited(spark):
    rows = [(i, path, text, "x") for i, (path, text) in enumerate(FILES.items())] + [(98, None, "x", "x"), (99, "a/new/deep/q", None, "x"), (99, "a/new/deep/q", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string, license string")
    found = {row.doc_id: row for row in licenses.scan(docs, "path").collect()}
    files = [(text, path) for _, path, text, _ in rows]
    for i, (path, text) in enumerate(FILES.items()):
        value, name = plain_best(text, path, files)
        assert (found[i].license_from == "own") == (name is not None), path
        if name:
            assert found[i].license == name and math.isclose(found[i].cosine, value, abs_tol=1e-8)
    by = {path: (found[i].license, found[i].license_from, found[i].steps) for i, path in enumerate(FILES)}
    assert by["a/b/c/x.py"] == ("GPL-3.0", "inherited", 0) and by["a/b/y.py"][:2] == ("Apache-2.0", "own")
    assert by["d/z.py"] == (None, "none", None) and by["top.py"] == (None, "none", None)
    assert (found[99].license, found[99].license_from, found[99].steps) == ("MIT", "inherited", 2)
    assert found[98].license_from == "none"
    assert licenses.scan(docs, "path").count() == len(rows) and licenses.scan(docs.limit(0), "path").count() == 0


def test_query_finds_the_statements_of_the_given_table(spark, sf_dir):
    from clickloom.llm.queries import QUERIES

    rows = {row.doc_id: row for row in QUERIES["op10_license_scan"].build(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    total, frequency = len(docs), Counter()
    for doc in docs:
        parts = licenses.statements(doc.text or "", is_named(rows[doc.doc_id].path))
        frequency.update({f for part in parts for f in licenses.features(part)} & set(licenses.VOCABULARY))
    for doc in docs:
        value, name = plain_best_by(doc.text, rows[doc.doc_id].path, total, frequency)
        assert (rows[doc.doc_id].license_from == "own") == (name is not None)
        if name:
            assert rows[doc.doc_id].license == name


def test_query_inherits_from_ancestors_as_brute_force_does(spark):
    from clickloom.llm.queries import QUERIES

    rows = QUERIES["op10_license_scan"].build(spark, "/root/testdata/sf0.01").collect()
    stated = {}
    for row in rows:
        if row.license_from == "own" and row.path is not None:
            folder = row.path.rpartition("/")[0]
            stated[folder] = min(stated.get(folder, (0.0,)), (-row.cosine, row.path, row.license))
    for row in rows:
        if row.license_from != "own":
            parts = row.path.split("/")[:-1] if row.path is not None else None
            up = [] if parts is None else ["/".join(parts[:n]) for n in range(len(parts), -1, -1)]
            near = next(((stated[folder][2], "inherited", i) for i, folder in enumerate(up) if folder in stated), (None, "none", None))
            assert (row.license, row.license_from, row.steps) == near, row.path
    assert {0, 1} <= {row.steps for row in rows}


def comment(text, mark="# ", width=72):
    """A text as a comment block, broken at ``width``."""
    lines, line = [], ""
    for word in text.split(" "):
        if len(line) + len(word) > width:
            lines, line = [*lines, line], ""
        line = f"{line} {word}".strip()
    return "\n".join(mark + part for part in [*lines, line])


HEADERS = {
    "// SPDX-License-Identifier: MIT": "MIT",
    "# SPDX-License-Identifier: Apache-2.0\n# SPDX-FileCopyrightText: 2020 Someone": "Apache-2.0",
    "/* SPDX-License-Identifier: GPL-2.0 */\n#include <a.h>": "GPL-2.0",
    "MIT License\n\nCopyright (c) 2019 A. Person\n\n" + comment(licenses._GRANT_MIT, "") + "\n\n" + comment(licenses._TERMS_MIT, ""): "MIT",
    "# Copyright 2021 The Authors\n#\n" + comment(licenses._NOTICE_APACHE) + "\n#\n" + comment(licenses._TERMS_APACHE) + "\n\nimport os": "Apache-2.0",
    "Copyright (c) 1999, X\n" + comment(licenses._BSD_2, " * ") + "\n *\n" + comment(licenses._BSD_END, " * "): "BSD-2-Clause",
    "Copyright (c) 1999, X\n" + comment(licenses._BSD_2, " * ") + "\n" + comment(licenses._CLAUSE_3, " * ") + "\n *\n" + comment(licenses._BSD_END, " * "): "BSD-3-Clause",
    comment("Foo is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
            "Free Software Foundation; either version 2 of the License, or (at your option) any later version.", " * "): "GPL-2.0",
    comment("Bar is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
            "Free Software Foundation, either version 3 of the License, or any later version.", "; "): "AGPL-3.0",
    comment("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
            "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "-- "): "LGPL-2.1",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy": "GPL-3.0",
    "                                 Apache License\n                           Version 2.0, January 2004\n": "Apache-2.0",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.": "ISC",
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, "
    "You can obtain one at http://mozilla.org/MPL/2.0/.": "MPL-2.0",
    "SPDX-License-Identifier: Zlib": None,
    "He was licensed as a driver and all the rights of way were his": None,
    "the warranty covers parts for two years": None,
    "apache helicopters over the desert": None,
    "rights": None,
    "Wir kommen mit dem Zug": None,
}


def test_common_headers_are_found_and_relatives_told_apart(spark):
    rows = [(i, f"s/{i}.c", f"{text}\nint main;\n\nmore prose that goes on and says nothing") for i, text in enumerate(HEADERS)]
    rows += [(1000 + i, f"s/{i}.txt", f"prose number {i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    found = {row.doc_id: row.license for row in licenses.scan(docs, "path").collect()}
    assert [found[i] for i in range(len(HEADERS))] == list(HEADERS.values())


def test_whole_license_files_are_one_vector():
    text = "\n".join(["MIT License", "", "Copyright (c) 2019 A. Person", "", licenses._GRANT_MIT, "", "", licenses._TERMS_MIT])
    assert text in licenses.statements(text, whole=True) and text not in licenses.statements(text)
    assert licenses.statements("nothing of the kind\n\nhere", whole=True) == []


def test_clashing_column_names_stay_out_of_the_way(spark):
    docs = spark.createDataFrame([(1, "a/LICENSE", "Released under the MIT License.", "x"), (2, "a/b", "", "x")], "doc_id long, path string, text string, whole string")
    docs = docs.selectExpr("*", "'x' AS id", "'x' AS dir", "'x' AS license", "'x' AS above", "1 AS steps", "'x' AS cosine")
    assert sorted((row.doc_id, row.license, row.license_from) for row in licenses.scan(docs, "path").collect()) == [(1, "MIT", "own"), (2, "MIT", "inherited")]
