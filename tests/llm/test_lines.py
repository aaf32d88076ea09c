import random
import time
from collections import defaultdict

from clickloom.llm import lines
from tests.llm.brute import WORD


def plain(rows, min_sites):
    sites, first = defaultdict(set), {}
    for doc, text, site in sorted(rows, key=lambda row: row[0]):
        for i, line in enumerate((text or "").split("\n")):
            line = line.strip(" ")
            if WORD.search(line):
                sites[line].add(site or "")
                first.setdefault(line, (doc, i))
    out = {}
    for doc, text, _ in rows:
        kept = [] if text is None else [
            line for i, line in enumerate(text.split("\n"))
            if len(sites[line.strip(" ")]) < min_sites * (lines.SHORT_FACTOR if len(WORD.findall(line)) < lines.SHORT_WORDS else 1) or first[line.strip(" ")] == (doc, i)]
        out[doc] = (None if text is None else "\n".join(kept), 0 if text is None else text.count("\n") + 1 - len(kept))
    return out


def test_equals_the_plain_version(spark):
    rng = random.Random(4)
    shared = [f"line {i} is known to several sites" for i in range(12)] + ["short one", "two  words", "\tthree of them", " four of them\tnow ", "", " ", "\t"]
    rows = [(i, "\n".join(rng.choice(shared) + rng.choice(["", "  "]) if rng.random() < 0.6 else f"own words of {i} {rng.random()}" for _ in range(rng.randrange(9))),
             rng.choice([None, "hot", "hot", "hot", *map(str, range(rng.choice([2, 30])))])) for i in range(200)]
    rows += [(900, None, "s"), (901, "", "s"), (902, "\n\n", "s"), (903, shared[0], "z"), (904, "y " * 60_000, "s")]
    docs = spark.createDataFrame([(*row, 1, "x", "y") for row in rows], "doc_id long, text string, source string, n_chars long, site string, x string")
    for min_sites in (2, 4, 20):
        out = lines.deduplicate_lines(docs, min_sites)
        assert out.columns == [*docs.columns, "removed_lines"]
        assert {row.doc_id: (row.text, row.removed_lines) for row in out.collect()} == plain(rows, min_sites)


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    line = "the same line on every site"
    docs = spark.createDataFrame([(1, line, "a"), (1, line, "a"), (None, line, "b"), (2, f"{line}\n{line}", "c"), (3, line, "d")], "doc_id long, text string, source string")
    out = sorted((row.doc_id or 0, row.text) for row in lines.deduplicate_lines(docs).collect())
    assert out == [(0, line), (1, ""), (1, ""), (2, ""), (3, "")]
    assert lines.deduplicate_lines(docs.limit(0)).count() == 0


def test_a_long_run_takes_time_in_proportion(spark):
    docs = spark.createDataFrame([(1, "x" * 1_000_000, "a"), (2, " " * 1_000_000 + "x", "b"), (3, "x " * 500_000, "c")], "doc_id long, text string, source string")
    lines.deduplicate_lines(docs).count()
    start = time.time()
    assert sorted(row.removed_lines for row in lines.deduplicate_lines(docs).collect()) == [0, 0, 0]
    assert time.time() - start < 20


def test_short_lines_need_more_sites(spark):
    rows = [(i, f"All rights reserved.\nnot so many\na line of more words\nown line of document {i}", f"s{i}") for i in range(4)]
    rows += [(i, "All rights reserved.", f"s{i}") for i in range(4, 9)]
    out = lines.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    texts = {row.doc_id: row.text for row in out.collect()}
    assert texts[0] == rows[0][1] and texts[5] == "" and texts[1] == "not so many\nown line of document 1"


def test_columns_of_clashing_names_stay(spark):
    line = "the same line on every site"
    docs = spark.createDataFrame([(i, line, f"s{i}", "a", "b", "c", "d", "e") for i in range(6)],
                                 "doc_id long, text string, source string, _id string, _gone string, line_owner string, LINE_PLACES string, id string")
    out = lines.deduplicate_lines(docs)
    assert out.columns == [*docs.columns, "removed_lines"]
    assert {tuple(row)[3:8] for row in out.collect()} == {("a", "b", "c", "d", "e")}
