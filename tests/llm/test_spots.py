import hashlib
import re

import pytest
from pyspark.sql import functions as F

from clickloom.llm import spots


def signatures(text, chain=3):
    """Chains as tuples, in place of hashes."""
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    out = set()
    for i, word in enumerate(words):
        if word in spots.ANCHORS:
            content = [w for w in words[i + 1 :] if w not in spots.ANCHORS][:chain]
            if len(content) == chain:
                out.add((word, *content))
    if not out:
        out = {tuple(words)} if words else {text} if text else set()
    return out


def alike(a, b):
    if not a and not b:
        return 1.0
    return len(a & b) / len(a | b)


def check(docs, rows):
    order = sorted(docs, key=lambda i: -i)
    assert {row.doc_id for row in rows} == set(docs) and len(rows) == len(docs)
    prints = {}
    for row in rows:
        text, after = docs[row.doc_id] or "", docs[order[(order.index(row.doc_id) + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, changed = signatures(text), signatures(edited)
        assert (row.n_signatures, row.n_edited_signatures) == (len(own), len(changed))
        assert row.near_edited == pytest.approx(alike(own, changed)) and row.near_next == pytest.approx(alike(own, signatures(after)))
        assert row.same_next == (alike(own, signatures(after)) >= spots.LEAST)
        for key, value in ((text, row.fingerprint), (edited, row.edited_fingerprint)):
            assert prints.setdefault(key, value) == value


@pytest.mark.parametrize("ids", [[5], [3, 4], [0, 1, 999, 1000, 5_000_000, 2_000_000_123, -7, -5000], list(range(0, 90_000, 1777))])
def test_equals_the_plain_version(spark, ids):
    texts = ["The cat sat on the mat and it was a very happy old cat in the end of the day", None, "", "?!", "no anchors here😀",
             "der Hund und die Katze mit dem Ball spielen nicht gern im Garten", "The cat sat on the mat and it was a very happy dog"]
    docs = {i: texts[k % len(texts)] for k, i in enumerate(ids)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumns({"bucket": F.lit("x"), "id": F.lit(1)})
    check(docs, spots.edited_likeness(frame).collect())


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    frame = spark.createDataFrame([(2, "b"), (2, "b"), (2, "aa"), (1, "cc"), (None, "dd")], "doc_id long, text string")
    rows = spots.edited_likeness(frame).collect()
    edited = sorted(row.edited_sha256 for row in rows)
    assert edited == sorted(hashlib.sha256(t.encode()).hexdigest() for t in ["ab", "b", "b", "cd", "da"])
    assert spots.edited_likeness(frame.limit(0)).count() == 0


def test_partitions_never_part_alike_sets(spark):
    for floor in (0.05, 0.5, 0.8):
        pairs = spark.range(1, 300).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(299))).alias("m")).where(
            F.least("n", "m") >= F.greatest("n", "m") * floor)
        apart = F.abs(spots.length_partition(F.col("n"), floor) - spots.length_partition(F.col("m"), floor))
        assert pairs.agg(F.max(apart)).first()[0] <= 1


def test_query_equals_the_plain_version_on_the_given_table(spark, sf_dir):
    from clickloom.llm.queries import QUERIES

    docs = {row.doc_id: row.text for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(docs, QUERIES["op9_spot_signatures"].build(spark, sf_dir).collect())


def test_small_likeness_is_returned_and_lengths_settle_near_duplicates(spark):
    rows = [(1, list(range(100)), list(range(99, 140))), (2, list(range(100)), list(range(80))), (3, list(range(100)), list(range(79))),
            (4, [], []), (5, [], [1]), (6, [1], [1]), (7, list(range(4)), list(range(1, 5)))]
    frame = spark.createDataFrame(rows, "i int, a array<long>, b array<long>")
    value = spots.likeness(F.col("a"), F.col("b"))
    found = {row.i: (row.v, row.n) for row in frame.select("i", value.alias("v"), spots.near(F.col("a"), F.col("b"), value, 0.8).alias("n")).collect()}
    assert found[1] == (pytest.approx(1 / 140), False)
    assert found[2] == (0.8, True) and found[3] == (0.79, False)
    assert found[4] == (1.0, True) and found[5] == (0.0, False) and found[6] == (1.0, True) and found[7] == (0.6, False)
