import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clickloom.llm import packing
from tests.llm.brute import near_groups
from tests.llm.test_lines import plain
from tests.llm.test_packing import check
from tests.llm.test_rules import statistics


def text_of(words):
    return " ".join(words)


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns for the given small table, in turn."""
    folder, out = "/root/testdata/sf0.001", []
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        out.append(docs)
    return out


def test_stages_keep_the_columns_and_take_effect(stages):
    start, calm, fit, cut, single, packed = stages
    for docs in stages[1:-1]:
        assert docs.columns == start.columns
    ids = [{row.doc_id for row in docs.select("doc_id").collect()} for docs in stages[:-1]]
    assert ids[0] >= ids[1] >= ids[2] == ids[3] > ids[4] and len(ids[1]) > 0.8 * len(ids[0])
    passed = {row.doc_id: row for row in calm.collect()}
    assert all(not statistics(passed[i].text)[5] for i in ids[2])
    before = [(row.doc_id, row.text, row.source) for row in fit.collect()]
    after = {row.doc_id: (row.text, row.n_chars) for row in cut.collect()}
    expected = plain(before, 4)
    assert {i: text for i, (text, _) in after.items()} == {i: text for i, (text, _) in expected.items()}
    assert all(n == len(text) for text, n in after.values())
    groups = near_groups({i: text for i, (text, _) in after.items()}, 5)
    assert ids[4] == {i for i, (_, head) in groups.items() if head == i}
    check(packed.collect(), {row.doc_id: row.text for row in single.collect()})


def test_run_equals_the_stages(spark, stages):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, stages[-1].collect()))


def test_stages_on_empty_and_odd_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    words = text_of(f"word{i}" for i in range(80))
    odd = spark.createDataFrame([(10**9, words, "en", "s", 5), (10**9, words, "en", "s", 5), (None, None, None, None, None), (10**9 + 1, "", "en", None, 0)], docs.schema)
    for docs_in, most in ((docs.limit(0), 0), (odd, 1)):
        now = docs_in
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, folder)
        assert now.count() == most
    near = corpus_pipeline.drop_near_duplicates(spark, odd, folder)
    assert sorted(row.doc_id or 0 for row in near.collect()) == [0, 10**9, 10**9 + 1]
    assert packing.pack_documents(near.withColumn("size", F.lit(1))).count() == 1


def test_columns_of_clashing_names_survive(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"rejected": F.lit("r"), "removed_lines": F.lit("l")})
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns
    assert {tuple(row) for row in now.select("rejected", "removed_lines").distinct().collect()} == {("r", "l")}


def test_texts_that_surely_stay_are_not_shuffled(spark):
    """Of 300 rows, those of ids that go or are repeated meet in a shuffle; the others are told by a bitmap."""
    rows = [(i, text_of(f"w{i}x{j}" for j in range(30)), "en", "s", 1) for i in range(280)]
    rows += [(280 + i, rows[i][1], "en", "s", 1) for i in range(10)] + [(300, "one row", "en", "s", 1)] * 4 + [(None, "no id", "en", "s", 1)] * 3
    rows += [(301, rows[1][1], "en", "s", 1), (301, "", "en", "s", 1), (302, rows[2][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = corpus_pipeline.drop_near_duplicates(spark, docs, "/root/testdata/sf0.001")
        plan = spark._jvm.PythonSQLUtils.explainString(near._jdf.queryExecution(), "formatted")
        found = sorted(row.doc_id if row.doc_id is not None else -1 for row in near.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == [-1, -1, -1, *range(280), 300]
    assert not re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\]]*text", plan)  # what is caught goes in groups by id
