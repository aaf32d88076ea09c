import random

import numpy as np
from pyspark.sql import functions as F

from clickloom.llm import toxicity


def categories():
    return {"rude": F.col("rude") == 1, "vile": F.col("vile") == 1}


def made(spark, count=600):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(count):
        rude = rng.random() < 0.3
        vile = rude and rng.random() < 0.5
        words = [f"w{rng.randrange(400)}x" for _ in range(40)] + ["oaf"] * rude + ["fiendish"] * vile
        rng.shuffle(words)
        docs.append((i, "! ".join(words).replace("w", "wa").translate(str.maketrans("0123456789", "abcdefghij")), "x", 1.0))
        labels.append((i, int(rude), int(vile)))
    return (spark.createDataFrame(docs, "doc_id long, text string, word string, p_rude double"),
            spark.createDataFrame(labels, "doc_id long, rude int, vile int"))


def test_chain_learns_the_categories_and_scores_odd_texts(spark):
    docs, labels = made(spark)
    chain = toxicity.fit(docs.where("doc_id % 3 > 0"), labels, categories())
    truth = {row.doc_id: row for row in labels.collect()}
    rows = {row.doc_id: row for row in toxicity.score(docs, chain).collect()}
    unseen = [i for i in rows if i % 3 == 0]
    assert np.mean([(rows[i].p_rude >= 0.5) == bool(truth[i].rude) for i in unseen]) > 0.97
    assert np.mean([(rows[i].p_vile >= 0.5) == bool(truth[i].vile) for i in unseen]) > 0.97
    assert chain.weights[1, len(chain.words)] > 0  # the later model listens to the earlier one
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "OAF, " + "waabx " * 50_000), (3, "x"), (None, "x")], "doc_id long, text string")
    found = toxicity.score(odd, chain).collect()
    assert len(found) == 5 and all(0 <= row.p_rude <= 1 for row in found)
    assert [row.p_rude >= 0.5 for row in found if row.doc_id == 3][0]
    flagged = toxicity.with_rejection(docs, chain, "rude")
    assert flagged.columns == [*docs.columns, "rejected"]
    assert {row.doc_id for row in flagged.where("rejected").collect()} == {i for i in rows if rows[i].p_rude >= 0.5}
    assert toxicity.score(docs.limit(0), chain).count() == 0


def test_without_labels_nothing_is_toxic(spark):
    docs, labels = made(spark, 20)
    for some in (labels.limit(0), labels.withColumns({"rude": F.lit(0), "vile": F.lit(None).cast("int")})):
        chain = toxicity.fit(docs, some, categories())
        assert all(row.p_vile < 0.5 for row in toxicity.score(docs, chain).collect())


def test_repeated_labels_and_null_ids(spark):
    docs = spark.createDataFrame([(i, "bad word" if i % 2 else "good word") for i in range(60)] + [(None, "bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, None) for i in range(60)] + [(i, i % 2, i % 2) for i in range(60)] + [(None, 1, 1)],
                                   "doc_id long, rude int, vile int")
    rows = {row.doc_id: row.p_vile for row in toxicity.score(docs, toxicity.fit(docs, labels, categories())).collect()}
    assert all((rows[i] >= 0.5) == (i % 2 == 1) for i in range(60))


def test_query_finds_labelled_toxic_texts(spark):
    from clickloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    rows = {row.doc_id: row.kept for row in QUERIES["op3_toxicity_chain"].build(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    clean = [rows[row.doc_id] for row in labels if row.toxic == 0]
    toxic = [rows[row.doc_id] for row in labels if row.toxic == 1]
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert sum(clean) >= 0.99 * len(clean) and sum(toxic) <= 0.3 * len(toxic)
