import random
from collections import Counter

from pyspark.sql import functions as F

from clickloom.llm import rules
from tests.llm.brute import WORD


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), base)


def judged(docs, learned=()):
    return {row.doc_id: tuple(row)[1:] for row in rules.judge(docs, list(learned)).collect()}


def test_statistics_of_odd_texts(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "a", "a a a a", "a b a b a b", "\n\nx\n x\nx\n", "<&#>|$ %*", "é 😀 b", "a b\x0bc", "x " * 70_000]
    texts += [" ".join(rng.choice("abcd") + rng.choice(["", "\n", " ", "#"]) for _ in range(rng.randrange(120))) for _ in range(150)]
    docs = spark.createDataFrame([(i, text, 5, "s", "w") for i, text in enumerate(texts)], "doc_id long, text string, n_words int, s string, w string")
    found = judged(docs)
    for i, text in enumerate(texts):
        assert found[i][:6] == statistics(text), repr(text)[:80]
        assert found[i][6] == (not found[i][5])
    assert rules.judge(docs.limit(0), []).count() == 0
    kept = rules.only_kept(docs, [])
    assert kept.columns == docs.columns and {row.doc_id for row in kept.collect()} == {i for i in found if found[i][6]}


def test_learns_ordered_conjunctions(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        symbols, marks = rng.random(), rng.random()
        bad = int(symbols > 0.7 and marks > 0.5)
        rows.append((i, bad, rng.random() * 500, 5.0, symbols, marks, 0.0, 0.0, 9.0))
    frame = spark.createDataFrame(rows, "id long, bad int, " + ", ".join(f"{name} double" for name in rules.FEATURES))
    learned = rules.learn(frame.cache())
    assert learned and {c.feature for rule in learned for c in rule.conditions} <= {"symbols", "marks"}
    verdict = F.lit(False)
    for rule in learned:
        verdict = verdict | rule.column()
    right = frame.where(verdict == (F.col("bad") == 1)).count()
    assert right > 0.97 * len(rows)
    assert rules.learn(frame.where("bad = 0")) == [] and rules.learn(frame.limit(0)) == []


def test_query_statistics_and_verdicts(spark, sf_dir):
    from clickloom.llm.queries import QUERIES

    rows = {row.doc_id: row for row in QUERIES["op7_quality_rules"].build(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        row = rows[doc.doc_id]
        assert tuple(row)[1:7] == statistics(doc.text)
        assert not (row.base_failed and row.kept)
    labels = {row.doc_id: row.quality for row in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [rows[i] for i, quality in labels.items() if quality == 1 and not rows[i].base_failed]
    poor = [rows[i] for i, quality in labels.items() if quality == 0]
    assert sum(row.kept for row in good) >= 0.98 * len(good) and sum(row.kept for row in poor) <= 0.3 * len(poor)


def test_labels_with_nulls_repeats_and_strangers(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text), (None, text), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (1, 0), (2, 1), (9, 0), (None, 0), (3, 0)], "doc_id long, quality int")
    rows = rules.labelled_features(docs, labels, F.col("quality") == 0).collect()
    assert sorted((row.id, row.bad) for row in rows) == [(1, 1), (2, 0)]
