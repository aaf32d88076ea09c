import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from clickloom.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, longest):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_version(docs, target, plan):
    """[(id, n_words, n_features, weight, score, rank)] of rows (id, text), step by step."""
    bucket = lambda gram: zlib.crc32(gram.encode()) % plan.buckets
    s = Counter(bucket(g) for _, text in docs for g in grams(text, plan.longest)[1])
    t = Counter(bucket(g) for text in target for g in grams(text, plan.longest)[1])
    s_all, t_all = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + plan.buckets) / ((s[b] + 1) * (t_all + plan.buckets))))
    rows = []
    for i, text in docs:
        words, own = grams(text, plan.longest)
        h = int(hashlib.sha256(f"{plan.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in own)
        rows.append([i, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((row for row in rows if row[1] >= plan.min_words), key=lambda row: (-row[4], row[0] is None, row[0] or 0))
    for rank, row in enumerate(fit[: plan.percent * len(fit) // 100], 1):
        row[5] = rank
    return sorted(map(tuple, rows), key=str)


def sample_texts(rng, n):
    vocabulary = [f"w{i}" for i in range(300)] + ["Über", "漢字", "Mixed9", "don't", "x-y", " z", "İ"]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 19, 20, 21, 60, 300]))) for _ in range(n)]


@pytest.mark.parametrize("plan", [importance.Sampling(), importance.Sampling(longest=3, buckets=500, min_words=3, percent=35, seed=9)])
def test_equals_the_plain_version(spark, plan):
    rng = random.Random(plan.longest)
    docs = list(enumerate(sample_texts(rng, 300))) + [(1000, None), (1001, ""), (1002, "A" * 100_000), (1003, "the end " * 50_000)]
    target = sample_texts(rng, 20)
    table = spark.createDataFrame([(i, text, "r", 1, "s") for i, text in docs], "doc_id long, text string, rank string, bucket int, score string")
    found = importance.resample(table.repartition(7), spark.createDataFrame([(t,) for t in target], "text string"), plan)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_version(docs, target, plan)


def test_chained_crc_is_that_of_the_joined_words():
    own = [word.encode() for word in "one two three four five".split()]
    got = importance.features(own, 4, 1 << 32)
    assert got == Counter(zlib.crc32(b" ".join(own[i : i + n])) for n in range(1, 5) for i in range(len(own) - n + 1))


def test_ties_and_repeated_rows_have_ranks_of_their_own(spark):
    plan = importance.Sampling(min_words=1, percent=50)
    scored = [(i, 5, 5, 0, score) for i, score in [(4, 9), (2, 9), (2, 9), (2, 9), (1, 8), (None, 9), (7, 1), (8, 1), (9, -(10**9)), (3, 10**9)]]
    rows = spark.createDataFrame(scored, "id long, n_words long, n_features long, weight long, score long")
    drawn = sorted((row["rank"], row["id"]) for row in importance.draw(rows.repartition(4), plan).collect() if row["rank"])
    assert drawn == [(1, 3), (2, 2), (3, 2), (4, 2), (5, 4)]


def test_empty_tables_and_no_target(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c d")], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    plan = importance.Sampling(min_words=2, percent=100)
    assert importance.resample(docs.limit(0), none, plan).count() == 0
    rows = sorted(map(tuple, importance.resample(docs, none, plan).collect()), key=str)
    assert rows == plain_version([(1, "a b"), (None, "c d")], [], plan)
    assert [row["rank"] for row in importance.resample(docs, none).collect()] == [None, None]
