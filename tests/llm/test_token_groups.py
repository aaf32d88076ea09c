import random

import pytest

from clickloom.llm import token_groups
from tests.llm.brute import near_groups


def variant(rng, words, share):
    return [w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in words]


def found(docs, **options):
    return {row.doc_id: (row.n_shingles, row.component_id) for row in token_groups.join_by_groups(docs, **options).collect()}


def test_heads_of_similar_sets_share_what_is_said():
    rng = random.Random(4)
    for _ in range(3000):
        percent = rng.choice([50, 67, 80, 85, 99, 100])
        n = rng.randrange(1, 60)
        a = set(rng.sample(range(10_000), n))
        out, more = rng.randrange(0, n // 2 + 1), rng.randrange(0, n // 2 + 1)
        b = set(sorted(a, key=lambda _: rng.random())[out:]) | set(rng.sample(range(10_000), more))
        if not b or 100 * len(a & b) < percent * len(a | b):
            continue
        assert len(b) >= token_groups.required(len(a), percent)
        heads = [set(sorted(s)[: token_groups.head_size(len(s), percent)]) for s in (a, b)]
        assert len(heads[0] & heads[1]) >= token_groups.sure_common(token_groups.required(len(a), percent), percent)


@pytest.mark.parametrize("width, percent", [(4, 85), (2, 60), (5, 80)])
def test_equals_brute_force_on_groups_of_all_kinds(spark, monkeypatch, width, percent):
    monkeypatch.setattr(token_groups, "CHUNK", 5)  # so that rounds and several groups a component take part
    monkeypatch.setattr(token_groups, "QUERIES", 3)
    monkeypatch.setattr(token_groups, "HOT_SHARE", 0.001)
    rng = random.Random(width)
    texts, passage = {}, [f"p{i}" for i in range(40)]
    for group in range(12):
        base = [f"w{group}_{i}" for i in range(rng.choice([3, 20, 60, 200, 400]))]
        for _ in range(rng.choice([1, 2, 40])):
            texts[len(texts)] = " ".join(variant(rng, base, rng.choice([0, 0.01, 0.02, 0.04])))
    for length in range(30, 75):  # each a little longer than the one before: a chain of links
        texts[len(texts)] = " ".join(f"c{i}" for i in range(length * 4))
    for _ in range(25):  # a common passage in texts that are otherwise different
        texts[len(texts)] = " ".join(passage + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([2, 5, 9, 15, 60]))])
    for odd in [None, "", "   ", "one", "One", "one two", "ONE  two\n", "a " * 30_000]:
        texts[len(texts)] = odd
    ids = list(texts)
    rng.shuffle(ids)
    texts = {new: texts[old] for new, old in zip(sorted(ids), ids)}
    docs = spark.createDataFrame([(i, text, "x", 1) for i, text in texts.items()], "doc_id long, text string, root string, n int")
    assert found(docs, width=width, percent=percent) == near_groups(texts, width, percent)


def test_a_passage_that_is_half_of_many_texts_pairs_few_of_them(spark, monkeypatch):
    rng, pairs, candidates = random.Random(6), [], token_groups.candidates

    def counting(*args):
        rows = candidates(*args)
        pairs.append(rows.count())
        return rows

    monkeypatch.setattr(token_groups, "candidates", counting)
    passage = [f"p{i}" for i in range(40)]
    texts = {i: " ".join([*passage, *[f"u{rng.randrange(10**6)}" for _ in range(40)]]) for i in range(120)}
    for i in range(0, 120, 10):  # similar ones among them, and some that are nothing but the passage
        texts[200 + i] = texts[i] + " end"
        texts[400 + i] = " ".join(passage[: 40 - i // 30])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(docs, width=4, percent=85) == near_groups(texts, 4, 85)
    assert pairs[0] < 5 * len(texts)  # 1,218 where all groups that share an entered token are paired


@pytest.mark.parametrize("often", [1, 3])
def test_equals_brute_force_where_most_tokens_are_frequent(spark, monkeypatch, often):
    monkeypatch.setattr(token_groups, "CHUNK", 5)
    monkeypatch.setattr(token_groups, "OFTEN", often)
    rng = random.Random(often)
    passages = [[f"p{k}_{i}" for i in range(30)] for k in range(6)]
    texts = {}
    for i in range(150):
        base = sum(rng.sample(passages, rng.choice([1, 1, 2])), []) + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 3, 8, 30]))]
        for _ in range(rng.choice([1, 1, 3])):
            texts[len(texts)] = " ".join(variant(rng, base, rng.choice([0, 0.01, 0.03])))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(docs, width=2, percent=80) == near_groups(texts, 2, 80)


def test_sets_at_the_very_threshold(spark):
    """17 of 20 tokens in common is 85 percent, 16 of 19 is not."""
    base = [f"t{i}" for i in range(20)]
    texts = {1: " ".join(base[:17]), 2: " ".join(base), 3: " ".join([*base[:16], "o", "p", "q"]), 4: " ".join(base[:16])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(docs, width=1, percent=85) == near_groups(texts, 1, 85)


def test_repeated_and_null_ids_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (3, "a b d")], "doc_id long, text string")
    rows = sorted(tuple(row) for row in token_groups.join_by_groups(docs, width=2).fillna(-1).collect())
    assert rows == [(-1, 2, -1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 3)]
    assert token_groups.join_by_groups(docs.limit(0), width=2).count() == 0
    with pytest.raises(ValueError):
        token_groups.join_by_groups(docs, percent=30)


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y z w v"), ("a", "x y z w v"), ("c", "other words")], "doc_id string, text string")
    assert found(docs) == {"a": (1, "a"), "b": (1, "a"), "c": (1, "c")}
