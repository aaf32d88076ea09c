import random

import pytest

from clickloom.llm import components, minhash
from tests.llm.brute import near_groups


def variant(rng, words, share):
    return [w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in words]


def found(docs, **options):
    return {row.doc_id: (row.n_shingles, row.component_id) for row in minhash.near_duplicates(docs, **options).collect()}


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 200), (7, None)] + [(300 - i, 299 - i) for i in range(9)]
    roots = {row.vertex: row.root for row in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}, 200: 200, **{291 + i: 291 for i in range(10)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_equals_brute_force_on_groups_of_all_kinds(spark, monkeypatch, width):
    monkeypatch.setattr(minhash, "LONG_LIST", 6)  # so that leaders and blocks take part
    rng = random.Random(width)
    texts, passage = {}, [f"p{i}" for i in range(40)]
    for group in range(12):
        base = [f"w{group}_{i}" for i in range(rng.choice([3, 20, 60, 200, 400]))]
        for _ in range(rng.choice([1, 2, 30])):
            texts[len(texts)] = " ".join(variant(rng, base, rng.choice([0, 0.02, 0.04])))
    for _ in range(25):  # a common passage in texts that are otherwise different
        texts[len(texts)] = " ".join(passage + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([5, 15, 60]))])
    for odd in [None, "", "   ", "one", "One", "one two", "ONE  two\n"]:
        texts[len(texts)] = odd
    ids = list(texts)
    rng.shuffle(ids)
    texts = {new: texts[old] for new, old in zip(sorted(ids), ids)}
    docs = spark.createDataFrame([(i, text, "x", 1) for i, text in texts.items()], "doc_id long, text string, copy string, n int")
    assert found(docs, width=width) == near_groups(texts, width)


def test_repeated_and_null_ids_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (3, "a b d")], "doc_id long, text string")
    rows = sorted(tuple(row) for row in minhash.near_duplicates(docs, width=2).fillna(-1).collect())
    assert rows == [(-1, 2, -1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 3, True)]
    assert minhash.near_duplicates(docs.limit(0), width=2).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs, percent=50)


def test_query_equals_brute_force_on_the_given_table(spark, sf_dir):
    from clickloom.llm.queries import QUERIES

    rows = QUERIES["op4_minhash_near_dedup"].build(spark, sf_dir).collect()
    texts = {row.doc_id: row.text for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {row.doc_id: (row.n_shingles, row.component_id) for row in rows} == near_groups(texts, 2)
    assert all(row.kept == (row.doc_id == row.component_id) for row in rows)


def test_sets_within_the_sketch_meet_larger_ones(spark):
    rng, texts = random.Random(9), {}
    for n in (45, 46, 47, 48):
        for size in range(49, 61):
            for _ in range(6):  # the smaller set lies within the larger
                words = [f"t{rng.randrange(10**12)}" for _ in range(size + 1)]
                texts |= {len(texts): " ".join(words[: n + 1]), len(texts) + 1: " ".join(words)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    groups = near_groups(texts, 2)
    assert sum(group != doc for doc, (_, group) in groups.items()) > 100
    assert found(docs, width=2) == groups


def test_sets_that_meet_by_chance_are_not_read_whole(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LONG_LIST", 3)
    rng, read = random.Random(4), []
    texts = {i: " ".join(f"v{rng.randrange(40)}" for _ in range(60)) for i in range(120)}
    texts |= {200: texts[5] + " end", 201: texts[6] + " end"}
    real = minhash.full_sets
    monkeypatch.setattr(minhash, "full_sets", lambda docs, wanted, *rest: read.append(wanted.count()) or real(docs, wanted, *rest))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(docs, width=2) == near_groups(texts, 2)
    assert 4 <= sum(read) < 40  # nearly all 122 are in long lists
