import random
from collections import defaultdict

import pytest

from clickloom.llm import packing


def expected(room, ahead, longest):
    """What the sizes ahead fill of the room, class by class, each piece as large as its class's mean."""
    width, left = -(-longest // packing.CLASSES), room
    for at in sorted({size // width for size in ahead if size // width <= room // width}, reverse=True):
        own = [size for size in ahead if size // width == at]
        mean = sum(own) // len(own)
        for _ in own:
            left -= mean if mean <= left else 0
    return room - left


def slow_pack(sizes, lengths, overhead):
    """The same rule with plain scans."""
    bins, order = [], sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    for done, i in enumerate(order):
        ahead = [sizes[j] for j in order[done + 1 :]]
        fitting = [b for b in bins if b[0] >= sizes[i]]
        if fitting:
            best = min(fitting, key=lambda b: (b[0], b[2]))
        else:
            capacity = min((c for c in lengths if c >= sizes[i]), key=lambda c: ((c + overhead) / (sizes[i] + expected(c - sizes[i], ahead, max(lengths))), c))
            best = [capacity, [], len(bins)]
            bins.append(best)
        best[0] -= sizes[i]
        best[1].append(i)
    return [(min(c for c in lengths if c >= sum(sizes[i] for i in content)), content) for _, content, _ in bins]


@pytest.mark.parametrize("seed", range(6))
def test_equals_plain_best_fit_and_wastes_little(seed):
    rng = random.Random(seed)
    lengths = (16, 32, 64) if seed % 2 else packing.LENGTHS
    sizes = [rng.randrange(1, max(lengths) + 1) if rng.random() < 0.3 else rng.randrange(1, max(lengths) // 8) for _ in range(rng.choice([1, 7, 600]))]
    bins = packing.pack(sizes, lengths, 4.0)
    assert [(b.capacity, b.pieces) for b in bins] == slow_pack(sizes, lengths, 4.0)
    assert sorted(i for b in bins for i in b.pieces) == list(range(len(sizes)))
    if len(sizes) > 100:
        assert sum(sizes) >= 0.9 * sum(b.capacity for b in bins)
    assert packing.pack([], lengths) == []


def check(rows, texts):
    held, bins = defaultdict(list), defaultdict(list)
    for row in rows:
        held[row.doc_id].append((row.start, row.size))
        bins[row.bin].append((row.bin_start, row.size, row.capacity))
    for doc, text in texts.items():
        size, at = len((text or "").encode()), 0
        for start, length in sorted(held[doc]):
            assert start == at and length > 0
            at += length
        assert at == size
    for content in bins.values():
        at = 0
        for start, size, capacity in sorted(content):
            assert start == at
            at += size
        assert at <= capacity and capacity == min(c for c in packing.LENGTHS if c >= at) and len({c for _, _, c in content}) == 1


def test_every_byte_has_one_place(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_GROUP", 50)
    rng = random.Random(2)
    texts = {i: "é" * rng.randrange(3000) for i in range(300)} | {1000: None, 1001: "", 1002: "x" * 50_001, 1003: "x" * 8192}
    docs = spark.createDataFrame([(i, text, 1, 2) for i, text in texts.items()], "doc_id long, text string, size int, bin int")
    check(packing.pack_documents(docs).collect(), texts)
    assert packing.pack_documents(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "ab"), (1, "ab"), (None, "c")], "doc_id long, text string")
    assert sorted((row.doc_id or 0, row.size) for row in packing.pack_documents(twice).collect()) == [(0, 1), (1, 2), (1, 2)]


def test_opens_what_pieces_to_come_will_fill():
    # Two of 6 would leave 3 of 15 empty, and nothing that comes fits there; 6 and 4 fill 10.
    assert [b.capacity for b in packing.pack([6, 6, 4, 4], (10, 15), 1.0)] == [10, 10]
    assert [b.capacity for b in packing.pack([6, 6, 4, 3], (10, 15), 1.0)] == [15, 10]


def test_groups_stay_small_where_all_rows_have_one_id_or_none(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_GROUP", 50)
    docs = spark.createDataFrame([(None if i % 2 else 7, "x" * 10) for i in range(1000)], "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    assert len(rows) == 1000 and sum(row.doc_id is None for row in rows) == 500
    per_group = defaultdict(int)
    for row in rows:
        per_group[row.bin % 20] += 1
    assert len(per_group) == 20 and max(per_group.values()) < 100


def test_query_places_the_given_table(spark, sf_dir):
    from clickloom.llm.queries import QUERIES

    rows = QUERIES["op6_best_fit_packing"].build(spark, sf_dir).collect()
    check(rows, {row.doc_id: row.text for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()})
