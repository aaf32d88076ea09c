import math
import zlib

import numpy as np
import public_tokenizers
import pytest

from clickloom.llm import langid

PATH = public_tokenizers.path("piece_bpe_32k.model")


def by_hand(word, chance):
    """Sum over all segmentations, one after the other."""
    if not word:
        return 1.0
    total = 0.0
    for end in range(1, len(word) + 1):
        piece = word[:end]
        p = chance.get(piece, langid.FLOOR if end == 1 else 0)
        if p:
            total += p * by_hand(word[end:], chance)
    return total


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "ba", "aba", langid.WORD_START, langid.WORD_START + "a"]
    lattice = langid.build_lattice(pieces)
    chances = np.zeros((len(pieces) + 2, 1))
    chances[:-2, 0] = [0.1, 0.2, 0.15, 0.05, 0.2, 0.2, 0.1]
    chances[-1, 0] = langid.FLOOR
    for word in ["a", "abab", "bbbaa", "xa", "ü"]:
        expected = math.log(by_hand(langid.WORD_START + word, dict(zip(pieces, chances[:, 0]))))
        assert langid.log_scores([word], lattice, chances)[0, 0] == pytest.approx(expected)
    long = "ab" * 300
    assert np.isfinite(langid.log_scores([long], lattice, chances)).all()


def test_long_runs_are_summed_over_all_segmentations():
    lattice = langid.build_lattice(langid.read_pieces(PATH))
    rng = np.random.default_rng(1)
    chances = rng.random((lattice.size + 2, 2))
    chances /= chances.sum(axis=0)
    chances[-2:] = 0, langid.FLOOR
    logs = langid._logs(chances)
    letters = list("etaoinshrdluü漢")
    for length in (47, 48, 49, 50, 95, 96, 97, 150, 400):
        word = "".join(rng.choice(letters, length))
        marked = langid.WORD_START + word
        whole = langid._forward(langid._edges([marked], lattice), len(marked), 1, logs)[-1]
        assert langid.log_scores([word], lattice, chances) == pytest.approx(whole)


def test_without_labelled_rows_nothing_is_determined(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    for table in (docs, docs.limit(0)):
        model = langid.fit(table, PATH)
        assert model.languages == []
        assert {tuple(row)[1:] for row in langid.predict(table, model).collect()} <= {("und", 0.0)}
    assert langid.predict(docs, model).count() == 2


def test_learning_raises_the_likelihood():
    lattice = langid.build_lattice(langid.read_pieces(PATH))
    words = {"the": 5, "then": 2, "there": 1, "lathe": 1}
    scores = []
    for rounds in (1, 2, 4, 8):
        chances = langid.learn({"x": words}, lattice, rounds=rounds, smooth=1e-6)
        assert chances[:-2, 0].sum() == pytest.approx(1)
        scores.append(sum(langid.log_scores([word], lattice, chances)[0, 0] * n for word, n in words.items()))
    assert scores == sorted(scores)


def test_predicts_and_handles_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_WORDS", 3)
    rows = [(i, "the house of the rising sun and this" if i % 2 else "das Haus und die Sonne ist nicht hier", "en" if i % 2 else "de", "z") for i in range(40)]
    rows += [(100, None, "en", "z"), (101, "some text", None, "z"), (None, "die Sonne", None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(docs, PATH)
    assert model.languages == ["de", "en"]
    odd = spark.createDataFrame([(1, "the sun"), (1, "the sun"), (2, None), (3, ""), (4, "12 $% 3"), (5, "die Sonne"), (6, "ü" * 50_000), (None, "the")],
                                "doc_id long, text string")
    found = [(row.doc_id, row.lang_pred, row.score) for row in langid.predict(odd, model).collect()]
    assert [pair[:2] for pair in found] == [(1, "en"), (1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "de"), (6, found[6][1]), (None, "en")]
    assert all(0 <= score <= 1 for _, _, score in found) and found[6][1] in ("de", "en")
    assert langid.predict(odd.limit(0), model).count() == 0


def test_query_held_out_accuracy(spark, sf_dir):
    from clickloom.llm.queries import QUERIES

    docs = {row.doc_id: row for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op8_language_id"].build(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1) for row in rows)
    held = [row.lang_pred == docs[row.doc_id].lang for row in rows if row.held_out]
    assert sum(held) >= 0.95 * len(held)


def test_letters_outside_the_vocabulary_leave_the_other_words_their_say(spark):
    pieces = langid.read_pieces(PATH)
    strange = "".join([c for c in map(chr, range(0x3400, 0x4DB0)) if c not in pieces][:60])
    assert len(strange) == 60
    lattice = langid.build_lattice(pieces)
    assert np.isfinite(langid.log_scores([strange], lattice, langid.learn({"x": {"the": 1, strange: 1}}, lattice))).all()
    rows = [(i, "the house of the rising sun and this" if i % 2 else "das Haus und die Sonne ist nicht hier", "en" if i % 2 else "de") for i in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH)
    text = "the house of the rising sun and this " * 50
    docs = spark.createDataFrame([(1, text + strange), (2, strange + " " + text)], "doc_id long, text string")
    for row in langid.predict(docs, model).collect():
        assert row.lang_pred == "en" and 0 <= row.score <= 1
