import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import Row

from clickloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def parts():
    with open(PATH, "rb") as file:
        return bpe.coder(tuple(file.readlines()), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(parts):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=parts[0].ranks, special_tokens={})


def random_text(rng, longest):
    pieces = ["a", "b", "th", "e", " ", "  ", "\n", "1", "22", "é", "ü", "中", "😀", "'s", "!", "_", "ing", "\x1c", "²", "zz", "A"]
    return "".join(rng.choice(pieces) for _ in range(rng.randrange(longest)))


@pytest.mark.parametrize("states", [1, 50, bpe.MAX_STATES])
def test_equals_the_library_however_many_states_are_kept(library, monkeypatch, states):
    monkeypatch.setattr(bpe, "MAX_STATES", states)
    with open(PATH, "rb") as file:
        encoder = bpe.Encoder(bpe.read_ranks(file))
    import regex

    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(states)
    for longest in [8, 30, 200] * 150:
        text = random_text(rng, longest)
        assert bpe.encode_text(text, encoder, pattern) == library.encode_ordinary(text), text
    for text in ["", " ", "a" * 3000, "ab" * 3000, " \n" * 500, "<|endoftext|>"]:
        assert bpe.encode_text(text, encoder, pattern) == library.encode_ordinary(text)


def test_full_tables_begin_anew_with_the_same_result(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_PIECES", 5)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 5)
    with open(PATH, "rb") as file:
        encoder = bpe.Encoder(bpe.read_ranks(file))
    import regex

    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(9)
    for _ in range(200):
        text = random_text(rng, 60)
        assert bpe.encode_text(text, encoder, pattern) == library.encode_ordinary(text)


def test_new_pieces_are_read_side_by_side(library, monkeypatch):
    """Only long pieces go byte by byte through the table of states."""
    with open(PATH, "rb") as file:
        encoder = bpe.Encoder(bpe.read_ranks(file))
    import regex

    read = []
    advance = encoder._advance
    monkeypatch.setattr(encoder, "_advance", lambda state, byte: read.append(byte) or advance(state, byte))
    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(2)
    words = ["".join(rng.choice("aeinorstüй") for _ in range(rng.randrange(1, 40))) for _ in range(5000)]
    texts = [" ".join(words[at : at + 100]) for at in range(0, 5000, 100)] + ["", "  a\n b "]
    tokens, counts = bpe.encode_texts(texts, encoder, pattern)
    assert not read
    assert tokens.tolist() == [token for text in texts for token in library.encode_ordinary(text)]
    assert counts.tolist() == [len(library.encode_ordinary(text)) for text in texts]
    monkeypatch.setattr(bpe, "MAX_STATES", 100)
    long = ["".join(rng.choice("aeinorst") for _ in range(size)) for size in [bpe.LONG - 2, bpe.LONG - 1, bpe.LONG, 3000] for _ in range(3)]
    assert bpe.encode_text(" ".join(long), encoder, pattern) == library.encode_ordinary(" ".join(long))
    assert read and len(encoder.hypotheses) <= 100


def test_a_pattern_that_leaves_spaces_out_and_ranks_out_of_order_are_refused(parts):
    import regex

    with pytest.raises(ValueError):
        bpe.encode_text("a b", parts[0], regex.compile(r"\S+"))
    with pytest.raises(ValueError):
        bpe.Encoder({bytes([byte]): byte for byte in range(256)} | {b"abcd": 256, b"ab": 257, b"cd": 258})


def test_decoder_takes_tokens_one_by_one_and_replaces_wrong_bytes(parts):
    encoder, decoder, _ = parts
    for data in [b"", "é中😀!".encode(), b"\xff\xc3(", b"\xe4\xb8", b"\xf0\x9f\x98", b"\xed\xa0\x80a", b"\xc0\xaf", b"a\xe2\x28\xa1"]:
        tokens = [encoder.ranks[bytes([byte])] for byte in data]
        out = "".join(decoder.feed([token]) for token in tokens) + decoder.finish()
        assert out == data.decode(errors="replace")
        assert decoder.feed(tokens) + decoder.finish() == out


def test_single_bytes_are_required():
    with pytest.raises(ValueError):
        bpe.Encoder({b"a": 0})


def test_rows(spark, library):
    texts = [None, "", "hello  world 's é", "hello  world 's é", "x" * 20_000, " ".join(f"w{i}" for i in range(30_000))]
    docs = spark.createDataFrame([Row(doc_id=i, text=text, n_tokens=-1, id=None) for i, text in enumerate(texts)],
                                 "doc_id long, text string, n_tokens int, id string")
    found = {row.doc_id: row for row in bpe.round_trip(docs, PATH, public_tokenizers.PATTERN, with_tokens=True).collect()}
    for i, text in enumerate(texts):
        tokens = library.encode_ordinary(text or "")
        row = found[i]
        assert row.tokens == tokens and row.n_tokens == len(tokens)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_equals_the_library_on_the_given_table(spark, sf_dir, library):
    from clickloom.llm.queries import QUERIES

    found = {row.doc_id: row for row in QUERIES["op1_byte_bpe"].build(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(docs)
    for doc in docs:
        tokens = library.encode_ordinary(doc.text or "")
        row = found[doc.doc_id]
        assert row.n_tokens == len(tokens)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((doc.text or "").encode()).hexdigest()
