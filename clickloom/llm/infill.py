"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, and its blocks are exchanged in place.

Sentinels are put before the three blocks in one bytearray, in the order of the text; what has to change places is then
exchanged by three reversals (each half, then the whole), and restoring a text inverts that rotation and takes the sentinels
out again. Cuts lie between tokens, runs of ASCII letters or any other single character, found as a mask over the bytes.

A sentinel starts with its only ``<`` and ends with its only ``>``, so next to a text without sentinels none can arise across
a border: each occurs exactly once in an output, and the text comes back byte for byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.arrow_text import slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Plan:
    """What is done with how many texts: ``rate`` percent are cut, of those ``spm_rate`` percent with the suffix first."""

    seed: int = 1
    rate: int = 90
    spm_rate: int = 20


def _rotate(block: np.ndarray, left: int) -> None:
    """Exchanges the first ``left`` bytes of a block with the others, by three reversals in place."""
    for part in (block[:left], block[left:], block):
        half = len(part) // 2
        front = part[:half].copy()
        part[:half] = part[len(part) - half :][::-1]
        part[len(part) - half :] = front[::-1]


def token_starts(data: np.ndarray) -> np.ndarray:
    """Byte offsets at which the tokens of a UTF-8 text start."""
    letter = ((data | 0x20) - np.uint8(0x61)) < 26
    start = (data & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(start)


def _draws(seed: int, name: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform_text(text: bytes, name: str, plan: Plan) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of tokens, form, code points of prefix and middle (None if plain), and the output."""
    data = np.frombuffer(text, dtype=np.uint8)
    starts = token_starts(data)
    n = len(starts)
    h1, h2, h3, h4 = _draws(plan.seed, name)
    if not n or h3 % 100 >= plan.rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, text
    ends = [int(starts[k]) if k < n else len(text) for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    buffer = bytearray(text)
    for place, mark in ((ends[1], SUFFIX), (ends[0], MIDDLE), (0, PREFIX)):
        buffer[place:place] = mark
    spm = h4 % 100 < plan.spm_rate
    first = 0 if spm else ends[0] + len(PREFIX)  # where the block starts that the suffix changes places with
    _rotate(np.frombuffer(buffer, dtype=np.uint8)[first:], ends[1] + len(PREFIX + MIDDLE) - first)
    return n, SPM if spm else PSM, int(chars[ends[0]]), int(chars[ends[1]] - chars[ends[0]]), bytes(buffer)


def restore_text(output: bytes, form: str) -> bytes:
    """The text an output was made of."""
    if form == PLAIN:
        return output
    buffer = bytearray(output)
    first = output.index(SUFFIX)
    _rotate(np.frombuffer(buffer, dtype=np.uint8)[first:], output.index(MIDDLE if form == PSM else PREFIX) - first)
    for mark in (PREFIX, MIDDLE, SUFFIX):
        place = buffer.index(mark)
        del buffer[place : place + len(mark)]
    return bytes(buffer)


def _bytes(column: pa.Array) -> Iterator[bytes]:
    return (value or b"" for value in column.cast(pa.large_binary()).to_pylist())


def fill_in_middle(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the id, ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``.

    Cuts, form and order follow from a hash of seed and id, so a repeated run, a lost task and a repeated row give the same;
    a null id counts as an empty name. A null text is an empty one; empty texts and texts that hold a sentinel stay plain.
    Texts are worked on one by one and whole, whatever their length. Other columns of ``docs``, whatever their names, play
    no part. An empty table gives none.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                names = part.column("name").to_pylist()
                made = [transform_text(text, name, plan) for text, name in zip(_bytes(part.column("text")), names)]
                n, form, before, middle, output = zip(*made) if made else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array([o.decode() for o in output], pa.string())],
                    ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    own = F.col(id_col)
    source = docs.select(own.alias("id"), F.coalesce(own.cast("string"), F.lit("")).alias("name"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    made = source.mapInArrow(work, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def restored(df: DataFrame, output_col: str = "output", form_col: str = "form", text_col: str = "restored") -> DataFrame:
    """``df`` with the text rebuilt from output and form. A null output gives an empty text; an existing ``text_col`` goes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, output_col):
                pairs = zip(_bytes(part.column(output_col)), part.column(form_col).to_pylist())
                texts = pa.array([restore_text(output, form or PLAIN).decode() for output, form in pairs], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, text_col])

    source = df.drop(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    return source.mapInArrow(work, f"{fields}, `{text_col}` string")
