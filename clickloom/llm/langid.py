"""Language identification by unigram pieces, with all segmentations of a word summed.

The pieces are those of a fixed public vocabulary. Per language the operator learns a probability for each piece, and a
word's probability is the sum over all ways to cut it into pieces (a forward pass over the word). A text's score for a
language is the product over its words. Learning (a few rounds of expectation maximisation over the same lattice) takes a
bounded sample of labelled rows; predicting reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.arrow_text import letter_words, slices

WORD_START = "▁"
WINDOW = 48
"""A longer run of letters is scored window by window, and the sums over segmentations are carried from one to the next, so that
memory is bounded and every segmentation counts. Sums are logarithms: nothing underflows. Learning, which takes a bounded
sample, cuts runs into pieces of this length."""
MAX_WORDS = 400_000
"""Words whose scores are remembered per task."""
FLOOR = 1e-9
"""Probability of a character that is no piece of the vocabulary."""
UNDETERMINED = "und"

BASE = np.uint64(0x9E3779B97F4A7C15)
BITS = np.uint64(32)


class Lattice(NamedTuple):
    """Pieces of the vocabulary by length: sorted hashes and the numbers of the pieces."""

    hashes: dict[int, np.ndarray]
    numbers: dict[int, np.ndarray]
    size: int


def read_pieces(path: str) -> list[str]:
    """Pieces of letters, with or without the mark of a word's start; control, byte and other pieces are left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i)]
    return sorted({piece.lower() for piece in pieces if piece.removeprefix(WORD_START).isalpha()} | {WORD_START})


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, one word a row."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1).astype(np.uint64)


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + (codes[:, i] + np.uint64(1)) * (BASE >> np.uint64(7))
    return out


def build_lattice(pieces: list[str]) -> Lattice:
    hashes, numbers = {}, {}
    for length in sorted({len(piece) for piece in pieces}):
        own = [i for i, piece in enumerate(pieces) if len(piece) == length]
        values = _prefix_hashes(_codes([pieces[i] for i in own]))[:, -1]
        order = np.argsort(values)
        hashes[length], numbers[length] = values[order], np.array(own)[order]
    return Lattice(hashes, numbers, len(pieces))


def _edges(words: list[str], lattice: Lattice) -> dict[tuple[int, int], np.ndarray]:
    """For words of one length: by start and end the piece in between, ``size`` if there is none.

    A single character is always an edge; outside the vocabulary it has the number ``size + 1``, the unknown character.
    """
    before = _prefix_hashes(_codes(words))
    width, out = before.shape[1] - 1, {}
    for length, known in lattice.hashes.items():
        factor = np.uint64(pow(int(BASE), length, 1 << 64))
        for start in range(width - length + 1):
            value = before[:, start + length] - before[:, start] * factor
            place = np.minimum(np.searchsorted(known, value), len(known) - 1)
            found = known[place] == value
            if length == 1:
                out[start, start + 1] = np.where(found, lattice.numbers[1][place], lattice.size + 1)
            elif found.any():
                out[start, start + length] = np.where(found, lattice.numbers[length][place], lattice.size)
    return out


def _logs(chances: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):  # no piece: -inf
        return np.log(chances)


def _forward(edges: dict[tuple[int, int], np.ndarray], width: int, count: int, logs: np.ndarray) -> list[np.ndarray]:
    """Log sums over all segmentations of the first i characters, for each i; ``logs``: pieces x languages."""
    sums = [np.zeros((count, logs.shape[1]))] + [np.full((count, logs.shape[1]), -np.inf) for _ in range(width)]
    for start, end in sorted(edges):
        sums[end] = np.logaddexp(sums[end], sums[start] + logs[edges[start, end]])
    return sums


def _backward(edges: dict[tuple[int, int], np.ndarray], width: int, count: int, logs: np.ndarray) -> list[np.ndarray]:
    sums = [np.full((count, logs.shape[1]), -np.inf) for _ in range(width)] + [np.zeros((count, logs.shape[1]))]
    for start, end in sorted(edges, reverse=True):
        sums[start] = np.logaddexp(sums[start], sums[end] + logs[edges[start, end]])
    return sums


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    lengths = np.array([len(word) for word in words])
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        for some in np.array_split(own, len(own) // 20_000 + 1):
            yield some, [words[i] for i in some]


def chunked(word: str) -> list[str]:
    marked = WORD_START + word
    return [marked[i : i + WINDOW] for i in range(0, len(marked), WINDOW)]


def _rolling(word: str, lattice: Lattice, logs: np.ndarray) -> np.ndarray:
    """Log sum over all segmentations of one long run. Pieces that start in a window may end in the next: the sums at as many
    positions as the longest piece has characters go along."""
    longest = max(lattice.hashes, default=1)
    carried = np.full((longest, logs.shape[1]), -np.inf)
    carried[0] = 0
    for start in range(0, len(word), WINDOW):
        text = word[start : start + WINDOW + longest - 1]
        sums = np.full((WINDOW + longest, logs.shape[1]), -np.inf)
        sums[:longest] = carried
        for (a, b), number in sorted(_edges([text], lattice).items()):
            if a < WINDOW:
                sums[b] = np.logaddexp(sums[b], sums[a] + logs[number[0]])
        carried = sums[WINDOW:]
        if len(word) - start <= WINDOW:
            return sums[len(word) - start]
    return carried[0]


def log_scores(words: list[str], lattice: Lattice, chances: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    logs, out = _logs(chances), np.zeros((len(words), chances.shape[1]))
    marked = [WORD_START + word for word in words]
    for own, group in _by_length(marked):
        if len(group[0]) <= WINDOW:
            out[own] = _forward(_edges(group, lattice), len(group[0]), len(group), logs)[-1]
        else:
            out[own] = [_rolling(word, lattice, logs) for word in group]
    return out


def learn(counts: dict[str, dict[str, int]], lattice: Lattice, rounds: int = 4, smooth: float = 0.05) -> np.ndarray:
    """Piece probabilities, one column a language in the order of ``counts``, from the words of each language.

    Expectation maximisation from equal chances; ``smooth`` is added to each expected count. The last two rows stand for
    "no piece" (0) and an unknown character (``FLOOR``).
    """
    columns = []
    for words in counts.values():
        flat: dict[str, float] = {}
        for word, count in words.items():
            for chunk in chunked(word):
                flat[chunk] = flat.get(chunk, 0) + count
        texts = list(flat)
        weights = np.array([flat[text] for text in texts], dtype=float)
        groups = [(weights[own], len(group[0]), _edges(group, lattice)) for own, group in _by_length(texts)] if texts else []
        chances = np.full((lattice.size + 2, 1), 1.0 / lattice.size)
        chances[-2:, 0] = 0, FLOOR
        for _ in range(rounds):
            expected, logs = np.zeros(lattice.size + 2), _logs(chances)
            for weight, width, edges in groups:
                ahead = _forward(edges, width, len(weight), logs)
                behind = _backward(edges, width, len(weight), logs)
                for (start, end), numbers in edges.items():
                    use = np.exp(ahead[start][:, 0] + logs[numbers, 0] + behind[end][:, 0] - ahead[-1][:, 0]) * weight
                    expected += np.bincount(numbers, use, lattice.size + 2)
            chances[:-2, 0] = (expected[:-2] + smooth) / (expected[:-2] + smooth).sum()
        columns.append(chances[:, 0])
    return np.stack(columns, axis=1)


class Model(NamedTuple):
    languages: list[str]
    lattice: Lattice
    chances: np.ndarray


def fit(docs: DataFrame, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        rows_per_language: int = 1500, words_per_language: int = 30_000, max_languages: int = 200) -> Model:
    """Learns from a bounded sample: about ``rows_per_language`` rows of each language, chosen by a hash of the id.

    Rows without text or language are skipped; without any other the model knows no language. ``words_per_language`` bounds the distinct words of a language that reach
    the driver (the most frequent; ties by the word), ``max_languages`` the languages (those with most rows).
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    source = source.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = source.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(max_languages).collect()
    if not sizes:
        lattice = build_lattice(read_pieces(pieces_path))
        return Model([], lattice, np.zeros((lattice.size + 2, 0)))
    share = F.create_map(*[F.lit(x) for row in sizes for x in (row["lang"], min(1.0, rows_per_language / row["rows"]))])
    draw = F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1_000_000)) / F.lit(1_000_000.0)
    sample = source.where(F.coalesce(draw, F.lit(0.0)) < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = letter_words(part.column("text"))
                known, row_lang = np.unique(np.array(part.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
                pair, number = np.unique(row_lang[words.text] * (len(words.distinct) + 1) + words.code, return_counts=True)
                lang, code = np.divmod(pair, len(words.distinct) + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(known[lang].tolist(), pa.string()), words.distinct.take(pa.array(code)).cast(pa.string()),
                     pa.array(number, pa.int64())], ["lang", "word", "n"])

    counted = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # The sample bounds these lists; sixteen parts keep a language's words out of one task.
    ranked = (
        counted.groupBy("lang", F.pmod(F.xxhash64("word"), F.lit(16)).alias("part"))
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "word")), asc=False), 1, words_per_language // 16).alias("top"))
        .select("lang", F.explode("top").alias("top")).select("lang", "top.word", "top.n")
    )
    counts: dict[str, dict[str, int]] = {row["lang"]: {} for row in sorted(sizes)}
    for row in ranked.toLocalIterator():
        counts[row["lang"]][row["word"]] = row["n"]
    lattice = build_lattice(read_pieces(pieces_path))
    return Model(list(counts), lattice, learn(counts, lattice))


class _Scorer:
    """Scores of words, remembered up to ``MAX_WORDS``."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.languages)))

    def scores(self, words: list[str]) -> np.ndarray:
        if len(self.place) > MAX_WORDS:
            self.clear()
        fresh = [word for word in words if word not in self.place]
        if fresh:
            self.place.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh))))
            self.rows = np.concatenate([self.rows, log_scores(fresh, self.model.lattice, self.model.chances)])
        return self.rows[[self.place[word] for word in words]]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The most probable language of each whole text, and its share of the probability of all languages.

    Returns the id, the columns in ``keep``, ``lang_pred`` and ``score`` (0 to 1). A text that is null or has no letter
    gets ``und`` and 0, and so does every text if the model knows no language. Of equally probable languages the first by name wins. Equal texts get equal results; an empty table
    gives none. The model (vocabulary x languages) is broadcast; both are bounded.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    languages = np.array(model.languages)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shipped.value)
        for batch in batches:
            for part in slices(batch, text_col):
                if not len(languages):
                    rest, n = [part.column(name) for name in names], len(part)
                    yield pa.RecordBatch.from_arrays([*rest, pa.array([UNDETERMINED] * n, pa.string()), pa.array(np.zeros(n))], [*names, "lang_pred", "score"])
                    continue
                words = letter_words(part.column(text_col))
                total = np.zeros((len(part), len(languages)))
                if len(words.code):
                    scores = scorer.scores(words.distinct.to_pylist())
                    for i in range(len(languages)):
                        total[:, i] = np.bincount(words.text, scores[words.code, i], len(part))
                some = np.bincount(words.text, minlength=len(part)) > 0
                best = total.argmax(axis=1)
                share = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                rest = [part.column(name) for name in names]
                found = pa.array(np.where(some, languages[best], UNDETERMINED).tolist(), pa.string())
                yield pa.RecordBatch.from_arrays([*rest, found, pa.array(np.where(some, share, 0.0))], [*names, "lang_pred", "score"])

    names = [id_col, *keep]
    source = docs.select(*names, text_col)
    schema = ", ".join(f"`{name}` {source.schema[name].dataType.simpleString()}" for name in names)
    return source.mapInArrow(work, f"{schema}, lang_pred string, score double")
