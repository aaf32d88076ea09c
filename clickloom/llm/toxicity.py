"""Toxicity by a classifier chain of sparse linear models.

The categories have an order. The model of a category sees which telling words a text has, and the log odds that the
models before it give. Those are out of fold when a model is trained: a row's odds come from models that have not seen the
row nor a copy of its text, as will be so for new rows. Fitting takes a bounded sample of labelled rows; scoring reads every
whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.arrow_text import Words, letter_words, slices

FOLDS = 3
BEGINNINGS = (5, 7)
"""Lengths of the word beginnings that are features beside whole words."""
THRESHOLD = 0.5
"""Probability from which a category counts as present."""


class Chain(NamedTuple):
    """``weights`` has a row for each category: one weight a word, one for each category before it, and the constant."""

    categories: list[str]
    words: list[str]
    weights: np.ndarray


def _features(words: Words) -> list[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """What words are looked up by: themselves, and their beginnings if they are longer, written with a star.

    For each kind: which occurrences have the feature, the code of the feature by distinct word, and the distinct features.
    """
    kinds = [(np.ones(len(words.code), dtype=bool), np.arange(len(words.distinct)), words.distinct)]
    lengths = pc.utf8_length(words.distinct).to_numpy(zero_copy_only=False)
    for n in BEGINNINGS:
        coded = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words.distinct, 0, n), *(pa.scalar(x, words.distinct.type) for x in ("*", ""))).dictionary_encode()
        kinds.append(((lengths > n)[words.code], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary))
    return kinds


def _distinct_features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """For each kind of feature, each feature of each text once: text, code and the distinct features."""
    for has, code_of, distinct in _features(words):
        pairs = np.unique(words.text[has].astype(np.int64) * (len(distinct) + 1) + code_of[words.code[has]])
        yield *np.divmod(pairs, len(distinct) + 1), distinct


def _known_features(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which features of the vocabulary each text has: text and place in the vocabulary, each pair once."""
    words = letter_words(texts)
    pairs = [np.zeros(0, dtype=np.int64)]
    for has, code_of, distinct in _features(words):
        found = pc.index_in(distinct, value_set=vocabulary.cast(distinct.type))
        place = pc.fill_null(found, -1).to_numpy(zero_copy_only=False)[code_of] if len(distinct) else np.zeros(0, dtype=np.int64)
        hit = place[words.code] if len(words.code) else np.zeros(0, dtype=np.int64)
        keep = has & (hit >= 0)
        pairs.append(words.text[keep].astype(np.int64) * len(vocabulary) + hit[keep])
    return np.divmod(np.unique(np.concatenate(pairs)), max(1, len(vocabulary)))


def _odds(rows: np.ndarray, cols: np.ndarray, count: int, extra: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log odds of one category; ``extra``: log odds of the categories before it."""
    n_words = len(weights) - extra.shape[1] - 1
    linear = np.bincount(rows, weights[:n_words][cols], count) if len(rows) else np.zeros(count)
    return linear + extra @ weights[n_words:-1] + weights[-1]


def _train(rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, target: np.ndarray, n_words: int, penalty: float = 1.0,
           rounds: int = 300) -> np.ndarray:
    """Logistic regression with a quadratic penalty by accelerated gradient steps, scaled by each column's curvature."""
    count = len(target)
    scale = np.concatenate([np.bincount(cols, minlength=n_words) if len(cols) else np.zeros(n_words), (extra**2).sum(axis=0), [count]])
    step = 1.0 / (0.25 * scale * 4 + penalty)
    weights = np.zeros(n_words + extra.shape[1] + 1)
    ahead, momentum = weights, 1.0
    for _ in range(rounds):
        wrong = 1 / (1 + np.exp(-np.clip(_odds(rows, cols, count, extra, ahead), -30, 30))) - target
        slope = np.concatenate([np.bincount(cols, wrong[rows], n_words) if len(cols) else np.zeros(n_words), extra.T @ wrong, [wrong.sum()]])
        slope[:-1] += penalty * ahead[:-1]
        new = ahead - step * slope
        grown = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        if slope @ (new - weights) > 0:  # overshot: begin the acceleration anew
            grown, ahead = 1.0, new
        else:
            ahead = new + (momentum - 1) / grown * (new - weights)
        weights, momentum = new, grown
    return weights


def train_chain(rows: np.ndarray, cols: np.ndarray, targets: np.ndarray, fold: np.ndarray, n_words: int) -> np.ndarray:
    """One row of weights a category (columns of ``targets``), padded to one length."""
    count, n = targets.shape
    extra, out = np.zeros((count, 0)), np.zeros((n, n_words + n))
    for category in range(n):
        target = targets[:, category]
        whole = _train(rows, cols, extra, target, n_words)
        out[category, : n_words + category], out[category, -1] = whole[:-1], whole[-1]
        unseen = np.zeros(count)
        for part in range(FOLDS):
            rest = fold != part
            number = np.cumsum(rest) - 1
            of_rest = rest[rows] if len(rows) else np.zeros(0, dtype=bool)
            model = _train(number[rows[of_rest]], cols[of_rest], extra[rest], target[rest], n_words)
            unseen[~rest] = _odds(rows, cols, count, extra, model)[~rest]
        extra = np.column_stack([extra, np.clip(unseen, -8, 8)])
    return out


def chain_chances(rows: np.ndarray, cols: np.ndarray, count: int, weights: np.ndarray) -> np.ndarray:
    """Probability of each category (columns) for each text."""
    n = len(weights)
    n_words, extra = weights.shape[1] - n, np.zeros((count, 0))
    for category in range(n):
        own = np.concatenate([weights[category, : n_words + category], weights[category, -1:]])
        extra = np.column_stack([extra, np.clip(_odds(rows, cols, count, extra, own), -8, 8)])
    return 1 / (1 + np.exp(-extra))


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text",
        max_positive: int = 6000, max_negative: int = 12_000, max_words: int = 2000, least_z: float = 4.0) -> Chain:
    """Fits the chain on a bounded sample of labelled rows, chosen by a hash of the id.

    ``categories``: conditions on ``labels``, in the order of the chain. Of rows in the last category or the one before it
    at most ``max_positive`` are taken, of the others ``max_negative``. Repeated labels of an id count as one that has each
    category any of them has; a null condition counts as false; ids without a text are skipped. Words are features if their
    share of texts in some category differs by ``least_z`` standard errors, at most ``max_words`` of them.
    """
    names = list(categories)
    flags = labels.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), *[F.coalesce(c, F.lit(False)).cast("int").alias(f"c{i}") for i, c in enumerate(categories.values())])
    flags = flags.groupBy("id").agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(len(names))])
    rare = F.greatest(*[F.col(f"c{i}") for i in range(max(0, len(names) - 2), len(names))], F.lit(0)) == 1
    by_hash = [F.xxhash64("id", F.lit("toxicity")), "id"]
    sample = flags.where(rare).orderBy(*by_hash).limit(max_positive).unionByName(
        flags.where(~rare).orderBy(*by_hash).limit(max_negative))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # At most max_positive + max_negative rows of a few numbers are broadcast.
    rows = texts.join(F.broadcast(sample), "id").withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for text, code, distinct in _distinct_features(letter_words(part.column("text"))):
                    seen = np.bincount(code, minlength=len(distinct)).astype(np.int64)
                    columns = [distinct.cast(pa.string()), pa.array(seen)]
                    for i in range(len(names)):
                        flag = part.column(f"c{i}").to_numpy(zero_copy_only=False)
                        columns.append(pa.array(np.bincount(code, flag[text], len(distinct)).astype(np.int64)))
                    yield pa.RecordBatch.from_arrays(columns, ["word", "n", *[f"c{i}" for i in range(len(names))]])

    sums = ", ".join(f"c{i} long" for i in range(len(names)))
    size = rows.agg(F.count("*").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(names))]).first()
    if not size["n"]:
        return Chain(names, [], np.concatenate([np.zeros((len(names), len(names) - 1)), np.full((len(names), 1), -8.0)], axis=1))
    words = rows.mapInArrow(telling, f"word string, n long, {sums}").groupBy("word").agg(
        F.sum("n").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(names))])
    scores = []
    for i in range(len(names)):
        base = (size[f"c{i}"] or 0) / size["n"]
        spread = max(base * (1 - base), 1e-9)
        scores.append(F.abs(F.col(f"c{i}") / F.col("n") - F.lit(base)) / F.sqrt(F.lit(spread) / F.col("n")))
    strength = F.greatest(*scores) if len(scores) > 1 else scores[0]
    chosen = words.where(F.col("n") >= 3).withColumn("z", strength).where(F.col("z") >= least_z)
    vocabulary = sorted(row["word"] for row in chosen.orderBy(F.desc("z"), "word").limit(max_words).select("word").collect())
    lookup = pa.array(vocabulary, pa.string())

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, place = _known_features(part.column("text"), lookup)
                ends = np.cumsum(np.bincount(text, minlength=len(part)))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(place, pa.int32()))
                columns = [part.column(name) for name in kept]
                yield pa.RecordBatch.from_arrays([*columns, lists], [*kept, "words"])

    kept = ["key", "fold", *[f"c{i}" for i in range(len(names))]]
    ints = ", ".join(f"c{i} int" for i in range(len(names)))
    keyed = rows.withColumn("key", F.xxhash64("id", "text"))
    # Bounded by the sample, and kept as Arrow: a few numbers a row. The order of rows doesn't depend on tasks.
    found = keyed.mapInArrow(featured, f"key long, fold int, {ints}, words array<int>").toArrow()
    found = found.take(pa.array(np.argsort(found.column("key").to_numpy(), kind="stable")))
    lists = found.column("words").combine_chunks()
    cols = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.repeat(np.arange(len(found)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    targets = np.stack([found.column(f"c{i}").to_numpy() for i in range(len(names))], axis=1).astype(float)
    weights = train_chain(at, cols, targets, found.column("fold").to_numpy(), len(vocabulary))
    return Chain(names, vocabulary, weights)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Probability of each category for each whole text: the id and a column ``p_<category>`` each.

    A null or empty text has no words and gets what the constants say. Equal texts get equal results, repeated rows each
    have one, an empty table gives none, and other columns of ``docs`` don't matter. The chain (at most ``max_words`` words)
    goes with the tasks.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{category}" for category in chain.categories]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(shipped.value.words, pa.string())
        for batch in batches:
            for part in slices(batch, "text"):
                text, place = _known_features(part.column("text"), vocabulary)
                chances = chain_chances(text, place, len(part), shipped.value.weights)
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(chances[:, i]) for i in range(len(names))]],
                                                 [id_col, *names])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(work, f"`{id_col}` {kind}, " + ", ".join(f"`{name}` double" for name in names))


def with_rejection(docs: DataFrame, chain: Chain, category: str, threshold: float = THRESHOLD, text_col: str = "text",
                   name: str = "rejected") -> DataFrame:
    """``docs`` as it is, with a column ``name``: whether the category's probability reaches the threshold."""
    shipped = docs.sparkSession.sparkContext.broadcast(chain)
    place = chain.categories.index(category)

    @F.pandas_udf("boolean")
    def rejected(texts):
        import pandas as pd

        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        out = []
        for part in slices(batch, "text"):
            text, word = _known_features(part.column("text"), pa.array(shipped.value.words, pa.string()))
            out.append(chain_chances(text, word, len(part), shipped.value.weights)[:, place] >= threshold)
        return pd.Series(np.concatenate(out) if out else [], dtype=bool)

    return docs.withColumn(name, rejected(F.col(text_col)))
