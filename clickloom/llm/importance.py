"""Importance resampling towards a target distribution, on hashed n-grams.

Texts are worked on as UTF-8 bytes: a table of 256 entries puts A-Z in lower case and blanks every other ASCII character that
is no digit or letter, ``bytes.split`` yields the words, and the CRC-32 of an n-gram extends that of the n-gram one word
shorter, so every feature costs one step. Bytes from 0x80 on stay as they are: characters beyond ASCII are parts of words.

Each task counts the buckets of its texts in a ``Counter``; one row per bucket and task goes to the shuffle. The table of gains
has as many numbers as there are buckets, whatever the input. Documents are then weighted in a second scan, and those drawn
are numbered by a sort by range, so that neither step needs all documents in one place.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.arrow_text import slices
from clickloom.llm.components import reliable

WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
TABLE = bytes(low if low in WORD_BYTES else 0x20 for low in (b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256)))


@dataclass(frozen=True)
class Sampling:
    """``longest``: words in the longest n-gram; ``percent`` of the texts of ``min_words`` words or more are drawn."""

    longest: int = 1
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 10
    seed: int = 2024


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def features(own: list[bytes], longest: int, buckets: int) -> Counter:
    """How often the n-grams of 1 to ``longest`` of the words fall into each bucket."""
    crc = zlib.crc32
    if longest == 1:
        out: Counter = Counter()
        for word, n in Counter(own).items():
            out[crc(word) % buckets] += n
        return out
    grams = [crc(word) for word in own]
    out = Counter(seed % buckets for seed in grams)
    spaced = [b" " + word for word in own]
    for n in range(1, longest):  # the n-gram that starts at a word grows by the word n places on
        grams = [crc(word, seed) for seed, word in zip(grams, spaced[n:])]
        out.update(seed % buckets for seed in grams)
    return out


def _binary(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


def bucket_counts(df: DataFrame, text_col: str, plan: Sampling) -> DataFrame:
    """(bucket, n) of all features of all texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for text in _binary(part):
                    total.update(features(words(text), plan.longest, plan.buckets))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["bucket", "n"])

    made = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(work, "bucket int, n long")
    return made.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """Thousandths of the log ratio of each bucket's smoothed share in the target to that in the raw texts, floored."""
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    s, t = [0] * buckets, [0] * buckets
    for row in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():  # at most one row a bucket
        s[row["bucket"]], t[row["bucket"]] = row["s"], row["t"]
    raw_all, target_all = sum(s), sum(t)
    return [math.floor(1000 * math.log((t[b] + 1) * (raw_all + buckets) / ((s[b] + 1) * (target_all + buckets)))) for b in range(buckets)]


def noise(seed: int, name: str) -> int:
    """The Gumbel noise of a document in thousandths, floored."""
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, table: list[int], plan: Sampling, id_col: str, text_col: str) -> DataFrame:
    """Per document the id, ``n_words``, ``n_features``, ``weight`` and ``score``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n_words, n_features, weight, score = [], [], [], []
                for text, name in zip(_binary(part), part.column("name").to_pylist()):
                    own = words(text)
                    counts = features(own, plan.longest, plan.buckets)
                    n_words.append(len(own))
                    n_features.append(counts.total())
                    weight.append(sum(table[bucket] * n for bucket, n in counts.items()))
                    score.append(weight[-1] + noise(plan.seed, name))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(values, pa.int64()) for values in (n_words, n_features, weight, score))],
                    ["id", "n_words", "n_features", "weight", "score"])

    own = F.col(id_col)
    source = docs.select(own.alias("id"), F.coalesce(own.cast("string"), F.lit("")).alias("name"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(work, f"id {kind}, n_words long, n_features long, weight long, score long")


def draw(scored: DataFrame, plan: Sampling) -> DataFrame:
    """Adds ``rank`` to the highest ``percent`` of the scores of long enough texts, 1 for the highest; null for the others.

    The score at the border is found from counts per score; only what reaches it is sorted, by range. Rows equal in score and id
    are told apart by their place in the stored table.
    """
    stored = reliable(scored.withColumn("_row", F.monotonically_increasing_id()))
    fit = stored.where(F.col("n_words") >= plan.min_words)
    wanted = fit.count() * plan.percent // 100
    if not wanted:
        return stored.drop("_row").withColumn("rank", F.lit(None).cast("long"))
    # The range of the score at the border is cut into 1024 cells at most, again and again, until it is one score.
    low, high = fit.agg(F.min("score"), F.max("score")).first()
    above, width = 0, -(-(high - low + 1) // 1024)
    while True:
        inside = fit.where(F.col("score").between(low, high))
        cells = inside.groupBy(F.expr(f"(score - {low}) div {width}").alias("cell")).agg(F.count("*").alias("n"))
        for row in sorted(cells.collect(), reverse=True):
            if above + row["n"] >= wanted:
                break
            above += row["n"]
        low = low + row["cell"] * width
        high = min(high, low + width - 1)
        if width == 1:
            break
        width = -(-width // 1024)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("_row")]
    ordered = reliable(fit.where(F.col("score") >= low).select("id", "score", "_row").repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    ranks = ordered.withColumn("place", place).join(F.broadcast(offsets), "_part").select("_row", (F.col("before") + F.col("place")).alias("rank"))
    return stored.join(ranks.where(F.col("rank") <= wanted), "_row", "left").drop("_row")


def resample(docs: DataFrame, target: DataFrame, plan: Sampling = Sampling(), id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text") -> DataFrame:
    """Per document the id, ``n_words``, ``n_features``, ``weight`` (sum of its features' gains), ``score`` (weight and noise) and
    ``rank`` (long) among the drawn, null if not drawn.

    Ties in score go to the smaller id. A null text has no words and no features; it weighs 0 and isn't drawn unless ``min_words`` is 0.
    A null id is hashed as an empty name and comes last in ties. Repeated rows count and are drawn each by itself, with ranks of
    their own. Without target texts every bucket's share is that of smoothing alone. An empty table gives none. Other columns,
    whatever their names, play no part.
    """
    table = gains(bucket_counts(docs, text_col, plan), bucket_counts(target, target_col, plan), plan.buckets)
    drawn = draw(weigh(docs, table, plan, id_col, text_col), plan)
    return drawn.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
