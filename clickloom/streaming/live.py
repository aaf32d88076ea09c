"""Structured Streaming forms of scoring, ranking and the click-rate series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from clickloom.functions import temporal
from clickloom.operators import ranking
from clickloom.operators.features import deduplicate_characters
from clickloom.operators.model import Predictor
from clickloom.schema import CONTEXT_SCHEMA, FALLBACK_CTR, MAX_RANK_CANDIDATES, RANK_REQUEST_SCHEMA


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)


def parse_contexts(lines: DataFrame, column: str = "value") -> DataFrame:
    """Context rows from JSON text; fields outside the contract stay in ``extras``."""
    known = [field.name for field in CONTEXT_SCHEMA.fields if field.name != "extras"]
    every = F.from_json(F.col(column), "map<string,string>")
    extras = F.map_filter(every, lambda key, _: ~key.isin(known))
    context = F.from_json(F.col(column), T.StructType([f for f in CONTEXT_SCHEMA.fields if f.name != "extras"]))
    return lines.select(context.alias("context"), extras.alias("extras")).select("context.*", "extras")


def parse_rank_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.from_json(F.col(column), RANK_REQUEST_SCHEMA).alias("request")).select("request.*")


def score_stream(
    contexts: DataFrame,
    predictor: Predictor,
    characters: DataFrame | None = None,
    order_col: str | None = None,
) -> DataFrame:
    """Scores a stream of contexts. The static dimension is deduplicated before the stream meets it."""
    side = None if characters is None else deduplicate_characters(characters, order_col)
    return predictor.score(contexts, side)


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands everything available now to ``work`` in micro-batches and returns the finished query."""
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def score_and_store(
    load: Callable[[], Predictor],
    characters: Callable[[], DataFrame | None],
    folder: str,
    order_col: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """Work for ``run_batches``: scores a micro-batch with the model and the dimension as they are stored at its start.

    Both are read anew for each batch, so a model saved or a character changed meanwhile counts from the next one on. A batch
    owns the folder ``batch=<id>``: replayed after a failure it replaces its own rows and no others.
    """

    def work(batch: DataFrame, number: int) -> None:
        side = characters()
        scored = load().score(batch, None if side is None else deduplicate_characters(side, order_col))
        scored.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return work


def rank_and_reject(
    folder: str, prior: float = FALLBACK_CTR, reason: str | None = None, limit: int = MAX_RANK_CANDIDATES
) -> Callable[[DataFrame, int], None]:
    """Work for ``run_batches``: accepted requests of a micro-batch are ranked under ``ranked``, the others go to ``rejected`` with
    what is wrong with them. The source is read once: the batch is written under ``received`` and both outputs read that, in tasks
    of a bounded part of its files whatever its size. It is deleted when both are there; a replayed batch replaces its own rows in
    all of them."""

    def work(batch: DataFrame, number: int) -> None:
        spark, received = batch.sparkSession, f"{folder}/received/batch={number}"
        batch.write.mode("overwrite").parquet(received)
        kept = spark.read.schema(batch.schema).parquet(received)
        ranking.rank_arrays(kept, prior, reason, limit).write.mode("overwrite").parquet(f"{folder}/ranked/batch={number}")
        rejected_requests(kept, limit).write.mode("overwrite").parquet(f"{folder}/rejected/batch={number}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(received)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    return work


def count_windows(
    folder: str, time_col: str = "ts", click_col: str = "click", window: str = "1 hour", delay: str = "1 hour"
) -> Callable[[DataFrame, int], None]:
    """Work for ``run_batches``: rows and clicks of a micro-batch per time window, and how many of them came late.

    Late is a row whose window had ended ``delay`` or more before the latest time seen in earlier batches. That time is taken
    from what those batches stored, so a replayed batch judges its rows as it did before. ``windows`` sums the batches up.
    """

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        timed = batch.select(event_time(time_col, batch.schema[time_col].dataType).alias("time"), F.col(click_col).alias("click"))
        grouped = timed.groupBy(F.window("time", window)).agg(
            F.count("*").alias("rows"), F.sum(F.col("click").cast("double")).alias("clicks"), F.max("time").alias("latest"))
        closed = None
        if number:
            earlier = _window_parts(spark, folder).where(F.col("batch") < number)
            closed = earlier.agg((F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("closed")).first()["closed"]
        late = F.lit(False) if closed is None else F.col("window.end") <= F.lit(closed)
        parts = grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "rows", "clicks", "latest", late.alias("late"))
        parts.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return work


_PARTS = "start timestamp, end timestamp, rows long, clicks double, latest timestamp, late boolean, batch int"


def _window_parts(spark: SparkSession, folder: str) -> DataFrame:
    """What ``count_windows`` stored: a row per window and batch."""
    return spark.read.schema(_PARTS).parquet(folder)


def windows(spark: SparkSession, folder: str) -> DataFrame:
    """Per window the rows in time with their click rate, and the late rows, which count nowhere else."""
    timely = F.when(~F.col("late"), F.col("rows"))
    table = _window_parts(spark, folder).groupBy("start").agg(
        F.coalesce(F.sum(timely), F.lit(0)).alias("impressions"),
        (F.sum(F.when(~F.col("late"), F.col("clicks"))) / F.sum(timely)).alias("ctr"),
        F.coalesce(F.sum(F.when(F.col("late"), F.col("rows"))), F.lit(0)).alias("late_rows"))
    return table.select(temporal.instant_to_utc(F.col("start")).alias("window_start"), "impressions", "ctr", "late_rows")


def rank_stream(
    requests: DataFrame,
    prior: float = FALLBACK_CTR,
    reason: str | None = None,
    limit: int = MAX_RANK_CANDIDATES,
) -> DataFrame:
    """Ranks the accepted requests of a stream; keeps no state."""
    return ranking.rank_arrays(requests, prior, reason, limit)


def rejected_requests(requests: DataFrame, limit: int = MAX_RANK_CANDIDATES) -> DataFrame:
    gated = ranking.gate_requests(requests, limit)
    return gated.where(F.col("rejection").isNotNull()).select("request_id", "rejection")


def event_time(column: str, kind: T.DataType) -> Column:
    """The zoned timestamp watermarks need; a naive time is taken as UTC."""
    if isinstance(kind, T.TimestampType):
        return F.col(column)
    return F.timestamp_micros(temporal.utc_micros(F.col(column)))


def windowed_ctr(
    events: DataFrame,
    time_col: str = "ts",
    click_col: str = "click",
    window: str = "1 hour",
    watermark: str = "1 hour",
) -> DataFrame:
    """Volume and click rate per time window; rows later than the watermark are dropped on a stream."""
    timed = events.withColumn("_time", event_time(time_col, events.schema[time_col].dataType))
    if events.isStreaming:
        timed = timed.withWatermark("_time", watermark)
    grouped = timed.groupBy(F.window("_time", window)).agg(
        F.count("*").alias("impressions"), F.avg(click_col).alias("ctr")
    )
    start = temporal.instant_to_utc(F.col("window.start"))
    return grouped.select(start.alias("window_start"), "impressions", "ctr")


def run_once(
    stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append"
) -> StreamingQuery:
    """Writes everything available now to files and returns the finished query."""
    query = (
        stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
        .option("path", path).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
