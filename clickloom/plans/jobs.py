"""The drift report and batch scoring jobs."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from clickloom.operators import drift
from clickloom.operators.model import UNAVAILABLE, Predictor
from clickloom.operators.prediction import fallback_score
from clickloom.session import work_path
from clickloom.sources.sinks import write_metric_tables


def drift_tables(frame: DataFrame) -> dict[str, DataFrame]:
    """All drift tables of a prepared drift frame."""
    return {
        "summary": drift.ctr_delta(frame),
        "periods": drift.period_summary(frame),
        "ctr_over_time": drift.ctr_by_day(frame),
        "impressions_over_time": drift.volume_by_hour(frame),
        "top_character_concentration": drift.concentration(frame),
        "distributions": drift.distribution_by_period(frame),
        "feature_shift": drift.feature_shift(frame),
        "top_values": drift.top_values(frame),
    }


def write_drift_report(
    impressions: DataFrame,
    characters: DataFrame,
    folder: str,
    order_col: str | None = None,
    as_of: str | None = None,
) -> None:
    """Builds the drift frame once, stores the columns the tables need, and writes the tables."""
    frame = drift.prepare_drift_frame(impressions, characters, order_col, as_of)
    needed = ["period", "click", "event_day", "event_hour_bucket", "character_id", *drift.DRIFT_FEATURES]
    frame.select(*needed).write.mode("overwrite").parquet(f"{folder}/frame")
    stored = frame.sparkSession.read.parquet(f"{folder}/frame")
    write_metric_tables(drift_tables(stored), folder)


def score_batch(
    contexts: DataFrame,
    predictor: Predictor,
    folder: str,
    characters: DataFrame | None = None,
    order_col: str | None = None,
    batches: int = 1,
) -> dict[int, str]:
    """Scores context rows and writes them as Parquet, in ``batches`` parts of about equal size under ``folder/batch=<n>``.

    A part whose job fails, because the model or its files break inside a task, is written again with fallback scores and
    the reason first; the other parts keep the model's scores. Every row is thus written once. Returns the error by part.
    """
    spark = contexts.sparkSession
    if batches > 1:
        # Dealt once by a hash of the whole row, so that each part is read by itself and a repeated job gets the same rows.
        staged = work_path(spark, "contexts")
        part = F.pmod(F.xxhash64(*[F.col(name).cast("string") for name in contexts.columns]), F.lit(batches))
        contexts.withColumn("_batch", part).write.partitionBy("_batch").parquet(staged)
        stored = spark.read.schema(f"{contexts.schema.toDDL()}, _batch int").parquet(staged)
        parts = [stored.where(F.col("_batch") == number).drop("_batch") for number in range(batches)]
    else:
        parts = [contexts]
    failed = {}
    for number, rows in enumerate(parts):
        path = f"{folder}/batch={number}"
        try:
            predictor.score(rows, characters, order_col).write.mode("overwrite").parquet(path)
        except (PySparkException, Py4JJavaError) as error:
            failed[number] = type(error).__name__
            plain = fallback_score(rows, predictor.prior, predictor.reason, predictor.version)
            first = F.array(F.lit(UNAVAILABLE + failed[number]))
            plain.withColumn("reasons", F.concat(first, F.col("reasons"))).write.mode("overwrite").parquet(path)
    return failed
