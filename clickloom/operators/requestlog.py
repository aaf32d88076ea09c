"""Latency summary of a request log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from clickloom.functions import text
from clickloom.operators.ordering import bucket_limits, running_totals

# The reported percentiles.
PERCENTILES = (50, 95, 99)


def latency_summary(log: DataFrame, limits: Sequence[float] | None = None) -> DataFrame:
    """Count, mean, nearest-rank p50/p95/p99 and maximum of ``duration_ms`` per ``path``.

    A percentile is the value at position ``round(share * (n - 1))``, halves to even. Equal
    durations are combined first and positions come from bucketed running counts, so a path with
    most of the log still spreads over many tasks.
    """
    if limits is None:
        limits = bucket_limits(log, "duration_ms")
    counts = (
        log.select(text.known_id(F.col("path")).alias("path"), F.col("duration_ms").cast("double").alias("duration_ms"))
        .where(F.col("duration_ms").isNotNull())
        .groupBy("path", "duration_ms")
        .agg(F.count("*").alias("rows"))
    )
    placed = running_totals(counts, ["path"], "duration_ms", ["rows"], limits)

    def nearest_rank(percent: int):
        place = F.bround(F.lit(percent / 100.0) * (F.col("all_rows") - 1))
        return F.min(F.when(F.col("cum_rows") > place, F.col("duration_ms"))).alias(f"p{percent}_ms")

    return placed.groupBy("path").agg(
        F.sum("rows").alias("count"),
        (F.sum(F.col("duration_ms") * F.col("rows")) / F.sum("rows")).alias("mean_ms"),
        *[nearest_rank(percent) for percent in PERCENTILES],
        F.max("duration_ms").alias("max_ms"),
    )
