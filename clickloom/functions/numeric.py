"""Numeric expressions: tolerant parsing, clipping, the two probability clips."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# What counts as number text, and the probability limits of metrics and serving.
NUMBER_TEXT = "^[ \t\r\n]*[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|[iI]nf|[iI]nfinity)[ \t\r\n]*$"
METRIC_LIMIT = 1e-6
SERVING_LIMIT = 1e-4


def to_number(sql: str, data_type: T.DataType) -> str:
    """SQL text of a double; bad text and NaN become null."""
    if isinstance(data_type, T.StringType):
        return f"CASE WHEN {sql} RLIKE '{NUMBER_TEXT}' THEN try_cast(trim({sql}) AS DOUBLE) END"
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return f"CASE WHEN NOT isnan({sql}) THEN CAST({sql} AS DOUBLE) END"
    if isinstance(data_type, (T.NumericType, T.BooleanType, T.NullType)):
        return f"CAST({sql} AS DOUBLE)"
    return "CAST(NULL AS DOUBLE)"


def number_or_zero(sql: str, data_type: T.DataType) -> str:
    return f"coalesce({to_number(sql, data_type)}, 0.0D)"


def at_least_zero(sql: str) -> str:
    return f"greatest({sql}, 0.0D)"


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def metric_probability(score: Column) -> Column:
    return clip(score.cast("double"), METRIC_LIMIT, 1.0 - METRIC_LIMIT)


def serving_probability(score: Column) -> Column:
    return F.round(clip(score, SERVING_LIMIT, 1.0 - SERVING_LIMIT), 6)
