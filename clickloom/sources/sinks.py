"""Result writers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T


def finite_or_null(value: Column, kind: T.DataType) -> Column:
    """NaN and infinite numbers become null, also inside arrays and structs."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: finite_or_null(item, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [finite_or_null(value[field.name], field.dataType).alias(field.name) for field in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def clean_metrics(df: DataFrame) -> DataFrame:
    """Columns sorted by name, without values JSON cannot hold."""
    return df.select(*[
        finite_or_null(F.col(name), df.schema[name].dataType).alias(name) for name in sorted(df.columns)
    ])


# Tables whose size follows the number of values in the data; the others have a few rows a group.
LARGE_TABLES = ("distributions", "slices", "checks", "impressions_over_time")


def write_metric_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "json") -> None:
    """One sub-folder per metric table. A small table becomes one file behind a shuffle of its own, so that what
    computes it stays in parallel; the large ones are written as they come."""
    for name, df in tables.items():
        cleaned = clean_metrics(df) if name in LARGE_TABLES else clean_metrics(df).repartition(1)
        writer = cleaned.write.mode("overwrite").format(fmt)
        (writer.option("ignoreNullFields", False) if fmt == "json" else writer).save(f"{folder}/{name}")


def write_by_day(df: DataFrame, folder: str, day_col: str = "event_day") -> None:
    """Parquet partitioned by day. The rebalance splits large days and merges small ones."""
    df.hint("rebalance", day_col).write.mode("overwrite").partitionBy(day_col).parquet(folder)
