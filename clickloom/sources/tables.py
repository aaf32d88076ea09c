"""Scans of the impression and character tables (CSV with header, Parquet, ORC or JSON lines)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clickloom.functions import numeric, text
from clickloom.operators.features import build_features
from clickloom.schema import (
    CHARACTER_COLUMNS, CHARACTER_NUMERICS, IMPRESSION_COLUMNS, IMPRESSION_NUMERICS, require_columns,
)

FILE_ORDER = "file_order"


def read_table(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """A file table; CSV cells stay text and are bound to columns by header name."""
    reader = spark.read
    if fmt == "csv":
        reader = reader.options(header=True, escape='"', multiLine=multi_line)
    if fmt == "json":
        reader = reader.option("primitivesAsString", True)
    try:
        return reader.format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no table at {path}") from error
        raise


def normalize_table(df: DataFrame, required: list[str], numerics: list[str]) -> DataFrame:
    """Null texts become null, known numbers become doubles and every other known column is text."""
    values = []
    for name in df.columns:
        sql, kind = text.quoted(name), df.schema[name].dataType
        is_text = isinstance(kind, T.StringType)
        if name in numerics:
            sql = numeric.to_number(f"({text.null_text(sql)})" if is_text else sql, kind)
        elif is_text:
            sql = text.null_text(sql)
        elif name in required and not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            sql = text.canonical_text(sql, kind)
        values.append(f"{sql} AS {text.quoted(name)}")
    return df.selectExpr(*values)


def load_impressions(
    spark: SparkSession, path: str, fmt: str = "csv", validate: bool = True, multi_line: bool = False
) -> DataFrame:
    df = read_table(spark, path, fmt, multi_line)
    if validate:
        require_columns(df.columns, IMPRESSION_COLUMNS, "impressions")
    return normalize_table(df, IMPRESSION_COLUMNS, IMPRESSION_NUMERICS)


def load_characters(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    validate: bool = True,
    multi_line: bool = True,
    with_file_order: bool = False,
) -> DataFrame:
    """Characters. Their descriptions are free text, so quoted cells may hold line breaks unless ``multi_line`` is off; a
    CSV file is then read by one task, which suits a dimension. ``with_file_order`` adds a sortable ``file_order`` for keeping the last row of an id.

    Within a block of a file the generated ids rise in row order, so (file, block, id) is file order.
    """
    df = read_table(spark, path, fmt, multi_line)
    if validate:
        require_columns(df.columns, CHARACTER_COLUMNS, "characters")
    if with_file_order:
        df = df.withColumn(
            FILE_ORDER, F.struct(F.input_file_name(), F.input_file_block_start(), F.monotonically_increasing_id())
        )
    return normalize_table(df, CHARACTER_COLUMNS, CHARACTER_NUMERICS)


def load_training_tables(
    spark: SparkSession, impressions_path: str, characters_path: str, fmt: str = "csv", validate: bool = True, multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Both tables. ``multi_line`` is for impressions with line breaks in quoted cells, whose files can't be split then."""
    return (
        load_impressions(spark, impressions_path, fmt, validate, multi_line),
        load_characters(spark, characters_path, fmt, validate, with_file_order=True),
    )


def load_feature_frame(
    spark: SparkSession, impressions_path: str, characters_path: str, fmt: str = "csv", as_of: str | None = None, multi_line: bool = False
) -> DataFrame:
    impressions, characters = load_training_tables(spark, impressions_path, characters_path, fmt, multi_line=multi_line)
    return build_features(impressions, characters, FILE_ORDER, as_of)
