"""Data quality checks of the input tables: counts, issues, verdict, and the training gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from clickloom.functions import numeric, temporal, text
from clickloom.operators.features import deduplicate_characters
from clickloom.operators.joins import join_dimension
from clickloom.schema import CHARACTER_COLUMNS, IMPRESSION_COLUMNS, missing_columns

CHECK_SCHEMA = "table string, code string, column string, severity string, count bigint"
# Columns whose nulls and negative numbers are counted.
NULL_CHECKS = {"impressions": ["hour", "character_id"], "characters": ["safety_tier", "creator_type"]}
NEGATIVE_CHECKS = {"impressions": ["conversation_turn", "session_msg_count"], "characters": ["num_interactions"]}


def event_hour(df: DataFrame) -> Column:
    return temporal.parse_hour(text.canonical_text("hour", text.type_of(df, "hour")))


def _number(df: DataFrame, name: str) -> Column:
    return F.expr(numeric.to_number(text.quoted(name), text.type_of(df, name)))


def check_row(table: str, code: str, column: str | None, severity: str, count: Column) -> Column:
    return F.struct(
        F.lit(table).alias("table"), F.lit(code).alias("code"), F.lit(column).cast("string").alias("column"),
        F.lit(severity).alias("severity"), count.cast("bigint").alias("count"),
    )


def check_rows(df: DataFrame, checks: list[Column]) -> DataFrame:
    """One aggregate over the table, one output row per check."""
    return df.agg(F.array(*checks).alias("checks")).select(F.inline("checks"))


def _counts(df: DataFrame, table: str) -> list[tuple[str, str | None, str, Column]]:
    """Code, column, severity and count of the checks that read a table by itself."""
    empty = "error" if table == "impressions" else "warning"
    checks: list[tuple[str, str | None, str, Column]] = [
        ("row_count", None, "info", F.count("*")),
        ("empty_table", None, empty, (F.count("*") == 0).cast("int")),
    ]
    if table == "impressions" and "click" in df.columns:
        click = _number(df, "click")
        bad = F.count_if(click.isNull() | ~click.isin(0.0, 1.0))
        checks.append(("invalid_binary_target", "click", "error", bad))
    if table == "impressions" and "hour" in df.columns:
        checks.append(("invalid_hour", "hour", "warning", F.count_if(event_hour(df).isNull())))
    for name in NEGATIVE_CHECKS[table]:
        if name in df.columns:
            negative = F.count_if(_number(df, name) < 0)
            checks.append(("negative_numeric_values", name, "warning", negative))
    for name in NULL_CHECKS[table]:
        if name in df.columns:
            checks.append(("null_values", name, "info", F.count_if(F.col(name).isNull())))
    return checks


def table_counts(df: DataFrame, table: str) -> DataFrame:
    """Row count, empty table, bad clicks and hours, negative numbers and nulls in one aggregate."""
    return check_rows(df, [check_row(table, *check) for check in _counts(df, table)])


def observe_counts(df: DataFrame, table: str) -> tuple[DataFrame, Observation]:
    """The table, and what counts it while the next action reads it, so that the checks need no scan of their own."""
    seen = Observation()
    return df.observe(seen, *[count.cast("bigint").alias(f"c{i}") for i, (*_, count) in enumerate(_counts(df, table))]), seen


def observed_counts(df: DataFrame, table: str, seen: Observation, rows: int) -> DataFrame:
    """The rows of ``table_counts`` from what was observed while ``rows`` rows were written, one for each of the table.

    Spark counts rows twice if tasks are repeated after executors are lost. Then the observed number of rows differs from
    those written, and the table is scanned after all.
    """
    values = seen.get
    if values.get("c0") != rows:
        return table_counts(df, table)
    found = [(table, code, column, severity, values[f"c{i}"]) for i, (code, column, severity, _) in enumerate(_counts(df, table))]
    return df.sparkSession.createDataFrame(found, CHECK_SCHEMA)


def unjoined_ids(impressions: DataFrame, characters: DataFrame) -> DataFrame:
    """Impressions whose character is absent from the dimension, counted per id before the join."""
    ids = impressions.groupBy(text.known_id(F.col("character_id")).alias("character_id")).agg(F.count("*").alias("n"))
    known = characters.select(text.known_id(F.col("character_id")).alias("character_id")).distinct()
    missing = ids.join(known, "character_id", "left_anti")
    count = F.coalesce(F.sum("n"), F.lit(0))
    return check_rows(missing, [check_row("impressions", "unjoined_character_ids", "character_id", "warning", count)])


def duplicate_ids(df: DataFrame, table: str, column: str) -> DataFrame:
    """Rows beyond the first of each id; nulls count as one id."""
    groups = df.groupBy(column).agg(F.count("*").alias("n"))
    count = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return check_rows(groups, [check_row(table, "duplicate_ids", column, "warning", count)])


def future_created(impressions: DataFrame, characters: DataFrame, order_col: str | None = None) -> DataFrame:
    """Impressions earlier than their character's creation, counted per (character, time) before the join."""
    # A null id only meets a null id here, so both become a text no id has.
    def side(df: DataFrame) -> DataFrame:
        key = F.col("character_id").cast("string")
        return df.withColumn("character_id", F.when(key.isNull(), "\x00").otherwise(key))

    created = deduplicate_characters(side(characters), order_col).select(
        "character_id",
        temporal.to_utc_naive(F.col("created_at"), text.type_of(characters, "created_at")).alias("created_at"),
    )
    seen = (
        side(impressions).groupBy("character_id", event_hour(impressions).alias("event_timestamp"))
        .agg(F.count("*").alias("n"))
    )
    joined = join_dimension(seen, created, "character_id").where(F.col("created_at") > F.col("event_timestamp"))
    count = F.coalesce(F.sum("n"), F.lit(0))
    return check_rows(joined, [check_row("characters", "future_created_at", "created_at", "warning", count)])


def _missing(df: DataFrame, table: str, required: list[str]) -> DataFrame:
    rows = [(table, "missing_required_columns", name, "error", 1) for name in missing_columns(df.columns, required)]
    return df.sparkSession.createDataFrame(rows, CHECK_SCHEMA)


def lacking_columns(impressions: DataFrame, characters: DataFrame) -> DataFrame:
    """Required columns that are absent; reads no rows."""
    return _missing(impressions, "impressions", IMPRESSION_COLUMNS).unionByName(_missing(characters, "characters", CHARACTER_COLUMNS))


def input_checks(
    impressions: DataFrame, characters: DataFrame, order_col: str | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """All checks as rows ``(table, code, column, severity, count)``, also those that found nothing.

    ``counted`` are the impressions' own counts if they are known already.
    """
    parts = [
        lacking_columns(impressions, characters),
        table_counts(impressions, "impressions") if counted is None else counted,
        table_counts(characters, "characters"),
    ]
    both_ids = "character_id" in impressions.columns and "character_id" in characters.columns
    if both_ids:
        parts.append(unjoined_ids(impressions, characters))
    if "id" in impressions.columns:
        parts.append(duplicate_ids(impressions, "impressions", "id"))
    if "character_id" in characters.columns:
        parts.append(duplicate_ids(characters, "characters", "character_id"))
    if both_ids and "created_at" in characters.columns and "hour" in impressions.columns:
        parts.append(future_created(impressions, characters, order_col))
    return reduce(DataFrame.unionByName, parts)


def issues(checks: DataFrame) -> DataFrame:
    return checks.where((F.col("severity") != "info") & (F.col("count") > 0))


def verdict(checks: DataFrame) -> DataFrame:
    """One row: ``status`` and the number of error and warning issues.

    All missing columns of one table make one issue.
    """
    found = issues(checks)
    name = F.concat_ws("/", "table", "code", F.when(F.col("code") != "missing_required_columns", F.col("column")))

    def issue_count(severity: str) -> Column:
        return F.count_distinct(F.when(F.col("severity") == severity, name))

    return found.agg(
        F.when(issue_count("error") == 0, "pass").otherwise("fail").alias("status"),
        issue_count("error").alias("error_count"),
        issue_count("warning").alias("warning_count"),
    )


def require_pass(checks: DataFrame) -> None:
    """Stops a training job on any error."""
    if verdict(checks).first()["status"] != "pass":
        raise ValueError("the input tables did not pass the checks")


def check_target(df: DataFrame, target: str = "click") -> DataFrame:
    """The frame with an integer target; raises if a value is missing or not a number."""
    if target not in df.columns:
        raise ValueError(f"there is no column {target} to learn from")
    number = _number(df, target)
    if df.where(number.isNull()).limit(1).count():
        raise ValueError(f"some rows have no number in {target}, which is to be learned")
    return df.withColumn(target, number.cast("int"))
