"""Feature pipeline: time, turn and joined dimension features, missing values, the 33-column frame."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions import numeric, temporal, text
from clickloom.operators.joins import join_dimension
from clickloom.schema import (
    CATEGORICAL_FEATURES, CHARACTER_COLUMNS, FEATURE_COLUMNS, NUMERIC_FEATURES, UNKNOWN,
)

_SIDE = "_character"


def add_time_features(df: DataFrame, hour_col: str = "hour") -> DataFrame:
    if hour_col not in df.columns:
        df = df.withColumn(hour_col, F.lit(None).cast("string"))
    hour = text.canonical_text(text.quoted(hour_col), text.type_of(df, hour_col))
    time = F.col("event_timestamp")
    return df.withColumn("event_timestamp", temporal.parse_hour(hour)).withColumns({
        "hour_of_day": temporal.hour_of_day(time),
        "day_of_week": temporal.day_of_week(time),
        "is_weekend": temporal.is_weekend(time),
    })


def _number_or_zero(df: DataFrame, name: str) -> str:
    return numeric.number_or_zero(text.column_sql(df, name), text.type_of(df, name))


def add_turn_features(df: DataFrame) -> DataFrame:
    counts = {
        name: F.expr(numeric.at_least_zero(_number_or_zero(df, name)))
        for name in ("conversation_turn", "session_msg_count")
    }
    ratio = "CASE WHEN session_msg_count > 0 THEN conversation_turn / session_msg_count ELSE 0.0D END"
    return df.withColumns(counts).withColumn("turn_ratio", F.expr(ratio))


def deduplicate_characters(characters: DataFrame, order_col: str | None = None) -> DataFrame:
    """One row per character id: the last by ``order_col``.

    Rows have no order of their own, so without ``order_col`` the largest row by content is kept,
    and content also breaks ties. The aggregate combines before the shuffle, so an id with very many
    copies costs each task one row.
    """
    if "character_id" not in characters.columns:
        characters = characters.withColumn("character_id", F.lit(UNKNOWN))
    keyed = characters.withColumn("character_id", text.known_id(F.col("character_id")))
    ordered, last = last_copy(keyed, order_col)
    if not ordered:
        return keyed.distinct()
    return keyed.groupBy("character_id").agg(last.alias("_last")).select("character_id", *[f"_last.{name}" for name in ordered])


def last_copy(characters: DataFrame, order_col: str | None) -> tuple[list[str], Column]:
    """The columns in which copies of a character are compared, and the aggregate that keeps the last of them."""
    rest = [name for name in characters.columns if name not in ("character_id", order_col)]
    ordered = [order_col, *rest] if order_col else rest
    return ordered, F.max(F.struct(*ordered))


def _age_reference(df: DataFrame, as_of: str | None) -> Column:
    now = F.lit(as_of).cast("timestamp_ntz") if as_of else temporal.utc_now()
    if "event_timestamp" in df.columns:
        event = temporal.to_utc_naive(F.col("event_timestamp"), text.type_of(df, "event_timestamp"))
        return F.coalesce(event, now)
    if "hour" in df.columns:
        return F.coalesce(temporal.parse_hour("CAST(hour AS STRING)"), now)
    return now


def join_character_features(
    impressions: DataFrame,
    characters: DataFrame,
    order_col: str | None = None,
    as_of: str | None = None,
) -> DataFrame:
    """Left join of the deduplicated dimension; its non-null values win over the impression's.

    ``as_of`` replaces the current time where an impression has no event time.
    """
    facts = impressions.withColumn(
        "character_id", text.known_id(text.column_or_default(impressions, "character_id"))
    )
    attributes = [name for name in CHARACTER_COLUMNS if name != "character_id"]
    side = dimension_values(deduplicate_characters(characters, order_col), attributes)
    return merge_dimension(facts, join_dimension(facts, side, "character_id"), as_of)


def merge_dimension(facts: DataFrame, joined: DataFrame, as_of: str | None = None) -> DataFrame:
    """``joined``, which is ``facts`` with ``dimension_values``, with one column for each attribute, and the age."""
    attributes = [name for name in CHARACTER_COLUMNS if name != "character_id"]
    values = {}
    for name in attributes:
        own, kind = text.quoted(name), text.type_of(facts, name)
        value = text.quoted(name + _SIDE)
        if name not in facts.columns:
            values[name] = F.col(value)
        elif name == "created_at":
            values[name] = F.when(F.col("_created"), F.col(value)).otherwise(temporal.to_utc_naive(F.col(own), kind))
        elif name == "num_interactions":
            values[name] = F.expr(f"coalesce({value}, {numeric.to_number(own, kind)})")
        else:
            values[name] = F.expr(f"coalesce({value}, CAST({own} AS STRING))")
    out = joined.withColumns(values).drop("_created", *[name + _SIDE for name in attributes])
    age = temporal.whole_days(F.col("created_at"), _age_reference(out, as_of)).cast("double")
    return out.withColumn("character_age_days", F.greatest(age, F.lit(0.0)))  # greatest skips null


def dimension_values(side: DataFrame, attributes: list[str], keep: Iterable[str] = ("character_id",)) -> DataFrame:
    """Dimension columns parsed once per character, before they meet the impressions, beside the columns to ``keep``."""
    parsed = []
    for name in attributes:
        value, kind = text.column_sql(side, name), text.type_of(side, name)
        if name == "created_at":
            column = temporal.to_utc_naive(F.expr(value), kind)
        elif name == "num_interactions":
            column = F.expr(numeric.to_number(value, kind))
        else:
            column = F.expr(f"CAST({value} AS STRING)")
        parsed.append(column.alias(name + _SIDE))
    created = F.expr(f"{text.column_sql(side, 'created_at')} IS NOT NULL").alias("_created")
    return side.select(*keep, *parsed, created)


def fill_missing_values(df: DataFrame, categorical_columns: Iterable[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """Trimmed category text with "unknown" for missing, numbers with 0 for missing."""
    values = {}
    for name in categorical_columns:
        raw = text.canonical_text(text.column_sql(df, name), text.type_of(df, name))
        values[name] = text.normalize_category(raw)
    for name in NUMERIC_FEATURES:
        values[name] = _number_or_zero(df, name)
    for name in ("num_interactions", "character_age_days"):
        values[name] = numeric.at_least_zero(values[name])
    values["num_interactions_log1p"] = f"log1p({values['num_interactions']})"
    kept = [text.quoted(name) for name in df.columns if name not in values]
    return df.selectExpr(*kept, *[f"{sql} AS {text.quoted(name)}" for name, sql in values.items()])


def add_dimension_defaults(df: DataFrame) -> DataFrame:
    """Dimension columns for data that comes without a character table."""
    return df.withColumns({
        "safety_tier": text.column_or_default(df, "safety_tier", UNKNOWN),
        "creator_type": text.column_or_default(df, "creator_type", UNKNOWN),
        "num_interactions": text.column_or_default(df, "num_interactions", 0.0),
        "character_age_days": text.column_or_default(df, "character_age_days", 0.0),
    })


def build_features(
    impressions: DataFrame,
    characters: DataFrame | None = None,
    order_col: str | None = None,
    as_of: str | None = None,
) -> DataFrame:
    df = impressions.transform(add_time_features).transform(add_turn_features)
    if characters is None:
        df = add_dimension_defaults(df)
    else:
        df = join_character_features(df, characters, order_col, as_of)
    return fill_missing_values(df)


def select_feature_columns(df: DataFrame) -> DataFrame:
    missing = [name for name in FEATURE_COLUMNS if name not in df.columns]
    if missing:
        raise ValueError(f"feature frame is missing columns: {missing}")
    return df.select(*FEATURE_COLUMNS)
