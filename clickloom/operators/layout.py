"""Impressions and characters stored by character, so that joins between them shuffle neither.

Both go once into tables of the session's catalog, bucketed alike by character and part. A character on more rows than a
bucket should hold is dealt over several parts, and its one row is repeated for each, so no bucket grows with a hot
character. Features and the two checks that join are then read off without an exchange of impressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickloom.functions import temporal, text
from clickloom.operators import quality
from clickloom.operators.features import (
    add_time_features, add_turn_features, dimension_values, fill_missing_values, last_copy, merge_dimension,
)
from clickloom.schema import CHARACTER_COLUMNS
from clickloom.session import materialize

KEY = ["_key", "_part"]
ATTRIBUTES = [name for name in CHARACTER_COLUMNS if name != "character_id"]


@dataclass(frozen=True)
class Layout:
    """Names of the two tables."""

    impressions: str
    characters: str
    buckets: int


def hot_characters(facts: DataFrame, buckets: int) -> DataFrame:
    """``_key`` and ``_parts`` of characters with more rows than an even bucket: fewer than ``buckets`` of them."""
    even = max(1, facts.count()) / buckets
    counts = facts.groupBy("_key").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > even).select("_key", F.ceil(F.col("n") / even).cast("int").alias("_parts"))


def store(impressions: DataFrame, characters: DataFrame, name: str, buckets: int, order_col: str | None = None) -> Layout:
    """Writes ``<name>_impressions`` and ``<name>_characters``, replacing tables of these names.

    Null ids count as "unknown", as in the feature join; of a character's copies the last by ``order_col`` is kept. Rows
    equal in every column stay in one part. Empty tables give empty tables.
    """
    for df, what in ((impressions, "impressions"), (characters, "characters")):
        if "character_id" not in df.columns:
            raise ValueError(f"the {what} have no character_id to be stored by")
    key = text.known_id(F.col("character_id")).alias("_key")
    facts = impressions.select("*", key)
    hot = F.broadcast(materialize(hot_characters(facts.select("_key"), buckets)))  # fewer rows than buckets
    part = F.pmod(F.xxhash64(*[F.col(text.quoted(c)).cast("string") for c in impressions.columns]), F.col("_parts")).cast("int")
    dealt = facts.join(hot, "_key", "left").withColumn("_part", F.coalesce(part, F.lit(0))).drop("_parts")

    ordered, last = last_copy(characters, order_col)
    null = F.col("character_id").isNull()
    # "unknown" stands for null as well as for a character of that name; the check of creation times tells them apart.
    rows = characters.groupBy(key).agg(last.alias("_last"), F.max(F.when(null, F.struct(*ordered))).alias("_null"),
                                       F.max(F.when(~null, F.struct(*ordered))).alias("_named"))
    created = {f"_created{side}": temporal.to_utc_naive(F.col(f"{side}.created_at"), text.type_of(characters, "created_at"))
               if "created_at" in characters.columns else F.lit(None).cast("timestamp_ntz") for side in ("_null", "_named")}
    rows = rows.withColumns(created).select("_key", *created, "_last.*")
    people = dimension_values(rows, ATTRIBUTES, ["_key", *created])
    people = people.join(hot, "_key", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")

    layout = Layout(f"{name}_impressions", f"{name}_characters", buckets)
    for df, table in ((dealt, layout.impressions), (people, layout.characters)):
        # One task and one file a bucket.
        df.repartition(buckets, *KEY).write.mode("overwrite").format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(table)
    return layout


def _tables(spark: SparkSession, layout: Layout) -> tuple[DataFrame, DataFrame]:
    return spark.table(layout.impressions), spark.table(layout.characters)


def build_features(spark: SparkSession, layout: Layout, as_of: str | None = None) -> DataFrame:
    """The feature frame, equal to that of ``features.build_features`` on the tables the layout was stored from."""
    facts, people = _tables(spark, layout)
    facts = facts.transform(add_time_features).transform(add_turn_features).withColumn("character_id", F.col("_key"))
    joined = facts.join(people.drop("_created_null", "_created_named"), KEY, "left")
    return fill_missing_values(merge_dimension(facts, joined, as_of).drop(*KEY))


def join_checks(spark: SparkSession, layout: Layout) -> DataFrame:
    """Impressions without a character and those earlier than their character's creation, from one join."""
    facts, people = _tables(spark, layout)
    known = people.select(*KEY, "_created_null", "_created_named", F.lit(True).alias("_known"))
    joined = facts.join(known, KEY, "left")
    created = F.when(F.col("character_id").isNull(), F.col("_created_null")).otherwise(F.col("_created_named"))
    early = F.count_if(created > quality.event_hour(facts)) if "hour" in facts.columns else F.lit(0)
    return quality.check_rows(joined, [
        quality.check_row("impressions", "unjoined_character_ids", "character_id", "warning", F.count_if(F.col("_known").isNull())),
        quality.check_row("characters", "future_created_at", "created_at", "warning", early),
    ])


def drop(spark: SparkSession, layout: Layout) -> None:
    for table in (layout.impressions, layout.characters):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
