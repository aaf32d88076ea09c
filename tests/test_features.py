from datetime import datetime
from math import log1p

import pytest
from pyspark.sql import functions as F

from clickloom.functions import numeric, temporal, text
from clickloom.operators import features
from clickloom.schema import CATEGORICAL_FEATURES, FEATURE_COLUMNS


def test_parse_hour(spark):
    cases = {
        "14102100": datetime(2014, 10, 21), "14102113": datetime(2014, 10, 21, 13),
        "14102113.0": datetime(2014, 10, 21, 13), " 14102113 ": datetime(2014, 10, 21, 13),
        "2014-10-21 09:30:00": datetime(2014, 10, 21, 9, 30), "70010100": datetime(1970, 1, 1),
        "": None, "not-a-timestamp": None, "14102124": None, "14023001": None, "14102": None, "1410210": None,
    }
    df = spark.createDataFrame([(key,) for key in cases], "hour string")
    found = {row["hour"]: row["t"] for row in df.select("hour", temporal.parse_hour("hour").alias("t")).collect()}
    assert found == cases


def test_time_features(spark):
    df = spark.createDataFrame([("14102512",), (None,), ("14102100",)], "hour string")
    rows = features.add_time_features(df).select("hour_of_day", "day_of_week", "is_weekend").collect()
    assert [tuple(row) for row in rows] == [(12, 5, 1), (-1, -1, 0), (0, 1, 0)]


def test_time_features_without_hour(spark):
    row = features.add_time_features(spark.range(1)).first()
    assert (row["event_timestamp"], row["hour_of_day"], row["is_weekend"]) == (None, -1, 0)


def test_numeric_hour_matches_text_hour(spark):
    df = spark.createDataFrame([(14102113.0,)], "hour double")
    assert features.add_time_features(df).first()["hour_of_day"] == 13


def test_utc_conversion(spark):
    df = spark.createDataFrame([("2014-10-21T09:30:00Z",), ("2014-10-21 09:30:00+02:00",), ("2014-10-21",), ("bad",)], "t string")
    found = [row[0] for row in df.select(temporal.to_utc_naive(F.col("t"), df.schema["t"].dataType)).collect()]
    assert found == [datetime(2014, 10, 21, 9, 30), datetime(2014, 10, 21, 7, 30), datetime(2014, 10, 21), None]


def test_turn_features(spark):
    df = spark.createDataFrame(
        [("2", "4"), ("3", "0"), (None, None), ("-2", "-3"), ("6", "4"), ("bad", "1e1")],
        "conversation_turn string, session_msg_count string",
    )
    rows = features.add_turn_features(df).select("conversation_turn", "session_msg_count", "turn_ratio").collect()
    assert [tuple(row) for row in rows] == [(2, 4, 0.5), (3, 0, 0), (0, 0, 0), (0, 0, 0), (6, 4, 1.5), (0, 10, 0)]


def test_turn_features_without_columns(spark):
    row = features.add_turn_features(spark.range(1)).first()
    assert (row["conversation_turn"], row["session_msg_count"], row["turn_ratio"]) == (0, 0, 0)


IMPRESSIONS = [("14102100", "char-1"), ("14102100", "char-missing")]
VERSIONS = [
    ("char-1", "older-copy", "mature", "studio", 10.0, "2014-10-10", 1),
    ("char-1", "newer-copy", "sfw", "community", 20.0, "2014-10-01", 2),
]
VERSION_SCHEMA = (
    "character_id string, character_name string, safety_tier string, creator_type string, "
    "num_interactions double, created_at string, version int"
)


@pytest.mark.parametrize("order", [1, -1])
@pytest.mark.parametrize("limit", ["10485760", "-1"])
def test_character_join_keeps_last_version(spark, order, limit):
    impressions = features.add_time_features(spark.createDataFrame(IMPRESSIONS, "hour string, character_id string"))
    characters = spark.createDataFrame(VERSIONS[::order], VERSION_SCHEMA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        rows = features.join_character_features(impressions, characters, "version").orderBy("character_id").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 2
    first, second = rows
    assert (first["character_name"], first["safety_tier"], first["creator_type"]) == ("newer-copy", "sfw", "community")
    assert (first["num_interactions"], first["character_age_days"]) == (20.0, 20.0)
    assert (second["safety_tier"], second["character_age_days"]) == (None, 0.0)


def test_join_matches_null_and_unknown_ids(spark):
    impressions = spark.createDataFrame([("14102100", None), ("14102100", " unknown")], "hour string, character_id string")
    characters = spark.createDataFrame([(None, "studio")], "character_id string, creator_type string")
    rows = features.join_character_features(impressions, characters).collect()
    assert {row["character_id"]: row["creator_type"] for row in rows} == {"unknown": "studio", " unknown": None}


def test_dimension_value_wins_if_present(spark):
    impressions = spark.createDataFrame(
        [("14102100", "a", "sfw", "2014-10-19"), ("14102100", "b", "sfw", "2014-10-19")],
        "hour string, character_id string, safety_tier string, created_at string",
    )
    characters = spark.createDataFrame(
        [("a", "mature", "2014-10-20"), ("b", None, None)], "character_id string, safety_tier string, created_at string"
    )
    frame = features.join_character_features(features.add_time_features(impressions), characters)
    found = {row["character_id"]: (row["safety_tier"], row["character_age_days"]) for row in frame.collect()}
    assert found == {"a": ("mature", 1.0), "b": ("sfw", 2.0)}


def test_age_counts_whole_days_and_uses_as_of(spark):
    impressions = spark.createDataFrame(
        [("2014-10-02 01:00:00", "a"), ("bad", "a")], "hour string, character_id string"
    )
    characters = spark.createDataFrame([("a", "2014-10-01 23:00:00")], "character_id string, created_at string")
    frame = features.join_character_features(features.add_time_features(impressions), characters, as_of="2014-10-05")
    assert {row["hour"]: row["character_age_days"] for row in frame.collect()} == {"2014-10-02 01:00:00": 0.0, "bad": 3.0}


def test_missing_values(spark):
    df = spark.createDataFrame(
        [(None, "", "bad", None, -5.0)],
        "site_id string, app_category string, conversation_turn string, session_msg_count double, num_interactions double",
    )
    row = features.fill_missing_values(df).first()
    assert all(isinstance(row[name], str) for name in CATEGORICAL_FEATURES)
    assert (row["site_id"], row["app_category"]) == ("unknown", "unknown")
    assert all(row[name] == 0 for name in (
        "conversation_turn", "session_msg_count", "num_interactions", "num_interactions_log1p",
    ))


def test_category_texts(spark):
    cases = {
        "　game\xa0": "game", " nan ": "unknown", "None": "unknown", "<NA>": "unknown", "\t": "unknown",
        "été": "été", "a b": "a b", "NA": "NA", " x ": "x", "none": "none",
    }
    df = spark.createDataFrame([(key,) for key in cases], "c string")
    assert {row["c"]: row["n"] for row in df.select("c", F.expr(text.normalize_category("c")).alias("n")).collect()} == cases


def test_canonical_text_of_numbers(spark):
    df = spark.createDataFrame([(320.0, 7), (0.5, None), (None, 1)], "a double, b int")
    rows = features.fill_missing_values(df.withColumnRenamed("a", "C15").withColumnRenamed("b", "C16")).collect()
    assert [(row["C15"], row["C16"]) for row in rows] == [("320", "7"), ("0.5", "unknown"), ("unknown", "1")]


def test_numeric_coercion(spark):
    cases = {"1": 1.0, " 2.5 ": 2.5, "1e3": 1000.0, ".5": 0.5, "5.": 5.0, "+7": 7.0, "1d": None, "1f": None, "NaN": None, "x": None, "": None}
    df = spark.createDataFrame([(key,) for key in cases], "t string")
    rows = df.select("t", F.expr(numeric.to_number("t", df.schema["t"].dataType)).alias("n")).collect()
    assert {row["t"]: row["n"] for row in rows} == cases


def test_feature_frame(spark):
    impressions = spark.createDataFrame(
        [("1", "14102100", "char-1", 2.0, 4.0)],
        "id string, hour string, character_id string, conversation_turn double, session_msg_count double",
    )
    characters = spark.createDataFrame([("char-1", "sfw", "community", 9.0, "2014-10-01")],
                                       "character_id string, safety_tier string, creator_type string, num_interactions double, created_at string")
    frame = features.build_features(impressions, characters)
    row = frame.first()
    assert (row["turn_ratio"], row["character_age_days"], row["num_interactions"]) == (0.5, 20.0, 9.0)
    assert row["num_interactions_log1p"] == pytest.approx(log1p(9))
    assert features.select_feature_columns(frame).columns == FEATURE_COLUMNS
    assert len(FEATURE_COLUMNS) == 33


def test_feature_frame_without_characters(spark):
    row = features.build_features(spark.createDataFrame([("14102100",)], "hour string")).first()
    assert (row["safety_tier"], row["creator_type"]) == ("unknown", "unknown")
    assert (row["num_interactions"], row["character_age_days"]) == (0.0, 0.0)


def test_missing_feature_columns_are_named(spark):
    with pytest.raises(ValueError, match="site_id"):
        features.select_feature_columns(spark.range(1))
