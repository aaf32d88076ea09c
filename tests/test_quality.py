import pytest

from clickloom.operators import quality


def found(checks):
    return {(row["code"], row["column"]): row["count"] for row in checks.collect()}


def test_invalid_row(spark):
    impressions = spark.createDataFrame(
        [("1", "bad-hour", 2.0, "missing-character", -1.0, 2.0)],
        "id string, hour string, click double, character_id string, conversation_turn double, session_msg_count double",
    )
    characters = spark.createDataFrame([("char-1", "sfw")], "character_id string, safety_tier string")
    checks = quality.input_checks(impressions, characters)
    counts = found(checks)
    assert counts["invalid_binary_target", "click"] == 1
    assert counts["invalid_hour", "hour"] == 1
    assert counts["unjoined_character_ids", "character_id"] == 1
    assert counts["negative_numeric_values", "conversation_turn"] == 1
    row = quality.verdict(checks).first()
    # One issue per table with missing columns, and the click.
    assert (row["status"], row["error_count"], row["warning_count"]) == ("fail", 3, 3)
    with pytest.raises(ValueError):
        quality.require_pass(checks)


def test_future_creation_with_mixed_id_types(spark):
    impressions = spark.createDataFrame([("1", "14102100", "101")], "id string, hour string, character_id string")
    characters = spark.createDataFrame([(101, "2014-10-22")], "character_id bigint, created_at string")
    assert quality.future_created(impressions, characters).first()["count"] == 1


def test_future_creation_uses_last_copy(spark):
    impressions = spark.createDataFrame([("14102100", "a"), ("14102100", None)], "hour string, character_id string")
    characters = spark.createDataFrame(
        [("a", "2014-10-22", 1), ("a", "2014-10-01", 2), (None, "2015-01-01", 1)],
        "character_id string, created_at string, version int",
    )
    assert quality.future_created(impressions, characters, "version").first()["count"] == 1


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), (None,), (None,), ("b",)], "id string")
    assert quality.duplicate_ids(df, "impressions", "id").first()["count"] == 3


def test_empty_tables(spark):
    impressions = spark.createDataFrame([], "id string, click double")
    characters = spark.createDataFrame([], "character_id string")
    rows = quality.issues(quality.input_checks(impressions, characters)).collect()
    assert {(row["table"], row["severity"]) for row in rows if row["code"] == "empty_table"} == {
        ("impressions", "error"), ("characters", "warning"),
    }


def test_target(spark):
    assert quality.check_target(spark.createDataFrame([("1",)], "click string")).first()["click"] == 1
    for rows in ([(None,)], [("x",)]):
        with pytest.raises(ValueError, match="no number in"):
            quality.check_target(spark.createDataFrame(rows, "click string"))
    with pytest.raises(ValueError, match="no column"):
        quality.check_target(spark.range(1))
