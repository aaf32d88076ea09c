import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clickloom.operators import features
from clickloom.schema import CHARACTER_COLUMNS, IMPRESSION_COLUMNS
from clickloom.sources import sinks, tables

# Own sample values; the id has more digits than a double can hold.
VALUES = {name: f"{name.lower()}-7" for name in IMPRESSION_COLUMNS} | {
    "id": "98765432109876543211", "hour": "24030517", "click": "1", "C15": "300", "character_id": "p9", "conversation_turn": "5",
    "session_msg_count": "8",
}
CHARACTER = {
    "character_id": "p9", "character_name": "Ada", "character_description": "Knows the way.", "safety_tier": "sfw",
    "creator_type": "studio", "num_interactions": "31", "created_at": "2024-02-14",
}


def write(folder, name, columns, rows):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as out:
        out.write(",".join(columns) + "\n")
        for row in rows:
            out.write(",".join(row[column] for column in columns) + "\n")
    return path


def test_round_trip(spark, folder):
    impressions = write(folder, "impressions.csv", IMPRESSION_COLUMNS, [VALUES])
    characters = write(folder, "characters.csv", CHARACTER_COLUMNS, [CHARACTER])
    row = tables.load_feature_frame(spark, impressions, characters).first()
    assert (row["id"], row["C15"], row["click"]) == (VALUES["id"], "300", 1.0)
    assert row["event_timestamp"] == datetime(2024, 3, 5, 17)
    assert (row["turn_ratio"], row["safety_tier"], row["character_age_days"]) == (0.625, "sfw", 20.0)


def test_header_order_and_null_texts(spark, folder):
    columns = IMPRESSION_COLUMNS[::-1]
    path = write(folder, "impressions.csv", columns, [{**VALUES, "site_id": "NA", "app_id": "", "click": "x", "C1": "none"}])
    row = tables.load_impressions(spark, path).first()
    assert (row["site_id"], row["app_id"], row["click"], row["C1"]) == (None, None, None, "none")
    assert (row["hour"], row["conversation_turn"]) == ("24030517", 5.0)


def test_line_breaks_in_quoted_cells(spark, folder):
    note = '"first ""line"",\nsecond"'
    impressions = write(folder, "impressions.csv", IMPRESSION_COLUMNS, [VALUES])
    characters = write(folder, "characters.csv", CHARACTER_COLUMNS, [{**CHARACTER, "character_description": note}])
    assert tables.load_characters(spark, characters).first()["character_description"] == 'first "line",\nsecond'
    assert tables.load_feature_frame(spark, impressions, characters).first()["safety_tier"] == "sfw"
    assert tables.load_characters(spark, characters, multi_line=False).count() == 2  # what the switch is for


def test_missing_columns(spark, folder):
    path = write(folder, "impressions.csv", ["id", "hour"], [VALUES])
    with pytest.raises(ValueError, match="impressions: these columns are needed and not there: \\['click'"):
        tables.load_impressions(spark, path)
    assert tables.load_impressions(spark, path, validate=False).columns == ["id", "hour"]


def test_missing_file(spark, folder):
    with pytest.raises(FileNotFoundError, match="nothing.csv"):
        tables.load_characters(spark, f"{folder}/nothing.csv")


def test_file_order_decides_the_last_copy(spark, folder):
    rows = [{**CHARACTER, "character_name": f"copy-{i:05d}", "created_at": "2024-02-14"} for i in range(3000)]
    rows.append({**CHARACTER, "character_name": "a-last"})
    path = write(folder, "characters.csv", CHARACTER_COLUMNS, rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        characters = tables.load_characters(spark, path, multi_line=False, with_file_order=True)
        assert characters.rdd.getNumPartitions() > 3
        kept = features.deduplicate_characters(characters, tables.FILE_ORDER).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [row["character_name"] for row in kept] == ["a-last"]


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_other_formats(spark, folder, fmt):
    row = {**VALUES, "C15": 300.0}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if k == 'C15' else 'string'}" for k in row))
    df.write.mode("overwrite").format(fmt).save(f"{folder}/t")
    found = tables.load_impressions(spark, f"{folder}/t", fmt).first()
    assert (found["id"], found["click"]) == (VALUES["id"], 1.0)
    if fmt != "json":
        assert found["C15"] == "300"


def test_metric_json(spark, folder):
    df = spark.createDataFrame([("b", float("nan"), [float("inf"), 1.0])], "z string, a double, list array<double>")
    sinks.write_metric_tables({"t": df}, folder)
    part = next(name for name in os.listdir(f"{folder}/t") if name.endswith(".json"))
    text = open(f"{folder}/t/{part}").read()
    assert json.loads(text) == {"a": None, "list": [None, 1.0], "z": "b"}
    assert list(json.loads(text)) == ["a", "list", "z"]


def test_partitioned_write(spark, folder):
    df = spark.range(10).withColumn("event_day", F.when(F.col("id") < 8, "2024-01-01").otherwise("unknown"))
    sinks.write_by_day(df, f"{folder}/days")
    back = spark.read.parquet(f"{folder}/days")
    assert back.where("event_day = 'unknown'").count() == 2 and back.count() == 10
