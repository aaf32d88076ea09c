"""Tables stored by character, and counts taken while writing."""

import uuid

import pytest
from pyspark.sql import functions as F

from clickloom.operators import features, layout, quality
from clickloom.plans import views

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def shuffled_joins(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.fixture
def stored(spark):
    made = []

    def store(impressions, characters, buckets=4, order_col="version"):
        made.append(layout.store(impressions, characters, f"t{uuid.uuid4().hex}", buckets, order_col))
        return made[-1]

    yield store
    for one in made:
        layout.drop(spark, one)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def with_hot(spark):
    impressions = views.dirty_impressions(spark, SMALL)
    return impressions.withColumn("character_id", F.expr("if(bigint(id) % 3 = 0, '7', character_id)")), views.characters(spark, SMALL)


def test_features_and_checks_equal_those_of_the_plain_tables(spark, stored, shuffled_joins):
    impressions, characters = with_hot(spark)
    one = stored(impressions, characters)
    frame = layout.build_features(spark, one, "2024-02-01")
    expected = features.build_features(impressions, characters, "version", "2024-02-01")
    assert set(frame.columns) == set(expected.columns)
    assert sorted(map(str, frame.select(*sorted(frame.columns)).collect())) == sorted(map(str, expected.select(*sorted(expected.columns)).collect()))
    checks = {row.code: row["count"] for row in layout.join_checks(spark, one).collect()}
    assert checks["unjoined_character_ids"] == quality.unjoined_ids(impressions, characters).first()["count"] > 0
    assert checks["future_created_at"] == quality.future_created(impressions, characters, "version").first()["count"] > 0


def test_joins_do_not_shuffle_impressions(spark, stored, shuffled_joins):
    one = stored(*with_hot(spark))
    joined = plan(layout.build_features(spark, one))
    assert "SortMergeJoin" in joined and "Exchange" not in joined
    checks = plan(layout.join_checks(spark, one))
    assert "SortMergeJoin" in checks and "hashpartitioning" not in checks  # only the sums of the tasks are gathered


def test_a_hot_character_is_spread_over_parts(spark, stored):
    impressions, characters = with_hot(spark)
    one = stored(impressions, characters, buckets=16)
    facts, people = spark.table(one.impressions), spark.table(one.characters)
    assert facts.where("_key = '7'").select("_part").distinct().count() > 4
    assert people.where("_key = '7'").select("_part").distinct().count() == people.where("_key = '7'").count() > 4
    assert facts.count() == impressions.count()


def test_null_ids_meet_no_character_of_that_name(spark, stored):
    impressions = spark.createDataFrame([("1", "14102100", None), ("2", "14102100", "unknown"), ("3", "bad", "a"), ("4", "14102100", "b")],
                                        "id string, hour string, character_id string")
    characters = spark.createDataFrame([("unknown", "2015-01-01", 1), ("a", "2015-01-01", 1), ("a", "2013-01-01", 2)],
                                       "character_id string, created_at string, version int")
    one = stored(impressions, characters)
    found = {row.code: row["count"] for row in layout.join_checks(spark, one).collect()}
    assert found == {"unjoined_character_ids": 1, "future_created_at": 1}
    assert quality.unjoined_ids(impressions, characters).first()["count"] == 1
    assert quality.future_created(impressions, characters, "version").first()["count"] == 1


def test_empty_tables_and_absent_ids(spark, stored):
    impressions, characters = views.impressions(spark, SMALL), views.characters(spark, SMALL)
    one = stored(impressions.limit(0), characters.limit(0))
    assert layout.build_features(spark, one).count() == 0
    assert {row["count"] for row in layout.join_checks(spark, one).collect()} == {0}
    with pytest.raises(ValueError):
        layout.store(impressions.drop("character_id"), characters, "none", 2)


def test_counts_taken_while_writing_equal_a_scan(spark, folder):
    for i, impressions in enumerate([views.dirty_impressions(spark, SMALL), views.impressions(spark, SMALL).drop("hour", "click")]):
        watched, seen = quality.observe_counts(impressions, "impressions")
        watched.write.parquet(f"{folder}/{i}")
        rows = spark.read.parquet(f"{folder}/{i}").count()
        expected = sorted(map(str, quality.table_counts(impressions, "impressions").collect()))
        assert sorted(map(str, quality.observed_counts(impressions, "impressions", seen, rows).collect())) == expected


def test_counts_of_repeated_tasks_are_not_taken(spark, folder):
    impressions = views.dirty_impressions(spark, SMALL)
    watched, seen = quality.observe_counts(impressions.union(impressions.limit(5)), "impressions")
    watched.write.parquet(f"{folder}/t")
    found = quality.observed_counts(impressions, "impressions", seen, impressions.count())
    assert sorted(map(str, found.collect())) == sorted(map(str, quality.table_counts(impressions, "impressions").collect()))


def test_an_empty_table_is_counted(spark, folder):
    impressions = views.impressions(spark, SMALL).limit(0)
    watched, seen = quality.observe_counts(impressions, "impressions")
    watched.write.parquet(f"{folder}/t")
    found = {row.code: row["count"] for row in quality.observed_counts(impressions, "impressions", seen, 0).collect()}
    assert found["row_count"] == 0 and found["empty_table"] == 1
