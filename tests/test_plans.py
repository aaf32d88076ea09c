"""Plan shapes that matter at scale, and results that must not depend on placement."""

import pytest
from pyspark.sql import functions as F

from clickloom.operators import drift, features, metrics, ordering, ranking
from clickloom.plans import views
from clickloom.plans.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scan_columns(df):
    return [line for line in plan(df).splitlines() if "ReadSchema" in line]


@pytest.fixture
def shuffled_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dimension_within_the_limit_is_broadcast(spark):
    frame = features.build_features(views.impressions(spark, SMALL), views.characters(spark, SMALL), "version")
    text = plan(frame)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert "Python" not in text


def test_large_dimension_is_joined_by_shuffle_with_the_same_rows(spark):
    impressions, characters = views.impressions(spark, SMALL), views.characters(spark, SMALL)
    expected = sorted(features.build_features(impressions, characters, "version").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = features.build_features(impressions, characters, "version")
        assert "SortMergeJoin" in plan(frame)
        found = sorted(frame.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == expected


def test_hot_key_is_split(spark):
    from clickloom.operators.joins import join_dimension
    fact = spark.range(200_000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"))
    dimension = spark.range(50).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("v"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        joined = join_dimension(fact, dimension, "k")
        assert len(joined.collect()) == 200_000
        assert "skew=true" in plan(joined)
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_unused_columns_are_not_read(spark):
    frame = features.build_features(views.impressions(spark, SMALL), views.characters(spark, SMALL), "version")
    lines = scan_columns(frame.groupBy("is_weekend").count())
    assert any("struct<ts:" in line for line in lines) and not any("props" in line for line in lines)


def test_ranking_metrics_do_not_send_rows_to_one_task(spark):
    text = plan(metrics.binary_metrics(views.scored(spark, SMALL), ["split"], [0.1, 0.5]))
    assert "SinglePartition" not in text and "Python" not in text


def test_topk_drops_rows_before_the_shuffle(spark):
    text = plan(metrics.topk_rows(views.scored(spark, SMALL), ["split"], 10))
    assert "_cut" in text and "BroadcastHashJoin" in text


def test_topk_when_one_score_holds_all_rows(spark):
    df = spark.range(5000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("id"), F.lit(0.2).alias("p"), (F.col("id") < 7).cast("int").alias("y"))
    best = metrics.topk_rows(df.repartition(9), [], 10).orderBy("rank").collect()
    assert [row["id"] for row in best] == [f"{i:05d}" for i in range(10)]
    assert metrics.topk_metrics(df, k_values=[10, 2000]).where("k = 10").first()["ctr_at_k"] == 0.7


def test_requests_drop_surplus_candidates_before_the_shuffle(spark):
    requests = ranking.assemble_requests(views.rank_contexts(spark, SMALL), views.candidate_rows(spark, SMALL), views.CANDIDATE_ORDER)
    text = plan(requests)
    assert "WindowGroupLimit" in text and "Partial" in text


def test_period_labels_need_no_shuffle(spark):
    frame = features.add_time_features(views.impressions(spark, SMALL))
    assert "Exchange" not in plan(drift.assign_periods(frame))


def test_period_boundaries_are_found_without_the_dimension(spark, shuffled_joins):
    frame = drift.prepare_drift_frame(views.impressions(spark, SMALL), views.characters(spark, SMALL), "version")
    assert plan(frame).count("SortMergeJoin") == 1  # that of the features


def test_array_ranking_needs_no_shuffle(spark):
    schema = "request_id string, app_category string, candidates array<struct<candidate_id:string,safety_tier:string>>"
    assert "Exchange" not in plan(ranking.rank_arrays(spark.createDataFrame([], schema)))


def test_deduplication_combines_before_the_shuffle(spark):
    text = plan(features.deduplicate_characters(views.characters(spark, SMALL), "version"))
    assert text.count("SortAggregate") + text.count("HashAggregate") == 2


def test_latest_rows_filter_instead_of_sorting(spark):
    from clickloom.operators.split import latest_rows
    frame = features.add_time_features(views.impressions(spark, SMALL))
    assert "Exchange" not in plan(latest_rows(frame, 100))


@pytest.mark.parametrize("name", ["feature_shift", "binary_metrics", "rank_candidates", "time_split_rows"])
def test_results_do_not_depend_on_partitions_or_join_strategy(spark, name, shuffled_joins):
    found = sorted(QUERIES[name].build(spark, SMALL).collect(), key=str)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(QUERIES[name].build(spark, SMALL).collect(), key=str) == found
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_bucket_limits_follow_the_data(spark):
    df = spark.range(10000).select((F.col("id") / 1e9 + 0.05).alias("p"))
    limits = ordering.bucket_limits(df, "p", 10)
    assert len(limits) == 9
    sizes = ordering.add_bucket(df, "p", limits, "b").groupBy("b").count().collect()
    assert len(sizes) == 10 and max(row["count"] for row in sizes) < 1300
