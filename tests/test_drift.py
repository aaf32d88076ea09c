from collections import Counter

import pytest

from clickloom.operators import drift
from clickloom.plans import jobs

IMPRESSIONS = [
    ("1", "14102100", 0.0, "c1", "game", "chat", "1"), ("2", "14102101", 0.0, "c1", "game", "chat", "1"),
    ("3", "14102200", 1.0, "c2", "social", "chat", "4"), ("4", "14102201", 1.0, "c2", "social", "chat", "4"),
    ("5", "14102300", 1.0, "c2", "social", "chat", "4"), ("6", "14102301", 1.0, "c2", "social", "chat", "4"),
]
SCHEMA = "id string, hour string, click double, character_id string, app_category string, site_category string, device_type string"


def tables(spark):
    impressions = spark.createDataFrame(IMPRESSIONS[::-1], SCHEMA).repartition(3)
    characters = spark.createDataFrame(
        [("c1", "sfw", "studio", 10.0, "2014-10-01"), ("c2", "mature", "community", 20.0, "2014-10-01")],
        "character_id string, safety_tier string, creator_type string, num_interactions double, created_at string",
    )
    return impressions, characters


def test_two_distributions(spark):
    schema = "value string, share double"
    pair = drift.pair_distributions(
        spark.createDataFrame([("a", 0.8), ("b", 0.2)], schema), spark.createDataFrame([("a", 0.2), ("b", 0.8)], schema)
    )
    row = pair.agg(*drift.shift_measures()).first()
    assert row["psi"] == pytest.approx(1.663553, abs=1e-6)
    assert row["kl_divergence"] == pytest.approx(0.831777, abs=1e-6)
    assert row["normalized_distribution_delta"] == pytest.approx(0.6)


def test_report(spark, folder):
    jobs.write_drift_report(*tables(spark), folder)
    read = lambda name: spark.read.json(f"{folder}/{name}")
    summary = read("summary").first()
    assert (summary["row_count"], summary["ctr_delta_latest_vs_early"]) == (6, 1.0)
    assert {row["period"]: (row["impressions"], row["ctr"]) for row in read("periods").collect()} == {
        "early": (2, 0.0), "middle": (2, 1.0), "latest": (2, 1.0),
    }
    shift = {row["feature"]: row for row in read("feature_shift").collect()}
    assert shift["safety_tier"]["psi"] == pytest.approx(41.446532, abs=1e-5)
    assert shift["safety_tier"]["kl_divergence"] == pytest.approx(20.723266, abs=1e-5)
    assert shift["site_category"]["psi"] == pytest.approx(0.0, abs=1e-12)
    days = read("ctr_over_time").orderBy("event_day").collect()
    assert [(row["event_day"], row["impressions"]) for row in days] == [("2014-10-21", 2), ("2014-10-22", 2), ("2014-10-23", 2)]
    assert read("impressions_over_time").count() == 6
    focus = {row["period"]: row for row in read("top_character_concentration").collect()}
    assert (focus["early"]["top_character_share"], focus["early"]["unique_characters"]) == (1.0, 1)
    top = read("top_values").where("feature = 'device_type'").collect()
    assert {(row["period"], row["value"], row["share"]) for row in top} == {("early", "1", 1.0), ("latest", "4", 1.0)}


@pytest.mark.parametrize("count", [1, 2, 3, 4, 5, 11])
def test_periods_are_terciles(spark, count):
    df = spark.createDataFrame([(f"{i:02d}", "14102100") for i in range(count)], "id string, hour string")
    from clickloom.operators.features import add_time_features
    rows = drift.assign_periods(add_time_features(df)).collect()
    expected = Counter(["early", "middle", "latest"][min(2, int(i * 3 / count))] for i in range(count))
    assert Counter(row["period"] for row in rows) == expected


def test_missing_click_and_null_time(spark):
    df = spark.createDataFrame([("1", None), ("2", "14102100")], "id string, hour string")
    frame = drift.prepare_drift_frame(df, None)
    assert {row["id"]: (row["click"], row["event_day"], row["event_hour_bucket"]) for row in frame.collect()} == {
        "1": (0.0, "unknown", "unknown"), "2": (0.0, "2014-10-21", "2014-10-21 00:00"),
    }
    delta = drift.ctr_delta(frame.where("period = 'middle'")).first()
    assert delta["ctr_delta_latest_vs_early"] == 0.0


def test_empty_frame(spark):
    frame = drift.prepare_drift_frame(spark.createDataFrame([], "id string, hour string, click double"), None)
    assert frame.count() == 0 and drift.period_summary(frame).count() == 0
