from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clickloom.operators import boosting, model
from clickloom.plans import jobs
from clickloom.streaming import live


def stored(folder, name):
    return f"{folder}/{name}"


def test_each_batch_meets_the_model_and_characters_of_its_time(spark, folder):
    contexts = "id string, hour string, character_id string"
    tree = lambda low, high: boosting.BoostedTrees(0.0, [boosting.Tree(["num_interactions"], [5.0], [low, high], [1, 1])])
    people = "character_id string, num_interactions double, version int"
    work = live.score_and_store(lambda: model.load_predictor(spark, stored(folder, "model")), lambda: spark.read.parquet(stored(folder, "people")),
                                stored(folder, "out"), "version")

    def arrive(rows):
        spark.createDataFrame(rows, contexts).coalesce(1).write.mode("append").parquet(stored(folder, "in"))
        live.run_batches(live.read_stream(spark, stored(folder, "in"), spark.createDataFrame([], contexts).schema), work, stored(folder, "state"))

    spark.createDataFrame([("c", 1.0, 1), ("c", 9.0, 2)], people).write.parquet(stored(folder, "people"))
    arrive([("0", "14102100", "c")])  # no model yet
    model.ClickModel(None, None, {"model_version": "m1"}, tree(-1.0, 1.0)).save(spark, stored(folder, "model"))
    arrive([("1", "14102100", "c"), ("2", "14102100", "other")])
    spark.createDataFrame([("c", 2.0, 3)], people).write.mode("overwrite").parquet(stored(folder, "people"))
    model.ClickModel(None, None, {"model_version": "m2"}, tree(-1.0, 1.0)).save(spark, stored(folder, "model"))
    arrive([("3", "14102100", "c")])
    found = {row["id"]: (row["model_version"], row["predicted_ctr"]) for row in spark.read.parquet(stored(folder, "out")).collect()}
    up, down = pytest.approx(0.731059), pytest.approx(0.268941)
    assert found["0"][0] not in ("m1", "m2") and found["1"] == ("m1", up) and found["2"] == ("m1", down) and found["3"] == ("m2", down)
    work(spark.createDataFrame([("3", "14102100", "c")], contexts), 2)  # replayed
    assert spark.read.parquet(stored(folder, "out")).count() == 4


def test_requests_go_to_one_of_two_outputs(spark, folder):
    ads = [(f"ad{i}", "sfw") for i in range(4)]
    rows = [(f"r{i}", "sfw", ads[:i]) for i in range(5)]
    kind = "request_id string, safety_tier string, candidates array<struct<candidate_id: string, safety_tier: string>>"
    batch = spark.createDataFrame(rows, kind)
    work = live.rank_and_reject(folder, limit=3)
    for _ in range(2):  # the second time it is a replay
        work(batch, 7)
        ranked = {row["request_id"]: len(row["ranked_candidates"]) for row in spark.read.parquet(stored(folder, "ranked")).collect()}
        rejected = {row["request_id"]: row["rejection"] for row in spark.read.parquet(stored(folder, "rejected")).collect()}
        assert ranked == {"r1": 1, "r2": 2, "r3": 3}
        assert rejected == {"r0": "empty_candidates", "r4": "too_many_candidates"}


def test_late_rows_are_counted_apart(spark, folder):
    def rows(*times):
        return spark.createDataFrame([(datetime.fromisoformat(f"2024-01-01 {t}:00"), float(i % 2)) for i, t in enumerate(times)], "ts timestamp_ntz, click double")

    work = live.count_windows(folder)
    batches = [rows("08:10", "09:30", "10:20"), rows("08:50", "09:40", "12:30", "08:15"), rows("09:59", "11:10", "12:00")]
    for number, batch in enumerate(batches):
        work(batch, number)
    work(batches[1], 1)  # replayed: judged by the batches before it
    found = {row["window_start"].hour: (row["impressions"], row["late_rows"]) for row in live.windows(spark, folder).collect()}
    # After the first batch 09:20 is closed: 08:15 and 08:50 are late. After the second 11:30 is: 09:59 is late too.
    assert found == {8: (1, 2), 9: (2, 1), 10: (1, 0), 11: (1, 0), 12: (2, 0)}
    assert sum(map(sum, found.values())) == sum(batch.count() for batch in batches)
    clicks = {row["window_start"].hour: row["ctr"] for row in live.windows(spark, folder).collect()}
    assert clicks[9] == 1.0 and clicks[10] == 0.0


class Breaks:
    """Fails in the tasks that meet one app."""

    version = "m"

    def transform(self, df):
        return df.withColumn("probability", F.when(F.col("app_category") == "bad", F.raise_error(F.lit("lost")).cast("double")).otherwise(0.25))


def test_a_model_that_throws_in_a_task_yields_a_full_table(spark, folder):
    contexts = spark.createDataFrame([(str(i), "bad" if i == 17 else "good") for i in range(60)], "id string, app_category string")
    failed = jobs.score_batch(contexts, model.Predictor(Breaks(), 0.1, "v1"), folder, batches=4)
    assert len(failed) == 1
    rows = spark.read.parquet(folder).collect()
    assert sorted(int(row["id"]) for row in rows) == list(range(60))
    fallen = {row["id"] for row in rows if row["reasons"][0] == f"primary model unavailable: {list(failed.values())[0]}"}
    assert "17" in fallen and 0 < len(fallen) < 60
    assert all((row["predicted_ctr"], row["model_version"]) == ((0.105, "v1") if row["id"] in fallen else (0.25, "m")) for row in rows)
    assert jobs.score_batch(contexts.where("id <> '17'"), model.Predictor(Breaks(), 0.1, "v1"), f"{folder}/again") == {}


def test_a_batch_is_not_held_in_memory(spark, folder, monkeypatch):
    """The source is read once and no decoded row is kept: both outputs read what was written of the batch, which is then deleted."""
    def held(self, *args):
        raise AssertionError("rows of a batch are kept by the executors")

    monkeypatch.setattr(type(spark.range(1)), "persist", held)
    monkeypatch.setattr(type(spark.range(1)), "cache", held)
    reads = spark.sparkContext.accumulator(0)
    kind = "request_id string, safety_tier string, candidates array<struct<candidate_id: string, safety_tier: string>>"
    rows = spark.createDataFrame([(f"r{i}", "sfw", [("ad", "sfw")] * i) for i in range(5)], kind)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    live.rank_and_reject(folder, limit=3)(rows.mapInArrow(counted, rows.schema), 0)
    assert reads.value == 5
    assert spark.read.parquet(stored(folder, "ranked")).count() == 3 and spark.read.parquet(stored(folder, "rejected")).count() == 2
    assert sorted(path.name for path in Path(folder).iterdir()) == ["ranked", "received", "rejected"]
    assert list(Path(folder, "received").iterdir()) == []
