import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clickloom.operators import model, ranking
from clickloom.schema import CANDIDATE_SCHEMA
from clickloom.streaming import live


def write_lines(path, rows):
    with open(path, "w", encoding="utf-8") as out:
        out.write("\n".join(json.dumps(row) for row in rows))


CONTEXTS = [
    {"id": str(i), "hour": "14102100", "app_category": "a" if i % 2 else None, "conversation_turn": i, "session_msg_count": 5,
     "character_id": f"c{i % 3}", "campaign_note": f"n{i}"} for i in range(8)
]


def lines(spark, folder):
    return spark.readStream.format("text").load(folder)


def test_scored_stream_equals_batch(spark, folder):
    import os
    os.mkdir(f"{folder}/in")
    write_lines(f"{folder}/in/a.json", CONTEXTS[:5])
    write_lines(f"{folder}/in/b.json", CONTEXTS[5:])
    characters = spark.createDataFrame([("c0", "sfw", 1), ("c0", "mature", 2)], "character_id string, safety_tier string, version int")

    class Tiers:
        version = "tiers"

        def transform(self, df):
            return df.withColumn("probability", F.when(F.col("safety_tier") == "mature", 0.5).otherwise(0.1))

    predictor = model.Predictor(Tiers())
    stream = live.parse_contexts(lines(spark, f"{folder}/in"))
    live.run_once(live.score_stream(stream, predictor, characters, "version"), f"{folder}/out", f"{folder}/state")
    found = spark.read.parquet(f"{folder}/out")
    batch = predictor.score(live.parse_contexts(spark.read.text(f"{folder}/in")), characters, "version")
    columns = ["id", "predicted_ctr", "model_version", "reasons"]
    assert sorted(found.select(*columns).collect()) == sorted(batch.select(*columns).collect())
    assert {row["id"]: row["predicted_ctr"] for row in found.collect()} == {
        str(i): 0.5 if i % 3 == 0 else 0.1 for i in range(8)
    }
    extras = {row["id"]: row["extras"] for row in found.collect()}
    assert extras["3"] == {"campaign_note": "n3"}


def test_ranked_stream_equals_batch(spark, folder):
    import os
    os.mkdir(f"{folder}/in")
    ads = [{"candidate_id": f"ad{i}", "safety_tier": "mature" if i == 2 else "sfw", "fatigue_count": i * 3, "pacing_ratio": 0.5 + i / 4} for i in range(5)]
    rows = [{"request_id": f"r{i}", **CONTEXTS[i], "safety_tier": "sfw", "candidates": ads[:i]} for i in range(6)]
    write_lines(f"{folder}/in/a.json", rows)
    requests = live.parse_rank_requests(lines(spark, f"{folder}/in"))
    assert requests.schema["candidates"].dataType.elementType == CANDIDATE_SCHEMA
    live.run_once(live.rank_stream(requests), f"{folder}/out", f"{folder}/state")
    live.run_once(live.rejected_requests(requests), f"{folder}/rejected", f"{folder}/rejected_state")
    batch = ranking.rank_arrays(live.parse_rank_requests(spark.read.text(f"{folder}/in")))
    found = spark.read.parquet(f"{folder}/out")
    assert sorted(found.collect()) == sorted(batch.collect())
    assert found.count() == 5
    assert [tuple(row) for row in spark.read.parquet(f"{folder}/rejected").collect()] == [("r0", "empty_candidates")]


def test_windows(spark, folder):
    start = datetime(2024, 3, 10, 1, 30)  # around a clock change in the session's zone
    rows = [(start + timedelta(minutes=20 * i), float(i % 2)) for i in range(20)]
    spark.createDataFrame(rows, "ts timestamp_ntz, click double").coalesce(1).write.parquet(f"{folder}/in")
    batch = live.windowed_ctr(spark.read.parquet(f"{folder}/in")).collect()
    assert min(row["window_start"] for row in batch) == datetime(2024, 3, 10, 1)
    assert sum(row["impressions"] for row in batch) == 20
    stream = live.windowed_ctr(live.read_stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema))
    live.run_once(stream, f"{folder}/out", f"{folder}/state")
    closed = spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()
    assert set(closed) <= set(batch) and 0 < len(closed) < len(batch)  # the last windows stay open
