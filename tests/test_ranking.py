import pytest
from pyspark.sql import functions as F

from clickloom.operators import prediction, ranking
from clickloom.operators.prediction import fallback_score
from clickloom.schema import RANK_REQUEST_SCHEMA

CONTEXT = {"safety_tier": "sfw", "app_category": "a", "site_category": "s", "conversation_turn": 1.0, "session_msg_count": 5.0}


def ad(name, tier=None, fatigue=0, pacing=1.0, **other):
    return {"candidate_id": name, "safety_tier": tier, "fatigue_count": fatigue, "pacing_ratio": pacing, "bid": 1.0, **other}


def requests(spark, *candidates, context=CONTEXT, request="r1"):
    return spark.createDataFrame([{"request_id": request, **context, "candidates": list(candidates)}], RANK_REQUEST_SCHEMA)


def ranked(df, score=fallback_score):
    return ranking.rank_candidates(df, score).orderBy("request_id", "rank").collect()


@pytest.mark.parametrize("turn,messages,app,site,expected", [
    (1.0, 5.0, "a", "s", 0.055157), (4.0, 5.0, "a", "s", 0.052994), (0.0, 0.0, "a", None, 0.0525), (None, None, "", "unknown", 0.05),
])
def test_fallback_score(spark, turn, messages, app, site, expected):
    df = spark.createDataFrame([(turn, messages, app, site)],
                               "conversation_turn double, session_msg_count double, app_category string, site_category string")
    row = prediction.fallback_score(df, reason="why").first()
    assert row["predicted_ctr"] == pytest.approx(expected, abs=1.1e-6)
    assert row["reasons"][:2] == ["fallback global CTR prior", "why"]
    assert ("app category available" in row["reasons"]) == (app == "a")


def test_fatigue_order(spark):
    rows = ranked(requests(spark, ad("fatigued", fatigue=9), ad("fresh")))
    assert [row["candidate_id"] for row in rows] == ["fresh", "fatigued"]
    assert rows[0]["final_score"] == pytest.approx(0.055157 * 1.03 * 1.05, abs=4e-3)
    assert [row["rank"] for row in rows] == [1, 2]
    assert rows[1]["reasons"][-3:] == ["pacing on target", "fatigue penalty applied", "no exploration bonus"]


def test_published_scores(spark):
    def stub(df):
        rate = F.when(F.col("candidate_id") == "a", 0.128705).otherwise(0.111246)
        return df.withColumns({"predicted_ctr": rate, "model_version": F.lit("v"), "reasons": F.array(F.lit("stub"))})

    rows = ranked(requests(spark, ad("b", "suggestive", 0, 0.75), ad("a", "sfw", 1, 0.92)), stub)
    assert [(row["candidate_id"], row["final_score"]) for row in rows] == [("a", 0.13514025), ("b", 0.1168083)]
    assert rows[0]["reasons"] == ["stub", "pacing on target", "fatigue within cap", "no exploration bonus", "safe tier match"]


def test_safety_gate_and_default_ids(spark):
    rows = ranked(requests(spark, ad("m", " Mature "), ad(None), ad("")))
    assert sorted(row["candidate_id"] for row in rows) == ["candidate-2", "candidate-3"]
    open_context = {**CONTEXT, "safety_tier": "mature"}
    assert len(ranked(requests(spark, ad("m", "mature"), ad("n"), context=open_context))) == 2


def test_ties_keep_input_order(spark):
    rows = ranked(requests(spark, *[ad(f"c{i}") for i in (3, 1, 2)]))
    assert [row["candidate_id"] for row in rows] == ["c3", "c1", "c2"]


@pytest.mark.parametrize("pacing,factor", [(1.2, 0.833333), (3.0, 0.5), (0.0, 1.0), (0.5, 1.05), (None, 1.0)])
def test_pacing(spark, pacing, factor):
    row = ranked(requests(spark, ad("x", fatigue=1, pacing=pacing)))[0]
    assert row["final_score"] == pytest.approx(row["predicted_ctr"] * factor, abs=1e-7)


@pytest.mark.parametrize("fatigue,factor", [(3, 1.0), (4, 0.88), (8, 0.40), (9, 0.30), (50, 0.30)])
def test_fatigue(spark, fatigue, factor):
    row = ranked(requests(spark, ad("x", fatigue=fatigue)))[0]
    assert row["final_score"] == pytest.approx(row["predicted_ctr"] * factor, abs=1e-7)


def test_ad_fields_override_the_context(spark):
    context = {**CONTEXT, "banner_pos": "9", "C14": "1", "C15": "7"}
    rows = ranking.explode_candidates(requests(spark, ad("x", "sfw", banner_pos="0", C14=None), context=context)).collect()
    assert [(row["banner_pos"], row["C14"], row["C15"], row["safety_tier"]) for row in rows] == [("0", "1", "7", "sfw")]


def test_request_gate(spark):
    df = requests(spark).unionByName(requests(spark, *[ad(f"c{i}") for i in range(201)], request="r2"))
    df = df.unionByName(requests(spark, ad("x"), request="r3"))
    found = {row["request_id"]: row["rejection"] for row in ranking.gate_requests(df).collect()}
    assert found == {"r1": "empty_candidates", "r2": "too_many_candidates", "r3": None}
    assert {row["request_id"] for row in ranked(df)} == {"r3"}
    assert [row["request_id"] for row in ranking.rank_arrays(df).collect()] == ["r3"]


def test_array_form_equals_row_form(spark):
    ads = [ad(f"c{i}" if i % 4 else None, ["sfw", "mature", None, "suggestive"][i % 4], i % 11, (i % 9) / 4) for i in range(60)]
    df = requests(spark, *ads)
    grouped = ranking.regroup_ranked(ranking.rank_candidates(df)).first()["ranked_candidates"]
    assert ranking.rank_arrays(df).first()["ranked_candidates"] == grouped
    assert [item["rank"] for item in grouped] == list(range(1, len(grouped) + 1))


def test_assembled_requests_with_a_hot_request(spark):
    contexts = spark.createDataFrame([("r1",), ("hot",), ("none",)], "request_id string")
    rows = [("r1", 2, "b"), ("r1", 1, "a")] + [("hot", i, f"h{i}") for i in range(500)]
    candidates = spark.createDataFrame(rows, "request_id string, place int, candidate_id string")
    found = {row["request_id"]: row for row in ranking.assemble_requests(contexts, candidates, ["place"]).collect()}
    assert [item["candidate_id"] for item in found["r1"]["candidates"]] == ["a", "b"]
    assert (found["hot"]["candidate_count"], found["hot"]["rejection"], found["hot"]["candidates"]) == (500, "too_many_candidates", None)
    assert found["none"]["rejection"] == "empty_candidates"


def test_candidate_contract(spark):
    schema = "candidate_id string, safety_tier string, bid double, fatigue_count int, pacing_ratio double"
    df = spark.createDataFrame([("a", "sfw", 1.0, 0, 1.0), ("b", "adult", -1.0, -1, -0.1), ("c", None, None, None, None)], schema)
    valid, invalid = ranking.quarantine(ranking.candidate_violations(df))
    assert {row["candidate_id"] for row in valid.collect()} == {"a", "c"}
    assert invalid.first()["violations"] == ["invalid_safety_tier", "negative_bid", "negative_fatigue_count", "negative_pacing_ratio"]


def test_prediction_contract(spark):
    df = spark.createDataFrame([(0.5, 0.1), (1.5, -0.1)], "predicted_ctr double, final_score double")
    valid, invalid = ranking.quarantine(ranking.prediction_violations(df))
    assert valid.count() == 1
    assert invalid.first()["violations"] == ["predicted_ctr_out_of_range", "negative_final_score"]
