import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from clickloom.operators import metrics, requestlog

EPS = 1e-6


def scored(spark, p, y, keys=None):
    rows = [(f"{i:06d}", float(a), int(b), keys[i] if keys else "k") for i, (a, b) in enumerate(zip(p, y))]
    return spark.createDataFrame(rows, "id string, p double, y int, split string").repartition(3)


def brute_auc(p, y):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def brute_ap(p, y):
    total = 0.0
    for s in np.unique(p):
        at, above = p == s, p >= s
        total += y[at].sum() * y[above].sum() / above.sum()
    return total / y.sum()


def test_small_case(spark):
    row = metrics.binary_metrics(scored(spark, [.9, .8, .7, .6, .5, .5], [1, 0, 1, 0, 1, 0])).first()
    assert row["roc_auc"] == pytest.approx(0.611111, abs=1e-6)
    assert row["pr_auc"] == pytest.approx(0.722222, abs=1e-6)


@pytest.fixture(scope="module")
def hot_scores():
    """A third of the rows share one score, a third crowd a narrow range."""
    rng = np.random.default_rng(7)
    p = np.concatenate([np.full(400, 0.25), 0.1 + 1e-6 * rng.random(400), rng.random(400), [0.0, 1.0]])
    y = (rng.random(len(p)) < 0.3).astype(int)
    return p, y, ["a" if i % 3 else "b" for i in range(len(p))]


@pytest.mark.parametrize("limits", [None, [], [0.1, 0.1000005, 0.25, 0.9]])
def test_against_brute_force(spark, hot_scores, limits):
    p, y, keys = hot_scores
    rows = metrics.binary_metrics(scored(spark, p, y, keys), ["split"], limits).collect()
    assert len(rows) == 2
    for row in rows:
        mask = np.array([key == row["split"] for key in keys])
        q, t = np.clip(p[mask], EPS, 1 - EPS), y[mask]
        assert (row["n"], row["clicks"]) == (mask.sum(), t.sum())
        assert row["ctr"] == pytest.approx(t.mean())
        assert row["log_loss"] == pytest.approx(-(t * np.log(q) + (1 - t) * np.log(1 - q)).mean())
        assert row["brier_score"] == pytest.approx(((q - t) ** 2).mean())
        assert row["roc_auc"] == pytest.approx(brute_auc(q, t))
        assert row["pr_auc"] == pytest.approx(brute_ap(q, t))


def test_auc_equals_spark_ml(spark, hot_scores):
    p, y, _ = hot_scores
    df = scored(spark, p, y)
    expected = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label", numBins=0).evaluate(
        df.select("p", F.col("y").cast("double").alias("label"))
    )
    assert metrics.binary_metrics(df).first()["roc_auc"] == pytest.approx(expected)


def test_one_class_has_no_auc(spark):
    row = metrics.binary_metrics(scored(spark, [.1, .2], [0, 0])).first()
    assert (row["roc_auc"], row["pr_auc"], row["ctr"]) == (None, None, 0.0)
    top = metrics.topk_metrics(scored(spark, [.1, .2], [0, 0]), k_values=[1]).first()
    assert top["lift_at_k"] is None


def test_constant_score(spark):
    row = metrics.binary_metrics(scored(spark, [.2] * 10, [1, 0, 0, 0, 0] * 2)).first()
    assert (row["roc_auc"], row["pr_auc"]) == (pytest.approx(0.5), pytest.approx(0.2))


def test_calibration_edges(spark):
    df = scored(spark, [0.1, 0.3, 0.30000000000000004, 1.0, 0.0, 0.31], [1, 0, 1, 1, 0, 0])
    rows = {row["bin"]: row for row in metrics.calibration_table(df).collect()}
    assert {number: row["count"] for number, row in rows.items()} == {1: 2, 3: 2, 4: 1, 10: 1}
    assert (rows[3]["lower_bound"], rows[3]["upper_bound"]) == (0.2, 0.30000000000000004)
    error = metrics.calibration_error(metrics.calibration_table(df)).first()[0]
    p, y = np.array([.1, 0, .3, .3, .31, 1]), np.array([1, 0, 0, 1, 0, 1])
    groups = [[0, 1], [2, 3], [4], [5]]
    assert error == pytest.approx(sum(abs(p[g].mean() - y[g].mean()) * len(g) for g in groups) / 6, abs=1e-5)
    assert 0 <= error <= 1


def test_topk_with_ties(spark, hot_scores):
    p, y, keys = hot_scores
    rows = metrics.topk_metrics(scored(spark, p, y, keys), ["split"], k_values=[5, 300, 5000]).collect()
    for row in rows:
        index = [i for i in range(len(p)) if keys[i] == row["split"]]
        best = sorted(index, key=lambda i: (-p[i], f"{i:06d}"))[: row["k"]]
        rate, overall = y[best].mean(), y[index].mean()
        assert row["effective_k"] == len(best)
        assert row["ctr_at_k"] == row["precision_at_k"] == pytest.approx(rate)
        assert row["lift_at_k"] == pytest.approx(rate / overall)
    assert len(rows) == 6


def test_slices(spark):
    rows = [(f"{i}", 0.1 + (i % 7) / 10, i % 2, "sfw" if i < 60 else f"v{i}", "c1" if i < 50 else "c2", float(i % 12)) for i in range(100)]
    df = spark.createDataFrame(rows, "id string, p double, y int, safety_tier string, character_id string, conversation_turn double")
    counts = metrics.character_counts(df)
    frame = metrics.add_slice_columns(df, counts.where("character_id = 'c1'"), 50)
    stages = {row["conversation_turn"]: row["turn_stage"] for row in frame.collect()}
    assert (stages[2.0], stages[3.0], stages[8.0], stages[9.0]) == ("early", "mid", "mid", "late")
    found = {(row["slice"], row["value"]): row["n"] for row in metrics.slice_metrics(frame, min_count=10).collect()}
    assert found == {
        ("safety_tier", "sfw"): 60, ("turn_stage", "early"): 27, ("turn_stage", "mid"): 49, ("turn_stage", "late"): 24,
        ("cold_start_character", "graduated"): 50, ("cold_start_character", "cold_start_like"): 50,
    }
    capped = metrics.slice_metrics(frame, slices=["safety_tier"], min_count=1, max_values=3).collect()
    assert sorted(row["value"] for row in capped) == ["sfw", "v60", "v61"]


def test_latency_percentiles(spark):
    rng = np.random.default_rng(3)
    values = {"/a": np.concatenate([np.full(300, 12.5), rng.random(101) * 50]), "/b": np.array([3.0]), "/c": rng.random(20)}
    rows = [(path, float(v)) for path, items in values.items() for v in items]
    log = spark.createDataFrame(rows, "path string, duration_ms double").repartition(3)
    for row in requestlog.latency_summary(log).collect():
        ordered = sorted(values[row["path"]])
        for percent in (50, 95, 99):
            assert row[f"p{percent}_ms"] == ordered[round(percent / 100.0 * (len(ordered) - 1))]
        assert (row["count"], row["max_ms"]) == (len(ordered), ordered[-1])
        assert row["mean_ms"] == pytest.approx(np.mean(ordered))
