import pytest
from pyspark.sql import functions as F

from clickloom.operators import features, model, quality, split
from clickloom.plans import jobs, training
from clickloom.schema import CHARACTER_COLUMNS, FEATURE_COLUMNS, IMPRESSION_COLUMNS

CONFIG = model.TrainingConfig(iterations=3, depth=2, hash_buckets=64, learning_rate=0.3)


def tables(spark, rows=1200):
    """Impressions whose click depends on the app."""
    n = F.col("n")
    impressions = spark.range(rows).withColumnRenamed("id", "n").select(
        n.cast("string").alias("id"),
        F.concat(F.lit("141021"), F.lpad((n * 24 / rows).cast("int").cast("string"), 2, "0")).alias("hour"),
        ((n % 5 == 0) & (n % 35 != 0)).cast("double").alias("click"),
        *[F.lit("x").alias(name) for name in IMPRESSION_COLUMNS if name not in (
            "id", "hour", "click", "app_id", "device_ip", "character_id", "conversation_turn", "session_msg_count")],
        F.concat(F.lit("app"), n % 5).alias("app_id"),
        F.concat(F.lit("ip"), n).alias("device_ip"),
        F.concat(F.lit("c"), n % 9).alias("character_id"),
        (n % 12).cast("double").alias("conversation_turn"),
        (n % 20).cast("double").alias("session_msg_count"),
    )
    characters = spark.createDataFrame(
        [(f"c{i}", "name", "text", "sfw" if i % 2 else "mature", "studio", float(i), "2014-10-01") for i in range(9)],
        ", ".join(f"{name} {'double' if name == 'num_interactions' else 'string'}" for name in CHARACTER_COLUMNS),
    )
    return impressions, characters


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("training"))
    fitted = training.train_and_evaluate(*tables(spark), folder, CONFIG, min_impressions=50)
    return fitted, folder


def test_training_beats_the_constant(spark, trained):
    fitted, folder = trained
    rows = {(row["model"], row["split"]): row for row in spark.read.json(f"{folder}/evaluation/metrics").collect()}
    assert set(rows) == {("model", "train"), ("model", "validation"), ("model", "test"), ("global_ctr", "validation"), ("global_ctr", "test")}
    for name in ("validation", "test"):
        assert rows["model", name]["log_loss"] < rows["global_ctr", name]["log_loss"]
        assert rows["global_ctr", name]["roc_auc"] == pytest.approx(0.5)
        assert rows["global_ctr", name]["pr_auc"] == pytest.approx(rows["global_ctr", name]["ctr"])
    assert sum(rows["model", name]["n"] for name in ("train", "validation", "test")) == 1200
    assert fitted.metadata["test_metrics"]["n"] == rows["model", "test"]["n"]
    ranking = spark.read.json(f"{folder}/evaluation/ranking")
    assert ranking.count() == 15
    assert spark.read.json(f"{folder}/evaluation/slices").where("slice = 'safety_tier'").count() > 0
    top = spark.read.json(f"{folder}/evaluation/feature_importance").orderBy(F.desc("importance")).first()
    assert top["feature"] == "app_id"


def test_saved_model_scores_alike(spark, trained):
    fitted, folder = trained
    impressions, characters = tables(spark, 100)
    loaded = model.load_predictor(spark, f"{folder}/model")
    assert loaded.prior == pytest.approx(fitted.metadata["global_ctr"])
    assert loaded.info()["metrics"]["serving_mode"] == "primary_with_fallback"
    expected = fitted.transform(features.build_features(impressions, characters)).select("id", "probability")
    rows = loaded.score(impressions, characters).join(expected, "id").collect()
    assert len(rows) == 100
    for row in rows:
        assert row["predicted_ctr"] == pytest.approx(min(max(row["probability"], 1e-4), 0.9999), abs=1e-6)
        assert (row["model_version"], row["reasons"]) == (fitted.version, model.MODEL_REASONS)


def test_batch_scores_are_written(spark, trained, folder):
    fitted, _ = trained
    impressions, _ = tables(spark, 50)
    jobs.score_batch(impressions, model.Predictor(fitted), f"{folder}/scores")
    stored = spark.read.parquet(f"{folder}/scores")
    assert stored.count() == 50 and {"predicted_ctr", "model_version", "reasons"} <= set(stored.columns)


def test_training_rows_leave_out_their_own_fold(spark):
    rows = features.build_features(tables(spark, 400)[0])
    rows = quality.check_target(rows)
    encoder = model.RateEncoder.fit(rows, "click", CONFIG)
    assert all(len(values) == 64 for values in encoder.rates.values())
    # Every device_ip is unique, so apart from collisions its own click must not show in its rate.
    found = encoder.encode(rows, training=True).agg(F.corr("click", "device_ip_rate").alias("own")).first()["own"]
    leaky = encoder.encode(rows).agg(F.corr("click", "device_ip_rate").alias("own")).first()["own"]
    assert found < leaky


def test_bad_input_stops_training(spark, folder):
    impressions, characters = tables(spark, 60)
    with pytest.raises(ValueError, match="did not pass the checks"):
        training.train_and_evaluate(impressions.withColumn("click", F.lit(2.0)), characters, folder, CONFIG)
    with pytest.raises(ValueError):
        model.TrainingConfig(iterations=0).check()


def test_linear_model(spark):
    frame = quality.check_target(features.build_features(*tables(spark, 300)))
    frame = split.time_based_split(frame).assign(frame)
    train, validation = (frame.where(F.col("split") == name) for name in ("train", "validation"))
    config = model.TrainingConfig(classifier="logistic", iterations=5, hashed_dimensions=1 << 10)
    fitted = model.train_model(train, validation, config)
    low, high = fitted.transform(frame).agg(F.min("probability"), F.max("probability")).first()
    assert 0.0 <= low < high <= 1.0
    assert fitted.feature_importance(spark).count() == 0


def test_absent_and_broken_artifacts(spark, folder):
    context = spark.createDataFrame([("a", 1.0, 5.0)], "app_category string, conversation_turn double, session_msg_count double")
    row = model.load_predictor(spark, f"{folder}/nothing").score(context).first()
    assert row["reasons"][:2] == ["fallback global CTR prior", "model artifact not found"]
    spark.range(1).write.parquet(f"{folder}/broken/metadata")
    predictor = model.load_predictor(spark, f"{folder}/broken")
    assert predictor.reason == "model artifact unavailable or incompatible"
    assert predictor.info()["metrics"]["serving_mode"] == "fallback"


class Broken:
    version = "broken"

    def transform(self, df):
        raise ValueError("no model")


class Partial(Broken):
    def transform(self, df):
        return df.withColumn("probability", F.when(F.col("app_category") == "a", 0.25))


def test_failing_model_falls_back(spark):
    context = spark.createDataFrame([("a",), ("b",)], "app_category string")
    predictor = model.Predictor(Broken(), 0.1, "v1", "primary model load succeeded but inference failed")
    rows = predictor.score(context).collect()
    assert rows[0]["reasons"][:3] == [
        "primary model unavailable: ValueError", "fallback global CTR prior", "primary model load succeeded but inference failed",
    ]
    assert (rows[0]["predicted_ctr"], rows[0]["model_version"]) == (0.105, "v1")
    found = {row["app_category"]: row for row in model.Predictor(Partial(), 0.1, "v1").score(context).collect()}
    assert (found["a"]["predicted_ctr"], found["a"]["reasons"]) == (0.25, model.MODEL_REASONS)
    assert found["b"]["predicted_ctr"] == 0.105
    assert found["b"]["reasons"][0] == "primary model unavailable: MissingScore"


def test_feature_order():
    assert [name.removesuffix("_rate") for name in model.ENCODED_COLUMNS] == FEATURE_COLUMNS
