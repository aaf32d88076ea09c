"""The training job: check, build features, split, fit, score, evaluate, store."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from clickloom.functions import temporal
from clickloom.operators import metrics, quality, split
from clickloom.operators.features import build_features
from clickloom.operators.model import ClickModel, TrainingConfig, train_model
from clickloom.operators.prediction import baseline_score
from clickloom.schema import COLD_START_MIN_IMPRESSIONS, SLICE_COLUMNS
from clickloom.session import set_checkpoint_dir
from clickloom.sources.sinks import write_by_day, write_metric_tables

SCORED_COLUMNS = ["id", "character_id", "conversation_turn", *[c for c in SLICE_COLUMNS if c in (
    "safety_tier", "creator_type", "app_category")]]


def scored_table(model: ClickModel, frame: DataFrame, train: DataFrame, target: str = "click") -> DataFrame:
    """Model and baseline scores of all split rows, keyed by ``model`` and ``split``."""
    keep = [*SCORED_COLUMNS, "split", F.col(target).cast("int").alias("y")]
    own = model.transform(frame).select(*keep, F.col("probability").alias("p"), F.lit("model").alias("model"))
    constant = baseline_score(frame.where(F.col("split") != "train"), train, target)
    return own.unionByName(constant.select(*keep, F.col("probability").alias("p"), F.lit("global_ctr").alias("model")))


def checked_features(
    impressions: DataFrame, characters: DataFrame, folder: str, order_col: str | None = None, as_of: str | None = None
) -> DataFrame:
    """The feature frame, stored by day in ``folder/features``; raises if the tables do not pass the checks.

    The impressions' own counts are taken by the job that writes the features. Where columns are absent, nothing but the
    checks is written.
    """
    spark = impressions.sparkSession
    frame, counted = None, None
    if quality.lacking_columns(impressions, characters).isEmpty():
        watched, seen = quality.observe_counts(impressions, "impressions")
        frame = build_features(watched, characters, order_col, as_of)
        frame = frame.withColumn("event_day", temporal.day_label(F.col("event_timestamp")))
        write_by_day(frame, f"{folder}/features")
        frame = spark.read.schema(frame.schema).parquet(f"{folder}/features")
        counted = quality.observed_counts(impressions, "impressions", seen, frame.count())
    checks = quality.input_checks(impressions, characters, order_col, counted)
    # The checks read the tables; issues and verdict read the stored checks.
    checks.write.mode("overwrite").parquet(f"{folder}/quality/stored")
    checks = spark.read.parquet(f"{folder}/quality/stored")
    write_metric_tables({"checks": checks, "issues": quality.issues(checks), "verdict": quality.verdict(checks)}, f"{folder}/quality")
    if frame is None or spark.read.json(f"{folder}/quality/verdict").first()["status"] != "pass":
        raise ValueError(f"the input tables did not pass the checks stored in {folder}/quality")
    return frame


def train_and_evaluate(
    impressions: DataFrame,
    characters: DataFrame,
    folder: str,
    config: TrainingConfig = TrainingConfig(),
    order_col: str | None = None,
    as_of: str | None = None,
    min_impressions: int = COLD_START_MIN_IMPRESSIONS,
) -> ClickModel:
    """Runs the whole job. Features and scores are written once and read back; the classifier caches its own input."""
    config.check()
    split.check_fractions(config.train_fraction, config.validation_fraction)
    spark = impressions.sparkSession
    frame = checked_features(impressions, characters, folder, order_col, as_of)
    frame = quality.check_target(frame)
    parts = split.time_based_split(frame, config.train_fraction, config.validation_fraction)
    frame = parts.assign(frame)
    summary = split.split_summary(frame)
    split.check_parts(summary)
    train, validation = (frame.where(F.col("split") == name) for name in ("train", "validation"))

    # ``max_rows`` bounds what the classifier is fitted on; counts, scores and metrics cover all rows.
    fit_rows = train if config.max_rows is None else split.latest_rows(train, config.max_rows)
    set_checkpoint_dir(spark)  # long boosting runs cut their lineage there
    model = train_model(fit_rows, validation, config)
    scored_table(model, frame, train).write.mode("overwrite").parquet(f"{folder}/scored")
    scored = spark.read.parquet(f"{folder}/scored")
    tables = metrics.evaluate(scored, metrics.character_counts(train), min_impressions=min_impressions)
    tables["split"] = summary
    tables["feature_importance"] = model.feature_importance(spark)
    write_metric_tables(tables, f"{folder}/evaluation")

    test = spark.read.json(f"{folder}/evaluation/metrics").where("model = 'model' AND split = 'test'").first()
    model = replace(model, metadata={
        **model.metadata,
        "split": {
            "strategy": "time_based_chronological", "split_unit": parts.unit, "warnings": parts.warnings,
            "unique_timestamp_count": parts.unique_times,
        },
        "test_metrics": {name: test[name] for name in metrics.METRIC_NAMES},
        "evaluation": f"{folder}/evaluation",
        # One number a feature and one a split and model: small tables of fixed size.
        "feature_importance": {row["feature"]: row["importance"] for row in model.feature_importance(spark).collect()},
        "calibration_error": {f"{row['model']}/{row['split']}": row["calibration_error"] for row in
                              spark.read.json(f"{folder}/evaluation/calibration_error").collect()},
    })
    model.save(spark, f"{folder}/model")
    return model


def describe(model: ClickModel) -> str:
    return json.dumps(model.metadata, indent=2, sort_keys=True, default=str)
