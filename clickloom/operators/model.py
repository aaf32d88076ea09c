"""Click model: hashed click-rate encoding of categories, then boosted trees or a logistic regression.

High-cardinality ids are never indexed on the driver. Each category value falls into one of a fixed
number of hash buckets per column; the click rate of a bucket, smoothed towards the global rate, is
its encoding. The rate table is bounded by columns x buckets x folds whatever the data, so scoring
needs no join. A training row is encoded with what was known before its time (``statistics.ordered_rates``), or, in
tables without a time, with the rates of the other folds, not its own.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickloom.functions import numeric
from clickloom.operators import boosting
from clickloom.operators.features import build_features, select_feature_columns
from clickloom.operators.prediction import fallback_score, global_ctr
from clickloom.operators.statistics import ordered_rates
from clickloom.schema import (
    CATEGORICAL_FEATURES, FALLBACK_CTR, FEATURE_COLUMNS, NUMERIC_FEATURES, UNTRAINED_VERSION,
)
from clickloom.session import materialize, work_path

# The reason texts scored rows carry.
MODEL_REASONS = ["trained CTR model", "online context features"]
UNAVAILABLE = "primary model unavailable: "
INFERENCE_FAILED = "primary model load succeeded but inference failed"
NO_ARTIFACT = "model artifact not found"
BAD_ARTIFACT = "model artifact unavailable or incompatible"


@dataclass(frozen=True)
class TrainingConfig:
    """Settings of a training run; the boosting defaults are the published ones.

    ``regularization`` is the L2 term on the leaves of the trees; the logistic model's ``regParam`` is a thousandth of it.
    Boosting stops ``patience`` rounds after the best loss on the validation rows and keeps the trees up to that.
    """

    train_fraction: float = 0.70
    validation_fraction: float = 0.15
    classifier: str = "boosted_trees"  # or "logistic"
    iterations: int = 250
    learning_rate: float = 0.08
    depth: int = 6
    regularization: float = 3.0
    patience: int = 30
    bins: int = 32
    seed: int = 42
    max_rows: int | None = None
    hash_buckets: int = 1024
    folds: int = 4
    smoothing: float = 20.0
    hashed_dimensions: int = 1 << 18

    def check(self) -> None:
        if self.iterations <= 0:
            raise ValueError("iterations must be positive")
        if self.classifier not in ("boosted_trees", "logistic"):
            raise ValueError(f"unknown classifier: {self.classifier}")

    def boosting(self) -> boosting.BoostConfig:
        return boosting.BoostConfig(self.iterations, self.depth, self.learning_rate, self.regularization, self.patience, self.bins)


@dataclass(frozen=True)
class RateEncoder:
    """Smoothed click rate per column and hash bucket, as nested lists of fixed size."""

    buckets: int
    folds: int
    rates: dict[str, list[float]]
    fold_rates: dict[str, list[float]]

    @staticmethod
    def _bucket(name: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(name)), F.lit(buckets)).cast("int")

    @staticmethod
    def _fold(folds: int) -> Column:
        return F.pmod(F.xxhash64(F.lit("fold"), *FEATURE_COLUMNS), F.lit(folds)).cast("int")

    @staticmethod
    def ordered(train: DataFrame, target: str, time_col: str, config: TrainingConfig) -> DataFrame:
        """Numeric features and target of the training rows with one ``<column>_rate`` per category, of what was known before each
        row's hour."""
        keys = {name: RateEncoder._bucket(name, config.hash_buckets) for name in CATEGORICAL_FEATURES}
        prior = train.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0
        keep = [*[name for name in FEATURE_COLUMNS if name not in CATEGORICAL_FEATURES], target]
        return ordered_rates(train, keys, target, time_col, prior, config.smoothing, keep=keep)

    @classmethod
    def fit(cls, train: DataFrame, target: str, config: TrainingConfig) -> RateEncoder:
        cells = F.array(*[
            F.struct(F.lit(i).alias("column"), cls._bucket(name, config.hash_buckets).alias("bucket"))
            for i, name in enumerate(CATEGORICAL_FEATURES)
        ])
        counts = (
            train.select(F.col(target).alias("y"), cls._fold(config.folds).alias("fold"), F.explode(cells).alias("cell"))
            .groupBy("cell.column", "cell.bucket", "fold")
            .agg(F.count("*").alias("n"), F.sum("y").alias("clicks"))
        )
        table = counts.collect()  # at most columns x buckets x folds rows
        total = sum(row["n"] for row in table if row["column"] == 0)
        prior = sum(row["clicks"] for row in table if row["column"] == 0) / max(total, 1)
        size = config.hash_buckets
        seen = {(row["column"], row["bucket"], row["fold"]): (row["n"], row["clicks"]) for row in table}

        def rate(n: float, clicks: float) -> float:
            return (clicks + config.smoothing * prior) / (n + config.smoothing)

        rates, fold_rates = {}, {}
        for i, name in enumerate(CATEGORICAL_FEATURES):
            whole, others = [], []
            for bucket in range(size):
                parts = [seen.get((i, bucket, fold), (0, 0)) for fold in range(config.folds)]
                n, clicks = (sum(values) for values in zip(*parts))
                whole.append(rate(n, clicks))
                others += [rate(n - part[0], clicks - part[1]) for part in parts]
            rates[name], fold_rates[name] = whole, others
        return cls(size, config.folds, rates, fold_rates)

    def encode(self, df: DataFrame, training: bool = False) -> DataFrame:
        """Adds one ``<column>_rate`` per category; ``training`` leaves out the row's own fold."""
        table = self.fold_rates if training else self.rates
        columns = {}
        for name in CATEGORICAL_FEATURES:
            place = self._bucket(name, self.buckets)
            if training:
                place = place * self.folds + self._fold(self.folds)
            # A constant array, folded into the plan.
            values = F.from_json(F.lit(json.dumps(table[name])), "array<double>")
            columns[f"{name}_rate"] = F.element_at(values, place + 1)
        return df.withColumns(columns)


ENCODED_COLUMNS = [f"{name}_rate" if name in CATEGORICAL_FEATURES else name for name in FEATURE_COLUMNS]


@dataclass(frozen=True)
class ClickModel:
    """A fitted model: ``transform`` adds ``probability`` to rows that hold the feature columns."""

    pipeline: PipelineModel | None
    encoder: RateEncoder | None
    metadata: dict = field(default_factory=dict)
    trees: boosting.BoostedTrees | None = None

    @property
    def version(self) -> str:
        return str(self.metadata.get("model_version", "unknown"))

    def transform(self, df: DataFrame) -> DataFrame:
        select_feature_columns(df)
        encoded = self.encoder.encode(df) if self.encoder else df
        if self.trees is not None:
            scored = self.trees.transform(encoded)
        else:
            scored = self.pipeline.transform(encoded).withColumn("probability", vector_to_array(F.col("_probability"))[1])
        return scored.select(*[c for c in df.columns if c != "probability"], "probability")

    def feature_importance(self, spark: SparkSession) -> DataFrame:
        """Importance per feature by how far its splits move predictions, with a sum of 100, largest first; empty for a linear model."""
        rows = []
        if self.trees is not None:
            share = self.trees.importance()
            rows = [(name, share.get(encoded, 0.0)) for name, encoded in zip(FEATURE_COLUMNS, ENCODED_COLUMNS)]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")

    def save(self, spark: SparkSession, folder: str) -> None:
        """Writes a version of its own, then one row that names it: a save that breaks off leaves the earlier version in place."""
        version = uuid.uuid4().hex
        place = f"{folder}/versions/{version}"
        if self.pipeline is not None:
            self.pipeline.save(f"{place}/pipeline")
        document = {
            "metadata": self.metadata,
            "encoder": None if self.encoder is None else asdict(self.encoder),
            "trees": None if self.trees is None else self.trees.to_dict(),
        }
        row = spark.createDataFrame([(json.dumps(document, sort_keys=True),)], "document string")
        row.coalesce(1).write.parquet(f"{place}/document")
        current = spark.createDataFrame([(version, time.time_ns())], "version string, saved_at long")
        current.coalesce(1).write.mode("append").parquet(f"{folder}/current")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> ClickModel:
        """The version saved last."""
        version = spark.read.parquet(f"{folder}/current").orderBy(F.desc("saved_at")).first()["version"]
        place = f"{folder}/versions/{version}"
        document = json.loads(spark.read.parquet(f"{place}/document").first()["document"])
        encoder = RateEncoder(**document["encoder"]) if document["encoder"] else None
        trees = boosting.BoostedTrees.from_dict(document["trees"]) if document["trees"] else None
        return cls(None if trees else PipelineModel.load(f"{place}/pipeline"), encoder, document["metadata"], trees)


def train_model(
    train: DataFrame, validation: DataFrame, config: TrainingConfig = TrainingConfig(), target: str = "click",
    time_col: str = "event_timestamp",
) -> ClickModel:
    """Fits the classifier on the train rows; boosting stops early by the validation rows."""
    config.check()
    keep = [*FEATURE_COLUMNS, target]
    timed = time_col in train.columns
    rate = train.agg(F.avg(F.col(target).cast("double"))).first()[0]
    encoder, trees, pipeline, fitted = None, None, None, {}
    if config.classifier == "logistic":
        stages = [
            FeatureHasher(
                inputCols=FEATURE_COLUMNS, categoricalCols=CATEGORICAL_FEATURES, outputCol="_features",
                numFeatures=config.hashed_dimensions,
            ),
            LogisticRegression(
                featuresCol="_features", labelCol=target, probabilityCol="_probability", rawPredictionCol="_raw",
                predictionCol="_prediction", maxIter=config.iterations, regParam=config.regularization / 1000,
            ),
        ]
        # Stored and read back: a classifier just fitted holds the summary of its training and with it the session, which
        # tasks that score cannot be sent once something was observed in it.
        path = work_path(train.sparkSession, "classifier")
        Pipeline(stages=stages).fit(train.select(*keep)).write().save(path)
        pipeline = PipelineModel.load(path)
    else:
        encoder = RateEncoder.fit(train, target, config)
        own = train.select(*keep, *([time_col] if timed else []))
        # Read several times while trees are learned, so it is stored once.
        encoded = encoder.ordered(own, target, time_col, config) if timed else encoder.encode(own, training=True)
        encoded = materialize(encoded.select(*ENCODED_COLUMNS, target))
        learned = boosting.fit(encoded, encoder.encode(validation.select(*keep)), ENCODED_COLUMNS, target, config.boosting())
        trees = learned.model
        fitted = {"best_round": learned.best_round, "validation_losses": learned.losses}
    now = datetime.now(timezone.utc)
    metadata = {
        "model_name": f"{config.classifier}_ctr",
        "model_version": now.strftime("ctr-%Y%m%dT%H%M%SZ"),
        "trained_at": now.isoformat(),
        "feature_columns": FEATURE_COLUMNS,
        "categorical_columns": CATEGORICAL_FEATURES,
        "numeric_columns": NUMERIC_FEATURES,
        "target_column": target,
        "training_config": asdict(config),
        "global_ctr": rate,
        **fitted,
    }
    return ClickModel(pipeline, encoder, metadata, trees)


@dataclass(frozen=True)
class Predictor:
    """Row scorer with a fallback, for batch tables, streams and the ranker.

    Without a model every row gets the fallback score. With one, rows the model cannot score, or
    all rows if the model cannot be applied at all, get it.
    """

    model: ClickModel | None = None
    prior: float = FALLBACK_CTR
    version: str = UNTRAINED_VERSION
    reason: str | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.score(df)

    def score(self, df: DataFrame, characters: DataFrame | None = None, order_col: str | None = None) -> DataFrame:
        """Adds ``predicted_ctr``, ``model_version`` and ``reasons`` to raw context rows."""
        fallback = fallback_score(df, self.prior, self.reason, self.version)
        if self.model is None:
            return fallback
        own = F.struct(*[F.col(name) for name in fallback.columns]).alias("_row")
        try:
            inputs = fallback.select("*", own)
            scored = self.model.transform(build_features(inputs, characters, order_col))
        except (AnalysisException, ValueError) as error:  # columns missing or of a kind the model cannot take
            first = F.array(F.lit(UNAVAILABLE + type(error).__name__))
            return fallback.withColumn("reasons", F.concat(first, F.col("reasons")))
        failed = F.col("probability").isNull() | F.isnan("probability")
        first = F.array(F.lit(UNAVAILABLE + "MissingScore"))
        model_reasons = F.array(*map(F.lit, MODEL_REASONS))
        return scored.select(
            *[F.col("_row")[name].alias(name) for name in df.columns],
            F.when(failed, F.col("_row.predicted_ctr"))
            .otherwise(numeric.serving_probability(F.col("probability"))).alias("predicted_ctr"),
            F.when(failed, F.lit(self.version)).otherwise(F.lit(self.model.version)).alias("model_version"),
            F.when(failed, F.concat(first, F.col("_row.reasons"))).otherwise(model_reasons).alias("reasons"),
        )

    def info(self) -> dict:
        """Name, version, training time, features and serving mode."""
        if self.model is None:
            return {
                "model_name": "global_ctr_fallback", "model_version": self.version, "trained_at": None,
                "features": FEATURE_COLUMNS,
                "metrics": {"serving_mode": "fallback", "fallback_reason": self.reason},
            }
        known = self.model.metadata
        return {
            "model_name": known.get("model_name", "unknown"), "model_version": self.model.version,
            "trained_at": known.get("trained_at"), "features": known.get("feature_columns", FEATURE_COLUMNS),
            "metrics": {**known.get("test_metrics", {}), "serving_mode": "primary_with_fallback"},
        }


def load_predictor(
    spark: SparkSession, folder: str, prior: float = FALLBACK_CTR, version: str = UNTRAINED_VERSION
) -> Predictor:
    """The saved model with its own fallback, or the plain fallback if there is none or it cannot be read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return Predictor(prior=prior, version=version, reason=NO_ARTIFACT)
    try:
        model = ClickModel.load(spark, folder)
    except (AnalysisException, Py4JJavaError, KeyError, TypeError, ValueError):  # unreadable or of another kind
        return Predictor(prior=prior, version=version, reason=BAD_ARTIFACT)
    return Predictor(
        model, float(model.metadata.get("global_ctr", prior)), model.metadata.get("model_version", version), INFERENCE_FAILED
    )


__all__ = [
    "ClickModel", "Predictor", "RateEncoder", "TrainingConfig", "global_ctr", "load_predictor", "train_model",
]
