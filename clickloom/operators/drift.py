"""Drift over time: periods, click rate series, distributions, PSI, KL divergence, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.functions import numeric, temporal, text
from clickloom.operators.features import add_time_features, build_features
from clickloom.operators.ordering import Cuts, TimeOrder, cut_at
from clickloom.schema import DRIFT_FEATURES, PERIODS, UNKNOWN

# The smoothing term, and how many entries the top lists have.
EPSILON = 1e-9
TOP_VALUES = 5
TOP_CHARACTERS = 10


def _period_ends(total: Column) -> dict[str, Column]:
    return {"early": F.ceil(total / 3) - 1, "middle": F.ceil(total * 2 / 3) - 1}


def assign_periods(df: DataFrame, order: TimeOrder = TimeOrder()) -> DataFrame:
    """Adds ``period``: the tercile of the row's position in time order, exact also on ties.

    Only the boundary keys are looked up; rows are compared with them and not shuffled.
    """
    cuts = cut_at(df, order, _period_ends)
    return cuts.finish(cuts.frame.withColumn("period", _period_label(cuts)))


def _period_label(cuts: Cuts) -> Column:
    if not cuts.upto:
        return F.lit(None).cast("string")
    return F.when(cuts.upto["early"], PERIODS[0]).when(cuts.upto["middle"], PERIODS[1]).otherwise(PERIODS[2])


def prepare_drift_frame(
    impressions: DataFrame,
    characters: DataFrame | None,
    order_col: str | None = None,
    as_of: str | None = None,
    order: TimeOrder = TimeOrder(),
) -> DataFrame:
    """Feature frame with a click in [0, 1], the period and the day and hour labels."""
    # Periods depend on the impressions alone: they are found before the dimension is joined.
    cuts = cut_at(add_time_features(impressions), order, _period_ends)
    placed = cuts.finish(cuts.frame.withColumn("period", _period_label(cuts)))
    frame = build_features(placed, characters, order_col, as_of)
    click = F.expr(numeric.number_or_zero(text.column_sql(frame, "click"), text.type_of(frame, "click")))
    time = F.col("event_timestamp")
    return frame.withColumns({
        "click": numeric.clip(click, 0.0, 1.0),
        "event_day": temporal.day_label(time),
        "event_hour_bucket": temporal.hour_label(time),
    })


def _volume() -> list[Column]:
    return [F.count("*").alias("impressions"), F.avg("click").alias("ctr")]


def period_summary(frame: DataFrame) -> DataFrame:
    return frame.groupBy("period").agg(*_volume())


def ctr_delta(frame: DataFrame) -> DataFrame:
    """Latest minus early click rate; a missing period counts as 0."""
    def rate(period: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col("period") == period, F.col("click"))), F.lit(0.0))

    return frame.agg(
        F.count("*").alias("row_count"),
        (rate("latest") - rate("early")).alias("ctr_delta_latest_vs_early"),
    )


def ctr_by_day(frame: DataFrame) -> DataFrame:
    return frame.groupBy("event_day").agg(*_volume()).orderBy("event_day")


def volume_by_hour(frame: DataFrame, limit: int | None = None) -> DataFrame:
    """Volume and click rate of every hour, or of the first ``limit`` hours."""
    hours = frame.groupBy("event_hour_bucket").agg(*_volume()).orderBy("event_hour_bucket")
    return hours if limit is None else hours.limit(limit)


def _category(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(UNKNOWN))


def value_distribution(frame: DataFrame, feature: str) -> DataFrame:
    """Share of rows per value."""
    counts = frame.groupBy(_category(feature).alias("value")).agg(F.count("*").alias("impressions"))
    return counts.withColumn("share", F.col("impressions") / counts.agg(F.sum("impressions")).scalar())


def long_features(frame: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Counts per (keys, feature, value) in one pass over the rows."""
    present = [name for name in features if name in frame.columns]
    pairs = F.array(*[F.struct(F.lit(name).alias("feature"), _category(name).alias("value")) for name in present])
    return (
        frame.select(*keys, F.explode(pairs).alias("pair"))
        .groupBy(*keys, F.col("pair.feature").alias("feature"), F.col("pair.value").alias("value"))
        .agg(F.count("*").alias("impressions"))
    )


def distribution_by_period(frame: DataFrame, features: list[str] = ["safety_tier", "app_category"]) -> DataFrame:
    """Share of each value within its period."""
    counts = long_features(frame, features, ["period"])
    # Each row has one value of every feature, so the counts of a feature add up to the rows of the period.
    totals = counts.groupBy("period", "feature").agg(F.sum("impressions").alias("total"))
    return counts.join(F.broadcast(totals), ["period", "feature"]).select(  # three rows a feature
        "period", "feature", "value", "impressions", (F.col("impressions") / F.col("total")).alias("share")
    )


def period_shares(frame: DataFrame, features: list[str] = DRIFT_FEATURES) -> DataFrame:
    """Early (reference) and latest (current) share per feature value; a missing value has share 0."""
    shares = distribution_by_period(frame, features).where(F.col("period").isin("early", "latest"))

    def share(period: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("period") == period, F.col("share"))), F.lit(0.0))

    return shares.groupBy("feature", "value").agg(
        share("early").alias("reference_share"), share("latest").alias("current_share")
    )


def pair_distributions(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Shares of two distributions over the union of their values."""
    left = reference.select("value", F.col("share").alias("reference_share"))
    right = current.select("value", F.col("share").alias("current_share"))
    return left.join(right, "value", "full_outer").select(
        "value",
        F.coalesce("reference_share", F.lit(0.0)).alias("reference_share"),
        F.coalesce("current_share", F.lit(0.0)).alias("current_share"),
    )


def shift_measures() -> list[Column]:
    """PSI, KL divergence and total variation over (reference_share, current_share) rows."""
    reference, current = F.col("reference_share"), F.col("current_share")
    smooth_reference, smooth_current = reference + EPSILON, current + EPSILON
    return [
        F.sum((current - reference) * F.log(smooth_current / smooth_reference)).alias("psi"),
        F.sum(smooth_reference * F.log(smooth_reference / smooth_current)).alias("kl_divergence"),
        (F.sum(F.abs(current - reference)) * 0.5).alias("normalized_distribution_delta"),
    ]


def feature_shift(frame: DataFrame, features: list[str] = DRIFT_FEATURES) -> DataFrame:
    return period_shares(frame, features).groupBy("feature").agg(*shift_measures())


def top_values(frame: DataFrame, features: list[str] = DRIFT_FEATURES, limit: int = TOP_VALUES) -> DataFrame:
    """The most frequent values of the early and of the latest period."""
    shares = distribution_by_period(frame, features).where(F.col("period").isin("early", "latest"))
    order = Window.partitionBy("period", "feature").orderBy(F.desc("impressions"), "value")
    return shares.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def concentration(frame: DataFrame, top: int = TOP_CHARACTERS) -> DataFrame:
    """Share of the largest and of the ``top`` largest characters, and the number of characters."""
    counts = frame.groupBy("period", _category("character_id").alias("character_id")).agg(
        F.count("*").alias("n")
    )
    order = Window.partitionBy("period").orderBy(F.desc("n"), "character_id")
    largest = (
        counts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .groupBy("period")
        .agg(F.max("n").alias("top_n"), F.sum("n").alias("top_10_n"))
    )
    totals = counts.groupBy("period").agg(F.sum("n").alias("total"), F.count("*").alias("unique_characters"))
    return totals.join(F.broadcast(largest), "period").select(  # three rows each
        "period",
        (F.col("top_n") / F.col("total")).alias("top_character_share"),
        (F.col("top_10_n") / F.col("total")).alias("top_10_character_share"),
        "unique_characters",
    )
