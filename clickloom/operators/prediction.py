"""Scoring without a trained model: the constant baseline and the rule-based fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions import numeric, rules, text
from clickloom.schema import FALLBACK_CTR, UNKNOWN, UNTRAINED_VERSION


def global_ctr(train: DataFrame, target: str = "click") -> Column:
    """Training click rate as a scalar subquery."""
    return train.agg(F.avg(F.col(target).cast("double"))).scalar()


def baseline_score(df: DataFrame, train: DataFrame, target: str = "click") -> DataFrame:
    """The clipped training click rate for every row, as ``probability``."""
    return df.withColumn("probability", numeric.metric_probability(global_ctr(train, target)))


def _known(df: DataFrame, name: str) -> Column:
    value = text.canonical_text(text.column_sql(df, name), text.type_of(df, name))
    return F.expr(f"coalesce({value}, '') NOT IN ('', '{UNKNOWN}')")


def _count(df: DataFrame, name: str) -> Column:
    return F.expr(numeric.number_or_zero(text.column_sql(df, name), text.type_of(df, name)))


def fallback_columns(df: DataFrame, prior: float = FALLBACK_CTR, reason: str | None = None) -> tuple[Column, Column]:
    """Score and reasons of the rule-based fallback for the rows of ``df``."""
    app, site = _known(df, "app_category"), _known(df, "site_category")
    turn, messages = _count(df, "conversation_turn"), _count(df, "session_msg_count")
    session = messages > 0
    early = session & (F.try_divide(turn, messages) <= 0.25)
    score = (
        F.lit(float(prior))
        * F.when(app, 1.05).otherwise(1.0)
        * F.when(site, 1.03).otherwise(1.0)
        * F.when(early, 1.02).when(session, 0.98).otherwise(1.0)
    )
    reasons = rules.array_of(
        F.lit("fallback global CTR prior"),
        F.lit(reason).cast("string"),
        F.when(app, "app category available"),
        F.when(site, "site category available"),
        F.when(early, "early session context").when(session, "later session context"),
    )
    return numeric.serving_probability(score), reasons


def fallback_score(
    df: DataFrame,
    prior: float = FALLBACK_CTR,
    reason: str | None = None,
    version: str = UNTRAINED_VERSION,
) -> DataFrame:
    """Adds ``predicted_ctr``, ``model_version`` and ``reasons``."""
    score, reasons = fallback_columns(df, prior, reason)
    return df.withColumns({"predicted_ctr": score, "model_version": F.lit(version), "reasons": reasons})
