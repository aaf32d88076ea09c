"""Business rules of scoring and ranking as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from clickloom.schema import UNKNOWN


def array_of(*items: Column) -> Column:
    """Array of the non-null items, in order."""
    return F.array_compact(F.array(*items))


def turn_stage(turn: Column) -> Column:
    return F.when(turn <= 2, "early").when(turn <= 8, "mid").otherwise("late")


def cold_start(train_count: Column, min_impressions: int) -> Column:
    seen = F.coalesce(train_count, F.lit(0))
    return F.when(seen < min_impressions, "cold_start_like").otherwise("graduated")


def blocks(context_tier: Column, candidate_tier: Column) -> Column:
    """Mature ads never show in a safe context; tiers are normalised."""
    return (context_tier == "sfw") & (candidate_tier == "mature")


def tier_match(context_tier: Column, candidate_tier: Column) -> Column:
    return (candidate_tier == context_tier) & (candidate_tier != UNKNOWN)


def safety_multiplier(context_tier: Column, candidate_tier: Column) -> Column:
    return F.when(tier_match(context_tier, candidate_tier), 1.05).otherwise(1.0)


def pacing_ratio(ratio: Column) -> Column:
    """A missing or zero ratio counts as on target."""
    return F.when(ratio != 0, ratio).otherwise(F.lit(1.0))


def pacing_multiplier(ratio: Column) -> Column:
    return (
        F.when(ratio > 1.0, F.greatest(F.lit(0.5), F.try_divide(F.lit(1.0), ratio)))
        .when((ratio >= 0.0) & (ratio < 0.8), 1.05)
        .otherwise(1.0)
    )


def pacing_reason(ratio: Column) -> Column:
    return (
        # These reason texts, and those of the functions below.
        F.when(ratio > 1.0, "pacing reduced overspending campaign")
        .when((ratio >= 0.0) & (ratio < 0.8), "pacing boosted underspending campaign")
        .otherwise("pacing on target")
    )


def fatigue_penalty(count: Column) -> Column:
    return F.when(count <= 3, 1.0).otherwise(F.greatest(F.lit(0.3), 1.0 - (count - 3) * F.lit(0.12)))


def fatigue_reason(count: Column) -> Column:
    return F.when(count <= 3, "fatigue within cap").otherwise("fatigue penalty applied")


def _unexplored(count: Column, ctr: Column) -> Column:
    return (count == 0) & (ctr < 0.08)


def exploration_bonus(count: Column, ctr: Column) -> Column:
    return F.when(_unexplored(count, ctr), 1.03).otherwise(1.0)


def exploration_reason(count: Column, ctr: Column) -> Column:
    return F.when(_unexplored(count, ctr), "under-explored candidate bonus").otherwise("no exploration bonus")


def ad_score(ctr: Column, context_tier: Column, candidate_tier: Column, ratio: Column, count: Column) -> Column:
    factors = (
        ctr
        * safety_multiplier(context_tier, candidate_tier)
        * pacing_multiplier(ratio)
        * fatigue_penalty(count)
        * exploration_bonus(count, ctr)
    )
    return F.round(factors, 8)


def ad_reasons(ctr: Column, context_tier: Column, candidate_tier: Column, ratio: Column, count: Column) -> Column:
    return array_of(
        pacing_reason(ratio),
        fatigue_reason(count),
        exploration_reason(count, ctr),
        F.when(tier_match(context_tier, candidate_tier), "safe tier match"),
    )
