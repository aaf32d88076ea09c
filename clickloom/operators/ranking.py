"""Ranking of candidate ads: request gate, safety gate, field override, score rules, order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.functions import rules, text
from clickloom.operators.prediction import fallback_columns, fallback_score
from clickloom.schema import AD_FIELDS, FALLBACK_CTR, MAX_RANK_CANDIDATES, SAFETY_TIERS

Scorer = Callable[[DataFrame], DataFrame]


def _size_verdict(size: Column, limit: int) -> Column:
    return F.when(size == 0, "empty_candidates").when(size > limit, "too_many_candidates")


def gate_requests(requests: DataFrame, limit: int = MAX_RANK_CANDIDATES) -> DataFrame:
    """Adds ``rejection``: null for an accepted request, else the reason code."""
    size = F.coalesce(F.size("candidates"), F.lit(0))
    return requests.withColumn("rejection", _size_verdict(F.greatest(size, F.lit(0)), limit))


def candidate_violations(candidates: DataFrame) -> DataFrame:
    """Adds ``violations``: codes of the field rules a candidate breaks (empty when it is valid)."""
    def negative(name: str) -> Column:
        if name not in candidates.columns:
            return F.lit(None).cast("string")
        return F.when(F.col(name) < 0, f"negative_{name}")

    checks = [negative(name) for name in ("bid", "fatigue_count", "pacing_ratio")]
    if "safety_tier" in candidates.columns:
        checks.insert(0, F.when(~F.col("safety_tier").isin(SAFETY_TIERS), "invalid_safety_tier"))
    return candidates.withColumn("violations", rules.array_of(*checks))


def prediction_violations(scored: DataFrame) -> DataFrame:
    """Adds ``violations`` for a rate outside [0, 1] or a negative final score."""
    checks = []
    if "predicted_ctr" in scored.columns:
        checks.append(F.when(~F.col("predicted_ctr").between(0.0, 1.0), "predicted_ctr_out_of_range"))
    if "final_score" in scored.columns:
        checks.append(F.when(F.col("final_score") < 0, "negative_final_score"))
    return scored.withColumn("violations", rules.array_of(*checks, F.lit(None).cast("string")))


def quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and invalid rows with their reason codes."""
    valid = F.size("violations") == 0
    return checked.where(valid).drop("violations"), checked.where(~valid)


def assemble_requests(
    contexts: DataFrame,
    candidates: DataFrame,
    order_cols: list[str],
    limit: int = MAX_RANK_CANDIDATES,
) -> DataFrame:
    """Contexts with ``candidate_count``, ``rejection`` and, if accepted, the ``candidates`` array.

    Candidate rows carry ``request_id``. Requests above ``limit`` are rejected by their full count, so
    no more than ``limit`` rows of a request need to be moved or gathered; each task already drops the
    others before the shuffle. All sides share one partitioning by request.
    """
    counts = candidates.groupBy("request_id").agg(F.count("*").alias("candidate_count"))
    fields = [name for name in candidates.columns if name not in ("request_id", *order_cols)]
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(*order_cols))
    lists = (
        candidates.withColumn("_place", place).where(F.col("_place") <= limit)
        .groupBy("request_id")
        .agg(F.array_sort(F.collect_list(F.struct("_place", F.struct(*fields).alias("ad")))).alias("_ads"))
    )
    size = F.coalesce("candidate_count", F.lit(0))
    joined = contexts.join(counts, "request_id", "left").join(lists, "request_id", "left")
    return (
        joined.withColumn("candidate_count", size)
        .withColumn("rejection", _size_verdict(F.col("candidate_count"), limit))
        .withColumn("candidates", F.when(F.col("rejection").isNull(), F.col("_ads.ad")))
        .drop("_ads")
    )


def _candidate_fields(df: DataFrame) -> list[str]:
    return df.schema["candidates"].dataType.elementType.names


def _from_ad(ad: Column, fields: list[str], name: str, default) -> Column:
    return F.coalesce(ad[name], F.lit(default)) if name in fields else F.lit(default)


def _ad_terms(ad: Column, fields: list[str], position: Column) -> dict[str, Column]:
    """Candidate-side inputs of the score rules."""
    given = ad["candidate_id"].cast("string") if "candidate_id" in fields else F.lit(None).cast("string")
    tier = ad["safety_tier"] if "safety_tier" in fields else F.lit(None).cast("string")
    return {
        "candidate_id": F.coalesce(
            F.nullif(given, F.lit("")), F.concat(F.lit("candidate-"), (position + 1).cast("string"))
        ),
        "tier": text.normalize_tier(tier),
        "ratio": rules.pacing_ratio(_from_ad(ad, fields, "pacing_ratio", 1.0).cast("double")),
        "count": _from_ad(ad, fields, "fatigue_count", 0).cast("int"),
    }


def explode_candidates(requests: DataFrame) -> DataFrame:
    """One row per shown candidate: context fields overridden by the ad's, and the rule inputs.

    Positions count every candidate of the request, also those the safety gate then drops.
    """
    fields = _candidate_fields(requests)
    context_tier = text.normalize_tier(text.column_or_default(requests, "safety_tier"))
    terms = _ad_terms(F.col("ad"), fields, F.col("position"))
    rows = requests.select(
        *[name for name in requests.columns if name != "candidates"],
        context_tier.alias("context_tier"),
        F.posexplode("candidates").alias("position", "ad"),
    ).withColumns({
        "candidate_id": terms["candidate_id"],
        "candidate_tier": terms["tier"],
        "ad_pacing_ratio": terms["ratio"],
        "ad_fatigue_count": terms["count"],
    })
    merged = {}
    for name in AD_FIELDS:
        if name in fields:
            own = F.col(name) if name in requests.columns else F.lit(None)
            merged[name] = F.coalesce(F.col("ad")[name].cast("string"), own.cast("string"))
    rows = rows.withColumns(merged) if merged else rows
    return rows.drop("ad").where(~rules.blocks(F.col("context_tier"), F.col("candidate_tier")))


def rank_rows(rows: DataFrame, score: Scorer = fallback_score) -> DataFrame:
    """Scores exploded candidates and ranks them within their request.

    One scoring call covers all rows. Requests hold a bounded number of candidates (see the gate),
    so the window partitions are small.
    """
    inputs = [F.col(name) for name in (
        "predicted_ctr", "context_tier", "candidate_tier", "ad_pacing_ratio", "ad_fatigue_count",
    )]
    scored = score(rows).withColumns({
        "final_score": rules.ad_score(*inputs),
        "reasons": F.concat("reasons", rules.ad_reasons(*inputs)),
    })
    order = Window.partitionBy("request_id").orderBy(F.desc("final_score"), "position")
    return scored.withColumn("rank", F.row_number().over(order)).select(
        "request_id", "position", "candidate_id", "rank", "predicted_ctr", "final_score", "reasons",
    )


def rank_candidates(requests: DataFrame, score: Scorer = fallback_score, limit: int = MAX_RANK_CANDIDATES) -> DataFrame:
    """Ranked rows of the accepted requests, scored by any row scorer."""
    accepted = gate_requests(requests, limit).where(F.col("rejection").isNull()).drop("rejection")
    return rank_rows(explode_candidates(accepted), score)


def regroup_ranked(ranked: DataFrame) -> DataFrame:
    """One row per request with its candidates in rank order."""
    item = F.struct("rank", "candidate_id", "predicted_ctr", "final_score", "reasons")
    return ranked.groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("ranked_candidates"))


def rank_arrays(
    requests: DataFrame,
    prior: float = FALLBACK_CTR,
    reason: str | None = None,
    limit: int = MAX_RANK_CANDIDATES,
) -> DataFrame:
    """Ranks each accepted request inside its own row with the fallback score; no shuffle, streamable."""
    accepted = gate_requests(requests, limit).where(F.col("rejection").isNull()).drop("rejection")
    fields = _candidate_fields(accepted)
    ctr, reasons = fallback_columns(accepted, prior, reason)
    tier = text.normalize_tier(text.column_or_default(accepted, "safety_tier"))
    base = accepted.withColumns({"_ctr": ctr, "_reasons": reasons, "_tier": tier})

    def shown(ad: Column, position: Column) -> Column:
        terms = _ad_terms(ad, fields, position)
        return F.struct(position.alias("position"), *[value.alias(name) for name, value in terms.items()])

    def scored(entry: Column) -> Column:
        inputs = [F.col("_ctr"), F.col("_tier"), entry["tier"], entry["ratio"], entry["count"]]
        return F.struct(
            (-rules.ad_score(*inputs)).alias("sort_key"),
            entry["position"].alias("position"),
            entry["candidate_id"].alias("candidate_id"),
            rules.ad_reasons(*inputs).alias("reasons"),
        )

    def ranked(entry: Column, place: Column) -> Column:
        return F.struct(
            (place + 1).cast("int").alias("rank"),
            entry["candidate_id"].alias("candidate_id"),
            F.col("_ctr").alias("predicted_ctr"),
            (-entry["sort_key"]).alias("final_score"),
            F.concat("_reasons", entry["reasons"]).alias("reasons"),
        )

    # Each step computes its values once per candidate; the next one only reads them.
    entries = F.filter(F.transform("candidates", shown), lambda entry: ~rules.blocks(F.col("_tier"), entry["tier"]))
    return base.select("request_id", F.transform(F.array_sort(F.transform(entries, scored)), ranked).alias("ranked_candidates"))
