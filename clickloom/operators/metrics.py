"""Evaluation of scored rows: log loss, Brier, exact ROC AUC and average precision, calibration, top-k, slices.

A scored row has a label ``y`` (0 or 1), a score ``p`` and any key columns, such as model and split.
All metrics of all keys come out of one grouped plan; keys are text, with null as "unknown".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.functions import numeric, rules, text
from clickloom.operators.joins import join_dimension
from clickloom.operators.ordering import bucket_limits, histogram, running_totals
from clickloom.schema import COLD_START_MIN_IMPRESSIONS, SLICE_COLUMNS, UNKNOWN

# Report sizes.
TOP_K = (100, 1000, 10000)
CALIBRATION_BINS = 10
TOP_K_GROUPS = 64
TOP_SHARES = (0.9, 0.99, 0.999, 0.9999, 0.99999)
TOP_CELLS = 1000


def _keyed(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scored.withColumns({key: text.known_id(F.col(key)) for key in keys}) if keys else scored


def _score_counts(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and clicks per (keys, clipped score): all the threshold metrics need."""
    return (
        _keyed(scored, keys)
        .select(*keys, F.col("y").cast("int").alias("y"), numeric.metric_probability(F.col("p")).alias("p"))
        .groupBy(*keys, "p")
        .agg(F.count("*").alias("rows"), F.sum("y").alias("clicks"))
    )


def _metric_columns() -> list[Column]:
    """Aggregates over (p, rows, clicks) with running totals in ascending score order."""
    rows, clicks, p = F.col("rows"), F.col("clicks"), F.col("p")
    misses = rows - clicks
    n, positives = F.sum(rows), F.sum(clicks)
    negatives = n - positives
    both = (positives > 0) & (negatives > 0)
    # Misses scored lower count fully, misses with the same score count half.
    below = F.col("cum_rows") - F.col("cum_clicks") - misses
    wins = F.sum(clicks * (below + misses * 0.5))
    log_loss = F.sum(-(clicks * F.log(p) + misses * F.log(1 - p)))
    brier = F.sum(clicks * (1 - p) * (1 - p) + misses * p * p)
    return [
        n.alias("n"), positives.alias("clicks"), (positives / n).alias("ctr"),
        (log_loss / n).alias("log_loss"), (brier / n).alias("brier_score"),
        F.when(both, wins / (positives.cast("double") * negatives)).alias("roc_auc"),
        # Precision at each distinct score, weighted by the clicks at that score.
        F.when(both, F.sum(clicks * F.try_divide(F.col("from_top_clicks"), F.col("from_top_rows"))) / positives).alias("pr_auc"),
    ]


METRIC_NAMES = ["n", "clicks", "ctr", "log_loss", "roc_auc", "pr_auc", "brier_score"]


def binary_metrics(scored: DataFrame, keys: Sequence[str] = (), limits: Sequence[float] | None = None) -> DataFrame:
    """Count, clicks, rate, log loss, ROC AUC, average precision and Brier score per key group.

    ``limits`` are score bucket limits for the exact ranking metrics; by default one extra pass over
    the scores finds quantiles. They affect balance only, not results.
    """
    if limits is None:
        limits = bucket_limits(scored, "p")
    counts = _score_counts(scored, keys)
    running = running_totals(counts, list(keys), "p", ["rows", "clicks"], limits)
    ranked = running.withColumns({
        "from_top_rows": F.col("all_rows") - F.col("cum_rows") + F.col("rows"),
        "from_top_clicks": F.col("all_clicks") - F.col("cum_clicks") + F.col("clicks"),
    })
    return ranked.groupBy(*keys).agg(*_metric_columns()).select(*keys, *METRIC_NAMES)


def bin_edges(bins: int) -> list[float]:
    """Equal-width edges from 0 to 1; inner edges are multiples of 1/bins in floating point."""
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def calibration_table(scored: DataFrame, keys: Sequence[str] = (), bins: int = CALIBRATION_BINS) -> DataFrame:
    """Predicted and observed rate per score bin; bins are open at the left and closed at the right."""
    edges = bin_edges(bins)
    p = numeric.metric_probability(F.col("p"))
    number = F.lit(1)
    for edge in edges[1:-1]:
        number = number + (F.col("p") > edge).cast("int")
    edge_list = F.lit(edges)
    return (
        _keyed(scored, keys).withColumn("p", p).withColumn("bin", number)
        .groupBy(*keys, "bin")
        .agg(
            F.count("*").alias("count"),
            F.avg("p").alias("mean_predicted_ctr"),
            F.avg(F.col("y").cast("double")).alias("observed_ctr"),
        )
        .select(
            *keys, "bin",
            F.element_at(edge_list, F.col("bin")).alias("lower_bound"),
            F.element_at(edge_list, F.col("bin") + 1).alias("upper_bound"),
            "count", "mean_predicted_ctr", "observed_ctr",
        )
    )


def calibration_error(calibration: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count-weighted mean gap between predicted and observed rate."""
    gap = F.abs(F.col("mean_predicted_ctr") - F.col("observed_ctr"))
    error = F.try_divide(F.sum(F.col("count") * gap), F.sum("count"))
    return calibration.groupBy(*keys).agg(error.alias("calibration_error"))


def _cut_to_top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Drops rows that cannot be among the k best of their key group.

    Candidate cuts come from a histogram of the scores, about where the top shares begin. Each group takes the highest cut
    that leaves it k rows by an exact count, so cuts need not be exact.
    """
    cells = histogram(rows, "p", TOP_CELLS)
    total, above, cuts = sum(n for _, n in cells), 0, []
    left = sorted(TOP_SHARES, reverse=True)
    for low, n in reversed(cells):
        above += n
        while left and above >= total * (1 - left[0]):
            cuts.append(low)
            left.pop(0)
    if not cuts:
        return rows
    choice = F.lit(float("-inf"))
    for cut in sorted(set(cuts)):
        choice = F.when(F.count_if(F.col("p") >= cut) >= k, F.lit(cut)).otherwise(choice)
    if not keys:
        return rows.where(F.col("p") >= rows.agg(choice).scalar())
    chosen = rows.groupBy(*keys).agg(choice.alias("_cut"))  # one row per key group
    return rows.join(F.broadcast(chosen), keys).where(F.col("p") >= F.col("_cut")).drop("_cut")


def topk_rows(scored: DataFrame, keys: Sequence[str], k: int, id_col: str = "id") -> DataFrame:
    """The k best rows per key group with their ``rank``; ties go by id.

    Rows below a safe cut are dropped in place. The rest is reduced in steps - per task, per group of
    tasks, overall - so that even if one score holds most rows, no task sees more than its share.
    """
    keys = list(keys)
    best = [F.desc("p"), F.col(id_col)]
    rows = _keyed(scored, keys).select(*keys, id_col, F.col("y").cast("int").alias("y"), F.col("p").cast("double").alias("p"))
    kept = _cut_to_top(rows, keys, k).withColumn("_task", F.spark_partition_id())
    for salt in (F.col("_task"), F.col("_task") % TOP_K_GROUPS):
        place = F.row_number().over(Window.partitionBy(*keys, salt).orderBy(*best))
        kept = kept.withColumn("rank", place).where(F.col("rank") <= k)
    final = F.row_number().over(Window.partitionBy(*keys).orderBy(*best))
    return kept.drop("_task").withColumn("rank", final).where(F.col("rank") <= k)


def topk_metrics(
    scored: DataFrame, keys: Sequence[str] = (), k_values: Sequence[int] = TOP_K, id_col: str = "id"
) -> DataFrame:
    """Click rate, precision and lift of the best k rows, for each k, by unclipped score."""
    keys = list(keys)
    best = topk_rows(scored, keys, max(k_values), id_col)
    sums = [
        F.named_struct(
            F.lit("k"), F.lit(k),
            F.lit("effective_k"), F.count_if(F.col("rank") <= k),
            F.lit("ctr_at_k"), F.avg(F.when(F.col("rank") <= k, F.col("y"))),
        )
        for k in k_values
    ]
    top = best.groupBy(*keys).agg(F.array(*sums).alias("tops")).select(*keys, F.explode("tops").alias("top"))
    overall = _keyed(scored, keys).groupBy(*keys).agg(F.avg(F.col("y").cast("double")).alias("overall_ctr"))
    if keys:
        joined = top.join(overall, keys)
    else:
        joined = top.withColumn("overall_ctr", overall.scalar())
    rate = F.col("top.ctr_at_k")
    return joined.select(
        *keys,
        F.col("top.k").alias("k"),
        rate.alias("ctr_at_k"),
        rate.alias("precision_at_k"),
        F.when(F.col("overall_ctr") > 0, rate / F.col("overall_ctr")).alias("lift_at_k"),
        F.col("top.effective_k").alias("effective_k"),
        "overall_ctr",
    )


def character_counts(train: DataFrame) -> DataFrame:
    """Training impressions per character."""
    return train.groupBy(text.known_id(F.col("character_id")).alias("character_id")).agg(
        F.count("*").alias("train_impressions")
    )


def add_slice_columns(
    frame: DataFrame, train_counts: DataFrame, min_impressions: int = COLD_START_MIN_IMPRESSIONS
) -> DataFrame:
    """Adds ``turn_stage`` and ``cold_start_character``."""
    turn = numeric.number_or_zero(
        text.column_sql(frame, "conversation_turn"), text.type_of(frame, "conversation_turn")
    )
    keyed = frame.withColumn("character_id", text.known_id(text.column_or_default(frame, "character_id", UNKNOWN)))
    return (
        join_dimension(keyed, train_counts, "character_id")
        .withColumns({
            "turn_stage": rules.turn_stage(F.expr(turn)),
            "cold_start_character": rules.cold_start(F.col("train_impressions"), min_impressions),
        })
        .drop("train_impressions")
    )


def _long_slices(scored: DataFrame, keys: list[str], slices: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(name).alias("slice"), text.known_id(F.col(name)).alias("value")) for name in slices])
    long = _keyed(scored, keys).select(*keys, "y", "p", F.explode(pairs).alias("pair"))
    return long.select(*keys, "y", "p", "pair.slice", "pair.value")


def _slice_rows(long: DataFrame, group: list[str], min_count: int | None) -> DataFrame:
    """Rows per slice value and whether they reach the floor."""
    counts = long.groupBy(*group, "value").agg(F.count("*").alias("rows"))
    totals = counts.groupBy(*group).agg(F.sum("rows").alias("total"))
    floor = F.lit(min_count) if min_count is not None else F.greatest(
        F.lit(10), F.least(F.lit(100), F.floor(F.col("total") * 0.01))
    )
    return counts.join(totals, group).select(*group, "value", "rows", (F.col("rows") >= floor).alias("enough"))


def slice_coverage(
    scored: DataFrame, keys: Sequence[str] = (), slices: Sequence[str] = SLICE_COLUMNS, min_count: int | None = None
) -> DataFrame:
    """Per slice: how many values and rows have metrics, and how many are below the row floor."""
    group = [*keys, "slice"]
    rows = _slice_rows(_long_slices(scored, list(keys), [name for name in slices if name in scored.columns]), group, min_count)
    enough = F.col("enough")
    return rows.groupBy(*group).agg(
        F.count_if(enough).alias("values_measured"), F.count_if(~enough).alias("values_left_out"),
        F.sum(F.when(enough, F.col("rows")).otherwise(0)).alias("rows_measured"),
        F.sum(F.when(enough, 0).otherwise(F.col("rows"))).alias("rows_left_out"),
    )


def slice_metrics(
    scored: DataFrame,
    keys: Sequence[str] = (),
    slices: Sequence[str] = SLICE_COLUMNS,
    min_count: int | None = None,
    max_values: int | None = None,
    limits: Sequence[float] | None = None,
) -> DataFrame:
    """Metrics per slice value with enough rows; ``slice_coverage`` tells what the floor leaves out.

    The row floor is 1% of the key group's rows, within 10 to 100, unless given. ``max_values`` keeps the most frequent
    values of each slice only; by default there is no such limit.
    """
    keys = list(keys)
    present = [name for name in slices if name in scored.columns]
    long = _long_slices(scored, keys, present)
    group = [*keys, "slice"]
    kept = _slice_rows(long, group, min_count).where("enough")
    if max_values is not None:
        by_count = Window.partitionBy(*group).orderBy(F.desc("rows"), "value")
        kept = kept.withColumn("place", F.row_number().over(by_count)).where(F.col("place") <= max_values)
    # The floor bounds the values of a slice by 100 of each key group's rows; Spark chooses the join by their size.
    chosen = long.join(kept.select(*group, "value"), [*group, "value"], "left_semi")
    if limits is None:
        limits = bucket_limits(scored, "p")
    return binary_metrics(chosen, [*group, "value"], limits)


def evaluate(
    scored: DataFrame,
    train_counts: DataFrame,
    keys: Sequence[str] = ("model", "split"),
    min_impressions: int = COLD_START_MIN_IMPRESSIONS,
    id_col: str = "id",
) -> dict[str, DataFrame]:
    """All metric tables of a scored table, keyed by model and split.

    The score limits are looked up once. Store the scored table first: each result reads it again.
    """
    limits = bucket_limits(scored, "p")
    calibration = calibration_table(scored, keys)
    sliced = add_slice_columns(scored, train_counts, min_impressions)
    return {
        "metrics": binary_metrics(scored, keys, limits),
        "calibration": calibration,
        "calibration_error": calibration_error(calibration, keys),
        "ranking": topk_metrics(scored, keys, id_col=id_col),
        "slices": slice_metrics(sliced, keys, limits=limits),
        "slice_coverage": slice_coverage(sliced, keys),
    }
