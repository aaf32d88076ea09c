"""The registered queries: each runs an operator over whole provided tables, with DuckDB SQL to compare."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clickloom.functions import numeric, rules, temporal, text
from clickloom.operators import (
    boosting, drift, features, layout, metrics, model, ordering, prediction, quality, ranking, requestlog, split, statistics,
)
from clickloom.plans import jobs, training, views
from clickloom.plans.view_sql import PARSED_HOUR, with_views
from clickloom.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from clickloom.session import materialize, shared_dir, work_path
from clickloom.sources import sinks, tables
from clickloom.streaming import live

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        QUERIES[name] = Query(build, sql)
        return build
    return add


def r6(name: str, alias: str | None = None) -> Column:
    return F.round(F.col(name).cast("double"), 6).alias(alias or name)


def joined_reasons() -> Column:
    return F.array_join("reasons", "|").alias("reasons")


def clean(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return views.impressions(spark, sf_dir), views.characters(spark, sf_dir)


def dirty(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return views.dirty_impressions(spark, sf_dir), views.characters(spark, sf_dir)


# Expressions and features


@register("ctr_by_day_and_tier", with_views(["featured"], """
SELECT strftime(event_timestamp, '%Y-%m-%d') AS event_day, tier AS safety_tier, count(*) AS impressions,
  round(avg(click), 6) AS ctr
FROM featured GROUP BY ALL"""))
def ctr_by_day_and_tier(spark, sf_dir):
    impressions, characters = clean(spark, sf_dir)
    frame = features.build_features(impressions, characters, "version")
    return (
        frame.groupBy(temporal.day_label(F.col("event_timestamp")).alias("event_day"), "safety_tier")
        .agg(F.count("*").alias("impressions"), F.round(F.avg("click"), 6).alias("ctr"))
    )


_MIXED_HOUR = """CASE event_id % 6 WHEN 0 THEN strftime(ts, '%y%m%d%H') WHEN 1 THEN strftime(ts, ' %y%m%d%H.0 ')
  WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 3 THEN strftime(ts, '%y%m%d') || '24'
  WHEN 4 THEN 'hour ' || event_id ELSE strftime(ts, '%Y-%m-%d') END"""


@register("parse_hour", f"""
SELECT event_id::VARCHAR AS id, h AS hour, {PARSED_HOUR.format('h')} AS event_timestamp
FROM (SELECT event_id, {_MIXED_HOUR} AS h FROM events)""")
def parse_hour(spark, sf_dir):
    ts = F.col("ts")
    form = F.col("event_id") % 6
    packed = F.date_format(ts, "yyMMddHH")
    hour = (
        F.when(form == 0, packed)
        .when(form == 1, F.concat(F.lit(" "), packed, F.lit(".0 ")))
        .when(form == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(form == 3, F.concat(F.date_format(ts, "yyMMdd"), F.lit("24")))
        .when(form == 4, F.concat(F.lit("hour "), "event_id"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )
    events = views.table(spark, sf_dir, "events")
    return events.select(F.col("event_id").cast("string").alias("id"), hour.alias("hour")).withColumn(
        "event_timestamp", temporal.parse_hour("hour")
    )


@register("parse_zoned_hour", """
SELECT event_id::VARCHAR AS id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 150 MINUTE
  WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('day', ts) END AS event_timestamp FROM events""")
def parse_zoned_hour(spark, sf_dir):
    form = F.col("event_id") % 4
    hour = (
        F.when(form == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(form == 1, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+02:30")))
        .when(form == 2, F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy/M/d"))
    )
    events = views.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), hour.alias("hour"))
    return events.select("id", temporal.parse_hour("hour").alias("event_timestamp"))


@register("utc_timestamp", """
SELECT event_id::VARCHAR AS id, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts)
  WHEN 1 THEN date_trunc('second', ts) - INTERVAL 150 MINUTE END AS utc_time
FROM events""")
def utc_timestamp(spark, sf_dir):
    form = F.col("event_id") % 3
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    written = F.when(form == 0, F.concat(plain, F.lit("Z"))).when(form == 1, F.concat(plain, F.lit("+02:30"))).otherwise("soon")
    df = views.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), written.alias("t"))
    return df.select("id", temporal.to_utc_naive(F.col("t"), df.schema["t"].dataType).alias("utc_time"))


@register("numeric_coerce", """
SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN round(value * 1000, 6) WHEN 2 THEN -value END AS number
FROM events""")
def numeric_coerce(spark, sf_dir):
    form = F.col("event_id") % 5
    value = F.col("value").cast("string")
    written = (
        F.when(form == 0, F.concat(F.lit(" "), value, F.lit(" "))).when(form == 1, F.concat(value, F.lit("e3")))
        .when(form == 2, F.concat(F.lit("-"), value)).when(form == 3, F.concat(value, F.lit("d"))).otherwise("NaN")
    )
    df = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), written.alias("t"))
    return df.select("id", F.round(F.expr(numeric.to_number("t", df.schema["t"].dataType)), 6).alias("number"))


@register("time_features", with_views(["featured"], """
SELECT id, event_timestamp, hour_of_day::INTEGER AS hour_of_day, day_of_week::INTEGER AS day_of_week, is_weekend
FROM featured""", dirty=True))
def time_features(spark, sf_dir):
    frame = features.add_time_features(views.dirty_impressions(spark, sf_dir))
    return frame.select("id", "event_timestamp", "hour_of_day", "day_of_week", "is_weekend")


@register("turn_features", with_views(["featured"], """
SELECT id, turn AS conversation_turn, messages AS session_msg_count, round(turn_ratio, 6) AS turn_ratio
FROM featured""", dirty=True))
def turn_features(spark, sf_dir):
    frame = features.add_turn_features(views.dirty_impressions(spark, sf_dir))
    return frame.select("id", "conversation_turn", "session_msg_count", r6("turn_ratio"))


@register("conversation_turn_features", """
SELECT conv_id, turn, n AS messages, round(turn::DOUBLE / n, 6) AS turn_ratio,
  CASE WHEN turn <= 2 THEN 'early' WHEN turn <= 8 THEN 'mid' ELSE 'late' END AS turn_stage
FROM conversations JOIN (SELECT conv_id, count(*)::DOUBLE AS n FROM conversations GROUP BY 1) USING (conv_id)""")
def conversation_turn_features(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("session_msg_count"))
    frame = turns.join(counts, "conv_id").withColumn("conversation_turn", F.col("turn"))
    return features.add_turn_features(frame).select(
        "conv_id", "turn", F.col("session_msg_count").alias("messages"), r6("turn_ratio"),
        rules.turn_stage(F.col("conversation_turn")).alias("turn_stage"),
    )


@register("deduplicate_characters", with_views(["dedup"], """
SELECT character_id, character_name, safety_tier, creator_type, num_interactions, created_at, version FROM dedup"""))
def deduplicate_characters(spark, sf_dir):
    return features.deduplicate_characters(views.characters(spark, sf_dir), "version").select(
        "character_id", "character_name", "safety_tier", "creator_type", "num_interactions", "created_at", "version"
    )


@register("character_join", with_views(["featured"], """
SELECT id, character_id, character_name, safety_tier, creator_type, num_interactions, created_at,
  greatest(coalesce(date_sub('day', created_at, event_timestamp), CASE WHEN created_at IS NULL THEN 0
    ELSE date_sub('day', created_at, TIMESTAMP '2024-02-01') END), 0)::DOUBLE AS character_age_days
FROM featured""", dirty=True))
def character_join(spark, sf_dir):
    impressions, characters = dirty(spark, sf_dir)
    frame = features.add_time_features(impressions)
    return features.join_character_features(frame, characters, "version", as_of="2024-02-01").select(
        "id", "character_id", "character_name", "safety_tier", "creator_type", "num_interactions", "created_at",
        "character_age_days",
    )


_CATEGORY = """CASE WHEN {0} IS NULL OR trim({0}) IN ('', 'nan', 'None', '<NA>') THEN 'unknown' ELSE trim({0}) END AS {0}"""


@register("missing_fill", with_views(["featured"], f"""
SELECT id, {_CATEGORY.format('app_category')}, {_CATEGORY.format('site_category')}, tier AS safety_tier,
  creator AS creator_type, turn AS conversation_turn, messages AS session_msg_count, interactions AS num_interactions,
  round(ln(1 + interactions), 6) AS num_interactions_log1p
FROM featured""", dirty=True))
def missing_fill(spark, sf_dir):
    impressions, characters = dirty(spark, sf_dir)
    frame = features.add_turn_features(features.add_time_features(impressions))
    joined = features.join_character_features(frame, characters, "version", as_of="2024-02-01")
    return features.fill_missing_values(joined).select(
        "id", "app_category", "site_category", "safety_tier", "creator_type", "conversation_turn",
        "session_msg_count", "num_interactions", r6("num_interactions_log1p"),
    )


_PLAIN = [c for c in CATEGORICAL_FEATURES if c not in ("character_id", "safety_tier", "creator_type")]
_FEATURE_SQL = f"""
SELECT id, {', '.join(_PLAIN)}, character_id, {{tier}} AS safety_tier, {{creator}} AS creator_type,
  turn AS conversation_turn, messages AS session_msg_count, round(turn_ratio, 6) AS turn_ratio,
  hour_of_day::DOUBLE AS hour_of_day, day_of_week::DOUBLE AS day_of_week, is_weekend::DOUBLE AS is_weekend,
  {{interactions}} AS num_interactions, round(ln(1 + {{interactions}}), 6) AS num_interactions_log1p,
  {{age}} AS character_age_days
FROM featured"""


@register("feature_frame", with_views(["featured"], _FEATURE_SQL.format(
    tier="tier", creator="creator", interactions="interactions", age="age_days")))
def feature_frame(spark, sf_dir):
    impressions, characters = clean(spark, sf_dir)
    return features.build_features(impressions, characters, "version").select(
        "id", *CATEGORICAL_FEATURES,
        *[r6(name) if name in ("turn_ratio", "num_interactions_log1p") else F.col(name) for name in NUMERIC_FEATURES],
    )


@register("feature_frame_without_characters", with_views(["featured"], _FEATURE_SQL.format(
    tier="'unknown'", creator="'unknown'", interactions="0.0::DOUBLE", age="0.0::DOUBLE").replace("SELECT id,", "SELECT")))
def feature_frame_without_characters(spark, sf_dir):
    frame = features.select_feature_columns(features.build_features(views.impressions(spark, sf_dir)))
    return frame.withColumns({name: r6(name) for name in ("turn_ratio", "num_interactions_log1p")})


# Quality


_COUNT_SQL = """
SELECT 'impressions' AS "table", 'row_count' AS code, NULL::VARCHAR AS "column", 'info' AS severity, count(*) AS count FROM dirty
UNION ALL SELECT 'impressions', 'empty_table', NULL, 'error', (count(*) = 0)::BIGINT FROM dirty
UNION ALL SELECT 'impressions', 'invalid_binary_target', 'click', 'error', count(*) FILTER (click NOT IN (0, 1) OR click IS NULL) FROM dirty
UNION ALL SELECT 'impressions', 'invalid_hour', 'hour', 'warning', count(*) FILTER (hour IS NULL OR hour = 'bad') FROM dirty
UNION ALL SELECT 'impressions', 'negative_numeric_values', 'conversation_turn', 'warning', count(*) FILTER (conversation_turn < 0) FROM dirty
UNION ALL SELECT 'impressions', 'negative_numeric_values', 'session_msg_count', 'warning', count(*) FILTER (session_msg_count < 0) FROM dirty
UNION ALL SELECT 'impressions', 'null_values', 'hour', 'info', count(*) FILTER (hour IS NULL) FROM dirty
UNION ALL SELECT 'impressions', 'null_values', 'character_id', 'info', count(*) FILTER (character_id IS NULL) FROM dirty
UNION ALL SELECT 'characters', 'row_count', NULL, 'info', count(*) FROM characters
UNION ALL SELECT 'characters', 'empty_table', NULL, 'warning', (count(*) = 0)::BIGINT FROM characters
UNION ALL SELECT 'characters', 'negative_numeric_values', 'num_interactions', 'warning', count(*) FILTER (num_interactions < 0) FROM characters
UNION ALL SELECT 'characters', 'null_values', 'safety_tier', 'info', count(*) FILTER (safety_tier IS NULL) FROM characters
UNION ALL SELECT 'characters', 'null_values', 'creator_type', 'info', count(*) FILTER (creator_type IS NULL) FROM characters"""
_UNJOINED_SQL = """
SELECT 'impressions' AS "table", 'unjoined_character_ids' AS code, 'character_id' AS "column", 'warning' AS severity, count(*) AS count
FROM dirty WHERE coalesce(character_id, 'unknown') NOT IN (SELECT character_id FROM characters)"""
_DUPLICATE_SQL = """
SELECT 'impressions' AS "table", 'duplicate_ids' AS code, 'id' AS "column", 'warning' AS severity, (count(*) - count(DISTINCT id))::BIGINT AS count FROM dirty
UNION ALL SELECT 'characters', 'duplicate_ids', 'character_id', 'warning', (count(*) - count(DISTINCT character_id))::BIGINT FROM characters"""
_FUTURE_SQL = f"""
SELECT 'characters' AS "table", 'future_created_at' AS code, 'created_at' AS "column", 'warning' AS severity, count(*) AS count
FROM dirty i JOIN dedup d ON i.character_id = d.character_id WHERE d.created_at::TIMESTAMP > {PARSED_HOUR.format('i.hour')}"""


@register("quality_counts", with_views(["dirty", "characters"], _COUNT_SQL))
def quality_counts(spark, sf_dir):
    impressions, characters = dirty(spark, sf_dir)
    return quality.table_counts(impressions, "impressions").unionByName(quality.table_counts(characters, "characters"))


@register("quality_unjoined", with_views(["dirty", "characters"], _UNJOINED_SQL))
def quality_unjoined(spark, sf_dir):
    return quality.unjoined_ids(*dirty(spark, sf_dir))


@register("quality_duplicates", with_views(["dirty", "characters"], _DUPLICATE_SQL))
def quality_duplicates(spark, sf_dir):
    impressions, characters = dirty(spark, sf_dir)
    return quality.duplicate_ids(impressions, "impressions", "id").unionByName(
        quality.duplicate_ids(characters, "characters", "character_id")
    )


@register("quality_future_created", with_views(["dirty", "dedup"], _FUTURE_SQL))
def quality_future_created(spark, sf_dir):
    return quality.future_created(*dirty(spark, sf_dir), "version")


_ALL_CHECKS = f"SELECT * FROM ({_COUNT_SQL} UNION ALL {_UNJOINED_SQL} UNION ALL {_DUPLICATE_SQL} UNION ALL {_FUTURE_SQL})"


@register("quality_issues", with_views(["dirty", "characters", "dedup"], _ALL_CHECKS + " WHERE severity <> 'info' AND count > 0"))
def quality_issues(spark, sf_dir):
    return quality.issues(quality.input_checks(*dirty(spark, sf_dir), "version"))


@register("quality_while_writing", with_views(["dirty", "characters"], f"""SELECT * FROM ({_COUNT_SQL}) WHERE "table" = 'impressions'"""))
def quality_while_writing(spark, sf_dir):
    """The impressions' counts, taken by the job that writes their features."""
    impressions, characters = dirty(spark, sf_dir)
    watched, seen = quality.observe_counts(impressions, "impressions")
    folder = work_path(spark, "features")
    frame = features.build_features(watched, characters, "version")
    sinks.write_by_day(frame.withColumn("event_day", temporal.day_label(F.col("event_timestamp"))), folder)
    return quality.observed_counts(impressions, "impressions", seen, spark.read.parquet(folder).count())


@contextmanager
def _layout(spark, impressions, characters):
    """The tables stored by character under a name of their own, dropped in the end."""
    stored = layout.store(impressions, characters, f"by_character_{uuid.uuid4().hex}", 8, "version")
    try:
        yield stored
    finally:
        layout.drop(spark, stored)


def _stored(df, label):
    folder = work_path(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


@register("layout_checks", with_views(["dirty", "characters", "dedup"], f"{_UNJOINED_SQL} UNION ALL {_FUTURE_SQL}"))
def layout_checks(spark, sf_dir):
    """Both checks that join, from one join without a shuffle of impressions."""
    with _layout(spark, *dirty(spark, sf_dir)) as stored:
        return _stored(layout.join_checks(spark, stored), "checks")


@register("layout_features", with_views(["featured"], _FEATURE_SQL.format(
    tier="tier", creator="creator", interactions="interactions", age="age_days")))
def layout_features(spark, sf_dir):
    """The feature frame from tables stored by character."""
    with _layout(spark, *clean(spark, sf_dir)) as stored:
        frame = _stored(layout.build_features(spark, stored), "features")
    return frame.select(
        "id", *CATEGORICAL_FEATURES,
        *[r6(name) if name in ("turn_ratio", "num_interactions_log1p") else F.col(name) for name in NUMERIC_FEATURES],
    )


_GATE_SCHEMA = "tables string, passed boolean, error_count long, row_count long"


@register("training_gate", with_views(["dirty", "characters", "dedup"], """
SELECT 'clean' AS tables, true AS passed, 0::BIGINT AS error_count, count(*) AS row_count FROM events
UNION ALL SELECT 'dirty', count(*) FILTER (click NOT IN (0, 1)) = 0, (count(*) FILTER (click NOT IN (0, 1)) > 0)::BIGINT, count(*) FROM dirty
UNION ALL SELECT 'without click', false, 1, count(*) FROM events"""))
def training_gate(spark, sf_dir):
    """What the training job's first step lets through: sound tables, tables with bad clicks, and tables without the target."""
    impressions, characters = clean(spark, sf_dir)
    rows = []
    for name, facts in (("clean", impressions), ("dirty", dirty(spark, sf_dir)[0]), ("without click", impressions.drop("click"))):
        folder = work_path(spark, "gate")
        try:
            training.checked_features(facts, characters, folder, "version")
            passed = True
        except ValueError:
            passed = False
        checks = spark.read.parquet(f"{folder}/quality/stored")
        total = checks.where("table = 'impressions' AND code = 'row_count'").first()["count"]
        rows.append((name, passed, spark.read.json(f"{folder}/quality/verdict").first()["error_count"], total))
    return spark.createDataFrame(rows, _GATE_SCHEMA)


@register("target_check", """
SELECT 'as given' AS target, true AS accepted, count(*) AS rows, count(*) FILTER (event_type = 'click') AS clicks FROM events
UNION ALL SELECT 'as text', true, count(*), count(*) FILTER (event_type = 'click') FROM events
UNION ALL SELECT 'null', count(*) FILTER (event_id % 97 = 0) = 0, NULL, NULL FROM events
UNION ALL SELECT 'no number', count(*) FILTER (event_type <> 'click') = 0, NULL, NULL FROM events
UNION ALL SELECT 'absent', false, NULL, NULL""")
def target_check(spark, sf_dir):
    """Targets the training job takes, as whole numbers, and those it refuses."""
    rows = views.impressions(spark, sf_dir).select("id", "click")
    cases = {
        "as given": rows,
        "as text": rows.withColumn("click", F.concat(F.lit(" "), F.col("click").cast("int").cast("string"))),
        "null": rows.withColumn("click", F.expr("if(bigint(id) % 97 = 0, NULL, click)")),
        "no number": rows.withColumn("click", F.expr("if(click = 1, '1', 'none')")),
        "absent": rows.drop("click"),
    }
    out = []
    for name, frame in cases.items():
        try:
            counted = quality.check_target(frame).agg(F.count("*").alias("rows"), F.sum("click").alias("clicks")).first()
            out.append((name, True, counted["rows"], counted["clicks"]))
        except ValueError:
            out.append((name, False, None, None))
    return spark.createDataFrame(out, "target string, accepted boolean, rows long, clicks long")


@register("quality_missing_columns", """
SELECT 'impressions' AS "table", 'missing_required_columns' AS code, c AS "column", 'error' AS severity, 1::BIGINT AS count
FROM (VALUES ('hour'), ('C21'), ('device_ip')) AS v(c)
UNION ALL SELECT 'impressions', 'row_count', NULL, 'info', count(*) FROM events
UNION ALL SELECT 'characters', 'row_count', NULL, 'info', 2 * count(*) FROM customer""")
def quality_missing_columns(spark, sf_dir):
    impressions, characters = clean(spark, sf_dir)
    checks = quality.input_checks(impressions.drop("hour", "C21", "device_ip"), characters, "version")
    return checks.where(F.col("code").isin("missing_required_columns", "row_count"))


@register("quality_verdict", with_views(["dirty", "characters", "dedup"], f"""
SELECT CASE WHEN count(*) FILTER (severity = 'error') = 0 THEN 'pass' ELSE 'fail' END AS status,
  count(*) FILTER (severity = 'error') AS error_count, count(*) FILTER (severity = 'warning') AS warning_count
FROM ({_ALL_CHECKS}) WHERE severity <> 'info' AND count > 0"""))
def quality_verdict(spark, sf_dir):
    return quality.verdict(quality.input_checks(*dirty(spark, sf_dir), "version"))


@register("candidate_contract", """
SELECT c_custkey::VARCHAR AS candidate_id, array_to_string(list_filter([
  CASE WHEN c_nationkey % 5 = 4 THEN 'invalid_safety_tier' END, CASE WHEN c_acctbal < 0 THEN 'negative_bid' END,
  CASE WHEN c_custkey % 10 = 0 THEN 'negative_fatigue_count' END,
  CASE WHEN c_custkey % 30 < 2 THEN 'negative_pacing_ratio' END], lambda x: x IS NOT NULL), '|') AS violations
FROM customer WHERE violations <> ''""")
def candidate_contract(spark, sf_dir):
    _, rejected = ranking.quarantine(ranking.candidate_violations(views.offers(spark, sf_dir)))
    return rejected.select("candidate_id", F.array_join("violations", "|").alias("violations"))


@register("prediction_contract", """
SELECT event_id::VARCHAR AS id FROM events WHERE value / 100 NOT BETWEEN 0 AND 1""")
def prediction_contract(spark, sf_dir):
    scored = views.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), (F.col("value") / 100).alias("predicted_ctr")
    )
    _, rejected = ranking.quarantine(ranking.prediction_violations(scored))
    return rejected.select("id")


# Time order and split


def _frame(spark, sf_dir, build=clean):
    return features.build_features(*build(spark, sf_dir), "version", as_of="2024-02-01")


_SPLIT_SQL = """, times AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS u
  FROM (SELECT DISTINCT event_timestamp AS t FROM featured WHERE event_timestamp IS NOT NULL)),
places AS (SELECT it, least(greatest(it + 1, floor(u * (0.70::DOUBLE + 0.15::DOUBLE)) - 1), u - 2) AS iv
  FROM (SELECT DISTINCT u, least(greatest(0, floor(u * 0.70::DOUBLE) - 1), u - 3) AS it FROM times)),
assigned AS (SELECT *, CASE WHEN event_timestamp <= (SELECT t FROM times, places WHERE i = it) THEN 'train'
  WHEN event_timestamp <= (SELECT t FROM times, places WHERE i = iv) THEN 'validation' ELSE 'test' END AS split FROM featured)
"""


@register("sorted_by_time", with_views(["featured"], "SELECT id, hour, event_timestamp FROM featured", dirty=True))
def sorted_by_time(spark, sf_dir):
    return ordering.sort_by_time(features.add_time_features(views.dirty_impressions(spark, sf_dir))).select(
        "id", "hour", "event_timestamp"
    )


@register("time_split", with_views(["featured"], "", dirty=True) + _SPLIT_SQL + """
SELECT split, count(*) AS rows, min(event_timestamp) AS start, max(event_timestamp) AS "end" FROM assigned GROUP BY split""")
def time_split(spark, sf_dir):
    frame = features.add_time_features(views.dirty_impressions(spark, sf_dir))
    return split.split_summary(split.time_based_split(frame).assign(frame))


@register("time_split_rows", with_views(["featured"], "") + _SPLIT_SQL + "SELECT id, split FROM assigned")
def time_split_rows(spark, sf_dir):
    frame = features.add_time_features(views.impressions(spark, sf_dir))
    return split.time_based_split(frame).assign(frame).select("id", "split")


@register("row_split", with_views(["drift"], """
SELECT id, CASE WHEN pos < te THEN 'train' WHEN pos < least(greatest(te + 1, floor(total * (0.70::DOUBLE + 0.15::DOUBLE))), total - 1)
  THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, least(greatest(1, floor(total * 0.70::DOUBLE)), total - 2) AS te FROM drift)""", dirty=True))
def row_split(spark, sf_dir):
    frame = features.add_time_features(views.dirty_impressions(spark, sf_dir))
    return split.row_split(frame).assign(frame).select("id", "split")


@register("latest_rows", with_views(["drift"], "SELECT id, event_timestamp FROM drift WHERE pos >= total - 2500"))
def latest_rows(spark, sf_dir):
    frame = features.add_time_features(views.impressions(spark, sf_dir))
    return split.latest_rows(frame, 2500).select("id", "event_timestamp")


_TIED_SQL = """
WITH tied AS (SELECT (event_id % 2)::VARCHAR AS id, event_type AS hour, date_trunc('month', ts) AS t, event_id % 7 AS v FROM events),
counted AS (SELECT t, hour, id, count(*) AS n FROM tied GROUP BY ALL),
ends AS (SELECT *, sum(n) OVER (ORDER BY t, hour, id) AS upto, sum(n) OVER () AS total FROM counted)
"""


def tied_rows(spark, sf_dir):
    """Events reduced to few distinct order keys, so that boundaries fall among equal rows."""
    return views.table(spark, sf_dir, "events").select(
        (F.col("event_id") % 2).cast("string").alias("id"), F.col("event_type").alias("hour"),
        F.date_trunc("month", F.col("ts")).cast("timestamp_ntz").alias("event_timestamp"), (F.col("event_id") % 7).alias("v"),
    )


def _tied_counts(df, part):
    return df.groupBy(part, "event_timestamp", "hour", "id").agg(F.count("*").alias("rows")).withColumn("rows", F.col("rows").cast("bigint"))


def _tied_parts(first: str, second: str, names: tuple[str, str, str], part: str) -> str:
    """Rows of each key in each of three parts that end after ``first`` and ``second`` rows."""
    inside = "greatest(0, least(upto, {high}) - greatest(upto - n, {low}))"
    pieces = [(names[0], "0", first), (names[1], first, second), (names[2], second, "total")]
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS {part}, t AS event_timestamp, hour, id, ({inside.format(low=low, high=high)})::BIGINT AS rows FROM ends"
        for name, low, high in pieces)
    return _TIED_SQL + f"SELECT * FROM ({rows}) WHERE rows > 0"


_TRAIN_END = "least(greatest(1, floor(total * 0.70::DOUBLE)), total - 2)"


@register("row_split_ties", _tied_parts(
    _TRAIN_END, f"least(greatest({_TRAIN_END} + 1, floor(total * (0.70::DOUBLE + 0.15::DOUBLE))), total - 1)",
    ("train", "validation", "test"), "split"))
def row_split_ties(spark, sf_dir):
    df = tied_rows(spark, sf_dir)
    return _tied_counts(split.row_split(df).assign(df), "split")


@register("periods_ties", _tied_parts("ceil(total / 3)", "ceil(total * 2 / 3)", ("early", "middle", "latest"), "period"))
def periods_ties(spark, sf_dir):
    return _tied_counts(drift.assign_periods(tied_rows(spark, sf_dir)), "period")


@register("latest_rows_ties", _TIED_SQL + """
SELECT t AS event_timestamp, hour, id, least(n, upto - (total - 2500))::BIGINT AS rows FROM ends WHERE upto > total - 2500""")
def latest_rows_ties(spark, sf_dir):
    df = split.latest_rows(tied_rows(spark, sf_dir), 2500)
    return df.groupBy("event_timestamp", "hour", "id").agg(F.count("*").alias("rows"))


_PARTS = {"all": "event_id % 10 < 7", "no test": "event_id >= 0", "no rows in two": "event_id < 0"}
_PART_LABEL = "CASE WHEN event_id % 3 = 0 THEN 'train' WHEN event_id % 3 = 1 AND ({0}) THEN 'validation' WHEN event_id % 3 = 2 AND NOT ({0}) THEN 'test' ELSE 'train' END"


@register("split_guards", """
SELECT 'shares 0.7 and 0.15' AS guard, true AS accepted UNION ALL SELECT 'shares 0.9 and 0.2', false UNION ALL SELECT 'shares 0 and 0.5', false
UNION ALL SELECT 'the latest 2', false UNION ALL SELECT 'the latest 3', true UNION ALL """ + " UNION ALL ".join(f"""
SELECT 'parts: {name}', count(*) FILTER (part = 'train') > 0 AND count(*) FILTER (part = 'validation') > 0 AND count(*) FILTER (part = 'test') > 0
FROM (SELECT {_PART_LABEL.format(rule)} AS part FROM events)""" for name, rule in _PARTS.items()))
def split_guards(spark, sf_dir):
    """Shares, row numbers and parts that a split takes or refuses."""
    events = views.table(spark, sf_dir, "events").withColumn("event_timestamp", F.col("ts"))
    frame = _frame(spark, sf_dir)
    guards = {f"shares {a:g} and {b:g}": (split.check_fractions, a, b) for a, b in ((0.7, 0.15), (0.9, 0.2), (0.0, 0.5))}
    guards |= {f"the latest {n}": (split.latest_rows, frame, n) for n in (2, 3)}
    guards |= {f"parts: {name}": (split.check_parts, split.split_summary(events.withColumn("split", F.expr(_PART_LABEL.format(rule)))))
               for name, rule in _PARTS.items()}
    out = []
    for name, (check, *given) in guards.items():
        try:
            check(*given)
            out.append((name, True))
        except ValueError:
            out.append((name, False))
    return spark.createDataFrame(out, "guard string, accepted boolean")


# Metrics


_METRIC_SQL = """, probs AS (SELECT *, least(greatest(p, 1e-6::DOUBLE), (1 - 1e-6)::DOUBLE) AS q FROM {source}),
counts AS (SELECT {keys}, q, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM probs GROUP BY ALL),
cum AS (SELECT *, sum(n - pos) OVER up - (n - pos) AS neg_below,
    sum(pos) OVER down AS top_pos, sum(n) OVER down AS top_n FROM counts
  WINDOW up AS (PARTITION BY {keys} ORDER BY q ROWS UNBOUNDED PRECEDING),
    down AS (PARTITION BY {keys} ORDER BY q DESC ROWS UNBOUNDED PRECEDING)),
measured AS (SELECT {keys}, sum(n)::BIGINT AS n, sum(pos)::BIGINT AS clicks, round(sum(pos) / sum(n), 6) AS ctr,
  round(sum(-(pos * ln(q) + (n - pos) * ln(1 - q))) / sum(n), 6) AS log_loss,
  CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0 THEN
    round(sum(pos * (neg_below + (n - pos) / 2)) / (sum(pos) * sum(n - pos)), 6) END AS roc_auc,
  CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0 THEN round(sum(pos * top_pos / top_n) / sum(pos), 6) END AS pr_auc,
  round(sum(pos * (1 - q) * (1 - q) + (n - pos) * q * q) / sum(n), 6) AS brier_score
FROM cum GROUP BY ALL)
"""


def rounded_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, "n", "clicks", *[r6(name) for name in ("ctr", "log_loss", "roc_auc", "pr_auc", "brier_score")])


@register("binary_metrics", with_views(["scored"], "") + _METRIC_SQL.format(source="scored", keys="split")
          + "SELECT * FROM measured")
def binary_metrics(spark, sf_dir):
    return rounded_metrics(metrics.binary_metrics(views.scored(spark, sf_dir), ["split"]), ["split"])


@register("roc_pr_auc", with_views(["scored"], "") + _METRIC_SQL.format(source="scored", keys="'all' AS g").replace(
    "PARTITION BY 'all' AS g", "PARTITION BY g").replace("SELECT 'all' AS g, sum", "SELECT sum").replace(
    "FROM cum GROUP BY ALL", "FROM cum") + "SELECT n, clicks, roc_auc, pr_auc FROM measured")
def roc_pr_auc(spark, sf_dir):
    return metrics.binary_metrics(views.scored(spark, sf_dir)).select("n", "clicks", r6("roc_auc"), r6("pr_auc"))


_BIN_SQL = """, binned AS (SELECT *, 1 + {steps} AS bin
  FROM (SELECT split, y, least(greatest(p, 1e-6::DOUBLE), (1 - 1e-6)::DOUBLE) AS q FROM scored)),
calibrated AS (SELECT split, bin::INTEGER AS bin, count(*) AS count, avg(q) AS mean_predicted_ctr, avg(y) AS observed_ctr
  FROM binned GROUP BY ALL)
""".format(steps=" + ".join(f"(q > {edge!r}::DOUBLE)::INTEGER" for edge in metrics.bin_edges(10)[1:-1]))


@register("calibration", with_views(["scored"], "") + _BIN_SQL + """
SELECT split, bin, round((bin - 1) / 10, 6) AS lower_bound, round(bin / 10, 6) AS upper_bound, count,
  round(mean_predicted_ctr, 6) AS mean_predicted_ctr, round(observed_ctr, 6) AS observed_ctr FROM calibrated""")
def calibration(spark, sf_dir):
    table = metrics.calibration_table(views.scored(spark, sf_dir), ["split"])
    return table.select("split", "bin", r6("lower_bound"), r6("upper_bound"), "count", r6("mean_predicted_ctr"), r6("observed_ctr"))


@register("ece", with_views(["scored"], "") + _BIN_SQL + """
SELECT split, round(sum(count * abs(mean_predicted_ctr - observed_ctr)) / sum(count), 6) AS calibration_error
FROM calibrated GROUP BY split""")
def ece(spark, sf_dir):
    table = metrics.calibration_table(views.scored(spark, sf_dir), ["split"])
    return metrics.calibration_error(table, ["split"]).select("split", r6("calibration_error"))


@register("evaluated_split", with_views(["scored"], "") + _METRIC_SQL.format(source="scored", keys="split") + _BIN_SQL + """, errors AS (
  SELECT split, round(sum(count * abs(mean_predicted_ctr - observed_ctr)) / sum(count), 6) AS calibration_error FROM calibrated GROUP BY split),
tops AS (SELECT split, round(avg(y) FILTER (rank <= 100), 6) AS ctr_at_100 FROM (
  SELECT split, y, row_number() OVER (PARTITION BY split ORDER BY p DESC, id) AS rank FROM scored) GROUP BY split)
SELECT measured.*, calibration_error, ctr_at_100 FROM measured JOIN errors USING (split) JOIN tops USING (split)""")
def evaluated_split(spark, sf_dir):
    """All tables of an evaluation, joined by split: metrics, calibration error and click rate of the top 100."""
    scored = _stored(views.scored(spark, sf_dir), "scored")
    tables = metrics.evaluate(scored, metrics.character_counts(scored), ["split"])
    top = tables["ranking"].where("k = 100").select("split", r6("ctr_at_k", "ctr_at_100"))
    errors = tables["calibration_error"].select("split", r6("calibration_error"))
    return rounded_metrics(tables["metrics"], ["split"]).join(errors, "split").join(top, "split")


@register("topk_lift", with_views(["scored"], """
, placed AS (SELECT split, y, row_number() OVER (PARTITION BY split ORDER BY p DESC, id) AS rank,
  avg(y) OVER (PARTITION BY split) AS overall FROM scored)
SELECT split, k, round(avg(y), 6) AS ctr_at_k, round(avg(y), 6) AS precision_at_k,
  round(avg(y) / min(overall), 6) AS lift_at_k, count(*) AS effective_k, round(min(overall), 6) AS overall_ctr
FROM placed, (VALUES (100), (1000), (10000)) AS ks(k) WHERE rank <= k GROUP BY split, k"""))
def topk_lift(spark, sf_dir):
    table = metrics.topk_metrics(views.scored(spark, sf_dir), ["split"])
    return table.select("split", "k", r6("ctr_at_k"), r6("precision_at_k"), r6("lift_at_k"), "effective_k", r6("overall_ctr"))


@register("train_counts", with_views(["scored"], """
SELECT character_id, count(*) AS train_impressions FROM scored GROUP BY 1"""))
def train_counts(spark, sf_dir):
    return metrics.character_counts(views.scored(spark, sf_dir))


_SLICED_SQL = """, sliced AS (SELECT s.*, CASE WHEN conversation_turn <= 2 THEN 'early' WHEN conversation_turn <= 8 THEN 'mid' ELSE 'late' END AS turn_stage,
  CASE WHEN c.n < 65 THEN 'cold_start_like' ELSE 'graduated' END AS cold_start_character
  FROM scored s JOIN (SELECT character_id, count(*) AS n FROM scored GROUP BY 1) c USING (character_id))
"""


@register("slice_columns", with_views(["scored"], "") + _SLICED_SQL + "SELECT id, turn_stage, cold_start_character FROM sliced")
def slice_columns(spark, sf_dir):
    scored = views.scored(spark, sf_dir)
    return metrics.add_slice_columns(scored, metrics.character_counts(scored), 65).select("id", "turn_stage", "cold_start_character")


_LONG_SQL = """, long AS (
  SELECT split, y, p, 'safety_tier' AS slice, safety_tier AS value FROM sliced
  UNION ALL SELECT split, y, p, 'creator_type', creator_type FROM sliced
  UNION ALL SELECT split, y, p, 'turn_stage', turn_stage FROM sliced
  UNION ALL SELECT split, y, p, 'cold_start_character', cold_start_character FROM sliced
  UNION ALL SELECT split, y, p, 'app_category', app_category FROM sliced)
"""


@register("slice_metrics", with_views(["scored"], "") + _SLICED_SQL + _LONG_SQL + """, kept AS (SELECT split, slice, value FROM (SELECT split, slice, value, count(*) AS n,
    sum(count(*)) OVER (PARTITION BY split, slice) AS total FROM long GROUP BY split, slice, value)
  WHERE n >= greatest(10, least(100, floor(total * 0.01)))),
chosen AS (SELECT long.* FROM long JOIN kept USING (split, slice, value))
""" + _METRIC_SQL.format(source="chosen", keys="split, slice, value") + "SELECT * FROM measured")
def slice_metrics(spark, sf_dir):
    folder = work_path(spark, "scored")
    views.scored(spark, sf_dir).write.parquet(folder)  # read four times below
    scored = spark.read.parquet(folder)
    frame = metrics.add_slice_columns(scored, metrics.character_counts(scored), 65)
    return rounded_metrics(metrics.slice_metrics(frame, ["split"]), ["split", "slice", "value"])


@register("slice_coverage", with_views(["scored"], "") + _SLICED_SQL + _LONG_SQL + """, counted AS (
  SELECT split, slice, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY split, slice) AS total FROM long GROUP BY split, slice, value),
judged AS (SELECT *, n >= greatest(10, least(100, floor(total * 0.01))) AS enough FROM counted)
SELECT split, slice, count(*) FILTER (enough) AS values_measured, count(*) FILTER (NOT enough) AS values_left_out,
  coalesce(sum(n) FILTER (enough), 0)::BIGINT AS rows_measured, coalesce(sum(n) FILTER (NOT enough), 0)::BIGINT AS rows_left_out
FROM judged GROUP BY split, slice""")
def slice_coverage(spark, sf_dir):
    scored = views.scored(spark, sf_dir)
    frame = metrics.add_slice_columns(scored, metrics.character_counts(scored), 65)
    return metrics.slice_coverage(frame, ["split"], slices=["safety_tier", "creator_type", "turn_stage", "cold_start_character", "app_category"])


# Prediction and ranking


@register("baseline_score", with_views(["scored"], """
SELECT id, round((SELECT avg(y) FROM scored WHERE split = 'validation'), 6) AS probability FROM scored"""))
def baseline_score(spark, sf_dir):
    scored = views.scored(spark, sf_dir)
    out = prediction.baseline_score(scored, scored.where(F.col("split") == "validation"), "y")
    return out.select("id", r6("probability"))


@register("fallback_score", with_views(["fallback"], """
SELECT request_id, predicted_ctr, 'untrained-0.1.0' AS model_version, reasons FROM fallback"""))
def fallback_score(spark, sf_dir):
    scored = prediction.fallback_score(views.rank_contexts(spark, sf_dir))
    return scored.select("request_id", "predicted_ctr", "model_version", joined_reasons())


def requests(spark, sf_dir, limit: int = 200) -> DataFrame:
    return ranking.assemble_requests(
        views.rank_contexts(spark, sf_dir), views.candidate_rows(spark, sf_dir), views.CANDIDATE_ORDER, limit
    )


@register("rank_gate", """
SELECT o_orderkey::VARCHAR AS request_id, coalesce(n, 0) AS candidate_count,
  CASE WHEN n IS NULL THEN 'empty_candidates' WHEN n > 6 THEN 'too_many_candidates' END AS rejection
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def rank_gate(spark, sf_dir):
    return requests(spark, sf_dir, limit=6).select("request_id", "candidate_count", "rejection")


@register("rank_candidates", with_views(["ranked"], """
SELECT request_id, candidate_id, rank, predicted_ctr, final_score, reasons FROM ranked"""))
def rank_candidates(spark, sf_dir):
    ranked = ranking.rank_candidates(requests(spark, sf_dir))
    return ranked.select("request_id", "candidate_id", F.col("rank").cast("bigint").alias("rank"), "predicted_ctr", "final_score", joined_reasons())


@register("rank_arrays", with_views(["ranked"], """
SELECT request_id, candidate_id, rank, predicted_ctr, final_score, reasons FROM ranked"""))
def rank_arrays(spark, sf_dir):
    # The outer form keeps Spark from ranking once more to filter empty lists ahead of the unnesting.
    ranked = ranking.rank_arrays(requests(spark, sf_dir)).select("request_id", F.inline_outer("ranked_candidates"))
    ranked = ranked.where(F.col("rank").isNotNull())
    return ranked.select("request_id", "candidate_id", F.col("rank").cast("bigint").alias("rank"), "predicted_ctr", "final_score", joined_reasons())


@register("rank_regrouped", with_views(["ranked"], """
SELECT request_id, string_agg(candidate_id, '>' ORDER BY rank) AS ranking FROM ranked GROUP BY 1"""))
def rank_regrouped(spark, sf_dir):
    grouped = ranking.regroup_ranked(ranking.rank_candidates(requests(spark, sf_dir)))
    return grouped.select("request_id", F.array_join("ranked_candidates.candidate_id", ">").alias("ranking"))


@register("rank_merged_fields", with_views(["candidates", "contexts"], """
SELECT request_id, c.candidate_id, coalesce(c.banner_pos, x.banner_pos) AS banner_pos, coalesce(c.C14, x.C14) AS C14
FROM candidates c JOIN contexts x USING (request_id) WHERE NOT (x.safety_tier = 'sfw' AND c.tier = 'mature')"""))
def rank_merged_fields(spark, sf_dir):
    rows = ranking.explode_candidates(requests(spark, sf_dir).drop("rejection", "candidate_count"))
    return rows.select("request_id", "candidate_id", "banner_pos", "C14")


# Drift


def drift_frame(spark, sf_dir):
    return drift.prepare_drift_frame(*dirty(spark, sf_dir), "version", as_of="2024-02-01")


@register("drift_periods", with_views(["drift"], "SELECT id, period, event_day, event_hour_bucket FROM drift", dirty=True))
def drift_periods(spark, sf_dir):
    return drift_frame(spark, sf_dir).select("id", "period", "event_day", "event_hour_bucket")


@register("period_summary", with_views(["drift"], """
SELECT period, count(*) AS impressions, round(avg(clicked), 6) AS ctr FROM drift GROUP BY 1""", dirty=True))
def period_summary(spark, sf_dir):
    return drift.period_summary(drift_frame(spark, sf_dir)).select("period", "impressions", r6("ctr"))


@register("ctr_delta", with_views(["drift"], """
SELECT count(*) AS row_count, round(avg(clicked) FILTER (period = 'latest') - avg(clicked) FILTER (period = 'early'), 6)
  AS ctr_delta_latest_vs_early FROM drift""", dirty=True))
def ctr_delta(spark, sf_dir):
    return drift.ctr_delta(drift_frame(spark, sf_dir)).select("row_count", r6("ctr_delta_latest_vs_early"))


@register("ctr_by_day", with_views(["drift"], """
SELECT event_day, count(*) AS impressions, round(avg(clicked), 6) AS ctr FROM drift GROUP BY 1""", dirty=True))
def ctr_by_day(spark, sf_dir):
    return drift.ctr_by_day(drift_frame(spark, sf_dir)).select("event_day", "impressions", r6("ctr"))


@register("volume_by_hour", with_views(["drift"], """
SELECT event_hour_bucket, count(*) AS impressions, round(avg(clicked), 6) AS ctr FROM drift GROUP BY 1""", dirty=True))
def volume_by_hour(spark, sf_dir):
    return drift.volume_by_hour(drift_frame(spark, sf_dir)).select("event_hour_bucket", "impressions", r6("ctr"))


@register("value_distribution", with_views(["featured"], """
SELECT app_category AS value, count(*) AS impressions, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM featured GROUP BY 1"""))
def value_distribution(spark, sf_dir):
    frame = _frame(spark, sf_dir)
    return drift.value_distribution(frame, "app_category").select("value", "impressions", r6("share"))


_SHARES_SQL = f""", filled AS (SELECT period, tier AS safety_tier, creator AS creator_type, {_CATEGORY.format('app_category')},
  {_CATEGORY.format('site_category')}, device_type FROM drift),
long AS (SELECT period, name AS feature, value FROM (UNPIVOT filled ON safety_tier, creator_type, app_category, site_category, device_type
  INTO NAME name VALUE value)),
shares AS (SELECT period, feature, value, count(*) AS impressions,
  count(*) / sum(count(*)) OVER (PARTITION BY period, feature) AS share FROM long GROUP BY period, feature, value)
"""


@register("distribution_by_period", with_views(["drift"], "", dirty=True) + _SHARES_SQL + """
SELECT period, feature, value, impressions, round(share, 6) AS share FROM shares WHERE feature IN ('safety_tier', 'app_category')""")
def distribution_by_period(spark, sf_dir):
    table = drift.distribution_by_period(drift_frame(spark, sf_dir))
    return table.select("period", "feature", "value", "impressions", r6("share"))


@register("feature_shift", with_views(["drift"], "", dirty=True) + _SHARES_SQL + """, pairs AS (
  SELECT feature, value, coalesce(max(share) FILTER (period = 'early'), 0) AS r,
    coalesce(max(share) FILTER (period = 'latest'), 0) AS c
  FROM shares WHERE period <> 'middle' GROUP BY ALL)
SELECT feature, round(sum((c - r) * ln((c + 1e-9) / (r + 1e-9))), 6) AS psi,
  round(sum((r + 1e-9) * ln((r + 1e-9) / (c + 1e-9))), 6) AS kl_divergence,
  round(sum(abs(c - r)) / 2, 6) AS normalized_distribution_delta
FROM pairs GROUP BY feature""")
def feature_shift(spark, sf_dir):
    table = drift.feature_shift(drift_frame(spark, sf_dir))
    return table.select("feature", r6("psi"), r6("kl_divergence"), r6("normalized_distribution_delta"))


@register("distribution_pair", with_views(["featured"], """
SELECT value, round(coalesce(r, 0), 6) AS reference_share, round(coalesce(c, 0), 6) AS current_share FROM
  (SELECT app_category AS value, count(*) / sum(count(*)) OVER () AS r FROM featured WHERE is_weekend = 0 GROUP BY 1)
  FULL OUTER JOIN (SELECT site_category AS value, count(*) / sum(count(*)) OVER () AS c FROM featured WHERE is_weekend = 1 GROUP BY 1)
  USING (value)"""))
def distribution_pair(spark, sf_dir):
    frame = features.build_features(views.impressions(spark, sf_dir))
    reference = drift.value_distribution(frame.where(F.col("is_weekend") == 0), "app_category")
    current = drift.value_distribution(frame.where(F.col("is_weekend") == 1), "site_category")
    return drift.pair_distributions(reference, current).select("value", r6("reference_share"), r6("current_share"))


@register("top_values", with_views(["drift"], "", dirty=True) + _SHARES_SQL + """
SELECT period, feature, value, impressions, round(share, 6) AS share,
  row_number() OVER (PARTITION BY period, feature ORDER BY impressions DESC, value) AS rank
FROM shares WHERE period <> 'middle' QUALIFY rank <= 5""")
def top_values(spark, sf_dir):
    table = drift.top_values(drift_frame(spark, sf_dir))
    return table.select("period", "feature", "value", "impressions", r6("share"), F.col("rank").cast("bigint").alias("rank"))


@register("concentration", with_views(["drift"], """
, counts AS (SELECT period, coalesce(character_id, 'unknown') AS c, count(*) AS n FROM drift GROUP BY ALL)
SELECT period, round(max(n) / sum(n), 6) AS top_character_share,
  round(sum(n) FILTER (place <= 10) / sum(n), 6) AS top_10_character_share, count(*) AS unique_characters
FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY n DESC, c) AS place FROM counts) GROUP BY period""", dirty=True))
def concentration(spark, sf_dir):
    table = drift.concentration(drift_frame(spark, sf_dir))
    return table.select("period", r6("top_character_share"), r6("top_10_character_share"), "unique_characters")


# Request log


@register("latency_summary", """
SELECT path, count(*) AS count, round(avg(v), 6) AS mean_ms,
  max(v) FILTER (i = round_even(0.5::DOUBLE * (n - 1), 0)) AS p50_ms, max(v) FILTER (i = round_even(0.95::DOUBLE * (n - 1), 0)) AS p95_ms,
  max(v) FILTER (i = round_even(0.99::DOUBLE * (n - 1), 0)) AS p99_ms, max(v) AS max_ms
FROM (SELECT '/' || event_type AS path, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
  count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY path""")
def latency_summary(spark, sf_dir):
    return requestlog.latency_summary(views.request_log(spark, sf_dir)).withColumn("mean_ms", r6("mean_ms"))


# Sources and sinks


def _written_csv(spark, sf_dir):
    folder = work_path(spark, "csv")
    for name, df in (("impressions", views.dirty_impressions(spark, sf_dir)), ("characters", views.characters(spark, sf_dir))):
        df.write.option("header", True).option("nullValue", "N/A").option("escape", '"').csv(f"{folder}/{name}")
    return folder


@register("csv_impressions", with_views(["dirty"], """
SELECT id, hour, click, character_id, site_category, C14, conversation_turn, session_msg_count
FROM (SELECT * REPLACE (CASE WHEN site_category <> 'None' THEN site_category END AS site_category) FROM dirty)"""))
def csv_impressions(spark, sf_dir):
    loaded = tables.load_impressions(spark, f"{_written_csv(spark, sf_dir)}/impressions")
    return loaded.select(
        "id", "hour", "click", "character_id", "site_category", "C14", "conversation_turn", "session_msg_count"
    )


@register("csv_feature_frame", with_views(["featured"], """
SELECT tier AS safety_tier, creator AS creator_type, count(*) AS impressions, round(avg(turn_ratio), 6) AS turn_ratio,
  round(avg(interactions), 6) AS num_interactions FROM featured GROUP BY ALL""", dirty=True))
def csv_feature_frame(spark, sf_dir):
    folder = _written_csv(spark, sf_dir)
    impressions = tables.load_impressions(spark, f"{folder}/impressions")
    characters = tables.load_characters(spark, f"{folder}/characters")
    frame = features.build_features(impressions, characters, "version", as_of="2024-02-01")
    return frame.groupBy("safety_tier", "creator_type").agg(
        F.count("*").alias("impressions"), F.round(F.avg("turn_ratio"), 6).alias("turn_ratio"),
        F.round(F.avg("num_interactions"), 6).alias("num_interactions"),
    )


@register("csv_line_breaks", with_views(["featured"], """
SELECT tier AS safety_tier, count(*) AS impressions, round(avg(interactions), 6) AS num_interactions FROM featured GROUP BY ALL""", dirty=True))
def csv_line_breaks(spark, sf_dir):
    """As in ``csv_feature_frame``, with line breaks, quotes and commas in every description, by the loader of both tables."""
    folder = work_path(spark, "csv")
    note = F.concat(F.lit('first "line",\nsecond\r\n'), F.coalesce("character_description", F.lit("")))
    people = views.characters(spark, sf_dir)
    newest = people.groupBy("character_id").agg(F.max(F.struct("version", *[c for c in people.columns if c not in ("version", "character_id")])).alias("n"))
    people = newest.select("character_id", "n.*").withColumn("character_description", note)
    for name, df in (("impressions", views.dirty_impressions(spark, sf_dir)), ("characters", people)):
        df.write.option("header", True).option("nullValue", "N/A").option("escape", '"').csv(f"{folder}/{name}")
    frame = tables.load_feature_frame(spark, f"{folder}/impressions", f"{folder}/characters", as_of="2024-02-01")
    return frame.groupBy("safety_tier").agg(F.count("*").alias("impressions"), F.round(F.avg("num_interactions"), 6).alias("num_interactions"))


@register("metric_json", with_views(["featured"], """
SELECT strftime(event_timestamp, '%Y-%m-%d') AS event_day, count(*) AS impressions,
  CASE WHEN sum(click) > 0 THEN round(count(*) / sum(click), 6) END AS per_click
FROM featured GROUP BY 1"""))
def metric_json(spark, sf_dir):
    folder = work_path(spark, "metrics")
    day = temporal.day_label(F.col("event_timestamp")).alias("event_day")
    table = features.add_time_features(views.impressions(spark, sf_dir)).groupBy(day).agg(
        F.count("*").alias("impressions"),
        F.when(F.sum("click") > 0, F.round(F.count("*") / F.sum("click"), 6)).otherwise(F.lit(float("inf"))).alias("per_click"),
    )
    sinks.write_metric_tables({"days": table}, folder)
    return spark.read.schema("event_day string, impressions bigint, per_click double").json(f"{folder}/days")


@register("features_by_day", with_views(["featured"], """
SELECT strftime(event_timestamp, '%Y-%m-%d') AS event_day, count(*) AS impressions FROM featured GROUP BY 1"""))
def features_by_day(spark, sf_dir):
    folder = work_path(spark, "features")
    frame = features.build_features(*clean(spark, sf_dir), "version")
    sinks.write_by_day(frame.withColumn("event_day", temporal.day_label(F.col("event_timestamp"))), folder)
    stored = spark.read.schema("id string, event_day string").parquet(folder)
    return stored.groupBy("event_day").agg(F.count("*").alias("impressions"))


# Model; the numbers depend on the learner, so these have no SQL

TRAINING = model.TrainingConfig()


def _trained(spark, sf_dir):
    """A model fitted on the train split, and the labelled frame it came from. Both are stored in a folder of the application
    for these tables and settings, so the queries that use them don't depend on each other."""
    key = hashlib.sha256(repr((spark.sparkContext.applicationId, sf_dir, TRAINING)).encode()).hexdigest()[:16]
    folder = f"{shared_dir(spark)}/clickloom/fitted-{key}"
    if model.load_predictor(spark, f"{folder}/model").model is None:
        frame = _frame(spark, sf_dir)
        sinks.write_by_day(frame.withColumn("event_day", temporal.day_label(F.col("event_timestamp"))), f"{folder}/frame")
        frame, train, validation = _labelled(spark, folder)
        model.train_model(train, validation, TRAINING).save(spark, f"{folder}/model")
    frame, train, _ = _labelled(spark, folder)
    return model.ClickModel.load(spark, f"{folder}/model"), frame, train


def _labelled_frame(spark, sf_dir):
    folder = work_path(spark, "labelled")
    _frame(spark, sf_dir).write.parquet(f"{folder}/frame")
    return _labelled(spark, folder)


def _labelled(spark, folder):
    frame = quality.check_target(spark.read.parquet(f"{folder}/frame"))
    frame = split.time_based_split(frame).assign(frame)
    train, validation = (frame.where(F.col("split") == name) for name in ("train", "validation"))
    return frame, train, validation


@register("model_scores")
def model_scores(spark, sf_dir):
    fitted, frame, _ = _trained(spark, sf_dir)
    return fitted.transform(frame).select("id", "split", "probability")


@register("model_evaluation")
def model_evaluation(spark, sf_dir):
    fitted, frame, train = _trained(spark, sf_dir)
    folder = work_path(spark, "scored")
    training.scored_table(fitted, frame, train).write.parquet(folder)
    evaluated = metrics.evaluate(spark.read.parquet(folder), metrics.character_counts(train))
    return evaluated["metrics"].join(evaluated["calibration_error"], ["model", "split"])


@register("feature_importance")
def feature_importance(spark, sf_dir):
    fitted, _, _ = _trained(spark, sf_dir)
    return fitted.feature_importance(spark)


@register("saved_model_scores")
def saved_model_scores(spark, sf_dir):
    fitted, _, _ = _trained(spark, sf_dir)
    folder = work_path(spark, "model")
    fitted.save(spark, folder)
    predictor = model.load_predictor(spark, folder)
    scored = predictor.score(views.impressions(spark, sf_dir), views.characters(spark, sf_dir), "version")
    return scored.select("id", "predicted_ctr", joined_reasons())


@register("model_ranking")
def model_ranking(spark, sf_dir):
    fitted, _, _ = _trained(spark, sf_dir)
    return ranking.rank_candidates(requests(spark, sf_dir), model.Predictor(fitted)).select(
        "request_id", "candidate_id", "rank", "predicted_ctr", "final_score"
    )


@register("model_score_facts", with_views(["featured"], "") + _SPLIT_SQL + """
SELECT split, count(*) AS rows, count(*) AS rows_in_range, count(DISTINCT id) AS ids FROM assigned GROUP BY split""")
def model_score_facts(spark, sf_dir):
    """What holds whatever the learner finds: every row of every split has one score between 0 and 1."""
    fitted, frame, _ = _trained(spark, sf_dir)
    inside = (F.col("probability") > 0) & (F.col("probability") < 1)
    return fitted.transform(frame).groupBy("split").agg(
        F.count("*").alias("rows"), F.count_if(inside).alias("rows_in_range"), F.countDistinct("id").alias("ids"))


@register("feature_importance_facts", """
SELECT 33::BIGINT AS features, 100.0::DOUBLE AS total, 0::BIGINT AS negative, count(*) AS rows_scored FROM events""")
def feature_importance_facts(spark, sf_dir):
    fitted, frame, _ = _trained(spark, sf_dir)
    table = fitted.feature_importance(spark).agg(
        F.count("*").alias("features"), F.round(F.sum("importance"), 6).alias("total"), F.count_if(F.col("importance") < 0).alias("negative"))
    return table.withColumn("rows_scored", frame.agg(F.count("*")).scalar())


@register("saved_model_facts", """
SELECT count(*) AS rows, count(*) AS same_as_unsaved, count(*) AS from_the_model, count(*) AS rounded FROM events""")
def saved_model_facts(spark, sf_dir):
    """A saved and loaded model gives each row the score of the model in memory, rounded, with the model's reasons."""
    fitted, _, _ = _trained(spark, sf_dir)
    folder = work_path(spark, "model")
    fitted.save(spark, folder)
    contexts, people = views.impressions(spark, sf_dir), views.characters(spark, sf_dir)
    loaded = model.load_predictor(spark, folder).score(contexts, people, "version")
    own = model.Predictor(fitted).score(contexts, people, "version").select("id", F.col("predicted_ctr").alias("own"))
    score = F.col("predicted_ctr")
    return loaded.join(own, "id").agg(
        F.count("*").alias("rows"), F.count_if(score == F.col("own")).alias("same_as_unsaved"),
        F.count_if(F.get("reasons", F.lit(0)) == model.MODEL_REASONS[0]).alias("from_the_model"),
        F.count_if((score == F.round(score, 6)) & score.between(0, 1)).alias("rounded"))


@register("missing_model_scores", with_views(["fallback"], """
SELECT request_id, predicted_ctr, replace(reasons, 'fallback global CTR prior', 'fallback global CTR prior|model artifact not found') AS reasons
FROM fallback"""))
def missing_model_scores(spark, sf_dir):
    predictor = model.load_predictor(spark, work_path(spark, "absent"))
    return predictor.score(views.rank_contexts(spark, sf_dir)).select("request_id", "predicted_ctr", joined_reasons())


# Boosting


_ORDERED = ["app_id", "character_id", "safety_tier"]


def _ordered_sql(column: str, name: str) -> str:
    before = f"OVER (PARTITION BY {column} ORDER BY date_trunc('hour', event_timestamp) NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)"
    return f"round((coalesce(sum(click) {before}, 0) + 0.2::DOUBLE * 20) / (count(*) {before} + 20), 6) AS {name}_rate"


@register("ordered_statistics", with_views(["featured"], f"""
SELECT id, {_ordered_sql('app_id', 'app_id')}, {_ordered_sql('character_id', 'character_id')}, {_ordered_sql('tier', 'safety_tier')}
FROM featured"""))
def ordered_statistics(spark, sf_dir):
    """Click rates of three categories, one of them on most rows, as known before each row's hour."""
    frame = _frame(spark, sf_dir).select("id", "click", "event_timestamp", *_ORDERED)
    rated = statistics.ordered_rates(frame, {name: F.col(name) for name in _ORDERED}, "click", "event_timestamp", 0.2, 20.0)
    return rated.select("id", *[r6(f"{name}_rate") for name in _ORDERED])


_BORDERS = {"hour_of_day": [3.0, 7.0, 11.0, 15.0, 19.0], "conversation_turn": [1.0, 4.0, 8.0]}
_STUMP_ROWS = """, rows AS (SELECT hour_of_day::DOUBLE AS hour_of_day, turn AS conversation_turn, click AS y FROM featured),
base AS (SELECT ln(avg(y) / (1 - avg(y))) AS b FROM rows),
borders(feature, border) AS (VALUES ('hour_of_day', 3.0::DOUBLE), ('hour_of_day', 7.0), ('hour_of_day', 11.0), ('hour_of_day', 15.0),
  ('hour_of_day', 19.0), ('conversation_turn', 1.0), ('conversation_turn', 4.0), ('conversation_turn', 8.0)),
raw0 AS (SELECT *, b AS raw FROM rows, base)"""


def _stump_sql(i: int) -> str:
    return f""", sums{i} AS (SELECT feature, border, (CASE feature WHEN 'hour_of_day' THEN hour_of_day ELSE conversation_turn END) > border AS above,
  sum(1 / (1 + exp(-raw)) - y) AS g, sum(1 / (1 + exp(-raw)) * (1 - 1 / (1 + exp(-raw)))) AS h, count(*) AS n FROM raw{i - 1}, borders GROUP BY ALL),
stump{i} AS (SELECT feature, border, -0.3::DOUBLE * max(g / (h + 3)) FILTER (NOT above) AS low, -0.3::DOUBLE * max(g / (h + 3)) FILTER (above) AS high,
  max(n) FILTER (NOT above) AS low_rows, max(n) FILTER (above) AS high_rows FROM sums{i} GROUP BY feature, border
  ORDER BY sum(g * g / (h + 3)) DESC LIMIT 1),
raw{i} AS (SELECT r.* EXCLUDE (raw), raw + CASE WHEN (CASE feature WHEN 'hour_of_day' THEN hour_of_day ELSE conversation_turn END) > border
  THEN high ELSE low END AS raw FROM raw{i - 1} r, stump{i})"""


@register("newton_stumps", with_views(["featured"], "") + _STUMP_ROWS + _stump_sql(1) + _stump_sql(2) + _stump_sql(3) + """
SELECT round, feature, border, round(low, 4) AS low, round(high, 4) AS high, low_rows, high_rows FROM (
  SELECT 1 AS round, * FROM stump1 UNION ALL SELECT 2, * FROM stump2 UNION ALL SELECT 3, * FROM stump3)""")
def newton_stumps(spark, sf_dir):
    """Three rounds of one-question trees on all rows: the questions, and the Newton values and rows of their sides."""
    frame = _frame(spark, sf_dir)
    fitted = boosting.fit(frame, None, list(_BORDERS), "click", boosting.BoostConfig(rounds=3, depth=1, learning_rate=0.3), _BORDERS)
    rows = [(i, t.features[0], t.borders[0], t.values[0], t.values[1], t.weights[0], t.weights[1]) for i, t in enumerate(fitted.model.trees, 1)]
    table = spark.createDataFrame(rows, "round int, feature string, border double, low double, high double, low_rows long, high_rows long")
    return table.withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


@register("newton_cells", with_views(["featured"], "") + _STUMP_ROWS + """
SELECT feature, (SELECT count(*) FROM borders o WHERE o.feature = f.feature AND o.border < x) AS bin, round(sum(1 / (1 + exp(-raw)) - y), 3) AS g,
  round(avg(1 / (1 + exp(-raw)) * (1 - 1 / (1 + exp(-raw)))), 4) AS mean_h, count(*) AS n
FROM (SELECT 'hour_of_day' AS feature, hour_of_day AS x, y, raw FROM raw0 UNION ALL SELECT 'conversation_turn', conversation_turn, y, raw FROM raw0) f
GROUP BY ALL""")
def newton_cells(spark, sf_dir):
    """Gradient, mean curvature and rows by feature and bin at the root of the first tree."""
    frame = _frame(spark, sf_dir)
    rate = frame.agg(F.avg("click")).first()[0]
    binned = boosting.bin_rows(frame, _BORDERS, "click", math.log(rate / (1 - rate)))
    sums = boosting.level_sums(binned, 2, 6, [], [], []).where("cell >= 0")
    return sums.select(
        F.element_at(F.array(*map(F.lit, _BORDERS)), (F.expr("cell div 6") + 1).cast("int")).alias("feature"), F.expr("cell % 6").alias("bin"),
        F.round(F.col("g") / boosting.UNIT, 3).alias("g"), F.round(F.col("h") / boosting.UNIT / F.col("n"), 4).alias("mean_h"), "n")


# Trees of a set form; their losses fall at first and rise later.
_SET_TREES = boosting.BoostedTrees(-0.2, [
    boosting.Tree(["hour_of_day", "conversation_turn"], [float(3 * k % 20), float(k % 9)],
                  [-0.3 + 0.02 * k, -0.25 + 0.03 * k, -0.2 + 0.04 * k, -0.28 + 0.01 * k], [1, 1, 1, 1]) for k in range(12)])


def _tree_sql(k: int) -> str:
    tree = _SET_TREES.trees[k]
    leaf = f"(hour_of_day > {tree.borders[0]!r})::INT + 2 * (turn > {tree.borders[1]!r})::INT"
    return f"list_extract([{', '.join(f'{v!r}::DOUBLE' for v in tree.values)}], 1 + {leaf})"


_STAGED_SQL = ", terms AS (SELECT click AS y, [" + ", ".join(_tree_sql(k) for k in range(12)) + """] AS t FROM featured),
losses AS (SELECT round, count(*) AS n, avg(greatest(raw, 0) - raw * y + ln(1 + exp(-abs(raw)))) AS loss FROM (
  SELECT y, round::INT AS round, -0.2::DOUBLE + coalesce(list_sum(t[1:round]), 0) AS raw FROM terms, range(13) AS r(round)) GROUP BY round)"""


@register("staged_losses", with_views(["featured"], "") + _STAGED_SQL + " SELECT round, n, round(loss, 6) AS loss FROM losses")
def staged_losses(spark, sf_dir):
    return boosting.staged_losses(_frame(spark, sf_dir), _SET_TREES, "click").select("round", "n", r6("loss"))


@register("stopping_round", with_views(["featured"], "") + _STAGED_SQL + """
, ranked AS (SELECT round, loss, loss < coalesce(min(loss) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e9) AS better FROM losses),
ends AS (SELECT min(r.round) AS stopped_at FROM ranked r WHERE r.round - (SELECT max(b.round) FROM ranked b WHERE b.better AND b.round <= r.round) >= 3)
SELECT round AS best_round, round(loss, 6) AS best_loss, stopped_at FROM ranked, ends
WHERE better AND round <= coalesce(stopped_at, 99) ORDER BY round DESC LIMIT 1""")
def stopping_round(spark, sf_dir):
    """The number of trees kept when training may go on for three rounds without gain."""
    losses = boosting.staged_losses(_frame(spark, sf_dir), _SET_TREES, "click")
    return boosting.stopping_round(losses, 3).select("best_round", r6("best_loss"), "stopped_at")


@register("leaf_weights", with_views(["featured"], "") + " UNION ALL ".join(
    f"SELECT {k} AS tree, (hour_of_day > {t.borders[0]!r})::INT + 2 * (turn > {t.borders[1]!r})::INT AS leaf, count(*) AS n FROM featured GROUP BY ALL"
    for k, t in enumerate(_SET_TREES.trees)))
def leaf_weights(spark, sf_dir):
    return boosting.leaf_weights(_frame(spark, sf_dir), _SET_TREES)


_SIDES_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS feature, {k} AS tree, {other} AS rest, ({test})::INT AS side, count(*)::DOUBLE AS n, any_value({_tree_sql(k)}) AS v FROM featured GROUP BY ALL"
    for k, t in enumerate(_SET_TREES.trees)
    for name, test, other in (("hour_of_day", f"hour_of_day > {t.borders[0]!r}", f"(turn > {t.borders[1]!r})::INT"),
                              ("conversation_turn", f"turn > {t.borders[1]!r}", f"(hour_of_day > {t.borders[0]!r})::INT")))


@register("prediction_change", with_views(["featured"], "") + f"""
, sides AS ({_SIDES_SQL}), changes AS (SELECT feature, sum(n) * var_pop_w AS change FROM (
  SELECT feature, tree, rest, sum(n) AS n, sum(n * v * v) / sum(n) - (sum(n * v) / sum(n)) ** 2 AS var_pop_w FROM sides GROUP BY ALL) GROUP BY feature, tree, rest, var_pop_w)
SELECT feature, round(100 * sum(change) / (SELECT sum(change) FROM changes), 4) AS importance FROM changes GROUP BY feature""")
def prediction_change(spark, sf_dir):
    """Importance of the features of the set trees, with the rows of the table as the weights of their leaves."""
    counts = {(row["tree"], row["leaf"]): row["n"] for row in boosting.leaf_weights(_frame(spark, sf_dir), _SET_TREES).collect()}  # 48 leaves
    trees = [replace(tree, weights=[counts.get((k, leaf), 0) for leaf in range(4)]) for k, tree in enumerate(_SET_TREES.trees)]
    share = boosting.BoostedTrees(0.0, trees).importance()
    return spark.createDataFrame(list(share.items()), "feature string, importance double").withColumn("importance", F.round("importance", 4))


@register("training_facts", """
SELECT true AS falls_on_train, true AS kept_the_best, true AS tells_the_losses, true AS stops_in_time""")
def training_facts(spark, sf_dir):
    """Of the trained model: each tree lowers the loss of its training rows as encoded for training, the best round on validation is kept."""
    frame, train, validation = _labelled_frame(spark, sf_dir)
    encoder = model.RateEncoder.fit(train, "click", TRAINING)
    ordered = materialize(encoder.ordered(train, "click", "event_timestamp", TRAINING))
    held = encoder.encode(validation)
    config = boosting.BoostConfig(rounds=8, depth=4, learning_rate=0.3, patience=4)
    fitted = boosting.fit(ordered, held, model.ENCODED_COLUMNS, "click", config)
    falls = boosting.staged_losses(ordered, fitted.model, "click")
    falls = falls.select((F.col("loss") < F.lag("loss").over(Window.orderBy("round"))).alias("less")).agg(F.every("less").alias("falls_on_train"))  # a row a round
    kept = fitted.losses[1:]
    told = boosting.staged_losses(held, fitted.model, "click").orderBy("round").collect()
    return falls.select(
        "falls_on_train", F.lit(kept[fitted.best_round - 1] == min(kept)).alias("kept_the_best"),
        F.lit(all(abs(row["loss"] - loss) < 1e-6 for row, loss in zip(told, fitted.losses))).alias("tells_the_losses"),
        F.lit(len(kept) - fitted.best_round <= config.patience).alias("stops_in_time"))


# Streams


def _event_stream(spark, sf_dir):
    schema = views.table(spark, sf_dir, "events").schema
    return live.read_stream(spark, sf_dir, schema, pathGlobFilter="events.parquet")


def _stored_request_stream(spark, sf_dir):
    folder = work_path(spark, "requests")
    stored = requests(spark, sf_dir)
    stored.write.parquet(folder)
    return live.read_stream(spark, folder, stored.schema)


@register("stream_scores", with_views(["impressions"], """
SELECT id, round(0.05::DOUBLE * 1.05::DOUBLE * 1.03::DOUBLE * CASE WHEN session_msg_count > 0 AND conversation_turn / session_msg_count <= 0.25
    THEN 1.02::DOUBLE WHEN session_msg_count > 0 THEN 0.98::DOUBLE ELSE 1 END, 6) AS predicted_ctr FROM impressions"""))
def stream_scores(spark, sf_dir):
    folder = work_path(spark, "stream")
    scored = live.score_stream(views.impression_columns(_event_stream(spark, sf_dir)), model.Predictor())
    live.run_once(scored.select("id", "predicted_ctr"), f"{folder}/out", f"{folder}/state")
    return spark.read.schema("id string, predicted_ctr double").parquet(f"{folder}/out")


@register("stream_ranking", with_views(["ranked"], """
SELECT request_id, candidate_id, rank, final_score FROM ranked"""))
def stream_ranking(spark, sf_dir):
    folder = work_path(spark, "stream")
    ranked = live.rank_stream(_stored_request_stream(spark, sf_dir))
    live.run_once(ranked, f"{folder}/out", f"{folder}/state")
    stored = spark.read.schema(ranked.schema).parquet(f"{folder}/out")
    return stored.select("request_id", F.inline("ranked_candidates")).select(
        "request_id", "candidate_id", F.col("rank").cast("bigint").alias("rank"), "final_score"
    )


@register("stream_windowed_ctr", """
SELECT date_trunc('hour', ts) AS window_start, count(*) AS impressions, round(avg((event_type = 'click')::INTEGER), 6) AS ctr
FROM events, (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS closed FROM events)
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= closed GROUP BY 1""")
def stream_windowed_ctr(spark, sf_dir):
    """Windows that the watermark has closed: in append mode each is written once, and its state is freed."""
    folder = work_path(spark, "stream")
    events = _event_stream(spark, sf_dir).withColumn("click", (F.col("event_type") == "click").cast("double"))
    series = live.windowed_ctr(events)
    live.run_once(series, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(series.schema).parquet(f"{folder}/out").select("window_start", "impressions", r6("ctr"))


# A model of one tree, so that its scores can be worked out in SQL; one of its questions needs the characters.
_ONE_TREE = model.ClickModel(None, None, {"model_version": "set"}, boosting.BoostedTrees(
    -1.0, [boosting.Tree(["num_interactions", "hour_of_day"], [4000.0, 9.0], [-0.5, 0.25, 0.125, 0.75], [1, 1, 1, 1])]))
_ONE_TREE_SQL = """list_extract([-0.5::DOUBLE, 0.25, 0.125, 0.75], 1 + (interactions > 4000)::INT + 2 * (hour_of_day > 9)::INT)"""


@register("stream_model_scores", with_views(["featured"], f"""
SELECT id, round(1 / (1 + exp(1 - {_ONE_TREE_SQL})), 6) AS predicted_ctr, 'set' AS model_version FROM featured"""))
def stream_model_scores(spark, sf_dir):
    """A stream of all events, scored with a stored model and characters that are read anew for each micro-batch."""
    folder = work_path(spark, "stream")
    _ONE_TREE.save(spark, f"{folder}/model")
    views.characters(spark, sf_dir).write.parquet(f"{folder}/characters")
    work = live.score_and_store(
        lambda: model.load_predictor(spark, f"{folder}/model"), lambda: spark.read.parquet(f"{folder}/characters"), f"{folder}/out", "version")
    live.run_batches(views.impression_columns(_event_stream(spark, sf_dir)), work, f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select("id", "predicted_ctr", "model_version")


@register("stream_accepted_and_rejected", """
SELECT o_orderkey::VARCHAR AS request_id, CASE WHEN n IS NULL THEN 'empty_candidates' WHEN n > 6 THEN 'too_many_candidates' ELSE 'none' END AS rejection
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def stream_accepted_and_rejected(spark, sf_dir):
    """Both outputs of a stream of requests, after its only batch was replayed: each request stands in one of them, once."""
    folder = work_path(spark, "stream")
    stored = requests(spark, sf_dir)
    stored.write.parquet(f"{folder}/in")
    work = live.rank_and_reject(folder, limit=6)
    live.run_batches(live.read_stream(spark, f"{folder}/in", stored.schema), work, f"{folder}/state")
    work(spark.read.parquet(f"{folder}/in"), 0)
    accepted = spark.read.parquet(f"{folder}/ranked").select("request_id", F.lit("none").alias("rejection"))
    return accepted.unionByName(spark.read.parquet(f"{folder}/rejected").select("request_id", "rejection"))


@register("batch_scores", with_views(["impressions"], """
SELECT id, round(0.05::DOUBLE * 1.05::DOUBLE * 1.03::DOUBLE * CASE WHEN session_msg_count > 0 AND conversation_turn / session_msg_count <= 0.25
    THEN 1.02::DOUBLE WHEN session_msg_count > 0 THEN 0.98::DOUBLE ELSE 1 END, 6) AS predicted_ctr FROM impressions"""))
def batch_scores(spark, sf_dir):
    """The batch scoring job with a model that breaks inside tasks: every part is written with fallback scores."""
    folder = work_path(spark, "scores")
    failed = jobs.score_batch(views.impressions(spark, sf_dir), model.Predictor(_BreaksInTasks()), folder, batches=3)
    if sorted(failed) != [0, 1, 2]:
        raise RuntimeError(f"parts that failed: {failed}")
    return spark.read.parquet(folder).where(F.get("reasons", F.lit(0)).startswith(model.UNAVAILABLE)).select("id", "predicted_ctr")


class _BreaksInTasks:
    version = "broken"

    def transform(self, df):
        return df.withColumn("probability", F.raise_error(F.lit("lost files")).cast("double"))


_LATE = "event_id % 10 = 7"


@register("stream_late_rows", f"""
WITH first AS (SELECT * FROM events WHERE NOT {_LATE}), second AS (SELECT * FROM events WHERE {_LATE}),
late AS (SELECT s.*, date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM first) AS is_late FROM second s)
SELECT window_start, sum(timely)::BIGINT AS impressions, round(sum(timely_clicks) / nullif(sum(timely), 0), 6) AS ctr, sum(late)::BIGINT AS late_rows FROM (
  SELECT date_trunc('hour', ts) AS window_start, 1 AS timely, (event_type = 'click')::INT::DOUBLE AS timely_clicks, 0 AS late FROM first
  UNION ALL SELECT date_trunc('hour', ts), (NOT is_late)::INT, (NOT is_late AND event_type = 'click')::INT::DOUBLE, is_late::INT FROM late) GROUP BY 1""")
def stream_late_rows(spark, sf_dir):
    """Events that arrive in two batches, every tenth of them in the second: what is in time, and what is late."""
    folder = work_path(spark, "stream")
    events = views.table(spark, sf_dir, "events")
    work = live.count_windows(f"{folder}/out")
    for late in (f"NOT {_LATE}", _LATE):
        events.where(late).write.mode("append").parquet(f"{folder}/in")
        stream = live.read_stream(spark, f"{folder}/in", events.schema).withColumn("click", (F.col("event_type") == "click").cast("double"))
        live.run_batches(stream, work, f"{folder}/state")
    return live.windows(spark, f"{folder}/out").select("window_start", "impressions", r6("ctr"), "late_rows")
