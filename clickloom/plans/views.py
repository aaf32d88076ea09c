"""Impression, character, request and log views over the provided tables.

The views only rename and compute columns and keep every row. ``SQL`` holds the same views for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickloom.operators.features import build_features
from clickloom.operators.joins import join_dimension

CANDIDATE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def impression_columns(events: DataFrame, *extra: str) -> DataFrame:
    """Impressions from events, batch or stream. No feature is derived from the label."""
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int")).selectExpr(
        "string(event_id) AS id",
        "date_format(ts, 'yyMMddHH') AS hour",
        "double(event_type = 'click') AS click",
        "string(k % 4) AS banner_pos",
        "concat('site', k) AS site_id",
        "concat('sd', k % 10) AS site_domain",
        "concat('s', k % 5) AS site_category",
        "concat('app', event_id % 50) AS app_id",
        "concat('ad', event_id % 10) AS app_domain",
        "concat('a', k % 7) AS app_category",
        "concat('dev', user_id) AS device_id",
        "concat('ip', event_id % 1000) AS device_ip",
        "concat('m', user_id % 20) AS device_model",
        "string(k % 3) AS device_type",
        "string(event_id % 4) AS device_conn_type",
        "'1005' AS C1",
        "string(floor(value)) AS C14",
        "'320' AS C15",
        "'50' AS C16",
        "string(k) AS C17",
        "string(k % 4) AS C18",
        "string(user_id % 7) AS C19",
        "string(event_id % 9) AS C20",
        "string(event_id % 11) AS C21",
        "string(user_id) AS character_id",
        "double(event_id % 12) AS conversation_turn",
        "double(event_id % 20) AS session_msg_count",
        *extra,
    )


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impression_columns(table(spark, sf_dir, "events"))


def _tier(number: str) -> str:
    return f"element_at(array('sfw', 'suggestive', 'mature', 'unknown'), int(({number}) % 4 + 1)) AS safety_tier"


def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of every customer; every tenth goes by another id and joins to no impression."""
    customer = table(spark, sf_dir, "customer").withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    return customer.selectExpr(
        "CASE WHEN c_custkey % 10 = 9 THEN concat('retired-', c_custkey) ELSE string(c_custkey) END AS character_id",
        "c_name AS character_name",
        "concat('about ', c_name) AS character_description",
        _tier("c_nationkey + 2 - version"),
        "c_mktsegment AS creator_type",
        "c_acctbal AS num_interactions",
        "string(date_add(DATE'2023-12-25', int(c_custkey % 40))) AS created_at",
        "version",
    )


DEFECTS = {
    "hour": "CASE WHEN id % 97 = 0 THEN NULL WHEN id % 101 = 0 THEN 'bad' ELSE hour END",
    "click": "CASE WHEN id % 103 = 0 THEN 2.0D ELSE click END",
    "app_category": "CASE WHEN id % 107 = 0 THEN ' ' WHEN id % 109 = 0 THEN ' x ' ELSE app_category END",
    "site_category": "CASE WHEN id % 113 = 0 THEN 'None' ELSE site_category END",
    "character_id": "CASE WHEN id % 127 = 0 THEN NULL ELSE character_id END",
    "conversation_turn": "CASE WHEN id % 131 = 0 THEN -3.0D ELSE conversation_turn END",
    "session_msg_count": "CASE WHEN id % 137 = 0 THEN NULL ELSE session_msg_count END",
}


def dirty_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions with the defects the provided events lack."""
    df = impressions(spark, sf_dir)
    return df.selectExpr(*[
        f"{DEFECTS[name].replace('id %', 'bigint(id) %')} AS {name}" if name in DEFECTS else name for name in df.columns
    ])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows with a label ``y``, a score ``p`` in [0, 1] and a split name."""
    events = table(spark, sf_dir, "events")
    frame = build_features(impression_columns(events, "value"), characters(spark, sf_dir), "version")
    return frame.select(
        "id", "character_id", "safety_tier", "creator_type", "app_category", "conversation_turn",
        F.col("click").cast("int").alias("y"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("p"),
        F.when(F.col("id").cast("bigint") % 3 == 0, "validation").otherwise("test").alias("split"),
    )


def rank_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ad opportunity per order."""
    return table(spark, sf_dir, "orders").selectExpr(
        "string(o_orderkey) AS request_id",
        "string(o_custkey) AS character_id",
        _tier("o_orderkey"),
        "CASE WHEN o_orderkey % 3 != 0 THEN o_orderpriority END AS app_category",
        "CASE WHEN o_orderkey % 4 != 0 THEN o_orderstatus END AS site_category",
        "'9' AS banner_pos",
        "string(o_orderkey % 6) AS C14",
        "double(o_orderkey % 12) AS conversation_turn",
        "double(o_orderkey % 20) AS session_msg_count",
    )


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate ad per line item: request, sort columns ``CANDIDATE_ORDER`` and the ad's fields."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    item = join_dimension(table(spark, sf_dir, "lineitem"), part, "l_partkey")
    return item.selectExpr(
        "string(l_orderkey) AS request_id",
        *CANDIDATE_ORDER,
        "CASE WHEN l_partkey % 5 != 0 THEN concat('part', l_partkey) END AS candidate_id",
        "concat('campaign', l_suppkey) AS campaign_id",
        "CASE WHEN p_size % 2 = 0 THEN string(p_size % 8) END AS banner_pos",
        "string(p_size) AS C14",
        "l_tax AS bid",
        _tier("p_size"),
        "p_size % 10 AS fatigue_count",
        "(l_partkey % 30) / 15.0D AS pacing_ratio",
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate ads from customers, some of which break the field rules."""
    return table(spark, sf_dir, "customer").selectExpr(
        "string(c_custkey) AS candidate_id",
        "c_acctbal AS bid",
        "element_at(array('sfw', 'suggestive', 'mature', 'unknown', 'banned'), c_nationkey % 5 + 1) AS safety_tier",
        "int(c_custkey % 10 - 1) AS fatigue_count",
        "(c_custkey % 30) / 15.0D - 0.1D AS pacing_ratio",
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("/"), "event_type").alias("path"), F.col("value").alias("duration_ms")
    )
