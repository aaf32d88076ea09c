"""Table contracts: column lists, request structs and the constants results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# The anonymised ad fields, in order.
C_FIELDS = ["C1", "C14", "C15", "C16", "C17", "C18", "C19", "C20", "C21"]

# Where the ad was shown and on what device.
PLACEMENT_FIELDS = [
    "banner_pos", "site_id", "site_domain", "site_category", "app_id", "app_domain",
    "app_category", "device_id", "device_ip", "device_model", "device_type", "device_conn_type",
]

# Required columns of the two input tables.
IMPRESSION_COLUMNS = [
    "id", "hour", "click", *PLACEMENT_FIELDS, *C_FIELDS,
    "character_id", "conversation_turn", "session_msg_count",
]
CHARACTER_COLUMNS = [
    "character_id", "character_name", "character_description", "safety_tier", "creator_type",
    "num_interactions", "created_at",
]

IMPRESSION_NUMERICS = ["click", "conversation_turn", "session_msg_count"]
CHARACTER_NUMERICS = ["num_interactions"]

# The 33 model features, in model order.
CATEGORICAL_FEATURES = [
    *PLACEMENT_FIELDS, "character_id", "safety_tier", "creator_type", *C_FIELDS,
]
NUMERIC_FEATURES = [
    "conversation_turn", "session_msg_count", "turn_ratio", "hour_of_day", "day_of_week",
    "is_weekend", "num_interactions", "num_interactions_log1p", "character_age_days",
]
FEATURE_COLUMNS = [*CATEGORICAL_FEATURES, *NUMERIC_FEATURES]

# Texts that mean "no category" after trimming, and the text they become.
UNKNOWN = "unknown"
MISSING_CATEGORY_TEXTS = ["", "nan", "None", "<NA>"]

# CSV cell texts read as null.
CSV_NULL_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Ad fields a candidate may override, tiers, drift features and period names.
AD_FIELDS = ["banner_pos", *C_FIELDS]
SAFETY_TIERS = ["sfw", "suggestive", "mature", "unknown"]
DRIFT_FEATURES = ["safety_tier", "creator_type", "app_category", "site_category", "device_type"]
PERIODS = ["early", "middle", "latest"]
SLICE_COLUMNS = ["safety_tier", "creator_type", "turn_stage", "cold_start_character", "app_category"]
SPLITS = ["train", "validation", "test"]

# Serving defaults.
FALLBACK_CTR = 0.05
UNTRAINED_VERSION = "untrained-0.1.0"
COLD_START_MIN_IMPRESSIONS = 500
MAX_RANK_CANDIDATES = 200


def _strings(names: list[str]) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


CANDIDATE_SCHEMA = T.StructType([
    *_strings(["candidate_id", "campaign_id", "advertiser_id", *AD_FIELDS]),
    T.StructField("bid", T.DoubleType()),
    T.StructField("safety_tier", T.StringType()),
    T.StructField("fatigue_count", T.IntegerType()),
    T.StructField("pacing_ratio", T.DoubleType()),
])

CONTEXT_SCHEMA = T.StructType([
    *_strings(["id", "hour", *PLACEMENT_FIELDS, *C_FIELDS, "character_id"]),
    T.StructField("conversation_turn", T.DoubleType()),
    T.StructField("session_msg_count", T.DoubleType()),
    *_strings(["safety_tier", "creator_type"]),
    T.StructField("num_interactions", T.DoubleType()),
    T.StructField("character_description", T.StringType()),
    T.StructField("extras", T.MapType(T.StringType(), T.StringType())),
])

RANK_REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    *CONTEXT_SCHEMA.fields,
    T.StructField("candidates", T.ArrayType(CANDIDATE_SCHEMA)),
])


def missing_columns(columns: list[str], required: list[str]) -> list[str]:
    present = set(columns)
    return [name for name in required if name not in present]


def require_columns(columns: list[str], required: list[str], table: str) -> None:
    missing = missing_columns(columns, required)
    if missing:
        raise ValueError(f"{table}: these columns are needed and not there: {missing}")
