"""Text expressions: trimming, category and tier normalisation, canonical number text.

Functions that serve many columns at once take and return SQL text, so that a frame of dozens of
columns is a few calls to the JVM and not thousands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from clickloom.schema import CSV_NULL_TEXTS, MISSING_CATEGORY_TEXTS, SAFETY_TIERS, UNKNOWN

# The Unicode white space characters.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def quoted(name: str) -> str:
    return f"`{name}`"


def text_list(texts: list[str]) -> str:
    return ", ".join(f"'{text}'" for text in texts)


def trimmed(sql: str) -> str:
    return f"trim(BOTH '{WHITESPACE}' FROM {sql})"


def is_plain(sql: str) -> str:
    """True for text whose first and last characters are printable ASCII, so it needs no trimming."""
    return f"({sql} > ' ' AND {sql} < '\x7f' AND substr({sql}, -1, 1) BETWEEN '!' AND '~')"


def column_or_default(df: DataFrame, name: str, default=None) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def column_sql(df: DataFrame, name: str) -> str:
    return quoted(name) if name in df.columns else "NULL"


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType if name in df.columns else T.NullType()


def canonical_text(sql: str, data_type: T.DataType) -> str:
    """Text of a value; whole floating numbers lose their ".0" so they match integer text."""
    if isinstance(data_type, T.StringType):
        return sql
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        number = f"CAST({sql} AS DOUBLE)"
        return (
            f"CASE WHEN isnan({number}) THEN NULL"
            f" WHEN {number} = floor({number}) AND abs({number}) < 1e15D THEN CAST(CAST({number} AS BIGINT) AS STRING)"
            f" ELSE CAST({number} AS STRING) END"
        )
    return f"CAST({sql} AS STRING)"


def normalize_category(sql: str) -> str:
    """Trimmed category, or "unknown" for a missing one.

    The rare text that needs work goes through a one-element array: with two dozen categories, the
    inlined code would otherwise grow past the size the JVM compiles.
    """
    missing = text_list(MISSING_CATEGORY_TEXTS)
    cleaned = f"coalesce(CASE WHEN {trimmed('x')} NOT IN ({missing}) THEN {trimmed('x')} END, '{UNKNOWN}')"
    return (
        f"CASE WHEN {is_plain(sql)} AND {sql} NOT IN ({missing}) THEN {sql}"
        f" ELSE element_at(transform(array({sql}), x -> {cleaned}), 1) END"
    )


def normalize_tier(text: Column) -> Column:
    """Trimmed lower-case tier, with null and empty text as "unknown"; the known tiers are passed through."""
    value = text.cast("string")
    filled = F.coalesce(F.nullif(value, F.lit("")), F.lit(UNKNOWN))
    return F.when(value.isin(SAFETY_TIERS), value).otherwise(F.lower(F.trim(filled, F.lit(WHITESPACE))))


def null_text(sql: str) -> str:
    """Null for the cell texts a CSV uses for missing values."""
    return f"CASE WHEN {sql} NOT IN ({text_list(CSV_NULL_TEXTS)}) THEN {sql} END"


def known_id(value: Column) -> Column:
    """Join key form of an id: text, with null as "unknown" and no trimming."""
    return F.coalesce(value.cast("string"), F.lit(UNKNOWN))
