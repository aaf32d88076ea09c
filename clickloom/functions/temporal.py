"""Time expressions. Times are TIMESTAMP_NTZ in UTC and do not depend on the session time zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F, types as T

from clickloom.functions.text import WHITESPACE, trimmed
from clickloom.schema import UNKNOWN

# Two-digit years from here on belong to the 1900s.
CENTURY_PIVOT = 69
_PACKED = "^[0-9]{8}$"
_ISO = "^[0-9]{4}(-|$)"
_SLASHED = "^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})"
_ZONED = r"^[0-9-]{8,10}[ T].*[0-9:.][ ]*(Z|UTC|GMT|[+-][0-9]{1,2}(:?[0-9]{2})?)$"
_ZONE = r"[0-9:.](\s*(Z|UTC|GMT)|[+-][0-9]{1,2}(:?[0-9]{2})?)$"


def _packed_hour(sql: str) -> str:
    year, month, day, hour = (f"try_cast(substr({sql}, {start}, 2) AS INT)" for start in (1, 3, 5, 7))
    century = f"CASE WHEN {year} >= {CENTURY_PIVOT} THEN 1900 ELSE 2000 END"
    return f"try_make_timestamp_ntz({century} + {year}, {month}, {day}, {hour}, 0, 0)"


def parse_hour(sql: str) -> Column:
    """``yyMMddHH`` text, else a timestamp as Spark reads it, with ``-`` or ``/`` between the parts of the date; anything
    else is null. Takes SQL text. A time with a zone becomes UTC, as in ``to_utc_naive``.

    Each row is parsed by itself, so the result does not depend on other rows. Text other than plain
    digits goes through a one-element array, which keeps the usual path small and fast.
    """
    text = f"regexp_replace({trimmed('x')}, '[.]0$', '')"
    dated = f"regexp_replace({trimmed('x')}, '{_SLASHED}', '$1-$2-$3')"
    # Midnight of 1970 in UTC plus the microseconds since: the wall clock in UTC, whatever the session's zone is.
    instant = f"timestampadd(MICROSECOND, unix_micros(try_cast({dated} AS TIMESTAMP)), TIMESTAMP_NTZ '1970-01-01 00:00:00')"
    other = (
        f"CASE WHEN {text} RLIKE '{_PACKED}' THEN {_packed_hour(text)}"
        f" WHEN {dated} RLIKE '{_ZONED}' THEN {instant}"
        f" WHEN {dated} RLIKE '{_ISO}' THEN try_cast({dated} AS TIMESTAMP_NTZ) END"
    )
    return F.expr(
        f"CASE WHEN {sql} RLIKE '{_PACKED}' THEN {_packed_hour(sql)}"
        f" ELSE element_at(transform(array({sql}), x -> {other}), 1) END"
    )


def instant_to_utc(instant: Column) -> Column:
    """UTC wall clock of a zoned timestamp, whatever the session zone is."""
    seconds = (F.unix_micros(instant).cast("decimal(24,0)") / F.lit(1000000)).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def to_utc_naive(value: Column, data_type: T.DataType) -> Column:
    """Any time value as a naive UTC timestamp; unparseable text is null."""
    if isinstance(data_type, T.TimestampNTZType):
        return value
    if isinstance(data_type, T.TimestampType):
        return instant_to_utc(value)
    if isinstance(data_type, T.DateType):
        return value.cast("timestamp_ntz")
    if isinstance(data_type, T.StringType):
        text = F.trim(value, F.lit(WHITESPACE))
        iso = text.rlike(_ISO)
        zoned = text.rlike("^[0-9-]{10}[ T]") & text.rlike(_ZONE)
        return (
            F.when(iso & zoned, instant_to_utc(text.try_cast("timestamp")))
            .when(iso, text.try_cast("timestamp_ntz"))
        )
    return F.lit(None).cast("timestamp_ntz")


def utc_now() -> Column:
    return F.expr("convert_timezone(current_timezone(), 'UTC', localtimestamp())")


def hour_of_day(time: Column) -> Column:
    return F.coalesce(F.hour(time), F.lit(-1))


def day_of_week(time: Column) -> Column:
    """Monday is 0; null is -1."""
    return F.coalesce(F.weekday(time), F.lit(-1))


def is_weekend(time: Column) -> Column:
    return F.coalesce(F.weekday(time).isin(5, 6), F.lit(False)).cast("int")


def day_label(time: Column) -> Column:
    return F.coalesce(F.substring(time.cast("string"), 1, 10), F.lit(UNKNOWN))


def hour_label(time: Column) -> Column:
    return F.coalesce(F.concat(F.substring(time.cast("string"), 1, 13), F.lit(":00")), F.lit(UNKNOWN))


def hour_number(time: Column) -> Column:
    """Hours since 1970, a coarse key in time order."""
    return F.unix_date(time.cast("date")).cast("bigint") * 24 + F.hour(time)


def whole_days(start: Column, end: Column) -> Column:
    """Full 24-hour periods between two naive times (not calendar days)."""
    return F.extract(F.lit("DAY"), end - start)


def utc_micros(time: Column) -> Column:
    """Microseconds since 1970 of a naive UTC time."""
    since = time - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), since)
    minutes = (part("DAY").cast("bigint") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return minutes * 60000000 + (part("SECOND") * 1000000).cast("bigint")


def literal(time: datetime | None) -> Column:
    """A naive time as a constant; passing a datetime itself would go through the session time zone."""
    return F.lit(None if time is None else time.isoformat(sep=" ")).cast("timestamp_ntz")
