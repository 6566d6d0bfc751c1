"""Column expressions shared by all jobs: coercion, rounding, calendar, formatting.

Everything here is built from Spark's own functions, so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Number pattern used on readings with units, and weekday labels
# in the Sunday-first order of SQL's day-of-week.
NUMBER_PATTERN = r"([-+]?\d*\.?\d+)"
WEEKDAY_LABELS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]

_UNIT_SECONDS = {"s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "t": 60,
                 "h": 3600, "hr": 3600, "hour": 3600, "d": 86400, "day": 86400}


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds_of(freq: str) -> int:
    """``"15min"``, ``"1h"``, ``"30 minutes"`` -> seconds."""
    match = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+?)s?\s*", freq)
    unit = match and (match.group(2).lower() or "s")
    if not match or unit not in _UNIT_SECONDS:
        raise ValueError(f"unknown frequency: {freq!r}")
    return int(match.group(1) or 1) * _UNIT_SECONDS[unit]


# --- coercion ---------------------------------------------------------------

def to_number(c: Column | str) -> Column:
    """Double, or null where the value is not a number."""
    value = as_col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def to_moment(c: Column | str) -> Column:
    """Local timestamp without zone, or null where the value is not one."""
    return as_col(c).try_cast("timestamp_ntz")


def local_moment(c: Column | str) -> Column:
    """Wall-clock time of text such as ``2024-04-28T00:00:00-07:00 Los_Angeles``."""
    bare = F.regexp_replace(
        F.trim(as_col(c)), r"(Z|[+-]\d{2}:?\d{2})?(\s+[A-Za-z_/]+)?$", ""
    )
    return bare.try_cast("timestamp_ntz")


def first_number(c: Column | str) -> Column:
    """First number inside text such as ``72.5 F``; null when there is none."""
    return F.regexp_extract(as_col(c).cast("string"), NUMBER_PATTERN, 1).try_cast("double")


def squash(c: Column | str) -> Column:
    """Lower case, trimmed, inner blanks collapsed."""
    return F.regexp_replace(F.lower(F.trim(as_col(c))), r"\s+", " ")


def non_negative(c: Column | str) -> Column:
    """Null becomes 0, negatives become 0."""
    return F.greatest(F.coalesce(as_col(c), F.lit(0.0)), F.lit(0.0))


# --- arithmetic -------------------------------------------------------------

def round_to(c: Column | str, places: int = 2) -> Column:
    """Decimal rounding, half away from zero, returned as double; NaN becomes null.

    Ten digits are settled first, so that binary noise does not decide a tie.
    The value is read once: where it is a subquery, that is planned once.
    """
    value = as_col(c).try_cast("double")
    return F.nanvl(F.round(F.round(value, 10), places), F.lit(None).cast("double"))


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` with 0 for an empty denominator."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def share(flag: Column) -> Column:
    """Aggregate: fraction of rows where ``flag`` holds; null flags count as false."""
    return F.avg(F.when(flag, F.lit(1.0)).otherwise(F.lit(0.0)))


def tally(flag: Column) -> Column:
    """Aggregate: number of rows where ``flag`` holds."""
    return F.coalesce(F.count_if(flag), F.lit(0)).cast("bigint")


# --- calendar ---------------------------------------------------------------

def dow_sun0(ts: Column | str) -> Column:
    return (F.dayofweek(as_col(ts)) - 1).cast("int")


def dow_mon0(ts: Column | str) -> Column:
    return F.weekday(as_col(ts)).cast("int")


def hour_of(ts: Column | str) -> Column:
    return F.hour(as_col(ts)).cast("int")


def minute_of_day(ts: Column | str) -> Column:
    return (F.hour(as_col(ts)) * 60 + F.minute(as_col(ts))).cast("int")


def weekend(ts: Column | str) -> Column:
    return (F.weekday(as_col(ts)) >= 5).cast("int")


def day_of(ts: Column | str) -> Column:
    return F.to_date(as_col(ts))


def bucket(ts: Column | str, seconds: int) -> Column:
    """Start of the epoch-aligned bucket ``ts`` falls in; null stays null."""
    step = F.lit(seconds * 1_000_000)
    return F.timestamp_add("MICROSECOND", -F.pmod(epoch_micros(ts), step), as_col(ts))


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    ts = as_col(ts)
    return (
        F.unix_date(F.to_date(ts)).cast("bigint") * F.lit(86_400_000_000)
        + F.hour(ts).cast("bigint") * F.lit(3_600_000_000)
        + F.minute(ts).cast("bigint") * F.lit(60_000_000)
        + (F.date_part(F.lit("SECOND"), ts) * F.lit(1_000_000)).cast("bigint")
    )


def after(ts: Column | str, micros: Column) -> Column:
    """``ts`` moved forward by a number of microseconds."""
    return F.timestamp_add("MICROSECOND", micros.cast("bigint"), as_col(ts))


# --- text for reports -------------------------------------------------------

def show_number(c: Column | str, places: int = 2) -> Column:
    return F.coalesce(F.format_number(as_col(c).cast("double"), places), F.lit("N/A"))


def show_hour(c: Column | str) -> Column:
    padded = F.lpad(as_col(c).cast("string"), 2, "0")
    return F.coalesce(F.concat(padded, F.lit(":00")), F.lit("N/A"))


def weekday_label(dow: Column | str) -> Column:
    names = F.array(*[F.lit(name) for name in WEEKDAY_LABELS])
    return F.coalesce(F.try_element_at(names, as_col(dow) + 1), F.lit("N/A"))
