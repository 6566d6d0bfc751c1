"""Canonical series: name resolution, coercion, duplicate collapse, time filters."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from roomtide.functions.scalars import as_col, to_moment, to_number

# Accepted source column names, first match wins.
OCCUPANCY_TIME = ["timestamp", "interval_begin", "beginning", "ds"]
OCCUPANCY_ZONE = ["zone_id", "access_point", "space_id", "ap", "user"]
OCCUPANCY_COUNT = ["occupancy_count", "count", "occupancy", "y"]
WEATHER_TIME = ["timestamp", "time", "ds"]
WEATHER_TEMP = ["outside_temp", "temperature", "temp", "temperature_2m", "y"]
EQUIPMENT_TIME = ["timestamp", "Timestamp", "time", "beginning"]
EQUIPMENT_ZONE = ["zone_id", "space_id", "access_point", "ap"]


def resolve(df: DataFrame, candidates: Sequence[str], role: str) -> str:
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"no {role} column; looked for {', '.join(candidates)}")


def occupancy_rows(df: DataFrame, zone_id: str | None = None) -> DataFrame:
    """``timestamp, zone_id, occupancy_count`` with unusable rows dropped."""
    ts = resolve(df, OCCUPANCY_TIME, "timestamp")
    zone = resolve(df, OCCUPANCY_ZONE, "zone")
    count = resolve(df, OCCUPANCY_COUNT, "occupancy")
    rows = df.select(
        to_moment(df[ts]).alias("timestamp"),
        df[zone].cast("string").alias("zone_id"),
        to_number(df[count]).alias("occupancy_count"),
    ).dropna()
    return rows if zone_id is None else rows.where(F.col("zone_id") == str(zone_id))


def normalize_occupancy(df: DataFrame, zone_id: str | None = None) -> DataFrame:
    """One row per (timestamp, zone): the mean of its duplicates."""
    return occupancy_rows(df, zone_id).groupBy("timestamp", "zone_id").agg(
        F.avg("occupancy_count").alias("occupancy_count")
    )


def count_duplicates(df: DataFrame, zone_id: str | None = None) -> DataFrame:
    """One row: usable rows, distinct keys and the rows that repeat a key."""
    per_key = occupancy_rows(df, zone_id).groupBy("timestamp", "zone_id").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("usable_rows"),
        F.count(F.lit(1)).cast("bigint").alias("distinct_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
    )


def normalize_weather(df: DataFrame) -> DataFrame:
    """One row per timestamp: mean outside temperature."""
    ts = resolve(df, WEATHER_TIME, "weather timestamp")
    temp = resolve(df, WEATHER_TEMP, "weather temperature")
    rows = df.select(to_moment(df[ts]).alias("timestamp"), to_number(df[temp]).alias("outside_temp"))
    return rows.dropna(subset=["timestamp"]).groupBy("timestamp").agg(F.avg("outside_temp").alias("outside_temp"))


def coerce_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn the named columns that exist into doubles; text that is no number becomes null."""
    return df.withColumns({c: to_number(c) for c in columns if c in df.columns})


def moment(value: datetime | date | str | None) -> datetime | None:
    if value is None or isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    return datetime.fromisoformat(value)


def moment_lit(value: datetime | date | str) -> Column:
    return F.lit(moment(value).isoformat(sep=" ")).cast("timestamp_ntz")


def between(
    ts: Column | str,
    start: datetime | date | str | None = None,
    end: datetime | date | str | None = None,
    end_open: bool = False,
) -> Column:
    """Time-range predicate, both ends included; true when no end is given."""
    start, end = moment(start), moment(end)
    if start is not None and end is not None and start > end:
        raise ValueError("start must not be after end")
    ts, inside = as_col(ts), None
    if start is not None:
        inside = ts >= moment_lit(start)
    if end is not None:
        upper = ts < moment_lit(end) if end_open else ts <= moment_lit(end)
        inside = upper if inside is None else inside & upper
    return F.lit(True) if inside is None else inside


def day_window(start_day: date | str, end_day: date | str, half_open: bool = False) -> tuple[datetime, datetime]:
    """First and last moment of a range of days.

    The default end is one second before midnight; ``half_open`` returns the
    next midnight instead, to be used with ``between(..., end_open=True)``.
    """
    end = moment(end_day) + timedelta(days=1)
    return moment(start_day), end if half_open else end - timedelta(seconds=1)


def chosen_days(value, first_day: date, last_day: date) -> tuple[date, date]:
    """Day range from a user's choice: a pair (either part may be missing), one day, or nothing."""
    if isinstance(value, (tuple, list)) and len(value) == 2:
        return value[0] or first_day, value[1] or last_day
    if isinstance(value, date):
        return value, value
    return first_day, last_day


def day_bounds(df: DataFrame, ts: str) -> DataFrame:
    """One row: first and last day with data, today when there is none."""
    return df.agg(
        F.coalesce(F.to_date(F.min(ts)), F.current_date()).alias("first_day"),
        F.coalesce(F.to_date(F.max(ts)), F.current_date()).alias("last_day"),
    )


def last_days(df: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days before the newest row.

    The newest moment is a scalar subquery, so the bound reaches the scan as a
    plain predicate.
    """
    newest = df.agg(F.max(ts)).scalar()
    return df.where(F.col(ts) >= newest - F.make_dt_interval(F.lit(days)))


def first_zones(df: DataFrame, n: int | None, zone: str = "zone_id") -> DataFrame:
    """The first ``n`` zone ids in text order (all when ``n`` is None)."""
    zones = df.select(F.col(zone).cast("string").alias("zone_id")).dropna().distinct().orderBy("zone_id")
    return zones if n is None else zones.limit(n)


def only_zones(df: DataFrame, zones: DataFrame, zone: str = "zone_id") -> DataFrame:
    return df.join(zones.select(F.col("zone_id").alias(zone)), zone, "left_semi")
