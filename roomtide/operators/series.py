"""Features and reshaping of ordered rows: lags, hourly series, thinning, sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from roomtide.functions.scalars import bucket, epoch_micros, to_moment, to_number
from roomtide.operators.canonical import normalize_weather
from roomtide.operators.grid import DEFAULT_LAGS, bucket_of_slots, calendar, expand_slots
from roomtide.operators.ordered import neighbours, number_rows, percentiles, slot_lags, with_halo
from roomtide.operators.selection import quantiles
from roomtide.session import durable

HOUR = 3600


def engineer_features(
    df: DataFrame,
    with_calendar: bool = True,
    with_lags: bool = True,
    lags: Sequence[int] = DEFAULT_LAGS,
    keys: Sequence[str] = ("zone_id",),
    tie_breaker: Sequence[str] = (),
) -> DataFrame:
    """Calendar columns and lags by row position in time order, per zone."""
    ts = "timestamp" if "timestamp" in df.columns else "ds"
    target = "occupancy_count" if "occupancy_count" in df.columns else "y"
    out = df.withColumn(ts, to_moment(ts))
    if with_calendar:
        out = calendar(out, ts)
    if with_lags and lags and target in df.columns:
        keys = [k for k in keys if k in df.columns]
        out = number_rows(out, keys, [ts, *(tie_breaker or [target])], "_row")
        out = slot_lags(out, keys, "_row", target, lags, f"{target}_lag_").drop("_row", "_row_total")
    return out


def hourly_series(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Hourly sum over all sources; hours without rows count 0."""
    sums = (
        df.select(to_moment(ts).alias("_ts"), to_number(value).alias("_v")).where(F.col("_ts").isNotNull())
        .groupBy(bucket("_ts", HOUR).alias("timestamp"))
        .agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("occupancy"))
    )
    micros = F.lit(HOUR * 1_000_000)
    span = sums.agg(F.min("timestamp").alias("_start"), F.max("timestamp").alias("_end")).withColumn(
        "_slots", F.floor((epoch_micros("_end") - epoch_micros("_start")) / micros).cast("bigint") + 1
    )
    grid = expand_slots(span, "_start", "_slots", micros).select("timestamp", "slot", F.col("_slots").alias("slots"))
    return grid.join(sums, "timestamp", "left").withColumn("occupancy", F.coalesce("occupancy", F.lit(0.0)))


def hourly_features(series: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """Calendar, 1 h and 24 h lags and forward-filled temperature; rows with a hole are dropped."""
    rows = slot_lags(series, [], "slot", "occupancy", [1, 24], "occ_lag_")
    rows = rows.withColumnsRenamed({"occ_lag_1": "occ_lag_1h", "occ_lag_24": "occ_lag_24h"})
    temp: list[str] = []
    if weather is not None:
        rows = rows.join(normalize_weather(weather), "timestamp", "left")
        filled = neighbours(rows, [], "slot", F.col("outside_temp"), bucket_of_slots(HOUR))
        rows = filled.withColumn("outside_temp", F.col("_prev")).drop("_prev", "_next")
        temp = ["outside_temp"]
    rows = calendar(rows).select(
        "timestamp", "slot", "slots", "occupancy", *temp,
        "hour", "day_of_week", "is_weekend", "occ_lag_1h", "occ_lag_24h",
    )
    return rows.dropna()


def thin(df: DataFrame, order: Sequence[str], points: int) -> DataFrame:
    """Keep ``points`` evenly spaced rows (all of them when there are fewer).

    Wanted positions are those of an even spacing from the first to the last
    row, rounded half to even; arithmetic on a row's number tells
    whether it is one of them.
    """
    rows = number_rows(df, [], order, "_row")
    # position i lies at i * (n - 1) / (points - 1)
    step = F.try_divide((F.col("_row_total") - 1).cast("double"), F.lit(float(max(points - 1, 1))))
    position = (F.col("_row") - 1).cast("double")
    near = F.floor(F.try_divide(position, step)).cast("bigint")
    hit = F.lit(False)
    for shift in (-1, 0, 1, 2):
        i = near + shift
        hit = hit | ((i >= 0) & (i < points) & (F.rint(i.cast("double") * step) == position))
    keep = (F.col("_row_total") <= points) | F.coalesce(hit, F.lit(False))
    return rows.where(keep).drop("_row", "_row_total")


def sampling_gaps(df: DataFrame, ts: str) -> DataFrame:
    """``gap``: microseconds between successive rows in time order, equal moments included.

    Rows are cut into hours of the calendar. Gaps inside an hour and the first
    and last moment of each hour come from the same exchange; the gaps between
    hours follow from one row per hour.
    """
    moments = df.where(F.col(ts).isNotNull()).select(epoch_micros(ts).alias("_t"))
    cut = moments.withColumn("_chunk", F.floor(F.col("_t") / F.lit(HOUR * 1_000_000)).cast("bigint")).repartition("_chunk")
    inside = cut.select((F.col("_t") - F.lag("_t").over(Window.partitionBy("_chunk").orderBy("_t"))).alias("gap"))
    ends = cut.groupBy("_chunk").agg(F.min("_t").alias("_head"), F.max("_t").alias("_tail"))
    across = ends.select((F.col("_head") - F.lag("_tail").over(Window.orderBy("_chunk"))).alias("gap"))
    return inside.unionByName(across).where(F.col("gap").isNotNull())


def step_hours(df: DataFrame, ts: str, default: float = 0.25) -> DataFrame:
    """One row, ``step_hours``: median distance between successive rows."""
    median = percentiles(sampling_gaps(df, ts), [], "gap", {"median": 0.5})
    usable = F.col("median") > 0
    return median.select(F.when(usable, F.col("median") / 3600e6).otherwise(F.lit(default)).alias("step_hours"))


def sampling_step(df: DataFrame, ts: str, default: float = 0.25) -> float:
    """The step of ``step_hours`` as a value; the gaps are written once and searched."""
    (median,) = quantiles(durable(sampling_gaps(df, ts)), "gap", [0.5])
    return median / 3600e6 if median else default


def sequences(
    df: DataFrame, keys: Sequence[str], slot: str, value: str, history: int = 96, horizon: int = 96
) -> DataFrame:
    """Sliding pairs: the last ``history`` values and the next ``horizon`` values.

    Only rows with both sides complete are kept. Blocks overlap by the window
    lengths, so no zone is gathered in one task.
    """
    ordered = Window.partitionBy(*keys, "_block").orderBy(slot)
    rows = with_halo(df, slot, left=history - 1, right=horizon, block=4 * max(history, horizon))
    rows = rows.withColumn("inputs", F.collect_list(value).over(ordered.rowsBetween(-(history - 1), 0)))
    rows = rows.withColumn("targets", F.collect_list(value).over(ordered.rowsBetween(1, horizon)))
    full = F.col("_own") & (F.size("inputs") == history) & (F.size("targets") == horizon)
    return rows.where(full).drop("_own", "_block")
