"""Dense time grids, weather on a grid, imputation and forecast features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from roomtide.functions.scalars import (
    after, bucket, dow_mon0, epoch_micros, hour_of, non_negative, seconds_of, weekend,
)
from roomtide.operators.canonical import normalize_occupancy, normalize_weather, occupancy_rows
from roomtide.operators.ordered import BLOCK, neighbours, percentiles, slot_lags

DEFAULT_LAGS = (1, 4, 96)


def expand_slots(spans: DataFrame, start: str, slots: str, step_micros) -> DataFrame:
    """One row per slot: ``slot`` from 0 to ``slots - 1`` and its ``timestamp``.

    Expansion goes block by block, so no row ever carries a whole zone's grid.
    The spans are few and small, which would leave their expansion to one task;
    the blocks are therefore spread over all shuffle partitions first.
    """
    last = F.col(slots) - 1
    blocks = spans.where(last >= 0).withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / BLOCK).cast("bigint")))
    )
    tasks = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.repartition(tasks, *spans.columns, "_b")
    first = F.col("_b") * BLOCK
    rows = blocks.withColumn("slot", F.explode(F.sequence(first, F.least(first + (BLOCK - 1), last)))).drop("_b")
    return rows.withColumn("timestamp", after(start, F.col("slot") * step_micros))


def align(series: DataFrame, keys: Sequence[str], value: str, step: int) -> DataFrame:
    """Floor a series to the step and take the mean per slot."""
    return series.groupBy(bucket("timestamp", step).alias("timestamp"), *keys).agg(F.avg(value).alias(value))


def zone_spans(
    occupancy: DataFrame, freq: str, align_mode: str = "floor", zone_id: str | None = None
) -> DataFrame:
    """Per zone: first grid point and number of grid points up to its last row.

    Works on the raw rows: the ends of a series do not depend on collapsing
    duplicates, so this pass shuffles one row per zone and task only.
    """
    step = seconds_of(freq)
    spans = occupancy_rows(occupancy, zone_id).groupBy("zone_id").agg(
        F.min("timestamp").alias("grid_start"), F.max("timestamp").alias("_end")
    )
    if align_mode == "floor":
        spans = spans.withColumn("grid_start", bucket("grid_start", step)).withColumn("_end", bucket("_end", step))
    distance = epoch_micros("_end") - epoch_micros("grid_start")
    slots = F.floor(distance / F.lit(step * 1_000_000)).cast("bigint") + 1
    return spans.select("zone_id", "grid_start", slots.alias("slots"))


def series_on_freq(occupancy: DataFrame, freq: str, mode: str, zone_id: str | None = None) -> DataFrame:
    series = normalize_occupancy(occupancy, zone_id)
    if mode == "floor":
        return align(series, ["zone_id"], "occupancy_count", seconds_of(freq))
    if mode == "exact":
        return series
    raise ValueError(f"align must be 'floor' or 'exact', not {mode!r}")


def dense_grid(
    occupancy: DataFrame, freq: str = "15min", align_mode: str = "floor", zone_id: str | None = None
) -> DataFrame:
    """Regular grid per zone from its first to its last row; holes count 0.

    ``align_mode="floor"`` moves rows to the slot they fall in; ``"exact"``
    anchors the grid at the zone's first row and keeps only rows that hit a
    grid point. ``slot`` numbers the grid points, ``slots`` is their count.
    """
    series = series_on_freq(occupancy, freq, align_mode, zone_id)
    spans = zone_spans(occupancy, freq, align_mode, zone_id)
    grid = expand_slots(spans, "grid_start", "slots", F.lit(seconds_of(freq) * 1_000_000))
    return grid.drop("grid_start").join(series, ["zone_id", "timestamp"], "left").select(
        "zone_id", "timestamp", "slot", "slots", non_negative("occupancy_count").alias("occupancy_count")
    )


def weather_slots(weather: DataFrame, freq: str) -> tuple[DataFrame, tuple[int, int] | None]:
    """Mean temperature per grid slot (``slot`` counts steps since 1970), and the first and last slot with a reading."""
    step = seconds_of(freq)
    series = align(normalize_weather(weather), [], "outside_temp", step)
    series = series.select(F.floor(epoch_micros("timestamp") / F.lit(step * 1_000_000)).cast("bigint").alias("slot"), "outside_temp")
    ends = series.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")).first()
    return series, None if ends["lo"] is None else (ends["lo"], ends["hi"])


def weather_lines(series: DataFrame, ends: tuple[int, int] | None, step: int) -> DataFrame:
    """``slot, outside_temp`` for every slot between the ends.

    Each known temperature meets the next one (30-day chunks; what crosses a
    border comes from one row per chunk), and the slots between the two are
    expanded from the pair, so no empty grid is built and joined.
    """
    first, last = (F.lit(end).cast("bigint") for end in ends or (None, None))
    known = series.where(F.col("outside_temp").isNotNull())
    around = neighbours(known, [], "slot", F.struct("slot", "outside_temp"), bucket_of_slots(step), inclusive=False)
    later, here = F.col("_next").getField("slot"), F.col("slot")
    begin = F.when(F.col("_prev").isNull(), first).otherwise(here)
    spans = around.withColumn("_at", F.explode(F.sequence(begin, F.coalesce(later - 1, last))))
    slope = F.try_divide(F.col("_at") - here, later - here)
    rise = F.col("_next").getField("outside_temp") - F.col("outside_temp")
    linear = F.when((F.col("_at") > here) & later.isNotNull(), F.col("outside_temp") + rise * slope)
    return spans.select(F.col("_at").alias("slot"), F.coalesce(linear, "outside_temp").alias("outside_temp"))


def weather_grid(weather: DataFrame, freq: str = "15min") -> DataFrame:
    """Outside temperature on the grid: linear in time, flat beyond the first and last known one.

    The grid reaches from the first to the last reading, which are looked up
    first. It is empty where no temperature is known.
    """
    series, ends = weather_slots(weather, freq)
    step = seconds_of(freq)
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return weather_lines(series, ends, step).select(
        after(epoch, F.col("slot") * F.lit(step * 1_000_000)).alias("timestamp"), "outside_temp"
    )


def bucket_of_slots(step: int, days: int = 30):
    """Chunk number of a slot: one chunk per ``days`` days of grid."""
    per_chunk = max(days * 86400 // step, 1)
    return F.floor(F.col("slot") / F.lit(per_chunk)).cast("bigint")


def with_weather(df: DataFrame, weather: DataFrame | None, freq: str = "15min") -> DataFrame:
    """Attach interpolated temperature; moments outside the weather series get its nearest end.

    Rows without a time are kept and have no temperature. The ends of the
    series are looked up first and limit the slots as literals.
    """
    if weather is None:
        return df.withColumn("outside_temp", F.lit(None).cast("double"))
    step = seconds_of(freq)
    series, ends = weather_slots(weather, freq)
    slot = F.floor(epoch_micros("timestamp") / F.lit(step * 1_000_000)).cast("bigint")
    first, last = (F.lit(end).cast("bigint") for end in ends or (None, None))
    keyed = df.withColumn("_at", F.when(slot.isNotNull(), F.least(F.greatest(slot, first), last)))
    lines = weather_lines(series, ends, step).withColumnRenamed("slot", "_at")
    return keyed.join(lines, "_at", "left").drop("_at")


def impute_median(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Replace nulls by the exact median (per key when keys are given)."""
    median = percentiles(df, list(keys), column, {"_median": 0.5})
    if keys:
        filled = df.join(median, list(keys), "left")
        return filled.withColumn(column, F.coalesce(column, "_median")).drop("_median")
    return df.withColumn(column, F.coalesce(F.col(column), median.select("_median").scalar()))


def calendar(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumns({"hour": hour_of(ts), "day_of_week": dow_mon0(ts), "is_weekend": weekend(ts)})


def forecast_features(
    occupancy: DataFrame,
    weather: DataFrame | None = None,
    zone_id: str | None = None,
    freq: str = "15min",
    lags: Sequence[int] = DEFAULT_LAGS,
    drop_warmup: bool = True,
    align_mode: str = "floor",
) -> DataFrame:
    """Feature frame of all zones: grid, temperature, calendar and lags.

    Rows whose longest lag reaches before the zone's start are dropped by slot
    number when ``drop_warmup`` is set.
    """
    grid = dense_grid(occupancy, freq, align_mode, zone_id)
    lagged = slot_lags(grid, ["zone_id"], "slot", "occupancy_count", lags, "occupancy_lag_")
    if drop_warmup and lags:
        lagged = lagged.where(F.col("slot") >= max(lags))
    features = calendar(with_weather(lagged, weather, freq)).withColumn("is_occupied", F.col("occupancy_count") > 0)
    return features.select(
        "timestamp", "zone_id", "occupancy_count", "outside_temp", "is_occupied",
        "hour", "day_of_week", "is_weekend", *[f"occupancy_lag_{k}" for k in lags],
    )
