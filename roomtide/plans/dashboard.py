"""Dashboard aggregates over occupancy and zone temperature.

Inputs: occupancy ``space_id, occupancy, beginning``; temperature ``timestamp,
space_id, zone_temp``; spaces ``space_id, space_name, building_room``. Every
function takes an optional inclusive time range, which Catalyst pushes into
the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from roomtide.functions.scalars import (
    WEEKDAY_LABELS, day_of, dow_sun0, hour_of, round_to, share, weekday_label,
)
from roomtide.operators.canonical import between
from roomtide.operators.ordered import percentiles, summary
from roomtide.operators.selection import quantiles


def _rows() -> Column:
    return F.count(F.lit(1)).cast("bigint")


def _outside(low: float, high: float) -> Column:
    temp = F.col("zone_temp")
    return (temp < F.lit(float(low))) | (temp > F.lit(float(high)))


def _percent(flag: Column) -> Column:
    return round_to(F.lit(100.0) * share(flag))


# --- occupancy --------------------------------------------------------------

def occupancy_kpis(occupancy: DataFrame, start=None, end=None) -> DataFrame:
    rows = occupancy.where(between("beginning", start, end))
    median = percentiles(rows, [], "occupancy", {"m": 0.5}, few_values=True).select("m").scalar()
    return rows.agg(
        _rows().alias("rows"),
        F.count_distinct("space_id").cast("int").alias("spaces"),
        F.min("beginning").alias("min_ts"),
        F.max("beginning").alias("max_ts"),
        round_to(F.avg("occupancy")).alias("avg_occ"),
        F.max("occupancy").alias("peak_occ"),
    ).withColumn("median_occ", round_to(median))


def occupancy_daily(occupancy: DataFrame, start=None, end=None) -> DataFrame:
    rows = occupancy.where(between("beginning", start, end))
    return (
        rows.groupBy(day_of("beginning").alias("day"))
        .agg(
            round_to(F.avg("occupancy")).alias("avg_occ"),
            F.max("occupancy").alias("peak_occ"),
            _rows().alias("samples"),
        )
        .orderBy("day")
    )


def occupancy_heatmap(occupancy: DataFrame, start=None, end=None) -> DataFrame:
    rows = occupancy.where(between("beginning", start, end))
    return (
        rows.groupBy(dow_sun0("beginning").alias("day_of_week"), hour_of("beginning").alias("hour_of_day"))
        .agg(round_to(F.avg("occupancy")).alias("avg_occ"), _rows().alias("samples"))
        .orderBy("day_of_week", "hour_of_day")
    )


def occupancy_space_stats(occupancy: DataFrame, spaces: DataFrame, start=None, end=None) -> DataFrame:
    """Per-space statistics with a label.

    Aggregates before the join: the dimension (unique by ``space_id``) then
    meets one row per space, however many rows a busy space has.
    """
    rows = occupancy.where(between("beginning", start, end))
    per_space = rows.groupBy("space_id").agg(
        round_to(F.avg("occupancy")).alias("avg_occ"), F.max("occupancy").alias("peak_occ"), _rows().alias("samples")
    )
    label = F.coalesce("building_room", "space_name", F.lit("(unknown)"))
    labels = spaces.select("space_id", label.alias("space_label"))
    return (
        per_space.join(labels, "space_id", "left")
        .select(
            F.col("space_id").cast("string").alias("space_id"),
            F.coalesce("space_label", F.lit("(unknown)")).alias("space_label"),
            "avg_occ", "peak_occ", "samples",
        )
        .orderBy(F.desc_nulls_first("avg_occ"), F.desc("samples"), "space_id")
    )


def heatmap_by(occupancy: DataFrame, how: str = "mean", space_id=None, start=None, end=None) -> DataFrame:
    """Hour by weekday heatmap with mean, median or max."""
    rows = occupancy.where(between("beginning", start, end))
    if space_id is not None:
        rows = rows.where(F.col("space_id") == space_id)
    rows = rows.select(
        dow_sun0("beginning").alias("day_of_week"), hour_of("beginning").alias("hour_of_day"), "occupancy"
    )
    keys = ["day_of_week", "hour_of_day"]
    if how == "median":
        cells = percentiles(rows, keys, "occupancy", {"occ": 0.5}, few_values=True)
    elif how in ("mean", "max"):
        cells = rows.groupBy(*keys).agg((F.avg if how == "mean" else F.max)("occupancy").cast("double").alias("occ"))
    else:
        raise ValueError(f"how must be mean, median or max, not {how!r}")
    return cells.select(*keys, round_to("occ").alias("occ")).orderBy(*keys)


def occupancy_timeline(occupancy: DataFrame, ts: str = "beginning", count: str = "occupancy") -> DataFrame:
    """Sum over all zones per moment, in time order."""
    return occupancy.groupBy(F.col(ts).alias("timestamp")).agg(
        F.sum(count).cast("double").alias("total_occupancy")
    ).orderBy("timestamp")


# --- temperature ------------------------------------------------------------

def hvac_kpis(hvac: DataFrame, start=None, end=None) -> DataFrame:
    """Counts, extent, mean, median and 95th percentile; the percentiles are found first, by narrowing."""
    rows = hvac.where(between("timestamp", start, end))
    median, p95 = quantiles(rows, "zone_temp", [0.5, 0.95])
    return rows.agg(
        _rows().alias("rows"),
        F.count_distinct("space_id").cast("int").alias("zones"),
        F.min("timestamp").alias("min_ts"),
        F.max("timestamp").alias("max_ts"),
        round_to(F.avg("zone_temp")).alias("avg_temp"),
    ).withColumns({
        "median_temp": round_to(F.lit(median).cast("double")), "p95_temp": round_to(F.lit(p95).cast("double")),
    })


def _temp_by(rows: DataFrame, key: str, name: str, p: float) -> DataFrame:
    found = summary(rows, [key], "zone_temp", {name: p}).orderBy(key)
    return found.select(key, round_to("mean").alias("avg_temp"), round_to(name).alias(name), F.col("rows").alias("samples"))


def hvac_daily(hvac: DataFrame, start=None, end=None) -> DataFrame:
    rows = hvac.where(between("timestamp", start, end))
    return _temp_by(rows.select(day_of("timestamp").alias("day"), "zone_temp"), "day", "p95_temp", 0.95)


def hvac_hourly(hvac: DataFrame, start=None, end=None) -> DataFrame:
    rows = hvac.where(between("timestamp", start, end))
    return _temp_by(
        rows.select(hour_of("timestamp").alias("hour_of_day"), "zone_temp"), "hour_of_day", "p90_temp", 0.9
    )


def hvac_zone_stats(
    hvac: DataFrame, comfort_low: float = 70.0, comfort_high: float = 76.0, start=None, end=None
) -> DataFrame:
    rows = hvac.where(between("timestamp", start, end))
    return (
        rows.groupBy("space_id")
        .agg(
            round_to(F.avg("zone_temp")).alias("avg_temp"),
            round_to(F.stddev_pop("zone_temp")).alias("std_temp"),
            round_to(F.min("zone_temp")).alias("min_temp"),
            round_to(F.max("zone_temp")).alias("max_temp"),
            _percent(_outside(comfort_low, comfort_high)).alias("comfort_exceedance_pct"),
            _rows().alias("samples"),
        )
        .orderBy(F.desc_nulls_first("avg_temp"), F.desc("samples"), "space_id")
    )


def hvac_comfort_summary(
    hvac: DataFrame, comfort_low: float = 70.0, comfort_high: float = 76.0, start=None, end=None
) -> DataFrame:
    rows = hvac.where(between("timestamp", start, end))
    temp = F.col("zone_temp")
    return rows.agg(
        _percent(temp < F.lit(float(comfort_low))).alias("below_band_pct"),
        _percent(temp > F.lit(float(comfort_high))).alias("above_band_pct"),
        _percent(_outside(comfort_low, comfort_high)).alias("out_of_band_pct"),
    )


# --- rankings and reshaping of the small results ----------------------------

def top_spaces(space_stats: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` busiest spaces, shown from the least busy of them upwards."""
    top = space_stats.orderBy(F.desc_nulls_last("avg_occ"), F.desc("samples"), "space_id").limit(n)
    return top.orderBy("avg_occ", "space_id")


def top_zones(zone_stats: DataFrame, n: int = 10) -> DataFrame:
    """Hottest, coldest and most variable zones, ``n`` of each."""
    orders = {
        "hottest": F.desc_nulls_last("avg_temp"),
        "coldest": F.asc_nulls_last("avg_temp"),
        "most_variable": F.desc_nulls_last("std_temp"),
    }
    out = None
    for name, order in orders.items():
        part = zone_stats.orderBy(order, "space_id").limit(n)
        part = part.select(F.lit(name).alias("ranking"), "space_id", "avg_temp", "std_temp")
        out = part if out is None else out.unionByName(part)
    return out


def heatmap_pivot(heatmap: DataFrame) -> DataFrame:
    """Weekday rows, hour columns ``h00``..``h23``; all seven weekdays are present."""
    spark = heatmap.sparkSession
    wide = heatmap.groupBy("day_of_week").pivot("hour_of_day", list(range(24))).agg(F.first("avg_occ"))
    wide = wide.withColumnsRenamed({str(h): f"h{h:02d}" for h in range(24)})
    week = spark.range(len(WEEKDAY_LABELS)).select(F.col("id").cast("int").alias("day_of_week"))
    return week.join(wide, "day_of_week", "left").select(
        weekday_label("day_of_week").alias("day_name"), *[f"h{h:02d}" for h in range(24)]
    )


def daily_long(daily: DataFrame, metrics: list[str]) -> DataFrame:
    """Long form for charts: one row per day and metric."""
    return daily.select("day", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        "day", metrics, "metric", "value"
    )
