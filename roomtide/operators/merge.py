"""Joining occupancy with equipment, weather and tariff; the opportunity flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from roomtide.functions.scalars import bucket, hour_of, seconds_of, to_moment, to_number
from roomtide.operators.canonical import (
    EQUIPMENT_TIME, EQUIPMENT_ZONE, normalize_occupancy, normalize_weather, resolve,
)
from roomtide.operators.grid import align
from roomtide.operators.ordered import match, neighbours


def with_hvac_on(df: DataFrame) -> DataFrame:
    """Keep ``hvac_on``; else derive it from ``hvac_mode`` (null mode counts as on); else true."""
    if "hvac_on" in df.columns:
        return df
    if "hvac_mode" in df.columns:
        return df.withColumn("hvac_on", F.coalesce(F.lower("hvac_mode") != "off", F.lit(True)))
    return df.withColumn("hvac_on", F.lit(True))


def equipment_buckets(equipment: DataFrame, freq: str = "15min") -> DataFrame:
    """One row per (bucket, zone): the first non-null reading of every column.

    "First" is by raw timestamp, then by a hash of the payload, so it does not
    depend on the order in which files are read.
    """
    ts = resolve(equipment, EQUIPMENT_TIME, "equipment timestamp")
    zone = resolve(equipment, EQUIPMENT_ZONE, "equipment zone")
    rows = equipment.withColumns({ts: to_moment(ts), zone: F.col(zone).cast("string")}).dropna(subset=[ts, zone])
    rows = with_hvac_on(rows.withColumnsRenamed({ts: "timestamp", zone: "zone_id"}))
    payload = [c for c in rows.columns if c not in ("timestamp", "zone_id")]
    # one hash of the payload settles ties, so the state per column does not grow with the number of columns
    rows = rows.withColumn("_order", F.struct("timestamp", F.xxhash64(*payload) if payload else F.lit(0)))
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c) for c in payload]
    return rows.groupBy(bucket("timestamp", seconds_of(freq)).alias("timestamp"), "zone_id").agg(*first)


def merge_occupancy_equipment(
    occupancy: DataFrame, equipment: DataFrame, freq: str = "15min", how: str = "inner"
) -> DataFrame:
    """Join both sides on (bucket, zone).

    Each side is aggregated to one row per key first, so the join is 1:1 and
    no key can be hot; the aggregations' partitioning serves the join as well.
    """
    people = align(normalize_occupancy(occupancy), ["zone_id"], "occupancy_count", seconds_of(freq))
    return people.join(equipment_buckets(equipment, freq), ["timestamp", "zone_id"], how)


def add_weather(df: DataFrame, weather: DataFrame) -> DataFrame:
    """Left join on the exact timestamp."""
    base = df.withColumn("timestamp", to_moment("timestamp"))
    return base.join(normalize_weather(weather), "timestamp", "left")


def tariff_by_hour(tariff: DataFrame, priority: str = "tou_id") -> DataFrame:
    """``hour, tou_rate`` with at most 24 rows.

    ``[start_hour, end_hour)``; a window with start after end wraps past
    midnight, one with equal ends matches nothing; where windows overlap, the
    row with the highest ``priority`` wins.
    """
    missing = {"start_hour", "end_hour", "rate_kwh"} - set(tariff.columns)
    if missing:
        raise ValueError(f"tariff lacks columns: {', '.join(sorted(missing))}")
    hours = tariff.select(
        F.col("start_hour").cast("int").alias("s"),
        F.col("end_hour").cast("int").alias("e"),
        F.col("rate_kwh").cast("double").alias("rate"),
        F.col(priority).alias("p"),
        F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"),
    )
    h, s, e = F.col("hour"), F.col("s"), F.col("e")
    within = F.when(s <= e, (h >= s) & (h < e)).otherwise((h >= s) | (h < e))
    return hours.where(within).groupBy("hour").agg(F.max_by("rate", "p").alias("tou_rate"))


def add_tariff(df: DataFrame, tariff: DataFrame, priority: str = "tou_id", zone: str | None = "zone_id") -> DataFrame:
    """Rate of the row's hour; hours without a tariff take the last known rate.

    A rate depends on the hour only, so rows look it up in the 24-hour table,
    which is safe to broadcast, and are not shuffled; where all hours have a
    rate, that is all. Otherwise rows without a rate are filled in time order
    within each zone (over the whole frame without one): they meet one marker
    per calendar hour in which the zone has rows with a rate. Rows without a
    time come last in that order; a null zone is a zone like others. Every row
    is kept.
    """
    if "timestamp" not in df.columns:
        raise ValueError("add_tariff needs a timestamp column")
    keys = [zone] if zone and zone in df.columns else []
    rates = tariff_by_hour(tariff, priority)
    base = df.withColumn("timestamp", to_moment("timestamp")).withColumn("hour", hour_of("timestamp"))
    looked = base.join(F.broadcast(rates), "hour", "left").select(*base.columns, "tou_rate")
    covered = [row["hour"] for row in rates.where(F.col("tou_rate").isNotNull()).collect()]  # 24 at most
    if not covered:
        return looked
    no_rate = F.col("hour").isNull() | ~F.col("hour").isin(covered)
    # without a time a row stands after all others; hours of the calendar are the order
    late = F.lit("9999-12-31").cast("timestamp_ntz")
    payload = {f"_c{i}": F.when(no_rate, F.col(f"`{c}`")) for i, c in enumerate(base.columns)}
    placed = looked.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(bucket("timestamp", 3600), late).alias("_at"), "tou_rate",
        F.when(no_rate, F.monotonically_increasing_id()).alias("_row"), *[c.alias(name) for name, c in payload.items()],
    )
    # rows with a rate have no payload here and shrink to one marker per hour on the map side
    zones = [f"_k{i}" for i, _ in enumerate(keys)]
    few = placed.groupBy(*zones, "_at", "_row", *payload).agg(F.max("tou_rate").alias("tou_rate"))
    month = F.trunc(F.to_date("_at"), "month")
    filled = neighbours(few, zones, "_at", F.col("tou_rate"), month).where(F.col("_row").isNotNull())
    filled = filled.select(
        *[F.col(name).alias(c) for name, c in zip(payload, base.columns)], F.coalesce("_prev", "_next").alias("tou_rate")
    )
    return looked.where(~no_rate).unionByName(filled)


def flag_opportunity(
    df: DataFrame,
    occupancy: str = "occupancy_count",
    state: str = "hvac_on",
    energy: str | None = "energy_kwh",
    null_state: bool = True,
) -> DataFrame:
    """Nobody there while the equipment runs, and the energy used meanwhile.

    Unknown occupancy counts as zero; an unknown state counts as ``null_state``.
    """
    for name in (occupancy, state):
        if name not in df.columns:
            raise ValueError(f"missing column: {name}")
    if isinstance(df.schema[state].dataType, StringType):
        running = F.coalesce(F.lower(F.trim(state)) != "off", F.lit(null_state))  # any text but "off" counts as on
    else:
        running = F.coalesce(F.col(state).cast("boolean"), F.lit(null_state))
    people = F.coalesce(to_number(occupancy), F.lit(0.0))
    out = df.withColumn(occupancy, people).withColumn("is_opportunity", (F.col(occupancy) <= 0) & running)
    if energy and energy in df.columns:
        used = F.coalesce(to_number(energy), F.lit(0.0))
        out = out.withColumn("potential_energy_savings", F.when(F.col("is_opportunity"), used).otherwise(F.lit(0.0)))
    return out
