"""How much energy runs into empty rooms, and what to do about it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from roomtide.functions.scalars import day_of, dow_mon0, epoch_micros, hour_of, seconds_of, tally
from roomtide.operators.canonical import between, day_window
from roomtide.operators.merge import flag_opportunity
from roomtide.operators.ordered import with_halo


def savings_potential(
    merged: DataFrame, interval: str = "15min", rate: str | None = None,
    occupancy: str = "occupancy_count", state: str = "hvac_on", energy: str = "energy_kwh",
) -> DataFrame:
    """Opportunity hours, energy and cost in total, by hour and by weekday (one pass)."""
    flagged = flag_opportunity(merged, occupancy, state, energy)
    price = F.col(rate) if rate else F.lit(None).cast("double")
    rows = flagged.select(
        hour_of("timestamp").alias("hour"), dow_mon0("timestamp").alias("day_of_week"),
        "is_opportunity", F.col("potential_energy_savings").alias("e"), F.col(energy).try_cast("double").alias("used"),
        (F.col("potential_energy_savings") * price).alias("cost"),
    )
    hours = seconds_of(interval) / 3600.0
    grouped = rows.groupingSets([[], ["hour"], ["day_of_week"]], "hour", "day_of_week").agg(
        F.grouping_id().alias("g"),
        (F.count_if("is_opportunity") * F.lit(hours)).alias("opportunity_hours"),
        F.sum("e").alias("opportunity_energy_kwh"),
        F.sum("cost").alias("opportunity_cost"),
        F.sum("used").alias("used"),
    )
    # 32 rows at most; the one of the empty grouping set has the energy of all rows
    total = F.max(F.when(F.col("g") == 3, F.col("used"))).over(Window.partitionBy())
    breakdown = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "hour").otherwise("weekday")
    return grouped.withColumn("_total", total).select(
        breakdown.alias("breakdown"), "hour", "day_of_week", "opportunity_hours", "opportunity_energy_kwh",
        "opportunity_cost",
        F.coalesce(F.lit(100.0) * F.try_divide("opportunity_energy_kwh", "_total"), F.lit(0.0)).alias("percent_of_total"),
    )


def daily_opportunity(flagged: DataFrame, energy: str = "energy_kwh") -> DataFrame:
    """Per day: energy while nobody is there, total energy, and the running sum of the former.

    The running sum runs over the daily table, which has one row per calendar day.
    """
    daily = flagged.groupBy(day_of("timestamp").alias("date")).agg(
        F.sum("potential_energy_savings").alias("opportunity_energy_kwh"),
        F.sum(F.col(energy).try_cast("double")).alias("total_energy_kwh"),
    )
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("cumulative_opportunity_kwh", F.sum("opportunity_energy_kwh").over(so_far)).orderBy("date")


def day_timeline(flagged: DataFrame, day, zone_id: str | None = None) -> DataFrame:
    """One day's rows, optionally of one zone, in time order."""
    start, end = day_window(day, day, half_open=True)
    rows = flagged.where(between("timestamp", start, end, end_open=True))
    if zone_id is not None:
        rows = rows.where(F.col("zone_id") == str(zone_id))
    return rows.orderBy("timestamp", "zone_id")


def sustained_opportunity(flagged: DataFrame, freq: str = "15min", minimum: str = "30min") -> DataFrame:
    """Minutes and energy per zone and day that belong to opportunity runs of at least ``minimum``.

    ``flagged`` has one row per (bucket, zone). A run is a chain of flagged
    buckets without a hole. A bucket belongs to a long enough run exactly when
    the run's part within ``minimum`` around it is long enough, so overlapping
    blocks decide it without gathering a zone.
    """
    step = seconds_of(freq)
    need = max(-(-seconds_of(minimum) // step), 1)
    on = flagged.where("is_opportunity").withColumn(
        "slot", F.floor(epoch_micros("timestamp") / F.lit(step * 1_000_000)).cast("bigint")
    )
    rows = with_halo(on, "slot", left=need - 1, right=need - 1)
    ordered = Window.partitionBy("zone_id", "_block").orderBy("slot")
    rows = rows.withColumn("_island", F.col("slot") - F.row_number().over(ordered))
    length = F.count(F.lit(1)).over(Window.partitionBy("zone_id", "_block", "_island"))
    kept = rows.withColumn("_length", length).where(F.col("_own") & (F.col("_length") >= need))
    return kept.groupBy("zone_id", day_of("timestamp").alias("date")).agg(
        (F.count(F.lit(1)) * F.lit(step / 60.0)).alias("opportunity_minutes"),
        F.sum("potential_energy_savings").alias("opportunity_energy_kwh"),
    )


@dataclass(frozen=True)
class Comfort:
    """Setback limits, minutes of pre-conditioning, and the count that still is unoccupied."""

    min_temp: float = 60.0
    max_temp: float = 85.0
    pre_condition_minutes: int = 30
    occupancy_threshold: float = 0.0
    reduction: float = 0.30


def setpoint_plan(
    forecast: DataFrame, baseline: DataFrame, rates: DataFrame | None = None,
    comfort: Comfort = Comfort(), freq: str = "15min",
) -> DataFrame:
    """Setpoint and savings per (moment, zone).

    ``forecast``: ``timestamp, zone_id, predicted_occupancy``; ``baseline``:
    ``timestamp, zone_id, baseline_setpoint, baseline_energy``; ``rates``:
    ``hour, tou_rate``. A zone is set back while it is predicted empty and
    stays empty through the pre-conditioning time. Setback relaxes the setpoint
    towards the limit of its season: setpoints above the middle of the allowed
    range are cooling setpoints.
    """
    step = seconds_of(freq)
    ahead = -(-comfort.pre_condition_minutes * 60 // step)
    rows = forecast.withColumn(
        "slot", F.floor(epoch_micros("timestamp") / F.lit(step * 1_000_000)).cast("bigint")
    )
    rows = with_halo(rows, "slot", left=0, right=ahead)
    soon = Window.partitionBy("zone_id", "_block").orderBy("slot").rangeBetween(0, ahead)
    rows = rows.withColumn("_peak", F.max(F.coalesce("predicted_occupancy", F.lit(0.0))).over(soon)).where("_own")
    plan = rows.select("timestamp", "zone_id", "predicted_occupancy", "_peak").join(
        baseline.select("timestamp", "zone_id", "baseline_setpoint", "baseline_energy"), ["timestamp", "zone_id"]
    )
    empty = F.coalesce("predicted_occupancy", F.lit(0.0)) <= comfort.occupancy_threshold
    setback = F.col("_peak") <= comfort.occupancy_threshold
    middle = (comfort.min_temp + comfort.max_temp) / 2
    relaxed = F.when(F.col("baseline_setpoint") >= middle, F.lit(comfort.max_temp)).otherwise(F.lit(comfort.min_temp))
    saved = F.when(setback, F.col("baseline_energy") * comfort.reduction).otherwise(F.lit(0.0))
    plan = plan.withColumns({
        "is_unoccupied": empty,
        "pre_conditioning": empty & ~setback,
        "recommended_setpoint": F.when(setback, relaxed).otherwise(F.col("baseline_setpoint")),
        "energy_savings_kwh": F.coalesce(saved, F.lit(0.0)),
    }).drop("_peak")
    if rates is None:
        return plan.withColumn("cost_savings", F.lit(None).cast("double"))
    priced = plan.withColumn("hour", hour_of("timestamp")).join(F.broadcast(rates), "hour", "left").drop("hour")
    return priced.withColumn("cost_savings", F.col("energy_savings_kwh") * F.col("tou_rate")).drop("tou_rate")


def plan_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count(F.lit(1)).cast("bigint").alias("steps"),
        tally(F.col("is_unoccupied")).alias("unoccupied_steps"),
        tally(F.col("is_unoccupied") & ~F.col("pre_conditioning")).alias("setback_steps"),
        F.sum("energy_savings_kwh").alias("total_energy_savings_kwh"),
        F.sum("cost_savings").alias("total_cost_savings"),
        F.sum("baseline_energy").alias("total_baseline_energy_kwh"),
    )
