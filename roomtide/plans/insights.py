"""One-row narratives derived from the dashboard results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roomtide.functions.scalars import show_hour, show_number, to_number, weekday_label


def occupancy_insights(heatmap: DataFrame, space_stats: DataFrame, low_count: int = 3) -> DataFrame:
    """Busiest weekday and hour, busiest space, least used spaces.

    The weekday is the one with the highest plain mean of its (rounded) cells.
    Ties go to the earlier weekday or hour and to the smaller label.
    """
    cells = heatmap.withColumn("avg_occ", to_number("avg_occ")).where(F.col("avg_occ").isNotNull())
    days = cells.groupBy("day_of_week").agg(F.avg("avg_occ").alias("a"))
    best_day = days.agg(F.min(F.struct((-F.col("a")).alias("a"), "day_of_week"))).scalar()
    spaces = space_stats.withColumn("avg_occ", to_number("avg_occ")).where(F.col("avg_occ").isNotNull())
    best_space = spaces.agg(F.min(F.struct((-F.col("avg_occ")).alias("a"), F.col("space_label").cast("string").alias("l")))).scalar()
    low = spaces.select("avg_occ", F.col("space_label").cast("string").alias("l"))
    low = low.orderBy("avg_occ", "l").limit(low_count)
    low_list = low.agg(F.array_sort(F.collect_list(F.struct("avg_occ", "l"))).getField("l")).scalar()
    cell = cells.agg(
        F.min(F.struct((-F.col("avg_occ")).alias("a"), "day_of_week", "hour_of_day")).alias("c")
    )
    return cell.select(
        weekday_label(best_day.getField("day_of_week")).alias("busiest_day"),
        show_hour(F.col("c.hour_of_day")).alias("busiest_hour"),
        show_number(-F.col("c.a")).alias("busiest_hour_avg_occ"),
        F.coalesce(best_space.getField("l"), F.lit("N/A")).alias("highest_util_space"),
        show_number(-best_space.getField("a")).alias("highest_util_avg_occ"),
        F.coalesce(low_list, F.array().cast("array<string>")).alias("low_util_spaces"),
    )


def hvac_insights(zone_stats: DataFrame, comfort_summary: DataFrame) -> DataFrame:
    """Most variable, hottest and coldest zone, and the share of time outside the band."""
    zones = zone_stats.select(
        F.col("space_id").cast("string").alias("z"),
        to_number("std_temp").alias("std"),
        to_number("avg_temp").alias("avg"),
        to_number("comfort_exceedance_pct").alias("out"),
    )
    overall = comfort_summary.agg(F.first(to_number("out_of_band_pct"))).scalar()

    def extreme(value, known):
        return F.coalesce(
            F.min(F.when(known.isNotNull(), F.struct(value.alias("k"), "z"))),
            F.min(F.when(known.isNull(), F.struct(value.alias("k"), "z"))),
        )

    std, avg = F.col("std"), F.col("avg")
    one = zones.agg(
        extreme(-std, std).alias("v"), extreme(-avg, avg).alias("h"), extreme(avg, avg).alias("c"),
        F.avg("out").alias("mean_out"), F.count(F.lit(1)).alias("n"),
    )
    return one.select(
        F.coalesce("v.z", F.lit("N/A")).alias("high_variability_zone"),
        show_number(-F.col("v.k")).alias("high_variability_std_temp"),
        F.coalesce("h.z", F.lit("N/A")).alias("hottest_zone"),
        show_number(-F.col("h.k")).alias("hottest_zone_avg_temp"),
        F.coalesce("c.z", F.lit("N/A")).alias("coldest_zone"),
        show_number(F.col("c.k")).alias("coldest_zone_avg_temp"),
        show_number(F.when(F.col("n") > 0, F.coalesce(overall, F.col("mean_out")))).alias("overall_out_of_band_pct"),
    )
