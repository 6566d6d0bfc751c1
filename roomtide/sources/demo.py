"""Telemetry-shaped views over the star-schema test tables.

``events`` plays occupancy, zone temperature, equipment and the text export;
``nation`` plays the space dimension; the hourly mean of one event type plays
a weather station whose series has holes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roomtide.functions.scalars import bucket
from roomtide.sources.tables import open_parquet

TARIFF_ROWS = [(0, 22, 6, 0.12), (1, 6, 14, 0.20), (2, 15, 20, 0.32), (3, 16, 18, 0.40)]


class Demo:
    """The views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._open: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = open_parquet(self.spark, self.folder, name)
        return self._open[name]

    @property
    def events(self) -> DataFrame:
        return self.table("events")

    @property
    def occ(self) -> DataFrame:
        return self.events.select(
            F.col("ts").alias("timestamp"), F.col("event_type").alias("zone_id"),
            F.floor(F.col("value") / 10).cast("double").alias("occupancy_count"),
        )

    @property
    def space_occ(self) -> DataFrame:
        return self.events.select(
            (F.col("user_id") % 30).cast("int").alias("space_id"),
            F.floor(F.col("value") / 10).cast("int").alias("occupancy"),
            F.col("ts").alias("beginning"),
        )

    @property
    def space(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").alias("space_id"), F.col("n_name").alias("space_name"),
            F.col("n_regionkey").alias("parent_space_id"), F.lit(None).cast("string").alias("building_room"),
        )

    @property
    def hvac(self) -> DataFrame:
        return self.events.select(
            F.col("ts").alias("timestamp"), F.col("event_type").alias("space_id"),
            (F.lit(60) + F.col("value") / 5).alias("zone_temp"),
        )

    @property
    def hvac_state(self) -> DataFrame:
        third = F.col("user_id") % 3
        return self.events.select(
            F.col("ts").alias("timestamp"), F.col("event_type").alias("space_id"),
            (F.lit(60) + F.col("value") / 5).alias("zone_temp"),
            F.when(third == 0, "Off").when(third == 1, "Cool").otherwise("Heat").alias("hvac_mode"),
            (F.col("value") / 10).alias("energy_kwh"),
        )

    @property
    def weather(self) -> DataFrame:
        station = self.events.where(F.col("event_type") == "view")
        return station.groupBy(bucket("ts", 3600).alias("timestamp")).agg(F.avg("value").alias("outside_temp"))

    @property
    def tariff(self) -> DataFrame:
        return self.spark.createDataFrame(
            TARIFF_ROWS, "tou_id int, start_hour int, end_hour int, rate_kwh double"
        )

    @property
    def bms(self) -> DataFrame:
        value, user = F.col("value"), F.col("user_id")

        def text(number, unit):
            return F.concat(number.cast("decimal(12,2)").cast("string"), F.lit(unit))

        return self.events.select(
            "event_id", F.col("ts").alias("timestamp"),
            F.when(F.col("event_type").isin("purchase", "signup"), "AAAB (occ)").otherwise("AAAA").alias("occ_ahu1"),
            F.when(user % 10 == 0, "AAAB").otherwise("nan").alias("occ_ahu2"),
            text(value, " F").alias("return_temp_ahu1"),
            F.col("props").alias("supply_temp_ahu1"),
            F.when(user % 7 == 0, "nan").otherwise(text(value + user % 5, " F")).alias("return_temp_ahu2"),
            F.concat((user % 60).cast("string"), F.lit(" F")).alias("supply_temp_ahu2"),
            text(value - 10, " kW").alias("hvac_power_kw"),
        )
