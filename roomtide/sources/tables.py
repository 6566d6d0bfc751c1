"""Table sources: projection, predicate, ordering and limit over parquet, JDBC or catalog tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from roomtide.functions.scalars import to_moment, to_number


def open_parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def open_csv(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """CSV files with a header line and a declared schema, so that no pass is spent on guessing types.

    A value that does not fit its type becomes null.
    """
    return spark.read.schema(schema).options(header=True, mode="PERMISSIVE", **options).csv(path)


def open_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Database table; pass ``partitionColumn``, bounds and ``numPartitions`` for a parallel read."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def scan(
    table: DataFrame,
    columns: Sequence[str | Column] | None = None,
    where: Column | str | None = None,
    limit: int | None = None,
    parse_dates: Sequence[str] = (),
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Filter, project, parse dates, then limit.

    Filter and projection end up in the scan. A limit without ``order_by``
    returns any rows, as in SQL.
    """
    rows = table if where is None else table.where(where)
    rows = rows.select(*columns) if columns else rows
    rows = rows.withColumns({c: to_moment(c) for c in parse_dates if c in rows.columns})
    rows = rows.orderBy(*order_by) if order_by else rows
    return rows if limit is None else rows.limit(limit)


def occupancy_source(table: DataFrame, zone_id: str | None = None) -> DataFrame:
    """``zone_id, interval_begin, count`` from a space-occupancy table.

    The zone predicate compares the numeric id when the text is a number, so
    it can be pushed into the source. Other tables pass through with the known
    columns coerced.
    """
    if {"space_id", "occupancy", "beginning"} <= set(table.columns):
        rows = table
        if zone_id is not None:
            numeric = dict(table.dtypes)["space_id"] in ("int", "bigint") and str(zone_id).lstrip("-").isdigit()
            same = F.col("space_id") == int(zone_id) if numeric else F.col("space_id").cast("string") == str(zone_id)
            rows = rows.where(same)
        return rows.select(
            F.col("space_id").cast("string").alias("zone_id"),
            to_moment("beginning").alias("interval_begin"),
            to_number("occupancy").alias("count"),
        )
    coerced = {"interval_begin": to_moment("interval_begin"), "count": to_number("count")}
    return table.withColumns({c: v for c, v in coerced.items() if c in table.columns})


def weather_source(table: DataFrame, ts: str = "timestamp", temp: str = "outside_temp") -> DataFrame:
    """``timestamp, outside_temp`` in time order, rows without a time dropped."""
    rows = table.select(to_moment(ts).alias("timestamp"), to_number(temp).alias("outside_temp"))
    return rows.dropna(subset=["timestamp"]).orderBy("timestamp")


def hvac_source(table: DataFrame) -> DataFrame:
    return scan(table, parse_dates=["timestamp"])


def tariff_source(table: DataFrame) -> DataFrame:
    """``tou_id, start_hour, end_hour, rate_kwh`` with the types that ``add_tariff`` expects."""
    kinds = {"tou_id": "int", "start_hour": "int", "end_hour": "int", "rate_kwh": "double"}
    return scan(table, [F.col(c).try_cast(t).alias(c) for c, t in kinds.items()])


def space_source(table: DataFrame) -> DataFrame:
    """Space metadata: id, name, parent and room label, as the dashboard joins them."""
    return scan(table, ["space_id", "space_name", "parent_space_id", "building_room"])
