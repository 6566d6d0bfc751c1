from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from roomtide.functions import scalars as s
from roomtide.operators import canonical


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_frequencies():
    assert [s.seconds_of(f) for f in ("15min", "1h", "30 minutes", "day", "45s")] == [900, 3600, 1800, 86400, 45]
    with pytest.raises(ValueError):
        s.seconds_of("soon")


def test_numbers_from_text(spark):
    texts = ["72.5 F", "-3", ".5 kW", "nan", "{\"k\": 69}", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(s.first_number("t").alias("x")).collect()
    assert [r.x for r in rows] == [72.5, -3.0, 0.5, None, 69.0, None]


def test_bad_values_become_null(spark):
    df = spark.createDataFrame([("1.5", "2025-01-01 00:15:00"), ("x", "never"), ("NaN", None)], "n string, t string")
    rows = df.select(s.to_number("n").alias("n"), s.to_moment("t").alias("t")).collect()
    assert [r.n for r in rows] == [1.5, None, None]
    assert [r.t for r in rows] == [datetime(2025, 1, 1, 0, 15), None, None]


def test_zoned_text_keeps_wall_clock(spark):
    text = F.lit("2024-04-28T01:15:00-07:00 Los_Angeles")
    assert one(spark, s.local_moment(text)) == datetime(2024, 4, 28, 1, 15)
    assert one(spark, s.local_moment(F.lit("2024-04-28"))) == datetime(2024, 4, 28)


def test_rounding_is_half_away_from_zero(spark):
    assert one(spark, s.round_to(F.lit(2.675))) == 2.68
    assert one(spark, s.round_to(F.lit(-0.125))) == -0.13


def test_ratio_of_nothing_is_zero(spark):
    assert one(spark, s.ratio(F.lit(0), F.lit(0))) == 0.0


def test_calendar(spark):
    sunday = F.lit("2025-01-05 13:45:10").cast("timestamp_ntz")
    got = spark.range(1).select(
        s.dow_sun0(sunday), s.dow_mon0(sunday), s.weekend(sunday), s.hour_of(sunday), s.minute_of_day(sunday)
    ).first()
    assert tuple(got) == (0, 6, 1, 13, 825)


def test_epoch_micros_ignores_the_session_zone(spark):
    moment = F.lit("2025-03-09 02:30:00.000001").cast("timestamp_ntz")  # does not exist in New York
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        micros = one(spark, s.epoch_micros(moment))
        again = one(spark, s.after(F.lit("1970-01-01").cast("timestamp_ntz"), F.lit(micros)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert again == datetime(2025, 3, 9, 2, 30, 0, 1)


def test_report_texts(spark):
    got = spark.range(1).select(
        s.show_number(F.lit(1234.5)), s.show_number(F.lit(None).cast("double")), s.show_hour(F.lit(7)),
        s.weekday_label(F.lit(0)), s.weekday_label(F.lit(9)),
    ).first()
    assert tuple(got) == ("1,234.50", "N/A", "07:00", "Sunday", "N/A")


def test_range_predicate(spark, at):
    df = spark.createDataFrame([(at(i),) for i in range(4)], "t timestamp_ntz")
    assert df.where(canonical.between("t", at(1), at(2))).count() == 2
    assert df.where(canonical.between("t", at(1), at(2), end_open=True)).count() == 1
    assert df.where(canonical.between("t", None, at(2))).count() == 3
    assert df.where(canonical.between("t")).count() == 4
    with pytest.raises(ValueError):
        canonical.between("t", at(2), at(1))


def test_range_predicate_is_pushed_to_the_scan(spark, tmp_path, at):
    spark.createDataFrame([(at(0), "a", 1.0)], "timestamp timestamp_ntz, space_id string, zone_temp double").write.parquet(f"{tmp_path}/h")
    df = spark.read.parquet(f"{tmp_path}/h").where(canonical.between("timestamp", at(0), at(9))).select("zone_temp")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in plan and "LessThanOrEqual(timestamp" in plan
    assert "space_id" not in plan.split("ReadSchema:")[1].splitlines()[0]


def test_day_window_and_bounds(spark, at):
    assert canonical.day_window(date(2025, 1, 1), date(2025, 1, 2)) == (datetime(2025, 1, 1), datetime(2025, 1, 2, 23, 59, 59))
    assert canonical.day_window("2025-01-01", "2025-01-02", half_open=True)[1] == datetime(2025, 1, 3)
    df = spark.createDataFrame([(at(0),), (at(3000),)], "t timestamp_ntz")
    assert tuple(canonical.day_bounds(df, "t").first()) == (date(2025, 1, 1), date(2025, 1, 3))
    empty = canonical.day_bounds(df.limit(0), "t").first()
    assert empty.first_day == empty.last_day and empty.first_day is not None


def test_chosen_days():
    first, last, one = date(2025, 1, 1), date(2025, 1, 31), date(2025, 1, 7)
    assert canonical.chosen_days((one, None), first, last) == (one, last)
    assert canonical.chosen_days(one, first, last) == (one, one)
    assert canonical.chosen_days(None, first, last) == (first, last)


def test_rounding_keeps_large_numbers(spark):
    df = spark.createDataFrame([(1e29,), (-3e30,), (1.005,), (2.5,), (None,), (float("nan"),)], "x double")
    got = [r.x for r in df.select(s.round_to("x", 2).alias("x")).collect()]
    assert got == [1e29, -3e30, 1.01, 2.5, None, None]


def test_bucket_keeps_nulls(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2025-01-01 10:59:59.9'), (timestamp_ntz'1969-12-31 23:59:00'), (NULL) AS t(x)")
    got = [str(r.b) for r in df.select(s.bucket("x", 900).alias("b")).collect()]
    assert got == ["2025-01-01 10:45:00", "1969-12-31 23:45:00", "None"]
