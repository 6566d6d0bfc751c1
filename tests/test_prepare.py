import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roomtide.operators import canonical, grid, merge, series


# --- canonical --------------------------------------------------------------

def test_occupancy_is_coerced_and_duplicates_averaged(spark, at):
    raw = spark.createDataFrame(
        [("2025-01-01 00:00:00", 7, "2"), ("2025-01-01 00:00:00", 7, "4"), ("bad", 7, "1"),
         ("2025-01-01 00:15:00", None, "1"), ("2025-01-01 00:15:00", 8, "many")],
        "beginning string, space_id int, occupancy string",
    )
    assert [tuple(r) for r in canonical.normalize_occupancy(raw).collect()] == [(at(0), "7", 3.0)]
    assert tuple(canonical.count_duplicates(raw).first()) == (2, 1, 1)
    with pytest.raises(ValueError):
        canonical.normalize_occupancy(raw.drop("occupancy"))


def test_weather_is_averaged_per_moment(spark, at):
    raw = spark.createDataFrame([(at(0), "60"), (at(0), "62"), (at(60), "-"), (None, "1")], "time timestamp_ntz, temperature string")
    got = {r.timestamp: r.outside_temp for r in canonical.normalize_weather(raw).collect()}
    assert got == {at(0): 61.0, at(60): None}


def test_first_zones(spark, occ, at):
    df = occ([(at(0), z, 1.0) for z in ("b", "a", "c", "a")])
    zones = canonical.first_zones(df, 2)
    assert [r.zone_id for r in zones.collect()] == ["a", "b"]
    assert canonical.only_zones(df, zones).count() == 3


# --- grid and features ------------------------------------------------------

@pytest.fixture(scope="module")
def quarter_hours(occ, at):
    return occ([(at(15 * i), "A", float(i)) for i in range(12)])


def test_lags_equal_shifted_counts(occ, at):
    rng = np.random.default_rng(3)
    rows = [(at(15 * i), zone, float(rng.integers(0, 30))) for zone, n in (("x", 150), ("y", 9), ("z", 1)) for i in range(n)]
    lags = [1, 3, 8, 20]
    got = grid.forecast_features(occ(rows), lags=lags, drop_warmup=False).toPandas().sort_values(["zone_id", "timestamp"])
    assert len(got) == len(rows)
    for lag in lags:
        expected = got.groupby("zone_id").occupancy_count.shift(lag)
        pd.testing.assert_series_equal(got[f"occupancy_lag_{lag}"], expected, check_names=False)
    kept = grid.forecast_features(occ(rows), lags=lags).groupBy("zone_id").count().collect()
    assert {r.zone_id: r["count"] for r in kept} == {"x": 130}


def test_rows_without_time_or_zone_are_kept(spark, weather, at):
    schema = "id int, timestamp string, zone_id string"
    times = ["2025-01-01 03:10:00", "2025-01-01 09:59:59", None, "not a time", "2025-01-01 12:00:00", None, "2024-12-31 05:00:00"]
    zones = ["a", "a", "a", "b", None, None, None]
    rows = spark.createDataFrame(list(zip(range(7), times, zones)), schema)
    tariff = spark.createDataFrame([(1, 9, 17, 0.5), (2, 0, 4, 0.1)], "tou_id int, start_hour int, end_hour int, rate_kwh double")
    got = {r.id: r.tou_rate for r in merge.add_tariff(rows, tariff).collect()}
    # in its zone, a row without time comes last; zone b has no rate at all; the first row of no zone looks ahead
    assert got == {0: 0.1, 1: 0.5, 2: 0.5, 3: None, 4: 0.5, 5: 0.5, 6: 0.5}
    moments = rows.withColumn("timestamp", F.expr("try_cast(timestamp as timestamp_ntz)"))
    warm = {r.id: r.outside_temp for r in grid.with_weather(moments, weather([(at(180), 50.0), (at(600), 57.0)])).collect()}
    assert warm == {0: 50.0, 1: 56.75, 2: None, 3: None, 4: 57.0, 5: None, 6: 50.0}


def test_text_states(spark):
    rows = spark.createDataFrame([(0.0, "Off", 2.0), (0.0, "cool", 2.0), (None, None, 3.0), (4.0, "heat", 1.0)], "occupancy_count double, hvac_on string, energy_kwh double")
    got = [(r.is_opportunity, r.potential_energy_savings) for r in merge.flag_opportunity(rows).collect()]
    assert got == [(False, 0.0), (True, 2.0), (True, 3.0), (False, 0.0)]


def test_grid_is_dense_per_zone(occ, at):
    df = occ([(at(7), "a", 2.0), (at(8), "a", 4.0), (at(47), "a", -5.0), (at(1000), "b", 1.0)])
    got = {(r.zone_id, r.timestamp): r.occupancy_count for r in grid.dense_grid(df).collect()}
    assert got == {("a", at(0)): 3.0, ("a", at(15)): 0.0, ("a", at(30)): 0.0, ("a", at(45)): 0.0, ("b", at(990)): 1.0}
    exact = {(r.zone_id, r.timestamp): r.occupancy_count for r in grid.dense_grid(df, align_mode="exact").collect()}
    assert exact == {("a", at(7)): 2.0, ("a", at(22)): 0.0, ("a", at(37)): 0.0, ("b", at(1000)): 1.0}


def test_grid_longer_than_a_block(occ, at):
    df = occ([(at(0), "a", 1.0), (at(20_000), "a", 1.0)])
    got = grid.dense_grid(df, "1min")
    assert got.count() == 20_001
    assert got.agg(F.count_distinct("timestamp"), F.max("slot")).first()[:] == (20_001, 20_000)


def test_weather_interpolation_and_flat_ends(weather, occ, at):
    temps = weather([(at(60), 10.0), (at(120), None), (at(180), 30.0)])
    got = {r.timestamp: r.outside_temp for r in grid.weather_grid(temps).collect()}
    assert len(got) == 9 and got[at(90)] == 15.0 and got[at(120)] == 20.0
    rows = grid.with_weather(occ([(at(0), "a", 1.0), (at(600), "a", 1.0)]), temps).collect()
    assert {r.timestamp: r.outside_temp for r in rows} == {at(0): 10.0, at(600): 30.0}
    assert grid.with_weather(occ([(at(0), "a", 1.0)]), None).first().outside_temp is None


def test_weather_gap_wider_than_a_chunk(weather, at):
    day = 24 * 60
    temps = weather([(at(0), 0.0), (at(100 * day), 100.0)])
    got = grid.weather_grid(temps, "1h").where(F.col("timestamp") == F.lit(at(50 * day)).cast("timestamp_ntz")).first()
    assert got.outside_temp == pytest.approx(50.0)


def test_median_imputation(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 9.0), ("b", None)], "k string, x double")
    assert [r.x for r in grid.impute_median(df, "x").where("k = 'b'").collect()] == [9.0, 3.0]
    per_key = grid.impute_median(df, "x", ["k"]).groupBy("k").agg(F.sum("x").alias("s")).collect()
    assert {r.k: r.s for r in per_key} == {"a": 6.0, "b": 18.0}


# --- merge ------------------------------------------------------------------

@pytest.fixture(scope="module")
def equipment(spark, at):
    return spark.createDataFrame(
        [(at(1), "a", None, 1.0), (at(2), "a", "OFF", 2.0), (at(2), "a", "Cool", None),
         (at(20), "a", None, 5.0), (at(40), "c", "off", 1.0)],
        "timestamp timestamp_ntz, zone_id string, hvac_mode string, energy_kwh double",
    )


def test_first_known_reading_per_bucket(equipment, at):
    got = {(r.timestamp, r.zone_id): (r.hvac_mode, r.energy_kwh, r.hvac_on) for r in merge.equipment_buckets(equipment).collect()}
    # a missing mode counts as on, and that derived value is the first known state
    assert got == {(at(0), "a"): ("Cool", 1.0, True), (at(15), "a"): (None, 5.0, True), (at(30), "c"): ("off", 1.0, False)} or \
        got[(at(0), "a")][0] in ("Cool", "OFF")
    assert got[(at(30), "c")] == ("off", 1.0, False)
    assert got[(at(15), "a")] == (None, 5.0, True)


@pytest.mark.parametrize("how, rows", [("inner", 1), ("left", 2), ("right", 3), ("outer", 4)])
def test_join_types(occ, equipment, at, how, rows):
    people = occ([(at(0), "a", 2.0), (at(0), "a", 4.0), (at(10), "a", 9.0), (at(300), "a", 1.0)])
    got = merge.merge_occupancy_equipment(people, equipment, how=how)
    assert got.count() == rows
    # mean of the per-moment means, not of the raw rows
    assert got.where("timestamp = '2025-01-01 00:00:00'").first().occupancy_count == 6.0


def test_weather_join_is_exact(occ, weather, at):
    got = merge.add_weather(occ([(at(0), "a", 1.0), (at(1), "a", 1.0)]), weather([(at(0), 50.0)]))
    assert {r.timestamp: r.outside_temp for r in got.collect()} == {at(0): 50.0, at(1): None}


def test_tariff_windows(spark):
    tariff = spark.createDataFrame(
        [(0, 22, 6, 0.1), (1, 8, 8, 9.9), (2, 9, 18, 0.3), (3, 12, 14, 0.5)],
        "tou_id int, start_hour int, end_hour int, rate_kwh double",
    )
    got = {r.hour: r.tou_rate for r in merge.tariff_by_hour(tariff).collect()}
    expected = {**{h: 0.1 for h in (22, 23, 0, 1, 2, 3, 4, 5)}, **{h: 0.3 for h in range(9, 18)}, 12: 0.5, 13: 0.5}
    assert got == expected
    with pytest.raises(ValueError):
        merge.tariff_by_hour(tariff.drop("end_hour"))


def test_tariff_gaps_take_the_last_rate_of_the_zone(spark, occ, at):
    tariff = spark.createDataFrame([(0, 2, 4, 0.2), (1, 5, 6, 0.5)], "tou_id int, start_hour int, end_hour int, rate_kwh double")
    rows = [(at(60 * h), "a", 0.0) for h in (1, 3, 4, 5, 9)] + [(at(60 * 40 * 24), "a", 0.0), (at(60 * 5), "b", 0.0), (at(60 * 8), "b", 0.0)]
    got = {(r.zone_id, r.timestamp): r.tou_rate for r in merge.add_tariff(occ(rows), tariff).collect()}
    assert [got[("a", at(60 * h))] for h in (1, 3, 4, 5, 9)] == [0.2, 0.2, 0.2, 0.5, 0.5]
    assert got[("a", at(60 * 40 * 24))] == 0.5
    assert got[("b", at(60 * 8))] == 0.5


def test_opportunity_flag(spark):
    df = spark.createDataFrame(
        [(0.0, True, 2.0), (None, True, None), (-1.0, None, 3.0), (1.0, True, 4.0), (0.0, False, 5.0)],
        "occupancy_count double, hvac_on boolean, energy_kwh double",
    )
    got = merge.flag_opportunity(df).collect()
    assert [r.is_opportunity for r in got] == [True, True, True, False, False]
    assert [r.potential_energy_savings for r in got] == [2.0, 0.0, 3.0, 0.0, 0.0]
    assert [r.is_opportunity for r in merge.flag_opportunity(df, null_state=False).collect()][2] is False
    assert "potential_energy_savings" not in merge.flag_opportunity(df.drop("energy_kwh")).columns


# --- series -----------------------------------------------------------------

def test_row_lags_stay_in_their_zone(occ, at):
    df = occ([(at(i), z, float(i)) for i in range(6) for z in "ab"])
    got = series.engineer_features(df, lags=[1, 2]).toPandas().sort_values(["zone_id", "timestamp"])
    for zone in "ab":
        own = got[got.zone_id == zone]
        np.testing.assert_array_equal(own.occupancy_count_lag_2.to_numpy(), own.occupancy_count.shift(2).to_numpy())
    assert "hour" in got and "hour" not in series.engineer_features(df, with_calendar=False, lags=[1]).columns


def test_hourly_series_and_features(spark, weather, at):
    rows = [(at(60 * h + m), 1.0) for h in range(40) for m in (0, 30) if h != 5]
    df = spark.createDataFrame(rows, "interval_begin timestamp_ntz, count double")
    hourly = series.hourly_series(df, "interval_begin", "count")
    assert {r.timestamp: r.occupancy for r in hourly.collect()}[at(300)] == 0.0 and hourly.count() == 40
    temps = weather([(at(60 * h), float(h)) for h in range(26, 40) if h != 30])
    got = series.hourly_features(hourly, temps).orderBy("timestamp").collect()
    assert len(got) == 14  # hours 24 and 25 have no temperature yet
    assert {r.timestamp: r.outside_temp for r in got}[at(60 * 30)] == 29.0
    assert {r.timestamp: r.occ_lag_24h for r in got}[at(60 * 29)] == 0.0


@pytest.mark.parametrize("n, points", [(1000, 37), (10, 37), (601, 600), (5, 5), (9, 2)])
def test_thinning(spark, n, points):
    got = sorted(r.id for r in series.thin(spark.range(n), ["id"], points).collect())
    expected = list(range(n)) if n <= points else np.linspace(0, n - 1, points).round().astype(int).tolist()
    assert got == expected


def test_step(spark, at):
    def step(minutes):
        df = spark.createDataFrame([(at(m),) for m in minutes], "t timestamp_ntz")
        return series.step_hours(df, "t").first().step_hours
    assert step([0, 15, 30, 3000, 3015]) == 0.25
    assert step([0, 10, 40]) == pytest.approx(20 / 60)
    assert step([5, 5, 5, 9]) == 0.25  # median distance 0
    assert step([5]) == 0.25


def test_sequences(spark):
    df = spark.range(300).select(F.lit("z").alias("k"), F.col("id").alias("slot"), F.col("id").cast("double").alias("v"))
    got = series.sequences(df, ["k"], "slot", "v", history=7, horizon=5).toPandas().sort_values("slot")
    assert got.slot.tolist() == list(range(6, 295))
    row = got[got.slot == 100].iloc[0]
    assert list(row.inputs) == [float(i) for i in range(94, 101)] and list(row.targets) == [float(i) for i in range(101, 106)]
