from datetime import datetime

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from roomtide.operators import grid, series
from roomtide.plans import boosted, forecast, regression


@pytest.fixture(scope="module")
def train(spark, at):
    return spark.createDataFrame([(at(15 * i), float(i % 4)) for i in range(200)], "ds timestamp_ntz, y double")


@pytest.fixture(scope="module")
def fortnight(occ, at):
    rows = [(at(15 * i), "A", 5.0 if 8 <= (i // 4) % 24 < 18 else 0.0) for i in range(14 * 96)]
    return occ(rows + [(at(0), "tiny", 1.0), (at(96 * 15), "one", 1.0), (at(0), "one", 1.0)])


def test_inclusive_range(train):
    model = forecast.fit_profile(train)
    got = forecast.predict_rows(model, forecast.future_range(model.level, "2025-01-03 00:00", "2025-01-03 03:45")).orderBy("ds").collect()
    assert len(got) == 16
    assert (got[0].ds, got[-1].ds) == (datetime(2025, 1, 3), datetime(2025, 1, 3, 3, 45))
    assert {"pred_occupancy_count", "pred_is_occupied"} <= set(got[0].asDict())
    with pytest.raises(ValueError):
        forecast.future_range(model.level, "2025-01-03", "2025-01-02")


def test_unknown_slots_take_the_mean(train):
    model = forecast.fit_profile(train)
    known = forecast.predict_rows(model, forecast.future_range(model.level, "2025-01-08 00:15", "2025-01-08 00:15")).first()
    other = forecast.predict_rows(model, forecast.future_range(model.level, "2025-01-05 00:15", "2025-01-05 00:15")).first()
    assert known.yhat == 1.0 and other.yhat == 1.5
    total = model.slots.agg(F.sum(F.col("expected") * F.col("rows")) / F.sum("rows")).first()[0]
    assert total == pytest.approx(model.level.first().zone_mean)


def test_periods_continue_after_the_last_row(train, at):
    got = [r.ds for r in forecast.future_periods(train, 3).orderBy("ds").collect()]
    assert got == [at(15 * i) for i in (200, 201, 202)]
    with_past = forecast.forecast_with_history(train, 3)
    assert with_past.count() == 203
    with pytest.raises(ValueError):
        forecast.future_periods(train, 0)


def test_asymmetric_thresholds(spark, at):
    truth = spark.createDataFrame([(at(0), 0.0), (at(15), 2.0)], "ds timestamp_ntz, y double")
    guess = spark.createDataFrame([(at(0), 0.8, False), (at(15), 1.2, True)], "ds timestamp_ntz, pred_occupancy_count double, pred_is_occupied boolean")
    pairs = forecast.pair_up(truth, guess)
    got = forecast.score(pairs, ["zone_id"]).first()
    assert (got.binary_accuracy, got.precision, got.recall, got.f1, got.n_eval_rows) == (1.0, 1.0, 1.0, 1.0, 2)
    assert got.mae == pytest.approx(0.8)
    errors = forecast.error_metrics(pairs, ["zone_id"]).first()
    assert (errors.rmse, errors.mape) == (pytest.approx(0.8), pytest.approx(40.0))


def test_end_to_end(fortnight, weather, at):
    only = fortnight.where("zone_id = 'A'")
    temps = weather([(at(60 * i), 58 + (i % 24) * 0.2) for i in range(336)])
    features = grid.forecast_features(only, temps)
    assert features.count() == 1248
    frame = forecast.model_frame(only)
    train = frame.where(F.col("pos") < forecast.cut_at("n", 0.8))
    assert train.count() == 998
    model = forecast.fit_profile(train)
    scored = forecast.evaluate(model, frame.where(F.col("pos") >= forecast.cut_at("n", 0.8))).first()
    assert scored.binary_accuracy == 1.0 and scored.mae == 0.0
    got = forecast.predict_occupancy(only, "2025-01-14 00:00", "2025-01-14 23:45").orderBy("timestamp").collect()
    assert len(got) == 96 and all(a.timestamp < b.timestamp for a, b in zip(got, got[1:]))


def test_backtest_keeps_short_zones(fortnight):
    result = forecast.backtest_zones(fortnight)
    got = {r.zone_id: r for r in result.metrics.collect()}
    assert got["A"].status == "ok" and got["A"]["pass"] is True
    for zone in ("tiny", "one"):
        assert (got[zone].status, got[zone].binary_accuracy, got[zone].mae, got[zone]["pass"]) == ("insufficient_data", 0.0, None, False)
    assert result.forecasts.select("zone_id").distinct().count() == 1
    assert tuple(forecast.zone_gate(result.metrics, 1).first()) == (1, 3, True)
    assert forecast.zone_gate(result.metrics, 2).first().gate_pass is False


def test_future_weather_falls_back_to_the_training_median(spark, train, weather, at):
    warm = train.withColumn("outside_temp", F.when(F.col("y") > 0, F.lit(50.0)))
    future = forecast.future_periods(warm, 2)
    got = forecast.with_future_weather(future, weather([(at(15 * 200), 71.0)]), warm).orderBy("ds").collect()
    assert [r.outside_temp for r in got] == [71.0, 50.0]


def test_future_weather_keeps_one_row_per_step(spark, train, weather, at):
    future = forecast.future_periods(train, 2)
    assert forecast.with_future_weather(future, weather([(at(15 * 200), 71.0)]), train).columns == future.columns
    warm = train.withColumn("outside_temp", F.lit(50.0))
    readings = weather([(at(15 * 200), 70.0), (at(15 * 200), 74.0), (at(15 * 201), None)])
    got = forecast.with_future_weather(future, readings, warm).orderBy("ds").collect()
    assert [r.outside_temp for r in got] == [72.0, 50.0]
    own = forecast.with_future_weather(future.withColumn("outside_temp", F.lit(1.0)), readings, warm).collect()
    assert [r.outside_temp for r in own] == [1.0, 1.0]


def test_service_with_weather_and_regression(fortnight, weather, at):
    temps = weather([(at(60 * i), 58 + (i % 24) * 0.2) for i in range(14 * 24)])
    day = ("2025-01-14 00:00", "2025-01-14 23:45")
    plain = forecast.predict_occupancy(fortnight.where("zone_id = 'A'"), *day).orderBy("timestamp").collect()
    with_temps = forecast.predict_occupancy(fortnight.where("zone_id = 'A'"), *day, weather_history=temps, weather_future=temps)
    assert with_temps.orderBy("timestamp").collect() == plain  # the profile does not use temperature
    fitted = forecast.predict_occupancy(
        fortnight.where("zone_id = 'A'"), *day, weather_history=temps, weather_future=temps, backend=regression.REGRESSION
    )
    assert fitted.count() == 96 and fitted.columns == with_temps.columns
    result = forecast.backtest_zones(fortnight, weather=temps, backend=regression.REGRESSION)
    got = {r.zone_id: r for r in result.metrics.collect()}
    assert set(got) == {"A", "tiny", "one"} and got["A"].status == "ok" and got["A"].mae < 3
    assert {r.zone_id for r in forecast.backtest_zones(fortnight, max_zones=1).metrics.collect()} == {"A"}
    assert {r.zone_id for r in forecast.backtest_zones(fortnight, zones=["tiny"]).metrics.collect()} == {"tiny"}


def test_chosen_metrics(train):
    model = forecast.fit_profile(train)
    assert forecast.evaluate(model, train, ["mae", "f1", "unknown"]).columns == ["zone_id", "mae", "f1"]


def test_regression_equals_dense_least_squares(spark, at):
    rng = np.random.default_rng(1)
    rows = []
    for zone, level in (("a", 4.0), ("b", 9.0)):
        for i in range(96 * 21):
            wave = 2 * np.sin(2 * np.pi * (i % 96) / 96)
            temp = float(60 + 5 * np.cos(i / 50))
            rows.append((at(15 * i), zone, float(level + wave + 0.1 * (temp - 60) + rng.normal(0, 0.1)), temp))
    train = spark.createDataFrame(rows, "ds timestamp_ntz, zone_id string, y double, outside_temp double")
    model = regression.fit_regression(train)
    fitted = regression.predict_regression(model, train).toPandas()
    residual = fitted.y - fitted.yhat
    assert residual.std() < 0.11
    inside = ((fitted.y >= fitted.yhat_lower) & (fitted.y <= fitted.yhat_upper)).mean()
    assert 0.75 < inside < 0.85
    # the same normal equations, built row by row
    own = fitted[fitted.zone_id == "a"].sort_values("ds")
    minute = (own.ds.dt.dayofweek * 1440 + own.ds.dt.hour * 60 + own.ds.dt.minute).to_numpy()
    columns = [np.ones(len(own))]
    for period, k in regression._angles():
        columns += [np.sin(2 * np.pi * k * minute / period), np.cos(2 * np.pi * k * minute / period)]
    years = (own.ds - own.ds.min()).dt.total_seconds().to_numpy() / (365.25 * 86400)
    columns += [years, own.outside_temp.to_numpy() - own.outside_temp.median()]
    x = np.stack(columns, axis=1)
    beta = np.linalg.lstsq(x, own.y.to_numpy(), rcond=None)[0]
    np.testing.assert_allclose(x @ beta, own.yhat.to_numpy(), atol=1e-5)


def test_trees_beat_the_mean(spark, at):
    rows = [(at(60 * h), float(20 if 8 <= h % 24 < 18 else 1)) for h in range(24 * 30)]
    df = spark.createDataFrame(rows, "interval_begin timestamp_ntz, count double")
    features = series.hourly_features(series.hourly_series(df, "interval_begin", "count"))
    result = boosted.train_trees(features, rounds=10, depth=3)
    n = 24 * 30 - 24
    assert result.predictions.count() == n - int(n * 0.8)
    assert result.mean_absolute_error() < 13.0  # ten trees at a small step are still far from the pattern
    longer = boosted.train_trees(features, rounds=200, depth=3, patience=20)
    assert longer.mean_absolute_error() < 0.5 and longer.model.stages[-1].getNumTrees <= 200
    parts = {r.part: r["count"] for r in boosted.split_hourly(features, 0.8, 0.1).groupBy("part").count().collect()}
    assert sum(parts.values()) == n and parts["validate"] > 0


def test_continued_boosting_equals_one_run(spark, at):
    rng = np.random.default_rng(2)
    rows = [(at(60 * h), float(8 + 6 * np.sin(h * np.pi / 12) + rng.normal())) for h in range(24 * 14)]
    df = spark.createDataFrame(rows, "interval_begin timestamp_ntz, count double")
    features = series.hourly_features(series.hourly_series(df, "interval_begin", "count"))
    result = boosted.train_trees(features, rounds=24, depth=3, patience=3, learning_rate=0.2)
    grown = result.model.stages[-1]
    assert 4 < grown.getNumTrees <= 24  # continued beyond the first run
    labelled = boosted.split_hourly(features, 0.8, 0.1)
    known = result.model.stages[0].transform(labelled.where("part != 'test'"))
    whole = GBTRegressor(labelCol="occupancy", featuresCol="inputs", stepSize=0.2, maxDepth=3, seed=7, maxIter=24)
    whole = whole.fit(known.where("part = 'train'"))
    errors = whole.evaluateEachIteration(known.where("part = 'validate'"), "squared")
    stop = next((i for i in range(24) if i - int(np.argmin(errors[:i + 1])) >= 3), 23)
    assert grown.getNumTrees == int(np.argmin(errors[:stop + 1])) + 1
    one_run = boosted.assembled(whole, whole.trees[:grown.getNumTrees], 0.2)
    test = result.model.stages[0].transform(labelled.where("part = 'test'"))
    ours = [r.prediction for r in result.predictions.orderBy("timestamp").collect()]
    theirs = [r.prediction for r in one_run.transform(test).orderBy("timestamp").collect()]
    np.testing.assert_allclose(ours, theirs, rtol=1e-9)
