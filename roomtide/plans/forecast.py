"""Seasonal-naive forecasts and chronological backtests for all zones at once.

A fitted model is a pair of DataFrames, never driver state: the weekday by
minute-of-day profile per zone, and the zone's overall mean.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F

from roomtide.functions.scalars import (
    after, as_col, dow_mon0, epoch_micros, minute_of_day, non_negative, ratio, seconds_of, tally,
    to_moment, to_number,
)
from roomtide.operators.canonical import first_zones, moment, moment_lit, normalize_weather, only_zones
from roomtide.operators.grid import DEFAULT_LAGS, dense_grid, expand_slots, with_weather
from roomtide.operators.ordered import percentiles
from roomtide.session import durable

OCCUPIED_FROM = 1.0


@dataclass(frozen=True)
class Backend:
    """A way to forecast: ``fit(train)`` gives a model, ``predict(model, future)`` rows, ``zones(model)`` its zone ids."""
    fit: Callable[[DataFrame], Any]
    predict: Callable[[Any, DataFrame], DataFrame]
    zones: Callable[[Any], DataFrame]


@dataclass(frozen=True)
class SeasonalProfile:
    slots: DataFrame  # zone_id, dow, minute, expected
    level: DataFrame  # zone_id, zone_mean


def model_rows(df: DataFrame) -> DataFrame:
    """``zone_id, ds, y[, outside_temp]`` with unusable rows dropped."""
    for name in ("ds", "y"):
        if name not in df.columns:
            raise ValueError(f"model rows need column {name!r}")
    out = df if "zone_id" in df.columns else df.withColumn("zone_id", F.lit("all"))
    extra = [to_number("outside_temp").alias("outside_temp")] if "outside_temp" in df.columns else []
    return out.select("zone_id", to_moment("ds").alias("ds"), to_number("y").alias("y"), *extra).dropna(
        subset=["ds", "y"]
    )


def fit_profile(train: DataFrame) -> SeasonalProfile:
    """Mean per (zone, weekday, minute of day), and per zone.

    The zone means are taken from the profile's sums, so the training rows are
    shuffled once, already reduced to at most one row per weekly slot.
    """
    rows = model_rows(train)
    sums = rows.groupBy("zone_id", dow_mon0("ds").alias("dow"), minute_of_day("ds").alias("minute")).agg(
        F.sum("y").alias("s"), F.count("y").alias("n")
    )
    level = sums.groupBy("zone_id").agg((F.sum("s") / F.sum("n")).alias("zone_mean"))
    return SeasonalProfile(
        sums.select("zone_id", "dow", "minute", (F.col("s") / F.col("n")).alias("expected"), F.col("n").alias("rows")),
        level,
    )


def finish_forecast(df: DataFrame) -> DataFrame:
    """Null and negative predictions become 0; occupied from one person upwards."""
    out = df.withColumns({c: non_negative(c) for c in ("yhat", "yhat_lower", "yhat_upper")})
    return out.withColumn("pred_occupancy_count", F.col("yhat")).withColumn(
        "pred_is_occupied", F.col("pred_occupancy_count") >= OCCUPIED_FROM
    )


def predict_rows(model: SeasonalProfile, future: DataFrame) -> DataFrame:
    """Forecast for given ``zone_id, ds`` rows; other columns are kept."""
    if "zone_id" not in future.columns:
        future = future.withColumn("zone_id", F.lit("all"))
    rows = future.withColumn("ds", to_moment("ds")).dropna(subset=["ds"])
    rows = rows.withColumns({"dow": dow_mon0("ds"), "minute": minute_of_day("ds")})
    joined = rows.join(model.slots.drop("rows"), ["zone_id", "dow", "minute"], "left").join(
        model.level, "zone_id", "left"
    )
    yhat = F.coalesce("expected", "zone_mean")
    joined = joined.withColumns({"yhat": yhat, "yhat_lower": yhat, "yhat_upper": yhat})
    return finish_forecast(joined.drop("dow", "minute", "expected", "zone_mean"))


PROFILE = Backend(fit_profile, predict_rows, lambda model: model.level)


def future_periods(train: DataFrame, periods: int, freq: str = "15min") -> DataFrame:
    """The next ``periods`` steps after each zone's last training row."""
    if periods <= 0:
        raise ValueError("periods must be > 0")
    step = F.lit(seconds_of(freq) * 1_000_000)
    last = model_rows(train).groupBy("zone_id").agg(F.max("ds").alias("_last"))
    spans = last.select("zone_id", after("_last", step).alias("_start"), F.lit(periods).cast("bigint").alias("_n"))
    return expand_slots(spans, "_start", "_n", step).select("zone_id", F.col("timestamp").alias("ds"))


def future_range(zones: DataFrame, start, end, freq: str = "15min") -> DataFrame:
    """Every step from ``start`` to ``end``, both included, for each zone."""
    first, last = moment(start), moment(end)
    if last < first:
        raise ValueError("end must not be before start")
    step = seconds_of(freq)
    n = int((last - first).total_seconds() // step) + 1
    spans = zones.select("zone_id", moment_lit(first).alias("_start"), F.lit(n).cast("bigint").alias("_n"))
    return expand_slots(spans, "_start", "_n", F.lit(step * 1_000_000)).select(
        "zone_id", F.col("timestamp").alias("ds")
    )


def with_future_weather(future: DataFrame, weather: DataFrame | None, train: DataFrame) -> DataFrame:
    """Temperature for future rows: what the row has, the mean of that moment's weather rows, the zone's training median.

    A model trained without temperature takes none: the rows are returned as they are.
    """
    if "outside_temp" not in train.columns:
        return future
    median = percentiles(model_rows(train), ["zone_id"], "outside_temp", {"_median": 0.5})
    rows = future if "outside_temp" in future.columns else future.withColumn("outside_temp", F.lit(None).cast("double"))
    if weather is not None:
        names = {"timestamp": "ds", "temperature": "outside_temp"}
        weather = weather.withColumnsRenamed({a: b for a, b in names.items() if b not in weather.columns})
        weather = weather.select(to_moment("ds").alias("ds"), to_number("outside_temp").alias("_reading"))
        weather = weather.groupBy("ds").agg(F.avg("_reading").alias("_reading"))
        rows = rows.join(weather, "ds", "left").withColumn("outside_temp", F.coalesce("outside_temp", "_reading")).drop("_reading")
    filled = rows.join(median, "zone_id", "left")
    return filled.withColumn("outside_temp", F.coalesce("outside_temp", "_median")).drop("_median")


def forecast_with_history(train: DataFrame, periods: int, freq: str = "15min") -> DataFrame:
    """Fitted values on the training rows followed by the next ``periods`` steps."""
    history = model_rows(train).select("zone_id", "ds")
    rows = history.unionByName(future_periods(train, periods, freq), allowMissingColumns=True)
    return predict_rows(fit_profile(train), rows)


# --- splits by slot number --------------------------------------------------

def model_frame(
    occupancy: DataFrame, freq: str = "15min", warmup: int = max(DEFAULT_LAGS), align_mode: str = "floor",
    zone_id: str | None = None,
) -> DataFrame:
    """Grid rows after the lag warm-up: ``zone_id, ds, y, pos, n``.

    ``pos`` counts a zone's rows from 0 and ``n`` is their number. Both follow
    from the slot number, so splitting needs neither a sort nor a window.
    """
    return after_warmup(dense_grid(occupancy, freq, align_mode, zone_id), warmup)


def after_warmup(grid: DataFrame, warmup: int) -> DataFrame:
    return grid.where(F.col("slot") >= warmup).select(
        "zone_id", F.col("timestamp").alias("ds"), F.col("occupancy_count").alias("y"),
        (F.col("slot") - warmup).alias("pos"), (F.col("slots") - warmup).alias("n"),
    )


def cut_at(n, train_ratio: float):
    """Number of training rows, ``int(n * train_ratio)``."""
    return F.floor(as_col(n).cast("double") * F.lit(float(train_ratio))).cast("bigint")


def temperatures(rows: DataFrame, weather: DataFrame | None, freq: str) -> DataFrame:
    """Model rows with the temperature of their slot; unchanged without weather."""
    if weather is None:
        return rows
    return with_weather(rows.withColumnRenamed("ds", "timestamp"), weather, freq).withColumnRenamed("timestamp", "ds")


def predict_occupancy(
    occupancy: DataFrame, start, end, freq: str = "15min", train_ratio: float = 0.8,
    zone_id: str | None = None, model: Any = None, align_mode: str = "floor",
    weather_history: DataFrame | None = None, weather_future: DataFrame | None = None, backend: Backend = PROFILE,
) -> DataFrame:
    """Train on the first part of every zone's history and forecast a range of moments.

    With ``weather_history`` the training rows get their temperature, and the
    range gets that of ``weather_future``, or the zone's training median. A
    ``model`` that the caller has fitted takes the temperatures as they are.
    """
    train = None
    if model is None:
        frame = model_frame(occupancy, freq, align_mode=align_mode, zone_id=zone_id)
        train = frame.where(F.col("pos") < cut_at("n", train_ratio)).select("zone_id", "ds", "y")
        train = temperatures(train, weather_history, freq)
        model = backend.fit(train)
    future = future_range(backend.zones(model).select("zone_id"), start, end, freq)
    if train is not None:
        future = with_future_weather(future, weather_future, train)
    elif weather_future is not None:
        readings = normalize_weather(weather_future).withColumnRenamed("timestamp", "ds")
        future = future.join(readings, "ds", "left")
    out = backend.predict(model, future)
    return out.select(
        F.col("ds").alias("timestamp"), "zone_id", "pred_occupancy_count", "pred_is_occupied"
    )


# --- evaluation -------------------------------------------------------------

def pair_up(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """Actual and predicted values of the same (zone, moment)."""
    truth = model_rows(actual).select("zone_id", "ds", "y")
    if "zone_id" not in forecast.columns:
        forecast = forecast.withColumn("zone_id", F.lit("all"))
    return truth.join(
        forecast.select("zone_id", "ds", "pred_occupancy_count", "pred_is_occupied"), ["zone_id", "ds"]
    )


METRICS = ("binary_accuracy", "precision", "recall", "f1", "mae", "n_eval_rows")


def score(pairs: DataFrame, keys: list[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Occupied/unoccupied metrics (truth ``y > 0``) and mean absolute error; unknown names in ``metrics`` are ignored."""
    truth, guess = F.col("y") > 0, F.col("pred_is_occupied")
    counted = pairs.groupBy(*keys).agg(
        tally(truth & guess).alias("tp"), tally(~truth & ~guess).alias("tn"),
        tally(~truth & guess).alias("fp"), tally(truth & ~guess).alias("fn"),
        F.count(F.lit(1)).cast("bigint").alias("n_eval_rows"),
        F.avg(F.abs(F.col("y") - F.col("pred_occupancy_count"))).alias("mae"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    found = counted.select(
        *keys, ratio(tp + tn, F.col("n_eval_rows")).alias("binary_accuracy"),
        precision.alias("precision"), recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"), "mae", "n_eval_rows",
    )
    return found.select(*keys, *[m for m in metrics if m in METRICS])


def evaluate(model: Any, test: DataFrame, metrics: Sequence[str] = METRICS, backend: Backend = PROFILE) -> DataFrame:
    rows = model_rows(test)
    return score(backend.predict(model, rows), ["zone_id"], metrics)


def error_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """MAE, RMSE and MAPE (over rows whose actual value is not 0)."""
    miss = F.col("y") - F.col("pred_occupancy_count")
    return pairs.groupBy(*keys).agg(
        F.avg(F.abs(miss)).alias("mae"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        (F.lit(100.0) * F.avg(F.abs(F.try_divide(miss, F.nullif(F.col("y"), F.lit(0.0)))))).alias("mape"),
    )


@dataclass(frozen=True)
class Backtest:
    metrics: DataFrame
    forecasts: DataFrame


def backtest_zones(
    occupancy: DataFrame, freq: str = "15min", test_ratio: float = 0.2, accuracy_threshold: float = 0.8,
    warmup: int = max(DEFAULT_LAGS), align_mode: str = "floor", weather: DataFrame | None = None,
    zones: Sequence[str] | None = None, max_zones: int | None = None, backend: Backend = PROFILE,
) -> Backtest:
    """Prepare, split, fit and score every zone in one plan.

    ``zones`` names the zones to test, ``max_zones`` takes the first in text order.

    Zones too short to be split still get a row, with status
    ``insufficient_data``, because the metrics start from the list of zones. The
    grid, read by the zone list, the fit and the test, is written out once.
    """
    keep = 1.0 - test_ratio
    grid = dense_grid(occupancy, freq, align_mode)
    if zones is not None:
        grid = grid.where(F.col("zone_id").isin([str(z) for z in zones]))
    if max_zones is not None:
        grid = only_zones(grid, first_zones(grid, max_zones))
    grid = durable(grid)
    n = F.greatest(F.col("slots") - warmup, F.lit(0))
    usable = (F.col("cut") >= 1) & (F.col("cut") < F.col("n"))
    listed = grid.where(F.col("slot") == 0).select("zone_id", n.alias("n")).withColumn("cut", cut_at("n", keep)).withColumn("usable", usable)
    frame = after_warmup(grid, warmup).withColumn("cut", cut_at("n", keep)).where(usable)
    frame = temperatures(frame, weather, freq)
    inputs = ["zone_id", "ds", "y", *(["outside_temp"] if weather is not None else [])]
    model = backend.fit(frame.where(F.col("pos") < F.col("cut")).select(inputs))
    test = frame.where(F.col("pos") >= F.col("cut")).select(inputs)
    predicted = backend.predict(model, test)
    scored = listed.join(score(predicted, ["zone_id"]), "zone_id", "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("binary_accuracy", "precision", "recall", "f1")}
    metrics = scored.withColumns(zero).select(
        "zone_id",
        F.when(F.col("usable"), "ok").otherwise("insufficient_data").alias("status"),
        "binary_accuracy", "precision", "recall", "f1", "mae",
        F.coalesce("n_eval_rows", F.lit(0)).cast("bigint").alias("n_eval_rows"),
        (F.col("usable") & (F.col("binary_accuracy") >= accuracy_threshold)).alias("pass"),
    )
    forecasts = predicted.select(
        F.col("ds").alias("timestamp"), "zone_id", "pred_occupancy_count", "pred_is_occupied"
    )
    return Backtest(metrics, forecasts)


def zone_gate(metrics: DataFrame, min_passing: int = 1) -> DataFrame:
    """How many zones pass, and whether that is enough."""
    return metrics.agg(
        tally(F.col("pass")).alias("passing_zones"),
        F.count(F.lit(1)).cast("bigint").alias("zones"),
        (tally(F.col("pass")) >= min_passing).alias("gate_pass"),
    )
