"""Trend, daily and weekly seasonality and temperature, by least squares per zone.

Least squares needs only sums of products. Training rows are reduced by
ordinary Spark aggregation to one row per (zone, weekday, minute of day): the
seasonal terms are constant within such a slot, so ten sums describe all its
rows. What reaches Python is bounded by the calendar (at most 10,080 rows of
sums per zone at one-minute steps), whatever the number of training rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from roomtide.functions.scalars import dow_mon0, epoch_micros, minute_of_day
from roomtide.operators.ordered import percentiles
from roomtide.plans.forecast import Backend, finish_forecast, model_rows
from roomtide.session import durable

DAILY_TERMS = 4
WEEKLY_TERMS = 3
DAY, WEEK = 1440, 10080
BAND = 1.2815515655446004  # 80 % of a normal distribution lies within this many deviations
YEAR_MICROS = 365.25 * 86400 * 1e6
EPOCH_2020 = 1_577_836_800_000_000

SUMS = ["n", "t", "x", "tt", "xx", "tx", "y", "ty", "xy", "yy"]
COEFFICIENTS = "zone_id string, coef array<double>, sigma double, temp_mid double, n bigint"


def _angles():
    return [(DAY, k) for k in range(1, DAILY_TERMS + 1)] + [(WEEK, k) for k in range(1, WEEKLY_TERMS + 1)]


def _years(ds: Column | str) -> Column:
    return (epoch_micros(ds) - F.lit(EPOCH_2020)) / F.lit(YEAR_MICROS)


def zone_solver() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Function that solves the normal equations of one zone from its per-slot sums.

    It is a closure over plain values, so executors need numpy and pandas but
    not this package.
    """
    angles, day, sums = _angles(), DAY, SUMS

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dow", "minute"])
        minute_of_week = pdf["dow"].to_numpy() * day + pdf["minute"].to_numpy()
        waves = [np.ones(len(pdf))]
        for period, k in angles:
            phase = 2 * np.pi * k * minute_of_week / period
            waves += [np.sin(phase), np.cos(phase)]
        phi = np.stack(waves, axis=1)
        s = {c: pdf[c].to_numpy(dtype=float) for c in sums}
        p = phi.shape[1]
        gram = np.zeros((p + 2, p + 2))
        gram[:p, :p] = phi.T @ (phi * s["n"][:, None])
        gram[:p, p] = gram[p, :p] = phi.T @ s["t"]
        gram[:p, p + 1] = gram[p + 1, :p] = phi.T @ s["x"]
        gram[p, p], gram[p + 1, p + 1] = s["tt"].sum(), s["xx"].sum()
        gram[p, p + 1] = gram[p + 1, p] = s["tx"].sum()
        moment = np.concatenate([phi.T @ s["y"], [s["ty"].sum(), s["xy"].sum()]])
        coef, _, rank, _ = np.linalg.lstsq(gram, moment, rcond=1e-12)
        n = s["n"].sum()
        rss = max(s["yy"].sum() - 2 * coef @ moment + coef @ gram @ coef, 0.0)
        return pd.DataFrame({
            "zone_id": [pdf["zone_id"].iloc[0]], "coef": [coef.tolist()],
            "sigma": [float(np.sqrt(rss / max(n - rank, 1)))],
            "temp_mid": [float(pdf["temp_mid"].iloc[0])], "n": [int(n)],
        })

    return solve


def fit_regression(train: DataFrame) -> DataFrame:
    """``zone_id, coef, sigma, temp_mid, n``; missing temperatures take the zone's median.

    The model (one row per zone) is written out, so predicting never refits.
    """
    rows = model_rows(train)
    if "outside_temp" not in rows.columns:
        rows = rows.withColumn("outside_temp", F.lit(None).cast("double"))
    return durable(slot_sums(rows).groupBy("zone_id").applyInPandas(zone_solver(), COEFFICIENTS))


def fill_temperatures(rows: DataFrame) -> DataFrame:
    """Model rows with ``temp_mid``, the zone's median temperature (0 if none is known), in place of missing ones."""
    middle = percentiles(rows, ["zone_id"], "outside_temp", {"temp_mid": 0.5})
    rows = rows.join(middle, "zone_id", "left").withColumn("temp_mid", F.coalesce("temp_mid", F.lit(0.0)))
    return rows.withColumn("outside_temp", F.coalesce("outside_temp", "temp_mid"))


def slot_sums(rows: DataFrame) -> DataFrame:
    """Ten sums per zone and weekly slot; all that the normal equations need of ``zone_id, ds, y, outside_temp``."""
    rows = fill_temperatures(rows).select(
        "zone_id", "temp_mid", dow_mon0("ds").alias("dow"), minute_of_day("ds").alias("minute"),
        _years("ds").alias("_t"), (F.col("outside_temp") - F.col("temp_mid")).alias("_x"), F.col("y").alias("_y"),
    )
    t, x, y = F.col("_t"), F.col("_x"), F.col("_y")
    products = {"t": t, "x": x, "tt": t * t, "xx": x * x, "tx": t * x, "y": y, "ty": t * y, "xy": x * y, "yy": y * y}
    return rows.groupBy("zone_id", "temp_mid", "dow", "minute").agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(v).alias(k) for k, v in products.items()]
    )


def _terms() -> list[Column]:
    """The terms of a row with ``ds, outside_temp, temp_mid``, in the order of the coefficients."""
    minute = (dow_mon0("ds") * DAY + minute_of_day("ds")).cast("double")
    terms: list[Column] = [F.lit(1.0)]
    for period, k in _angles():
        angle = minute * F.lit(2 * np.pi * k / period)
        terms += [F.sin(angle), F.cos(angle)]
    return terms + [_years("ds"), F.coalesce("outside_temp", "temp_mid") - F.col("temp_mid")]


def _fitted(model: DataFrame, rows: DataFrame) -> DataFrame:
    rows = rows if "outside_temp" in rows.columns else rows.withColumn("outside_temp", F.lit(None).cast("double"))
    yhat = F.lit(0.0)
    for i, term in enumerate(_terms()):
        yhat = yhat + F.get("coef", F.lit(i)) * term
    return rows.join(model, "zone_id", "left").withColumn("yhat", yhat)


def predict_regression(model: DataFrame, future: DataFrame) -> DataFrame:
    """Forecast with an 80 % band for ``zone_id, ds[, outside_temp]`` rows."""
    rows = _fitted(model, future)
    band = F.col("sigma") * BAND
    rows = rows.withColumns({"yhat_lower": F.col("yhat") - band, "yhat_upper": F.col("yhat") + band})
    return finish_forecast(rows.drop("coef", "sigma", "temp_mid", "n"))


def residual_products(model: DataFrame, train: DataFrame) -> DataFrame:
    """How far a fit is from least squares: ``zone_id, term, rows, residual_share``.

    At the minimum the residuals are orthogonal to every term, so the sum of
    residual times term is 0 per zone and term, whatever method found the
    coefficients. ``residual_share`` is that sum, without sign, in proportion
    to the sum of the sizes of its products with the values.
    """
    rows = _fitted(model, model_rows(train))
    miss, terms = F.col("y") - F.col("yhat"), _terms()
    sums = rows.groupBy("zone_id").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.abs(F.sum(miss * term)).alias(f"_m{i}") for i, term in enumerate(terms)],
        *[F.sum(F.abs(F.col("y") * term)).alias(f"_s{i}") for i, term in enumerate(terms)],
    )
    shares = [
        F.struct(F.lit(i).alias("term"), F.coalesce(F.try_divide(f"_m{i}", f"_s{i}"), F.lit(0.0)).alias("residual_share"))
        for i, _ in enumerate(terms)
    ]
    return sums.select("zone_id", "rows", F.inline(F.array(*shares))).select("zone_id", "term", "rows", "residual_share")


REGRESSION = Backend(fit_regression, predict_regression, lambda model: model.select("zone_id"))
