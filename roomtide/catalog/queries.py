"""The registered queries: every operator run over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from roomtide.functions.scalars import round_to
from roomtide.operators import canonical, grid, merge, series
from roomtide.operators.ordered import chronological_split
from roomtide.plans import boosted, dashboard, describe, forecast, insights, regression, savings
from roomtide.plans.thermal import ThermalSettings, ThermalStudy
from roomtide.session import durable, tune
from roomtide.sources.demo import Demo
from roomtide.sources.tables import (
    hvac_source, occupancy_source, scan, space_source, tariff_source, weather_source,
)

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]
RANGE = ("2024-02-01 00:00:00", "2024-02-03 23:45:00")
PLAN_RANGE = ("2024-01-25 00:00:00", "2024-01-30 23:45:00")
PLAN_THRESHOLD = 1.0
EXAMPLE_DAY, EXAMPLE_ZONE = date(2024, 1, 15), "view"
THERMAL = ThermalSettings(occ_prob_threshold=0.95)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def tidy(df: DataFrame, places: int = 6) -> DataFrame:
    """Round doubles, so that the order of summation cannot show."""
    return df.select(*[round_to(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str | Callable[[Demo], DataFrame]):
    """Register a function under its own name, or under the name given."""
    def register(build: Callable[[Demo], DataFrame], key: str) -> Callable[[Demo], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(build(Demo(tune(spark), folder)))

        QUERIES[key] = run
        return build

    if callable(name):
        return register(name, name.__name__)
    return lambda build: register(build, name)


# --- sources ----------------------------------------------------------------

@query
def scan_project_filter_limit(d: Demo) -> DataFrame:
    return scan(
        d.hvac_state, ["timestamp", "space_id", "zone_temp"], F.col("zone_temp") > 76.0, 500,
        ["timestamp"], ["timestamp", "space_id"],
    )


@query("occupancy_source")
def occupancy_source_zone(d: Demo) -> DataFrame:
    return occupancy_source(d.space_occ, "7")


@query("weather_source")
def weather_source_rows(d: Demo) -> DataFrame:
    return weather_source(d.weather)


@query
def schema_dictionary(d: Demo) -> DataFrame:
    tables = {name: d.table(name) for name in TABLES}
    return describe.schema_dictionary(d.spark, tables).select(
        "table_name", "column_name", "ordinal_position", "data_type", "is_nullable",
        "estimated_row_count", "semantic_meaning",
    )


@query
def column_profile(d: Demo) -> DataFrame:
    return describe.column_profile(d.events).withColumn("examples", F.array_join("examples", "|"))


@query
def time_range(d: Demo) -> DataFrame:
    return describe.time_range(d.events, "ts")


@query("hvac_source")
def hvac_source_rows(d: Demo) -> DataFrame:
    return hvac_source(d.hvac.withColumn("timestamp", F.col("timestamp").cast("string")))


@query("tariff_source")
def tariff_source_rows(d: Demo) -> DataFrame:
    size = F.col("p_size")
    return tariff_source(d.table("part").select(
        F.col("p_partkey").cast("string").alias("tou_id"), (size % 24).cast("string").alias("start_hour"),
        F.when(size > 24, size % 7).cast("string").alias("end_hour"),
        F.concat(F.when(size % 5 == 0, "?").otherwise(""), F.col("p_retailprice").cast("string")).alias("rate_kwh"),
    ))


@query("space_source")
def space_source_rows(d: Demo) -> DataFrame:
    return space_source(d.space)


# --- coercion and predicates ------------------------------------------------

@query
def normalize_occupancy(d: Demo) -> DataFrame:
    return canonical.normalize_occupancy(d.occ)


@query
def duplicate_count(d: Demo) -> DataFrame:
    hourly = d.occ.withColumn("timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    return canonical.count_duplicates(hourly)


@query
def coerce_numeric(d: Demo) -> DataFrame:
    texts = d.bms.select(
        "event_id", F.regexp_replace("return_temp_ahu1", " F", "").alias("clean"),
        F.col("return_temp_ahu2").alias("dirty"),
    )
    return canonical.coerce_numbers(texts, ["clean", "dirty", "absent"])


@query
def normalize_weather(d: Demo) -> DataFrame:
    return canonical.normalize_weather(
        d.events.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"), F.col("value").alias("temperature"))
    )


@query
def time_filter(d: Demo) -> DataFrame:
    inside = canonical.between("timestamp", "2024-01-08 06:00:00", "2024-01-20 18:00:00")
    return d.hvac.where(inside).groupBy("space_id").agg(
        F.count(F.lit(1)).alias("samples"), F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts")
    )


@query
def day_window(d: Demo) -> DataFrame:
    start, end = canonical.day_window(date(2024, 1, 10), date(2024, 1, 12))
    inside = d.occ.where(canonical.between("timestamp", start, end))
    bounds = canonical.day_bounds(d.occ, "timestamp").select(F.struct("first_day", "last_day")).scalar()
    return inside.groupBy("zone_id").agg(F.count(F.lit(1)).alias("samples")).withColumns({
        "first_day": bounds.getField("first_day"), "last_day": bounds.getField("last_day"),
    })


@query
def recent_window(d: Demo) -> DataFrame:
    return canonical.last_days(d.hvac, "timestamp", 14).groupBy("space_id").agg(
        F.count(F.lit(1)).alias("samples"), F.min("timestamp").alias("min_ts"), F.avg("zone_temp").alias("avg_temp")
    )


@query
def first_n_zones(d: Demo) -> DataFrame:
    chosen = canonical.first_zones(d.occ, 3)
    return canonical.only_zones(d.occ, chosen).groupBy("zone_id").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("occupancy_count").alias("avg_occ")
    )


# --- dashboard --------------------------------------------------------------

@query
def occupancy_kpis(d: Demo) -> DataFrame:
    return dashboard.occupancy_kpis(d.space_occ)


@query
def occupancy_daily(d: Demo) -> DataFrame:
    return dashboard.occupancy_daily(d.space_occ)


@query
def occupancy_heatmap(d: Demo) -> DataFrame:
    return dashboard.occupancy_heatmap(d.space_occ)


@query
def occupancy_space_stats(d: Demo) -> DataFrame:
    return dashboard.occupancy_space_stats(d.space_occ, d.space)


@query
def hvac_kpis(d: Demo) -> DataFrame:
    return dashboard.hvac_kpis(d.hvac)


@query
def hvac_daily(d: Demo) -> DataFrame:
    return dashboard.hvac_daily(d.hvac)


@query
def hvac_hourly(d: Demo) -> DataFrame:
    return dashboard.hvac_hourly(d.hvac)


@query
def hvac_zone_stats(d: Demo) -> DataFrame:
    return dashboard.hvac_zone_stats(d.hvac)


@query
def hvac_comfort_summary(d: Demo) -> DataFrame:
    return dashboard.hvac_comfort_summary(d.hvac)


@query
def top_spaces(d: Demo) -> DataFrame:
    return dashboard.top_spaces(dashboard.occupancy_space_stats(d.space_occ, d.space), 15)


@query
def top_zones(d: Demo) -> DataFrame:
    return dashboard.top_zones(dashboard.hvac_zone_stats(d.hvac), 3)


@query
def heatmap_pivot(d: Demo) -> DataFrame:
    return dashboard.heatmap_pivot(dashboard.occupancy_heatmap(d.space_occ))


@query
def heatmap_agg(d: Demo) -> DataFrame:
    return dashboard.heatmap_by(d.space_occ, "median")


@query
def daily_unpivot(d: Demo) -> DataFrame:
    return dashboard.daily_long(dashboard.occupancy_daily(d.space_occ), ["avg_occ", "peak_occ"])


@query
def occupancy_timeline(d: Demo) -> DataFrame:
    return dashboard.occupancy_timeline(d.space_occ)


@query
def occupancy_insights(d: Demo) -> DataFrame:
    out = insights.occupancy_insights(
        dashboard.occupancy_heatmap(d.space_occ), dashboard.occupancy_space_stats(d.space_occ, d.space)
    )
    return out.withColumn("low_util_spaces", F.array_join("low_util_spaces", "|"))


@query
def hvac_insights(d: Demo) -> DataFrame:
    return insights.hvac_insights(dashboard.hvac_zone_stats(d.hvac), dashboard.hvac_comfort_summary(d.hvac))


# --- preparation ------------------------------------------------------------

@query
def merge_occupancy_hvac(d: Demo) -> DataFrame:
    return merge.merge_occupancy_equipment(d.occ, d.hvac_state)


@query
def merge_occupancy_hvac_left(d: Demo) -> DataFrame:
    running = d.hvac_state.where(F.col("hvac_mode") != "Off")  # leaves buckets without a partner
    return merge.merge_occupancy_equipment(d.occ, running, how="left")


@query
def add_weather_features(d: Demo) -> DataFrame:
    hourly = grid.align(canonical.normalize_occupancy(d.occ), ["zone_id"], "occupancy_count", 3600)
    return merge.add_weather(hourly, d.weather)


@query
def add_tou_features(d: Demo) -> DataFrame:
    return merge.add_tariff(d.occ, d.tariff)


@query
def opportunity_flag(d: Demo) -> DataFrame:
    return merge.flag_opportunity(merge.merge_occupancy_equipment(d.occ, d.hvac_state, how="left"))


@query
def dense_grid(d: Demo) -> DataFrame:
    return grid.dense_grid(d.occ).select("zone_id", "timestamp", "occupancy_count")


@query
def weather_interpolated(d: Demo) -> DataFrame:
    return grid.weather_grid(d.weather)


@query
def median_impute(d: Demo) -> DataFrame:
    hourly = grid.align(canonical.normalize_occupancy(d.occ), ["zone_id"], "occupancy_count", 3600)
    return grid.impute_median(merge.add_weather(hourly, d.weather), "outside_temp")


@query
def forecast_features(d: Demo) -> DataFrame:
    return grid.forecast_features(d.occ, d.weather)


@query
def engineer_features(d: Demo) -> DataFrame:
    return series.engineer_features(d.occ)


@query
def hourly_resample(d: Demo) -> DataFrame:
    return series.hourly_series(d.occ, "timestamp", "occupancy_count").select("timestamp", "occupancy")


@query
def hourly_features(d: Demo) -> DataFrame:
    hourly = series.hourly_series(d.occ, "timestamp", "occupancy_count")
    return series.hourly_features(hourly, d.weather).drop("slot", "slots")


@query("chronological_split")
def split_rows(d: Demo) -> DataFrame:
    return chronological_split(canonical.normalize_occupancy(d.occ), ["zone_id"], "timestamp", 0.8)


@query
def infer_step_hours(d: Demo) -> DataFrame:
    return series.step_hours(d.occ, "timestamp")


@query
def downsample(d: Demo) -> DataFrame:
    return series.thin(dashboard.occupancy_timeline(d.space_occ), ["timestamp"], 500)


@query
def sliding_sequences(d: Demo) -> DataFrame:
    pairs = series.sequences(grid.dense_grid(d.occ), ["zone_id"], "slot", "occupancy_count")
    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return pairs.select(
        "zone_id", "timestamp", F.size("inputs").alias("n_in"), F.size("targets").alias("n_out"),
        F.element_at("inputs", 1).alias("first_in"), F.element_at("inputs", -1).alias("last_in"),
        F.element_at("targets", 1).alias("first_out"), F.element_at("targets", -1).alias("last_out"),
        total("inputs").alias("sum_in"), total("targets").alias("sum_out"),
    )


@query
def add_tou_dirty(d: Demo) -> DataFrame:
    """Some rows have no time, some no zone."""
    mark = F.pmod(F.col("occupancy_count").cast("bigint"), F.lit(11))
    rows = d.occ.withColumns({
        "timestamp": F.when(mark != 3, F.col("timestamp")), "zone_id": F.when(mark != 5, F.col("zone_id")),
    })
    return merge.add_tariff(rows, d.tariff).select("timestamp", "zone_id", "occupancy_count", "hour", "tou_rate")


# --- forecasting ------------------------------------------------------------

def train_frame(d: Demo) -> DataFrame:
    frame = forecast.model_frame(d.occ)
    return frame.where(F.col("pos") < forecast.cut_at("n", 0.8)).select("zone_id", "ds", "y")


def test_pairs(d: Demo) -> DataFrame:
    frame = forecast.model_frame(d.occ)
    test = frame.where(F.col("pos") >= forecast.cut_at("n", 0.8)).select("zone_id", "ds", "y")
    predicted = forecast.predict_rows(forecast.fit_profile(train_frame(d)), test.select("zone_id", "ds"))
    return forecast.pair_up(test, predicted)


@query
def seasonal_profile(d: Demo) -> DataFrame:
    model = forecast.fit_profile(train_frame(d))
    return model.slots.join(model.level, "zone_id")


@query
def future_grid(d: Demo) -> DataFrame:
    return forecast.future_periods(train_frame(d), 192)


@query
def seasonal_naive_forecast(d: Demo) -> DataFrame:
    train = train_frame(d)
    return forecast.predict_rows(forecast.fit_profile(train), forecast.future_periods(train, 672))


@query
def forecast_with_history(d: Demo) -> DataFrame:
    return forecast.forecast_with_history(train_frame(d), 96)


@query
def predict_occupancy(d: Demo) -> DataFrame:
    return forecast.predict_occupancy(d.occ, *RANGE)


@query
def predict_occupancy_weather(d: Demo) -> DataFrame:
    return forecast.predict_occupancy(d.occ, *RANGE, weather_history=d.weather, weather_future=d.weather)


@query
def backtest_metrics(d: Demo) -> DataFrame:
    return forecast.score(test_pairs(d), ["zone_id"])


@query
def error_metrics(d: Demo) -> DataFrame:
    return forecast.error_metrics(test_pairs(d), ["zone_id"])


@query
def zone_backtest(d: Demo) -> DataFrame:
    return forecast.backtest_zones(d.occ).metrics


@query
def zone_backtest_forecasts(d: Demo) -> DataFrame:
    return forecast.backtest_zones(d.occ).forecasts


@query
def zone_gate(d: Demo) -> DataFrame:
    return forecast.zone_gate(forecast.backtest_zones(d.occ).metrics)


@query
def seasonal_regression_forecast(d: Demo) -> DataFrame:
    rows = grid.with_weather(train_frame(d).withColumnRenamed("ds", "timestamp"), d.weather)
    train = rows.withColumnRenamed("timestamp", "ds")
    train = durable(train)  # read by the fit, the medians and the horizon
    model = regression.fit_regression(train)
    future = forecast.with_future_weather(forecast.future_periods(train, 192), None, train)
    return regression.predict_regression(model, future)


@query
def regression_median_fill(d: Demo) -> DataFrame:
    hourly = merge.add_weather(train_frame(d).withColumnRenamed("ds", "timestamp"), d.weather)
    return regression.fill_temperatures(forecast.model_rows(hourly.withColumnRenamed("timestamp", "ds")))


@query
def regression_residual_products(d: Demo) -> DataFrame:
    train = durable(forecast.temperatures(train_frame(d), d.weather, "15min"))
    return regression.residual_products(regression.fit_regression(train), train)


@query
def regression_backtest(d: Demo) -> DataFrame:
    found = forecast.backtest_zones(d.occ, weather=d.weather, backend=regression.REGRESSION).metrics
    return found.select("zone_id", "status", "n_eval_rows")


@query
def regression_slot_sums(d: Demo) -> DataFrame:
    rows = forecast.temperatures(train_frame(d), d.weather, "15min")
    return regression.slot_sums(forecast.model_rows(rows))


@query
def gbt_hourly_frame(d: Demo) -> DataFrame:
    hourly = series.hourly_series(d.occ, "timestamp", "occupancy_count")
    return boosted.split_hourly(series.hourly_features(hourly, d.weather), 0.8, 0.1).drop("slot", "slots")


@query
def hourly_forecast_error(d: Demo) -> DataFrame:
    """The value of a day before as forecast of the test rows: what a fitted model has to beat."""
    hourly = series.hourly_series(d.occ, "timestamp", "occupancy_count")
    rows = boosted.split_hourly(series.hourly_features(hourly, d.weather), 0.8, 0.1).where("part = 'test'")
    return boosted.forecast_error(rows, rows.select("timestamp", F.col("occ_lag_24h").alias("prediction")))


@query
def gbt_hourly_forecast(d: Demo) -> DataFrame:
    hourly = series.hourly_series(d.occ, "timestamp", "occupancy_count")
    return boosted.train_trees(series.hourly_features(hourly, d.weather)).predictions


# --- thermal proxy ----------------------------------------------------------

def study(d: Demo) -> ThermalStudy:
    return ThermalStudy(d.bms, THERMAL, tie_breaker="event_id")


@query
def thermal_signal(d: Demo) -> DataFrame:
    return study(d).signal


@query
def select_threshold(d: Demo) -> DataFrame:
    return study(d).threshold


@query
def classification_metrics(d: Demo) -> DataFrame:
    return study(d).metrics()


@query
def thermal_hourly_profile(d: Demo) -> DataFrame:
    return study(d).hourly_profile()


@query
def thermal_dow_hour_profile(d: Demo) -> DataFrame:
    return study(d).weekly_profile()


@query
def thermal_summary(d: Demo) -> DataFrame:
    return study(d).summary()


@query
def thermal_opportunity(d: Demo) -> DataFrame:
    return study(d).historical()


@query
def thermal_forecast(d: Demo) -> DataFrame:
    return study(d).forecast().drop("slot")


@query
def setback_windows(d: Demo) -> DataFrame:
    return study(d).windows()


# --- savings ----------------------------------------------------------------

def flagged(d: Demo) -> DataFrame:
    return merge.flag_opportunity(merge.merge_occupancy_equipment(d.occ, d.hvac_state))


@query
def savings_potential(d: Demo) -> DataFrame:
    merged = merge.merge_occupancy_equipment(d.occ, d.hvac_state)
    return savings.savings_potential(merge.add_tariff(merged, d.tariff).drop("hour"), rate="tou_rate")


@query
def daily_opportunity_cumulative(d: Demo) -> DataFrame:
    return savings.daily_opportunity(flagged(d))


@query
def day_timeline(d: Demo) -> DataFrame:
    return savings.day_timeline(flagged(d), EXAMPLE_DAY, EXAMPLE_ZONE)


@query
def opportunity_min_duration(d: Demo) -> DataFrame:
    return savings.sustained_opportunity(flagged(d))


@query
def setpoint_plan(d: Demo) -> DataFrame:
    predicted = forecast.predict_occupancy(d.occ, *PLAN_RANGE).withColumnRenamed(
        "pred_occupancy_count", "predicted_occupancy"
    )
    baseline = merge.equipment_buckets(d.hvac_state).withColumnsRenamed(
        {"zone_temp": "baseline_setpoint", "energy_kwh": "baseline_energy"}
    )
    comfort = savings.Comfort(occupancy_threshold=PLAN_THRESHOLD)
    return savings.setpoint_plan(predicted, baseline, merge.tariff_by_hour(d.tariff), comfort)
