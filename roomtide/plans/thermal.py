"""Occupancy inferred from air-handler temperatures, and setback planning.

Data-dependent scalars (cut, threshold, sampling step, newest moment, spread)
are one-row results. They are found once per study and enter the tables as
literals: a scalar subquery would be copied into every expression that reads it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from roomtide.functions.scalars import (
    after, dow_mon0, first_number, hour_of, ratio, share, tally, to_moment,
)
from roomtide.operators.canonical import last_days
from roomtide.operators.ordered import chronological_split, runs
from roomtide.operators.selection import quantiles
from roomtide.operators.series import sampling_step, thin
from roomtide.session import durable

# Status code of an occupied air handler, number of candidate
# thresholds, smallest spread of the logistic curve, probability limits.
OCCUPIED_STATUS = "AAAB"
CANDIDATES = 300
MIN_SPREAD = 0.45
PROBABILITY_RANGE = (0.01, 0.99)


@dataclass(frozen=True)
class ThermalSettings:
    forecast_hours: float = 168
    recent_days: int = 14
    opportunity_kw: float = 0.5
    setback_reduction: float = 0.30
    occ_prob_threshold: float = 0.35
    train_ratio: float = 0.8


def signal(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed signal from text readings.

    ``raw`` has ``timestamp, occ_ahu1, occ_ahu2, return_temp_ahu1,
    supply_temp_ahu1, return_temp_ahu2, supply_temp_ahu2, hvac_power_kw``.
    """
    def occupied(c: str) -> Column:
        return F.coalesce(F.substring(F.col(c).cast("string"), 1, 4) == OCCUPIED_STATUS, F.lit(False))

    def mean_of(a: Column, b: Column) -> Column:
        return F.coalesce((a + b) / 2, a, b)

    readings = F.struct(
        to_moment("timestamp").alias("timestamp"),
        (occupied("occ_ahu1") | occupied("occ_ahu2")).alias("occupied_actual"),
        *[
            first_number(f"{side}_temp_ahu{i}").alias(f"{side}{i}")
            for side in ("return", "supply") for i in (1, 2)
        ],
        first_number("hvac_power_kw").alias("kw"),
        *keep,
    )
    # as a generated row the parsed readings are evaluated once; a plain
    # projection would be repeated inside the null filter below
    parsed = raw.select(F.inline(F.array(readings))).where(F.col("timestamp").isNotNull())
    delta1, delta2 = F.col("return1") - F.col("supply1"), F.col("return2") - F.col("supply2")
    return parsed.select(
        "timestamp", "occupied_actual",
        F.when(F.col("kw") < 0, F.lit(0.0)).otherwise(F.col("kw")).alias("hvac_kw"),
        delta1.alias("delta_ahu1_f"), delta2.alias("delta_ahu2_f"),
        mean_of(delta1, delta2).alias("cooling_delta_f"),
        mean_of(F.col("return1"), F.col("return2")).alias("return_temp_f"),
        mean_of(F.col("supply1"), F.col("supply2")).alias("supply_temp_f"),
        *keep,
    ).dropna(subset=["cooling_delta_f", "hvac_kw"])


def select_threshold(train: DataFrame, delta: str = "cooling_delta_f", target: str = "occupied_actual") -> DataFrame:
    """Threshold with the best balanced accuracy among 300 candidates; one row.

    Candidates are evenly spaced between the 1st and 99th percentile, which are
    found first and enter the plan as literals. One pass counts rows by the
    number of candidates they reach; the score of every candidate then follows
    from cumulative sums over 301 counts. The first of equally good candidates wins.
    """
    last = CANDIDATES - 1
    low, high = quantiles(train, delta, [0.01, 0.99])
    step = None if low is None else (high - low) / float(last)
    lo, hi, width = (F.lit(v).cast("double") for v in (low, high, step))

    def candidate(i: Column) -> Column:
        return F.when(i == last, hi).otherwise(lo + i.cast("double") * width)

    # Arithmetic gives the candidate next to the value up to rounding; the exact
    # comparisons around it settle the count.
    x = F.col(delta)
    guess = F.coalesce(F.floor(F.try_divide(x - lo, width)), F.lit(0))
    first = F.greatest(F.least(guess, F.lit(last)) - 1, F.lit(0)).cast("bigint")
    rows = train.select(x, F.col(target).alias("t"), first.alias("_first"))
    reached = F.col("_first")
    for shift in range(4):
        i = F.col("_first") + shift
        reached = reached + F.when((i <= last) & (x >= candidate(i)), 1).otherwise(0)
    counts = rows.select(reached.alias("reached"), "t").groupBy("reached").agg(
        tally(F.col("t")).alias("pos"), tally(~F.col("t")).alias("neg")
    )
    # at most 301 rows from here on
    table = counts.agg(F.map_from_entries(F.collect_list(F.struct("reached", F.struct("pos", "neg")))).alias("at"))
    ladder = table.select("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(CANDIDATES).cast("bigint"))).alias("reached"))
    cell = F.try_element_at("at", F.col("reached"))
    ladder = ladder.select("reached", *[F.coalesce(cell.getField(c), F.lit(0)).alias(c) for c in ("pos", "neg")])
    up = Window.orderBy(F.desc("reached")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    scored = ladder.select(
        (F.col("reached") - 1).alias("i"),
        F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"),
        F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"),
    ).where(F.col("i") >= 0)
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "p", "n"))
    recall, specificity = tp / F.greatest(p, F.lit(1)), (n - fp) / F.greatest(n, F.lit(1))
    best = scored.withColumn("balanced_accuracy", (recall + specificity) / 2).agg(
        F.min(F.struct((-F.col("balanced_accuracy")).alias("s"), "i")).alias("b")
    )
    return best.select(candidate(F.col("b.i")).alias("threshold_f"), (-F.col("b.s")).alias("balanced_accuracy"))


class ThermalStudy:
    """All report tables of one building over one raw frame.

    Cut, threshold, step and the signal's extent are single values. Each is
    found once per study, when a table first needs it, and enters the tables as
    a literal, so a table reads the signal once. Tables that need such a value
    read the signal as a written, typed table: its texts are parsed once.
    """

    def __init__(self, raw: DataFrame, settings: ThermalSettings = ThermalSettings(), tie_breaker: str | None = None):
        self.raw, self.settings, self.tie_breaker = raw, settings, tie_breaker
        self.signal = signal(raw, (tie_breaker,) if tie_breaker else ())

    @cached_property
    def rows(self) -> DataFrame:
        return durable(self.signal)

    @cached_property
    def split(self) -> DataFrame:
        return chronological_split(
            self.rows, [], "timestamp", self.settings.train_ratio, self.tie_breaker, at_least=1
        )

    @cached_property
    def threshold(self) -> DataFrame:
        """One row: ``threshold_f, balanced_accuracy``, found on the training part."""
        return select_threshold(self.split.where("is_train"))

    @cached_property
    def limit(self) -> Column:
        """The threshold as a literal."""
        return F.lit(self.threshold.first()["threshold_f"]).cast("double")

    @cached_property
    def step(self) -> float:
        """Sampling step in hours."""
        return sampling_step(self.rows, "timestamp")

    @cached_property
    def extent(self) -> Row:
        """Newest moment and spread of the temperature difference."""
        spread = F.greatest(F.stddev_samp("cooling_delta_f") / 4.0, F.lit(MIN_SPREAD))
        return self.rows.agg(F.max("timestamp").alias("last"), spread.alias("spread")).first()

    @cached_property
    def classified(self) -> DataFrame:
        return self.split.withColumn("occupied_pred", F.col("cooling_delta_f") >= self.limit)

    def with_step(self, df: DataFrame) -> DataFrame:
        """Attach the sampling step: ``_step`` in hours and ``_step_us`` in whole microseconds."""
        micros = round(self.step * 3600.0 * 1e6)
        return df.withColumns({"_step": F.lit(self.step), "_step_us": F.lit(micros).cast("bigint")})

    def with_opportunity(self) -> DataFrame:
        s = self.settings
        idle = ~F.col("occupied_pred") & (F.col("hvac_kw") >= float(s.opportunity_kw))
        saved = F.col("hvac_kw") * F.col("_step") * float(s.setback_reduction)
        rows = self.with_step(self.classified).withColumn("opportunity", idle)
        return rows.withColumn("avoidable_kwh", F.when(idle, saved).otherwise(F.lit(0.0)))

    def metrics(self) -> DataFrame:
        """Confusion metrics for ``train``, ``test`` and ``all``; an empty test part repeats ``train``."""
        truth, guess, train = F.col("occupied_actual"), F.col("occupied_pred"), F.col("is_train")
        cells = {"tp": truth & guess, "tn": ~truth & ~guess, "fp": ~truth & guess, "fn": truth & ~guess}
        parts = {"train": train, "test": ~train, "all": F.lit(True)}
        one = self.classified.agg(
            *[tally(cell & part).alias(f"{p}_{c}") for p, part in parts.items() for c, cell in cells.items()]
        )
        total = {p: sum((F.col(f"{p}_{c}") for c in cells), F.lit(0)) for p in parts}

        def row(p: str) -> Column:
            empty_test = total["test"] == 0 if p == "test" else F.lit(False)
            values = [F.when(empty_test, F.col(f"train_{c}")).otherwise(F.col(f"{p}_{c}")).alias(c) for c in cells]
            return F.struct(F.lit(p).alias("split"), *values)

        rows = one.select(F.inline(F.array(*[row(p) for p in parts])))
        return confusion_metrics(rows, ["split"])

    def hourly_profile(self) -> DataFrame:
        """24 rows; hours without data are null."""
        hours = self.raw.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
        per_hour = self.with_opportunity().groupBy(hour_of("timestamp").alias("hour")).agg(
            share(F.col("occupied_actual")).alias("actual_occ_rate"),
            share(F.col("occupied_pred")).alias("pred_occ_rate"),
            F.avg("hvac_kw").alias("mean_hvac_kw"),
            F.avg("cooling_delta_f").alias("mean_cooling_delta_f"),
            share(F.col("opportunity")).alias("opportunity_rate"),
        )
        return hours.join(F.broadcast(per_hour), "hour", "left")

    def weekly_profile(self) -> DataFrame:
        keys = [dow_mon0("timestamp").alias("day_of_week"), hour_of("timestamp").alias("hour")]
        source = self.rows if "rows" in vars(self) else self.signal
        return source.groupBy(*keys).agg(
            F.avg("cooling_delta_f").alias("expected_cooling_delta_f"),
            F.avg("hvac_kw").alias("expected_hvac_kw"),
            share(F.col("occupied_actual")).alias("occupancy_rate_actual"),
        )

    def recent(self, points: int = 600) -> DataFrame:
        """Timeline of the last days, thinned to ``points`` rows."""
        order = ["timestamp", *([self.tie_breaker] if self.tie_breaker else [])]
        rows = last_days(self.classified, "timestamp", self.settings.recent_days)
        return thin(rows, order, points)

    def forecast(self) -> DataFrame:
        """Expected load, occupancy probability and setback advice per future step."""
        return self._forecast().drop("_step", "_step_us")

    def _forecast(self) -> DataFrame:
        s, last = self.settings, self.extent["last"]
        steps = max(round(float(s.forecast_hours) / self.step), 1) if last is not None else 0
        spark = self.raw.sparkSession
        start = F.lit(None if last is None else last.isoformat(sep=" ")).cast("timestamp_ntz")
        grid = self.with_step(spark.range(steps).withColumnRenamed("id", "slot"))
        grid = grid.withColumn("timestamp", after(start, (F.col("slot") + 1) * F.col("_step_us")))
        grid = grid.withColumns({"day_of_week": dow_mon0("timestamp"), "hour": hour_of("timestamp")})
        # the weekly profile has at most 168 rows
        rows = grid.join(F.broadcast(self.weekly_profile()), ["day_of_week", "hour"], "left")
        spread, limit = F.lit(self.extent["spread"]).cast("double"), self.limit
        z = (F.col("expected_cooling_delta_f") - limit) / spread
        low, high = PROBABILITY_RANGE
        probability = F.when(
            F.col("expected_cooling_delta_f").isNotNull(),
            F.least(F.greatest(1.0 / (1.0 + F.exp(-z)), F.lit(low)), F.lit(high)),
        )
        rows = rows.withColumn("occ_prob_from_temp", probability)
        advise = (F.col("occ_prob_from_temp") <= float(s.occ_prob_threshold)) & (
            F.col("expected_hvac_kw") >= float(s.opportunity_kw)
        )
        rows = rows.withColumn("setback_recommended", F.coalesce(advise, F.lit(False)))
        saved = F.col("expected_hvac_kw") * F.col("_step") * float(s.setback_reduction)
        return rows.withColumn(
            "projected_savings_kwh", F.when(F.col("setback_recommended"), saved).otherwise(F.lit(0.0))
        )

    def windows(self, top: int = 10) -> DataFrame:
        """The ``top`` setback windows by projected savings, earlier start first on ties."""
        return setback_windows(self._forecast(), top)

    def summary(self) -> DataFrame:
        delta, there = F.col("cooling_delta_f"), F.col("occupied_actual")
        one = self.rows.agg(
            F.count(F.lit(1)).cast("bigint").alias("rows"),
            F.min("timestamp").alias("start"), F.max("timestamp").alias("end"),
            F.avg(F.when(there, delta)).alias("occupied_delta_mean_f"),
            F.avg(F.when(~there, delta)).alias("unoccupied_delta_mean_f"),
        )
        rows = self.with_step(one)
        return rows.withColumn("step_minutes", F.col("_step") * 60.0).drop("_step", "_step_us")

    def historical(self) -> DataFrame:
        one = self.with_opportunity().agg(
            (tally(F.col("opportunity")) * F.max("_step")).alias("opportunity_hours"),
            F.sum("avoidable_kwh").alias("estimated_avoidable_kwh"),
            share(F.col("opportunity")).alias("opportunity_rate"),
            (F.sum("hvac_kw") * F.max("_step")).alias("total_hvac_energy_kwh"),
        )
        return one

    def report(self) -> dict[str, DataFrame]:
        """Report sections by name, for ``sinks.write_sections``."""
        s = self.settings
        config = self.threshold.select(
            "threshold_f", *[F.lit(v).alias(k) for k, v in vars(s).items()]
        )
        forecast = self.forecast()
        return {
            "summary": self.summary(), "config": config, "model_metrics": self.metrics(),
            "historical": self.historical(), "recent_timeline": self.recent(),
            "hourly_profile": self.hourly_profile(), "windows": self.windows(),
            "forecast": thin(forecast.withColumn("label", F.date_format("timestamp", "MM-dd HH:mm")), ["slot"], 500),
        }


def confusion_metrics(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Rates from ``tp, tn, fp, fn``; an empty denominator gives 0."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    return counts.select(
        *keys, ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"), specificity.alias("specificity"),
        ((recall + specificity) / 2).alias("balanced_accuracy"),
        ratio(2 * precision * recall, precision + recall).alias("f1"), "tp", "tn", "fp", "fn",
    )


def setback_windows(forecast: DataFrame, top: int = 10) -> DataFrame:
    """Runs of recommended setback, largest savings first.

    ``forecast`` is numbered without holes by ``slot`` and carries the step as
    ``_step`` (hours) and ``_step_us`` (microseconds). A run starts at its first
    slot's own moment.
    """
    sums = ["projected_savings_kwh", "expected_hvac_kw", "occ_prob_from_temp"]
    found = runs(forecast, [], "slot", "setback_recommended", sums, ["timestamp", "_step", "_step_us"])
    rows = found.select(
        F.col("timestamp").alias("start"),
        after("timestamp", F.col("length") * F.col("_step_us")).alias("end"),
        (F.col("length") * F.col("_step")).alias("duration_hours"),
        F.col("projected_savings_kwh_sum").alias("projected_savings_kwh"),
        F.try_divide("expected_hvac_kw_sum", "expected_hvac_kw_n").alias("mean_hvac_kw"),
        F.try_divide("occ_prob_from_temp_sum", "occ_prob_from_temp_n").alias("mean_occ_prob"),
    )
    return rows.orderBy(F.desc("projected_savings_kwh"), "start").limit(top)
