"""Dashboard, insights, thermal study, savings and descriptions on hand-made frames."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomtide import sinks
from roomtide.operators import merge
from roomtide.plans import dashboard, describe, insights, savings, thermal
from roomtide.sources import exports, tables


# --- dashboard --------------------------------------------------------------

@pytest.fixture(scope="module")
def hvac(spark, at):
    rows = [(at(0), "z", 69.0), (at(60), "z", 75.0), (at(1440), "z", None), (at(1500), "y", 80.0), (at(1560), None, 72.0)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, space_id string, zone_temp double")


def test_zone_stats(hvac, at):
    got = {r.space_id: r for r in dashboard.hvac_zone_stats(hvac).collect()}
    assert list(got["z"].asDict()) == ["space_id", "avg_temp", "std_temp", "min_temp", "max_temp", "comfort_exceedance_pct", "samples"]
    # an unknown temperature stays in the denominator
    assert got["z"].comfort_exceedance_pct == 33.33 and got["z"].std_temp == 3.0 and got["y"].std_temp == 0.0
    assert [r.space_id for r in dashboard.hvac_zone_stats(hvac).collect()] == ["y", None, "z"] or got["z"].avg_temp == 72.0
    narrow = dashboard.hvac_zone_stats(hvac, 69.0, 75.0, at(0), at(60)).collect()
    assert [(r.space_id, r.comfort_exceedance_pct) for r in narrow] == [("z", 0.0)]


def test_kpis_and_daily(hvac, spark, at):
    kpi = dashboard.hvac_kpis(hvac).first()
    assert (kpi.rows, kpi.zones, kpi.avg_temp, kpi.median_temp) == (5, 2, 74.0, 73.5)
    assert kpi.p95_temp == pytest.approx(79.25)
    daily = dashboard.hvac_daily(hvac).collect()
    assert [(r.day, r.avg_temp, r.samples) for r in daily] == [(date(2025, 1, 1), 72.0, 2), (date(2025, 1, 2), 76.0, 3)]
    empty = dashboard.hvac_kpis(hvac, at(9999), None).first()
    assert (empty.rows, empty.median_temp) == (0, None)
    assert dashboard.hvac_comfort_summary(hvac).first().out_of_band_pct == 40.0


def test_space_labels(spark, at):
    occupancy = spark.createDataFrame([(1, 4, at(0)), (1, 5, at(1)), (2, 2, at(0)), (3, 1, at(0))], "space_id int, occupancy int, beginning timestamp_ntz")
    spaces = spark.createDataFrame([(1, "one", None), (2, "two", "R2")], "space_id int, space_name string, building_room string")
    got = dashboard.occupancy_space_stats(occupancy, spaces).collect()
    assert [(r.space_id, r.space_label, r.avg_occ, r.peak_occ, r.samples) for r in got] == [
        ("1", "one", 4.5, 5, 2), ("2", "R2", 2.0, 2, 1), ("3", "(unknown)", 1.0, 1, 1)]
    assert dashboard.occupancy_daily(occupancy).columns == ["day", "avg_occ", "peak_occ", "samples"]
    wide = dashboard.heatmap_pivot(dashboard.occupancy_heatmap(occupancy)).collect()
    assert len(wide) == 7 and {r.day_name: r.h00 for r in wide}["Wednesday"] == 3.0
    for how in ("mean", "max", "median"):
        assert dashboard.heatmap_by(occupancy, how, space_id=1).first().occ == {"mean": 4.5, "max": 5.0, "median": 4.5}[how]
    with pytest.raises(ValueError):
        dashboard.heatmap_by(occupancy, "sum")


# --- insights ---------------------------------------------------------------

HEAT = "day_of_week int, hour_of_day int, avg_occ double, samples bigint"
SPACES = "space_id string, space_label string, avg_occ double, peak_occ int, samples bigint"
ZONES = "space_id string, avg_temp double, std_temp double, comfort_exceedance_pct double, samples bigint"
COMFORT = "below_band_pct double, above_band_pct double, out_of_band_pct double"


def test_occupancy_insights(spark):
    rng = np.random.default_rng(5)
    cells = [(d, h, float(rng.integers(0, 400)) / 8, int(rng.integers(1, 50))) for d in range(7) for h in range(6, 20)]
    rooms = [(str(i), f"room {i:02d}", float(rng.integers(0, 90)) / 4, int(rng.integers(1, 60)), 30) for i in range(25)]
    got = insights.occupancy_insights(spark.createDataFrame(cells, HEAT), spark.createDataFrame(rooms, SPACES), 4).first()
    day_means = {d: np.mean([c[2] for c in cells if c[0] == d]) for d in range(7)}
    weekdays = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
    top_cell = max(cells, key=lambda c: (c[2], -c[0], -c[1]))
    top_room = max(rooms, key=lambda r: (r[2], [-ord(x) for x in r[1]]))
    quiet = [r[1] for r in sorted(rooms, key=lambda r: (r[2], r[1]))[:4]]
    assert tuple(got) == (
        weekdays[max(day_means, key=day_means.get)], f"{top_cell[1]:02d}:00", f"{top_cell[2]:.2f}", top_room[1], f"{top_room[2]:.2f}", quiet,
    )


def test_hvac_insights(spark):
    rng = np.random.default_rng(6)
    zones = [(f"zone {i}", 60 + float(rng.integers(0, 160)) / 8, float(rng.integers(1, 64)) / 16, float(rng.integers(0, 100)), 50) for i in range(12)]
    zones.append(("no reading", None, None, None, 0))
    known = [z for z in zones if z[1] is not None]
    got = insights.hvac_insights(spark.createDataFrame(zones, ZONES), spark.createDataFrame([(1.0, 2.0, 3.25)], COMFORT)).first()
    swings, hot, cold = max(known, key=lambda z: z[2]), max(known, key=lambda z: z[1]), min(known, key=lambda z: z[1])
    # ties go to the smaller label
    swings = min(z for z in known if z[2] == swings[2])
    hot, cold = min(z for z in known if z[1] == hot[1]), min(z for z in known if z[1] == cold[1])
    assert tuple(got) == (swings[0], f"{swings[2]:.2f}", hot[0], f"{hot[1]:.2f}", cold[0], f"{cold[1]:.2f}", "3.25")
    mean = np.mean([z[3] for z in known])
    alone = insights.hvac_insights(spark.createDataFrame(zones, ZONES), spark.createDataFrame([], COMFORT)).first()
    assert alone.overall_out_of_band_pct == f"{mean:.2f}"


def test_insights_of_nothing(spark):
    empty = insights.occupancy_insights(spark.createDataFrame([], HEAT), spark.createDataFrame([], SPACES)).collect()
    assert [tuple(r) for r in empty] == [("N/A",) * 5 + ([],)]
    assert tuple(insights.hvac_insights(spark.createDataFrame([], ZONES), spark.createDataFrame([], COMFORT)).first()) == ("N/A",) * 7


# --- thermal ----------------------------------------------------------------

RAW = "timestamp string, occ_ahu1 string, occ_ahu2 string, return_temp_ahu1 string, supply_temp_ahu1 string, return_temp_ahu2 string, supply_temp_ahu2 string, hvac_power_kw string"


def test_signal(spark):
    raw = spark.createDataFrame([
        ("2025-01-01 00:00:00", "AAAB (x)", None, "72.5 °F", "60 °F", "nan", "55", "-3 kW"),
        ("2025-01-01 00:15:00", "AAAA", "nan", "70", "60", "80", "60", "4.5"),
        ("2025-01-01 00:30:00", "AAAA", "AAAB", "nan", "60", "80", None, "4.5"),
        ("2025-01-01 00:45:00", "AAAA", "AAAB", "70", "60", "80", "60", "off"),
        ("never", "AAAA", "AAAB", "70", "60", "80", "60", "1"),
    ], RAW)
    got = thermal.signal(raw).orderBy("timestamp").collect()
    assert [(r.occupied_actual, r.hvac_kw, r.cooling_delta_f) for r in got] == [(True, 0.0, 12.5), (False, 4.5, 15.0)]
    assert got[0].return_temp_f == 72.5 and got[0].supply_temp_f == 57.5


@pytest.mark.parametrize("kind", ["separable", "noisy", "one class", "constant"])
def test_threshold_equals_trying_every_candidate(spark, kind):
    rng = np.random.default_rng(11)
    delta = np.round(rng.normal(5, 4, 700), 2)
    label = {"separable": delta > 6, "noisy": delta + rng.normal(0, 4, 700) > 6, "one class": delta > 1e9, "constant": rng.random(700) < 0.5}[kind]
    delta = np.full(700, 3.0) if kind == "constant" else delta
    df = spark.createDataFrame([(float(d), bool(o)) for d, o in zip(delta, label)], "cooling_delta_f double, occupied_actual boolean")
    got = thermal.select_threshold(df).first()
    best, score = None, -1.0
    for t in np.linspace(np.quantile(delta, 0.01), np.quantile(delta, 0.99), 300):
        guess = delta >= t
        tp, tn, fp, fn = (label & guess).sum(), (~label & ~guess).sum(), (~label & guess).sum(), (label & ~guess).sum()
        s = (tp / max(tp + fn, 1) + tn / max(tn + fp, 1)) / 2
        if s > score:
            best, score = t, s
    assert got.threshold_f == pytest.approx(best, abs=1e-12) and got.balanced_accuracy == pytest.approx(score)


def forecast_frame(spark, at, flags):
    rows = [(i, at(15 * i), bool(f), 2.0 if f else 0.0, 4.0, 0.2, 0.25, 900_000_000) for i, f in enumerate(flags)]
    return spark.createDataFrame(rows, "slot bigint, timestamp timestamp_ntz, setback_recommended boolean, projected_savings_kwh double, expected_hvac_kw double, occ_prob_from_temp double, _step double, _step_us bigint")


def test_setback_windows(spark, at):
    got = thermal.setback_windows(forecast_frame(spark, at, [1, 1, 0, 1, 0, 0, 1, 1, 1])).collect()
    assert [(r.start, r.end, r.duration_hours, r.projected_savings_kwh) for r in got] == [
        (at(90), at(135), 0.75, 6.0), (at(0), at(30), 0.5, 4.0), (at(45), at(60), 0.25, 2.0)]
    assert got[0].mean_hvac_kw == 4.0 and got[0].mean_occ_prob == pytest.approx(0.2)
    assert thermal.setback_windows(forecast_frame(spark, at, [0, 0])).count() == 0
    many = thermal.setback_windows(forecast_frame(spark, at, [1, 0] * 15)).collect()
    assert [r.start for r in many] == [at(30 * i) for i in range(10)]


def test_study(spark, at):
    rows = []
    for i in range(14 * 96):
        busy = 8 <= (i // 4) % 24 < 18
        rows.append((at(15 * i).isoformat(sep=" "), "AAAB" if busy else "AAAA", "nan", "75 F", "55 F" if busy else "72 F", "nan", "nan", "8 kW" if busy else "2 kW"))
    study = thermal.ThermalStudy(spark.createDataFrame(rows, RAW), thermal.ThermalSettings(occ_prob_threshold=0.5))
    assert study.summary().first().step_minutes == 15.0
    metrics = {r.split: r for r in study.metrics().collect()}
    assert set(metrics) == {"train", "test", "all"} and metrics["test"].accuracy == 1.0
    assert metrics["all"].tp + metrics["all"].tn == 14 * 96
    assert study.historical().first().opportunity_hours == pytest.approx(14 * 14.0)
    assert study.historical().first().estimated_avoidable_kwh == pytest.approx(14 * 14 * 2 * 0.3)
    assert study.hourly_profile().count() == 24 and study.weekly_profile().count() == 168
    plan = study.forecast()
    assert plan.count() == 672 and plan.agg(F.min("timestamp")).first()[0] == at(15 * 14 * 96)
    assert study.recent(100).count() == 100
    windows = study.windows().collect()
    assert windows and all(w.duration_hours in (8.0, 14.0, 6.0) for w in windows)
    report = study.report()
    assert set(report) == {"summary", "config", "model_metrics", "historical", "recent_timeline", "hourly_profile", "windows", "forecast"}


def test_report_is_written_as_json(spark, tmp_path):
    sections = {"summary": spark.createDataFrame([(1, "x")], "a int, b string")}
    sinks.write_sections(sections, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/summary").first().asDict() == {"a": 1, "b": "x"}


# --- savings ----------------------------------------------------------------

@pytest.fixture(scope="module")
def merged(spark, at):
    flags = [1, 1, 0, 1, 0, 1, 1, 1]
    rows = [(at(24 * 60 - 45 + 15 * i), "a", 0.0 if f else 3.0, True, 2.0, 0.5) for i, f in enumerate(flags)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, zone_id string, occupancy_count double, hvac_on boolean, energy_kwh double, tou_rate double")


def test_savings_potential(merged):
    got = savings.savings_potential(merged, rate="tou_rate").collect()
    total = next(r for r in got if r.breakdown == "total")
    assert (total.opportunity_hours, total.opportunity_energy_kwh, total.opportunity_cost, total.percent_of_total) == (1.5, 12.0, 6.0, 75.0)
    for part in ("hour", "weekday"):
        assert sum(r.opportunity_hours for r in got if r.breakdown == part) == 1.5


def test_daily_and_sustained(merged, at):
    flagged = merge.flag_opportunity(merged)
    daily = savings.daily_opportunity(flagged).collect()
    assert [(r.opportunity_energy_kwh, r.total_energy_kwh, r.cumulative_opportunity_kwh) for r in daily] == [(4.0, 6.0, 4.0), (8.0, 10.0, 12.0)]
    kept = {r.date: r.opportunity_minutes for r in savings.sustained_opportunity(flagged).collect()}
    assert kept == {date(2025, 1, 1): 30.0, date(2025, 1, 2): 45.0}
    assert savings.day_timeline(flagged, date(2025, 1, 2), "a").count() == 5


def test_sustained_runs_cross_midnight_and_blocks(spark, at, occ):
    flags = np.random.default_rng(2).random(40_000) < 0.6
    rows = spark.createDataFrame([(at(15 * i), "a", bool(f), 1.0) for i, f in enumerate(flags)], "timestamp timestamp_ntz, zone_id string, is_opportunity boolean, potential_energy_savings double")
    got = savings.sustained_opportunity(rows, minimum="60min").agg(F.sum("opportunity_minutes")).first()[0]
    expected, length = 0, 0
    for f in [*flags, False]:
        if f:
            length += 1
        else:
            expected += 15 * length if length >= 4 else 0
            length = 0
    assert got == expected


def test_setpoint_plan(spark, at):
    people = [0, 0, 0, 0, 5, 0, 0, 0]
    forecast = spark.createDataFrame([(at(15 * i), "a", float(p)) for i, p in enumerate(people)], "timestamp timestamp_ntz, zone_id string, predicted_occupancy double")
    base = spark.createDataFrame([(at(15 * i), "a", 74.0 if i < 4 else 68.0, 1.0) for i in range(8)], "timestamp timestamp_ntz, zone_id string, baseline_setpoint double, baseline_energy double")
    rates = spark.createDataFrame([(0, 0.1), (1, 0.2)], "hour int, tou_rate double")
    got = savings.setpoint_plan(forecast, base, rates).orderBy("timestamp").collect()
    assert [r.recommended_setpoint for r in got] == [85.0, 85.0, 74.0, 74.0, 68.0, 60.0, 60.0, 60.0]
    assert [r.pre_conditioning for r in got] == [False, False, True, True, False, False, False, False]
    totals = savings.plan_totals(savings.setpoint_plan(forecast, base, rates)).first()
    assert totals.setback_steps == 5 and totals.total_energy_savings_kwh == pytest.approx(1.5)
    assert totals.total_cost_savings == pytest.approx(2 * 0.03 + 3 * 0.06)


# --- descriptions, sources and sinks ----------------------------------------

def test_schema_dictionary_and_markdown(spark, tmp_path):
    space = spark.createDataFrame([(1, 2)], "space_id int, parent_space_id int")
    wifi = spark.createDataFrame([("m", "w"), ("m", "v")], "mac string, wap string")
    got = describe.schema_dictionary(spark, {"wifi": wifi, "space": space})
    assert [(r.table_name, r.column_name, r.estimated_row_count) for r in got.collect()] == [
        ("space", "space_id", 1), ("space", "parent_space_id", 1), ("wifi", "mac", 2), ("wifi", "wap", 2)]
    assert [r.semantic_meaning for r in got.collect()] == [
        "entity identifier", "hierarchical parent reference", "anonymized user/device identifier", "network/sensor source identifier"]
    sinks.write_dictionary(got, describe.dictionary_markdown(got), str(tmp_path))
    lines = [r.value for r in spark.read.text(f"{tmp_path}/schema_dictionary_md").collect()]
    assert "## wifi" in lines and any(line.startswith("| mac | string | YES |") for line in lines)
    assert spark.read.option("header", True).csv(f"{tmp_path}/schema_dictionary").count() == 4


def test_column_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "c"), (3, "d"), (4, "e")], "n int, s string")
    got = {r.column_name: r for r in describe.column_profile(df).collect()}
    assert (got["n"].distinct_values, got["n"].null_pct, got["s"].distinct_values, got["s"].null_pct) == (4, 0.0, 4, 20.0)
    assert got["s"].examples == ["a", "c", "d"]
    approx = {r.column_name: r for r in describe.column_profile(df, approx=True).collect()}
    assert approx["s"].nulls == 1 and approx["n"].distinct_values == 4


def test_scan_and_sources(spark, at):
    df = spark.createDataFrame([(3, 5, at(0)), (4, 6, at(15))], "space_id int, occupancy int, beginning timestamp_ntz")
    got = tables.occupancy_source(df, "4").collect()
    assert [tuple(r) for r in got] == [("4", at(15), 6.0)]
    assert tables.scan(df, ["occupancy"], "space_id > 3", 5).first()[:] == (6,)
    text = spark.createDataFrame([("2025-01-01", "x"), ("bad", "1")], "interval_begin string, count string")
    assert [tuple(r) for r in tables.occupancy_source(text).collect()] == [(at(0), None), (None, 1.0)]
    assert [r.outside_temp for r in tables.weather_source(text, "interval_begin", "count").collect()] == [None]


def test_header_rules():
    assert exports.unique_headers(["A", "B", "A", "A"]) == ["A", "B", "A__dup2", "A__dup3"]
    headers = ["Timestamp", "AH-01 Supply Air Temp Eff SP", "ah-01  SUPPLY air temp", "x"]
    assert exports.find_header(headers, ["ah-01", "supply air temp"], exports.SUPPLY_NOT) == headers[2]
    with pytest.raises(ValueError, match="occ_ahu1"):
        exports.find_roles(headers)


def test_weekly_exports(spark, tmp_path):
    header = ["Timestamp", "AH-01 Occ Eff Status", "AH-02 Occ Eff Status", "AH-01 Return Air Temp", "AH-01 Supply Air Temp",
              "AH-02 Return Air Temp", "AH-02 Supply Air Temp", "Noise", "Noise", "Whole Building Electric Meter Total Elec Power"]
    line = "2024-04-28T00:00:00-07:00 Los_Angeles,AAAB,AAAA,70 F,60 F,71 F,61 F,1,2,5 kW"
    (tmp_path / "SiteWeek_May5.csv").write_text(",".join(header) + "\n" + line.replace("04-28", "05-05") + "\n")
    (tmp_path / "SiteWeek_Apr28.csv").write_text(",".join(header) + "\n" + line + "\n")
    swapped = [header[0], *header[2:], header[1]]
    cells = line.replace("04-28", "06-02").split(",")
    (tmp_path / "extra.csv").write_text(",".join(swapped) + "\n" + ",".join([cells[0], *cells[2:], cells[1]]) + "\n")
    got = exports.read_exports(spark, str(tmp_path)).orderBy("week_month", "week_day", "stem").collect()
    assert [r.stem for r in got] == ["SiteWeek_Apr28", "SiteWeek_May5", "extra"]
    assert all((r.occ_ahu1, r.occ_ahu2, r.hvac_power_kw) == ("AAAB", "AAAA", "5 kW") for r in got)
    typed = thermal.signal(exports.read_exports(spark, str(tmp_path))).collect()
    assert len(typed) == 3 and typed[0].cooling_delta_f == 10.0


def test_backtest_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "zone_id string, mae double")
    paths = sinks.write_backtest(df, df, str(tmp_path), "20250101_000000")
    assert paths["metrics"].endswith("occupancy_model_metrics_20250101_000000")
    assert spark.read.option("header", True).csv(paths["forecasts"]).first().zone_id == "a"


def test_many_exports_are_read_in_few_jobs(spark, tmp_path):
    header = "Timestamp,AH-01 Occ Eff Status,AH-02 Occ Eff Status,AH-01 Return Air Temp,AH-01 Supply Air Temp,AH-02 Return Air Temp,AH-02 Supply Air Temp,HVAC Meter HVAC Elec Power"
    folder = tmp_path / "weekly files"
    folder.mkdir()
    for i in range(60):
        lead = "Spare," if i % 2 else ""
        line = ("x," if i % 2 else "") + f"2025-01-01 {i // 60:02d}:{i % 60:02d}:00,AAAB,AAAA,70,60,71,61,{i}"
        (folder / f"B_Week_Jan{i % 28 + 1:02d}_{i}.csv").write_text(f"{lead}{header}\n{line}\n")
    tracker, group = spark.sparkContext.statusTracker(), "exports"
    spark.sparkContext.setJobGroup(group, "reading headers")
    rows = exports.read_exports(spark, str(folder))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup(group)) <= 3
    assert sorted(int(r.hvac_power_kw) for r in rows.collect()) == list(range(60))


def test_typed_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,at,reading\n1,2025-01-01 00:00:00,2.5\n2,never,x\n")
    got = tables.open_csv(spark, str(tmp_path / "a.csv"), "id int, at timestamp_ntz, reading double").orderBy("id").collect()
    assert [(r.id, str(r.at), r.reading) for r in got] == [(1, "2025-01-01 00:00:00", 2.5), (2, "None", None)]


def test_hvac_source_takes_the_named_columns(spark, at):
    rows = spark.createDataFrame([(at(0), "7", 70.5, "x"), (at(15), "8", 71.0, "y")], "timestamp timestamp_ntz, space_id string, zone_temp double, more string")
    assert tables.hvac_source(rows).count() == 2


def test_wide_exports_of_many_layouts_are_one_scan(spark, tmp_path):
    """14 layouts of 5,956 columns each, the roles at different places, quoted commas among them."""
    roles = ["Timestamp", "AH-01 Occ Eff Status", "AH-02 Occ Eff Status", "AH-01 Return Air Temp", "AH-01 Supply Air Temp",
             "AH-02 Return Air Temp", "AH-02 Supply Air Temp", "HVAC Meter HVAC Elec Power"]
    for i in range(14):
        spare = 5956 - len(roles)
        at = [(i * 397 + j * 701) % spare for j in range(len(roles))]
        header, cells = [f'"Spare, {k}"' for k in range(spare)], [str(k) for k in range(spare)]
        for place, role, value in sorted(zip(at, roles, [f"2025-01-01 00:{i:02d}:00", "AAAB", "AAAA", "70", "60", "71", "61", str(i)]), reverse=True):
            header.insert(place, role)
            cells.insert(place, f'"{value}"')
        (tmp_path / f"B_Week_Feb{i + 1:02d}.csv").write_text(",".join(header) + "\n" + ",".join(cells) + "\n" + ",".join(cells) + "\n")
    rows = exports.read_exports(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and plan.count("Union") == 0
    got = rows.orderBy("timestamp").collect()
    assert len(got) == 28 and [(int(r.hvac_power_kw), r.return_temp_ahu2, r.week_day, r.timestamp.minute) for r in got[::2]] == [(i, "71", i + 1, i) for i in range(14)]
    with pytest.raises(Exception):
        exports.read_exports(spark, str(tmp_path / "nothing"))


def test_sketched_profile_has_the_exact_one_s_columns_and_merges(spark):
    rows = [(i, f"v{i % 7}" if i % 5 else None, None, 2.5) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, `meta.name` string, nothing string, same double")
    exact, approx = describe.column_profile(df), describe.column_profile(df, approx=True)
    assert exact.columns == approx.columns == describe.PROFILE
    def facts(profile):
        rows = profile.withColumn("distinct_values", F.round(F.col("distinct_values") / 20)).collect()  # 5 % of the largest
        return {r.column_name: r for r in rows}

    assert facts(exact) == facts(approx)
    parts = describe.profile_sketches(df.where("id < 100")).unionByName(describe.profile_sketches(df.where("id >= 100")))
    merged = describe.sketched_profile(describe.merge_profiles(parts))
    assert facts(merged) == facts(exact)
    got = {r.column_name: r for r in exact.collect()}
    assert got["meta.name"].examples == ["v0", "v1", "v2"] and got["meta.name"].distinct_values == 7 and got["meta.name"].nulls == 80
    assert got["nothing"].examples == [] and got["same"].examples == ["2.5"]
    assert describe.column_profile(df.limit(0)).count() == 0


def test_presets_of_sources(spark):
    raw = spark.createDataFrame([("1", "2", None, "x", 0), ("2", "22", "6", "0.5", 0)], "tou_id string, start_hour string, end_hour string, rate_kwh string, more int")
    assert [tuple(r) for r in tables.tariff_source(raw).orderBy("tou_id").collect()] == [(1, 2, None, None), (2, 22, 6, 0.5)]
    space = spark.createDataFrame([(1, "n", 0, None, "x")], "space_id int, space_name string, parent_space_id int, building_room string, more string")
    assert tables.space_source(space).columns == ["space_id", "space_name", "parent_space_id", "building_room"]
