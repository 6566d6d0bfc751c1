"""DuckDB SQL that answers the registered queries independently."""

from __future__ import annotations

from roomtide.catalog.queries import EXAMPLE_DAY, EXAMPLE_ZONE, PLAN_RANGE, PLAN_THRESHOLD, RANGE, TABLES, THERMAL
from roomtide.functions.scalars import NUMBER_PATTERN, WEEKDAY_LABELS
from roomtide.sources.demo import TARIFF_ROWS


def r(expr: str, places: int = 6) -> str:
    return f"cast(round(cast({expr} as decimal(38,10)), {places}) as double)"


def r2(expr: str) -> str:
    return r(expr, 2)


def first_number(c: str) -> str:
    return f"try_cast(regexp_extract({c}, '{NUMBER_PATTERN}', 1) as double)"


STEP = "interval 15 minute"
ROWS_BACK = "rows between unbounded preceding and current row"
ROWS_AHEAD = "rows between current row and unbounded following"
MINUTE = "cast(extract(hour from {0}) * 60 + extract(minute from {0}) as int)"
DOW0 = "cast(extract(isodow from {0}) - 1 as int)"
HOUR = "cast(extract(hour from {0}) as int)"


def minute(c):
    return MINUTE.format(c)


def dow(c):
    return DOW0.format(c)


def hour(c):
    return HOUR.format(c)


# name -> (parents, body); `cte` resolves parents in order
PARTS: dict[str, tuple[list[str], str]] = {
    "v_occ": ([], "select ts as timestamp, event_type as zone_id, cast(floor(value/10) as double) as occupancy_count from events"),
    "v_space_occ": ([], "select cast(user_id % 30 as int) as space_id, cast(floor(value/10) as int) as occupancy, ts as beginning from events"),
    "v_space": ([], "select n_nationkey as space_id, n_name as space_name, n_regionkey as parent_space_id, cast(null as varchar) as building_room from nation"),
    "v_hvac": ([], "select ts as timestamp, event_type as space_id, 60 + value/5 as zone_temp from events"),
    "v_state": ([], """select ts as timestamp, event_type as space_id, 60 + value/5 as zone_temp,
        case when user_id % 3 = 0 then 'Off' when user_id % 3 = 1 then 'Cool' else 'Heat' end as hvac_mode,
        value/10 as energy_kwh from events"""),
    "v_weather": ([], "select date_trunc('hour', ts) as timestamp, avg(value) as outside_temp from events where event_type = 'view' group by 1"),
    "v_tou": ([], "select * from (values " + ", ".join(map(str, TARIFF_ROWS)) + ") t(tou_id, start_hour, end_hour, rate_kwh)"),
    "v_bms": ([], """select event_id, ts as timestamp,
        case when event_type in ('purchase','signup') then 'AAAB (occ)' else 'AAAA' end as occ_ahu1,
        case when user_id % 10 = 0 then 'AAAB' else 'nan' end as occ_ahu2,
        concat(cast(cast(value as decimal(12,2)) as varchar), ' F') as return_temp_ahu1,
        props as supply_temp_ahu1,
        case when user_id % 7 = 0 then 'nan' else concat(cast(cast(value + user_id % 5 as decimal(12,2)) as varchar), ' F') end as return_temp_ahu2,
        concat(cast(user_id % 60 as varchar), ' F') as supply_temp_ahu2,
        concat(cast(cast(value - 10 as decimal(12,2)) as varchar), ' kW') as hvac_power_kw from events"""),
    # dashboard
    "heat": (["v_space_occ"], f"""select cast(extract(dow from beginning) as int) as day_of_week, {hour('beginning')} as hour_of_day,
        {r2('avg(occupancy)')} as avg_occ, count(*) as samples from v_space_occ group by 1, 2"""),
    "spaces": (["v_space_occ", "v_space"], f"""select cast(o.space_id as varchar) as space_id,
        coalesce(s.building_room, s.space_name, '(unknown)') as space_label, {r2('avg(o.occupancy)')} as avg_occ,
        max(o.occupancy) as peak_occ, count(*) as samples
        from v_space_occ o left join v_space s on s.space_id = o.space_id group by o.space_id, 2"""),
    "daily": (["v_space_occ"], f"""select cast(beginning as date) as day, {r2('avg(occupancy)')} as avg_occ,
        max(occupancy) as peak_occ, count(*) as samples from v_space_occ group by 1"""),
    "zones": (["v_hvac"], f"""select space_id, {r2('avg(zone_temp)')} as avg_temp, {r2('stddev_pop(zone_temp)')} as std_temp,
        {r2('min(zone_temp)')} as min_temp, {r2('max(zone_temp)')} as max_temp,
        {r2('100.0::double * avg(case when zone_temp < 70.0 or zone_temp > 76.0 then 1.0::double else 0.0::double end)')} as comfort_exceedance_pct,
        count(*) as samples from v_hvac group by space_id"""),
    "comfort": (["v_hvac"], "select " + ", ".join(
        f"{r2(f'100.0::double * avg(case when {cond} then 1.0::double else 0.0::double end)')} as {name}"
        for name, cond in [("below_band_pct", "zone_temp < 70.0"), ("above_band_pct", "zone_temp > 76.0"),
                           ("out_of_band_pct", "zone_temp < 70.0 or zone_temp > 76.0")]) + " from v_hvac"),
    # preparation
    "norm": (["v_occ"], "select timestamp, zone_id, avg(occupancy_count) as occupancy_count from v_occ group by 1, 2"),
    "floored": (["norm"], f"select time_bucket({STEP}, timestamp) as timestamp, zone_id, avg(occupancy_count) as occupancy_count from norm group by 1, 2"),
    "hourly_occ": (["norm"], "select date_trunc('hour', timestamp) as timestamp, zone_id, avg(occupancy_count) as occupancy_count from norm group by 1, 2"),
    "equip": (["v_state"], f"""select time_bucket({STEP}, timestamp) as timestamp, space_id as zone_id,
        arg_min(zone_temp, timestamp) as zone_temp, arg_min(hvac_mode, timestamp) as hvac_mode,
        arg_min(energy_kwh, timestamp) as energy_kwh,
        arg_min(coalesce(lower(hvac_mode) <> 'off', true), timestamp) as hvac_on from v_state group by 1, 2"""),
    "merged": (["floored", "equip"], "select * from floored join equip using (timestamp, zone_id)"),
    "merged_left": (["floored", "equip"], "select * from floored left join equip using (timestamp, zone_id)"),
    "flagged": (["merged"], """select *, (coalesce(occupancy_count, 0) <= 0 and coalesce(hvac_on, true)) as is_opportunity,
        case when coalesce(occupancy_count, 0) <= 0 and coalesce(hvac_on, true) then coalesce(energy_kwh, 0) else 0 end as potential_energy_savings
        from merged"""),
    "rates": (["v_tou"], """select cast(h as int) as hour, arg_max(rate_kwh, tou_id)::double as tou_rate from v_tou, range(24) t(h)
        where case when start_hour <= end_hour then h >= start_hour and h < end_hour else h >= start_hour or h < end_hour end group by 1"""),
    "spans": (["floored"], "select zone_id, min(timestamp) as a, max(timestamp) as b from floored group by 1"),
    "grid": (["spans"], f"select zone_id, unnest(generate_series(a, b, {STEP})) as timestamp from spans"),
    "dense": (["grid", "floored"], """select g.zone_id, g.timestamp, greatest(coalesce(f.occupancy_count, 0), 0)::double as occupancy_count,
        row_number() over (partition by g.zone_id order by g.timestamp) - 1 as slot, count(*) over (partition by g.zone_id) as slots
        from grid g left join floored f using (zone_id, timestamp)"""),
    "wslots": (["v_weather"], f"select time_bucket({STEP}, timestamp) as t, avg(outside_temp) as x from v_weather group by 1"),
    "wgrid": (["wslots"], f"select unnest(generate_series(min(t), max(t), {STEP})) as t from wslots"),
    "wmarks": (["wgrid", "wslots"], f"""select t, x, last_value(x ignore nulls) over (order by t {ROWS_BACK}) as pv,
        last_value(case when x is not null then epoch(t) end ignore nulls) over (order by t {ROWS_BACK}) as pt,
        first_value(x ignore nulls) over (order by t {ROWS_AHEAD}) as nv,
        first_value(case when x is not null then epoch(t) end ignore nulls) over (order by t {ROWS_AHEAD}) as nt
        from wgrid left join wslots using (t)"""),
    "wline": (["wmarks"], """select t as timestamp, coalesce(x, pv + (nv - pv) * case when nt > pt then (epoch(t) - pt) / (nt - pt) end, pv, nv) as outside_temp from wmarks"""),
    # hourly
    "hsum": (["v_occ"], "select date_trunc('hour', timestamp) as timestamp, sum(occupancy_count) as s from v_occ group by 1"),
    "hgrid": (["hsum"], "select unnest(generate_series(min(timestamp), max(timestamp), interval 1 hour)) as timestamp from hsum"),
    "hours": (["hgrid", "hsum"], "select timestamp, coalesce(s, 0)::double as occupancy from hgrid left join hsum using (timestamp)"),
    # forecasting
    "frame": (["dense"], "select zone_id, timestamp as ds, occupancy_count as y, slot - 96 as pos, slots - 96 as n from dense where slot >= 96"),
    "train": (["frame"], "select * from frame where pos < floor(n * 0.8::double)"),
    "test": (["frame"], "select * from frame where pos >= floor(n * 0.8::double)"),
    "profile": (["train"], f"select zone_id, {dow('ds')} as dow, {minute('ds')} as minute, avg(y) as expected, count(*) as rows from train group by 1, 2, 3"),
    "level": (["train"], "select zone_id, avg(y) as zone_mean from train group by 1"),
    "pairs": (["test", "profile", "level"], f"""select t.zone_id, t.ds, t.y, greatest(coalesce(p.expected, l.zone_mean, 0), 0) as yhat
        from test t left join profile p on p.zone_id = t.zone_id and p.dow = {dow('t.ds')} and p.minute = {minute('t.ds')}
        left join level l on l.zone_id = t.zone_id"""),
    "counted": (["pairs"], """select zone_id, count(*) as n, avg(abs(y - yhat)) as mae,
        count(*) filter (y > 0 and yhat >= 1) as tp, count(*) filter (y <= 0 and yhat < 1) as tn,
        count(*) filter (y <= 0 and yhat >= 1) as fp, count(*) filter (y > 0 and yhat < 1) as fn from pairs group by 1"""),
    "scored": (["counted"], """select zone_id, n, mae, (tp + tn) / n::double as acc,
        case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as pr,
        case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as re from counted"""),
    "backtest": (["spans", "frame", "scored"], """select s.zone_id, case when f.n is not null and floor(f.n * (1.0::double - 0.2::double)) between 1 and f.n - 1 then 'ok' else 'insufficient_data' end as status,
        coalesce(acc, 0) as acc, coalesce(pr, 0) as pr, coalesce(re, 0) as re,
        coalesce(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end, 0) as f1, mae, coalesce(c.n, 0) as n_eval
        from spans s left join (select distinct zone_id, n from frame) f using (zone_id) left join scored c using (zone_id)"""),
    "horizon": (["train"], "select zone_id, max(ds) as last from train group by 1"),
    # thermal
    "parsed": (["v_bms"], f"""select event_id, timestamp,
        substr(occ_ahu1, 1, 4) = 'AAAB' or substr(occ_ahu2, 1, 4) = 'AAAB' as occ,
        {first_number('return_temp_ahu1')} as r1, {first_number('supply_temp_ahu1')} as s1,
        {first_number('return_temp_ahu2')} as r2, {first_number('supply_temp_ahu2')} as s2,
        greatest({first_number('hvac_power_kw')}, 0) as kw from v_bms"""),
    "sig": (["parsed"], """select event_id, timestamp, occ, kw, r1 - s1 as d1, r2 - s2 as d2,
        coalesce(((r1 - s1) + (r2 - s2)) / 2, r1 - s1, r2 - s2) as d, coalesce((r1 + r2) / 2, r1, r2) as rt,
        coalesce((s1 + s2) / 2, s1, s2) as st from parsed where coalesce(r1 - s1, r2 - s2) is not null and kw is not null"""),
    "step": (["sig"], "select quantile_cont(gap, 0.5) / 3600.0 as h, cast(round_even(quantile_cont(gap, 0.5) * 1e6, 0) as bigint) as us from (select (epoch_us(timestamp) - lag(epoch_us(timestamp)) over (order by timestamp)) / 1e6 as gap from sig)"),
    "ranked": (["sig"], "select *, row_number() over (order by timestamp, event_id) <= greatest(floor(count(*) over () * 0.8::double), 1) as is_train from sig"),
    "qs": (["ranked"], "select quantile_cont(d, 0.01) as lo, quantile_cont(d, 0.99) as hi from ranked where is_train"),
    "cands": (["qs"], "select i, case when i = 299 then hi else lo + i * ((hi - lo) / 299.0::double) end as t from qs, range(300) c(i)"),
    "cscore": (["cands", "ranked"], """select i, t, (tp / greatest(p, 1)::double + (n - fp) / greatest(n, 1)::double) / 2 as s from (
        select i, t, count(*) filter (occ and d >= t) as tp, count(*) filter (not occ and d >= t) as fp,
        count(*) filter (occ) as p, count(*) filter (not occ) as n from cands, ranked where is_train group by i, t)"""),
    "thr": (["cscore"], "select t as threshold_f, s as balanced_accuracy from cscore order by s desc, i limit 1"),
    "cls": (["ranked", "thr", "step"], """select ranked.*, d >= threshold_f as pred, not (d >= threshold_f) and kw >= 0.5 as opp,
        case when not (d >= threshold_f) and kw >= 0.5 then kw * h * 0.3 else 0 end as saved, h from ranked, thr, step"""),
    "weekly": (["sig"], f"""select {dow('timestamp')} as day_of_week, {hour('timestamp')} as hour, avg(d) as expected_cooling_delta_f,
        avg(kw) as expected_hvac_kw, avg(case when occ then 1.0::double else 0.0::double end) as occupancy_rate_actual from sig group by 1, 2"""),
    "fgrid": (["sig", "step"], """select unnest(range(cast(greatest(round_even(168.0 / h, 0), 1) as bigint))) as slot, last, us, h
        from (select max(timestamp) as last from sig), step"""),
    "fts": (["fgrid"], "select slot, us, h, last + to_microseconds((slot + 1) * us) as timestamp from fgrid"),
    "spread": (["sig"], "select greatest(stddev_samp(d) / 4.0, 0.45) as w from sig"),
    "fprob": (["fts", "weekly", "thr", "spread"], f"""select slot, us, h, timestamp, {dow('timestamp')} as day_of_week, {hour('timestamp')} as hour,
        expected_cooling_delta_f, expected_hvac_kw, occupancy_rate_actual,
        case when expected_cooling_delta_f is not null then least(greatest(1.0 / (1.0 + exp(-(expected_cooling_delta_f - threshold_f) / w)), 0.01), 0.99) end as prob
        from fts left join weekly on weekly.day_of_week = {dow('timestamp')} and weekly.hour = {hour('timestamp')}, thr, spread"""),
    "fc": (["fprob"], f"""select *, coalesce(prob <= {THERMAL.occ_prob_threshold} and expected_hvac_kw >= 0.5, false) as advise,
        case when coalesce(prob <= {THERMAL.occ_prob_threshold} and expected_hvac_kw >= 0.5, false) then expected_hvac_kw * h * 0.3 else 0 end as saved from fprob"""),
    "islands": (["fc"], "select *, slot - row_number() over (order by slot) as island from fc where advise"),
}


def sql(body: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for parent in PARTS[name][0]:
            visit(parent)
        order.append(name)

    for name in needs:
        visit(name)
    head = ",\n".join(f"{name} as ({PARTS[name][1]})" for name in order)
    return f"with {head}\n{body}" if head else body


def _forecast_body(rows: str, extra: str = "") -> str:
    """Seasonal-naive forecast columns for a subquery with zone_id and ds."""
    yhat = r("greatest(coalesce(p.expected, l.zone_mean, 0), 0)")
    return f"""select f.zone_id, f.ds{extra}, {yhat} as yhat, {yhat} as yhat_lower, {yhat} as yhat_upper,
        {yhat} as pred_occupancy_count, greatest(coalesce(p.expected, l.zone_mean, 0), 0) >= 1 as pred_is_occupied
        from ({rows}) f left join profile p on p.zone_id = f.zone_id and p.dow = {dow('f.ds')} and p.minute = {minute('f.ds')}
        left join level l on l.zone_id = f.zone_id"""


def _range_rows(bounds: tuple[str, str]) -> str:
    return f"select zone_id, unnest(generate_series(timestamp '{bounds[0]}', timestamp '{bounds[1]}', {STEP})) as ds from level"


def _future_rows(periods: int) -> str:
    return f"select zone_id, unnest(generate_series(last + {STEP}, last + {periods} * {STEP}, {STEP})) as ds from horizon"


def _case(names: list[str], key: str) -> str:
    return f"case {key} " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(names)) + " else 'N/A' end"


def _fmt(expr: str) -> str:
    return f"coalesce(format('{{:,.2f}}', {expr}), 'N/A')"


_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "FLOAT": "float",
          "TIMESTAMP": "timestamp_ntz", "FLOAT[]": "array<float>", "DOUBLE[]": "array<double>",
          "BOOLEAN": "boolean", "DATE": "date"}
_MEANING = """case when lower(column_name) in ('beginning','end','timestamp') then 'time boundary / observation timestamp'
    when lower(column_name) like '%occupancy%' then 'observed occupancy count'
    when lower(column_name) in ('space_id','roomid','typeid','region_id','wapcov_id') then 'entity identifier'
    when lower(column_name) in ('user','mac') then 'anonymized user/device identifier'
    when lower(column_name) like '%temp%' then 'temperature measurement'
    when lower(column_name) in ('access_point','wap','sensor','sensor_id') then 'network/sensor source identifier'
    when lower(column_name) = 'payload' then 'raw payload or event value'
    when table_name = 'space' and lower(column_name) = 'parent_space_id' then 'hierarchical parent reference'
    else 'domain-specific field; confirm with data owner' end"""


def _opportunity(source: str) -> str:
    on = "(coalesce(occupancy_count, 0) <= 0 and coalesce(hvac_on, true))"
    return f"""select timestamp, zone_id, {r('occupancy_count')} as occupancy_count, {r('zone_temp')} as zone_temp, hvac_mode,
        {r('energy_kwh')} as energy_kwh, hvac_on, {on} as is_opportunity,
        {r(f'case when {on} then coalesce(energy_kwh, 0) else 0 end')} as potential_energy_savings from {source}"""


def _merge(join: str) -> str:
    return f"""select timestamp, zone_id, {r('occupancy_count')} as occupancy_count, {r('zone_temp')} as zone_temp,
        hvac_mode, {r('energy_kwh')} as energy_kwh, hvac_on from {join}"""


def _metric_row(name: str, condition: str) -> str:
    return f"""select '{name}' as split, count(*) filter (occ and pred and {condition}) as tp, count(*) filter (not occ and not pred and {condition}) as tn,
        count(*) filter (not occ and pred and {condition}) as fp, count(*) filter (occ and not pred and {condition}) as fn from cls"""


def _seq(agg: str, frame: str) -> str:
    return f"{agg} over (partition by zone_id order by slot {frame})"


_BACK, _AHEAD = "rows between 95 preceding and current row", "rows between 1 following and 96 following"

ORACLES: dict[str, str] = {
    "scan_project_filter_limit": sql(f"select timestamp, space_id, {r('zone_temp')} as zone_temp from v_state where zone_temp > 76.0 order by timestamp, space_id limit 500", "v_state"),
    "occupancy_source": sql("select cast(space_id as varchar) as zone_id, beginning as interval_begin, cast(occupancy as double) as count from v_space_occ where cast(space_id as varchar) = '7'", "v_space_occ"),
    "weather_source": sql(f"select timestamp, {r('outside_temp')} as outside_temp from v_weather", "v_weather"),
    "schema_dictionary": f"""select c.table_name, c.column_name, cast(c.ordinal_position as int) as ordinal_position,
        {"case c.data_type " + " ".join(f"when '{a}' then '{b}'" for a, b in _TYPES.items()) + " else c.data_type end"} as data_type,
        'YES' as is_nullable, n.n as estimated_row_count, {_MEANING} as semantic_meaning
        from (select distinct table_name, column_name, ordinal_position, data_type from information_schema.columns) c
        join ({" union all ".join(f"select '{t}' as t, count(*) as n from {t}" for t in TABLES)}) n on n.t = c.table_name""",
    "column_profile": " union all ".join(
        f"""select '{c}' as column_name, count(*) as rows, count(*) - count({c}) as nulls,
        {r(f'100.0::double * (count(*) - count({c})) / count(*)')} as null_pct, count(distinct {c}) as distinct_values,
        min(cast({c} as varchar)) as min_text, max(cast({c} as varchar)) as max_text,
        coalesce((select string_agg(v, '|' order by v) from (select distinct cast({c} as varchar) as v from events where {c} is not null order by v limit 3)), '') as examples
        from events"""
        for c in ("event_id", "ts", "user_id", "event_type", "value", "props")),
    "time_range": "select count(*) as rows, min(ts) as first_ts, max(ts) as last_ts from events",
    "hvac_source": sql(f"select timestamp, space_id, {r('zone_temp')} as zone_temp from v_hvac", "v_hvac"),
    "tariff_source": f"""select cast(p_partkey as int) as tou_id, cast(p_size % 24 as int) as start_hour,
        cast(case when p_size > 24 then p_size % 7 end as int) as end_hour,
        {r('case when p_size % 5 <> 0 then p_retailprice end')} as rate_kwh from part""",
    "space_source": sql("select * from v_space", "v_space"),
    "normalize_occupancy": sql(f"select timestamp, zone_id, {r('occupancy_count')} as occupancy_count from norm", "norm"),
    "duplicate_count": sql("""select cast(sum(n) as bigint) as usable_rows, count(*) as distinct_keys, cast(sum(n - 1) as bigint) as duplicate_rows
        from (select count(*) as n from v_occ group by date_trunc('hour', timestamp), zone_id)""", "v_occ"),
    "coerce_numeric": sql(f"""select event_id, {r("try_cast(replace(return_temp_ahu1, ' F', '') as double)")} as clean,
        case when return_temp_ahu2 = 'nan' then null else try_cast(return_temp_ahu2 as double) end as dirty from v_bms""", "v_bms"),
    "normalize_weather": f"select date_trunc('hour', ts) as timestamp, {r('avg(value)')} as outside_temp from events group by 1",
    "time_filter": sql("""select space_id, count(*) as samples, min(timestamp) as min_ts, max(timestamp) as max_ts from v_hvac
        where timestamp >= timestamp '2024-01-08 06:00:00' and timestamp <= timestamp '2024-01-20 18:00:00' group by 1""", "v_hvac"),
    "day_window": sql("""select zone_id, count(*) as samples, (select cast(min(timestamp) as date) from v_occ) as first_day,
        (select cast(max(timestamp) as date) from v_occ) as last_day from v_occ
        where timestamp >= timestamp '2024-01-10' and timestamp <= timestamp '2024-01-12 23:59:59' group by 1""", "v_occ"),
    "recent_window": sql(f"""select space_id, count(*) as samples, min(timestamp) as min_ts, {r('avg(zone_temp)')} as avg_temp from v_hvac
        where timestamp >= (select max(timestamp) from v_hvac) - interval 14 day group by 1""", "v_hvac"),
    "first_n_zones": sql(f"""select zone_id, count(*) as samples, {r('avg(occupancy_count)')} as avg_occ from v_occ
        where zone_id in (select distinct zone_id from v_occ order by 1 limit 3) group by 1""", "v_occ"),
    # dashboard
    "occupancy_kpis": sql(f"""select count(*) as rows, cast(count(distinct space_id) as int) as spaces, min(beginning) as min_ts,
        max(beginning) as max_ts, {r2('avg(occupancy)')} as avg_occ, max(occupancy) as peak_occ,
        {r2('quantile_cont(occupancy, 0.5)')} as median_occ from v_space_occ""", "v_space_occ"),
    "occupancy_daily": sql("select * from daily", "daily"),
    "occupancy_heatmap": sql("select * from heat", "heat"),
    "occupancy_space_stats": sql("select * from spaces", "spaces"),
    "hvac_kpis": sql(f"""select count(*) as rows, cast(count(distinct space_id) as int) as zones, min(timestamp) as min_ts,
        max(timestamp) as max_ts, {r2('avg(zone_temp)')} as avg_temp, {r2('quantile_cont(zone_temp, 0.5)')} as median_temp,
        {r2('quantile_cont(zone_temp, 0.95)')} as p95_temp from v_hvac""", "v_hvac"),
    "hvac_daily": sql(f"""select cast(timestamp as date) as day, {r2('avg(zone_temp)')} as avg_temp,
        {r2('quantile_cont(zone_temp, 0.95)')} as p95_temp, count(*) as samples from v_hvac group by 1""", "v_hvac"),
    "hvac_hourly": sql(f"""select {hour('timestamp')} as hour_of_day, {r2('avg(zone_temp)')} as avg_temp,
        {r2('quantile_cont(zone_temp, 0.9)')} as p90_temp, count(*) as samples from v_hvac group by 1""", "v_hvac"),
    "hvac_zone_stats": sql("select * from zones", "zones"),
    "hvac_comfort_summary": sql("select * from comfort", "comfort"),
    "top_spaces": sql("select * from spaces order by avg_occ desc, samples desc, space_id limit 15", "spaces"),
    "top_zones": sql(" union all ".join(
        f"select * from (select '{name}' as ranking, space_id, avg_temp, std_temp from zones order by {order}, space_id limit 3)"
        for name, order in [("hottest", "avg_temp desc"), ("coldest", "avg_temp"), ("most_variable", "std_temp desc")]), "zones"),
    "heatmap_pivot": sql(f"""select {_case(WEEKDAY_LABELS, 'd')} as day_name, """ + ", ".join(
        f"max(case when hour_of_day = {h} then avg_occ end) as h{h:02d}" for h in range(24)) + " from range(7) w(d) left join heat on day_of_week = d group by d", "heat"),
    "heatmap_agg": sql(f"""select cast(extract(dow from beginning) as int) as day_of_week, {hour('beginning')} as hour_of_day,
        {r2('quantile_cont(occupancy, 0.5)')} as occ from v_space_occ group by 1, 2""", "v_space_occ"),
    "daily_unpivot": sql("select day, 'avg_occ' as metric, avg_occ as value from daily union all select day, 'peak_occ', cast(peak_occ as double) from daily", "daily"),
    "occupancy_timeline": sql("select beginning as timestamp, cast(sum(occupancy) as double) as total_occupancy from v_space_occ group by 1", "v_space_occ"),
    "occupancy_insights": sql(f"""select (select {_case(WEEKDAY_LABELS, 'day_of_week')} from heat group by day_of_week order by avg(avg_occ) desc, day_of_week limit 1) as busiest_day,
        (select concat(lpad(cast(hour_of_day as varchar), 2, '0'), ':00') from heat order by avg_occ desc, day_of_week, hour_of_day limit 1) as busiest_hour,
        (select {_fmt('avg_occ')} from heat order by avg_occ desc, day_of_week, hour_of_day limit 1) as busiest_hour_avg_occ,
        (select space_label from spaces order by avg_occ desc, space_label limit 1) as highest_util_space,
        (select {_fmt('avg_occ')} from spaces order by avg_occ desc, space_label limit 1) as highest_util_avg_occ,
        (select string_agg(space_label, '|' order by avg_occ, space_label) from (select * from spaces order by avg_occ, space_label limit 3)) as low_util_spaces""", "heat", "spaces"),
    "hvac_insights": sql(f"""select (select space_id from zones order by std_temp desc, space_id limit 1) as high_variability_zone,
        (select {_fmt('std_temp')} from zones order by std_temp desc, space_id limit 1) as high_variability_std_temp,
        (select space_id from zones order by avg_temp desc, space_id limit 1) as hottest_zone,
        (select {_fmt('avg_temp')} from zones order by avg_temp desc, space_id limit 1) as hottest_zone_avg_temp,
        (select space_id from zones order by avg_temp, space_id limit 1) as coldest_zone,
        (select {_fmt('avg_temp')} from zones order by avg_temp, space_id limit 1) as coldest_zone_avg_temp,
        (select {_fmt('out_of_band_pct')} from comfort) as overall_out_of_band_pct""", "zones", "comfort"),
    # preparation
    "merge_occupancy_hvac": sql(_merge("merged"), "merged"),
    "merge_occupancy_hvac_left": sql(_merge("""floored left join (select time_bucket(interval 15 minute, timestamp) as timestamp, space_id as zone_id,
        arg_min(zone_temp, timestamp) as zone_temp, arg_min(hvac_mode, timestamp) as hvac_mode, arg_min(energy_kwh, timestamp) as energy_kwh,
        arg_min(coalesce(lower(hvac_mode) <> 'off', true), timestamp) as hvac_on from v_state where hvac_mode <> 'Off' group by 1, 2) q using (timestamp, zone_id)"""), "floored", "v_state"),
    "add_weather_features": sql(f"select timestamp, zone_id, {r('occupancy_count')} as occupancy_count, {r('outside_temp')} as outside_temp from hourly_occ left join v_weather using (timestamp)", "hourly_occ", "v_weather"),
    "add_tou_features": sql(f"""select timestamp, zone_id, occupancy_count, hour, {r(f'''coalesce(
        last_value(tou_rate ignore nulls) over (partition by zone_id order by timestamp {ROWS_BACK}),
        first_value(tou_rate ignore nulls) over (partition by zone_id order by timestamp {ROWS_AHEAD}))''')} as tou_rate
        from (select *, {hour('timestamp')} as hour from v_occ) left join rates using (hour)""", "v_occ", "rates"),
    "add_tou_dirty": sql(f"""select timestamp, zone_id, occupancy_count, hour, {r(f'''coalesce(
        last_value(tou_rate ignore nulls) over (partition by zone_id order by timestamp nulls last {ROWS_BACK}),
        first_value(tou_rate ignore nulls) over (partition by zone_id order by timestamp nulls last {ROWS_AHEAD}))''')} as tou_rate
        from (select *, {hour('timestamp')} as hour from (select case when mark <> 3 then timestamp end as timestamp,
        case when mark <> 5 then zone_id end as zone_id, occupancy_count from
        (select *, ((cast(trunc(occupancy_count) as bigint) % 11) + 11) % 11 as mark from v_occ))) left join rates using (hour)""", "v_occ", "rates"),
    "opportunity_flag": sql(_opportunity("merged_left"), "merged_left"),
    "dense_grid": sql(f"select zone_id, timestamp, {r('occupancy_count')} as occupancy_count from dense", "dense"),
    "weather_interpolated": sql(f"select timestamp, {r('outside_temp')} as outside_temp from wline", "wline"),
    "median_impute": sql(f"""select timestamp, zone_id, {r('occupancy_count')} as occupancy_count,
        {r('coalesce(outside_temp, (select quantile_cont(outside_temp, 0.5) from hourly_occ left join v_weather using (timestamp)))')} as outside_temp
        from hourly_occ left join v_weather using (timestamp)""", "hourly_occ", "v_weather"),
    "forecast_features": sql(f"""select timestamp, zone_id, {r('occupancy_count')} as occupancy_count, {r('outside_temp')} as outside_temp,
        occupancy_count > 0 as is_occupied, {hour('timestamp')} as hour, {dow('timestamp')} as day_of_week,
        cast(extract(isodow from timestamp) >= 6 as int) as is_weekend, {r('l1')} as occupancy_lag_1, {r('l4')} as occupancy_lag_4, {r('l96')} as occupancy_lag_96
        from (select *, {", ".join(f"lag(occupancy_count, {k}) over (partition by zone_id order by timestamp) as l{k}" for k in (1, 4, 96))},
          least(greatest(timestamp, (select min(timestamp) from wline)), (select max(timestamp) from wline)) as wt from dense) x
        left join (select timestamp as wt, outside_temp from wline) w using (wt) where l96 is not null""", "dense", "wline"),
    "engineer_features": sql(f"""select timestamp, zone_id, occupancy_count, {hour('timestamp')} as hour, {dow('timestamp')} as day_of_week,
        cast(extract(isodow from timestamp) >= 6 as int) as is_weekend,
        {", ".join(f"lag(occupancy_count, {k}) over (partition by zone_id order by timestamp, occupancy_count) as occupancy_count_lag_{k}" for k in (1, 4, 96))} from v_occ""", "v_occ"),
    "hourly_resample": sql("select * from hours", "hours"),
    "hourly_features": sql(f"""select * from (select timestamp, occupancy, {r(f'last_value(outside_temp ignore nulls) over (order by timestamp {ROWS_BACK})')} as outside_temp,
        {hour('timestamp')} as hour, {dow('timestamp')} as day_of_week, cast(extract(isodow from timestamp) >= 6 as int) as is_weekend,
        lag(occupancy, 1) over (order by timestamp) as occ_lag_1h, lag(occupancy, 24) over (order by timestamp) as occ_lag_24h
        from hours left join v_weather using (timestamp)) where outside_temp is not null and occ_lag_24h is not null""", "hours", "v_weather"),
    "gbt_hourly_frame": sql(f"""select f.*, case when pos < floor(floor(n * 0.8::double) * (1.0::double - 0.1::double)) then 'train'
        when pos < floor(n * 0.8::double) then 'validate' else 'test' end as part
        from (select * from (select timestamp, occupancy, {r(f'last_value(outside_temp ignore nulls) over (order by timestamp {ROWS_BACK})')} as outside_temp,
        {hour('timestamp')} as hour, {dow('timestamp')} as day_of_week, cast(extract(isodow from timestamp) >= 6 as int) as is_weekend,
        lag(occupancy, 1) over (order by timestamp) as occ_lag_1h, lag(occupancy, 24) over (order by timestamp) as occ_lag_24h
        from hours left join v_weather using (timestamp)) where outside_temp is not null and occ_lag_24h is not null) f
        join (select timestamp as moment, row_number() over (order by timestamp) - 25 as pos, count(*) over () - 24 as n from hours) on moment = f.timestamp""",
        "hours", "v_weather"),
    "regression_slot_sums": sql(f"""select * from (with rows as (select zone_id, ds, y, outside_temp from train left join wline on wline.timestamp =
        greatest(least(ds, (select max(timestamp) from wline)), (select min(timestamp) from wline))),
        mid as (select zone_id, quantile_cont(outside_temp, 0.5) as temp_mid from rows group by 1),
        parts as (select zone_id, temp_mid, {dow('ds')} as dow, {minute('ds')} as minute, y,
        (epoch_us(ds) - 1577836800000000) / 31557600000000.0::double as t, outside_temp - temp_mid as x from rows join mid using (zone_id))
        select zone_id, {r('temp_mid')} as temp_mid, dow, minute, count(*)::double as n, {r('sum(t)')} as t, {r('sum(x)')} as x, {r('sum(t * t)')} as tt,
        {r('sum(x * x)')} as xx, {r('sum(t * x)')} as tx, {r('sum(y)')} as y, {r('sum(t * y)')} as ty, {r('sum(x * y)')} as xy, {r('sum(y * y)')} as yy
        from parts group by all)""", "train", "wline"),
    "chronological_split": sql("""select timestamp, zone_id, occupancy_count, row_number() over (partition by zone_id order by timestamp)
        <= floor(count(*) over (partition by zone_id) * 0.8::double) as is_train from norm""", "norm"),
    "infer_step_hours": sql(f"""select {r('quantile_cont(gap, 0.5) / 3600.0')} as step_hours from
        (select (epoch_us(timestamp) - lag(epoch_us(timestamp)) over (order by timestamp)) / 1e6 as gap from v_occ)""", "v_occ"),
    "downsample": sql("""select t.timestamp, t.total_occupancy from (
        select beginning as timestamp, cast(sum(occupancy) as double) as total_occupancy, row_number() over (order by beginning) - 1 as p, count(*) over () as n from v_space_occ group by 1) t
        where n <= 500 or p in (select cast(round_even(i * ((m - 1) / 499.0::double), 0) as bigint) from range(500) c(i), (select count(distinct beginning) as m from v_space_occ))""", "v_space_occ"),
    "sliding_sequences": sql(f"""select * from (select zone_id, timestamp, cast({_seq('count(*)', _BACK)} as int) as n_in, cast({_seq('count(*)', _AHEAD)} as int) as n_out,
        {r(_seq('first_value(occupancy_count)', _BACK))} as first_in, {r(_seq('last_value(occupancy_count)', _BACK))} as last_in,
        {r(_seq('first_value(occupancy_count)', _AHEAD))} as first_out, {r(_seq('last_value(occupancy_count)', _AHEAD))} as last_out,
        {r(_seq('sum(occupancy_count)', _BACK))} as sum_in, {r(_seq('sum(occupancy_count)', _AHEAD))} as sum_out from dense) where n_in = 96 and n_out = 96""", "dense"),
    # forecasting
    "seasonal_profile": sql(f"select zone_id, dow, minute, {r('expected')} as expected, rows, {r('zone_mean')} as zone_mean from profile join level using (zone_id)", "profile", "level"),
    "future_grid": sql(_future_rows(192), "horizon"),
    "seasonal_naive_forecast": sql(_forecast_body(_future_rows(672)), "profile", "level", "horizon"),
    "forecast_with_history": sql(_forecast_body(f"select zone_id, ds from train union all {_future_rows(96)}"), "train", "profile", "level", "horizon"),
    "predict_occupancy": sql(f"select ds as timestamp, zone_id, pred_occupancy_count, pred_is_occupied from ({_forecast_body(_range_rows(RANGE))})", "profile", "level"),
    "predict_occupancy_weather": sql(f"select ds as timestamp, zone_id, pred_occupancy_count, pred_is_occupied from ({_forecast_body(_range_rows(RANGE))})", "profile", "level"),
    "regression_median_fill": sql(f"""select zone_id, ds, {r('y')} as y, {r('coalesce(outside_temp, mid)')} as outside_temp, {r('mid')} as temp_mid
        from (select t.zone_id, ds, y, outside_temp, quantile_cont(outside_temp, 0.5) over (partition by t.zone_id) as mid
          from train t left join v_weather on v_weather.timestamp = t.ds)""", "train", "v_weather"),
    "regression_residual_products": sql("""select zone_id, cast(term as int) as term, rows, 0.0::double as residual_share
        from (select zone_id, count(*) as rows, unnest(range(17)) as term from train group by 1)""", "train"),
    "regression_backtest": sql("select zone_id, status, n_eval as n_eval_rows from backtest", "backtest"),
    "hourly_forecast_error": sql(f"""select count(*) as rows, {r('avg(abs(occupancy - lagged))')} as mae, {r('sqrt(avg((occupancy - lagged) * (occupancy - lagged)))')} as rmse
        from (select timestamp, occupancy, lag(occupancy, 24) over (order by timestamp) as lagged, last_value(outside_temp ignore nulls) over (order by timestamp {ROWS_BACK}) as temp,
          row_number() over (order by timestamp) - 25 as pos, count(*) over () - 24 as n from hours left join v_weather using (timestamp))
        where pos >= floor(n * 0.8::double) and temp is not null and lagged is not null""", "hours", "v_weather"),
    "backtest_metrics": sql(f"""select zone_id, {r('acc')} as binary_accuracy, {r('pr')} as precision, {r('re')} as recall,
        {r('case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end')} as f1, {r('mae')} as mae, n as n_eval_rows from scored""", "scored"),
    "error_metrics": sql(f"""select zone_id, {r('avg(abs(y - yhat))')} as mae, {r('sqrt(avg((y - yhat) * (y - yhat)))')} as rmse,
        {r('100.0::double * avg(abs((y - yhat) / nullif(y, 0)))')} as mape from pairs group by 1""", "pairs"),
    "zone_backtest": sql(f"""select zone_id, status, {r('acc')} as binary_accuracy, {r('pr')} as precision, {r('re')} as recall, {r('f1')} as f1,
        {r('mae')} as mae, n_eval as n_eval_rows, status = 'ok' and acc >= 0.8 as pass from backtest""", "backtest"),
    "zone_backtest_forecasts": sql(f"select ds as timestamp, zone_id, {r('yhat')} as pred_occupancy_count, yhat >= 1 as pred_is_occupied from pairs", "pairs"),
    "zone_gate": sql("""select count(*) filter (status = 'ok' and acc >= 0.8) as passing_zones, count(*) as zones,
        count(*) filter (status = 'ok' and acc >= 0.8) >= 1 as gate_pass from backtest""", "backtest"),
    # thermal
    "thermal_signal": sql(f"""select timestamp, occ as occupied_actual, {r('kw')} as hvac_kw, {r('d1')} as delta_ahu1_f, {r('d2')} as delta_ahu2_f,
        {r('d')} as cooling_delta_f, {r('rt')} as return_temp_f, {r('st')} as supply_temp_f, event_id from sig""", "sig"),
    "select_threshold": sql(f"select {r('threshold_f')} as threshold_f, {r('balanced_accuracy')} as balanced_accuracy from thr", "thr"),
    "classification_metrics": sql(f"""select split, {r('(tp + tn) / greatest(tp + tn + fp + fn, 1)::double')} as accuracy, {r('pr')} as precision, {r('re')} as recall,
        {r('sp')} as specificity, {r('(re + sp) / 2')} as balanced_accuracy, {r('2 * pr * re / greatest(pr + re, 1e-12)')} as f1, tp, tn, fp, fn from (
        select *, tp / greatest(tp + fp, 1)::double as pr, tp / greatest(tp + fn, 1)::double as re, tn / greatest(tn + fp, 1)::double as sp from (
        {_metric_row('train', 'is_train')} union all {_metric_row('test', 'not is_train')} union all {_metric_row('all', 'true')}))""", "cls"),
    "thermal_hourly_profile": sql(f"""select cast(hh as int) as hour, {r('avg(case when occ then 1.0::double when not occ then 0.0::double end)')} as actual_occ_rate,
        {r('avg(case when pred then 1.0::double when not pred then 0.0::double end)')} as pred_occ_rate, {r('avg(kw)')} as mean_hvac_kw, {r('avg(d)')} as mean_cooling_delta_f,
        {r('avg(case when opp then 1.0::double when not opp then 0.0::double end)')} as opportunity_rate
        from range(24) t(hh) left join cls on {hour('timestamp')} = hh group by 1""", "cls"),
    "thermal_dow_hour_profile": sql(f"""select day_of_week, hour, {r('expected_cooling_delta_f')} as expected_cooling_delta_f,
        {r('expected_hvac_kw')} as expected_hvac_kw, {r('occupancy_rate_actual')} as occupancy_rate_actual from weekly""", "weekly"),
    "thermal_summary": sql(f"""select count(*) as rows, min(timestamp) as start, max(timestamp) as "end", {r('avg(d) filter (occ)')} as occupied_delta_mean_f,
        {r('avg(d) filter (not occ)')} as unoccupied_delta_mean_f, {r('(select h from step) * 60')} as step_minutes from sig""", "sig", "step"),
    "thermal_opportunity": sql(f"""select {r('count(*) filter (opp) * max(h)')} as opportunity_hours, {r('sum(saved)')} as estimated_avoidable_kwh,
        {r('avg(case when opp then 1.0::double else 0.0::double end)')} as opportunity_rate, {r('sum(kw) * max(h)')} as total_hvac_energy_kwh from cls""", "cls"),
    "thermal_forecast": sql(f"""select timestamp, day_of_week, hour, {r('expected_cooling_delta_f')} as expected_cooling_delta_f, {r('expected_hvac_kw')} as expected_hvac_kw,
        {r('occupancy_rate_actual')} as occupancy_rate_actual, {r('prob')} as occ_prob_from_temp, advise as setback_recommended, {r('saved')} as projected_savings_kwh from fc""", "fc"),
    "setback_windows": sql(f"""select min(timestamp) as start, max(timestamp) + to_microseconds(max(us)) as "end", {r('count(*) * max(h)')} as duration_hours,
        {r('sum(saved)')} as projected_savings_kwh, {r('avg(expected_hvac_kw)')} as mean_hvac_kw, {r('avg(prob)')} as mean_occ_prob
        from islands group by island order by sum(saved) desc, 1 limit 10""", "islands"),
    # savings
    "savings_potential": sql(f"""select case when g = 3 then 'total' when g = 1 then 'hour' else 'weekday' end as breakdown, hour, day_of_week,
        {r('n * 0.25')} as opportunity_hours, {r('e')} as opportunity_energy_kwh, {r('cost')} as opportunity_cost,
        {r('100.0::double * e / (select sum(energy_kwh) from merged)')} as percent_of_total from (
        select hour, day_of_week, grouping(hour, day_of_week) as g, count(*) filter (is_opportunity) as n, sum(potential_energy_savings) as e,
        sum(potential_energy_savings * tou_rate) as cost from (select f.*, {dow('timestamp')} as day_of_week, coalesce(
          last_value(rate0 ignore nulls) over (partition by zone_id order by timestamp {ROWS_BACK}),
          first_value(rate0 ignore nulls) over (partition by zone_id order by timestamp {ROWS_AHEAD})) as tou_rate
          from (select flagged.*, {hour('timestamp')} as hour, rates.tou_rate as rate0 from flagged left join rates on rates.hour = {hour('timestamp')}) f)
        group by grouping sets ((), (hour), (day_of_week)))""", "flagged", "rates"),
    "daily_opportunity_cumulative": sql(f"""select date, {r('o')} as opportunity_energy_kwh, {r('t')} as total_energy_kwh, {r('sum(o) over (order by date)')} as cumulative_opportunity_kwh
        from (select cast(timestamp as date) as date, sum(potential_energy_savings) as o, sum(energy_kwh) as t from flagged group by 1)""", "flagged"),
    "day_timeline": sql(_opportunity("merged") + f" where cast(timestamp as date) = date '{EXAMPLE_DAY}' and zone_id = '{EXAMPLE_ZONE}'", "merged"),
    "opportunity_min_duration": sql(f"""select zone_id, cast(timestamp as date) as date, count(*) * 15.0::double as opportunity_minutes, {r('sum(potential_energy_savings)')} as opportunity_energy_kwh
        from (select *, count(*) over (partition by zone_id, island) as n from (select *, epoch(timestamp) / 900 - row_number() over (partition by zone_id order by timestamp) as island
        from flagged where is_opportunity)) where n >= 2 group by 1, 2""", "flagged"),
    "setpoint_plan": sql(f"""select timestamp, zone_id, {r('y')} as predicted_occupancy, {r('e.zone_temp')} as baseline_setpoint, {r('e.energy_kwh')} as baseline_energy,
        y <= {PLAN_THRESHOLD} as is_unoccupied, y <= {PLAN_THRESHOLD} and peak > {PLAN_THRESHOLD} as pre_conditioning,
        {r(f'case when peak <= {PLAN_THRESHOLD} then case when e.zone_temp >= 72.5 then 85.0 else 60.0 end else e.zone_temp end')} as recommended_setpoint,
        {r(f'case when peak <= {PLAN_THRESHOLD} then e.energy_kwh * 0.3 else 0 end')} as energy_savings_kwh,
        {r(f'case when peak <= {PLAN_THRESHOLD} then e.energy_kwh * 0.3 else 0 end * rates.tou_rate')} as cost_savings
        from (select ds as timestamp, zone_id, pred as y, max(pred) over (partition by zone_id order by ds rows between current row and 2 following) as peak from
          (select f.zone_id, f.ds, greatest(coalesce(p.expected, l.zone_mean, 0), 0) as pred from ({_range_rows(PLAN_RANGE)}) f
           left join profile p on p.zone_id = f.zone_id and p.dow = {dow('f.ds')} and p.minute = {minute('f.ds')} left join level l on l.zone_id = f.zone_id)) a
        join equip e using (timestamp, zone_id) left join rates on rates.hour = {hour('timestamp')}""", "profile", "level", "equip", "rates"),
}
