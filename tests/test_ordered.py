"""Order-dependent operators against brute force, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roomtide.operators import ordered


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    n = 3000
    keys = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", None], n))
    values = np.round(rng.gamma(2.0, 10.0, n), 1)
    values[rng.random(n) < 0.3] = 7.0
    values[rng.random(n) < 0.02] = np.nan
    return pd.DataFrame({"k": keys, "v": values, "id": np.arange(n), "t": rng.integers(0, 400, n)})


def frame(spark, pdf):
    rows = [(None if k is None else str(k), None if np.isnan(v) else float(v), int(i), int(t)) for k, v, i, t in pdf[["k", "v", "id", "t"]].values]
    return spark.createDataFrame(rows, "k string, v double, id bigint, t bigint")


def test_percentiles_per_key_and_overall(spark, skewed):
    df, probs = frame(spark, skewed), {"lo": 0.01, "mid": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.k: r for r in ordered.percentiles(df, ["k"], "v", probs).collect()}
    for key in ("hot", "a", "b", None):
        own = skewed[skewed.k.isna() if key is None else skewed.k == key].v
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(own.quantile(p)), (key, name)
    overall = ordered.percentiles(df, [], "v", probs).first()
    few = ordered.percentiles(df, [], "v", probs, few_values=True).first()
    for name, p in probs.items():
        assert overall[name] == pytest.approx(skewed.v.quantile(p))
        assert few[name] == pytest.approx(skewed.v.quantile(p))


def test_percentiles_of_odd_inputs(spark):
    df = spark.createDataFrame([("x", 5.0), ("x", 5.0), ("big", 1e300), ("big", -1e300), ("no", None)], "k string, v double")
    got = {r.k: r.m for r in ordered.percentiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {"x": 5.0, "big": 0.0}
    assert ordered.percentiles(df.limit(0), [], "v", {"m": 0.5}).first().m is None


def test_weighted_percentiles(spark):
    df = spark.createDataFrame([(1.0, 5), (9.0, 4), (4.0, 0)], "v double, n bigint").where("n > 0")
    assert ordered.percentiles(df, [], "v", {"m": 0.5}, weight="n").first().m == 1.0


def test_split_takes_exactly_the_first_rows(spark, skewed, at):
    pdf = skewed.assign(ts=[at(int(m)) for m in skewed.t])
    df = spark.createDataFrame(
        [(None if k is None else str(k), t, int(i)) for k, t, i in zip(pdf.k, [x.to_pydatetime() for x in pdf.ts], pdf.id)],
        "k string, ts timestamp_ntz, id bigint",
    )
    got = ordered.chronological_split(df, ["k"], "ts", 0.8, tie_breaker="id").toPandas()
    for key in ("hot", "a", "b", None):
        own = got[got.k.isna() if key is None else got.k == key].sort_values(["ts", "id"])
        expected = np.arange(len(own)) < int(len(own) * 0.8)
        assert (own.is_train.to_numpy() == expected).all(), key
    overall = ordered.chronological_split(df, [], "ts", 0.5, tie_breaker="id").toPandas().sort_values(["ts", "id"])
    assert (overall.is_train.to_numpy() == (np.arange(len(overall)) < len(overall) // 2)).all()


def test_split_tells_large_ids_apart(spark, at):
    first = 2**53
    df = spark.createDataFrame([(at(0), first + i) for i in range(10)], "ts timestamp_ntz, id bigint")
    got = ordered.chronological_split(df, [], "ts", 0.5, tie_breaker="id").where("is_train").collect()
    assert sorted(r.id for r in got) == [first + i for i in range(5)]


def test_split_of_few_rows(spark, at):
    df = spark.createDataFrame([(at(0),)], "ts timestamp_ntz")
    assert ordered.chronological_split(df, [], "ts", 0.8).first().is_train is False
    assert ordered.chronological_split(df, [], "ts", 0.8, at_least=1).first().is_train is True


def test_row_numbers(spark, skewed):
    got = ordered.number_rows(frame(spark, skewed), ["k"], ["t", "id"], "n").toPandas()
    for key in ("hot", "a", None):
        own = got[got.k.isna() if key is None else got.k == key].sort_values(["t", "id"])
        assert own.n.tolist() == list(range(1, len(own) + 1))
        assert set(own.n_total) == {len(own)}


def test_lags_across_blocks_equal_shift(spark):
    df = spark.range(100).select(F.lit("z").alias("k"), F.col("id").alias("slot"), (F.col("id") * F.col("id")).cast("double").alias("v"))
    got = ordered.slot_lags(df, ["k"], "slot", "v", [1, 4, 9], "lag_", block=10).toPandas().sort_values("slot")
    assert len(got) == 100
    for k in (1, 4, 9):
        pd.testing.assert_series_equal(got[f"lag_{k}"].reset_index(drop=True), got.v.reset_index(drop=True).shift(k), check_names=False)


def test_neighbours_across_chunks(spark):
    values = {3: 1.0, 4: 2.0, 17: 5.0}
    df = spark.createDataFrame([(i, values.get(i)) for i in range(25)], "slot bigint, v double")
    got = ordered.neighbours(df, [], "slot", F.col("v"), F.floor(F.col("slot") / 5)).toPandas().sort_values("slot")
    series = pd.Series([values.get(i, np.nan) for i in range(25)])
    np.testing.assert_array_equal(got._prev.to_numpy(dtype=float), series.ffill().to_numpy())
    np.testing.assert_array_equal(got._next.to_numpy(dtype=float), series.bfill().to_numpy())


def test_neighbours_without_the_row_itself(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 11, 40)], "slot bigint")
    got = ordered.neighbours(df, [], "slot", F.col("slot"), F.floor(F.col("slot") / 10), inclusive=False).toPandas().sort_values("slot")
    assert got._next.tolist()[:3] == [2, 11, 40] and pd.isna(got._next.iloc[3])
    assert got._prev.tolist()[1:] == [1, 2, 11] and pd.isna(got._prev.iloc[0])


def test_runs_across_blocks(spark):
    rng = np.random.default_rng(5)
    flags = rng.random(200) < 0.7
    flags[55:130] = True  # spans several blocks of ten
    df = spark.createDataFrame([("z", i, bool(f), float(i)) for i, f in enumerate(flags)], "k string, slot bigint, flag boolean, x double")
    got = {(r.first_slot, r.last_slot, r.length, r.x_sum, r.x_n) for r in ordered.runs(df, ["k"], "slot", "flag", ["x"], block=10).collect()}
    expected, start = set(), None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        if not f and start is not None:
            expected.add((start, i - 1, i - start, float(sum(range(start, i))), i - start))
            start = None
    assert got == expected
    assert sum(r[2] for r in got) == int(flags.sum())


def test_summary_equals_pandas(spark, skewed):
    totals = [ordered.Total("first_t", F.min, F.col("t")), ordered.Total("ids", F.sum, F.col("id"))]
    got = {r.k: r for r in ordered.summary(frame(spark, skewed), ["k"], "v", {"p50": 0.5, "p9": 0.9}, totals).collect()}
    for key in ("hot", "a", "b", None):
        own = skewed[skewed.k.isna() if key is None else skewed.k == key]
        r = got[key]
        assert (r.rows, r.first_t, r.ids) == (len(own), own.t.min(), own.id.sum())
        assert (r.mean, r.p50, r.p9) == pytest.approx((own.v.mean(), own.v.quantile(0.5), own.v.quantile(0.9)))
    nothing = spark.createDataFrame([("x", None), ("x", float("nan"))], "k string, v double")
    r = ordered.summary(nothing, ["k"], "v", {"m": 0.5}).first()
    assert (r.k, r.rows, r["mean"], r.m) == ("x", 2, None, None)
    assert ordered.summary(nothing.limit(0), ["k"], "v", {"m": 0.5}).count() == 0
