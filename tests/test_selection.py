"""Exact ranks by narrowing, against sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomtide.operators import selection


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(5)
    out = np.round(rng.gamma(2.0, 10.0, 4000), 1)
    out[rng.random(4000) < 0.3] = 7.0  # a value that a third of all rows have
    out[:3] = [-1e300, 1e300, 0.0]
    return out


@pytest.mark.parametrize("listed", [100_000, 50, 1])
def test_quantiles_equal_numpy(spark, values, listed):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(5)
    probs = [0.0, 0.01, 0.2, 0.3, 0.5, 0.99, 1.0]
    got = selection.quantiles(df, "v", probs, listed)
    assert got == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)


@pytest.mark.parametrize("listed", [1000, 3])
def test_ranks_of_large_whole_numbers(spark, listed):
    first = 2**53
    numbers = sorted([first + i // 2 for i in range(60)])
    df = spark.createDataFrame([(v,) for v in reversed(numbers)], "v bigint")
    n, found = selection.ranked_values(df, "v", [0.0, 0.4, 0.9, 1.0, 1.0], lambda n: [0, 23, 55, n - 1, n], listed)
    assert n == 60 and found[4] is None
    for rank, ranked in zip([0, 23, 55, 59], found):
        assert ranked == selection.Ranked(numbers[rank], numbers.index(numbers[rank]), 2)


def test_a_poor_sketch_costs_passes_not_answers(spark, values, monkeypatch):
    monkeypatch.setattr(selection, "_sketch", lambda x, shares, slack: F.array(*[F.lit(7.0)] * 2 * len(shares)))
    df = spark.createDataFrame([(float(v),) for v in values[3:403]], "v double")
    got = selection.quantiles(df, "v", [0.01, 0.5, 0.99], 30)
    assert got == pytest.approx(list(np.quantile(values[3:403], [0.01, 0.5, 0.99])), rel=1e-12)


def test_nothing_to_rank(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert selection.quantiles(df, "v", [0.5]) == [None]
    assert selection.quantiles(df.limit(0), "v", [0.5]) == [None]
    assert selection.quantiles(spark.createDataFrame([(3.0,)], "v double"), "v", [0.1, 0.9]) == [3.0, 3.0]
