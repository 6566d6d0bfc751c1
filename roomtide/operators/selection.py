"""Exact order statistics of one column, as plain values.

Thresholds, cut-offs and slice borders are needed by many expressions of a later
plan. As scalar subqueries they would be copied into each of them; found once
and put in as literals they cost nothing there, reach the scan as predicates,
and every pass over the data sees the same value.

A rank is found by narrowing: a quantile sketch gives an interval that should
hold it, one aggregate counts the rows below, at and between its ends, and the
interval shrinks until what is between fits a short list. Counts are exact, so
a poor sketch costs another pass and never a wrong answer. Passes are plain
aggregates that combine on the map side; what reaches the driver is one row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from roomtide.functions.scalars import as_col

LISTED = 100_000  # values that one aggregate may hold as a list
ACCURACY = 20_000  # of the sketch; its ranks are right within 1 / ACCURACY of the rows


@dataclass(frozen=True)
class Ranked:
    """A value, the number of rows below it, and the number of rows that have it."""

    value: Any
    below: int
    equal: int


class _Search:
    """What is known of one rank: it lies within ``outer``; ``(lo, hi)`` is tried next."""

    def __init__(self, rank: int, outer: tuple[Any, Any], guess: tuple[Any, Any]):
        self.rank, self.outer, self.guess = rank, outer, guess
        self.inside: tuple[int, int] | None = None  # rows below the guess's inside and rows in it, once counted
        self.found: Ranked | None = None

    def measures(self, x: Column, name: str, listed: bool) -> list[Column]:
        lo, hi = (F.lit(v).cast("bigint" if isinstance(v, int) else "double") for v in self.guess)
        between = (x > lo) & (x < hi)
        out = [
            F.count_if(x < lo).alias(f"{name}_below"), F.count_if(x == lo).alias(f"{name}_lo"),
            F.count_if(between).alias(f"{name}_in"), F.count_if(x == hi).alias(f"{name}_hi"),
        ]
        if listed:
            out.append(F.array_sort(F.collect_list(F.when(between, x))).alias(f"{name}_list"))
        return out

    def pick(self, name: str) -> list[Column]:
        """The listed value at the rank, and how many listed values are below and equal to it."""
        values = F.col(f"{name}_list")
        at = F.lit(self.rank) - F.col(f"{name}_below") - F.col(f"{name}_lo")
        # get() takes an int position; positions beyond the list give null
        value = F.get(values, F.when((at >= 0) & (at < F.size(values)), at.cast("int")).otherwise(F.lit(-1)))
        return [
            value.alias(f"{name}_value"), (F.array_position(values, value) - 1).alias(f"{name}_before"),
            F.size(F.filter(values, lambda v: v == value)).alias(f"{name}_same"),
        ]

    def learn(self, row, name: str, listed: bool) -> None:
        (lo, hi), r = self.guess, self.rank
        below, at_lo, between, at_hi = (row[f"{name}_{part}"] for part in ("below", "lo", "in", "hi"))
        if lo == hi:
            between = at_hi = 0
        if r < below:
            self.outer = self.guess = (self.outer[0], lo)
        elif r < below + at_lo:
            self.found = Ranked(lo, below, at_lo)
        elif r < below + at_lo + between:
            if listed:
                value, before, same = (row[f"{name}_{part}"] for part in ("value", "before", "same"))
                self.found = Ranked(value, below + at_lo + before, same)
            else:
                self.outer, self.inside = (lo, hi), (below + at_lo, between)
        elif r < below + at_lo + between + at_hi:
            self.found = Ranked(hi, below + at_lo + between, at_hi)
        else:
            self.outer = self.guess = (hi, self.outer[1])

    def narrow(self, lo: Any, hi: Any) -> bool:
        """Try the sketch's interval next; false if it does not lie strictly inside, and the lower half is tried."""
        low, high = self.outer
        usable = low < lo <= hi < high
        if not usable:
            lo, hi = low, (low + high) // 2 if isinstance(low, int) else low / 2 + high / 2
        self.guess, self.inside = (lo, hi), None
        return usable


def _sketch(x: Column, shares: Sequence[float], slack: float) -> Column:
    probs = [min(max(p + s, 0.0), 1.0) for p in shares for s in (-slack, slack)]
    return F.percentile_approx(x, probs, ACCURACY)


def ranked_values(
    df: DataFrame, value: str | Column, shares: Sequence[float], ranks: Callable[[int], Sequence[int]],
    listed: int = LISTED,
) -> tuple[int, list[Ranked | None]]:
    """Number of rows, and the value at each 0-based rank ``ranks(n)`` in ascending order.

    Nulls and NaN are left out. ``shares`` says about where each rank lies (0 to
    1), which only steers the search. A rank outside the rows gives None.
    Whole numbers stay whole, everything else is compared as double.
    """
    whole = dict(df.select(as_col(value).alias("x")).dtypes)["x"] in ("tinyint", "smallint", "int", "bigint")
    x = F.col("_x")
    rows = df.select(as_col(value).cast("bigint" if whole else "double").alias("_x")).where(x.isNotNull())
    if not whole:
        rows = rows.where(~F.isnan(x))
    slack = 2.0 / ACCURACY
    first = rows.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), _sketch(x, shares, slack).alias("q")).first()
    n, wanted = first["n"], list(ranks(first["n"]))
    outer = (first["lo"], first["hi"])
    searches: dict[int, _Search] = {}
    for i, rank in enumerate(wanted):
        if 0 <= rank < n:
            guess = outer if n <= listed else tuple(first["q"][2 * i:2 * i + 2])
            searches.setdefault(rank, _Search(rank, outer, guess))
    few = n <= listed or n * 4 * slack <= listed
    while open_ := [s for s in searches.values() if s.found is None]:
        names = [f"s{i}" for i in range(len(open_))]
        counted = rows.agg(*[m for s, name in zip(open_, names) for m in s.measures(x, name, few)])
        if few:
            counts = [c for c in counted.columns if not c.endswith("_list")]
            counted = counted.select(*counts, *[c for s, name in zip(open_, names) for c in s.pick(name)])
        row = counted.first()
        for s, name in zip(open_, names):
            s.learn(row, name, few)
        left = [s for s in open_ if s.found is None]
        few = False
        known = [s for s in left if s.inside is not None]
        if known and len(known) == len(left):
            few = all(s.inside[1] <= listed for s in known)
            if not few:
                sketches = [
                    _sketch(F.when((x > F.lit(s.guess[0])) & (x < F.lit(s.guess[1])), x), [(s.rank - s.inside[0]) / s.inside[1]], slack)
                    for s in known
                ]
                row = rows.agg(*[q.alias(f"q{i}") for i, q in enumerate(sketches)]).first()
                short = all(s.inside[1] * 4 * slack <= listed for s in known)
                few = all([s.narrow(*row[f"q{i}"]) for i, s in enumerate(known)]) and short
    return n, [searches[r].found if r in searches else None for r in wanted]


def quantiles(df: DataFrame, value: str | Column, probs: Sequence[float], listed: int = LISTED) -> list[float | None]:
    """Exact quantiles with linear interpolation; None where there are no values."""
    def ends(n: int) -> list[int]:
        return [int(f((n - 1) * p)) for p in probs for f in (_floor, _ceil)]

    n, found = ranked_values(df, as_col(value).cast("double"), [p for p in probs for _ in range(2)], ends, listed)
    out = []
    for i, p in enumerate(probs):
        low, high = found[2 * i], found[2 * i + 1]
        at = (n - 1) * p
        out.append(None if low is None else low.value + (high.value - low.value) * (at - _floor(at)))
    return out


def _floor(v: float) -> int:
    return int(v // 1)


def _ceil(v: float) -> int:
    return -int(-v // 1)
