"""Order-dependent operators that never put one key's rows into one task.

A window over a whole zone, or over a whole series, would pull all of that
zone's rows into one task. The operators below cut a series into pieces first
(value bins, range slices, or blocks of a slot number), work inside a piece,
and carry what crosses a border through a summary with one row per piece.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from roomtide.functions.scalars import after, as_col, bucket, epoch_micros
from roomtide.operators.selection import ranked_values
from roomtide.session import durable

BLOCK = 8192
BINS_PER_DOUBLING = 4096


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null matches null; keeps the left key columns."""
    right = right.withColumnsRenamed({k: f"_rk_{k}" for k in keys})
    condition = None
    for k in keys:
        same = left[k].eqNullSafe(right[f"_rk_{k}"])
        condition = same if condition is None else condition & same
    return left.join(right, condition, how).drop(*[f"_rk_{k}" for k in keys])


# --- exact order statistics -------------------------------------------------

def _pick(
    freq: DataFrame, keys: Sequence[str], ranks: dict[str, Callable[[Column], Column]], totals: Sequence[Total] = (),
) -> DataFrame:
    """Values at given 0-based ranks, per key.

    ``freq`` holds one row per key and distinct value: ``_v``, its weight ``_w``
    and a bin ``_bin`` that never decreases with ``_v``. The bins of a key (a
    bounded number) give the ranks at which each bin starts; only bins that
    hold a wanted rank are then sorted. Returns per key ``_total`` and, for each
    name, the value and ``<name>_below``, the weight of all smaller values.
    ``totals`` are sums, minima or maxima of ``freq`` that are wanted besides;
    they are taken per bin on the way and named by their alias. A row without
    value (and without bin) counts in them only.
    """
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.when(F.col("_bin").isNotNull(), F.col("_w")).otherwise(F.lit(0)) if totals else F.col("_w")
    carried = [f"_t{i}" for i, _ in enumerate(totals)]
    bins = (
        freq.groupBy(*keys, "_bin")
        .agg(F.sum(weight).alias("_bin_w"), *[t.how(t.of).alias(name) for t, name in zip(totals, carried)])
        .withColumn("_total", F.sum("_bin_w").over(whole))
        .withColumn("_before", F.coalesce(F.sum("_bin_w").over(earlier), F.lit(0)))
        .withColumns({name: t.how(name).over(whole) for t, name in zip(totals, carried)})
    )
    wanted = F.lit(False)
    for name, rank in ranks.items():
        bins = bins.withColumn(f"_r_{name}", rank(F.col("_total")))
        r = F.col(f"_r_{name}")
        wanted = wanted | ((r >= F.col("_before")) & (r < F.col("_before") + F.col("_bin_w")))
    if totals:  # a key without any value still has its totals: its bin of rows without value stands in
        wanted = wanted | ((F.col("_total") == 0) & F.col("_bin").isNull())
    rows = match(freq, bins.where(wanted), [*keys, "_bin"])
    running = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.sum("_w").over(running) + F.col("_before"))
    picked = [F.max("_total").alias("_total"), *[F.max(name).alias(t.name) for t, name in zip(totals, carried)]]
    for name in ranks:
        here = F.col("_upto") > F.col(f"_r_{name}")
        picked.append(F.min(F.when(here, F.col("_v"))).alias(name))
        picked.append(F.min(F.when(here, F.col("_upto") - F.col("_w"))).alias(f"{name}_below"))
    return rows.groupBy(*keys).agg(*picked)


class Total(NamedTuple):
    """A total that can be taken in steps: ``how`` is ``F.sum``, ``F.min`` or ``F.max``."""

    name: str
    how: Callable[..., Column]
    of: Column


def with_bins(freq: DataFrame) -> DataFrame:
    """Bin number of ``_v`` on a logarithmic scale, 4096 bins per doubling.

    The scale is fixed, so it takes no pass over the data to set it up, and
    a few wild readings cannot squeeze all others into one bin.
    """
    v = F.col("_v").cast("double")
    size = F.floor(F.log2(F.abs(v) * 2.0**20 + 1.0) * BINS_PER_DOUBLING)
    capped = F.when(F.abs(v) > 1e300, F.lit(2000 * BINS_PER_DOUBLING)).otherwise(size).cast("bigint")
    return freq.withColumn("_bin", F.when(v < 0, -capped).otherwise(capped))


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    probs: dict[str, float],
    weight: str | Column | None = None,
    few_values: bool = False,
) -> DataFrame:
    """Exact percentiles with linear interpolation, per key.

    Equal values are counted together before anything is sorted, and the sort
    covers only the value bins in which a percentile lies, so a hot key is
    spread over as many tasks as it has distinct values. Nulls are ignored.
    ``few_values`` says that a key has a small number of distinct values by its
    nature (head counts); their counts then go to Spark's own ``percentile``.
    """
    value = as_col(value).cast("double")
    weight = F.lit(1) if weight is None else as_col(weight)
    rows = df.select(*keys, value.alias("_v"), weight.cast("bigint").alias("_w"))
    rows = rows.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counted = rows.groupBy(*keys, "_v").agg(F.sum("_w").alias("_w"))
    if few_values:
        return counted.groupBy(*keys).agg(*[F.percentile("_v", p, F.col("_w")).alias(name) for name, p in probs.items()])
    return _interpolated(with_bins(counted), keys, probs)


def summary(
    df: DataFrame, keys: Sequence[str], value: str | Column, probs: dict[str, float], totals: Sequence[Total] = ()
) -> DataFrame:
    """``rows``, ``mean`` of the known values, ``totals`` and exact percentiles per key, from one counted table.

    The table has a row per key and distinct value with its count. Rows without
    a value (null or NaN) count in ``rows`` and in the totals only.
    """
    value = as_col(value).cast("double")
    rows = df.withColumn("_v", F.when(~F.isnan(value), value))
    own = [f"_o{i}" for i, _ in enumerate(totals)]
    freq = with_bins(rows.groupBy(*keys, "_v").agg(
        F.count(F.lit(1)).alias("_w"), *[t.how(t.of).alias(name) for t, name in zip(totals, own)]
    ))
    further = [
        Total("rows", F.sum, F.col("_w")), Total("_sum", F.sum, F.col("_v") * F.col("_w")),
        *[t._replace(of=F.col(name)) for t, name in zip(totals, own)],
    ]
    found = _interpolated(freq, keys, probs, further)
    mean = F.try_divide("_sum", F.col("_total").cast("double"))
    names = ["rows", *[t.name for t in totals], *probs]
    return found.withColumn("rows", F.coalesce("rows", F.lit(0))).select(*keys, mean.alias("mean"), *names)


def _interpolated(
    freq: DataFrame, keys: Sequence[str], probs: dict[str, float], totals: Sequence[Total] = ()
) -> DataFrame:
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in probs.items():
        ranks[f"{name}_lo"] = lambda n, p=p: F.floor((n - 1) * F.lit(p)).cast("bigint")
        ranks[f"{name}_hi"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p)).cast("bigint")
    found = _pick(freq, keys, ranks, totals)
    out = []
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(p)
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    if not totals:
        return found.select(*keys, *out)
    return found.select(*keys, "_total", *[t.name for t in totals], *out)


def chronological_split(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    train_ratio: float,
    tie_breaker: str | None = None,
    at_least: int = 0,
    bin_seconds: int = 3600,
) -> DataFrame:
    """Mark the first ``int(n * train_ratio)`` rows of each key in time order.

    Adds boolean ``is_train``. The moment of the last training row is found
    by counting rows per time bin and sorting only the bin that holds it, so no
    key is sorted as a whole. Rows that share that moment are told apart by
    ``tie_breaker`` (a number, unique within a moment); without one they all
    count as training rows. Without keys the cut is found first and enters the
    plan as literals (``chronological_cut``).
    """
    rows = df.where(F.col(ts).isNotNull())
    if not keys:
        return rows.withColumn("is_train", chronological_cut(rows, ts, train_ratio, tie_breaker, at_least))

    def last_train(n: Column) -> Column:
        size = F.floor(n.cast("double") * F.lit(float(train_ratio))).cast("bigint")
        return F.greatest(size, F.lit(at_least).cast("bigint")) - 1

    freq = (
        rows.groupBy(*keys, F.col(ts).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_w"))
        .withColumn("_bin", bucket("_v", bin_seconds))
    )
    cut = _pick(freq, keys, {"_cut": last_train})
    cut = cut.select(*keys, "_cut", (last_train(F.col("_total")) - F.col("_cut_below")).alias("_cut_rank"))
    marked = match(rows, cut, keys, "left")
    before = F.col(ts) < F.col("_cut")
    same = F.col(ts) == F.col("_cut")
    if tie_breaker is None:
        is_train = before | same
        return marked.withColumn("is_train", F.coalesce(is_train, F.lit(False))).drop("_cut", "_cut_rank")
    tied = marked.where(same).withColumn("_t", F.col(tie_breaker))  # in its own type: a double would merge large ids
    tied = with_bins(tied.groupBy(*keys, "_cut_rank", F.col("_t").alias("_v")).agg(F.count(F.lit(1)).alias("_w")))
    # the rank within the tied rows differs per key, so it is part of the key
    marked = match(marked, _pick_ranked(tied, keys), keys, "left")
    is_train = before | (same & (F.col(tie_breaker) <= F.col("_cut_tie")))
    return marked.withColumn("is_train", F.coalesce(is_train, F.lit(False))).drop("_cut", "_cut_rank", "_cut_tie")


def chronological_cut(
    df: DataFrame, ts: str, train_ratio: float, tie_breaker: str | None = None, at_least: int = 0
) -> Column:
    """Predicate of the first ``int(n * train_ratio)`` rows (``at_least`` so many) in time order, made of literals.

    Runs the search for the cut; a tie-breaker is looked at only if the cut
    falls between rows of one moment.
    """
    def last_train(n: int) -> int:
        return max(int(n * float(train_ratio)), at_least) - 1

    n, (cut,) = ranked_values(df, epoch_micros(ts), [train_ratio], lambda n: [last_train(n)])
    if cut is None:
        return F.lit(last_train(n) >= 0)
    moment = after(F.lit("1970-01-01").cast("timestamp_ntz"), F.lit(cut.value)).cast(df.schema[ts].dataType)
    if tie_breaker is None or last_train(n) == cut.below + cut.equal - 1:
        return F.col(ts) <= moment
    rank = last_train(n) - cut.below
    _, (tie,) = ranked_values(df.where(F.col(ts) == moment), tie_breaker, [rank / cut.equal], lambda n: [rank])
    last = F.lit(False) if tie is None else F.coalesce(F.col(tie_breaker) <= F.lit(tie.value), F.lit(False))
    return (F.col(ts) < moment) | ((F.col(ts) == moment) & last)


def _pick_ranked(tied: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tie-breaker value at rank ``_cut_rank`` of each key's tied rows."""
    whole = [*keys, "_cut_rank"]
    found = _pick(tied, whole, {"_cut_tie": lambda n: F.col("_cut_rank")})
    return found.select(*keys, "_cut_tie")


# --- row numbers ------------------------------------------------------------

SLICES_PER_TASK = 4


def _on_a_line(df: DataFrame, name: str) -> Column | None:
    """The column as a double that never decreases with it, nulls first; None for types that have no such double."""
    kind = dict(df.dtypes)[name]
    if kind in ("timestamp", "timestamp_ntz", "date"):
        value = epoch_micros(F.col(name).cast("timestamp_ntz")).cast("double")
    elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        value = F.col(name).cast("double")
    else:
        return None
    return F.when(F.isnan(value), F.lit(float("inf"))).otherwise(F.coalesce(value, F.lit(float("-inf"))))


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "_slice") -> DataFrame:
    """Cut rows into slices that grow with ``order``, of about equal size.

    Where the first column of ``order`` is a number or a moment, one pass finds
    its quantiles; as literal borders they cut every later pass alike, and
    nothing is written. Rows of one value of that column share a slice. Other
    types go through a range partitioning, which is written, because its borders
    come from a sample.
    """
    line = _on_a_line(df, order[0])
    if line is None:
        dealt = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]])
        return durable(dealt.withColumn(name, F.spark_partition_id()))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * SLICES_PER_TASK
    probs = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(line, probs, max(8 * n, 1000)).alias("q")).first()["q"] or []
    borders = sorted({b for b in found if abs(b) != float("inf")})
    cut = Bucketizer(splits=[float("-inf"), *borders, float("inf")], inputCol="_line", outputCol=name)
    if not borders:
        return df.withColumn(name, F.lit(0))
    return cut.transform(df.withColumn("_line", line)).withColumn(name, F.col(name).cast("int")).drop("_line")


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_no") -> DataFrame:
    """Exact 1-based row number within each key, in ``order``; also ``<name>_total``.

    Rows are cut into slices, so one hot key fills many of them. A count per
    slice gives the number at which it starts; inside a slice rows are numbered
    by a window. ``order`` should identify a row within its key.
    """
    cut = sliced(df, keys, order)
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        cut.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .withColumn(f"{name}_total", F.sum("_size").over(whole))
        .drop("_size")
    )
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        match(cut, sizes, [*keys, "_slice"])
        .withColumn(name, F.row_number().over(within) + F.col("_before"))
        .drop("_slice", "_before")
    )


# --- blocks of a slot number ------------------------------------------------

def with_halo(df: DataFrame, slot: str, left: int, right: int, block: int = BLOCK) -> DataFrame:
    """Cut a series numbered by ``slot`` into blocks that overlap.

    Every row lands in its own block (``_block``, ``_own`` true); rows close to
    a border are repeated as the neighbour's halo (``_own`` false). A window
    frame reaching ``left`` slots back and ``right`` slots ahead is then exact
    inside ``partitionBy(keys, "_block")``.
    """
    block = max(block, left, right, 1)
    home = F.floor(F.col(slot) / F.lit(block)).cast("bigint")
    offset = F.pmod(F.col(slot), F.lit(block))
    targets = F.array_compact(
        F.array(
            home,
            F.when(offset >= block - left, home + 1) if left else F.lit(None).cast("bigint"),
            F.when(offset < right, home - 1) if right else F.lit(None).cast("bigint"),
        )
    )
    return df.withColumn("_home", home).withColumn("_block", F.explode(targets)).withColumn(
        "_own", F.col("_block") == F.col("_home")
    ).drop("_home")


def slot_lags(
    df: DataFrame, keys: Sequence[str], slot: str, value: str, lags: Sequence[int], prefix: str, block: int = BLOCK
) -> DataFrame:
    """Value ``k`` rows earlier for each ``k``, on rows numbered without holes by ``slot``."""
    if not lags:
        return df
    ordered = Window.partitionBy(*keys, "_block").orderBy(slot)
    haloed = with_halo(df, slot, left=max(lags), right=0, block=block)
    lagged = haloed.select("*", *[F.lag(value, k).over(ordered).alias(f"{prefix}{k}") for k in lags])
    return lagged.where("_own").drop("_own", "_block")


def so_far(ordered: WindowSpec, skip: int) -> WindowSpec:
    """Frame from the start up to ``skip`` rows before the current one.

    Looking ahead uses this frame on the reversed order: Spark keeps a running
    value for it, while a frame that ends at the last row is evaluated anew for
    every row.
    """
    return ordered.rowsBetween(Window.unboundedPreceding, -skip)


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    chunk: Column,
    inclusive: bool = True,
) -> DataFrame:
    """Nearest non-null ``value`` before and after each row: ``_prev`` and ``_next``.

    ``chunk`` must grow with ``order``. Inside a chunk a window finds the
    neighbour; across chunks it comes from a table with one row per chunk. That
    table is made from the rows as they are dealt to the windows: its border
    rows are kept whole, so both sides ask for the same exchange, and the input
    is built once.
    """
    reach = 0 if inclusive else 1
    cut = df.withColumn("_val", value).withColumn("_chunk", chunk).repartition(*[F.col(c) for c in [*keys, "_chunk"]])
    inside = Window.partitionBy(*keys, "_chunk")
    rows = cut.withColumn("_prev", F.last("_val", True).over(so_far(inside.orderBy(order), reach)))
    rows = rows.withColumn("_next", F.last("_val", True).over(so_far(inside.orderBy(F.desc(order)), reach)))
    present = F.when(F.col("_val").isNotNull(), F.col(order))
    whole_row = F.struct(*[F.col(f"`{c}`") for c in cut.columns])
    borders = cut.groupBy(*keys, "_chunk").agg(
        F.max_by(whole_row, present).alias("_tail"), F.min_by(whole_row, present).alias("_head")
    )
    across = Window.partitionBy(*keys)
    borders = borders.select(
        *keys, "_chunk",
        F.last("_tail", True).over(so_far(across.orderBy("_chunk"), 1)).getField("_val").alias("_from_left"),
        F.last("_head", True).over(so_far(across.orderBy(F.desc("_chunk")), 1)).getField("_val").alias("_from_right"),
    )
    return (
        match(rows, borders, [*keys, "_chunk"], "left")
        .withColumn("_prev", F.coalesce("_prev", "_from_left"))
        .withColumn("_next", F.coalesce("_next", "_from_right"))
        .drop("_val", "_chunk", "_from_left", "_from_right")
    )


def runs(
    df: DataFrame, keys: Sequence[str], slot: str, flag: str, sums: Sequence[str] = (), lowest: Sequence[str] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Maximal runs of consecutive slots whose ``flag`` holds.

    One row per run: ``first_slot``, ``last_slot``, ``length`` and, for every
    column in ``sums``, its sum and its non-null count (``<c>_sum``, ``<c>_n``);
    for those in ``lowest`` the smallest value under their own name. Runs are
    built inside blocks; the pieces that touch a block border (at most two per
    block) are stitched over the whole series. Border and inner pieces go
    through the same exchange: an inner piece is a lane of its own.
    """
    on = df.where(F.col(flag)).withColumn("_block", F.floor(F.col(slot) / F.lit(block)).cast("bigint"))
    inside = Window.partitionBy(*keys, "_block").orderBy(slot)
    on = on.withColumn("_island", F.col(slot) - F.row_number().over(inside))
    pieces = on.groupBy(*keys, "_block", "_island").agg(
        F.min(slot).alias("first_slot"),
        F.max(slot).alias("last_slot"),
        *[F.sum(c).alias(f"{c}_sum") for c in sums],
        *[F.count(c).alias(f"{c}_n") for c in sums],
        *[F.min(c).alias(c) for c in lowest],
    )
    at_border = (F.pmod(F.col("first_slot"), F.lit(block)) == 0) | (
        F.pmod(F.col("last_slot"), F.lit(block)) == block - 1
    )
    pieces = pieces.withColumn("_lane", F.when(at_border, F.lit(-1)).otherwise(F.col("_island")))
    pieces = pieces.withColumn("_of_block", F.when(at_border, F.lit(-1)).otherwise(F.col("_block")))
    lane = [*keys, "_of_block", "_lane"]
    across = Window.partitionBy(*lane).orderBy("first_slot")
    joined = F.col("first_slot") == F.lag("last_slot").over(across) + 1
    pieces = pieces.withColumn("_start", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    pieces = pieces.withColumn("_run", F.sum("_start").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    found = pieces.groupBy(*lane, "_run").agg(
        F.min("first_slot").alias("first_slot"),
        F.max("last_slot").alias("last_slot"),
        *[F.sum(f"{c}_{s}").alias(f"{c}_{s}") for c in sums for s in ("sum", "n")],
        *[F.min(c).alias(c) for c in lowest],
    )
    return found.drop("_of_block", "_lane", "_run").withColumn("length", F.col("last_slot") - F.col("first_slot") + 1)
