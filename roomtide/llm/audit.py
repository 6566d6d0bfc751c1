"""How filters interact: what each removes at every place of every order.

Spark reduces the documents to counts per part and failure mask (which filters
a document fails). The counts of a part become a decision diagram with one level
per filter, whose nodes carry the weight below them. Swapping adjacent levels
turns the diagram of one order into that of the next, and all orders are reached
by such swaps. In each, the path on which every filter passes gives the steps:
the fail branch of its k-th node is what the k-th filter removes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from roomtide.llm.common import SPACE_GAP, named, portable

portable(__name__)

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MOST_FILTERS = 8  # 40320 orders

REPORT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint"
)

# --- the diagram ------------------------------------------------------------


class Node:
    """Weight of a branch and what is below it: ``low`` if the level's filter passes, ``high`` if it fails."""

    __slots__ = ("low", "high", "weight")

    def __init__(self, low: Node | None, high: Node | None, weight: tuple[int, ...]):
        self.low, self.high, self.weight = low, high, weight


class Diagram:
    """Decision diagram of the weights per failure mask, every level present, equal branches shared."""

    def __init__(self, weights: Mapping[int, tuple[int, ...]], filters: int, width: int):
        self.order = list(range(filters))
        self.levels: list[dict] = [{} for _ in range(filters)]
        self.leaves: dict = {}
        self.none = (0,) * width
        self.root = self._build(0, dict(weights))

    def _build(self, level: int, weights: dict[int, tuple[int, ...]]) -> Node:
        if level == len(self.order):
            weight = next(iter(weights.values()), self.none)
            return self.leaves.setdefault(weight, Node(None, None, weight))
        bit = 1 << self.order[level]
        low = self._build(level + 1, {m: w for m, w in weights.items() if not m & bit})
        high = self._build(level + 1, {m: w for m, w in weights.items() if m & bit})
        return self._node(level, low, high)

    def _node(self, level: int, low: Node, high: Node) -> Node:
        table, key = self.levels[level], (id(low), id(high))
        if key not in table:
            table[key] = Node(low, high, tuple(a + b for a, b in zip(low.weight, high.weight)))
        return table[key]

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the one below; nothing else in the diagram changes."""
        upper = list(self.levels[level].values())
        self.levels[level], self.levels[level + 1] = {}, {}
        for node in upper:
            low = self._node(level + 1, node.low.low, node.high.low)
            high = self._node(level + 1, node.low.high, node.high.high)
            node.low, node.high = low, high
            self.levels[level][id(low), id(high)] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def path(self) -> Iterator[tuple[int, Node]]:
        """Filters of the all-pass path with their nodes."""
        node = self.root
        for name in self.order:
            yield name, node
            node = node.low


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places to swap, one after the other, so that ``n`` things run through all their orders."""
    if n < 2:
        return
    down = True
    for place in adjacent_swaps(n - 1):
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        # the largest stands at one end meanwhile, which moves the others by one
        yield place + 1 if down else place
        down = not down
    yield from range(n - 2, -1, -1) if down else range(n - 1)


def alone(node: Node) -> tuple[int, ...]:
    """Weight of what fails the filter of the first level and no other."""
    node = node.high
    while node.low is not None:
        node = node.low
    return node.weight


def all_orders(part: str, weights: Mapping[int, tuple[int, int, int]], letters: str) -> list[dict]:
    """Rows of the report for one part."""
    n = len(letters)
    diagram = Diagram(weights, n, 3)
    rows, fails, only, shapley = [], {}, {}, [0] * n

    def note() -> None:
        first = diagram.order[0]
        fails[first], only[first] = diagram.root.high.weight[0], alone(diagram.root)[0]
        name = "".join(letters[i] for i in diagram.order)
        for step, (i, node) in enumerate(diagram.path(), 1):
            removed, good, toxic = node.high.weight
            shapley[i] += removed
            rows.append({
                "part": part, "filter_order": name, "step": step, "kept": node.low.weight[0], "removed": removed,
                "good_lost": good, "toxic_lost": toxic, "_filter": i,
            })

    note()
    for place in adjacent_swaps(n):
        diagram.swap(place)
        note()
    for row in rows:
        i = row.pop("_filter")
        row.update(redundant=fails[i] - row["removed"], unique_fails=only[i], shapley=shapley[i])
    return rows


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """The report from ``part, mask, rows, good, toxic``; bit ``i`` of ``mask`` stands for filter ``letters[i]``.

    One row per part, order and step. A part has at most two to the number of
    filters masks, so its rows fit one task whatever the corpus; the number of
    orders grows with the factorial, hence ``MOST_FILTERS``.
    """
    if not 1 <= len(letters) <= MOST_FILTERS or len(set(letters)) != len(letters):
        raise ValueError(f"between 1 and {MOST_FILTERS} different letters are needed: {letters!r}")
    whole = counts.groupBy("part", "mask").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("rows", "good", "toxic")])
    columns = [field.split()[0] for field in REPORT.split(", ")]

    def report(counts: pd.DataFrame) -> pd.DataFrame:
        weights = {row.mask: (row.rows, row.good, row.toxic) for row in counts.itertuples()}
        return pd.DataFrame(all_orders(counts["part"].iloc[0], weights, letters), columns=columns)

    return whole.groupBy("part").applyInPandas(report, REPORT)


# --- the filters ------------------------------------------------------------

def few_words(words: Column, text: Column) -> Column:
    return F.size(words) < 100


def repetitive(words: Column, text: Column) -> Column:
    return F.size(F.array_distinct(words)).cast("bigint") * 100 < F.size(words).cast("bigint") * 80


def loud(words: Column, text: Column) -> Column:
    capitals = F.char_length(text) - F.char_length(F.translate(text, CAPITALS, ""))
    return capitals.cast("bigint") * 100 > F.char_length(text).cast("bigint") * 10


def symbols(words: Column, text: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


Rule = Callable[[Column, Column], Column]
RULES: dict[str, Rule] = {"A": few_words, "B": repetitive, "C": loud, "D": symbols}
COPIES = "E"


def failure_counts(
    docs: DataFrame, labels: DataFrame, rules: Mapping[str, Rule], key: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """``part, mask, rows, good, toxic`` of all documents; the bit after the rules' is set for later copies.

    Only digests of texts are shuffled, and rows of equal texts are counted
    together on the way, so a text that a third of all documents share is no
    hot group. The smallest id of a text is looked up among its few sums.
    """
    body = F.coalesce(named(text), F.lit(""))
    rows = docs.select(named(key).alias("id"), F.coalesce(named(part), F.lit("")).alias("part"), body.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE_GAP), ""))
    mask = F.lit(0)
    for i, rule in enumerate(rules.values()):
        mask = mask + F.when(rule(F.col("words"), F.col("text")), 1 << i).otherwise(0)
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("same"), mask.alias("mask"))
    rows = rows.groupBy("id", "part", "same", "mask").agg(F.count(F.lit(1)).alias("n"))

    # a null id finds no label; its stand-in spreads such rows over all tasks
    has_id, stand_in = F.col("id").isNotNull().alias("_has"), F.coalesce("id", F.xxhash64("same")).alias("_id")
    known = labels.groupBy(named(key).alias("_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    ).withColumn("_has", F.lit(True))
    rows = rows.select("*", has_id, stand_in).join(known, ["_id", "_has"], "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    sums = rows.groupBy("same", "part", "mask", *flags).agg(
        F.sum("n").alias("n"), first.alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n"))).alias("no_id")
    )
    smallest = F.min("first.id").over(Window.partitionBy("same"))
    sums = sums.withColumn("smallest", smallest)
    original = F.when(F.col("first.id") == F.col("smallest"), F.col("first.n"))
    passing = F.coalesce(original, F.lit(0)) + F.coalesce("no_id", F.lit(0))
    halves = F.array(
        F.struct("mask", passing.alias("n")), F.struct((F.col("mask") + (1 << len(rules))).alias("mask"), (F.col("n") - passing).alias("n"))
    )
    sums = sums.select("part", "good", "toxic", F.inline(halves)).where("n > 0")
    return sums.groupBy("part", "mask").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("good"),
        F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("toxic"),
    )


def interaction_audit(
    docs: DataFrame, labels: DataFrame, rules: Mapping[str, Rule] = RULES, copies: str = COPIES,
    key: str = "doc_id", text: str = "text", part: str = "lang",
) -> DataFrame:
    """What each of ``rules`` and the copy filter removes, per part, order of the filters and step.

    A rule gets the text and its words (between white space) and says whether a
    text fails. The copy filter fails every document whose text equals that of a
    smaller id, anywhere in the table. Null text counts as empty, null part as
    the empty string. A null id has no label, is no copy and makes none; rows
    that repeat an id count as rows, and equal texts under one id are no copies
    of each other. A document is good or toxic if any of its labels says so. An
    empty table gives no rows. Other columns are ignored, whatever their names.
    """
    counts = failure_counts(docs, labels, rules, key, text, part)
    return audit(counts, "".join(rules) + copies)
