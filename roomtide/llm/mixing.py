"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected the same number of times (target size
over source size). Within its source the documents stand in a fixed order;
their expected copies are summed up, one offset per source is added, and a
document is emitted once for each whole number its interval crosses. The order
goes by size class, so every size is drawn evenly and the words taken come
close to the target although documents differ much in length.

A hot source is no single task: the order is cut into blocks (size class and
hash bucket, the number of buckets follows the source's row count), the sums of
the blocks are a small table, and only the rows of one block are sorted
together. Expected copies are whole multiples of 2**-24, so sums do not depend
on the order of addition and reruns agree.

Defined cases: null and empty texts have size 0 and are drawn like others; in a
source without any word every document is taken once. Null sources form one
source, which comes last. Repeated rows count and are drawn as rows. An empty
table gives an empty table. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from roomtide.llm.common import fresh, n_space_words, named, prefix_sums
from roomtide.operators.ordered import match, number_rows
from roomtide.session import durable

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
UNIT = 24  # expected copies are counted in 2**-24
BLOCK_ROWS = 2_000


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Target of each source from (_source, _size, _rows): shares by weight, none above ``cap`` times its size.

    What a capped source cannot take goes to the others by weight, until none
    is above its cap. Each round is one aggregate over the table of sources.
    """
    listed = sizes.withColumn("_all", F.lit(0)).withColumn("_last", F.col("_source").isNull())
    numbered = number_rows(listed, ["_all"], ["_last", "_source"], "_no")
    nth = F.pmod(F.col("_no") - 1, F.lit(len(weights)))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), nth.cast("int"))
    table = durable(numbered.select("_source", "_size", "_rows", weight.alias("_weight"), (F.col("_size") * cap).alias("_most")))
    level, capped = 0.0, -1
    while True:
        above = F.col("_most") < F.col("_weight") * level
        found = table.agg(
            F.coalesce(F.sum("_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(above, F.col("_most"))), F.lit(0.0)).alias("taken"),
            F.coalesce(F.sum(F.when(~above, F.col("_weight"))), F.lit(0)).alias("weight"),
            F.count_if(above).alias("capped"),
        ).first()
        if found["capped"] == capped or not found["weight"]:
            break
        capped, level = found["capped"], (share * found["total"] - found["taken"]) / found["weight"]
    return table.withColumn("_target", F.least("_most", F.col("_weight") * level))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20,
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, keep: Sequence[str] | None = None,
) -> tuple[DataFrame, dict[str, str]]:
    """Every document with ``size``, ``source_size``, ``target`` and ``copies`` (0, 1, ...), and the added names.

    ``keep`` names the columns of ``docs`` to keep; without it all are kept.
    """
    kept = list(docs.columns if keep is None else keep)
    sized = docs.select(
        F.struct(*[named(c) for c in kept]).alias("_doc"), F.col(source_col).cast("string").alias("_source"), n_space_words(F.col(text_col)).alias("_size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_mark"),
    )
    narrow = text_col not in kept
    facts = durable(sized if narrow else sized.select("_source", "_size", "_mark"))
    totals = facts.groupBy("_source").agg(F.sum("_size").alias("_size"), F.count(F.lit(1)).alias("_rows"))
    rate = F.when(F.col("_size") == 0, 1.0).otherwise(F.col("_target") / F.col("_size"))
    rates = durable(source_targets(totals, weights, share, cap).select(
        "_source", F.col("_size").alias("_source_size"), "_target",
        F.round(rate * (1 << UNIT)).cast("bigint").alias("_expected"),
        F.pmod(F.xxhash64(F.lit(seed), "_source"), F.lit(1 << UNIT)).alias("_offset"),
        (F.floor(F.col("_rows") / BLOCK_ROWS) + 1).alias("_buckets"),
    ))

    def blocked(rows: DataFrame) -> DataFrame:
        return match(rows, rates, ["_source"]).withColumns({
            "_class": F.length(F.bin("_size")), "_bucket": F.pmod("_mark", "_buckets"),
        })

    ordered = prefix_sums(
        blocked(facts if narrow else sized), blocked(facts), ["_source"], ["_class", "_bucket"],
        ["_size", "_mark"], "_expected", "_through",
    )
    last = F.shiftright(F.col("_through") + F.col("_offset"), UNIT)
    before = F.shiftright(F.col("_through") + F.col("_offset") - F.col("_expected"), UNIT)
    names = {name: fresh(docs, name) for name in ("size", "source_size", "target", "copies")}
    return ordered.select(
        *[F.col("_doc").getField(c).alias(c) for c in kept], F.col("_size").alias(names["size"]), F.col("_source_size").alias(names["source_size"]),
        F.col("_target").alias(names["target"]), (last - before).alias(names["copies"]),
    ), names


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document repeated as often as it is drawn, with the columns of ``docs``."""
    df, names = mix(docs, **options)
    copies = F.col(names["copies"]).cast("int")
    return df.where(copies > 0).withColumn(names["size"], F.explode(F.array_repeat(F.lit(1), copies))).select(*[named(c) for c in docs.columns])


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes of it."""
    df, names = mix(docs.select("doc_id", "source", "text"), keep=["doc_id"])
    return df.select(
        "doc_id", F.col(names["size"]).alias("size"), F.col(names["source_size"]).alias("source_size"),
        F.col(names["target"]).alias("target"), (F.col(names["copies"]) * F.col(names["size"])).alias("taken"),
    )
