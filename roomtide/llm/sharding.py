"""Sharding by longest processing time: what stays together goes, largest first, to the least-loaded shard.

Documents with equal texts form a group and stay in one shard. A group larger
than ``1 / (shards * FINE)`` of all bytes is an item of its own; there can be at
most ``shards * FINE`` of those. The smaller groups are put by hash into
``shards * FINE`` bundles, and each bundle is one item. So the heap on the driver
gets at most twice that many items whatever the corpus, each is a small part
of a shard, and the assignment that is broadcast has the same bound.

Defined cases: null text has no bytes and forms a group with other null texts
(not with empty ones). Repeated rows count. An empty table gives an empty
table. A group larger than a shard's share makes its shard that large. Ties go
to the item with the smaller key and to the shard with the smaller number.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, functions as F

from roomtide.llm.common import fresh, n_bytes, prefix_sums
from roomtide.session import durable

SHARDS, FINE = 16, 512
BLOCK_ROWS = 20_000


def longest_first(items: list[tuple[tuple, int]], shards: int) -> dict[tuple, int]:
    """Shard of each (key, size) item."""
    heap = [(0, s) for s in range(shards)]
    where = {}
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        where[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return where


def assign(docs: DataFrame, *, size: Column, group: Column, shards: int = SHARDS, fine: int = FINE) -> tuple[DataFrame, str]:
    """``docs`` with ``shard`` (0 to shards - 1), and the name of that column.

    ``size`` is a whole number per row, ``group`` a 64-bit key of the rows that
    stay together.
    """
    spark, limit = docs.sparkSession, shards * fine
    bundle = F.pmod(F.xxhash64(F.lit("bundle"), "_group"), F.lit(limit))
    keyed = docs.select(F.struct("*").alias("_doc"), group.alias("_group"), size.cast("bigint").alias("_bytes"))
    groups = durable(keyed.groupBy("_group").agg(F.sum("_bytes").alias("_bytes")))
    total = groups.agg(F.sum("_bytes")).first()[0] or 0
    large = F.col("_bytes") * limit > total
    alone = [tuple(r) for r in groups.where(large).select("_group", "_bytes").collect()]
    bundles = [tuple(r) for r in groups.where(~large).groupBy(bundle.alias("_bundle")).agg(F.sum("_bytes")).collect()]
    where = longest_first([((0, k), n) for k, n in alone] + [((1, k), n) for k, n in bundles], shards)
    of_group = spark.createDataFrame([(k, where[0, k]) for k, _ in alone], "_group bigint, _alone int")
    of_bundle = spark.createDataFrame([(k, where[1, k]) for k, _ in bundles], "_bundle bigint, _bundled int")
    placed = (
        keyed.withColumn("_bundle", bundle)
        .join(F.broadcast(of_group), "_group", "left").join(F.broadcast(of_bundle), "_bundle", "left")
    )
    name = fresh(docs, "shard")
    return placed.select(
        *[F.col("_doc").getField(c).alias(c) for c in docs.columns], F.coalesce("_alone", "_bundled").alias(name)
    ), name


def text_group(text: str) -> Column:
    """Key of equal texts; two texts that share it only share a shard."""
    return F.xxhash64(F.lit("group"), text, F.col(text).isNull())


def shard_plan(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: size, checksum, shard, and its gapless place in the shard."""
    size = n_bytes(F.col(text_col)) + 1
    rows = docs.select(
        F.col(id_col).alias("doc_id"), size.alias("size"), text_group(text_col).alias("_text"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    facts = durable(rows)
    placed, shard = assign(facts, size=F.col("size"), group=F.col("_text"), shards=shards)
    buckets = facts.count() // (shards * BLOCK_ROWS) + 1
    placed = placed.withColumn("_mark", F.xxhash64(F.lit("slot"), "doc_id", "_text"))
    placed = durable(placed.withColumn("_bucket", F.pmod("_mark", F.lit(buckets))).withColumn("_one", F.lit(1)))
    numbered = prefix_sums(placed, placed, [shard], ["_bucket"], ["_mark", "doc_id"], "_one", "_slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col(shard).alias("shard"),
        (F.col("_slot") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded_documents(docs: DataFrame, shards: int = SHARDS, text_col: str = "text") -> DataFrame:
    """``docs`` with the shard of each row in an added column ``shard``."""
    return assign(docs, size=n_bytes(F.col(text_col)) + 1, group=text_group(text_col), shards=shards)[0]
