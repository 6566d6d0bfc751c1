"""Quality rules: text statistics, and a hashed n-gram likelihood ratio between trusted and raw text.

Raw text is all of the corpus: the byte n-grams of every document are hashed
into ``BUCKETS`` counters, each task sums its own, and the tasks' counters are
summed by bucket. Trusted text is a bounded sample (``trusted_rows`` documents,
taken by the hash of their id) of the documents labelled good; its counters
come from the same pass. Both become smoothed multinomials, and a document's
score is the mean over its n-grams of log(trusted / raw). Every document is
held against one threshold, learned from the scores of all labelled documents
that pass the base rules: the one that best separates documents labelled good
from those labelled bad (quality 0 or toxic) among those that lose at most a
share ``tail`` of the good ones. It never lies more than ``margin`` below the
highest threshold with that share; without documents labelled bad it lies there.

Defined cases: null and empty texts have no words and fail the base rules.
Repeated rows count as rows in the corpus and are scored alike. A document with
a good and a bad label counts as good. Without
trusted documents the ratio is 0 everywhere and only the base rules decide.
Labels without a document, and documents without a label, change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roomtide.llm.common import SPACE_GAPS, Hasher, Words, blocks, byte_set, portable, text_bytes
from roomtide.session import durable

portable(__name__)

BUCKETS, GRAM = 1 << 14, 3
TRUSTED_ROWS = 5_000
TAIL, MARGIN = 0.002, 0.15
SMOOTHING = 1.0
STEPS = 4096  # score bins in 1
MIN_WORDS, MAX_REPEAT_PCT, REPEAT_WINDOW = 10, 20, 5

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
NEWLINE = byte_set((0x0A, 0x0A))


def gram_buckets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each byte that begins one, and the number of n-grams of each text."""
    n = len(buf) - GRAM + 1
    counts = np.maximum(np.diff(offsets) - GRAM + 1, 0)
    if n <= 0:
        return np.zeros(0, np.int64), counts
    code = np.zeros(n, dtype=np.uint32)
    for i in range(GRAM):
        code = (code << np.uint32(8)) | buf[i:i + n]
    z = (code + np.uint32(0x7F4A7C15)) * np.uint32(0x9E3779B1)
    z = (z ^ (z >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    bucket = (z ^ (z >> np.uint32(13))) & np.uint32(BUCKETS - 1)
    end = np.repeat(offsets[1:], np.diff(offsets))[:n]
    return bucket[np.arange(GRAM, n + GRAM) <= end].astype(np.int64), counts


def sums_by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``; the run lengths are ``counts``."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def count_grams(docs: DataFrame, text_col: str, trusted_col: str) -> DataFrame:
    """(bucket, raw, trusted): n-grams of all rows and of the trusted rows, in every bucket."""
    def tally(batches):
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in blocks(batches, text_col):
            buf, offsets = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            bucket, counts = gram_buckets(buf, offsets)
            raw += np.bincount(bucket, minlength=BUCKETS)
            marked = np.asarray(batch.column(batch.schema.get_field_index(trusted_col)).fill_null(False))
            if marked.any():
                good += np.bincount(bucket[np.repeat(marked, counts)], minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"bucket": np.arange(BUCKETS), "raw": raw, "trusted": good})

    parts = docs.mapInArrow(tally, "bucket bigint, raw bigint, trusted bigint")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def log_ratio(counts: DataFrame) -> np.ndarray:
    """log(trusted share / raw share) of each bucket; the table has ``BUCKETS`` rows whatever the corpus."""
    table = counts.orderBy("bucket").toPandas()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[table["bucket"]], good[table["bucket"]] = table["raw"], table["trusted"]
    if not good.sum():
        return np.zeros(BUCKETS)
    smooth = lambda x: (x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS)
    return np.log(smooth(good) / smooth(raw))


def repeated_words(words: Words, hasher: Hasher) -> np.ndarray:
    """Words of each text that lie in a window of REPEAT_WINDOW words found twice or more in that text."""
    at = words.windows(REPEAT_WINDOW)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    if len(at):
        grams = dict(hasher.grams(hasher.words(words), [REPEAT_WINDOW]))[REPEAT_WINDOW][at]
        doc = words.doc[at]
        order = np.lexsort((grams, doc))
        same = (grams[order][1:] == grams[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + REPEAT_WINDOW, -1)
    return sums_by_text((np.cumsum(covered[:-1]) > 0).astype(np.int64), words.counts)


def repeated_lines(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line of it."""
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    breaks = sums_by_text(NEWLINE[buf].astype(np.int64), np.diff(offsets))
    for d in np.flatnonzero(breaks).tolist():
        seen: set[bytes] = set()
        for line in buf[offsets[d]:offsets[d + 1]].tobytes().split(b"\n"):
            if line.strip(b" \t\n\v\f\r"):
                out[d] += line in seen
                seen.add(line)
    return out


def measures(docs: DataFrame, text_col: str, ratio: np.ndarray) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and llr."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ratio)
    counted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def measure(batches):
        hasher, weights = Hasher(), shared.value
        for batch in blocks(batches, text_col):
            buf, offsets = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            words = Words(buf, offsets, SPACE_GAPS)
            sizes = np.diff(offsets)
            letter = ~SPACE_GAPS[buf] & ((buf & 0xC0) != 0x80)
            bucket, counts = gram_buckets(buf, offsets)
            llr = sums_by_text(weights[bucket], counts) / np.maximum(counts, 1)
            columns = [
                words.counts, sums_by_text(letter.astype(np.int64), sizes), sums_by_text(SYMBOL[buf].astype(np.int64), sizes),
                repeated_lines(buf, offsets), repeated_words(words, hasher), llr,
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c) for c in columns]], names=[*batch.schema.names, *counted, "llr"]
            )

    added = {c: F.lit(0).cast("bigint") for c in counted} | {"llr": F.lit(0.0)}
    schema = docs.withColumns(added).schema
    for field in schema.fields:
        field.nullable = True
    return docs.mapInArrow(measure, schema)


def separating_score(labelled: DataFrame, tail: float, margin: float) -> float:
    """The threshold of ``labelled`` (llr, good); scores are log ratios of counts, so the table of bins is bounded."""
    bins = labelled.groupBy(F.floor(F.col("llr") * STEPS).alias("bin")).agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    )
    table = bins.orderBy("bin").toPandas()
    at, good, bad = (table[c].to_numpy(np.int64) for c in ("bin", "good", "bad"))
    if not good.sum():
        return -margin
    lost = (np.cumsum(good) - good) / good.sum()  # by a threshold at the lower border of each bin
    caught = (np.cumsum(bad) - bad) / max(bad.sum(), 1)
    allowed = np.flatnonzero(lost <= tail)
    best = allowed[np.argmax((caught - lost)[allowed])]
    middle = (at[best - 1] + 1 + at[best]) / 2 / STEPS if best else -np.inf  # of the gap above the last bad row caught
    return float(max(middle, at[allowed[-1]] / STEPS - margin))


def quality(
    docs: DataFrame, labels: DataFrame, *, trusted_rows: int = TRUSTED_ROWS, tail: float = TAIL, margin: float = MARGIN
) -> DataFrame:
    """One row per document: statistics, base rules, likelihood ratio, verdict.

    ``docs`` has doc_id and text, ``labels`` has doc_id, quality and toxic.
    """
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    trusted = (
        good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_rows)
        .withColumn("_trusted", F.lit(True))
    )
    marked = docs.select("doc_id", "text").join(F.broadcast(trusted), "doc_id", "left")
    marked = marked.withColumn("_trusted", F.coalesce("_trusted", F.lit(False)))
    ratio = log_ratio(count_grams(marked.select("text", "_trusted"), "text", "_trusted"))
    scored = durable(measures(docs.select("doc_id", "text"), "text", ratio).drop("text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    bad = labels.where((F.col("quality") == 0) | (F.col("toxic") == 1))
    classes = good.select("doc_id", F.lit(True).alias("good")).unionByName(bad.select("doc_id", F.lit(False).alias("good")))
    classes = classes.groupBy("doc_id").agg(F.max("good").alias("good"))
    threshold = separating_score(scored.where(~failed).select("doc_id", "llr").join(classes, "doc_id"), tail, margin)
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr",
    )
