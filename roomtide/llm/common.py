"""What the operators share: whole-batch word splitting and hashing with numpy, and small Spark helpers.

Texts are processed as the UTF-8 bytes of an Arrow batch. Word borders, word
hashes and n-gram hashes of a whole block of documents come from a few array
operations; no Python object per word is made. Hashes have 64 bits. Across
documents they only find candidates, whose bytes or words are then compared.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from roomtide.operators.ordered import match


def portable(module: str) -> None:
    """Ship the functions of a module by value, so that executors need numpy and pyarrow but not this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


portable(__name__)

BLOCK_BYTES = 1 << 20  # texts handled together; one longer text makes a block of its own

#: Words of letters and digits (after A-Z are lowered): everything outside ASCII, 0-9 and a-z.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words between white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
SPACE_GAP = r"[\x20\x09-\x0D]+"


# --- Spark ------------------------------------------------------------------

def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    return name if name.lower() not in {c.lower() for c in df.columns} else f"{name}_{uuid.uuid4().hex[:8]}"


def named(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def plainly_named(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by position: what runs over whole rows must not mind dots in their names."""
    return df.toDF(*[f"c{i}" for i, _ in enumerate(df.columns)])


def n_space_words(text: Column) -> Column:
    """Number of white-space separated words; null counts as none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_GAP)
    return F.size(F.array_remove(parts, "")).cast("bigint")


def n_bytes(text: Column) -> Column:
    """Length in UTF-8 bytes; null counts as none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


# --- blocks of texts --------------------------------------------------------

def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each piece have about ``limit`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        index = batch.schema.get_field_index(column)
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(index)), 0), dtype=np.int64)
        total = np.cumsum(sizes)
        first = 0
        while first < batch.num_rows:
            done = total[first - 1] if first else 0
            last = max(int(np.searchsorted(total, done + limit, side="right")), first + 1)
            yield batch.slice(first, last - first)
            first = last


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and the n + 1 offsets of the texts in it; null is empty."""
    texts = pa.compute.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    at = at.astype(np.int64)
    size = int(at[-1] - at[0])
    buf = np.frombuffer(data, dtype=np.uint8, count=size, offset=int(at[0])) if size else np.zeros(0, np.uint8)
    return buf, at - at[0]


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first:last + 1] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


ALNUM_GAPS = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
SPACE_GAPS = byte_set((0x20, 0x20), (0x09, 0x0D))
LOWER = lower_table()


class Words:
    """Words of a block: byte range of each, and for each document the range of its words."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, gaps: np.ndarray):
        n = len(buf)
        self.buf, self.offsets = buf, offsets
        inside = ~gaps[buf]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        starts, ends = np.zeros(n, dtype=bool), np.zeros(n + 1, dtype=bool)
        if n:
            starts[0] = inside[0]
            starts[1:] = inside[1:] & (~inside[:-1] | first[1:n])
            ends[1:n] = inside[:-1] & (~inside[1:] | first[1:n])
            ends[n] = inside[n - 1]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends)
        self.bounds = np.searchsorted(self.start, offsets)  # words of document d: bounds[d] to bounds[d + 1]
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, length: int) -> np.ndarray:
        """Words at which ``length`` words of one document begin."""
        if len(self) < length:
            return np.zeros(0, dtype=np.int64)
        at = np.arange(len(self) - length + 1)
        return at[self.doc[:len(at)] == self.doc[length - 1:]]


def mixed(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which every input bit reaches every output bit."""
    z = z ^ (z >> np.uint64(31))
    z = z * np.uint64(0x7FB5D329728EA185)
    z = z ^ (z >> np.uint64(27))
    z = z * np.uint64(0x81DADEF4BC2DD44D)
    return z ^ (z >> np.uint64(33))


class Hasher:
    """Polynomial hashes modulo 2**64 of byte ranges and of runs of words."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, seed: int = 1):
        self.of_byte = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1))
        self.step = 0xD1342543DE82EF95
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, BLOCK_BYTES + (BLOCK_BYTES >> 3))
            self.up = np.cumprod(np.full(n, self.BASE, dtype=np.uint64))
            self.down = np.cumprod(np.full(n, self.INVERSE, dtype=np.uint64))

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        """Sums from which ``ranges`` takes the hash of any byte range."""
        self._powers(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(self.of_byte[buf] * self.up[:len(buf)], out=sums[1:])
        return sums

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start])

    def words(self, words: Words) -> np.ndarray:
        return self.ranges(self.prefix(words.buf), words.start, words.end)

    def grams(self, hashes: np.ndarray, lengths: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """For each length, ascending: hash of the run of so many words from each word on."""
        total, power, done = np.zeros(len(hashes), dtype=np.uint64), 1, 0
        for length in sorted(lengths):
            while done < length and done < len(hashes):
                kept = len(hashes) - done
                total[:kept] += hashes[done:] * np.uint64(power)
                power, done = power * self.step % (1 << 64), done + 1
            yield length, mixed(total[:max(len(hashes) - length + 1, 0)])


# --- running sums -----------------------------------------------------------

def prefix_sums(
    rows: DataFrame, counted: DataFrame, keys: list[str], block: list[str], order: list[str], value: str, name: str
) -> DataFrame:
    """``rows`` and the running sum of ``value`` within ``keys``, in the order ``block``, ``order``.

    No task sees more than one block: the sums of the blocks (from ``counted``,
    the same rows without what is wide) are a small table of their own.
    """
    place = [*keys, *block]
    earlier = Window.partitionBy(*keys).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    before = counted.groupBy(*place).agg(F.sum(value).alias("_sum")).select(
        *place, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumn(name, F.sum(value).over(within))
    return match(running, before, place).withColumn(name, F.col(name) + F.col("_before")).drop("_before")
