"""Line dedup by winnowing: later copies of runs of lines are deleted.

Every text is cut at line feeds and its lines are hashed. In each window of
``run`` lines the line with the smallest hash (the last of equals) is a
fingerprint; a run of that length that stands in two places has the same
fingerprint in both, so only shared fingerprints are joined. A fingerprint's
position carries the hashes of all windows it stands for, and these are counted.
Matches are not extended: a longer one is the union of its windows. A window's first place (by id, then by a hash of the text, then by line)
stays, its later places are deleted. Windows are counted with aggregation, so a
very common line is no hot group and no pairs are listed.

What counts is length, not only the number of lines: runs of fewer than ``run``
lines are windows, too, if they hold ``words`` words between white space.

Lines and texts are compared by 64-bit hashes. Defined cases: null is an empty
text; an empty text is one empty line; texts shorter than both bounds stay
whole. Rows without id come last in the order. Rows with the same id and the
same text are one place, so neither is later than the other and both get the
same result. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roomtide.llm.common import SPACE_GAPS, Hasher, Words, blocks, mixed, portable, text_bytes
from roomtide.llm.repeats import keyed_texts, text_keys
from roomtide.operators.ordered import match
from roomtide.session import durable, forget

portable(__name__)

RUN, WORDS = 3, 10


def line_bounds(buf: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    breaks = np.flatnonzero(buf[start:end] == 0x0A) + start
    return np.concatenate([[start], breaks + 1]), np.append(breaks, end)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, run: int, words: int) -> DataFrame:
    """(id, key, mark, length, starts, windows): fingerprint hash, lines of its windows, and their first lines and hashes."""
    def find(batches):
        hasher = Hasher()
        for batch in blocks(batches, "_text"):
            buf, offsets = text_bytes(batch.column(1))
            sums = hasher.prefix(buf)
            keys = text_keys(hasher, sums, offsets)
            word_starts = Words(buf, offsets, SPACE_GAPS).start
            row, mark, length, starts, windows = [], [], [], [], []
            for d in range(batch.num_rows):
                first, last = line_bounds(buf, int(offsets[d]), int(offsets[d + 1]))
                lines = hasher.ranges(sums, first, last)
                before = np.searchsorted(word_starts, np.append(first, last[-1]))
                sizes = range(1, min(run, len(lines)) + 1)
                for k, whole in hasher.grams(lines, sizes):
                    n = len(lines) - k + 1
                    at = np.arange(n) if k == run else np.flatnonzero(before[k:k + n] - before[:n] >= words)
                    if not len(at):
                        continue
                    frames = np.lib.stride_tricks.sliding_window_view(lines, k)[at]
                    best = k - 1 - frames[:, ::-1].argmin(axis=1) + at
                    marks = mixed(lines[best] + np.uint64(k)).view(np.int64).tolist()
                    hashes = mixed(whole[at] + np.uint64(k)).view(np.int64).tolist()  # windows of other lengths differ
                    cut = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(at)]
                    places = at.tolist()
                    for i, j in zip(cut[:-1], cut[1:]):
                        row.append(d)
                        mark.append(marks[i])
                        length.append(k)
                        starts.append(places[i:j])
                        windows.append(hashes[i:j])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(keys).take(at), pa.array(mark, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(starts, pa.list_(pa.int64())), pa.array(windows, pa.list_(pa.int64()))],
                names=["id", "key", "mark", "length", "starts", "windows"],
            )

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(
        find, f"id {dict(rows.dtypes)['_id']}, key bigint, mark bigint, length bigint, starts array<bigint>, windows array<bigint>"
    )


def later_lines(docs: DataFrame, id_col: str, text_col: str, run: int, words: int) -> DataFrame:
    """(id, key, found): first lines and lengths of the windows of each text that stand at an earlier place, too."""
    marks = durable(fingerprints(docs, id_col, text_col, run, words))
    shared = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("mark")
    places = durable(
        marks.join(shared, "mark")
        .select("id", "key", "length", F.inline(F.arrays_zip(F.col("starts").alias("start"), F.col("windows").alias("window"))))
        .toDF("id", "key", "length", "start", "window").distinct()
    )
    forget(marks)
    order = F.struct(F.col("id").isNull().alias("last"), "id", "key", "start")
    first = places.groupBy("window").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    later = places.join(first.select("window", "_first"), "window").where(order != F.col("_first"))
    return later.groupBy("id", "key").agg(F.collect_list(F.struct("start", "length")).alias("found"))


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, words: int = WORDS
) -> DataFrame:
    """(id, n_lines, n_removed, n_runs, kept): removed lines and runs, and the remaining text."""
    texts = keyed_texts(docs, text_col, id_col)
    found = match(texts, later_lines(docs, id_col, text_col, run, words), ["id", "key"], "left")

    def strip(batches):
        for batch in blocks(batches, "packed"):
            out = []
            for size, packed, places in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                text = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True) if size else b""
                lines = text.split(b"\n")
                gone = np.zeros(len(lines) + 1, dtype=bool)
                for place in places or ():
                    gone[place["start"]:place["start"] + place["length"]] = True
                kept = b"\n".join(line for line, g in zip(lines, gone) if not g).decode("utf-8")
                out.append((len(lines), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), kept))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
                names=["id", "n_lines", "n_removed", "n_runs", "kept"],
            )

    rows = found.select("id", "size", "packed", "found")
    return rows.mapInArrow(strip, f"id {dict(rows.dtypes)['id']}, n_lines bigint, n_removed bigint, n_runs bigint, kept string")


def line_report(docs: DataFrame) -> DataFrame:
    """One row per document: lines, removed lines and runs, and the digest of what remains."""
    return dedup_lines(docs).select(
        F.col("id").alias("doc_id"), "n_lines", "n_removed", "n_runs", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
