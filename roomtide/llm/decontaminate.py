"""Benchmark decontamination: find the word windows of test items in training texts.

The windows of the benchmark are a small table. It is cut into parts of at most
``part_rows`` (window, item) rows; each part is broadcast as a hash index and
scanned against all documents. Between two parts the documents and their hits so
far are written, so neither the driver nor a task holds more than one part,
however large the benchmark is.
A document window whose hash is in the index is a hit only if its words are
equal to the benchmark's words.

Defined cases: a null or empty text has no words and is clean; an item without
words matches nothing; items with the same id are one item; an item without id
counts as an item with the id ''. Repeated documents are judged one by one. An
empty benchmark leaves every document clean. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from roomtide.llm.common import ALNUM_GAPS, LOWER, Hasher, Words, blocks, fresh, named, plainly_named, portable, text_bytes
from roomtide.session import durable

portable(__name__)

WINDOW = 10
BITS = 1 << 22
PART_ROWS = 500_000  # (window, item) rows of one broadcast, some 60 bytes each


def normalised(words: Words, first: int, last: int) -> bytes:
    """Words ``first`` to ``last - 1``, joined by single spaces."""
    data, start, end = words.buf, words.start, words.end
    return b" ".join(data[start[i]:end[i]].tobytes() for i in range(first, last))


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """Distinct (item, length, window): runs of ``window`` words, or the whole item if it is shorter."""
    def cut(batches):
        for batch in blocks(batches, "text"):
            buf, offsets = text_bytes(batch.column(1))
            words = Words(LOWER[buf], offsets, ALNUM_GAPS)
            ids, out = batch.column(0).to_pylist(), []
            for d, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:])):
                size = min(window, b - a)
                if size:
                    out += [(ids[d], int(size), normalised(words, i, i + size)) for i in range(a, b - size + 1)]
            yield pa.RecordBatch.from_pydict({
                "item": pa.array([x[0] for x in out], pa.string()),
                "length": pa.array([x[1] for x in out], pa.int32()),
                "gram": pa.array([x[2] for x in out], pa.binary()),
            })

    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "item string, length int, gram binary").distinct()


def gram_index(rows: list[tuple[str, int, bytes]]) -> dict[int, tuple]:
    """Index of a part of the benchmark as plain values: for each window length its sorted hashes, the words and
    items of each window, and a bit table that answers "surely not" at once."""
    grams: dict[tuple[int, bytes], set[str]] = {}
    for item, length, gram in rows:
        grams.setdefault((length, gram), set()).add(item)
    hasher, index = Hasher(), {}
    for length in sorted({k[0] for k in grams}):
        texts = [g for n, g in grams if n == length]
        joined = np.frombuffer(b"".join(texts), dtype=np.uint8)
        words = Words(joined, np.cumsum([0, *map(len, texts)]), ALNUM_GAPS)
        hashes = dict(hasher.grams(hasher.words(words), [length]))[length][words.windows(length)]
        order = np.argsort(hashes, kind="stable")
        seen = np.zeros(BITS, dtype=bool)
        seen[hashes & np.uint64(BITS - 1)] = True
        index[length] = (
            hashes[order], [texts[i] for i in order], [sorted(grams[length, texts[i]]) for i in order], np.packbits(seen)
        )
    return index


def hits(index: dict[int, tuple], words: Words, hasher: Hasher) -> Iterator[tuple[int, int, list[str]]]:
    """(first word, number of words, items) of every window of the block that is in the index."""
    if not index or not len(words):
        return
    for length, all_grams in hasher.grams(hasher.words(words), index):
        at = words.windows(length)
        hashes, texts, items, packed = index[length]
        grams = all_grams[at]
        low = grams & np.uint64(BITS - 1)
        maybe = np.flatnonzero((packed[low >> np.uint64(3)] >> (np.uint64(7) - (low & np.uint64(7))).astype(np.uint8)) & 1)
        left, right = np.searchsorted(hashes, grams[maybe]), np.searchsorted(hashes, grams[maybe], side="right")
        for m, a, b in zip(at[maybe].tolist(), left.tolist(), right.tolist()):
            if a < b:
                gram = normalised(words, m, m + length)
                for i in range(a, b):
                    if texts[i] == gram:
                        yield m, length, items[i]


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same words as disjoint ranges, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan_part(index, text_col: str, names: tuple[str, str, str, str], last: bool):
    """Scan of a part; adds to the hits that earlier parts have left in the columns ``names``."""
    n_col, span_col, item_col, clean_col = names

    def scan(batches):
        hasher = Hasher()
        for batch in blocks(batches, text_col):
            column = {name: batch.schema.get_field_index(name) for name in (text_col, span_col, item_col)}
            buf, offsets = text_bytes(batch.column(column[text_col]))
            words = Words(LOWER[buf], offsets, ALNUM_GAPS)
            spans, items = {}, {}
            flat, known = batch.column(column[span_col]), batch.column(column[item_col])
            for d in np.flatnonzero(np.asarray(pa.compute.greater(pa.compute.list_value_length(flat), 0))).tolist():
                pairs = flat[d].as_py()
                spans[d], items[d] = list(zip(pairs[::2], pairs[1::2])), set(known[d].as_py())
            for at, length, ids in hits(index.value, words, hasher):
                d = int(words.doc[at])
                first = at - int(words.bounds[d])
                spans.setdefault(d, []).append((first, first + length))
                items.setdefault(d, set()).update(ids)
            spans = {d: union(x) for d, x in spans.items()}
            rows = range(batch.num_rows)
            new = {
                n_col: pa.array(words.counts, pa.int64()),
                span_col: pa.array([[x for pair in spans.get(d, ()) for x in pair] for d in rows], pa.list_(pa.int64())),
                item_col: pa.array([sorted(items.get(d, ())) for d in rows], pa.list_(pa.string())),
            }
            if clean_col:
                new[clean_col] = pa.array([
                    None if not batch.column(column[text_col])[d].is_valid
                    else cut_out(buf, offsets, words, d, spans.get(d, ())) if last else "" for d in rows
                ], pa.string())
            yield pa.RecordBatch.from_arrays(
                [new.get(name, batch.column(i)) for i, name in enumerate(batch.schema.names)], names=batch.schema.names
            )

    return scan


def cut_out(buf: np.ndarray, offsets: np.ndarray, words: Words, d: int, spans) -> str:
    """Text of document ``d`` without the words of ``spans`` and what stands between them."""
    at, kept = int(offsets[d]), []
    for a, b in spans:
        kept.append(buf[at:words.start[words.bounds[d] + a]].tobytes())
        at = int(words.end[words.bounds[d] + b - 1])
    kept.append(buf[at:offsets[d + 1]].tobytes())
    return b"".join(kept).decode("utf-8")


def scan_documents(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, part_rows: int = PART_ROWS, cleaned: bool = False,
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` and what was found, and the names of the added columns.

    ``n_words``; ``spans`` (flat list of word ranges, first and past-the-end,
    disjoint); ``items`` (sorted ids of the items with a hit); with ``cleaned``
    also ``clean_text``, the text without the hit words.
    """
    spark = docs.sparkSession
    grams = benchmark_windows(benchmark, item_id, item_text, window)
    parts = max(-(-grams.count() // part_rows), 1)
    if parts > 1:
        grams = durable(grams)
    part = F.pmod(F.xxhash64("item", "gram"), F.lit(parts))
    found = ["n_words", "spans", "items", *(["clean_text"] if cleaned else [])]
    added = {name: fresh(docs, name) for name in found}
    empty = {"n_words": F.lit(0).cast("bigint"), "clean_text": F.lit("")}
    empty |= {"spans": F.array().cast("array<bigint>"), "items": F.array().cast("array<string>")}
    df = plainly_named(docs).select("*", *[empty[name].alias(name) for name in found])
    text_at = f"c{docs.columns.index(text_col)}"
    kinds = {"n_words": LongType(), "spans": ArrayType(LongType()), "items": ArrayType(StringType()), "clean_text": StringType()}
    schema = StructType([StructField(f.name, kinds.get(f.name, f.dataType), True) for f in df.schema.fields])
    for k in range(parts):
        rows = [(r.item, r.length, bytes(r.gram)) for r in grams.where(part == k).collect()]
        index = spark.sparkContext.broadcast(gram_index(rows))
        names = ("n_words", "spans", "items", "clean_text" if cleaned else "")
        df = df.mapInArrow(scan_part(index, text_at, names, k == parts - 1), schema)
        if k < parts - 1:  # what was found is written, so that no two parts are held at once
            df = durable(df)
            index.destroy()
    return df.toDF(*docs.columns, *added.values()), added


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "drop", **options) -> DataFrame:
    """Documents without benchmark content, with the columns of ``docs``.

    ``drop`` leaves out every document with a hit, ``remove`` cuts the hit
    words out of the text and keeps the document.
    """
    if action not in ("drop", "remove"):
        raise ValueError(f"unknown action {action!r}")
    text_col = options.get("text_col", "text")
    df, added = scan_documents(docs, benchmark, cleaned=action == "remove", **options)
    if action == "drop":
        return df.where(F.size(added["spans"]) == 0).select(*[named(c) for c in docs.columns])
    return df.select(*[F.col(added["clean_text"]).alias(c) if c == text_col else named(c) for c in docs.columns])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: how many words and which items were hit."""
    df, added = scan_documents(docs.select("doc_id", "text"), benchmark)
    spans = F.col(added["spans"])
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size(spans) - 1, F.lit(1)), F.lit(0).cast("bigint"),
        lambda total, i: total + F.get(spans, i) * F.when(i % 2 == 0, -1).otherwise(1),
    )
    return df.select(
        "doc_id", F.col(added["n_words"]).alias("n_words"),
        F.when(F.size(spans) > 0, covered).otherwise(F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(added["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(added["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(spans) > 0).alias("contaminated"),
    )
