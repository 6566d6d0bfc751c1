"""Suffix-array dedup: remove every byte covered by a long string that starts at a second place too.

A match is ``length`` bytes that start anywhere else in the corpus, in the same
or another document; it never crosses documents. A suffix array of the whole
corpus would pass everything through one task, so the suffixes are first dealt
to groups in which all their matches must lie:

1. Anchors. Among the ``GRAM``-byte strings inside a window of ``length`` bytes the
   one with the smallest hash (the last of equals) is the window's anchor.
   Equal windows have equal anchors at equal places, so a match always shares
   an anchor. Consecutive windows of a document with the same anchor form a
   segment: the anchor's hash, a hash of the bytes of all its windows, and its
   place. Anchors that occur once in the corpus hold no match and are dropped.
2. Segments with equal bytes repeat in full; no bytes are needed for those. What
   remains are anchors with differing segments, at the edges of copies. One
   segment of each kind is cut from its text, and segments are dealt by anchor
   to groups of about ``GROUP_BYTES``.
3. In each group the segments are joined into one text, whose suffix array and
   Burrows-Wheeler transform are built. Interval expansion by backward
   extension, breadth first, gives the common prefixes of neighbouring suffixes
   by increasing value and stops at ``length``: boundaries not reached by then
   separate suffixes that agree in ``length`` bytes or more, a match.
4. An anchor with more than ``HOT`` kinds of segments (a very common line in ever
   different surroundings) is not collected: the hashes of its windows are
   counted with ordinary aggregation instead, where runs of neighbouring windows
   are not settled by what all of a run share. Only what is counted once is told
   to the segments, whose other windows are matches.
5. The matches of each text are merged into removed runs.

Equal texts have one key (64 bits) and are cut alike. Anchors, segments and hot
windows are compared by 64-bit hashes, groups by bytes.

Defined cases: null is an empty text, and texts shorter than ``length`` stay
whole. A repeated row repeats all its bytes, so both go if they are long
enough. Matches are judged on the input, and overlaps count. An empty table
gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roomtide.llm.common import BLOCK_BYTES, Hasher, blocks, mixed, portable, text_bytes
from roomtide.session import durable, forget

portable(__name__)

LENGTH, GRAM = 200, 32
GROUP_BYTES, HOT = 1 << 19, 1024
RUN = 12  # places before a hot anchor whose windows are looked at together first
PLACE = np.uint64((1 << 31) - 1)


# --- anchors ----------------------------------------------------------------

def text_keys(hasher: Hasher, sums: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return mixed(hasher.ranges(sums, offsets[:-1], offsets[1:]) + np.diff(offsets).astype(np.uint64)).view(np.int64)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def segments(buf: np.ndarray, offsets: np.ndarray, hasher: Hasher, sums: np.ndarray, length: int):
    """Text, anchor place, first and last window start (within the buffer), anchor hash and segment hash of all segments."""
    n = len(buf)
    if n < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * hasher.down[:n - GRAM + 1])
    ranked = (grams & ~PLACE) | np.arange(int(PLACE), int(PLACE) - len(grams), -1).astype(np.uint64)
    place = PLACE - (sliding_min(ranked, length - GRAM + 1) & PLACE)
    room = np.repeat(offsets[1:] - length, np.diff(offsets))[:n - length + 1]
    starts = np.flatnonzero(np.arange(n - length + 1) <= room)
    place = place[starts].astype(np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = place[1:] != place[:-1]  # anchors of different texts stand at different places
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts))[:len(first)] - 1
    a, b, p = starts[first], starts[last], place[first]
    kind = mixed(hasher.ranges(sums, a, b + length) + (p - a).astype(np.uint64) * np.uint64(length) + (b - a).astype(np.uint64))
    return np.searchsorted(offsets, a, side="right") - 1, p, a, b, grams[p], kind


def packed_place(offset: np.ndarray, p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Anchor place in its text, and how far before it the first and the last window start, in one number."""
    return ((p - offset) << 20) | ((p - a) << 10) | (p - b)


def anchor_rows(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """(anchor, kind, text key, place) of all segments."""
    def find(batches):
        hasher = Hasher()
        for batch in blocks(batches, "_text", BLOCK_BYTES >> 2):  # so that its arrays stay in a core's cache
            buf, offsets = text_bytes(batch.column(0))
            sums = hasher.prefix(buf)
            doc, p, a, b, anchor, kind = segments(buf, offsets, hasher, sums, length)
            keys, place = text_keys(hasher, sums, offsets)[doc], packed_place(offsets[doc], p, a, b)
            columns = (anchor.view(np.int64), kind.view(np.int64), keys, place)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["anchor", "kind", "key", "place"])

    return docs.select(F.col(text_col).alias("_text")).mapInArrow(find, "anchor bigint, kind bigint, key bigint, place bigint")


def keyed_texts(docs: DataFrame, text_col: str, id_col: str | None) -> DataFrame:
    """([id,] key, size, packed): compressed text of each document under its key."""
    def pack(batches):
        hasher = Hasher()
        for batch in blocks(batches, "_text"):
            buf, offsets = text_bytes(batch.column(0))
            keys = text_keys(hasher, hasher.prefix(buf), offsets)
            packed = [pa.compress(buf[s:e].tobytes(), codec="zstd", asbytes=True) for s, e in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(keys), pa.array(np.diff(offsets)), pa.array(packed, pa.binary())],
                names=[*batch.schema.names[1:], "key", "size", "packed"],
            )

    rows = docs.select(F.col(text_col).alias("_text"), *([F.col(id_col).alias("id")] if id_col else []))
    kind = f"id {dict(rows.dtypes)['id']}, " if id_col else ""
    return rows.mapInArrow(pack, kind + "key bigint, size bigint, packed binary")


# --- suffix array and interval expansion ------------------------------------

def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(order, fewer, just, known): suffixes of small non-negative numbers, sorted by their first ``depth`` symbols at least.

    A shorter suffix comes first. The first sort is by ``known`` symbols, packed into one number; it
    tells which suffixes share fewer than these, or just one fewer, with the one before them. After it, ties
    alone are sorted, by the ranks of the parts that follow, three times (in long texts twice) as deep each time.
    """
    n = len(text)
    used = np.zeros(int(text.max()) + 1, dtype=bool)
    used[text] = True
    codes = np.cumsum(used).astype(np.uint64)  # from 1: beyond the end are zeros
    bits = int(codes[-1]).bit_length()
    known = max(min(64 // bits, depth // 2), 1)
    padded = np.zeros(n + known, dtype=np.uint64)
    padded[:n] = codes[text]
    key = padded[:n].copy()
    for i in range(1, known):
        key <<= np.uint64(bits)
        key |= padded[i:n + i]
    order = np.argsort(key)
    key = key[order]
    unlike = np.append(np.uint64(1 << 63), key[1:] ^ key[:-1])
    fewer = unlike != 0
    just = fewer & (unlike >> np.uint64(bits) == 0)
    new, slot = fewer.copy(), np.arange(n)
    rank = np.zeros(n + 2 * depth, dtype=np.uint64)
    rank[order] = np.maximum.accumulate(np.where(new, slot, 0)) + 1
    parts, width = (3, 21) if n < 1 << 21 else (2, 32)
    step = known
    while step < depth:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        at = order[tied]
        key = rank[at]
        for part in range(1, parts):
            key = (key << np.uint64(width)) | rank[at + part * step]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[tied] = at
        new[tied[1:]] |= key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(new[tied], tied, 0)) + 1
        step *= parts
    return order, fewer, just, known


def short_prefixes(order: np.ndarray, fewer: np.ndarray, just: np.ndarray, known: int, length: int) -> np.ndarray:
    """For each place of the suffix array: does the suffix share fewer than ``length`` symbols with the one before it?

    Interval expansion on the Burrows-Wheeler transform: the suffixes that begin
    with a string w are an interval; those that begin with cw are the images of
    its rows with c before them. When the intervals of all w with l symbols are
    extended, a right border not seen before has a common prefix of just l.
    Only such intervals go on to the next round. The first sort gives the borders
    below ``known`` symbols, so expansion begins with the intervals of that length.
    """
    n = len(order)
    image = np.empty(n, dtype=np.uint64)
    image[order] = np.arange(n)
    image = image[order - 1] << np.uint64(32)  # the text ends with a separator of its own, so it is a cycle
    border = np.append(fewer, True)
    right = np.flatnonzero(just[1:]) + 1
    borders = np.flatnonzero(border)
    left = borders[np.searchsorted(borders, right) - 1]
    for _ in range(known, length):
        if not len(left):
            break
        sizes = right - left
        before = np.cumsum(sizes) - sizes
        rows = np.repeat(left - before, sizes) + np.arange(sizes.sum())
        key = np.sort(image[rows] | np.repeat(np.arange(len(left), dtype=np.uint64), sizes))
        to = (key >> np.uint64(32)).astype(np.int64)
        new = border[to]  # other symbols c have a border between them
        new[0] = True
        new[1:] |= key[1:] - key[:-1] != np.uint64(1 << 32)  # not the next row from the same interval
        first = np.flatnonzero(new)
        left, right = to[first], to[np.append(first[1:], len(to)) - 1] + 1
        unseen = ~border[right]
        left, right = left[unseen], right[unseen]
        border[right] = True
    return border[:n]


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each string: the starts of its windows of ``length`` bytes that occur at another start, in any of the strings."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    text = np.zeros(int(ends[-1]) if len(parts) else 0, dtype=np.int64)
    inside = np.ones(len(text), dtype=bool)
    inside[ends - 1] = False
    text[inside] = np.frombuffer(b"".join(parts), dtype=np.uint8)
    text[inside] += 2
    text[ends - 1] = 1
    text[-1] = 0
    order, *borders = suffix_array(text, length)
    apart = short_prefixes(order, *borders, length)
    fits = np.zeros(len(text), dtype=bool)
    for s, size in zip(begins, sizes):
        fits[s:s + max(size - length + 1, 0)] = True
    group = np.cumsum(apart)
    valid = fits[order]
    counts = np.bincount(group[valid], minlength=int(group[-1]) + 1)
    found = np.zeros(len(text), dtype=bool)
    found[order[valid & (counts[group] > 1)]] = True
    return [np.flatnonzero(found[s:s + size]) for s, size in zip(begins, sizes)]


# --- matches ----------------------------------------------------------------

def cut_segments(kinds: DataFrame, docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """(anchor, kind, hot, before, bytes) of one segment of each kind; the anchor stands ``before`` bytes in.

    A text comes once, with all places at which it is cut.
    """
    def cut(batches):
        for batch in blocks(batches, "packed"):
            places = batch.column(2)
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.list_value_length(places)))
            anchor, kind, place, hot = places.flatten().flatten()
            place = np.asarray(place)
            before = (place >> 10) & 1023
            begin = (place >> 20) - before
            end = (place >> 20) - (place & 1023) + length
            sizes, packed = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, known, text = [], -1, b""
            for d, first, last in zip(owner.tolist(), begin.tolist(), end.tolist()):
                if d != known:
                    known, text = d, pa.decompress(packed[d], decompressed_size=sizes[d], codec="zstd", asbytes=True)
                out.append(text[first:last])
            columns = [anchor, kind, hot, pa.array(before), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "kind", "hot", "before", "bytes"])

    places = kinds.groupBy("key").agg(F.collect_list(F.struct("anchor", "kind", "place", "hot")).alias("places"))
    texts = keyed_texts(docs, text_col, None).join(kinds.select("key").distinct(), "key", "left_semi").groupBy("key").agg(
        F.first("size").alias("size"), F.first("packed").alias("packed")
    )
    return texts.join(places, "key").select("size", "packed", "places").mapInArrow(
        cut, "anchor bigint, kind bigint, hot boolean, before bigint, bytes binary"
    )


def group_matches(cut: DataFrame, length: int, group_bytes: int) -> DataFrame:
    """(anchor, kind, first, last): ranges of repeated window starts within the segments, group by group."""
    total = cut.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    groups = -(-total // group_bytes) or 1

    def expand(table: pa.Table) -> pa.Table:
        parts = table.column("bytes").to_pylist()
        index, firsts, lasts = [], [], []
        for i, starts in enumerate(repeated_starts(parts, length)):
            if len(starts):
                gap = np.flatnonzero(np.diff(starts) > 1)
                index += [i] * (len(gap) + 1)
                firsts += starts[np.concatenate([[0], gap + 1])].tolist()
                lasts += starts[np.append(gap, len(starts) - 1)].tolist()
        chosen = table.take(pa.array(index, pa.int64()))
        return pa.table({
            "anchor": chosen.column("anchor"), "kind": chosen.column("kind"),
            "first": pa.array(firsts, pa.int64()), "last": pa.array(lasts, pa.int64()),
        })

    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("anchor"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(expand, "anchor bigint, kind bigint, first bigint, last bigint")


def hot_matches(cut: DataFrame, length: int) -> DataFrame:
    """The same ranges for hot anchors: between the windows whose hash is counted once, all windows of a segment are repeated.

    Equal windows begin equally far before their anchor. The windows that begin in
    a run of ``RUN`` such places share a core of bytes and lie in a hull. A core
    counted once settles that its windows are, too, and a hull that comes again that
    its windows do. Windows become rows where neither holds, and for the first of equal hulls, with which they count double.
    """
    def runs(batch):
        """Bytes, text borders, and of every run its segment, its first and last window start, and the last of a whole run."""
        buf, offsets = text_bytes(batch.column(3).cast(pa.large_binary()).view(pa.large_string()))
        before, after = batch.column(2).to_numpy(), np.diff(offsets) - length
        low = (before - after) // RUN
        times = before // RUN - low + 1
        row = np.repeat(np.arange(len(before)), times)
        start = before[row] - (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + low[row]) * RUN
        return buf, offsets, row, np.maximum(start - RUN + 1, 0), np.minimum(start, after[row]), start

    def named(batch, row, **columns):
        keys = [c.take(pa.array(row)) for c in batch.columns[:2]]
        return pa.RecordBatch.from_arrays([*keys, *map(pa.array, columns.values())], names=["anchor", "kind", *columns])

    def outlines(batches):
        hasher = Hasher()
        for batch in blocks(batches, "bytes", BLOCK_BYTES >> 2):
            buf, offsets, row, first, last, start = runs(batch)
            sums, base = hasher.prefix(buf), offsets[row]
            core = hasher.ranges(sums, base + start, base + start + length - RUN + 1)
            hull = mixed(hasher.ranges(sums, base + first, base + last + length) + (start - first).astype(np.uint64) * np.uint64(RUN) + (start - last).astype(np.uint64))
            yield named(batch, row, first=first, last=last, core=core.view(np.int64), hull=hull.view(np.int64))

    def windows(batches):
        hasher = Hasher()
        for batch in blocks(batches, "bytes", BLOCK_BYTES >> 2):
            buf, offsets, row, first, last, _ = runs(batch)
            weight = np.zeros(len(row), dtype=np.int64)
            by_place = np.argsort(offsets[row] + first)
            place = (offsets[row] + first)[by_place]

            def listed(column):
                """Which runs the lists of a column name, by their first start, and the other number there."""
                times = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(batch.column(column)), 0))
                start, other = (c.to_numpy() for c in batch.column(column).flatten().flatten())
                return by_place[np.searchsorted(place, np.repeat(offsets[:-1], times) + start)], other

            stands, times = listed(5)
            weight[stands] = np.minimum(times, 2)
            weight[listed(4)[0]] = 0
            chosen = weight > 0
            row, first, size, weight = row[chosen], first[chosen], (last - first + 1)[chosen], weight[chosen]
            row, weight, start = np.repeat(row, size), np.repeat(weight, size), np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            at = offsets[row] + start
            hashes = hasher.ranges(hasher.prefix(buf), at, at + length).view(np.int64)
            yield named(batch, row, start=start, weight=weight, hash=hashes)

    key = ["anchor", "kind"]
    cut = cut.select(*key, "before", "bytes")
    outline = durable(cut.mapInArrow(outlines, "anchor bigint, kind bigint, first bigint, last bigint, core bigint, hull bigint"))
    run = F.struct("kind", "first", "last")
    alone = outline.groupBy("anchor", "core").agg(F.count(F.lit(1)).alias("_n"), F.min(run).alias("_at")).where("_n = 1")
    alone = alone.groupBy("anchor", "_at.kind").agg(F.collect_list(F.struct("_at.first", "_at.last")).alias("_alone"))
    hulls = outline.groupBy("anchor", "hull").agg(F.count(F.lit(1)).alias("_n"), F.min(run).alias("_at"))
    hulls = hulls.groupBy("anchor", "_at.kind").agg(F.collect_list(F.struct("_at.first", "_n")).alias("_hulls"))
    segment = durable(cut.join(alone, key, "left").join(hulls, key, "left"))
    rows = segment.mapInArrow(windows, "anchor bigint, kind bigint, start bigint, weight bigint, hash bigint")
    once = rows.groupBy("anchor", "hash").agg(F.sum("weight").alias("_n"), F.min(F.struct("kind", "start")).alias("_at")).where("_n = 1")
    once = once.groupBy("anchor", "_at.kind").agg(F.collect_list(F.struct(F.col("_at.start").alias("first"), F.col("_at.start").alias("last"))).alias("_once"))
    after = (F.octet_length("bytes") - length + 1).cast("bigint")
    segment = segment.select(*key, "_alone", after.alias("_after")).join(once, key, "left")
    ends = F.array(*[F.struct(x.alias("first"), x.alias("last")) for x in (F.lit(-1).cast("bigint"), F.col("_after"))])
    none = F.slice(ends, 1, 0)
    edges = segment.select(*key, F.array_sort(F.concat(ends, F.coalesce("_alone", none), F.coalesce("_once", none))).alias("_e"))
    pairs = F.zip_with(
        F.expr("slice(_e, 1, size(_e) - 1)"), F.expr("slice(_e, 2, size(_e) - 1)"),
        lambda x, y: F.struct((x["last"] + 1).alias("first"), (y["first"] - 1).alias("last")),
    )
    return edges.select(*key, F.inline(F.filter(pairs, lambda r: r["first"] <= r["last"])))


def covered(docs: DataFrame, text_col: str = "text", length: int = LENGTH, group_bytes: int = GROUP_BYTES, hot: int = HOT) -> DataFrame:
    """(key, first, end): byte ranges of each text covered by matches; they may overlap. Written out."""
    rows = durable(anchor_rows(docs, text_col, length))
    counted = rows.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("_n"), (F.min("kind") == F.max("kind")).alias("alike")
    ).where("_n > 1").drop("_n")
    shared = durable(rows.join(counted, "anchor"))
    forget(rows)
    place, before = F.shiftright("place", 20), lambda bits: F.shiftright("place", bits).bitwiseAND(1023)
    begin = place - before(10)
    whole = lambda df: df.select("key", begin.alias("first"), (place - before(0) + length).alias("end"))
    differing = shared.where(~F.col("alike"))
    kinds = durable(differing.groupBy("anchor", "kind").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("key", "place")).alias("_at")
    ).select("anchor", "kind", "times", "_at.key", "_at.place"))
    wanted = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("_kinds"), F.min("times").alias("_least")).where("_least = 1")
    to_cut = kinds.join(wanted, "anchor").select("anchor", "kind", "key", "place", (F.col("_kinds") > hot).alias("hot"))
    cut = durable(cut_segments(to_cut, docs, text_col, length))
    found = group_matches(cut.where(~F.col("hot")).drop("hot", "before"), length, group_bytes)
    found = found.unionByName(hot_matches(cut.where("hot"), length))
    single = kinds.where("times = 1").join(found, ["anchor", "kind"]).select(
        "key", (begin + F.col("first")).alias("first"), (begin + F.col("last") + length).alias("end")
    )
    repeated = differing.join(kinds.where("times > 1").select("anchor", "kind"), ["anchor", "kind"], "left_semi")
    return durable(whole(shared.where("alike")).unionByName(whole(repeated)).unionByName(single).distinct())


def strip_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept): removed byte runs (flat list of starts and ends) and remaining bytes."""
    spans = covered(docs, text_col, length, **options).groupBy("key").agg(
        F.collect_list(F.struct("first", "end")).alias("_spans")
    )

    def strip(batches):
        for batch in blocks(batches, "packed"):
            sizes, packed = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            times = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(batch.column(3)), 0))
            first, end = (c.to_numpy() for c in batch.column(3).flatten().flatten())
            owner = np.repeat(np.arange(batch.num_rows), times)
            shift = (np.cumsum(sizes) - sizes)[owner]  # as if the texts stood in one line
            order = np.lexsort((first, owner))
            first, reach = (first + shift)[order], np.maximum.accumulate((end + shift)[order])
            new = np.append(True, (owner[1:] != owner[:-1]) | (first[1:] > reach[:-1]))[:len(first)]
            own, shift = owner[new], shift[new]
            start, stop = first[new] - shift, reach[np.append(new[1:], True)[:len(new)]] - shift
            bounds = np.searchsorted(own, np.arange(batch.num_rows + 1))
            removed = np.diff(np.append(0, np.cumsum(stop - start))[bounds])
            starts, stops, at, kept = start.tolist(), stop.tolist(), bounds.tolist(), []
            for d, (size, data) in enumerate(zip(sizes.tolist(), packed)):
                text = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""
                runs = slice(at[d], at[d + 1])
                kept.append(b"".join(text[e:s] for e, s in zip([0, *stops[runs]], [*starts[runs], size])))
            spans = pa.ListArray.from_arrays(pa.array((2 * bounds).astype(np.int32)), pa.array(np.stack([start, stop], axis=1).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed), spans, pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "n_removed", "spans", "kept"],
            )

    rows = keyed_texts(docs, text_col, id_col).join(spans, "key", "left").select("id", F.col("size").alias("n_bytes"), "packed", "_spans")
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(strip, f"id {kind}, n_bytes bigint, n_removed bigint, spans array<bigint>, kept binary")


def repeat_report(docs: DataFrame) -> DataFrame:
    """One row per document: removed bytes and runs, and the digest of what remains."""
    return strip_repeats(docs).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.floor(F.size("spans") / 2).cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
