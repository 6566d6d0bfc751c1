"""Similarity join on word shingles: which documents link, and the groups their links make.

Documents with the same shingle set are one node; nodes x and y link when
``100 * |x & y| >= threshold * |x | y|``. Shingles are compared by 64-bit hashes.

1. Inverted lists. A node posts the shingles whose hash is below its level. The
   levels are few fixed numbers, and a node takes the lowest one at which a
   link surely shows: a pair of ``n`` and ``m`` shingles overlaps in at least
   ``o = threshold (n + m) / (100 + threshold)``, so below a level where x posts
   ``s`` of its ``n`` shingles the two share at least ``o - (n - s)``, the
   occurrence bound T. A node that shares fewer shingles with all others
   together is dropped at once. This is exact, and most nodes go here. The
   texts of those that stay are packed into a table, from which denser lists,
   in the end of all shingles, are made and pruned in the same way. What a node
   shares with all others together also bounds each pair's overlap.
2. Collapse. In a few rounds, nodes are put into bands by their smallest
   shared shingles and compared with their neighbours there, if the two are not
   connected yet and can link at all. One link suffices to put a node into a large group, so
   thousands of near copies shrink to a few components without comparing all
   pairs. Nothing is dropped here.
3. T-occurrence search for what the bands left: only lists that still touch two
   components count. Nodes meet at the first shingle, in an order of the lists
   by length, that they can share if they link; the nodes that meet there bring
   all their shingles, so the search of a bundle has exact lists at hand. A node is the
   query for larger nodes. Of its lists the longest, at most T - 1, are set
   aside (DivideSkip); the short ones are merged with a heap, nodes found often enough
   are looked up in the long ones by binary search, and then the overlap is exact.
   Where many entries or nodes are left, the lists are counted by place
   instead, which gives the same numbers. Bundles put out links, one per node
   and component, and no candidates. Large bundles are cut into pieces.

Components go over to their smallest neighbour, round by round, and verified
links within one drop out; each search goes on from the components of those
before it. No links, components or fingerprints reach the driver, only counts.

Defined cases: null, empty and word-less texts have no shingles and link with
nothing; a text shorter than a shingle has one shingle, its whole sequence of
words. Repeated rows and copies share a node. A component's id is its smallest
doc_id; documents without id take part, and a component of those only has a
null id. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

from roomtide.llm.common import LOWER, SPACE_GAPS, Hasher, Words, blocks, mixed, named, portable, text_bytes
from roomtide.session import durable, forget

portable(__name__)

SHINGLE, THRESHOLD = 4, 85
LEVELS = (0.2, 0.3, 0.5, 1.0)  # first lists, of all nodes
DENSER = ((0.5, 1.0), (1.0,))  # second and third lists, of the nodes that stay
ROUNDS = ((2, 2, 1, 1), (1, 1, 1, 1))  # shingles in the keys of each round's bands
FACTS = ("n", "posted", "at_least", "to_stay")
FACT_TYPES = ", ".join(f"{c} bigint" for c in FACTS) + ", own array<bigint>"
SLICED, MARKED = 1000, 1 << 18  # nodes whose postings are unfolded together, postings that a task looks through together
SLICE = 256  # nodes of a band that are sorted together
KNOWN_BYTES = 64 << 20  # shingle sets that a verifying task keeps
BUNDLE = 256  # nodes of a bundle that make a piece
LINKED = 1 << 12  # links for which a round of components has a task of its own
LONG_LIST, PROBED = 32, 8  # lists above are set aside; so many nodes are looked up in them one by one
HEAP_ENTRIES = 256  # entries that a heap merges


# --- shingle sets -----------------------------------------------------------

def shingle_sets(texts: pa.Array, hasher: Hasher, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and the n + 1 bounds of the texts."""
    buf, offsets = text_bytes(texts)
    words = Words(LOWER[buf], offsets, SPACE_GAPS)
    hashes, at = hasher.words(words), words.windows(k)
    grams = dict(hasher.grams(hashes, [k]))[k][at] if len(at) else np.zeros(0, np.uint64)
    doc = words.doc[at]
    few = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(few):
        runs = dict(hasher.grams(hashes, range(1, k)))
        short = np.array([runs[int(words.counts[d])][words.bounds[d]] for d in few], dtype=np.uint64)
        short = mixed(short + words.counts[few].astype(np.uint64))  # "a b" is not a shingle of other lengths
        grams, doc = np.concatenate([grams, short]), np.concatenate([doc, few])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[new], np.searchsorted(doc[new], np.arange(len(offsets)))


class NodeFacts:
    """Per text of a block: node key, number of shingles, posted shingles, and the bounds for its partners."""

    def __init__(self, grams: np.ndarray, bounds: np.ndarray, threshold: int, levels: tuple[float, ...] = LEVELS):
        n = np.diff(bounds)
        self.n = n
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(grams))])
        self.node = mixed(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64)).view(np.int64)
        self.posted = np.zeros(len(n), dtype=np.int64)
        self.at_least = np.ones(len(n), dtype=np.int64)  # shared with a larger node that links
        self.to_stay = np.ones(len(n), dtype=np.int64)  # shared with all others together, if any link exists
        open_, bound = n > 0, np.full(len(n), np.iinfo(np.int64).max)
        overlap = -(-2 * threshold * n // (100 + threshold))
        for k, level in enumerate(levels):
            limit = np.uint64(min(int(level * 2.0**64), (1 << 64) - 1))
            below = np.concatenate([[0], np.cumsum(grams <= limit)])
            s = below[bounds[1:]] - below[bounds[:-1]]
            bound = np.where(open_, np.minimum(bound, overlap - n + s), bound)
            sure = -(-threshold * n // 100) - n + s
            here = open_ & ((sure >= 1) | (level == 1.0))
            self.posted[here] = s[here]
            self.at_least[here] = np.maximum(bound[here], 1)
            if k == 0:
                self.to_stay[here] = sure[here]
            open_ &= ~here

    def columns(self, grams: np.ndarray) -> list[pa.Array]:
        """The FACTS of all texts, and what each posts: hashes are sorted, so those below the level come first."""
        kept = np.arange(len(grams)) - np.repeat(np.cumsum(self.n) - self.n, self.n) < np.repeat(self.posted, self.n)
        offsets = np.concatenate([[0], np.cumsum(self.posted)]).astype(np.int32)
        own = pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams[kept].view(np.int64)))
        return [*map(pa.array, (self.n, self.posted, self.at_least, self.to_stay)), own]


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int, threshold: int) -> DataFrame:
    """(id, node, text_key, facts, own) of every document; node is null without shingles. Written out.

    The one pass that hashes all texts: ``own`` holds the shingles that the node
    posts below LEVELS, ``text_key`` tells later passes which texts they need.
    """
    def sketch(batches):
        hasher = Hasher()
        for batch in blocks(batches, "_text"):
            grams, bounds = shingle_sets(batch.column(1), hasher, k)
            f = NodeFacts(grams, bounds, threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(f.node, mask=f.n == 0), *f.columns(grams)],
                names=["id", "text_key", "node", *FACTS, "own"],
            )

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), text_key(F.col(text_col)))
    return durable(rows.mapInArrow(sketch, f"id {dict(rows.dtypes)['_id']}, text_key bigint, node bigint, {FACT_TYPES}"))


def text_key(text: Column) -> Column:
    return F.xxhash64(text).alias("text_key")


# --- inverted lists ---------------------------------------------------------

def posted(table: DataFrame) -> DataFrame:
    """(shingle, node): what each node of ``table`` posts."""
    def post(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, SLICED):
                some = batch.slice(first, SLICED)
                times = np.asarray(pa.compute.list_value_length(some.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [some.column(1).flatten(), pa.array(np.repeat(some.column(0).to_numpy(), times))], names=["shingle", "node"]
                )

    return shared(table.where("node IS NOT NULL").select("node", "own"), post)


def shared(rows: DataFrame, post=None) -> DataFrame:
    """The (shingle, node) of shingles that two nodes have; a row that comes twice may do so again.

    Rows of a shingle meet in one task, so a shingle that is found twice in a
    block of rows sends only its first and last node there. What stands between
    is shared for sure and is dealt by node.
    """
    def mark(batches):
        held, size = [], 0
        for batch in chain(batches if post is None else post(batches), [None]):
            if batch is not None and batch.num_rows:
                held.append([batch.column(c).to_numpy() for c in range(2)])
                size += batch.num_rows
            if held and (batch is None or size >= MARKED):
                shingle, node = map(np.concatenate, zip(*held))
                order = np.lexsort((node, shingle))
                shingle, node = shingle[order], node[order]
                new = np.append(True, (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1]))
                shingle, node = shingle[new], node[new]
                same = shingle[1:] == shingle[:-1]
                sure = np.append(False, same) & np.append(same, False)
                held, size = [], 0
                yield pa.RecordBatch.from_arrays(list(map(pa.array, (shingle, node, sure))), names=["shingle", "node", "sure"])

    def meet(batches):
        def parts(columns):
            """What two nodes share among complete groups."""
            shingle, node, sure = columns
            order = np.lexsort((node, shingle, sure))
            shingle, node, sure = shingle[order], node[order], sure[order]
            same = (shingle[1:] == shingle[:-1]) & (sure[1:] == sure[:-1])
            new = np.append(True, ~same | (node[1:] != node[:-1]))
            shingle, node, sure = shingle[new], node[new], sure[new]
            same = (shingle[1:] == shingle[:-1]) & (sure[1:] == sure[:-1])
            kept = sure | np.append(False, same) | np.append(same, False)
            return pa.RecordBatch.from_arrays([pa.array(shingle[kept]), pa.array(node[kept])], names=["shingle", "node"])

        held = None  # the last group waits for the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                now = [np.concatenate(c) for c in zip(held, now)]
            key = np.where(now[2], now[1], now[0])
            last = int(np.searchsorted(key, key[-1]))
            held = [c[last:] for c in now]
            if last:
                yield parts([c[:last] for c in now])
        if held is not None:
            yield parts(held)

    marked = (rows if post is not None else rows.select("shingle", "node")).mapInArrow(mark, "shingle bigint, node bigint, sure boolean")
    key = F.when(F.col("sure"), F.col("node")).otherwise(F.col("shingle"))
    return marked.repartition(key).sortWithinPartitions(key).mapInArrow(meet, "shingle bigint, node bigint")


def pruned(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` of lists with two nodes, of nodes that share enough for a link. Written out."""
    for _ in range(2):  # dropping nodes leaves lists with one node, so a second pass drops more
        stay = (
            rows.groupBy("node").agg(F.count(F.lit(1)).alias("_shared")).join(nodes, "node")
            .where(F.col("_shared") >= F.col("to_stay")).select("node")
        )
        before, rows = rows, durable(shared(rows.join(stay, "node")))
        forget(before)
    return rows


def shared_postings(sketched: DataFrame, nodes: DataFrame) -> DataFrame:
    """First lists: what all documents post below LEVELS, pruned."""
    return pruned(durable(posted(sketched).distinct()), nodes)


def dense_postings(texts: DataFrame, k: int, threshold: int, levels: tuple[float, ...]) -> tuple[DataFrame, DataFrame]:
    """Denser lists, of the nodes that are left: what they post below ``levels``, pruned, and the nodes' facts.

    With more shingles a pair must share a larger part of them, so this drops
    most nodes that only share a passage.
    """
    def sketch(batches):
        hasher = Hasher()
        for batch in batches:
            for first in range(0, batch.num_rows, 100):
                some = batch.slice(first, 100)
                raw = [
                    pa.decompress(p, decompressed_size=n, codec="zstd", asbytes=True)
                    for n, p in zip(some.column(1).to_pylist(), some.column(2).to_pylist())
                ]
                grams, bounds = shingle_sets(pa.array([r.decode("utf-8") for r in raw], pa.string()), hasher, k)
                f = NodeFacts(grams, bounds, threshold, levels)
                yield pa.RecordBatch.from_arrays([pa.array(f.node), *f.columns(grams)], names=["node", *FACTS, "own"])

    table = durable(texts.select("node", "size", "packed").mapInArrow(sketch, f"node bigint, {FACT_TYPES}"))
    nodes = durable(table.drop("own"))
    rows = durable(posted(table))
    forget(table)
    return pruned(rows, nodes), nodes


def node_texts(docs: DataFrame, nodes: DataFrame, rows: DataFrame, text_col: str, k: int, threshold: int) -> DataFrame:
    """(node, size, packed): one compressed text for each node of ``rows``. Written out."""
    def pack(batches):
        hasher = Hasher()
        for batch in blocks(batches, "_text"):
            grams, bounds = shingle_sets(batch.column(0), hasher, k)
            node = NodeFacts(grams, bounds, threshold).node
            buf, offsets = text_bytes(batch.column(0))
            some = np.flatnonzero(np.diff(bounds))
            packed = [pa.compress(buf[offsets[d]:offsets[d + 1]].tobytes(), codec="zstd", asbytes=True) for d in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[some]), pa.array(np.diff(offsets)[some]), pa.array(packed, pa.binary())],
                names=["node", "size", "packed"],
            )

    # texts with the same set differ in case or white space; one of them is enough
    wanted = nodes.join(rows.select("node").distinct(), "node").groupBy("node").agg(F.min("text_key").alias("text_key"))
    texts = docs.select(F.col(text_col).alias("_text"), text_key(F.col(text_col))).where("_text IS NOT NULL")
    texts = texts.join(wanted.select("text_key").distinct(), "text_key").select("_text")
    packed = texts.mapInArrow(pack, "node bigint, size bigint, packed binary")
    return durable(packed.groupBy("node").agg(F.first("size").alias("size"), F.first("packed").alias("packed")))


# --- verification -----------------------------------------------------------

def verify(pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """The (x, y) of ``pairs`` that link. Written out."""
    def check(batches):
        hasher, known, held = Hasher(), OrderedDict(), 0

        def grams(node, size, packed):
            nonlocal held
            if node not in known:
                text = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True).decode("utf-8")
                known[node] = shingle_sets(pa.array([text], pa.string()), hasher, k)[0]
                held += known[node].nbytes
                while held > KNOWN_BYTES and len(known) > 2:
                    held -= known.popitem(last=False)[1].nbytes
            known.move_to_end(node)
            return known[node]

        for batch in batches:
            x, y, *sides = (c.to_pylist() for c in batch.columns)
            good = []
            for i in range(batch.num_rows):
                a, b = grams(x[i], sides[0][i], sides[1][i]), grams(y[i], sides[2][i], sides[3][i])
                if len(a) > len(b):
                    a, b = b, a
                found = 0
                if 100 * len(a) >= threshold * len(b):
                    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                    found = int((b[at] == a).sum())
                good.append(100 * found >= threshold * (len(a) + len(b) - found))
            kept = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["x", "y"])

    both = (
        pairs.select("x", "y")
        .join(texts.select(F.col("node").alias("x"), F.col("size").alias("_sx"), F.col("packed").alias("_px")), "x")
        .join(texts.select(F.col("node").alias("y"), F.col("size").alias("_sy"), F.col("packed").alias("_py")), "y")
    )
    return durable(both.select("x", "y", "_sx", "_px", "_sy", "_py").mapInArrow(check, "x bigint, y bigint"))


# --- components -------------------------------------------------------------

def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, component) of the nodes that ``links`` and the components of ``labels`` join to a smaller one; written out.

    The component is the smallest reachable node; a node without row is its own.
    In each round every component with a smaller neighbour goes over to the
    smallest, and on to where that one ends up; links within one component then drop
    out, so later rounds work on what is still to be joined. ``labels`` stay as they are.
    The tables of the rounds are written by a task per ``LINKED`` links: most are
    small, and many files of a few rows cost more than the rows.
    """
    tasks = links.count() // LINKED + 1

    def written(rows: DataFrame) -> DataFrame:
        return durable(rows.coalesce(tasks))

    def moved(rows: DataFrame, column: str, moves: DataFrame | None) -> DataFrame:
        """``rows`` with the nodes of ``column`` replaced by where ``moves`` (node, component) puts them."""
        if moves is None:
            return rows
        to = moves.select(F.col("node").alias("_at"), F.col("component").alias("_to"))
        return rows.join(to, F.col(column) == F.col("_at"), "left").withColumn(column, F.coalesce("_to", column)).drop("_at", "_to")

    def apart(edges: DataFrame, moves: DataFrame | None) -> DataFrame:
        edges = moved(moved(edges, "x", moves), "y", moves).where("x <> y")
        return written(edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))

    edges, rounds = apart(links.select("x", "y"), labels), []
    while not edges.isEmpty():
        nearest = written(edges.groupBy(F.col("y").alias("node")).agg(F.min("x").alias("component")))
        moves = nearest
        while True:  # four times as far each time
            half = moved(moves, "component", moves).withColumn("_half", F.col("component"))
            before, moves = moves, written(moved(half, "component", half))
            forget(before)
            if moves.where("component <> _half").isEmpty():
                break
        rounds.append(moves)
        moves = moves.drop("_half")
        before, edges = edges, apart(edges, moves)
        forget(before)
        labels = moves if labels is None else moved(labels, "component", moves).unionByName(moves)
    labels = durable(labels if labels is not None else edges.select(F.col("y").alias("node"), F.col("x").alias("component")))
    forget(edges, *rounds)
    return labels


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` with the component of ``node``; a node without link is its own."""
    if labels is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


# --- candidates -------------------------------------------------------------

def open_lists(rows: DataFrame) -> DataFrame:
    """Rows (shingle, node, component) of the lists that touch two components."""
    mixed_lists = (
        rows.groupBy("shingle").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b").select("shingle")
    )
    return rows.join(mixed_lists, "shingle")


def band_keys(rows: DataFrame) -> DataFrame:
    """(round, mask, band, node): a key of each node for every band: its smallest posted shingles in the band's order. Written out.

    Nodes that agree in a key are likely to be similar, the more so the more shingles the key is made of.
    """
    def keys(batches):
        most = np.iinfo(np.int64).max
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(1).flatten().to_numpy()
            times = np.asarray(pa.compute.list_value_length(batch.column(1)))
            starts, no = np.cumsum(times) - times, 0
            for number, sizes in enumerate(ROUNDS):
                for size in sizes:
                    mask = (no * 0x9E3779B97F4A7C1) & ((1 << 60) - 1)
                    turned, band = own ^ np.int64(mask), np.full(batch.num_rows, no, np.uint64)
                    for _ in range(size):
                        least = np.minimum.reduceat(turned, starts)
                        band = mixed(band + mixed(least.view(np.uint64)))
                        turned = np.where(turned == np.repeat(least, times), most, turned)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(batch.num_rows, number, np.int32)), pa.array(np.full(batch.num_rows, mask)), pa.array(band.view(np.int64)), batch.column(0)],
                        names=["round", "mask", "band", "node"],
                    )
                    no += 1

    own = rows.groupBy("node").agg(F.collect_list("shingle").alias("_own"))
    return durable(own.mapInArrow(keys, "round int, mask bigint, band bigint, node bigint"))


def feasible(threshold: int):
    """Do the sizes, and what each side shares at most, allow x and y to link?"""
    need = threshold * (F.col("_nx") + F.col("_ny"))
    return (
        (100 * F.least("_nx", "_ny") >= threshold * F.greatest("_nx", "_ny"))
        & ((100 + threshold) * F.least("_mx", "_my") >= need)
    )


def band_pairs(bands: DataFrame, nodes: DataFrame, labels: DataFrame | None, number: int, threshold: int) -> DataFrame:
    """(x, y): neighbours in their bands, sorted by size and then in the band's order, where components differ and a
    link is possible. A large band is cut into slices of about ``SLICE`` nodes by hash."""
    sized = labelled(bands.where(F.col("round") == number), labels).join(nodes.select("node", "n", "most"), "node")
    open_ = sized.groupBy("band").agg(
        F.count(F.lit(1)).alias("_rows"), (F.min("component") != F.max("component")).alias("_open")
    ).where("_open")
    sized = sized.join(open_, "band").withColumn("_slice", F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("_rows") / SLICE)))
    order = Window.partitionBy("band", "_slice").orderBy("n", F.col("node").bitwiseXOR(F.col("mask")))
    before = F.lag(F.struct("node", "component", "n", "most")).over(order)
    pairs = sized.withColumn("_b", before).where(F.col("_b").isNotNull() & (F.col("component") != F.col("_b.component")))
    pairs = pairs.select(
        F.col("node").alias("x"), F.col("_b.node").alias("y"), F.col("n").alias("_nx"), F.col("most").alias("_mx"),
        F.col("_b.n").alias("_ny"), F.col("_b.most").alias("_my"),
    )
    return pairs.where(feasible(threshold)).select("x", "y").distinct()


# --- the search -------------------------------------------------------------

class Bundle:
    """The nodes that met at one shingle, smallest first, with their lists, in one task.

    ``own`` holds the shingles of all nodes, each node's in the common order
    (short lists first). ``after`` gives for a posting the rest of its list:
    the larger nodes.
    """

    def __init__(self, at: int, nodes, components, n, piece, sets: list[np.ndarray], threshold: int):
        order = np.lexsort((nodes, n))
        self.nodes, self.n, self.piece, self.threshold = nodes[order], n[order], piece[order], threshold
        self.root = np.unique(components[order], return_inverse=True)[1]
        sets = [sets[i] for i in order]
        lengths = np.array([len(x) for x in sets])
        flat, self.bounds = np.concatenate(sets), np.concatenate([[0], np.cumsum(lengths)])
        who = np.repeat(np.arange(len(sets)), lengths)
        self.own = np.unique(flat, return_inverse=True)[1]
        by_list = np.argsort(self.own, kind="stable")
        self.entries = who[by_list]
        self.begin = np.empty(len(flat), dtype=np.int64)
        self.begin[by_list] = np.arange(len(flat)) + 1
        self.end = np.cumsum(np.bincount(self.own))[self.own]
        # what a node has before the shingle of the bundle: who shares one of these has met it before
        met = np.flatnonzero(flat == at)
        early = np.arange(len(flat)) < met[who]
        self.early = early
        kept = by_list[early[by_list]]
        self.early_entries = who[kept]
        self.early_end = np.cumsum(np.bincount(self.own[kept], minlength=self.own.max() + 1))[self.own]
        self.early_begin = np.zeros(len(flat), dtype=np.int64)
        self.early_begin[kept] = np.arange(len(kept)) + 1

    @staticmethod
    def joined(entries: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The given parts of ``entries``, one after the other."""
        lengths = end - begin
        total = int(lengths.sum())
        return entries[np.repeat(begin - np.cumsum(lengths) + lengths, lengths) + np.arange(total)]

    def times(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many of the lists hold each node: a heap merges few entries, many are counted by place."""
        if (end - begin).sum() > HEAP_ENTRIES:
            return np.bincount(self.joined(self.entries, begin, end), minlength=len(self.nodes))
        found = np.zeros(len(self.nodes), dtype=np.int64)
        for node, run in groupby(heapq.merge(*(self.entries[a:b].tolist() for a, b in zip(begin, end)))):
            found[node] = sum(1 for _ in run)
        return found

    def probe(self, found: np.ndarray, wanted: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Add the long lists: each is probed for the nodes that are left, or counted where these are many."""
        if len(wanted) > PROBED:
            found += np.bincount(self.joined(self.entries, begin, end), minlength=len(self.nodes))
            return
        for a, b in zip(begin, end):
            at = np.searchsorted(self.entries[a:b], wanted)
            here = at < b - a
            found[wanted[here]] += self.entries[a:b][at[here]] == wanted[here]

    def links(self, crossing: bool) -> Iterator[tuple[int, int]]:
        """One link per node and component of larger nodes; with ``crossing`` only between the two pieces."""
        n, t = self.n, self.threshold
        for x in range(len(self.nodes) - 1):
            open_ = np.zeros(len(self.nodes), dtype=bool)
            open_[x + 1:np.searchsorted(n, 100 * n[x] // t, side="right")] = True
            open_ &= self.root != self.root[x]
            if crossing:
                open_ &= self.piece != self.piece[x]
            need = -(-2 * t * int(n[x]) // (100 + t))
            own = slice(self.bounds[x], self.bounds[x + 1])
            begin, end = self.begin[own], self.end[own]
            lists = np.flatnonzero(end > begin)
            if len(lists) < need or not open_.any():
                continue
            before = self.early[own]
            open_[self.joined(self.early_entries, self.early_begin[own][before], self.early_end[own][before])] = False
            if not open_.any():
                continue
            lists = lists[np.argsort(end[lists] - begin[lists], kind="stable")]
            long = min(need - 1, int((end[lists] - begin[lists] > LONG_LIST).sum()))
            short, long = lists[:len(lists) - long], lists[len(lists) - long:]
            found = self.times(begin[short], end[short])
            wanted = np.flatnonzero(open_ & (found >= need - len(long)))
            if not len(wanted):
                continue
            self.probe(found, wanted, begin[long], end[long])
            wanted = wanted[100 * found[wanted] >= t * (n[x] + n[wanted] - found[wanted])]
            for y in wanted.tolist():
                if self.root[y] != self.root[x]:
                    self.root[self.root == self.root[y]] = self.root[x]
                    yield int(self.nodes[x]), int(self.nodes[y])


def divide_skip(rows: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """(x, y): links between components, at least one for each two that a link joins directly. Written out.

    Two nodes of ``n`` and ``m`` shingles that link share ``threshold / 100`` of
    the larger one's. In an order of all shingles, short lists first, the first
    shingle that they share thus stands among the first ``s - need + 1`` of the
    ``s`` shared ones of each. All nodes that have it there meet in one bundle,
    which brings their shingles once, and the T-occurrence search runs inside.
    A pair that meets in several bundles is looked at in the first. Bundles of
    one component are dropped, and so are later ones of the same members; a
    large one is cut into pieces, and each two of them meet. What is put out are
    links, never candidates. ``rows`` is used up.
    """
    need = F.ceil(F.col("n") * threshold / 100).cast("int")
    for _ in range(2):  # a node that goes shortens the lists, and so others go
        shared = rows.groupBy("node").agg(F.count(F.lit(1)).alias("_shared")).join(nodes.select("node", "n"), "node")
        staying = rows.join(shared.where(F.col("_shared") >= need).select("node"), "node")
        before, rows = rows, durable(open_lists(staying.select("shingle", "node", "component")))
        forget(before)
    lists = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("_length"))
    sets = rows.join(lists, "shingle").groupBy("node", "component").agg(
        F.collect_list(F.struct("_length", "shingle")).alias("_own")
    ).join(nodes.select("node", "n"), "node").where(F.size("_own") >= need)

    def ordered(batches):
        for batch in batches:
            lengths, own = (c.to_numpy() for c in batch.column(3).flatten().flatten())
            times = np.asarray(pa.compute.list_value_length(batch.column(3)), dtype=np.int64)
            order = np.lexsort((own, lengths, np.repeat(np.arange(len(times)), times)))
            offsets = pa.array(np.concatenate([[0], np.cumsum(times)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.ListArray.from_arrays(offsets, pa.array(own[order]))], names=["node", "component", "n", "own"]
            )

    sets = sets.select("node", "component", "n", "_own")
    sets = durable(sets.mapInArrow(ordered, "node bigint, component bigint, n bigint, own array<bigint>"))
    # the smaller of two nodes shares a larger part of its shingles, so it must have met the other earlier in its order
    of_smaller = F.size("own") - F.ceil(F.col("n") * (2 * threshold) / (100 + threshold)) + 1
    places = sets.select(
        "node", "component", of_smaller.alias("_smaller"), F.posexplode(F.slice("own", F.lit(1), F.size("own") - need + 1)).alias("_at", "shingle")
    )
    # bundles of the same members hold the same pairs, which are looked at in the first of them
    bundles = places.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("component").alias("_a"), F.max("component").alias("_b"),
        F.max(F.col("_at") < F.col("_smaller")).alias("_asked"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("_members"),
    ).where("_a <> _b AND _asked").join(lists, "shingle")
    bundles = bundles.groupBy("_members", "_rows").agg(F.min(F.struct("_length", "shingle")).alias("_first")).select(
        "_first.shingle", F.ceil(F.col("_rows") / BUNDLE).cast("int").alias("_pieces")
    )
    met = places.select("shingle", "node").join(bundles, "shingle").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("_pieces")).cast("int"))
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    met = met.select("node", "shingle", F.least("piece", "_other").alias("i"), F.greatest("piece", "_other").alias("j"), "piece")
    work = met.join(sets.select("node", "component", "n", "own"), "node").select("shingle", "i", "j", "node", "component", "n", "piece", "own")

    def search(batches):
        def of(parts):
            table = pa.Table.from_batches(parts)
            at, i, j = (table.column(c)[0].as_py() for c in range(3))
            nodes, components, n, piece = (table.column(c).to_numpy() for c in range(3, 7))
            sets = [x.values.to_numpy(zero_copy_only=False) for x in table.column(7)]
            yield from Bundle(at, nodes, components, n, piece, sets, threshold).links(i != j)

        held, key = [], None
        for batch in chain(batches, [None]):
            found = []
            if batch is None:
                if held:
                    found = list(of(held))
            elif batch.num_rows:
                keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
                starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
                for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
                    own = tuple(keys[:, a].tolist())
                    if held and own != key:
                        found += of(held)
                        held = []
                    held.append(batch.slice(a, b - a))
                    key = own
            x, y = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    dealt = work.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    found = durable(dealt.mapInArrow(search, "x bigint, y bigint").distinct())
    forget(sets, rows)
    return found


# --- the join ---------------------------------------------------------------

def node_components(docs: DataFrame, sketched: DataFrame, nodes: DataFrame, text_col: str, k: int, threshold: int) -> DataFrame | None:
    """(node, component) of the nodes with links; None if there are none. ``sketched`` is used up."""
    distinct = durable(nodes.where("node IS NOT NULL").dropDuplicates(["node"]).select("node", *FACTS))
    rows = shared_postings(sketched, distinct)
    forget(sketched)
    if rows.isEmpty():
        return None
    texts = node_texts(docs, nodes, rows, text_col, k, threshold)
    for levels in DENSER:
        before = rows, distinct
        rows, distinct = dense_postings(texts.join(rows.select("node").distinct(), "node"), k, threshold, levels)
        forget(*before)
    if rows.isEmpty():
        return None
    shared = rows.groupBy("node").agg(F.count(F.lit(1)).alias("_shared"))
    distinct = durable(distinct.join(shared, "node").withColumn("most", F.col("n") - F.col("posted") + F.col("_shared")).drop("_shared"))
    labels = None

    def add(found: DataFrame) -> None:
        nonlocal labels
        if not found.isEmpty():
            before, labels = labels, components(found, labels)
            forget(before)
        forget(found)

    bands = band_keys(rows) if ROUNDS else None
    for number in range(len(ROUNDS)):
        add(verify(band_pairs(bands, distinct, labels, number, threshold), texts, k, threshold))
    forget(bands, texts)
    remaining = durable(open_lists(labelled(rows, labels)))
    forget(rows)
    add(divide_skip(remaining, distinct, threshold))
    return labels


def linked_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD
) -> DataFrame:
    """(id, n_shingles, node, text_key, component, component_id) of every document; component is null without shingles."""
    sketched = sketches(docs, id_col, text_col, shingle, threshold)
    nodes = durable(sketched.drop("own"))
    members = durable(labelled(nodes.select("id", "n", "node", "text_key"), node_components(docs, sketched, nodes, text_col, shingle, threshold)))
    smallest = members.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("_first"))
    out = members.join(smallest, "component", "left")
    return out.select(
        "id", F.col("n").alias("n_shingles"), "node", "text_key", "component",
        F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("_first")).alias("component_id"),
    )


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: size of its shingle set and the smallest doc_id it reaches by links."""
    return linked_components(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group of linked documents: the one with the smallest id.

    Documents without shingles belong to no group and all stay.
    """
    found = durable(linked_components(docs, id_col=id_col, text_col=text_col, shingle=shingle, threshold=threshold))
    first = found.where(F.col("component").isNotNull() & F.col("id").eqNullSafe(F.col("component_id")))
    # copies of one row may share the smallest id, and so may two nodes: one node is kept, and one row of it
    kept = first.groupBy("component").agg(F.min("node").alias("_kept")).select("_kept")
    chosen = durable(first.join(kept, first["node"] == kept["_kept"]).groupBy("id", "text_key", "node").agg(F.count(F.lit(1)).alias("_times")))
    repeated = not chosen.groupBy("node").agg(F.sum("_times").alias("_times")).where("_times > 1").isEmpty()
    # id and text tell a document; texts need not be hashed to shingles again
    alone = found.where("node IS NULL").select("id", "text_key", "node").distinct()
    wanted = durable(chosen.select("id", "text_key", "node").unionByName(alone))
    columns = docs.columns
    rows = docs.select(F.struct(*[named(c) for c in columns]).alias("_doc"), named(id_col).alias("_id"), F.xxhash64(named(text_col)).alias("_key"))
    staying = rows.join(wanted, (F.col("_key") == F.col("text_key")) & F.col("_id").eqNullSafe(F.col("id")))
    if repeated:
        staying = staying.where("node IS NOT NULL").dropDuplicates(["node"]).unionByName(staying.where("node IS NULL"))
    return staying.select(*[F.col("_doc").getField(c).alias(c) for c in columns])
