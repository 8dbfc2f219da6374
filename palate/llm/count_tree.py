"""Exact Jaccard join with a tree over count vectors.

A document's set is hashed into GROUPS groups; how many of its shingles fall into each is its point. Two documents share at
most the sum of the smaller coordinates of their points, and at most as much as a box's upper corner allows with any
point in the box, so a tree of boxes over points rejects most pairs without their sets. What is left is verified on
full sets.

Boxes over hashed counts of unlike documents overlap in every coordinate, so one tree over all of them rejects next to
nothing above its leaves (README has figures). The tree's top level is therefore a cell for each of a document's rarest
shingles: of two sets that are similar enough, the first n - ceil(percent * n) + 1 shingles in one global order have one in
common, whatever the order. Shingles whose hash slot is frequent come last in it, so a line that many documents share
makes no cell.

In a cell all members meet its smallest one first. Members that are in one component then need not meet again; the others
are dealt by size and in blocks, each block's points are packed into a tree, and the other members search it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palate.llm.common import components, discard, join_components, materialise, mix, one_text_each, shingle_sets, text_parts
from palate.llm.near_dup import confirm

PERCENT = 80
GROUPS = 256
#: Sets of more shingles have a second point in more groups, for the pairs that the first one lets pass.
FINE = 1024
#: Slots that shingles are counted in to tell the frequent ones; a slot is frequent from so many times the mean on.
SLOTS, FREQUENT = 1 << 16, 4
#: Points of a leaf, and children of an inner node.
FAN = 16
#: Members of a cell and size class in one block; cells of up to SMALL need no tree.
BLOCK, SMALL = 2048, 48
_FULL = np.uint8(0xFF)

SKETCH = "doc_id long, n_shingles long, fp binary, counts binary, fine binary, keys array<long>"


def slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(48)).astype(np.int64)


def group_counts(shingles: np.ndarray) -> np.ndarray:
    """The point of a set: shingles in each group. A coordinate that is full stands for any number."""
    found = np.bincount(((shingles >> np.uint64(40)) & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return np.minimum(found, int(_FULL)).astype(np.uint8)


def fine_counts(shingles: np.ndarray) -> bytes:
    """The point of a set of over FINE shingles in about a quarter as many groups as it has shingles, a power of two; each
    group of fewer is a run of groups of more. Nothing for smaller sets, which GROUPS tell apart well enough."""
    if len(shingles) <= FINE:
        return b""
    bits = min(int(len(shingles) / 4 - 1).bit_length(), 24)
    group = ((shingles >> np.uint64(16)) & np.uint64((1 << 24) - 1)) >> np.uint64(24 - bits)
    return np.minimum(np.bincount(group.astype(np.int64), minlength=1 << bits), int(_FULL)).astype(np.uint8).tobytes()


def fine_bound(x: bytes, y: bytes) -> int | None:
    """``bound`` of two fine points, the finer one summed up to the groups of the other; None where there is none."""
    if not x or not y:
        return None
    a, b = (np.frombuffer(v, dtype=np.uint8).astype(np.int64) for v in (x, y))
    if (a == _FULL).any() or (b == _FULL).any():
        return None
    n = min(len(a), len(b))
    return int(np.minimum(a.reshape(n, -1).sum(axis=1), b.reshape(n, -1).sum(axis=1)).sum())


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Shared shingles from which sets of these sizes are similar enough."""
    return -(-percent * (a + b) // (100 + percent))


def bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The most shingles that two points, or a point and a box by its upper corner, can share."""
    low = np.minimum(x, y)
    most = low.sum(axis=-1, dtype=np.int64)
    return np.where((low == _FULL).any(axis=-1), np.iinfo(np.int64).max, most)


def prefix(shingles: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in the order (frequency level of the slot, hash) of an ascending distinct array."""
    n = len(shingles)
    first = n - -(-percent * n // 100) + 1
    level = levels[slot(shingles)]
    if not level.any():
        return shingles[:first]
    return shingles[np.argsort(level, kind="stable")[:first]]


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, dtype=np.int64)
    for batch in batches:
        for _, texts in text_parts(batch.column(0)):
            for s in shingle_sets(texts):
                total += np.bincount(slot(s), minlength=SLOTS) if len(s) > SLOTS // 8 else 0
                if len(s) <= SLOTS // 8:
                    np.add.at(total, slot(s), 1)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["slot", "n"])


def frequency_levels(texts: DataFrame) -> np.ndarray:
    """For each of SLOTS hash slots how much more shingles than the mean slot it has over all documents, as a power of
    two; 0 under FREQUENT times the mean. A slot is a row, so what the driver gets has one size for any input."""
    found = texts.select("text").mapInArrow(_count_slots, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SLOTS)
    for row in found:
        counts[row["slot"]] = row["n"]
    share = counts / max(counts.mean(), 1.0)
    return np.where(share >= FREQUENT, np.log2(np.maximum(share, 1)), 0).astype(np.uint8)


def _sketches(levels: np.ndarray, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [batch.column(0).to_pylist(), [], [], [], [], []]
            for _, texts in text_parts(batch.column(1)):
                for s in shingle_sets(texts):
                    twice = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                    rows[1].append(len(s))
                    rows[2].append(s.sum(dtype=np.uint64).tobytes() + twice.sum(dtype=np.uint64).tobytes())
                    rows[3].append(group_counts(s).tobytes())
                    rows[4].append(fine_counts(s))
                    rows[5].append(prefix(s, levels, percent).view(np.int64) if len(s) else [])
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc_id", "n_shingles", "fp", "counts", "fine", "keys"])

    return run


def _points(column: pa.Array) -> np.ndarray:
    """A binary column of points as a matrix."""
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].reshape(-1, GROUPS)


def _bounded(percent: int):
    """Pairs (a, b, na, nb, ca, cb) that the bound allows, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
                keep = bound(_points(batch.column("ca")), _points(batch.column("cb"))) >= needed(na, nb, percent)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _refined(percent: int):
    """Pairs (a, b, na, nb, fa, fb) that the bound of fine points allows, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need = needed(*(batch.column(c).to_numpy() for c in ("na", "nb")), percent).tolist()
            most = (fine_bound(x, y) for x, y in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist(), strict=True))
            keep = [m is None or m >= n for m, n in zip(most, need, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class Tree:
    """A packed tree over points: sorted by size into slabs and in each by the coordinate that differs most, FAN points a
    leaf, FAN leaves an inner node; each node has the upper corner of its box and the range of its sizes."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        slab = np.argsort(sizes, kind="stable")
        wide = points[:, int(np.argmax(np.ptp(points.astype(np.int64), axis=0)))]
        width = FAN * max(1, round((len(sizes) / FAN) ** 0.5))
        rank = np.empty(len(sizes), dtype=np.int64)
        rank[slab] = np.arange(len(sizes)) // width
        self.order = np.lexsort((wide, rank))
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > FAN:
            corner, low, high = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.maximum.reduceat(corner, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def search(self, sizes: np.ndarray, points: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) numbers of all pairs that the bound allows, the point's set being as large as the query's or
        larger. From the top on, only children of nodes that may hold such a point are looked at."""
        q = np.repeat(np.arange(len(sizes)), len(self.levels[-1][1]))
        node = np.tile(np.arange(len(self.levels[-1][1])), len(sizes))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, low, high = self.levels[depth]
            fits = (high[node] >= sizes[q]) & (percent * low[node] <= 100 * sizes[q])
            q, node = q[fits], node[fits]
            keep = np.zeros(len(q), dtype=bool)
            for i in range(0, len(q), 1 << 15):
                x, y = q[i : i + (1 << 15)], node[i : i + (1 << 15)]
                keep[i : i + (1 << 15)] = bound(points[x], corner[y]) >= needed(sizes[x], np.maximum(low[y], sizes[x]), percent)
            q, node = q[keep], node[keep]
            if depth:
                child = node[:, None] * FAN + np.arange(FAN)
                real = child < len(self.levels[depth - 1][1])
                q, node = np.repeat(q, FAN)[real.ravel()], child[real]
        return q, self.order[node]


def _search_blocks(percent: int):
    """Rows (key, size, i, j, query, rep, n, comp, rest, counts), those of a block together: pairs (a, b) of a query and a
    point of the same block that are in different components, one of them not in the cell's own, and that the bound
    allows. Small blocks of a batch are compared together, larger ones by a tree each."""

    def pairs(batch: pa.RecordBatch, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, points, query = batch.column("n").to_numpy(), _points(batch.column("counts")), batch.column("query").to_numpy(zero_copy_only=False)
        small = size <= SMALL
        begin = first[small]
        count = size[small]
        # every row of a small block beside every row of it
        row = np.repeat(begin, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        row, reach, start = row[query[row]], np.repeat(count, count)[query[row]], np.repeat(begin, count)[query[row]]
        for i in range(0, len(row), 4096):
            x, r, s = row[i : i + 4096], reach[i : i + 4096], start[i : i + 4096]
            y = np.repeat(s, r) + np.arange(int(r.sum())) - np.repeat(np.cumsum(r) - r, r)
            x = np.repeat(x, r)
            fits = ~query[y] & (n[y] >= n[x]) & (percent * n[y] <= 100 * n[x])
            x, y = x[fits], y[fits]
            keep = bound(points[x], points[y]) >= needed(n[x], n[y], percent)
            yield x[keep], y[keep]
        for s, m in zip(first[~small].tolist(), size[~small].tolist(), strict=True):
            rows = np.arange(s, s + m)
            x, y = rows[query[s : s + m]], rows[~query[s : s + m]]
            if len(x) and len(y):
                tree = Tree(n[y], points[y])
                for i in range(0, len(x), 256):
                    found, point = tree.search(n[x[i : i + 256]], points[x[i : i + 256]], percent)
                    yield x[i + found], y[point]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not len(batch):
                continue
            batch = batch if held is None else pa.concat_batches([held, batch])
            ids = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "size", "i", "j")])
            first = np.flatnonzero(np.concatenate(([True], (ids[:, 1:] != ids[:, :-1]).any(axis=0))))
            held = batch.slice(first[-1])
            if len(first) > 1:
                yield from answers(batch.slice(0, first[-1]), first[:-1], np.diff(first))
        if held is not None:
            yield from answers(held, np.zeros(1, dtype=np.int64), np.array([len(held)]))

    def answers(batch: pa.RecordBatch, first: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        rep, comp, rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "comp", "rest"))
        for x, y in pairs(batch, first, size):
            keep = (comp[x] != comp[y]) & (rest[x] | rest[y])
            a, b = rep[x[keep]], rep[y[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Components under 100 * intersection >= ``percent`` * union: rows (doc_id, n_shingles, component_id), one a document.

    Words are runs of characters other than white space, A-Z lower-cased; a document's set is its distinct five-word
    shingles, or with one to four words the whole sequence as one shingle. ``component_id`` is the smallest id
    reachable over links. Candidate cells, bounds and verification are exact: no link is lost and none is made up,
    but for equal 64-bit hashes of different shingles.

    Empty or null texts have no shingles and are linked with nothing. Rows that repeat an id count as one document with
    the smallest of their texts. Rows with a null id come back once each with a null component, linked with nothing.
    Other columns are not read. An empty table gives an empty table. Texts of any length are read whole.
    """
    texts = one_text_each(docs, id_col, text_col)
    levels = frequency_levels(texts)
    whole = materialise(texts.mapInArrow(_sketches(levels, percent), SKETCH), "sketches")
    named = materialise(whole.select("doc_id", "n_shingles", "fp"), "named")
    classes = named.where("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    full = whole.where("n_shingles > 0").drop("fp")
    reps = classes.join(full, classes.rep == full.doc_id).select("rep", classes.fp, F.col("n_shingles").alias("n"), "counts", "fine", "keys")
    reps = materialise(reps, "classes")
    discard(whole)
    comp = _linked(reps, texts, percent)
    out = named.join(reps.select("fp", "rep"), "fp", "left").join(comp.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("comp", "rep", "doc_id").alias("component_id"))
    base = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text"))
    nameless = base.where("doc is null").mapInArrow(_sketches(levels, percent), SKETCH)
    return out.unionByName(nameless.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))


def _fine(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that their fine points allow."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"f{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", "na", "nb", "fa", "fb").mapInArrow(_refined(percent), "a long, b long")


def _linked(reps: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Components (id, comp) of class representatives; those without a link have no row."""
    members = reps.select("rep", F.explode("keys").alias("key"))
    cells = members.groupBy("key").agg(F.min("rep").alias("center"), F.max("rep").alias("top")).where("center < top")
    cells = materialise(cells.select("key", "center"), "cells")
    shared = materialise(members.join(cells, "key"), "shared")
    discard(cells)
    points = reps.select("rep", "n", "counts")
    side = lambda x: points.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("counts").alias(f"c{x}"))
    stars = shared.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    sized = stars.join(side("b"), "b").join(side("a"), "a").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    near = materialise(sized.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(_bounded(percent), "a long, b long"), "near")
    comp = materialise(components(confirm(_fine(near, reps, percent), texts, percent), "stars"), "labels")
    discard(near)
    of = shared.join(comp.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    of = of.join(comp.select(F.col("id").alias("center"), F.col("comp").alias("home")), "center", "left").select(
        "key", "rep", F.coalesce("comp", "rep").alias("comp"), F.coalesce("home", "center").alias("home"), (F.col("rep") == F.col("center")).alias("tested")
    )
    # a cell's smallest member has met all others
    of = materialise(of.where("not tested"), "placed")
    discard(shared)
    # where the others are in one component there is nothing left to test
    open_ = of.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    size = F.floor(F.log("n") / float(np.log(100 / percent)) + 1e-9).cast("int")
    left = of.join(open_, "key", "left_semi").withColumn("rest", F.col("comp") != F.col("home"))
    left = materialise(left.join(points, "rep").select("key", "rep", "n", "comp", "rest", "counts", size.alias("size")), "open")
    discard(of)
    many = left.groupBy("key", "size").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # a set as large or larger, yet similar enough, is of the same size class or the next
    every = left.withColumn("query", F.lit(False)).unionByName(
        left.withColumn("query", F.lit(True)).withColumn("size", F.explode(F.array("size", F.col("size") + 1)))
    )
    own = F.pmod(F.xxhash64("rep"), "blocks").cast("int")
    all_ = F.sequence(F.lit(0), F.col("blocks") - 1)
    rows = every.join(many, ["key", "size"]).withColumn("own", own).withColumn("other", F.explode(all_))
    rows = rows.select(
        "key", "size", F.when(F.col("query"), F.col("other")).otherwise(F.col("own")).alias("i"), F.when(F.col("query"), F.col("own")).otherwise(F.col("other")).alias("j"),
        "query", "rep", "n", "comp", "rest", "counts",
    )
    block = ("key", "size", "i", "j")
    found = rows.repartition(*block).sortWithinPartitions(*block).mapInArrow(_search_blocks(percent), "a long, b long").distinct()
    found = materialise(found, "found")
    discard(left)
    second = materialise(confirm(_fine(found, reps, percent), texts, percent), "links")
    discard(found)
    return comp if second.isEmpty() else join_components(comp, second)
