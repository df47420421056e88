"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors are one class. Spherical k-means, fitted on a bounded sample, gives centres; a
vector goes to its nearest centre's cell and to others that could hold the middle of it and a
partner, so that a pair meets in the cell of its middle. If cosine(x, y) >= t, the unit vector m between them lies within
r = 2 sin(acos(t) / 4) of both, and m can lie in the cell of centre b only if x.(c_a - c_b) <= r |c_a - c_b|, with a the
nearest centre. That bound is reached only by pairs that differ along the line between two centres. Differences
in any other direction have a part along it of some r / sqrt(d), d the number of coordinates, and vectors are dealt for SURE times
that; ``sure=None`` deals them for the whole bound, loses no link whatever the centres are, and costs more copies. Recall is measured in
the tests and the README. A pair that meets in several cells counts in the first of them.

Within a cell, vectors are compared by products of blocks. A large cell is cut into blocks; each block is a unit
of work of its own which meets the rest of the cell as a stream. A unit gives back, per vector, the
number of links and one edge of a spanning forest, never pairs. Classes are then joined into components.

Results for odd input: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different lengths neither (those of the most common length use the centres, others one cell for each
length); rows with a null id link like others but give no component id (null, if no other row of the
component has an id) and are not kept; repeated rows link with each other, and all rows of the id that is kept are kept;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm import store
from duskwatch.llm.classes import join_classes
from duskwatch.llm.components import components

#: Vectors for which a cell is planned, most cells, vectors per cell in the sample (picked by hash) that is fitted, and rounds of fitting.
CELL, CELLS, SAMPLE, ROUNDS = 256, 16384, 64, 5
#: Standard deviations of a random difference along a line for which vectors are dealt to further cells.
SURE = 2.5
#: Vectors of a cell that one unit of work compares with the whole cell, and vectors in a product.
BLOCK, TILE = 16384, 1024
#: Rows that a task of comparing reads, if no cell is larger.
TASK = 4096
#: Room for rounding in the test of cells.
SLACK = 1e-7


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as an array of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors scaled to length one, without overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _sums(centres: np.ndarray):
    """Per cell the sum of a task's unit vectors in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(centres)
        for batch in batches:
            if batch.num_rows:
                x = unit(_matrix(batch.column("v")))
                np.add.at(total, (x @ centres.T).argmax(1), x)
        hit = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit].tolist(), pa.list_(pa.float64()))], names=["cell", "total"])

    return run


def fit(vectors: DataFrame, count: int) -> np.ndarray:
    """Unit centres of cells, by spherical k-means on some SAMPLE vectors per cell, picked by a hash. ``vectors`` has ``node`` and ``v``, all of one length."""
    k = max(1, min(CELLS, count // CELL))
    share = min(1.0, 1.2 * SAMPLE * k / max(1, count))
    picked = vectors.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = store.keep(picked.select("node", "v"), "cells-sample")
    first = sample.df.orderBy(F.xxhash64("node", F.lit(1))).limit(k).collect()
    centres = unit(np.array([r.v for r in first]))
    for _ in range(ROUNDS if k > 1 else 0):
        found = sample.df.select("v").mapInArrow(_sums(centres), "cell long, total array<double>")
        summed = found.select("cell", F.posexplode("total").alias("at", "x")).groupBy("cell", "at").agg(F.sum("x").alias("x"))
        total = np.zeros_like(centres)
        for cell, at, x in summed.collect():  # cells times coordinates
            total[cell, at] = x
        hit = np.abs(total).max(1) > 0
        centres[hit] = unit(total[hit])
    sample.drop()
    return centres


def _deal(centres: np.ndarray, threshold: float, sure: float | None):
    """Cells of each vector: its own and those that could hold the middle of a linked pair; with each, the cells before it."""
    reach = 2 * math.sin(math.acos(min(1.0, threshold)) / 4)
    if sure is not None:
        reach *= min(1.0, sure / math.sqrt(centres.shape[1]))
    rows_at_once = max(1, (1 << 21) // len(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(begin, rows_at_once)
                x = unit(_matrix(part.column("v")))
                near = x @ centres.T
                own = near.argmax(1)
                apart = np.sqrt(np.maximum(0, 2 - 2 * centres[own] @ centres.T))
                rows, cells = np.nonzero(near[np.arange(len(x)), own][:, None] - near <= reach * apart + SLACK)
                starts = np.searchsorted(rows, rows)
                before = [cells[a:b].tolist() for a, b in zip(starts, range(len(rows)), strict=True)]
                pick = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells, pa.int32()), pa.array(before, pa.list_(pa.int32())), pick.column("node"), pick.column("n"), pick.column("v")],
                    names=["cell", "before", "node", "n", "v"],
                )

    return run


class _Unit:
    """One block of a cell: links of its vectors with each other and with what streams by."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.parts: list = []
        self.ready = False

    def add(self, node, n, x, before) -> None:
        self.parts.append((node, n, x, before))

    def close(self) -> None:
        self.ready = True
        self.node, self.n, self.x = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        self.before = [b for p in self.parts for b in p[3]]
        self.parts = []
        self.links = np.zeros(len(self.node), np.int64)
        self.label = np.arange(len(self.node))
        for a in range(0, len(self.node), TILE):
            z = slice(a, a + TILE)
            self.meet(self.node[z], self.n[z], self.x[z], self.before[z], a)

    def meet(self, node, n, x, before, inner: int | None = None) -> np.ndarray:
        """Link the block with further vectors; for each of these a linked node of the block, or -1. ``inner``: they are the block's, from this place."""
        size = len(self.node)
        if inner is None:
            # while they are met, they are nodes of the forest behind those of the block
            self.label = np.concatenate((self.label, np.arange(size, size + len(node))))
        for a in range(0, size, TILE):
            near = self.x[a : a + TILE] @ x.T
            p, q = np.nonzero(near >= self.threshold - 1e-12)
            close = near[p, q] - self.threshold
            linked = close >= 0
            for i in np.flatnonzero(np.abs(close) <= 1e-12):
                linked[i] = math.fsum(self.x[a + p[i]] * x[q[i]]) >= self.threshold
            if inner is not None:
                linked &= a + p != inner + q
            p, q = a + p[linked], q[linked]
            if len(p):
                fresh = ~self._met(p, q, before)
                p, q = p[fresh], q[fresh]
                np.add.at(self.links, p, n[q])
                self._unite(p, q + (size if inner is None else inner))
        if inner is not None:
            return np.full(len(node), -1)
        root = self.label[size:]
        self.label = self.label[:size]
        return np.where(root < size, self.node[np.minimum(root, size - 1)], -1)

    def _met(self, p, q, before) -> np.ndarray:
        """Whether the pairs have met in an earlier cell."""
        mine, theirs = {i: self.before[i] for i in np.unique(p)}, {j: before[j] for j in np.unique(q)}
        number: dict[int, int] = {}
        for cells in theirs.values():
            for c in cells:
                number.setdefault(c, len(number))
        if not number or not any(mine.values()):
            return np.zeros(len(p), bool)
        at_p, at_q = np.unique(p, return_inverse=True)[1], np.unique(q, return_inverse=True)[1]
        left, right = np.zeros((len(mine), len(number)), np.float32), np.zeros((len(theirs), len(number)), np.float32)
        for table, side in ((left, mine), (right, theirs)):
            for row, cells in enumerate(side.values()):
                table[row, [number[c] for c in cells if c in number]] = 1
        return (left @ right.T)[at_p, at_q] > 0

    def _unite(self, p, q) -> None:
        label = self.label
        while True:
            one, two = label[p], label[q]
            if (one == two).all():
                return
            least = np.minimum(one, two)
            np.minimum.at(label, one, least)
            np.minimum.at(label, two, least)
            while True:
                deeper = label[label]
                if (deeper == label).all():
                    break
                label[:] = deeper

    def out(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts and not self.ready:
            return (np.zeros(0, np.int64),) * 3
        if not self.ready:
            self.close()
        hit = np.flatnonzero(self.links)
        return self.node[hit], self.links[hit], self.node[self.label[hit]]


def _compare(threshold: float):
    """Rows (cell, block, side, ...) in that order: side 0 is the unit's block, side 1 the other blocks of its cell."""
    names = ["node", "links", "other"]

    def frame(node, links, other):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x), pa.int64()) for x in (node, links, other)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, unit_ = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "cell", "block", "side")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                for c in range(a, b, TILE):
                    part = batch.slice(c, min(TILE, b - c))
                    what = (part.column("node").to_numpy(), part.column("n").to_numpy(), unit(_matrix(part.column("v"))), part.column("before").to_pylist())
                    if tuple(key[:3, a]) != now:
                        if unit_ is not None:
                            yield frame(*unit_.out())
                        now, unit_ = tuple(key[:3, a]), _Unit(threshold)
                    if key[3, a] == 0:
                        unit_.add(*what)
                        continue
                    if not unit_.parts and not unit_.ready:
                        continue  # no vector fell into this block
                    if not unit_.ready:
                        unit_.close()
                    met = unit_.meet(*what)
                    hit = met >= 0
                    yield frame(what[0][hit], np.zeros(int(hit.sum()), np.int64), met[hit])
        if unit_ is not None:
            yield frame(*unit_.out())

    return run


def _units(dealt: store.Kept) -> DataFrame:
    """The dealt vectors by unit of work: each block of a cell, and the cell's other blocks for it to meet."""
    sizes = dealt.df.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sizes = store.keep(sizes, "cells-sizes")
    # rows that the units read, each block of a cell the whole cell
    read = sizes.df.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    # one row per cell, and there are at most CELLS and one per other length
    cut = dealt.df.join(sizes.sized().drop("n"), ["length", "cell"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = cut.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("side", (F.col("block") != F.col("mine")).cast("int"))
    spread = spread.select("length", "cell", "block", "side", "node", "n", "before", "v")
    order = ["length", "cell", "block"]
    return spread.repartition(read // TASK + 1, *order).sortWithinPartitions(*order, "side")


def link(rows: DataFrame, threshold: float = 0.95, sure: float | None = SURE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Every row's ``vec_id, n_links, component_id, kept``; ``threshold`` is above 0."""
    numbered = rows.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")
    )
    numbered = store.keep(numbered, "cells-rows").df
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = numbered.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    bad = numbered.join(good.select("row"), "row", "left_anti").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")
    )
    classes = good.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("node"), F.min("vec_id").alias("least"))
    classes = store.keep(classes.withColumn("length", F.size("v")), "cells-classes")
    lengths = classes.df.groupBy("length").count().orderBy(F.desc("count"), F.desc("length")).first()
    most, count = (lengths.length, lengths["count"]) if lengths else (0, 0)
    common = classes.df.where(F.col("length") == most)
    dealt = classes.df.where(F.col("length") != most).select(
        F.lit(0).alias("cell"), F.array().cast("array<int>").alias("before"), "node", "n", "v"
    )
    if count:
        deal = _deal(fit(common, count), threshold, sure)
        dealt = common.select("node", "n", "v").mapInArrow(deal, "cell int, before array<int>, node long, n long, v array<double>").union(dealt)
    dealt = store.keep(dealt.withColumn("length", F.size("v")), "cells-dealt")
    found = store.keep(_units(dealt).mapInArrow(_compare(threshold), "node long, links long, other long"), "cells-links")
    dealt.drop()
    links = found.df.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.df.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = classes.df.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = store.keep(named.select("v", "node", "n", "least", "label"), "cells-named").df
    groups = named.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    total = named.count()
    groups = store.keep(groups, "cells-groups").df
    full = join_classes(named.select("v", "node", "n", "label"), groups, "label", "size", total).join(links, "node", "left")
    full = store.keep(full.select("v", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "cells-full").df
    out = join_classes(good.select("vec_id", "v"), full, "v", "n", good.count())
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")).union(bad)
