"""Embedding near-duplicates: an exact metric range join over pivot cells.

Vectors are scaled to length one, where cosine >= c is Euclidean distance
<= r = sqrt(2 - 2c).  Equal unit vectors collapse to one representative with a
count.  Every representative belongs to the cell of its nearest pivot.  For a
pair within r whose ends lie in cells i < j, the triangle inequality gives
d(y, p_i) <= R_i + r (R_i: radius of cell i) and d(y, p_i) <= d(y, p_j) + 2r, so
y in j is copied to i when both hold, and each cell finds its pairs alone.
A cell with many members is cut into blocks; a member also visits the blocks
before its own.  Distances are screened in single precision with a margin and
decided in double.

No pair leaves a cell: a cell gives link counts, and a spanning forest of its
links for the components.

Pivots are a documented bounded sample (at most ``MOST_PIVOTS``, by hash);
every vector is compared.  In many dimensions without clusters distances
concentrate and most vectors visit most cells; the join then stays exact and
its work grows with the square of the rows.

Defined cases: null, empty and zero vectors, vectors with a null or non-finite
component and rows with a null vec_id link with nothing; vectors of different
length never link; rows with equal vectors, or equal vec_ids, are vectors of
their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common
from loomgraph.llm.components import components

COSINE = 0.95
CELL = 4096
BLOCK = 8192
MOST_PIVOTS = 1024
_MARGIN = 1e-4
_STEP = 1024


def units(vectors: DataFrame) -> DataFrame:
    """vec_id and the unit vector's bytes (little-endian doubles); null where nothing can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            out: list[bytes | None] = [None] * len(b)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            for i, (ok, x) in enumerate(zip(known, lists)):
                if not ok or not x.is_valid or x.values.null_count or not len(x.values):
                    continue
                v = x.values.to_numpy().astype(np.float64)
                top = np.abs(v).max()
                if not np.isfinite(top) or top == 0:
                    continue
                v = v / top
                out[i] = (v / math.sqrt(float(v @ v)) + 0.0).astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], names=["vec_id", "unit"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, unit binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ pivots.T), 0.0))


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    dims = np.array([len(u) // 8 for u in b.column("unit").to_pylist()])
    for dim in np.unique(dims):
        yield int(dim), np.flatnonzero(dims == dim)


def _with_cells(reps: DataFrame, pivots: dict[int, np.ndarray], first: dict[int, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, dist = np.empty(len(b), np.int32), np.zeros(len(b))
            for dim, at in _by_dim(b):
                if dim not in pivots:
                    cell[at] = -dim  # no pivot of that length: a cell by itself
                    continue
                d = _distances(_matrix(b.column("unit").take(pa.array(at)), dim), pivots[dim])
                near = d.argmin(axis=1)
                cell[at], dist[at] = near + first[dim], d[np.arange(len(at)), near]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(dist)], names=[*b.schema.names, "cell", "dist"])

    return reps.mapInArrow(run, "id long, copies long, unit binary, cell int, dist double")


def _visits(members: DataFrame, pivots: dict[int, np.ndarray], first: dict[int, int], radius: dict[int, float], blocks: dict[int, int], r: float) -> DataFrame:
    """A row per place where a representative is held or visits: cell, block, guest."""
    slack = 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cells, dist = b.column("id").to_numpy(), b.column("cell").to_numpy(), b.column("dist").to_numpy()
            row: list[np.ndarray] = []
            cell: list[np.ndarray] = []
            block: list[np.ndarray] = []
            guest: list[np.ndarray] = []

            def add(rows: np.ndarray, c: np.ndarray | int, k: np.ndarray | int, visiting: bool) -> None:
                row.append(rows)
                cell.append(np.broadcast_to(c, len(rows)).astype(np.int32))
                block.append(np.broadcast_to(k, len(rows)).astype(np.int32))
                guest.append(np.full(len(rows), visiting))

            own = np.array([blocks[c] for c in cells.tolist()])
            mine = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % own
            add(np.arange(len(b)), cells, mine, False)
            for k in range(int(own.max(initial=1)) - 1):
                later = np.flatnonzero(mine > k)
                add(later, cells[later], k, True)
            for dim, at in _by_dim(b):
                if dim not in pivots:
                    continue
                d = _distances(_matrix(b.column("unit").take(pa.array(at)), dim), pivots[dim])
                for i in range(d.shape[1]):
                    c = first[dim] + i
                    if c not in radius:
                        continue
                    go = at[(cells[at] > c) & (d[:, i] <= radius[c] + r + slack) & (d[:, i] <= dist[at] + 2 * r + slack)]
                    for k in range(blocks[c]):
                        add(go, c, k, True)
            rows = np.concatenate(row)
            base = b.select(["id", "copies", "unit"])
            for s in range(0, len(rows), 20_000):
                part = slice(s, s + 20_000)
                cols = [x[part] for x in (np.concatenate(cell), np.concatenate(block), np.concatenate(guest))]
                taken = base.take(pa.array(rows[part]))
                yield pa.RecordBatch.from_arrays([*taken.columns, *map(pa.array, cols)], names=["id", "copies", "unit", "cell", "block", "guest"])

    return members.mapInArrow(run, "id long, copies long, unit binary, cell int, block int, guest boolean")


class _Block:
    """The held vectors of one block: link counts and a forest over all that it has seen."""

    def __init__(self, cosine: float) -> None:
        self.cosine = cosine
        self.ids, self.copies, self.x = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        self.links, self.root = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _pairs(self, y: np.ndarray, y32: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.nonzero(y32 @ self.x32[low:high].T >= self.cosine - _MARGIN)
        sure = np.einsum("ij,ij->i", y[i], self.x[low + j]) >= self.cosine if len(i) else np.zeros(0, bool)
        return i[sure], low + j[sure]

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Merge the trees of held vectors a and b; roots are the least indexes."""
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def hold(self, ids: np.ndarray, copies: np.ndarray, y: np.ndarray) -> None:
        n = len(self.ids)
        self.ids, self.copies = np.concatenate([self.ids, ids]), np.concatenate([self.copies, copies])
        self.x = y if self.x is None else np.concatenate([self.x, y])
        self.x32 = self.x.astype(np.float32)
        self.links = np.concatenate([self.links, np.zeros(len(ids), np.int64)])
        self.root = np.concatenate([self.root, np.arange(n, n + len(ids))])
        y32 = y.astype(np.float32)
        for s in range(0, len(ids), _STEP):
            e = min(len(ids), s + _STEP)
            for t in range(0, n + e, _STEP):
                i, j = self._pairs(y[s:e], y32[s:e], t, min(n + e, t + _STEP))
                i = i + n + s
                once = i > j
                i, j = i[once], j[once]
                np.add.at(self.links, i, self.copies[j])
                np.add.at(self.links, j, self.copies[i])
                self._join(i, j)

    def visit(self, ids: np.ndarray, copies: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (id, links, other) of the guests that link here."""
        links, near = np.zeros(len(ids), np.int64), np.full(len(ids), -1, np.int64)
        y32 = y.astype(np.float32)
        for s in range(0, len(ids), _STEP):
            for t in range(0, len(self.ids), _STEP):
                i, j = self._pairs(y[s : s + _STEP], y32[s : s + _STEP], t, min(len(self.ids), t + _STEP))
                i = i + s
                np.add.at(links, i, self.copies[j])
                np.add.at(self.links, j, copies[i])
                new = near[i] < 0
                near[i[new]] = j[new]
                self._join(j, near[i])
        hit = np.flatnonzero(links)
        return ids[hit], links[hit], self.ids[near[hit]]

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hit = np.flatnonzero(self.links)
        return self.ids[hit], self.links[hit], self.ids[self.root[hit]]


def _join_cells(places: DataFrame, cosine: float) -> DataFrame:
    names = ["id", "links", "other"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, _Block(cosine)
        for b in batches:
            keys = np.stack([b.column("cell").to_numpy(), b.column("block").to_numpy(), b.column("guest").to_numpy(zero_copy_only=False).astype(np.int32)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(b)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if at != (key := tuple(keys[s, :2])):
                    if at is not None:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, block.close())), names=names)
                    at, block = key, _Block(cosine)
                part = b.slice(s, e - s)
                ids, copies = part.column("id").to_numpy(), part.column("copies").to_numpy()
                y = _matrix(part.column("unit"), len(part.column("unit")[0].as_py()) // 8)
                if not keys[s, 2]:
                    block.hold(ids, copies, y)
                elif block.x is not None:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, block.visit(ids, copies, y))), names=names)
        if at is not None:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, block.close())), names=names)

    return places.mapInArrow(run, "id long, links long, other long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id, embedding)``."""
    spark = vectors.sparkSession
    common.small_batches(spark)
    r = math.sqrt(2.0 - 2.0 * cosine)
    all_units = common.written(units(vectors), "units")
    reps = all_units.where("unit IS NOT NULL").groupBy("unit").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "copies", "unit")
    reps = common.written(reps, "representatives")
    n = reps.count()
    chosen = [x["unit"] for x in reps.orderBy(F.xxhash64("id"), "id").limit(min(MOST_PIVOTS, max(1, -(-n // cell)))).select("unit").collect()]
    pivots: dict[int, np.ndarray] = {}
    first: dict[int, int] = {}
    for dim in sorted({len(u) // 8 for u in chosen}):
        first[dim] = sum(map(len, pivots.values()))
        pivots[dim] = np.array([np.frombuffer(u, "<f8") for u in chosen if len(u) == 8 * dim])
    members = common.written(_with_cells(reps, pivots, first), "cells")
    found = members.groupBy("cell").agg(F.max("dist").alias("r"), F.count(F.lit(1)).alias("n")).collect()  # a row per pivot
    radius = {x["cell"]: x["r"] for x in found}
    blocks = {x["cell"]: -(-x["n"] // BLOCK) for x in found}
    places = _visits(members, pivots, first, radius, blocks, r)
    dealt = places.repartition(max(common.partitions(spark), sum(blocks.values())), "cell", "block").sortWithinPartitions("cell", "block", "guest")
    linked = common.written(_join_cells(dealt, cosine), "links")
    counts = linked.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(linked.select(F.col("id").alias("u"), F.col("other").alias("v"))).withColumnRenamed("node", "id")
    known = reps.join(counts, "id", "left").join(groups, "id", "left").select(
        F.col("unit").alias("_unit"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    rows = all_units.join(known, F.col("unit") == F.col("_unit"), "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )
