"""Connected components of an edge table: local contraction, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

#: Edges that one task contracts at most, about.
PART_EDGES = 250_000


def _sum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each pair with the least neighbour of u; minima combine before the shuffle, and as they are written the join has exchanges of its own, in which a hot u can be split."""
    least = common.written(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u"), "least")
    return pairs.join(least, F.col("u") == F.col("_u")).drop("_u")


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least node of each node's tree once all pairs (a, b) are joined."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return root


def _contracted(edges: DataFrame, count: int) -> DataFrame:
    """The same components with fewer edges: any part of the edges may be replaced by stars on its own least nodes."""
    schema = edges.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        ends = [t.column(c).combine_chunks() for c in ("u", "v")]
        if pa.types.is_struct(ends[0].type):
            names = [f.name for f in ends[0].type]
            fields = [np.concatenate([e.field(i).to_numpy(zero_copy_only=False) for e in ends]) for i in range(len(names))]
            keys = np.rec.fromarrays(fields, names=names)
        else:
            names, keys = [], np.concatenate([e.to_numpy(zero_copy_only=False) for e in ends])
        known, at = np.unique(keys, return_inverse=True)
        root = roots_of(at[: len(t)], at[len(t) :], len(known))
        node = np.flatnonzero(root != np.arange(len(known)))
        pick = lambda k: pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(known[n][k])) for n in names], fields=list(ends[0].type)) if names else pa.array(known[k])
        yield pa.RecordBatch.from_arrays([pick(node), pick(root[node])], names=["u", "v"])

    return edges.repartition(max(1, -(-count // PART_EDGES))).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(u, v)``; the component is its least node.

    Edges may repeat, loop and point either way; nulls are dropped.  Parts of
    the edges of bounded size are contracted first, each in a task (edges that fit
    one part are done then).  Each round is
    written to the shared folder, and only a count and a checksum come to the
    driver.
    """
    now = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = common.written(now, "edges")
    count = now.count()
    now = common.written(_contracted(now, count), "edges")
    seen = _sum(now)
    while seen[0] and count > PART_EDGES:  # a single part is whole once contracted
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = _with_least(large)
        # u and its smaller neighbours all hang on the least of them
        hung = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        now = common.written(small.select(hung).select("e.u", "e.v").where("u <> v").distinct(), "edges")
        last, seen = seen, _sum(now)
        if seen == last:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
