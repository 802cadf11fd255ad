"""An inverted-file index over vectors: cells round centroids, a probe of the nearest, an exact rerank.

Centroids are fitted on a bounded sample; every vector lies in the cell of its
nearest one, and a cell is a folder, so a probe reads the folders of its cells
alone.  Beside the centroids stand, for each batch, cell and label, how many
vectors there are and how far the farthest lies from the centroid.

A search probes the cells nearest to each query and ranks what they hold by the
exact cosine.  With ``exact`` it then goes on: the k-th best distance of a query
and label so far rules out every cell whose centroid is farther than that by more
than its radius, and the cells that are left are read too, so the result is that of
comparing everything.  Distances are between vectors of unit length, in which
order by distance is order by cosine.  A task keeps the ``k`` best of a query and
label of the pairs that it compares, so neither its memory nor what is shuffled
grows with the pairs.

Batches are published as numbered versions.  An insert goes into the folders of
its cells under its own batch; an id that is there already is replaced, the
newest vector counting.  Vectors that are null, zero or not finite, or of another
size than most of the sample, are not indexed; the manifest counts them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators import retrieve as R
from loomgraph.sources import versions

#: Vectors that the centroids are fitted on at most, the least by hash of their id.
SAMPLE = 100_000
PROBES = 4
#: Queries up to this number meet the cells by a broadcast.
FEW = 10_000
#: Pairs that a task holds before it keeps the best of them, where there are more queries.
HELD = 2_000_000
SLACK = 1e-7
_ROW = "id bigint, label bigint, embedding array<float>, batch int, cell int"


def _usable(rows: DataFrame, column: str) -> DataFrame:
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(column).isNotNull() & ~bad & (R.dot(F.col(column), F.col(column)) > 0))


class VectorIndex:
    """The index below ``path`` over vectors (id long, label long, embedding array of float)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int, sample: int = SAMPLE, seed: int = 1) -> VectorIndex:
        """Fit the centroids and index all ``vectors``."""
        out = cls(vectors.sparkSession, path)
        drawn = R.written(R.with_norm(_usable(vectors, "embedding")).orderBy(F.xxhash64("id"), "id").limit(sample).select(F.transform("embedding", lambda x: x.cast("double") / F.col("_norm")).alias("unit")), "sample")
        common = drawn.groupBy(F.size("unit").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
        fit = drawn.where(F.size("unit") == (common["d"] if common else 0)).select(array_to_vector("unit").alias("features"))
        n = min(cells, fit.count())
        centers = [list(map(float, c)) for c in KMeans(k=n, seed=seed, maxIter=10, initMode="random").fit(fit).clusterCenters()] if n > 1 else [list(map(float, r["features"])) for r in fit.collect()]
        fresh = {"centers": centers, "size": len(centers[0]) if centers else 0, "batches": [], "replaced": False, "left_out": 0}
        versions.change(out.spark, out.path, lambda old: fresh)
        out.insert(vectors)
        return out

    def _manifest(self) -> dict[str, Any]:
        m = versions.latest(self.spark, self.path)
        if m is None:
            raise ValueError(f"no index at {self.path}")
        return m

    def _at(self, kind: str, batch: dict[str, Any]) -> str:
        return f"{self.path}/data/{kind}/of={batch['name']}"

    def _rows(self, m: dict[str, Any], cells: list[int]) -> DataFrame:
        """Vectors of some cells; no folder of another cell is opened."""
        paths = [f"{self._at('cells', b)}/cell={c}" for b in m["batches"] for c in cells if c in b["cells"]]
        if not paths:
            return self.spark.createDataFrame([], _ROW)
        rows = self.spark.read.schema(f"{_ROW}, of string").option("basePath", f"{self.path}/data/cells").parquet(*paths).drop("of")
        if not m["replaced"]:
            return rows
        last = self._stats(m, "ids", "id bigint, batch int").groupBy(F.col("id").alias("_id")).agg(F.max("batch").alias("_last"), F.min("batch").alias("_first")).where("_first < _last")
        return rows.join(last, (F.col("id") == F.col("_id")) & (F.col("batch") < F.col("_last")), "left_anti")

    def _stats(self, m: dict[str, Any], kind: str, schema: str) -> DataFrame:
        paths = [self._at(kind, b) for b in m["batches"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def insert(self, vectors: DataFrame) -> dict[str, Any]:
        """Add vectors; of equal ids in one call the greatest row counts, and an id of an earlier batch is replaced."""
        rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<float>").alias("embedding"))

        def work(m: dict[str, Any] | None) -> dict[str, Any] | None:
            if m is None:
                raise ValueError(f"no index at {self.path}")
            number = len(m["batches"]) + 1
            batch: dict[str, Any] = {"name": uuid.uuid4().hex, "number": number}
            good = _usable(rows, "embedding").where(F.col("id").isNotNull() & (F.size("embedding") == m["size"]))
            good = good.groupBy("id").agg(F.max(F.struct("label", "embedding")).alias("r")).select("id", "r.label", "r.embedding")
            placed = R.written(self._placed(good, np.array(m["centers"], np.float64).reshape(len(m["centers"]), m["size"]), number), "placed")
            placed.drop("away").repartition("cell").sortWithinPartitions("cell", "label", "id").write.partitionBy("cell").parquet(self._at("cells", batch))
            placed.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).coalesce(1).write.parquet(self._at("stats", batch))
            placed.select("id", "batch").write.parquet(self._at("ids", batch))
            batch["cells"] = sorted(r[0] for r in placed.select("cell").distinct().collect())
            if not batch["cells"]:
                return None
            known = self._stats(m, "ids", "id bigint, batch int")
            again = bool(m["batches"]) and not placed.select("id").join(known, "id", "left_semi").isEmpty()
            return m | {"batches": [*m["batches"], batch], "replaced": m["replaced"] or again, "left_out": m["left_out"] + rows.count() - placed.count()}

        return versions.change(self.spark, self.path, work)

    def _placed(self, rows: DataFrame, centers: np.ndarray, batch: int) -> DataFrame:
        """Rows with their cell and their distance from its centroid."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                x = b.column("embedding").flatten().to_numpy().astype(np.float64).reshape(len(b), -1)
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                far = (x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)
                cell = far.argmin(axis=1)
                away = np.sqrt(((x - centers[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), batch), pa.int32()), pa.array(cell, pa.int32()), pa.array(away)], names=[*b.schema.names, "batch", "cell", "away"])

        return rows.mapInArrow(run, f"{_ROW}, away double")

    def _distances(self, queries: DataFrame, m: dict[str, Any]) -> DataFrame:
        """query_id, query and, cell by cell, the distance of its centroid."""
        centers = np.array(m["centers"], np.float64).reshape(len(m["centers"]), m["size"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                x = b.column("query").flatten().to_numpy().astype(np.float64).reshape(len(b), -1)
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                far = np.sqrt(((x[:, None, :] - centers) ** 2).sum(axis=2)) if len(b) * centers.size < 20_000_000 else np.stack([np.sqrt(((centers - q) ** 2).sum(axis=1)) for q in x])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, far.size + 1, far.shape[1]), pa.int32()), pa.array(far.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("query"), flat], names=["query_id", "query", "far"])

        good = _usable(queries.select("query_id", F.col("query").cast("array<float>").alias("query")), "query").where(F.size("query") == m["size"])
        return good.mapInArrow(run, f"query_id {dict(queries.dtypes)['query_id']}, query array<float>, far array<double>")

    def search(self, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = False) -> DataFrame:
        """query_id, label, id, score (cosine scaled to 0..1) and rank of the best ``k`` of each label; for each of ``queries(query_id, query)``."""
        return self._search(queries, k, probes, exact)[0]

    def scanned(self, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = False) -> dict[str, int]:
        """Vectors in the index, cells probed and vectors compared, over all queries."""
        m = self._manifest()
        _, probed = self._search(queries, k, probes, exact)
        per = self._stats(m, "stats", "cell int, label bigint, n bigint, radius double").groupBy("cell").agg(F.sum("n").alias("n"))
        r = probed.join(per, "cell").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"), F.countDistinct("cell").alias("read")).first()
        return {"vectors": per.agg(F.sum("n")).first()[0] or 0, "probes": r["cells"], "compared": r["n"] or 0, "cells_read": r["read"]}

    def _search(self, queries: DataFrame, k: int, probes: int, exact: bool) -> tuple[DataFrame, DataFrame]:
        m = self._manifest()
        near = R.written(self._distances(queries, m), "query-distances")
        few = near.limit(FEW + 1).count() <= FEW
        every = near.select("query_id", F.posexplode("far").alias("cell", "distance"))
        first = F.transform(F.slice(F.array_sort(F.transform("far", lambda d, i: F.struct(d.alias("d"), i.alias("i")))), 1, probes), lambda x: x["i"])
        probed = near.select("query_id", F.explode(first).alias("cell"))
        hits = self._compared(m, near, probed, k, few)
        if not exact:
            return self._ranked(hits, k), probed
        hits = R.written(hits, "probe-hits")
        # a label of which fewer than k were found so far rules out no cell
        reach = hits.where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("label").alias("_l"), F.sqrt(F.greatest(2 - 2 * (2 * F.col("score") - 1), F.lit(0.0))).alias("reach"))
        stats = self._stats(m, "stats", "cell int, label bigint, n bigint, radius double").groupBy("cell", "label").agg(F.max("radius").alias("radius"))
        maybe = every.join(stats, "cell").join(reach, (F.col("query_id") == F.col("_q")) & F.col("label").eqNullSafe(F.col("_l")), "left")
        maybe = maybe.where(F.col("reach").isNull() | (F.col("distance") - F.col("radius") <= F.col("reach") + SLACK)).select("query_id", "cell").distinct()
        left = R.written(maybe.join(probed, ["query_id", "cell"], "left_anti"), "probes")
        more = self._compared(m, near, left, k, few)
        return self._ranked(hits.unionByName(more), k), probed.unionByName(left)

    def _compared(self, m: dict[str, Any], near: DataFrame, probed: DataFrame, k: int, few: bool) -> DataFrame:
        cells = [r[0] for r in probed.select("cell").distinct().collect()]  # at most as many as there are centroids
        asked = near.where("query_id IS NOT NULL").select("query_id", "query").collect() if few else []
        if asked and cells:
            context = self.spark.sparkContext
            names = self.spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(asked)], T.StructType([T.StructField("place", T.IntegerType()), near.schema["query_id"]]))
            probing = {r["cell"]: np.unique(r["places"]) for r in probed.join(F.broadcast(names), "query_id").groupBy("cell").agg(F.collect_list("place").alias("places")).collect()}
            rows = self._rows(m, cells).select(F.col("id").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"), "cell")
            found = rows.mapInArrow(R._nearest(context.broadcast(np.array([r["query"] for r in asked], np.float64)), k, context.broadcast(probing)), "place int, label long, id long, score double")
            return self._ranked(found.join(F.broadcast(names), "place"), k)
        q = near.select("query_id", "query").join(probed, "query_id").withColumn("_qn", F.sqrt(R.dot(F.col("query"), F.col("query"))))
        rows = R.with_norm(self._rows(m, cells))
        met = rows.join(q, "cell")
        cosine = R.dot(F.col("embedding"), F.col("query")) / (F.col("_norm") * F.col("_qn"))
        scored = met.select("query_id", "label", "id", ((1 + cosine) / 2).alias("score"))
        return self._ranked(scored.mapInArrow(_best(k, HELD), scored.schema), k)

    def _ranked(self, hits: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("query_id", "label").orderBy(F.col("score").desc(), "id")
        return hits.select("query_id", "label", "id", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(k: int, most: int):
    """Batches of query_id, label, id and score to the best ``k`` of a query and label among some ``most`` pairs."""

    def kept(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        num = lambda c: c.combine_chunks().to_numpy(zero_copy_only=False)
        codes = [pc.dictionary_encode(t.column(c).combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("query_id", "label")]
        group = codes[0] * (codes[1].max(initial=0) + 1) + codes[1]
        order = np.lexsort((num(t.column("id")), -num(t.column("score")), group))
        group = group[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
        return t.take(pa.array(order[place < k])).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            size += len(b)
            if size >= most:
                held = [kept(held)]
                size = len(held[0])
                if 2 * size > most:
                    yield held[0]
                    held, size = [], 0
        if held:
            yield kept(held)

    return run
