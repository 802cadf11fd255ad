"""An adjacency table: both directions of every edge, node by node, laid out so that a step reads what it needs.

A row is an edge seen from one of its ends; a node with more than ``SHARE``
edges is dealt into shares.  Rows are bucketed by node and share and sorted
inside, so building takes one shuffle of narrow rows.  A step from a large
frontier joins it to the buckets as they lie, so edges are not shuffled; only
the frontier is.  A step from a few nodes names them, and then no other bucket
is opened at all.  A node with most of the edges lies in many
buckets, so no task gets the whole of it.

The table is built once for a graph and found again by a signature of the files
it came from, in this session or a later one.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.sources import versions
from loomgraph.sources.tables import RELATIONS, edges, place, undirected, written

BUCKETS = 32
#: Bytes of the tables behind a bucket; a graph of more has more buckets than ``BUCKETS``.
BUCKET_BYTES = 4 << 20
#: Neighbours of a share, about.
SHARE = 4096
#: Nodes that a step names one by one.
FEW = 200
#: Nodes of several shares up to this number are broadcast.
FEW_HOT = 50_000


class Adjacency:
    """Neighbours by node; ``of_edges`` builds the table, ``of_tables`` does so once for a set of files."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        m = versions.latest(spark, path)
        self.buckets = m["buckets"]
        self.hot = spark.read.schema("node string, shares int").parquet(f"{path}/data/{m['hot']}")
        self.few_hot = m["hot_nodes"] <= FEW_HOT
        name = f"adjacency_{hashlib.sha256(path.encode()).hexdigest()[:20]}"
        if not spark.catalog.tableExists(name):
            # the files lie bucketed already; the session is told so
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (node STRING, share INT, other STRING, relation STRING, ahead BOOLEAN, quantity DOUBLE, price DOUBLE) USING parquet CLUSTERED BY (node, share) SORTED BY (node, share) INTO {self.buckets} BUCKETS LOCATION '{path}/data/{m['rows']}'")
        self.rows = spark.table(name)

    @classmethod
    def of_edges(cls, e: DataFrame, path: str, buckets: int = BUCKETS) -> Adjacency:
        spark = e.sparkSession
        name = uuid.uuid4().hex
        e = written(e.select("src", "dst", "relation", "quantity", "price").where("src IS NOT NULL AND dst IS NOT NULL"), "edges")
        ends = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node")))
        hot = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARE).select("node", F.ceil(F.col("n") / SHARE).cast("int").alias("shares"))
        hot.write.parquet(f"{path}/data/hot-{name}")
        hot = spark.read.schema("node string, shares int").parquet(f"{path}/data/hot-{name}")
        hot_nodes = hot.count()
        named = hot.select(F.col("node").alias("_n"), "shares")
        both = undirected(e).select("node", "other", "relation", (F.col("node") == F.col("src")).alias("ahead"), "quantity", "price")
        split = both.join(F.broadcast(named) if hot_nodes <= FEW_HOT else named, F.col("node") == F.col("_n"), "left")
        split = split.withColumn("share", F.coalesce(F.pmod(F.xxhash64("other"), F.col("shares")), F.lit(0)).cast("int"))
        rows = split.select("node", "share", "other", "relation", "ahead", "quantity", "price")
        table = f"adjacency_{name}"
        # the write needs a name; it is dropped and the files stay
        rows.repartition(buckets, "node", "share").write.bucketBy(buckets, "node", "share").sortBy("node", "share").option("path", f"{path}/data/rows-{name}").saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")
        versions.change(spark, path, lambda old: {"rows": f"rows-{name}", "hot": f"hot-{name}", "hot_nodes": hot_nodes, "buckets": buckets})
        return cls(spark, path)

    @classmethod
    def of_tables(cls, spark: SparkSession, d: str, relations: tuple[str, ...] = tuple(RELATIONS)) -> Adjacency:
        """The graph view of the tables in ``d``; what was built from the same files is used again."""
        e = edges(spark, d, relations)
        facts = []
        for f in sorted(e.inputFiles()):
            fs, p = versions.path_of(spark, f)
            s = fs.getFileStatus(p)
            facts.append([f, s.getLen(), s.getModificationTime()])
        signature = hashlib.sha256(json.dumps(["edges", facts, sorted(relations)]).encode()).hexdigest()[:24]
        path = f"{place(spark, 'x').rpartition('/')[0]}/adjacency-{signature}"
        return cls(spark, path) if versions.latest(spark, path) else cls.of_edges(e, path, max(BUCKETS, sum(f[1] for f in facts) // BUCKET_BYTES))

    # -- steps

    def neighbours(self, front: DataFrame, node: str, ahead: bool = False) -> DataFrame:
        """Rows of ``front`` with each neighbour of their ``node`` (``ahead``: by edges from it alone): other, relation, src, dst, quantity, price."""
        few = [r[0] for r in front.select(node).distinct().limit(FEW + 1).collect()]
        hot = self.hot.select(F.col("node").alias("_h"), "shares")
        rows = self.rows.where("ahead") if ahead else self.rows
        if len(few) <= FEW:
            rows = rows.where(F.col("node").isin([n for n in few if n is not None]))
            met = front.join(rows, F.col(node) == F.col("node"))
        else:
            wide = front.join(F.broadcast(hot) if self.few_hot else hot, F.col(node) == F.col("_h"), "left")
            wide = wide.withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("_h", "shares")
            met = wide.join(rows, (F.col(node) == F.col("node")) & (F.col("_share") == F.col("share")))
        src, dst = F.when(F.col("ahead"), F.col("node")).otherwise(F.col("other")), F.when(F.col("ahead"), F.col("other")).otherwise(F.col("node"))
        return met.select(*front.columns, "other", "relation", src.alias("src"), dst.alias("dst"), "quantity", "price")

    def hops(self, centers: DataFrame, depth: int, only: Column | None = None) -> DataFrame:
        """Least number of undirected hops, up to ``depth``, from each of ``centers(center)`` to the nodes it reaches; over the edges of which ``only`` holds."""
        front = written(centers.select("center", F.col("center").alias("id"), F.lit(0).alias("distance")), "hops")
        known = front
        for level in range(1, depth + 1):
            near = self.neighbours(front.select("center", "id"), "id")
            step = (near if only is None else near.where(only)).select("center", F.col("other").alias("id")).distinct()
            front = written(step.join(known.select("center", "id"), ["center", "id"], "left_anti").withColumn("distance", F.lit(level)), "hops")
            if front.isEmpty():
                break
            known = known.unionByName(front)
        return known

    def subgraph(self, centers: DataFrame, depth: int = 2, most: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes within ``depth`` hops (all, or the nearest ``most`` a center) and every directed edge among them."""
        near = written(G.nearest(self.hops(centers, depth), most), "subgraph")
        # an edge is seen from its source, and kept where its other end is one of the center's nodes too
        out = self.neighbours(near.select("center", "id"), "id", ahead=True).select("center", "src", "dst", "relation").distinct()
        ends = near.select("center", F.col("id").alias("dst"))
        if most is None:  # nodes without bound are not broadcast, however small their files
            ends = ends.hint("merge")
        return near, out.join(ends, ["center", "dst"]).select("center", "src", "dst", "relation")

    def shortest_path(self, pairs: DataFrame, most: int = 4) -> DataFrame:
        """Length of the shortest undirected path of up to ``most`` hops between ``pairs(a, b)``; null where there is none."""
        ends = pairs.select(F.col("a").alias("center")).union(pairs.select("b")).distinct()
        return G.meeting(pairs, self.hops(ends, (most + 1) // 2), most)

    def expand(self, seeds: DataFrame, per_seed: int = G.SEED_CAP) -> DataFrame:
        """One undirected hop from ``seeds(seed_id)`` to nodes that are no seeds, capped by relation and then by seed."""
        near = self.neighbours(seeds.select("seed_id"), "seed_id").where(F.col("relation").isin(*G.TIERS))
        return G.capped(near, seeds, per_seed)
