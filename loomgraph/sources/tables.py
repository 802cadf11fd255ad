"""Reading the tables, and their view as a property graph."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels in the order in which ties between them are settled.
LABELS = ["Region", "Nation", "Customer", "Supplier", "Part", "Order", "Document", "Page"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(spark: SparkSession, name: str) -> str:
    """A new folder's path in the folder that driver and executors share (a temporary one only where none is set and all runs on this machine)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='loomgraph-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/loomgraph/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: ``df`` written to the shared folder and read back."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}#"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str, labels: tuple[str, ...] = tuple(LABELS)) -> DataFrame:
    """id, label, name, text, url; only the wanted labels are scanned."""
    none = F.lit(None).cast("string")
    make = {
        "Region": ("region", "region", "r_regionkey", F.col("r_name"), none, none),
        "Nation": ("nation", "nation", "n_nationkey", F.col("n_name"), none, none),
        "Customer": ("customer", "customer", "c_custkey", F.col("c_name"), none, none),
        "Supplier": ("supplier", "supplier", "s_suppkey", F.col("s_name"), none, none),
        "Part": ("part", "part", "p_partkey", F.col("p_name"), F.concat_ws(" ", "p_brand", "p_type"), none),
        "Order": ("orders", "order", "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), none, none),
        "Document": ("documents", "doc", "doc_id", none, F.col("text"), none),
        "Page": ("pages", "page", "page_id", none, none, F.col("url")),
    }
    out = None
    for label in labels:
        source, kind, key, name, text, url = make[label]
        part = table(spark, sf_dir, source).select(_id(kind, key).alias("id"), F.lit(label).alias("label"), name.alias("name"), text.alias("text"), url.alias("url"))
        out = part if out is None else out.unionByName(part)
    return out


RELATIONS = ["IN_REGION", "IN_NATION", "PLACED_BY", "CONTAINS", "SUPPLIED_BY"]


def edges(spark: SparkSession, sf_dir: str, relations: tuple[str, ...] = tuple(RELATIONS)) -> DataFrame:
    """src, dst, relation and the props quantity and price (null but for CONTAINS)."""
    none = F.lit(None).cast("double")
    t = lambda name: table(spark, sf_dir, name)

    def edge(df: DataFrame, src: Column, dst: Column, relation: str, quantity: Column = none, price: Column = none) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), quantity.alias("quantity"), price.alias("price"))

    make = {
        "IN_REGION": lambda: edge(t("nation"), _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "IN_REGION"),
        "IN_NATION": lambda: edge(t("customer"), _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "IN_NATION").unionByName(
            edge(t("supplier"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "IN_NATION")
        ),
        "PLACED_BY": lambda: edge(t("orders"), _id("order", "o_orderkey"), _id("customer", "o_custkey"), "PLACED_BY"),
        "CONTAINS": lambda: edge(
            t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min_by(F.struct("l_quantity", "l_extendedprice"), F.struct("l_linenumber", "l_quantity", "l_extendedprice")).alias("p")),
            _id("order", "l_orderkey"), _id("part", "l_partkey"), "CONTAINS", F.col("p.l_quantity"), F.col("p.l_extendedprice"),
        ),
        "SUPPLIED_BY": lambda: edge(t("lineitem").select("l_partkey", "l_suppkey").distinct(), _id("part", "l_partkey"), _id("supplier", "l_suppkey"), "SUPPLIED_BY"),
    }
    out = None
    for r in relations:
        out = make[r]() if out is None else out.unionByName(make[r]())
    return out


def edge_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src and dst of ``edges``, a line's edges as often as it has lines: for what asks only who is beside whom, so nothing is grouped."""
    out = None
    for name, kind, key, to, other in (
        ("nation", "nation", "n_nationkey", "region", "n_regionkey"), ("customer", "customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"),
        ("orders", "order", "o_orderkey", "customer", "o_custkey"), ("lineitem", "order", "l_orderkey", "part", "l_partkey"), ("lineitem", "part", "l_partkey", "supplier", "l_suppkey"),
    ):
        part = table(spark, sf_dir, name).select(_id(kind, key).alias("src"), _id(to, other).alias("dst"))
        out = part if out is None else out.unionByName(part)
    return out


def undirected(e: DataFrame) -> DataFrame:
    """Each edge seen from both ends: ``node``, ``other``, and the edge."""
    ahead = e.withColumns({"node": F.col("src"), "other": F.col("dst")})
    return ahead.unionByName(e.withColumns({"node": F.col("dst"), "other": F.col("src")}))


NODES_SQL = """
nodes AS (
  SELECT 'region#' || r_regionkey AS id, 'Region' AS label, r_name AS name, NULL::VARCHAR AS text, NULL::VARCHAR AS url FROM region
  UNION ALL SELECT 'nation#' || n_nationkey, 'Nation', n_name, NULL, NULL FROM nation
  UNION ALL SELECT 'customer#' || c_custkey, 'Customer', c_name, NULL, NULL FROM customer
  UNION ALL SELECT 'supplier#' || s_suppkey, 'Supplier', s_name, NULL, NULL FROM supplier
  UNION ALL SELECT 'part#' || p_partkey, 'Part', p_name, concat_ws(' ', p_brand, p_type), NULL FROM part
  UNION ALL SELECT 'order#' || o_orderkey, 'Order', 'Order ' || o_orderkey, NULL, NULL FROM orders
  UNION ALL SELECT 'doc#' || doc_id, 'Document', NULL, text, NULL FROM documents
  UNION ALL SELECT 'page#' || page_id, 'Page', NULL, NULL, url FROM pages)"""
EDGES_SQL = """
first_lines AS (
  SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_quantity, l_extendedprice) = 1),
edges AS (
  SELECT 'nation#' || n_nationkey AS src, 'region#' || n_regionkey AS dst, 'IN_REGION' AS relation, NULL::DOUBLE AS quantity, NULL::DOUBLE AS price FROM nation
  UNION ALL SELECT 'customer#' || c_custkey, 'nation#' || c_nationkey, 'IN_NATION', NULL, NULL FROM customer
  UNION ALL SELECT 'supplier#' || s_suppkey, 'nation#' || s_nationkey, 'IN_NATION', NULL, NULL FROM supplier
  UNION ALL SELECT 'order#' || o_orderkey, 'customer#' || o_custkey, 'PLACED_BY', NULL, NULL FROM orders
  UNION ALL SELECT 'order#' || l_orderkey, 'part#' || l_partkey, 'CONTAINS', l_quantity, l_extendedprice FROM first_lines
  UNION ALL SELECT DISTINCT 'part#' || l_partkey, 'supplier#' || l_suppkey, 'SUPPLIED_BY', NULL::DOUBLE, NULL::DOUBLE FROM lineitem)"""
BOTH_SQL = """
both_ways AS (
  SELECT *, src AS node, dst AS other FROM edges UNION ALL SELECT *, dst, src FROM edges)"""
