"""The adjacency table against traversals that plan the edges anew."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import adjacency
from loomgraph.operators import graph as G
from loomgraph.operators.adjacency import Adjacency
from loomgraph.plans import catalog

EDGES = "src string, dst string, relation string, quantity double, price double"


def _graph(spark, n=300, hub=120):
    rng = random.Random(2)
    rows = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice(["CONTAINS", "PLACED_BY", "OTHER"])) for _ in range(n)}
    rows |= {("hub", f"n{k}", "IN_NATION") for k in range(hub)} | {("loop", "loop", "CONTAINS"), ("loop", "n1", "CONTAINS")}
    return spark.createDataFrame([(*r, 1.0, None) for r in sorted(rows)] + [(None, "n1", "CONTAINS", 1.0, None)], EDGES)


@pytest.mark.parametrize("share, few", [(4096, 200), (10, 0), (10, 200)])
def test_steps_against_planned_edges(spark, tmp_path, monkeypatch, share, few):
    monkeypatch.setattr(adjacency, "SHARE", share)
    monkeypatch.setattr(adjacency, "FEW", few)
    e = _graph(spark)
    a = Adjacency.of_edges(e, f"{tmp_path}/a", buckets=3)
    assert (a.hot.count() > 0) == (share == 10)
    centers = spark.createDataFrame([("hub",), ("n1",), ("loop",), ("missing",)], "center string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    whole = e.where("src IS NOT NULL")
    assert rows(a.hops(centers, 3)) == rows(G.hops(whole, centers, 3))
    for mine, other in zip(a.subgraph(centers), G.subgraph(whole, centers)):
        assert rows(mine) == rows(other)
    pairs = spark.createDataFrame([("hub", "loop"), ("n1", "n2"), ("n1", "n1"), ("missing", "n1"), ("n5", "n250")], "a string, b string")
    assert rows(a.shortest_path(pairs)) == rows(G.shortest_path(whole, pairs))
    seeds = spark.createDataFrame([("hub",), ("n3",), ("n1",)], "seed_id string")
    assert rows(a.expand(seeds)) == rows(G.expand(whole, seeds))


def test_a_step_does_not_shuffle_edges(spark, tmp_path, monkeypatch):
    a = Adjacency.of_edges(_graph(spark), f"{tmp_path}/a", buckets=4)
    front = spark.createDataFrame([(f"n{k}",) for k in range(250)], "id string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with a frontier too large to broadcast
    try:
        monkeypatch.setattr(adjacency, "FEW", 0)
        plan = a.neighbours(front, "id")._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "SortMergeJoin" in plan
        shuffled = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
        assert shuffled == ["id"]  # the frontier, and not the edges
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    monkeypatch.setattr(adjacency, "FEW", 200)
    few = a.neighbours(spark.createDataFrame([("n1",)], "id string"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "In(node" in few or "EqualTo(node" in few


def test_a_subgraph_has_all_nodes_unless_a_number_is_asked_for(spark, tmp_path):
    rows = [("hub", f"n{k}", "CONTAINS") for k in range(400)] + [(f"n{k}", f"m{k}", "OTHER") for k in range(400)]
    e = spark.createDataFrame([(*r, 1.0, None) for r in rows], EDGES)
    a = Adjacency.of_edges(e, f"{tmp_path}/a", buckets=3)
    center = spark.createDataFrame([("hub",)], "center string")
    for near, among in (a.subgraph(center), G.subgraph(e, center)):
        assert near.count() == 801 and sorted(tuple(r)[1:] for r in among.collect()) == sorted(rows)
    for near, among in (a.subgraph(center, most=150), G.subgraph(e, center, most=150)):
        assert near.count() == 150 and among.count() == 149


def test_edges_among_many_nodes_are_not_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(adjacency, "FEW", 0)
    a = Adjacency.of_edges(_graph(spark), f"{tmp_path}/a", buckets=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = a.subgraph(spark.createDataFrame([("hub",)], "center string"))[1]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Bucketed: true" in plan and not re.search(r"Exchange hashpartitioning\(node#", plan)


def test_the_query_has_every_edge_within_two_hops(spark):
    d, rows = "/root/testdata/sf0.01", {}  # a region with 302 customers
    got = catalog.queries()["subgraph_depth2"](spark, d).where("center = 'region#1'").collect()
    nations = {r[0] for r in spark.read.parquet(f"{d}/nation.parquet").where("n_regionkey = 1").select("n_nationkey").collect()}
    for kind, key, of in (("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey")):
        rows |= {f"{kind}#{r[0]}": f"nation#{r[1]}" for r in spark.read.parquet(f"{d}/{kind}.parquet").select(key, of).collect() if r[1] in nations}
    assert {(r["src"], r["dst"]) for r in got} == set(rows.items()) | {(f"nation#{n}", "region#1") for n in nations}


def test_a_graph_is_built_once(spark, tmp_path, monkeypatch):
    d = "/root/testdata/sf0.001"
    first = Adjacency.of_tables(spark, d)
    monkeypatch.setattr(Adjacency, "of_edges", None)  # would fail
    assert Adjacency.of_tables(spark, d).path == first.path
    assert first.neighbours(spark.createDataFrame([("nation#1",)], "id string"), "id").where(F.col("relation") == "IN_REGION").count() == 1


def test_a_build_shuffles_narrow_rows_once(spark, tmp_path, monkeypatch):
    e = spark.range(20_000).select(F.concat(F.lit("n"), F.col("id") % 100).alias("src"), F.concat(F.lit("m"), "id").alias("dst"), F.lit("CONTAINS").alias("relation"), F.lit(1.0).alias("quantity"), F.lit(None).cast("double").alias("price"))
    store = spark.sparkContext._jsc.sc().statusStore()
    wrote = lambda: store.executorList(False).apply(0).totalShuffleWrite()
    before = wrote()
    a = Adjacency.of_edges(e, f"{tmp_path}/a", buckets=4)
    assert a.rows.count() == 40_000 and set(a.rows.columns) == {"node", "share", "other", "relation", "ahead", "quantity", "price"}
    assert wrote() - before < 40_000 * 60  # nodes counted and rows dealt once; neither lists nor both ends again


def test_more_tables_make_more_buckets(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(adjacency, "BUCKET_BYTES", 4096)
    monkeypatch.setattr(Adjacency, "of_edges", lambda e, path, buckets: made.append(buckets))
    monkeypatch.setattr(adjacency.versions, "latest", lambda *_: None)
    Adjacency.of_tables(spark, "/root/testdata/sf0.001")
    assert made[0] > adjacency.BUCKETS
