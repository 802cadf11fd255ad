"""The vector index and the full-text index against searches that compare everything."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import retrieve as R
from loomgraph.operators import text_index, vector_index
from loomgraph.operators.text_index import TextIndex
from loomgraph.operators.vector_index import VectorIndex
from loomgraph.sources import versions

DOCS = "id long, text string"


def _text(rng, n):
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(n))


def _same(got, docs, queries, k):
    want = R.bm25(docs, "id", F.col("text"), queries, k).collect()
    key = lambda r: (r.query_id, r.id, round(r.score, 6), r["rank"])
    assert sorted(map(key, got.collect())) == sorted(map(key, want)) and want


def test_text_index_through_updates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 4)
    monkeypatch.setattr(text_index, "SHARD", 40)
    rng = random.Random(8)
    queries = spark.createDataFrame([(1, "w1 w2 w30"), (2, "W40 w3 w3"), (3, "absent"), (4, ""), (5, None), (6, "w25 w26 w27 w28")], "query_id long, text string")
    held = {i: _text(rng, rng.randint(1, 40)) for i in range(100)}
    index = TextIndex.create(spark, f"{tmp_path}/i", buckets=3)
    assert index.search(queries, 5).collect() == []
    docs = lambda: spark.createDataFrame(sorted(held.items()), DOCS)
    index.update(docs())
    _same(index.search(queries, 5), docs(), queries, 5)
    # new ones, changed ones, an id twice in one call, a null id
    fresh = {i: _text(rng, rng.randint(1, 30)) for i in [3, 7, 55, *range(100, 130)]}
    index.update(spark.createDataFrame([*fresh.items(), (3, ""), (None, "w1 w1")], DOCS))
    held |= fresh
    _same(index.search(queries, 5), docs(), queries, 5)
    gone = [0, 7, 110, 999]
    index.remove(spark.createDataFrame([(i,) for i in gone], "id long"))
    held = {i: t for i, t in held.items() if i not in gone}
    _same(index.search(queries, 5), docs(), queries, 5)
    number = versions.latest(spark, index.path)["version"]
    index.remove(spark.createDataFrame([(999,)], "id long"))
    assert versions.latest(spark, index.path)["version"] == number
    # what is gone can come back, and an update equals a rebuild
    index.update(spark.createDataFrame([(7, "w30 w30 w2")], DOCS))
    held[7] = "w30 w30 w2"
    rebuilt = TextIndex.create(spark, f"{tmp_path}/r", buckets=3)
    rebuilt.update(docs())
    same = lambda i: sorted(tuple(r) for r in i.search(queries, 9).collect())
    assert same(index) == same(rebuilt)
    index.compact()
    m = versions.latest(spark, index.path)
    assert len(m["segments"]) == 1 and (m["docs"], m["words"]) == (len(held), sum(len(t.split()) for t in held.values()))
    assert same(index) == same(rebuilt)
    _same(index.search(queries, 9), docs(), queries, 9)


def test_text_index_leaves_out_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 8)
    docs = spark.createDataFrame([(i, "rare common" if i < 5 else "common " + "other " * (i % 50)) for i in range(2000)], DOCS)
    queries = spark.createDataFrame([(1, "common"), (2, "rare common")], "query_id long, text string")
    index = TextIndex.create(spark, f"{tmp_path}/i", buckets=2)
    index.update(docs)
    _same(index.search(queries, 5), docs, queries, 5)
    r = {x.query_id: (x.postings, x.scored) for x in index.scanned(queries, 5).collect()}
    assert r[1][0] == 2000 and r[1][1] < 100 and r[2][0] == 2005 >= r[2][1]
    plan = index.search(queries, 5)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan


def _shuffled(spark, work):
    """Rows that the stages of ``work`` shuffle."""
    gw, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    none = gw.jvm.java.util.ArrayList
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for x in [store.stageList(none(), False, False, gw.new_array(gw.jvm.double, 0), none())] for s in map(x.apply, range(x.size()))}
    before = stages()
    work()
    return sum(n for k, n in stages().items() if k not in before)


def test_text_index_deals_texts_and_postings_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 8)
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "common " + " ".join(rng.sample([f"w{j}" for j in range(80)], 40))) for i in range(1000)], DOCS)
    queries = spark.createDataFrame([(i, "common") for i in range(50)], "query_id long, text string")
    index = TextIndex.create(spark, f"{tmp_path}/i", buckets=2)
    # 41,000 postings in lists, not a row each; 1,000 postings for 50 queries, not 50,000 pairs
    assert _shuffled(spark, lambda: index.update(docs)) < 10_000
    assert _shuffled(spark, lambda: index.search(queries, 20).collect()) < 15_000
    _same(index.search(queries, 20), docs, queries, 20)


def _clustered(rng, n, d=16, centers=12):
    c = rng.normal(size=(centers, d))
    x = c[rng.integers(centers, size=n)] + 0.15 * rng.normal(size=(n, d))
    return [(i, int(rng.integers(3)), v.astype(np.float32).tolist()) for i, v in enumerate(x)]


VECTORS = "id long, label long, embedding array<float>"


def _key(r):
    return r.query_id, r.label, r.id, round(r.score, 9), r["rank"]


@pytest.mark.parametrize("probes", [1, 3])
def test_vector_index_is_exact_and_prunes(spark, tmp_path, probes):
    rng = np.random.default_rng(5)
    rows = _clustered(rng, 1500)
    vectors = spark.createDataFrame(rows, VECTORS)
    queries = vectors.where("id % 60 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    index = VectorIndex.build(vectors.where("id % 4 <> 0"), f"{tmp_path}/v", cells=12)
    index.insert(vectors.where("id % 4 = 0"))
    want = sorted(_key(r) for r in R.knn_per_label(vectors.withColumnRenamed("id", "vec_id"), queries, 10).collect())
    assert sorted(_key(r) for r in index.search(queries, 10, probes, exact=True).collect()) == want
    near = {_key(r)[:3] for r in index.search(queries, 10, probes=3).collect()}
    assert len(near & {w[:3] for w in want}) >= 0.95 * len(want)
    seen = index.scanned(queries, 10, probes, exact=True)
    assert seen["vectors"] == 1500 and seen["compared"] < 0.5 * 25 * 1500
    one = queries.limit(1)
    files = index._rows(index._manifest(), [r.cell for r in index._search(one, 10, 1, False)[1].collect()]).inputFiles()
    assert {f.split("/cell=")[1].split("/")[0] for f in files} == {str(r.cell) for r in index._search(one, 10, 1, False)[1].collect()}


def test_recall_on_the_embeddings(spark, tmp_path):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", "embedding")
    queries = vectors.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    index = VectorIndex.build(vectors, f"{tmp_path}/v", cells=16)
    want = {_key(r)[:3] for r in index.search(queries, 5, exact=True).collect()}
    found = {_key(r)[:3] for r in index.search(queries, 5, probes=14).collect()}
    assert want == {_key(r)[:3] for r in R.knn_per_label(vectors.withColumnRenamed("id", "vec_id"), queries, 5).collect()}
    assert len(found & want) >= 0.95 * len(want)


def test_vector_index_replaces_and_leaves_out(spark, tmp_path):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0]), (3, None, [1.0, 1.0]), (4, 0, None), (5, 0, [0.0, 0.0]), (6, 0, [float("nan"), 1.0]), (7, 0, [1.0]), (None, 0, [1.0, 2.0])]
    index = VectorIndex.build(spark.createDataFrame(rows, VECTORS), f"{tmp_path}/v", cells=5)
    queries = spark.createDataFrame([(9, [1.0, 0.1]), (10, None), (11, [1.0])], "query_id long, query array<float>")
    best = lambda exact: [(r.label, r.id) for r in index.search(queries, 1, 1, exact).orderBy(F.col("label").asc_nulls_last()).collect()]
    assert best(True) == [(0, 1), (None, 3)] and versions.latest(spark, index.path)["left_out"] == 5
    index.insert(spark.createDataFrame([(1, 0, [-1.0, 0.0]), (8, 2, [1.0, 0.0])], VECTORS))
    assert best(True) == [(0, 2), (2, 8), (None, 3)]
    index.insert(spark.createDataFrame([], VECTORS))
    assert best(True) == [(0, 2), (2, 8), (None, 3)]
    empty = VectorIndex.build(spark.createDataFrame([], VECTORS), f"{tmp_path}/e", cells=5)
    assert empty.search(queries, 3, exact=True).collect() == []


def test_vector_index_keeps_k_a_task(spark, tmp_path, monkeypatch):
    """Neither way to search shuffles or sorts the pairs; both equal a search of everything."""
    rng = np.random.default_rng(7)
    vectors = spark.createDataFrame([(i, [0, 1, None][i % 3], rng.normal(size=8).astype(np.float32).tolist()) for i in range(3000)] + [(9000 + i, 1, [1.0] * 8) for i in range(40)], VECTORS)
    queries = vectors.where("id % 30 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    index = VectorIndex.build(vectors.where("id % 7 <> 0"), f"{tmp_path}/v", cells=6)
    index.insert(vectors.where("id % 5 = 0 OR id % 7 = 0"))
    want = sorted((_key(r) for r in R.knn_per_label(vectors.withColumnRenamed("id", "vec_id"), queries, 4).collect()), key=repr)
    seen, old = [], VectorIndex._ranked
    monkeypatch.setattr(VectorIndex, "_ranked", lambda self, hits, k: seen.append(hits.count()) or old(self, hits, k))
    for few, held in ((10_000, 100), (10, 100), (10, 100_000)):
        monkeypatch.setattr(vector_index, "FEW", few)
        monkeypatch.setattr(vector_index, "HELD", held)
        seen.clear()
        assert sorted((_key(r) for r in index.search(queries, 4, 2, exact=True).collect()), key=repr) == want
        if held > 100 or few > 10:  # of 310,000 pairs 4 a query, label and task
            assert max(seen) <= 102 * 3 * 4 * 8
