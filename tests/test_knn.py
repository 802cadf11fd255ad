"""Search per label by products in tasks against every pair scored in the JVM."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import retrieve as R

VECTORS = "vec_id long, label long, embedding array<float>"


def _vectors(spark, odd=True):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 1, 2, None]), [rng.uniform(-1, 1) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, 1, [0.5, 0.25, 1.0, 0.0, 0.0, 0.0, 0.0, 2.0]) for i in range(300)]  # copies: ties by id
    if odd:
        rows += [(2000, 3, None), (2001, 3, [1.0, None] + [0.5] * 6), (2002, 3, [1.0, 2.0]), (2003, 3, [float("nan")] * 8), (2004, 7, [1.0] * 8)]
    return spark.createDataFrame(rows, VECTORS).repartition(5)


def _rows(df):
    return sorted(((r["query_id"], r["label"], r["rank"], r["id"], repr(r["score"])) for r in df.collect()), key=repr)


def test_equal_to_every_pair_scored(spark, monkeypatch):
    for block, held in ((R.BLOCK, R.HELD), (64, 50)):
        monkeypatch.setattr(R, "BLOCK", block)
        monkeypatch.setattr(R, "HELD", held)
        v = _vectors(spark)
        q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
        assert _rows(R.knn_per_label(v, q, 6)) == _rows(R._ranked(R._scored(v, q), 6))


def test_what_is_shuffled_does_not_grow_with_the_pairs(spark):
    v = spark.range(0, 20_000, 1, 2).select(F.col("id").alias("vec_id"), F.lit(1).cast("long").alias("label"), F.array(*[F.rand(i) for i in range(8)]).alias("embedding"))
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    scored = []
    old = R._ranked
    try:
        R._ranked = lambda df, k: scored.append(df.count()) or old(df, k)
        assert R.knn_per_label(v, q, 3).count() == 200 * 3
    finally:
        R._ranked = old
    assert scored[0] <= 200 * 3 * 2  # k a query and task, of 4,000,000 pairs
