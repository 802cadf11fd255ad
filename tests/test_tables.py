"""The SQL table functions on awkward rows."""

from __future__ import annotations

import pytest

from loomgraph.functions import tables as T


def test_option_walk(spark):
    T.register(spark)
    rows = [("u", 3, "  b"), ("u", 1, "Takes one of:"), ("u", 2, "  a"), ("u", 4, None), ("u", 5, " "), ("u", 6, "alone"), ("u", 7, "  below nothing"), ("v", 1, "  x"), (None, 1, "y"), ("v", 2, "be mounted on:"), ("v", 3, "\tmule"), ("v", 4, "again:"), ("v", 5, " z")]
    spark.createDataFrame(rows, "unit string, n long, line string").createOrReplaceTempView("walk_lines")
    out = sorted(((r.unit or "", r.place, r.line, r.group_id, r.mounts) for r in spark.sql("SELECT * FROM option_walk(TABLE(walk_lines))").collect()))
    assert out == [
        ("", 0, "y", None, False), ("u", 0, "a", 1, False), ("u", 1, "b", 1, False), ("u", 2, "alone", None, False), ("u", 3, "below nothing", None, False),
        ("v", 0, "x", None, False), ("v", 1, "mule", 1, True), ("v", 2, "z", 2, False),
    ]
    with pytest.raises(Exception, match="unit, n and line"):
        spark.sql("SELECT * FROM option_walk(TABLE(SELECT 1 AS unit))").collect()


@pytest.mark.parametrize("name", ["node_counts", "edge_counts", "orphans", "ratio", "dangling_references", "armies_without_edge", "unreachable", "coverage", "intrinsic", "dangling_types"])
def test_each_check_can_stop_a_load(spark, name):
    from loomgraph.operators import quality as Q

    rows = [(c, 0, False) for c in ("node_counts", "coverage") if c != name]
    shape = "check string, n long, failed boolean"
    assert Q.raise_if_failed(spark.createDataFrame(rows, shape)).count() == len(rows)
    with pytest.raises(ValueError, match=f"checks failed: {name}$"):
        Q.raise_if_failed(spark.createDataFrame([*rows, (name, 3, True)], shape))


def test_a_load_counts_while_it_writes(spark, tmp_path):
    from loomgraph.operators import quality as Q

    ids = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    raw = spark.createDataFrame([("a", "b", "R"), ("a", "x", "R"), ("y", "b", "R"), ("a", "a", "S"), (None, "a", "S")], "src string, dst string, relation string")
    seen = Q.observed_load(raw, ids, f"{tmp_path}/e", ["R", "S", "T"], ["b"])
    assert seen == {"R": {"raw": 3, "loaded": 1, "orphans": 2, "intrinsic": 1}, "S": {"raw": 2, "loaded": 1, "orphans": 1, "intrinsic": 0}, "T": {"raw": 0, "loaded": 0, "orphans": 0, "intrinsic": 0}}
    assert spark.read.parquet(f"{tmp_path}/e").count() == 2
