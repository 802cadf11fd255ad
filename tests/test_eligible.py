"""Eligibility summed and reduced to items before units meet items, against its edges on awkward rows."""

from collections import defaultdict

from pyspark.sql import functions as F

from loomgraph.operators import graph as G

UNITS = [("u1", "army-1", 1), ("u2", "army-1", None), ("u3", "army-2", 0), ("u4", None, 2), ("u5", "army-9", 3), ("u6", "army-1", 2)]
UPGRADES = [
    ("a", "u1", "magic_item_budget", 25, None, None, 2), ("b", "u1", "command_bsb", None, None, True, 1), ("c", "u2", "command_standard", None, 50, None, 1), ("d", "u2", "command_bsb", 75, None, None, 1),
    ("e", "u3", "rune_budget", 25, None, None, 1), ("f", "u3", "magic_item_budget", None, None, False, 1), ("g", "u4", "vampiric_powers_budget", 25, None, None, 1), ("h", "u4", "command_bsb", 25, None, True, 1), ("i", "missing", "command_bsb", 25, None, True, 1),
]
ITEMS = [(f"{kind}-{army}-{i}", kind, army) for kind in ("magic_weapon", "arcane_item", "magic_standard", "ability", None) for army in ("army-1", "army-2", "army-3", "ravening-hordes", None) for i in range(2)]


def _tables(spark, upgrades=UPGRADES):
    return (
        spark.createDataFrame(UNITS, "unit string, army string, wizard_level int"),
        spark.createDataFrame(upgrades, "upgrade string, unit string, upgrade_type string, points_budget int, magic_standard_budget int, unlimited boolean, ord int"),
        spark.createDataFrame(ITEMS, "item string, item_type string, army string"),
    )


def test_sums_and_reachable_items_equal_the_edges(spark):
    for upgrades in (UPGRADES, [u for u in UPGRADES if u[2] == "rune_budget"], [u for u in UPGRADES if u[1] == "missing"]):
        t = _tables(spark, upgrades)
        edges = G.eligible(*t).collect()
        want = defaultdict(list)
        for e in edges:
            want[e["unit"], e["pass"], e["via"], e["budget"], e["unlimited"]].append(e["item"])
        sums = {(r["unit"], r["pass"], r["via"], r["budget"], r["unlimited"]): (r["n"], r["first_item"]) for r in G.eligible_sums(*t).collect()}
        assert sums == {k: (len(v), min(v)) for k, v in want.items()}
        assert sorted(r["item"] for r in G.reachable(*t).collect()) == sorted({e["item"] for e in edges})


def test_units_do_not_meet_items_one_by_one(spark):
    units = spark.range(3000).select(F.concat(F.lit("u"), "id").alias("unit"), F.lit("army-1").alias("army"), F.lit(1).alias("wizard_level"))
    upgrades = spark.range(3000).select(F.col("id").cast("string").alias("upgrade"), F.concat(F.lit("u"), "id").alias("unit"), F.lit("command_bsb").alias("upgrade_type"), F.lit(5).alias("points_budget"), F.lit(None).cast("int").alias("magic_standard_budget"), F.lit(True).alias("unlimited"), F.lit(1).alias("ord"))
    items = spark.range(1_000_000).select(F.col("id").cast("string").alias("item"), F.lit("magic_weapon").alias("item_type"), F.when(F.col("id") % 2 == 0, "army-1").alias("army"))
    got = G.eligible_sums(units, upgrades, items).agg(F.count(F.lit(1)), F.min("n"), F.max("n"), F.min("first_item")).collect()[0]  # three thousand million edges
    assert tuple(got) == (3000, 1_000_000, 1_000_000, "0")
    assert G.reachable(units, upgrades, items).count() == 1_000_000


def test_edges_of_one_army_are_dealt_over_tasks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("-1", "false", "16")):
            spark.conf.set(k, v)
        units = spark.range(2000).select(F.col("id").alias("unit"), F.lit("army-1").alias("army"))
        items = spark.createDataFrame([(str(i), "army-1") for i in range(5)], "item string, class string")
        rows = G.dealt(units, items, "army", "class").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in rows) == 10_000 and len(rows) > 8 and max(r["count"] for r in rows) < 2500


def _joined(df):
    """The final plan of ``df`` once it has run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_abilities_are_shuffled_with_their_units_into_all_tasks(spark):
    plan = _joined(G.eligible(*_tables(spark)).where("pass = 2"))  # files far below what the planner broadcasts
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert plan.count(f", {G.SPREAD}), REPARTITION_BY_NUM") == 2  # adaptive execution deals no more than it was given into fewer tasks


def test_standards_of_all_armies_are_shuffled_too(spark):
    edges = G.eligible(*_tables(spark)).where("pass = 1")
    plan = _joined(edges)
    assert "Broadcast" not in plan and plan.count(f", {G.SPREAD}), REPARTITION_BY_NUM") == 4  # those of the unit's army, and those of all
    items = {(r["unit"], r["item"]) for r in edges.collect()}
    assert items == {(u, f"magic_standard-{army}-{i}") for u, own in (("u1", "army-1"), ("u2", "army-1"), ("u4", None)) for army in ("ravening-hordes", None, own) for i in range(2)}
