"""Queries over the property-graph view, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators.adjacency import Adjacency
from loomgraph.sources import replay
from loomgraph.sources.tables import BOTH_SQL, EDGES_SQL, LABELS, NODES_SQL, edges, nodes, table, undirected

SEEDS = ["part#1", "part#2", "nation#3", "customer#5", "supplier#7", "order#11", "nation#19", "region#1"]
_SEEDS_SQL = "seeds AS (SELECT unnest([" + ", ".join(f"'{s}'" for s in SEEDS) + "]) AS seed_id)"
_TIER_SQL = "CASE relation WHEN 'IN_REGION' THEN 1 WHEN 'IN_NATION' THEN 1 WHEN 'PLACED_BY' THEN 2 WHEN 'SUPPLIED_BY' THEN 2 ELSE 3 END"
_CAP_SQL = "CASE relation WHEN 'CONTAINS' THEN 3 WHEN 'SUPPLIED_BY' THEN 5 WHEN 'PLACED_BY' THEN 20 ELSE 4 END"
_EXPAND_SQL = f"""
near AS (
  SELECT seed_id, relation, other AS id, {_TIER_SQL} AS tier FROM both_ways JOIN seeds ON node = seed_id
  WHERE other NOT IN (SELECT seed_id FROM seeds)
  QUALIFY row_number() OVER (PARTITION BY seed_id, relation ORDER BY tier, other) <= {_CAP_SQL}),
expanded AS (
  SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY tier, id, relation) AS place FROM near
  QUALIFY place <= 40)"""


def seeds(spark: SparkSession, ids: list[str] = SEEDS) -> DataFrame:
    return spark.createDataFrame([(s,) for s in ids], "seed_id string")


def node_counts_by_label(spark, d):
    """Every expected label, those without nodes included."""
    found = nodes(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("actual"))
    return spark.createDataFrame([(x,) for x in [*LABELS, "Absent"]], "label string").join(found, "label", "left").select("label", F.coalesce("actual", F.lit(0)).cast("bigint").alias("actual"))


def edge_counts_by_relation(spark, d):
    return edges(spark, d).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def expand_one_hop(spark, d):
    s = seeds(spark)
    near = undirected(edges(spark, d)).join(s, F.col("node") == F.col("seed_id"))
    near = near.join(s.select(F.col("seed_id").alias("_s")), F.col("other") == F.col("_s"), "left_anti")
    return near.groupBy("seed_id", "relation").agg(F.countDistinct("other").alias("n"), F.min("other").alias("first_id"))


def expand_capped(spark, d):
    return Adjacency.of_tables(spark, d).expand(seeds(spark)).select("seed_id", "rel_type", "id", F.col("place").cast("bigint").alias("place"))


def _linked_seeds(spark, d):
    first = table(spark, d, "orders").where("o_orderkey % 100 = 0").select(F.explode(F.array(F.concat(F.lit("order#"), F.col("o_orderkey")), F.concat(F.lit("customer#"), F.col("o_custkey")))).alias("seed_id"))
    return first.unionByName(table(spark, d, "nation").select(F.concat(F.lit("nation#"), F.col("n_nationkey")).alias("seed_id"))).unionByName(seeds(spark, ["region#0", "region#1"])).distinct()


def links_between(spark, d):
    return G.links_between(edges(spark, d), _linked_seeds(spark, d)).select("src", "dst", "relation")


_HOP_SQL = "relation IS NOT NULL"
_LEVELS_SQL = f"""
pairs AS (SELECT DISTINCT node, other FROM both_ways WHERE {_HOP_SQL}),
l0 AS (SELECT seed_id AS center, seed_id AS id FROM seeds),
l1 AS (SELECT DISTINCT center, other AS id FROM l0 JOIN pairs ON id = node EXCEPT SELECT * FROM l0),
l2 AS (SELECT DISTINCT center, other AS id FROM l1 JOIN pairs ON id = node EXCEPT SELECT * FROM l0 EXCEPT SELECT * FROM l1),
l3 AS (SELECT DISTINCT center, other AS id FROM l2 JOIN pairs ON id = node EXCEPT SELECT * FROM l0 EXCEPT SELECT * FROM l1 EXCEPT SELECT * FROM l2),
l4 AS (SELECT DISTINCT center, other AS id FROM l3 JOIN pairs ON id = node EXCEPT SELECT * FROM l0 EXCEPT SELECT * FROM l1 EXCEPT SELECT * FROM l2 EXCEPT SELECT * FROM l3),
dist AS (SELECT center, id, 0 AS distance FROM l0 UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3 UNION ALL SELECT *, 4 FROM l4)"""
_CENTERS = ["part#1", "region#1", "customer#5", "missing#1"]
_CENTERS_SQL = "seeds AS (SELECT unnest(['part#1', 'region#1', 'customer#5', 'missing#1']) AS seed_id)"
_HOPS_WITH = f"WITH {EDGES_SQL}, {BOTH_SQL}, {_CENTERS_SQL}, {_LEVELS_SQL}"


def _centers(spark):
    return seeds(spark, _CENTERS).withColumnRenamed("seed_id", "center")


def hop_distance(spark, d):
    return Adjacency.of_tables(spark, d).hops(_centers(spark), 4).groupBy("center", "distance").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


#: Nodes of a subgraph that is drawn.
_DRAWN = 150


def subgraph_depth2(spark, d):
    """Every edge among all nodes within two hops of each center."""
    _, among = Adjacency.of_tables(spark, d).subgraph(_centers(spark))
    return among


def subgraph_nodes(spark, d):
    near, _ = Adjacency.of_tables(spark, d).subgraph(_centers(spark), most=_DRAWN)
    return near


def capped_bfs(spark, d):
    return G.capped_bfs(Adjacency.of_tables(spark, d).subgraph(_centers(spark), most=_DRAWN)[1])


def shortest_path(spark, d):
    pairs = spark.createDataFrame([("part#1", "region#1"), ("customer#5", "supplier#7"), ("region#1", "region#2"), ("part#1", "missing#1"), ("customer#5", "customer#5")], "a string, b string")
    return Adjacency.of_tables(spark, d).shortest_path(pairs)


def var_length_1_2(spark, d):
    start = seeds(spark, ["part#1", "part#2", "customer#5", "order#3"]).withColumnRenamed("seed_id", "src")
    return G.variable_length(edges(spark, d), start).select("src", "end", F.col("length").cast("bigint").alias("length"))


def radial_layout(spark, d):
    near, _ = Adjacency.of_tables(spark, d).subgraph(_centers(spark), most=_DRAWN)
    return G.radial_layout(near).select("center", "id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def merge_nodes(spark, d):
    """Parts, upserted with a changed price and with new rows."""
    part = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_retailprice").alias("price"))
    change = part.where("p_partkey % 3 = 0").select((F.col("p_partkey") + F.when(F.col("p_partkey") % 2 == 0, 1_000_000).otherwise(0)).alias("p_partkey"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).alias("p_name"), (F.col("price") * 2).alias("price"))
    return G.merge_rows(part, change, "p_partkey", ["p_name", "price"])


def merge_edges(spark, d):
    line = table(spark, d, "lineitem")
    e = line.select(F.concat(F.lit("order#"), F.col("l_orderkey")).alias("src"), F.concat(F.lit("part#"), F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, 10_000_000).otherwise(0)).alias("dst"), F.lit("CONTAINS").alias("relation"), F.col("l_quantity").alias("quantity"), F.struct("l_linenumber", "l_quantity").alias("seq"))
    return G.merge_edges(e, nodes(spark, d, ("Order", "Part")).select("id")).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


def dedupe_last_wins(spark, d):
    return G.last_wins(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


def dedupe_first_wins(spark, d):
    return G.first_wins(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


def eligibility_derivation(spark, d):
    """Customers may take parts of their nation's class or of no class; parts are summed by class and type before they meet customers."""
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "c_acctbal")
    part = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 10 != 0, F.col("p_size").cast("bigint") % 25).alias("class"), "p_type")
    kinds = part.groupBy("class", "p_type").agg(F.count(F.lit(1)).alias("parts"), F.min("p_partkey").alias("least"))
    can = G.universal_or_equal(customer, kinds, "c_nationkey", "class")
    # three-valued: a null type never qualifies, a small type needs a balance
    can = can.where("(p_type <> 'SMALL' OR coalesce(c_acctbal, 0) >= 1000) AND p_type <> 'ECONOMY'")
    universal = F.sum(F.when(F.col("class").isNull(), F.col("parts")).otherwise(0))
    return can.groupBy("c_custkey").agg(F.sum("parts").alias("n"), F.min("least").alias("first_part"), universal.alias("universal"))


def best_upgrade(spark, d):
    """On-create merge: of several lines that make the same edge the first defines its properties, null budgets last."""
    line = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity")).alias("budget"), "l_linenumber", "l_orderkey")
    order = Window.partitionBy("l_suppkey", "l_partkey").orderBy(F.col("budget").isNull(), "l_linenumber", "l_orderkey", "budget")
    return line.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("l_suppkey", "l_partkey", "budget", F.col("l_orderkey").alias("via"))


def relabel_two_pass(spark, d):
    """Pass one relabels edges by what they point at, pass two promotes sources of one of the new labels."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    weapon = table(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("_w"))
    item = table(spark, d, "part").where("p_retailprice > 1500 OR p_size > 45").select(F.col("p_partkey").alias("_i"))
    one = line.join(weapon, F.col("dst") == F.col("_w"), "left").join(item, F.col("dst") == F.col("_i"), "left")
    one = one.select("src", "dst", F.when(F.col("_w").isNotNull(), "UNLOCKS_WEAPON").when(F.col("_i").isNotNull(), "UNLOCKS_ITEM").otherwise("UNLOCKS_RULE").alias("relation"))
    armed = one.where("relation = 'UNLOCKS_WEAPON'").select(F.col("src").alias("_a")).distinct()
    kinds = one.select("src").distinct().join(armed, F.col("src") == F.col("_a"), "left").select("src", F.when(F.col("_a").isNotNull(), "weapon_add").otherwise("rule_add").alias("kind"))
    return one.groupBy("src", "relation").agg(F.count(F.lit(1)).alias("n")).join(kinds, "src")


def roster_listing(spark, d):
    """Customers of the nations of a region, with the set of order priorities; category is sought in several fields."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    customer = table(spark, d, "customer").join(nation, "c_nationkey").where("n_regionkey = 1")
    kinds = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("types"))
    rows = customer.join(kinds, F.col("c_custkey") == F.col("o_custkey"), "left")
    rows = rows.where(F.exists(F.array("c_mktsegment", "n_name"), lambda x: F.contains(F.lower(x), F.lit("bui"))))
    return rows.select("c_custkey", "n_name", "c_mktsegment", "types")


def name_prefix_search(spark, d):
    """Nodes whose name begins with a prefix, label by label, up to a limit."""
    n = nodes(spark, d, ("Nation", "Customer", "Supplier", "Part")).where(F.lower("name").startswith("s"))
    place = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("label"))
    return n.orderBy(place, "name", "id").limit(60).select("id", "label", "name")


def rule_with_clarification(spark, d):
    """Two patterns that meet in one node: order -> part <- other order's supplier, counted."""
    e = edges(spark, d, ("CONTAINS", "SUPPLIED_BY"))
    a = e.where("relation = 'CONTAINS'").groupBy("dst").agg(F.count(F.lit(1)).alias("orders"))
    b = e.where("relation = 'SUPPLIED_BY'").groupBy(F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "dst").select(F.col("dst").alias("id"), "orders", "suppliers")


def stat_filter(spark, d):
    return table(spark, d, "part").where("p_size >= 40 AND p_retailprice >= 920").select("p_partkey", "p_name", F.col("p_size").cast("bigint").alias("p_size"))


def union_of_paths(spark, d):
    """Distinct union of two paths to nations: by customer and by supplier of one part."""
    e = edges(spark, d)
    part = e.where("relation = 'SUPPLIED_BY' AND src IN ('part#1', 'part#5')").select(F.col("dst").alias("src"))
    by_supplier = e.where("relation = 'IN_NATION'").join(part, "src").select("dst")
    by_customer = e.where("relation = 'IN_NATION' AND src IN ('customer#1', 'customer#2', 'customer#3')").select("dst")
    return by_supplier.union(by_customer).distinct().select(F.col("dst").alias("id"))


def optional_branches(spark, d):
    """A nation with two optional branches: its customers and its suppliers."""
    e = edges(spark, d, ("IN_NATION",))
    n = nodes(spark, d, ("Nation",)).select("id", "name")
    count = lambda kind, name: e.where(F.col("src").startswith(kind)).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias(name))
    out = n.join(count("customer#", "customers"), "id", "left").join(count("supplier#", "suppliers"), "id", "left")
    return out.select("id", "name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


def unlock_chain(spark, d):
    """One node fully expanded, with an optional second hop: order, its parts, their suppliers."""
    e = edges(spark, d, ("CONTAINS", "SUPPLIED_BY"))
    first = e.where("relation = 'CONTAINS' AND src IN ('order#1', 'order#2', 'order#3')").select("src", F.col("dst").alias("part"), "quantity")
    second = e.where("relation = 'SUPPLIED_BY'").select(F.col("src").alias("part"), F.col("dst").alias("supplier"))
    return first.join(second, "part", "left").select("src", "part", "quantity", "supplier")


def budget_lookup(spark, d):
    """Items that a node can take, with the edge's properties."""
    e = edges(spark, d, ("CONTAINS",)).where("src = 'order#7'")
    return e.join(nodes(spark, d, ("Part",)), F.col("dst") == F.col("id")).select("id", "name", "quantity", "price")


def crawl_frontier(spark, d):
    """Breadth-first rounds over page links: hosts reached from a seed host by shared first link words, until a round meets no new one.

    Hosts and words take turns, so hosts that share a word are not paired.
    """
    pages = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host"), F.regexp_extract_all("html", F.lit('<a href="/([a-z]+)"'), 1).alias("links"))
    pairs = pages.select(F.concat(F.lit("host "), "host").alias("host"), F.explode(F.transform("links", lambda w: F.concat(F.lit("word "), w))).alias("word")).distinct()
    links = pairs.toDF("from_url", "to_url").unionByName(pairs.toDF("to_url", "from_url"))
    seed = pages.select("host").distinct().orderBy("host").limit(1).select(F.concat(F.lit("host "), "host").alias("url"))
    seen = replay.frontier(seed, links).where(F.col("url").startswith("host "))
    return seen.select(F.substring("url", 6, 2**31 - 1).alias("host"), F.floor(F.col("round") / 2).cast("bigint").alias("round"))


QUERIES = {f.__name__: f for f in (
    node_counts_by_label, edge_counts_by_relation, expand_one_hop, expand_capped, links_between, hop_distance, subgraph_depth2, subgraph_nodes,
    capped_bfs, shortest_path, var_length_1_2, radial_layout, merge_nodes, merge_edges, dedupe_last_wins, dedupe_first_wins, eligibility_derivation,
    best_upgrade, relabel_two_pass, roster_listing, name_prefix_search, rule_with_clarification, stat_filter, union_of_paths, optional_branches,
    unlock_chain, budget_lookup, crawl_frontier,
)}

_LINK_SEEDS_SQL = """seeds AS (
  SELECT DISTINCT * FROM (
  SELECT unnest(['order#' || o_orderkey, 'customer#' || o_custkey]) AS seed_id FROM orders WHERE o_orderkey % 100 = 0
  UNION ALL SELECT 'nation#' || n_nationkey FROM nation UNION ALL SELECT unnest(['region#0', 'region#1'])))"""
_NEAR_SQL = "near2 AS (SELECT center, id, distance FROM dist WHERE distance <= 2 QUALIFY row_number() OVER (PARTITION BY center ORDER BY distance, id) <= 150)"
ORACLES = {
    "node_counts_by_label": f"WITH {NODES_SQL} SELECT l AS label, count(id) AS actual FROM (SELECT unnest([{', '.join(repr(x) for x in [*LABELS, 'Absent'])}]) AS l) LEFT JOIN nodes ON label = l GROUP BY l",
    "edge_counts_by_relation": f"WITH {EDGES_SQL} SELECT relation, count(*) AS n FROM edges GROUP BY relation",
    "expand_one_hop": f"WITH {EDGES_SQL}, {BOTH_SQL}, {_SEEDS_SQL} SELECT seed_id, relation, count(DISTINCT other) AS n, min(other) AS first_id FROM both_ways JOIN seeds ON node = seed_id WHERE other NOT IN (SELECT seed_id FROM seeds) GROUP BY ALL",
    "expand_capped": f"WITH {EDGES_SQL}, {BOTH_SQL}, {_SEEDS_SQL}, {_EXPAND_SQL} SELECT seed_id, relation AS rel_type, id, place FROM expanded",
    "links_between": f"WITH {EDGES_SQL}, {_LINK_SEEDS_SQL} SELECT src, dst, relation FROM edges WHERE src IN (SELECT seed_id FROM seeds) AND dst IN (SELECT seed_id FROM seeds) AND src <> dst QUALIFY row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst), relation ORDER BY src, dst) = 1",
    "hop_distance": f"{_HOPS_WITH} SELECT center, distance, count(*) AS n, min(id) AS first_id FROM dist GROUP BY ALL",
    "subgraph_depth2": f"{_HOPS_WITH}, near2 AS (SELECT center, id FROM dist WHERE distance <= 2) SELECT DISTINCT a.center, e.src, e.dst, e.relation FROM edges e JOIN near2 a ON a.id = e.src JOIN near2 b ON b.id = e.dst AND a.center = b.center WHERE {_HOP_SQL}",
    "subgraph_nodes": f"{_HOPS_WITH}, {_NEAR_SQL} SELECT * FROM near2",
    "shortest_path": f"""WITH {EDGES_SQL}, {BOTH_SQL}, p AS (SELECT * FROM (VALUES ('part#1', 'region#1'), ('customer#5', 'supplier#7'), ('region#1', 'region#2'), ('part#1', 'missing#1'), ('customer#5', 'customer#5')) v(a, b)),
        seeds AS (SELECT DISTINCT a AS seed_id FROM p), {_LEVELS_SQL} SELECT a, b, distance::BIGINT AS hops FROM p LEFT JOIN dist ON a = center AND b = id""",
    "var_length_1_2": f"""WITH {EDGES_SQL}, one AS (SELECT * FROM edges WHERE src IN ('part#1', 'part#2', 'customer#5', 'order#3'))
        SELECT src, dst AS "end", 1::BIGINT AS length FROM one UNION ALL SELECT a.src, b.dst, 2 FROM one a JOIN edges b ON a.dst = b.src WHERE NOT (a.src = b.src AND a.dst = b.dst AND a.relation = b.relation)""",
    "radial_layout": f"""{_HOPS_WITH}, {_NEAR_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY center, distance ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY center, distance) AS n FROM near2),
        p AS (SELECT *, CASE WHEN distance = 0 THEN 0 ELSE greatest(distance * 260.0::DOUBLE, n * 170.0::DOUBLE / (2 * pi())) END AS radius, distance * pi() / 7 + 2 * pi() * i / n AS angle FROM r)
        SELECT center, id, round(radius * cos(angle), 4) AS x, round(radius * sin(angle), 4) AS y FROM p""",
    "merge_nodes": """WITH n AS (SELECT p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 1000000 ELSE 0 END AS k, CASE WHEN p_partkey % 5 = 0 THEN p_name END AS name, p_retailprice * 2 AS price FROM part WHERE p_partkey % 3 = 0)
        SELECT coalesce(k, p_partkey) AS p_partkey, CASE WHEN k IS NULL THEN p_name ELSE name END AS p_name, CASE WHEN k IS NULL THEN p_retailprice ELSE price END AS price FROM part FULL JOIN n ON k = p_partkey""",
    "merge_edges": """WITH e AS (SELECT l_orderkey, l_partkey + CASE WHEN l_linenumber = 7 THEN 10000000 ELSE 0 END AS p, l_quantity, l_linenumber FROM lineitem),
        k AS (SELECT * FROM e WHERE p IN (SELECT p_partkey FROM part) AND l_orderkey IN (SELECT o_orderkey FROM orders) QUALIFY row_number() OVER (PARTITION BY l_orderkey, p ORDER BY l_linenumber, l_quantity) = 1)
        SELECT 'order#' || l_orderkey AS src, count(*) AS n, sum(l_quantity) AS quantity FROM k GROUP BY l_orderkey""",
    "dedupe_last_wins": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "dedupe_first_wins": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1",
    "eligibility_derivation": """WITH c AS (SELECT * FROM customer), p AS (SELECT p_partkey, CASE WHEN p_size % 10 <> 0 THEN p_size % 25 END AS class, p_type FROM part)
        SELECT c_custkey, count(*) AS n, min(p_partkey) AS first_part, count(*) FILTER (class IS NULL) AS universal FROM c JOIN p ON class IS NULL OR class = c_nationkey
        WHERE (p_type <> 'SMALL' OR coalesce(c_acctbal, 0) >= 1000) AND p_type <> 'ECONOMY' GROUP BY c_custkey""",
    "best_upgrade": """SELECT l_suppkey, l_partkey, CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END AS budget, l_orderkey AS via FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY (l_linenumber % 2 = 0), l_linenumber, l_orderkey, l_quantity) = 1""",
    "relabel_two_pass": """WITH e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem),
        r AS (SELECT src, CASE WHEN p_size > 40 THEN 'UNLOCKS_WEAPON' WHEN p_retailprice > 1500 OR p_size > 45 THEN 'UNLOCKS_ITEM' ELSE 'UNLOCKS_RULE' END AS relation FROM e LEFT JOIN part ON dst = p_partkey)
        SELECT src, relation, count(*) AS n, CASE WHEN src IN (SELECT src FROM r WHERE relation = 'UNLOCKS_WEAPON') THEN 'weapon_add' ELSE 'rule_add' END AS kind FROM r GROUP BY src, relation""",
    "roster_listing": """SELECT c_custkey, n_name, c_mktsegment, types FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS types FROM orders GROUP BY 1) ON o_custkey = c_custkey
        WHERE n_regionkey = 1 AND (contains(lower(c_mktsegment), 'bui') OR contains(lower(n_name), 'bui'))""",
    "name_prefix_search": f"""WITH {NODES_SQL} SELECT id, label, name FROM nodes WHERE label IN ('Nation', 'Customer', 'Supplier', 'Part') AND starts_with(lower(name), 's')
        ORDER BY list_position([{', '.join(repr(x) for x in LABELS)}], label), name, id LIMIT 60""",
    "rule_with_clarification": f"""WITH {EDGES_SQL} SELECT a.dst AS id, orders, suppliers FROM (SELECT dst, count(*) AS orders FROM edges WHERE relation = 'CONTAINS' GROUP BY 1) a
        JOIN (SELECT src, count(*) AS suppliers FROM edges WHERE relation = 'SUPPLIED_BY' GROUP BY 1) b ON a.dst = b.src""",
    "stat_filter": "SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part WHERE p_size >= 40 AND p_retailprice >= 920",
    "union_of_paths": f"""WITH {EDGES_SQL} SELECT b.dst AS id FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src IN ('part#1', 'part#5') AND a.relation = 'SUPPLIED_BY' AND b.relation = 'IN_NATION'
        UNION SELECT dst FROM edges WHERE relation = 'IN_NATION' AND src IN ('customer#1', 'customer#2', 'customer#3')""",
    "optional_branches": "SELECT 'nation#' || n_nationkey AS id, n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation",
    "unlock_chain": """WITH a AS (SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IN (1, 2, 3) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_quantity, l_extendedprice) = 1),
        b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT 'order#' || l_orderkey AS src, 'part#' || l_partkey AS part, l_quantity AS quantity, 'supplier#' || l_suppkey AS supplier FROM a LEFT JOIN b USING (l_partkey)""",
    "budget_lookup": f"WITH {EDGES_SQL} SELECT dst AS id, p_name AS name, quantity, price FROM edges JOIN part ON dst = 'part#' || p_partkey WHERE relation = 'CONTAINS' AND src = 'order#7'",
    "crawl_frontier": """WITH RECURSIVE l AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, unnest(regexp_extract_all(html, '<a href="/([a-z]+)"', 1)) AS word FROM pages),
        hop AS (SELECT DISTINCT a.host AS f, b.host AS t FROM l a JOIN l b USING (word)), hosts AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages),
        walk AS (SELECT min(host) AS host, 0::BIGINT AS round FROM hosts UNION SELECT t, round + 1 FROM walk JOIN hop ON f = host WHERE round < (SELECT count(*) FROM hosts))
        SELECT host, min(round) AS round FROM walk GROUP BY 1""",
}
