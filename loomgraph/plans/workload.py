"""The documented query workload and the remaining relational operators, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import classify as C
from loomgraph.functions import markup as M
from loomgraph.functions import text as X
from loomgraph.operators import quality as Q
from loomgraph.operators import retrieve as R
from loomgraph.sources.tables import EDGES_SQL, NODES_SQL, edges, nodes, table

_int = lambda c: c.cast("bigint")
ALLIES = [("region#0", "region#1", "trusted"), ("region#1", "region#2", "uneasy"), ("region#3", "region#9", "suspicious"), ("region#2", "region#4", "trusted")]
_ALLIES_SQL = "allies AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in ALLIES) + ") v(src, dst, kind))"


def constant_relation_join(spark, d):
    """Constant edges, kept where both ends exist."""
    n = nodes(spark, d, ("Region",)).select("id", "name")
    c = spark.createDataFrame(ALLIES, "src string, dst string, kind string")
    both = c.join(n.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src").join(n.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst")
    return both.select("src", "dst", "kind", "src_name", "dst_name")


def seed_upsert(spark, d):
    """Constants create or overwrite three columns of nations; the other columns stay."""
    seed = spark.createDataFrame([(1, "SEED ONE", 9), (99, "NEW", 2)], "k int, name string, region int")
    n = table(spark, d, "nation")
    j = n.join(seed, F.col("n_nationkey") == F.col("k"), "full_outer")
    return j.select(_int(F.coalesce("k", "n_nationkey")).alias("id"), F.coalesce("name", "n_name").alias("name"), _int(F.coalesce("region", "n_regionkey")).alias("region"))


def uniqueness_violations(spark, d):
    """Ids that a label holds more than once: the constraint as a query."""
    line = table(spark, d, "lineitem").select(F.lit("Line").alias("label"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))
    return nodes(spark, d).select("label", "id").unionByName(line).groupBy("label", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("label").agg(F.count(F.lit(1)).alias("ids"), F.max("n").alias("most"))


def labelless_edges(spark, d):
    """Edge ends looked up without their label: numbers that two labels share give a row per label pair."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.lit("Part").alias("label"))
    supp = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("Supplier").alias("label"))
    ids = part.unionByName(supp)
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return e.join(ids, "k").groupBy("label").agg(F.count(F.lit(1)).alias("ends"), F.sum("n").alias("edges"))


def first_seen_dedupe(spark, d):
    """A target that several prioritised sources name belongs to the first; one relation is exempt."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2).alias("source"), "l_linenumber")
    kept = line.where("source <> 2").groupBy("l_orderkey", "l_suppkey").agg(F.min(F.struct("source", "l_linenumber")).alias("m"))
    rows = kept.select("l_orderkey", _int(F.col("m.source")).alias("source")).unionByName(line.where("source = 2").select("l_orderkey", F.lit(2).cast("bigint").alias("source")))
    return rows.groupBy("l_orderkey", "source").agg(F.count(F.lit(1)).alias("n"))


def ordered_distinct(spark, d):
    """Order-keeping distinct of each conversation's roles and first words."""
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.substring_index("text", " ", 1).alias("w")))).alias("a"))
    return t.select("conv_id", F.array_join(F.array_distinct(F.transform("a", lambda x: x["w"])), " ").alias("words"))


def faction_hub(spark, d):
    """Hub and spokes: each region with its nations in order, up to a limit."""
    e = edges(spark, d, ("IN_REGION",))
    return e.orderBy("dst", "src").limit(60).select("dst", "src")


def reference_by_length(spark, d):
    """Trails of one or two edges from parts, shortest first, up to 200."""
    e = edges(spark, d, ("SUPPLIED_BY", "IN_NATION")).select("src", "dst")
    one = e.where(F.col("src").startswith("part#")).select("src", F.col("dst").alias("end"), F.lit(1).cast("bigint").alias("hops"))
    two = one.join(e.select(F.col("src").alias("_m"), F.col("dst").alias("_e")), F.col("end") == F.col("_m")).select("src", F.col("_e").alias("end"), F.lit(2).cast("bigint").alias("hops"))
    return one.unionByName(two).orderBy("hops", "src", "end").limit(200)


def lore_two_branches(spark, d):
    """Parts of a class with two optional branches: suppliers and orders."""
    p = table(spark, d, "part").where("p_type = 'SMALL'").select("p_partkey", "p_name")
    s = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_orderkey").alias("orders"))
    return p.join(s, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("orders", F.lit(0)).alias("orders"))


def clarifying_edges(spark, d):
    """Edges of two relations from two labels, the first 40."""
    e = edges(spark, d, ("PLACED_BY", "IN_NATION"))
    return e.where((F.col("relation") == "PLACED_BY") | F.col("src").startswith("supplier#")).orderBy("relation", "src", "dst").limit(40).select("src", "dst", "relation")


def point_lookup(spark, d):
    return nodes(spark, d, ("Supplier",)).where("id = 'supplier#7'").select("id", "name")


def allies_ordered(spark, d):
    c = spark.createDataFrame(ALLIES, "src string, dst string, kind string")
    order = Window.partitionBy(F.lit(1)).orderBy("kind", "src", "dst")
    return c.withColumn("place", _int(F.row_number().over(order)))


def slot_rows(spark, d):
    """Slots of each region's list: share of customers by segment, as limits."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = c.groupBy("n_regionkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("n_regionkey"))
    return counts.select(_int(F.col("n_regionkey")).alias("region"), F.col("c_mktsegment").alias("slot"), "n", Q.ratio(F.col("n"), total).alias("share"))


def slot_allows(spark, d):
    """Slot to allowed members with their limits."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", (F.col("c_custkey") % 4).alias("max_count"))
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    j = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.where("coalesce(orders, 0) >= max_count * 5").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("allowed"), F.max("max_count").alias("most"))


def standard_bearers(spark, d):
    """Members that hold an upgrade of a kind, through two joins."""
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    line = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, d, "customer").join(o.join(line, "o_orderkey", "left_semi"), "c_custkey").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("orders"))


def weapon_class(spark, d):
    return table(spark, d, "part").select("p_partkey", C.weapon_kind(X.slugify("p_name"), F.col("p_name")).alias("kind"))


def document_class(spark, d):
    return table(spark, d, "documents").select("doc_id", C.document_kind(F.col("source"), F.col("lang")).alias("kind"))


def page_router(spark, d):
    return table(spark, d, "pages").select("page_id", C.routed_kind(C.page_kind(X.url_path("url")), X.url_slug("url"), M.next_data(F.col("html")).isNotNull()).alias("kind"))


def spell_values(spark, d):
    """Value, override as text, number in its list and list id, from raw fields."""
    p = table(spark, d, "part").select("p_partkey", "p_size", F.concat(X.slugify("p_type"), F.lit("-lore")).alias("lore"))
    return p.select("p_partkey", F.when(F.col("p_size") % 7 != 0, _int(F.col("p_size"))).alias("value"), F.when(F.col("p_size") % 7 == 0, F.concat("p_size", F.lit("+"))).alias("override"), _int(F.floor(F.col("p_size") / 10)).alias("number"), F.regexp_replace("lore", "-lore$", "").alias("lore_id"))


def cost_override(spark, d):
    """A cost is dropped where an override says something."""
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, "see text").when(F.col("p_size") % 4 == 1, "").alias("o"), _int(F.col("p_size")).alias("c"))
    return p.select("p_partkey", F.when(F.coalesce(F.col("o"), F.lit("")) == "", F.col("c")).alias("cost"))


def text_contains_join(spark, d):
    """Passages that no label holds yet (anti join), bare of the full stop, and the number of conversations with a turn that holds the whole passage; openings of every twentieth conversation are passages too."""
    held = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"))
    said = table(spark, d, "conversations").where("conv_id % 20 = 0").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    passages = table(spark, d, "benchmark").select("item_id", "text").unionByName(said.select((-1 - F.col("conv_id")).alias("item_id"), "text"))
    free = passages.join(held, "item_id", "left_anti").select(F.col("item_id").alias("name_id"), F.regexp_replace("text", r"\.$", "").alias("name"))
    t = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("text_id"), "text")
    return R.dictionary_join(free, t).groupBy(F.col("name_id").alias("item_id")).agg(F.countDistinct("text_id.conv_id").alias("n"))


def label_of_id(spark, d):
    n = nodes(spark, d).groupBy(F.regexp_extract("id", "^([a-z]+)#", 1).alias("kind"), "label").agg(F.count(F.lit(1)).alias("n"), F.count("name").alias("named"), F.count("text").alias("with_text"))
    return n


QUERIES = {f.__name__: f for f in (
    constant_relation_join, seed_upsert, uniqueness_violations, labelless_edges, first_seen_dedupe, ordered_distinct, faction_hub, reference_by_length,
    lore_two_branches, clarifying_edges, point_lookup, allies_ordered, slot_rows, slot_allows, standard_bearers, weapon_class, document_class, page_router,
    spell_values, cost_override, text_contains_join, label_of_id,
)}

_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_KIND = f"CASE WHEN {_PATH} IN ('', '/') THEN 'toc' WHEN regexp_matches({_PATH}, '^/[a-z]{{2}}/\\d+/?$') THEN 'article' WHEN regexp_matches({_PATH}, '^/[a-z]{{2}}(/|$)') THEN 'section' WHEN regexp_matches({_PATH}, '\\.(pdf|zip)$') THEN 'file' END"
ORACLES = {
    "constant_relation_join": f"WITH {_ALLIES_SQL} SELECT src, dst, kind, a.r_name AS src_name, b.r_name AS dst_name FROM allies JOIN region a ON src = 'region#' || a.r_regionkey JOIN region b ON dst = 'region#' || b.r_regionkey",
    "seed_upsert": "SELECT coalesce(k, n_nationkey)::BIGINT AS id, coalesce(name, n_name) AS name, coalesce(region, n_regionkey)::BIGINT AS region FROM nation FULL JOIN (VALUES (1, 'SEED ONE', 9), (99, 'NEW', 2)) s(k, name, region) ON n_nationkey = k",
    "uniqueness_violations": f"WITH {NODES_SQL}, c AS (SELECT label, id, count(*) AS n FROM (SELECT label, id FROM nodes UNION ALL SELECT 'Line', l_orderkey || '-' || l_linenumber FROM lineitem) GROUP BY 1, 2 HAVING count(*) > 1) SELECT label, count(*) AS ids, max(n) AS most FROM c GROUP BY 1",
    "labelless_edges": "WITH ids AS (SELECT p_partkey AS k, 'Part' AS label FROM part UNION ALL SELECT s_suppkey, 'Supplier' FROM supplier) SELECT label, count(DISTINCT k) AS ends, count(*) AS edges FROM lineitem JOIN ids ON l_partkey = k GROUP BY 1",
    "first_seen_dedupe": """WITH l AS (SELECT l_orderkey, l_suppkey, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END::BIGINT AS source FROM lineitem),
        k AS (SELECT l_orderkey, min(source) AS source FROM l WHERE source <> 2 GROUP BY l_orderkey, l_suppkey UNION ALL SELECT l_orderkey, source FROM l WHERE source = 2) SELECT l_orderkey, source, count(*) AS n FROM k GROUP BY 1, 2""",
    "ordered_distinct": "WITH w AS (SELECT conv_id, split_part(text, ' ', 1) AS w, min(turn) AS t FROM conversations GROUP BY 1, 2) SELECT conv_id, string_agg(w, ' ' ORDER BY t) AS words FROM w GROUP BY 1",
    "faction_hub": f"WITH {EDGES_SQL} SELECT dst, src FROM edges WHERE relation = 'IN_REGION' ORDER BY dst, src LIMIT 60",
    "reference_by_length": f"""WITH {EDGES_SQL}, e AS (SELECT src, dst FROM edges WHERE relation IN ('SUPPLIED_BY', 'IN_NATION')), one AS (SELECT src, dst AS "end", 1::BIGINT AS hops FROM e WHERE src LIKE 'part#%')
        SELECT * FROM (SELECT * FROM one UNION ALL SELECT one.src, e.dst, 2 FROM one JOIN e ON one."end" = e.src) ORDER BY hops, src, "end" LIMIT 200""",
    "lore_two_branches": "SELECT p_partkey, p_name, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_type = 'SMALL' GROUP BY 1, 2",
    "clarifying_edges": f"WITH {EDGES_SQL} SELECT src, dst, relation FROM edges WHERE relation = 'PLACED_BY' OR (relation = 'IN_NATION' AND src LIKE 'supplier#%') ORDER BY relation, src, dst LIMIT 40",
    "point_lookup": "SELECT 'supplier#' || s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey = 7",
    "allies_ordered": f"WITH {_ALLIES_SQL} SELECT src, dst, kind, row_number() OVER (ORDER BY kind, src, dst) AS place FROM allies",
    "slot_rows": "WITH c AS (SELECT n_regionkey::BIGINT AS region, c_mktsegment AS slot, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT region, slot, n, round_even(n / sum(n) OVER (PARTITION BY region), 3) AS share FROM c",
    "slot_allows": "SELECT c_mktsegment, count(*) AS allowed, max(c_custkey % 4) AS most FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE coalesce(orders, 0) >= (c_custkey % 4) * 5 GROUP BY 1",
    "standard_bearers": "SELECT c_custkey, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1",
    "weapon_class": "SELECT p_partkey, CASE WHEN p_name IN ('old rod', 'new rod') THEN 'great_weapon' WHEN regexp_matches(p_name, 'bolt|arrow|bow') THEN 'missile' WHEN regexp_matches(p_name, 'ring|gem') THEN 'arcane' WHEN regexp_matches(p_name, 'rod|widget') THEN 'combat' ELSE 'other' END AS kind FROM part",
    "document_class": "SELECT doc_id, CASE WHEN source IN ('src0', 'src1') OR source || '/' || lang IN ('src2/en', 'src3/de') THEN 'Document' ELSE 'CoreRule' END AS kind FROM documents",
    "page_router": f"""SELECT page_id, CASE WHEN regexp_matches(coalesce(nullif(regexp_extract({_PATH}, '([^/]+)/*$', 1), ''), 'toc'), '^[0-9]+$') AND {_KIND} = 'article' THEN 'numbered' WHEN contains(html, '__NEXT_DATA__') THEN 'data' WHEN {_KIND} = 'toc' THEN 'index' ELSE {_KIND} END AS kind FROM pages""",
    "spell_values": "SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_size END::BIGINT AS value, CASE WHEN p_size % 7 = 0 THEN p_size || '+' END AS override, (p_size // 10)::BIGINT AS number, lower(p_type) AS lore_id FROM part",
    "cost_override": "SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_size END::BIGINT AS cost FROM part",
    "text_contains_join": r"""WITH p AS (SELECT item_id, text FROM benchmark UNION ALL SELECT -1 - conv_id, arg_min(text, turn) FROM conversations WHERE conv_id % 20 = 0 GROUP BY conv_id),
        f AS MATERIALIZED (SELECT item_id, lower(regexp_replace(text, '\.$', '')) AS name FROM p WHERE item_id NOT IN (SELECT doc_id FROM labels)), c AS MATERIALIZED (SELECT conv_id, lower(text) AS t FROM conversations),
        m AS MATERIALIZED (SELECT item_id, conv_id, name, t FROM f, c WHERE contains(t, name))
        SELECT item_id, count(DISTINCT conv_id) AS n FROM m WHERE regexp_matches(t, '(^|[^\p{L}\p{M}\p{N}_])' || regexp_escape(name) || '($|[^\p{L}\p{M}\p{N}_])') GROUP BY 1""",
    "label_of_id": f"WITH {NODES_SQL} SELECT regexp_extract(id, '^([a-z]+)#', 1) AS kind, label, count(*) AS n, count(name) AS named, count(text) AS with_text FROM nodes GROUP BY 1, 2",
}
