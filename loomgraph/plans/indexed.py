"""Queries over tables and indexes that are kept: built, changed by batches, searched; with their oracles.

Each builds what it searches below the shared folder, from the whole tables, in
several batches of which later ones replace or remove what earlier ones brought,
so the result shows the batches' rules and not the order of the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import tables as T
from loomgraph.functions import variant as V
from loomgraph.operators.text_index import TextIndex
from loomgraph.operators.vector_index import VectorIndex
from loomgraph.plans import catalogue, retrieval
from loomgraph.sources.keyed import KeyedTable
from loomgraph.sources.tables import NODES_SQL, nodes, place, table

BUCKETS = 8
CELLS = 16


def keyed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a keyed table: all of them, prices and new rows by batches of a stream, one batch sent twice, some taken out, some back."""
    part = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_retailprice").alias("price"))
    held = KeyedTable.create(spark, place(spark, "parts"), part.schema, ["p_partkey"], BUCKETS)
    put = held.sink("prices")
    put(part, 0)
    put(part.where("p_partkey % 3 = 0").select("p_partkey", (F.col("price") * 2).alias("price")), 1)
    put(part.select("p_partkey", F.lit("sent again").alias("p_name"), F.lit(0.0).alias("price")), 1)
    held.delete(part.where("p_partkey % 7 = 0").select("p_partkey"))
    put(part.where("p_partkey % 14 = 0").select("p_partkey", F.col("p_name")), 2)
    held.compact()
    put(part.where("p_partkey % 5 = 0").select((F.col("p_partkey") + 1_000_000).alias("p_partkey"), "p_name", F.when(F.col("p_partkey") % 2 == 0, F.col("price")).alias("price")), 3)
    return held.read()


def _index(spark: SparkSession, d: str) -> TextIndex:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    index = TextIndex.create(spark, place(spark, "texts"), BUCKETS)
    stale = docs.withColumn("text", F.when(F.col("id") % 7 == 0, F.concat(F.lit("the market of the river "), F.col("id").cast("string"))).otherwise(F.col("text")))
    index.update(stale.unionByName(docs.where("id % 50 = 0").withColumn("id", -1 - F.col("id"))))
    index.update(docs.where("id % 7 = 0"))
    index.remove(docs.where("id % 50 = 0").select((-1 - F.col("id")).alias("id")))
    return index


def text_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """Full-text search over the index: documents replaced and removed after it was built do not show."""
    hits = _index(spark, d).search(retrieval._text_queries(spark, d), retrieval.TOP)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """Exact search per label over the cells: built of most vectors, the others inserted, some of them first with a vector that is replaced."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("label"), "embedding")
    late = F.col("id") % 5 == 0
    turned = rows.where("id % 11 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    index = VectorIndex.build(rows.where(~late & (F.col("id") % 11 != 0)).unionByName(turned.where(~late)), place(spark, "vectors"), CELLS)
    index.insert(rows.where(late | (F.col("id") % 11 == 0)))
    hits = index.search(retrieval._vector_queries(spark, d), retrieval._K, exact=True)
    return hits.select("query_id", "label", "id", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Every turn as a message in JSON: its words as text blocks, its role as reasoning, its number as a citation; unreadable where the turn is a seventh."""
    c = table(spark, d, "conversations")
    block = lambda kind, **more: F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in more.items()])
    text = F.to_json(block("text", text=F.col("text"), citations=F.array(F.struct(F.lit("search_result_location").alias("type"), F.col("turn").alias("search_result_index")))))
    raw = F.concat(F.lit("["), text, F.lit(","), F.to_json(block("thinking", thinking=F.col("role"))), F.lit(","), F.to_json(block("text_delta", delta=F.concat(F.lit(" "), F.col("role")))), F.lit("]"))
    return c.select("conv_id", "turn", V.parsed(F.when(F.col("turn") % 7 == 6, F.concat(F.lit("{"), raw)).otherwise(raw)).alias("v"))


def variant_messages(spark: SparkSession, d: str) -> DataFrame:
    """Text, reasoning and citations of messages that are parsed once."""
    m = _messages(spark, d).select("conv_id", "turn", V.content(F.col("v")).alias("c"))
    return m.select("conv_id", "turn", F.sha2("c.text", 256).alias("text"), "c.reasoning", F.array_join(F.col("c.cited").cast("array<string>"), ",").alias("cited"))


def variant_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of all messages by kind: how many there are and how long their texts are."""
    rows = V.blocks(_messages(spark, d), "v", ["conv_id", "turn"]).where("place IS NOT NULL")
    kind, text = V.field(F.col("value"), "$.type"), F.coalesce(V.field(F.col("value"), "$.text"), V.field(F.col("value"), "$.delta"), V.field(F.col("value"), "$.thinking"))
    return rows.groupBy(kind.alias("kind"), "place").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length(text)).alias("chars"))


def option_walk(spark: SparkSession, d: str) -> DataFrame:
    """Options of every customer's order lines by a table function in SQL: urgent orders open groups, those of low priority stand below them."""
    T.register(spark)
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("n"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("May be mounted on one of "), F.col("o_orderkey").cast("string"), F.lit(":"))).when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("Takes one of:")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit("option "), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("  choice "), F.col("o_orderkey").cast("string"))).alias("line"),
    )
    o.createOrReplaceTempView("loomgraph_lines")
    return spark.sql("SELECT unit, bigint(place) AS place, line, bigint(group_id) AS group_id, header, mounts, n FROM option_walk(TABLE(loomgraph_lines))")


def army_roster(spark: SparkSession, d: str) -> DataFrame:
    """The roster tool in SQL, for every nation: units of a category in order, the first fifty."""
    T.army_roster(spark, catalogue.units(spark, d))
    table(spark, d, "nation").createOrReplaceTempView("loomgraph_nations")
    return spark.sql("SELECT n_name, r.unit, r.category, bigint(r.place) AS place FROM loomgraph_nations, LATERAL army_roster(concat('army-', n_nationkey), 'u', 50) r")


def archive_query(spark: SparkSession, d: str) -> DataFrame:
    """The archive tool in SQL: what is called so or speaks of it, the first hundred."""
    T.archive_query(spark, nodes(spark, d, ("Part", "Nation", "Region", "Supplier")))
    return spark.sql("SELECT id, label, name, exact, bigint(place) AS place FROM archive_query('Red Bolt', 100)")


QUERIES = {f.__name__: f for f in (keyed_batches, text_index_topk, vector_index_topk, variant_messages, variant_blocks, option_walk, army_roster, archive_query)}
ORACLES = {
    "keyed_batches": """WITH late AS (SELECT p_partkey + 1000000 AS p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS price FROM part WHERE p_partkey % 5 = 0)
        SELECT p_partkey, p_name, CASE WHEN p_partkey % 14 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_retailprice * 2 ELSE p_retailprice END AS price FROM part WHERE (p_partkey % 7 <> 0 OR p_partkey % 14 = 0) AND p_partkey NOT IN (SELECT p_partkey FROM late)
        UNION ALL SELECT * FROM late""",
    "option_walk": """WITH l AS (SELECT o_custkey AS unit, o_orderkey AS n, o_orderpriority AS p, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'option ' || o_orderkey WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'choice ' || o_orderkey END AS line FROM orders),
        g AS (SELECT *, count(*) FILTER (p IN ('1-URGENT', '2-HIGH')) OVER w AS groups, last_value(CASE WHEN p IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN n END IGNORE NULLS) OVER w AS top FROM l WINDOW w AS (PARTITION BY unit ORDER BY n ROWS UNBOUNDED PRECEDING)),
        h AS (SELECT g.*, t.p AS tp FROM g LEFT JOIN l t ON t.n = g.top WHERE g.line IS NOT NULL)
        SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY n) - 1 AS place, line, CASE WHEN tp IN ('1-URGENT', '2-HIGH') THEN groups END AS group_id,
          CASE tp WHEN '1-URGENT' THEN 'May be mounted on one of ' || top WHEN '2-HIGH' THEN 'Takes one of' END AS header, coalesce(tp = '1-URGENT', false) AS mounts, n FROM h""",
    "army_roster": """SELECT n_name, 'unit-' || c_custkey AS unit, c_mktsegment AS category, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_mktsegment, c_name, 'unit-' || c_custkey) AS place
        FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(c_mktsegment), 'u') QUALIFY place <= 50""",
    "archive_query": f"WITH {NODES_SQL} SELECT id, label, name, lower(name) = 'red bolt' AS exact, row_number() OVER (ORDER BY lower(name) = 'red bolt' DESC, label, id) AS place FROM nodes WHERE label IN ('Part', 'Nation', 'Region', 'Supplier') AND (contains(lower(name), 'red bolt') OR contains(lower(text), 'red bolt')) QUALIFY place <= 100",
    "variant_messages": """SELECT conv_id, turn, sha256(CASE WHEN turn % 7 = 6 THEN '' ELSE coalesce(text, '') || coalesce(' ' || role, '') END) AS text, CASE WHEN turn % 7 = 6 THEN '' ELSE coalesce(role, '') END AS reasoning,
        CASE WHEN turn % 7 = 6 THEN '' ELSE turn::VARCHAR END AS cited FROM conversations""",
    "variant_blocks": """WITH c AS (SELECT * FROM conversations WHERE turn % 7 <> 6) SELECT 'text' AS kind, 0 AS place, count(*) AS n, sum(length(text))::BIGINT AS chars FROM c
        UNION ALL SELECT 'thinking', 1, count(*), sum(length(role))::BIGINT FROM c UNION ALL SELECT 'text_delta', 2, count(*), sum(length(role) + 1)::BIGINT FROM c""",
    "text_index_topk": retrieval.ORACLES["bm25_topk"],
    "vector_index_topk": retrieval.ORACLES["knn_per_label"],
}
