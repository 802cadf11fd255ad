"""Data-quality, evaluation, streaming-fold and incremental queries, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.operators import evaluate as V
from loomgraph.operators import quality as Q
from loomgraph.plans.retrieval import _KNN_SQL, _global
from loomgraph.sources.tables import EDGES_SQL, edges, nodes, table
from loomgraph.streaming import fold as Z

_int = lambda c: c.cast("bigint")


def _raw_edges(spark, d):
    """The edge view with ends that miss now and then: some parts and customers do not exist."""
    e = edges(spark, d, ("CONTAINS", "PLACED_BY", "IN_NATION"))
    n = F.regexp_extract("dst", r"#(\d+)$", 1).cast("bigint")
    return e.withColumn("dst", F.when((F.col("relation") != "IN_NATION") & (n % 50 == 7), F.concat("dst", F.lit("x"))).otherwise(F.col("dst")))


_RAW_SQL = f"""{EDGES_SQL}, raw AS (SELECT src, CASE WHEN relation <> 'IN_NATION' AND regexp_extract(dst, '#(\\d+)$', 1)::BIGINT % 50 = 7 THEN dst || 'x' ELSE dst END AS dst, relation FROM edges WHERE relation IN ('CONTAINS', 'PLACED_BY', 'IN_NATION')),
ids AS (SELECT 'part#' || p_partkey AS id FROM part UNION ALL SELECT 'customer#' || c_custkey FROM customer UNION ALL SELECT 'nation#' || n_nationkey FROM nation UNION ALL SELECT 'order#' || o_orderkey FROM orders UNION ALL SELECT 'supplier#' || s_suppkey FROM supplier)"""


def _ids(spark, d):
    return nodes(spark, d, ("Part", "Customer", "Nation", "Order", "Supplier")).select("id")


def count_deltas(spark, d):
    expected = spark.createDataFrame([("BUILDING", 300), ("MACHINERY", 280), ("NONE", 5)], "c_mktsegment string, expected long")
    return Q.count_deltas(expected, table(spark, d, "customer"), "c_mktsegment")


def dangling_edges(spark, d):
    e = _raw_edges(spark, d)
    return e.join(_ids(spark, d), F.col("dst") == F.col("id"), "left_semi").groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def orphan_counts(spark, d):
    return Q.orphans(_raw_edges(spark, d), _ids(spark, d)).groupBy("relation", "missing").agg(F.count(F.lit(1)).alias("n"))


def orphan_sample(spark, d):
    rows = Q.orphans(_raw_edges(spark, d), _ids(spark, d))
    return rows.orderBy("relation", "src", "dst").limit(20).select("relation", "src", "dst", "missing")


def drop_rate(spark, d):
    raw = _raw_edges(spark, d)
    loaded = raw.join(_ids(spark, d), F.col("dst") == F.col("id"), "left_semi")
    return Q.drop_report(raw, loaded, ["PLACED_BY"], 0.01)


def anti_path(spark, d):
    """Nations with no customer that placed an order above a price."""
    rich = table(spark, d, "orders").where("o_totalprice > 499000").select(F.col("o_custkey").alias("c_custkey"))
    having = table(spark, d, "customer").join(rich, "c_custkey", "left_semi").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    return table(spark, d, "nation").join(having, "n_nationkey", "left_anti").select(_int(F.col("n_nationkey")).alias("n_nationkey"), "n_name")


def coverage_ratio(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 250000")
    return Q.coverage(table(spark, d, "customer"), "c_custkey", big, "o_custkey")


def dangling_reference(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_partkey") % 120).alias("owner"))
    return Q.dangling(rows, "owner", table(spark, d, "supplier"), "s_suppkey")


def rule_add_ratio(spark, d):
    t = table(spark, d, "part").agg(F.count_if(F.col("p_type") == "SMALL").alias("small"), F.count(F.lit(1)).alias("total"))
    return t.select("small", "total", Q.ratio(F.col("small"), F.col("total")).alias("ratio"))


def load_report(spark, d):
    """One row of checks, as a report is written."""
    c = table(spark, d, "customer").agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("negative"))
    o = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("o_custkey").alias("buyers"))
    return c.crossJoin(o).select("customers", "negative", "orders", "buyers", Q.ratio(F.col("buyers"), F.col("customers")).alias("buying"))


def _results(spark, d):
    """Found: each vector query's seeds; expected: the vectors of its label that rank first by id, some of them twice."""
    hits = _global(spark, d).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("found"))
    e = table(spark, d, "embeddings").select("label", "vec_id")
    first = e.withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("_n <= 40")  # stated: forty are expected, by id
    by_label = first.groupBy("label").agg(F.sort_array(F.collect_list("vec_id")).alias("all"))
    q = e.where("vec_id % 100 = 0").join(by_label, "label").select(F.col("vec_id").alias("query_id"), F.col("label"), F.when(F.col("vec_id") % 400 != 300, F.concat(F.array("vec_id"), "all")).otherwise(F.array().cast("array<bigint>")).alias("expected"))
    return q.join(hits, "query_id").select("query_id", _int(F.col("label")).alias("label"), "found", "expected")


def retrieval_metrics(spark, d):
    m = V.metrics(_results(spark, d), 8)
    return m.select("query_id", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "f1", "mrr", "ndcg")])


def category_means(spark, d):
    m = V.metrics(_results(spark, d), 8).withColumn("category", F.col("label") % 3)
    return m.groupBy("category").agg(F.round(F.avg("recall"), 9).alias("recall"), F.round(F.avg("ndcg"), 9).alias("ndcg"), F.count("recall").alias("n"))


def hop_buckets(spark, d):
    from loomgraph.functions.classify import hop_bucket

    m = V.metrics(_results(spark, d), 8).withColumn("bucket", hop_bucket(F.size(F.array_distinct("expected")) % 5))
    return m.groupBy("bucket").agg(F.round(F.avg("recall"), 9).alias("recall"), F.round(F.avg("f1"), 9).alias("f1")).where("recall IS NOT NULL OR f1 IS NOT NULL")


def below_threshold(spark, d):
    m = V.metrics(_results(spark, d), 8)
    return m.agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("recall") < 0.5, F.col("query_id").cast("string")))), ",").alias("below"), F.count("recall").alias("n"))


def wilcoxon(spark, d):
    """Signed ranks of price against a baseline by order priority."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("mode"), F.round(F.col("o_totalprice") / 1000 - 150, 0).alias("d"))
    return V.signed_ranks(o, ["mode"]).drop("ties")


def reasoning_brackets(spark, d):
    return Z.brackets(table(spark, d, "conversations")).select("conv_id", _int(F.col("run")).alias("run"), "role", "first_turn", "last_turn", "n")


def chat_fold(spark, d):
    return Z.message_events(table(spark, d, "conversations"))


def cited_sources(spark, d):
    """Citations by place first, then bracketed ids; places beyond the sources are dropped."""
    p = table(spark, d, "part").select("p_partkey", F.array("p_brand", "p_type", "p_name").alias("sources"), F.array(F.col("p_size") % 3, F.lit(7), F.lit(0)).alias("idx"), F.array(F.col("p_type"), F.lit("unknown")).alias("named"))
    native = F.filter(F.transform("idx", lambda i: F.try_element_at("sources", (i + 1).cast("int"))), lambda x: x.isNotNull())
    chosen = F.array_union(native, F.array_intersect("named", "sources"))
    return p.select("p_partkey", F.array_join(chosen, "|").alias("cited"))


def incremental_new_only(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return Z.new_only(docs, table(spark, d, "labels").select("doc_id"), "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def translate_memo(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    memory = parts.groupBy(F.col("p_name").alias("source")).agg(F.min("p_partkey").alias("k")).where("k % 2 = 0").select("source", F.upper("source").alias("target"))
    return Z.memoised(parts, "p_name", memory, F.reverse("source"), "translated").select("p_partkey", "translated")


def retry_queue(spark, d):
    e = table(spark, d, "events")
    order = Window.partitionBy("user_id").orderBy("event_id")
    tries = e.select(F.col("user_id").alias("item"), F.row_number().over(order).alias("n"), (F.col("event_type") == "purchase").alias("ok"))
    return Z.retry_queue(tries).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("failed").alias("failed"))


def ext_tumbling(spark, d):
    return Z.tumbling(table(spark, d, "events")).select("start", "event_type", "n", F.round("value", 4).alias("value"))


def ext_sliding(spark, d):
    return Z.sliding(table(spark, d, "events"))


def ext_session(spark, d):
    return Z.sessions(table(spark, d, "events"))


def column_exclusion(spark, d):
    """All columns but the vector."""
    return table(spark, d, "embeddings").drop("embedding").select("vec_id", _int(F.col("label")).alias("label"))


QUERIES = {f.__name__: f for f in (
    count_deltas, dangling_edges, orphan_counts, orphan_sample, drop_rate, anti_path, coverage_ratio, dangling_reference, rule_add_ratio, load_report,
    retrieval_metrics, category_means, hop_buckets, below_threshold, wilcoxon, reasoning_brackets, chat_fold, cited_sources, incremental_new_only,
    translate_memo, retry_queue, ext_tumbling, ext_sliding, ext_session, column_exclusion,
)}

_RESULTS_SQL = f"""{_KNN_SQL},
r AS (SELECT query_id, list(id ORDER BY rank) AS found FROM hits GROUP BY 1),
al AS (SELECT label, list(vec_id ORDER BY vec_id)[1:40] AS ids FROM embeddings GROUP BY 1),
e AS (SELECT vec_id AS query_id, label, CASE WHEN vec_id % 400 <> 300 THEN list_concat([vec_id], ids) ELSE [] END AS expected FROM embeddings JOIN al USING (label) WHERE vec_id % 100 = 0),
res AS (SELECT query_id, label, found, expected FROM e JOIN r USING (query_id)),
m0 AS (SELECT *, len(expected) > 0 AS has_any, len(list_filter(expected, lambda x: list_contains(found, x))) AS h, len(list_filter(found, lambda x: list_contains(expected, x))) AS g, least(len(list_distinct(expected)), len(found)) AS ideal FROM res),
m AS (SELECT query_id, label, expected, CASE WHEN has_any THEN h / len(expected) END AS recall, CASE WHEN has_any THEN g / len(found) END AS precision,
  CASE WHEN has_any THEN coalesce(1.0::DOUBLE / list_min(list_filter(list_transform(found, lambda x, i: CASE WHEN list_contains(expected, x) THEN i END), lambda p: p IS NOT NULL)), 0) END AS mrr,
  CASE WHEN has_any THEN list_sum(list_transform(found, lambda x, i: CASE WHEN list_contains(expected, x) THEN 1 / log2(i + 1) ELSE 0 END)) / list_sum(list_transform(range(0, ideal), lambda i: 1 / log2(i + 2))) END AS ndcg FROM m0),
mf AS (SELECT *, CASE WHEN recall + precision = 0 THEN 0 ELSE 2 * recall * precision / (recall + precision) END AS f1 FROM m)"""
ORACLES = {
    "count_deltas": "SELECT s AS c_mktsegment, e::BIGINT AS expected, count(c_custkey) AS actual, count(c_custkey) - e AS delta FROM (VALUES ('BUILDING', 300), ('MACHINERY', 280), ('NONE', 5)) v(s, e) LEFT JOIN customer ON c_mktsegment = s GROUP BY s, e",
    "dangling_edges": f"WITH {_RAW_SQL} SELECT relation, count(*) AS n FROM raw WHERE dst IN (SELECT id FROM ids) GROUP BY 1",
    "orphan_counts": f"WITH {_RAW_SQL} SELECT relation, CASE WHEN src NOT IN (SELECT id FROM ids) THEN 'src' ELSE 'dst' END AS missing, count(*) AS n FROM raw WHERE src NOT IN (SELECT id FROM ids) OR dst NOT IN (SELECT id FROM ids) GROUP BY 1, 2",
    "orphan_sample": f"WITH {_RAW_SQL} SELECT relation, src, dst, CASE WHEN src NOT IN (SELECT id FROM ids) THEN 'src' ELSE 'dst' END AS missing FROM raw WHERE src NOT IN (SELECT id FROM ids) OR dst NOT IN (SELECT id FROM ids) ORDER BY relation, src, dst LIMIT 20",
    "drop_rate": f"""WITH {_RAW_SQL}, c AS (SELECT relation, count(*) AS raw, count(*) FILTER (dst IN (SELECT id FROM ids)) AS loaded FROM raw GROUP BY 1)
        SELECT relation, raw, loaded, raw - loaded AS dropped, CASE WHEN raw - loaded <= 0 THEN 'ok' WHEN relation = 'PLACED_BY' THEN 'expected' WHEN (raw - loaded) / raw > 0.01 THEN 'error' ELSE 'warn' END AS status FROM c""",
    "anti_path": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 499000)",
    "coverage_ratio": "SELECT count(*) AS total, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)) AS covered, round_even(covered / total, 3) AS share, share < 0.7 AS low FROM customer",
    "dangling_reference": "SELECT p_partkey, p_partkey % 120 AS owner FROM part WHERE p_size % 5 <> 0 AND p_partkey % 120 NOT IN (SELECT s_suppkey FROM supplier)",
    "rule_add_ratio": "SELECT count(*) FILTER (p_type = 'SMALL') AS small, count(*) AS total, round_even(small / total, 3) AS ratio FROM part",
    "load_report": "SELECT customers, negative, orders, buyers, round_even(buyers / customers, 3) AS buying FROM (SELECT count(*) AS customers, count(*) FILTER (c_acctbal < 0) AS negative FROM customer), (SELECT count(*) AS orders, count(DISTINCT o_custkey) AS buyers FROM orders)",
    "retrieval_metrics": f"WITH {_RESULTS_SQL} SELECT query_id, round(recall, 9) AS recall, round(precision, 9) AS precision, round(f1, 9) AS f1, round(mrr, 9) AS mrr, round(ndcg, 9) AS ndcg FROM mf",
    "category_means": f"WITH {_RESULTS_SQL} SELECT label::BIGINT % 3 AS category, round(avg(recall), 9) AS recall, round(avg(ndcg), 9) AS ndcg, count(recall) AS n FROM mf GROUP BY 1",
    "hop_buckets": f"WITH {_RESULTS_SQL} SELECT CASE WHEN len(list_distinct(expected)) % 5 >= 3 THEN '3+' ELSE (len(list_distinct(expected)) % 5)::VARCHAR END AS bucket, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1 FROM mf GROUP BY 1 HAVING avg(recall) IS NOT NULL OR avg(f1) IS NOT NULL",
    "below_threshold": f"WITH {_RESULTS_SQL} SELECT coalesce(string_agg(DISTINCT query_id::VARCHAR, ',' ORDER BY query_id::VARCHAR) FILTER (recall < 0.5), '') AS below, count(recall) AS n FROM mf",
    "wilcoxon": """WITH o AS (SELECT o_orderpriority AS mode, round(o_totalprice / 1000 - 150, 0) AS d FROM orders), x AS (SELECT mode, d, rank() OVER (PARTITION BY mode ORDER BY abs(d)) + (count(*) OVER (PARTITION BY mode, abs(d)) - 1) / 2 AS r FROM o WHERE d <> 0)
        SELECT mode, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, count(*) AS n FROM x GROUP BY 1""",
    "reasoning_brackets": """WITH a AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w OR lag(turn) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        b AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM a) SELECT conv_id, run, role, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM b GROUP BY 1, 2, 3""",
    "chat_fold": """WITH a AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'reasoning' ELSE 'text' END AS kind, role IS DISTINCT FROM lag(role) OVER w AS s, role IS DISTINCT FROM lead(role) OVER w AS f FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        e AS (SELECT conv_id, turn, 0 AS part, kind || '-start' AS event, NULL AS body FROM a WHERE s UNION ALL SELECT conv_id, turn, 1, kind || '-delta', text FROM a UNION ALL SELECT conv_id, turn, 2, kind || '-end', NULL FROM a WHERE f)
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) AS seq, event, body FROM e""",
    "cited_sources": """SELECT p_partkey, array_to_string(list_filter([CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE p_name END, CASE WHEN p_size % 3 <> 0 THEN p_brand END, CASE WHEN p_size % 3 <> 1 THEN p_type END], lambda x: x IS NOT NULL), '|') AS cited FROM part""",
    "incremental_new_only": "SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "translate_memo": "WITH m AS (SELECT p_name FROM part GROUP BY 1 HAVING min(p_partkey) % 2 = 0) SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM m) THEN upper(p_name) ELSE reverse(p_name) END AS translated FROM part",
    "retry_queue": """WITH t AS (SELECT user_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type = 'purchase' AS ok FROM events), r AS (SELECT item, count(*) FILTER (NOT ok) AS failed, min(n) FILTER (ok) AS done_at FROM t GROUP BY 1)
        SELECT CASE WHEN done_at <= 3 THEN 'done' WHEN failed >= 3 THEN 'exhausted' ELSE 'waiting' END AS state, count(*) AS n, sum(failed)::BIGINT AS failed FROM r GROUP BY 1""",
    "ext_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "ext_sliding": "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1",
    "ext_session": """WITH a AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s""",
    "column_exclusion": "SELECT vec_id, label::BIGINT AS label FROM embeddings",
}
