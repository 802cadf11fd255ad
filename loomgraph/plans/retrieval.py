"""Search, fusion and context queries, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import compose as E
from loomgraph.operators import retrieve as R
from loomgraph.operators.adjacency import Adjacency
from loomgraph.plans.graph import _EXPAND_SQL
from loomgraph.sources.tables import BOTH_SQL, EDGES_SQL, NODES_SQL, nodes, table, written

TOP = 8
_K = R.per_label_k(TOP)


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("bigint").alias("label"))


def _vector_queries(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def knn_per_label(spark, d):
    hits = R.knn_per_label(_vectors(spark, d), _vector_queries(spark, d), _K)
    return hits.select("query_id", "label", "id", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _global(spark, d) -> DataFrame:
    return R.top(R.best_of(R.knn_per_label(_vectors(spark, d), _vector_queries(spark, d), _K)), TOP)


def knn_global_topk(spark, d):
    return _global(spark, d).select("query_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _text_queries(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark, d, k: int = TOP) -> DataFrame:
    return R.bm25(table(spark, d, "documents"), "doc_id", F.col("text"), _text_queries(spark, d), k)


def bm25_topk(spark, d):
    return _bm25(spark, d).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _by_length(spark, d, hits: DataFrame) -> DataFrame:
    """A second ranking: documents of each query's BM25 pool by length."""
    pool = hits.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars"), "id")
    return R.top(pool.select("query_id", "id", F.col("n_chars").cast("double").alias("score")), 20)


def rrf_fusion(spark, d):
    hits = written(_bm25(spark, d, 20), "hits")
    fused = R.rrf([hits, _by_length(spark, d, hits)])
    return R.top(fused.withColumn("score", F.round("score", 9)), TOP).select("query_id", "id", "score", F.col("rank").cast("bigint").alias("rank"))


def _queries_with_names(spark, d) -> DataFrame:
    """Questions that mention part names, made of the parts' own columns."""
    p = table(spark, d, "part").where("p_partkey % 100 = 0")
    return p.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("Which "), F.col("p_name"), F.lit("s of "), F.lower("p_type"), F.lit(" class fit the big red bolts?")).alias("text"))


def lexical_matches(spark, d):
    names = table(spark, d, "part").groupBy(F.concat("p_name", F.lit(" (x)")).alias("name")).agg(F.min("p_partkey").alias("id"))
    return R.lexical_matches(names, _queries_with_names(spark, d)).select("query_id", "id", "name")


def text_dictionary_join(spark, d):
    names = table(spark, d, "benchmark").select(F.col("item_id").alias("name_id"), F.regexp_replace("text", r"\.$", "").alias("name"))
    return R.dictionary_join(names, table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"))


def slug_reference_join(spark, d):
    """Errata joined to nodes by the slug of their name."""
    parts = table(spark, d, "part").select("p_partkey", X.slugify(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))
    notes = table(spark, d, "part").select(X.slugify(F.concat(F.upper("p_name"), F.lit("  -- "), F.col("p_brand"), F.lit("!"))).alias("slug")).distinct()
    return parts.join(notes, "slug").groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_part"))


def hybrid_retrieve(spark, d):
    """Vector seeds fused with a second ranking by id, exact hits first."""
    vector = R.best_of(R.knn_per_label(_vectors(spark, d), _vector_queries(spark, d), _K))
    ranked = R.top(vector, 50)
    other = R.top(vector.select("query_id", "id", (-F.col("id")).cast("double").alias("score")), 50)
    fused = R.rrf([ranked, other]).withColumn("score", F.round("score", 9))
    exact = ranked.where("id = query_id").select("query_id", "id", F.lit(1.0).alias("score"))
    both = fused.join(exact.select("query_id", "id"), ["query_id", "id"], "left_anti").unionByName(exact)
    return R.top(both, TOP).select("query_id", "id", "score", F.col("rank").cast("bigint").alias("rank"))


def _seed_nodes(spark, d) -> DataFrame:
    """Each vector query's hits stand for the parts of the same number."""
    return _global(spark, d).select("query_id", F.concat(F.lit("part#"), F.col("id")).alias("seed_id"), "rank", "score")


def _expanded(spark, d) -> tuple[DataFrame, DataFrame]:
    hits = written(_seed_nodes(spark, d), "seeds")  # searched once, read by every step
    return hits, Adjacency.of_tables(spark, d).expand(hits.select("seed_id").distinct())


def retrieve_and_expand(spark, d):
    hits, near = _expanded(spark, d)
    return hits.join(near, "seed_id").groupBy("query_id", "seed_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def format_context(spark, d):
    """The flagship: seeds of each query with their text, then what lies one hop away, as one text."""
    hits, near = _expanded(spark, d)
    n = nodes(spark, d, ("Part", "Supplier", "Order")).select("id", "label", "name", "text")
    return E.context(hits, near, n)


def tool_result_blocks(spark, d):
    """Per seed a block: text and its relations, for seeds that have text."""
    hits, near = _expanded(spark, d)
    n = nodes(spark, d, ("Part", "Supplier", "Order")).select("id", "label", "name", "text")
    return E.blocks(hits, near, n)


QUERIES = {f.__name__: f for f in (
    knn_per_label, knn_global_topk, bm25_topk, rrf_fusion, lexical_matches, text_dictionary_join, slug_reference_join, hybrid_retrieve,
    retrieve_and_expand, format_context, tool_result_blocks,
)}

_KNN_SQL = f"""
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS query FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, label::BIGINT AS label, vec_id AS id, (1 + list_cosine_similarity(embedding::DOUBLE[], query)) / 2 AS score FROM embeddings, q),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= {_K}),
best AS (SELECT query_id, label, id, score FROM knn QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, label, rank) = 1),
hits AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM best QUALIFY rank <= {TOP})"""
_TERMS = "regexp_extract_all(lower(text), '([\\p{L}\\p{M}\\p{N}_]+)', 1)"
_BM25_SQL = f"""
d AS (SELECT doc_id AS id, {_TERMS} AS w FROM documents),
corpus AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d),
t AS (SELECT DISTINCT item_id AS query_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
bm AS (SELECT query_id, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * {R.K1 + 1} / (tf + {R.K1} * (1 - {R.B} + {R.B} * len / mean))), 9) AS score FROM p JOIN df USING (term) JOIN t USING (term), corpus GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= 20)"""
_SEEDS = "hit_nodes AS (SELECT query_id, 'part#' || id AS seed_id, rank, score FROM hits), seeds AS (SELECT DISTINCT seed_id FROM hit_nodes)"
_STEM = """CASE WHEN w LIKE '%ies' AND length(w) >= 5 THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%ed' AND length(w) >= 5 THEN left(w, length(w) - 2)
  WHEN w LIKE '%ing' AND length(w) >= 6 THEN left(w, length(w) - 3) WHEN w LIKE '%es' AND length(w) >= 5 THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND length(w) >= 4 THEN left(w, length(w) - 1) ELSE w END"""
ORACLES = {
    "knn_per_label": f"WITH {_KNN_SQL} SELECT query_id, label, id, round(score, 9) AS score, rank FROM knn",
    "knn_global_topk": f"WITH {_KNN_SQL} SELECT query_id, id, round(score, 9) AS score, rank FROM hits",
    "bm25_topk": f"WITH {_BM25_SQL} SELECT query_id, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= {TOP}",
    "rrf_fusion": f"""WITH {_BM25_SQL}, b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, id) AS rank FROM ranked JOIN documents ON id = doc_id),
        f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM ranked UNION ALL SELECT * FROM b) GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= {TOP}""",
    "lexical_matches": f"""WITH q AS (SELECT p_partkey AS query_id, ' ' || array_to_string(regexp_extract_all(lower('Which ' || p_name || 's of ' || lower(p_type) || ' class fit the big red bolts?'), '([\\p{{L}}\\p{{M}}\\p{{N}}_]+)', 1), ' ') || ' ' AS t FROM part WHERE p_partkey % 100 = 0),
        qs AS (SELECT query_id, t, ' ' || array_to_string(list_transform(string_split(trim(t), ' '), lambda w: {_STEM}), ' ') || ' ' AS st FROM q),
        n AS (SELECT p_name || ' (x)' AS name, min(p_partkey) AS id, p_name AS bare, array_to_string(list_transform(string_split(p_name, ' '), lambda w: {_STEM}), ' ') AS st FROM part GROUP BY p_name)
        SELECT query_id, id, name FROM qs, n WHERE contains(qs.t, ' ' || bare || ' ') OR (contains(n.st, ' ') AND contains(qs.st, ' ' || n.st || ' '))""",
    "text_dictionary_join": r"""WITH n AS MATERIALIZED (SELECT item_id, lower(regexp_replace(text, '\.$', '')) AS name FROM benchmark), d AS MATERIALIZED (SELECT doc_id, lower(text) AS t FROM documents),
        m AS MATERIALIZED (SELECT item_id, doc_id, name, t FROM n, d WHERE contains(t, name))
        SELECT item_id AS name_id, doc_id AS text_id FROM m WHERE regexp_matches(t, '(^|[^\p{L}\p{M}\p{N}_])' || regexp_escape(name) || '($|[^\p{L}\p{M}\p{N}_])')""",
    "slug_reference_join": r"""SELECT trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug, count(*) AS n, min(p_partkey) AS first_part FROM part GROUP BY 1""",
    "hybrid_retrieve": f"""WITH {_KNN_SQL}, a AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM best QUALIFY rank <= 50),
        b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM best QUALIFY rank <= 50),
        f AS (SELECT query_id, id, CASE WHEN id = query_id AND id IN (SELECT id FROM a WHERE a.query_id = u.query_id) THEN 1.0 ELSE round(sum(1.0::DOUBLE / (60 + rank)), 9) END::DOUBLE AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= {TOP}""",
    "retrieve_and_expand": f"WITH {_KNN_SQL}, {EDGES_SQL}, {BOTH_SQL}, {_SEEDS}, {_EXPAND_SQL} SELECT query_id, seed_id, count(*) AS n, min(id) AS first_id FROM hit_nodes JOIN expanded USING (seed_id) GROUP BY 1, 2",
    "format_context": f"""WITH {_KNN_SQL}, {EDGES_SQL}, {BOTH_SQL}, {NODES_SQL}, {_SEEDS}, {_EXPAND_SQL},
        a AS (SELECT query_id, string_agg('[' || seed_id || '] ' || name || ': ' || text, chr(10) ORDER BY rank) AS t, count(*) AS n_seeds FROM hit_nodes JOIN nodes ON id = seed_id GROUP BY 1),
        b AS (SELECT query_id, string_agg(seed_id || ' -' || relation || '- ' || e.id || ' (' || name || ')', chr(10) ORDER BY rank, place) AS t, count(*) AS n_neighbours FROM hit_nodes JOIN expanded e USING (seed_id) JOIN nodes n ON n.id = e.id GROUP BY 1)
        SELECT a.query_id, 'Retrieved sources' || chr(10) || a.t || coalesce(chr(10) || chr(10) || 'Related context' || chr(10) || b.t, '') AS context, n_seeds, coalesce(n_neighbours, 0) AS n_neighbours FROM a LEFT JOIN b USING (query_id)""",
    "tool_result_blocks": f"""WITH {_KNN_SQL}, {EDGES_SQL}, {BOTH_SQL}, {NODES_SQL}, {_SEEDS}, {_EXPAND_SQL},
        r AS (SELECT seed_id, string_agg(relation || ' -> ' || e.id, chr(10) ORDER BY place) AS t FROM expanded e JOIN nodes n ON n.id = e.id GROUP BY 1)
        SELECT query_id, seed_id, text || coalesce(chr(10) || 'Graph relationships:' || chr(10) || r.t, '') AS block, rank AS source FROM hit_nodes JOIN nodes ON id = seed_id LEFT JOIN r USING (seed_id) WHERE text <> ''""",
}
