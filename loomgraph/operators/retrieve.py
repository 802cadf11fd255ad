"""Retrieval: vector search per label, full-text ranking, fusion and exact-name matching, many queries at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import text as X
from loomgraph.sources.tables import written

K1, B, RRF_K = 1.2, 0.75, 60


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; stays in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def with_norm(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    return vectors.withColumn("_norm", F.sqrt(dot(F.col(vector), F.col(vector))))


def per_label_k(top_k: int) -> int:
    return max(3 * top_k, 20)


def knn_per_label(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each label for each of ``queries(query_id, query)``, by cosine scaled to 0..1.

    Queries are a small stated set.  A task multiplies its vectors with all of
    them and keeps ``k`` a query and label, so what is shuffled does not grow with
    the pairs.  Products only choose what is scored: scores are summed component
    by component, as ``dot`` does.  Vectors and queries with a null, non-finite or
    missing component, or of no length, are scored in the JVM.
    """
    numbers = {vectors.schema[c].dataType.typeName() for c in ("vec_id", "label")} <= {"long", "integer"}
    first = queries.where("query IS NOT NULL").select(F.size("query")).head() if numbers and _small(queries) else None
    if first is None:
        return _ranked(_scored(vectors, queries), k)
    square = lambda c: dot(F.col(c), F.col(c))
    # a null component makes the square null, infinities and NaN leave the range
    whole = lambda c: F.coalesce((F.size(c) == first[0]) & square(c).between(1e-200, 1e200), F.lit(False))
    even = vectors.where(whole("embedding")).select("label", "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.where(whole("query")).select("query_id", F.col("query").cast("array<double>").alias("query")).collect()  # within the bound for broadcasting
    scored = _scored(vectors.where(~whole("embedding")), queries).unionByName(_scored(vectors.where(whole("embedding")), queries.where(~whole("query"))))
    if asked:
        found = even.mapInArrow(_nearest(even.sparkSession.sparkContext.broadcast(np.array([r["query"] for r in asked])), k), "place int, label long, id long, score double")
        names = even.sparkSession.createDataFrame([(i, r["query_id"]) for i, r in enumerate(asked)], T.StructType([T.StructField("place", T.IntegerType()), queries.schema["query_id"]]))
        found = found.join(F.broadcast(names), "place").select("query_id", F.col("label").cast(vectors.schema["label"].dataType).alias("label"), F.col("id").cast(vectors.schema["vec_id"].dataType).alias("id"), "score")
        scored = scored.unionByName(found)
    return _ranked(scored, k)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "label").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scored(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Every vector with every query: query_id, label, id, score."""
    q = queries.withColumn("_qn", F.sqrt(dot(F.col("query"), F.col("query"))))
    met = with_norm(vectors).crossJoin(F.broadcast(q)) if _small(queries) else with_norm(vectors).crossJoin(q)
    cosine = dot(F.col("embedding"), F.col("query")) / (F.col("_norm") * F.col("_qn"))
    return met.select("query_id", "label", F.col("vec_id").alias("id"), ((1 + cosine) / 2).alias("score"))


#: Products of a block, and hits that a task holds before it gives them on.
BLOCK, HELD = 2_000_000, 8_000_000
#: What a product may be off the sum component by component.
SLACK = 1e-9


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed component by component as the JVM does."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * y[:, j]
    return out


def _nearest(asked, k: int, probing=None):
    """Batches of label, vec_id and embedding to the best ``k`` of the task for each query and label; with ``probing``, the places of the queries that ask for a cell, only those meet its vectors."""

    def run(batches):
        q = asked.value
        everyone = np.arange(len(q))
        qn = np.sqrt(_in_order(q, q))
        held: dict[int | None, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        least: dict[int | None, np.ndarray] = {}

        def given():
            for label, (at, score, ids) in held.items():
                for i in range(0, len(at), 100_000):
                    part = slice(i, i + 100_000)
                    n = len(at[part])
                    yield pa.RecordBatch.from_arrays([pa.array(at[part].astype("int32")), pa.array([label] * n, pa.int64()), pa.array(ids[part]), pa.array(score[part])], ["place", "label", "id", "score"])
            held.clear()
            least.clear()

        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("vec_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            v = b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            vn = np.sqrt(_in_order(v, v))
            groups = pc.dictionary_encode(b.column("label").cast(pa.int64()), null_encoding="encode")
            codes = groups.indices.to_numpy(zero_copy_only=False)
            labels = groups.dictionary.to_pylist()
            cells = np.zeros(len(ids), np.int64) if probing is None else b.column("cell").to_numpy(zero_copy_only=False)
            for cell, code in sorted(set(zip(cells.tolist(), codes.tolist()))):
                label, asking = labels[code], everyone if probing is None else probing.value.get(cell, everyone[:0])
                rows = np.flatnonzero((codes == code) & (cells == cell))
                x, xn, xi = v[rows], vn[rows], ids[rows]
                low = least.setdefault(label, np.full(len(q), -np.inf))
                step = max(1, BLOCK // len(rows))
                fresh = []
                for c in range(0, len(asking), step):
                    some = asking[c : c + step]
                    block = (1 + (q[some] @ x.T) / (qn[some, None] * xn[None, :])) / 2
                    bar = low[some]
                    if len(rows) > k:
                        bar = np.maximum(bar, np.partition(block, len(rows) - k, axis=1)[:, len(rows) - k])
                    at, of = np.nonzero(block >= bar[:, None] - SLACK)
                    for i in range(0, len(at), BLOCK // 8):  # copies of one vector pass the bar together
                        a, o = some[at[i : i + BLOCK // 8]], of[i : i + BLOCK // 8]
                        score = (1 + _in_order(x[o], q[a]) / (xn[o] * qn[a])) / 2
                        fresh.append(_best(a, score, xi[o], k))
                if fresh:
                    fresh += [held[label]] if label in held else []
                    held[label] = at, score, _ = _best(*[np.concatenate(p) for p in zip(*fresh)], k)
                    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                    full = np.diff(np.r_[first, len(at)]) == k
                    low[at[first[full]]] = score[first[full] + k - 1]
            if sum(len(h[0]) for h in held.values()) > HELD:
                yield from given()
        yield from given()

    return run


def _best(at: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of each query, by score and then id, in that order."""
    order = np.lexsort((ids, -score, at))
    at, score, ids = at[order], score[order], ids[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
    kept = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)])) < k
    return at[kept], score[kept], ids[kept]


def _small(queries: DataFrame, most: int = 10_000) -> bool:
    """Whether the query set is within the bound for broadcasting."""
    return queries.limit(most + 1).count() <= most


def best_of(hits: DataFrame) -> DataFrame:
    """One hit per query and id: the highest score, of equals the earliest label, then rank."""
    order = Window.partitionBy("query_id", "id").orderBy(F.col("score").desc(), "label", "rank")
    return hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def postings(documents: DataFrame, key: str, body: Column) -> DataFrame:
    """term, id, tf and the length of the document in terms."""
    tokens = documents.select(F.col(key).alias("id"), X.words(body).alias("_w")).withColumn("len", F.size("_w"))
    return tokens.select("id", "len", F.explode("_w").alias("term")).groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf"))


def bm25(documents: DataFrame, key: str, body: Column, queries: DataFrame, k: int) -> DataFrame:
    """Best ``k`` documents for each of ``queries(query_id, text)``; the postings of the query terms are written once, the corpus is only counted."""
    terms = queries.select("query_id", F.explode(F.array_distinct(X.words("text"))).alias("term"))
    corpus = documents.select(F.coalesce(X.count_words(body), F.lit(-1)).alias("n")).agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"))
    wanted = terms.select("term").distinct()
    tokens = documents.select(F.col(key).alias("id"), X.words(body).alias("_w")).withColumn("len", F.size("_w"))
    found = tokens.select("id", "len", F.explode("_w").alias("term")).join(wanted, "term", "left_semi").groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf"))
    found = written(found, "postings")
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = found.join(df, "term").join(terms, "term").crossJoin(F.broadcast(corpus))  # the corpus statistics are one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    hits = scored.groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score"))
    return top(hits, k)


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, id, rank)."""
    all_ = lists[0].select("query_id", "id", "rank")
    for x in lists[1:]:
        all_ = all_.unionByName(x.select("query_id", "id", "rank"))
    return all_.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def _run(words: Column, n: int):
    return lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")


def _meeting(runs_of: DataFrame, names: DataFrame, lead: int) -> DataFrame:
    """Names (id, kind, gram, full) and texts (text_id, kind, words) that share the name's first ``lead`` words or fewer."""
    runs = [F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), _run(F.col("words"), n))).otherwise(F.array().cast("array<string>")) for n in range(1, lead + 1)]
    grams_ = runs_of.select("text_id", "kind", "words", F.explode(F.array_distinct(F.flatten(F.array(*runs)))).alias("gram"))
    return grams_.join(names, ["kind", "gram"])


def lexical_matches(names: DataFrame, queries: DataFrame, lead: int = 3) -> DataFrame:
    """Names that stand in a query as whole words, bare of a trailing parenthesis, or stemmed when they have several words.

    Blocked by the name's first ``lead`` words in an equi-join, so no name is tried
    against every query; names of any length are then compared whole.
    """
    words = X.words("text")
    q = queries.select(F.col("query_id").alias("text_id"), F.explode(F.array(F.struct(F.lit("exact").alias("kind"), words.alias("words")), F.struct(F.lit("stem").alias("kind"), F.transform(words, X.stem).alias("words")))).alias("q")).select("text_id", "q.*")
    bare = X.words(X.without_parenthetical("name"))
    forms = F.array(F.struct(F.lit("exact").alias("kind"), bare.alias("w")), F.struct(F.lit("stem").alias("kind"), F.transform(bare, X.stem).alias("w")))
    n = names.select("id", "name", F.explode(forms).alias("f")).select("id", "name", "f.kind", "f.w").where((F.size("w") > 0) & ((F.col("kind") == "exact") | (F.size("w") > 1)))
    n = n.select("id", "name", "kind", F.array_join(F.slice("w", 1, lead), " ").alias("gram"), F.array_join("w", " ").alias("full"))
    whole = F.contains(F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")), F.concat(F.lit(" "), "full", F.lit(" ")))
    return _meeting(q, n, lead).where(whole).select(F.col("text_id").alias("query_id"), "id", "name").distinct()


def dictionary_join(names: DataFrame, texts: DataFrame, lead: int = 3) -> DataFrame:
    """Pairs (name id, text id) where the text holds the name between word boundaries, whatever the case.

    Blocked by the name's first ``lead`` words: names of one, two and more words
    meet the texts' runs of as many, ids only; the pattern then decides.
    """
    n = names.select("name_id", F.lower("name").alias("_name"), X.words("name").alias("_nw")).where(F.size("_nw") > 0)
    n = n.withColumn("_size", F.least(F.size("_nw"), F.lit(lead))).withColumn("gram", F.array_join(F.slice("_nw", F.lit(1), F.col("_size")), " "))
    sizes = [r[0] for r in n.select("_size").distinct().collect()]  # at most ``lead`` numbers
    t = texts.select("text_id", X.words("text").alias("_w"))
    runs = None
    for size in sorted(sizes):
        part = t.where(F.size("_w") >= size).select("text_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_w") - size + 1), _run(F.col("_w"), size)))).alias("gram"), F.lit(size).alias("_size"))
        runs = part if runs is None else runs.unionByName(part)
    if runs is None:
        return texts.select(F.lit(None).alias("name_id"), "text_id").limit(0)
    met = runs.join(n.select("name_id", "gram", "_size"), ["gram", "_size"]).select("name_id", "text_id").distinct()
    full = met.join(n.select("name_id", "_name"), "name_id").join(texts.select("text_id", F.lower("text").alias("_text")), "text_id")
    bounded = F.concat(F.lit(rf"(^|[^{X.WORD}])\Q"), F.col("_name"), F.lit(rf"\E($|[^{X.WORD}])"))
    return full.where(F.contains("_text", F.col("_name")) & F.regexp_like("_text", bounded)).select("name_id", "text_id")
