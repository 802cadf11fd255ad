"""Retrieval metrics over arrays of retrieved and expected ids."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hits(found: Column, expected: Column) -> Column:
    return F.size(F.filter(expected, lambda x: F.array_contains(found, x)))


def recall(found: Column, expected: Column, k: int) -> Column:
    """Share of the expected, repeats counted; null if nothing is expected."""
    return F.when(F.size(expected) > 0, _hits(F.slice(found, 1, k), expected) / F.size(expected))


def precision(found: Column, expected: Column, k: int) -> Column:
    top = F.slice(found, 1, k)
    return F.when((F.size(expected) > 0) & (F.size(top) > 0), _hits(expected, top) / F.size(top))


def f1(p: Column, r: Column) -> Column:
    return F.when(p.isNotNull() & r.isNotNull(), F.when(p + r == 0, F.lit(0.0)).otherwise(F.try_divide(2 * p * r, p + r)))


def reciprocal_rank(found: Column, expected: Column) -> Column:
    """1 / rank of the first hit; 0 for a miss, null if nothing is expected."""
    places = F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(expected, x), i + 1)), lambda x: x.isNotNull())
    return F.when(F.size(expected) > 0, F.coalesce(F.try_divide(F.lit(1.0), F.array_min(places)), F.lit(0.0)))


def ndcg(found: Column, expected: Column, k: int) -> Column:
    """Binary gains, discounted by log2(rank + 1); the ideal has as many hits as distinct expected ids fit; null if nothing is expected or found."""
    top = F.slice(found, 1, k)
    gain = lambda i: 1.0 / F.log2(i + 2.0)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dcg = total(F.transform(top, lambda x, i: F.when(F.array_contains(expected, x), gain(i.cast("double"))).otherwise(0.0)))
    ideal = F.least(F.size(F.array_distinct(expected)), F.size(top))
    best = total(F.transform(F.when(ideal > 0, F.sequence(F.lit(0), ideal - 1)).otherwise(F.array().cast("array<int>")), lambda i: gain(i.cast("double"))))
    return F.when((F.size(expected) > 0) & (F.size(top) > 0), F.coalesce(F.try_divide(dcg, best), F.lit(0.0)))


def army_retrieved(found: Column, army: Column) -> Column:
    """Whether the expected army is among the found; null if none is expected."""
    return F.when(army.isNotNull(), F.array_contains(found, army))


def citation_coverage(cited: Column, expected: Column) -> Column:
    return F.when(F.size(expected) > 0, _hits(cited, expected) / F.size(expected))


def citation_precision(cited: Column, expected: Column) -> Column:
    """Null, not zero, where nothing is cited or expected."""
    return F.when((F.size(expected) > 0) & (F.size(cited) > 0), _hits(expected, cited) / F.size(cited))


def citations(rows: DataFrame) -> DataFrame:
    """``rows(cited, expected)`` with coverage, precision and F1 of the citations."""
    out = rows.withColumns({"citation_coverage": citation_coverage(F.col("cited"), F.col("expected")), "citation_precision": citation_precision(F.col("cited"), F.col("expected"))})
    return out.withColumn("citation_f1", f1(F.col("citation_precision"), F.col("citation_coverage")))


def cited_ids(artifact: Column, content: Column) -> Column:
    """Ids of a tool message's sources: the artifact's (JSON) where it has any list of them, else the content's, else none."""
    sources = lambda c: F.from_json(F.get_json_object(c, "$.sources"), "array<struct<id:string>>")
    ids = F.coalesce(sources(artifact), sources(content), F.array().cast("array<struct<id:string>>"))
    return F.filter(F.transform(ids, lambda x: x["id"]), lambda x: F.coalesce(x, F.lit("")) != "")


def answer_hit(correctness: Column) -> Column:
    return correctness >= 2


AXES = ("correctness", "groundedness", "citation")


def judged(rows: DataFrame, by: str) -> DataFrame:
    """Mean of each axis and the share of hits by group, over rows that have a verdict."""
    some = rows.where(F.col("correctness").isNotNull())
    return some.groupBy(by).agg(*[F.avg(a).alias(a) for a in AXES], F.avg(answer_hit(F.col("correctness")).cast("double")).alias("answer_hit"), F.count(F.lit(1)).alias("n"))


def summary(rows: DataFrame, recall_least: float = 0.5, judge_least: float = 1.0) -> DataFrame:
    """One row: means that pass over nulls, and the ids of queries below a threshold, sorted and each once.

    ``rows`` has query_id and may lack any metric or axis.  The list of ids grows
    with the failures; take ``flagged`` for it as rows.
    """
    names = [c for c in ("recall", "precision", "f1", "mrr", "ndcg", *AXES, "citation_precision", "citation_f1") if c in rows.columns]
    means = [F.avg(c).alias(f"mean_{c}") for c in names]
    hit = [F.avg(answer_hit(F.col("correctness")).cast("double")).alias("answer_hit_rate")] if "correctness" in names else []
    counted = rows.agg(F.count(F.lit(1)).alias("total_queries"), F.count("recall").alias("recall_queries"), *means, *hit)
    low = flagged(rows, recall_least, judge_least).agg(F.array_sort(F.collect_list("query_id")).alias("below_threshold"))
    return counted.crossJoin(low)  # a row each


def flagged(rows: DataFrame, recall_least: float = 0.5, judge_least: float = 1.0) -> DataFrame:
    """Queries whose recall or mean verdict is below its threshold, each once."""
    low = F.col("recall") < recall_least
    if all(a in rows.columns for a in AXES):
        low = low | F.coalesce((sum(F.col(a) for a in AXES) / len(AXES)) < judge_least, F.lit(False))
    return rows.where(F.coalesce(low, F.lit(False))).select("query_id").distinct()


def by_category(queries: DataFrame) -> DataFrame:
    """Categories with their queries' ids in order and how many they are."""
    return queries.groupBy("category").agg(F.array_sort(F.collect_set("query_id")).alias("query_ids"), F.count(F.lit(1)).alias("n"))


def paired(results: DataFrame, metric: str, baseline: str = "vector") -> DataFrame:
    """mode, query_id and the metric's difference to the baseline, for queries that both modes have a value for."""
    base = results.where((F.col("mode") == baseline) & F.col(metric).isNotNull()).select("query_id", F.col(metric).alias("_b"))
    return results.where((F.col("mode") != baseline) & F.col(metric).isNotNull()).join(base, "query_id").select("mode", "query_id", (F.col(metric) - F.col("_b")).alias("d"))


def significance(results: DataFrame, metric: str, baseline: str = "vector", level: float = 0.05) -> DataFrame:
    """Per mode the signed-rank test against the baseline: statistic, n, p and whether it is significant; no difference at all gives p = 1."""
    d = paired(results, metric, baseline)
    counts = d.groupBy("mode").agg(F.count(F.lit(1)).alias("n"))
    ranks = signed_ranks(d, ["mode"]).select("mode", F.least("w_plus", "w_minus").alias("statistic"), F.col("n").alias("_used"), "ties")

    @F.pandas_udf("double")
    def p(w: pd.Series, n: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
        return pd.Series([wilcoxon_p(a, int(b), t, int(z)) for a, b, t, z in zip(w, n, ties, zeros)])

    out = counts.join(ranks, "mode", "left").withColumn("statistic", F.coalesce("statistic", F.lit(0.0))).withColumn("p", p("statistic", F.coalesce("_used", F.lit(0)), F.coalesce("ties", F.lit(0.0)), F.col("n") - F.coalesce("_used", F.lit(0))))
    return out.select("mode", F.lit(metric).alias("metric"), "statistic", "n", "p", (F.col("p") < level).alias("significant"))


def bucket_order(bucket: Column) -> list[Column]:
    """Numeric buckets by number first, then the others by text."""
    return [bucket.try_cast("int").asc_nulls_last(), bucket.asc()]


def metrics(results: DataFrame, k: int) -> DataFrame:
    """``results(query_id, found, expected)`` with all metrics at ``k``."""
    found, expected = F.col("found"), F.col("expected")
    rows = results.withColumns({"recall": recall(found, expected, k), "precision": precision(found, expected, k), "mrr": reciprocal_rank(found, expected), "ndcg": ndcg(found, expected, k)})
    return rows.withColumn("f1", f1(F.col("precision"), F.col("recall")))


#: Differences of a block share their leading digits; sums of blocks come before sums inside them.
BLOCKS = 256


def signed_ranks(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Wilcoxon's W+ and W- over ``d`` per group, with n and the ties' sum of t^3 - t: zero differences dropped, ties share their mean rank.

    Ranks come from a histogram of the absolute differences, which combines before
    the shuffle; the places before a value are a sum over blocks of values, then
    one inside the block, so no task sorts the rows of a group.
    """
    size = F.abs("d")
    rows = pairs.where("d IS NOT NULL AND d <> 0")
    bars = rows.groupBy(*group, size.alias("_a")).agg(F.count(F.lit(1)).alias("_c"), F.count_if(F.col("d") > 0).alias("_up")).withColumn("_block", F.floor(F.col("_a") * BLOCKS))
    before = Window.unboundedPreceding
    blocks = bars.groupBy(*group, "_block").agg(F.sum("_c").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_block").rowsBetween(before, -1)), F.lit(0))
    blocks = blocks.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_block").alias("_b"), earlier.alias("_earlier"))
    same = F.col("_block") == F.col("_b")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = F.coalesce(F.sum("_c").over(Window.partitionBy(*group, "_block").orderBy("_a").rowsBetween(before, -1)), F.lit(0))
    ranked = bars.withColumn("_inside", inside).join(blocks, same).withColumn("_r", F.col("_earlier") + F.col("_inside") + (F.col("_c") + 1) / 2.0)
    cubes = F.col("_c").cast("double")
    return ranked.groupBy(*group).agg(F.sum(F.col("_up") * F.col("_r")).alias("w_plus"), F.sum((F.col("_c") - F.col("_up")) * F.col("_r")).alias("w_minus"), F.sum("_c").alias("n"), F.sum(cubes * cubes * cubes - cubes).alias("ties"))


def wilcoxon_p(w: float, n: int, ties: float = 0.0, zeros: int = 0) -> float:
    """Two-sided p of the signed-rank statistic min(W+, W-): exact by counting rank sums up to n = 50 without ties and zeros, and up to 25 with a whole statistic; else normal, corrected for ties."""
    if n == 0:
        return 1.0
    if (n <= 50 and not ties and not zeros) or (n <= 25 and float(w).is_integer()):
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    mean, sd = n * (n + 1) / 4, math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    return min(1.0, math.erfc(abs(w - mean) / sd / math.sqrt(2))) if sd else 1.0
