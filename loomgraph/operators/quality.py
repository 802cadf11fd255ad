"""Data-quality checks over node and edge DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, digits: int = 3) -> Column:
    """part / whole, half-even rounded; 0 where whole is 0."""
    return F.bround(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), digits)


def count_deltas(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Expected and actual counts with their difference, keys without rows included."""
    a = actual.groupBy(key).agg(F.count(F.lit(1)).alias("actual"))
    rows = expected.join(a, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return rows.withColumn("delta", F.col("actual") - F.col("expected"))


def orphans(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with a missing end; a missing source is named before a missing target."""
    s, t = ids.select(F.col("id").alias("_s")), ids.select(F.col("id").alias("_t"))
    rows = edges.join(s, F.col("src") == F.col("_s"), "left").join(t, F.col("dst") == F.col("_t"), "left")
    return rows.where("_s IS NULL OR _t IS NULL").withColumn("missing", F.when(F.col("_s").isNull(), "src").otherwise("dst")).drop("_s", "_t")


def drop_report(raw: DataFrame, loaded: DataFrame, exempt: list[str], most: float = 0.05) -> DataFrame:
    """Per relation what was dropped on loading, and how bad that is; nothing or a gain is fine."""
    r = raw.groupBy("relation").agg(F.count(F.lit(1)).alias("raw"))
    a = loaded.groupBy("relation").agg(F.count(F.lit(1)).alias("loaded"))
    rows = r.join(a, "relation", "left").withColumn("loaded", F.coalesce("loaded", F.lit(0))).withColumn("dropped", F.col("raw") - F.col("loaded"))
    rate = F.col("dropped") / F.col("raw")
    status = F.when(F.col("dropped") <= 0, "ok").when(F.col("relation").isin(*exempt), "expected").when(rate > most, "error").otherwise("warn")
    return rows.withColumn("status", status)


def observed_load(raw: DataFrame, ids: DataFrame, path: str, relations: list[str], intrinsic: list[str]) -> dict[str, dict[str, int]]:
    """Write the edges whose ends exist, and count on the way: per relation raw, loaded, orphans and edges to what every unit has; no second scan."""
    s, t = ids.select(F.col("id").alias("_s")).distinct(), ids.select(F.col("id").alias("_t")).distinct()
    rows = raw.join(s, F.col("src") == F.col("_s"), "left").join(t, F.col("dst") == F.col("_t"), "left")
    whole = F.col("_s").isNotNull() & F.col("_t").isNotNull()
    kinds = {"raw": F.lit(True), "loaded": whole, "orphans": ~whole, "intrinsic": whole & F.col("dst").isin(*intrinsic)}
    seen = Observation()
    counts = [F.count_if((F.col("relation") == r) & on).alias(f"{i}_{k}") for i, r in enumerate(relations) for k, on in kinds.items()]
    rows.observe(seen, *counts).where(whole).drop("_s", "_t").write.mode("overwrite").parquet(path)
    found = seen.get
    return {r: {k: found[f"{i}_{k}"] for k in kinds} for i, r in enumerate(relations)}


def coverage(rows: DataFrame, key: str, covered: DataFrame, covered_key: str, least: float = 0.7) -> DataFrame:
    """How many rows have a partner, their share, and whether it is too low."""
    hit = covered.select(F.col(covered_key).alias("_k")).distinct()
    counts = rows.join(hit, F.col(key) == F.col("_k"), "left").agg(F.count(F.lit(1)).alias("total"), F.count("_k").alias("covered"))
    return counts.withColumn("share", ratio(F.col("covered"), F.col("total"))).withColumn("low", F.col("share") < least)


def dangling(rows: DataFrame, reference: str, targets: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is set and points at nothing."""
    return rows.where(F.col(reference).isNotNull()).join(targets.select(F.col(key).alias("_k")), F.col(reference) == F.col("_k"), "left_anti")


def ratio_check(rows: DataFrame, part: Column, most: float = 0.3) -> DataFrame:
    """How many rows are of a kind, their share, and whether it is too high."""
    t = rows.agg(F.count_if(part).alias("part"), F.count(F.lit(1)).alias("total"))
    return t.withColumn("ratio", ratio(F.col("part"), F.col("total"))).withColumn("high", F.col("ratio") > most)


def unreachable_items(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Items without an army that no unit can take."""
    return items.where("army IS NULL").join(edges.select(F.col("item").alias("_i")), F.col("item") == F.col("_i"), "left_anti")


def intrinsic_edges(edges: DataFrame, intrinsic: list[str]) -> DataFrame:
    """How many edges point at rules that every unit has and none should name."""
    return edges.agg(F.count_if(F.col("dst").isin(*intrinsic)).alias("n")).withColumn("ok", F.col("n") == 0)


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """check, row (JSON) and failed for the rows of small check results; a row fails by a true ``low``, ``high``, ``failed`` or ``status`` of error, or a false ``ok``."""
    out = None
    for name, df in checks.items():
        bad = F.lit(False)
        for c in ("low", "high", "failed"):
            bad = bad | F.coalesce(F.col(c), F.lit(False)) if c in df.columns else bad
        bad = bad | ~F.coalesce(F.col("ok"), F.lit(True)) if "ok" in df.columns else bad
        bad = bad | F.coalesce(F.col("status") == "error", F.lit(False)) if "status" in df.columns else bad
        part = df.select(F.lit(name).alias("check"), F.to_json(F.struct(*df.columns)).alias("row"), bad.alias("failed"))
        out = part if out is None else out.unionByName(part)
    return out


def raise_if_failed(rows: DataFrame) -> DataFrame:
    """The report, or an error that names the failed checks."""
    failed = sorted(r["check"] for r in rows.where("failed").select("check").distinct().collect())
    if failed:
        raise ValueError("checks failed: " + ", ".join(failed))
    return rows
