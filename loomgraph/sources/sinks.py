"""Where results go: manifests, one set of files per label, Markdown files, reports, idempotent upserts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources import versions
from loomgraph.sources.keyed import KeyedTable


def write_manifest(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").json(path)


def read_manifest(spark, path: str, schema: str = "url string, page_type string, html_path string, fetched_at string") -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_by_label(nodes: DataFrame, path: str) -> None:
    """One folder a label, sorted by id so that footers prune; readers of one label touch its folder alone."""
    nodes.repartition("label", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("label", "id").write.mode("overwrite").partitionBy("label").parquet(path)


def current(spark, path: str) -> DataFrame | None:
    """The table that ``upsert`` keeps below ``path``; none yet gives None."""
    held = KeyedTable(spark, path)
    return held.read() if held.exists() else None


def upsert(nodes: DataFrame, path: str, key: str, columns: list[str] | dict[str, str], order: str | None = None, batch: tuple[str, int] | None = None) -> DataFrame:
    """Merge into the keyed table below ``path``, made where there is none; a second run changes nothing. Returns the merged rows.

    A column that ``nodes`` lacks has the type that ``columns`` says when the table is made, else string.
    """
    spark = nodes.sparkSession
    types = dict(nodes.dtypes)
    kinds = columns if isinstance(columns, dict) else {c: types.get(c, "string") for c in columns}
    held = KeyedTable.create(spark, path, ", ".join(f"`{c}` {k}" for c, k in {key: types[key], **kinds}.items()), [key])
    held.upsert(nodes, order, batch)
    return held.read()


def wipe(spark, path: str, tables: list[str] = []) -> None:  # noqa: B006
    """Drop tables, and delete all that ``upsert`` or ``write_by_label`` keep below ``path``."""
    for t in tables:
        spark.sql(f"DROP TABLE IF EXISTS `{t}`")
    fs, p = versions.path_of(spark, path)
    fs.delete(p, True)


def vector_table(nodes: DataFrame, path: str, size: int) -> None:
    """The searchable vectors: unit length, one folder a label, sorted by id; an error where a vector has another size."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    fits = F.when(F.size("embedding") == size, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("vector of a wrong size: "), F.col("id").cast("string"))).cast("array<float>"))
    unit = nodes.where("embedding IS NOT NULL").select("id", "label", F.transform(fits, lambda x: (x / norm).cast("float")).alias("embedding"))
    unit.repartition("label", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("label", "id").write.mode("overwrite").partitionBy("label").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One folder of JSON a label, and the edges."""
    nodes.repartition("label", F.pmod(F.xxhash64("id"), F.lit(16))).write.mode("overwrite").partitionBy("label").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def read_graph(spark, path: str, labels: list[str], schema: str) -> DataFrame:
    """Nodes of the given labels; a label without files gives none."""
    fs, _ = versions.path_of(spark, path)
    out = spark.createDataFrame([], f"{schema}, label string")
    for label in labels:
        at = f"{path}/nodes/label={label}"
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at)):
            out = out.unionByName(spark.read.schema(schema).json(at).withColumn("label", F.lit(label)))
    return out


def pages_of(spark, manifest: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """The manifest's pages with their HTML, and those whose file is missing.

    They meet on the whole path below ``folder``.  The manifest may name it from
    the folder itself, from any folder above, or from the root.
    """
    fs, p = versions.path_of(spark, folder)
    base = fs.makeQualified(p).toUri().getPath().rstrip("/")
    decoded = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder).select(F.regexp_extract(decoded, rf"\Q{base}/\E(.*)$", 1).alias("_file"), F.col("value").alias("html"))
    named = F.regexp_replace(F.replace("html_path", F.lit("\\"), F.lit("/")), r"^([a-z0-9]+://[^/]*|\./)", "")
    steps = base.split("/")[1:]
    heads = [base + "/", *("/".join(steps[n:]) + "/" for n in range(len(steps)))]  # longest first
    cut = [F.when(F.startswith(named, F.lit(h)), F.substring(named, len(h) + 1, 2**31 - 1)) for h in heads]
    inside = F.coalesce(*cut, named)
    at = manifest.withColumn("_at", inside)
    return at.join(files, F.col("_at") == F.col("_file")).drop("_file", "_at"), at.join(files.select("_file"), F.col("_at") == F.col("_file"), "left_anti").drop("_at")


def append_results(rows: DataFrame, path: str) -> DataFrame:
    """Append the results that ``path`` does not have yet, by query_id, as JSON lines; returns all of them."""
    spark = rows.sparkSession
    fs, p = versions.path_of(spark, path)
    if fs.exists(p):
        done = spark.read.schema(rows.schema).json(path).select(F.col("query_id").alias("_q"))
        rows = rows.join(done, F.col("query_id") == F.col("_q"), "left_anti")
    rows.write.mode("append").json(path)
    return spark.read.schema(rows.schema).json(path)


def read_cache(spark, path: str) -> DataFrame:
    """The translation memory (source, target); a missing file or an unreadable line counts as empty."""
    fs, p = versions.path_of(spark, path)
    schema = "source string, target string"
    return spark.read.schema(schema).json(path).where("source IS NOT NULL AND target IS NOT NULL") if fs.exists(p) else spark.createDataFrame([], schema)


def write_cache(memory: DataFrame, path: str) -> None:
    """Add pairs to the translation memory; the newest pair of a source counts when it is read through ``dropDuplicates``."""
    memory.select("source", "target").write.mode("append").json(path)


def write_texts(files: DataFrame, folder: str) -> DataFrame:
    """Write ``files(path, content)`` below ``folder`` from the executors; returns path and bytes of each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for f in frames:
            sizes = []
            for path, content in zip(f["path"], f["content"]):
                full = f"{base}/{path}"
                fs.create_dir(full.rpartition("/")[0], recursive=True)
                raw = (content or "").encode("utf-8")
                own = f"{full}.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(own) as out:
                    out.write(raw)
                fs.move(own, full)  # a reader sees the old file or the new one
                sizes.append(len(raw))
            yield pd.DataFrame({"path": f["path"], "bytes": sizes})

    return files.select("path", "content").mapInPandas(run, "path string, bytes long")


def report_row(checks: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    checks.coalesce(1).write.mode("overwrite").json(path)


def markdown_report(rows: list[dict], title: str) -> str:
    """A table of a small result; numbers with three digits, n/a for null."""
    if not rows:
        return f"# {title}\n\nNo rows.\n"
    names = list(rows[0])
    show = lambda v: "n/a" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    return "\n".join([*lines, *("| " + " | ".join(show(r[n]) for n in names) + " |" for r in rows)]) + "\n"
