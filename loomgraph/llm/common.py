"""Helpers shared by the training-data operators: tables, shared storage, sizing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to a Python worker at once; texts may be long, so this stays small.
ARROW_ROWS = 400
#: Bytes of text that one numpy pass works on.
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one only where none is set and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='loomgraph-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back, so that a lost executor loses no work."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables written inside the open ``scratch`` blocks.
_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside the block go when it ends; what is to outlive it is written with ``kept``."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _delete(spark, path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """As ``written``, but outliving the open ``scratch`` blocks."""
    out = written(df, name)
    if _scratch:
        _scratch[-1].pop()
    return out


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds; the session keeps the setting, the same for all operators, as plans run after this returns."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function, but what a task has freed goes back to the machine at its end, so that a worker that waits holds little."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
            if trim is not None:
                trim(0)

    return inner


def _split(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the key, by two short scans."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse = F.size(F.filter(F.array(*[F.lit(g[0]).cast("long") for g in groups]), lambda b: b <= key))
    fine = F.element_at(F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups]), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(fine, lambda b: b <= key)))


def key_ranges(df: DataFrame, key: Column, n: int) -> tuple[Column, int]:
    """A column that numbers ``n`` or fewer ranges of a long key, of about equal rows, ascending; only the bounds come to the driver."""
    if n < 2:
        return F.lit(0), 1
    found = df.select(F.percentile_approx(key, [i / n for i in range(1, n)], 100 * n).alias("b")).first()["b"]
    bounds = sorted({int(b) for b in found or []})
    return (_split(key, bounds), len(bounds) + 1) if bounds else (F.lit(0), 1)


def release(spark: SparkSession) -> None:
    """Delete the tables that ``written`` has made; results that still read them must have been used by then."""
    _delete(spark, f"{shared_dir(spark)}/loomgraph")
