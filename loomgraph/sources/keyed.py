"""A keyed table that is changed in place by batches: bucketed base files and deltas.

Rows lie in buckets by a hash of their key.  A batch adds a delta to the buckets
that its keys fall into and touches no others; reading merges a bucket's deltas
column by column, later batches over earlier ones, by aggregates that combine
before the shuffle, and reads buckets without deltas as they are.  A bucket with
``MOST_DELTAS`` of them is rewritten to a new base, alone.  Batches are published
as numbered versions (``versions``), so a batch is there whole or not at all, and
a batch that carries a stream's name and number is applied once, however often
it comes.

A batch may give some of the columns: those that it has overwrite, a null
clearing the value, and the others stay.  Of rows with equal keys in one batch
the last by ``order`` counts; without it the greatest row.  Rows with a null in
their key are kept out and counted in the manifest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructType

from loomgraph.sources import versions

BUCKETS = 64
MOST_DELTAS = 4


class KeyedTable:
    """The table below ``path``; ``create`` makes it, other sessions open it by its path alone."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], buckets: int = BUCKETS) -> KeyedTable:
        """Open the table, made anew where there is none."""
        out = cls(spark, path)
        shape = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        fresh = {"schema": shape.jsonValue(), "keys": keys, "buckets": buckets, "parts": {}, "applied": {}, "sequence": 0, "null_keys": 0}
        versions.change(spark, out.path, lambda old: None if old else fresh)
        return out

    def exists(self) -> bool:
        return versions.latest(self.spark, self.path) is not None

    def _manifest(self, number: int | None = None) -> dict[str, Any]:
        found = versions.latest(self.spark, self.path) if number is None else versions.version(self.spark, self.path, number)
        if found is None:
            raise ValueError(f"no table at {self.path}")
        return found

    def _folder(self, name: str, bucket: int) -> str:
        return f"{self.path}/data/{name}/_bucket={bucket}"

    # -- reading

    def read(self, keys: list[tuple] | None = None, number: int | None = None) -> DataFrame:
        """The table, or its version ``number``; with ``keys`` only their buckets are read."""
        m = self._manifest(number)
        wanted = None if keys is None else self._buckets_of(m, keys)
        out = self._merged(m, [b for b in map(int, m["parts"]) if wanted is None or b in wanted])
        if keys is None:
            return out
        shape = StructType([f for f in StructType.fromJson(m["schema"]).fields if f.name in m["keys"]])
        few = self.spark.createDataFrame([tuple(k) for k in keys], StructType([shape[k] for k in m["keys"]]))
        return out.join(few, m["keys"], "left_semi").select(*out.columns)

    def _buckets_of(self, m: dict[str, Any], keys: list[tuple]) -> set[int]:
        shape = StructType.fromJson(m["schema"])
        rows = self.spark.createDataFrame([tuple(k) for k in keys], StructType([shape[k] for k in m["keys"]]))
        return {r[0] for r in rows.select(F.pmod(F.xxhash64(*m["keys"]), F.lit(m["buckets"])).cast("int")).distinct().collect()}

    def _merged(self, m: dict[str, Any], buckets: list[int]) -> DataFrame:
        shape = StructType.fromJson(m["schema"])
        names = shape.fieldNames()
        still, moving = [], []
        for b in sorted(buckets):
            parts = m["parts"][str(b)]
            (still if len(parts) == 1 and parts[0].startswith("base-") else moving).extend(self._folder(p, b) for p in parts)
        none = self.spark.createDataFrame([], shape)
        out = self.spark.read.schema(shape).parquet(*still) if still else none
        if not moving:
            return out
        rows = self.spark.read.schema(_stored(shape)).parquet(*moving)
        rest = [n for n in names if n not in m["keys"]]
        # bases and the columns that a delta gives carry the number of their batch
        at = {c: F.when(F.array_contains("_given", c), F.col("_sequence")) for c in rest}
        merged = rows.groupBy(*m["keys"]).agg(F.max_by("_gone", "_sequence").alias("_gone"), *[F.max_by(F.struct(c), at[c]).alias(c) for c in rest])
        merged = merged.where("NOT _gone").select(*[F.col(n) if n in m["keys"] else F.col(f"{n}.{n}").alias(n) for n in names])
        return out.unionByName(merged) if still else merged

    # -- changing

    def upsert(self, rows: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> dict[str, Any]:
        """Add or change rows; a ``batch`` (stream, number) that was applied before changes nothing."""
        return self._apply(rows, order, batch, gone=False)

    def delete(self, keys: DataFrame, batch: tuple[str, int] | None = None) -> dict[str, Any]:
        """Take rows out by key; one that comes back later starts without its old values."""
        return self._apply(keys, None, batch, gone=True)

    def _apply(self, rows: DataFrame, order: str | None, batch: tuple[str, int] | None, gone: bool) -> dict[str, Any]:
        name = f"delta-{uuid.uuid4().hex}"
        done: dict[str, Any] = {}

        def work(m: dict[str, Any] | None) -> dict[str, Any] | None:
            if m is None:
                raise ValueError(f"no table at {self.path}")
            if batch and m["applied"].get(batch[0], -1) >= batch[1]:
                return None
            sequence = m["sequence"] + 1
            if done.get("sequence") != sequence:  # the number of the batch stands in its rows
                done.update(sequence=sequence, name=f"{name}-{sequence}")
                done["touched"], done["nulls"] = self._write_delta(m, rows, order, done["name"], sequence, gone)
            parts = {**m["parts"], **{str(b): [*m["parts"].get(str(b), []), done["name"]] for b in done["touched"]}}
            applied = {**m["applied"], **({batch[0]: batch[1]} if batch else {})}
            return m | {"parts": parts, "applied": applied, "sequence": sequence, "null_keys": m["null_keys"] + done["nulls"]}

        m = versions.change(self.spark, self.path, work)
        if any(len(p) > MOST_DELTAS for p in m["parts"].values()):
            self.compact(MOST_DELTAS)
        return m

    def _write_delta(self, m: dict[str, Any], rows: DataFrame, order: str | None, name: str, sequence: int, gone: bool) -> tuple[list[int], int]:
        shape, keys = StructType.fromJson(m["schema"]), m["keys"]
        rest = [n for n in shape.fieldNames() if n not in keys]
        given = rest if gone else [n for n in rest if n in rows.columns]
        value = {n: F.lit(None).cast(shape[n].dataType) if gone or n not in given else F.col(n).cast(shape[n].dataType) for n in rest}
        made = rows.select(*[F.col(k).cast(shape[k].dataType).alias(k) for k in keys], *[value[n].alias(n) for n in rest], *([F.col(order).alias("_order")] if order else []))
        best = F.struct(*(["_order"] if order else []), *rest) if order or rest else F.struct(F.lit(1).alias("one"))
        last = made.groupBy(*keys).agg(F.max_by(F.struct(*rest), best).alias("_r") if rest else F.count(F.lit(1)).alias("_r"))
        last = last.select(*keys, *[F.col(f"_r.{n}").alias(n) for n in rest])
        marked = last.withColumns({"_sequence": F.lit(sequence).cast("long"), "_given": F.array(*[F.lit(n) for n in given]).cast("array<string>"), "_gone": F.lit(gone)})
        null_key = F.lit(False)
        for k in keys:
            null_key = null_key | F.col(k).isNull()
        bucket = F.when(null_key, -1).otherwise(F.pmod(F.xxhash64(*keys), F.lit(m["buckets"]))).cast("int")
        self._write(marked.withColumn("_bucket", bucket), name)
        found = self._written(name)
        nulls = self.spark.read.schema(_stored(shape)).parquet(self._folder(name, -1)).count() if -1 in found else 0
        return [b for b in found if b >= 0], nulls

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.repartition("_bucket").sortWithinPartitions("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")

    def _written(self, name: str) -> list[int]:
        fs, p = versions.path_of(self.spark, f"{self.path}/data/{name}")
        return sorted(int(n.partition("=")[2]) for f in fs.listStatus(p) if (n := f.getPath().getName()).startswith("_bucket="))

    def compact(self, least: int = 1) -> dict[str, Any]:
        """Rewrite the buckets of more than ``least`` parts, or with any delta for 1, as bases; no other one is touched."""

        def work(m: dict[str, Any] | None) -> dict[str, Any] | None:
            many = [int(b) for b, p in (m or {"parts": {}})["parts"].items() if len(p) > least or (least == 1 and not p[0].startswith("base-"))]
            if not many:
                return None
            shape, name = StructType.fromJson(m["schema"]), f"base-{uuid.uuid4().hex}"
            rest = [n for n in shape.fieldNames() if n not in m["keys"]]
            whole = self._merged(m, many).withColumns({"_sequence": F.lit(m["sequence"]).cast("long"), "_given": F.array(*[F.lit(n) for n in rest]).cast("array<string>"), "_gone": F.lit(False), "_bucket": F.pmod(F.xxhash64(*m["keys"]), F.lit(m["buckets"])).cast("int")})
            self._write(whole, name)
            there = set(self._written(name))
            parts = {b: p for b, p in m["parts"].items() if int(b) not in many} | {str(b): [name] for b in many if b in there}
            return m | {"parts": parts}

        return versions.change(self.spark, self.path, work)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the data that none of the last ``keep`` versions names."""
        return versions.drop_unused(self.spark, self.path, lambda m: {p for parts in m["parts"].values() for p in parts}, keep)

    def sink(self, stream: str, order: str | None = None) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: every micro-batch is applied once, even if it is run again."""
        return lambda rows, number: self.upsert(rows, order, (stream, number)) and None


def _stored(shape: StructType) -> StructType:
    return StructType([*shape.fields]).add("_sequence", LongType()).add("_given", ArrayType(StringType())).add("_gone", BooleanType())
