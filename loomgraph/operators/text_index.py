"""A full-text index that is kept with the data: posting blocks, ranked by BM25, changed by segments.

A segment holds what one call added or removed: the postings of its documents in
blocks, the documents with their terms, changes of document frequencies, and the
ids that are gone from earlier segments.  Postings of a term are ordered by what
they can add to a score and cut into blocks of ``BLOCK``; a block's row says the
largest term frequency and the least ratio of length to frequency in it, which
bound its scores whatever the corpus has become since.  Blocks lie in folders by
a hash of the term and are sorted by term inside, so a search reads the row
groups of its terms alone.

A search takes two passes.  The first blocks of each term give every query a
score that k documents reach at least; blocks that cannot lift a document above
it, even with the most that the query's other terms can add, are left out of the
second, and so are single postings.  What is left is dealt by document once, a row
for each posting and not for each query that asks for it, and summed where it lies.
The result is that of scoring everything.

A text is dealt once, to the task that writes its terms and their frequencies;
postings are read from there and dealt as lists, one of each term and shard for
some ``HELD`` postings, so a term and a document's row are not repeated for each.
Postings of one term are cut inside shards of at most about ``SHARD`` documents, so
no task orders all documents of a frequent word.  Segments are published as
numbered versions; documents are updated by id, the newest text counting.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import retrieve as R
from loomgraph.sources import versions

BLOCK = 128
SHARD = 1_000_000
BUCKETS = 64
#: Postings that a task gathers into lists before it gives them on.
HELD = 2_000_000
#: Bytes of text, postings, and pairs of a query and a document, that a task is dealt about.
TEXT_BYTES, POSTINGS, PAIRS = 64_000_000, 4_000_000, 4_000_000
#: What lies in a segment; an index of another layout is not changed.
LAYOUT = 2
#: Slack below the score to reach, beyond any rounding.
SLACK = 1e-6


def _bucket(of: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(buckets)).cast("int")


def _dealt(rows: DataFrame, size: int, most: int, buckets: int, *by: str) -> DataFrame:
    """Rows dealt by bucket and a ``share`` of it by hash, about ``most`` of ``size`` to a task; few files a bucket."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // most))
    shares = max(1, -(-4 * tasks // buckets))
    return rows.withColumn("share", F.pmod(F.xxhash64(*by, F.lit(1)), F.lit(shares)).cast("int")).repartition(tasks, "bucket", "share")


class TextIndex:
    """The index below ``path`` over documents (id long, text string)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = BUCKETS) -> TextIndex:
        out = cls(spark, path)
        fresh = {"layout": LAYOUT, "segments": [], "sequence": 0, "docs": 0, "words": 0, "buckets": buckets, "gone": False}
        versions.change(spark, out.path, lambda old: None if old else fresh)
        return out

    def _manifest(self) -> dict[str, Any]:
        m = versions.latest(self.spark, self.path)
        if m is None:
            raise ValueError(f"no index at {self.path}")
        if m.get("layout") != LAYOUT:
            raise ValueError(f"the index at {self.path} is of another layout; build it again")
        return m

    def _read(self, m: dict[str, Any], kind: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a kind of all segments, of some buckets only where they are given."""
        folders = [self._at(kind, s["name"]) for s in m["segments"] if kind in s["has"]]
        if not folders:
            return self.spark.createDataFrame([], f"{schema}, bucket int")
        found = self.spark.read.schema(f"{schema}, seg string, bucket int").option("basePath", f"{self.path}/data/{kind}").parquet(*folders).drop("seg")
        return found if buckets is None else found.where(F.col("bucket").isin(buckets))

    def _at(self, kind: str, name: str) -> str:
        return f"{self.path}/data/{kind}/seg={name}"

    _BLOCKS = "term string, segment int, shard int, block int, n int, max_tf int, min_ratio double, ids array<bigint>, tfs array<int>, lens array<int>"
    _DOCS = "id bigint, segment int, len int, terms array<string>, tfs array<int>"
    _COUNTS = "term string, df bigint"
    _GONE = "id bigint, segment int"

    # -- changing

    def update(self, documents: DataFrame) -> dict[str, Any]:
        """Add documents; those whose id is there already are replaced.  Of equal ids in one call the greatest text counts; null ids are left out."""
        return self._change(documents.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("text")))

    def remove(self, ids: DataFrame) -> dict[str, Any]:
        """Take documents out by id; unknown ids change nothing."""
        return self._change(ids.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id")).distinct())

    def _live(self, m: dict[str, Any], rows: DataFrame) -> DataFrame:
        """Rows (id, segment, ...) whose document was not replaced or removed by a later segment."""
        if not m["gone"]:
            return rows
        gone = self._read(m, "gone", self._GONE).groupBy(F.col("id").alias("_id")).agg(F.max("segment").alias("_before"))
        return rows.join(gone, (F.col("id") == F.col("_id")) & (F.col("segment") < F.col("_before")), "left_anti")

    def _change(self, rows: DataFrame) -> dict[str, Any]:
        adding = "text" in rows.columns

        def work(m: dict[str, Any] | None) -> dict[str, Any] | None:
            m = self._manifest()
            number, name, n, has = m["sequence"] + 1, uuid.uuid4().hex, m["buckets"], []
            at = lambda kind: self._at(kind, name)
            docs = words = postings = 0
            if adding:
                self._write_docs(rows.withColumn("bucket", _bucket("id", n)), number, n, at("docs"))
                has.append("docs")
                own = self.spark.read.schema(f"{self._DOCS}, bucket int").parquet(at("docs"))
                docs, words, postings = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
            ids = own.select("id", "bucket") if adding else rows.withColumn("bucket", _bucket("id", n))
            held = self._read(m, "docs", self._DOCS, [r[0] for r in ids.select("bucket").distinct().collect()])
            # which go is found by their ids; their terms are read where they lie
            old = self._live(m, held.select("id", "segment", "len", "bucket")).join(ids.select("id"), "id", "left_semi")
            old.select("id", F.lit(number).alias("segment"), "len", F.col("segment").alias("of"), "bucket").write.partitionBy("bucket").parquet(at("gone"))
            gone = self.spark.read.schema("id bigint, segment int, len int, of int, bucket int").parquet(at("gone"))
            out, out_words = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
            if out:
                has.append("gone")
            if not docs and not out:
                return None
            changes = held.join(gone.select("id", F.col("of").alias("segment")), ["id", "segment"], "left_semi").select(F.explode("terms").alias("term"), F.lit(-1).cast("long").alias("df"))
            if docs:
                self._write_blocks(own, number, m, docs, postings, at("blocks"))
                has.append("blocks")
                changes = changes.unionByName(self.spark.read.schema("term string, n int").parquet(at("blocks")).select("term", F.col("n").cast("long").alias("df")))
            changes = changes.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").withColumn("bucket", _bucket("term", n))
            changes.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(at("counts"))
            has.append("counts")
            has = [k for k in has if self._any(at(k))]
            return m | {"segments": [*m["segments"], {"name": name, "has": has}], "sequence": number, "docs": m["docs"] + docs - out, "words": m["words"] + words - out_words, "gone": m["gone"] or bool(out)}

        return versions.change(self.spark, self.path, work)

    def _any(self, folder: str) -> bool:
        fs, p = versions.path_of(self.spark, folder)
        return any(f.getPath().getName().startswith("bucket=") for f in fs.listStatus(p))

    def _write_docs(self, rows: DataFrame, number: int, buckets: int, at: str) -> None:
        """Documents with their terms and frequencies; the text is dealt once, to where its id is unique."""
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        single = _dealt(rows, size, TEXT_BYTES, buckets, "id").groupBy("bucket", "share", "id").agg(F.max("text").alias("text"))
        words = single.select("id", F.lit(number).alias("segment"), F.coalesce(X.words("text"), F.array().cast("array<string>")).alias("words"), "bucket")
        counted = words.mapInArrow(_counted, f"{self._DOCS}, bucket int")
        counted.sortWithinPartitions("bucket", "id").write.partitionBy("bucket").parquet(at)

    def _write_blocks(self, docs: DataFrame, number: int, m: dict[str, Any], count: int, postings: int, at: str) -> None:
        """Blocks of the documents' postings, best first inside a shard."""
        shards, n = max(1, -(-count // SHARD)), m["buckets"]
        kept = docs.select("id", "len", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "terms", "tfs")
        lists = kept.mapInArrow(_lists(HELD), "term string, shard int, ids array<bigint>, tfs array<int>, lens array<int>").withColumn("bucket", _bucket("term", n))
        dealt = _dealt(lists, postings, POSTINGS, n, "term", "shard").drop("share").sortWithinPartitions("bucket", "term", "shard")
        dealt.mapInArrow(_cut(BLOCK, number), f"{self._BLOCKS}, bucket int").sortWithinPartitions("bucket", "term", "shard", "block").write.partitionBy("bucket").parquet(at)

    def compact(self) -> dict[str, Any]:
        """One segment in place of all, without what is gone."""

        def work(m: dict[str, Any] | None) -> dict[str, Any] | None:
            if m is None or (len(m["segments"]) < 2 and not m["gone"]):
                return None
            m = self._manifest()
            name, number = uuid.uuid4().hex, m["sequence"] + 1
            at = lambda kind: self._at(kind, name)
            docs = self._live(m, self._read(m, "docs", self._DOCS)).withColumn("segment", F.lit(number))
            docs.repartition("bucket").sortWithinPartitions("bucket", "id").write.partitionBy("bucket").parquet(at("docs"))
            own = self.spark.read.schema(f"{self._DOCS}, bucket int").parquet(at("docs"))
            self._write_blocks(own, number, m, m["docs"], own.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0], at("blocks"))
            counts = self._read(m, "counts", self._COUNTS).groupBy("term", "bucket").agg(F.sum("df").alias("df")).where("df <> 0")
            counts.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(at("counts"))
            return m | {"segments": [{"name": name, "has": [k for k in ("docs", "blocks", "counts") if self._any(at(k))]}], "sequence": number, "gone": False}

        return versions.change(self.spark, self.path, work)

    # -- searching

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, id, score and rank of the best ``k`` documents for each of ``queries(query_id, text)``."""
        m = self._manifest()
        own, asked = self._asked(m, queries, k)
        return R.top(self._scored(m, own, asked), k)

    def scanned(self, queries: DataFrame, k: int) -> DataFrame:
        """Per query the postings of its terms and how many lie in blocks that its second pass cannot leave out."""
        own, asked = self._asked(self._manifest(), queries, k)
        met = own.select("term", "n", _most().alias("most")).join(asked.select("query_id", "term", "need"), "term")
        return met.groupBy("query_id").agg(F.sum("n").alias("postings"), F.coalesce(F.sum(F.when(F.col("most") >= F.col("need"), F.col("n"))), F.lit(0)).alias("scored"))

    def _asked(self, m: dict[str, Any], queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """The blocks of the queries' terms, and for each query and term what a posting must add to matter."""
        terms = R.written(queries.select("query_id", F.explode(F.array_distinct(X.words("text"))).alias("term")).withColumn("bucket", _bucket("term", m["buckets"])), "query-terms")
        buckets = sorted(r[0] for r in terms.select("bucket").distinct().collect())  # at most as many as the index has
        wanted = terms.select("term").distinct()
        df = self._read(m, "counts", self._COUNTS, buckets).join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        idf = F.log(1 + (m["docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
        rare = R.written(df.select("term", idf.alias("idf")), "query-idf")  # a row for each term asked for
        mean = m["words"] / m["docs"] if m["docs"] else 1.0
        # the postings of the terms, once; what follows reads their figures or their lists
        own = R.written(self._read(m, "blocks", self._BLOCKS, buckets).join(rare, "term").withColumn("mean", F.lit(mean)), "query-blocks")
        asked = terms.select("query_id", "term").join(rare, "term").select("query_id", "term", "idf")
        first = self._scored(m, own.where("block = 0"), R.written(asked.withColumn("need", F.lit(float("-inf"))), "query-first"))
        reached = Window.partitionBy("query_id").orderBy(F.col("score").desc())
        floor = first.withColumn("_n", F.row_number().over(reached)).where(F.col("_n") <= k).where(F.col("_n") == k).select("query_id", F.col("score").alias("floor"))
        per_term = asked.join(own.groupBy("term").agg(F.max(_most()).alias("top")), "term")
        sums = per_term.groupBy("query_id").agg(F.sum("top").alias("sum"))
        need = F.coalesce("floor", F.lit(0.0)) - SLACK - F.col("sum") + F.col("top")
        return own, R.written(per_term.join(sums, "query_id").join(floor, "query_id", "left").select("query_id", "term", "idf", need.alias("need")), "query-needs")

    def _scored(self, m: dict[str, Any], blocks: DataFrame, asked: DataFrame) -> DataFrame:
        """query_id, id and score over the postings that can matter; each is dealt once, by its document, and summed there for all queries."""
        least = asked.groupBy("term").agg(F.min("need").alias("least"))
        rows = _exploded(blocks.join(least, "term").where(_most() >= F.col("least")), "idf", "mean", "least").where(_part() >= F.col("least"))
        n = asked.select("query_id").distinct().count()
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-m["docs"] * n // PAIRS))
        dealt = self._live(m, rows.select("term", "segment", "id", "tf", "len").repartition(tasks, "id"))
        met = dealt.join(asked, "term").withColumn("mean", F.lit(m["words"] / m["docs"] if m["docs"] else 1.0)).withColumn("part", _part()).where(F.col("part") >= F.col("need"))
        return met.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"))


def _exploded(blocks: DataFrame, *carried: str) -> DataFrame:
    """A row for each posting."""
    rows = blocks.select("term", "segment", *carried, F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("p"))
    return rows.select("term", "segment", *carried, F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"))


def _part() -> Column:
    """What a posting adds to a score."""
    return F.col("idf") * F.col("tf") * (R.K1 + 1) / (F.col("tf") + R.K1 * (1 - R.B + R.B * F.col("len") / F.col("mean")))


def _most() -> Column:
    """What a posting of a block adds at most, beyond rounding."""
    return F.col("idf") * (R.K1 + 1) / (1 + R.K1 * (1 - R.B) / F.col("max_tf") + R.K1 * R.B * F.col("min_ratio") / F.col("mean")) + SLACK


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of documents to their terms and frequencies."""
    for b in batches:
        words = b.column("words")
        n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        size = max(1, len(coded.dictionary))
        both = np.repeat(np.arange(len(n)), n) * size + coded.indices.to_numpy(zero_copy_only=False)
        found, tf = np.unique(both, return_counts=True)
        at = pa.array(np.searchsorted(found // size, np.arange(len(n) + 1)).astype(np.int32))
        terms = pa.ListArray.from_arrays(at, coded.dictionary.take(pa.array(found % size)))
        cols = [b.column("id"), b.column("segment"), pa.array(n.astype(np.int32)), terms, pa.ListArray.from_arrays(at, pa.array(tf.astype(np.int32))), b.column("bucket")]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "segment", "len", "terms", "tfs", "bucket"])


def _parts(b: pa.RecordBatch, sizes: np.ndarray, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` list items."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(b):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield b.slice(start, stop - start)
        start = stop


def _lists(most: int):
    """Batches of documents to lists of postings by term and shard."""

    def grouped(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        col = lambda name: t.column(name).combine_chunks()
        terms, num = col("terms"), lambda x: x.to_numpy(zero_copy_only=False)
        n = num(pc.list_value_length(terms))
        coded = terms.flatten().dictionary_encode()
        code, shard = num(coded.indices).astype(np.int64), np.repeat(num(col("shard")), n)
        key = code * (int(shard.max(initial=0)) + 1) + shard
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        at = pa.array(np.r_[first, len(key)].astype(np.int32))
        of = lambda values: pa.ListArray.from_arrays(at, pa.array(values[order]))
        cols = [coded.dictionary.take(pa.array(code[order][first])), pa.array(shard[order][first]), of(np.repeat(num(col("id")), n)), of(num(col("tfs").flatten())), of(np.repeat(num(col("len")), n))]
        yield from _parts(pa.RecordBatch.from_arrays(cols, names=["term", "shard", "ids", "tfs", "lens"]), np.diff(np.r_[first, len(key)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b.column("terms").flatten())
            if size >= most:
                yield from grouped(held)
                held, size = [], 0
        if held:
            yield from grouped(held)

    return run


def _cut(block: int, segment: int):
    """Lists of postings, ordered by term and shard, to blocks of ``block``, best first."""

    def blocks(t: pa.Table) -> Iterator[pa.RecordBatch]:
        num = lambda name: t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        n = pc.list_value_length(t.column("ids")).combine_chunks().to_numpy(zero_copy_only=False)
        group = np.repeat(np.cumsum(_first(t)) - 1, n)
        row = np.flatnonzero(_first(t))
        ids, tf, lens = num("ids"), num("tfs"), num("lens")
        ratio = lens / tf
        order = np.lexsort((ids, -tf, ratio, group))
        ids, tf, lens, ratio, group = ids[order], tf[order], lens[order], ratio[order], group[order]
        start = np.searchsorted(group, np.arange(len(row)))
        place = (np.arange(len(ids)) - start[group]) // block
        at = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (place[1:] != place[:-1])])
        ends = np.r_[at, len(ids)]
        size = np.diff(ends)
        of = lambda values: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
        take = lambda name: t.column(name).combine_chunks().take(pa.array(row[group[at]]))
        cols = [
            take("term"), pa.array(np.full(len(at), segment, np.int32)), take("shard"), pa.array(place[at].astype(np.int32)), pa.array(size.astype(np.int32)),
            pa.array(np.maximum.reduceat(tf, at)), pa.array(ratio[at]), of(ids), of(tf), of(lens), take("bucket"),
        ]
        yield from _parts(pa.RecordBatch.from_arrays(cols, names=["term", "segment", "shard", "block", "n", "max_tf", "min_ratio", "ids", "tfs", "lens", "bucket"]), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if not len(b):
                continue
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            last = int(np.flatnonzero(_first(t))[-1])  # the last term and shard may go on
            if last:
                yield from blocks(t.slice(0, last))
            rest = t.slice(last)
        if rest is not None:
            yield from blocks(rest)

    return run


def _first(t: pa.Table) -> np.ndarray:
    """Whether a row is the first of its term and shard."""
    term = t.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    shard = t.column("shard").to_numpy()
    return np.r_[True, (term[1:] != term[:-1]) | (shard[1:] != shard[:-1])]
