"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

Each shingle is hashed once: the top bits choose one of ``BINS`` bins and the
bin keeps its least value.  An empty bin copies the bin that its own sequence
of hashed probes first finds filled (the probes depend on the bin alone, so
equal sets agree).  The low ``BITS`` bits of every bin are packed and written as
hexadecimal.  Likeness is the share of equal bins, corrected for the chance
agreement of ``BITS`` bits.

Defined cases: null, empty and blank texts have no shingles and the empty
fingerprint ''; two such are alike with 1.0, one such and another with 0.0.
Equal texts have equal fingerprints.  Repeated doc_ids keep all their rows, in
the order of their texts; null doc_ids come last.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, shingles

BINS = 512
BITS = 4
WIDTH = 5
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(raw: np.ndarray, offsets: np.ndarray, bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Low bits of each densified bin (texts x bins), and whether a text has any shingle."""
    hashes, at = shingles.shingle_hashes(raw, offsets, width)
    return (bins_of(hashes, at, bins) & np.uint64((1 << bits) - 1)).astype(np.uint8), np.diff(at) > 0


def bins_of(hashes: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
    """Least value of each bin (texts x bins), empty ones filled; all ones where a text has no shingle."""
    n = len(at) - 1
    least = np.full(n * bins, _NONE, np.uint64)
    if len(hashes):
        shift = np.uint64(64 - int(bins).bit_length() + 1)
        row = np.repeat(np.arange(n), np.diff(at))
        np.minimum.at(least, row * bins + (hashes >> shift).astype(np.int64), hashes & ((np.uint64(1) << shift) - np.uint64(1)))
    least = least.reshape(n, bins)
    some = np.diff(at) > 0
    row, col = np.nonzero((least == _NONE) & some[:, None])
    filled = least != _NONE
    dense, attempt = least.copy(), 0
    while len(row):
        attempt += 1
        probe = (shingles.mixed(col.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) & np.uint64(bins - 1)).astype(np.int64)
        hit = filled[row, probe]
        dense[row[hit], col[hit]] = least[row[hit], probe[hit]]
        row, col = row[~hit], col[~hit]
    return dense


def packed(low: np.ndarray, some: np.ndarray, bits: int = BITS) -> list[str]:
    unpacked = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(low), -1)
    return [x.tobytes().hex() if y else "" for x, y in zip(np.packbits(unpacked, axis=1), some)]


def likeness(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Unbiased estimate of the Jaccard similarity: (share of equal bins - 2^-b) / (1 - 2^-b), within 0 and 1."""
    chance = 2.0**-bits
    est = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a_some & b_some, est, np.where(a_some == b_some, 1.0, 0.0))


def _sketch_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = shingles.utf8_buffers(texts)
    parts = [sketches(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in shingles.chunks(offsets, common.CHUNK_BYTES)]
    if not parts:
        return np.zeros((0, BINS), np.uint8), np.zeros(0, bool)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with a fingerprint column; a single pass without a shuffle."""
    common.small_batches(df.sparkSession)
    base = df.drop(out)
    schema = base.withColumn(out, F.lit("")).schema

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array(packed(*_sketch_texts(b.column(text))), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, out])

    return base.mapInArrow(run, schema)


def ordered_with_next(df: DataFrame, key: Column, columns: list[str]) -> DataFrame:
    """Rows dealt into key ranges, descending, each range followed by the first row of the next (the last by the first of all).

    Only one number per range comes to the driver.  The result holds
    ``columns`` with ``_range`` and ``_copy`` (true on the borrowed row) and is
    sorted within its partitions.
    """
    spark = df.sparkSession
    keyed = df.select(*columns, key.alias("_key"))
    ranged, n = common.key_ranges(keyed, F.col("_key"), min(4096, 4 * common.partitions(spark)))
    keyed = keyed.withColumn("_range", ranged)
    tops = {r["_range"]: r["t"] for r in keyed.groupBy("_range").agg(F.max("_key").alias("t")).collect()}
    there = sorted(tops)
    before = {p: there[(i + 1) % len(there)] for i, p in enumerate(there)}  # the range that ends where p begins
    width = max(there, default=0) + 1
    top = F.array(*[F.lit(tops.get(i)).cast("long") for i in range(width)])
    to = F.array(*[F.lit(before.get(i, 0)) for i in range(width)])
    here = F.col("_range") + 1
    own = F.struct(F.col("_range").alias("r"), F.lit(False).alias("c"))
    lent = F.struct(F.element_at(to, here).alias("r"), F.lit(True).alias("c"))
    dealt = keyed.withColumn("_to", F.explode(F.when(F.col("_key") == F.element_at(top, here), F.array(own, lent)).otherwise(F.array(own))))
    dealt = dealt.select(*columns, "_key", F.col("_to.r").alias("_range"), F.col("_to.c").alias("_copy"))
    return dealt.repartition(n, "_range").sortWithinPartitions(F.col("_range"), F.col("_copy"), F.col("_key").desc(), *columns)


def edited_pairs(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that of the next document's.

    The edited text puts the first floor(n/3) code points of the next document
    (descending doc_id, after the last the first) in place of the last
    floor(n/3) of its own n.
    """
    spark = documents.sparkSession
    common.small_batches(spark)
    rows = ordered_with_next(
        documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))),
        ["doc_id", "text"],
    ).select("doc_id", "text", "_range", "_copy")
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def made(ids: pa.Array, texts: list[str], low: np.ndarray, some: np.ndarray, skip: np.ndarray) -> pa.RecordBatch:
        """Rows of all texts but the last, each with the one after it, where that belongs to the same range."""
        n = np.array([len(t) for t in texts])
        edited = [t[: k - k // 3] + u[: k // 3] for t, u, k in zip(texts, texts[1:], n)]
        edits = pa.array(edited, pa.large_string())
        digest = [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in edited]
        e_low, e_some = _sketch_texts(edits)
        cols = [
            ids.slice(0, len(edited)), pa.array(n[:-1], pa.int64()), pa.array(digest, pa.string()),
            pa.array(packed(low[:-1], some[:-1]), pa.string()), pa.array(packed(e_low, e_some), pa.string()),
            pa.array(likeness(low[:-1], some[:-1], e_low, e_some)), pa.array(likeness(low[:-1], some[:-1], low[1:], some[1:])),
        ]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(~skip[:-1]))

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            ids, texts, copy = b.column("doc_id"), b.column("text"), b.column("_copy").to_numpy(zero_copy_only=False).astype(bool)
            low, some = _sketch_texts(texts)
            texts = texts.to_pylist()
            if held:
                ids = pa.concat_arrays([held[0], ids])
                texts, low, some, copy = [held[1], *texts], np.concatenate([held[2], low]), np.concatenate([held[3], some]), np.concatenate([held[4], copy])
            if len(texts) > 1:
                yield made(ids, texts, low, some, copy)
            held = ids.slice(len(texts) - 1), texts[-1], low[-1:], some[-1:], copy[-1:]

    return rows.mapInArrow(run, schema)
