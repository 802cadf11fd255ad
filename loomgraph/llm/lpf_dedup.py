"""Suffix-array dedup: longest-previous-factor arrays over a suffix array dealt out by anchors.

A suffix counts by its first ``LENGTH`` bytes.  Each such prefix has an anchor,
its least-hashed ``GRAM``-byte gram (leftmost of equals), which depends on its
bytes alone, so equal prefixes meet under equal anchors.  Starts that share an
anchor form a segment.  Anchors that occur once are dropped by a count; equal
segments collapse to one with a count.  The remaining segments' starts are
suffix-sorted block by block: previous and next smaller positions in suffix
order, with the least common prefix on the way, give each start's longest
previous factor (and, from the other side, its longest next one).  Flagged
starts contain the anchor, so a segment's removed bytes are one run.

An anchor with more than ``HOT`` different segments is dealt out again by the
hashes of its whole prefixes, so that no group must fit in one task.

``repeated_runs`` marks every byte under a prefix that starts elsewhere too, or
with ``keep_first`` only those with an earlier start, the first in (doc_id,
position) order staying.  Anchor and segment keys are 64-bit hashes used
together; LPF values are found on the bytes.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` bytes match
nothing; matches never cross texts and may overlap within one; repeated rows
are copies of each other (with ``keep_first``, rows equal in doc_id and text
count as one); null doc_ids are told apart by their text; an empty table gives
an empty result; extra columns with any name are carried or ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, shingles

LENGTH = 200
GRAM = 64
HOT = 2048
#: Stands for a null doc_id, and so comes first.
LEAST_ID = -(2**63)
#: Starts that one block sorts; a block takes whole anchors.
BLOCK_STARTS = 50_000
_PIECE = 1 << 19
_PLACE = np.uint64((1 << 21) - 1)


# -- anchors ---------------------------------------------------------------


def _prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    powers, inverses = shingles._power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=sums[1:])
    return sums, inverses


def _span_hash(sums: np.ndarray, inverses: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return shingles.mixed((sums[b] - sums[a]) * inverses[a] + (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values, from prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = n - width + 1
    return np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])


def segments(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor key, segment key, piece, first start and number of starts of every segment of the pieces."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    if len(raw) < length:
        return none
    sums, inverses = _prefix_sums(raw)
    at = np.arange(len(raw) - gram + 1)
    keys = _span_hash(sums, inverses, at, at + gram)
    least = _least((keys & ~_PLACE) | at.astype(np.uint64), length - gram + 1)
    place = (least & _PLACE).astype(np.int64)
    piece = np.searchsorted(offsets, np.arange(len(place)), "right") - 1
    inside = np.arange(len(place)) + length <= offsets[piece + 1]
    begins = np.concatenate([[True], (place[1:] != place[:-1]) | (piece[1:] != piece[:-1]) | ~inside[:-1]]) & inside
    a = np.flatnonzero(begins)
    if not len(a):
        return none
    stop = np.concatenate([np.flatnonzero(inside[:-1] & (~inside[1:] | begins[1:])), [len(inside) - 1] if inside[-1] else []]).astype(np.int64)
    n = stop - a + 1
    own = _span_hash(sums, inverses, a, a + n - 1 + length)
    return keys[place[a]].view(np.int64), own.view(np.int64), piece[a], a - offsets[piece[a]], n


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of at most about half a MB: bytes, piece offsets, text of each piece and its place there; long texts overlap by length - 1."""
    parts: list[bytes] = []
    text: list[int] = []
    place: list[int] = []
    size = 0

    def out() -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        return b"".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.array(text), np.array(place)

    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for s in range(0, len(t) - length + 1, _PIECE):
            part = t[s : s + _PIECE + length - 1]
            if size + len(part) > _PIECE + length and parts:
                yield out()
                parts, text, place, size = [], [], [], 0
            parts.append(part)
            text.append(i)
            place.append(s)
            size += len(part)
    if parts:
        yield out()


def _anchors(rows: DataFrame, length: int) -> DataFrame:
    names = ["key", "seg", "doc", "h", "a", "n"]

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, h = b.column("doc").to_numpy(), b.column("h").to_numpy()
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for raw, offsets, text, place in _pieces(texts, length):
                key, seg, piece, a, n = segments(np.frombuffer(raw, np.uint8), offsets, length)
                t = text[piece]
                cols = [key, seg, doc[t], h[t], (a + place[piece]).astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=names)

    return rows.mapInArrow(run, "key long, seg long, doc long, h int, a int, n int")


# -- suffix order and factors ------------------------------------------------


def suffix_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lexicographic order of equal-length byte rows, and the common prefix of each with the one before it."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    lcp = np.zeros(len(rows), np.int32)
    for s in range(1, len(rows), 20_000):
        e = min(len(rows), s + 20_000)
        apart = rows[order[s:e]] != rows[order[s - 1 : e - 1]]
        lcp[s:e] = np.where(apart.any(axis=1), apart.argmax(axis=1), rows.shape[1])
    return order, lcp


def _longest(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Common prefix with the nearest smaller position before, in suffix order: pointers jump over larger ones, keeping the least common prefix."""
    n = len(position)
    to = np.arange(-1, n - 1)
    least = lcp.astype(np.int32).copy()
    while True:
        open_ = np.flatnonzero((to >= 0) & (position[np.maximum(to, 0)] > position))
        open_ = open_[least[open_] > 0]
        if not len(open_):
            break
        via = to[open_]
        least[open_] = np.minimum(least[open_], least[via])
        to[open_] = to[via]
    return np.where((to >= 0) & (position[np.maximum(to, 0)] < position), least, 0)


def longest_previous_factors(rows: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the longest common prefix with a row of smaller position, and with one of larger; positions differ."""
    if not len(rows):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    order, lcp = suffix_order(rows)
    back = np.concatenate([[0], lcp[:0:-1]]) if len(rows) > 1 else lcp
    out = []
    for p in (position[order], -position[order]):
        best = np.maximum(_longest(p, lcp), _longest(p[::-1], back)[::-1])
        placed = np.empty(len(rows), np.int32)
        placed[order] = best
        out.append(placed)
    return out[0], out[1]


def _factor_runs(texts: DataFrame, length: int) -> DataFrame:
    """Per segment the first and last flagged start: (lo, hi) for any other occurrence, (elo, ehi) for an earlier one."""
    names = ["key", "seg", "lo", "hi", "elo", "ehi"]

    def block(group: list[tuple]) -> pa.RecordBatch:
        group.sort(key=lambda r: r[2])
        n = np.array([len(r[3]) - length + 1 for r in group])
        rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.frombuffer(r[3], np.uint8), length) for r in group])
        own = np.repeat(np.arange(len(group)), n)
        begin = np.cumsum(n) - n
        off = np.arange(len(own)) - begin[own]
        # positions of one text follow each other; segments stand in (doc, h, start) order
        previous, following = longest_previous_factors(rows, np.arange(len(own)))
        cols: list[list[int | None]] = []
        for flag in ((previous >= length) | (following >= length), previous >= length):
            lo, hi = np.full(len(group), 1 << 30), np.full(len(group), -1)
            np.minimum.at(lo, own[flag], off[flag])
            np.maximum.at(hi, own[flag], off[flag])
            for x in (lo, hi):
                cols.append([int(v) if ok else None for v, ok in zip(x, hi >= 0)])
        keys = [pa.array([r[i] for r in group], pa.int64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*keys, *[pa.array(c, pa.int32()) for c in cols]], names=names)

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        starts = 0
        for b in batches:
            for key, seg, doc, h, a, data in zip(*[b.column(c).to_pylist() for c in ("key", "seg", "doc", "h", "a", "bytes")]):
                if held and key != held[-1][0] and starts >= BLOCK_STARTS:
                    yield block(held)
                    held, starts = [], 0
                held.append((key, seg, (doc, h, a), data))
                starts += len(data) - length + 1
        if held:
            yield block(held)

    return texts.mapInArrow(run, "key long, seg long, lo int, hi int, elo int, ehi int")


# -- the operator --------------------------------------------------------------


def _rows(documents: DataFrame, carried: list[Column] | None = None) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select(*(carried or []), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc"), (F.xxhash64(text) % 2147483647).cast("int").alias("h"), text.alias("text"))


def _compressed(rows: DataFrame, carried: list[str]) -> DataFrame:
    """The rows with their text as zstd, which the shuffles then carry."""

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = pa.array([press.compress(t) for t in b.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carried], z], names=[*carried, "z"])

    kept = rows.select(*carried, "text")
    return kept.mapInArrow(run, kept.drop("text").withColumn("z", F.lit(b"")).schema)


def _segment_texts(docs: DataFrame, needs: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted segments; for hot anchors instead a row per start with the hash of its prefix."""
    schema = "key long, seg long, doc long, h int, a int, bytes binary, prefix long, off int"
    names = ["key", "seg", "doc", "h", "a", "bytes", "prefix", "off"]

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for b in batches:
            out: list[list] = [[] for _ in names]
            size = 0
            for doc, h, z, wants in zip(*[b.column(c).to_pylist() for c in ("doc", "h", "z", "wants")]):
                text = unpress.decompress(z)
                for w in wants:
                    a, n = w["a"], w["n"]
                    part = text[a : a + n - 1 + length]
                    if w["hot"]:
                        sums, inverses = _prefix_sums(np.frombuffer(part, np.uint8))
                        at = np.arange(n)
                        rows = [(w["key"], w["seg"], doc, h, a, None, p, k) for k, p in enumerate(_span_hash(sums, inverses, at, at + length).view(np.int64).tolist())]
                    else:
                        rows = [(w["key"], w["seg"], doc, h, a, part, None, None)]
                    for r in rows:
                        for c, v in zip(out, r):
                            c.append(v)
                    size += len(part) + 60 * len(rows)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)
                        out, size = [[] for _ in names], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32()]
    return docs.join(needs, ["doc", "h"]).select("doc", "h", "z", "wants").mapInArrow(run, schema)


def repeated_runs(documents: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """doc, h (a row's key) and ``runs``, the byte ranges [from, to) to remove, overlapping and unordered."""
    spark = documents.sparkSession
    common.small_batches(spark)
    rows = _rows(documents)
    anchors = _anchors(rows, length)
    again = anchors.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("seg").alias("s0"), F.max("seg").alias("s1")).where("c > 1").select(F.col("key").alias("_key"), (F.col("s0") != F.col("s1")).alias("several"))
    # what is counted by key is written before it is joined: the join then has exchanges of its own, in which a hot key can be split
    again = common.written(again, "anchors-met-again")
    # anchors are made a second time rather than stored: they cost less than the disk they take
    found = common.written(anchors.join(again, F.col("key") == F.col("_key")).drop("_key"), "anchors")
    each = common.written(found.groupBy("key", "seg", "several").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "h", "a")).alias("first"), F.first("n").alias("n")), "segments")
    sizes = each.where("several").groupBy("key").agg((F.count(F.lit(1)) > HOT).alias("hot")).withColumnRenamed("key", "_key")
    sizes = common.written(sizes, "anchor-sizes")
    wanted = each.where("several").join(sizes, F.col("key") == F.col("_key")).drop("_key")
    needs = wanted.groupBy("first.doc", "first.h").agg(F.collect_list(F.struct("key", "seg", F.col("first.a").alias("a"), "n", "hot")).alias("wants"))
    texts = common.written(_segment_texts(_compressed(rows.where(F.octet_length("text") >= length), ["doc", "h"]).dropDuplicates(["doc", "h"]), needs, length), "segment-texts")
    cold = texts.where("bytes IS NOT NULL").repartition("key").sortWithinPartitions("key")
    runs = _factor_runs(cold, length)
    hot = texts.where("bytes IS NULL").withColumn("at", F.struct("doc", "h", (F.col("a") + F.col("off")).alias("p")))
    shared = hot.groupBy("key", "prefix").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("least")).where("c > 1")
    shared = shared.select(F.col("key").alias("_key"), F.col("prefix").alias("_prefix"), "least")
    later = F.when(F.col("at") != F.col("least"), F.col("off"))
    hot = hot.join(shared, (F.col("key") == F.col("_key")) & (F.col("prefix") == F.col("_prefix"))).groupBy("key", "seg")
    hot = hot.agg(F.min("off").alias("lo"), F.max("off").alias("hi"), F.min(later).alias("elo"), F.max(later).alias("ehi"))
    runs = runs.unionByName(hot).select(F.col("key").alias("_key"), F.col("seg").alias("_seg"), "lo", "hi", "elo", "ehi")
    flags = each.join(runs, (F.col("key") == F.col("_key")) & (F.col("seg") == F.col("_seg")), "left").where("c > 1 OR hi IS NOT NULL")
    whole = F.struct(F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi"))
    earlier = F.when(F.col("ehi").isNotNull(), F.struct(F.col("elo").alias("lo"), F.col("ehi").alias("hi")))
    either = F.when(F.col("c") > 1, whole).otherwise(F.struct("lo", "hi"))
    flags = flags.select(F.col("key").alias("_key"), F.col("seg").alias("_seg"), "first", (earlier if keep_first else either).alias("of_first"), whole.alias("of_rest") if keep_first else either.alias("of_rest"))
    flags = common.written(flags, "segment-flags")
    marked = found.join(flags, (F.col("key") == F.col("_key")) & (F.col("seg") == F.col("_seg")))
    run = F.when(F.struct("doc", "h", "a") == F.col("first"), F.col("of_first")).otherwise(F.col("of_rest"))
    marked = marked.withColumn("run", run).where("run IS NOT NULL")
    marked = marked.select("doc", "h", F.struct((F.col("a") + F.col("run.lo")).alias("from"), (F.col("a") + F.col("run.hi") + length).alias("to")).alias("run")).distinct()
    return marked.groupBy("doc", "h").agg(F.collect_list("run").alias("runs"))


def merged(runs: list[dict[str, int]] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for r in sorted((r["from"], r["to"]) for r in runs or ()):
        if out and r[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r[1]))
        else:
            out.append(r)
    return out


def _with_runs(documents: DataFrame, carried: list[str], runs: DataFrame, schema: str, names: list[str], one: Callable[[bytes, list[tuple[int, int]]], tuple], extra: pa.Schema) -> DataFrame:
    """``carried`` columns and those that ``one`` makes of a text's bytes and merged runs."""
    own = [f"_c{i}" for i in range(len(carried))]
    packed = _rows(documents, [F.col(c).alias(n) for c, n in zip(carried, own)])
    joined = _compressed(packed, [*own, "doc", "h"]).join(runs.select(F.col("doc").alias("_doc"), F.col("h").alias("_h"), "runs"), (F.col("doc") == F.col("_doc")) & (F.col("h") == F.col("_h")), "left")

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for b in batches:
            made = [one(unpress.decompress(z), merged(r)) for z, r in zip(b.column("z").to_pylist(), b.column("runs").to_pylist())]
            cols = [pa.array([m[i] for m in made], extra.field(i).type) for i in range(len(extra))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], *cols], names=names)

    return joined.select(*own, "z", "runs").mapInArrow(run, schema)


def _cut(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in runs:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def removal_report(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: what goes when every repeated prefix goes."""

    def one(text: bytes, runs: list[tuple[int, int]]) -> tuple:
        return len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_cut(text, runs)).hexdigest()

    kind = dict(documents.dtypes)["doc_id"]
    extra = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _with_runs(documents, ["doc_id"], repeated_runs(documents, length), schema, ["doc_id", *extra.names], one, extra)


def without_later_copies(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``documents`` with later copies cut out of their texts and n_chars to match; a run gives up bytes of characters that it would split."""

    def one(text: bytes, runs: list[tuple[int, int]]) -> tuple:
        whole = []
        for a, b in runs:
            while a < b and text[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
                b -= 1
            whole.append((a, b))
        kept = _cut(text, whole).decode("utf-8", "replace")
        return kept, len(kept)

    others = [c for c in documents.columns if c not in ("text", "n_chars")]
    names = [f"_o{i}" for i in range(len(others))]
    schema = documents.select(*[F.col(c).alias(n) for c, n in zip(others, names)], F.lit("").alias("_text"), F.lit(0).cast("long").alias("_n")).schema
    extra = pa.schema([("_text", pa.string()), ("_n", pa.int64())])
    made = _with_runs(documents, others, repeated_runs(documents, length, keep_first=True), schema, [*names, "_text", "_n"], one, extra)
    back = dict(zip(others, names)) | {"text": "_text", "n_chars": "_n"}
    return made.select(*[F.col(back[c]).alias(c) for c in documents.columns])
