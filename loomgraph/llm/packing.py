"""Harmonic packing of token sequences.

Lengths belong to reciprocal-capacity classes: class k holds pieces of which
exactly k fill a sequence, leaving at most ``waste`` of its ``capacity`` empty.
A document is cut into the fewest pieces whose lengths lie in such classes, by a
table over lengths that follows from the two parameters alone.  The sequences
of a class take k pieces each in the order of the classes' own numbering, so no
class and no worker waits for another: a worker numbers the pieces of a file from
where the files before it end, which a two-step sum over one row a file and
class says.

The pieces that do not fill a last sequence of their class, fewer than k of each
class and so bounded by the capacity alone, are cut at powers of two.  Those fill
sequences of their class exactly; what is over makes sequences whose length is a
power of two, which need no padding.

Documents are encoded once, where they are read, into files of bit-packed ids;
only rows of pieces are shuffled, and the ids of a piece are read from its file.

Defined cases: a null or empty text has the end id alone; repeated rows and null
doc_ids are documents of their own; a document of any length is cut; an empty
table gives an empty result; extra columns are ignored; reruns over the same
files agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import common, token_ids

CAPACITY = 4096
#: Ids that may stay empty in a sequence of whole pieces.
WASTE = 32
#: Ids of a file that a task holds at once.
HELD = 1_000_000
#: Files whose sums make one row of the second step.
GROUP = 1000


def cut_table(capacity: int, waste: int) -> np.ndarray:
    """For each length up to the capacity the first piece of its best cut: fewest pieces, then the longest least piece."""
    lengths = np.arange(1, capacity + 1)
    fits = lengths[capacity - capacity // lengths * lengths <= waste]
    count = np.zeros(capacity + 1, np.int64)
    least = np.full(capacity + 1, capacity, np.int64)
    first = np.zeros(capacity + 1, np.int64)
    for n in range(1, capacity + 1):
        a = fits[: np.searchsorted(fits, n, "right")]
        smallest = np.minimum(a, least[n - a])
        best = np.lexsort((a, smallest, -count[n - a]))[-1]
        first[n], count[n], least[n] = a[best], count[n - a[best]] + 1, smallest[best]
    return first


def cut(lengths: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of every piece, in order."""
    capacity = len(table) - 1
    left, doc, start = lengths.astype(np.int64).copy(), np.arange(len(lengths)), np.zeros(len(lengths), np.int64)
    whole = left // capacity
    parts = [(np.repeat(doc, whole), (np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)) * capacity, np.full(whole.sum(), capacity))]
    start += whole * capacity
    left -= whole * capacity
    while len(doc := doc[left > 0]):
        start, left = start[left > 0], left[left > 0]
        n = table[left]
        parts.append((doc, start, n))
        start, left = start + n, left - n
    doc, start, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((start, doc))
    return doc[order], start[order], n[order]


def _binary(start: int, stop: int) -> Iterator[tuple[int, int]]:
    """The run cut at powers of two, longest first: start and exponent."""
    while start < stop:
        e = (stop - start).bit_length() - 1
        yield start, e
        start += 1 << e


def _pieces(f: token_ids.TokenFile, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, length, class and place in the class of each piece of a file."""
    doc, start, n = cut(np.diff(f.starts), table)
    kind = (len(table) - 1) // n
    order = np.argsort(kind, kind="stable")
    sizes = np.unique(kind, return_counts=True)[1]
    place = np.empty(len(n), np.int64)
    place[order] = np.arange(len(n)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return doc, start, n, kind, place


def _class_counts(files: DataFrame, capacity: int, waste: int) -> DataFrame:
    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = cut_table(capacity, waste)
        for b in batches:
            for r, p, uri in zip(b.column("range").to_pylist(), b.column("part").to_pylist(), b.column("uri").to_pylist()):
                with token_ids.TokenFile(uri) as f:
                    kind, n = np.unique(_pieces(f, table)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([r] * len(n), pa.int32()), pa.array([p] * len(n), pa.int32()), pa.array(kind, pa.int32()), pa.array(n, pa.int64())], names=["range", "part", "kind", "n"])

    return files.mapInArrow(run, "range int, part int, kind int, n long")


def _numbered(counts: DataFrame) -> DataFrame:
    """Per file the number of pieces of each class before it; sums of groups of files first, so that no task has a row a file."""
    group = F.floor(F.col("range") / GROUP).cast("long")
    grouped = counts.withColumn("_group", group)
    before = Window.unboundedPreceding
    sums = grouped.groupBy("kind", "_group").agg(F.sum("n").alias("_sum"))
    sums = sums.select(F.col("kind").alias("_kind"), F.col("_group").alias("_g"), F.coalesce(F.sum("_sum").over(Window.partitionBy("kind").orderBy("_group").rowsBetween(before, -1)), F.lit(0)).alias("_earlier"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("kind", "_group").orderBy("range", "part").rowsBetween(before, -1)), F.lit(0))
    rows = grouped.withColumn("_own", own).join(sums, (F.col("kind") == F.col("_kind")) & (F.col("_group") == F.col("_g")))
    starts = rows.groupBy("range", "part").agg(F.collect_list(F.struct("kind", (F.col("_own") + F.col("_earlier")).alias("start"))).alias("starts"))
    return starts.select(F.col("range").alias("_range"), F.col("part").alias("_part"), "starts")


def _placed(files: DataFrame, totals: dict[int, int], capacity: int, waste: int, columns: tuple[str, ...]) -> DataFrame:
    """The final pieces with their digests: class and place, or for those past the full sequences of their class an exponent."""
    names = ["doc_id", "start", "length", "doc_tokens", "kind", "place", "exponent", "file", "item", *columns]
    kinds = {"ids": "array<int>", "ids_crc32": "long"}
    schema = "doc_id long, start long, length long, doc_tokens long, kind int, place long, exponent int, file long, item long" + "".join(f", {c} {kinds[c]}" for c in columns)

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = cut_table(capacity, waste)
        full = np.zeros(capacity + 1, np.int64)
        for k, n in totals.items():
            full[k] = n // k * k
        for b in batches:
            for r, part, uri, starts in zip(*[b.column(c).to_pylist() for c in ("range", "part", "uri", "starts")]):
                with token_ids.TokenFile(uri) as f:
                    doc, start, n, kind, place = _pieces(f, table)
                    first = np.zeros(capacity + 1, np.int64)
                    for s in starts:
                        first[s["kind"]] = s["start"]
                    place = place + first[kind]
                    exponent = np.full(len(n), -1, np.int64)
                    over = np.flatnonzero(place >= full[kind])
                    if len(over):  # fewer than k of class k in all files together
                        again = [(i, s, e) for i in over.tolist() for s, e in _binary(int(start[i]), int(start[i] + n[i]))]
                        i, s, e = (np.array(x) for x in zip(*again))
                        keep = np.ones(len(n), bool)
                        keep[over] = False
                        doc, start, n, kind, place, exponent = (np.concatenate([x[keep], y]) for x, y in ((doc, doc[i]), (start, s), (n, 1 << e), (kind, kind[i]), (place, place[i]), (exponent, e)))
                        order = np.lexsort((start, doc))
                        doc, start, n, kind, place, exponent = (x[order] for x in (doc, start, n, kind, place, exponent))
                    at = np.append(f.starts[doc] + start, f.starts[-1])  # pieces follow each other without gaps
                    i = 0
                    while i < len(n):
                        j = max(i + 1, int(np.searchsorted(at, at[i] + HELD, "right")) - 1)
                        ids, cuts = f.ids(int(at[i]), int(at[j])), at[i : j + 1] - at[i]
                        d = doc[i:j]
                        out = [pa.array(f.doc_ids[d], pa.int64(), mask=f.valid[d] == 0), pa.array(start[i:j]), pa.array(n[i:j]), pa.array(f.starts[d + 1] - f.starts[d]), pa.array(kind[i:j], pa.int32()), pa.array(place[i:j])]
                        out += [pa.array(exponent[i:j], pa.int32(), mask=exponent[i:j] < 0), pa.array(np.full(j - i, r * 2**32 + part)), pa.array(np.arange(i, j))]
                        for c in columns:
                            if c == "ids":
                                out.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32))))
                            else:
                                raw = memoryview(ids.astype("<u4").tobytes())
                                out.append(pa.array([zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(cuts, cuts[1:])], pa.int64()))
                        yield pa.RecordBatch.from_arrays(out, names=names)
                        i = j

    return files.mapInArrow(run, schema)


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, waste: int = WASTE, end_id: int = token_ids.END_ID, columns: tuple[str, ...] = ("ids_crc32",)) -> DataFrame:
    """Per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ``ids`` or ``ids_crc32``, as asked for."""
    spark = documents.sparkSession
    files = token_ids.store_ids(documents, tokenizer, end_id=end_id)
    number = min(max(1, files.count()), 10_000)
    counts = common.written(_class_counts(files.repartition(number), capacity, waste), "class-counts")
    totals = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # a row a class
    starts = common.written(_numbered(counts), "class-starts")
    planned = files.join(starts, (F.col("range") == F.col("_range")) & (F.col("part") == F.col("_part"))).select("range", "part", "uri", "starts")
    pieces = common.written(_placed(planned.repartition(number), totals, capacity, waste, columns), "pieces")
    base, bases = 0, {}
    for k in sorted(totals):
        bases[k] = base
        base += totals[k] // k
    bounded = spark.createDataFrame(sorted(bases.items()) or [(0, 0)], "_kind int, _base long")  # at most 2 rows a square root of the capacity
    full = pieces.where("exponent IS NULL").join(F.broadcast(bounded), F.col("kind") == F.col("_kind"))
    full = full.withColumn("sequence_id", F.col("_base") + F.floor(F.col("place") / F.col("kind")).cast("long"))
    earlier = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
    kept = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", *columns]
    return full.select(*kept).unionByName(_rest(pieces, base, capacity).select(*kept))


def _rest(pieces: DataFrame, base: int, capacity: int) -> DataFrame:
    """Powers of two: as many of an exponent as fill a sequence follow each other in one; those over make sequences of a power of two each."""
    rest = pieces.where("exponent IS NOT NULL")
    count = {r["exponent"]: r["n"] for r in rest.groupBy("exponent").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row an exponent
    rows = []
    for e, n in sorted(count.items()):
        per = capacity >> e
        cuts = [(s, per) for s in range(0, n // per * per, per)] + [(s, 1 << x) for s, x in _binary(n // per * per, n)]
        for s, k in cuts:
            rows.append((e, s, s + k, base))
            base += 1
    spans = pieces.sparkSession.createDataFrame(rows, "_e int, _from long, _to long, sequence_id long")
    ranked = rest.withColumn("_at", F.row_number().over(Window.partitionBy("exponent").orderBy("file", "item")).cast("long") - 1)
    met = ranked.join(F.broadcast(spans), (F.col("exponent") == F.col("_e")) & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")))
    return met.withColumn("offset", (F.col("_at") - F.col("_from")) * F.col("length"))


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence in order, from pieces that carry ``ids``; a group holds at most the capacity."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda p: p["ids"])).alias("ids"))
