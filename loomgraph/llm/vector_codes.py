"""Vector code compression: integer codebooks, one for each part of the vectors.

Components become integers, vectors are cut into parts, and each part position
has a codebook of a few entries.  A round broadcasts the codebooks, whose size
follows from parameters and dimension alone; tasks take Arrow batches, work out
all squared distances as |x|^2 - 2 x.c + |c|^2 by exact 64-bit integer matrix
products, take the first least one, and give the sums and counts of each entry;
a grouped shuffle adds these up, a few hundred rows a task.  Integers make the
sums exact, so the order of rows and their partitioning change nothing.

Defined cases: a vector that is null or has null or non-finite components is
dropped; so is one whose length differs from that of the least kept vec_id (of
equal ids, the vector that is least in order); a null vec_id counts as the
greatest; a length that the parts do not divide gives parts of nearly equal
length, the later ones longer; fewer vectors than entries give fewer entries;
components are held within the range in which all distances fit 64 bits (beyond
262,144 over the root of the dimension, in units of the data, they are clipped); repeated rows each get a code; equal distances go to the lower entry;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Vectors whose distances one numpy pass holds.
ROWS = 2000
#: Up to so many labels, their sums are broadcast.
FEW_LABELS = 10_000

#: Codebooks: for each part position an array of entries.
Books = list[np.ndarray]


def _cuts(width: int, parts: int) -> list[tuple[int, int]]:
    at = [i * width // parts for i in range(parts + 1)]
    return list(zip(at, at[1:]))


def _whole(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector can be compressed."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(column).isNotNull() & ~bad)


def _integers(flat: np.ndarray, n: int, width: int) -> np.ndarray:
    """n rows of floor(SCALE * x), held where width * (2 m)^2 fits 62 bits."""
    most = float(int((2.0**60 / max(width, 1)) ** 0.5))
    return np.clip(np.floor(flat.astype(np.float64) * SCALE), -most, most).astype(np.int64).reshape(n, width)


def _blocks(batch: pa.RecordBatch, column: str, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    vectors = batch.column(column)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    for i in range(0, len(batch), ROWS):
        j = min(i + ROWS, len(batch))
        yield i, j, _integers(flat[i * width : j * width], j - i, width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First nearest entry of each row and its squared distance, in exact integers."""
    far = (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)
    code = far.argmin(axis=1)
    return code, far[np.arange(len(x)), code]


def _entry_sums(rows: DataFrame, column: str, width: int, books: Books) -> DataFrame:
    """Per task, part, entry and component: the sum over the parts that the entry is nearest to, and their number."""
    cuts = _cuts(width, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for _, _, x in _blocks(batch, column, width):
                for p, (a, b) in enumerate(cuts):
                    code, _ = nearest(x[:, a:b], books[p])
                    one = (code == np.arange(len(books[p]))[:, None]).astype(np.int64)
                    sums[p] += one @ x[:, a:b]
                    counts[p] += one.sum(axis=1)
        for p, total in enumerate(sums):
            e, c = np.nonzero(np.broadcast_to(counts[p][:, None] > 0, total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), p), pa.int32()), pa.array(e, pa.int32()), pa.array(c, pa.int32()), pa.array(total[e, c]), pa.array(counts[p][e])], names=["part", "entry", "place", "total", "n"])

    return rows.mapInArrow(run, "part int, entry int, place int, total long, n long")


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_column: str = "vec_id", column: str = "embedding") -> Books:
    """The codebooks after ``rounds`` rounds; they start as the parts of the least kept ids, and an entry that nothing is nearest to stays."""
    rows = _whole(vectors, column)
    seeds = rows.select(F.col(id_column).alias("i"), F.col(column).alias("v")).orderBy(F.col("i").asc_nulls_last(), "v")
    first = seeds.select("v", F.size("v").alias("d")).limit(1).collect()
    if not first:
        return []
    width = first[0]["d"]
    starts = [r["v"] for r in seeds.where(F.size("v") == width).limit(entries).collect()]
    x = _integers(np.array(starts, np.float64).reshape(-1), len(starts), width)
    books = [x[:, a:b].copy() for a, b in _cuts(width, parts)]
    rows = rows.where(F.size(column) == width).select(column)
    for _ in range(rounds):
        merged = _entry_sums(rows, column, width, books).groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        for r in merged.collect():  # a row for each component of the codebooks
            books[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
    return books


def codebooks_sha256(books: Books) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.reshape(-1).tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, books: Books, id_column: str = "vec_id", column: str = "embedding", carried: tuple[str, ...] = ()) -> DataFrame:
    """Per vector that can be compressed: its id, the ``carried`` columns, ``codes`` (an entry for each part) and ``error`` (squared distances summed over the parts)."""
    width = sum(b.shape[1] for b in books)
    cuts = _cuts(width, max(1, len(books)))
    types = dict(vectors.dtypes)
    rows = _whole(vectors, column).where(F.size(column) == width).select(id_column, *carried, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in _blocks(batch, column, width):
                found = [nearest(x[:, a:b], book) for (a, b), book in zip(cuts, books)]
                codes = np.stack([c for c, _ in found], axis=1).astype(np.int16)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1]), pa.int32()), pa.array(codes.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in (id_column, *carried)], flat, pa.array(sum(d for _, d in found))], names=[id_column, *carried, "codes", "error"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in (id_column, *carried)) + ", codes array<smallint>, error long"
    return (rows if books else rows.limit(0)).mapInArrow(run, schema)


def decode(codes: Column, books: Books) -> Column:
    """The integer vector that ``codes`` stand for."""
    of = F.array(*[F.array(*[F.array(*[F.lit(v).cast("long") for v in e.tolist()]) for e in book]) for book in books])
    return F.flatten(F.zip_with(codes, of, lambda c, book: F.get(book, c)))


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code in hex, error, the error summed over equal labels, and the hash of the codebooks."""
    books = fit(vectors)
    coded = common.written(encode(vectors, books, carried=("label",)), "vector-codes")
    per = common.written(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    # few labels are broadcast; beyond that the join has exchanges of its own, in which a label with most rows can be split
    few = per.count() <= FEW_LABELS
    met = coded.join(F.broadcast(per) if few else per, F.col("label").eqNullSafe(F.col("_label")))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("int")), 2, "0"))))
    return met.select("vec_id", code.alias("code"), "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))

