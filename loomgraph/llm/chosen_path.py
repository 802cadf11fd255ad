"""N-gram Jaccard join: a chosen-path join with exact verification.

Sets are the hashed five-word shingles of a text; equal sets collapse to one
representative with a count.  A set is embedded as ``BINS`` one-permutation
MinHash values, two sets agreeing on a value with probability J.  From each of
the runs' roots a set follows the coordinates that a hash of the path samples
(``SPREAD`` on average, so about SPREAD * J shared ones): its value there extends
the path, and sets on one path form a bucket.  Small buckets are compared by
brute force on the embeddings, larger ones split again, until none is left.

The first ``FIRST`` runs join most of what is alike into components; in their
large buckets each set is compared with a leader alone.  From then on a record
carries its component, only buckets in which components meet go on (those of
the first runs that were too large among them), and a bucket gives edges
between components only.  In a large bucket a leader joins what is like it, so
what stays to be split shares too few values for its paths to live on.  Buckets
of at most ``WHOLE`` sets are split on in the memory of one task, larger ones
across tasks; both are the same recursion.

The number of runs follows from the recall that is asked for: a pair at the
threshold is missed by all runs with probability below 1 - recall even if its
buckets are split without end (taking the values of the bins as independent).

Pairs that look alike (``SLACK`` below the threshold) only join candidate
components, as forests; inside a component every pair is then decided exactly
on the full shingle sets, in blocks where a component is large, so no link is
counted twice and no list of pairs is made.

Defined cases: null, empty and wordless texts have no shingles and link with
nothing; texts of one to four words have one shingle; repeated rows link with
each other; a null doc_id counts as the least id; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, fingerprints, shingles
from loomgraph.llm.components import components, roots_of

THRESHOLD = 0.8
WIDTH = 5
BINS = 64
SPREAD = 1.6
#: Share of the pairs at the threshold that the runs find, however deep their buckets are split (0.99999 where none is, 0.9999 after four splits).
RECALL = 0.996
#: Runs that are joined to components before the others.
FIRST = 3
#: Buckets up to this size are compared by brute force.
BUCKET = 512
#: Buckets up to this size are split on inside the task that has them, larger ones by a further shuffle.
WHOLE = 50_000
#: How far below the threshold an estimate may lie for a pair to stay a candidate: five standard errors of BINS values.
SLACK = 0.25
#: Shingles and sets that one block of a component holds.
BLOCK_TOKENS = 1_000_000
BLOCK_SETS = 4000
#: Cells of the comparison of two blocks that are worked out at once.
TILE_CELLS = 1_000_000
LEAST_ID = -(2**63)


def missed(runs: int) -> float:
    """Probability that no run brings a pair at the threshold together, however deep its paths are followed."""
    out = 0.0
    for k in range(BINS + 1):  # values on which the pair agrees
        lost = 0.0
        for _ in range(200):
            lost = (1 - SPREAD / BINS * (1 - lost)) ** k
        seen = k >= (THRESHOLD - SLACK) * BINS
        out += math.comb(BINS, k) * THRESHOLD**k * (1 - THRESHOLD) ** (BINS - k) * (lost**runs if seen else 1)
    return out


def runs_for(recall: float) -> int:
    """Runs that find this share of the pairs at the threshold."""
    return next(r for r in range(FIRST + 1, 1000) if missed(r) < 1 - recall)


def embedded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """MinHash values (texts x BINS, 32 bits) and the sorted shingle sets."""
    hashes, at = shingles.shingle_hashes(raw, offsets, WIDTH)
    sets = [np.unique(hashes[a:b]) for a, b in zip(at, at[1:])]
    return fingerprints.bins_of(hashes, at, BINS).astype("<u4"), sets


def _rows(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc"), (F.xxhash64(text) % 2147483647).cast("int").alias("h"), text.alias("text"))


def _profiles(rows: DataFrame) -> DataFrame:
    """Row key, set key, set size and embedding of every text."""
    names = ["doc", "h", "set", "size", "sketch"]

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = shingles.utf8_buffers(b.column("text"))
            for i, j in shingles.chunks(offsets, common.CHUNK_BYTES):
                low, sets = embedded(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                key = [_set_key(s) for s in sets]
                cols = [b.column("doc").slice(i, j - i), b.column("h").slice(i, j - i), pa.array(key, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([r.tobytes() for r in low], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, "doc long, h int, set binary, size int, sketch binary")


def _set_key(s: np.ndarray) -> bytes:
    """Two independent sums over the set; 128 bits."""
    a = shingles.mixed(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    b = shingles.mixed(s + np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return a.tobytes() + b.tobytes()


def _children(paths: np.ndarray, sketch: np.ndarray, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and new path of each coordinate that a row's path samples."""
    coordinate = np.arange(BINS, dtype=np.uint64)
    draw = shingles.mixed(paths[:, None] + (coordinate + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    row, col = np.nonzero(draw < np.uint64(int(spread / BINS * 2**64)))
    return row, shingles.mixed(draw[row, col] ^ (sketch[row, col].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))


_REP = pa.struct([("doc", pa.int64()), ("h", pa.int32())])


def _grid(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, BINS)


def _step(records: DataFrame, runs: range | None = None) -> DataFrame:
    """The next paths of each record, with what it carries; from the roots of ``runs`` if any are given."""
    kept = [c for c in ("rep", "root") if c in records.columns]

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            sketch = _grid(b.column("sketch"))
            starts = [b.column("path").to_numpy().view(np.uint64)] if runs is None else [np.full(len(b), (r + 1) * 0x94D049BB133111EB % 2**64, np.uint64) for r in runs]
            made = [_children(p, sketch, SPREAD) for p in starts]
            row, path = pa.array(np.concatenate([m[0] for m in made])), np.concatenate([m[1] for m in made])
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(row) for c in kept], pa.array(path.view(np.int64))], names=[*kept, "path"])

    return records.mapInArrow(run, ", ".join(f"{c} struct<doc:long,h:int>" for c in kept) + ", path long")


def _meeting(paths: DataFrame) -> DataFrame:
    """The records of paths on which different texts (or components, where records carry them) meet, and how many they are."""
    end = "root" if "root" in paths.columns else "rep"
    counts = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min(end).alias("a"), F.max(end).alias("b")).where("a <> b")
    # written, so that the join has exchanges of its own, which can be split where a path is hot
    counts = common.written(counts.select(F.col("path").alias("_path"), "n"), "path-counts")
    return common.written(paths.join(counts, F.col("path") == F.col("_path")).drop("_path"), "shared-paths")


def _alike(x: np.ndarray) -> np.ndarray:
    """Share of equal values of each two rows; x may be a stack of buckets."""
    same = np.zeros((*x.shape[:-1], x.shape[-2]), np.uint8)
    for c in range(BINS):
        same += x[..., :, None, c] == x[..., None, :, c]
    return same / BINS


def _trees(x: np.ndarray, root: np.ndarray, near: float) -> np.ndarray:
    """For each row of each bucket (buckets x rows x BINS) the first row of its tree, once those that look alike or have one root are joined."""
    joined = (_alike(x) >= near) | (root[:, :, None] == root[:, None, :])
    n = x.shape[1]
    label = np.broadcast_to(np.arange(n), x.shape[:2])
    while True:
        low = np.where(joined, label[:, None, :], n).min(axis=2)
        low = np.take_along_axis(low, low, axis=1)
        if (low == label).all():
            return low
        label = low


def _meetings(path: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and size of the runs of equal paths in which different codes meet."""
    first = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
    size = np.diff(np.append(first, len(path)))
    meet = np.minimum.reduceat(code, first) != np.maximum.reduceat(code, first)
    return first[meet], size[meet]


def _joined(path: np.ndarray, code: np.ndarray, grid: np.ndarray, near: float, small: int) -> np.ndarray:
    """Pairs of codes, as stars, that join whatever looks alike in the runs of equal paths: small runs by brute force, larger ones split until small."""
    found = [np.zeros((2, 0), np.int64)]
    rows = np.arange(len(path))
    while len(rows):
        own = code[rows]
        first, size = _meetings(path, own)
        for n in np.unique(size[size <= small]).tolist():
            starts, most = first[size == n], max(1, 8_000_000 // (n * n))
            for s in range(0, len(starts), most):
                at = starts[s : s + most, None] + np.arange(n)
                label = _trees(grid[rows[at]], own[at], near)
                u, v = own[at], own[np.take_along_axis(at, label, axis=1)]
                found.append(np.stack([u[u != v], v[u != v]]))
        first, size = first[size > small], size[size > small]
        if not len(first):
            break
        # the leader of each large run, then what is still apart goes a step further
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        lead = first + (shingles.mixed(path[first].view(np.uint64)) % size.astype(np.uint64)).astype(np.int64)
        lead = np.repeat(lead, size)
        alike = (grid[rows[at]] == grid[rows[lead]]).mean(axis=1) >= near
        found.append(np.stack([own[at[alike]], own[lead[alike]]]))
        pairs = np.concatenate(found, axis=1)
        code = roots_of(pairs[0], pairs[1], len(code))[code]
        found = [np.unique(pairs, axis=1)]
        row, child = _children(path[at].view(np.uint64), grid[rows[at]], SPREAD)
        order = np.argsort(child, kind="stable")
        path, rows = child[order].view(np.int64), rows[at[row[order]]]
    return np.unique(np.concatenate(found, axis=1), axis=1)


def _bucket_edges(records: DataFrame) -> DataFrame:
    """Each bucket's trees as stars, rows to a root, between ends that differ."""
    near, small, whole = THRESHOLD - SLACK, BUCKET, WHOLE
    end = "root" if "root" in records.columns else "rep"
    kind = np.dtype([("doc", np.int64), ("h", np.int32)])

    def edges(path: np.ndarray, ends: np.ndarray, grid: np.ndarray) -> pa.RecordBatch:
        known, code = np.unique(ends, return_inverse=True)
        pairs = _joined(path, code, grid, near, small)
        pairs = pairs[:, pairs[0] != pairs[1]]
        sides = [pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(known[p][k])) for k in ("doc", "h")], fields=list(_REP)) for p in pairs]
        return pa.RecordBatch.from_arrays(sides, names=["u", "v"])

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in batches:
            if not len(b):
                continue
            e = b.column(end)
            now = b.column("path").to_numpy(), np.rec.fromarrays([e.field(0).to_numpy(), e.field(1).to_numpy()], dtype=kind), _grid(b.column("sketch"))
            if parts and parts[-1][0][-1] == now[0][0] == now[0][-1]:  # one bucket goes on
                parts.append(now)
                continue
            path, ends, grid = (np.concatenate(x) for x in zip(*parts, now))
            stop = int(np.flatnonzero(path == path[-1])[0])
            if stop:
                yield edges(path[:stop], ends[:stop], grid[:stop])
            parts = [(path[stop:], ends[stop:], grid[stop:])]
        if parts:
            yield edges(*(np.concatenate(x) for x in zip(*parts)))

    dealt = records.where(F.col("n") <= whole).select(end, "path", "sketch").repartition("path").sortWithinPartitions("path")
    return dealt.mapInArrow(run, "u struct<doc:long,h:int>, v struct<doc:long,h:int>")


def _leader_edges(large: DataFrame) -> DataFrame:
    """In each large bucket, those that look like its leader, which a hash of the path picks."""
    near = THRESHOLD - SLACK
    end = "root" if "root" in large.columns else "rep"
    leaders = large.groupBy("path").agg(F.min(F.struct(F.xxhash64("path", "rep.doc", "rep.h").alias("by"), F.col(end).alias("to"), "sketch")).alias("l"))
    leaders = common.written(leaders.select(F.col("path").alias("_path"), F.col("l.to").alias("to"), F.col("l.sketch").alias("lead")), "leaders")
    met = large.join(leaders, F.col("path") == F.col("_path")).where(F.col(end) != F.col("to")).select(F.col(end).alias("u"), F.col("to").alias("v"), "sketch", "lead")

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                alike = (_grid(b.column("sketch")) == _grid(b.column("lead"))).mean(axis=1) >= near
                yield b.select(["u", "v"]).filter(pa.array(alike))

    return met.mapInArrow(run, "u struct<doc:long,h:int>, v struct<doc:long,h:int>")


def _rooted(records: DataFrame, roots: DataFrame) -> DataFrame:
    """Records with their component so far, or themselves."""
    return records.join(roots, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("component", "rep")).drop("node", "component")


def candidate_groups(reps: DataFrame, recall: float = RECALL) -> DataFrame:
    """``node, component`` over ``reps(rep, sketch)``; a similar pair shares a component with the given recall."""
    runs = runs_for(recall)
    first = _meeting(common.written(_step(reps, range(FIRST)), "paths"))
    full = first.join(reps, "rep")
    edges = _bucket_edges(full).unionByName(_leader_edges(common.written(full.where(F.col("n") > WHOLE), "large-buckets")))
    roots = common.written(components(edges), "roots")
    paths = _step(_rooted(reps, roots), range(FIRST, runs))
    paths = paths.unionByName(_rooted(first.where(F.col("n") > WHOLE).select("rep", "path"), roots).select("rep", "root", "path"))
    while True:
        full = _meeting(common.written(paths, "paths")).join(reps, "rep")
        large = common.written(full.where(F.col("n") > WHOLE), "large-buckets")
        edges = _bucket_edges(full).unionByName(roots.select(F.col("node").alias("u"), F.col("component").alias("v")))
        if large.isEmpty():
            return components(edges)
        roots = common.written(components(edges.unionByName(_leader_edges(large))), "roots")
        paths = _rooted(_step(large.drop("root")), roots).select("rep", "root", "path")


# -- exact verification ----------------------------------------------------------


def near_pairs(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of a are alike with which of b, as a matrix of booleans; intersections are counted for a tile of rows of a at a time."""
    near = np.zeros((len(a), len(b)), bool)
    na, nb = np.array([len(s) for s in a], np.int64), np.array([len(s) for s in b], np.int64)
    tokens, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    ta, tb = at[: na.sum()].astype(np.int32), at[na.sum() :].astype(np.int32)
    ra, rb = np.repeat(np.arange(len(a), dtype=np.int32), na), np.repeat(np.arange(len(b), dtype=np.int32), nb)
    da, db = np.bincount(ta, minlength=len(tokens)), np.bincount(tb, minlength=len(tokens))
    often = np.flatnonzero(da * db > 64)
    column = np.full(len(tokens), -1, np.int32)
    column[often] = np.arange(len(often), dtype=np.int32)
    rare = (da > 0) & (db > 0) & (da * db <= 64)
    keep = rare[tb]
    order = np.argsort(tb[keep], kind="stable")
    rare_tb, rare_rb = tb[keep][order], rb[keep][order]

    def by_column(t: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = column[t]
        order = np.argsort(c, kind="stable")[(c < 0).sum() :]
        return c[order], row[order]

    cb, rows_b = by_column(tb, rb)
    ends = np.concatenate([[0], np.cumsum(na)])
    height = max(1, TILE_CELLS // max(1, len(b)))
    width = max(1, TILE_CELLS // max(1, len(b)))
    for top in range(0, len(a), height):
        low = min(top + height, len(a))
        t, r = ta[ends[top] : ends[low]], ra[ends[top] : ends[low]] - top
        out = np.zeros((low - top, len(b)), np.float32)  # counts stay far below 2^24
        ca, rows_a = by_column(t, r)
        for s in range(0, len(often), width):
            x, y = (np.zeros((n, min(width, len(often) - s)), np.float32) for n in (low - top, len(b)))
            for grid, c, row in ((x, ca, rows_a), (y, cb, rows_b)):
                i, j = np.searchsorted(c, [s, s + width])
                grid[row[i:j], c[i:j] - s] = 1
            out += x @ y.T
        of_rare = rare[t]
        t, r = t[of_rare], r[of_rare]
        lo, hi = np.searchsorted(rare_tb, t, "left"), np.searchsorted(rare_tb, t, "right")
        for s in range(0, len(t), 20_000):
            n = (hi - lo)[s : s + 20_000]
            j = rare_rb[np.repeat(lo[s : s + 20_000] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            np.add.at(out, (np.repeat(r[s : s + 20_000], n), j), 1)
        union = (na[top:low, None] + nb[None, :]).astype(np.float64) - out
        near[top:low] = out >= threshold * union - 1e-9
    return near


def _verified(sets: DataFrame, threshold: float) -> DataFrame:
    """(rep, links, other) of the exact links of each block pair; rows come sorted by component, blocks and side."""
    kind = pa.struct([("doc", pa.int64()), ("h", pa.int32())])

    def links(rows: list[tuple], whole: bool) -> pa.RecordBatch:
        sides = [[r for r in rows if r[0] == k] for k in (0, 1)]
        a = sides[0]
        b = a if whole else sides[1]
        if not a or not b:
            return pa.RecordBatch.from_arrays([pa.array([], kind), pa.array([], pa.int64()), pa.array([], kind)], names=["rep", "links", "other"])
        x, y = ([np.frombuffer(r[3], "<u8") for r in side] for side in (a, b))
        near = near_pairs(x, y, threshold)
        if whole:
            np.fill_diagonal(near, False)
        reps: list[dict] = []
        total: list[int] = []
        other: list[dict] = []
        ca, cb = np.array([r[2] for r in a], np.int64), np.array([r[2] for r in b], np.int64)
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            reps.append(a[i][1])
            total.append(int(cb[near[i]].sum()))
            other.append(b[int(near[i].argmax())][1])
        if not whole:
            for j in np.flatnonzero(near.any(axis=0)).tolist():
                reps.append(b[j][1])
                total.append(int(ca[near[:, j]].sum()))
                other.append(a[int(near[:, j].argmax())][1])
        # first partners alone may leave trees apart that another link joins
        for p, q in _joins(near, whole):
            reps.append(a[p][1])
            total.append(0)
            other.append(b[q][1])
        return pa.RecordBatch.from_arrays([pa.array(reps, kind), pa.array(total, pa.int64()), pa.array(other, kind)], names=["rep", "links", "other"])

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for b in batches:
            for comp, bi, bj, side, rep, copies, data in zip(*[b.column(c).to_pylist() for c in ("comp", "bi", "bj", "side", "rep", "copies", "data")]):
                key = (comp["doc"], comp["h"], bi, bj)
                if key != held:
                    if rows:
                        yield links(rows, held[2] == held[3])
                    held, rows = key, []
                rows.append((side, rep, copies, data))
        if rows:
            yield links(rows, held[2] == held[3])

    return sets.mapInArrow(run, "rep struct<doc:long,h:int>, links long, other struct<doc:long,h:int>")


def _joins(near: np.ndarray, whole: bool) -> list[tuple[int, int]]:
    """Pairs (row, column) that join the trees left by everyone's first partner."""
    n, m = near.shape
    root = np.arange(n if whole else n + m)
    shift = 0 if whole else n

    def merge(p: np.ndarray, q: np.ndarray) -> None:
        while len(p):
            a, b = root[p], root[q]
            apart = a != b
            p, q, a, b = p[apart], q[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root[:] = root[root]

    i = np.flatnonzero(near.any(axis=1))
    merge(i, near[i].argmax(axis=1) + shift)
    if not whole:
        j = np.flatnonzero(near.any(axis=0))
        merge(near[:, j].argmax(axis=0), j + shift)
    out = []
    for i in range(n):
        row = np.flatnonzero(near[i])
        row = row[root[row + shift] != root[i]]
        while len(row):
            q = int(row[0])
            out.append((i, q))
            merge(np.array([i]), np.array([q + shift]))
            row = row[root[row + shift] != root[i]]
    return out


def _placed_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Full shingle sets of the candidates, at every block pair of their component."""
    packed = _compressed(rows)
    joined = packed.join(wanted.select(F.col("rep.doc").alias("doc"), F.col("rep.h").alias("h"), "comp", "copies", "blocks"), ["doc", "h"])
    schema = "comp struct<doc:long,h:int>, bi int, bj int, side int, rep struct<doc:long,h:int>, copies long, data binary"
    kind = pa.struct([("doc", pa.int64()), ("h", pa.int32())])
    kinds = [kind, pa.int32(), pa.int32(), pa.int32(), kind, pa.int64(), pa.binary()]
    names = ["comp", "bi", "bj", "side", "rep", "copies", "data"]

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for b in batches:
            texts = pa.array([unpress.decompress(z) for z in b.column("z").to_pylist()], pa.binary()).cast(pa.string())
            raw, offsets = shingles.utf8_buffers(texts)
            out: list[list] = [[] for _ in names]
            held = 0
            for i, j in shingles.chunks(offsets, common.CHUNK_BYTES):
                hashes, at = shingles.shingle_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WIDTH)
                for k in range(i, j):
                    data = np.unique(hashes[at[k - i] : at[k - i + 1]]).astype("<u8").tobytes()
                    comp, copies, blocks = b.column("comp")[k].as_py(), b.column("copies")[k].as_py(), b.column("blocks")[k].as_py()
                    rep = {"doc": b.column("doc")[k].as_py(), "h": b.column("h")[k].as_py()}
                    own = (rep["doc"] * 2654435761 + rep["h"]) % 2147483647 % blocks
                    for other in range(blocks):
                        place = (min(own, other), max(own, other), int(own > other))
                        for c, v in zip(out, (comp, *place, rep, copies, data)):
                            c.append(v)
                        held += len(data) + 100
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)
                            out, held = [[] for _ in names], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return joined.select("doc", "h", "z", "comp", "copies", "blocks").mapInArrow(run, schema)


def _compressed(rows: DataFrame) -> DataFrame:
    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = pa.array([press.compress(t) for t in b.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("h"), z], names=["doc", "h", "z"])

    return rows.mapInArrow(run, "doc long, h int, z binary").dropDuplicates(["doc", "h"])


def classes(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Row key (doc, h), class (least row key of those reachable by links) and n_links of every row of ``documents``."""
    if threshold < THRESHOLD:
        raise ValueError(f"the runs are laid out for thresholds from {THRESHOLD} on")
    spark = documents.sparkSession
    common.small_batches(spark)
    rows = _rows(documents)
    profiles = common.written(_profiles(rows), "profiles")
    some = profiles.where("size > 0")
    per_set = some.groupBy("set").agg(F.min(F.struct("doc", "h")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    reps = common.written(per_set, "sets")
    groups = common.written(candidate_groups(reps.select("rep", "sketch"), recall), "candidates")
    members = groups.join(reps, groups["node"] == reps["rep"]).select("rep", F.col("component").alias("comp"), "copies", "size")
    sizes = members.groupBy("comp").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("sets"))
    blocks = F.ceil(F.greatest(F.col("tokens") / BLOCK_TOKENS, F.col("sets") / BLOCK_SETS)).cast("int")
    sizes = sizes.select(F.col("comp").alias("_comp"), blocks.alias("blocks"))
    sizes = common.written(sizes, "component-sizes")
    wanted = common.written(members.join(sizes, F.col("comp") == F.col("_comp")).drop("_comp"), "wanted")
    placed = _placed_sets(rows, wanted)
    dealt = placed.repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj", "side")
    linked = common.written(_verified(dealt, threshold), "links")
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "_rep")
    true = components(linked.select(F.col("rep").alias("u"), F.col("other").alias("v")))
    per = reps.select("set", "rep", "copies").join(counts, F.col("rep") == F.col("_rep"), "left").join(true, F.col("rep") == F.col("node"), "left")
    per = per.select(F.col("set").alias("_set"), F.coalesce("component", "rep").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = profiles.select("doc", "h", "set", "size").join(per, (F.col("set") == F.col("_set")) & (F.col("size") > 0), "left")
    return out.select("doc", "h", F.coalesce("class", F.struct("doc", "h")).alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def similarity_classes(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), n_links (other rows of similarity ``threshold`` or more) and kept, a row per document."""
    found = classes(documents, threshold, recall)
    real = lambda c: F.when(c != LEAST_ID, c)
    return found.select(real(F.col("doc")).alias("doc_id"), real(F.col("class.doc")).alias("class_id"), "n_links", (F.struct("doc", "h") == F.col("class")).alias("kept"))


def without_near_copies(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that stand for their class; of rows equal in doc_id and text one stays."""
    found = classes(documents, threshold).where(F.struct("doc", "h") == F.col("class")).select(F.col("doc").alias("_cp_d"), F.col("h").alias("_cp_g")).distinct()
    text = F.coalesce("text", F.lit(""))
    keyed = documents.withColumns({"_cp_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)), "_cp_h": (F.xxhash64(text) % 2147483647).cast("int")})
    kept = keyed.join(found, (F.col("_cp_doc") == F.col("_cp_d")) & (F.col("_cp_h") == F.col("_cp_g")), "left_semi")
    repeated = kept.groupBy("_cp_doc", "_cp_h").agg(F.count(F.lit(1)).alias("_cp_n")).where("_cp_n > 1")
    if repeated.isEmpty():
        return kept.select(*documents.columns)
    return kept.dropDuplicates(["_cp_doc", "_cp_h"]).select(*documents.columns)
