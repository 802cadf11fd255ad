"""SentencePiece encoding and decoding with N-best segmentation by A* over the piece lattice.

A text becomes U+2581 and itself with spaces turned into U+2581; pieces and
their scores come from a model file, a segmentation's score is the sum.  A
character that is no piece costs, for each of its bytes, ``PENALTY`` below the
least score and is written as byte pieces.  The lattice falls apart into units
that no piece crosses.  Forward Viterbi scores of all units new to a worker are
found side by side in numpy; they give the best path, and with the backward
scores the gap to the second best.  A text's N best can differ from its best
only in the N - 1 units of least gap: there a backward A* search whose heuristic
is the forward Viterbi score, hence exact, lists the unit's N best, and the
lists are merged.  Ties go to the unit that comes first and to the longer last piece.
Units of more than ``LONG`` characters (text without spaces) fall apart at every
place that no piece crosses; what is still long is searched edge by edge.  A*
keeps the N most promising ends only, so work and memory grow with the length of
the text.
Every segmentation comes out whole: the best as ids, each as the runs of those
ids that it replaces, from which ``nbest_ids`` writes its ids in full.

Decoding joins pieces and bytes; encoding and decoding give back every text, a
literal U+2581 included (it is always written as bytes).

Defined cases: null and empty texts have no pieces, one segmentation of score
0; texts of any length are encoded whole; repeated rows encode alike; null
doc_ids stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, pieces, shingles

NBEST = 5
PENALTY = 10.0
CACHE = 250_000
#: Characters of new units that one numpy pass takes.
SLICE = 100_000
CHUNK = 1_000_000
#: Characters from which on a unit is taken apart.
LONG = 64
#: Units of which a worker remembers the N best.
LISTS = 20_000
#: Factors of the characters of a unit by place, for hashes.
WEIGHTS = np.random.default_rng(4).integers(1, 1 << 63, LONG + 1, np.uint64) * np.uint64(2) + np.uint64(1)
WORD, STOP = 1, 2
MARK = pieces.SPACE
Unit = tuple[bytes, float, float]
#: Place in the best ids, the ids that stand there, and those that replace them.
Change = tuple[int, bytes, bytes]


@lru_cache(maxsize=1)
def _words() -> np.ndarray:
    """``WORD`` at the code points of letters and digits, else 0."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), np.uint8, 0x110000) * np.uint8(WORD)


class Encoder:
    def __init__(self, model: str) -> None:
        names, scores, kinds = pieces.vocabulary(model)
        normal = {p: i for i, (p, k) in enumerate(zip(names, kinds)) if k == "normal" and p}
        self.ids = normal
        self.scores = np.array(scores)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(names, kinds)) if k == "byte"}
        self.raw = [p.replace(MARK, " ").encode("utf-8") for p in names]
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.width = np.array([len(r) for r in self.raw])
        self.begin = np.cumsum(self.width) - self.width
        if len(self.byte) < 256:
            raise ValueError("the model has no byte pieces")
        self.unknown = min(scores[i] for i in normal.values()) - PENALTY
        self.most = max(map(len, normal))
        self.crossing = any(MARK in p.lstrip(MARK) for p in normal)
        self.lines = not any("\n" in p and len(p) > 1 for p in normal)
        word = re.compile(r"[^\W_]")
        joined = {p[i] for p in normal for i in range(1, len(p)) if p[i] in ".,;:!?*#$%&" and word.match(p[i - 1])}
        self.kind = _words().copy()
        self.kind[[ord(c) for c in ".,;:!?*#$%&" if c not in joined]] = STOP
        flat = np.frombuffer("".join(normal).encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(p) for p in normal])])
        hashes = self._hashes(flat, at[:-1], at[1:])
        self.table = np.full(1 << 21, -1, np.int32)
        self.key = np.zeros(1 << 21, np.uint64)
        mask = len(self.table) - 1
        for h, i in zip(hashes.tolist(), normal.values()):
            slot = h & mask
            while self.table[slot] >= 0:
                slot = (slot + 1) & mask
            self.table[slot], self.key[slot] = i, h
        self.units: dict[str, Unit] = {}
        self.older: dict[str, Unit] = {}
        self.lists: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    @staticmethod
    def _hashes(points: np.ndarray, a: np.ndarray, b: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        powers, inverses = shingles._power_tables(len(points) + 1)
        if sums is None:
            sums = np.zeros(len(points) + 1, np.uint64)
            np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers[: len(points)], out=sums[1:])
        return shingles.mixed((sums[b] - sums[a]) * inverses[a] + (b - a).astype(np.uint64))

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.table) - 1)
        slot = (hashes & mask).astype(np.int64)
        found = np.where(self.key[slot] == hashes, self.table[slot], -1)
        again = np.flatnonzero((found < 0) & (self.table[slot] >= 0))
        while len(again):
            slot[again] = (slot[again] + 1) & int(mask)
            hit = self.key[slot[again]] == hashes[again]
            found[again[hit]] = self.table[slot[again[hit]]]
            again = again[~hit & (self.table[slot[again]] >= 0)]
        return found

    def _learn(self, new: list[str]) -> None:
        """Best path, its score and the gap to the second best of each unit."""
        new = sorted(new, key=len, reverse=True)
        points = np.frombuffer("".join(new).encode("utf-32-le"), np.uint32)
        n = np.array([len(u) for u in new])
        start = np.cumsum(n) - n
        end = np.repeat(start + n, n)
        p, longest = len(points), int(n[0])
        at = np.arange(p)
        most = min(self.most, longest)
        powers, _ = shingles._power_tables(p + 1)
        sums = np.zeros(p + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers[:p], out=sums[1:])
        # the t-th characters of all units that have so many lie side by side, edges at the characters at which they end
        live = np.append(np.searchsorted(-n, -np.arange(1, longest + 1), "right"), 0)
        first = np.cumsum(live) - live
        unit = np.repeat(np.arange(len(new)), n)
        turn = at - start[unit]
        slot = first[turn] + unit
        ids = np.full((most + 1, p), -1, np.int32)
        edge = np.full((most + 1, p), -np.inf)
        some = np.zeros((most + 1, longest), bool)
        some[1] = True
        for k in range(1, most + 1):
            i = at[at + k <= end]
            found = self._find(self._hashes(points, i, i + k, sums))
            i, found = i[found >= 0] + k - 1, found[found >= 0]
            ids[k, slot[i]], edge[k, slot[i]] = found, self.scores[found]
            some[k, turn[i]] = True
        lone = np.flatnonzero(ids[1, slot] < 0)
        width = np.where(points[lone] < 0x80, 1, np.where(points[lone] < 0x800, 2, np.where(points[lone] < 0x10000, 3, 4)))
        edge[1, slot[lone]] = width * self.unknown
        rows = [(t, int(live[t - 1]), int(first[t - 1]), [m for m in range(1, min(most, t) + 1) if some[m, t - 1]]) for t in range(1, longest + 1)]
        ahead, back = [np.zeros(len(new))], [np.zeros(len(new), np.int32)]
        for t, k, a, steps in rows:
            top, by = ahead[t - 1][:k] + edge[1, a : a + k], np.ones(k, np.int32)
            for m in steps[1:]:
                score = ahead[t - m][:k] + edge[m, a : a + k]
                better = score >= top
                np.copyto(top, score, where=better)
                np.copyto(by, m, where=better)
            ahead.append(top)
            back.append(by)
        behind = [np.full(len(x), -np.inf) for x in ahead]
        best, second = np.empty(len(new)), np.full(len(new), -np.inf)
        place, count = n.copy(), np.zeros(len(new), np.int64)
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        for t, k, a, steps in reversed(rows):
            hind = behind[t]
            hind[live[t] :] = 0
            best[live[t] : k] = ahead[t][live[t] :]
            on = np.flatnonzero(place[:k] == t)
            own = back[t][on]
            for m in steps:
                np.maximum(behind[t - m][:k], hind + edge[m, a : a + k], out=behind[t - m][:k])
                through = ahead[t - m][:k] + edge[m, a : a + k] + hind
                through[on[own == m]] = -np.inf
                np.maximum(second[:k], through, out=second[:k])
            taken.append((on, ids[own, a + on]))
            place[on] -= own
            count[on] += 1
        gap = best - second
        last = np.cumsum(count)
        flat = np.empty(int(last[-1]), "<i4")
        put = last.copy()
        for on, i in taken:
            put[on] -= 1
            flat[put[on]] = i
        raw = flat.tobytes()
        odd = set(np.unique(np.repeat(np.arange(len(new)), count)[flat < 0]).tolist()) if (flat < 0).any() else set()
        for u, (text, a, b, s, g) in enumerate(zip(new, (last - count).tolist(), last.tolist(), best.tolist(), gap.tolist())):
            data = raw[4 * a : 4 * b]
            self.units[text] = (data if u not in odd else self.nbest(text, 1)[0][1], s, g)

    def _found(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, places and ids of all pieces of a unit, slice by slice."""
        for s in range(0, len(points), SLICE):
            window = points[s : s + SLICE + self.most - 1]
            powers, _ = shingles._power_tables(len(window) + 1)
            sums = np.zeros(len(window) + 1, np.uint64)
            np.cumsum((window.astype(np.uint64) + np.uint64(1)) * powers[: len(window)], out=sums[1:])
            for k in range(1, min(self.most, len(window)) + 1):
                i = np.arange(min(SLICE, len(window) - k + 1))
                found = self._find(self._hashes(window, i, i + k, sums))
                yield k, i[found >= 0] + s, found[found >= 0]

    def _parts(self, unit: str) -> np.ndarray:
        """Places inside a long unit that no piece crosses."""
        points = np.frombuffer(unit.encode("utf-32-le"), np.uint32)
        step = np.zeros(len(points) + 2, np.int32)
        for k, i, _ in self._found(points):
            if k > 1:
                step[i + 1] += 1
                step[i + k] -= 1
        return np.flatnonzero(np.cumsum(step)[1 : len(points)] == 0) + 1

    def _lattice(self, unit: str, mark: str = "") -> tuple[list[int], list[int], list[float], list[int]]:
        """Begin, id (-1: bytes) and score of the edges by the node at which they end, longest first, and each node's first edge."""
        points = np.frombuffer(unit.encode("utf-32-le"), np.uint32)
        found = [(i, i + k, x, self.scores[x]) for k, i, x in self._found(points)]
        lone = np.ones(len(points), bool)
        for i, e, _, _ in found:
            lone[i[e == i + 1]] = False
        i = np.flatnonzero(lone)
        width = np.where(points[i] < 0x80, 1, np.where(points[i] < 0x800, 2, np.where(points[i] < 0x10000, 3, 4)))
        if mark:
            width[points[i] == ord(mark)] = len(MARK.encode("utf-8"))
        found.append((i, i + 1, np.full(len(i), -1), width * self.unknown))
        begin, end, ids, score = (np.concatenate([f[c] for f in found]) for c in range(4))
        order = np.lexsort((begin, end))
        at = np.searchsorted(end[order], np.arange(len(points) + 2))
        return begin[order].tolist(), ids[order].tolist(), score[order].tolist(), at.tolist()

    def _ahead(self, n: int, begin: list[int], score: list[float], at: list[int]) -> tuple[list[float], list[int]]:
        """Forward Viterbi scores of the nodes, and the edge by which each is reached."""
        ahead, by = [0.0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            best, edge = -np.inf, 0
            for x in range(at[j], at[j + 1]):
                v = ahead[begin[x]] + score[x]
                if v > best:
                    best, edge = v, x
            ahead[j], by[j] = best, edge
        return ahead, by

    def _own(self, unit: str, i: int, j: int, k: int, mark: str = "") -> list[int]:
        """Ids of an edge."""
        return [k] if k >= 0 else [self.byte[x] for x in (MARK if unit[i:j] == mark else unit[i:j]).encode("utf-8")]

    def _long(self, unit: str, mark: str = "") -> Unit:
        """Best path, its score and the gap to the second best of one long unit."""
        n = len(unit)
        begin, ids, score, at = self._lattice(unit, mark)
        ahead, by = self._ahead(n, begin, score, at)
        behind = [-np.inf] * n + [0.0]
        for j in range(n, 0, -1):
            for x in range(at[j], at[j + 1]):
                v = behind[j] + score[x]
                if v > behind[begin[x]]:
                    behind[begin[x]] = v
        path, j = [], n
        while j:
            path.append((by[j], j))
            j = begin[by[j]]
        through = np.array(ahead)[begin] + np.array(score) + np.array(behind)[np.repeat(np.arange(n + 1), np.diff(at))]
        through[[x for x, _ in path]] = -np.inf
        flat = [k for x, j in reversed(path) for k in self._own(unit, begin[x], j, ids[x], mark)]
        return np.array(flat, "<i4").tobytes(), ahead[n], ahead[n] - float(through.max(initial=-np.inf))

    def nbest(self, unit: str, count: int, mark: str = "") -> list[tuple[float, bytes]]:
        """The ``count`` best segmentations of a unit, best first; ``mark`` stands for a literal U+2581."""
        n = len(unit)
        if n > LONG:
            begin, ids, score, at = self._lattice(unit, mark)
        else:
            begin, ids, score, at = [], [], [], [0, 0]
            for j in range(1, n + 1):
                for i in range(max(0, j - self.most), j):
                    k = self.ids.get(unit[i:j], -1)
                    if k >= 0 or i == j - 1:
                        begin.append(i)
                        ids.append(k)
                        score.append(float(self.scores[k]) if k >= 0 else len((MARK if unit[i:j] == mark else unit[i:j]).encode("utf-8")) * self.unknown)
                at.append(len(begin))
        ahead, _ = self._ahead(n, begin, score, at)
        # as the heuristic is exact, each open end stands for a segmentation of just its promise, and different ends for
        # different ones: the ``count`` most promising are enough. Of equal ones the nearest to the start comes first, then the longer piece
        ends: list[tuple[float, int, int, float, tuple]] = [(-ahead[n], n, 0, 0.0, ())]
        out, turn = [], 0
        while ends and len(out) < count:
            _, j, _, s, path = ends.pop(0)
            if j == 0:
                found: list[int] = []
                while path:
                    i, e, k, path = path
                    found += self._own(unit, i, e, k, mark)
                out.append((s, np.array(found, "<i4").tobytes()))
                continue
            for x in range(at[j], at[j + 1]):
                turn += 1
                i = begin[x]
                ends.append((-(s + score[x] + ahead[i]), i, turn, s + score[x], (i, j, ids[x], path)))
            ends.sort()
            del ends[count - len(out) :]
        return out

    def _starts(self, points: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Where units start: at a text, a run of U+2581, a line's end and behind it, and at a stop behind a word.

        No piece goes on from a letter to a stop, so a word ends before it.
        """
        if self.crossing:
            return texts
        new = np.zeros(len(points) + 1, bool)
        space = points == ord(MARK)
        new[1:-1] = space[1:] & ~space[:-1]
        if self.lines:
            line = np.flatnonzero(points == 10)
            new[line] = new[line + 1] = True
            kind = self.kind[points]
            rest = np.flatnonzero(kind != WORD)
            new[rest[1:]] |= (kind[rest[1:]] == STOP) & space[rest[:-1]] & (np.diff(rest) > 1)
        new[texts] = True
        return np.flatnonzero(new[:-1])

    @staticmethod
    def _distinct(points: np.ndarray, a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One of equal units each, and for every unit the number of its own; only equal characters make units equal."""
        kept, number, total = [], np.empty(len(a), np.int64), 0
        cuts = np.unique(np.append(np.searchsorted(a, np.arange(0, len(points), CHUNK)), len(a)))
        for x, y in zip(cuts, cuts[1:]):
            b, k = a[x:y] - a[x], n[x:y]
            own = points[a[x] : a[x] + b[-1] + k[-1]]
            sums = np.zeros(len(own) + 1, np.uint64)
            np.cumsum((own + np.uint64(1)) * WEIGHTS[np.minimum(np.arange(len(own)) - np.repeat(b, k), LONG)], out=sums[1:])
            hashes = sums[b + k] - sums[b]
            order = np.argsort(hashes)
            new = np.append(True, hashes[order[1:]] != hashes[order[:-1]])
            some = order[new]
            group = np.empty(len(b), np.int64)
            group[order] = np.cumsum(new) - 1
            like = some[group]
            like = np.where(k[like] == k, like, np.arange(len(b)))
            unlike = np.flatnonzero(own != own[np.arange(len(own)) + np.repeat(b[like] - b, k)])
            alone = np.unique(np.concatenate([np.flatnonzero(k[some[group]] != k), np.searchsorted(b, unlike, "right") - 1]))
            group[alone] = len(some) + np.arange(len(alone))
            number[x:y] = total + group
            kept.append(x + np.append(some, alone))
            total += len(kept[-1])
        return np.concatenate(kept), number

    def _entries(self, names: list[str], marks: dict[int, str]) -> list[Unit]:
        """What is known of units, by their place in ``names``; ``marks`` has the mark of those with a literal U+2581."""
        entries: list[Unit | None] = list(map(self.units.get, names))
        for j in marks:
            entries[j] = None
        lengthy: dict[tuple[str, str], Unit] = {}  # not remembered beyond this call
        new: list[int] = []
        for j in [j for j, e in enumerate(entries) if e is None]:
            u = names[j]
            if j in marks or len(u) > LONG:
                key = (u, marks.get(j, ""))
                if key not in lengthy:
                    lengthy[key] = self._long(*key)
                entries[j] = lengthy[key]
            elif (known := self.older.get(u)) is not None:
                self.units[u] = entries[j] = known
            else:
                new.append(j)
        some: list[str] = []
        size = 0
        for j in new:
            some.append(names[j])
            size += len(names[j])
            if size > SLICE:
                self._learn(some)
                some, size = [], 0
        if some:
            self._learn(some)
        for j in new:
            entries[j] = self.units[names[j]]
        return entries

    def _best(self, unit: str, mark: str, count: int, top: bytes) -> list[tuple[float, bytes]]:
        """The ``count`` best segmentations of a unit, of equal first ones ``top``; those of short units are remembered."""
        key = (unit, count)
        if mark or (best := self.lists.get(key)) is None:
            best = self.nbest(unit, count, mark)
            if best[0][1] != top:
                best = [(best[0][0], top), *[x for x in best if x[1] != top]][:count]
            if not mark and len(unit) <= LONG:
                if len(self.lists) >= LISTS:
                    self.lists = {}
                self.lists[key] = best
        return best

    def __call__(self, texts: list[str], count: int = NBEST) -> list[tuple[bytes, list[float], list[int], list[list[Change]]]]:
        """Per text the ids of the best segmentation, and scores, piece counts and changes to those ids of the ``count`` best."""
        if len(self.units) > CACHE:
            self.units, self.older = {}, self.units
        marks = [next(c for c in map(chr, [*range(0xFDD0, 0xFDF0), *range(0xF0000, 0x10FFFE)]) if c not in t) if MARK in t else "" for t in texts]
        full = [MARK + (t.replace(MARK, m) if m else t).replace(" ", MARK) if t else "" for t, m in zip(texts, marks)]
        whole = "".join(full)
        if not whole:
            return [(b"", [0.0], [0], [[]]) for _ in texts]
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in full])
        begins = np.append(0, ends[:-1])
        a = self._starts(points, begins[begins < ends])
        n = np.diff(a, append=len(points))
        more = [a[j] + self._parts(whole[a[j] : a[j] + n[j]]) for j in np.flatnonzero(n > LONG)]
        if more:
            a = np.sort(np.concatenate([a, *more]))
            n = np.diff(a, append=len(points))
        own: dict[int, str] = {}
        for i in [i for i, m in enumerate(marks) if m]:
            at = begins[i] + np.flatnonzero(points[begins[i] : ends[i]] == ord(marks[i]))
            own |= dict.fromkeys((np.searchsorted(a, at, "right") - 1).tolist(), marks[i])
        some, number = self._distinct(points, a, n)
        if own:  # a mark may be a character of another text
            alone = np.fromiter(own, np.int64, len(own))
            number[alone] = len(some) + np.arange(len(own))
            some = np.append(some, alone)
        names = [whole[x:y] for x, y in zip(a[some].tolist(), (a + n)[some].tolist())]
        entries = self._entries(names, dict(zip(range(len(names) - len(own), len(names)), own.values())))
        made = np.frombuffer(b"".join([e[0] for e in entries]), "<i4")
        size = np.array([len(e[0]) // 4 for e in entries])
        score, gap = (np.array([e[c] for e in entries]) for c in (1, 2))
        past = np.append(0, np.cumsum(size[number]))
        made = made[np.repeat((np.cumsum(size) - size)[number] - past[:-1], size[number]) + np.arange(past[-1])]
        out = []
        for x, y in zip(np.searchsorted(a, begins).tolist(), np.searchsorted(a, ends).tolist()):
            if x == y:
                out.append((b"", [0.0], [0], [[]]))
                continue
            total = sum(score[number[x:y]].tolist())
            gaps = gap[number[x:y]]
            near = np.argsort(gaps, kind="stable")[: count - 1] if len(gaps) < 64 else _least(gaps, count - 1)
            near = near[np.isfinite(gaps[near])].tolist()
            ways: list[tuple[float, int, tuple[tuple[int, bytes], ...]]] = [(0.0, int(past[y] - past[x]), ())]
            for i in near:
                j = number[x + i]
                best = self._best(names[j], own.get(x + i, ""), count, entries[j][0])
                top, first = best[0][0], len(best[0][1])
                # a pair that ``count`` others precede in both lists is not among the best
                ways = sorted([(d + s - top, k + (len(z) - first) // 4, (*w, (i, z)) if r else w) for q, (d, k, w) in enumerate(ways) for r, (s, z) in enumerate(best[: count // (q + 1)])], key=lambda w: -w[0])[:count]
            place = {i: int(past[x + i] - past[x]) for i in near}
            changes = [[(place[i], entries[number[x + i]][0], z) for i, z in sorted(w)] for _, _, w in ways]
            out.append((made[past[x] : past[y]].tobytes(), [total + d for d, _, _ in ways], [k for _, k, _ in ways], changes))
        return out

    def _same(self, change: Change) -> bool:
        """Whether the new ids stand for the bytes of the old ones."""
        old, new = (b"".join(map(self.raw.__getitem__, np.frombuffer(x, "<i4").tolist())) for x in change[1:])
        return old == new

    def _gives(self, ids: np.ndarray, at: np.ndarray, texts: list[str]) -> np.ndarray:
        """Whether the bytes of the pieces ``ids[at[i]:at[i + 1]]`` are those of each text, as ``decode`` joins them."""
        want = [(" " + t).encode("utf-8") if t else b"" for t in texts]
        lengths = np.array([len(w) for w in want])
        size = self.width[ids]
        past = np.append(0, np.cumsum(size))
        right = np.diff(past[at]) == lengths
        if not right.all():
            return np.array([self.decode(ids[a:e].tolist()) == t for a, e, t in zip(at, at[1:], texts)])
        ends = np.cumsum(lengths)
        wanted = np.frombuffer(b"".join(want), np.uint8)
        for x in range(0, len(ids), CHUNK):
            k = size[x : x + CHUNK]
            begin, end = past[x], past[x + len(k)]
            got = self.bytes[np.repeat(self.begin[ids[x : x + CHUNK]] - past[x : x + len(k)] + begin, k) + np.arange(end - begin)]
            right[np.searchsorted(ends, begin + np.flatnonzero(got != wanted[begin:end]), "right")] = False
        return right

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation."""
        if not ids:
            return ""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


def _least(values: np.ndarray, count: int) -> np.ndarray:
    """Places of the least values, of equals the first ones, in order."""
    bound = np.partition(values, count - 1)[count - 1]
    some = np.flatnonzero(values <= bound)
    return some[np.argsort(values[some], kind="stable")][:count]


@lru_cache(maxsize=2)
def encoder(model: str) -> Encoder:
    return Encoder(model)


def _changes(rows: list[list[list[Change]]]) -> pa.Array:
    """The changes of each rank of each text as one nested array."""
    ranks = [r for row in rows for r in row]
    flat = [c for r in ranks for c in r]
    ends = lambda lists: pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32))
    size = lambda k: np.array([len(c[k]) // 4 for c in flat], np.int32)
    ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size(2))]).astype(np.int32)), pa.array(np.frombuffer(b"".join([c[2] for c in flat]), "<i4")))
    structs = pa.StructArray.from_arrays([pa.array([c[0] for c in flat], pa.int32()), pa.array(size(1)), ids], names=["place", "size", "ids"])
    return pa.ListArray.from_arrays(ends(rows), pa.ListArray.from_arrays(ends(ranks), structs))


def nbest_ids(ids: str = "ids", changes: str = "nbest_changes") -> Column:
    """Full ids of every segmentation, best first."""
    put = lambda x, c: F.concat(F.slice(x, F.lit(1), c["place"]), c["ids"], F.slice(x, c["place"] + c["size"] + 1, F.size(x)))
    return F.transform(changes, lambda way: F.aggregate(F.reverse(way), F.col(ids), put))


def decode(encoded: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``encoded`` with the text of the pieces in ``ids``, in place of a column ``out``; null ids give null."""
    common.small_batches(encoded.sparkSession)
    base = encoded.drop(out)
    schema = base.withColumn(out, F.lit("")).schema

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(model)
        for b in batches:
            texts = [None if x is None else machine.decode(x) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return base.mapInArrow(run, schema)


def encode(documents: DataFrame, model: str, nbest: int = NBEST) -> DataFrame:
    """doc_id, n_pieces, ids, nbest_scores, nbest_pieces, nbest_changes and whether decoding every rank gives the text back; a single pass without a shuffle.

    ``nbest_changes`` has for each rank the runs of ``ids`` that it replaces, by place from 0 and in order; ``nbest_ids`` applies them.
    """
    common.small_batches(documents.sparkSession)
    rows = documents.select("doc_id", "text")
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_pieces int, ids array<int>, nbest_scores array<double>, nbest_pieces array<int>, nbest_changes array<array<struct<place:int,size:int,ids:array<int>>>>, round_trip boolean"

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(model)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
                    size += len(texts[j])
                    j += 1
                made = machine(texts[i:j], nbest)
                flat = np.frombuffer(b"".join(m[0] for m in made), "<i4")
                at = np.concatenate([[0], np.cumsum([len(m[0]) // 4 for m in made])]).astype(np.int32)
                back = [bool(g) and all(machine._same(c) for w in m[3] for c in w) for g, m in zip(machine._gives(flat, at, texts[i:j]), made)]
                cols = [
                    b.column("doc_id").slice(i, j - i), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)),
                    pa.array([m[1] for m in made], pa.list_(pa.float64())), pa.array([m[2] for m in made], pa.list_(pa.int32())), _changes([m[3] for m in made]), pa.array(back),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_pieces", "ids", "nbest_scores", "nbest_pieces", "nbest_changes", "round_trip"])
                i = j

    return rows.mapInArrow(run, schema)
