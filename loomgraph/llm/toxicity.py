"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Words are runs of letters, digits and non-ASCII bytes, ASCII lower-cased.  A
word enters as the embedding of its entry in a learned vocabulary plus the sum
of embeddings of its hashed four-byte grams (with a mark on the first), so
unseen inflections still carry their stems.  Every window of ``WINDOW`` words,
``STRIDE`` apart, that covers the text is scored: a forward and a backward GRU,
one attention score a word, a logistic output on the pooled states.  A text's
score is that of its highest window, and training follows the same rule: a
positive text teaches by its highest window, a negative one by its highest and
by others.

Fitting uses a bounded sample: at most ``SAMPLE`` labelled rows outside the
held-out fold, by hash, as many as hold ``SAMPLE_CHARS`` characters together, each
with its whole text (texts beyond ``LONGEST`` characters are not drawn).  Scoring
covers all words of all texts.

Defined cases: null, empty and wordless texts are one window without words and
get the network's base score; null or other labels than 0 and 1 teach nothing;
without any labelled row the score is 0.5 less a hair for all; repeated rows
score alike; null doc_ids are not held out; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import common, shingles

WINDOW, STRIDE = 64, 32
HIDDEN = 8
WORD_DIM = CHAR_DIM = 8
VOCABULARY = 8192
GRAMS = 1 << 14  # with the place of other bytes behind them they fit 16 bits
SAMPLE = 6000
#: Characters of the sample's texts together; training holds about seven bytes for each.
SAMPLE_CHARS = 48_000_000
#: Characters of a text that the sample may draw.
LONGEST = 3_000_000
FOLDS = 5
EPOCHS = 9
CHUNK = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Words:
    """Words of some texts: hash, first byte, and the texts' word offsets; ``grams`` per byte of the buffer."""

    hashes: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    grams: np.ndarray


def words_of(texts: list[str]) -> Words:
    parts = [t.encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    low = np.where(_IN_WORD[raw], _LOWER[raw], np.uint8(0))
    inside = np.concatenate([[False], low > 0, [False]])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    stops = np.flatnonzero(inside[:-1] & ~inside[1:])
    # hash through the shared polynomial, with everything outside words as a space
    hashes, _ = shingles.word_hashes(np.where(low > 0, low, np.uint8(32)), np.array([0, len(low)]))
    v = np.concatenate([low, np.zeros(3, np.uint8)]).astype(np.uint32)
    n = len(low)
    c1 = v[1 : n + 1]
    c2 = np.where(c1 > 0, v[2 : n + 2], 0)
    c3 = np.where(c2 > 0, v[3 : n + 3], 0)
    first = np.zeros(n, np.uint32)
    first[starts] = 1
    g = (v[:n] | (c1 << 8) | (c2 << 16) | (c3 << 24)) ^ (first * np.uint32(0x5BD1E995))
    g = (g * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAMS.bit_length() + 1)
    grams = np.where(low > 0, g, GRAMS).astype(np.uint16)
    assert len(stops) == len(starts) == len(hashes)
    return Words(hashes, starts, np.concatenate([[0], np.searchsorted(starts, ends)]), grams)


def _sums(table: np.ndarray, w: Words) -> np.ndarray:
    """Per word the sum of its grams' rows; the row of a byte outside words is zero."""
    return np.add.reduceat(table[w.grams], w.starts, axis=0) if len(w.starts) else np.zeros((0, *table.shape[1:]), table.dtype)


def windows_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of each window."""
    count = np.diff(at)
    each = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(count)), each)
    nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    first = at[:-1][text] + nth * STRIDE
    return text, first, np.minimum(WINDOW, at[1:][text] - first)


class Network:
    """Weights by name; the leading axis 2 is (forward, backward)."""

    def __init__(self, p: dict[str, np.ndarray], vocabulary: np.ndarray) -> None:
        self.p, self.vocabulary = p, vocabulary

    @classmethod
    def new(cls, vocabulary: np.ndarray, word_odds: np.ndarray, gram_odds: np.ndarray, prior: float) -> Network:
        rng = np.random.default_rng(7)
        f = lambda *s, k=0.3: rng.normal(0, k, s).astype(np.float32)
        word, gram = f(len(vocabulary) + 1, WORD_DIM, k=0.05), f(GRAMS + 1, CHAR_DIM, k=0.05)
        word[:, 0], gram[:, 0] = np.append(word_odds, 0), np.append(gram_odds, 0)
        word[-1], gram[-1] = 0, 0
        p = {
            "word": word, "gram": gram, "in_w": f(2, WORD_DIM, 3 * HIDDEN), "in_c": f(2, CHAR_DIM, 3 * HIDDEN), "in_b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "rec": f(2, HIDDEN, 3 * HIDDEN), "att": f(2, HIDDEN), "out": f(2, HIDDEN), "bias": np.array([prior], np.float32),
        }
        return cls(p, vocabulary)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        slots = len(self._slots) - 1
        i = self._slots[(hashes & np.uint64(slots)).astype(np.int64)]
        hit = self.vocabulary[i] == hashes
        i = np.where(hit, i, len(self.vocabulary))
        for x, k in self._spare.items():
            i[hashes == np.uint64(x)] = k
        return i

    def index(self) -> Network:
        """A direct table over the low bits of the vocabulary's hashes; the few that collide are looked for one by one."""
        bits = 1 << 20
        slot = (self.vocabulary & np.uint64(bits - 1)).astype(np.int64)
        self._slots = np.zeros(bits, np.int32)
        self._slots[slot] = np.arange(len(self.vocabulary))
        lost = np.flatnonzero(self._slots[slot] != np.arange(len(self.vocabulary)))
        self._spare = {int(self.vocabulary[k]): int(k) for k in lost}
        return self

    def inputs(self, w: Words, ids: np.ndarray) -> np.ndarray:
        """Gate inputs of each word, (2, words + 1, 3 H); the last is for places past a window's end."""
        p = self.p
        chars = _sums(p["gram"], w)
        out = np.zeros((2, len(ids) + 1, 3 * HIDDEN), np.float32)
        for d in range(2):
            by_word = p["word"] @ p["in_w"][d]
            np.matmul(chars, p["in_c"][d], out=out[d, :-1])
            out[d, :-1] += by_word[ids]
            out[d, :-1] += p["in_b"][d]
        return out

    def _steps(self, first: np.ndarray, length: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Word index (T, 2, B) of each step and whether it lies in the window."""
        top = max(1, int(length.max(initial=0)))
        t = np.arange(top)[:, None]
        ahead = np.stack([np.broadcast_to(t, (top, len(first))), np.broadcast_to(top - 1 - t, (top, len(first)))], axis=1)
        live = ahead < length
        return np.where(live, first + ahead, words), live

    def score(self, x: np.ndarray, first: np.ndarray, length: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; with ``keep`` the states needed to go back."""
        p, h2, n = self.p, 2 * HIDDEN, len(first)
        idx, live = self._steps(first, length, x.shape[1] - 1)
        top = len(idx)
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((top, 2, n, HIDDEN), np.float32)
        mask = live[..., None].astype(np.float32)
        full = bool(live.all())
        half = np.float32(0.5)
        for t in range(top):
            a = np.empty((2, n, 3 * HIDDEN), np.float32)
            np.take(x[0], idx[t, 0], axis=0, out=a[0])
            np.take(x[1], idx[t, 1], axis=0, out=a[1])
            u = np.matmul(h, p["rec"])
            g = a[..., :h2] + u[..., :h2]
            g *= half
            np.tanh(g, out=g)
            g *= half
            g += half
            z, r = g[..., :HIDDEN], g[..., HIDDEN:]
            c = r * u[..., h2:]
            c += a[..., h2:]
            np.tanh(c, out=c)
            before = h
            h = before - c
            h *= z
            h += c
            if not full:
                h *= mask[t]
            states[t] = h
            if keep is not None:
                keep.setdefault("steps", []).append((before, z.copy(), r.copy(), c, u[..., h2:].copy()))
        # states of one word stand at t (forward) and top - 1 - t (backward)
        e = np.matmul(states[:, 0], p["att"][0]) + np.matmul(states[::-1, 1], p["att"][1])
        inside = live[:, 0]
        e = np.where(inside, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        e *= inside
        e /= np.maximum(e.sum(axis=0), np.float32(1e-9))
        s = np.matmul(states[:, 0], p["out"][0]) + np.matmul(states[::-1, 1], p["out"][1])
        logit = (e * s).sum(axis=0) + p["bias"][0]
        if keep is not None:
            keep.update(idx=idx, mask=mask, states=states, att=e, each=s, logit=logit)
        return logit

    def texts(self, texts: list[str]) -> np.ndarray:
        """The highest window's logit of each text."""
        w = words_of(texts)
        x = self.inputs(w, self.ids(w.hashes))
        text, first, length = windows_of(w.at)
        out = np.full(len(texts), -np.inf, np.float32)
        order = np.argsort(length, kind="stable")
        for s in range(0, len(order), 1024):
            k = order[s : s + 1024]
            np.maximum.at(out, text[k], self.score(x, first[k], length[k]))
        return out

    def gradients(self, w: Words, ids: np.ndarray, first: np.ndarray, length: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, h2 = self.p, 2 * HIDDEN
        k: dict = {}
        x = self.inputs(w, ids)
        logit = self.score(x, first, length, k)
        top, n = len(k["idx"]), len(first)
        d_logit = (1 / (1 + np.exp(-logit)) - label) * weight / weight.sum()
        g = {name: np.zeros_like(a) for name, a in p.items() if name not in ("word", "gram")}
        g["bias"][0] = d_logit.sum()
        att, each, states = k["att"], k["each"], k["states"]
        d_each = att * d_logit
        d_e = att * (each - (att * each).sum(axis=0)) * d_logit
        d_states = np.zeros_like(states)
        for d in range(2):
            st = states[:, 0] if d == 0 else states[::-1, 1]
            g["out"][d] = np.einsum("tb,tbh->h", d_each, st)
            g["att"][d] = np.einsum("tb,tbh->h", d_e, st)
            back = d_each[..., None] * p["out"][d] + d_e[..., None] * p["att"][d]
            if d == 0:
                d_states[:, 0] += back
            else:
                d_states[:, 1] += back[::-1]
        dx = np.zeros_like(x)
        dh = np.zeros((2, n, HIDDEN), np.float32)
        for t in range(top - 1, -1, -1):
            before, z, r, c, un = k["steps"][t]
            dh = (dh + d_states[t]) * k["mask"][t]
            dz = dh * (before - c) * z * (1 - z)
            dc = dh * (1 - z) * (1 - c * c)
            dr = dc * un * r * (1 - r)
            da = np.concatenate([dz, dr, dc], axis=2)
            du = np.concatenate([dz, dr, dc * r], axis=2)
            g["rec"] += np.matmul(before.transpose(0, 2, 1), du)
            for d in range(2):
                np.add.at(dx[d], k["idx"][t, d], da[d])
            dh = dh * z + np.matmul(du, p["rec"].transpose(0, 2, 1))
        dx = dx[:, :-1]
        chars, rows = _sums(p["gram"], w), p["word"][ids]
        d_word, d_char = np.zeros_like(rows), np.zeros_like(chars)
        for d in range(2):
            g["in_b"][d, 0] = dx[d].sum(axis=0)
            g["in_w"][d], g["in_c"][d] = rows.T @ dx[d], chars.T @ dx[d]
            d_word += dx[d] @ p["in_w"][d].T
            d_char += dx[d] @ p["in_c"][d].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], ids, d_word)
        if len(w.starts):
            span = np.diff(np.append(w.starts, len(w.grams)))
            np.add.at(g["gram"], w.grams[w.starts[0] :], np.repeat(d_char, span, axis=0))
        g["word"][-1], g["gram"][-1] = 0, 0
        return g


def _odds(has: np.ndarray, positive: np.ndarray, totals: tuple[int, int], limit: float = 3.0) -> np.ndarray:
    lo = np.log((positive + 0.5) / (totals[0] + 1)) - np.log((has - positive + 0.5) / (totals[1] + 1))
    return np.clip(lo * has / (has + 3.0), -limit, limit).astype(np.float32) * np.float32(0.3)


def train(texts: list[str], labels: np.ndarray) -> Network:
    """Fit on labelled texts; deterministic for a given order."""
    labels = np.asarray(labels, np.float32)
    n_pos, n = int(labels.sum()), len(labels)
    prior = float(np.log((n_pos + 0.5) / (n - n_pos + 1.0)))
    pairs: list[np.ndarray] = []
    grams = np.zeros((2, GRAMS), np.int64)
    parts = []
    begins = []
    while (i := begins[-1] + len(parts[-1].at) - 1 if begins else 0) < n:
        size = np.cumsum([len(t) for t in texts[i : i + 200]])
        w = words_of(texts[i : i + max(1, int(np.searchsorted(size, CHUNK, "right")))])
        begins.append(i)
        parts.append(w)
        for j in range(len(w.at) - 1):
            pairs.append(np.unique(w.hashes[w.at[j] : w.at[j + 1]]))
            lo = w.starts[w.at[j]] if w.at[j] < len(w.starts) else 0
            hi = w.starts[w.at[j + 1]] if w.at[j + 1] < len(w.starts) else len(w.grams)
            seen = np.unique(w.grams[lo:hi]) if w.at[j + 1] > w.at[j] else np.zeros(0, np.int64)
            seen = seen[seen < GRAMS]
            grams[0, seen] += 1
            grams[1, seen] += int(labels[i + j])
    flat = np.concatenate(pairs) if pairs else np.zeros(0, np.uint64)
    hit = np.repeat(labels > 0, [len(x) for x in pairs]) if pairs else np.zeros(0, bool)
    known, where, has = np.unique(flat, return_inverse=True, return_counts=True)
    positive = np.bincount(where, hit, len(known)) if len(known) else np.zeros(0)
    odds = _odds(has, positive, (n_pos, n - n_pos)) if len(known) else np.zeros(0, np.float32)
    usable = np.flatnonzero(has >= 3)
    best = np.sort(usable[np.argsort(-np.abs(odds[usable]), kind="stable")[:VOCABULARY]])
    net = Network.new(known[best], odds[best], _odds(grams[0], grams[1], (n_pos, n - n_pos)), prior).index()
    if not n_pos or n_pos == n:
        net.p["out"][:] = 0
        if n == 0:
            net.p["bias"][0] = -1e-3
        return net
    rng = np.random.default_rng(11)
    moment = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in net.p.items()}
    step = 0
    spans = [windows_of(w.at) for w in parts]
    for epoch in range(EPOCHS):
        tasks = []
        for k, (w, (text, first, length)) in enumerate(zip(parts, spans)):
            ids = net.ids(w.hashes)
            if epoch == 0:  # before training a window counts by what its words say
                value = net.p["word"][ids, 0] + _sums(net.p["gram"][:, :1], w)[:, 0]
                total = np.concatenate([[0], np.cumsum(value)])
                logit = total[first + length] - total[first]
            elif epoch % 3 == 0:
                x = net.inputs(w, ids)
                logit = np.concatenate([net.score(x, first[s : s + 1024], length[s : s + 1024]) for s in range(0, len(first), 1024)])
            else:
                logit = None
            if logit is not None:
                order = np.lexsort((logit, text))
                last = np.append(text[order][1:] != text[order][:-1], True)
                spans[k] = (text, first, length)
                top = order[last]
                w.top = top  # type: ignore[attr-defined]
            label = labels[begins[k] + text]
            more = np.flatnonzero((label == 0) & (rng.random(len(text)) < 2.0 / np.maximum(1, np.bincount(text)[text])))
            tasks.append((w, ids, first, length, label, np.unique(np.concatenate([w.top, more]))))  # type: ignore[attr-defined]
        for k in rng.permutation(len(tasks)):
            w, ids, first, length, label, pick = tasks[k]
            pick = rng.permutation(pick)
            for s in range(0, len(pick), 128):
                q = pick[s : s + 128]
                small, i, f = _only(w, ids, first[q], length[q])
                g = net.gradients(small, i, f, length[q], label[q], np.ones(len(q), np.float32))
                step += 1
                rate = 0.02 * (1 - 0.8 * epoch / EPOCHS)
                for name, a in g.items():
                    m, v = moment[name]
                    m += np.float32(0.1) * (a - m)
                    v += np.float32(0.01) * (a * a - v)
                    net.p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def _only(w: Words, ids: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of some windows alone, window after window."""
    ends = np.append(w.starts[1:], len(w.grams))
    at = np.concatenate([[0], np.cumsum(length)])
    word = np.repeat(first - at[:-1], length) + np.arange(at[-1])
    span = ends[word] - w.starts[word]
    begin = np.concatenate([[0], np.cumsum(span)])
    byte = np.repeat(w.starts[word] - begin[:-1], span) + np.arange(begin[-1])
    return Words(w.hashes[word], begin[:-1], at, w.grams[byte]), ids[word], at[:-1]


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample_of(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text and toxic of labelled rows outside the held-out fold, the least by hash within both bounds; texts are whole, and equal rows count once."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = common.written(chosen.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").alias("_toxic")), "toxic-sample")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(F.col("_id").alias("doc_id"), text.alias("text"), F.col("_toxic").alias("toxic"), F.xxhash64(text).alias("_hash"))
    # a doc_id may stand on many rows: the sizes alone say which rows fit, then their texts are read
    sizes = rows.groupBy("doc_id", "_hash").agg(F.max(F.char_length("text")).alias("n")).where(F.col("n") <= min(LONGEST, SAMPLE_CHARS))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("_hash")]
    upto = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over the sample's rows alone
    fits = common.written(sizes.orderBy(*order).limit(sample).withColumn("_upto", upto).where(F.col("_upto") <= SAMPLE_CHARS).select("doc_id", "_hash"), "toxic-fits")
    return rows.join(F.broadcast(fits), ["doc_id", "_hash"]).groupBy("doc_id", "_hash").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).drop("_hash")


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """A network trained in one task on the bounded sample; only the weights come to the driver."""
    common.small_batches(documents.sparkSession)

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "toxic")]))
        net = train([r[1] for r in rows], np.array([r[2] for r in rows], np.float32))
        made = {**net.p, "vocabulary": net.vocabulary}
        cols = [pa.array(list(made)), pa.array([a.dtype.str for a in made.values()]), pa.array([list(a.shape) for a in made.values()], pa.list_(pa.int32())), pa.array([a.tobytes() for a in made.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["name", "kind", "shape", "data"])

    # one partition even where the sample is empty
    made = sample_of(documents, labels, sample).coalesce(1).mapInArrow(run, "name string, kind string, shape array<int>, data binary").collect()
    p = {r["name"]: np.frombuffer(bytes(r["data"]), r["kind"]).reshape(r["shape"]).copy() for r in made}
    if not p:
        return train([], np.zeros(0, np.float32))
    return Network(p, p.pop("vocabulary")).index()


def _logits(own: Network, texts: list[str]) -> np.ndarray:
    """Scores of texts, about ``CHUNK`` characters at a time."""
    logit = np.empty(len(texts), np.float64)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
            size += len(texts[j])
            j += 1
        logit[i:j] = own.texts(texts[i:j])
        i = j
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def scores(documents: DataFrame, net: Network) -> DataFrame:
    """``documents`` with ``score`` (0 to 1) and ``predicted``, in place of columns of those names; a single pass without a shuffle."""
    spark = documents.sparkSession
    common.small_batches(spark)
    base = documents.drop("score", "predicted")
    schema = base.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema
    shared = spark.sparkContext.broadcast((net.p, net.vocabulary))

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(*shared.value).index()
        for b in batches:
            score = _logits(own, [t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return base.mapInArrow(run, schema)


def without_toxic(documents: DataFrame, net: Network) -> DataFrame:
    """The rows of ``documents`` that score below 0.5, with their own columns."""
    spark = documents.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast((net.p, net.vocabulary))

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(*shared.value).index()
        for b in batches:
            yield b.filter(pa.array(_logits(own, [t or "" for t in b.column("text").to_pylist()]) < 0.5))

    return documents.mapInArrow(run, documents.schema)
