"""Token counts: greedy longest-match piece counts by a linear automaton.

The vocabulary's trie over UTF-8 bytes gets, per node, a failure link (the node
reached once the longest-match pieces of its string are popped) and the number
of pieces popped.  Resolving the links byte by byte gives one dense table of
next node and popped count, so each byte costs one lookup and no piece is ever
built.  numpy walks all words of a chunk side by side.

Words are runs of bytes other than space and U+0009..U+000D, each led by the
space mark U+2581; matching is greedy, longest first, within a word.  A byte
that no piece covers is a piece by itself.

Defined cases: null, empty and blank texts have no words and no pieces; text of
any length and one word of any length is counted whole; repeated rows count
alike; null doc_ids stay; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, pieces, shingles

CHUNK = 1_000_000


class Automaton:
    def __init__(self, vocabulary: list[bytes], lead: bytes) -> None:
        children: list[dict[int, int]] = [{}]
        accepts = [False]
        depth = [0]
        for piece in [bytes([i]) for i in range(256)] + vocabulary:
            at = 0
            for c in piece:
                to = children[at].get(c)
                if to is None:
                    to = children[at][c] = len(children)
                    children.append({})
                    accepts.append(False)
                    depth.append(depth[at] + 1)
                at = to
            accepts[at] = True
        n = len(children)
        self.next = np.zeros((n, 256), np.int32)
        self.popped = np.zeros((n, 256), np.uint8)
        link, pops, rest = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        for c, to in children[0].items():
            self.next[0, c] = to
        level = [0]
        while level:
            below = [(v, c, to) for v in level for c, to in children[v].items()]
            if not below:
                break
            parent, byte, node = (np.array(x) for x in zip(*below))
            whole = np.array([accepts[x] for x in node.tolist()])
            # popping the parent's pieces and then reading the byte, or the node itself when it is a piece
            link[node] = np.where(whole, 0, self.next[link[parent], byte])
            pops[node] = np.where(whole, 1, pops[parent] + self.popped[link[parent], byte])
            rest[node] = pops[node] + rest[link[node]]
            self.next[node] = self.next[link[node]]
            self.popped[node] = self.popped[link[node]] + pops[node][:, None].astype(np.uint8)
            for v in node.tolist():
                for c, to in children[v].items():
                    self.next[v, c] = to
                    self.popped[v, c] = 0
            level = node.tolist()
        self.rest = rest
        self.start, self.before = 0, 0
        for c in lead:
            self.before += int(self.popped[self.start, c])
            self.start = int(self.next[self.start, c])
        self.next, self.popped = self.next.reshape(-1), self.popped.reshape(-1)

    def counts(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word."""
        length = ends - starts
        order = np.argsort(-length, kind="stable")
        first, size = starts[order], length[order]
        state = np.full(len(order), self.start, np.int64)
        total = np.full(len(order), self.before, np.int64)
        live = len(order) - np.searchsorted(size[::-1], np.arange(int(size[0]) if len(size) else 0), "right")
        for t, k in enumerate(live.tolist()):
            at = state[:k] * 256 + raw[first[:k] + t]
            total[:k] += self.popped[at]
            state[:k] = self.next[at]
        total += self.rest[state]
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


@lru_cache(maxsize=2)
def automaton(model: str) -> Automaton:
    names, _, kinds = pieces.vocabulary(model)
    return Automaton([p.encode("utf-8") for p, k in zip(names, kinds) if k == "normal" and p], pieces.SPACE.encode("utf-8"))


def token_counts(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, n_bytes, n_words and n_tokens of every document; a single pass without a shuffle."""
    common.small_batches(documents.sparkSession)
    rows = documents.select("doc_id", "text")
    schema = rows.select("doc_id").withColumns({c: F.lit(0).cast("long") for c in ("n_bytes", "n_words", "n_tokens")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(model)
        for b in batches:
            raw, offsets = shingles.utf8_buffers(b.column("text"))
            words, tokens = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for i, j in shingles.chunks(offsets, CHUNK):
                part = raw[offsets[i] : offsets[j]]
                starts, ends, at = shingles.word_spans(part, offsets[i : j + 1] - offsets[i])
                words[i:j] = np.diff(at)
                sums = np.concatenate([[0], np.cumsum(machine.counts(part, starts, ends))])
                tokens[i:j] = sums[at[1:]] - sums[at[:-1]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(words), pa.array(tokens)], names=["doc_id", "n_bytes", "n_words", "n_tokens"])

    return rows.mapInArrow(run, schema)
