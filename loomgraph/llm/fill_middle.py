"""Fill-in-middle transformation over a succinct index of code points.

The bytes of many texts lie in one buffer.  A bit vector marks the first byte of
every code point; packed in 64-bit words, with the number of set bits before
each block of ``BLOCK`` bits, it answers ``rank`` (code points before a byte)
and ``select`` (byte of a code point) for whole batches of queries.  The rank
over a text is its length n, and two selects give the bytes at which prefix and
middle end, so no text is decoded or cut code point by code point.

Where the cuts fall and which form a document takes follow from a hash of its
doc_id alone, so reruns and any partitioning agree.

Defined cases: a null or empty text is plain and empty; a null doc_id hashes as
an empty number; a text that holds a sentinel stays plain, as it could not be
taken apart again; repeated rows give equal results; bytes that are no UTF-8
count by their leading bits and come back as they were; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, shingles

#: Prefix, suffix and middle sentinels.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 1
#: Of a hundred documents, how many are rearranged, and of these, how many begin with their suffix.
CHANGED = 90
SUFFIX_FIRST = 20
#: Bits of a block of the directory.
BLOCK = 512
_WORDS = BLOCK // 64

#: Place of set bit number k of each byte value.
_IN_BYTE = np.zeros((256, 8), np.int64)
for _v in range(256):
    _on = np.flatnonzero([_v >> _i & 1 for _i in range(8)])
    _IN_BYTE[_v, : len(_on)] = _on


class CodePoints:
    """Rank and select over the bits that mark the first bytes of code points."""

    def __init__(self, raw: np.ndarray) -> None:
        self.size = len(raw)
        packed = np.packbits((raw & 0xC0) != 0x80, bitorder="little")
        held = np.zeros((len(raw) // BLOCK + 1) * BLOCK // 8, np.uint8)
        held[: len(packed)] = packed
        self.words = held.view("<u8").reshape(-1, _WORDS)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.int64), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that start before each byte position, the end of the buffer included."""
        block, word, bit = at // BLOCK, at % BLOCK // 64, (at % 64).astype(np.uint64)
        of = self.words[block]
        whole = np.where(np.arange(_WORDS) < word[:, None], np.bitwise_count(of), 0).sum(axis=1, dtype=np.int64)
        part = np.take_along_axis(of, word[:, None], axis=1)[:, 0] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + whole + np.bitwise_count(part)

    def select(self, k: np.ndarray) -> np.ndarray:
        """First byte of code point number ``k``, counted from 0; the end of the buffer for the one after the last."""
        out = np.full(len(k), self.size, np.int64)
        real = np.flatnonzero(k < self.before[-1])
        k = k[real]
        block = np.searchsorted(self.before, k, "right") - 1
        at, k = block * BLOCK, k - self.before[block]
        for parts, bits in ((self.words[block], 64), (None, 8)):
            if parts is None:
                parts = np.ascontiguousarray(word).view(np.uint8).reshape(-1, 8)
            upto = np.cumsum(np.bitwise_count(parts), axis=1, dtype=np.int64)
            i = (upto <= k[:, None]).sum(axis=1)[:, None]
            word = np.take_along_axis(parts, i, axis=1)
            k = k - np.where(i > 0, np.take_along_axis(upto, np.maximum(i - 1, 0), axis=1), 0)[:, 0]
            at = at + i[:, 0] * bits
        out[real] = at + _IN_BYTE[word[:, 0], k]
        return out


def _draws(seed: int) -> list[Column]:
    """Four numbers below 2^32 of each doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(documents: DataFrame, seed: int = SEED, sentinels: tuple[str, str, str] = SENTINELS, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Per document: doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars and ``output``, its text in that form."""
    common.small_batches(documents.sparkSession)
    marks = [s.encode() for s in sentinels]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *_draws(seed))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = shingles.utf8_buffers(b.column("text"))
            draws = [b.column(f"h{i}").to_numpy() for i in range(1, 5)]
            for i, j in shingles.chunks(offsets, common.CHUNK_BYTES):
                part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                index = CodePoints(part)
                first = index.rank(at)
                n = np.diff(first)
                h1, h2, h3, h4 = (h[i:j] for h in draws)
                x, y = h1 % (n + 1), h2 % (n + 1)
                low, high = np.minimum(x, y), np.maximum(x, y)
                p, m = (np.minimum(index.select(first[:-1] + k), at[1:]).tolist() for k in (low, high))
                data, out, form = part.tobytes(), [], []
                for s, e, a, c, plain, behind in zip(at.tolist(), at[1:].tolist(), p, m, (h3 % 100 >= changed).tolist(), (h4 % 100 < suffix_first).tolist()):
                    text = data[s:e]
                    if plain or not text or any(x in text for x in marks):
                        form.append("plain")
                        out.append(text)
                        continue
                    sides = [marks[0] + data[s:a], marks[1] + data[c:e]]
                    form.append("spm" if behind else "psm")
                    out.append(b"".join([*(sides[::-1] if behind else sides), marks[2], data[a:c]]))
                none = np.array([f == "plain" for f in form], bool)
                columns = [b.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()), pa.array(form), pa.array(low, pa.int64(), mask=none), pa.array(high - low, pa.int64(), mask=none)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], names=names)

    made = rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made of: as a part never holds a sentinel, these alone cut it."""
    first, second, third = sentinels
    places = {s: F.instr(output, s) for s in sentinels}

    def between(s: str, stop: Column) -> Column:
        return F.substring(output, places[s] + len(s), stop - places[s] - len(s))

    end = F.char_length(output) + 1
    psm = F.concat(between(first, places[second]), between(third, end), between(second, places[third]))
    spm = F.concat(between(first, places[third]), between(third, end), between(second, places[first]))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(documents: DataFrame) -> DataFrame:
    """``transform`` with the hashes of the output and of the text rebuilt from it in place of the output."""
    made = transform(documents)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
