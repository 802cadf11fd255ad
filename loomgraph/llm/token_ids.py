"""Token-ID binary output: fixed-width bit packing with block offsets.

A file holds whole documents in order.  Ids are packed in ``bits`` bits, the
fewest that hold the vocabulary, little-endian, in blocks of ``BLOCK`` ids that
start on a byte of their own, so numpy unpacks a block with a few shifts and
any id range is read from its blocks alone.

Files of about ``FILE_BYTES`` of text follow each other inside a key range, so
neither a task nor the driver holds a range whole.

Layout: a JSON header of fixed fields padded to ``HEADER`` bytes, then doc ids
(int64), their validity (uint8), document offsets in ids (uint64, one more than
documents), block offsets in bytes (uint64, one more than blocks), the blocks.

Defined cases: a null text encodes as empty; every document ends with
``end_id``; repeated doc_ids keep their rows, ordered by text; null doc_ids come
first; an empty table writes no file and gives no row; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import common, storage

BLOCK = 4096
HEADER = 256
MAGIC = "token-ids-1"
END_ID = 2
#: Texts of about so many bytes, or one document, go into one file.
FILE_BYTES = 16_000_000
#: Key ranges at most, each written by one task, file after file; their bounds and sums come to the driver.
RANGES = 4096
#: Entries of a worker's word cache, which is emptied when full.
CACHE = 300_000


def width_of(vocabulary: int) -> int:
    """Bits of the largest id."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in a little-endian bit stream, padded to whole groups of 64 ids."""
    n = -(-len(ids) // 64)
    padded = np.zeros(n * 64, np.uint64)
    padded[: len(ids)] = ids
    grid = padded.reshape(n, 64).T
    words = np.zeros((bits, n), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[word] |= grid[j] << np.uint64(shift)
        if shift + bits > 64:
            words[word + 1] |= grid[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    words = np.ascontiguousarray(np.frombuffer(data, "<u8").reshape(-1, bits).T)
    mask = np.uint64((1 << bits) - 1)
    out = np.empty((64, words.shape[1]), np.uint32)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = words[word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[word + 1] << np.uint64(64 - shift))
        out[j] = x & mask
    return out.T.reshape(-1)[:count]


def file_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int) -> list[bytes]:
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    at = np.zeros(len(blocks) + 1, "<u8")
    np.cumsum([len(b) for b in blocks], out=at[1:])
    docs = np.zeros(len(lengths) + 1, "<u8")
    np.cumsum(lengths, out=docs[1:])
    head = json.dumps({"magic": MAGIC, "bits": bits, "block": BLOCK, "docs": len(lengths), "ids": len(ids)}).encode().ljust(HEADER)
    valid = np.array([x is not None for x in doc_ids], np.uint8)
    keys = np.array([x or 0 for x in doc_ids], "<i8")
    return [head, keys.tobytes(), valid.tobytes(), docs.tobytes(), at.tobytes(), *blocks]


class TokenFile:
    """Random access to the ids of one file; only the blocks asked for are read."""

    def __init__(self, uri: str) -> None:
        fs, path = storage.filesystem(uri)
        self._file = fs.open_input_file(path)
        head = json.loads(self._file.read_at(HEADER, 0))
        if head["magic"] != MAGIC:
            raise ValueError(f"not a token-id file: {uri}")
        self.bits, self.block, n, self.n_ids = head["bits"], head["block"], head["docs"], head["ids"]
        blocks = -(-self.n_ids // self.block)
        sizes = [8 * n, n, 8 * (n + 1), 8 * (blocks + 1)]
        raw = self._file.read_at(sum(sizes), HEADER)
        cuts = np.cumsum([0, *sizes])
        part = lambda i, kind: np.frombuffer(raw[cuts[i] : cuts[i + 1]], kind)
        self.doc_ids, self.valid, self.starts, self._at = part(0, "<i8"), part(1, np.uint8), part(2, "<u8").astype(np.int64), part(3, "<u8").astype(np.int64)
        self._data = HEADER + int(cuts[-1])

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_: object) -> None:
        self._file.close()

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        raw = self._file.read_at(int(self._at[last + 1] - self._at[first]), self._data + int(self._at[first]))
        count = min(self.n_ids, (last + 1) * self.block) - first * self.block
        return unpack(raw, self.bits, count)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


class WordEncoder:
    """Ids of texts by a tokenizers file, remembering the ids of words.

    A text of plain Latin letters, digits, punctuation, spaces and newlines in
    composed form is lower-cased and cut here as the file's normaliser and
    pre-tokenizer do, and the library's model encodes words not met before.
    Any other text goes through the library whole.
    """

    #: Fixed value: the pre-tokenizer's pattern, as its file states it.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Code points U+0021..U+017E but for controls, the no-break space, the soft hyphen and dotted or dotless I of U+0130 and U+0131.
    PLAIN = "\x21-\x7e\xa1-\xac\xae-\u012f\u0132-\u017e"
    #: The letters and digits (\\p{N}) among them.
    LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0132-\u017e"
    DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.size = self.whole.get_vocab_size()
        spec = json.loads(self.whole.to_str())
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.known = split.get("pattern", {}).get("Regex") == self.PATTERN and steps == ["NFC", "Replace", "Lowercase"]
        self.plain = re.compile(f"[ \n{self.PLAIN}]*")
        # letters, digits and the apostrophe exclude each other, so the commonest is tried first
        self.cut = re.compile(f"[{self.LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{self.DIGITS}]|[^ \n{self.LETTERS}{self.DIGITS}]+")
        self.cut_ascii = re.compile("[a-z]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^ \na-z0-9]+")  # of lower-cased ASCII
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.size, bool)
        for piece, i in self.whole.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        # byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [i for i in range(256) if i not in printable]
        self.table = "".join(chr(i) if i in printable or i == 32 else chr(256 + others.index(i)) for i in range(256))  # but the space between words
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        text = codecs.charmap_decode(" ".join(new).encode("utf-8"), "strict", self.table)[0]
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        stop = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(stop) != len(new):
            raise ValueError("a word did not end in one piece")
        raw, begin = ids.tobytes(), 0
        for p, end in zip(new, stop.tolist()):
            self.words[p] = raw[begin:end]
            begin = end

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut: list[list[str] | None] = []
        for t in texts:
            plain = self.known and self.plain.fullmatch(t) and "<|" not in t and unicodedata.is_normalized("NFC", t)
            cut.append((self.cut_ascii if t.isascii() else self.cut).findall(t.lower()) if plain else None)
        if len(self.words) > CACHE:  # words of the last round stay at hand
            self.words, self.older = {}, self.words
        words, older = self.words, self.older
        new = []
        for w in set().union(*[c for c in cut if c]).difference(words):
            if (ids := older.get(w)) is None:
                new.append(w)
            else:
                words[w] = ids
        for i in range(0, len(new), 2000):
            self._learn(new[i : i + 2000])
        get = words.__getitem__
        whole = lambda t: np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        return [whole(t) if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut)]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of a worker, with the words that its earlier tasks have met."""
    return WordEncoder(path)


def _write_ranges(encoder: Callable[[], WordEncoder], folder: str, end_id: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        bits = width_of(max(encode.size, end_id + 1))
        tail = np.array([end_id], "<u4").tobytes()
        held, part, filled, docs, lengths, ids = None, 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            uri = f"{folder}/ids-{held:06d}-{part:06d}.bin"
            flat = np.concatenate([np.frombuffer(x, "<u4") for x in ids])
            storage.put(uri, file_bytes(docs, np.array(lengths), flat, bits))
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([part], pa.int32()), pa.array([uri]), pa.array([len(flat)], pa.int64())], names=["range", "part", "uri", "n_ids"])

        for b in batches:
            keys, ranges, texts = b.column("doc_id").to_pylist(), b.column("_range").to_pylist(), b.column("text").to_pylist()
            i = 0
            while i < len(keys):
                j, size = i, 0
                while j < len(keys) and ranges[j] == ranges[i] and (j == i or size < min(common.CHUNK_BYTES, most)):
                    size += len(texts[j])
                    j += 1
                if ranges[i] != held or filled >= most:
                    if held is not None:
                        yield close()
                    part = part + 1 if ranges[i] == held else 0
                    held, filled, docs, lengths, ids = ranges[i], 0, [], [], []
                filled += size
                made = encode(texts[i:j])
                docs += keys[i:j]
                lengths += [len(x) // 4 + 1 for x in made]
                ids.append(b"".join(y for x in made for y in (x, tail)))
                i = j
        if held is not None:
            yield close()

    return run


def write_ids(documents: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode ``documents`` into files in ascending doc_id order; the manifest (range, part, uri, n_ids, start) is returned."""
    spark = documents.sparkSession
    common.small_batches(spark)
    folder = folder or common.shared_path(spark, "token-ids")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    ranged, n = common.key_ranges(rows, F.coalesce("doc_id", F.lit(-(2**63))), min(RANGES, max(common.partitions(spark), -(-size // FILE_BYTES))))
    dealt = rows.withColumn("_range", ranged).repartition(n, "_range").sortWithinPartitions("_range", F.col("doc_id").asc_nulls_first(), "text")
    files = dealt.mapInArrow(_write_ranges(lambda: word_encoder(tokenizer), folder, end_id, FILE_BYTES), "range int, part int, uri string, n_ids long")
    files = common.written(files, "token-manifest")
    start, before = 0, []
    for r in sorted(files.groupBy("range").agg(F.sum("n_ids").alias("n")).collect()):  # a row per range
        before.append((r["range"], start))
        start += r["n"]
    starts = spark.createDataFrame(before, "_range int, _start long")
    earlier = F.sum("n_ids").over(Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = files.withColumn("_own", F.coalesce(earlier, F.lit(0)))
    return files.join(F.broadcast(starts), F.col("range") == F.col("_range")).select("range", "part", "uri", "n_ids", (F.col("_start") + F.col("_own")).alias("start"))


def store_ids(documents: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode ``documents`` where they are read, without a shuffle, into files of bounded size; the manifest (range, part, uri, n_ids) is returned, a range being what a task reads."""
    spark = documents.sparkSession
    common.small_batches(spark)
    folder = folder or common.shared_path(spark, "token-store")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.spark_partition_id().alias("_range"))
    return common.written(rows.mapInArrow(_write_ranges(lambda: word_encoder(tokenizer), folder, end_id, FILE_BYTES), "range int, part int, uri string, n_ids long"), "token-store")


def read_ids(manifest: DataFrame, columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens and ``ids`` or ``ids_crc32``, as asked for."""
    kinds = {"ids": "array<int>", "ids_crc32": "long"}
    schema = "doc_id long, start long, n_tokens long" + "".join(f", {c} {kinds[c]}" for c in columns)

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column("uri").to_pylist(), b.column("start").to_pylist()):
                with TokenFile(uri) as f:
                    n = len(f.doc_ids)
                    step = 2000
                    for i in range(0, n, step):
                        j = min(n, i + step)
                        ids = f.ids(int(f.starts[i]), int(f.starts[j]))
                        at = f.starts[i : j + 1] - f.starts[i]
                        cols = [pa.array(f.doc_ids[i:j], pa.int64(), mask=f.valid[i:j] == 0), pa.array(f.starts[i:j] + start), pa.array(np.diff(at))]
                        for c in columns:
                            if c == "ids":
                                cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                            else:
                                raw = memoryview(ids.astype("<u4").tobytes())
                                cols.append(pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at, at[1:])], pa.int64()))
                        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", *columns])

    files = max(1, manifest.count())
    return manifest.repartition(files).mapInArrow(run, schema)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def round_trip(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents and read them back: doc_id, start, n_tokens, ids_crc32."""
    return read_ids(write_ids(documents, tokenizer), ("ids_crc32",))
