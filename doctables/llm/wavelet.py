"""Token ids of a corpus as wavelet matrices, one file value per shard.

A shard holds the ids of consecutive documents. Ids are replaced by codes, the most frequent id first, and the codes are written as
bit planes from the highest bit down; after each plane the codes are dealt out, zeros first, in their order. Planes are compressed in
blocks, each with the number of ones before it. From this one value a reader gets the token at a place (``access``), the number of a
token before a place (``rank``), the place of its k-th occurrence (``select``) and the documents, opening only the blocks it needs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doctables.llm.common import SLICE_BYTES, renamed, slices
from doctables.llm.tokens import encoder, with_end
from doctables.sinks.stored import stored

MAGIC = b"WVM1"
HEAD = struct.Struct("<4sQQIB")
BLOCK_BITS = 1 << 18
SHARD_TOKENS = 1 << 20
END_ID = 0


def pack_shard(ids: np.ndarray, doc_ids: list, sizes: np.ndarray) -> bytes:
    """The file value of one shard: ids of all documents end to end, the documents' ids (null allowed) and sizes."""
    counts = np.bincount(ids, minlength=1)
    alphabet = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype("<u4")
    code = np.zeros(len(counts), np.uint16)
    code[alphabet] = np.arange(len(alphabet))
    order, levels = code[ids], max(len(alphabet) - 1, 0).bit_length()
    pack = zstandard.ZstdCompressor(level=1).compress
    zeros, ranks, ends, parts = [], [], [], []
    for level in range(levels - 1, -1, -1):
        bit = (order >> level) & 1
        ones = bit.astype(bool)
        plane = np.packbits(ones)
        for a in range(0, len(order), BLOCK_BITS):
            ranks.append(int(bit[a : a + BLOCK_BITS].sum(dtype=np.int64)))
            parts.append(pack(plane[a >> 3 : (a + BLOCK_BITS) >> 3]))
            ends.append(len(parts[-1]))
        low = order.take(np.flatnonzero(~ones))
        zeros.append(len(low))
        order = np.concatenate((low, order.take(np.flatnonzero(ones))))
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    named = np.array([d or 0 for d in doc_ids], dtype="<i8")
    fixed = [alphabet, named, np.packbits(known), np.asarray(sizes, "<u8"), np.array(zeros, "<u8"), np.array(ranks, "<u4"), np.array(ends, "<u4")]
    return HEAD.pack(MAGIC, len(ids), len(doc_ids), len(alphabet), levels) + b"".join(x.tobytes() for x in fixed) + b"".join(parts)


class Shard:
    """Reads a shard's value; blocks of bit planes are opened when they are needed."""

    def __init__(self, value: bytes):
        magic, self.n, self.docs, self.letters, self.levels = HEAD.unpack_from(value)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        self.value, self.at, self.opened = value, HEAD.size, {}
        self.alphabet = self._take("<u4", self.letters)
        named, known = self._take("<i8", self.docs), np.unpackbits(self._take("u1", -(-self.docs // 8)))[: self.docs]
        self.doc_ids = [int(d) if k else None for d, k in zip(named, known)]
        self.starts = np.concatenate(([0], np.cumsum(self._take("<u8", self.docs)))).astype(np.int64)
        blocks = -(-self.n // BLOCK_BITS)
        self.zeros = self._take("<u8", self.levels).astype(np.int64)
        self.before = np.cumsum(np.hstack((np.zeros((self.levels, 1), np.int64), self._take("<u4", self.levels * blocks).reshape(self.levels, blocks))), axis=1)
        self.ends = np.concatenate(([0], np.cumsum(self._take("<u4", self.levels * blocks)))).astype(np.int64) + self.at
        self.blocks = blocks

    def _take(self, kind: str, count: int) -> np.ndarray:
        out = np.frombuffer(self.value, kind, count, self.at)
        self.at += out.nbytes
        return out

    def _bits(self, level: int, block: int) -> np.ndarray:
        key = level * self.blocks + block
        if key not in self.opened:
            raw = zstandard.ZstdDecompressor().decompress(self.value[self.ends[key] : self.ends[key + 1]], max_output_size=BLOCK_BITS >> 3)
            self.opened[key] = np.unpackbits(np.frombuffer(raw, np.uint8))[: min(BLOCK_BITS, self.n - block * BLOCK_BITS)]
        return self.opened[key]

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        block, rest = divmod(i, BLOCK_BITS)
        return int(self.before[level, block]) + (int(self._bits(level, block)[:rest].sum(dtype=np.int64)) if rest else 0)

    def _find(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit of a plane."""
        edges = self.before[level] if bit else np.minimum(np.arange(self.blocks + 1) * BLOCK_BITS, self.n) - self.before[level]
        block = int(np.searchsorted(edges, k, side="right")) - 1
        return block * BLOCK_BITS + int(np.flatnonzero(self._bits(level, block) == bit)[k - edges[block]])

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level in range(self.levels):
            block, rest = divmod(i, BLOCK_BITS)
            bit = int(self._bits(level, block)[rest])
            ones = self._ones(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        found = np.flatnonzero(self.alphabet == token)
        return int(found[0]) if len(found) else None

    def _range(self, code: int, i: int) -> tuple[int, int]:
        """Where the code's occurrences before place i lie in the order after the last plane."""
        a, b = 0, i
        for level in range(self.levels):
            bit = code >> (self.levels - 1 - level) & 1
            x, y = self._ones(level, a), self._ones(level, b)
            a, b = (int(self.zeros[level]) + x, int(self.zeros[level]) + y) if bit else (a - x, b - y)
        return a, b

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before place i."""
        code = self._code(token)
        if code is None:
            return 0
        a, b = self._range(code, i)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of a token."""
        code = self._code(token)
        a, b = self._range(code, self.n) if code is not None else (0, 0)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.levels - 1, -1, -1):
            bit = code >> (self.levels - 1 - level) & 1
            i = self._find(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids in order."""
        codes = np.zeros(self.n, np.uint16)
        for level in range(self.levels - 1, -1, -1):
            raw = b"".join(zstandard.ZstdDecompressor().decompress(self.value[self.ends[k] : self.ends[k + 1]], max_output_size=BLOCK_BITS >> 3) for k in range(level * self.blocks, (level + 1) * self.blocks))
            ones = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).view(bool)
            zeros, out = int(self.zeros[level]), np.empty(self.n, np.uint16)
            out[np.flatnonzero(~ones)] = codes[:zeros]
            out[np.flatnonzero(ones)] = codes[zeros:] | np.uint16(1 << (self.levels - 1 - level))
            codes = out
        return self.alphabet[codes] if self.n else np.zeros(0, "<u4")

    def document(self, j: int) -> np.ndarray:
        """The ids of the shard's j-th document."""
        return np.array([self.access(i) for i in range(self.starts[j], self.starts[j + 1])], dtype="<u4")


SHARDS = "part int, seq int, n_docs long, n_tokens long, value binary"


def shards(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per shard (part, seq, n_docs, n_tokens, value), documents in ascending order of id.

    A missing text has only its end id; a missing id sorts first. Repeated ids all stay, ordered by their text's hash. An empty table
    gives no shard. A shard ends with the first slice of texts
    that brings it to ``shard_tokens``, so a task holds one shard and one slice.
    """
    table = renamed(docs, {"doc_id": id_column, "text": text_column}).select(F.col("doc_id").cast("long"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, names, sizes = TaskContext.get().partitionId(), 0, [], [], []

        def out():
            ids = np.concatenate(held)
            row = [part, seq, len(names), len(ids), pack_shard(ids, names, np.concatenate(sizes))]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "seq", "n_docs", "n_tokens", "value"])

        for batch in slices(batches, "text", min(SLICE_BYTES, 4 * shard_tokens)):
            ids, counts = with_end(*encoder(tokenizer).slice(batch.column("text")), end_id)
            held.append(ids)
            names.extend(batch.column("doc_id").to_pylist())
            sizes.append(counts)
            if sum(map(len, held)) >= shard_tokens:
                yield out()
                seq, held, names, sizes = seq + 1, [], [], []
        if names:
            yield out()

    return table.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, SHARDS)


def digests(files: DataFrame) -> DataFrame:
    """Per document of the shards read back: doc_id, start (ids before it in the corpus), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, value in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "value"))):
                shard = Shard(value)
                raw, starts = memoryview(np.ascontiguousarray(shard.tokens(), "<u4")).cast("B"), shard.starts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                n = shard.docs
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    sizes = files.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # one row per task that wrote
    parts = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_part_start"))
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    starts = sizes.join(parts, "part").select("part", "seq", (F.col("_part_start") + before).alias("_start"))
    docs = files.select("part", "seq", "value").mapInArrow(read, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def wavelet_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the shards to the cluster's shared folder and read the files back."""
    return stored(shards(docs, tokenizer, **options))
