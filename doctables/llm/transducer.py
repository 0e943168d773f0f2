"""Exact token counts by a finite-state transducer compiled from a byte-level vocabulary.

Inside a piece, a state holds what later bytes can still depend on: the suffixes that some token begins with, the last token before each,
and how many tokens it took to get there. A byte leads to one next state and changes the count by a number written on the transition.
States are built when a text first needs them, from merge ranks alone. A chunk of a text maps whatever state it is entered in to a count
and the state it leaves: it is fixed from its first cut before white space to its last one, and what lies outside stays open until a
neighbour joins. These maps compose associatively, so long texts are counted chunk by chunk on any executor and joined in two levels.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.llm.common import renamed, slices, text_bytes
from doctables.llm.pretokens import SPACE, classes, code_points, cuts
from doctables.llm.tokens import Pieces, byte_letters

CHUNK_BYTES = 1 << 18
BLOCK_CHUNKS = 256
STATES = 1 << 19
START = ((b"", -1, 0),)


class Transducer:
    """count(piece) for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = {letter: b for b, letter in enumerate(byte_letters())}
        raw = lambda shown: bytes(back[c] for c in shown)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        special = {t["content"] for t in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.names = {i: t for t, i in self.ids.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.prefixes = {t[:k] for t in self.ids for k in range(len(t))}
        self.stays: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states, self.number, self.next = [START], {START: 0}, {}

    def merged(self, raw: bytes) -> list[bytes]:
        """The tokens of a few bytes, merged by rank."""
        parts = [raw[k : k + 1] for k in range(len(raw))]
        while len(parts) > 1:
            rank, k = min((self.ranks.get(pair, 1 << 62), k) for k, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 62:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _stays(self, before: int, token: int) -> bool:
        """Two tokens (or one, at the start of a piece) stay as they are when their bytes are merged."""
        key = (before, token)
        if key not in self.stays:
            tokens = [self.names[x] for x in key if x >= 0]
            self.stays[key] = self.merged(b"".join(tokens)) == tokens
        return self.stays[key]

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the change of the count."""
        letter, live, found = bytes([byte]), [], None
        for suffix, before, count in self.states[state]:
            longer = suffix + letter
            token = self.ids.get(longer)
            if token is not None and found is None and self._stays(before, token):
                found = (token, count + 1)
            if longer in self.prefixes:
                live.append((longer, before, count))
        token, change = found
        key = (*((s, b, c - change) for s, b, c in live), (b"", token, 0))
        target = self.number.get(key)
        if target is None:
            target = self.number[key] = len(self.states)
            self.states.append(key)
        self.next[state << 8 | byte] = (target, change)
        return target, change

    def count(self, piece: bytes) -> int:
        if len(self.states) > STATES:
            self.reset()
        state, total, known = 0, 0, self.next
        for byte in piece:
            state, change = known.get(state << 8 | byte) or self.step(state, byte)
            total += change
        return total


class Counter:
    """Counts of slices of texts: pieces seen before come from a memo of fixed size."""

    def __init__(self, path: str):
        self.transducer = Transducer(path)
        self.pieces = Pieces(lambda raw: [self.transducer.count(raw)], np.int32)

    def _runs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        starts, ends = cuts(data, offsets, bare=False)
        at, _ = self.pieces(data, starts, ends)
        total = np.concatenate(([0], np.cumsum(self.pieces.pool[at], dtype=np.int64)))
        return np.diff(total[np.searchsorted(starts, offsets)])

    def many(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text; a special string is one token and parts what stands around it."""
        out, raw = self._runs(data, offsets), data.tobytes()
        for special in self.transducer.special:
            if special in raw:
                for j, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    if special in raw[a:b]:
                        parts = raw[a:b].split(special)
                        bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
                        out[j] = self._runs(np.frombuffer(b"".join(parts), np.uint8), bounds).sum() + len(parts) - 1
        return out

    def one(self, raw: bytes) -> int:
        return int(self.many(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])

    def chunk(self, raw: bytes) -> tuple[bytes, int, bytes | None]:
        """A chunk's map: open bytes at its start, tokens between its first and last cut, open bytes at its end (None: no cut)."""
        data = np.frombuffer(raw, np.uint8)
        at, points = code_points(data)
        space = classes()[points] == SPACE
        sure = at[1:][space[1:] & ~space[:-1]]
        if not len(sure):
            return raw, 0, None
        a, b = int(sure[0]), int(sure[-1])
        return raw[:a], self.one(raw[a:b]) if a < b else 0, raw[b:]

    def join(self, left: tuple, right: tuple) -> tuple[bytes, int, bytes | None]:
        """The map of two neighbouring chunks."""
        if left[2] is None:
            if right[2] is None:
                return self.chunk(left[0] + right[0])
            head, count, tail = self.chunk(left[0] + right[0])
            return (head, right[1], right[2]) if tail is None else (head, count + self.one(tail) + right[1], right[2])
        if right[2] is None:
            head, count, tail = self.chunk(left[2] + right[0])
            if tail is None:
                return left[0], left[1], head
            return left[0], left[1] + (self.one(head) if head else 0) + count, tail
        return left[0], left[1] + self.one(left[2] + right[0]) + right[1], right[2]

    def close(self, whole: tuple) -> int:
        return self.one(whole[0]) + whole[1] + (self.one(whole[2]) if whole[2] else 0)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def _cut(raw: bytes, most: int) -> Iterator[bytes]:
    """Chunks of at most ``most`` bytes that split no character."""
    a = 0
    while a < len(raw):
        b = min(a + most, len(raw))
        while b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        yield raw[a:b]
        a = b


COUNTED = "doc_id long, n_bytes long, n_tokens long"
MAPS = "row long, doc_id long, n_bytes long, block long, k long, head binary, inner long, tail binary"


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, chunk_bytes: int = CHUNK_BYTES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. A missing or empty text has no token. Every row is counted, ids may repeat.

    Texts of up to ``chunk_bytes`` are counted where they are read; longer ones are dealt out by chunk. A run of characters without
    white space stays open and is carried whole.
    """
    if chunk_bytes < 4:
        raise ValueError("a chunk must hold a character")
    table = renamed(docs, {"doc_id": id_column, "text": text_column}).select(F.col("doc_id").cast("long"), "text")
    long = F.octet_length("text") > chunk_bytes

    def short_texts(batches):
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            counts = counter(tokenizer).many(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])

    def to_chunks(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                raw = text.encode()
                for k, chunk in enumerate(_cut(raw, chunk_bytes)):
                    yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc_id, "n_bytes": len(raw), "k": k, "chunk": chunk}], pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("k", pa.int64()), ("chunk", pa.binary())]))
                row += 1

    def to_maps(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                head, inner, tail = counter(tokenizer).chunk(r["chunk"])
                out.append({"row": r["row"], "doc_id": r["doc_id"], "n_bytes": r["n_bytes"], "block": r["k"] // BLOCK_CHUNKS, "k": r["k"], "head": head, "inner": inner, "tail": tail})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([(n, t) for n, t in zip(("row", "doc_id", "n_bytes", "block", "k"), [pa.int64()] * 5)] + [("head", pa.binary()), ("inner", pa.int64()), ("tail", pa.binary())]))

    def composed(group: pd.DataFrame) -> tuple:
        group = group.sort_values("k")
        maps = [(h, int(i), None if t is None else t) for h, i, t in zip(group["head"], group["inner"], group["tail"])]
        while len(maps) > 1:  # neighbours in pairs: as deep as the logarithm of their number
            maps = [counter(tokenizer).join(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def join_block(group: pd.DataFrame) -> pd.DataFrame:
        head, inner, tail = composed(group)
        return group.head(1)[["row", "doc_id", "n_bytes", "block"]].assign(k=group["block"].iloc[0], head=[head], inner=inner, tail=[tail])

    def join_text(group: pd.DataFrame) -> pd.DataFrame:
        return group.head(1)[["doc_id", "n_bytes"]].assign(n_tokens=counter(tokenizer).close(composed(group)))

    short = table.filter(~F.coalesce(long, F.lit(False))).mapInArrow(short_texts, COUNTED)
    chunks = table.filter(long).mapInArrow(to_chunks, "row long, doc_id long, n_bytes long, k long, chunk binary")
    maps = chunks.repartition("row", "k").mapInArrow(to_maps, MAPS)
    blocks = maps.groupBy("row", "block").applyInPandas(join_block, MAPS)
    counted = short.unionByName(blocks.groupBy("row").applyInPandas(join_text, COUNTED))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
