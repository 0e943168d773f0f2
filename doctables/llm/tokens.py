"""Token ids of whole texts from a public tokenizer file, by the tokenizers library.

The library's model encodes each piece (see ``pretokens``) without regard to its neighbours, so the pieces of a slice of texts are
looked up in a memo of fixed size, and only those that it lacks go to the library. Texts with a special string, and
characters that the library's normalizer may change, go through the library whole. Ids are little-endian unsigned 16-bit.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from doctables.llm.common import SpanHasher, numbered, text_bytes
from doctables.llm.pretokens import cuts

SLOTS = 1 << 20
POOL = 1 << 22
TEXT = 1 << 24
#: Longer pieces are computed anew in every slice.
LONGEST = 64
#: Fixed value: the first bytes of UTF-8 characters from U+0100, which normalizing may change.
WIDE_LEAD = 0xC4


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Pieces:
    """A memo of fixed size: from a piece's bytes to its values, held end to end in one pool. Its own bytes stand beside them and are compared."""

    def __init__(self, compute, kind):
        self.compute, self.kind = compute, kind
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
        self.text_at, self.text_size = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0
        self.text, self.text_used = np.zeros(1 << 16, np.uint8), 0

    @staticmethod
    def _longer(pool: np.ndarray, used: int, values: np.ndarray) -> np.ndarray:
        need = used + len(values)
        if need > len(pool):
            pool = np.concatenate((pool, np.zeros(max(need, len(pool)), pool.dtype)))
        pool[used:need] = values
        return pool

    def _known(self, raw: np.ndarray, starts: np.ndarray, size: np.ndarray, hashes: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Whether the slot of each piece holds that very piece."""
        known = (self.keys[slot] == hashes) & (self.text_size[slot] == size)
        maybe = np.flatnonzero(known)
        if len(maybe):
            n = size[maybe].astype(np.int64)
            first = np.cumsum(n) - n
            inner = np.arange(n.sum()) - np.repeat(first, n)
            same = raw[np.repeat(starts[maybe], n) + inner] == self.text[np.repeat(self.text_at[slot[maybe]], n) + inner]
            known[maybe] = np.logical_and.reduceat(same, first)
        return known

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per piece: where its values begin in the pool, and how many there are. Pieces hold at least a byte and do not overlap."""
        if self.used > POOL or self.text_used > TEXT:
            self.clear()
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        number, pieces = numbered(data, starts, ends)
        offsets, raw = np.frombuffer(pieces.buffers()[1], np.int64, count=len(pieces) + 1), np.frombuffer(pieces.buffers()[2], np.uint8)
        begin, long = offsets[:-1], np.diff(offsets)
        hashes = SpanHasher(raw)(begin, offsets[1:]) | np.uint64(1)
        slot = (hashes >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)
        known = self._known(raw, begin, long, hashes, slot)
        at, size = self.at[slot], self.size[slot]
        new = np.flatnonzero(~known)
        if len(new):
            whole = raw.tobytes()
            found = [self.compute(whole[a:b]) for a, b in zip(begin[new].tolist(), offsets[1:][new].tolist())]
            size[new] = [len(x) for x in found]
            at[new] = self.used + np.cumsum(size[new], dtype=np.int64) - size[new]
            self.pool = self._longer(self.pool, self.used, np.array([x for values in found for x in values], self.kind))
            self.used += int(size[new].sum(dtype=np.int64))
            short = new[long[new] <= LONGEST]
            n = long[short]
            first = np.cumsum(n) - n
            self.text = self._longer(self.text, self.text_used, raw[np.repeat(begin[short] - first, n) + np.arange(n.sum())])
            self.keys[slot[short]], self.at[slot[short]], self.size[slot[short]] = hashes[short], at[short], size[short]
            self.text_at[slot[short]], self.text_size[slot[short]] = self.text_used + first, n
            self.text_used += int(n.sum())
        return at[number], size[number]

    def gather(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The values of these pieces end to end."""
        ends = np.cumsum(size, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(at - (ends - size), size) + np.arange(total)]


class Encoder:
    """Ids of slices of texts for one byte-level tokenizer file whose ids fit in 16 bits."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit in 16 bits")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bare = self.tokenizer.normalizer is not None
        self.model, self.letters = self.tokenizer.model, dict(enumerate(byte_letters()))
        self.pieces = Pieces(self._piece, np.uint16)

    def _piece(self, raw: bytes) -> list[int]:
        if self.bare:
            raw = raw.decode().lower().encode()
        return [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.letters))]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2")

    def slice(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the number of each text's ids (a missing text has none)."""
        data, offsets = text_bytes(column)
        raw, odd = data.tobytes(), set()
        for special in self.special:
            k = raw.find(special)
            while k >= 0:
                odd.add(int(np.searchsorted(offsets, k, side="right")) - 1)
                k = raw.find(special, k + 1)
        if self.bare:
            odd |= set(np.unique(np.searchsorted(offsets, np.flatnonzero(data >= WIDE_LEAD), side="right") - 1).tolist())
        at, size = self.pieces(data, *(bounds := cuts(data, offsets, self.bare)))
        ids = self.pieces.gather(at, size)
        edges = np.searchsorted(bounds[0], offsets)
        total = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[edges]
        counts = np.diff(total)
        if odd:
            out = [ids[a:b] for a, b in zip(total[:-1].tolist(), total[1:].tolist())]
            for j in odd:
                out[j] = self.whole(raw[offsets[j] : offsets[j + 1]].decode())
            ids, counts = np.concatenate(out), np.array([len(x) for x in out])
        return ids, counts


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id behind each text."""
    counts = counts + 1
    out = np.full(int(counts.sum()), end_id, "<u2")
    inner = np.ones(len(out), bool)
    inner[np.cumsum(counts) - 1] = False
    out[np.flatnonzero(inner)] = ids
    return out, counts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file in a Python worker."""
    return Encoder(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
