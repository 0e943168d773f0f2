"""Ids of whole texts as a byte-fallback piece model (merge type) gives them, and the texts of ids.

Merging always joins the adjacent symbols whose union is the best piece, the leftmost of equal ones. A row of pieces is what merging
gives exactly if every two neighbours alone are merged to themselves, because a merge across a border happens at the same step whether
or not the rest of the text is there. So a text is encoded from left to right without merging it: from each place the longest piece
(an Aho-Corasick automaton finds all of them in one pass) or the next shorter one that is compatible with the piece before, which a table
of pairs tells; a pair new to the table is merged once. Where no piece fits, the place is marked in a bit field as failed, since only one
row of pieces reaches it, and the piece that led there is taken back.

Two characters that stand side by side in no piece are never joined, so texts are first cut at all such places, and a segment seen before
comes from a memo of fixed size.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.llm.common import renamed, slices, text_bytes
from doctables.llm.pretokens import code_points
from doctables.llm.tokens import Pieces

#: The mark that stands for a space, what an unknown id decodes to, and the character for bytes that are no text.
MARK, UNKNOWN, BROKEN = "▁", " ⁇ ", "�"
PAIRS = 1 << 19
PROBE = " é  ﬁ́  x "


class PieceModel:
    """encode(segment) and decode(ids) for one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        if library.normalize(PROBE) != MARK + PROBE.replace(" ", MARK):
            raise ValueError(f"{os.path.basename(path)} changes texts before it cuts them")
        ids = range(library.get_piece_size())
        names = [library.id_to_piece(i) for i in ids]
        self.byte_id = {int(names[i][3:5], 16): i for i in ids if library.is_byte(i)}
        if len(self.byte_id) != 256:
            raise ValueError("the model lacks pieces for bytes")
        plain = [i for i in ids if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        self.id = {names[i]: i for i in plain}
        self.score = {names[i]: library.get_score(i) for i in plain}
        self.automaton = ahocorasick.Automaton()
        for name in self.id:
            self.automaton.add_word(name, len(name))
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.shorter: dict[str, str] = {}
        letter = {c: k for k, c in enumerate(sorted({c for name in self.id for c in name}), start=1)}
        self.letter = np.zeros(0x110000, np.int64)
        self.letter[[ord(c) for c in letter]] = list(letter.values())
        self.letter[0x20] = self.letter[ord(MARK)]
        self.n_letters = len(letter) + 1
        self.beside = np.zeros(self.n_letters**2, bool)
        self.beside[[letter[a] * self.n_letters + letter[b] for name in self.id for a, b in zip(name, name[1:])]] = True
        # what each id decodes to, end to end
        shown = [b"" if library.is_control(i) else UNKNOWN.encode() if library.is_unknown(i) else names[i].replace(MARK, " ").encode() for i in ids]
        for b, i in self.byte_id.items():
            shown[i] = bytes([b])
        self.marked = np.array([names[i].startswith(MARK) for i in ids])
        self.empty = np.array([not x for x in shown])
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array([len(x) for x in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size

    def merged(self, text: str) -> list[str]:
        """The symbols of a few characters, merged by score."""
        parts = list(text)
        while len(parts) > 1:
            best, k = max((self.score.get(a + b, -np.inf), -k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == -np.inf:
                break
            parts[-k : 2 - k] = [parts[-k] + parts[1 - k]]
        return parts

    def compatible(self, before: str, piece: str) -> bool:
        """The two (or the one, at the start) stay as they are when merged."""
        key = (before, piece)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[key] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return known

    def next_shorter(self, piece: str) -> str:
        """The longest proper prefix that is a piece or a single character; empty for a single character."""
        known = self.shorter.get(piece)
        if known is None:
            known = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if k == 1 or piece[:k] in self.id), "")
            if piece in self.id:
                self.shorter[piece] = known
        return known

    def pieces(self, text: str) -> list[str]:
        """The pieces of a segment; characters that the model lacks stand alone."""
        longest = [1] * len(text)
        for end, size in self.automaton.iter(text):
            if size > longest[end - size + 1]:
                longest[end - size + 1] = size
        found: list[str] = []
        failed = bytearray(len(text) // 8 + 1)
        at, piece = 0, text[: longest[0]]
        while at < len(text):
            before, end = found[-1] if found else "", at + len(piece)
            while piece and (failed[end >> 3] >> (end & 7) & 1 or not self.compatible(before, piece)):
                piece = self.next_shorter(piece)
                end = at + len(piece)
            if piece:
                found.append(piece)
                at = end
                piece = text[at : at + longest[at]] if at < len(text) else ""
            else:  # the piece before is tried again, and as its end has failed, a shorter one follows
                failed[at >> 3] |= 1 << (at & 7)
                piece = found.pop()
                at -= len(piece)
        return found

    def segment(self, raw: bytes) -> list[int]:
        out: list[int] = []
        for piece in self.pieces(raw.decode().replace(" ", MARK)):
            known = self.id.get(piece)
            out += [known] if known is not None else [self.byte_id[b] for b in piece.encode()]
        return out

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the segments: every place between characters that no piece holds side by side, and every start of a text."""
        at, points = code_points(data)
        letter = self.letter[points]
        opens = np.ones(len(at), bool)
        opens[1:] = ~self.beside[letter[:-1] * self.n_letters + letter[1:]]
        opens[np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])] = True
        starts = at[opens]
        return starts, np.append(starts[1:], len(data))

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of rows of ids, end to end in ``ids``. The mark in front of a text is dropped; each byte that is no text becomes U+FFFD."""
        ends = np.cumsum(counts)
        size = self.shown_size[ids].copy()
        at = self.shown_at[ids].copy()
        real = np.flatnonzero(~self.empty[ids])  # control ids show nothing and do not end the front of a text
        row = np.searchsorted(ends, real, side="right")
        front = real[np.concatenate(([True], row[1:] != row[:-1]))] if len(real) else real
        front = front[self.marked[ids[front]]]
        size[front] -= 1
        at[front] += 1
        total = np.concatenate(([0], np.cumsum(size)))
        raw = self.shown[np.repeat(at - total[:-1], size) + np.arange(total[-1])].tobytes()
        bounds = total[np.concatenate(([0], ends))].tolist()
        out = [_text(raw[a:b]) for a, b in zip(bounds, bounds[1:])]
        silent = np.flatnonzero(self.empty[ids])  # bytes on both sides of a control id are no character together
        for j in np.unique(np.searchsorted(ends, silent, side="right")).tolist():
            inner = total[silent[(silent >= ends[j] - counts[j]) & (silent < ends[j])]].tolist()
            out[j] = "".join(_text(raw[a:b]) for a, b in zip([bounds[j], *inner], [*inner, bounds[j + 1]]))
        return out


def _text(raw: bytes) -> str:
    """The bytes as text, each wrong byte by itself as U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append(BROKEN)
                at += 1
        return "".join(out)


class Coder:
    """A model with its memo of segments."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.memo = Pieces(self.model.segment, np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the number of each text's ids. A text that is missing or empty has none; others start with a mark."""
        data, offsets = text_bytes(column)
        some = offsets[:-1][np.diff(offsets) > 0]
        data = np.insert(data, some, 0x20)
        offsets = offsets + np.searchsorted(some, offsets, side="left")
        starts, ends = self.model.cuts(data, offsets)
        at, size = self.memo(data, starts, ends)
        ids = self.memo.gather(at, size)
        total = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[np.searchsorted(starts, offsets)]
        return ids, np.diff(total)


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def encoded(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, ids. A missing or empty text has no ids. Every row is encoded, ids of documents may repeat."""
    table = renamed(docs, {"doc_id": id_column, "text": text_column}).select(F.col("doc_id").cast("long"), "text")

    def encode(batches):
        for batch in slices(batches, "text"):
            ids, counts = coder(model).encode(batch.column("text"))
            rows = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows], names=["doc_id", "ids"])

    return table.mapInArrow(encode, "doc_id long, ids array<int>")


def decoded(coded: DataFrame, model: str) -> DataFrame:
    """The same rows with the ``text`` of their ids. Missing ids are none."""
    table = renamed(coded, {"doc_id": "doc_id", "ids": "ids"})

    def decode(batches):
        for batch in batches:
            rows = batch.column("ids").fill_null([])
            counts = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = coder(model).model.decoded(rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return table.mapInArrow(decode, "doc_id long, ids array<int>, text string")


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal, joined by commas), decoded_sha256."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
