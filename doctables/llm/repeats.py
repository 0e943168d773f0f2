"""Repeated passages: every byte inside a string of 50 bytes that an earlier document has is removed.

Texts are stored once in blocks. Each string of 50 bytes belongs to the least of its hashed 20-byte windows; neighbouring strings with the
same least window form one segment, so equal strings always stand in segments of equal windows. Blocks first tell which windows they
have, in a few bytes each; a window of one document only needs no further look. Of the others each block sends the hashes of its distinct
segments with the smallest document that has them; where all segments of a window are equal, that settles them. Only windows with
different segments need their texts. A part of a bucket of those is sorted into a Burrows-Wheeler transform; from it, breadth-first backward
extension of intervals finds common prefixes by increasing length and stops at 50, which leaves runs of equal strings. The smallest
document of each run goes back to the blocks, which mark their bytes. A window with very many segments is cut into its single
strings, which are dealt out by their own hash, so that no bucket gathers all contexts of one passage. Every block sends something to
every bucket, so buckets are large and few, and only what is transformed at once is small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.llm.common import SpanHasher, renamed, slices, spans_of, text_bytes
from doctables.sinks.stored import shared_folder, stored

LENGTH = 50
WINDOW = 20
BLOCK_BYTES = 2 << 20
#: Text that is transformed at once, about; a bucket has up to so many times as much.
BUCKET_BYTES = 2 << 20
BUCKET_PARTS = 16
#: A window of more segments is cut: its texts, of 50 to 80 bytes each, would take more than half of what is transformed at once.
HOT_SEGMENTS = 1 << 14
OPEN = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.array([x.nbytes], "<u8").tobytes() + x.tobytes() for x in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(value: bytes, *kinds) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(value), 0, []
    for kind in kinds:
        n = int(np.frombuffer(raw, "<u8", 1, at)[0])
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


class Segments:
    """Segments of a block's texts: where each starts, how many strings of ``length`` begin in it, its window's hash, its text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, window: int):
        n, reach = len(data) - length + 1, length - window + 1
        self.length = length
        size = np.diff(offsets)
        doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        empty = np.zeros(0, np.int64)
        if n <= 0:
            self.start, self.strings, self.key, self.doc, self.hasher = empty, empty, empty.astype(np.uint64), empty, SpanHasher(data)
            return
        self.hasher = SpanHasher(data)
        value = self.hasher.every(window)
        least, span = value, 1
        while span < reach:  # minimum over windows, doubling
            step = min(span, reach - span)
            least, span = np.minimum(least[: len(least) - step], least[step:]), span + step
        least = least[:n]
        whole = doc[:n] == doc[length - 1 :]  # the string lies in one text
        begin = whole.copy()
        begin[1:] &= (least[1:] != least[:-1]) | ~whole[:-1] | (doc[1:n] != doc[: n - 1])
        self.start = np.flatnonzero(begin)
        stop = ~whole
        edge = np.flatnonzero(begin | stop)
        following = np.append(edge, n)[np.searchsorted(edge, self.start, side="right")]
        strings = following - self.start
        # a window that comes again and again would make a segment of any length: cut every ``reach`` strings
        parts = -(-strings // reach)
        if len(parts) and parts.max() > 1:
            inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            self.start = np.repeat(self.start, parts) + inner * reach
            strings = np.minimum(np.repeat(strings, parts) - inner * reach, reach)
        self.strings, self.key, self.doc = strings, least[self.start], doc[self.start].astype(np.int64)

    def only(self, wanted: np.ndarray, singles: np.ndarray) -> None:
        """Keep wanted segments; where ``singles``, each string becomes a segment under its own hash."""
        one, cut = np.flatnonzero(wanted & ~singles), np.flatnonzero(wanted & singles)
        n = self.strings[cut]
        start = np.repeat(self.start[cut], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.key = np.concatenate((self.key[one], self.hasher(start, start + self.length)))
        self.doc = np.concatenate((self.doc[one], np.repeat(self.doc[cut], n)))
        self.strings = np.concatenate((self.strings[one], np.ones(len(start), np.int64)))
        self.start = np.concatenate((self.start[one], start))


def suffix_order(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Order of all suffixes of segments laid end to end; ``left``: bytes up to and with the segment's separator (a zero).

    Ranks of 8 bytes are joined in pairs until they span the longest segment. Equal suffixes keep the order of their segments.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | np.where(left > k, padded[k : n + k], 0).astype(np.uint64)
    span, longest = 8, int(left.max())
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        if span >= longest or new.all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new)
        ahead = np.zeros(n, np.uint64)
        ahead[: n - span] = np.where(left[: n - span] > span, rank[span:], 0) if span < n else 0
        key, span = rank << np.uint64(32) | ahead, 2 * span


def same_prefix(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix in order, whether it shares its first ``length`` bytes with the one before, from the transform alone.

    Intervals of suffixes with a common beginning are extended to the left, all of one length at a time. Where an interval ends, the
    common prefix with the next suffix is as long as the interval's beginning less one; the first to end there settles it. What no
    interval shorter than ``length`` settles is common.
    """
    n = len(text)
    before = text[order - 1]  # the transform; a segment's first suffix has a separator
    last = np.empty(n, np.int64)
    last[np.argsort(before, kind="stable")] = np.arange(n)
    settled = np.zeros(n + 1, bool)
    settled[[0, n]] = True
    count = np.bincount(text, minlength=256)
    ends = np.cumsum(count)
    letters = np.flatnonzero(count[1:]) + 1
    # beginnings of one byte: every letter, and every separator for itself
    lo = np.concatenate((np.arange(count[0]), ends[letters] - count[letters]))
    hi = np.concatenate((np.arange(count[0]) + 1, ends[letters]))
    settled[hi] = True
    for _ in range(1, length):
        one = hi - lo == 1
        single = lo[one][before[lo[one]] != 0]
        left = last[single]
        size = (hi - lo)[~one]
        group = np.repeat(np.arange(len(size)), size)
        at = np.repeat(lo[~one] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        live = before[at] != 0
        to, group = last[at[live]], group[live]
        by = np.argsort(to, kind="stable")
        to, group = to[by], group[by]
        edge = np.concatenate(([True], (to[1:] != to[:-1] + 1) | (group[1:] != group[:-1]))) if len(to) else np.zeros(0, bool)
        # runs of one letter meet runs of the next only across groups or letters; the letter tells neighbours apart
        if len(to):
            edge[1:] |= text[order[to[1:]]] != text[order[to[:-1]]]
        starts = np.flatnonzero(edge)
        ends_at = np.append(starts[1:], len(to)) - 1 if len(starts) else starts
        new_lo, new_hi = np.concatenate((left, to[starts])), np.concatenate((left + 1, to[ends_at] + 1))
        fresh = ~settled[new_hi]
        lo, hi = new_lo[fresh], new_hi[fresh]
        if not len(lo):
            break
        settled[hi] = True
    return ~settled[:n]


def smallest(segments: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment, and each string of ``length`` that begins in it, the smallest document that has the string."""
    sizes = np.array([len(s) for s in segments], np.int64)
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    # byte zero is the separator here; other bytes move up, and the two highest, which UTF-8 never uses, make room
    clean = np.where(text == 255, 255, text + 1)
    clean = clean.astype(np.uint8)
    clean[np.cumsum(sizes + 1) - 1] = 0
    left = np.repeat(np.cumsum(sizes + 1), sizes + 1) - np.arange(len(text))
    order = suffix_order(clean, left)
    same = same_prefix(clean, order, length)
    owner = np.repeat(docs, sizes + 1)[order]
    start = np.flatnonzero(~same)
    run = np.cumsum(~same) - 1
    least = np.empty(len(text), np.int64)
    least[order] = np.minimum.reduceat(owner, start)[run]
    bounds = np.cumsum(sizes + 1) - (sizes + 1)
    return [least[a : a + n - length + 1] for a, n in zip(bounds.tolist(), sizes.tolist())]


BLOCKS = "block long, docs binary, sizes binary, raw binary"


def blocked(docs: DataFrame, block_bytes: int) -> DataFrame:
    """The texts in blocks: block, document ids, sizes in bytes, compressed bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ids, sizes = TaskContext.get().partitionId() << 32, [], [], []

        def out():
            row = [block, np.array(ids, "<i8").tobytes(), np.concatenate(sizes).astype("<i8").tobytes(), zstandard.ZstdCompressor(level=3).compress(b"".join(held))]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "docs", "sizes", "raw"])

        for batch in slices(batches, "text", block_bytes):
            data, offsets = text_bytes(batch.column("text"))
            held.append(data.tobytes())
            sizes.append(np.diff(offsets))
            ids += [NO_ID if d is None else d for d in batch.column("doc_id").to_pylist()]
            if sum(map(len, held)) >= block_bytes // 2:
                yield out()
                block, held, ids, sizes = block + 1, [], [], []
        if ids:
            yield out()

    return docs.mapInArrow(pack, BLOCKS)


class Block:
    def __init__(self, docs: bytes, sizes: bytes, raw: bytes):
        self.ids, self.sizes = np.frombuffer(docs, "<i8"), np.frombuffer(sizes, "<i8")
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=max(1, int(self.sizes.sum()))), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))

    def segments(self, length: int, window: int) -> Segments:
        return Segments(self.data, self.offsets, length, window)


def _windows(block: Block, segments: Segments, buckets: int):
    """The block's distinct windows by bucket and short key: bucket, short key, whether two of its documents have it, segments; per segment its place."""
    bucket, short = (segments.key % np.uint64(buckets)).astype(np.int64), (segments.key >> np.uint64(32)).astype(np.uint32)
    both, place = np.unique(bucket << 32 | short.astype(np.int64), return_inverse=True)
    low, high = np.full(len(both), NO_ID), np.full(len(both), np.iinfo(np.int64).min)
    ids = block.ids[segments.doc]
    np.minimum.at(low, place, ids)
    np.maximum.at(high, place, ids)
    return both >> 32, (both & 0xFFFFFFFF).astype(np.uint32), low != high, np.bincount(place, minlength=len(both)), place


def _distinct(block: Block, segments: Segments, buckets: int):
    """The block's distinct segments ordered by bucket and window: first place, bucket, text's hash, smallest document; per segment its number."""
    end = segments.start + segments.strings + segments.length - 1
    text = segments.hasher(segments.start, end)
    bucket = (segments.key % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((segments.strings, text, segments.key, bucket))
    new = np.ones(len(order), bool)
    for column in (text, segments.key, segments.strings):
        c = column[order]
        new[1:] &= c[1:] == c[:-1]
    new[1:] = ~new[1:]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[np.flatnonzero(new)]
    low = np.full(len(first), NO_ID)
    np.minimum.at(low, number, block.ids[segments.doc])
    return first, bucket[first], text[first], low, number


def _pieces(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
    yield from ((int(bucket[a]), int(a), int(b)) for a, b in zip(edge, [*edge[1:], len(bucket)]))


def removed(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_segments: int = HOT_SEGMENTS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (starts and ends of removed runs, in bytes).

    Matches lie within texts. Missing and empty texts, and texts shorter than ``length``, lose nothing. A document without an id counts as
    later than all others; rows of equal id do not remove from each other. Every row is returned.
    """
    spark = docs.sparkSession
    table = renamed(docs, {"doc_id": id_column, "text": text_column}).select(F.col("doc_id").cast("long"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    title, folder = f"blocks_{uuid4().hex}", shared_folder(spark)
    # bucketed, so that what is joined to the blocks moves and the texts do not
    blocked(table, block_bytes).write.bucketBy(parts, "block").option("path", folder).saveAsTable(title)
    blocks = spark.table(title)
    total = blocks.select(F.sum(F.octet_length("sizes")), F.sum(F.octet_length("raw"))).first()
    small = 2 * int(total[1] or 0) // bucket_bytes
    buckets = max(1, min(small, max(parts, small // BUCKET_PARTS)))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _read(batches):
            bucket, short, _, n, _ = _windows(block, block.segments(length, window), buckets)
            n = np.minimum(n, 0xFFFF).astype("<u2")
            cut = list(_pieces(bucket))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in cut], pa.int32()), pa.array([number] * len(cut), pa.int64()), pa.array([_pack(np.diff(short[a:b], prepend=np.uint32(0)), n[a:b]) for _, a, b in cut], pa.binary())], names=["bucket", "block", "keys"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _gathered(batches, ("block", "keys")):
            opened = [_unpack(k, "<u4", "<u2") for k in rows["keys"]]
            keys = [np.cumsum(o[0], dtype=np.uint32) for o in opened]
            _, place, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            many = np.bincount(place, np.concatenate([o[1] for o in opened])) > hot_segments
            state = ((n > 1).astype(np.uint8) + ((n > 1) & many))[place]  # 1: other blocks have it, 2: and its segments are very many
            cut = np.cumsum([len(k) for k in keys])[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(rows["block"], pa.int64()), pa.array([bucket] * len(keys), pa.int32()), pa.array([_pack(s) for s in np.split(state, cut)], pa.binary())], names=["block", "bucket", "value"])

    def shared_segments(block: Block, states: list) -> Segments:
        segments = block.segments(length, window)
        _, _, own, _, place = _windows(block, segments, buckets)
        state = np.concatenate([_unpack(x["value"], "u1")[0] for x in sorted(states, key=lambda x: x["bucket"])]) if states else np.zeros(0, np.uint8)
        segments.only(((state > 0) | own)[place], (state == 2)[place])
        return segments

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, states in _read(batches, "states"):
            segments = shared_segments(block, states)
            first, bucket, text, low, _ = _distinct(block, segments, buckets)
            short, cut = (segments.key[first] >> np.uint64(32)).astype(np.uint32), list(_pieces(bucket))
            packed = [_pack(np.diff(short[a:b], prepend=np.uint32(0)), text[a:b], low[a:b]) for _, a, b in cut]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in cut], pa.int32()), pa.array([number] * len(cut), pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "block", "names"])

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _gathered(batches, ("block", "names")):
            opened = [_unpack(x, "<u4", "<u8", "<i8") for x in rows["names"]]
            short = np.concatenate([np.cumsum(o[0], dtype=np.uint32) for o in opened])
            least = _agreed(short, np.concatenate([o[1] for o in opened]), np.concatenate([o[2] for o in opened]))
            cut = np.cumsum([len(o[0]) for o in opened])[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(rows["block"], pa.int64()), pa.array([bucket] * len(opened), pa.int32()), pa.array([_pack(x) for x in np.split(least, cut)], pa.binary())], names=["block", "bucket", "value"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, states, settled in _read(batches, "states", "settled"):
            segments = shared_segments(block, states)
            first, bucket, _, low, _ = _distinct(block, segments, buckets)
            still = np.flatnonzero(_settled(settled) == OPEN)
            first, bucket, low = first[still], bucket[still], low[still]
            top = (segments.key[first] >> np.uint64(56)).astype(np.uint8)  # rises within a bucket
            raw, start, size = block.data.tobytes(), segments.start[first], segments.strings[first] + length - 1
            out: list[list] = [[], [], []]
            for b, x, y in _pieces(bucket):
                joined = b"".join([raw[s : s + n] for s, n in zip(start[x:y].tolist(), size[x:y].tolist())])
                for column, value in zip(out, (b, number, _pack(np.frombuffer(joined, np.uint8), size[x:y].astype("<u4"), low[x:y], top[x:y]))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["bucket", "block", "segments"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _gathered(batches, ("block", "segments")):
            yield _answers(bucket, rows, length, bucket_bytes)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, states, settled, answers in _read(batches, "states", "settled", "answers"):
            yield _marked(block, shared_segments(block, states), _settled(settled), sorted(answers or [], key=lambda x: x["bucket"]), buckets, length)

    told = blocks.mapInArrow(tell, "bucket int, block long, keys binary").repartition("bucket").sortWithinPartitions("bucket", "block")
    states = told.mapInArrow(compare, "block long, bucket int, value binary").groupBy("block").agg(F.collect_list(F.struct("bucket", "value")).alias("states"))
    states = stored(states)  # two bits for each window of a block
    named = blocks.join(states, "block").mapInArrow(name, "bucket int, block long, names binary").repartition("bucket").sortWithinPartitions("bucket", "block")
    settled = named.mapInArrow(agree, "block long, bucket int, value binary").groupBy("block").agg(F.collect_list(F.struct("bucket", "value")).alias("settled"))
    settled = stored(settled)  # a document id for each shared segment of a block
    sent = blocks.join(states, "block").join(settled, "block").mapInArrow(send, "bucket int, block long, segments binary").repartition("bucket").sortWithinPartitions("bucket", "block")
    answers = sent.mapInArrow(expand, "block long, bucket int, value binary").groupBy("block").agg(F.collect_list(F.struct("bucket", "value")).alias("answers"))
    marked = blocks.join(states, "block", "left").join(settled, "block", "left").join(answers, "block", "left").mapInArrow(mark, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>")
    return marked


def _read(batches: Iterator[pa.RecordBatch], *more: str):
    """Blocks one at a time, with the named columns beside them."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in ("block", "docs", "sizes", "raw", *more)}
            yield (row["block"], Block(row["docs"], row["sizes"], row["raw"]), *(row[c] for c in more))


def _gathered(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]):
    """The rows of one bucket after another, from a partition sorted by bucket."""
    held: dict[str, list] = {c: [] for c in columns}
    last = None
    for batch in batches:
        values = [batch.column(c).to_pylist() for c in columns]
        for bucket, *row in zip(batch.column("bucket").to_pylist(), *values):
            if held[columns[0]] and bucket != last:
                yield last, held
                held = {c: [] for c in columns}
            for c, x in zip(columns, row):
                held[c].append(x)
            last = bucket
    if held[columns[0]]:
        yield last, held


def _agreed(short: np.ndarray, text: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Per segment the smallest document of its window if all the window's segments are equal, else OPEN."""
    order = np.lexsort((text, short))
    s, t = short[order], text[order]
    window = np.concatenate(([True], s[1:] != s[:-1]))
    start, group = np.flatnonzero(window), np.cumsum(window) - 1
    differs = np.concatenate(([False], (t[1:] != t[:-1]) & ~window[1:]))
    least = np.where(np.logical_or.reduceat(differs, start), OPEN, np.minimum.reduceat(low[order], start))
    out = np.empty(len(short), np.int64)
    out[order] = least[group]
    return out


def _settled(rows: list | None) -> np.ndarray:
    """A block's answers of all buckets in order."""
    found = [_unpack(x["value"], "<i8")[0] for x in sorted(rows or [], key=lambda x: x["bucket"])]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _answers(bucket: int, rows: dict, length: int, at_once: int) -> pa.RecordBatch:
    """For each block's segments of a bucket the smallest documents of their strings, as runs: number of runs, their lengths, documents.

    The bucket is worked through in parts of about ``at_once`` bytes; equal windows, and so equal strings, are in one part.
    """
    opened = [_unpack(x, "u1", "<u4", "<i8", "u1") for x in rows["segments"]]
    held = np.bincount(np.concatenate([o[3] for o in opened]), np.concatenate([o[1] for o in opened]), 256)
    part = ((np.cumsum(held) - held) // at_once).astype(np.int64)  # of each leading byte of a window's hash
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), 256]
    ends = [np.concatenate(([0], np.cumsum(o[1], dtype=np.int64))) for o in opened]
    runs: list[list] = [[] for _ in opened]
    for low, high in zip(edges, edges[1:]):
        cuts = [np.searchsorted(o[3], (low, high)) if high < 256 else np.array([np.searchsorted(o[3], low), len(o[3])]) for o in opened]
        if not any(y > x for x, y in cuts):
            continue
        text = [o[0][e[x] : e[y]] for o, e, (x, y) in zip(opened, ends, cuts)]
        size, docs = (np.concatenate([o[k][x:y] for o, (x, y) in zip(opened, cuts)]) for k in (1, 2))
        found = _found(np.concatenate(text), size, docs, length)
        at = 0
        for own, (x, y) in zip(runs, cuts):
            own += found[at : at + y - x]
            at += y - x
    out = []
    for own in runs:
        line = np.concatenate(own)
        edge = np.ones(len(line), bool)
        edge[1:] = line[1:] != line[:-1]
        edge[np.cumsum([len(x) for x in own])[:-1]] = True
        where = np.flatnonzero(edge)
        out.append(_pack(np.diff(np.append(where, len(line))).astype("u1"), line[where]))
    return pa.RecordBatch.from_arrays([pa.array(rows["block"], pa.int64()), pa.array([bucket] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["block", "bucket", "value"])


def _found(text: np.ndarray, size: np.ndarray, low: np.ndarray, length: int) -> list[np.ndarray]:
    """For each of the segments that stand end to end, the smallest document of each of its strings."""
    raw, end = text.tobytes(), np.cumsum(size, dtype=np.int64)
    segments = [raw[b - n : b] for b, n in zip(end.tolist(), size.tolist())]
    known: dict[bytes, int] = {}
    number = np.array([known.setdefault(s, len(known)) for s in segments], np.int64)
    least = np.full(len(known), NO_ID)
    np.minimum.at(least, number, low)
    found = smallest(list(known), least, length)
    return [found[k] for k in number.tolist()]


def _marked(block: Block, segments: Segments, settled: np.ndarray, answers: list, buckets: int, length: int) -> pa.RecordBatch:
    """The block's documents with what is removed from each."""
    gone = np.zeros(len(block.data) + 1, np.int64)
    if len(segments.start):
        first, _, _, _, number = _distinct(block, segments, buckets)
        n = segments.strings[first]
        least = np.repeat(settled, n)
        runs = [_unpack(x["value"], "u1", "<i8") for x in answers]
        if runs:
            least[least == OPEN] = np.repeat(np.concatenate([r[1] for r in runs]), np.concatenate([r[0] for r in runs]))
        begin = (np.cumsum(n) - n)[number]
        strings = segments.strings
        inner = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
        earlier = least[np.repeat(begin, strings) + inner] < np.repeat(block.ids[segments.doc], strings)
        at = (np.repeat(segments.start, strings) + inner)[earlier]
        np.add.at(gone, at, 1)
        np.add.at(gone, at + length, -1)
    covered = np.cumsum(gone)[:-1] > 0
    raw, out = block.data.tobytes(), [[], [], [], [], [], []]
    for doc, a, b in zip(block.ids.tolist(), block.offsets[:-1].tolist(), block.offsets[1:].tolist()):
        starts, ends = spans_of(covered[a:b])
        edges = [0, *np.stack((starts, ends), 1).ravel().tolist(), b - a]
        kept = b"".join(raw[a + x : a + y] for x, y in zip(edges[::2], edges[1::2]))
        values = (None if doc == NO_ID else doc, b - a, b - a - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), [{"start": x, "end": y} for x, y in zip(starts.tolist(), ends.tolist())])
        for column, value in zip(out, values):
            column.append(value)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), spans))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])
