"""Sequences of a fixed size from documents' tokens: shortest-pack-first over the histogram of lengths.

A document is cut into full sequences and one shorter rest. The rests are packed by their histogram, not one by one: there are as many
packs as all rests need when filled, and lengths are placed longest first, each time into the packs that are filled least. A pattern
stands for all packs filled in the same way, and placing n rests of a length changes the counts of patterns. Where a length fits nowhere,
it is cut at the room that is left and the remainder goes back to the histogram as a shorter length. So at most one sequence's worth of
padding remains in all. What was placed says, for a length and a range of ranks among the rests of that length, the packs and the
places there; joining it to the documents by rank yields the pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doctables.llm.common import renamed, slices
from doctables.llm.tokens import encoder, with_end
from doctables.sinks.stored import stored

SIZE = 2048
END_ID = 1
RANKED_TOGETHER = 200_000


def pack_histogram(counts: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int, int, int]], int]:
    """Placements (length, first rank, end rank, start in the rest, tokens, first pack, place in the pack), and the number of packs.

    Ranks first .. end-1 of that length put the tokens start .. start+tokens-1 of their rests into packs first_pack, first_pack+1, ...
    """
    total = sum(length * n for length, n in counts.items())
    packs = -(-total // size)
    open_packs = [(0, 0, packs)] if packs else []  # filled, first pack, number; least filled first
    # length still to place, length of the rest, start in it, first rank, end rank; longest first
    waiting = [(-length, length, 0, 0, n) for length, n in counts.items() if length and n]
    heapq.heapify(waiting)
    placed = []
    while waiting:
        negative, length, start, first, end = heapq.heappop(waiting)
        filled, pack, n = heapq.heappop(open_packs)
        take, tokens = min(n, end - first), min(-negative, size - filled)
        placed.append((length, first, first + take, start, tokens, pack, filled))
        if take < n:
            heapq.heappush(open_packs, (filled, pack + take, n - take))
        if filled + tokens < size:
            heapq.heappush(open_packs, (filled + tokens, pack, take))
        if take < end - first:
            heapq.heappush(waiting, (negative, length, start, first + take, end))
        if tokens < -negative:
            heapq.heappush(waiting, (negative + tokens, length, start + tokens, first, first + take))
    return placed, packs


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document a number of its own, its ids (little-endian 16-bit, with the end id) and how many they are; to be stored."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            ids, counts = with_end(*encoder(tokenizer).slice(batch.column("text")), end_id)
            offsets = (np.concatenate(([0], np.cumsum(counts))) * 2).astype(np.int32)
            values = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(counts))), batch.column("doc_id"), pa.array(counts.astype(np.int64)), values], names=["row", "doc_id", "doc_tokens", "ids"])
            row += len(counts)

    table = renamed(docs, {"doc_id": id_column, "text": text_column})
    return table.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "row long, doc_id long, doc_tokens long, ids binary")


PLACED = "rest int, first long, end long, start long, length long, pack long, offset long"


def placements(tokens: DataFrame, size: int, together: int) -> DataFrame:
    """Per document (row): n_full, first_full (the sequence of its first full one) and where the parts of its rest lie."""
    spark = tokens.sparkSession
    buckets = max(1, -(-tokens.count() // together))
    keyed = tokens.selectExpr("row", f"int(doc_tokens % {size}) as rest", f"doc_tokens div {size} as n_full", f"pmod(xxhash64(row), {buckets}) as bucket")
    groups = stored(keyed.groupBy("rest", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_full").alias("full")))  # size * buckets rows at most
    histogram = {r.rest: r.n for r in groups.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # ``size`` rows at most
    placed, packs = pack_histogram({k: v for k, v in histogram.items() if k}, size)
    table = spark.createDataFrame(placed, PLACED)
    by_rest = groups.groupBy("rest").agg(F.sum("full").alias("_full"))
    by_rest = by_rest.select("rest", (F.sum("_full").over(Window.orderBy("rest")) - F.col("_full") + packs).alias("_base"))  # ``size`` rows at most
    before = Window.partitionBy("rest").orderBy("bucket")
    firsts = groups.join(by_rest, "rest").select("rest", "bucket", (F.sum("n").over(before) - F.col("n")).alias("_n0"), (F.sum("full").over(before) - F.col("full") + F.col("_base")).alias("_full0"))
    inside = Window.partitionBy("rest", "bucket").orderBy("row")
    ranked = keyed.select("*", (F.row_number().over(inside) - 1).alias("_i"), (F.sum("n_full").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_full")).alias("_f"))
    ranked = ranked.join(firsts, ["rest", "bucket"]).selectExpr("row", "rest", "n_full", "_n0 + _i as rank", "_full0 + _f as first_full")
    # the placements depend on the histogram's lengths, not on the number of documents; Spark measures them before it broadcasts
    hits = ranked.join(table, (ranked["rest"] == table["rest"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")), "left")
    part = F.when(F.col("length").isNotNull(), F.struct("start", "length", (F.col("pack") + F.col("rank") - F.col("first")).alias("sequence"), "offset"))
    return hits.groupBy("row", "n_full", "first_full").agg(F.collect_list(part).alias("parts"))  # a rest has few parts


def packed(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, together: int = RANKED_TOGETHER, **columns: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 16-bit), doc_tokens, sequence_id, offset.

    A missing or empty text has its end id only. Ids may repeat or be missing: every row is packed by itself. An empty table gives no
    piece. Rests of equal length are ranked in buckets of about ``together`` rows, so one length may hold all documents.
    """
    tokens = stored(tokenized(docs, tokenizer, end_id, **columns))
    plan = placements(tokens.select("row", "doc_tokens"), size, together)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            out = []
            for doc_id, n, ids, n_full, first_full, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "ids", "n_full", "first_full", "parts"))):
                places = [(k * size, size, first_full + k, 0) for k in range(n_full)]
                places += [(n_full * size + p["start"], p["length"], p["sequence"], p["offset"]) for p in parts]
                out += [(doc_id, start, length, ids[2 * start : 2 * (start + length)], n, sequence, offset) for start, length, sequence, offset in places]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * len(PIECE), PIECE)], schema=PIECE)

    return tokens.join(plan, "row").mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids as 32-bit integers instead of the ids.

    By Spark's own functions: after the step that cuts the pieces, a second Python step would hold a second worker for each running task.
    """
    wide = F.unhex(F.regexp_replace(F.hex("ids"), "(.{4})", "$10000"))
    return pieces.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", F.crc32(wide).alias("ids_crc32"))
