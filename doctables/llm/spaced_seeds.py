"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask laid over consecutive words; only the words under its ones are hashed, so a word replaced under a zero changes
nothing. Hashes of the benchmark's seeds meet those of the corpus in a join; before it, a bit map of fixed size drops almost all corpus
seeds that no benchmark item has. Around each hit, text and item are laid over each other and any stretch with few substitutions
decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.llm.common import SpanHasher, mixed, renamed, slices, text_bytes, words_of
from doctables.sinks.stored import stored

#: Words under a one are compared.
MASKS = ("1110111", "110110011", "1101010011", "10110101", "1111001001")
BITS = 22
MIN_MATCHED = 10
MIN_PERCENT = 80
#: Bytes between words: ASCII that is neither letter nor digit.
MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words (lower case, no punctuation) end to end, and each text's first word (one more for the end)."""
    data, offsets = text_bytes(pc.utf8_lower(column))
    starts, ends, first = words_of(data, offsets, MARK)
    return SpanHasher(data)(starts, ends), first


def seeds(word: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask the positions (among all words) where it fits into a text, and the hashes there."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for k, mask in enumerate(MASKS):
        n = len(word) - len(mask) + 1
        if n <= 0:
            continue
        at = np.flatnonzero(doc[:n] == doc[len(mask) - 1 :])
        value = np.zeros(len(at), np.uint64)
        for j, one in enumerate(mask):
            if one == "1":
                value += word[at + j] * (mixed(np.array([100 * k + j + 1], np.uint64)) | np.uint64(1))
        yield at, mixed(value)


def _probes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << BITS) - 1)
    return (value & low).astype(np.int64), (value >> np.uint64(64 - BITS)).astype(np.int64)


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """item_id, place (word position), seed, and the two bits that a seed sets."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            word, first = word_hashes(batch.column("text"))
            for at, value in seeds(word, first):
                doc = np.searchsorted(first, at, side="right") - 1
                one, two = _probes(value)
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(doc)), pa.array(at - first[doc]), pa.array(value.view(np.int64)), pa.array(one), pa.array(two)], names=["item_id", "place", "seed", "one", "two"])

    return benchmark.mapInArrow(cut, "item_id long, place long, seed long, one long, two long")


def bit_map(found: DataFrame) -> np.ndarray:
    """The bits that the seeds set: 2**22 bits, whatever the benchmark's size."""
    words = found.select(F.explode(F.array("one", "two")).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(bit & 63)))").alias("bits"))
    out = np.zeros(1 << BITS - 6, np.int64)
    for row in words.collect():  # at most 2**16 rows
        out[row.word] = row.bits
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def overlap(text: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """The best stretch of a text against an item shifted by ``diagonal``: first word, end, words that agree. A substitution costs two."""
    a, b = max(0, diagonal), min(len(text), diagonal + len(item))
    same = text[a:b] == item[a - diagonal : b - diagonal]
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -2))))
    gain = total - np.minimum.accumulate(total)
    end = int(gain.argmax())
    start = int(np.flatnonzero(total[: end + 1] == total[: end + 1].min())[-1])
    return a + start, a + end, int(same[start:end].sum())


def qualifying(text: np.ndarray, item: np.ndarray, diagonal: int, min_matched: int, min_percent: int) -> tuple[int, int, int] | None:
    """Of the stretches of a diagonal that meet both limits, the shortest of those in which most words agree; None if none does."""
    a, b = max(0, diagonal), min(len(text), diagonal + len(item))
    if b - a < max(1, min_matched):
        return None
    same = text[a:b] == item[a - diagonal : b - diagonal]
    agree = np.concatenate(([0], np.cumsum(same)))
    score = 100 * agree - min_percent * np.arange(len(agree))  # a stretch has the share if its score is not negative
    ahead = np.maximum.accumulate(score[::-1])  # the highest score at a place or after it, from the end
    last = len(score) - 1 - np.searchsorted(ahead, score)  # the last end that goes with each start
    n = agree[last] - agree
    most = int(n.max())
    if most < max(1, min_matched):
        return None
    at, starts = np.flatnonzero(same), np.flatnonzero(n == most)
    first = at[agree[starts]]  # without the words at either end that do not agree
    end = at[agree[last[starts]] - 1] + 1
    k = int((end - first).argmin())
    return a + int(first[k]), a + int(end[k]), most


def contaminated(docs: DataFrame, benchmark: DataFrame, min_matched: int = MIN_MATCHED, min_percent: int = MIN_PERCENT, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that overlap: doc_id, tie, item_id, start, end (words), n_matched; the best stretch of each pair that counts.

    A stretch counts if ``min_matched`` words agree and they are ``min_percent`` of it. Missing and empty texts overlap with nothing, nor do
    items of fewer words. Repeated documents are reported once by id and text; repeated items each.
    """
    items = renamed(benchmark, {"item_id": item_column, "text": item_text}).select(F.col("item_id").cast("long"), "text")
    found = stored(item_seeds(items))
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(found))  # 2**22 bytes
    table = renamed(docs, {"doc_id": id_column, "text": text_column}).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text")

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in slices(batches, "text"):
            word, first = word_hashes(batch.column("text"))
            for at, value in seeds(word, first):
                one, two = _probes(value)
                hit = np.flatnonzero(known[one])
                hit = hit[np.flatnonzero(known[two[hit]])]
                at_hit = at[hit]
                doc = pa.array(np.searchsorted(first, at_hit, side="right") - 1)
                place = at_hit - first[doc.to_numpy()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(doc), batch.column("tie").take(doc), pa.array(place), pa.array(value[hit].view(np.int64))], names=["doc_id", "tie", "at", "seed"])

    hits = table.mapInArrow(sieve, "doc_id long, tie long, at long, seed long")
    laid = hits.join(found.select("seed", "item_id", "place"), "seed").select("doc_id", "tie", "item_id", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    laid = laid.groupBy("doc_id", "tie", "item_id").agg(F.collect_set("diagonal").alias("diagonals"))  # of one text and one item
    laid = stored(laid.withColumnsRenamed({"doc_id": "_doc", "tie": "_tie"}))
    texts = table.join(laid, table["doc_id"].eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie"))).select("doc_id", "tie", "item_id", "diagonals", "text")
    pairs = texts.join(items.withColumnRenamed("text", "item_words"), "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[list] = [[], [], [], [], [], []]
            (word, first), (other, start) = word_hashes(batch.column("text")), word_hashes(batch.column("item_words"))
            for k, (doc, tie, item, diagonals) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie", "item_id", "diagonals")))):
                text, words = word[first[k] : first[k + 1]], other[start[k] : start[k + 1]]
                met = [x for d in sorted(diagonals) if (x := qualifying(text, words, d, min_matched, min_percent))]
                if met:
                    a, b, n = max(met, key=lambda x: (x[2], x[0] - x[1]))
                    for column, value in zip(out, (doc, tie, item, a, b, n)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "tie", "item_id", "start", "end", "n_matched"])

    return pairs.mapInArrow(verify, "doc_id long, tie long, item_id long, start long, end long, n_matched long").distinct()


def clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents, all columns, that overlap with no item."""
    bad = contaminated(docs, benchmark, id_column=id_column, text_column=text_column, **options).select("doc_id", "tie").distinct()
    same = F.col(f"d.`{id_column}`").cast("long").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64(F.col(f"d.`{text_column}`")) == F.col("b.tie"))
    return docs.alias("d").join(bad.alias("b"), same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
