"""How filters on documents interact, from a sparse matrix of documents and words.

Texts are cut into words shard by shard. Each shard is a sparse matrix in compressed rows: for every document the words it holds and how
often. Words get numbers shard by shard first. The distinct words of each shard go, dealt out by their hash, to the buckets of one
dictionary, where equal words of all shards get one number; the shards get the numbers of their words back and are written again in
these. Row sums are the documents' words and stored entries their distinct words. A text above ``SHARD_BYTES`` is cut at blanks into
rows of several shards, and global numbers tell which words these share.

Counts over all orders of the filters need only the lattice K(S): how many documents of a part fail none of the filters in S. What filter f
removes behind the filters B is K(B) - K(B + f), and every other count is a sum of such differences.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.llm.common import BLANK, SpanHasher, groups_in_order, numbered, renamed, slices, text_bytes, words_of
from doctables.operators.blocks import lookup_by_block
from doctables.sinks.stored import stored

FILTERS = "ABCDE"
SHARD_BYTES = 1 << 22
#: Text per bucket of the dictionary, and the least number of buckets. A bucket's distinct words are held by one task.
BUCKET_BYTES = 1 << 26
LEAST_BUCKETS = 64
#: Rows of one key meet its row of another table in so many groups.
SPREAD = 64
#: The symbols of filter D.
SYMBOLS = b"#$%&*|"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 50, 65, 5

ROW = "row long, doc_id long, part string, same binary, chars long, upper long, symbol boolean"
SHARD = f"shard long, cut boolean, docs array<struct<{ROW.replace(' ', ':').replace(',:', ',')}>>, starts binary, columns binary, counts binary"
LOCAL = f"{SHARD}, words array<binary>"
ROW_ARROW = pa.struct([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.string()), ("same", pa.binary()), ("chars", pa.int64()), ("upper", pa.int64()), ("symbol", pa.bool_())])
SHARD_ARROW = pa.schema([("shard", pa.int64()), ("cut", pa.bool_()), ("docs", pa.list_(ROW_ARROW)), ("starts", pa.binary()), ("columns", pa.binary()), ("counts", pa.binary())])
LOCAL_ARROW = SHARD_ARROW.append(pa.field("words", pa.list_(pa.binary())))


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers as compressed bytes, the low bytes of all of them first."""
    width = 8 if len(values) and int(values.max()) >> 32 else 4
    raw = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()
    return bytes([width]) + len(values).to_bytes(7, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked(raw: bytes) -> np.ndarray:
    width, n = raw[0], int.from_bytes(raw[1:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(raw[8:], decompressed_size=width * n, codec="zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def gaps(columns: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sorted column numbers of each row as steps; a row's first is itself."""
    out = np.diff(columns, prepend=0)
    first = starts[:-1][np.diff(starts) > 0]
    out[first] = columns[first]
    return out


def from_gaps(steps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums, first = np.cumsum(steps), starts[:-1]
    size = np.diff(starts)
    before = np.concatenate(([0], sums))[first]
    return sums - np.repeat(before, size)


def csr(shard: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's row starts (one more for the end), column numbers and counts."""
    starts = unpacked(shard["starts"])
    return starts, from_gaps(unpacked(shard["columns"]), starts), unpacked(shard["counts"])


def sparse(owner: np.ndarray, word: np.ndarray, n_rows: int, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The compressed rows of words found in documents: ``owner`` and ``word`` per occurrence."""
    cell, counts = np.unique(owner * max(n_words, 1) + word, return_counts=True)
    row, columns = np.divmod(cell, max(n_words, 1))
    return np.searchsorted(row, np.arange(n_rows + 1)), columns, counts


def _cut_places(data: np.ndarray, most: int) -> list[int]:
    """Where a long text is cut: at the first blank from every ``most`` bytes on."""
    out, at = [0], most
    while at < len(data):
        found = np.flatnonzero(BLANK[data[at : at + 65536]])
        if len(found):
            out.append(at + int(found[0]))
            at = out[-1] + most
        else:
            at += 65536
    return [*out, len(data)]


def by_bucket(words: pa.LargeBinaryArray, buckets: int) -> tuple[np.ndarray, pa.ListArray]:
    """Each word's place when they are ordered by bucket, and the words of every bucket, parted by a space."""
    offsets = np.frombuffer(words.buffers()[1], np.int64, count=len(words) + 1)
    hashes = SpanHasher(np.frombuffer(words.buffers()[2], np.uint8))(offsets[:-1], offsets[1:])
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words.cast(pa.binary()).take(pa.array(order)))
    return place, pc.binary_join(lists, b" ")


def local_shards(docs: DataFrame, shard_bytes: int, buckets: int) -> DataFrame:
    """One row per shard, its columns numbered by its own ``words`` in the order of the buckets; ``cut`` shards hold a part of one long text."""

    def build(batches: Iterator[pa.RecordBatch]):
        at, row = TaskContext.get().partitionId() << 40, TaskContext.get().partitionId() << 40
        symbol_byte = np.isin(np.arange(256), list(SYMBOLS))
        for batch in slices(batches, "text", shard_bytes):
            data, offsets = text_bytes(batch.column("text"))
            rows = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            cut = batch.num_rows == 1 and len(data) > 2 * shard_bytes
            places = _cut_places(data, shard_bytes) if cut else [0, len(data)]
            for a, b in zip(places, places[1:]):
                part, bounds = data[a:b], np.array([0, b - a]) if cut else offsets
                inside = lambda hit: np.diff(np.searchsorted(np.flatnonzero(hit), bounds))  # noqa: B023, E731
                chars, upper = np.diff(bounds) - inside((part & 0xC0) == 0x80), inside((part >= 65) & (part <= 90))
                starts, ends, first = words_of(part, bounds, BLANK)
                row_starts, columns, counts, chunks = np.zeros(len(bounds), np.int64), *[np.zeros(0, np.int64)] * 2, pa.array([b""] * buckets, pa.binary())
                if len(starts):
                    number, words = numbered(part, starts, ends)
                    place, chunks = by_bucket(words, buckets)
                    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
                    row_starts, columns, counts = sparse(owner, place[number], len(bounds) - 1, len(words))
                about = [rows, *(batch.column(c) for c in ("doc_id", "part", "same")), pa.array(chars), pa.array(upper), pa.array(inside(symbol_byte[part]) > 0)]
                listed = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), pa.StructArray.from_arrays(about, fields=list(ROW_ARROW)))
                numbers = [pa.array([packed(x)], pa.binary()) for x in (row_starts, gaps(columns, row_starts), counts)]
                words_of_buckets = pa.ListArray.from_arrays(pa.array([0, buckets], pa.int32()), chunks)
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([cut]), listed, *numbers, words_of_buckets], schema=LOCAL_ARROW)
                at += 1

    return docs.mapInArrow(build, LOCAL)


def _bucket_words(local: DataFrame) -> DataFrame:
    """shard, bucket, words, each bucket in one task and sorted by shard."""
    chunks = local.select("shard", F.posexplode("words").alias("bucket", "words")).filter(F.length("words") > 0)
    return chunks.repartition("bucket").sortWithinPartitions("bucket", "shard")


def _bucket_numbers(group: pa.Table) -> tuple[np.ndarray, pa.LargeBinaryArray, np.ndarray]:
    """A number within its bucket for every word of a bucket, shard by shard; the distinct words; where each shard's words begin and end."""
    data, offsets = text_bytes(pa.concat_arrays(group.column("words").chunks).cast(pa.large_binary()).view(pa.large_string()))
    starts, ends, first = words_of(data, offsets, BLANK)
    return *numbered(data, starts, ends), first


def word_numbers(local: DataFrame, buckets: int) -> DataFrame:
    """shard, bucket, ids: the global numbers of a shard's words of a bucket. They depend on what the shards hold alone."""

    def number(batches):
        for group in groups_in_order(batches, ["bucket"]):
            found, _, first = _bucket_numbers(group)
            ids = found.astype("<u8") * np.uint64(buckets) + np.uint64(group.column("bucket")[0].as_py())
            raw = [packed(ids[a:b].astype(np.int64)) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            for at in range(0, group.num_rows, 1000):
                some = group.slice(at, 1000).combine_chunks()
                yield pa.RecordBatch.from_arrays([some.column("shard").chunk(0), some.column("bucket").chunk(0), pa.array(raw[at : at + 1000], pa.binary())], names=["shard", "bucket", "ids"])

    return _bucket_words(local).mapInArrow(number, "shard long, bucket int, ids binary")


def dictionary(local: DataFrame, buckets: int) -> DataFrame:
    """word, id: every distinct word and its global number."""

    def name(batches):
        for group in groups_in_order(batches, ["bucket"]):
            words = _bucket_numbers(group)[1].cast(pa.binary())
            ids = np.arange(len(words)) * buckets + group.column("bucket")[0].as_py()
            for at in range(0, len(words), 10_000):
                yield pa.RecordBatch.from_arrays([words.slice(at, 10_000), pa.array(ids[at : at + 10_000])], names=["word", "id"])

    return _bucket_words(local).mapInArrow(name, "word binary, id long")


def shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> tuple[DataFrame, DataFrame]:
    """The matrix in shards with global word numbers, stored, and the dictionary. A missing text has no words."""
    table = renamed(docs, {"doc_id": id_column, "text": text_column, "part": part_column})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    table = table.select(F.col("doc_id").cast("long"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("same"))
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, 1 << (size // BUCKET_BYTES).bit_length())
    local = stored(local_shards(table, shard_bytes, buckets))
    # a shard's numbers are as many as its own distinct words
    numbers = word_numbers(local, buckets).groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("bucket", "ids"))).alias("numbers"))

    def renumber(batches):
        for batch in batches:
            for shard in (batch.slice(k, 1) for k in range(batch.num_rows)):
                ids = shard.column("numbers").flatten()
                number = np.concatenate([np.zeros(0, np.int64), *(unpacked(x.as_py()) for x in (ids.field("ids") if len(ids) else []))])
                starts, columns, counts = csr({c: shard.column(c)[0].as_py() for c in ("starts", "columns", "counts")})
                columns, row = number[columns], np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                order = np.lexsort((columns, row))
                fresh = [pa.array([x], pa.binary()) for x in (packed(starts), packed(gaps(columns[order], starts)), packed(counts[order]))]
                yield pa.RecordBatch.from_arrays([shard.column(c) for c in ("shard", "cut", "docs")] + fresh, names=SHARD_ARROW.names)

    joined = local.drop("words").join(numbers, "shard", "left")
    return stored(joined.mapInArrow(renumber, SHARD)), dictionary(local, buckets)


def row_statistics(matrix: DataFrame) -> DataFrame:
    """Per document: row, doc_id, part, same, chars, upper, symbol, n_words (its row's sum), n_distinct (its row's entries)."""

    def sums(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                starts = unpacked(batch.column("starts")[k].as_py())
                counts = unpacked(batch.column("counts")[k].as_py())
                total = np.diff(np.concatenate(([0], np.cumsum(counts)))[starts])
                docs = batch.column("docs").slice(k, 1).flatten()
                yield pa.RecordBatch.from_arrays([*docs.flatten(), pa.array(total), pa.array(np.diff(starts))], names=[*ROW_ARROW.names, "n_words", "n_distinct"])

    def entries(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                starts, columns, counts = csr({c: batch.column(c)[k].as_py() for c in ("starts", "columns", "counts")})
                rows = batch.column("docs").slice(k, 1).flatten().field("row").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, np.diff(starts))), pa.array(columns)], names=["row", "id"])

    kinds = f"{ROW}, n_words long, n_distinct long"
    whole = matrix.filter("not cut").mapInArrow(sums, kinds)
    # long texts: their parts add up, and a word of several parts counts once
    parts = matrix.filter("cut").mapInArrow(sums, kinds)
    added = parts.groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc_id", "part", "same")], F.sum("chars").alias("chars"), F.sum("upper").alias("upper"), F.max("symbol").alias("symbol"), F.sum("n_words").alias("n_words"))
    distinct = matrix.filter("cut").mapInArrow(entries, "row long, id long").distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_distinct"))
    long = added.join(distinct, "row", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0).cast("long")))
    return whole.unionByName(long)


def failed_bits(stats: DataFrame) -> Column:
    """Filters A to D as bits 1, 2, 4, 8: few words, few distinct words, many of A-Z, a symbol."""
    checks = (F.col("n_words") < MIN_WORDS, 100 * F.col("n_distinct") < MIN_DISTINCT_PERCENT * F.col("n_words"), 100 * F.col("upper") > MAX_UPPER_PERCENT * F.col("chars"), F.col("symbol"))
    return sum((F.when(check, 1 << k).otherwise(0) for k, check in enumerate(checks)), F.lit(0))


def pattern_counts(stats: DataFrame, labels: DataFrame, label_id: str = "doc_id") -> DataFrame:
    """part, bits (filters failed, E is 16), n, good, toxic: documents, and those labelled good and toxic, of every pattern of failures.

    A document fails E if its text is that of a smaller id. Rows of one id and text are the same document for E: none of them is smaller.
    Rows without id neither fail E nor make others fail. Repeated labels count if any of them is 1.
    """
    given = renamed(labels, {"doc_id": label_id, "quality": "quality", "toxic": "toxic"})
    one = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False)).alias(name)
    given = given.select(F.col("doc_id").cast("long"), "quality", "toxic").groupBy("doc_id").agg(one("quality"), one("toxic"))
    rows = stats.select("doc_id", "part", "same", failed_bits(stats).alias("bits")).groupBy("doc_id", "part", "same", "bits").agg(F.count(F.lit(1)).alias("n"))
    rows = lookup_by_block(stored(rows), given, ["doc_id"], F.pmod(F.xxhash64("same"), F.lit(SPREAD))).na.fill(False, ["quality", "toxic"])
    nameless = F.col("doc_id").isNull()
    groups = stored(rows.groupBy("part", "same", "bits", "quality", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(nameless, F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(~nameless, F.struct("doc_id", F.col("n").alias("n")))).alias("first"),
    ))
    least = groups.groupBy("same").agg(F.min("first.doc_id").alias("least"))
    groups = lookup_by_block(groups, least, ["same"], F.pmod(F.xxhash64("part"), F.lit(SPREAD)))
    passed = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.col("bits").alias("bits"), passed.alias("n")), F.struct((F.col("bits") + 16).alias("bits"), (F.col("n") - passed).alias("n")))
    split = groups.select("part", "quality", "toxic", F.explode(both).alias("x")).select("part", "quality", "toxic", "x.*")
    lost = lambda name: F.sum(F.when(F.col(name), F.col("n")).otherwise(0))
    return split.groupBy("part", "bits").agg(F.sum("n").alias("n"), lost("quality").alias("good"), lost("toxic").alias("toxic"))


def audited(counts: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: what the step's filter does there. ``counts`` as ``pattern_counts`` returns them."""
    every = (1 << len(FILTERS)) - 1
    orders = ["".join(o) for o in permutations(FILTERS)]
    steps = [(1 << FILTERS.index(o[k]), sum(1 << FILTERS.index(c) for c in o[:k])) for o in orders for k in range(len(FILTERS))]

    def free(measure: str) -> Column:
        """For every set of filters: how many fail none of it."""
        return F.transform(F.sequence(F.lit(0), F.lit(every)), lambda s: F.aggregate(F.filter("c", lambda x: x["bits"].bitwiseAND(s) == 0), F.lit(0).cast("long"), lambda t, x: t + x[measure]))

    def share(k: int) -> Column:
        """Documents that filter k removes, summed over all orders: each set before it stands in as many orders as its rest can be dealt."""
        f, rest = 1 << k, [s for s in range(every + 1) if not s >> k & 1]
        behind = lambda s: factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())
        return sum(((F.get("K", F.lit(s)) - F.get("K", F.lit(s | f))) * behind(s) for s in rest), F.lit(0).cast("long"))

    lattice = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("c"))  # 32 patterns at most
    lattice = lattice.select("part", free("n").alias("K"), free("good").alias("G"), free("toxic").alias("T"))
    lattice = lattice.withColumn("S", F.array(*[share(k) for k in range(len(FILTERS))]))
    rows = lattice.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("i"))
    rows = rows.withColumns({"f": F.get(F.lit([f for f, _ in steps]), "i"), "b": F.get(F.lit([b for _, b in steps]), "i")})
    at = lambda name, place: F.get(name, place)
    f, b, then = F.col("f"), F.col("b"), F.col("f") + F.col("b")
    removed = at("K", b) - at("K", then)
    return rows.select(
        "part",
        F.get(F.lit(orders), F.floor(F.col("i") / len(FILTERS)).cast("int")).alias("filter_order"),
        (F.col("i") % len(FILTERS) + 1).cast("int").alias("step"),
        at("K", then).alias("kept"),
        removed.alias("removed"),
        (at("K", F.lit(0)) - at("K", f) - removed).alias("redundant"),
        (at("K", F.lit(every) - f) - at("K", F.lit(every))).alias("unique_fails"),
        (at("G", b) - at("G", then)).alias("good_lost"),
        (at("T", b) - at("T", then)).alias("toxic_lost"),
        F.get("S", F.round(F.log2(f)).cast("int")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, shard_bytes: int = SHARD_BYTES, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. No documents, no parts."""
    matrix, _ = shards(docs, shard_bytes, id_column, text_column, part_column)
    return audited(pattern_counts(row_statistics(matrix), labels))
