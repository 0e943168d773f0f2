"""Near duplicates: a multi-index Hamming join on b-bit MinHash signatures, confirmed on whole shingle sets.

A signature has 60 positions of 16 bits in 12 chunks of 5. Two signatures that differ in at most 23 positions have, by pigeonhole, a chunk
with at most one differing position; so a document is filed under every chunk with every one position left out (60 keys), and all pairs
within the distance meet. At the similarity of 0.85 a pair differs in 9 positions on average (standard deviation 2.8); less than one pair
in a hundred thousand exceeds 23. Inside a key, documents are joined to candidate groups by the distance alone; then each group's
whole shingle sets are compared, and links that hold are joined to components. Only spanning links are ever written.

A key or a group of many documents is first compared with its first document alone. All that it reaches are linked already, whatever else
holds between them; only the others are compared with all, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.llm.common import BLANK, LOWER, Joined, SpanHasher, groups_in_order, mixed, renamed, slices, text_bytes, words_of
from doctables.llm.graph import components, in_blocks
from doctables.operators.blocks import lookup_by_block
from doctables.sinks.stored import stored

CHUNKS, CHUNK = 12, 5
POSITIONS = CHUNKS * CHUNK
DISTANCE = 2 * CHUNKS - 1
PERCENT = 85
WORDS = 3
BLOCK = 256
#: Rows of a large key or group meet its first document in so many groups.
SPREAD = 64
MULTIPLY = mixed(np.arange(1, POSITIONS + 1, dtype=np.uint64)) | np.uint64(1)
ADD = mixed(np.arange(101, POSITIONS + 101, dtype=np.uint64))


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts end to end, sorted within a text, and where each text's begin (one more for the end)."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, first = words_of(data, offsets, BLANK)
    word = SpanHasher(data)(starts, ends)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    value = np.zeros(len(word), np.uint64)
    for k in range(words):
        value[: len(word) - k] += word[k:] * (mixed(np.array([k + 7], np.uint64)) | np.uint64(1))
    whole = np.zeros(len(word), bool)
    whole[: max(0, len(word) - words + 1)] = doc[words - 1 :] == doc[: max(0, len(doc) - words + 1)]
    for j in np.flatnonzero((count > 0) & (count < words)):  # the whole sequence is the one shingle
        a, n = first[j], count[j]
        salt = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        value[a], whole[a] = (word[a : a + n] * salt).sum(dtype=np.uint64) + np.uint64(n), True
    value, doc = mixed(value[whole]), doc[whole]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(count) + 1))


def signature(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16 bits of the minimum of each position's hash, a row per set (no set may be empty).

    The minimum is mixed first: of a large set it is small, and its high bits would be the same for all large sets.
    """
    out = np.empty((len(bounds) - 1, POSITIONS), np.uint16)
    for k in range(POSITIONS):
        out[:, k] = mixed(np.minimum.reduceat(values * MULTIPLY[k] + ADD[k], bounds[:-1])) >> np.uint64(48)
    return out


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """For each signature the keys of every chunk with each one position left out."""
    out = np.empty((len(signatures), POSITIONS), np.uint64)
    for chunk in range(CHUNKS):
        part = signatures[:, chunk * CHUNK : (chunk + 1) * CHUNK].astype(np.uint64)
        for gap in range(CHUNK):
            packed = np.zeros(len(part), np.uint64)
            for k in range(CHUNK):
                if k != gap:
                    packed = packed << np.uint64(16) | part[:, k]
            out[:, chunk * CHUNK + gap] = mixed(packed ^ mixed(np.array([1000 + chunk * CHUNK + gap], np.uint64)))
    return out


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def profiled(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, tie (the text's hash), n_shingles, c1 and c2 (128 bits that name the set), signature; to be stored."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, bounds = shingles(batch.column("text"), words)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            c1, c2, raw = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), np.zeros((len(n), POSITIONS), np.uint16)
            if len(full):
                at = np.append(bounds[full], bounds[-1])
                c1[full], c2[full] = np.add.reduceat(mixed(values), at[:-1]), np.add.reduceat(mixed(values ^ ADD[0]), at[:-1])
                raw[full] = signature(values, at)
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.arange(len(n) + 1) * 2 * POSITIONS).astype(np.int32)), pa.py_buffer(raw.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(n.astype(np.int64)), _signed(c1), _signed(c2), packed], names=["doc_id", "tie", "n_shingles", "c1", "c2", "signature"])

    return docs.mapInArrow(profile, "doc_id long, tie long, n_shingles long, c1 long, c2 long, signature binary")


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            raw = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(-1, POSITIONS)
            yield pa.RecordBatch.from_arrays([_signed(keys_of(raw).ravel()), pa.array(np.repeat(part.column("row").to_numpy(), POSITIONS))], names=["key", "row"])


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, POSITIONS)


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found) if found else ([], []))], names=["a", "b"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of the documents of each small key that are within the distance."""
    found: list[tuple[int, int]] = []
    for group in groups_in_order(batches, ["key"]):
        rows, raw = group.column("row").to_numpy(), _signatures(group.column("signature"))
        sets = Joined(len(rows))
        for p in range(len(rows) - 1):
            for q in np.flatnonzero((raw[p + 1 :] != raw[p]).sum(axis=1) <= DISTANCE) + p + 1:
                if sets.join(p, int(q)):
                    found.append((int(rows[p]), int(rows[q])))
            if sets.left == 1:
                break
        if len(found) > 10_000:
            yield _links(found)
            found = []
    if found:
        yield _links(found)


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of large keys, with ``far``: whether the key's first document is beyond the distance."""
    for batch in batches:
        if batch.num_rows:
            far = (_signatures(batch.column("signature")) != _signatures(batch.column("first_signature"))).sum(axis=1) > DISTANCE
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "row", "first", "signature")), pa.array(far)], names=["key", "row", "first", "signature", "far"])


def _asked(batches: Iterator[pa.RecordBatch], keys: list[str], reader, reaches) -> Iterator[pa.RecordBatch]:
    """Spanning links between the members that ask and those that answer; answers that are not far are linked to each other already."""
    for group in groups_in_order(batches, keys):
        rows, asks, far = (group.column(c).to_numpy() for c in ("row", "asks", "far"))
        answers = np.flatnonzero(~asks)
        held = reader(group)
        sets, found, near = Joined(len(rows)), [], answers[~far[answers]]
        for q in near[1:]:
            sets.join(int(near[0]), int(q))
        for p in np.flatnonzero(asks):
            for q in answers[reaches(held, p, answers)]:
                if rows[p] != rows[q] and sets.join(int(p), int(q)):
                    found.append((int(rows[p]), int(rows[q])))
        if found:
            yield _links(found)


def _asked_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _asked(batches, ["key", "i", "j"], lambda group: _signatures(group.column("signature")), lambda raw, p, others: (raw[others] != raw[p]).sum(axis=1) <= DISTANCE)


class Sets:
    """Shingle sets of a few documents, compared by counting what they share."""

    def __init__(self, packed: list[bytes]):
        sets = [np.frombuffer(x, np.uint64) for x in packed]
        self.size = np.array([len(x) for x in sets])
        self.starts = np.cumsum(self.size) - self.size
        self.number = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.mark = np.zeros(int(self.number.max()) + 1, np.int64)

    def common(self, p: int, others: np.ndarray) -> np.ndarray:
        """How many shingles each of the others (in order) shares with set ``p``."""
        own = self.number[self.starts[p] : self.starts[p] + self.size[p]]
        self.mark[own] = 1
        found = np.add.reduceat(self.mark[self.number], self.starts)[others]
        self.mark[own] = 0
        return found

    def alike(self, p: int, others: np.ndarray, percent: int) -> np.ndarray:
        common = self.common(p, others)
        return 100 * common >= percent * (self.size[p] + self.size[others] - common)


def _linked(percent: int):
    """Spanning links of the documents of each small candidate group whose sets are similar enough."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in_order(batches, ["component"]):
            rows = group.column("row").to_numpy()
            sets, joined, found = Sets(group.column("shingles").to_pylist()), Joined(len(rows)), []
            for p in range(len(rows) - 1):
                others = np.arange(p + 1, len(rows))
                for q in others[sets.alike(p, others, percent)]:
                    if joined.join(p, int(q)):
                        found.append((int(rows[p]), int(rows[q])))
                if joined.left == 1:
                    break
            if found:
                yield _links(found)

    return linked


def _resembling(percent: int):
    """Documents of large groups, with ``far``: whether the set of the group's first document is not similar enough."""

    def resembling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = []
            for own, first in zip(batch.column("shingles").to_pylist(), batch.column("first_shingles").to_pylist()):
                a, b = np.frombuffer(own, np.uint64), np.frombuffer(first, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                far.append(100 * common < percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("component", "row", "shingles")), pa.array(far, pa.bool_())], names=["component", "row", "shingles", "far"])

    return resembling


def _asked_alike(percent: int):
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _asked(batches, ["component", "i", "j"], lambda group: Sets(group.column("shingles").to_pylist()), lambda sets, p, others: sets.alike(p, others, percent))

    return asked


def _spread(rows: DataFrame, first: DataFrame, key: str) -> DataFrame:
    """The rows with what ``first`` says of their key; a key of many rows is met in many groups."""
    return lookup_by_block(rows, first, [key], F.pmod(F.xxhash64("row"), F.lit(SPREAD)))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest id reachable over links), kept (its own id is the smallest).

    Linked are documents whose sets of ``words``-word shingles have a similarity of ``percent`` or more. At 85 less than one pair in a
    hundred thousand lies beyond the signatures' distance, at 80 about three in ten thousand, and fewer the more alike they are. Documents without words are linked with nothing. Equal sets are one class, however many documents hold
    them. A document without an id keeps a missing component and stays; repeated ids keep their rows.
    """
    table = renamed(docs, {"doc_id": id_column, "text": text_column}).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text")
    profile = stored(profiled(table, words))
    # a class's row number: kept with the stored table, so it is the same whenever it is read
    classes = profile.filter("n_shingles > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("first_id"), F.min(F.coalesce("doc_id", F.lit(1 << 62))).alias("_holder"))
    classes = stored(classes.withColumn("row", F.monotonically_increasing_id()))
    held = profile.filter("n_shingles > 0").select("c1", "c2", F.coalesce("doc_id", F.lit(1 << 62)).alias("_holder"), "tie", "signature")
    signed = stored(held.join(classes.select("c1", "c2", "_holder", "row"), ["c1", "c2", "_holder"]).dropDuplicates(["row"]))
    filed = signed.select("row", "signature").mapInArrow(_filed, "key long, row long")
    shared = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).filter("n > 1")
    met = stored(filed.join(shared, "key").join(signed.select("row", "signature"), "row"))
    few, many = met.filter(F.col("n") <= 4 * block), met.filter(F.col("n") > 4 * block)
    near = few.repartition("key").sortWithinPartitions("key").mapInArrow(_near, "a long, b long")
    leads = many.filter("row = first").select("key", F.col("signature").alias("first_signature"))
    reached = stored(_spread(many, leads, "key").mapInArrow(_reached, "key long, row long, first long, signature binary, far boolean"))
    asked = in_blocks(reached, "key", "row", 4 * block).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_asked_near, "a long, b long")
    near = near.union(reached.filter("not far").select("row", "first")).union(asked)
    groups = stored(components(near))
    # the size of a group is stored beside its members: after a join by group Spark would take them as dealt out already, and might split a large part
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    wanted = groups.join(sizes, "component").withColumnRenamed("vertex", "row").join(signed.select("row", "_holder", "tie"), "row")
    holder = F.coalesce(F.col("doc_id"), F.lit(1 << 62))
    texts = table.join(wanted.withColumnRenamed("tie", "_tie"), (holder == F.col("_holder")) & (F.col("tie") == F.col("_tie"))).select("component", "row", "n", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, bounds = shingles(batch.column("text"), words)
            packed = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(values.tobytes())])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("component", "row", "n")), packed], names=["component", "row", "n", "shingles"])

    compared = stored(texts.mapInArrow(sets, "component long, row long, n long, shingles binary").dropDuplicates(["row"]))
    few, many = compared.filter(F.col("n") <= block), compared.filter(F.col("n") > block)
    alike = few.repartition("component").sortWithinPartitions("component").mapInArrow(_linked(percent), "a long, b long")
    leads = many.filter("row = component").select("component", F.col("shingles").alias("first_shingles"))
    reached = stored(_spread(many, leads, "component").mapInArrow(_resembling(percent), "component long, row long, shingles binary, far boolean"))
    asked = in_blocks(reached, "component", "row", block).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    alike = alike.union(reached.filter("not far").select("row", "component")).union(asked.mapInArrow(_asked_alike(percent), "a long, b long"))
    linked = components(alike).withColumnRenamed("vertex", "row")
    named = classes.select("c1", "c2", "row", "first_id").join(linked, "row", "left").withColumn("component", F.coalesce("component", "row"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "component").select("c1", "c2", "component_id")
    out = profile.select("doc_id", "n_shingles", "c1", "c2").withColumn("_some", F.col("n_shingles") > 0)
    out = out.join(named.withColumn("_some", F.lit(True)), ["c1", "c2", "_some"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
