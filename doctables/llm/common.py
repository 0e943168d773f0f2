"""What several operators share: bounded slices of Arrow batches, stored tables, words as arrays."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa

from doctables.functions.batches import SLICE_BYTES, give_back, slices, text_bytes  # noqa: F401
from doctables.sinks.stored import shared_folder

def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function on each value."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def byte_table(seed: int) -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


ODD = 0x5851F42D4C957F2D
INVERSE = pow(ODD, -1, 1 << 64)
#: A power of a place is the product of two: of its lower bits, from a fixed table, and of the rest. A table of all places would stay in every worker.
LOW_BITS = 12
UP, DOWN = powers(1 << LOW_BITS, ODD), powers(1 << LOW_BITS, INVERSE)


BYTES = byte_table(17)


class SpanHasher:
    """64-bit hashes of any spans of a byte array, from one running sum."""

    def __init__(self, data: np.ndarray):
        low, n = 1 << LOW_BITS, len(data)
        whole = n >> LOW_BITS
        up, self.down = (powers(whole + 1, pow(base, low, 1 << 64)) for base in (ODD, INVERSE))
        self.sums = np.zeros(n + 1, np.uint64)
        terms = self.sums[1:]
        BYTES.take(data, out=terms, mode="clip")
        rows = terms[: whole << LOW_BITS].reshape(-1, low)
        rows *= UP
        rows *= up[:whole, None]
        terms[whole << LOW_BITS :] *= UP[: n - (whole << LOW_BITS)] * up[whole]
        np.cumsum(terms, out=terms)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * DOWN[start & ((1 << LOW_BITS) - 1)]
        value *= self.down[start >> LOW_BITS]
        return mixed(value + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def every(self, size: int) -> np.ndarray:
        """The hashes of all spans of that many bytes, by place."""
        value = self.sums[size:] - self.sums[:-size]
        value *= (self.down[:, None] * DOWN).ravel()[: len(value)]
        value += np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64))
        return mixed(value)


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """A number for each span (in order, not empty, no two overlap) and the bytes of each number, as they first occur: equal numbers are equal bytes."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    held = data[inside] if not inside.all() else data
    offsets = np.concatenate(([0], np.cumsum(ends - starts, dtype=np.int64)))
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(held))])
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def spans_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_SENT: set[str] = set()
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark) -> None:
    """Give this library to the session's Python workers, whose path may not hold it: once, as an archive in the shared folder.

    Rows are whole texts, so a batch of the usual 10,000 rows would hold tens of megabytes on either side: unless the session says
    otherwise, batches have 1,000.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    top, archive = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, str(file.relative_to(top.parent)))
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}.zip")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = system.create(target)
    stream.write(bytearray(archive.getvalue()))
    stream.close()
    context.addPyFile(system.makeQualified(target).toString())
    _SENT.add(context.applicationId)


def renamed(table, columns: dict[str, str]):
    """Only the named columns, under the names the operator uses: columns beside them cannot clash."""
    from pyspark.sql import functions as F

    prepare(table.sparkSession)
    return table.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def words_of(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, and each text's first word (one more for the end). ``blank``: for each byte, whether it parts words."""
    inside = np.concatenate(([False], ~blank[data], [False]))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: The bytes that part words in the contracts, and A-Z to a-z.
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def groups_in_order(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a sorted partition, one after another; a group may run over several batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class Joined:
    """Disjoint sets of 0 .. n-1."""

    def __init__(self, n: int):
        self.up, self.left = list(range(n)), n

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        self.left -= 1
        return True
