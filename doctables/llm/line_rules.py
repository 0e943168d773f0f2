"""Quality rules: word statistics of each document, and lines that too many documents of a host share.

A line is normalised (A-Z to a-z, digits to 0, white space to single spaces), hashed with its host, and its distinct documents are
counted. Documents of equal lines, such as exact copies, count as one. Lines above the limit are removed; a document of which too little
is left is rejected.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.llm.common import renamed, slices
from doctables.sinks.stored import stored

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_DOCS = 20
MIN_LEFT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: A-Z to a-z, digits to 0.
FOLD = {c: c + 32 for c in range(65, 91)} | {c: 48 for c in range(48, 58)}
GAP = re.compile(f"[{BLANKS}]+")


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in windows found twice or more in the text. Windows get numbers by pairing those of half their size."""
    if len(words) <= window:
        return 0
    seen: dict = {}
    number, span = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64), 1
    while span < window:
        step = min(span, window - span)
        pair = number[: len(number) - step] * (int(number.max()) + 1) + number[step:]
        number, span = np.unique(pair, return_inverse=True)[1].astype(np.int64), span + step
    twice = np.bincount(number)[number] > 1
    if not twice.any():
        return 0
    at = np.flatnonzero(twice)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def line_hash(host: str | None, line: str) -> int | None:
    """The hash of a normalised line of a host; None for a line without a word."""
    plain = GAP.sub(" ", line.translate(FOLD)).strip(" ")
    return int.from_bytes(hashlib.md5(f"{host}\n{plain}".encode()).digest()[:8], "big", signed=True) if plain else None


def measures(text: str, host: str | None) -> dict:
    """Statistics of a text, and its distinct line hashes with the words that stand on those lines."""
    words = text.encode().split()
    seen, twice, lines = set(), 0, {}
    for line in text.split("\n"):
        h = line_hash(host, line)
        if h is None:
            continue
        twice += line in seen
        seen.add(line)
        lines[h] = lines.get(h, 0) + len(line.encode().split())
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, BLANKS)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": twice,
        "n_repeat_words": repeated_words(words),
        "hashes": list(lines),
        "words": list(lines.values()),
        "content": int.from_bytes(hashlib.md5(repr(sorted(lines)).encode()).digest()[:8], "big", signed=True),
    }


PROFILE = "doc_id long, tie long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, hashes array<long>, words array<int>, content long"
SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "tie", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("hashes", pa.list_(pa.int64())), ("words", pa.list_(pa.int32())), ("content", pa.int64())])


def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie", "host", "text")))
        yield pa.RecordBatch.from_pylist([{"doc_id": d, "tie": t} | measures(x or "", h) for d, t, h, x in rows], SCHEMA)


def keyed(docs: DataFrame, id_column: str, text_column: str, host_column: str) -> DataFrame:
    """doc_id, text, host and a hash that tells rows of equal id apart by what they hold."""
    table = renamed(docs, {"doc_id": id_column, "text": text_column, "host": host_column})
    return table.select(F.col("doc_id").cast("long"), "text", "host", F.xxhash64("text", "host").alias("tie"))


def verdicts(docs: DataFrame, max_docs: int = MAX_DOCS, min_left_percent: int = MIN_LEFT_PERCENT, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """Per document: doc_id, tie, the statistics, base_failed, n_removed_words, removed (hashes of its removed lines), kept.

    A missing text has no word and no line, and fails. Missing hosts are one host. Repeated rows are judged alike and all stay.
    """
    table = keyed(docs, id_column, text_column, host_column)
    profile = stored(table.mapInArrow(profiled, PROFILE).withColumn("row", F.monotonically_increasing_id()))
    lines = profile.select("row", "content", F.explode(F.arrays_zip("hashes", "words")).alias("line")).selectExpr("row", "content", "line.hashes as hash", "line.words as words")
    # a line of few rows is of few documents; only the others are looked at again
    often = lines.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_docs).select("hash")
    often = lines.join(often, "hash")
    above = often.select("hash", "content").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_docs).select("hash")
    hits = often.join(above, "hash").groupBy("row").agg(F.sum("words").alias("_words"), F.collect_list("hash").alias("_hashes"))  # a document's own lines
    judged = profile.drop("hashes", "words", "content").join(hits, "row", "left")
    removed = F.coalesce("_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = judged.withColumns({"n_removed_words": removed, "removed": F.coalesce("_hashes", F.array().cast("array<long>")), "base_failed": failed})
    left = 100 * (F.col("n_words") - F.col("n_removed_words")) >= min_left_percent * F.col("n_words")
    return judged.withColumn("kept", ~F.col("base_failed") & left).drop("row", "_words", "_hashes")


def cleaned(docs: DataFrame, max_docs: int = MAX_DOCS, min_left_percent: int = MIN_LEFT_PERCENT, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """The documents that are kept, all columns, their texts without the removed lines."""
    kept = verdicts(docs, max_docs, min_left_percent, id_column, text_column, host_column).filter("kept").select("doc_id", "tie", "removed").dropDuplicates(["doc_id", "tie"])
    text, host, removed = F.col(f"d.`{text_column}`"), F.col(f"d.`{host_column}`"), F.col("k.removed")
    same = F.col(f"d.`{id_column}`").cast("long").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64(text, host) == F.col("k.tie"))

    @F.pandas_udf("string")
    def without(texts, hosts, removed):
        import pandas as pd

        gone = [set(r) for r in removed]
        return pd.Series(["\n".join(x for x in t.split("\n") if line_hash(h, x) not in g) if t is not None and g else t for t, h, g in zip(texts, hosts, gone)], index=texts.index)

    cut = F.size(removed) > 0  # the other texts do not go to Python
    left = F.when(cut, without(F.when(cut, text), host, removed)).otherwise(text)
    return docs.alias("d").join(kept.alias("k"), same).select(*[left.alias(c) if c == text_column else F.col(f"d.`{c}`") for c in docs.columns])
