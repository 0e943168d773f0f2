"""Columns of a line or row from word positions: fixed boundaries or gap clusters, and the text of the cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType, LongType, StringType, StructField, StructType

from doctables.functions.fixed_values import CLUSTER_EPS, COLUMN_BOUNDARIES
from doctables.operators.blocks import ROWS_PER_PART, gap_numbers, number_rows
from doctables.sinks.shipped import ship_package
from doctables.sinks.stored import stored

LINE = ["doc_id", "page_no", "line_no"]


def bin_columns_fixed(words: DataFrame, boundaries=COLUMN_BOUNDARIES, x: str = "x", scale: float = 1.0, overflow: str = "last", out: str = "col_no") -> DataFrame:
    """Column of a word = first boundary that lies right of its x (times ``scale``).

    Words at or beyond the last boundary belong to the last column; ``overflow="drop"`` leaves them out.
    """
    if overflow not in ("drop", "last"):
        raise ValueError(f"overflow is 'drop' or 'last', not {overflow!r}")
    at = F.col(x) * F.lit(float(scale))
    column = F.when(at < boundaries[0], 0)
    for i, boundary in enumerate(boundaries[1:], start=1):
        column = column.when(at < boundary, i)
    if overflow == "last":
        return words.withColumn(out, column.otherwise(len(boundaries) - 1))
    return words.filter(at < boundaries[-1]).withColumn(out, column)


def cluster_columns_gap(words: DataFrame, keys: list[str] = LINE, x: str = "x", eps: float = CLUSTER_EPS, scale: float = 1.0, ord_col: str | None = "ord", out: str = "col_no", part_rows: int = ROWS_PER_PART) -> DataFrame:
    """Cluster words along x: a gap of more than ``eps`` starts a new column (0-based, left to right).

    This is density clustering with a minimum of one point in one dimension, where clusters are the runs without a larger
    gap. ``keys`` is the line; with the page as key the columns are shared by all lines of the page.
    """
    scaled = words.withColumn("_x", F.col(x) * F.lit(float(scale)))
    return gap_numbers(scaled, keys, "_x", eps, ord_col, out, part_rows).drop("_x")


def order_clusters(words: DataFrame, keys: list[str] = LINE, column_order: str = "x", cluster: str = "col_no", ord_col: str = "ord") -> DataFrame:
    """Number clusters left to right (``x``) or by the emission order of their first words (``first_seen``)."""
    if column_order == "x":
        return words
    if column_order != "first_seen":
        raise ValueError(f"column_order is 'x' or 'first_seen', not {column_order!r}")
    firsts = stored(words.groupBy(*keys, cluster).agg(F.min(ord_col).alias("_first")))  # read twice, and far fewer than the words
    ranked = number_rows(firsts, keys, ["_first"], "_rank").drop("_first")
    return words.join(ranked, [*keys, cluster]).withColumn(cluster, F.col("_rank")).drop("_rank")


def _runs(words: DataFrame, keys: list[str], ord_col: str, sep: str) -> DataFrame:
    """Neighbouring words of one cell, joined where they stand: a text in emission order, and what it takes to part it again.

    ``words`` are the words one by one where the text cannot simply be split; places are ``first`` and those after it, or ``places``.
    """
    kind = words.schema[ord_col].dataType
    whole, plain = isinstance(kind, IntegralType), len(sep) == 1

    def some(values: pa.Array, size: np.ndarray, kept: np.ndarray) -> pa.ListArray:
        """Lists of so many values, null where not ``kept``."""
        if not kept.any():
            return pa.nulls(len(kept), pa.list_(values.type))
        ends = np.concatenate(([0], np.cumsum(np.where(kept, size, 0)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), values.filter(pa.array(np.repeat(kept, size))), mask=pa.array(~kept))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = np.zeros(n, bool)
            fresh[0] = True
            for k in keys:
                column = batch.column(k)
                if pa.types.is_nested(column.type):
                    fresh[:] = True
                elif pa.types.is_integer(column.type) and not column.null_count:
                    fresh[1:] |= np.diff(column.to_numpy()) != 0
                else:  # two nulls count as different here; runs of one cell come together later
                    fresh[1:] |= pc.fill_null(pc.not_equal(column.slice(0, n - 1), column.slice(1)), True).to_numpy(zero_copy_only=False)
            run, begin = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
            place, text = batch.column(ord_col), batch.column("text")
            numbers = place.to_numpy() if whole and not place.null_count else None
            order = None if numbers is None else np.arange(n) if ((np.diff(numbers) > 0) | fresh[1:]).all() else np.lexsort((numbers, run))
            if order is None or ((np.diff(numbers[order]) == 0) & (np.diff(run) == 0)).any():
                order = pc.sort_indices(pa.table({"r": run, "p": place, "t": text}), [("r", "ascending"), ("p", "ascending"), ("t", "ascending")], null_placement="at_start").to_numpy()
            if text.null_count:  # a missing word adds nothing to its cell
                order = order[text.is_valid().to_numpy(zero_copy_only=False)[order]]
            place, text, run = place.take(pa.array(order)), text.take(pa.array(order)), run[order]
            size = np.bincount(run, minlength=len(begin))
            ends = np.concatenate(([0], np.cumsum(size)))
            some_words = size > 0
            head = np.where(some_words, ends[:-1], 0)
            apart = ~some_words if plain else np.ones(len(begin), bool)
            follow = np.zeros(len(begin), bool)
            if plain:
                apart[run[pc.match_substring(text, sep).to_numpy(zero_copy_only=False)]] = True
            if numbers is not None:
                follow[:] = some_words
                numbers = numbers[order]
                follow[run[1:][(np.diff(run) == 0) & (np.diff(numbers) != 1)]] = False
            first = pa.nulls(len(begin), pa.int64()) if numbers is None or not len(numbers) else pa.array(numbers[head].astype(np.int64), mask=~follow)
            lined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), text), sep)
            at = pa.array(begin)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(at) for k in keys), lined, some(text, size, apart), first, some(place, size, ~follow)],
                names=[*keys, "_text", "_words", "_first", "_places"],
            )

    ship_package(words.sparkSession)
    fields = [StructField("_text", StringType()), StructField("_words", ArrayType(StringType())), StructField("_first", LongType()), StructField("_places", ArrayType(kind))]
    spec = StructType([*(words.schema[k] for k in keys), *fields])
    return words.select(*keys, ord_col, "text").mapInArrow(joined, spec)


def merge_cell_text(words: DataFrame, keys: list[str] = [*LINE, "col_no"], ord_col: str = "ord", sep: str = " ", deal: list[str] | None = None) -> DataFrame:
    """One cell per key: its words in emission order, joined by a blank.

    With ``deal`` (some of the keys) the cells come dealt out by those, so that later steps by them move no text again, and neighbouring
    words are joined before they are moved: for words that are not dealt out by their line yet. The cells are the same.
    """
    if deal is None:
        return (
            words.groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct(ord_col, "text"))).alias("_words"))
            .withColumn("text", F.array_join(F.transform("_words", lambda w: w["text"]), sep))
            .drop("_words")
        )
    kind = words.schema[ord_col].dataType

    def parted(run):
        texts = F.coalesce(run["_words"], F.split(run["_text"], "".join(f"\\x{{{ord(c):x}}}" for c in sep)))
        return F.transform(texts, lambda w, i: F.struct(F.coalesce(F.get(run["_places"], i), (run["_first"] + i).cast(kind) if isinstance(kind, IntegralType) else F.lit(None).cast(kind)).alias("ord"), w.alias("text")))

    held = _runs(words, keys, ord_col, sep).repartition(*deal).groupBy(*keys).agg(F.collect_list(F.struct("_text", "_words", "_first", "_places")).alias("_runs"))
    several = F.array_join(F.transform(F.sort_array(F.flatten(F.transform("_runs", parted))), lambda w: w["text"]), sep)
    return held.select(*keys, F.when(F.size("_runs") == 1, F.col("_runs")[0]["_text"]).otherwise(several).alias("text"))


def fill_columns(lines: DataFrame, cells: DataFrame, n_columns: int, keys: list[str] = LINE) -> DataFrame:
    """Every line with all of its ``n_columns`` cells; missing cells are empty strings.

    Lines meet the cells of a line together, so cells that come dealt out by ``keys`` stay where they are.
    """
    more = [c for c in cells.columns if c not in (*keys, "col_no")]
    held = cells.groupBy(*keys).agg(F.collect_list(F.struct("col_no", *more)).alias("_cells"))
    some = F.coalesce("_cells", F.array().cast(held.schema["_cells"].dataType))

    def filled(found, i):
        there = F.transform(found, lambda c: F.struct(i.alias("col_no"), *[F.coalesce(c[m], F.lit("")).alias(m) if m == "text" else c[m].alias(m) for m in more]))
        none = F.struct(i.alias("col_no"), *[(F.lit("") if m == "text" else F.lit(None).cast(cells.schema[m].dataType)).alias(m) for m in more])
        return F.when(F.size(found) > 0, there).otherwise(F.array(none))

    grid = lines.select(*keys).join(held, keys, "left")
    by_column = F.transform(F.sequence(F.lit(0), F.lit(n_columns - 1)), lambda i: F.filter(some, lambda c: c["col_no"] == i))
    return grid.select(*keys, F.explode(F.flatten(F.transform(by_column, filled))).alias("_at")).select(*keys, "_at.*")


def skip_empty_lines(lines: DataFrame, words: DataFrame, keys: list[str] = LINE, keep_empty: bool = False) -> DataFrame:
    """Lines with the number of their words; lines without words are left out unless ``keep_empty``."""
    counts = words.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_words"))
    if not keep_empty:
        return lines.select(*keys).join(counts, keys)
    return lines.select(*keys).join(counts, keys, "left").withColumn("n_words", F.coalesce("n_words", F.lit(0)))
