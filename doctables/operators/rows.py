"""Rows of a page from word boxes: centroids, vertical order, anchor rows, order of the cells in a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from doctables.functions.fixed_values import ROW_TOLERANCE
from doctables.operators.anchors import NONE_ABOVE, entries, looked_up, numbered
from doctables.operators.blocks import ROWS_PER_PART, in_large, number_rows, parted, task_count
from doctables.operators.neighbours import can_pack
from doctables.sinks.stored import stored

PAGE = ["doc_id", "page_no"]


def word_centroid(words: DataFrame, bbox: str = "bbox") -> DataFrame:
    """Mean of the four corners as ``x`` and ``y``."""
    corner = [F.col(bbox)[i] for i in range(4)]
    return words.withColumns(
        {axis: (corner[0][axis] + corner[1][axis] + corner[2][axis] + corner[3][axis]) / 4 for axis in ("x", "y")}
    )


def word_left_x(words: DataFrame, bbox: str = "bbox", out: str = "x") -> DataFrame:
    """Left x: the x of the first corner."""
    return words.withColumn(out, F.col(bbox)[0]["x"])


def sort_by_y(words: DataFrame, keys: list[str] = PAGE, y: str = "y", ord_col: str = "ord", out: str = "y_rank", part_rows: int = ROWS_PER_PART) -> DataFrame:
    """Position of each word on its page by y; ties keep emission order."""
    return number_rows(words, keys, [y, ord_col], out, part_rows)


def group_rows_by_anchor(words: DataFrame, keys: list[str] = PAGE, y: str = "y", tol: float = ROW_TOLERANCE, ord_col: str | None = "ord", out: str = "row_no", part_rows: int = ROWS_PER_PART, keep: list[str] | None = None) -> DataFrame:
    """Row number of each word (0-based): a word belongs to the row of the last anchor at or above it.

    Exactly ``tol`` away from the anchor is still the same row. Pages without words give no rows; a word without a y has row -1.
    ``part_rows`` bounds what a task works on at once and does not change the result. Rows are found among a page's distinct values, and
    the words look theirs up: words are not sorted. Leave out columns that nothing needs. Words are moved once, packed by page; where a page
    has more than ``part_rows`` of them, all are moved one by one.

    With ``keep`` these columns are stored, dealt out by page (see ``stored``), for next steps by page or row.
    """
    cut = parted(words.withColumn("_v", F.col(y).cast("double")), keys, ["_v", ord_col] if ord_col else ["_v"], part_rows)
    columns = list(dict.fromkeys([*words.columns, out]))
    if cut.large is None and can_pack(words, keys):
        plain = words.select(*[F.col(f"`{c}`") for c in words.columns if c != out])
        plain = plain if isinstance(words.schema[y].dataType, DoubleType) else plain.withColumn("_v", F.col(y).cast("double"))
        tasks = task_count(words.sparkSession, cut.total)
        found = looked_up(plain, keys, y if "_v" not in plain.columns else "_v", float(tol), tasks, out, keep or columns)
        return stored(found, keys, tasks) if keep else found
    placed, names = cut.rows, keys if cut.large is None else [*keys, "_part"]
    values = placed.select(*names, "_v").filter("_v is not null").distinct()
    if cut.large is not None:  # one row per part of a large page
        above = entries(in_large(placed, keys, cut.large), keys, "_v", float(tol))
        values = values.join(F.broadcast(above), names, "left")
        values = values.withColumns({"_above": F.coalesce("_above", F.lit(NONE_ABOVE)), "_rows": F.coalesce("_rows", F.lit(0).cast("long"))})
    tasks, own = task_count(words.sparkSession, cut.total), task_count(words.sparkSession, 0)
    # one value, in which missing keys are alike; xxhash64 of one number is one-to-one, and by a float Spark would deal out once more
    at = F.struct(*names, F.when(F.col("_v").isNotNull(), F.xxhash64(F.col("_v") + 0.0)).alias("_hash"))
    found = numbered(values, keys, "_v", float(tol), None if tasks == own else tasks, "_no").select(at.alias("_at"), "_no")
    rows = placed.select(at.cast(found.schema["_at"].dataType).alias("_at"), *[c for c in words.columns if c not in keys and c != out])
    if tasks != own:
        rows, found = rows.repartition(tasks, "_at"), found.repartition(tasks, "_at")
    rows = rows.join(found.hint("shuffle_hash"), "_at", "left").withColumn(out, F.coalesce("_no", F.lit(-1)))
    rows = rows.select(*[F.col(f"_at.`{c}`").alias(c) if c in keys else F.col(f"`{c}`") for c in columns])
    return stored(rows.select(*keep)) if keep else rows


def order_cells_in_row(words: DataFrame, keys: list[str] = PAGE, cell_order: str = "x", out: str = "col_no", part_rows: int = ROWS_PER_PART) -> DataFrame:
    """Column number of each word in its row: by ``x`` (then emission order), or by ``text`` (then x, then emission order)."""
    if cell_order not in ("x", "text"):
        raise ValueError(f"cell_order is 'x' or 'text', not {cell_order!r}")
    return number_rows(words, [*keys, "row_no"], ["x", "ord"] if cell_order == "x" else ["text", "x", "ord"], out, part_rows)


def fragment_rows(words: DataFrame, keys: list[str], ord_col: str = "ord", out: str = "col_no") -> DataFrame:
    """One row per recogniser group: the column number of a word is its place in the group's emission order."""
    return number_rows(words, keys, [ord_col], out)


def table_lines(cells: DataFrame, keys: list[str] = PAGE, order: list[str] = ["col_no"], row: str = "row_no") -> DataFrame:
    """Display form: one line per table row with its cells as an array, in the order of ``order``.

    A displayed row is one value; the long form (one row per cell) has no such limit.
    """
    return (
        cells.groupBy(*keys, row)
        .agg(F.sort_array(F.collect_list(F.struct(*order, "text"))).alias("_cells"))
        .select(*keys, row, F.transform("_cells", lambda c: c["text"]).alias("cells"))
    )
