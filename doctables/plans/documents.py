"""Whole paths from recognised data to tables and documents, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.functions.fixed_values import CLUSTER_EPS, COLUMN_BOUNDARIES, ROW_TOLERANCE
from doctables.operators import answers as A
from doctables.operators import columns as C
from doctables.operators import lines as L
from doctables.operators import rows as R
from doctables.operators import shape as S
from doctables.operators.neighbours import stored_by
from doctables.sinks.stored import stored
from doctables.sources.pages import explode_lines

PAGE = ["doc_id", "page_no"]


def tables_from_boxes(words: DataFrame, tol: float = ROW_TOLERANCE, cell_order: str = "x", keys: list[str] = PAGE) -> DataFrame:
    """Word boxes (``bbox``) to the padded rows of each page's table: ``row_no``, ``cells``, ``width``."""
    order = ["x", "ord"] if cell_order == "x" else ["text", "x", "ord"]
    return S.pad_lines(R.table_lines(words_in_rows(words, tol, keys), keys, order), keys)


def words_in_rows(words: DataFrame, tol: float = ROW_TOLERANCE, keys: list[str] = PAGE) -> DataFrame:
    """Word boxes with the row that they belong to, stored by page: lines and cells are made of them where they are."""
    placed = R.word_centroid(words).select(*keys, "x", "y", "ord", "text")
    return R.group_rows_by_anchor(placed, keys, "y", tol, keep=[*keys, "row_no", "x", "ord", "text"])


def padded_cells(placed: DataFrame, cell_order: str = "x", keys: list[str] = PAGE, kept: bool = False) -> DataFrame:
    """Words with their ``row_no`` to padded cells in long form, for pages and rows of any size.

    Numbering and padding read their input several times, so the words are stored by page on the way (``kept``: they are already); they also
    tell how long the rows are.
    """
    words = placed if kept else stored_by(placed.select(*keys, "row_no", "x", "ord", "text"), keys)
    cells = R.order_cells_in_row(words, keys, cell_order).select(*keys, "row_no", "col_no", "text")
    return S.pad_rectangular(cells, keys, counted=words)


def cells_from_boxes(words: DataFrame, tol: float = ROW_TOLERANCE, cell_order: str = "x", keys: list[str] = PAGE) -> DataFrame:
    """Word boxes to padded cells in long form: the table of ``tables_from_boxes`` without its limit on a row's size."""
    return padded_cells(words_in_rows(words, tol, keys), cell_order, keys, kept=True)


def tables_from_fragments(words: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """One table row per recogniser group, cells in emission order, rows left ragged."""
    rows = words.withColumn("row_no", F.col("group_no"))
    return R.table_lines(rows, keys, ["ord"])


def tables_from_clusters(words: DataFrame, eps: float = CLUSTER_EPS, column_order: str = "x", scale: float = 1.0) -> DataFrame:
    """Cells (long form) per line, columns by gap clusters; missing cells at a line's end are null."""
    clustered = C.cluster_columns_gap(R.word_left_x(words), eps=eps, scale=scale).select(*C.LINE, "ord", "text", "col_no")
    if column_order != "x":
        clustered = C.order_clusters(stored(clustered), column_order=column_order)
    return S.pad_ragged_null(stored(C.merge_cell_text(clustered)), PAGE, "line_no")


def tables_from_boundaries(lines: DataFrame, words: DataFrame, boundaries=COLUMN_BOUNDARIES, scale: float = 1.0, overflow: str = "last") -> DataFrame:
    """Cells (long form) per line on a fixed grid; lines without words give a row of empty cells."""
    cells = C.merge_cell_text(C.bin_columns_fixed(R.word_left_x(words), boundaries, scale=scale, overflow=overflow), deal=C.LINE)
    return C.fill_columns(lines, cells, len(boundaries))


def structured_rows(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """Pages and their answers to typed rows with fallbacks."""
    classified = A.classify_answer(A.match_page_answer(pages, answers))
    return A.fallback_to_ocr(A.parse_structured_json(classified))


def markdown_from_text(pages: DataFrame, keys: list[str] = PAGE, drop_unclosed: bool = False) -> DataFrame:
    """Page texts to Markdown lines with their pipe tables converted."""
    marked = L.detect_pipe_tables(explode_lines(pages, keys=keys), keys)
    return L.stitch_markdown(L.normalize_pipe_rows(marked, keys), keys, drop_unclosed)


def tables_from_lines(lines: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Text lines to padded rows, cells split at wide blanks; blank rows are dropped."""
    rows = L.drop_blank_rows(L.split_whitespace_columns(lines))
    return S.pad_lines(rows.select(*keys, F.col("line_no").alias("row_no"), "cells"), keys, filler=None)
