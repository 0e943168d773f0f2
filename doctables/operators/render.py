"""Tables and pages as text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.functions.fixed_values import PAGE_BREAK
from doctables.functions.text import csv_line, markdown_line
from doctables.operators.blocks import ROWS_PER_BLOCK, int_block, lookup_by_block
from doctables.operators.lines import assemble_text

PAGE = ["doc_id", "page_no"]


def render_markdown_table(lines: DataFrame, keys: list[str] = PAGE, row: str = "row_no", header: bool = True) -> DataFrame:
    """Pipe table of each page as lines in the order of ``line_no``.

    ``lines`` are padded display rows (``cells``, ``width``). The header names the columns 0, 1, 2 ...; without one the table
    starts with its ``---`` row.
    """
    tables = lines.groupBy(*keys).agg(F.max("width").alias("_w"))
    names = markdown_line(F.transform(F.sequence(F.lit(0), F.col("_w") - 1), lambda i: i.cast("string")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.col("_w")))
    head = F.array(*([names, rule] if header else [rule]))
    heads = tables.select(*keys, F.posexplode(head).alias("_p", "text")).select(
        *keys, (F.col("_p") - (2 if header else 1)).alias("line_no"), "text"
    )
    body = lines.select(*keys, F.col(row).alias("line_no"), markdown_line(F.col("cells")).alias("text"))
    return heads.unionByName(body)


def render_plain_table(lines: DataFrame, keys: list[str] = PAGE, row: str = "row_no") -> DataFrame:
    """Fixed-width text: each column right-aligned to its longest cell, one blank between columns."""
    sizes = lines.select(*keys, F.posexplode("cells").alias("_c", "_t")).groupBy(*keys, "_c")
    sizes = sizes.agg(F.max(F.length(F.coalesce("_t", F.lit("")))).alias("_n"))
    widths = sizes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_c", "_n"))).alias("_ws"))
    wide = lookup_by_block(lines, widths, keys, int_block(F.col(row), ROWS_PER_BLOCK))
    padded = F.zip_with("cells", "_ws", lambda c, w: F.lpad(F.coalesce(c, F.lit("")), w["_n"], F.lit(" ")))
    return wide.select(*keys, row, F.array_join(padded, " ").alias("text"))


def text_rows(lines: DataFrame, keys: list[str] = PAGE, row: str = "row_no", sep: str = "\t") -> DataFrame:
    """Cells joined by a separator; on padded rows a short row ends in separators."""
    return lines.select(*keys, row, F.array_join("cells", sep, "").alias("text"))


def csv_rows(lines: DataFrame, keys: list[str] = PAGE, row: str = "row_no") -> DataFrame:
    """Rows as CSV lines; the width may differ from table to table."""
    return lines.select(*keys, row, csv_line(F.col("cells")).alias("text"))


def join_page_tables(lines: DataFrame, keys: list[str] = PAGE, row: str = "row_no", header: bool = True) -> DataFrame:
    """Markdown tables of all pages as lines, with a blank line after each table (``line_no``, ``part``, ``text``)."""
    last = lines.groupBy(*keys).agg((F.max(row) + 1).alias("line_no")).withColumn("text", F.lit(""))
    return render_markdown_table(lines, keys, row, header).unionByName(last).withColumn("part", F.lit(0))


def join_pages_markdown(names: DataFrame, out_lines: DataFrame, doc: str = "doc_id", pages: DataFrame | None = None) -> DataFrame:
    """Documents as texts in the order of ``page_no``, ``block_no``: a ``# name`` head (page 0), then the pages.

    Pages are numbered from 1 without holes. The page break stands before every page but the first, which gives the same
    document as a break after every page but the last and needs no look at the page count. With ``pages`` (document, page_no)
    a page without any line keeps its break.
    """
    texts = assemble_text(out_lines, [doc, "page_no"])
    opening = (F.col("page_no") > 1) & (F.col("block_no") == 0)
    texts = texts.withColumn("text", F.concat(F.when(opening, PAGE_BREAK).otherwise(""), "text"))
    heads = names.select(
        doc, F.lit(0).alias("page_no"), F.lit(0).alias("block_no"), F.concat(F.lit("# "), F.col("file_name"), F.lit("\n\n")).alias("text")
    )
    if pages is not None:
        bare = pages.filter("page_no > 1").select(doc, "page_no").distinct().join(out_lines.select(doc, "page_no").distinct(), [doc, "page_no"], "left_anti")
        texts = texts.unionByName(bare.select(doc, "page_no", F.lit(0).cast(texts.schema["block_no"].dataType).alias("block_no"), F.lit(PAGE_BREAK).alias("text")))
    return heads.unionByName(texts)


def document_lines(names: DataFrame, out_lines: DataFrame, doc: str = "doc_id", pages: DataFrame | None = None) -> DataFrame:
    """The same documents line by line (``page_no``, ``line_no``, ``part``): the form a text sink writes."""
    heads = names.select(
        doc,
        F.lit(0).alias("page_no"),
        F.lit(0).alias("line_no"),
        F.posexplode(F.array(F.concat(F.lit("# "), "file_name"), F.lit(""))).alias("part", "text"),
    )
    rule = PAGE_BREAK.split("\n")[:-1]
    breaks = (
        (out_lines if pages is None else pages).filter("page_no > 1")
        .select(doc, "page_no")
        .distinct()
        .select(doc, "page_no", F.lit(-1).alias("line_no"), F.posexplode(F.array(*map(F.lit, rule))).alias("part", "text"))
    )
    return heads.unionByName(breaks).unionByName(out_lines.select(doc, "page_no", "line_no", "part", "text"))
