"""Tables inside text lines: cells between wide blanks, and pipe tables between plain lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doctables.functions.text import count_pipes, line_class, pipe_row, split_wide_blanks
from doctables.operators.blocks import LINES_PER_BLOCK, int_block

PAGE = ["doc_id", "page_no"]


def split_whitespace_columns(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``cells``: the line cut at runs of two or more blanks; single blanks stay inside a cell."""
    return lines.withColumn("cells", split_wide_blanks(F.col(line)))


def drop_blank_rows(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Keep a row only if one of its cells is not empty."""
    return rows.filter(F.exists(cells, lambda c: c != ""))


def explode_cells(rows: DataFrame, keys: list[str], cells: str = "cells") -> DataFrame:
    """Rows with cell arrays to one row per cell."""
    return rows.select(*keys, F.posexplode(cells).alias("col_no", "text"))


def detect_pipe_tables(lines: DataFrame, keys: list[str] = PAGE, block_lines: int = LINES_PER_BLOCK) -> DataFrame:
    """Mark the lines of pipe tables.

    A separator line opens a table (or belongs to the open one); while a table is open, lines with a pipe belong to it; any
    other line closes it. So a table is open exactly where the last line that is not a pipe line was a separator. Adds
    ``table_no`` (0-based per page, null on plain lines), ``opens`` (first line of its table) and ``closed`` (false for a
    table that is still open at the end of its page).
    """
    rows = lines.withColumns({"_lb": int_block(F.col("line_no"), block_lines), "_k": line_class(F.col("line"))})
    inside = Window.partitionBy(*keys, "_lb").orderBy("line_no")
    solid = F.when(F.col("_k") != "P", F.col("_k"))
    rows = rows.withColumn("_prev", F.last(solid, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))

    page = Window.partitionBy(*keys)
    ahead = page.orderBy("_lb").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy(*keys, "_lb")
        .agg(
            F.min_by(solid, F.when(solid.isNotNull(), F.col("line_no"))).alias("_head"),
            F.max_by(solid, F.when(solid.isNotNull(), F.col("line_no"))).alias("_tail"),
            F.count_if((F.col("_k") == "S") & (F.col("_prev") == "O")).alias("_n"),
        )
        .withColumn("_carry", F.coalesce(F.last("_tail", ignorenulls=True).over(ahead), F.lit("O")))
        .withColumn("_n", F.col("_n") + F.when((F.col("_head") == "S") & (F.col("_carry") == "O"), 1).otherwise(0))
        .withColumns(
            {
                "_base": F.coalesce(F.sum("_n").over(ahead), F.lit(0)),
                "_all": F.sum("_n").over(page),
                "_end": F.last("_tail", ignorenulls=True).over(
                    page.orderBy("_lb").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
                ),
            }
        )
        .select(*keys, "_lb", "_carry", "_base", "_all", "_end")
    )
    is_open = F.coalesce("_prev", "_carry") == "S"
    return (
        rows.join(blocks, [*keys, "_lb"])
        .withColumn("opens", (F.col("_k") == "S") & ~is_open)
        .withColumn("_no", F.col("_base") + F.count_if("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        .withColumn("table_no", F.when((F.col("_k") == "S") | ((F.col("_k") == "P") & is_open), F.col("_no")).cast("int"))
        .withColumn("closed", F.when(F.col("table_no").isNotNull(), ~((F.col("_end") == "S") & (F.col("table_no") == F.col("_all") - 1))))
        .drop("_lb", "_k", "_prev", "_carry", "_base", "_all", "_end", "_no")
    )


def normalize_pipe_rows(marked: DataFrame, keys: list[str] = PAGE, block_lines: int = LINES_PER_BLOCK) -> DataFrame:
    """Give table lines their Markdown form in ``out_lines`` (array); plain lines pass through.

    Runs of ``-`` and ``+`` become one pipe, rows are padded with pipes to the width of their table, and a ``---`` row follows
    the first line of a table with more than one line.
    """
    rows = marked.withColumns(
        {
            "_lb": int_block(F.col("line_no"), block_lines),
            "_row": F.when(F.col("table_no").isNotNull(), pipe_row(F.col("line"))),
        }
    )
    table = Window.partitionBy(*keys, "table_no")
    widths = (
        rows.filter(F.col("table_no").isNotNull() & (F.col("_row") != ""))
        .groupBy(*keys, "table_no", "_lb")
        .agg(F.max(count_pipes(F.col("_row"))).alias("_w"), F.count(F.lit(1)).alias("_n"))
        .withColumns({"_w": F.max("_w").over(table), "_n": F.sum("_n").over(table)})
    )
    padded = F.concat("_row", F.repeat(F.lit("|"), F.col("_w") - count_pipes(F.col("_row"))))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.col("_w")))
    return (
        rows.join(widths, [*keys, "table_no", "_lb"], "left")
        .withColumn(
            "out_lines",
            F.when(F.col("table_no").isNull(), F.array("line"))
            .when(F.col("opens") & (F.col("_n") > 1), F.array(padded, rule))
            .otherwise(F.array(padded)),
        )
        .drop("_lb", "_row", "_w", "_n")
    )


def stitch_markdown(normal: DataFrame, keys: list[str] = PAGE, drop_unclosed: bool = False) -> DataFrame:
    """Text lines and converted tables in their original order, one row per output line (``line_no``, ``part``, ``text``).

    A blank line stands before every table. A table that is still open at the end of its page is kept unless
    ``drop_unclosed``.
    """
    if drop_unclosed:
        normal = normal.filter(F.coalesce("closed", F.lit(True)))
    lines = F.when(F.col("opens"), F.concat(F.array(F.lit("")), F.col("out_lines"))).otherwise(F.col("out_lines"))
    return normal.select(*keys, "line_no", F.posexplode(lines).alias("part", "text"))


def assemble_text(out_lines: DataFrame, keys: list[str] = PAGE, block_lines: int = LINES_PER_BLOCK) -> DataFrame:
    """Output lines to texts, each line ended by a line break: one text per page and per ``block_lines`` source lines.

    A page shorter than a block is one text; the texts of a longer one follow each other in the order of ``block_no``.
    """
    return (
        out_lines.groupBy(*keys, int_block(F.greatest("line_no", F.lit(0)), block_lines).cast("int").alias("block_no"))
        .agg(F.sort_array(F.collect_list(F.struct("line_no", "part", "text"))).alias("_l"))
        .select(*keys, "block_no", F.concat(F.array_join(F.transform("_l", lambda s: s["text"]), "\n"), F.lit("\n")).alias("text"))
    )
