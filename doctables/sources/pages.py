"""Documents to pages, pages to lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.operators.blocks import running_sum

# Characters of a piece of a long text.
PIECE_CHARS = 1 << 20


def explode_pages(docs: DataFrame, text: str = "text", keys: list[str] = ["doc_id"], page_break: str = "\f") -> DataFrame:
    """One row per page, numbered from 1. Each text is split inside its own row; for texts of any length: ``explode_long_pages``."""
    return docs.select(*keys, F.posexplode(F.split(text, page_break)).alias("_p", "text")).select(
        *keys, (F.col("_p") + 1).alias("page_no"), "text"
    )


def explode_lines(pages: DataFrame, text: str = "text", keys: list[str] = ["doc_id", "page_no"], line_no: str = "line_no") -> DataFrame:
    """One row per line, numbered from 0; empty lines stay, also trailing ones. For texts of any length: ``explode_long_lines``."""
    return pages.select(*keys, F.posexplode(F.split(text, "\n")).alias(line_no, "line"))


def _explode_pieces(texts: DataFrame, text: str, keys: list[str], mark: str, number: str, out: str, piece_chars: int) -> DataFrame:
    """The stretches between single-character marks, numbered from 0, of texts that are first cut into pieces.

    A row's only work on a whole text is to cut it, in one pass. The pieces are dealt out, split in their own tasks and numbered by the
    marks before them; a stretch that runs over several pieces is put together again. ``keys`` name a text.
    """
    cut = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{piece_chars}}}"), F.lit(0))
    whole = F.when(F.col(text) == "", F.array(F.lit(""))).otherwise(cut)
    pieces = texts.select(*keys, F.posexplode(whole).alias("_piece", "_text"))
    marks = F.length("_text") - F.length(F.replace("_text", F.lit(mark), F.lit("")))
    sizes = pieces.select(*keys, "_piece", marks.alias("_marks"))
    before = running_sum(sizes, keys, ["_piece"], F.col("_marks"), "_before").select(*keys, "_piece", "_before")
    split = pieces.repartition(*keys, "_piece").join(before, [*keys, "_piece"]).select(*keys, "_piece", "_before", F.posexplode(F.split("_text", mark, -1)).alias("_i", "_part"))
    numbered = split.withColumn(number, (F.col("_before") + F.col("_i")).cast("int"))
    parts = numbered.groupBy(*keys, number).agg(F.sort_array(F.collect_list(F.struct("_piece", "_part"))).alias("_parts"))
    return parts.select(*keys, number, F.array_join(F.transform("_parts", lambda p: p["_part"]), "").alias(out))


def explode_long_pages(docs: DataFrame, text: str = "text", keys: list[str] = ["doc_id"], page_break: str = "\f", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """The rows of ``explode_pages``; a text of many pages is split by many tasks."""
    pages = _explode_pieces(docs, text, keys, page_break, "_p", "text", piece_chars)
    return pages.select(*keys, (F.col("_p") + 1).alias("page_no"), "text")


def explode_long_lines(pages: DataFrame, text: str = "text", keys: list[str] = ["doc_id", "page_no"], line_no: str = "line_no", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """The rows of ``explode_lines``; a text of many lines is split by many tasks."""
    return _explode_pieces(pages, text, keys, "\n", line_no, "line", piece_chars)
