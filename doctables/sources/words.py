"""Recognised words from nested results, word trees and hOCR texts to one row per word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctables.functions.text import unescape_html, without_extension
from doctables.sources.files import read_text_files

PAGE = ["doc_id", "page_no"]


def four_corners(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """The corners of an upright box, clockwise from the upper left."""
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((left, top), (right, top), (right, bottom), (left, bottom))])


def explode_word_boxes(pages: DataFrame, result: str = "result", keys: list[str] = PAGE) -> DataFrame:
    """``array<array<struct<bbox,text,confidence>>>`` per page to words; ``ord`` counts all words of the page.

    The position is made inside the page's own row, so no shuffle is needed to number the words.
    """
    flat = F.flatten(F.transform(result, lambda group, g: F.transform(group, lambda item: F.struct(g.alias("group_no"), item.alias("item")))))
    return pages.select(*keys, F.posexplode(flat).alias("ord", "_w")).select(
        *keys,
        "_w.group_no",
        F.col("ord").cast("bigint").alias("ord"),
        "_w.item.text",
        "_w.item.confidence",
        "_w.item.bbox",
    )


def flatten_word_tree(pages: DataFrame, blocks: str = "blocks", keys: list[str] = PAGE) -> DataFrame:
    """Block -> line -> word trees with two-corner geometry to words with four corners."""
    flat = F.flatten(
        F.transform(
            blocks,
            lambda block, b: F.flatten(
                F.transform(
                    block["lines"],
                    lambda line, n: F.transform(
                        line["words"],
                        lambda word, i: F.struct(b.alias("block_no"), n.alias("line_no"), i.alias("word_no"), word.alias("word")),
                    ),
                )
            ),
        )
    )
    corner = [F.col("_w.word.geometry")[i] for i in range(2)]
    return pages.select(*keys, F.posexplode(flat).alias("ord", "_w")).select(
        *keys,
        "_w.block_no",
        "_w.line_no",
        "_w.word_no",
        F.col("ord").cast("bigint").alias("ord"),
        "_w.word.text",
        "_w.word.confidence",
        four_corners(corner[0]["x"], corner[0]["y"], corner[1]["x"], corner[1]["y"]).alias("bbox"),
    )


# --- fixed values: hOCR markup: the places before a page's and before a word's start mark ---
HOCR_PAGE = r"""(?=<div\b[^>]*class=['"][^'"]*\bocr_page\b)"""
HOCR_WORD = r"""(?=<span\b[^>]*class=['"][^'"]*\bocrx_word\b)"""
HOCR_BOX = r"bbox (-?\d+) (-?\d+) (-?\d+) (-?\d+)"
HOCR_CONFIDENCE = r"x_wconf (\d+(?:\.\d+)?)"
SPAN_MARK = r"(?=</?span\b)"
# --- fixed value: the extension of a compressed file, behind that of what it holds ---
PACKED = r"(?<=.\.[^.]{1,9})\.(gz|bz2|zst)$"


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _from_marks(text: Column, mark: str) -> Column:
    """The text cut before every mark, without what stands before the first one."""
    behind = lambda pieces: F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return _once(F.split(text, mark, -1), lambda pieces: F.when(text.rlike(f"^{mark}"), pieces).otherwise(behind(pieces)))


def _plain_content(after_mark: Column) -> Column:
    """What a span without spans inside holds, given what follows its start mark; all of it if the span is never closed."""
    closing = F.locate("</span", after_mark)
    return F.when(closing > 0, F.left(after_mark, closing - 1)).otherwise(after_mark)


def _span_content(after_mark: Column, plain: Column) -> Column:
    """What a span holds, given what follows its start mark, with spans at any depth inside; all of it if the span is never closed.

    Most words hold no span (``plain`` is their content); for the others the open spans are counted from mark to mark.
    """
    state = F.struct(F.lit(1).alias("depth"), F.lit("").alias("held"))

    def step(s, piece):
        depth = s["depth"] + F.when(piece.startswith("</span"), -1).when(piece.startswith("<span"), 1).otherwise(0)
        done = (s["depth"] == 0) | (depth == 0)
        return F.struct(F.when(done, 0).otherwise(depth).alias("depth"), F.when(done, s["held"]).otherwise(F.concat(s["held"], piece)).alias("held"))

    nested = F.aggregate(F.split(after_mark, SPAN_MARK, -1), state, step, lambda s: s["held"])
    return F.when(plain.contains("<span"), nested).otherwise(plain)


def parse_hocr(pages: DataFrame, hocr: str = "hocr", keys: list[str] = PAGE) -> DataFrame:
    """Words of hOCR texts: content, box and confidence (0..1), numbered by their start marks. A word without box or confidence has nulls."""
    words = pages.select(*keys, F.posexplode(_from_marks(F.col(hocr), HOCR_WORD)).alias("ord", "_s"))
    words = words.withColumn("_tag", F.regexp_extract("_s", "^<[^>]*>", 0))
    # a column of its own for what is named several times, so that no word is searched twice
    words = words.withColumns({"_after": F.substring("_s", F.length("_tag") + 1, F.length("_s")), "_box": F.split(F.regexp_extract("_tag", HOCR_BOX, 0), " ")})
    words = words.withColumn("_plain", _plain_content(F.col("_after")))
    words = words.withColumn("_held", _span_content(F.col("_after"), F.col("_plain")))
    words = words.withColumn("_held", F.when(F.col("_held").contains("<"), F.regexp_replace("_held", "<[^>]*>", "")).otherwise(F.col("_held")))
    side = [F.try_element_at("_box", F.lit(i)).try_cast("double") for i in range(2, 6)]
    return words.select(
        *keys,
        F.col("ord").cast("bigint").alias("ord"),
        unescape_html(F.col("_held")).alias("text"),
        (F.regexp_extract("_tag", HOCR_CONFIDENCE, 1).try_cast("double") / 100).alias("confidence"),
        four_corners(*side).alias("bbox"),
    )


def hocr_sheets(documents: DataFrame, hocr: str = "hocr", keys: list[str] = ["doc_id"]) -> DataFrame:
    """Pages of hOCR documents, numbered from 1; a document without page marks is one page."""
    whole = _once(_from_marks(F.col(hocr), HOCR_PAGE), lambda sheets: F.when(F.size(sheets) > 0, sheets).otherwise(F.array(hocr)))
    return documents.select(*keys, F.posexplode(whole).alias("_p", "hocr")).select(*keys, (F.col("_p") + 1).alias("page_no"), "hocr")


def scan_hocr_words(spark: SparkSession, path: str, files: str = "*.hocr") -> DataFrame:
    """Read hOCR sidecar files, one per document and of any number of pages, as words.

    ``doc_id`` is the name of the file without its extension, or that of its folder if folders are named ``doc_id=...``. Files may be
    compressed, which a second extension tells.
    """
    found = read_text_files(spark, path, files, "doc_id")
    name = F.when(F.col("named"), F.col("name")).otherwise(without_extension(F.regexp_replace("name", PACKED, "")))
    return parse_hocr(hocr_sheets(found.select(name.alias("doc_id"), F.col("value").alias("hocr"))))
