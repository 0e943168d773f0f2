"""Tables in text lines against plain loops."""

import random
import re
from itertools import groupby

import pytest

from doctables.operators import lines as L
from doctables.operators import render as D
from doctables.operators import shape as S
from pyspark.sql import functions as F

LINES = "doc_id bigint, page_no int, line_no int, line string"
SAMPLES = ["---+---", "  --  ", "a | b", "|x|y|z|", "plain", "", "2013-2017 | 5", "- -", "+", "x - y"]


def walk(page, drop_unclosed=False):
    """Output lines of one page: runs of lines that are governed by a separator line are tables, all others are text."""
    inside, governed = False, []
    for line in page:
        if set(line.strip()) and set(line.strip()) <= set("-+"):
            inside = True
        elif "|" not in line:
            inside = False
        governed.append(inside)
    out = []
    for is_table, run in groupby(zip(governed, page), key=lambda pair: pair[0]):
        run = [line for _, line in run]
        if not is_table:
            out += run
            continue
        cells = [re.split(r"[-+|]", re.sub(r"[-+]+", "|", line).strip()) for line in run]
        wide = max(map(len, cells))
        rows = ["|".join(c + [""] * (wide - len(c))) for c in cells]
        out += ["", rows[0], *(["|" + "---|" * (wide - 1)] if len(rows) > 1 else []), *rows[1:]]
        size = len(rows) + (len(rows) > 1) + 1
    return out[:-size] if inside and drop_unclosed else out


@pytest.mark.parametrize("block_lines", [1, 4, 65536])
def test_pipe_tables_equal_a_walk(spark, block_lines):
    rng = random.Random(block_lines)
    pages = {(d, p): [rng.choice(SAMPLES) for _ in range(rng.randint(1, 40))] for d in range(12) for p in (1, 2)}
    rows = [(*k, i, line) for k, page in pages.items() for i, line in enumerate(page)]
    rng.shuffle(rows)
    marked = L.detect_pipe_tables(spark.createDataFrame(rows, LINES), block_lines=block_lines)
    normal = L.normalize_pipe_rows(marked, block_lines=block_lines).cache()
    for drop in (False, True):
        got = {}
        for r in sorted(L.stitch_markdown(normal, drop_unclosed=drop).collect(), key=lambda r: (r.line_no, r.part)):
            got.setdefault((r.doc_id, r.page_no), []).append(r.text)
        assert got == {k: w for k, page in pages.items() if (w := walk(page, drop))}
    texts = {}
    for r in sorted(L.assemble_text(L.stitch_markdown(normal), block_lines=block_lines).collect(), key=lambda r: r.block_no):
        texts[(r.doc_id, r.page_no)] = texts.get((r.doc_id, r.page_no), "") + r.text
    assert texts == {k: "".join(line + "\n" for line in walk(page)) for k, page in pages.items()}
    normal.unpersist()


def test_wide_blanks_are_unicode_blanks(spark):
    lines = ["  a b  c ", "a  b c", "\t\tx\t\ty", "", "   ", "a\x1c\x1db", "one", "a   b"]
    table = spark.createDataFrame([(0, 1, i, line) for i, line in enumerate(lines)], LINES)
    got = {r.line_no: r.cells for r in L.split_whitespace_columns(table).collect()}
    assert got == {i: re.split(r"\s{2,}", line.strip()) for i, line in enumerate(lines)}
    kept = {r.line_no for r in L.drop_blank_rows(L.split_whitespace_columns(table)).collect()}
    assert kept == {0, 1, 2, 5, 6, 7}


def test_padding_and_rendering(spark):
    rows = [(0, 1, 0, ["a|b", "c"]), (0, 1, 1, ["d"]), (0, 2, 0, ["e", None, "f"])]
    lines = spark.createDataFrame(rows, "doc_id bigint, page_no int, row_no int, cells array<string>")
    padded = {(r.page_no, r.row_no): (r.cells, r.width) for r in S.pad_lines(lines).collect()}
    assert padded == {(1, 0): (["a|b", "c"], 2), (1, 1): (["d", ""], 2), (2, 0): (["e", None, "f"], 3)}
    got = D.render_markdown_table(S.pad_lines(lines)).orderBy("page_no", "line_no").collect()
    assert [r.text for r in got] == ["| 0 | 1 |", "|---|---|", "| a\\|b | c |", "| d |  |", "| 0 | 1 | 2 |", "|---|---|---|", "| e |  | f |"]
    plain = D.render_plain_table(S.pad_lines(lines)).orderBy("page_no", "row_no").collect()
    assert [r.text for r in plain] == ["a|b c", "  d  ", "e  f"]
    cells = L.explode_cells(lines, ["doc_id", "page_no", "row_no"])
    assert {(r.page_no, r.width) for r in S.max_columns(cells).collect()} == {(1, 2), (2, 3)}
    ragged = {(r.page_no, r.row_no, r.col_no): r.text for r in S.pad_ragged_null(cells).collect()}
    assert ragged == {(1, 0, 0): "a|b", (1, 0, 1): "c", (1, 1, 0): "d", (1, 1, 1): None, (2, 0, 0): "e", (2, 0, 1): None, (2, 0, 2): "f"}
    wide = S.widen_table(cells, 3, missing="").orderBy("page_no", "row_no").select("c0", "c1", "c2").collect()
    assert [tuple(r) for r in wide] == [("a|b", "c", ""), ("d", "", ""), ("e", "", "f")]


def test_documents_are_joined_with_breaks(spark):
    lines = spark.createDataFrame([(0, 1, 0, 0, "x"), (0, 1, 1, 0, "y"), (0, 2, 0, 0, "z")], "doc_id bigint, page_no int, line_no int, part int, text string")
    names = spark.createDataFrame([(0, "a.pdf"), (1, "empty.pdf")], "doc_id bigint, file_name string")
    want = "# a.pdf\n\nx\ny\n\n---\n\nz\n"
    texts = D.join_pages_markdown(names, lines).filter("doc_id = 0").orderBy("page_no", "block_no").collect()
    assert "".join(r.text for r in texts) == want
    single = D.document_lines(names, lines).filter("doc_id = 0").orderBy("page_no", "line_no", "part").collect()
    assert "".join(r.text + "\n" for r in single) == want
    assert D.join_pages_markdown(names, lines).filter(F.col("doc_id") == 1).collect()[0].text == "# empty.pdf\n\n"
