"""Every operator as a query on the test data, with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctables.operators import answers as A
from doctables.operators import columns as C
from doctables.operators import lines as L
from doctables.operators import profile as P
from doctables.operators import render as D
from doctables.operators import rows as R
from doctables.operators import shape as S
from doctables.operators.blocks import number_rows
from doctables.operators.neighbours import stored_by
from doctables.plans import documents as plans
from doctables.sinks import writers as W
from doctables.sinks.cells import write_cell_rows
from doctables.sinks.stored import shared_folder, stored
from doctables.sources import files as files_src
from doctables.sources import pages as pages_src
from doctables.sources import words as words_src
from fixtures import inputs as I
from fixtures.sql import PROMPT, statement

PAGE = ["doc_id", "page_no"]
LINE = [*PAGE, "line_no"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def case(name: str, inputs: str, select: str, **names: str):
    def register(query):
        QUERIES[name] = query
        ORACLES[name] = statement(inputs, select, **names)
        return query

    return register


def _marked(spark, sf):
    return L.detect_pipe_tables(I.marked_lines(spark, sf), ["page"])


def _spaced_rows(spark, sf):
    rows = L.drop_blank_rows(L.split_whitespace_columns(I.spaced_lines(spark, sf)))
    return rows.select("page", F.col("line_no").alias("row_no"), "cells")


def _anchored(spark, sf, y="y", more=("text", "x"), keep=None):
    """Words in rows, with the columns that the next steps read."""
    return R.group_rows_by_anchor(I.words(spark, sf).select(*PAGE, "ord", *more, y), y=y, keep=keep)


def _cells_in_rows(spark, sf, y="y"):
    """Words in rows, stored by page, without the columns that their order does not need."""
    return _anchored(spark, sf, y, keep=[*PAGE, "row_no", "x", "ord", "text"])


def _anchor_lines(spark, sf):
    return S.pad_lines(R.table_lines(_cells_in_rows(spark, sf, "y_drift"), PAGE, ["x", "ord"]))


def _binary(spark, sf):
    pixels = I.pixels(spark, sf)
    return P.threshold_binarize(pixels, P.otsu_threshold(pixels))


def _classified(spark, sf):
    return A.classify_answer(A.match_page_answer(I.answer_pages(spark, sf), I.answers(spark, sf)))


# ---- sources ----


@case("scan_pdf_files", "f7", "select doc_id, path from f7 where regexp_matches(path, '\\.pdf$', 'i')")
def _(spark, sf):
    return files_src.only_pdf(I.files(spark, sf)).select("doc_id", "path")


SENTENCE_PAGES = """select doc_id, generate_subscripts(string_split(text, '. '), 1)::int as page_no,
unnest(list_transform(string_split(text, '. '), lambda t, i: t || case when i < len(string_split(text, '. ')) then '.' else '' end)) as text from documents"""


def _sentence_pages(spark, sf):
    return I.documents(spark, sf).withColumn("text", F.replace("text", F.lit(". "), F.lit(".\f")))


@case("explode_pages", "", SENTENCE_PAGES)
def _(spark, sf):
    return pages_src.explode_pages(_sentence_pages(spark, sf))


@case("explode_long_pages", "", SENTENCE_PAGES)
def _(spark, sf):
    return pages_src.explode_long_pages(_sentence_pages(spark, sf), piece_chars=1000)


DOCUMENT_LINES = "select doc_id, 1 as page_no, ln::int as line_no, line from f1_raw"


@case("explode_lines", "f1_raw", DOCUMENT_LINES)
def _(spark, sf):
    return pages_src.explode_lines(pages_src.explode_pages(I.documents(spark, sf)))


@case("explode_long_lines", "f1_raw", DOCUMENT_LINES)
def _(spark, sf):
    return pages_src.explode_long_lines(pages_src.explode_pages(I.documents(spark, sf)), piece_chars=1000)


@case(
    "explode_word_boxes",
    "f2",
    """select doc_id, page_no, line_no as group_no, row_number() over (partition by doc_id, page_no order by ord) - 1 as ord, text, confidence,
    x as x0, y as y0, x + 8 * length(text) as x1, y + 12 as y1 from f2""",
)
def _(spark, sf):
    words = words_src.explode_word_boxes(I.box_pages(spark, sf))
    b = F.col("bbox")
    return words.select(
        *PAGE, "group_no", "ord", "text", "confidence",
        b[0]["x"].alias("x0"), b[1]["y"].alias("y0"), b[2]["x"].alias("x1"), b[3]["y"].alias("y1"),
    )


@case(
    "flatten_word_tree",
    "f2",
    """select doc_id, page_no, line_no // 5 as block_no, line_no % 5 as line_no,
    (row_number() over (partition by doc_id, page_no, line_no order by ord) - 1)::int as word_no,
    row_number() over (partition by doc_id, page_no order by ord) - 1 as ord, text, confidence,
    x as x0, y as y0, x + 8 * length(text) as x1, y + 12 as y1 from f2""",
)
def _(spark, sf):
    words = words_src.flatten_word_tree(I.tree_pages(spark, sf))
    b = F.col("bbox")
    return words.select(
        *PAGE, "block_no", "line_no", "word_no", "ord", "text", "confidence",
        b[3]["x"].alias("x0"), b[0]["y"].alias("y0"), b[1]["x"].alias("x1"), b[2]["y"].alias("y1"),
    )


HOCR_WORDS = """select doc_id, page_no, row_number() over (partition by doc_id, page_no order by ord) - 1 as ord, text, confidence,
x as x0, y as y0, x + 8 * length(text) as x1, y + 12 as y1 from f2"""


@case("scan_hocr_words", "f2", HOCR_WORDS)
def _(spark, sf):
    return _hocr_words(words_src.parse_hocr(words_src.hocr_sheets(I.hocr_documents(spark, sf))))


@case("scan_hocr_files", "f2", HOCR_WORDS)
def _(spark, sf):
    path = shared_folder(spark)
    I.write_hocr(spark, sf, path)
    return _hocr_words(words_src.scan_hocr_words(spark, path, "*.txt.gz"))


def _hocr_words(words):
    b = F.col("bbox")
    return words.select(
        F.col("doc_id").try_cast("bigint").alias("doc_id"), "page_no", "ord", "text", "confidence",
        b[0]["x"].alias("x0"), b[0]["y"].alias("y0"), b[2]["x"].alias("x1"), b[2]["y"].alias("y1"),
    )


@case("scan_regions", "f9", "select page_id, region_no, type, res from f9")
def _(spark, sf):
    return files_src.scan_regions(I.regions(spark, sf))


# ---- projections and filters ----


@case("word_centroid", "f2", "select doc_id, page_no, ord, x + 4 * length(text) as x, y + 6 as y from f2")
def _(spark, sf):
    return R.word_centroid(I.boxes(spark, sf)).select(*PAGE, "ord", "x", "y")


@case("word_left_x", "f2", "select doc_id, page_no, ord, x from f2")
def _(spark, sf):
    return R.word_left_x(I.boxes(spark, sf)).select(*PAGE, "ord", "x")


@case("drop_blank_rows", "f4_cells", "select page, line_no, len(cells)::int as n_cells from f4_cells where len(list_filter(cells, lambda c: c <> '')) > 0")
def _(spark, sf):
    rows = L.drop_blank_rows(L.split_whitespace_columns(I.spaced_lines(spark, sf)))
    return rows.select("page", "line_no", F.size("cells").alias("n_cells"))


@case("skip_empty_lines", "f2", "select doc_id, page_no, line_no, count(*) as n_words from f2 group by all")
def _(spark, sf):
    return C.skip_empty_lines(I.lines(spark, sf), I.words(spark, sf))


@case(
    "skip_empty_lines_kept",
    "f2",
    "select doc_id, page_no, line_no, count(w.ord) as n_words from f1 left join f2 w using (doc_id, page_no, line_no) group by all",
)
def _(spark, sf):
    return C.skip_empty_lines(I.lines(spark, sf), I.words(spark, sf), keep_empty=True)


@case("threshold_binarize", "inked_px", "select page_id, y, v, ink from inked_px")
def _(spark, sf):
    return _binary(spark, sf)


@case("build_prompt", "f7_pages", PROMPT)
def _(spark, sf):
    return A.build_prompt(I.answer_pages(spark, sf)).select(*PAGE, "prompt")


# ---- rows and columns ----


@case(
    "fragment_rows",
    "f2",
    """select doc_id, page_no, line_no, (count(*) over (partition by doc_id, page_no, line_no order by ord) - 1)::int as col_no, text from f2""",
)
def _(spark, sf):
    return R.fragment_rows(I.words(spark, sf), LINE).select(*LINE, "col_no", "text")


@case("sort_by_y", "f2", "select doc_id, page_no, ord, (count(*) over (partition by doc_id, page_no order by y, ord) - 1)::int as y_rank from f2")
def _(spark, sf):
    return R.sort_by_y(I.words(spark, sf)).select(*PAGE, "ord", "y_rank")


@case("group_rows_by_anchor", "anchored", "select doc_id, page_no, ord, row_no from anchored", y="y")
def _(spark, sf):
    return _anchored(spark, sf, more=()).select(*PAGE, "ord", "row_no")


@case("group_rows_by_anchor_drift", "anchored", "select doc_id, page_no, ord, row_no from anchored", y="y_drift")
def _(spark, sf):
    return _anchored(spark, sf, "y_drift", ()).select(*PAGE, "ord", "row_no")


@case("order_cells_in_row", "anchor_cells", "select doc_id, page_no, row_no, col_no, ord, text from anchor_cells", y="y_drift")
def _(spark, sf):
    return R.order_cells_in_row(_cells_in_rows(spark, sf, "y_drift")).select(*PAGE, "row_no", "col_no", "ord", "text")


@case(
    "order_cells_in_row_text",
    "anchored",
    """select doc_id, page_no, row_no, (row_number() over (partition by doc_id, page_no, row_no order by encode(text), x, ord) - 1)::int as col_no, ord, text from anchored""",
    y="y",
)
def _(spark, sf):
    return R.order_cells_in_row(_cells_in_rows(spark, sf), cell_order="text").select(*PAGE, "row_no", "col_no", "ord", "text")


@case("bin_columns_fixed", "bin_grid", "select doc_id, page_no, line_no, col_no, text from bin_grid")
def _(spark, sf):
    return plans.tables_from_boundaries(I.lines(spark, sf), I.boxes(spark, sf)).select(*LINE, "col_no", "text")


@case(
    "bin_columns_fixed_overflow",
    "f2",
    """select doc_id, page_no, line_no, ord, (case when x < 100 then 0 when x < 300 then 1 when x < 500 then 2 else 3 end)::int as col_no from f2 where x < 700""",
)
def _(spark, sf):
    return C.bin_columns_fixed(I.words(spark, sf), overflow="drop").select(*LINE, "ord", "col_no")


@case("cluster_columns_gap", "clustered", "select doc_id, page_no, line_no, ord, col_no from clustered")
def _(spark, sf):
    return C.cluster_columns_gap(I.words(spark, sf)).select(*LINE, "ord", "col_no")


@case(
    "cluster_columns_gap_page",
    "f2",
    """select doc_id, page_no, ord, (sum(fresh) over (partition by doc_id, page_no order by x range between unbounded preceding and current row) - 1)::int as col_no
    from (select *, (coalesce(x - lag(x) over (partition by doc_id, page_no order by x, ord), 1e9) > 60)::int as fresh from f2)""",
)
def _(spark, sf):
    return C.cluster_columns_gap(I.words(spark, sf), PAGE, eps=60).select(*PAGE, "ord", "col_no")


@case(
    "order_clusters",
    "clustered",
    """select doc_id, page_no, line_no, ord, (dense_rank() over (partition by doc_id, page_no, line_no order by first_ord) - 1)::int as col_no
    from (select *, min(ord) over (partition by doc_id, page_no, line_no, col_no) as first_ord from clustered)""",
)
def _(spark, sf):
    clustered = C.cluster_columns_gap(I.words(spark, sf)).select(*LINE, "ord", "col_no")
    return C.order_clusters(stored(clustered), column_order="first_seen").select(*LINE, "ord", "col_no")


@case("merge_cell_text", "cluster_cells", "select doc_id, page_no, line_no, col_no, text from cluster_cells")
def _(spark, sf):
    return C.merge_cell_text(C.cluster_columns_gap(I.words(spark, sf)))


@case(
    "split_whitespace_columns",
    "f4_cells",
    "select page, line_no, (generate_subscripts(cells, 1) - 1)::int as col_no, unnest(cells) as text from f4_cells",
)
def _(spark, sf):
    return L.explode_cells(L.split_whitespace_columns(I.spaced_lines(spark, sf)), ["page", "line_no"])


@case("detect_pipe_tables", "marked", "select page, line_no, table_no, opens, closed from marked")
def _(spark, sf):
    return _marked(spark, sf).select("page", "line_no", "table_no", "opens", "closed")


@case("segment_bands", "bands", "select page_id, band_no, y_start, y_end from bands")
def _(spark, sf):
    return P.segment_bands(I.profile(spark, sf))


@case(
    "crop_bands",
    "bands",
    "select b.page_id, b.band_no, p.y, p.ink from f6_profile p join bands b on b.page_id = p.page_id and p.y between b.y_start and b.y_end",
)
def _(spark, sf):
    profile = I.profile(spark, sf)
    return P.crop_bands(profile, P.segment_bands(profile)).select("page_id", "band_no", "y", "ink")


@case(
    "crop_bands_exclusive",
    "bands",
    "select b.page_id, b.band_no, p.y, p.ink from f6_profile p join bands b on b.page_id = p.page_id and p.y >= b.y_start and p.y < b.y_end",
)
def _(spark, sf):
    profile = I.profile(spark, sf)
    return P.crop_bands(profile, P.segment_bands(profile), exclusive_end=True).select("page_id", "band_no", "y", "ink")


# ---- aggregates and shape ----


@case("ink_profile", "inked_px", "select page_id, y, sum(ink)::bigint as ink from inked_px group by all")
def _(spark, sf):
    return P.ink_profile(_binary(spark, sf))


@case("otsu_threshold", "thresholds", "select page_id, threshold from thresholds")
def _(spark, sf):
    return P.otsu_threshold(I.pixels(spark, sf))


@case(
    "page_skew_angle",
    "f6_edges",
    """select o_orderkey as page_id, round(coalesce(median(degrees(theta) - 90), 0), 6) as angle from orders left join f6_edges on page_id = o_orderkey group by o_orderkey""",
)
def _(spark, sf):
    angles = P.page_skew_angle(I.edge_pages(spark, sf), I.edges(spark, sf))
    return angles.select("page_id", F.round("angle", 6).alias("angle"))


@case("max_columns", "anchor_widths", "select doc_id, page_no, width from anchor_widths", y="y_drift")
def _(spark, sf):
    return S.max_columns(_anchored(spark, sf, "y_drift", ()))


@case(
    "pad_rectangular",
    "anchor_cells anchor_widths",
    """select g.doc_id, g.page_no, g.row_no, g.col_no::int as col_no, coalesce(c.text, '') as text
    from (select doc_id, page_no, row_no, unnest(range(width)) as col_no from (select distinct doc_id, page_no, row_no from anchored) join anchor_widths using (doc_id, page_no)) g
    left join anchor_cells c using (doc_id, page_no, row_no, col_no)""",
    y="y_drift",
)
def _(spark, sf):
    return plans.padded_cells(_cells_in_rows(spark, sf, "y_drift"), kept=True)


@case(
    "pad_ragged_null",
    "f4_rows",
    "select page, row_no, col_no::int as col_no, cells[col_no + 1] as text from (select *, unnest(range(width)) as col_no from f4_rows)",
)
def _(spark, sf):
    cells = L.explode_cells(_spaced_rows(spark, sf), ["page", "row_no"])
    return S.pad_ragged_null(cells, ["page"])


@case(
    "widen_table",
    "bin_grid",
    """select doc_id, page_no, line_no, max(text) filter (col_no = 0) as c0, max(text) filter (col_no = 1) as c1,
    max(text) filter (col_no = 2) as c2, max(text) filter (col_no = 3) as c3 from bin_grid group by all""",
)
def _(spark, sf):
    return S.widen_table(plans.tables_from_boundaries(I.lines(spark, sf), I.boxes(spark, sf)), 4, PAGE, "line_no")


@case("normalize_pipe_rows", "normal", "select page, line_no, piece as part, table_no, text from normal")
def _(spark, sf):
    normal = L.normalize_pipe_rows(_marked(spark, sf), ["page"])
    return normal.filter("table_no is not null").select("page", "line_no", "table_no", F.posexplode("out_lines").alias("part", "text"))


@case("stitch_markdown", "stitched", "select page, 0 as block_no, string_agg(text || chr(10), '' order by line_no, part) as text from stitched group by all")
def _(spark, sf):
    normal = L.normalize_pipe_rows(_marked(spark, sf), ["page"])
    return L.assemble_text(L.stitch_markdown(normal, ["page"]), ["page"])


@case("stitch_markdown_closed", "stitched", "select page, line_no, part, text from stitched where closed")
def _(spark, sf):
    normal = L.normalize_pipe_rows(_marked(spark, sf), ["page"])
    return L.stitch_markdown(normal, ["page"], drop_unclosed=True)


def _f1_markdown(spark, sf):
    marked = L.detect_pipe_tables(I.lines(spark, sf))
    return L.stitch_markdown(L.normalize_pipe_rows(marked))


def _names(spark, sf):
    return I.document_files(spark, sf).select("doc_id", F.element_at(F.split("path", "/"), -1).alias("file_name"))


DOC_TEXT = """select doc_id, 0 as page_no, 0 as block_no, '# ' || replace(path, 'in/', '') || chr(10) || chr(10) as text from f7_docs
union all
select doc_id, page_no, 0, case when page_no > 1 then chr(10) || '---' || chr(10) || chr(10) else '' end || string_agg(line || chr(10), '' order by line_no) as text
from f1 group by doc_id, page_no"""


@case("join_pages_markdown", "f1 f7_docs", DOC_TEXT)
def _(spark, sf):
    lines = I.lines(spark, sf)
    return D.join_pages_markdown(_names(spark, sf), _f1_markdown(spark, sf), pages=lines.select(*PAGE))


F4_TABLE = """select page, -2 as line_no, '| ' || array_to_string(range(width), ' | ') || ' |' as text from (select distinct page, width from f4_rows)
union all select page, -1, '|' || repeat('---|', width) from (select distinct page, width from f4_rows)
union all select page, row_no, '| ' || array_to_string(cells, ' | ') || repeat(' | ', width - len(cells)) || ' |' from f4_rows"""


@case("render_markdown_table", "f4_rows", F4_TABLE)
def _(spark, sf):
    return D.render_markdown_table(S.pad_lines(_spaced_rows(spark, sf), ["page"], filler=None), ["page"])


@case(
    "render_markdown_table_plain_head",
    "anchor_lines",
    """select doc_id, page_no, -1 as line_no, '|' || repeat('---|', width) as text from anchor_widths
    union all select doc_id, page_no, row_no, '| ' || array_to_string(list_transform(cells, lambda c: replace(c, '|', '\\|')), ' | ') || repeat(' | ', width - len(cells)) || ' |' from anchor_lines""",
    y="y_drift",
)
def _(spark, sf):
    return D.render_markdown_table(_anchor_lines(spark, sf), header=False)


@case(
    "join_page_tables",
    "f4_rows",
    f"""select page, 0 as block_no, string_agg(text || chr(10), '' order by line_no) as text from (
    {F4_TABLE} union all select page, max(row_no) + 1, '' from f4_rows group by page) group by page""",
)
def _(spark, sf):
    lines = S.pad_lines(_spaced_rows(spark, sf), ["page"], filler=None)
    return L.assemble_text(D.join_page_tables(lines, ["page"]), ["page"])


@case(
    "render_plain_table",
    "f4_rows",
    """select page, row_no, string_agg(lpad(coalesce(cells[c + 1], ''), w, ' '), ' ' order by c) as text
    from (select *, unnest(range(width)) as c from f4_rows)
    join (select page, c, max(length(coalesce(cells[c + 1], '')))::int as w from (select *, unnest(range(width)) as c from f4_rows) group by all) using (page, c)
    group by page, row_no""",
)
def _(spark, sf):
    return D.render_plain_table(S.pad_lines(_spaced_rows(spark, sf), ["page"]), ["page"])


# ---- structured answers ----


@case("match_page_answer", "matched", "select doc_id, page_no, ocr_text, response from matched")
def _(spark, sf):
    return A.match_page_answer(I.answer_pages(spark, sf), I.answers(spark, sf))


@case("parse_structured_json", "structured", "select doc_id, page_no, title, content, tables from structured")
def _(spark, sf):
    parsed = A.parse_structured_json(_classified(spark, sf))
    return parsed.filter("status = 'structured'").select(*PAGE, "title", "content", "tables")


@case("classify_answer", "classified", "select doc_id, page_no, status from classified")
def _(spark, sf):
    return _classified(spark, sf).select(*PAGE, "status")


@case("fallback_to_ocr", "final_rows", "select doc_id, page_no, page, title, content, tables, status from final_rows")
def _(spark, sf):
    return plans.structured_rows(I.answer_pages(spark, sf), I.answers(spark, sf))


@case("quarantine", "classified", "select doc_id, page_no, response from classified where status = 'malformed'")
def _(spark, sf):
    return A.quarantine(_classified(spark, sf)).select(*PAGE, "response")


@case(
    "explode_answer_tables",
    "final_rows",
    """select doc_id, page_no, (i - 1)::int as table_no, json_extract_string(tables, '$[' || (i - 1) || '].table_title') as table_title,
    json_extract_string(tables, '$[' || (i - 1) || '].table_content') as table_content
    from (select *, unnest(range(1, json_array_length(tables)::bigint + 1)) as i from final_rows where tables like '[{%')
    union all select doc_id, page_no, null, null, null from final_rows where not tables like '[{%'""",
)
def _(spark, sf):
    return A.explode_answer_tables(plans.structured_rows(I.answer_pages(spark, sf), I.answers(spark, sf)))


MANIFEST = """select *, case when reason is null then 'success' else 'failed' end as status from (
    select doc_id, replace(path, 'in/', '') as file_name, count(c.status) as n_pages, count(*) filter (c.status = 'malformed') as n_malformed,
    case when read_error is not null then read_error when count(c.status) = 0 then 'no pages' {strict} end as reason
    from f7 left join classified c using (doc_id) where lower(path) like '%.pdf' group by doc_id, path, read_error)"""
STRICT = "when bool_or(c.status = 'malformed') then 'malformed answer'"


def _manifest(spark, sf, strict=False):
    """The outcome of files that are written, listed and read: pages come from the files, and so do the reasons of those that fail."""
    path = shared_folder(spark)
    I.write_page_files(spark, sf, path)
    # stored, since every file would be opened once more to tell which were read
    listing, rows = files_src.list_files(spark, path), stored(files_src.read_page_files(spark, path))
    pages = rows.filter("page_no is not null").select("doc_id", "page_no", "ocr_text")
    known = I.files(spark, sf).withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    known = known.join(files_src.read_outcomes(listing, rows, known), "file_name").drop("file_name")
    return A.file_manifest(known, A.classify_answer(A.match_page_answer(pages, I.answers(spark, sf))), strict)


@case("file_manifest", "f7 classified", MANIFEST, strict="")
def _(spark, sf):
    return _manifest(spark, sf)


@case("file_manifest_strict", "f7 classified", MANIFEST, strict=STRICT)
def _(spark, sf):
    return _manifest(spark, sf, strict=True)


@case("failure_report", "f7 classified", f"select file_name as report from ({MANIFEST}) where status = 'failed'", strict="")
def _(spark, sf):
    return A.failure_report(stored(_manifest(spark, sf)))


@case("failure_report_strict", "f7 classified", f"select file_name as report from ({MANIFEST}) where status = 'failed'", strict=STRICT)
def _(spark, sf):
    return A.failure_report(stored(_manifest(spark, sf, strict=True)))


@case("orphan_answers", "f7_pages f7b", """select doc_id, page_no, 2 as attempt, response from f7b where (doc_id, page_no) not in (select (doc_id, page_no) from f7_pages)
union all select doc_id, page_no, 1, '{"title":"first"}' from f7b where doc_id % 4 = 1 and (doc_id, page_no) not in (select (doc_id, page_no) from f7_pages)""")
def _(spark, sf):
    return A.orphan_answers(I.answer_pages(spark, sf), I.answers(spark, sf))


@case("output_path", "f7", "select doc_id, path, 'out/' || regexp_replace(replace(path, 'in/', ''), '\\.[^.]*$', '') || '.md' as output_path from f7")
def _(spark, sf):
    return A.output_path(I.files(spark, sf), extension=".md")


# ---- sinks: what a sink writes, or what is read back from it ----

CSV_CELL = """case when regexp_matches({c}, '[",\\n\\r]') then '"' || replace({c}, '"', '""') || '"' else {c} end"""


def _bucketed(lines):
    """Documents in sixteen folders."""
    return lines.withColumn("bucket", (F.col("doc_id") % 16).cast("int"))


def _written(spark, path):
    """What a sink wrote, each line with its place in its folder: files by name, lines as they stand in them."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("bucket", F.col("value").alias("text"), "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_i"))
    return number_rows(lines, ["bucket"], ["file_name", "file_block_start", "_i"], "place").select("bucket", "place", "text")


#: Lines with the place that their order gives them in their folder.
PLACED = "select (doc_id % 16)::int as bucket, (row_number() over (partition by doc_id % 16 order by {order}) - 1)::int as place, text from ({lines})"


@case(
    "write_table_csv",
    "anchor_lines",
    PLACED.format(
        order="doc_id, page_no, row_no",
        lines=f"""select doc_id, page_no, row_no, case when width = 1 and cells[1] = '' then '""'
        else array_to_string(list_transform(cells, lambda c: {CSV_CELL.format(c="c")}), ',') || repeat(',', width - len(cells)) end as text from anchor_lines""",
    ),
    y="y_drift",
)
def _(spark, sf):
    path = shared_folder(spark)
    W.write_table_csv(_bucketed(_anchor_lines(spark, sf)), path, ["bucket", *PAGE], by=["bucket"])
    return _written(spark, path)


@case("write_structured_csv", "final_rows", "select page, title, content, tables from final_rows")
def _(spark, sf):
    path = shared_folder(spark)
    W.write_structured_csv(plans.structured_rows(I.answer_pages(spark, sf), I.answers(spark, sf)), path, by=[], order=["doc_id", "page_no"])
    back = spark.read.schema("page string, title string, content string, tables string")
    return back.options(header=True, multiLine=True, quote='"', lineSep="\n", **W.CSV_DIALECT).csv(path).fillna("")


@case(
    "write_page_tables_csv",
    "cluster_cells",
    PLACED.format(
        order="doc_id, page_no, line_no",
        lines=f"""select doc_id, page_no, line_no, string_agg({CSV_CELL.format(c="text")}, ',' order by col_no) || repeat(',', any_value(width) - count(*)) as text
        from cluster_cells join (select doc_id, page_no, max(n) as width from (select doc_id, page_no, line_no, count(*) as n from cluster_cells group by all) group by all) using (doc_id, page_no)
        group by doc_id, page_no, line_no""",
    ),
)
def _(spark, sf):
    words = stored_by(I.words(spark, sf).select(*LINE, "ord", "x", "text"), PAGE)  # cells and lines are made of them where they are
    cells = C.merge_cell_text(C.cluster_columns_gap(words)).withColumnRenamed("line_no", "row_no")
    path = shared_folder(spark)
    W.write_page_tables_csv(_bucketed(S.pad_lines(R.table_lines(cells))), path, ["bucket", *PAGE], by=["bucket"])
    return _written(spark, path)


@case(
    "write_markdown",
    "f1 f7_docs",
    PLACED.format(
        order="doc_id, page_no, line_no, part",
        lines="""select doc_id, 0 as page_no, 0 as line_no, 0 as part, '# ' || replace(path, 'in/', '') as text from f7_docs
        union all select doc_id, 0, 0, 1, '' from f7_docs
        union all select doc_id, page_no, -1, part, ['', '---', ''][part + 1] from (select distinct doc_id, page_no, unnest([0, 1, 2]) as part from f1 where page_no > 1)
        union all select doc_id, page_no, line_no, 0, line from f1""",
    ),
)
def _(spark, sf):
    path = shared_folder(spark)
    W.write_markdown(_bucketed(D.document_lines(_names(spark, sf), _f1_markdown(spark, sf))), path, by=["bucket"])
    return _written(spark, path)


@case(
    "write_text_rows",
    "anchor_lines",
    PLACED.format(order="doc_id, page_no, row_no", lines="select doc_id, page_no, row_no, array_to_string(cells, chr(9)) || repeat(chr(9), width - len(cells)) as text from anchor_lines"),
    y="y_drift",
)
def _(spark, sf):
    path = shared_folder(spark)
    W.write_text_rows(_bucketed(_anchor_lines(spark, sf)), path, ["bucket", *PAGE], by=["bucket"])
    return _written(spark, path)


@case(
    "write_cell_rows",
    "anchor_lines",
    PLACED.format(order="doc_id, page_no, row_no", lines="select doc_id, page_no, row_no, array_to_string(cells, chr(9)) || repeat(chr(9), width - len(cells)) as text from anchor_lines"),
    y="y_drift",
)
def _(spark, sf):
    path = shared_folder(spark)
    write_cell_rows(_bucketed(plans.padded_cells(_cells_in_rows(spark, sf, "y_drift"), kept=True)), path, ["bucket", *PAGE], by=["bucket"])
    return _written(spark, path)


@case(
    "write_text_rows_fragments",
    "f2",
    PLACED.format(order="doc_id, page_no, line_no", lines="select doc_id, page_no, line_no, string_agg(text, ' ' order by ord) as text from f2 group by doc_id, page_no, line_no"),
)
def _(spark, sf):
    lines = plans.tables_from_fragments(words_src.explode_word_boxes(I.box_pages(spark, sf)))
    path = shared_folder(spark)
    W.write_text_rows(_bucketed(lines), path, ["bucket", *PAGE], by=["bucket"], sep=" ")
    return _written(spark, path)


@case(
    "write_sidecar_text",
    "f1",
    PLACED.format(order="doc_id, page_no, line_no", lines="select doc_id, page_no, line_no, case when page_no > 1 and line_no = 0 then chr(12) else '' end || line as text from f1"),
)
def _(spark, sf):
    lines = I.lines(spark, sf).groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    pages = lines.select(*PAGE, F.array_join(F.transform("l", lambda s: s["line"]), "\n").alias("text"))
    path = shared_folder(spark)
    W.write_sidecar_text(_bucketed(pages), path, by=["bucket"])
    return _written(spark, path)


@case("write_regions", "f9", "select page_id, region_no, type, res from f9")
def _(spark, sf):
    path = shared_folder(spark)
    W.write_regions(I.regions(spark, sf), path, by=["type"])
    return spark.read.schema("page_id bigint, region_no int, res string, type string").parquet(path)


# ---- whole paths ----


@case(
    "page_tables",
    "f2",
    """, ys as (select distinct doc_id, page_no, y + 6 as y from f2), anchors as (
      select doc_id, page_no, min(y) as y, 0 as row_no from ys group by all
      union all
      select a.doc_id, a.page_no, min(n.y), a.row_no + 1 from anchors a join ys n on n.doc_id = a.doc_id and n.page_no = a.page_no and n.y > a.y + 15
      group by a.doc_id, a.page_no, a.row_no),
    cells as (select w.*, a.row_no::int as row_no from f2 w asof join anchors a on w.doc_id = a.doc_id and w.page_no = a.page_no and w.y + 6 >= a.y),
    table_rows as (select doc_id, page_no, row_no, count(*)::int as n_cells, string_agg(text, chr(9) order by x + 4 * length(text), ord) as t from cells group by all),
    wide as (select *, max(n_cells) over (partition by doc_id, page_no) as width from table_rows)
    select doc_id, page_no, row_no, width, t || repeat(chr(9), width - n_cells) as text from wide""",
)
def page_tables(spark, sf):
    """Word boxes of every page to its padded table rows."""
    lines = plans.tables_from_boxes(I.boxes(spark, sf))
    return lines.select(*PAGE, "row_no", "width", F.array_join("cells", "\t").alias("text"))


@case(
    "cluster_tables",
    "cluster_cells",
    """select doc_id, page_no, line_no, unnest(range(width))::int as col_no, unnest(list_resize(texts, width)) as text from (
      select *, max(len(texts)) over (partition by doc_id, page_no) as width from (
        select doc_id, page_no, line_no, list(text order by col_no) as texts from cluster_cells group by all))""",
)
def _(spark, sf):
    return plans.tables_from_clusters(I.boxes(spark, sf))
