"""Files in, files out."""

import csv
import io
import random
import tracemalloc

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from doctables.operators import render as D
from doctables.operators import shape as S
from doctables.sinks import writers as W
from doctables.sinks.cells import CellRowWriter, write_cell_rows
from doctables.sources import files as files_src
from doctables.sources import pages as pages_src
from doctables.sources import words as words_src


def read(folder):
    return "".join(p.read_bytes().decode() for p in sorted(folder.glob("part-*")))


def test_long_texts_are_split_by_many_tasks(spark):
    rng = random.Random(6)
    texts = ["", "\n", "a", "\n\na\n", None, "x" * 50, *("".join(rng.choice("ab\n\f😀é") for _ in range(rng.randint(1, 90))) for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for chars in (1, 3, 40, 1000):
        got = pages_src.explode_long_lines(docs, keys=["doc_id"], piece_chars=chars).collect()
        assert {(r.doc_id, r.line_no): r.line for r in got} == {(d, i): x for d, t in enumerate(texts) if t is not None for i, x in enumerate(t.split("\n"))}
        got = pages_src.explode_long_pages(docs, piece_chars=chars).collect()
        assert {(r.doc_id, r.page_no): r.text for r in got} == {(d, i + 1): x for d, t in enumerate(texts) if t is not None for i, x in enumerate(t.split("\f"))}
    one = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(400_000)))], "doc_id bigint, text string")
    lines = pages_src.explode_long_lines(one, keys=["doc_id"], piece_chars=1 << 16)
    assert lines.count() == 400_000 and lines.filter("line <> concat('line ', line_no)").count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would put the few megabytes of this test into one task
    try:
        assert lines.select(F.spark_partition_id().alias("task")).distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def words_of_hocr(spark, body):
    table = spark.createDataFrame([(1, f"<html><div class='ocr_page'>{body}</div></html>")], "doc_id bigint, hocr string")
    return [(r.page_no, r.ord, r.text, r.confidence, r.bbox[0].x) for r in words_src.parse_hocr(words_src.hocr_sheets(table)).orderBy("ord").collect()]


def test_hocr_words_hold_spans_at_any_depth(spark):
    word = lambda inner, conf="; x_wconf 90.5": f"<span class='ocrx_word x' title='bbox 1 2 3 4{conf}'>{inner}</span>"
    deep = "<span class='a'><span class='b'><span>A</span></span><em>B</em></span><span>C</span>"
    body = f"head <span class='ocr_line' title='bbox 9 9 9 9'>{word('one')} stray {word(deep)}</span> tail {word('&#38;lt; &#x26;amp; &amp;lt; &#55296; &#1114112; &apos;', '')} after"
    assert words_of_hocr(spark, body) == [
        (1, 0, "one", 0.905, 1.0), (1, 1, "ABC", 0.905, 1.0), (1, 2, "&lt; &amp; &lt; \ufffd \ufffd '", None, 1.0)]
    assert [t for _, _, t, *_ in words_of_hocr(spark, "<span class='ocrx_word'>open <span>x" + word("y"))] == ["open x", "y"]
    assert words_of_hocr(spark, "no words") == []


def test_files_that_cannot_be_read_are_told_by_reading_them(spark, tmp_path):
    good = spark.createDataFrame([(1, 1, "p1"), (1, 2, "p2"), (2, None, None)], "doc_id bigint, page_no int, ocr_text string")
    for name, rows in (("good.pdf", good.filter("doc_id = 1")), ("none.pdf", good.filter("doc_id = 2"))):
        rows.coalesce(1).write.parquet(str(tmp_path / f"file_name={name}"))
    for name, content in (("broken.pdf", b"%PDF-1.4"), ("zero.pdf", b""), ("cut.pdf", None), ("gone.pdf", b"x")):
        folder = tmp_path / f"file_name={name}"
        folder.mkdir()
        if content is None:
            content = next((tmp_path / "file_name=good.pdf").glob("part-*")).read_bytes()[:-9]
        (folder / "part-0.parquet").write_bytes(content)
    listing = spark.createDataFrame(files_src.list_files(spark, str(tmp_path), "part-*").collect(), "path string, file_name string, length bigint")
    (tmp_path / "file_name=gone.pdf" / "part-0.parquet").unlink()
    rows = files_src.read_page_files(spark, str(tmp_path), files="part-*")
    assert sorted((r.file_name, r.page_no) for r in rows.collect() if r.page_no) == [("good.pdf", 1), ("good.pdf", 2)]
    want = {"good.pdf": None, "none.pdf": None, "broken.pdf": "cannot be read", "cut.pdf": "cannot be read", "gone.pdf": "cannot be read"}
    assert {r.file_name: r.read_error for r in files_src.read_outcomes(listing, rows).collect()} == want
    expected = spark.createDataFrame([(name,) for name in [*want, "zero.pdf", "never.pdf"]], "file_name string")
    got = {r.file_name: r.read_error for r in files_src.read_outcomes(listing, rows, expected).collect()}
    assert got == {**want, "zero.pdf": "empty or missing", "never.pdf": "empty or missing"}


def test_a_large_folder_continues_in_the_next_file(spark, tmp_path):
    rows = [(b, d, i, f"{b} {d} {i}") for b, n in ((0, 3), (1, 900), (2, 40)) for d in range(2) for i in range(n)]
    random.Random(1).shuffle(rows)
    lines = spark.createDataFrame(rows, "bucket int, doc_id bigint, line_no int, text string")
    W.write_lines(lines, str(tmp_path / "out"), ["bucket"], ["doc_id", "line_no"])
    for b in range(3):
        files = sorted((tmp_path / "out" / f"bucket={b}").glob("part-*"))
        assert "".join(f.read_text() for f in files) == "".join(t + "\n" for *_, t in sorted(r for r in rows if r[0] == b))
        assert (len(files) > 1) == (b == 1)


def test_pdf_listing_is_flat_and_ignores_case(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("A.PDF", "b.pdf", "c.txt", "d.pdf.bak", "sub/e.pdf"):
        (tmp_path / name).write_bytes(b"%PDF")
    got = files_src.scan_pdf_files(spark, str(tmp_path))
    assert {r.file_name for r in got.collect()} == {"A.PDF", "b.pdf"}


def test_hocr_files(spark, tmp_path):
    text = (
        "<html><body><span class='ocr_line' title='bbox 0 0 9 9'>\n"
        "<span class='ocrx_word' id='w1' title='bbox 10 20 30 40; x_wconf 96'>a&amp;b &lt;</span>\n"
        '<span class="ocrx_word" title="bbox 50 20 70 40; x_wconf 7"><strong>zwölf</strong></span></span></body></html>'
    )
    (tmp_path / "p.hocr").write_text(text, encoding="utf-8")
    word = lambda x, inner: f"<span class='ocrx_word'\n title='bbox {x} 1 2 3; x_wconf 50'>{inner}</span>\n"
    chars = "<span class='ocrx_cinfo'>A</span><span class='ocrx_cinfo'>B</span>"
    sheets = "".join(f"<div class='ocr_page' id='page_{p}'>\n{word(p, chars)}{word(p + 10, '&#228;&#x20AC;&amp;#65;')}{word(p + 20, '<em>e</em>f')}</div>" for p in (1, 2))
    (tmp_path / "two.x.hocr").write_text(f"<html><body>{sheets}</body></html>", encoding="utf-8")
    rows = words_src.scan_hocr_words(spark, str(tmp_path)).collect()
    got = sorted((r for r in rows if r.doc_id == "p"), key=lambda r: r.ord)
    assert [(r.page_no, r.ord, r.text, r.confidence, r.bbox[0].x, r.bbox[2].y) for r in got] == [(1, 0, "a&b <", 0.96, 10.0, 40.0), (1, 1, "zwölf", 0.07, 50.0, 40.0)]
    got = sorted((r.page_no, r.ord, r.text, r.bbox[0].x) for r in rows if r.doc_id == "two.x")
    assert got == [(p, i, t, p + 10.0 * i) for p in (1, 2) for i, t in enumerate(("AB", "ä€&#65;", "ef"))]


def test_table_csv_has_the_bytes_of_a_csv_writer(spark, tmp_path):
    rng = random.Random(2)
    pool = ["a", "", "b c", "x,y", 'say "hi"', "two\nlines", " lead", "trail ", "ä|ß", "1-2"]
    rows = {(d, p): [[rng.choice(pool) for _ in range(rng.randint(1, 4))] for _ in range(6)] for d in range(3) for p in (1, 2)}
    rows[(9, 1)] = [[""], ["z"]]
    flat = [(d, p, i, cells) for (d, p), page in rows.items() for i, cells in enumerate(page)]
    rng.shuffle(flat)
    lines = S.pad_lines(spark.createDataFrame(flat, "doc_id bigint, page_no int, row_no int, cells array<string>"))
    W.write_table_csv(lines, str(tmp_path / "csv"))
    W.write_page_tables_csv(lines, str(tmp_path / "pages"))
    W.write_text_rows(lines, str(tmp_path / "txt"))
    for doc in {d for d, _ in rows}:
        want, text = io.StringIO(), ""
        for page in sorted(p for d, p in rows if d == doc):
            one = pd.DataFrame(rows[(doc, page)]).fillna("").to_csv(index=False, header=False, lineterminator="\n")
            assert read(tmp_path / "pages" / f"doc_id={doc}" / f"page_no={page}") == one
            want.write(one)
            wide = max(map(len, rows[(doc, page)]))
            text += "".join("\t".join(r + [""] * (wide - len(r))) + "\n" for r in rows[(doc, page)])
        assert read(tmp_path / "csv" / f"doc_id={doc}") == want.getvalue()
        assert read(tmp_path / "txt" / f"doc_id={doc}") == text


def test_structured_csv(spark, tmp_path):
    rows = [(d, p, str(p), "t, x", 'line\n"two" ' + str(d), "[]" if p == 1 else "") for d in range(3) for p in (2, 1)]
    table = spark.createDataFrame(rows, "doc_id bigint, page_no int, page string, title string, content string, tables string")
    W.write_structured_csv(table, str(tmp_path / "out"))
    for doc in range(3):
        got = list(csv.reader(io.StringIO(read(tmp_path / "out" / f"doc_id={doc}"))))
        assert got == [["page", "title", "content", "tables"]] + [[str(p), "t, x", f'line\n"two" {doc}', "[]" if p == 1 else ""] for p in (1, 2)]


def test_markdown_sidecar_and_regions(spark, tmp_path):
    lines = spark.createDataFrame(
        [(0, p, i, 0, f"{p}.{i}") for p in (2, 1) for i in range(30)], "doc_id bigint, page_no int, line_no int, part int, text string"
    )
    names = spark.createDataFrame([(0, "a.pdf")], "doc_id bigint, file_name string")
    W.write_markdown(D.document_lines(names, lines), str(tmp_path / "md"))
    body = ["".join(f"{p}.{i}\n" for i in range(30)) for p in (1, 2)]
    assert read(tmp_path / "md" / "doc_id=0") == "# a.pdf\n\n" + "\n---\n\n".join(body)
    some = lines.filter("page_no = 1").union(spark.createDataFrame([(0, 3, 0, 0, "3.0")], lines.schema))
    sheets = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "doc_id bigint, page_no int")
    whole = sorted(D.join_pages_markdown(names, some, pages=sheets).collect(), key=lambda r: (r.page_no, r.block_no))
    assert "".join(r.text for r in whole) == "# a.pdf\n\n" + body[0] + "\n---\n\n" * 2 + "3.0\n"
    W.write_markdown(D.document_lines(names, some, pages=sheets), str(tmp_path / "md2"))
    assert read(tmp_path / "md2" / "doc_id=0") == "".join(r.text for r in whole)
    pages = spark.createDataFrame([(0, 2, "b\n"), (0, 1, "a\n")], "doc_id bigint, page_no int, text string")
    W.write_sidecar_text(pages, str(tmp_path / "txt"))
    assert read(tmp_path / "txt" / "doc_id=0") == "a\n\n\fb\n\n"
    regions = spark.createDataFrame(
        [(0, 0, "title", bytearray(b"x"), "r"), (0, 1, "text", bytearray(b"y"), "s")], "page_id bigint, region_no int, type string, img binary, res string"
    )
    W.write_regions(regions, str(tmp_path / "regions"))
    back = spark.read.parquet(str(tmp_path / "regions"))
    assert "img" not in back.columns and {(r.type, r.res) for r in back.collect()} == {("title", "r"), ("text", "s")}
    assert (tmp_path / "regions" / "page_id=0" / "type=title").is_dir()


def test_cell_rows_are_joined_by_the_writer(spark, tmp_path):
    rng = random.Random(3)
    rows = {(b, d, r): [rng.choice(["", None, "x", "ä b", "z" * 9]) for _ in range(rng.choice([1, 2, 900]))] for b in ("a b", "c/d=%", None) for d in range(3) for r in range(4)}
    flat = [(*key, i, text) for key, cells in rows.items() for i, text in enumerate(cells)]
    rng.shuffle(flat)
    cells = spark.createDataFrame(flat, "bucket string, doc_id bigint, row_no int, col_no int, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        write_cell_rows(cells, str(tmp_path / "out"), ["bucket", "doc_id"], ["bucket"], sep=" ")
        write_cell_rows(cells.filter("bucket = 'a b'").drop("bucket"), str(tmp_path / "flat"), ["doc_id"], [])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = lambda bucket, sep: "".join(sep.join(c or "" for c in rows[key]) + "\n" for key in sorted((k for k in rows if k[0] == bucket), key=str))
    found = {r.bucket for r in spark.read.text(str(tmp_path / "out")).select("bucket").distinct().collect()}
    assert found == {"a b", "c/d=%", None}
    for bucket, name in (("a b", "a b"), ("c/d=%", "c%2Fd%3D%25"), (None, "__HIVE_DEFAULT_PARTITION__")):
        assert read(tmp_path / "out" / f"bucket={name}") == want(bucket, " ")
    assert read(tmp_path / "flat") == want("a b", "\t")
    assert not list(tmp_path.glob("*/_temporary*"))
    with pytest.raises(FileExistsError):
        write_cell_rows(cells, str(tmp_path / "out"))


def test_a_row_of_ten_million_words_needs_the_memory_of_a_batch(tmp_path):
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1] * 10_000), "row_no": pa.array([0] * 10_000), "text": pa.array(["word"] * 10_000)})
    writer = CellRowWriter({"path": str(tmp_path / "out"), "sep": " ", "by": "[\"doc_id\"]", "row": "[\"row_no\"]", "job": "j"})
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    peak = 0

    def batches():
        nonlocal peak
        for _ in range(1000):
            yield batch
            peak = max(peak, pa.total_allocated_bytes() - before)

    writer.commit([writer.write(batches())])
    assert tracemalloc.get_traced_memory()[1] + peak < 4_000_000
    tracemalloc.stop()
    [file] = (tmp_path / "out" / "doc_id=1").glob("part-*")
    assert file.stat().st_size == 5 * 10_000_000
