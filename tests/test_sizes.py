"""Tasks that grow in number, not in size, and one file for every name."""

from pyspark.sql import functions as F

from doctables.operators import blocks as B
from doctables.operators import rows as R
from doctables.sinks import files as S
from doctables.sinks import writers as W
from doctables.sources import files as sources
from doctables.sources import words as words_src
from fixtures import inputs


def _words(spark):
    return spark.range(600).selectExpr("id % 50 as doc_id", "1 as page_no", "id as ord", "double(id % 37) as x", "double(id * 7 % 200) as y", "string(id) as text")


def test_rows_are_dealt_to_more_tasks_where_there_are_more(spark, monkeypatch):
    rows = lambda t: sorted(map(tuple, t.select("doc_id", "ord", "row_no").collect()))
    expected = rows(R.group_rows_by_anchor(_words(spark)))
    monkeypatch.setattr(B, "ROWS_PER_TASK", 10)
    for part_rows in (B.ROWS_PER_PART, 5):
        found = R.group_rows_by_anchor(_words(spark), part_rows=part_rows)
        assert rows(found) == expected
        assert found.rdd.getNumPartitions() == 60
    numbered = B.number_rows(_words(spark), ["doc_id"], ["ord"], "n")
    assert numbered.rdd.getNumPartitions() == 60
    assert sorted(r.n for r in numbered.filter("doc_id = 3").collect()) == list(range(12))


def test_files_of_many_rows_are_sorted_by_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(W, "ROWS_PER_FILE", 10)
    placed = W.in_order(_words(spark).withColumn("bucket", F.col("doc_id") % 2), ["bucket"], ["ord"])
    sizes = [len(p) for p in placed.rdd.glom().collect()]
    assert len(sizes) >= 60 and sum(sizes) == 600 and max(sizes) < 100


def test_one_file_for_every_name(spark, tmp_path):
    rows = spark.createDataFrame([("a.PDF", 1, "x"), ("a.PDF", 2, None), ("b.txt", 3, "ä"), (None, 4, "y")], "file_name string, doc_id long, ocr_text string")
    S.write_table_files(rows, str(tmp_path / "t"))
    S.write_text_files(rows.filter("doc_id < 3").withColumn("file_name", F.lit("c.pdf")), str(tmp_path / "t"), text="ocr_text")
    listing = sources.list_files(spark, str(tmp_path / "t"))
    assert sorted(r.file_name for r in listing.collect()) == ["a.PDF", "b.txt", "c.pdf"]
    read = sources.read_page_files(spark, str(tmp_path / "t"), "doc_id bigint, ocr_text string")
    assert sorted((r.file_name, r.doc_id, r.ocr_text or "") for r in read.collect()) == [("a.PDF", 1, "x"), ("a.PDF", 2, ""), ("b.txt", 3, "ä")]
    errors = {r.file_name: r.read_error for r in sources.read_outcomes(listing, read).collect()}
    assert errors == {"a.PDF": None, "b.txt": None, "c.pdf": "cannot be read"}
    text = next((tmp_path / "t").glob("folder=*/c.pdf")).read_text()
    assert sorted(text.split("\n")) == ["", "", "x"]


def test_hocr_files_named_by_their_document(spark, tmp_path):
    page = "<div class='ocr_page'><span class='ocrx_word' title='bbox 1 2 3 4; x_wconf 50'>a&amp;<b>b</b></span></div>"
    rows = spark.createDataFrame([("7.txt", page), ("8.txt", "<span class='ocrx_word'>c</span>")], "file_name string, value string")
    S.write_text_files(rows, str(tmp_path / "h"))
    found = words_src.scan_hocr_words(spark, str(tmp_path / "h"), "*.txt").selectExpr("doc_id", "page_no", "ord", "text", "confidence", "bbox[2].x", "bbox[2].y")
    assert sorted(map(tuple, found.collect())) == [("7", 1, 0, "a&b", 0.5, 3.0, 4.0), ("8", 1, 0, "c", None, None, None)]


def test_words_look_up_their_row_without_being_sorted(spark):
    found = R.group_rows_by_anchor(_words(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Window" not in plan
    rows = [(None, 1, 0, 5.0), (None, 1, 1, 30.0), (None, 1, 2, None), (2, None, 3, float("nan")), (2, None, 4, -0.0), (2, None, 5, 0.0), (2, None, 5, 0.0)]
    odd = spark.createDataFrame(rows, "doc_id long, page_no int, ord long, y double")
    expected = [(None, 1, 0, 0), (None, 1, 1, 1), (None, 1, 2, -1), (2, None, 3, 0), (2, None, 4, 0), (2, None, 5, 0), (2, None, 5, 0)]
    assert sorted(map(tuple, R.group_rows_by_anchor(odd).select("doc_id", "page_no", "ord", "row_no").collect()), key=lambda r: r[2]) == expected


def test_nested_pages_are_built_from_whole_slices(spark, tmp_path):
    texts = [(1, "ä b  c\n\nd\n"), (2, ""), (3, None), (None, "e f"), (-5, "\n".join(f"w{i} x" for i in range(30)))]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    pages = inputs.box_pages(spark, str(tmp_path))
    assert "lambda" not in pages._jdf.queryExecution().executedPlan().toString()
    found = {(r.doc_id, r.page_no): [[w.text for w in line] for line in r.result] for r in pages.collect()}
    with_empty = [line for i in range(30) for line in ([[f"w{i}", "x"], []] if i % 9 == 8 else [[f"w{i}", "x"]])]
    turned = lambda lines: [line[::-1] if n % 3 == 0 else line for n, line in enumerate(lines)]
    assert found == {
        (1, 1): [["c", "b", "ä"], [], ["d"], []], (2, 1): [[]], (None, 1): [["f", "e"]],
        (-5, 1): turned(with_empty[:25]), (-5, 2): turned(with_empty[25:]),
    }
    words = {(r.doc_id, w.text): w for r in pages.collect() for line in r.result for w in line}
    assert [(p.x, p.y) for p in words[1, "c"].bbox] == [(142.0, 0.0), (150.0, 0.0), (150.0, 12.0), (142.0, 12.0)] and words[1, "c"].confidence == 0.04
    assert words[None, "e"].confidence is None and words[None, "e"].bbox[0].x is None
    blocks = {(r.doc_id, r.page_no): [[[w.text for w in line.words] for line in b.lines] for b in r.blocks] for r in inputs.tree_pages(spark, str(tmp_path)).collect()}
    assert blocks == {k: [lines[i : i + 5] for i in range(0, len(lines), 5)] for k, lines in found.items()}
