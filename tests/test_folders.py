"""Folders of very many small files: tasks list and read them, and what is written there is not moved first."""

import gzip

from pyspark.sql import functions as F

from doctables.sinks import files as S
from doctables.sources import files as sources
from doctables.sources import words as words_src
from fixtures import inputs as I


def _odd_folder(top):
    for folder, files in {
        "folder=1": {"a b.pdf": b"x", "ä%41+.pdf": b"xy", "zero.pdf": b"", "_hidden.pdf": b"x", ".dot.pdf": b"x", "c.txt": b"x"},
        "folder=x y": {"d.pdf": b"x"}, "plain": {"e.pdf": b"x"}, ".g=1": {"g.pdf": b"x"},
    }.items():
        (top / folder).mkdir(parents=True)
        for name, content in files.items():
            (top / folder / name).write_bytes(content)


def test_tasks_list_files_as_spark_does(spark, tmp_path, monkeypatch):
    _odd_folder(tmp_path / "odd")
    (tmp_path / "odd" / "plain" / "e.pdf").unlink()
    (tmp_path / "odd" / "plain").rmdir()
    for value in ("a%20b", "7", "__HIVE_DEFAULT_PARTITION__"):
        (tmp_path / "named" / f"file_name={value}").mkdir(parents=True)
        (tmp_path / "named" / f"file_name={value}" / "part-0").write_bytes(b"abc")
    for name in ("odd", "named"):
        for files in ("*", "*.pdf", "part-*"):
            found = sources.list_files(spark, str(tmp_path / name), files)
            assert found.inputFiles() == []  # before: every file, kept on the driver
            got = sorted(map(tuple, found.collect()), key=repr)
            with monkeypatch.context() as m:
                m.setattr(sources, "_reached", lambda *a: None)
                assert got == sorted(map(tuple, sources.list_files(spark, str(tmp_path / name), files).collect()), key=repr)
    flat = tmp_path / "flat"
    _odd_folder(flat)
    (flat / "top.pdf").write_bytes(b"x")
    assert "e.pdf" not in {r.file_name for r in sources.list_files(spark, str(flat)).collect()}
    assert [r.file_name for r in sources.list_files(spark, f"{flat}/folder=*", "[a]*").collect()] == ["a%20b.pdf"]  # patterns are left to Spark
    (tmp_path / "none").mkdir()
    assert sources.list_files(spark, str(tmp_path / "none")).count() == 0


def test_tasks_read_page_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i}.pdf", i, 1, f"page {i}") for i in range(300)], "file_name string, doc_id long, page_no int, ocr_text string")
    S.write_table_files(rows, str(tmp_path / "p"))
    spark.createDataFrame([(5, "x")], "DOC_ID int, other string").coalesce(1).write.parquet(str(tmp_path / "p" / "folder=one"))
    spark.createDataFrame([("no number",)], "doc_id string").coalesce(1).write.parquet(str(tmp_path / "p" / "folder=two"))
    (tmp_path / "p" / "folder=one" / "bad").write_bytes(b"PAR1")
    read = sources.read_page_files(spark, str(tmp_path / "p"))
    assert read.inputFiles() == [] and read.columns == ["doc_id", "page_no", "ocr_text", "path", "file_name"]
    got = {r.file_name: r for r in read.collect()}
    assert len(got) == 301 and (got["17.pdf"].doc_id, got["17.pdf"].page_no, got["17.pdf"].ocr_text) == (17, 1, "page 17")
    other = next(r for name, r in got.items() if name.startswith("part-"))
    assert (other.doc_id, other.page_no, other.ocr_text) == (5, None, None)
    errors = sources.read_outcomes(sources.list_files(spark, str(tmp_path / "p")), read).filter("read_error is not null")
    assert sorted(r.file_name[:3] for r in errors.collect()) == ["bad", "par"]


def test_hocr_stays_where_it_is_built(spark, tmp_path):
    texts = [(1, "a <b\n" * 60), (1, "c"), (2, ""), (3, None), (None, "d e")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    held = I.hocr_documents(spark, str(tmp_path))
    assert held._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # of the texts; before: of the hOCR too
    got = {r.doc_id: r.hocr for r in held.collect()}
    assert set(got) == {1, 2, None} and got[1].count("id='page_1'") == 2 and got[1].count("ocrx_word") == 121 and "ocrx_word" not in got[2]
    I.write_hocr(spark, str(tmp_path), str(tmp_path / "out"))
    files = {f.name: gzip.decompress(f.read_bytes()).decode() for f in (tmp_path / "out").glob("folder=*/*")}
    assert files == {f"{'none' if d is None else d}.txt.gz": text + "\n" for d, text in got.items()}  # before: as they are, many times their size
    words = words_src.scan_hocr_words(spark, str(tmp_path / "out"), "*.txt.gz")
    assert {(r.doc_id, r.n) for r in words.groupBy("doc_id").agg(F.count("ord").alias("n")).collect()} == {("1", 121)}


def test_rows_that_stand_together_are_written_where_they_are(spark, tmp_path):
    lines = spark.range(0, 40, 1, 4).selectExpr("concat(id div 2, '.x') as file_name", "string(id) as value")
    S.write_text_files(lines, str(tmp_path / "t"), dealt=True)
    S.write_text_files(lines, str(tmp_path / "z"), packed=".zst")
    assert {f.name: f.read_text() for f in (tmp_path / "t").glob("folder=*/*")} == {f"{i}.x": f"{2 * i}\n{2 * i + 1}\n" for i in range(20)}
    read = sources.read_text_files(spark, str(tmp_path / "z"), "*.zst", "doc_id")
    assert {r.name: sorted(r.value.split()) for r in read.collect()} == {f"{i}.x.zst": sorted([str(2 * i), str(2 * i + 1)]) for i in range(20)}
