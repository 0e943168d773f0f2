"""Answers: validity against Python's parser, defaults, fallbacks, outcome of files."""

import json
import os

from doctables.operators import answers as A
from doctables.plans import documents as plans

RESPONSES = [
    '{"title":"t","content":"c","tables":[{"table_title":"a","table_content":"1"}]}',
    '{"title":"a","title":"b","content":"c","content":"d","tables":[1],"tables":[{"table_title":"z"}]}', '{"a":{"k":1,"k":2}}',
    '{"title":"t"}', "{}", '{"tables":"x"}', '{"tables":[]}', ' {"title":"t"} \n', '{"title":null}',
    '{"title":"t"} x', '{"a":1} {"b":2}', '{"a":1},{"b":2}', "{}] [{}", '{}} {"b":{}', '{"title":"t', "[1,2]", "[]", "null", "1", '"s"', "true",
    "", " ", "x", "[", "]", "}", '{"a":1}]', '{"a":[1,2}', "{'a':1}", '{"a":1,}', "[1],[2]", '1,"b":2', '{"title":"ä|\\n\\"q\\""}',
]


def expected(r):
    if r is None:
        return "missing"
    try:
        return "structured" if isinstance(json.loads(r), dict) else "fallback"
    except json.JSONDecodeError:
        return "malformed"


def test_status_agrees_with_a_strict_parser(spark):
    rows = [(i, 1, "ocr", r) for i, r in enumerate([*RESPONSES, None])]
    got = A.classify_answer(spark.createDataFrame(rows, "doc_id bigint, page_no int, ocr_text string, response string"))
    assert {r.response: r.status for r in got.collect()} == {r: expected(r) for r in [*RESPONSES, None]}


def test_fields_have_defaults(spark):
    rows = [(i, 1, "ocr", r) for i, r in enumerate(RESPONSES)]
    matched = spark.createDataFrame(rows, "doc_id bigint, page_no int, ocr_text string, response string")
    got = {r.doc_id: r for r in A.fallback_to_ocr(A.parse_structured_json(A.classify_answer(matched))).collect()}
    for i, r in enumerate(RESPONSES):
        if expected(r) != "structured":
            assert (got[i].title, got[i].content, got[i].tables) == ("", "ocr", "")
            continue
        want = json.loads(r)
        assert (got[i].title, got[i].content) == (want.get("title") or "", want.get("content", ""))
        assert json.loads(got[i].tables) == want.get("tables", [])


def test_answer_tables_and_outcomes(spark):
    pages = spark.createDataFrame([(0, 1, "p1"), (0, 2, "p2"), (1, 1, "q1"), (2, 1, "r1")], "doc_id bigint, page_no int, ocr_text string")
    answers = spark.createDataFrame(
        [(0, 1, RESPONSES[0]), (0, 2, '{"title":"t'), (1, 1, "[1]"), (5, 1, "{}")], "doc_id bigint, page_no int, response string"
    )
    rows = plans.structured_rows(pages, answers)
    assert {(r.doc_id, r.page_no): r.status for r in rows.collect()} == {
        (0, 1): "structured", (0, 2): "malformed", (1, 1): "fallback", (2, 1): "missing"}
    tables = {(r.doc_id, r.page_no, r.table_no): (r.table_title, r.table_content) for r in A.explode_answer_tables(rows).collect()}
    assert tables == {(0, 1, 0): ("a", "1"), (0, 2, None): (None, None), (1, 1, None): (None, None), (2, 1, None): (None, None)}
    files = spark.createDataFrame([(i, f"in/s.{i}.pdf") for i in range(4)], "doc_id bigint, path string")
    strict = {r.doc_id: (r.file_name, r.status, r.n_pages, r.n_malformed) for r in A.file_manifest(files, rows, strict=True).collect()}
    assert strict == {0: ("s.0.pdf", "failed", 2, 1), 1: ("s.1.pdf", "success", 1, 0), 2: ("s.2.pdf", "success", 1, 0), 3: ("s.3.pdf", "failed", 0, 0)}
    loose = {r.doc_id: (r.status, r.reason) for r in A.file_manifest(files, rows).collect()}
    assert loose == {0: ("success", None), 1: ("success", None), 2: ("success", None), 3: ("failed", "no pages")}
    read = files.selectExpr("*", "if(doc_id = 1, 'cannot be read', null) as read_error").union(spark.createDataFrame([(9, "in/s.9.txt", None)], "doc_id bigint, path string, read_error string"))
    manifest = A.file_manifest(read, rows, strict=True)
    assert {r.doc_id: r.reason for r in manifest.collect()} == {0: "malformed answer", 1: "cannot be read", 2: None, 3: "no pages"}
    assert sorted(r.report for r in A.failure_report(manifest).collect()) == ["s.0.pdf", "s.1.pdf", "s.3.pdf"]
    assert [r.report for r in A.failure_report(manifest.filter("doc_id = 2")).collect()] == ["All files processed successfully."]
    paths = {r.doc_id: r.output_path for r in A.output_path(files, "out", ".csv").collect()}
    assert paths == {i: f"out/s.{i}.csv" for i in range(4)}
    assert "p1" in A.build_prompt(pages).filter("ocr_text = 'p1'").collect()[0].prompt
    assert [(r.doc_id, r.page_no, r.response) for r in A.orphan_answers(pages, answers).collect()] == [(5, 1, "{}")]
    tries = spark.createDataFrame([(0, 1, 1, '{"a":9}'), (0, 1, 2, '{"a":2}'), (0, 1, 2, '{"a":1}')], "doc_id bigint, page_no int, attempt int, response string")
    assert [r.response for r in A.match_page_answer(pages, tries).filter("doc_id = 0 and page_no = 1").collect()] == ['{"a":2}']
    assert A.quarantine(A.classify_answer(A.match_page_answer(pages, answers))).count() == 1


def test_extensions_are_cut_like_splitext(spark):
    names = ["a.pdf", "a.b.PDF", ".pdf", "..pdf", "a..pdf", "plain", "dot.", "in/dir.x/name", "in/dir.x/name.hocr"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r.path: r.output_path for r in A.output_path(files, "o", ".md").collect()}
    assert got == {n: "o/" + os.path.splitext(os.path.basename(n))[0] + ".md" for n in names}
