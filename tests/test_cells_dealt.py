"""Cells dealt out by line: the same cells, and their text is moved once."""

import random

from pyspark.sql import functions as F

from doctables.operators import columns as C
from doctables.operators import shape as S
from doctables.plans import documents as plans

WORDS = "doc_id bigint, page_no int, line_no int, ord bigint, text string, bbox array<struct<x:double,y:double>>"


def some_words(rng):
    rows = []
    for doc in (None, 0, 1, 2):
        for line in (None, *range(12)):
            for k in range(rng.randint(0, 40)):
                text = rng.choice(["a", "b b", "", " ", None, "ß", "c\n"])
                place = rng.choice([None, k, k, k, rng.randint(0, 9)])
                rows.append((doc, 1, line, place, text, [(rng.uniform(0, 900), 0.0)]))
    return rows


def test_dealt_cells_are_the_same(spark):
    rng = random.Random(3)
    for order in (lambda r: 0, lambda r: rng.random()):
        words = spark.createDataFrame(sorted(some_words(rng), key=order), WORDS).withColumn("col_no", (F.col("bbox")[0]["x"] / 300).cast("int"))
        for table in (words, words.repartition(5, "ord"), words.withColumn("ord", F.col("ord").cast("string")), words.filter("false")):
            for sep in (" ", "", "--", "."):
                want = sorted(map(repr, C.merge_cell_text(table, sep=sep).collect()))
                assert sorted(map(repr, C.merge_cell_text(table, sep=sep, deal=C.LINE).collect())) == want


def test_lines_have_all_columns(spark):
    lines = spark.createDataFrame([(0, 1, 0), (0, 1, 1), (0, 1, 1), (None, 1, 0)], "doc_id bigint, page_no int, line_no int")
    cells = spark.createDataFrame([(0, 1, 0, 1, "x", 5), (0, 1, 1, 0, "y", 6), (0, 1, 1, 0, "z", 7), (0, 1, 1, 9, "beyond", 8), (0, 1, 1, 1, None, 9), (None, 1, 0, 0, "lost", 1)], "doc_id bigint, page_no int, line_no int, col_no int, text string, n int")
    got = sorted(map(tuple, C.fill_columns(lines, cells, 2).select("doc_id", "line_no", "col_no", "text", "n").collect()), key=repr)
    twice = [(0, 1, 0, "y", 6), (0, 1, 0, "z", 7), (0, 1, 1, "", 9)] * 2
    assert got == sorted([(0, 0, 0, "", None), (0, 0, 1, "x", 5), *twice, (None, 0, 0, "", None), (None, 0, 1, "", None)], key=repr)


def test_text_is_moved_once(spark):
    """From words to a wide table: one exchange of the words, one of the lines."""
    words = spark.createDataFrame(some_words(random.Random(4)), WORDS)
    lines = words.select(*C.LINE).distinct().localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        wide = S.widen_table(plans.tables_from_boundaries(lines, words), 4, C.LINE[:2], "line_no")
        plan = wide._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2
