"""What clusters are ranked by is derived once."""

from doctables.operators import columns as C


def test_words_are_read_twice_to_order_clusters(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(d, 1, ln, i, (i * 5 + d) % 7) for d in range(6) for ln in range(4) for i in range(30)]
    kind = "doc_id long, page_no int, line_no int, ord long, col_no int"
    words = spark.createDataFrame(rows, kind).mapInArrow(counted, kind)
    got = C.order_clusters(words, column_order="first_seen").collect()
    order = {(d, ln): list(dict.fromkeys(c for dd, _, l, _, c in rows if (dd, l) == (d, ln))) for d in range(6) for ln in range(4)}
    assert {(r.doc_id, r.line_no, r.ord): r.col_no for r in got} == {(d, ln, i): order[d, ln].index(c) for d, _, ln, i, c in rows}
    assert seen.value == 2 * len(rows)
