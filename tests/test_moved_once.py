"""Words move once, packed by page, and what is made of them afterwards is made where they are."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from doctables.operators import blocks as B
from doctables.operators import neighbours as N
from doctables.operators import rows as R
from doctables.operators import shape as S
from doctables.plans import documents as plans
from doctables.sinks.cells import write_cell_rows
from doctables.sinks.stored import CLEANUP, stored

PAGE = ["doc_id", "page_no"]
KEEP = [*PAGE, "row_no", "x", "ord", "text"]


def _words(spark, n=4000, parts=3):
    rng = random.Random(n)
    rows = [(rng.choice([None, 1, 2, 3]) if i % 50 else i, 1 + i % 7 // 4, i, rng.choice([None, float("nan"), -0.0, rng.uniform(0, 300)]) if i % 3 == 0 else float(i % 290), float(rng.randint(0, 9)), rng.choice(["a", "", "ß", None, "b c"])) for i in range(n)]
    rows.sort(key=lambda r: (str(r[0]), r[1]))
    return spark.createDataFrame(rows, "doc_id long, page_no int, ord long, y double, x double, text string").repartition(parts, "doc_id")


def _rows(table, *columns):
    return sorted(map(repr, map(tuple, (table.select(*columns) if columns else table).collect())))


def _moves(table) -> list[str]:
    plan = table._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange" in line]


def test_packed_rows_come_out_as_they_went_in(spark):
    kinds = spark.range(0, 3000, 1, 2).selectExpr(
        "id div 100 as k", "if(id % 700 < 20, null, 'g') as g", "id", "array(struct(id as a, string(id) as b)) as s", "if(id % 3 = 0, null, map('m', id)) as m",
        "timestamp_seconds(id) as t", "decimal(id) as d", "cast(string(id) as binary) as bytes", "id % 2 = 0 as f",
    )
    for table in (kinds, kinds.repartition(5, F.xxhash64("id")), kinds.filter("id < 0")):
        moved = N.packed(table, ["k", "g"], 7)
        assert moved.rdd.getNumPartitions() == 7
        kept = N.stored_by(table, ["k", "g"])
        assert _rows(kept) == _rows(table) and kept.columns == table.columns
    assert N.packed(kinds, ["k", "g"], 7).count() < 100  # before there was no packing: 3000 rows moved
    assert N.packed(kinds.repartition(5, F.xxhash64("id")), ["id"], 7).count() == 3000


def test_a_run_is_no_longer_than_its_batch(spark):
    got = N.packed(spark.range(0, 25000, 1, 1).selectExpr("1 as k", "id"), ["k"], 2)
    assert got.filter("_packed is not null").count() == -(-25000 // int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))


def test_rows_are_the_same_with_and_without_packing(spark, monkeypatch):
    for words in (_words(spark), _words(spark).repartition(4, F.xxhash64("ord")), _words(spark).withColumn("y", F.col("y").cast("float")), _words(spark).withColumn("y", F.lit(None).cast("int"))):
        columns = [c for c in words.columns if c != "y"]
        got = _rows(R.group_rows_by_anchor(words), *columns, "row_no")
        kept = R.group_rows_by_anchor(words, keep=KEEP)
        assert _rows(kept, *columns, "row_no") == got and kept.columns == KEEP
        with monkeypatch.context() as m:
            m.setattr(R, "can_pack", lambda *a: False)
            assert _rows(R.group_rows_by_anchor(words), *columns, "row_no") == got
            assert _rows(R.group_rows_by_anchor(words, keep=KEEP), *columns, "row_no") == got
        assert _rows(R.group_rows_by_anchor(words, part_rows=50, keep=KEEP), *columns, "row_no") == got


def test_nothing_moves_after_words_are_stored_by_page(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        words = _words(spark)
        kept = R.group_rows_by_anchor(words, keep=KEEP)
        plain = stored(kept)  # as it was kept before
        monkeypatch.setattr(B, "ROWS_PER_TASK", 700)  # more tasks than shuffle partitions: still nothing is dealt out anew
        spread = R.group_rows_by_anchor(words, keep=KEEP)
        assert B.stands(kept, PAGE, exactly=True) and not B.stands(plain, PAGE) and not B.stands(kept, ["page_no"]) and not B.stands(kept, [*PAGE, "row_no"], exactly=True)
        for table in (kept, spread):
            for make in (
                lambda t: R.order_cells_in_row(t),
                lambda t: R.order_cells_in_row(t, cell_order="text"),
                lambda t: S.pad_lines(R.table_lines(t, PAGE, ["x", "ord"])),
                lambda t: plans.padded_cells(t, kept=True),
            ):
                made = make(table)
                assert _moves(made) == [] and _moves(make(plain)) != []
                assert _rows(made) == _rows(make(plain))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_pages_are_not_brought_into_one_task(spark):
    words = _words(spark)
    for kept in (R.group_rows_by_anchor(words, part_rows=50, keep=KEEP), N.stored_by(words, PAGE, part_rows=50)):
        assert not B.stands(kept, PAGE) and kept.count() == 4000
    assert B.stands(N.stored_by(words, PAGE), PAGE, exactly=True)


def test_cells_travel_in_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("doctables.sinks.cells.CELLS_HELD", 16)
    cells = [(d, 1, r, c, None if c % 5 == 0 else f"{d}.{r}.{c}") for d in (0, 1, 2) for r in range(4) for c in range(d * 50 + 1)]
    random.Random(2).shuffle(cells)
    table = spark.createDataFrame(cells, "doc_id long, page_no int, row_no int, col_no int, text string")
    write_cell_rows(table, str(tmp_path / "out"))
    for d in (0, 1, 2):
        lines = "".join(f.read_text() for f in sorted((tmp_path / "out" / f"doc_id={d}").glob("*"))).split("\n")[:-1]
        assert lines == ["\t".join("" if c % 5 == 0 else f"{d}.{r}.{c}" for c in range(d * 50 + 1)) for r in range(4)]


def test_what_a_stored_table_was_shuffled_by_is_deleted(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    data = lambda: sum(files().apply(i).getName().startswith("shuffle") and files().apply(i).getName().endswith(".data") for i in range(files().size()))
    before, held = spark.conf.get(CLEANUP), data()
    kept = stored(spark.range(5000).selectExpr("id % 7 as k", "uuid() as u").repartition(6, "k"))
    for _ in range(50):
        if data() <= held:
            break
        __import__("time").sleep(0.1)
    assert data() <= held and kept.count() == 5000 and spark.conf.get(CLEANUP) == before  # before: the files stayed


def test_changes_between_batches():
    one, two = (pa.RecordBatch.from_pydict({"k": pa.array(v, pa.int64())}) for v in ([1, 1, None], [None, 2]))
    assert np.flatnonzero(N.changes(one, ["k"], None)).tolist() == [0, 2] and N.changes(two, ["k"], one).tolist() == [False, True]
