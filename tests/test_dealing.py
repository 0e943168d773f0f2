"""Tasks that cut texts up stay small."""

from pyspark.sql import functions as F

from fixtures import inputs as I


def test_texts_are_dealt_to_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    rows = [(i, f"some words of text {i} " * 10) for i in range(400)] + [(None, "no id"), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(I, "TEXT_PER_TASK", 2048, raising=False)
    docs = I.documents(spark, str(tmp_path))
    held = docs.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("text")).alias("n")).collect()
    total = sum(r.n or 0 for r in held)
    assert total == sum(len(text or "") for _, text in rows) and max(r.n or 0 for r in held) < 5 * 2048 < total / 5
    assert docs.count() == len(rows)


def test_few_texts_are_left_to_spark(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert I.documents(spark, str(tmp_path)).count() == 0
