"""Every stage of the pipeline against what a plain version would keep, and the whole on the smallest data."""

import random
import re

import corpus_pipeline
from doctables.llm import line_rules, secrets
from tests.llm.rows import SCHEMA, rows
from tests.llm.test_pairs import brute, chains
from tests.llm.test_texts import plain_measures, plain_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "ids", "row", "rest", "blob", "host"]


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    data = rows(13, 30) + [(2000 + k, t, "en", "s0", len(t), "", 1, 1, "", "") for k, t in enumerate(chains(5, 5, 6))]
    item = " ".join(f"bench{rng.randrange(999)}" for _ in range(30))
    data += [(3000 + k, " ".join(f"v{rng.randrange(9999)}" for _ in range(40)) + " " + item, "en", "s0", 1, "", 1, 1, "", "") for k in range(3)]
    data += [(3100, "password = 'hunter2hunter2' " + " ".join(f"u{rng.randrange(9999)}" for _ in range(40)), "en", "s0", 1, "", 1, 1, "", "")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, taken = spark.createDataFrame(data, SCHEMA).repartition(2), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), stage(spark, docs, str(tmp_path)).schema)
        taken[name] = docs.collect()
        if name != "packing":
            assert docs.columns == COLUMNS
    text = {r[0]: r[1] for r in data}
    kept = {r.doc_id for r in taken["quality_rules"]}
    measured = {i: plain_measures(t or "") for i, t in text.items()}
    assert kept == {i for i, m in measured.items() if m[0] >= 20 and 100 * m[4] <= 30 * m[0]}  # no line is common enough here
    rest = [(r.doc_id, r.text) for r in taken["quality_rules"]]
    assert all(text[i] == t for i, t in rest)
    import tests.llm.test_pairs as pairs

    three = pairs.shingle_set
    pairs.shingle_set = lambda t: three(t, 5)
    try:
        groups = brute(rest, 80)
    finally:
        pairs.shingle_set = three
    first = {i for i, (_, low) in groups.items() if i == low}
    assert {r.doc_id for r in taken["near_duplicates"]} == first
    assert {r.doc_id for r in taken["decontamination"]} == {i for i in first if item not in text[i]} and not first.isdisjoint(range(3000, 3003))
    for r in taken["secret_scan"]:
        assert bool(plain_spans(text[r.doc_id])) <= ("[secret]" in r.text) and not plain_spans(r.text) and r.n_chars == len(r.text)
    assert {r.doc_id for r in taken["packing"]} == {r.doc_id for r in taken["secret_scan"]} and any(r.doc_id == 3100 for r in taken["packing"])
    for r in taken["packing"]:
        assert r.length <= 2048


def test_run_on_the_smallest_data(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"] and out.count() > 50


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0


def test_nothing_else_imports_the_package():
    import pathlib

    top = pathlib.Path(corpus_pipeline.__file__).parent
    for file in [*top.glob("doctables/**/*.py"), *top.glob("fixtures/*.py"), *top.glob("tests/*.py"), *top.glob("tools/*.py"), top / "bench.py"]:
        if "llm" not in file.relative_to(top).parts:
            assert not re.search(r"doctables\.llm|corpus_pipeline", file.read_text()), file
    assert line_rules and secrets
