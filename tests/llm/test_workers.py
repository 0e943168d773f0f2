"""What Python workers keep, and how many of them a task needs."""

import zlib

import numpy as np

from doctables.llm import common, packing
from doctables.llm.tokens import tokenizer_path


def test_span_hashes_need_no_table_of_all_places():
    data = np.random.default_rng(5).integers(0, 256, 10_001).astype(np.uint8)
    for n in (0, 1, 4095, 4096, 4097, 8192, len(data)):
        start = np.arange(n)
        end = np.minimum(start + 20, n)
        value, terms = [], [int(common.BYTES[b]) * pow(common.ODD, i, 1 << 64) for i, b in enumerate(data[:n].tolist())]
        for a, b in zip(start[::500].tolist(), end[::500].tolist()):
            value.append((sum(terms[a:b]) * pow(common.INVERSE, a, 1 << 64) + (b - a) * 0x9E3779B97F4A7C15) % (1 << 64))
        hasher = common.SpanHasher(data[:n])
        assert hasher(start, end)[::500].tolist() == common.mixed(np.array(value, np.uint64)).tolist()
        if n > 20:
            assert hasher.every(20).tolist() == hasher(start[: n - 19], start[: n - 19] + 20).tolist()
    held = [x for x in vars(common).values() if isinstance(x, np.ndarray)]
    assert not hasattr(common, "_powers") and sum(x.nbytes for x in held) < 1 << 20


def test_pieces_are_cut_and_summed_by_one_python_step(spark):
    docs = spark.createDataFrame([(i, "some words and more of them " * i) for i in range(40)], "doc_id long, text string")
    got = packing.piece_digests(packing.packed(docs, tokenizer_path("word_bpe_49k.json"), size=64))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    pieces = packing.packed(docs, tokenizer_path("word_bpe_49k.json"), size=64).collect()
    want = {(p.doc_id, p.start): zlib.crc32(np.frombuffer(p.ids, "<u2").astype("<u4").tobytes()) for p in pieces}
    assert {(p.doc_id, p.start): p.ids_crc32 for p in got.collect()} == want and len(want) == len(pieces) > 40
