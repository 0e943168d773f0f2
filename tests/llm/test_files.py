"""Wavelet shards and packing against the ids they hold."""

import zlib

import numpy as np

from doctables.llm import packing, wavelet
from doctables.llm.tokens import Encoder, tokenizer_path
from tests.llm.rows import SCHEMA, rows

BYTE, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_shard_answers_as_the_ids_do():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (7, 2), (5000, 37), (300_000, 900)):
        ids = (rng.pareto(1.0, n) % top).astype(np.uint16) * 3
        shard = wavelet.Shard(wavelet.pack_shard(ids, [4, None], np.array([n - 1, 1])))
        assert (shard.tokens() == ids).all() and shard.doc_ids == [4, None] and shard.starts.tolist() == [0, n - 1, n]
        for i in {0, n // 3, n - 1}:
            token = int(ids[i])
            places = np.flatnonzero(ids == token)
            assert shard.access(i) == token and shard.count(token) == len(places) and shard.rank(token, i) == (places < i).sum()
            assert [shard.select(token, k) for k in {0, len(places) // 2, len(places) - 1}] == [places[k] for k in {0, len(places) // 2, len(places) - 1}]
        assert shard.count(1) == 0 and shard.document(1).tolist() == [ids[-1]]


def test_wavelet_files(spark):
    data, encode = rows(5), Encoder(BYTE).whole
    files = wavelet.wavelet_files(spark.createDataFrame(data, SCHEMA).repartition(5), BYTE, shard_tokens=200)
    assert files.count() > 3
    got, start = {r.doc_id: r for r in wavelet.digests(files).collect()}, 0
    for i, text, *_ in sorted(data, key=lambda r: r[0]):
        ids = [*encode(text or ""), 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc(ids)), text
        start += len(ids)


def test_histogram_fills_every_pack():
    rng = np.random.default_rng(2)
    for size, n in ((8, 30), (64, 1000), (2048, 4000)):
        lengths = np.minimum(rng.lognormal(np.log(size / 3), 0.8, n).astype(int) + 1, size - 1)
        counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
        placed, packs = packing.pack_histogram(counts, size)
        held = {}
        for length, first, end, start, tokens, pack, offset in placed:
            for rank in range(first, end):
                held.setdefault((length, rank), []).append((start, tokens))
        for (length, _), parts in held.items():
            parts.sort()
            assert [a for a, _ in parts] == np.cumsum([0] + [t for _, t in parts]).tolist()[:-1] and sum(t for _, t in parts) == length
        assert len(held) == n and packs == -(-int(lengths.sum()) // size)
    assert packing.pack_histogram({}, 8) == ([], 0)


def test_packed(spark):
    data, encode = rows(6), Encoder(WORDS).whole
    for size, together in ((32, 5), (2048, 1000)):
        pieces = packing.packed(spark.createDataFrame(data, SCHEMA).repartition(4), WORDS, size=size, together=together)
        rows_ = pieces.collect()
        by_doc, by_sequence = {}, {}
        for r in rows_:
            by_doc.setdefault(r.doc_id, []).append(r)
            by_sequence.setdefault(r.sequence_id, []).append(r)
        for i, text, *_ in data:
            ids, own = [*encode(text or ""), 1], sorted(by_doc[i], key=lambda r: r.start)
            assert b"".join(r.ids for r in own) == np.array(ids, "<u2").tobytes() and {r.doc_tokens for r in own} == {len(ids)}
            assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own]).tolist()[:-1]
        used = 0
        for own in by_sequence.values():
            own.sort(key=lambda r: r.offset)
            assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own]).tolist()[:-1]
            used += sum(r.length for r in own)
            assert sum(r.length for r in own) <= size
        assert len(by_sequence) * size - used < size
        assert {(r.doc_id, r.start, r.ids_crc32) for r in packing.piece_digests(pieces).collect()} == {(r.doc_id, r.start, crc(np.frombuffer(r.ids, "<u2"))) for r in rows_}
