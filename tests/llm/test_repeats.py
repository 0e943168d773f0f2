"""Removed bytes against the definition; the transform's runs against sorted strings."""

import hashlib
import random

import numpy as np

from doctables.llm import repeats
from tests.llm.rows import SCHEMA, rows


def brute(data, length):
    first = {}
    for i, text, *_ in data:
        raw = (text or "").encode()
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, text, *_ in data:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < i:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1))
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_runs_of_equal_strings():
    rng = random.Random(4)
    for length in (2, 5, 9):
        segments = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(length, length + 6))) for _ in range(60)}) + [bytes([0, 255, 254, 1] * 3)]
        docs = np.array([rng.randrange(100) for _ in segments])
        want = {}
        for s, d in zip(segments, docs):
            for k in range(len(s) - length + 1):
                want[s[k : k + length]] = min(want.get(s[k : k + length], 999), d)
        got = repeats.smallest(segments, docs, length)
        for s, g in zip(segments, got):
            assert g.tolist() == [want[s[k : k + length]] for k in range(len(s) - length + 1)]


def test_removed(spark):
    rng = random.Random(5)
    data = [r for r in rows(8, 40)]
    passage = " ".join(rng.choice(["der", "weiße", "über", "x"]) for _ in range(60))
    data += [(2000 + k, "".join(rng.choice("xyzé ") for _ in range(rng.randint(0, 90))) + passage[rng.randint(0, 9) :] + str(k), "en", "s", 1, "", 1, 1, "", "") for k in range(25)]
    want = {n: brute(data, n) for n in (50, 9)}
    table = spark.createDataFrame(data, SCHEMA).repartition(3)
    for length, window, block, bucket, hot in ((50, 20, 1 << 21, 1 << 21, 64), (50, 20, 900, 500, 2), (9, 4, 700, 400, 3)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removed(table, length, window, block, bucket, hot).collect()}
        assert got == want[length]


def test_missing_ids_repeated_rows_empty_tables(spark):
    long = "abcdefghij " * 9
    some = [(None, long, *[None] * 8), (3, long, *[None] * 8), (3, long, *[None] * 8), (4, None, *[None] * 8), (5, "x" + long, *[None] * 8)]
    got = sorted((r.doc_id is None, r.doc_id, r.n_removed) for r in repeats.removed(spark.createDataFrame(some, SCHEMA)).collect())
    assert got == [(False, 3, 0), (False, 3, 0), (False, 4, 0), (False, 5, len(long)), (True, None, len(long))]
    assert repeats.removed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_send_to_few_buckets_and_frequent_windows_stay_whole(spark, monkeypatch):
    """What is told does not grow with blocks times buckets, and a window of many blocks with few segments is not cut into its strings."""
    phrase = "a phrase that very many texts have in common "
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    data = [(k, " ".join([word() for _ in range(12)] + [phrase] + [word() for _ in range(12)]), *[None] * 8) for k in range(300)]
    data += [(300 + k, data[k][1], *[None] * 8) for k in range(20)]
    pieces, answers = [], []

    def seen(table):
        kept = original(table)
        values = [x["value"] for row in kept.collect() for x in row[1]]
        pieces.append(len(values))
        answers.append(sum(len(repeats._unpack(v, "u1")[0]) for v in values))
        return kept

    original = repeats.stored
    monkeypatch.setattr(repeats, "stored", seen)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removed(spark.createDataFrame(data, SCHEMA).repartition(4), 50, 20, 1000, 100).collect()}
    assert got == brute(data, 50)
    # told to buckets; segments that are asked for, of eight bytes each (a cut window has up to 31 times as many)
    assert pieces[0] < 3000 and answers[1] // 8 < 3000, (pieces, answers)


def test_parts_of_a_bucket(spark):
    """A bucket is transformed in parts, and its answers are those of the whole."""
    rng = random.Random(7)
    pieces = []
    for block in range(3):
        keys = np.sort(np.array([rng.randrange(256) for _ in range(40)], np.uint8))
        text = [bytes([97 + k // 16, 97 + k % 16]) + bytes(rng.choice(b"XY") for _ in range(10)) for k in keys.tolist()]
        pieces.append(repeats._pack(np.frombuffer(b"".join(text), np.uint8), np.full(40, 12, "<u4"), np.array([rng.randrange(50) for _ in keys], "<i8"), keys))
    rows = {"block": [1, 2, 3], "segments": pieces}
    whole = [[x.tolist() for x in repeats._unpack(v, "u1", "<i8")] for v in repeats._answers(0, rows, 12, 1 << 20).column("value").to_pylist()]
    for at_once in (1, 100, 400):
        assert [[x.tolist() for x in repeats._unpack(v, "u1", "<i8")] for v in repeats._answers(0, rows, 12, at_once).column("value").to_pylist()] == whole
