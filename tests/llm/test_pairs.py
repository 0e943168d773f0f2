"""Near duplicates against all pairs, on texts whose similarities lie around the threshold."""

import random
import re

import numpy as np

from doctables.llm import graph, hamming
from tests.llm.rows import SCHEMA, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, words=3):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute(data, percent=85):
    sets = [shingle_set(r[1]) for r in data]
    up = list(range(len(data)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                up[top(i)] = top(j)
    low = {}
    for i, r in enumerate(data):
        low[top(i)] = min(low.get(top(i), r[0]), r[0])
    return {r[0]: (len(sets[i]), low[top(i)]) for i, r in enumerate(data)}


def chains(seed, bases=12, members=14):
    """Groups around the threshold: each member changes some words of the base or of the member before it."""
    rng, out = random.Random(seed), []
    for b in range(bases):
        text = [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(members):
            text = list(text)
            for _ in range(rng.randint(0, 4) * len(text) // 90 + rng.randint(0, 1)):
                text[rng.randrange(len(text))] = f"z{rng.randrange(9999)}"
            out.append(" ".join(text).replace("a1", "A1") + rng.choice(["", "\n", " "]))
    return out


def test_components_are_those_of_all_pairs(spark):
    data = rows(7, 20)
    data += [(1000 + k, t, "en", "s", 1, "", 1, 1, "", "") for k, t in enumerate(chains(1))]
    want = brute(data)
    for block in (256, 3):
        got = {r.doc_id: r for r in hamming.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(4), block=block).collect()}
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (i == want[i][1]) for i, r in got.items())


def test_groups_stay_whole_whatever_joins_spark_picks(spark):
    """Sort-merge joins whose large partitions Spark would split: the members of a group are still compared with each other."""
    data = [(k, t, "en", "s", 1, "", 1, 1, "", "") for k, t in enumerate(chains(4, 4, 30))]
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        got = {r.doc_id: r.component_id for r in hamming.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()}
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert got == {i: low for i, (_, low) in brute(data).items()}


def test_pigeonhole_keys_meet_within_the_distance():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (400, hamming.POSITIONS)).astype(np.uint16)
    b = a.copy()
    for k in range(len(a)):
        at = rng.permutation(hamming.POSITIONS)[: hamming.DISTANCE]
        b[k, at] += 1
    assert (hamming.keys_of(a) == hamming.keys_of(b)).any(axis=1).all()


def test_signatures_of_large_unrelated_sets_differ():
    rng = np.random.default_rng(4)
    for n in (50, 20_000, 400_000):
        sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2)]
        a, b = hamming.signature(np.concatenate(sets), np.array([0, n, 2 * n]))
        assert (a != b).sum() > 50


def test_only_far_members_are_dealt_to_many_blocks(spark):
    members = spark.createDataFrame([(g, i, g == 2 and i % 100 == 0) for g in (1, 2) for i in range(1000)], "g long, row long, far boolean")
    dealt = graph.in_blocks(members, "g", "row", 50).collect()
    assert {r.g for r in dealt} == {2} and len(dealt) == 1000 + 10 * 20
    met = {}
    for r in dealt:
        met.setdefault((r.i, r.j), ([], []))[r.asks].append(r.row)
    pairs = {(a, b) for answers, asks in met.values() for a in asks for b in answers}
    assert pairs == {(a, b) for a in range(0, 1000, 100) for b in range(1000)}


def test_missing_ids_repeated_rows_empty_tables(spark):
    some = [(None, "a b c d", *[None] * 8)] * 2 + [(3, "a b c d", *[None] * 8)] * 2 + [(4, None, *[None] * 8), (5, " ", *[None] * 8), (None, "x", *[None] * 8)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in hamming.near_duplicates(spark.createDataFrame(some, SCHEMA)).collect()), key=str)
    assert got == [(3, 2, 3, True), (3, 2, 3, True), (4, 0, 4, True), (5, 0, 5, True), (None, 1, None, True), (None, 2, None, True), (None, 2, None, True)]
    assert hamming.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, 500 + i) for i in range(1, 30)] + [(7, 9), (9, 8), (8, 7)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 100 for i in range(100, 141)}, **{500 + i: 500 for i in range(30)}, 7: 7, 8: 7, 9: 7}
