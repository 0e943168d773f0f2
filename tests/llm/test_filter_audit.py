"""The audit against every order walked document by document; the matrix against plain counts."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np

from doctables.llm import filter_audit as A
from tests.llm.rows import SCHEMA, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int, part string, same string"


def brute(data, labels):
    texts = [r[1] or "" for r in data]
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    least = {}
    for r, t in zip(data, texts):
        if r[0] is not None:
            least[t] = min(least.get(t, r[0]), r[0])
    fails = []
    for r, t in zip(data, texts):
        w = WORD.findall(t)
        checks = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t), r[0] is not None and r[0] > least[t])
        fails.append({f for f, c in zip("ABCDE", checks) if c})
    out = {}
    for part in {r[3] or "" for r in data}:
        mine = [(f, r[0]) for f, r in zip(fails, data) if (r[3] or "") == part]
        share = Counter()
        for order in permutations("ABCDE"):
            left, gone = list(mine), []
            for step, f in enumerate(order, 1):
                hit, left = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                share[f] += len(hit)
                out[part, "".join(order), step] = [len(left), len(hit), sum(f in x[0] for x in gone), sum(x[0] == {f} for x in mine), sum(x[1] in good for x in hit), sum(x[1] in toxic for x in hit)]
                gone += hit
        for (p, order, step), row in out.items():
            if p == part:
                row.append(share[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def some_rows(seed):
    rng = random.Random(seed)
    data = rows(seed, 60)
    data += [(500 + i, rng.choice(data)[1], "en", rng.choice(["s0", "s1", "", None]), 1, "x", 7, 7, "x", "h") for i in range(60)]
    data += [(600 + i, " ".join(rng.choices(["Ab", "AB", "cd", "e#", "fgh", "ij", "kl"] + [f"w{k}" for k in range(90)], k=rng.randint(40, 160))), "en", "s0", 1, "x", 7, 7, "x", "h") for i in range(60)]
    data += [(None, data[-1][1], *data[-1][2:]), (None, "a b", *data[-1][2:]), (610, data[-1][1], *data[-1][2:]), data[-1], data[-1], (610, "other", *data[-1][2:])]
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1]), "p", "s") for r in data if rng.random() < 0.5]
    return data, labels + [labels[0], (99999, 1, 1, "p", "s"), (None, 1, 1, "p", "s"), (labels[1][0], 1, 1, "p", "s")]


def test_all_orders_and_steps(spark):
    data, labels = some_rows(4)
    for most in (A.SHARD_BYTES, 300):  # small shards cut long texts
        got = A.audit(spark.createDataFrame(data, SCHEMA).repartition(5), spark.createDataFrame(labels, LABELS), most)
        assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()} == brute(data, labels)


def test_the_matrix_holds_every_count_under_global_numbers(spark):
    data, _ = some_rows(6)
    matrix, words = A.shards(spark.createDataFrame(data, SCHEMA).repartition(3), 500)
    name = {r.id: bytes(r.word).decode() for r in words.collect()}
    texts = [r[1] or "" for r in data]
    assert sorted(name.values()) == sorted({w for t in texts for w in WORD.findall(t)})
    found = {}
    for shard in matrix.collect():
        starts, columns, counts = A.csr(shard.asDict())
        for row, a, b in zip(shard.docs, starts, starts[1:]):
            assert (np.diff(columns[a:b]) > 0).all()
            of = found.setdefault(row.row, [bytes(row.same), Counter()])
            of[1].update({name[int(c)]: int(n) for c, n in zip(columns[a:b], counts[a:b])})
    assert sorted(sorted(c.items()) for _, c in found.values()) == sorted(sorted(Counter(WORD.findall(t)).items()) for t in texts)
    stats = A.row_statistics(matrix).collect()
    assert len(stats) == len(data) and all((s.n_words, s.n_distinct) == (sum(found[s.row][1].values()), len(found[s.row][1])) for s in stats)


def test_a_text_above_a_slice_is_spread_over_shards(spark):
    text = " ".join(f"w{i % 70_000}" for i in range(2_000_000)) + " " + "x" * 300_000 + "É|"
    table = spark.createDataFrame([(1, text, "s"), (2, "a", "s")], "doc_id long, text string, source string")
    matrix, _ = A.shards(table)
    assert matrix.filter("cut").count() > 2
    long = [r for r in A.row_statistics(matrix).collect() if r.doc_id == 1]
    assert [(r.chars, r.n_words, r.n_distinct, r.symbol) for r in long] == [(len(text), 2_000_001, 70_001, True)]


def test_numbers_are_packed_and_read_back():
    for values in ([], [0], [5, 0, 255, 256, 1 << 31], [1 << 40, 3]):
        assert A.unpacked(A.packed(np.array(values, np.int64))).tolist() == values


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    got = A.audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"] and got.count() == 0
    one = A.audit(spark.createDataFrame([(1, None, None, None, None, None, 1, 1, None, None)], SCHEMA), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and all(r.removed == (r.filter_order[r.step - 1] == "A") for r in one)
