"""Geometry against plain loops on random pages, with blocks so small that every page has many of them."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctables.operators import anchors as A
from doctables.operators import blocks as B
from doctables.operators import columns as C
from doctables.operators import rows as R

WORDS = "doc_id bigint, page_no int, line_no int, ord bigint, text string, x double, y double"


def random_words(seed, pages=40, size=60, step=1.0, spread=400.0, low=-300.0):
    rng = random.Random(seed)
    rows = []
    for page in range(pages):
        dense = rng.choice([spread / 10, spread, spread * 10])
        for i in range(rng.randint(1, size)):
            y = round(rng.uniform(low, low + dense) / step) * step
            x = round(rng.uniform(low, low + dense) / step) * step
            rows.append((page // 3, page % 3 + 1, rng.randint(0, 2), i, rng.choice(["b", "a", "ä", "zz", "Z"]) + str(i % 7), x, y))
    rng.shuffle(rows)
    return rows


def loop_rows(rows, tol):
    """Row of each word by peeling rows off the top of each page."""
    out = {}
    for page in {r[:2] for r in rows}:
        left, row = [r for r in rows if r[:2] == page], 0
        while left:
            top = min(r[6] for r in left)
            out.update({(*page, r[3]): row for r in left if not r[6] - top > tol})
            left, row = [r for r in left if r[6] - top > tol], row + 1
    return out


@pytest.mark.parametrize("step,tol,part_rows", [(1.0, 15, 4), (0.25, 15, 9), (5.0, 15, 2), (0.1, 0.7, 16), (1.0, 15, 1 << 20), (0.1, 0.3, 5)])
def test_anchor_rows_equal_a_loop(spark, step, tol, part_rows):
    rows = random_words(seed=int(step * 100) + part_rows % 100, step=step)
    words = spark.createDataFrame(rows, WORDS)
    got = R.group_rows_by_anchor(words, tol=tol, part_rows=part_rows)
    assert {(r.doc_id, r.page_no, r.ord): r.row_no for r in got.collect()} == loop_rows(rows, tol)


def test_anchor_rows_without_any_gap_depend_on_the_whole_way_down(spark):
    """Evenly spaced words: rows start every 16 units, so a wrong entry into a block would shift all that follows."""
    rows = [(0, 1, 0, i, "w", 0.0, float(i)) for i in range(1500)]
    words = spark.createDataFrame(rows, WORDS)
    got = R.group_rows_by_anchor(words, tol=15, part_rows=40)
    assert {r.ord: r.row_no for r in got.collect()} == {i: i // 16 for i in range(1500)}


def test_exact_tolerance_stays_in_the_row(spark):
    words = spark.createDataFrame([(0, 1, 0, i, "w", 0.0, y) for i, y in enumerate([0.0, 15.0, 15.5, 30.5, 31.0])], WORDS)
    got = {r.ord: r.row_no for r in R.group_rows_by_anchor(words).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


def test_one_dense_line_is_cut_by_emission_order(spark):
    rows = [(0, 1, 0, i, "w", float(i), float(i % 3 * 20)) for i in range(300)]
    words = spark.createDataFrame(rows, WORDS)
    got = R.group_rows_by_anchor(words, part_rows=8)
    assert {r.ord: r.row_no for r in got.collect()} == {i: i % 3 for i in range(300)}
    assert B.parted(words, ["doc_id", "page_no"], ["y", "ord"], 8).rows.groupBy("_part").count().agg(F.max("count")).first()[0] == 8


def test_word_without_position_is_kept(spark):
    words = spark.createDataFrame([(0, 1, 0, 0, "a", 1.0, 5.0), (0, 1, 0, 1, "b", None, None)], WORDS)
    got = {r.text: r.row_no for r in R.group_rows_by_anchor(words).collect()}
    assert got == {"a": 0, "b": -1}


def test_no_words_no_rows(spark):
    assert R.group_rows_by_anchor(spark.createDataFrame([], WORDS)).count() == 0


@pytest.mark.parametrize("step,eps,part_rows", [(1.0, 10, 4), (0.5, 3, 2), (10.0, 100, 1 << 20), (1.0, 1, 8)])
def test_gap_clusters_equal_connected_components(spark, step, eps, part_rows):
    rows = random_words(seed=int(eps), step=step)
    words = spark.createDataFrame(rows, WORDS)
    got = C.cluster_columns_gap(words, eps=eps, part_rows=part_rows)
    want = {}
    for line in {r[:3] for r in rows}:
        inside = sorted((r for r in rows if r[:3] == line), key=lambda r: r[5])
        no = -1
        for before, r in zip([None, *inside], inside):
            no += before is None or r[5] - before[5] > eps
            want[(*line, r[3])] = no
    assert {(r.doc_id, r.page_no, r.line_no, r.ord): r.col_no for r in got.collect()} == want

    seen = C.order_clusters(got, column_order="first_seen")
    first = {}
    for key, no in want.items():
        first[(*key[:3], no)] = min(first.get((*key[:3], no), 1 << 60), key[3])
    ranks = {k: sorted(v for j, v in first.items() if j[:3] == k[:3]).index(first[k]) for k in first}
    assert {(r.doc_id, r.page_no, r.line_no, r.ord): r.col_no for r in seen.collect()} == {k: ranks[(*k[:3], n)] for k, n in want.items()}


def test_exact_eps_stays_in_the_cluster(spark):
    words = spark.createDataFrame([(0, 1, 0, i, "w", x, 0.0) for i, x in enumerate([0.0, 100.0, 200.0, 300.5])], WORDS)
    assert {r.ord: r.col_no for r in C.cluster_columns_gap(words).collect()} == {0: 0, 1: 0, 2: 0, 3: 1}


@pytest.mark.parametrize("part_rows", [3, 1 << 20])
def test_orders_equal_sorts(spark, part_rows):
    rows = random_words(seed=5, step=20.0)
    words = spark.createDataFrame(rows, WORDS)
    ranks = {(r.doc_id, r.page_no, r.ord): r.y_rank for r in R.sort_by_y(words, part_rows=part_rows).collect()}
    for page in {r[:2] for r in rows}:
        inside = sorted((r for r in rows if r[:2] == page), key=lambda r: (r[6], r[3]))
        assert [ranks[(*page, r[3])] for r in inside] == list(range(len(inside)))
    rowed = R.group_rows_by_anchor(words)
    row_of = loop_rows(rows, 15)
    for how, key in (("x", lambda r: (r[5], r[3])), ("text", lambda r: (r[4].encode(), r[5], r[3]))):
        cols = {(r.doc_id, r.page_no, r.ord): r.col_no for r in R.order_cells_in_row(rowed, cell_order=how, part_rows=part_rows).collect()}
        groups = {}
        for r in rows:
            groups.setdefault((*r[:2], row_of[(*r[:2], r[3])]), []).append(r)
        for group in groups.values():
            assert [cols[(*r[:2], r[3])] for r in sorted(group, key=key)] == list(range(len(group)))
    with pytest.raises(ValueError):
        R.order_cells_in_row(rowed, cell_order="z")


def test_fixed_boundaries(spark):
    words = spark.createDataFrame([(0, 1, 0, i, f"w{i}", x, 0.0) for i, x in enumerate([99.9, 100.0, 299.0, 300.0, 500.0, 699.0, 700.0])], WORDS)
    got = {r.ord: r.col_no for r in C.bin_columns_fixed(words, overflow="drop").collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 3}
    assert {r.ord: r.col_no for r in C.bin_columns_fixed(words).collect()} == {**got, 6: 3}
    halved = C.bin_columns_fixed(words, scale=0.5)
    assert {r.ord: r.col_no for r in halved.collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2}


def test_running_sum_over_parts(spark):
    rng = random.Random(3)
    rows = [(k, b, i, rng.randint(1, 9)) for k in range(3) for b in range(4) for i in range(5)]
    table = spark.createDataFrame(rows, "k int, b int, i int, n int")
    for part_rows in (3, 7, 100):
        for r in B.running_sum(table, ["k"], ["b", "i"], F.col("n"), "before", part_rows).collect():
            assert r.before == sum(n for k, b, i, n in rows if k == r.k and (b, i) < (r.b, r.i))


def test_parts_follow_the_order_and_depend_on_the_data_alone(spark):
    rows = [(0, i * 7919 % 5003, "x") for i in range(5003)] + [(1, i, "x") for i in range(9)]
    table = spark.createDataFrame(rows, "k int, at int, extra string")
    cut = B.parted(table.repartition(5), ["k"], ["at"], 200)
    assert [r.k for r in cut.large.collect()] == [0]
    got = sorted((r.k, r["at"], r._part) for r in cut.rows.collect())
    assert got == sorted((r.k, r["at"], r._part) for r in B.parted(table.repartition(2), ["k"], ["at"], 200).rows.collect())
    parts = [p for k, _, p in got if k == 0]
    assert parts == sorted(parts) and set(parts) == set(range(max(parts) + 1)) and 15 < max(parts) < 40
    assert max(parts.count(p) for p in set(parts)) < 500 and {p for k, _, p in got if k == 1} == {0}


def test_successors_and_moves_are_exact():
    rng = np.random.default_rng(5)
    for tol, step in ((15, 1.0), (0.3, 0.1), (0.7, 0.1), (1e-9, 1e-10), (15, 1e-3)):
        values = np.unique(rng.integers(0, 400, 200) * step)
        far = values[None, :] - values[:, None] > tol
        assert A.successors(values, tol).tolist() == [int(np.argmax(f)) if f.any() else len(values) for f in far]
        first, last, n = A.moves(values, tol)
        for above in [-np.inf, *(values[0] - tol * rng.random(30)), values[0]]:
            found = A.chain(values, above, tol)
            at = A.first_start(first, above, tol)
            assert (len(found), found[-1:].tolist()) == ((int(n[at]), [last[at]]) if at < len(first) else (0, []))


def test_a_dense_page_takes_time_in_proportion():
    """Twenty times the random values in far less than the square of twenty times the time."""
    rng, spent = np.random.default_rng(1), []
    for n in (100_000, 2_000_000):
        values = np.unique(rng.random(n) * 3000)
        start = time.perf_counter()
        A.chain(values, A.NONE_ABOVE, 15.0)
        A.moves(values, 15.0)
        spent.append(time.perf_counter() - start)
    assert spent[1] < 100 * max(spent[0], 0.005)


def test_block_sizes_are_powers_of_two():
    with pytest.raises(ValueError):
        B.int_block(F.lit(1), 1000)
