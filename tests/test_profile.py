"""Scanline statistics against NumPy."""

import random

import numpy as np
import pytest

from doctables.operators import profile as P


def test_threshold_is_the_best_split(spark):
    rng = random.Random(1)
    pages = {p: [rng.choice([rng.randint(0, 90), rng.randint(120, 255)]) for _ in range(rng.randint(2, 200))] for p in range(20)}
    pages[99] = [7, 7, 7]
    rows = [(p, i, v) for p, vs in pages.items() for i, v in enumerate(vs)]
    pixels = spark.createDataFrame(rows, "page_id bigint, y int, v int")
    got = {r.page_id: r.threshold for r in P.otsu_threshold(pixels).collect()}
    for p, vs in pages.items():
        a = np.array(vs, float)
        best = (0.0, 0)
        for t in sorted(set(vs))[:-1]:
            low, high = a[a <= t], a[a > t]
            score = len(low) * len(high) * (low.mean() - high.mean()) ** 2
            if score > best[0] * (1 + 1e-12):
                best = (score, t)
        assert got[p] == best[1]
    binary = P.threshold_binarize(pixels, P.otsu_threshold(pixels)).collect()
    assert all(r.ink == (255 if r.v <= got[r.page_id] else 0) for r in binary) and len(binary) == len(rows)


@pytest.mark.parametrize("span", [2, 16, 4096])
def test_bands_are_runs(spark, span):
    rng = random.Random(span)
    ink = {(p, y): rng.choice([0, 5, 9, 9]) for p in range(10) for y in range(rng.randint(1, 120))}
    profile = spark.createDataFrame([(p, y, v) for (p, y), v in ink.items()] + [(77, 0, 0)], "page_id bigint, y int, ink bigint")
    want = []
    for p in range(10):
        ys = sorted(y for (q, y), v in ink.items() if q == p and v > 0)
        runs = [r for r in np.split(np.array(ys), np.where(np.diff(ys) > 1)[0] + 1) if len(r)]
        want += [(p, i, int(r[0]), int(r[-1])) for i, r in enumerate(runs)]
    bands = P.segment_bands(profile, part_rows=span)
    assert sorted(tuple(r) for r in bands.select("page_id", "band_no", "y_start", "y_end").collect()) == sorted(want)
    for exclusive in (False, True):
        cropped = P.crop_bands(profile, bands, exclusive_end=exclusive)
        inside = {(p, i, y) for p, i, a, b in want for y in range(a, b + (0 if exclusive else 1))}
        assert {(r.page_id, r.band_no, r.y) for r in cropped.collect()} == inside
        assert all(r.height == r.y_end - r.y_start + (0 if exclusive else 1) for r in P.band_heights(bands, exclusive).collect())


@pytest.mark.parametrize("part_rows", [4, 1 << 20])
def test_skew_is_the_exact_median(spark, part_rows):
    rng = random.Random(4)
    edges = {p: [rng.uniform(-0.5, 3.6) for _ in range(rng.randint(1, 30))] for p in range(20)}
    edges[3] = [1.5, 1.6]
    edges[4] = [1.5] * 7 + [1.9]
    table = spark.createDataFrame([(p, t) for p, ts in edges.items() for t in ts], "page_id bigint, theta double")
    pages = spark.createDataFrame([(p,) for p in range(21)], "page_id bigint")
    got = {r.page_id: r.angle for r in P.page_skew_angle(pages, table, part_rows=part_rows).collect()}
    assert got[20] == 0.0
    for p, ts in edges.items():
        assert got[p] == pytest.approx(np.median([t * 180 / np.pi - 90 for t in ts]), abs=1e-9)
