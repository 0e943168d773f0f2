"""The tournament against all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from doctables.llm import bisectors as B

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, components string, distance long"


def brute(data, k, rounds, width):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, *_ in data if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), np.array(v, "<i4").tobytes(), v) for i, v in kept if i is not None)
    centroids = [v for *_, v in order[:k]]
    apart = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    nearest = lambda v: min((apart(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    placed = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = sum(d for *_, d in placed)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, sum(e for _, n, e in placed if n == c), total, digest[c]) for i, c, d in placed), key=str)


def vectors(seed, n, width, levels):
    rng = random.Random(seed)
    out = [(i, [rng.choice(levels) for _ in range(width)], i % 3, 5, "x", 9) for i in range(n)]
    out += [(1000 + i, v, 0, 5, "x", 9) for i, v in enumerate([None, [], [0.0] * (width - 1), [0.0] * (width + 1), [None] + [0.0] * (width - 1), [math.nan] + [1.0] * (width - 1), [math.inf] + [1.0] * (width - 1), [-math.inf] * width])]
    out += [(None, [0.5] * width, None, None, None, None), (3, [levels[0]] * width, 1, 5, "x", 9), (3, [levels[0]] * width, 1, 5, "x", 9), (4, [-0.0] * width, 1, 5, "x", 9)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("width, k, levels", [(1, 3, [0.0, 0.5, 1.0]), (2, 5, [-0.4, 0.0, 0.3, 1 / 64]), (64, 16, [-1.0, -0.01, 0.0, 0.02, 0.7]), (4, 7, [-2e6, 1.5, 2e6])])
def test_clusters_are_those_of_all_distances(spark, width, k, levels):
    data = vectors(width, 90, width, levels)  # few levels: many ties
    got = B.clustered(spark.createDataFrame(data, SCHEMA).repartition(4), k=k, width=width).drop("centroid")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(data, k, 3, width)


def test_ties_favour_the_smaller_number_and_all_signs_are_exact():
    rng = np.random.default_rng(2)
    centroids = rng.integers(-3, 4, (9, 3))
    found = B.Bisectors(centroids.tolist())
    points = rng.integers(-4, 5, (3000, 3))
    apart = ((points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (found.nearest(points) == apart.argmin(axis=1)).all() and (found.distance(points, apart.argmin(axis=1)) == apart.min(axis=1)).all()
    far = B.Bisectors([[B.LARGEST - 1] * 64, [1 - B.LARGEST] * 64])
    assert far.nearest(np.array([[B.LARGEST - 1] * 64, [-1] * 64, [0] * 64])).tolist() == [0, 1, 0]


def test_few_vectors_empty_tables_and_vectors_beyond_a_long(spark):
    few = [(7, [1.0, 2.0]), (8, [1.0, 2.0]), (None, [4.0, 4.0])]
    got = B.clustered(spark.createDataFrame(few, "vec_id long, embedding array<double>"), width=2).drop("centroid")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(few, 16, 3, 2)
    for rows in ([], [(None, [4.0, 4.0])], [(1, None)]):
        assert B.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), width=2).count() == 0
    with pytest.raises(Exception, match="fit in a long"):
        B.clustered(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), width=1).count()
