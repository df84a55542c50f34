"""Operator 13 against plain Lloyd rounds in Python's integers, with ties, odd rows and negative components."""

from __future__ import annotations

import collections
import hashlib
import math

import numpy as np
import pytest

from wayfold.llm import sort_means


def brute(rows: list[tuple], k: int = 16, rounds: int = 3) -> collections.Counter:
    kept = [(i, tuple(math.floor(64 * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [list(v) for _, v in named[:k]]
    if not centroids:
        return collections.Counter()

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        for j, own in groups.items():
            centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    per = collections.Counter()
    for _, d, j in found:
        per[j] += d
    return collections.Counter((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'c' AS cluster", "'v' AS v", "1 AS label").repartition(4)


def odd_rows(n: int) -> list[tuple]:
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-3, 3, 64) / 64 * (1 + i % 5)).tolist()) for i in range(n)]
    rows += rows[:10] + [(None, rows[0][1]), (None, [0.5] * 64), (900, None), (901, [0.1] * 63), (902, [0.1] * 65), (903, [None] + [0.1] * 63), (904, [float("nan")] + [0.0] * 63), (905, [float("inf")] + [0.0] * 63), (906, []), (907, [-1e-9] * 64), (908, [2e6] * 64)]
    return rows


def test_against_brute_force(spark):
    rows = odd_rows(250)
    assert collections.Counter(map(tuple, sort_means.clustered(table(spark, rows)).collect())) == brute(rows)


def test_few_and_equal_vectors(spark):
    for rows in ([(1, [0.25] * 64)] * 3, [(5, [1.0] * 64), (2, [-1.0] * 64)], [(None, [1.0] * 64)], [(1, None)]):
        assert collections.Counter(map(tuple, sort_means.clustered(table(spark, rows)).collect())) == brute(rows)


def test_too_large_components_stop_the_job(spark):
    with pytest.raises(ValueError, match="64 bits"):
        sort_means.clustered(table(spark, [(1, [1e300] + [0.0] * 63), (2, [0.0] * 64)]))


def test_ties_go_to_the_smaller_number_and_the_scan_stops_early():
    rng = np.random.default_rng(8)
    centroids = rng.integers(-2, 3, (16, 8)).astype(np.int64)
    v = rng.integers(-2, 3, (5000, 8)).astype(np.int64)
    all_distances = ((v[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    for before in (np.zeros(5000, dtype=np.int64), rng.integers(0, 16, 5000), all_distances.argmin(axis=1)):
        nearest, least, _ = sort_means.assigned(v, before, centroids)
        assert (nearest == all_distances.argmin(axis=1)).all() and (least == all_distances.min(axis=1)).all()
    far = np.repeat(np.arange(16), 100)[:, None] * 1000 + rng.integers(0, 5, (1600, 8))
    means = far.reshape(16, 100, 8).sum(axis=1) // 100
    assert sort_means.assigned(far, np.repeat(np.arange(16), 100), means)[2] == 1600  # one distance each
