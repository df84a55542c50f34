"""Components by stars: against union-find, and the queries that the driver plans and keeps for them."""

from __future__ import annotations

import random

import corpus_pipeline

from wayfold.llm import simhash
from wayfold.llm.common import load


def least_of(pairs: list[tuple[int, int]]) -> dict[int, int]:
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        low, high = sorted((root(a), root(b)))
        up[high] = low
    return {x: root(x) for x in up if root(x) != x}


def planned(spark, f):
    """What f gives, and the queries that ran meanwhile; the driver keeps the plans of the last 1,000."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = store.executionsCount()
    out = f()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, store.executionsCount() - before


def got(roots) -> dict[int, int]:
    rows = roots.collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.root for r in rows}


def test_components_of_chains_stars_and_loops(spark):
    draw = random.Random(3)
    names = [draw.randrange(-(1 << 62), 1 << 62) for _ in range(400)]
    pairs = [(names[i], names[i + 1]) for i in range(150)] + [(names[200], names[i]) for i in range(201, 260)] + [(names[draw.randrange(260, 400)], names[draw.randrange(260, 400)]) for _ in range(110)] + [(7, 7), (names[0], names[1])]
    cut = len(pairs) // 2
    edges = lambda own: spark.createDataFrame(own, "a long, b long")
    assert got(simhash.components(edges(pairs))) == least_of(pairs)
    roots = simhash.components(edges(pairs[:cut]))
    assert got(simhash.connected(roots, edges(pairs[cut:]))) == least_of(pairs)
    assert got(simhash.connected(roots, edges([]))) == least_of(pairs[:cut])
    assert got(simhash.components(edges([]))) == {}


def test_edges_that_are_stars_take_no_step(spark):
    pairs = [(i, i % 5) for i in range(5, 100)]
    roots, n = planned(spark, lambda: simhash.components(spark.createDataFrame(pairs, "a long, b long")))
    assert got(roots) == dict(pairs)
    assert n <= 2


def test_near_dedup_plans_few_queries(spark, sf_dir):
    """The driver's memory holds the plan of each query with those of its adaptive steps."""
    docs = load(spark, sf_dir, "documents")
    _, n = planned(spark, lambda: corpus_pipeline.near_dedup(spark, docs, sf_dir).count())
    assert n <= 42, n
