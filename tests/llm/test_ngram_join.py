"""Operator 11 against brute force on hard rows, on a chain of copies at the limit, and its filters one by one."""

from __future__ import annotations

import collections
import re

import numpy as np
import pytest

from wayfold.llm import ngram_join, queries
from wayfold.llm.common import load, slots_of, slotted
from wayfold.llm.jaccard import key_of


def shingles(text: str) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3)) if len(words) >= 4 else frozenset([tuple(words)] if words else [])


def brute(docs: list[tuple]) -> collections.Counter:
    sets = [shingles(t or "") for _, t in docs]
    root = list(range(len(docs)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs))


def words_of(rng: np.random.Generator, n: int) -> list[str]:
    return [f"W{x}" for x in rng.integers(0, 5000, n)]


@pytest.fixture(scope="module")
def limits() -> list[tuple]:
    """Chains of texts, each a few words off the one before (so that only the chain links its ends), pairs just at and just below the limit, and many texts around one passage."""
    rng = np.random.default_rng(7)
    docs: list[tuple] = []
    for _ in range(3):
        own = words_of(rng, 200)
        for _ in range(25):
            docs.append((len(docs), " ".join(own)))
            for at in rng.integers(0, len(own), 3):
                own[at] = words_of(rng, 1)[0]
    for drop in range(12, 24):  # of 100 shingles each, 100 - drop are shared when the tail of `drop` words differs
        own = words_of(rng, 103)
        docs.append((len(docs), " ".join(own)))
        docs.append((len(docs), "  ".join(own[: len(own) - drop // 2] + words_of(rng, drop // 2)).lower()))
    passage = words_of(rng, 80)
    for _ in range(60):
        docs.append((len(docs), " ".join(words_of(rng, 15) + passage + words_of(rng, 10))))
    docs += [(len(docs) + i, t) for i, t in enumerate([None, "", " \n", "a b c", "A  b\tC", "a b c d", "b c d a"])]
    return docs + [(None, docs[0][1]), (3, docs[3][1]), (None, "no id and alone here")]


def test_against_brute_force(spark, limits):
    df = spark.createDataFrame(limits, "doc_id long, text string").selectExpr("*", "'x' AS key", "1 AS n", "2 AS root", "3L AS h").repartition(5)
    got = collections.Counter(map(tuple, ngram_join.joined(df).collect()))
    assert got == brute(limits)


def test_hard_rows(spark, tmp_path):
    rows = [(0, None), (1, ""), (2, "one"), (3, "one"), (None, "one"), (4, "la nuit des longs mots 12 " * 4000), (5, "la nuit des longs mots 12 " * 3999), (6, "ÉA b c d"), (7, "éa b c d"), (8, " a b c d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert collections.Counter(map(tuple, queries.op11_ngram_join(spark, str(tmp_path)).collect())) == brute(rows)


def test_alike_sets_share_a_prefix_token_under_every_order():
    rng = np.random.default_rng(1)
    common = np.unique(rng.integers(-(1 << 62), 1 << 62, 40))
    powers = rng.integers(1, 12, len(common))
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.unique(np.concatenate([rng.integers(-(1 << 62), 1 << 62, n), rng.choice(common, min(n, 20))]))
        b = a[rng.random(len(a)) < 0.93]
        b = np.unique(np.concatenate([b, rng.integers(-(1 << 62), 1 << 62, int(0.05 * n))]))
        shared = len(np.intersect1d(a, b))
        if shared and 100 * shared >= 85 * (len(a) + len(b) - shared):
            for x, y in zip(ngram_join.prefixes_of(a, common, powers, 85), ngram_join.prefixes_of(b, common, powers, 85), strict=True):
                assert len(np.intersect1d(x, y))


def test_orders_differ():
    own = np.unique(np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 400))
    none = np.zeros(0, dtype=np.int64)
    a, b, c = (set(p.tolist()) for p in ngram_join.prefixes_of(own, none, none, 85))
    assert len(a) == len(b) == len(c) == 61 and len(a & b) < 25 and len(b & c) < 25


def test_slots_hold_all_values(spark):
    values = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 1000)
    bits = slots_of(spark.createDataFrame([(int(x),) for x in values], "x long"), "x")
    assert slotted(bits, values).all() and slotted(bits, values + 1).mean() < 0.01


def test_shingles_are_told_apart_by_order_and_number():
    texts = [b"a b c d", b"b a c d", b"a b c", b"a b", b"a", b"a a", b"a a a", b"a a a a", b"", b"ab c d e"]
    assert len({key_of(ngram_join.shingle_set(t, 4)) for t in texts}) == len(texts)


def test_shingles_of_long_texts_are_those_of_their_parts():
    rng = np.random.default_rng(6)
    words = [b"w%d" % x for x in rng.integers(0, 10**6, 60_000)] + [b"x" * 70_000, b"y" * 200_000] + [b"w%d" % x for x in rng.integers(0, 10**6, 300)]
    parts = [ngram_join.shingle_set(b" ".join(words[i : i + 4]), 4) for i in range(len(words) - 3)]
    assert (ngram_join.shingle_set(b" \n".join(words), 4) == np.unique(np.concatenate(parts))).all()


def test_whole_small_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in load(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert collections.Counter(map(tuple, queries.op11_ngram_join(spark, sf_dir).collect())) == brute(docs)


def test_forest_connects_what_all_pairs_connect():
    from wayfold.llm.jaccard import group_pairs, parities

    rng = np.random.default_rng(11)
    base = [np.unique(rng.integers(-(1 << 62), 1 << 62, 120)) for _ in range(3)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) < 0.95], rng.integers(-(1 << 62), 1 << 62, 4)])) for b in base for _ in range(40)]
    keys, sizes = np.arange(len(sets)), np.array([len(s) for s in sets])
    roots = np.where(rng.random(len(sets)) < 0.3, keys // 40 * 40, keys)
    bits = np.stack([parities(s) for s in sets]).view(np.uint64)

    def components(a, b):
        root = {int(k): int(r) for k, r in zip(keys, roots, strict=True)}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            old, new = root[x], root[y]
            root = {k: new if r == old else r for k, r in root.items()}
        return {frozenset(k for k in root if root[k] == r) for r in root.values()}

    forest, every = ngram_join.forest_pairs(keys, sizes, roots, bits, True, 85), group_pairs(keys, sizes, roots, bits, False, 85)
    assert components(*forest) == components(*every) and len(forest[0]) < len(set(roots.tolist())) < len(every[0])
