"""Parts of shingle sets: two alike sets always share one, unlike sets hardly ever."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from wayfold.llm import ngram_join, shingles


def tokens(rng: np.random.Generator, n: int) -> np.ndarray:
    return rng.integers(-(1 << 63), (1 << 63) - 1, n)


def alike(rng: np.random.Generator, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Two sets around the limit: of one size or of sizes as far apart as may be, with their differences spread or close together."""
    a = np.unique(tokens(rng, n))
    most = shingles.most_apart(len(a), least)
    gone = int(rng.integers(0, most // 2 + 1)) if rng.random() < 0.7 else 0
    at = int(rng.integers(0, len(a) - gone + 1))
    b = np.delete(a, np.arange(at, at + gone)) if rng.random() < 0.5 else rng.permutation(a)[gone:]
    return a, np.unique(np.concatenate([b, tokens(rng, int(rng.integers(0, most + 1)))]))


@pytest.mark.parametrize("least", [80, 85])
@pytest.mark.parametrize("prefix", [shingles.lowest, ngram_join.prefix_of])
def test_alike_sets_share_a_part(least, prefix):
    rng, met = np.random.default_rng(least), 0
    sizes = [*range(1, 140), *range(200, 1100, 7), *(2**k + d for k in range(4, 11) for d in (-1, 0, 1))]
    for n in sizes * 4:
        a, b = alike(rng, n, least)
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= least * (len(a) + len(b) - shared) and len(a) + len(b) > 2 * shared:
            assert len(np.intersect1d(shingles.parts_of(a, least, prefix), shingles.parts_of(b, least, prefix))), (len(a), len(b), shared)
            met += 1
    assert met > 500


def test_sets_of_few_parts_share_their_prefix():
    """All hashes in two narrow ranges: no set has the parts it needs, yet alike ones meet."""
    rng = np.random.default_rng(5)
    for n in (20, 60, 300):
        a = np.unique(np.concatenate([rng.integers(0, 1 << 30, n), rng.integers(1 << 62, (1 << 62) + (1 << 30), n)]))
        b = np.unique(np.concatenate([a[: len(a) - 2], [a[0] + 1, a[-1] + 1]]))
        shared = len(np.intersect1d(a, b))
        assert 100 * shared >= 85 * (len(a) + len(b) - shared)
        assert len(np.intersect1d(shingles.parts_of(a, 85), shingles.parts_of(b, 85)))


def test_one_shared_token_fills_no_bucket():
    """Sets that share a token each by chance shared prefix tokens; they share no part of two hashes."""
    rng = np.random.default_rng(9)
    common = tokens(rng, 40)
    sets = [np.unique(np.concatenate([tokens(rng, 400), rng.choice(common, 12, replace=False)])) for _ in range(60)]
    parts = [shingles.parts_of(s, 85) for s in sets]
    prefixes = [shingles.lowest(s, 85) for s in sets]
    pairs = list(itertools.combinations(range(60), 2))
    by_prefix = sum(bool(len(np.intersect1d(prefixes[i], prefixes[j]))) for i, j in pairs)
    assert by_prefix > 300 and sum(bool(len(np.intersect1d(parts[i], parts[j]))) for i, j in pairs) < 20


def test_buckets_hold_only_what_is_alike(spark):
    """Texts that share single shingles everywhere leave no bucket; those of one long passage with few other words do."""
    rng = np.random.default_rng(4)
    lines = [" ".join(f"c{i}_{k}" for k in range(4)) for i in range(30)]
    rows = [(i, " ".join(x for j in rng.permutation(30)[:12] for x in (lines[j], *(f"w{t}" for t in rng.integers(0, 10**9, 30))))) for i in range(80)]
    passage = " ".join(f"p{t}" for t in range(300))
    rows += [(100 + i, f"{passage} end{i}") for i in range(5)]
    members = ngram_join.in_shared_parts(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    keys = {ngram_join.key_of(ngram_join.shingle_set(t.encode(), 4)): d for d, t in rows}
    held = {keys[r.key] for r in members.select("key").distinct().collect()}
    assert held >= {100, 101, 102, 103, 104} and len(held) < 25
