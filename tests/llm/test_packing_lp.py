"""The configuration linear program: whole cover, stated gap to the lower bound, and how little is left to the greedy end."""

from __future__ import annotations

import numpy as np
import pytest

from wayfold.llm import packing


def histogram(kind: str) -> np.ndarray:
    r = np.random.default_rng(3)
    need = np.zeros(2049, dtype=np.int64)
    if kind == "prose":
        for n in np.clip(r.lognormal(6, 1, 20_000), 1, 2048).astype(int):
            need[n] += 1
    elif kind == "awkward":  # volume is no bound here: pieces of over half the capacity, and thirds that just do not fit
        need[[1100, 700, 690, 1024, 5]] = 500, 900, 333, 77, 40
    elif kind == "one":
        need[2048] = 12
    elif kind == "small":
        need[[3, 1000, 1048]] = 1, 2, 1
    return need


@pytest.mark.parametrize("kind", ["prose", "awkward", "one", "small", "none"])
@pytest.mark.parametrize("times", [1, 1000])
def test_cover_gap_and_rest(kind, times):
    need = histogram(kind) * times
    cover, bound = packing.fractional(need, 2048)
    covered = np.zeros(2049)
    for lengths, n, use in cover:
        assert use > 0 and lengths @ n <= 2048
        covered[lengths] += use * n
    assert np.allclose(covered, need)
    size = sum(u for _, _, u in cover)
    assert bound - 1e-6 <= size <= (1 + packing.GAP) * bound + 1e-9
    whole, told = packing.solve(need)
    held = np.zeros(2049, dtype=np.int64)
    for lengths, n in whole:
        assert lengths.sum() <= 2048
        np.add.at(held, lengths, n)
    assert (held == need).all()
    assert told["rest"] <= (0.001 if times > 1 else 0.06) or need.sum() < 20
    assert sum(n for _, n in whole) <= np.ceil(size) + 0.01 * size + 1


def test_the_bound_holds_for_every_packing():
    """Against the best packing of small cases, found by trying all."""
    r = np.random.default_rng(1)

    def least(pieces, rooms=()):
        if not pieces:
            return len(rooms)
        k, rest = pieces[0], pieces[1:]
        return min([least(rest, (*rooms[:i], room - k, *rooms[i + 1 :])) for i, room in enumerate(rooms) if room >= k and room not in rooms[:i]] + [least(rest, (*rooms, 20 - k))])

    for _ in range(20):
        pieces = sorted(r.integers(1, 21, 7).tolist(), reverse=True)
        need = np.bincount(pieces, minlength=21)
        best = least(pieces)
        assert packing.fractional(need, 20)[1] <= best + 1e-9
        assert sum(n for _, n in packing.solve(need, 20)[0]) <= best + 1
