"""Operator 12 against brute force on small corpora, and its suffix arrays against counting."""

from __future__ import annotations

import collections
import re

import numpy as np
from pyspark.sql import functions as F

from wayfold.llm import collocations


def brute(docs: list[tuple], least: int, held: int = 80, top: int = 2000) -> collections.Counter:
    counts: dict = collections.defaultdict(collections.Counter)
    totals: collections.Counter = collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    counts[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            score, _, le, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= held * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items())
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), le, r))
        for k, (s, a, p, le, r) in enumerate(sorted(rows)[:top]):
            out.append((lang, k + 1, p.decode(), -a, le, r, totals[lang], -s))
    return collections.Counter(out)


def corpus(seed: int, n: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    fixed = ["New York City hall", "in the end of", "ça va bien,", "one\ttwo  three"]
    rows = []
    for _ in range(n):
        words = [f"w{int(x)}" for x in rng.zipf(1.6, 30) % 40]
        for at in rng.integers(0, 30, 4):
            words[at] = fixed[int(rng.integers(0, 4))]
        marks = rng.choice([" ", " ", " ", " ", ". ", ",", "\n", "\x0b", "\x1c ", " "], len(words))
        rows.append(([None, "und", "en", "fr"][int(rng.integers(0, 4))], "".join(w + m for w, m in zip(words, marks, strict=True))))
    return [*rows, ("en", None), ("en", ""), ("xx", " . , "), (None, "!!"), ("de", "allein"), *rows[:5]]


def test_against_brute_force(spark):
    docs = corpus(5, 300)
    df = spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "1 AS f", "'a' AS phrase", "2 AS c").repartition(6)
    for least, top in ((5, 2000), (2, 50)):
        assert collections.Counter(map(tuple, collocations.top_phrases(df, least=least, top=top).collect())) == brute(docs, least, top=top)


def test_long_text_is_cut_where_pieces_end(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 10)
    text = b"aa bb cc dd ee. ff gg; hh ii jj kk ll mm nn oo pp. q"
    assert b"\n".join(collocations.slices(text)) == text.translate(collocations.TABLE)


def test_intervals_count_all_phrases():
    rng = np.random.default_rng(9)
    for most in (2, 3, 4):
        seq = np.concatenate([rng.integers(0, 6, 3000), np.zeros(4, dtype=np.int64)])
        want = collections.Counter(tuple(seq[i : i + m].tolist()) for m in range(2, most + 1) for i in range(3000) if (seq[i : i + m] > 0).all())
        got = {tuple(seq[i : i + m].tolist()): c for m, at, counts in collocations.intervals(seq, most) for i, c in zip(at.tolist(), counts.tolist(), strict=True)}
        assert got == dict(want)


def test_hash_is_that_of_spark(spark):
    words = ["a", "été", "x y", "漢字"]
    df = spark.createDataFrame([("en\n" + w,) for w in words], "k string")
    assert [r[0] for r in df.select(F.xxhash64("k")).collect()] == collocations.hashed("en", [w.encode() for w in words]).tolist()


def test_keys_come_apart(spark):
    keys = [("en", "a b"), ("", "x"), ("odd\nlang", "y"), ("fr", "")]
    df = spark.createDataFrame([(f"{lang}\n{p}",) for lang, p in keys], "k string")
    assert [tuple(r) for r in df.select(*collocations.parts_of(F.col("k"))).collect()] == keys


def test_products_beyond_64_bits(spark):
    a = 10**13
    row = spark.range(1).selectExpr(f"(CAST({a}L AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(7,0))) DIV CAST({2 * a + 1}L AS DECIMAL(20,0)) AS score").first()
    assert row.score == 2000000 * a // (2 * a + 1)
