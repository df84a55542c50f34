"""The near_dedup stage against brute-force Jaccard."""

from __future__ import annotations

import random

import corpus_pipeline


def shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def stays(docs: list[tuple]) -> set:
    """The smallest doc_id of each group that pairs of Jaccard similarity of at least 0.8 connect."""
    sets, up = {d: shingles(t) for d, t in docs}, {d: d for d, _ in docs}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in sets:
        for b in sets:
            both, all_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and 10 * both >= 8 * all_:
                low, high = sorted((root(a), root(b)))
                up[high] = low
    return {d for d in up if root(d) == d}


def made() -> list[tuple]:
    """Chains of edited copies near the limit, one passage in many texts, a large group of near copies, short and blank texts."""
    draw = random.Random(7)
    word = lambda: f"w{draw.randrange(3000)}"
    out: list[str | None] = [None, "", "  ", "one two", "ONE  two", "one two three"]
    for _ in range(30):
        words = [word() for _ in range(draw.randrange(20, 300))]
        for _ in range(6):
            out.append(" ".join(words))
            words = list(words)
            for _ in range(draw.randrange(1, max(2, len(words) // 30))):
                words[draw.randrange(len(words))] = word()
    passage, base = [word() for _ in range(40)], [word() for _ in range(100)]
    out += [" ".join([*passage, *(word() for _ in range(draw.randrange(5, 60)))]) for _ in range(120)]
    for _ in range(150):
        words = list(base)
        for _ in range(draw.randrange(0, 4)):
            words[draw.randrange(100)] = word()
        out.append(" ".join(words))
    draw.shuffle(out)
    return list(enumerate(out))


def test_near_dedup_is_brute_force_jaccard(spark, sf_dir):
    docs = made()
    assert 100 < len(stays(docs)) < len(docs) - 200
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, df, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == stays(docs)


def test_near_dedup_of_documents(spark, sf_dir):
    df = corpus_pipeline.load(spark, sf_dir, "documents")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, sf_dir).collect()} == stays(docs)


def test_rows_are_told_apart_by_id_and_text(spark, sf_dir):
    """Other texts of an id stay, repeated rows and copies without an id go, other columns pass."""
    a, b, c = ("first text of six words here", "second text has six words too", "third text has no id at all")
    rows = [(1, a, "x", 1), (1, b, "x", 2), (1, b, "x", 3), (2, a, "x", 4), (None, a, "x", 5), (None, c, "x", 6), (None, c, "x", 7), (3, None, "x", 8), (4, "", "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string, th long")
    out = corpus_pipeline.near_dedup(spark, df, sf_dir)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) in (sorted([(1, a), (1, b), (0, c), (3, "")]),)


def test_pairs_beyond_the_radius_are_found(spark, sf_dir):
    """SimHash alone would lose pairs of similarity 0.8: here both ways are needed, and bits decide nothing."""
    from wayfold.llm import jaccard, simhash

    docs = made()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    fps = {r.doc_id: r.fp for r in simhash.fingerprints(df, 5).collect()}
    sets = {d: shingles(t) for d, t in docs}
    got = {r.doc_id: r.component for r in jaccard.near_duplicates(df).collect()}
    far = [(a, b) for a in sets for b in sets if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and (fps[a] ^ fps[b] & (1 << 64) - 1).bit_count() > jaccard.RADIUS]
    assert len(far) > 20 and all(got[a] == got[b] for a, b in far)


def test_blocks_and_parities_lose_nothing(spark):
    """Members of a bucket compared in small blocks give the pairs that all pairs by hand give."""
    import numpy as np
    from pyspark.sql import functions as F

    from wayfold.llm import jaccard

    docs = spark.createDataFrame([d for d in made() if d[1] and d[1].strip()], "doc_id long, text string")
    nodes = jaccard.signatures(docs).dropDuplicates(["key"]).cache()
    members = nodes.select(F.lit(1).cast("long").alias("h"), "key", "n", F.when(F.col("doc_id") % 3 == 0, F.lit(0)).otherwise(F.col("key")).cast("long").alias("root"))
    rows = {r.key: (r.n, 0 if r.doc_id % 3 == 0 else r.key, np.array(r.bits)) for r in nodes.collect()}
    expected = set()
    for a, (n, u, x) in rows.items():
        for b, (m, v, y) in rows.items():
            if a < b and u != v and 10 * min(n, m) >= 8 * max(n, m) and np.bitwise_count((x ^ y).view(np.uint64)).sum() <= n + m - 2 * -(-80 * (n + m) // 180):
                expected.add((a, b))
    for block in (100, 5000):
        assert {(r.a, r.b) for r in jaccard.compared(members, nodes, False, block=block).collect()} == expected
        best = {(r.a, r.b) for r in jaccard.compared(members, nodes, True, block=block).collect()}
        assert best <= expected and {k for p in best for k in p if rows[k][1]} == {k for p in expected for k in p if rows[k][1]}
