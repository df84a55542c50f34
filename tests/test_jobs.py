"""The match job over runs, bounded candidates, stored results, the maintained index, sitemaps as a source, clusters by radius."""

from __future__ import annotations

import collections
import datetime
import math
import random
import re
import shutil

from pyspark.sql import functions as F

from wayfold.functions import vocab
from wayfold.operators import cascade, curation, match_jobs, postings, spatial
from wayfold.operators.matching import token_index
from wayfold.sources import files
from wayfold.sources.cache import ResultCache, files_fingerprint

LOTS = [("a", "김제시립도서관 주차장", "전북 김제시 요촌동", 35.8, 126.88), ("b", "스타필드 시티 위례 주차장", "경기 하남시 위례대로", 37.5, 127.1), ("c", "위례 공영주차장", "경기 성남시", 37.6, 127.2), ("d", None, None, None, None)]


def lots(spark):
    return spark.createDataFrame(LOTS, "id string, name string, address string, lat double, lng double")


def every_pair(spark, texts, places, most):
    """Candidates by comparing every text with every place."""
    words = F.filter(F.transform("words", F.lower), lambda w: F.length(w) >= 2)
    usable = texts.filter("id IS NOT NULL").select(F.col("id").alias("text"), words.alias("w")).filter("size(w) > 0").crossJoin(places.filter(F.length(F.regexp_replace("name", r"\s", "")) >= 2))
    rows = usable.select("text", "id", cascade.candidate_score(F.col("w"), F.col("name"), F.col("address")).alias("s")).filter("s > 0").collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.text].append((-r.s, r.id))
    return {(t, lot, -s, k + 1) for t, own in by.items() for k, (s, lot) in enumerate(sorted(own)[:most])}


def test_candidates_of_hot_districts_equal_a_full_comparison(spark):
    """A district that nearly all places lie in, words that are in many names or addresses or both, repeated words, ties."""
    rng = random.Random(3)
    names, towns = ["도서관", "스타필드", "박물관", "시장", "위례"], ["서울", "강남구", "위례동", "김제시", "양구군"]
    places = [(f"p{i:03}", " ".join(rng.sample(names, rng.randint(1, 2))) + " 주차장", " ".join([towns[0], *rng.sample(towns[1:], rng.randint(0, 2))])) for i in range(120)]
    texts = [(i, [rng.choice([*names, *towns, "없는말"]) for _ in range(rng.randint(1, 4))]) for i in range(60)] + [(60, ["서울"]), (61, ["서울", "서울"]), (62, ["서울", "강남구"]), (None, ["서울"]), (63, ["서울"])]
    t, p = spark.createDataFrame(texts, "id int, words array<string>"), spark.createDataFrame(places, "id string, name string, address string")
    got = {(r.id, r.lot, r.score, r.place) for r in cascade.candidate_places(t, "id", "words", p).collect()}
    assert got == every_pair(spark, t, p, 5)
    asked = t.filter("id >= 60").select(F.col("id").alias("_id"), F.col("words").alias("_words"))
    few = cascade.by_address(asked, p, 5).collect()
    assert len(few) <= 5 * 4 and {r.lot for r in few if r["_id"] == 60} == {f"p{i:03}" for i in range(5)}


def test_each_text_is_placed_once(spark):
    rows = [
        (1, "김제시립도서관 주차장 후기", "김제 요촌동 김제시립도서관 주차", "김제시립도서관 " * 40), (2, "하남시 별마루 후기", "별마루 앞 주차", "짧은 글"), (3, "공영주차장", "", ""), (4, "별마루 가는 길 후기", "멀리", ""), (5, None, None, None),
        (1, "김제시립도서관 주차장 후기", "김제 요촌동 김제시립도서관 주차", "김제시립도서관 " * 40), (None, "하남시 별마루", "", ""),
    ]
    texts = spark.createDataFrame(rows, "text_id int, title string, content string, text string")
    near, far = (37.5001, 127.1001), (36.0, 127.0)
    found = [(2, 1, "별마루 주차장", "주차장", "경기 하남시", *near), (4, 2, "다른 곳 주차장", "주차장", "부산", *near), (4, 3, "별마루 주차장", "주차장", "부산", *far), (2, 9, "식당", "음식점", "경기", *far)]
    results = spark.createDataFrame(found, "text_id int, id int, name string, category string, address string, lat double, lng double")
    got = {r.text_id: (r.stage, r.lot) for r in match_jobs.placed_texts(texts, "text_id", "title", "content", "text", lots(spark), results).collect()}
    assert got == {1: ("name", "a"), 2: ("coordinates", "b"), 3: ("noise", None), 4: ("missed", None), 5: ("noise", None)}


RAW = "id long, source string, source_id string, source_url string, title string, content string, author string, published_at string, sentiment_score double, keywords string, filter_passed int, filter_tier string"
VERDICT = "id long, lot string, filter_passed boolean, sentiment_score double, keywords string"


def raw(spark, rows):
    return spark.createDataFrame([(i, "blog", str(i), "u", t, c, None, None, 2.0, "[]", p, tier) for i, t, c, p, tier in rows], RAW)


def links(spark, out):
    return {(r.raw_source_id, r.parking_lot_id, r.sentiment_score) for r in match_jobs.stored_links(spark, out).collect()}


def test_match_job_runs_again_without_adding_and_goes_on_after_verdicts(spark, tmp_path):
    rows = [(1, "김제시립도서관 <b>주차장</b> 후기", "김제시립도서관 주차 편했다 요촌동", 1, "high"), (2, "스타필드 시티 위례 주차장", "위례대로 스타필드 시티 위례 주차", 1, "medium"), (3, "위례 공영주차장", "위례 주차 성남시", 0, "high"), (4, "12 3", "", 1, "high")]
    stop, out, none = ["후기"], str(tmp_path / "job"), spark.createDataFrame([], VERDICT)
    match_jobs.run_match_job(raw(spark, rows), lots(spark), none, out, 0, stop, "2002-01-01")
    assert {x[:2] for x in links(spark, out)} == {(1, "a")} and {r.id for r in spark.read.parquet(f"{out}/done/batch=0").collect()} == {1}
    assert "b" in {r.lot for r in spark.read.parquet(f"{out}/open/batch=0").collect()}
    match_jobs.run_match_job(raw(spark, rows), lots(spark), none, out, 1, stop, "2002-01-01")
    assert {x[:2] for x in links(spark, out)} == {(1, "a")} and spark.read.parquet(f"{out}/links/batch=1").count() == 0
    asked = [(r.id, r.lot) for r in spark.read.parquet(f"{out}/open/batch=1").collect()]
    given = spark.createDataFrame([(i, lot, lot == "b", 4.5, '["x"]') for i, lot in asked], VERDICT)
    match_jobs.run_match_job(raw(spark, rows), lots(spark), given, out, 2, stop, "2002-01-01")
    assert links(spark, out) == {(1, "a", 2.0), (2, "b", 4.5)}
    assert {r.id for r in spark.read.option("basePath", f"{out}/done").parquet(f"{out}/done/batch=*").collect()} == {1, 2}
    # a run that broke off before its texts were marked done finds and writes the same again
    shutil.rmtree(f"{out}/done/batch=2")
    match_jobs.run_match_job(raw(spark, rows), lots(spark), given, out, 2, stop, "2002-01-01")
    assert links(spark, out) == {(1, "a", 2.0), (2, "b", 4.5)}


def test_stored_results_follow_the_files_and_age(spark, tmp_path):
    path, now, made = str(tmp_path / "t.parquet"), [0.0], []
    cache = ResultCache(100, lambda: now[0])

    def result():
        df = spark.read.parquet(path)
        return cache.get(spark, "n", files_fingerprint(df), lambda: made.append(1) or df.agg(F.count("*").alias("n"))).first().n

    spark.range(5).coalesce(1).write.parquet(path)
    assert (result(), result(), len(made)) == (5, 5, 1)
    one = next(p for p in (tmp_path / "t.parquet").iterdir() if p.suffix == ".parquet")
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "u.parquet"))
    other = next(p for p in (tmp_path / "u.parquet").iterdir() if p.suffix == ".parquet")
    for crc in (tmp_path / "t.parquet").glob(".*.crc"):
        crc.unlink()
    shutil.copyfile(other, one)  # the same name, other rows
    assert (result(), len(made)) == (7, 2)
    now[0] = 100.0
    assert (result(), result(), len(made)) == (7, 7, 3)


def test_index_follows_random_changes(spark, tmp_path):
    rng, path, now = random.Random(2), str(tmp_path / "index"), {}
    kind = "id string, seq int, op string, name string, address string"

    def check(at):
        got = sorted(map(tuple, postings.current_postings(spark, at).collect()))
        assert got == sorted(map(tuple, token_index(spark.createDataFrame([(k, *v) for k, v in now.items()], "id string, name string, address string")).collect()))

    for segment in range(4):
        rows = [(rng.choice("abcdefgh"), s, rng.choice(["insert", "update", "update", "delete"]), " ".join(rng.choices(["X", "y", "주차장", "z"], k=2)), rng.choice(["서울 y", None])) for s in range(12)] + [(None, 99, "insert", "q", "q")]
        for k, _, op, *v in rows[:-1]:
            now.pop(k, None) if op == "delete" else now.update({k: v})
        for _ in range(2):  # the same batch again changes nothing
            postings.apply_changes(spark.createDataFrame(rows, kind), path, segment)
        check(path)
    postings.compacted(spark, path, f"{path}2", 4)
    check(f"{path}2")
    now.pop(next(iter(now)), None)
    gone = set("abcdefgh") - now.keys()
    postings.apply_changes(spark.createDataFrame([(k, 1, "delete", None, None) for k in gone], kind), f"{path}2", 5)
    check(f"{path}2")


def test_sitemaps_read_back(spark, tmp_path):
    rows = [(f"k{i:02}&x", datetime.datetime(2002, 1, 1 + i)) for i in range(7)]
    pages = files.numbered_pages(spark.createDataFrame(rows, "id string, modified timestamp").withColumn("id", F.replace("id", F.lit("&"), F.lit("&amp;"))), "id", 3)
    files.write_sitemaps(pages, "https://e.org/", str(tmp_path))
    got = files.expanded_sitemap(spark, f"{tmp_path}/index", lambda loc: f"{tmp_path}/pages/page={loc.rsplit('/', 1)[1].removesuffix('.xml')}")
    assert sorted((r.loc, str(r.lastmod)) for r in got.collect()) == [(f"https://e.org/{k}", str(d.date())) for k, d in rows] and got.select("file").distinct().count() == 3
    (tmp_path / "odd.xml").write_text("<urlset><url><loc> https://e.org/a </loc></url><url><lastmod>2002-01-01</lastmod></url><url><loc>https://e.org/b</loc><lastmod>soon</lastmod></url></urlset>")
    assert sorted((r.loc, r.lastmod) for r in files.sitemap_entries(spark, f"{tmp_path}/odd.xml").collect()) == [("https://e.org/a", None), ("https://e.org/b", None)]
    (tmp_path / "none.xml").write_text("<sitemapindex></sitemapindex>")
    assert files.expanded_sitemap(spark, f"{tmp_path}/none.xml", str).count() == 0


def serial_tree(points, zooms, turns, pixels=200.0):
    """The greedy pass, one point after another."""
    rows = {k: (turns[k], (lng + 180) / 360, (1 - math.log(math.tan(math.radians(lat)) + 1 / math.cos(math.radians(lat))) / math.pi) / 2, 1) for k, lat, lng in points}
    out, parents = {}, {}
    for zoom in sorted(zooms, reverse=True):
        r, centres = pixels / (512 * 2**zoom), {}
        for k in sorted(rows, key=lambda k: rows[k][0]):
            _, x, y, _ = rows[k]
            c = next((c for c in centres if (x - rows[c][1]) ** 2 + (y - rows[c][2]) ** 2 <= r * r), k)
            centres.setdefault(c, []).append(k)
        for c, own in centres.items():
            for k in own:
                parents[zoom, k] = c
        rows = {c: (rows[c][0], sum(rows[k][1] * rows[k][3] for k in own) / sum(rows[k][3] for k in own), sum(rows[k][2] * rows[k][3] for k in own) / sum(rows[k][3] for k in own), sum(rows[k][3] for k in own)) for c, own in centres.items()}
        out[zoom] = {c: v[3] for c, v in rows.items()}
    return out, parents


def test_clusters_equal_a_serial_pass(spark):
    rng = random.Random(5)
    points = [(f"p{i}", 36 + rng.gauss(0, 0.05), 127 + rng.gauss(0, 0.05)) for i in range(150)] + [(f"q{i}", 36.0, 127.0) for i in range(20)]
    df = spark.createDataFrame([(*p, 3.0) for p in points] + [("none", None, None, 1.0)], "id string, lat double, lng double, avg_score double")
    turns = {r.id: r.t for r in df.select("id", F.xxhash64("id").alias("t")).collect()}
    zooms = [6, 9, 12]
    tree = spatial.cluster_tree(df, zooms)
    rows = tree.collect()
    want, parents = serial_tree(points, zooms, turns)
    assert {z: {r.id: r.points for r in rows if r.zoom == z} for z in zooms} == want
    above = {12: 9, 9: 6}
    assert all(r.parent == parents[above[r.zoom], r.id] for r in rows if r.zoom in above) and all(r.parent is None for r in rows if r.zoom == 6)
    expansion = {(r.zoom, r.id): r.expansion for r in spatial.expansion_zooms(tree).collect()}
    for r in rows:
        own = [c for c in rows if c.zoom == 9 and c.parent == r.id] if r.zoom == 6 else [c for c in rows if c.zoom == 12 and c.parent == r.id]
        if r.zoom < 12:
            assert expansion[r.zoom, r.id] == ({6: 9, 9: 12}[r.zoom] if len(own) > 1 else expansion[own[0].zoom, own[0].id])
        else:
            assert expansion[r.zoom, r.id] == 13
    assert spatial.clusters_in(tree, 12, 0, 0, 180, 80).count() == len(want[12])


def test_small_operators(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError, match="source must be one of"):
        curation.allowed("elsewhere", curation.SOURCES, "source")
    rows = spark.createDataFrame([("a", 1), ("b|c", None)], "field string, n int")
    assert curation.markdown(rows, "Report", ["field", "n"], ["field"]).splitlines()[2:6] == ["| field | n |", "|---|---|", "| a | 1 |", "| b\\|c |  |"]
    assert vocab.PROVINCES[0] == curation.CITIES[0]


def many_alike(spark):
    """240 places of 12 names and addresses, dealt so that ids of a kind lie apart; one name that no other word begins."""
    names, towns = ["한빛도서관 주차장", "별빛 시장", "달빛스타필드", "한빛 시장"], ["서울 강남구", "김제시", "양구군"]
    rows = [(f"p{i:03}", names[i % 4], towns[i // 4 % 3]) for i in range(240)] + [("q", "큰별마루", "부산"), ("r", None, None)]
    return rows, spark.createDataFrame(rows, "id string, name string, address string")


def seen_by(monkeypatch, module, name, at):
    """How many places each call of a function is given."""
    seen, f = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a: (seen.append(a[at].count()), f(*a))[1])
    return seen


def test_search_sees_equal_places_once_and_finds_all_that_rank(spark, monkeypatch):
    rows, places = many_alike(spark)
    texts = [(1, ["한빛", "시장"]), (2, ["강남구"]), (3, ["별마루"]), (4, ["빛"]), (5, ["도서관", "스타필드"]), (6, ["없는말"]), (7, ["시장", "한빛"]), (8, ["큰별마루", "별마루"])]
    want = set()
    for text, words in texts:
        tokens = lambda r: [w for w in re.split(r"[^\w]+", f"{r[1] or ''} {r[2] or ''}".lower()) if len(w) >= 2]
        hits = {r[0]: sum(any(w.startswith(k) for w in tokens(r)) for k in words if len(k) >= 2) for r in rows}
        own = [lot for _, lot in sorted((-n, lot) for lot, n in hits.items() if n)][:20]
        if len(own) < 3:
            held = [(min(k for k, w in enumerate(words[:3]) if w in r[1]), r[0]) for r in rows if r[1] and r[0] not in own and any(len(w) >= 2 and w in r[1] for w in words[:3])]
            own = (own + [lot for _, lot in sorted(held)])[:20]
        want |= {(text, lot, k + 1) for k, lot in enumerate(own)}
    seen = seen_by(monkeypatch, match_jobs, "prefix_index", 0)
    got = {(r.id, r.lot, r["rank"]) for r in match_jobs.searched(spark.createDataFrame(texts, "id int, words array<string>"), "id", "words", places).collect()}
    assert got == want and max(collections.Counter(t for t, *_ in got).values()) == 20
    assert seen == [14]


def test_candidates_of_equal_places_equal_a_full_comparison(spark, monkeypatch):
    _, places = many_alike(spark)
    texts = spark.createDataFrame([(1, ["한빛", "시장"]), (2, ["강남구"]), (3, ["별마루"]), (4, ["달빛스타필드", "김제시"])], "id int, words array<string>")
    seen = seen_by(monkeypatch, cascade, "word_places", 2)
    got = {(r.id, r.lot, r.score, r.place) for r in cascade.candidate_places(texts, "id", "words", places).collect()}
    assert got == every_pair(spark, texts, places, 5)
    assert set(seen) == {13}


def test_equal_texts_and_places_are_held_against_each_other_once(spark, monkeypatch):
    _, places = many_alike(spark)
    rows = [(i, "한빛도서관 주차장", "서울 강남구 한빛도서관 주차", 1, "high" if i % 2 else "low") for i in range(30)]
    held, f = [], match_jobs.stored
    monkeypatch.setattr(match_jobs, "stored", lambda df, name: (out := f(df, name), held.append((name, out.count())))[0])
    pairs = match_jobs.decided_pairs(raw(spark, rows), places, spark.createDataFrame([], VERDICT), []).collect()
    assert len(pairs) == 30 * 20 and {r.lot for r in pairs if r.id == 0} == {f"p{i:03}" for i in range(0, 240, 12)}
    assert {(r.id % 2, r.decision) for r in pairs} == {(0, "open"), (1, "rule")}
    assert dict(held)["different-texts"] == 1 and dict(held)["held"] == 1


def test_a_repeated_key_gets_the_best_place_of_its_texts(spark):
    rows = [(1, "김제시립도서관 주차장 후기", "김제 요촌동 김제시립도서관 주차", ""), (1, "위례 주차", "", ""), (2, "김제시립도서관 주차장 후기", "김제 요촌동 김제시립도서관 주차", ""), (None, "김제시립도서관 주차장", "", "")]
    got = cascade.best_places(spark.createDataFrame(rows, "id int, title string, content string, text string"), "id", "title", "content", "text", lots(spark)).collect()
    assert sorted((r.id, r.lot) for r in got) == [(1, "a"), (2, "a")]


def test_nearest_places_equal_a_full_comparison_and_meet_few(spark, monkeypatch):
    """Places at equal points, a dense town, lone ones at the edge of the square, equal distances, none near, no coordinates."""
    rng = random.Random(5)
    town = lambda: (round(37 + rng.random() / 50, 4), round(127 + rng.random() / 50, 4))
    left = [(f"l{i:03}", *town()) for i in range(120)] + [(f"s{i:03}", 36.0, 127.0) for i in range(150)] + [("e", 35.0, 127.0), ("f", 60.0, 128.0), ("g", 20.0, 100.0), ("h", None, 127.0), ("t", 34.0, 127.0)]
    right = [(f"r{i:03}", *town()) for i in range(120)] + [(f"z{i:03}", 36.001, 127.001) for i in range(150)] + [("x", 35.15, 127.19), ("y", 35.0, 127.21), ("n", 60.19, 128.0), ("m", 60.0, 128.2), ("u", 34.0, 127.1), ("v", 34.0, 126.9), ("w", None, None)]

    def metres(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return round(2 * 6_371_000 * math.asin(min(1, math.sqrt(h))), 6)

    want = {}
    for a in left:
        near = [(metres(a, b), b[0]) for b in right if None not in (*a, *b) and abs(a[1] - b[1]) <= 0.2 and abs(a[2] - b[2]) <= 0.2]
        if near:
            want[a[0]] = min(near)
    pairs, f = [], spatial._gridded
    monkeypatch.setattr(spatial, "_gridded", lambda *a: (out := f(*a), pairs.append(out.count()))[0])
    schema = "id string, lat double, lng double"
    got = {r.left_id: (round(r.metres, 6), r.right_id) for r in spatial.nearest(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 0.2).collect()}
    assert got == want and got["s000"][1] == "z000" and got["e"][1] == "x" and got["f"][1] == "m" and "g" not in got and "h" not in got
    assert sum(pairs) < 6000  # of 36,900 in cells of 0.2 degrees


def test_equal_texts_are_placed_by_one_lookup(spark, monkeypatch):
    rows = [(i, "김제시립도서관 주차장 후기", "김제 요촌동 김제시립도서관 주차", "김제시립도서관 " * 40) for i in range(40)] + [(40, "스타필드 시티 위례 주차장", "위례대로 스타필드 시티 위례 주차", "")]
    seen = seen_by(monkeypatch, cascade, "candidate_places", 0)
    got = cascade.best_places(spark.createDataFrame(rows, "id int, title string, content string, text string"), "id", "title", "content", "text", lots(spark)).collect()
    assert sorted((r.id, r.lot) for r in got) == [*((i, "a") for i in range(40)), (40, "b")]
    assert seen == [2]
