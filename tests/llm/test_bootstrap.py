"""Bootstrapped personal data: planted identifiers that no expression finds, with measured recall and precision."""

from __future__ import annotations

import random

import pytest

from wayfold.llm import pii


def planted(n: int = 400) -> list[tuple[int, str, list[str], list[str]]]:
    """doc_id, text, the identifiers that only their context gives away, and look-alikes that must stay."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(r.randint(5, 40)))
    out = []
    for i in range(n):
        hidden, alike = [], []
        local, host = word() + str(i), word()
        mail = f"{local}@{host}.example"
        odd = f"{local} [at] {host}.example"
        phone, bare = f"+49 30 {r.randint(100000, 999999)}", f"030 {r.randint(100000, 999999)}"
        turn = i % 5
        lines = [prose()]
        if turn in (0, 1):
            lines += [f"please write to {mail} for all questions", f"call me under {phone} after noon"]
        elif turn == 2:
            lines += [f"please write to {odd} for all questions"]
            hidden += [odd]
        elif turn == 3:
            lines += [f"call me under {bare} after noon", f"the fax line is {bare} they say"]
            hidden += [bare]
        else:
            lines += [f"they sold {r.randint(1000000, 9999999)} pieces in a year", f"see chapter {r.randint(1, 9)} of {r.randint(100000, 999999)} for more"]
            alike += [lines[-2].split()[2], lines[-1].split()[4]]
            lines += ["the bus to town left after noon", "it is up to us for all questions"]
        lines.append(prose())
        out.append((i, " ".join(lines), hidden, alike))
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = planted()
    return rows, spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")


def test_unseen_identifiers_are_found(spark, table):
    rows, docs = table
    spans = {r.doc_id: {(s.start, s.end) for s in r.spans} - {(s.start, s.end) for s in r.base} for r in pii.found_spans(docs).collect()}
    hidden = met = wrong = added = 0
    for i, text, own, alike in rows:
        added += len(spans[i])
        for h in own:
            hidden += 1
            met += any(text[a:b] == h for a, b in spans[i])
        wrong += sum(text[a:b] in alike for a, b in spans[i])
    assert hidden == 160 and met >= 0.9 * hidden
    assert added and wrong == 0 and met >= 0.9 * sum(len(set(own)) for _, _, own, _ in rows)


def test_a_second_round_reaches_further(spark):
    """Numbers known from one context only lead to a new context, and from there to others."""
    rows = [(i, f"call me under +49 30 55{i:04d} after noon") for i in range(40)]
    rows += [(100 + i, f"call me under 030 77{i:04d} after noon") for i in range(40)]
    rows += [(200 + i, f"unser anschluss lautet 030 77{i:04d} seit langem") for i in range(40)]
    rows += [(300 + i, f"unser anschluss lautet 0351 88{i:04d} seit langem") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.found_spans(docs).collect()}
    assert all(got[i] == ["phone"] for i, _ in rows)


def test_plain_words_speak_against_a_pattern(spark):
    rows = [(i, f"wir fahren nach +49 30 55{i:04d} am abend") for i in range(20)] + [(100 + i, f"wir fahren nach {w} am abend") for i, w in enumerate(["hause", "paris", "rom"] * 20)]
    rows += [(200, "wir fahren nach 030 1234567 am abend")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = pii.mentions(docs).cache()
    assert pii.discovered(docs, marked).count() == 0
    few = docs.filter("doc_id < 100 OR doc_id = 200")
    assert pii.discovered(few, pii.mentions(few)).count() == 1
    able = marked.selectExpr("explode(found) AS m").selectExpr("explode(m.patterns) AS pattern").distinct()
    assert sorted(map(tuple, pii.plain_counts(docs, able, 7).collect())) == sorted(map(tuple, pii.plain_counts(docs, able).collect()))  # in blocks


def test_letters_that_lower_to_two_do_not_shift_places():
    text = "\u0130\u0130\u0130\u0130 write to someone@mail.example about the \u0130stanbul office today"
    start = text.index("someone")
    spans = [("email", start, start + len("someone@mail.example"))]
    own, plain = (pii.plain_places(t, spans, pii.Tokens()).tolist() for t in (text, text.replace("\u0130", "i")))
    assert own == plain != pii.plain_places(text, [], pii.Tokens()).tolist()


def test_redaction_of_discovered_ones(spark, table):
    rows, docs = table
    one, other = ({r.doc_id: r.text for r in pii.redacted(docs, sent).collect()} for sent in (pii.SENT, 0))
    assert one == other
    hidden = [(i, h) for i, _, own, _ in rows for h in own]
    assert sum(h not in one[i] for i, h in hidden) >= 0.9 * len(hidden)


def test_secrets(spark):
    rows = [(1, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ok'), (2, "x" * 50), (3, None), (4, "1" * 40)]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.found_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [("secret", 9, 49)], 2: [], 3: [], 4: []}
