"""Boilerplate lines are counted by distinct documents of a host."""

from __future__ import annotations

from wayfold.llm import quality


def own(i: int) -> str:
    return " ".join(f"word{i}x{k}" for k in range(12))


def removed(spark, rows):
    docs = spark.createDataFrame([(i, t, "web", len(t)) for i, t in rows], "doc_id long, text string, source string, n_chars long")
    return {r.doc_id: r.text for r in quality.cleaned(docs).collect()}


def test_all_lines_of_a_banner_go(spark):
    """The middle line of a shared passage always has the same neighbours."""
    banner = "First line of a banner\nMiddle line of a banner\nLast line of a banner"
    got = removed(spark, [(i, f"{own(i)}\n{banner}\n{own(i + 1000)}") for i in range(60)])
    assert got == {i: f"{own(i)}\n{own(i + 1000)}" for i in range(60)}


def test_copies_do_not_shield_a_line(spark):
    """Copies of one document that hold a line count once: it goes for its other documents."""
    line = "Subscribe to our newsletter"
    rows = [(i, f"{own(i)}\n{line}\n{own(i + 1000)}") for i in range(100)] + [(200 + i, f"{own(5000)}\n{line}\n{own(6000)}") for i in range(40)]
    assert not any(line in t for t in removed(spark, rows).values())


def test_copies_do_not_raise_the_limit_nor_lose_lines(spark):
    """25 of 26 distinct documents hold the line, whatever the number of copies; the copies keep their own lines."""
    line = "Subscribe to our newsletter"
    rows = [(i, f"{own(i)}\n{line}\n{own(i + 1000)}") for i in range(25)] + [(100 + i, f"{own(7000)}\n{own(8000)}") for i in range(2600)]
    got = removed(spark, rows)
    assert not any(line in t for t in got.values())
    assert all(got[100 + i] == f"{own(7000)}\n{own(8000)}" for i in range(2600))


def test_rows_without_an_id_are_cleaned_too(spark):
    line = "Subscribe to our newsletter"
    docs = spark.createDataFrame([(None, f"{own(i)}\n{line}", None, 1, "x", "y") for i in range(60)], "doc_id long, text string, source string, n_chars long, host string, removed string")
    got = quality.cleaned(docs)
    assert got.columns == docs.columns
    assert sorted(r.text for r in got.collect()) == sorted(own(i) for i in range(60))
