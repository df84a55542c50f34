"""Redaction of spans that overlap."""

from __future__ import annotations

from wayfold.llm import pii


def test_the_union_of_overlapping_spans_goes(spark):
    texts = {1: "call +49 30 123456-bob@x.org now", 2: "+49 30 123456-bob@x.org", 3: "mail a.b@example.org or +49 30 123456 please", 4: "nothing here"}
    assert {k for k, _, _ in pii.base_spans(texts[1])} == {"email", "phone"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert got == {1: "call <phone> now", 2: "<phone>", 3: "mail <email> or <phone> please", 4: "nothing here"}
