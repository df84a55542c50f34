"""Operator 2: personal data by patterns, and by bootstrapped contextual extraction.

Base spans are what fixed expressions find: e-mail addresses, IP addresses, card and telephone numbers. They and secrets
(long random-looking words) are the seed entities. The tokens around a seed (two before; one before and one after; two
after; words and marks alike, digits made equal) are lexical patterns. Candidates are all other stretches that look like
an identifier of some kind: numbers, anything with an at sign or a spelt-out one, words with letters and digits.

Spark scores the graph of patterns and entities in rounds, until no entity is added: a pattern of a kind is as good as
the share of what it surrounds that is known to be of that kind, against entities of other kinds, candidates that can't
be of the kind, and plain words in the same place, which a second pass over the texts counts; candidates that may be of
the kind say nothing yet. A candidate is as good as its patterns make it together. Good candidates join the entities,
which may raise further patterns. Their spans are added, with their kind; base spans always stay.

Null and empty texts have no spans, an empty table gives no rows. Repeated rows each give a row. Offsets count code
points. Other columns do not matter; redacted() passes them on as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import chunks, folded, unfolded, written

KINDS = ("email", "ip", "card", "phone")
#: The kinds that spans may have, in their order.
ALL_KINDS = (*KINDS, "secret")
#: Entities of a kind that a pattern needs; what patterns and candidates must score.
SUPPORT, GOOD_PATTERN, GOOD_ENTITY = 4, 0.8, 0.95
#: Characters beside a span in which its neighbouring tokens are sought.
BESIDE = 120
#: Patterns that one pass over the texts looks for, and entities that redaction sends along, at most (8 bytes each).
SENT = 500_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Words that may be secrets: so long, and of letters and digits.
SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{32,256}+(?![A-Za-z0-9_+/=-])")
#: Stretches that look like an identifier: digits with marks between, anything around an at sign, spelt-out at signs, words with digits.
LOOKS = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ().-]{0,2}[0-9]){5,}(?![0-9A-Za-z])|[^\s@]{1,64}@[^\s@]{1,255}|[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9.-]{1,255}|(?<![\w.:-])(?=[\w.:-]{0,255}[0-9])[A-Za-z0-9_]+(?:[.:-]+[A-Za-z0-9_]+)*")
AT = re.compile(r"@|[\[(](?:at|AT)[\])]")
TOKEN = re.compile(r"\w+|[^\w\s]")
DIGITS = re.compile(r"\d")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, at sign and dotted domain, found from the at signs in one pass."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base spans by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def secrets(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Long words of many different letters and digits that no base span touches."""
    out = [("secret", m.start(), m.end()) for m in SECRET.finditer(text) if len(set(m[0])) >= 10 and 5 <= sum(c.isdigit() for c in m[0]) <= len(m[0]) - 5]
    return apart(out, base) if out else out


def apart(spans: list[tuple[str, int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Ascending spans that touch none of the others."""
    out, i = [], 0
    others, top = sorted((a, b) for _, a, b in taken), []
    for _, b in others:
        top.append(max(b, top[-1] if top else 0))
    for kind, a, b in spans:
        while i < len(others) and others[i][0] < b:
            i += 1
        if not i or top[i - 1] <= a:
            out.append((kind, a, b))
    return out


def possible_kinds(found: str) -> list[str]:
    """The kinds that a stretch may be of."""
    digits, letters = len(DIGITS.findall(found)), any(c.isalpha() for c in found)
    if AT.search(found):
        return ["email"]
    out = []
    if found.count(".") == 3 and digits <= 12 and not letters or found.count(":") >= 2 and re.fullmatch(r"[0-9A-Fa-f:.]+", found):
        out.append("ip")
    if not letters and 12 <= digits <= 19:
        out.append("card")
    if not letters and 6 <= digits <= 15:
        out.append("phone")
    if letters and digits and len(found) >= 8 and " " not in found:
        out.append("secret")
    return out


def candidates(text: str, known: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifier-like stretches that no known span touches; their kind is open."""
    if not (DIGIT.search(text) or AT.search(text)):
        return []
    found = []
    for m in LOOKS.finditer(text):
        a, b = m.start(), m.end()
        if "@" in m[0]:  # marks around an address are none of it
            while a < b and not (text[a].isalnum()):
                a += 1
            while b > a and not (text[b - 1].isalnum()):
                b -= 1
        if b > a:
            found.append(("", a, b))
    return apart(found, known)


class Tokens(dict):
    """Hashes of tokens, kept; the lowest bit is set for plain words (letters only)."""

    def __missing__(self, token: str) -> int:
        if len(self) > 60_000:
            self.clear()
        h = xxhash.xxh64_intdigest(DIGITS.sub("0", token)) if len(token) < 64 else 0
        h = self[token] = h | 1 if token.isalpha() else h & ~1
        return h


def mixed(way: int, a, b):
    """The hash of a pattern: its way (two before, one on each side, two after) and its two tokens; of numbers or arrays."""
    x = (a * 0x9E3779B97F4A7C15 & FULL) ^ ((b * 0xC2B2AE3D27D4EB4F & FULL) >> 7) ^ (b * 0x165667B19E3779F9 & FULL) + way & FULL
    return (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & FULL


FULL = (1 << 64) - 1


def lowered(text: str) -> str:
    """Lower case with every code point at its place: a capital I with a dot, the one that would become two, is a plain i."""
    return text.replace("\u0130", "i").lower()


def contexts(text: str, start: int, end: int, memory: Tokens) -> list[int]:
    """Lexical patterns of a span."""
    before = [memory[t] for t in TOKEN.findall(lowered(text[max(0, start - BESIDE) : start]))[-2:]]
    after = [memory[t] for t in TOKEN.findall(lowered(text[end : end + BESIDE]))[:2]]
    out = []
    if len(before) == 2:
        out.append(mixed(1, before[0], before[1]))
    if before and after:
        out.append(mixed(2, before[-1], after[0]))
    if len(after) == 2:
        out.append(mixed(3, after[0], after[1]))
    return [x - (1 << 64) if x >> 63 else x for x in out]


def plain_places(text: str, spans: list[tuple[str, int, int]], memory: Tokens) -> np.ndarray:
    """Patterns around the plain words of a text: words without digits that lie in no span."""
    if len(text) < 2:
        return np.zeros(0, dtype=np.int64)
    found = TOKEN.findall(low := lowered(text))
    t = np.fromiter(map(memory.__getitem__, found), np.uint64, len(found))
    plain = (t & 1).astype(bool)
    if spans and len(found):
        starts = np.array([m.start() for m in TOKEN.finditer(low)])
        ordered = sorted((a, b) for _, a, b in spans)
        at = np.searchsorted(np.array([a for a, _ in ordered]), starts, side="right") - 1
        plain &= (at < 0) | (starts >= np.maximum.accumulate(np.array([b for _, b in ordered]))[at])
    out = [np.zeros(0, dtype=np.uint64)]
    if len(t) > 2:
        out += [mixed(1, t[:-2], t[1:-1])[plain[2:]], mixed(2, t[:-2], t[2:])[plain[1:-1]], mixed(3, t[1:-1], t[2:])[plain[:-2]]]
    return np.concatenate(out).view(np.int64)


SPANS = "array<struct<kind:string,start:long,end:long>>"
FOUND = "array<struct<kind:string,start:long,end:long,entity:long,kinds:array<string>,patterns:array<long>>>"


def entity_hash(found: str) -> int:
    return xxhash.xxh64_intdigest(found.lower()) - (1 << 63)


def mentions(docs: DataFrame) -> DataFrame:
    """A row number, doc_id, the base spans, and all mentions with their patterns: seeds have a kind, candidates the kinds they may be of."""
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    arrow_found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("entity", pa.int64()), ("kinds", pa.list_(pa.string())), ("patterns", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, memory = TaskContext.get().partitionId() << 40, Tokens()
        for batch in batches:
            for part, texts in chunks(batch):
                base, found = [], []
                for t in texts:
                    own = base_spans(t)
                    seeds = own + secrets(t, own)
                    base.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                    found.append([{"kind": k or None, "start": a, "end": b, "entity": entity_hash(t[a:b]), "kinds": [k] if k else possible_kinds(t[a:b]), "patterns": contexts(t, a, b, memory)} for k, a, b in seeds + candidates(t, seeds)])
                yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(texts)), pa.int64()), part.column("doc_id"), pa.array(base, arrow), pa.array(found, arrow_found)], ["row", "doc_id", "base", "found"])
                row += len(texts)

    return docs.select("doc_id", "text").mapInArrow(run, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {SPANS}, found {FOUND}")


def plain_counts(docs: DataFrame, patterns: DataFrame, sent: int = SENT) -> DataFrame:
    """pattern and plain: how often plain words stand in the place of each of the patterns. One pass over the texts for each `sent` patterns."""
    n = patterns.count()
    blocks = -(-n // sent)
    out = None
    for i in range(blocks):
        own = patterns if blocks == 1 else patterns.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == i)
        known = np.sort(own.toArrow().column("pattern").to_numpy())

        def run(batches: Iterator[pa.RecordBatch], known: np.ndarray = known) -> Iterator[pa.RecordBatch]:
            memory = Tokens()
            for batch in batches:
                for _, texts in chunks(batch):
                    hits = [np.zeros(0, dtype=np.int64)]
                    for t in texts:
                        own = base_spans(t)
                        seeds = own + secrets(t, own)
                        x = plain_places(t, seeds + candidates(t, seeds), memory)
                        hits.append(x[known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x] if len(known) else x[:0])
                    values, counts = np.unique(np.concatenate(hits), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], ["pattern", "plain"])

        part = docs.select("text").mapInArrow(run, "pattern long, plain long").groupBy("pattern").agg(F.sum("plain").alias("plain"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else patterns.withColumn("plain", F.lit(0).cast("long"))


def discovered(docs: DataFrame, found: DataFrame, sent: int = SENT) -> DataFrame:
    """Candidate entities of high confidence: entity, kind and confidence. found: mentions of docs."""
    each = found.select(F.explode("found").alias("m")).select("m.kind", "m.entity", "m.kinds", F.explode("m.patterns").alias("pattern"))
    graph = each.groupBy("pattern", "entity").agg(F.max("kind").alias("seed"), F.first("kinds").alias("kinds"))
    # a pattern counts if it may ever have enough entities of a kind, seeds among all that were met
    seeds = F.count("seed")
    able = graph.select("pattern", "seed", F.explode("kinds").alias("kind")).groupBy("pattern", "kind").agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT).select("pattern").distinct()
    graph = written(graph.join(able, "pattern", "left_semi"), "graph")
    if not graph.agg(seeds).first()[0]:
        return found.sparkSession.createDataFrame([], "entity long, kind string, confidence double")
    plain = written(plain_counts(docs, graph.select("pattern").distinct(), sent), "plain")
    all_met = graph.groupBy("pattern").agg(F.count("*").alias("all"))
    accepted, n = None, 0
    while True:
        known = graph.select("pattern", "entity", "kinds", F.col("seed").alias("kind"), F.when(F.col("seed").isNotNull(), F.lit(1.0)).alias("sure"))
        if accepted is not None:
            known = known.join(accepted.select("entity", F.col("kind").alias("_kind"), "confidence"), "entity", "left")
            known = known.select("pattern", "entity", "kinds", F.coalesce("kind", "_kind").alias("kind"), F.coalesce("sure", "confidence").alias("sure"))
        # of each pattern and kind: known entities, and candidates without a verdict that may be of the kind and do not speak against it
        sides = known.select("pattern", F.explode(F.when(F.col("kind").isNotNull(), F.array("kind")).otherwise(F.col("kinds"))).alias("kind"), "sure")
        per = sides.groupBy("pattern", "kind").agg(F.sum("sure").alias("own"), F.sum(F.when(F.col("sure").isNull(), 1).otherwise(0)).alias("open")).filter(F.col("own") >= SUPPORT)
        per = per.join(all_met, "pattern").join(plain, "pattern", "left")
        share = F.col("own") / (F.col("all") - F.col("open") + F.coalesce("plain", F.lit(0)))
        good = per.withColumn("score", share).filter(F.col("score") >= GOOD_PATTERN).select("pattern", "kind", F.least("score", 1 - 1 / (F.col("own") + 1)).alias("score"))
        met = graph.filter("seed IS NULL").select("pattern", "entity", F.explode("kinds").alias("kind")).join(good, ["pattern", "kind"])
        each = met.groupBy("entity", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("confidence")).filter(F.col("confidence") >= GOOD_ENTITY)
        if accepted is not None:
            each = each.unionByName(accepted)
        best = each.groupBy("entity").agg(F.max(F.struct("confidence", "kind")).alias("x")).select("entity", "x.kind", "x.confidence")
        accepted = written(best, "accepted")
        before, n = n, accepted.count()
        if n == before:  # entities are only ever added, so this ends
            return accepted


def found_spans(docs: DataFrame) -> DataFrame:
    """row, doc_id, base (base spans) and spans (base spans, secrets and discovered ones), each by kind as listed, then start."""
    marked = written(mentions(docs), "mentions")
    accepted = discovered(docs, marked).select("entity", F.col("kind").alias("_kind"))
    extra = marked.select("row", F.explode("found").alias("m")).filter("m.kind IS NULL").select("row", "m.start", "m.end", "m.entity").join(accepted, "entity")
    extra = extra.groupBy("row").agg(F.collect_list(F.struct(F.col("_kind").alias("kind"), "start", "end")).alias("extra"))
    order = ", ".join(f"'{k}'" for k in ALL_KINDS)
    sure = "transform(filter(found, x -> x.kind IS NOT NULL), x -> struct(x.kind AS kind, x.start AS start, x.end AS end))"
    spans = F.expr(f"transform(array_sort(transform(concat({sure}, coalesce(extra, array())), x -> struct(array_position(array({order}), x.kind) AS place, x.start AS start, x.end AS end, x.kind AS kind))), x -> struct(x.kind AS kind, x.start AS start, x.end AS end))")
    return marked.select("row", "doc_id", "base", "found").join(extra, "row", "left").select("row", "doc_id", "base", spans.alias("spans"))


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans by kind, SHA-256 of the base spans, all spans as text, and their number."""
    def text(c: str):
        return F.expr(f"array_join(transform({c}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")

    counts = [F.expr(f"size(filter(base, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return found_spans(docs).select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redacted(docs: DataFrame, sent: int = SENT) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets, n_chars counted anew; columns as in docs.

    Overlapping spans are replaced as one, by the kind of the first. Discovered entities come from all of docs; spans are
    found anew in each text, so texts are not shuffled, unless over `sent` entities were discovered: then rows are joined
    with the entities that they hold.
    """
    marked = written(mentions(docs.select(F.xxhash64("text").alias("doc_id"), "text")), "mentions")
    accepted = discovered(docs, marked)
    names, own = docs.columns, ["doc_id", "text", "n_chars"]
    few = accepted.count() <= sent
    known = {r.entity: r.kind for r in accepted.collect()} if few else {}
    rows = folded(docs, own)
    if few:
        rows = rows.withColumn("_found", F.lit(None).cast("map<bigint,string>"))
    else:  # equal texts hold equal entities
        more = marked.select(F.col("doc_id").alias("_x"), F.explode("found.entity").alias("entity")).distinct().join(accepted, "entity")
        more = more.groupBy("_x").agg(F.map_from_entries(F.collect_list(F.struct("entity", "kind"))).alias("_found"))
        rows = rows.withColumn("_x", F.xxhash64("text")).join(more, "_x", "left").drop("_x")
    kept = [c for c in rows.columns if c != "_found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, given_texts in chunks(batch):
                texts, sizes = [], []
                blank = part.column("text").is_null().to_pylist()
                for t, none, given in zip(given_texts, blank, part.column("_found").to_pylist(), strict=True):
                    base = base_spans(t)
                    spans = base + secrets(t, base)
                    entities = known or dict(given or ())
                    if entities:
                        spans += [(entities[e], a, b) for _, a, b in candidates(t, spans) if (e := entity_hash(t[a:b])) in entities]
                    out, at = [], 0
                    for k, a, b in sorted(set(spans), key=lambda s: (s[1], -s[2])):
                        if a >= at:
                            out += [t[at:a], f"<{k}>"]
                        at = max(at, b)
                    t = "".join([*out, t[at:]]) if out else t
                    texts.append(None if none else t)
                    sizes.append(None if none else len(t))
                arrays = [pa.array(texts, pa.string()) if c == "text" else pa.array(sizes, pa.int64()) if c == "n_chars" else part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays(arrays, kept)

    return unfolded(rows.mapInArrow(run, rows.select(*kept).schema), names, own)
