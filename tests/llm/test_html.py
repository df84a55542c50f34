"""Main text of pages: fixtures whose text is known, and site templates."""

from __future__ import annotations

import collections
import html.parser

from pyspark.sql import functions as F

from wayfold.llm import html_extract
from wayfold.llm.common import load

PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav>
<header class=site><h1>Site</h1></header><div class="cookie-notice">Accept?</div>
<article><h1>Head &amp; more</h1><p>First   para<br>graph &#x41;.</p><ul><li>one<li>two</ul><script>var x="<p>no</p>";</script><p>Café &lt;b&gt; {own}</p></article>
<aside>Links</aside><div id=comments>First!</div><footer>(c)</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, h long")


def test_text_of_an_article(spark):
    rows = [(1, "http://a.example/1", PAGE.format(own="mine"), "x", 1), (2, "http://a.example/2", None, "x", 1), (3, None, "", "x", 1), (4, "http://b.example/", "just text &amp; so on", "x", 1), (4, "http://b.example/", "just text &amp; so on", "x", 1)]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extracted(pages(spark, rows)).collect())
    text = "Head & more First para graph A. one two Café <b> mine"
    assert got == [(1, text, len(text)), (2, "", 0), (3, "", 0), (4, "just text & so on", 17), (4, "just text & so on", 17)]


def test_template_of_a_host_is_removed(spark):
    """Without an article, blocks that recur across pages of a host go; those of other hosts and single pages stay."""
    same = "<div><p>Our shop sells shoes. Call us.</p></div>"
    rows = [(i, f"http://shop.example/{i}", f"<body>{same}<div><p>Page number {i} is here</p></div></body>", None, None) for i in range(12)]
    rows += [(99, "http://other.example/", f"<body>{same}<p>Alone</p></body>", None, None)]
    got = {r.page_id: r.text for r in html_extract.extracted(pages(spark, rows)).collect()}
    assert got == {**{i: f"Page number {i} is here" for i in range(12)}, 99: "Our shop sells shoes. Call us. Alone"}


def test_repeated_parts_of_articles_and_pages(spark):
    """On a host with enough pages what recurs goes, within articles too; names are not needed, copies and rare blocks stay."""
    menu, notice = "<div><a href=/>Start</a> <a href=/b>Shop</a></div>", "<div><p>Read our terms.</p><p>They bind you.</p><p>Thank you.</p></div>"
    body = lambda i, text: f"<body><div><a href=#m>Go on</a>{menu}<div class=x{i}>Buy thing {i}</div><main><h1>News</h1>{text}{notice}</main></div></body>"
    own = [f"<p>First {i} of the day.</p><p>Second {i}, which is longer.</p>" for i in range(20)]
    copied = "<p>A wire story.</p><p>It is printed again and again.</p>"
    rows = [(i, f"http://n.example/{i}", body(i, t), None, None) for i, t in enumerate(own)]
    rows += [(100 + i, f"http://n.example/c{i}", body(i, copied), None, None) for i in range(30)]
    rows += [(200 + i, f"http://n.example/p{i}", body(i, f"<p>Shared passage.</p><p>Around it {i} stand words that no other page has at all.</p>"), None, None) for i in range(8)]
    expected = {i: f"News First {i} of the day. Second {i}, which is longer." for i in range(20)}
    expected |= {100 + i: "News A wire story. It is printed again and again." for i in range(30)} | {200 + i: f"News Shared passage. Around it {i} stand words that no other page has at all." for i in range(8)}
    for sent in (html_extract.SENT, 0):  # sent along, or joined with the pages
        assert {r.page_id: r.text for r in html_extract.extracted(pages(spark, rows), sent).collect()} == expected


class Article(html.parser.HTMLParser):
    """Text of the article elements, blocks joined by one space: a plain reading that shares nothing with the operator."""

    INLINE = frozenset("a b i em strong span br small code sub sup u".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.piece(tag)

    def handle_endtag(self, tag):
        self.piece(tag)
        self.depth -= tag == "article" and self.depth > 0

    def piece(self, tag):
        if tag == "br":
            self.blocks[-1] += "\n"
        elif tag not in self.INLINE:
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data


def article_of(page: str) -> str:
    reader = Article()
    reader.feed(page)
    reader.close()
    return " ".join(t for b in reader.blocks if (t := " ".join(b.split())))


def test_whole_table_against_brute_force(spark, sf_dir):
    """Every text equals a plain reading of the article; the counts of subtrees equal counts in Python."""
    table = load(spark, sf_dir, "pages")
    rows = table.collect()
    bodies = collections.defaultdict(set)
    for r in rows:
        host = html_extract.host_of(r.url)
        found, body = html_extract.hashed(html_extract.parsed(r.html or ""), host)
        for h, inner in found.items():
            bodies[host, h, inner].add(body)
    hosts = {html_extract.digest(host, "host"): host for host, _, _ in bodies}
    every = {hosts[h]: len(own) for (_, h, _), own in bodies.items() if h in hosts}
    template = {h for (host, h, inner), own in bodies.items() if h not in hosts and len(own) >= 5 and len(own) >= (0.5 if inner else 0.005) * every[host]}
    hashes = html_extract.page_hashes(table.withColumn("row", F.xxhash64("url", "html")))
    assert {r.h for r in html_extract.template_of(hashes).collect()} == template
    expected = sorted((r.page_id, article_of(r.html or "")) for r in rows)
    for sent in (html_extract.SENT, 0):
        assert sorted((r.page_id, r.text) for r in html_extract.extracted(table, sent).collect()) == expected


def test_subtrees_alone_remove_adverts_without_names(spark, sf_dir):
    """The table's pages on one host, twenty times each with other articles and no class names: all adverts recur and go."""
    found = load(spark, sf_dir, "pages").limit(10).collect()
    rows, expected = [], {}
    for i, r in enumerate(found):
        for k in range(20):
            page = r.html.replace('class="ad"', f'class="x{k}"').replace("<article>", f"<article><p>Copy {k} of page {i}.</p>")
            rows.append((20 * i + k, "http://one.example/", page, None, None))
            expected[20 * i + k] = article_of(page)
    assert {r.page_id: r.text for r in html_extract.extracted(pages(spark, rows)).collect()} == expected
    lone = html_extract.extracted(pages(spark, [r for r in rows if r[0] % 20 == 0])).collect()
    assert all(r.text != expected[r.page_id] and r.text.endswith(expected[r.page_id]) for r in lone)


def test_unique_text_beside_main_stays(spark):
    """A headline, a lead and loose text are kept although their place recurs; menus, counters and loose labels that recur go."""
    words = [f"{a}{b}" for a in ("ar", "be", "co", "du", "el") for b in ("n", "r", "s", "t")]
    page = lambda i, w: f"<body><div class=top><h1>Headline {w} 4</h1><p class=lead>Lead 3 on {w}</p></div><div>Page {i} of 20</div>Loose {w} <b>word</b><hr>Read on <i>here</i><main><p>Body of {w}.</p></main></body>"
    rows = [(i, f"http://n.example/{i}", page(i, w), None, None) for i, w in enumerate(words)]
    expected = {i: f"Headline {w} 4 Lead 3 on {w} Loose {w} word Body of {w}." for i, w in enumerate(words)}
    for sent in (html_extract.SENT, 0):
        assert {r.page_id: r.text for r in html_extract.extracted(pages(spark, rows), sent).collect()} == expected
    numbered = [(i, f"http://n.example/{i}", f"<h1>Issue {i}</h1><main><p>Text {i}</p></main>", None, None) for i in range(20)]
    assert {r.page_id: r.text for r in html_extract.extracted(pages(spark, numbered)).collect()} == {i: f"Issue {i} Text {i}" for i in range(20)}


def test_long_and_broken_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 10
    rows = [(1, "u", deep, None, None), (2, "u", "<p>a<p>b</div></p>c" + " word" * 100_000, None, None), (3, "u", "<div <p x='1>broken", None, None)]
    got = {r.page_id: r.text for r in html_extract.extracted(pages(spark, rows)).collect()}
    assert got[1] == "deep" and got[2].split(" ", 3)[:3] == ["a", "b", "c"] and len(got[2]) == 5 + 500_000
