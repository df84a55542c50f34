"""Operator 4: main text of web pages by site template removal.

A page is cut into elements in one pass and each element subtree has a hash of its tags and text. Spark counts the distinct
page bodies of each host that hold a hash; copies of an article are one body, so they are no template. What recurs is
deleted, and the rest of the page is its text: blocks in page order, white space collapsed, joined by one space.

* Outside main content (the outermost article or main elements) a block goes if its subtree is on LEAST_PAGES bodies of the
  host and on SHARE of them. Subtrees without a heading or paragraph are hashed with every number as 0, so "Page 3 of 9"
  recurs. Text beside main content that has no element of its own is a subtree together with the inline elements next to it.
  What does not recur stays, a headline or lead above the main element for instance.
* On pages without main content subtrees are hashed as they are, whatever they hold.
* In main content these are whole blocks (paragraphs, lists, divisions; never words or headings) on INNER_SHARE of the
  bodies, for articles share passages; and a page of whose main content more than half recurs is a near copy of others and
  keeps it.
* Markup that says of itself that it is no main text (nav, footer, aside, form, script, hidden parts, roles, a list of names
  in class and id such as ad or comments) goes everywhere, on hosts with too few pages to count anything too.

Null and empty pages have an empty text. Repeated rows each give a row; a null url is a host of its own. Other columns of
pages do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import chunks, written

#: Outside main content, a subtree is template if so many bodies of a host hold it and this share of them; in main content, the second share.
LEAST_PAGES, SHARE, INNER_SHARE = 5, 0.005, 0.5
#: Hashes of template that are sent to all tasks at most (8 bytes each); beyond, pages are joined with theirs. Both give the same.
SENT = 200_000

#: Elements of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head script style noscript iframe template textarea title nav aside footer form button select option input svg canvas object embed audio video menu dialog fieldset datalist map math".split())
ENDS_P = BLOCKS - frozenset("body html caption dd dt tbody td tfoot th thead tr legend summary figcaption li".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = frozenset("ul ol dl table body html article main section div nav aside footer header form td th".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Blocks that may be template within main content.
GROUPS = frozenset("address aside blockquote center details div dl figure fieldset footer form header hgroup menu nav ol p pre section table ul".split())
#: Parts of class and id names that mark what is not main text.
NAMED = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|notification|popup|modal|overlay|newsletter|subscribe|sidebar|side|breadcrumbs?|nav\w*|menu|footer|masthead|comments?|replies|respond|disqus|related|recommended|share|sharing|social|widget|toolbar|pagination|pager|login|signup|skip)(?:$|[-_ ])", re.I)
DIGITS = re.compile(r"[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")


class Node:
    __slots__ = ("tag", "drop", "named", "main", "within", "parts", "key")

    def __init__(self, tag: str, drop: bool = False, named: bool = False, main: bool = False, within: bool = False):
        self.tag, self.drop, self.named, self.main, self.within = tag, drop, named, main, within
        self.parts: list[str | Node] = []
        self.key: int | None = None


def judged(tag: str, attributes: str, within_main: bool) -> tuple[bool, bool]:
    """Whether the markup says that an element is no main text, and whether its names do."""
    if tag in DROPPED or tag == "header" and not within_main:
        return True, False
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False, False
    own = {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(attributes)}
    if "hidden" in own or own.get("aria-hidden") == "true" or own.get("role", "").lower() in ROLES or HIDDEN.search(own.get("style", "")):
        return True, False
    if tag in ("html", "body", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6", "b", "i", "em", "strong") or tag == "article" and not within_main:
        return False, False
    return False, bool(NAMED.search(own.get("class", "")) or NAMED.search(own.get("id", "")))


def parsed(page: str) -> Node:
    """The tree of a page: nodes whose parts are texts and nodes. Elements left open end with their parents."""
    root = Node("html")
    stack = [root]
    at = mains = 0
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "br":
                stack[-1].parts.append("\n")
            elif tag == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].parts.append(Node("p"))
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        mains -= sum(n.main for n in stack[k:])
                        del stack[k:]
                        break
                    if stack[k].tag in SCOPES and tag not in SCOPES:
                        break
            continue
        if tag == "br":
            stack[-1].parts.append("\n")
            continue
        if tag in ("html", "body"):
            if tag == "body" and len(stack) > 1 and stack[1].tag == "head":
                del stack[1:]
            continue
        closes = ("p",) if tag in ENDS_P else CLOSES.get(tag, ())
        for k in range(len(stack) - 1, 0, -1) if closes else ():
            if stack[k].tag in closes:
                mains -= sum(n.main for n in stack[k:])
                del stack[k:]
            elif stack[k].tag in SCOPES:
                break
        attributes = m[3] or m[6] or ""
        drop, named = judged(tag, attributes, mains > 0)
        node = Node(tag, drop, named, tag in ("article", "main") or 'role="main"' in attributes, mains > 0)
        stack[-1].parts.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*/?>", re.I).search(page, at)
            node.parts.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            continue
        stack.append(node)
        mains += node.main
    if at < len(page):
        stack[-1].parts.append(page[at:])
    return root


def digest(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts))) >> 1


def nodes_of(root: Node) -> list[Node]:
    """All nodes, parents first. Without recursion."""
    order, todo = [], [root]
    while todo:
        order.append(n := todo.pop())
        todo += [p for p in n.parts if isinstance(p, Node)]
    return order


def around_main(order: list[Node]) -> set[int]:
    """Of all nodes, parents first: the main elements and those around them, by id()."""
    holds: set[int] = set()
    for n in reversed(order):
        if n.main and not n.within or any(isinstance(p, Node) and id(p) in holds for p in n.parts):
            holds.add(id(n))
    return holds


def gathered(parts: list[str | Node], holds: set[int]) -> list[str | Node]:
    """Parts of an element around main content: texts and inline elements that follow each other become one node."""
    out: list[str | Node] = []
    run = None
    for p in parts:
        if isinstance(p, Node) and (p.tag in BLOCKS or id(p) in holds or p.drop or p.named):
            run = None
        elif run is None and isinstance(p, str) and not p.strip():
            pass
        else:
            if run is None:
                out.append(run := Node("#run"))
            run.parts.append(p)
            continue
        out.append(p)
    return out


def hashed(root: Node, host: str) -> tuple[dict[int, bool], int]:
    """The page's subtree hashes (each with its host; true for those in main content) and that of its body.

    Sets the keys of nodes that may be template. One hash is that of the host itself, which all its pages hold.
    """
    order = nodes_of(root)
    holds = around_main(order)
    for n in order if holds else ():
        if id(n) in holds and not (n.within or n.main):
            n.parts = gathered(n.parts, holds)
    order = nodes_of(root) if holds else order
    inline = {id(p): id(n) for n in order if n is not root for p in n.parts if isinstance(p, Node) and p.tag not in BLOCKS}
    whole: dict[int, int] = {}
    prose: set[int] = set()
    found = {digest(host, "host"): False}
    for n in reversed(order):
        inner = n.within or n.main
        below = [p for p in n.parts if isinstance(p, str) or not (p.drop or p.named)]
        if n.tag in PROSE or any(isinstance(p, Node) and id(p) in prose for p in below):
            prose.add(id(n))
        parts = [str(whole[id(p)]) if isinstance(p, Node) else " ".join(p.split()) for p in below]
        if holds and not inner and id(n) not in prose:
            parts = [p if isinstance(q, Node) else DIGITS.sub("0", p) for p, q in zip(parts, below, strict=True)]
        whole[id(n)] = digest(host, inner, n.tag, *parts)
        if id(n) in holds or n.drop or n.named:  # never template as a whole, or gone without it
            continue
        if inner and n.tag not in GROUPS or not inner and id(n) in inline and inline[id(n)] not in holds:  # goes with the block that it is in
            continue
        n.key = whole[id(n)]
        found[n.key] = inner
    body = digest(*sorted(whole[id(n)] for n in order if n.main and not n.within)) if holds else whole[id(root)]
    return found, body


def blocks_of(root: Node, cut: set[int]) -> list[tuple[str, bool]]:
    """Blocks of text of the nodes that are not cut (by id()), in page order, and whether they are in main content."""
    blocks: list[tuple[str, bool]] = []
    line: list[str] = []
    inner = False
    done: list = [root]

    def end() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        line.clear()
        if text:
            blocks.append((text, inner))

    while done:
        part = done.pop()
        if part is None:
            end()
        elif isinstance(part, bool):
            end()
            inner = part
        elif isinstance(part, str):
            line.append(part)
        elif id(part) in cut:
            done.append(" " if part.tag not in BLOCKS else None)
        else:
            own: list = list(reversed(part.parts))
            if part.main and not part.within:
                own = [False, *own, True]
            done += [None, *own, None] if part.tag in BLOCKS else own
    end()
    return blocks


def text_of(root: Node, template: set[int] | frozenset[int]) -> str:
    """Blocks of main text in page order, joined by one space; root is hashed, template holds its recurring hashes."""
    outer, inner = set(), set()
    nodes = nodes_of(root)
    holds = around_main(nodes)
    for n in nodes:
        if id(n) in holds:
            if n.drop and n.tag != "form":
                outer.add(id(n))
        elif n.drop or n.named:
            outer.add(id(n))
        elif n is not root and n.key in template:
            (inner if n.within or n.main else outer).add(id(n))
    blocks = blocks_of(root, outer)
    if inner:
        less = blocks_of(root, outer | inner)
        size = lambda found: sum(len(t) for t, main in found if main)
        if 2 * size(less) >= size(blocks):
            blocks = less
    return " ".join(t for t, _ in blocks)


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def page_hashes(rows: DataFrame) -> DataFrame:
    """host, body and hashes of each page of rows, and its row, a hash of url and html: equal rows have equal hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "html"):
                hosts, bodies, outer, inner = [], [], [], []
                for url, t in zip(part.column("url").to_pylist(), texts, strict=True):
                    host = host_of(url)
                    found, body = hashed(parsed(t), host)
                    hosts.append(digest(host, "host"))
                    bodies.append(body)
                    outer.append([h for h, within in found.items() if not within])
                    inner.append([h for h, within in found.items() if within])
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(hosts, pa.int64()), pa.array(bodies, pa.int64()), pa.array(outer, longs), pa.array(inner, longs)], ["row", "host", "body", "outer", "inner"])

    return rows.select("row", "url", "html").mapInArrow(run, "row long, host long, body long, `outer` array<long>, `inner` array<long>")


def template_of(hashes: DataFrame) -> DataFrame:
    """h and n: the recurring hashes of all hosts, and on how many distinct bodies of the host they are."""
    each = hashes.select("host", "body", F.explode(F.concat(F.transform("outer", lambda h: F.struct(h.alias("h"), F.lit(False).alias("inner"))), F.transform("inner", lambda h: F.struct(h.alias("h"), F.lit(True).alias("inner"))))).alias("x"))
    each = each.select("host", "body", "x.h", "x.inner").distinct()
    counts = written(each.groupBy("host", "h", "inner").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES), "subtrees")
    per_host = counts.filter("h = host").select("host", F.col("n").alias("all"))
    share = F.when(F.col("inner"), F.lit(INNER_SHARE)).otherwise(F.lit(SHARE))
    return counts.filter("h <> host").join(per_host, "host").filter(F.col("n") >= share * F.col("all")).select("h", "n")


def extracted(pages: DataFrame, sent: int = SENT) -> DataFrame:
    """page_id, url, text and n_chars of each page. sent: template hashes that go to all tasks at most."""
    rows = pages.select("page_id", "url", "html").withColumn("row", F.xxhash64("url", "html"))
    hashes = written(page_hashes(rows), "page-hashes")
    template = written(template_of(hashes).select("h").distinct(), "template")
    kind = pages.schema["page_id"].dataType.simpleString()
    few = template.count() <= sent
    known = np.array([r.h for r in template.collect()], dtype=np.int64) if few else None
    if not few:
        own = hashes.select("row", F.explode(F.concat("outer", "inner")).alias("h")).join(template, "h").groupBy("row").agg(F.collect_set("h").alias("_template"))
        rows = rows.join(own, "row", "left").select("page_id", "url", "html", "_template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = frozenset(known.tolist()) if few else frozenset()
        for batch in batches:
            for part, texts in chunks(batch, "html"):
                given = [None] * len(texts) if few else part.column("_template").to_pylist()
                out = []
                for url, t, own in zip(part.column("url").to_pylist(), texts, given, strict=True):
                    root = parsed(t)
                    hashed(root, host_of(url))
                    out.append(text_of(root, everywhere if few else frozenset(own or ())))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
