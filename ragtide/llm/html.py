"""Main text of web pages by site template removal.

Pages are parsed into element trees. Every element subtree that could be
template is hashed; the hashes are counted per host over pages with different
content; subtrees that recur across many pages of their host are deleted,
together with elements that are never article text by their tag, role or class
(navigation, header, footer, sidebar, notice, advert, form, script, style,
comments). What remains of the article is written out block by block.

Inside an <article> or <main> only containers can be template: a paragraph,
heading, list item or table cell there is the page's own text however often the
host repeats it.

What counts as many pages is an absolute number, so that a block goes however
large its host is; on smaller hosts a share of the pages is enough. Headings,
list items and table cells outside an article need the share: by themselves they
are short, and a large host's own texts repeat them.

A story that many pages of a host carry, each with its own date or counter, recurs like a template, but it is
what its pages are about. So a page counts for a subtree only if it has text of its own beside it: text blocks that
recur on few pages, of at least ``OWN`` of the length of the page's blocks that recur about as often as the subtree
(a story's paragraphs recur together, and so are one story). Subtrees on half of the host's pages need no such pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragtide.llm.common import schema_of, written

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are not text of the article, whatever they hold.
DROPPED = frozenset("head script style noscript template nav aside footer form button select textarea iframe object svg "
                    "canvas audio video dialog menu title".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th "
                   "thead tr ul caption legend menu dialog".split())
#: Elements that hold running text; inside an article they are never template.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th tr tbody thead table ul ol dl blockquote pre figcaption figure".split())
#: Elements that are template by their share of the host's pages only.
BY_SHARE = frozenset("h1 h2 h3 h4 h5 h6 li dd dt td th tr caption figcaption legend summary".split())
#: A start tag ends an open element of these kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"),
        "tfoot": ("tr", "td", "th", "tbody")}
#: An implied end does not reach beyond these.
SCOPES = frozenset("html body table ul ol dl div section article main aside nav header footer form select".split())
NOT_ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|header|"
    r"masthead|footer|sidebar|side|aside|widget|related|recommended|share|sharing|social|cookies?|consent|gdpr|notice|alert|"
    r"popup|modal|overlay|newsletter|subscribe|signup|login|search|comments?|disqus|respond|replies|pagination|pager|"
    r"copyright|disclaimer)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar "
                  "advertisement".split())


#: A page counts for a subtree if its own text is at least this share of what recurs together with the subtree.
OWN = 0.25


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None"):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []


class _Tree(HTMLParser):
    """Tolerant tree builder: implied and missing end tags, stray end tags, truncated pages."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def _close(self, tags: tuple[str, ...], scopes: frozenset[str]) -> None:
        n = self.at
        while n.parent is not None:
            if n.tag in tags:
                self.at = n.parent
                return
            if n.tag in scopes:
                return
            n = n.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._close(("p",), SCOPES)
        if tag in ENDS:
            self._close(ENDS[tag], SCOPES - {"table"} if tag in ("tbody", "tfoot") else SCOPES)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None:
            if n.tag == tag:
                self.at = n.parent
                return
            if n.tag in ("article", "main", "body", "table") and tag not in BLOCKS:
                return  # a stray inline end tag closes nothing further out
            n = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


def never_article(n: Node) -> bool:
    """By tag, role, class or id; a <header> inside an article holds the article's own title and stays."""
    if n.tag in DROPPED:
        return True
    if n.tag in ("html", "body", "article", "main"):
        return False
    if n.tag == "header":
        p = n.parent
        while p is not None and p.tag not in ("article", "main"):
            p = p.parent
        return p is None
    a = n.attrs
    if not a:
        return False
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true":
        return True
    if n.tag in TEXT and n.tag not in ("ul", "ol", "dl", "table", "figure"):
        names = a.get("class", "")
    else:
        names = f"{a.get('class', '')} {a.get('id', '')}"
    return bool(names.strip()) and NOT_ARTICLE.search(names) is not None


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Elements in page order that tags and classes leave, with whether they are inside article or main."""
    stack = [(root, False)]
    while stack:
        n, inside = stack.pop()
        if never_article(n):
            continue
        if n.tag != "#root":
            yield n, inside
        inside = inside or n.tag in ("article", "main")
        stack += [(c, inside) for c in reversed(n.children) if isinstance(c, Node)]


class _Subtrees:
    """Of every node, bottom up: a signed 64-bit hash of its subtree (tags, classes and squeezed text), the length of its text,
    and whether it holds a block element.

    The hash's lowest bit tells elements of BY_SHARE (1) from others (0)."""

    def __init__(self, root: Node):
        self.hash: dict[int, int] = {}
        self.size: dict[int, int] = {}
        self.holds: dict[int, bool] = {}
        stack: list[tuple[Node, bool]] = [(root, False)]
        while stack:
            n, done = stack.pop()
            if not done:
                stack.append((n, True))
                stack += [(c, False) for c in n.children if isinstance(c, Node)]
                continue
            parts, size, holds = [n.tag, n.attrs.get("class", "")], 0, False
            for c in n.children:
                if isinstance(c, str):
                    text = " ".join(c.split())
                    size += len(text)
                    parts.append(text)
                else:
                    parts.append(f"\x00{self.hash[id(c)]}")
                    size += self.size[id(c)]
                    holds = holds or c.tag in BLOCKS or self.holds[id(c)]
            h = _hash("\x01".join(p for p in parts if p)) & ~1 | (n.tag in BY_SHARE)
            self.hash[id(n)], self.size[id(n)], self.holds[id(n)] = _signed(h), size, holds


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def candidates(root: Node) -> tuple[int, set[int], dict[int, int]]:
    """(hash of the page, hashes of the subtrees that could be template, length of each text block by its hash).

    A text block is a block element without block elements in it, or what a block element with some has as text
    of its own between them."""
    trees = _Subtrees(root)
    found, blocks = set(), {}
    for n, inside in _walk(root):
        if n.tag not in BLOCKS:
            continue
        if not trees.holds[id(n)]:
            if trees.size[id(n)]:
                blocks[trees.hash[id(n)]] = trees.size[id(n)]
        else:
            own = " ".join(" ".join(c.split()) for c in n.children if isinstance(c, str)).strip()
            if own:
                blocks[_signed(_hash(f"\x02{own}"))] = len(own)
        if n.tag in ("html", "body", "article", "main") or (inside and n.tag in TEXT):
            continue
        found.add(trees.hash[id(n)])
    return trees.hash[id(root)], found, blocks


def main_text(root: Node, template: frozenset[int]) -> str:
    """Blocks of the article, one a line, without dropped elements and ``template`` subtrees.

    The article is every outermost <article> or <main>, if one has text; else the body."""
    hashes = _Subtrees(root).hash if template else {}

    def skipped(n: Node, inside: bool) -> bool:
        if never_article(n):
            return True
        return (bool(template) and n.tag in BLOCKS and n.tag not in ("html", "body", "article", "main")
                and not (inside and n.tag in TEXT) and hashes[id(n)] in template)

    def text_of(top: Node, inside: bool) -> list[str]:
        blocks: list[str] = []
        line: list[str] = []

        def flush() -> None:
            s = " ".join("".join(line).split())
            if s:
                blocks.append(s)
            line.clear()

        stack: list[tuple[Node | str | None, bool]] = [(top, inside)]
        while stack:
            n, here = stack.pop()
            if n is None:
                flush()
            elif isinstance(n, str):
                line.append(n)
            elif n is not top and skipped(n, here):
                if n.tag in BLOCKS:
                    flush()
            else:
                here = here or n.tag in ("article", "main")
                if n.tag == "br":
                    line.append(" ")
                if n.tag in BLOCKS or n is top:
                    flush()
                    stack.append((None, here))
                stack += [(c, here) for c in reversed(n.children)]
        flush()
        return blocks

    tops = []
    stack = [root]
    while stack:
        n = stack.pop()
        if n.tag in ("article", "main"):
            tops.append(n)
        elif not never_article(n):
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]
    blocks = [b for t in tops for b in text_of(t, True)]
    return "\n".join(blocks or text_of(root, False))


def host(url: str = "url") -> Column:
    """Lower-case host of an address; empty for null and for addresses without one."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1),
                              F.lit("")))


def _vouched(on_page: DataFrame, own: DataFrame) -> DataFrame:
    """(host, subtree, vouched): on how many pages with different content the subtree stands beside text of the page's own.

    ``on_page``: host, key, content, subtree, count, size (of a text block, else null), could_be (template)."""
    # a page's recurring elements; no more than the page has
    page = on_page.groupBy("host", "key", "content").agg(F.collect_list(F.struct("subtree", "count", "size", "could_be")).alias("e"))
    page = page.join(own, "key").withColumn("own", F.col("total_size") - F.aggregate(
        "e", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["size"], F.lit(0).cast("long"))))
    at = page.select("host", "content", "own", "e", F.explode(F.filter("e", lambda x: x["could_be"])).alias("s"))
    together = F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + F.when(
        (x["count"] * 2 >= F.col("s.count")) & (x["count"] <= F.col("s.count") * 2),
        F.coalesce(x["size"], F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")))
    for_it = at.where(F.col("own") >= OWN * together).select("host", F.col("s.subtree").alias("subtree"), "content")
    return for_it.distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("vouched"))


def template_subtrees(hashed: DataFrame, least_pages: int, least_share: float, many_pages: int) -> tuple[DataFrame, DataFrame]:
    """(host, subtree) that are template, and the elements on each page that recur.

    ``hashed``: host, key, content, subtrees (hashes that could be template), blocks (array of struct<h, size>)."""
    blocks = F.col("blocks")
    every = F.array_union(F.col("subtrees"), F.transform(blocks, lambda b: b["h"]))
    every = F.concat(F.array(F.lit(None).cast("long")), every)  # null: the page itself, for the host's number of pages
    trees = hashed.select("host", "key", "content", "subtrees", "blocks", F.explode(every).alias("subtree"))
    # Two steps, so that a host with a third of the pages is counted on many tasks.
    seen = trees.select("host", "subtree", "content").distinct().groupBy("host", "subtree").count()
    often = written(seen.where((F.col("subtree").isNull()) | (F.col("count") >= least_pages)), "html-often")
    total = often.where("subtree is null").select("host", F.col("count").alias("total"))
    often = often.where("subtree is not null")
    size = F.get(F.filter(blocks, lambda b: b["h"] == F.col("subtree")), F.lit(0))["size"]
    on_page = trees.where("subtree is not null").select(
        "host", "key", "content", "subtree", size.alias("size"), F.array_contains("subtrees", F.col("subtree")).alias("could_be"))
    on_page = written(on_page.join(often, ["host", "subtree"]).distinct(), "html-recurring")
    own = hashed.select("key", F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + b["size"]).alias("total_size")).distinct()
    counted = often.join(total, "host").join(_vouched(on_page, own), ["host", "subtree"], "left")
    vouched = F.coalesce("vouched", F.lit(0))
    share = (F.col("count") >= least_share * F.col("total")) & (vouched >= least_pages)
    many = (vouched >= many_pages) & (F.col("subtree").bitwiseAND(F.lit(1)) == 0)
    most = F.col("count") * 2 >= F.col("total")
    return counted.where(share | many | most).select("host", "subtree"), on_page


def extract(pages: DataFrame, least_pages: int = 5, least_share: float = 0.2,
            many_pages: int = 15) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages`` (page_id, url, html).

    A subtree is template if it occurs on at least ``least_pages`` pages with
    different content of its host, and on half of them, or on at least ``least_share`` of them and beside own text on
    ``least_pages``, or, but for BY_SHARE, beside own text on at least ``many_pages``, whatever the size of the host. Null and empty
    pages have an empty text. Pages without a host share the empty host.
    Repeated rows each get their row, and count once for the template. Other columns of ``pages`` are not read. An empty table gives
    no rows. A page is parsed whole, in one task.
    """
    rows = pages.select("page_id", "url", "html", host().alias("host"), F.xxhash64("url", "html").alias("key"))
    block = pa.list_(pa.struct([("h", pa.int64()), ("size", pa.int64())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, subtrees, blocks = [], [], []
            for t in b.column(2).to_pylist():
                page, got, texts = candidates(parse(t))
                content.append(page)
                subtrees.append(sorted(got))
                blocks.append([{"h": h, "size": size} for h, size in sorted(texts.items())])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(content, pa.int64()), pa.array(subtrees, pa.list_(pa.int64())),
                 pa.array(blocks, block)], names=["host", "key", "content", "subtrees", "blocks"])

    # One row of hashes a page, written once, as both the counts and the pages' deletions read it.
    hashed = written(rows.select("host", "key", "html").mapInArrow(
        found, "host string, key long, content long, subtrees array<long>, blocks array<struct<h:bigint,size:bigint>>"),
        "html-subtrees")
    template, recurring = template_subtrees(hashed, least_pages, least_share, many_pages)
    on_page = (recurring.where("could_be").select("host", "key", "subtree").join(template, ["host", "subtree"])
               .groupBy("key").agg(F.collect_set("subtree").alias("template")))  # at most a page's elements
    joined = rows.join(on_page, "key", "left").select("page_id", "url", "html", "template")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(parse(h), frozenset(t or ())) if h else ""
                   for h, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(texts, schema_of(pages, ["page_id", "url"], "text string, n_chars long"))
