"""Main text of web pages.

Method: site style tree. The pages of one host are merged into one tree: a node is the path of block elements with
their classes and ids, its presentations are the sequences of child elements seen under it, its contents the texts
seen in it. A node's importance joins the entropy of its presentations with that of its contents, in the base of the
number of pages that have it: what looks and reads the same on every page is near 0, what differs is near 1. Branches
of low importance are removed from each page, inside and outside of what it marks as its article (or main part). The
mark only raises importance: whole copies of an article are no boilerplate (inside, copies count as one page, and an
article of low branches alone is kept), and where the host has too few pages to tell, what is marked stays and what is
not marked beside it goes.

Some branches differ from page to page and still are no article: elements, roles, classes and ids that mean menus,
headers, footers, sidebars, adverts, forms or comments go whatever their importance. Words that an article's own parts
are called by too (notice, discussion, related ...) count outside of articles only. An article within a branch with
such a name stays where the page has no other. Of several articles those with less than a third of the longest's text
are teasers.

Only counts of hashes leave the pages: they are aggregated by (host, node, item) with partial sums, so a host with a
third of all pages is no large group. Verdicts go to the pages as a short list for each host; hosts with more nodes
than that are joined node by node to what their pages have, so no list grows with a host.

Defined results: null or empty html gives an empty text; a null url is a host of its own; a page without a marked
article is judged by the tree alone; unclosed elements end with their parents; character references are decoded in
each text node by itself; a page of any length or depth is read once, from left to right; repeated rows each count
outside of marked articles; ties of importance with the limit stay; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import over_batches, slices, written

#: A node is low if at least this many pages have it and its importance is below the limit.
MIN_PAGES, MIN_IMPORTANCE = 5, 0.3
#: The weight of presentations against contents in a node's importance.
PRESENTATION = 0.2
#: Nodes that a host's list may have; and the share of the longest article's text that another one needs.
LISTED, TEASER = 10_000, 1 / 3

_TOKEN = re.compile(r"<(?:!--(?:.*?--!?>|.*\Z)|(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|([^>]*+)(?:>|\Z))|[!?][^>]*+(?:>|\Z))", re.DOTALL)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PARTS = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - frozenset("option optgroup head html body".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = frozenset("ul ol menu dir dl table body article main section div".split())
_DROPPED = frozenset("nav footer aside form script style noscript template iframe object svg math canvas button select textarea title head menu dialog search audio video map datalist".split())
_MAIN = frozenset(("article", "main"))
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
_NAMES = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead topbar toolbar footer sidebar ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr popup modal newsletter subscribe login signup share sharing comment comments commentlist disqus copyright pagination pager reply replies respond responses skip".split()
)
#: Names that parts of an article have too.
_WEAK_NAMES = frozenset("aside notice notices alert overlay promotion subscription social related recommended recommendations discussion widget".split())


class Block(NamedTuple):
    """A text block: its node, whether it lies in the article, by which of the page's articles (0: none), what drops it and whether that stands above the article."""

    node: int
    main: bool
    unit: int
    hard: bool
    named: bool
    above: bool
    text: str


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


class _Open:
    """An open element. base: how deep the block element lies that it is or is in."""

    __slots__ = ("above", "base", "children", "hard", "main", "named", "node", "tag", "unit")

    def __init__(self, tag: str, node: int, base: int, main: bool, unit: int, hard: bool, named: bool, above: bool):
        self.tag, self.node, self.base, self.main, self.unit, self.hard, self.named, self.above = tag, node, base, main, unit, hard, named, above
        self.children: list[str] = []


_nodes: dict[tuple, int] = {}


def _node(parent: int, tag: str, name: str) -> int:
    key = (parent, tag, name)
    if key not in _nodes:
        if len(_nodes) > 200_000:
            _nodes.clear()
        _nodes[key] = _hash(parent, tag, name)
    return _nodes[key]


def _called(attrs: str) -> tuple[str, bool, bool, bool]:
    """What a tag's class and id are, and whether its role, a name, or a weak name tells that it is no article."""
    found = [(a.lower(), x or y or z) for a, x, y, z in _ATTR.findall(attrs)]
    role = named = weak = False
    for a, v in found:
        if a == "role":
            role = role or v.strip().lower() in _ROLES
        else:
            words = _PARTS.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", v).lower())
            named = named or not _NAMES.isdisjoint(words)
            weak = weak or not _WEAK_NAMES.isdisjoint(words)
    return " ".join([f"{a}={v}" for a, v in found if a != "role"]), role, named, weak


def parse(html: str) -> tuple[list[Block], list[tuple[int, bool, str]]]:
    """The text blocks and the elements (node, in the article, children) of a page."""
    stack = [_Open("", 0, 0, False, 0, False, False, False)]
    blocks: list[Block] = []
    elements: list[tuple[int, bool, str]] = []
    buffer: list[tuple[bool, str]] = []
    open_tags: Counter[str] = Counter()
    units = 0

    def flush() -> None:
        if buffer:
            top = stack[stack[-1].base]
            for dropped in (False, True):
                text = " ".join("".join([t for d, t in buffer if d == dropped]).split())
                if text:
                    blocks.append(Block(top.node, top.main, top.unit, top.hard, dropped or top.named, top.above, text))
            buffer.clear()

    def put(text: str) -> None:
        top = stack[-1]
        buffer.append((top.hard or top.named, unescape(text)))

    def close(depth: int) -> None:
        while len(stack) > depth:
            gone = stack.pop()
            open_tags[gone.tag] -= 1
            if gone.tag in _BLOCK:
                elements.append((gone.node, gone.main, " ".join(gone.children)))

    def last(tags: tuple[str, ...], stop: frozenset[str]) -> int:
        """The depth of the innermost open block of tags with none of stop inside it, or 0. Not looked for where none is open."""
        depth = stack[-1].base if any(open_tags[t] for t in tags) else 0
        while depth > 0:
            if stack[depth].tag in tags:
                return depth
            if stack[depth].tag in stop:
                return 0
            depth = stack[depth - 1].base
        return 0

    at, n = 0, len(html)
    for m in _TOKEN.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at:
            put(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in _BLOCK:
                flush()
            if open_tags[tag]:  # what is passed on the way is closed too
                close(next(d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == tag))
            continue
        block = tag in _BLOCK
        if block:
            flush()
            if tag in _ENDS_P and (depth := last(("p",), _BLOCK)):
                close(depth)
            if tag in _SAME and (depth := last(_SAME[tag], _LISTS)):
                close(depth)
        top = stack[-1]
        if tag in _RAW:
            end = re.compile(f"</{tag}", re.IGNORECASE).search(html, at)
            at = end.start() if end else n
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                buffer.append((top.hard or top.named, "\n"))
            continue
        attrs, name, role, named, weak = m[3] or m[4] or "", "", False, False, False
        if attrs:
            name, role, named, weak = _called(attrs)
        hard = top.hard or tag in _DROPPED or role or (tag == "header" and not top.main)
        main, above = top.main or tag in _MAIN, top.above
        if main and not top.main:  # what the branches above are called is told apart
            above = top.named
            top_named = False
        else:
            top_named = top.named
        unit = top.unit
        if tag == "article" and not unit:
            units += 1
            unit = units
        own = tag not in ("html", "body") and (named or (weak and block and not main))
        if block:
            top.children.append(tag)
        stack.append(_Open(tag, _node(top.node, tag, name) if block else top.node, len(stack) if block else top.base, main, unit, hard, top_named or own, above))
        open_tags[tag] += 1
    if at < n:
        put(html[at:])
    flush()
    close(1)
    return blocks, elements


def main_text(html: str | None, low: set[int], high: set[int] = frozenset()) -> str:
    """The text of a page without what its names drop and without the low nodes of its host.

    Beside a marked article only the nodes in high stay, those the host's tree finds important.
    """
    blocks, _ = parse(html or "")
    open_ = [b for b in blocks if not b.hard and not b.named]
    if any(b.main and not b.above for b in open_):
        open_ = [b for b in open_ if not b.above]
    marked = [b for b in open_ if b.main]
    if not marked:
        return "\n\n".join([b.text for b in open_ if b.node not in low])
    copied = all(b.node in low for b in marked)
    length = Counter()
    for b in marked:
        length[b.unit] += len(b.text) * (b.unit > 0)
    least = TEASER * max(length.values())
    stays = lambda b: (copied or b.node not in low) and (not b.unit or length[b.unit] >= least) if b.main else b.node in high
    return "\n\n".join([b.text for b in open_ if stays(b)])


def _host(pages: DataFrame, url: str) -> DataFrame:
    name = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]*)", 1))
    return pages.withColumn("site_", F.xxhash64(name))


def style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """site, node, outside (of articles), pages, importance of every node of every host's style tree; in articles, pages are different articles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 8 << 20):
                counts: dict[tuple[int, int, int, int, int | None], int] = {}
                for site, html in zip(part.column("site_").to_pylist(), part.column("html").to_pylist(), strict=True):
                    blocks, elements = parse(html or "")
                    article = _hash(*(b.text for b in blocks if b.main and not b.hard and not b.named))
                    seen = {(site, b.node, 1, _hash(b.text), article if b.main else None) for b in blocks}
                    seen |= {(site, node, 0, _hash(children), article if main else None) for node, main, children in elements}
                    seen |= {(site, node, 2, 0, copy) for _, node, _, _, copy in seen}
                    for k in seen:
                        counts[k] = counts.get(k, 0) + 1
                if counts:
                    cols = [*zip(*counts, strict=True), list(counts.values())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["site", "node", "kind", "item", "article", "n"])

    items = over_batches(_host(pages, url).select("site_", F.col(html).alias("html")), run, "site long, node long, kind int, item long, article long, n long")
    # copies of an article count once
    items = items.groupBy("site", "node", "kind", "item", "article").agg(F.sum("n").alias("n"))
    items = items.groupBy("site", "node", "kind", "item").agg(F.sum(F.when(F.col("article").isNull(), F.col("n")).otherwise(1)).alias("n"), F.bool_or(F.col("article").isNull()).alias("outside"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0.0))
    weight = F.col("n") * F.ln("n")
    nodes = items.groupBy("site", "node").agg(
        F.bool_or("outside").alias("outside"),
        of(2, F.col("n")).cast("long").alias("pages"), of(0, F.col("n")).alias("styles"), of(0, weight).alias("style_log"), of(1, F.col("n")).alias("texts"), of(1, weight).alias("text_log")
    )
    base = F.ln(F.greatest("pages", F.lit(2)))
    presentation = F.when(F.col("styles") > 0, (F.ln("styles") - F.col("style_log") / F.col("styles")) / base).otherwise(0.0)
    content = F.when(F.col("texts") > 0, 1 - F.col("text_log") / F.col("texts") / base).otherwise(0.0)
    importance = F.when(F.col("pages") < 2, 1.0).when(F.col("texts") == 0, presentation).otherwise(PRESENTATION * presentation + (1 - PRESENTATION) * content)
    return nodes.select("site", "node", "outside", "pages", importance.alias("importance"))


def _texts(pages: DataFrame, names: list[str]) -> DataFrame:
    """names of pages with the text that site_, html_ and the node lists low and high leave."""
    kinds = "".join(f"{c} {pages.schema[c].dataType.simpleString()}, " for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html_", 8 << 20):
                lists: dict[int, tuple[set[int], set[int]]] = {}
                found = []
                for i, (of, html) in enumerate(zip(part.column("of_").to_pylist(), part.column("html_").to_pylist(), strict=True)):
                    if of not in lists:
                        lists[of] = tuple(set(part.column(c)[i].as_py() or ()) for c in ("low", "high"))
                    found.append(main_text(html, *lists[of]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[*names, "text", "n_chars"])

    return over_batches(pages.select(*names, "of_", "html_", "low", "high"), run, f"{kinds}text string, n_chars long")


def _page_nodes(pages: DataFrame) -> DataFrame:
    """site_, of_ and each node of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html_", 8 << 20):
                rows = {(site, of, b.node) for site, of, html in zip(*(part.column(c).to_pylist() for c in ("site_", "of_", "html_")), strict=True) for b in parse(html or "")[0]}
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["site_", "of_", "node"])

    return over_batches(pages.select("site_", "of_", "html_"), run, "site_ long, of_ long, node long").distinct()


def extract(pages: DataFrame, keep: list[str], url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """Columns keep of pages, text and n_chars."""
    tree, is_low = style_tree(pages, url, html).where(F.col("pages") >= min_pages), F.col("importance") < min_importance
    judged = written(tree.where(is_low | F.col("outside")).select(F.col("site").alias("site_"), "node", is_low.alias("is_low")))
    of = lambda condition, name: F.collect_set(F.when(condition, F.col("node"))).alias(name)  # noqa: E731  an aggregate leaves nulls out
    lists = [of(F.col("is_low"), "low"), of(~F.col("is_low"), "high")]
    number = judged.groupBy("site_").agg(F.count("*").alias("n"))
    large = written(number.where(F.col("n") > LISTED).select("site_"))
    names = [f"k{i}" for i in range(len(keep))]
    own = [F.col(c).alias(n) for c, n in zip(keep, names, strict=True)]
    frame = _host(pages, url).select(*own, "site_", F.col(html).alias("html_"))
    short = written(judged.join(large, "site_", "left_anti").groupBy("site_").agg(*lists))
    if large.isEmpty():
        out = _texts(frame.join(short, "site_", "left").withColumn("of_", F.col("site_")), names)
    else:
        out = _texts(frame.join(large, "site_", "left_anti").join(short, "site_", "left").withColumn("of_", F.col("site_")), names)
        # pages of hosts with many nodes get the verdicts of the nodes they have
        paged = frame.join(large, "site_", "left_semi").withColumn("of_", F.xxhash64("site_", "html_"))
        found = written(_page_nodes(paged).join(judged, ["site_", "node"]).groupBy("of_").agg(*lists))
        out = out.unionByName(_texts(paged.join(found, "of_", "left"), names))
    return out.withColumnsRenamed(dict(zip(names, keep, strict=True)))
