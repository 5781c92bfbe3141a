"""Main text of web pages by site style trees.

Pages of one host are merged into a style tree: a node is the path of tags and classes from the host's root, and it
gathers the contents (own text of its block) and presentations (tags and classes of its children) of all pages. With m
pages that have the node, a content on c of them has the entropy log c / log m, and the importance of the node's own
text is one minus the mean entropy of its contents: 0 if all pages say the same, 1 if no two do. The composite
importance of a node with l presentations mixes their entropy with the mean composite importance of its children and
own text, (1 - 0.9**l) : 0.9**l. A branch of a page is noise if the composite importance of its top and of all blocks
below lies under ``importance`` times that of the host's node with the most text; so articles that were crawled many
times don't turn into noise. Noise branches go from each page, headings only with what they head, and never a branch
that holds half of the page's text. Inside an article just what says nearly the same everywhere goes, under ``inside``.

Nodes of fewer than ``min_pages`` distinct pages aren't judged; there, and beside the tree, what markup itself names
as boilerplate goes: menus, headers, footers, sidebars, notices, adverts, forms, scripts, reader comments. The text of
``article`` elements remains, or else of ``main``, or else of the body.

Equal pages of a host count once. Counts meet in partial aggregates, so a host with a third of all pages is no hot
spot. Judged nodes go to the executors while they are at most ``broadcast_nodes``; beyond that they are joined to the pages.

Defined results: null or empty html gives an empty text; a null url is a host of its own; repeated rows give repeated
results; unclosed and stray tags, truncated markup and unknown references are read as browsers do, roughly.
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

from .scratch import materialize

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:[\"'][^>]*)?>?|<[!?][^>]*>?", re.S)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_ENDS_P = _BLOCK - {"body", "html"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
_NOISE_TAGS = frozenset("nav footer aside form script style noscript template iframe button select input textarea svg canvas dialog menu head title object embed audio video map".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer header masthead topbar comment comments disqus".split())
_QUALIFIERS = frozenset("site page global main top bottom left right primary secondary upper lower area bar box block container content inner item items link links list outer region section slot space unit wrap wrapper".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Node:
    """An element; its key is the node of the site's style tree."""

    __slots__ = ("attrs", "children", "key", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, host: str = "") -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        own = f"{tag}.{attrs.get('class', '')}"
        self.key = xxhash.xxh64_intdigest(f"{parent.key}>{own}" if parent else f"{host}\0{own}") - (1 << 63)


def parse(source: str, host: str = "") -> Node:
    """A tree of elements and decoded texts; void elements are leaves, scripts and the like are dropped with their text."""
    root = here = Node("#root", {}, None, host)
    at = 0
    for_raw = None
    for m in iter(lambda: _TOKEN.search(source, at), None):
        if m.start() > at:
            here.children.append(html.unescape(source[at : m.start()]))
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            node = here
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node is not root:
                here = node.parent
            continue
        if tag in _RAW:
            for_raw = _RAW[tag].search(source, at)
            at = for_raw.end() if for_raw else len(source)
            continue
        shut = _CLOSES.get(tag)
        if shut or tag in _ENDS_P:
            scope = _SCOPE.get(tag, frozenset())
            node = here
            while node is not root and node.tag not in scope:
                if (shut and node.tag in shut) or (node.tag == "p" and tag in _ENDS_P):
                    here = node.parent
                elif node.tag in _BLOCK and node.tag != "p" and not (shut and tag != "li" and node.tag in ("tbody", "thead", "tfoot")):
                    break
                node = node.parent
        attrs = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(m[3])} if m[3].strip(" /") else {}
        node = Node(tag, attrs, here)
        here.children.append(node)
        if tag not in _VOID:
            here = node
    if at < len(source):
        here.children.append(html.unescape(source[at:]))
    return root


def _names_noise(value: str) -> bool:
    """Whether a class or id names boilerplate: a word of it alone, or with nothing but words of place and shape."""
    for name in value.lower().split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if any(w in _NOISE_WORDS for w in words) and all(w in _NOISE_WORDS or w in _QUALIFIERS for w in words):
            return True
    return False


def _holds_title(node: Node) -> bool:
    todo = [node]
    while todo:
        for c in todo.pop().children:
            if not isinstance(c, str):
                if c.tag == "h1":
                    return True
                todo.append(c)
    return False


def named_noise(node: Node, in_article: bool) -> bool:
    """Whether the markup itself calls the branch boilerplate."""
    a = node.attrs
    if node.tag in _NOISE_TAGS or (node.tag == "header" and not in_article):
        return True
    if not a:
        return False
    if a.get("role", "").lower() in _NOISE_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
        return True
    names = f"{a.get('class', '')} {a.get('id', '')}"
    if node.tag in ("article", "main", "body", "html"):
        return node.tag == "article" and bool(set(names.lower().split()) & {"comment", "comments"})
    if not _names_noise(names):
        return False
    return "head" not in names.lower() or not _holds_title(node)


def host_of(url: str | None) -> str:
    return re.sub(r"^(?:[\w+.-]+:)?//", "", url or "").split("/")[0].split("?")[0].split("#")[0].lower()


def _blocks(root: Node) -> list[tuple[Node, int, list[str]]]:
    """Block elements in order of the page, each with the number of the block around it and the parts of its own text."""
    out: list[tuple[Node, int, list[str]]] = [(root, -1, [])]
    frames = [(iter(root.children), 0)]
    while frames:
        left, at = frames[-1]
        for c in left:
            if isinstance(c, str):
                out[at][2].append(c)
                continue
            if c.tag in _BLOCK:
                out.append((c, at, []))
                frames.append((iter(c.children), len(out) - 1))
            else:
                out[at][2].append(" ")
                frames.append((iter(c.children), at))
            break
        else:
            frames.pop()
    return out


PRESENT, CONTENT, SHAPE = 0, 1, 2


def node_facts(root: Node) -> Iterator[tuple[int, int, int, int]]:
    """(node, kind, value, length): that a page has the node, the contents of the node, and its presentations."""
    blocks = _blocks(root)
    for node, _, parts in blocks:
        text = " ".join("".join(parts).split())
        yield node.key, PRESENT, 0, 0
        if text:
            yield node.key, CONTENT, xxhash.xxh64_intdigest(text) - (1 << 63), len(text)
        shape = ",".join(f"{c.tag}.{c.attrs.get('class', '')}" for c in node.children if not isinstance(c, str))
        if shape:
            yield node.key, SHAPE, xxhash.xxh64_intdigest(shape) - (1 << 63), 0


def severities(root: Node, judged: dict[int, tuple[float, float, float, float]]) -> dict[int, float]:
    """id(block) -> the largest share of its limit that the composite importance of the block or one below it reaches.

    judged: for each node of the style tree the importance of its own text, what its presentations add, the weight of
    its children, and its limit. Blocks that hold an unjudged block with text aren't in the result.
    """
    blocks = _blocks(root)
    total, count, worst = [0.0] * len(blocks), [0] * len(blocks), [0.0] * len(blocks)
    out: dict[int, float] = {}
    for k in range(len(blocks) - 1, -1, -1):
        node, around, parts = blocks[k]
        own = any(p and not p.isspace() for p in parts)
        if not own and not count[k]:
            continue
        found = judged.get(node.key)
        if found is None:
            comp, share = 1.0, float("inf")
        else:
            importance, shapes, weight, limit = found
            comp = importance if not count[k] else shapes + weight * (total[k] + (importance if own else 0.0)) / (count[k] + own)
            share = comp / limit if limit else float("inf")
        worst[k] = max(worst[k], share)
        if worst[k] < 1:
            out[id(node)] = worst[k]
        if around >= 0:
            total[around] += comp
            count[around] += 1
            worst[around] = max(worst[around], worst[k])
    return out


def _sizes(root: Node) -> dict[int, int]:
    """id(element) -> characters of its text."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in node.children if not isinstance(c, str))
    out: dict[int, int] = {}
    for node in reversed(order):
        out[id(node)] = sum(len(c.strip()) if isinstance(c, str) else out[id(c)] for c in node.children)
    return out


def main_text(root: Node, judged: dict | None = None, inside: float = 0.2) -> str:
    """Blocks of the main text, joined by newlines."""
    articles: list[Node] = []
    mains: list[Node] = []
    bodies: list[Node] = []

    todo = root.children[::-1]
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            continue
        if c.tag == "body" and not bodies:
            bodies.append(c)
        if named_noise(c, False):
            continue
        if c.tag == "article" or c.attrs.get("itemprop") == "articleBody":
            articles.append(c)
        else:
            if c.tag == "main" or c.attrs.get("role") == "main":
                mains.append(c)
            todo.extend(c.children[::-1])

    tops = articles or mains[:1] or bodies or [root]
    low = severities(root, judged) if judged else {}
    limit = inside if articles else 1.0
    sizes = _sizes(root) if low else {}
    whole = sum(sizes[id(top)] for top in tops) if low else 0
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    def walk(top: Node, in_article: bool) -> None:
        frames = [(iter(top.children), False)]
        while frames:
            left, block = frames[-1]
            for c in left:
                if isinstance(c, str):
                    line.append(c)
                    continue
                if named_noise(c, in_article) or (low.get(id(c), 1.0) < limit and c.tag not in _HEADINGS and 2 * sizes[id(c)] < whole):
                    flush()
                    continue
                if c.tag in _BLOCK:
                    flush()
                elif c.tag in ("br", "td", "th", "img"):
                    line.append(" ")
                frames.append((iter(c.children), c.tag in _BLOCK))
                break
            else:
                frames.pop()
                if block:
                    flush()

    for top in tops:
        walk(top, bool(articles))
        flush()
    return "\n".join(blocks)


_FACTS = "host long, page long, node long, kind int, value long, length long"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            rows: list[tuple[int, int, int, int, int, int]] = []
            for url, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if source:
                    host = host_of(url)
                    own = list(dict.fromkeys(node_facts(parse(source, host))))
                    page = xxhash.xxh64_intdigest(np.array([(x[0], x[2]) for x in own if x[1] == CONTENT], np.int64).tobytes()) - (1 << 63)
                    h = xxhash.xxh64_intdigest(host) - (1 << 63)
                    rows.extend((h, page, *x) for x in own)
            cols = np.array(rows, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([pa.array(cols[:, j].astype(np.int32) if j == 3 else cols[:, j]) for j in range(6)], ["host", "page", "node", "kind", "value", "length"])


def judged_nodes(pages: DataFrame, min_pages: int, importance: float, gamma: float = 0.9) -> DataFrame:
    """(node, own, shapes, weight, limit) of the nodes on ``min_pages`` distinct pages that can lie below their limit."""
    facts = pages.mapInArrow(_facts, _FACTS)
    distinct = facts.groupBy("host", "node", "kind", "value", "page").agg(F.max("length").alias("length"))
    counts = distinct.groupBy("host", "node", "kind", "value").agg(F.count("*").alias("c"), F.sum("length").alias("length"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    c, spread = F.col("c"), F.col("c") * F.log("c")
    per = counts.groupBy("host", "node").agg(
        of(PRESENT, c).alias("m"), of(CONTENT, c).alias("n"), of(CONTENT, spread).alias("s"), of(SHAPE, c).alias("n_shape"), of(SHAPE, spread).alias("s_shape"),
        of(SHAPE, F.lit(1)).alias("l"), of(CONTENT, F.col("length")).alias("length"),
    )
    m = F.log("m")
    own = F.when(F.col("m") > 1, 1 - F.col("s") / F.col("n") / m).otherwise(1.0)
    shapes = F.when(F.col("m") > 1, F.least(F.lit(1.0), (F.log("n_shape") - F.col("s_shape") / F.col("n_shape")) / m)).otherwise(1.0)
    weight = F.pow(F.lit(gamma), F.coalesce("l", F.lit(0)))
    nodes = per.select("host", "node", "m", F.coalesce(own, F.lit(1.0)).alias("own"), ((1 - weight) * F.coalesce(shapes, F.lit(0.0))).alias("shapes"), weight.alias("weight"), F.coalesce("length", F.lit(0)).alias("length"), F.col("n").isNotNull().alias("texts"))
    nodes = materialize(nodes, "style_tree")
    most = nodes.where("texts").groupBy("host").agg(F.max(F.struct("length", "own")).alias("x")).select("host", (F.col("x.own") * importance).alias("limit"))
    judged = nodes.where(F.col("m") >= min_pages).join(most, "host")
    return judged.where(F.when(F.col("texts"), F.least("own", "shapes")).otherwise(F.col("shapes")) < F.col("limit")).select("node", "own", "shapes", "weight", "limit")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 8, importance: float = 0.85, inside: float = 0.2, broadcast_nodes: int = 200_000) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    min_pages: distinct pages from which a node is judged. importance: share of the importance of the host's main node
    below which a branch is noise. inside: the share of that limit which holds inside articles.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    judged = materialize(judged_nodes(base.select("url", "html"), min_pages, importance), "judged")
    schema = f"page_id {base.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def texts(b: pa.RecordBatch, judged_of) -> pa.RecordBatch:
        out = [main_text(parse(source, host_of(url)), judged_of(i), inside) if source else "" for i, (url, source) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    if judged.count() <= broadcast_nodes:
        rows = judged.toArrow().to_pydict()
        shared = pages.sparkSession.sparkContext.broadcast(dict(zip(rows["node"], zip(*(rows[c] for c in ("own", "shapes", "weight", "limit")), strict=True), strict=True)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from (texts(b.slice(at, 500), lambda _: shared.value) for at in range(0, b.num_rows, 500))

        return base.mapInArrow(run, schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(3).to_pylist()
            yield texts(b, lambda i, own=own: {x["node"]: (x["own"], x["shapes"], x["weight"], x["limit"]) for x in own[i] or ()})

    key = F.xxhash64("url", "html")
    nodes = base.select(key.alias("page"), "url", "html").mapInArrow(_page_nodes, "page long, node long").distinct()
    of = nodes.join(judged, "node").groupBy("page").agg(F.collect_list(F.struct("node", "own", "shapes", "weight", "limit")).alias("nodes"))
    return base.withColumn("page", key).join(of, "page", "left").select("page_id", "url", "html", "nodes").mapInArrow(joined, schema)


def _page_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(row, node.key) for row, (url, source) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)) if source for node, _, _ in _blocks(parse(source, host_of(url)))]
        cols = np.array(rows, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[:, 0])), pa.array(cols[:, 1])], ["page", "node"])
